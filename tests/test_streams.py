"""Streams in several batches: what one batch leaves is there in the next."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from tracewell.operators import bank, rules
from tracewell.streaming import detectors as D
from tracewell.streaming.state import Buckets

SCHEMA = "event_id long, subscriber long, ts timestamp, device string, domain string"


def at(h):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)


def stream(spark, path, files):
    """Each file is a batch, in the order of writing."""
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


FILES = [
    [(1, 1, at(0), "a", "voice"), (2, 1, at(30), None, "voice"), (3, 2, at(1), "x", "data"), (9, 1, at(2), "q", "data")],
    [(4, 1, at(40), "a", "voice"), (5, 1, at(41), "b", "voice"), (6, 2, at(12.9), "x", "data"), (10, None, at(50), "z", "voice")],
    [(7, 1, at(53), "b", "voice"), (8, 2, at(25), "y", "data"), (11, 1, at(20), "c", "voice")],
]


def test_alerts_over_batches(spark, tmp_path):
    s = stream(spark, str(tmp_path / "in"), FILES)
    D.inactivity_alerts(s, "subscriber", "event_id", str(tmp_path / "gaps"), str(tmp_path / "s1"))
    got = sorted((r["event_id"], r["gap_s"]) for r in spark.read.parquet(str(tmp_path / "gaps")).collect())
    assert got == [(2, 28 * 3600), (7, 12 * 3600), (8, int(12.1 * 3600))]  # 6 comes 11.9 h after 3; 11 is late
    D.device_change_alerts(s, "subscriber", "event_id", str(tmp_path / "devices"), str(tmp_path / "s2"))
    got = sorted((r["event_id"], r["domain"], r["from_device"], r["to_device"]) for r in spark.read.parquet(str(tmp_path / "devices")).collect())
    assert got == [(5, "voice", "a", "b"), (8, "data", "x", "y")]
    assert len(list((tmp_path / "s2" / "newest").glob("batch=*"))) == 2  # older marks are removed


def test_forgotten_keys(spark, tmp_path):
    files = [[(1, 1, at(0), "a", "voice"), (2, 2, at(24 * 20), "a", "voice")], [(3, 1, at(24 * 40), "b", "voice"), (4, 2, at(24 * 41), "b", "voice")]]
    s = stream(spark, str(tmp_path / "in"), files)
    D.device_change_alerts(s, "subscriber", "event_id", str(tmp_path / "out"), str(tmp_path / "state"), ttl_days=10)
    assert [r["event_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [4]


def test_records_are_compared_over_days(spark):
    rows = [(i, i % 2, at(7 * i), f"d{i}", "v") for i in range(40)] + [(99, 5, at(1), "z", "v")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["event_id"]: r["last_device"] for r in D.after_each(df, ["subscriber"], "event_id", ["device"]).collect()}
    assert got == {i: (f"d{i - 2}" if i >= 2 else None) for i in range(40)} | {99: None}
    assert D.after_each(df.limit(0), ["subscriber"], "event_id", ["ts"]).where(F.col("last_ts").isNotNull()).count() == 0


def files(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("bucket=*"))


def test_a_batch_touches_the_buckets_of_its_keys(spark, tmp_path):
    """Two hundred keys, then one: of the 64 buckets the second batch writes that key's and the one whose turn it is."""
    many = [[(i, i, at(0), "a", "voice") for i in range(200)], [(999, 7, at(1), "b", "voice")], [(1000, 7, at(2), "c", "voice")]]
    s = stream(spark, str(tmp_path / "in"), many)
    D.device_change_alerts(s, "subscriber", "event_id", str(tmp_path / "out"), str(tmp_path / "state"), buckets=64)
    got = sorted((r["event_id"], r["from_device"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(999, "a"), (1000, "b")]
    written = files(tmp_path / "state" / "last")
    assert len([f for f in written if f.startswith("batch=0/")]) > 50
    assert 1 <= len([f for f in written if f.startswith("batch=1/")]) <= 2 and 1 <= len([f for f in written if f.startswith("batch=2/")]) <= 2
    state = Buckets(spark, str(tmp_path / "state" / "last"), ["subscriber", "domain"], spark.createDataFrame([], "subscriber long, domain string").schema, 64)
    assert all(len(v) <= 2 for v in state.versions(99).values())  # the last version and the one before it


def test_a_batch_that_failed_is_run_again(spark, tmp_path, monkeypatch):
    """The stream breaks off in its second batch, after that wrote its state, and goes on from there."""
    s = stream(spark, str(tmp_path / "in"), FILES)
    run = lambda to: D.inactivity_alerts(s, "subscriber", "event_id", str(tmp_path / to), str(tmp_path / f"state-{to}"))
    run("whole")
    clean, left = Buckets.clean, [1]

    def breaks(self, batch):
        if batch == 1 and left and left.pop():
            raise RuntimeError("lost")
        clean(self, batch)

    monkeypatch.setattr(Buckets, "clean", breaks)
    with pytest.raises(Exception, match="lost"):
        run("broken")
    run("broken")
    both = [sorted((r["event_id"], r["gap_s"]) for r in spark.read.parquet(str(tmp_path / d)).collect()) for d in ("whole", "broken")]
    assert both[0] == both[1] and len(both[0]) == 3


MONEY = "key long, amount double, tx_id long, tags array<string>"


def test_rolling_risk_is_the_risk_of_all_rows_so_far(spark, tmp_path):
    batches = [
        [(1, -50.0, 1, ["gambling"]), (1, 950.0, 2, None), (2, 10.0, 3, ["crypto", "GAMBLING", "Crypto"]), (3, 5.0, 4, [])],
        [(1, 100.0, 5, ["crypto"]), (None, 1.0, 6, ["crypto"])],
        [(2, 1e6, 7, []), (4, 3.0, 8, ["loans", None])],
    ]
    weights = spark.createDataFrame([("GAMBLING", 30.0), ("CRYPTO", 25.0), ("LOANS", 80.0)], "tag string, weight double")
    for n in (1, 2, 3):
        d = str(tmp_path / str(n))
        for rows in batches[:n]:
            spark.createDataFrame(rows, MONEY).coalesce(1).write.mode("append").parquet(f"{d}/in")
            time.sleep(1.1)
        s = spark.readStream.schema(MONEY).option("maxFilesPerTrigger", 1).parquet(f"{d}/in")
        D.rolling_risk(s, "key", weights, f"{d}/out", f"{d}/state", buckets=8)
        df = spark.createDataFrame([r for b in batches[:n] for r in b], MONEY).where("key is not null")
        tags = df.select("key", "amount", "tx_id", F.explode("tags").alias("tag")).where("tag is not null").withColumn("tag", F.upper("tag")).distinct()
        whole = {r["key"]: (r["score"], r["reasons"]) for r in bank.risk_score(tags, weights, df.groupBy("key").agg(F.sum(F.abs("amount")).alias("total")), "key").collect()}
        got = {r["key"]: r for r in D.latest_risk(spark, f"{d}/out", "key").collect()}
        assert {k: (r["score"], r["reasons"]) for k, r in got.items()} == {k: whole.get(k, (0.0, 0)) for k in {r[0] for b in batches[:n] for r in b if r[0]}}
    assert {k: r["version"] for k, r in got.items()} == {1: 1, 2: 2, 3: 0, 4: 2}


def test_a_rule_added_between_batches_takes_effect(spark, tmp_path):
    schema, own = "tx_id long, title string", "kind string, category string, subcategory string, pattern string, priority int"
    put = lambda rows: D.put_version(spark.createDataFrame(rows, own), str(tmp_path / "rules"))
    feed = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    found = lambda df, now: rules.classify(df, now["rules"], "tx_id", "title", {})

    def run():
        s = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        D.by_rules(s, str(tmp_path / "out"), str(tmp_path / "state"), {"rules": str(tmp_path / "rules")}, found)

    assert put([("category", "fuel", "x", "orlen", 1)]) == 1
    feed([(1, "Orlen 7"), (2, "Lidl")])
    run()
    assert put([("category", "fuel", "x", "orlen", 1), ("category", "food", "y", "lidl", 2)]) == 2
    feed([(3, "Orlen 8"), (4, "Lidl")])
    run()
    got = {r["tx_id"]: (r["category"], r["rules_version"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: ("fuel", 1), 2: ("unclassified", 1), 3: ("fuel", 2), 4: ("food", 2)}


def test_a_batch_run_again_reads_the_versions_it_read_before(spark, tmp_path):
    put = lambda x: D.put_version(spark.createDataFrame([(x,)], "word string"), str(tmp_path / "words"))
    put("old")
    spark.createDataFrame([(1,)], "id long").coalesce(1).write.parquet(str(tmp_path / "in"))
    fails = [True]

    def found(df, now):
        if fails and fails.pop():
            raise RuntimeError("lost")
        return df.crossJoin(F.broadcast(now["words"]))  # one word

    def run():
        D.by_rules(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), {"words": str(tmp_path / "words")}, found)

    with pytest.raises(Exception, match="lost"):
        run()
    put("new")
    run()
    assert [(r["word"], r["words_version"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("old", 1)]
