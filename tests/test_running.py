"""Groups of any size: running numbers and sums, ranks, and matching within a tolerance."""

import random
from collections import Counter, defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tracewell.operators import ranks, reconcile, running
from tracewell.sources import scratch


def test_numbers_of_one_large_group(spark):
    """A group with most of the rows is in several parts; nulls, ties and descending order are kept."""
    df = spark.range(4000).select(F.when(F.col("id") % 10 != 0, "big").when(F.col("id") % 3 == 0, "s").alias("g"), (F.col("id") * 7919 % 401).alias("v"), "id")
    got = running.numbered(df, ["g"], [F.desc("v"), F.col("id")]).collect()
    rows = defaultdict(list)
    for r in got:
        rows[r["g"]].append((r["n"], -r["v"], r["id"]))
    assert set(rows) == {"big", "s", None}
    for v in rows.values():
        assert [n for n, *_ in sorted(v)] == list(range(1, len(v) + 1)) and [x[1:] for x in sorted(v)] == sorted(x[1:] for x in v)
    assert got[0].asDict().keys() == {"g", "v", "id", "n"}
    assert running.numbered(df.limit(0), ["g"], ["v"]).count() == 0


def test_running_sums_like_a_loop(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), i, rng.choice([None, *range(-5, 9)])) for i in range(600)]
    got = running.running(spark.createDataFrame(rows, "k string, i long, x long"), ["k"], F.floor(F.col("i") / 50), ["i"], {"total": F.col("x"), "n": F.lit(1)})
    want, sums, counts = {}, Counter(), Counter()
    for k, i, x in rows:
        sums[k] += x or 0
        counts[k] += 1
        want[i] = (sums[k], counts[k])
    assert {r["i"]: (r["total"], r["n"]) for r in got.collect()} == want


@pytest.mark.parametrize("large", [1_000_000, 40])
def test_values_at_ranks_like_sorted_lists(spark, monkeypatch, large):
    """Every size up to some dozens, then heavy groups with ties, a long tail and equal values."""
    monkeypatch.setattr(ranks, "LARGE", large)
    rng = random.Random(3)
    groups = {n: [rng.choice([rng.uniform(-9, 9), 1.5, 2.0]) for _ in range(n)] for n in range(1, 44)}
    groups |= {1000: [rng.expovariate(1) ** 6 for _ in range(5000)], 1001: [7.25] * 900, 1002: [float(rng.randrange(4)) for _ in range(2500)]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g long, v double").repartition(6)
    df = df.unionByName(spark.createDataFrame([(None, 3.0), (None, None), (2, None)], "g long, v double"))
    got = {r["g"]: r for r in ranks.values_at(df, ["g"], "v", {"p95": (0.95, ranks.nearest(0.95)), "low": (0.5, ranks.LOWER_MIDDLE), "high": (0.5, ranks.UPPER_MIDDLE)}).collect()}
    for g, vs in (groups | {None: [3.0]}).items():
        s, n = sorted(vs), len(vs)
        assert (got[g]["p95"], got[g]["low"], got[g]["high"]) == (s[min(int(n * 0.95), n - 1)], s[(n - 1) // 2], s[n // 2]), g
    assert ranks.values_at(df.limit(0), ["g"], "v", {"a": (0.5, ranks.LOWER_MIDDLE)}).count() == 0


def test_a_heavy_group_is_many_tasks(spark, monkeypatch):
    """Half of all rows are one group's: its window holds the few rows about the rank, not the group."""
    monkeypatch.setattr(ranks, "LARGE", 500)
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("g"), ((F.col("id") * 104729) % 99991).cast("double").alias("v"))
    seen = []
    close = ranks._inside
    monkeypatch.setattr(ranks, "_inside", lambda *a: seen.append(close(*a)) or seen[-1])
    got = ranks.values_at(df, ["g"], "v", {"p": (0.95, ranks.nearest(0.95))}).where("g = 0").first()
    assert got["p"] == sorted(float(i * 104729 % 99991) for i in range(0, 20_000, 2))[9500]
    assert 0 < seen[0].count() < 40


def plain_greedy(left, right):
    """Each left row takes the first unused right row that is near enough, in order."""
    used, out = set(), []
    for i, (d, a) in enumerate(left):
        for j, (e, b) in enumerate(right):
            if j not in used and d == e and abs(a - b) < Decimal("0.01"):
                used.add(j)
                out.append((i, j))
                break
    return out


def matched(spark, left, right):
    make = lambda rows: spark.createDataFrame([(i, d, a) for i, (d, a) in enumerate(rows)], "tx_id long, day string, amount decimal(20,6)").repartition(3)
    return reconcile.reconcile(make(left), make(right), ["day"])


def test_reconcile_literal_rows(spark):
    d = Decimal
    left = [("x", d("10.00")), ("y", d("5.00")), ("z", d("7.00")), (None, d("1.00")), ("x", None), ("w", d("9.999"))]
    right = [("x", d("10.005")), ("x", d("9.995")), ("y", d("5.01")), ("z", d("7.00")), ("z", d("7.00")), (None, d("1.001")), ("w", d("10.001"))]
    got = {(r["left_id"], r["right_id"], r["status"]) for r in matched(spark, left, right).collect()}
    # the first could match two and takes one; a hundredth is too far; equal rows match once; a null day is a day
    assert {(1, None, "left_only"), (None, 2, "right_only"), (3, 5, "match"), (4, None, "left_only"), (5, 6, "match")} < got
    assert sum(s == "match" for *_, s in got) == 4 and sum(s == "right_only" for *_, s in got) == 3
    report = reconcile.match_report(matched(spark, left, right), ["day"]).where("day = 'z'").first()
    assert (report["matches"], report["left_only"], report["right_only"], report["match_rate"]) == (1, 0, 1, 100.0)


@pytest.mark.parametrize("grid", [1, 3, 5])
def test_reconcile_is_one_to_one_near_and_maximal(spark, grid):
    rng = random.Random(grid)
    amount = lambda: Decimal(rng.randrange(60)) * grid / 1000
    left, right = ([(rng.choice("ab"), amount()) for _ in range(n)] for n in (160, 150))
    rows = matched(spark, left, right).collect()
    assert sorted(r["left_id"] for r in rows if r["left_id"] is not None) == list(range(160))
    assert sorted(r["right_id"] for r in rows if r["right_id"] is not None) == list(range(150))
    near = lambda i, j: left[i][0] == right[j][0] and abs(left[i][1] - right[j][1]) < Decimal("0.01")
    assert all(near(r["left_id"], r["right_id"]) for r in rows if r["status"] == "match")
    alone = [[r[f"{s}_id"] for r in rows if r["status"] == f"{s}_only"] for s in ("left", "right")]
    assert not any(near(i, j) for i in alone[0] for j in alone[1])


def test_reconcile_finds_as_many_as_a_greedy_loop_where_near_amounts_stand_apart(spark):
    rng = random.Random(9)
    amount = lambda: Decimal(rng.randrange(40)) + Decimal(rng.randrange(3)) / 1000
    left, right = ([(rng.choice("ab"), amount()) for _ in range(n)] for n in (200, 220))
    rows = matched(spark, left, right).collect()
    assert sum(r["status"] == "match" for r in rows) == len(plain_greedy(left, right))


def test_declared_checks(spark):
    own = spark.createDataFrame([(1, 100.0, 5)], "k long, total double, n long")
    said = spark.createDataFrame([(1, 100.005, None), (2, 1.0, 3)], "k long, total double, n long")
    got = {(r["k"], r["field"]): r["match"] for r in reconcile.declared_checks(own, said, ["k"], ["total", "n"]).collect()}
    assert got == {(1, "total"): True, (2, "total"): False, (2, "n"): False}


def test_sweep_deletes_what_was_written(spark):
    df = scratch.stash(spark.range(5), "swept")
    assert df.count() == 5 and scratch.sweep(spark) >= 1 and scratch.sweep(spark) == 0
    with pytest.raises(Exception, match="(?i)not exist|does not|PATH_NOT_FOUND|FILE_NOT_EXIST"):
        spark.read.parquet(df.inputFiles()[0]).count()
