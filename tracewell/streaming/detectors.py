"""Ordered-event detectors as streams. Event time must be TIMESTAMP; late rows beyond the watermark
are dropped by Spark, as documented there.

Windows, sessions, joins and deduplication keep their state in Spark, which drops it by the watermark.
Detectors that compare a record with the one before it, or keep sums by key, work on batches: inside a
batch the order is made by Spark windows, a day at a time, and between batches state is kept in hash
buckets (``state``), of which a batch reads and writes those of its own keys. State and results are
written a folder a batch, so a batch that is run again replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import bank
from .state import Buckets, Files


def deduplicate(events: DataFrame, keys: list[str], delay: str = "1 day") -> DataFrame:
    """ST1: the first of equal keys within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def tumbling(events: DataFrame, key: str, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """ST2: records of each window."""
    g = events.withWatermark("ts", delay).groupBy(key, F.window("ts", width)).agg(F.count("*").alias("n"))
    return g.select(key, F.col("window.start").alias("from_ts"), "n")


def sliding_bursts(events: DataFrame, key: str, least: int, width: str = "30 minutes", step: str = "5 minutes", delay: str = "1 day") -> DataFrame:
    """ST3: windows with many records."""
    g = events.withWatermark("ts", delay).groupBy(key, F.window("ts", width, step)).agg(F.count("*").alias("n"))
    return g.where(F.col("n") >= least).select(key, F.col("window.start").alias("from_ts"), "n")


def sessions(events: DataFrame, key: str, gap: str = "12 hours", delay: str = "1 day") -> DataFrame:
    """ST4: activity without a pause longer than the gap; open ones come when they are closed."""
    g = events.withWatermark("ts", delay).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select(key, F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), "n")


def after_each(rows: DataFrame, key: list[str], id_column: str, carried: list[str]) -> DataFrame:
    """Each record with ``carried`` columns of the record before it in its key, named ``last_...``.

    Records are compared within a day; a day's first one with the last of the day before it that has
    any. So no task needs more than a day of a key at once.
    """
    own = Window.partitionBy(*key, "_day").orderBy("ts", id_column)
    r = rows.withColumn("_day", F.to_date("ts"))
    r = r.withColumns({f"last_{c}": F.lag(c).over(own) for c in carried} | {"_first": F.row_number().over(own) == 1})
    order = F.struct("ts", id_column)
    ends = r.groupBy(*key, "_day").agg(*(F.max_by(c, order).alias(f"_{c}") for c in carried))
    days = Window.partitionBy(*key).orderBy("_day")
    ends = ends.select(*key, "_day", *(F.lag(f"_{c}").over(days).alias(f"_{c}") for c in carried))
    out = r.join(ends, [*key, "_day"], "left")
    return out.withColumns({f"last_{c}": F.when(F.col("_first"), F.col(f"_{c}")).otherwise(F.col(f"last_{c}")) for c in carried}).drop("_day", "_first", *(f"_{c}" for c in carried))


def _run(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Everything that is there now, batch by batch."""
    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def compare_batches(
    stream: DataFrame, key: list[str], id_column: str, carried: list[str], found: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, ttl_days: int = 365, buckets: int = 64
) -> None:
    """``found`` picks from records with their ``last_...`` columns what is written to ``path``. Records
    that come later than younger ones of their key are compared in the batch they come in; the younger
    ones stay the last.

    The last record of each key is kept in hash buckets; a batch reads and writes those of its own keys.
    A key is forgotten if its last record is older than ``ttl_days`` before the newest record of the
    batches before.
    """

    def batch(df: DataFrame, i: int) -> None:
        spark = df.sparkSession
        rows = df.select(*key, id_column, "ts", *(c for c in carried if c != "ts")).where(F.col("ts").isNotNull()).persist()
        state = Buckets(spark, f"{checkpoint}/last", key, rows.schema, buckets)
        marks = Files(spark, f"{checkpoint}/newest")
        newest = (marks.read(f"batch={i - 1}") or {}).get("newest") if i else None
        known = F.lit(newest).cast("timestamp") - F.expr(f"interval {ttl_days} days")
        own = state.touched(rows, i)
        old = state.read(own, i)
        old = old.where(F.col("ts") >= known) if newest else old
        together = rows.withColumn("_new", F.lit(True)).unionByName(old.withColumn("_new", F.lit(False)))
        found(after_each(together, key, id_column, carried).where("_new").drop("_new")).write.mode("overwrite").parquet(f"{path}/batch={i}")
        rest = [c for c in rows.columns if c not in key]
        last = together.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("ts", id_column)).alias("r")).select(*key, "r.*")
        state.write(last, i)
        now = rows.agg(F.max("ts").cast("string").alias("m")).first()["m"]
        marks.write({"newest": max(filter(None, (newest, now)), default=None)}, f"batch={i}")
        rows.unpersist()
        state.clean(i)
        if i > 1:
            marks.drop(f"batch={i - 2}")

    _run(stream, batch, f"{checkpoint}/stream")


def inactivity_alerts(stream: DataFrame, key: str, id_column: str, path: str, checkpoint: str, hours: int = 12, ttl_days: int = 365, buckets: int = 64) -> None:
    """ST5: pauses between a key's records, to ``path``."""
    gap = F.unix_timestamp("ts") - F.unix_timestamp("last_ts")
    found = lambda df: df.where(gap >= hours * 3600).select(key, id_column, gap.alias("gap_s"))
    compare_batches(stream, [key], id_column, ["ts"], found, path, checkpoint, ttl_days, buckets)


def device_change_alerts(stream: DataFrame, key: str, id_column: str, path: str, checkpoint: str, device: str = "device", domain: str = "domain", ttl_days: int = 365, buckets: int = 64) -> None:
    """ST8: a device that differs from the last one of the key in its domain (voice or data), to ``path``.
    Records without a device tell nothing and are left out."""
    found = lambda df: df.where(F.col(f"last_{device}") != F.col(device)).select(key, domain, id_column, F.col(f"last_{device}").alias("from_device"), F.col(device).alias("to_device"))
    compare_batches(stream.where(F.col(device).isNotNull()), [key, domain], id_column, [device], found, path, checkpoint, ttl_days, buckets)


def pass_through(deposits: DataFrame, withdrawals: DataFrame, key: str, hours: int = 24, delay: str = "1 day") -> DataFrame:
    """ST6: each deposit (t1) with each withdrawal (t2) of the key within the window: an interval
    join of two streams, state bounded by both watermarks."""
    d = deposits.withWatermark("t1", delay).alias("d")
    w = withdrawals.withWatermark("t2", delay).alias("w")
    near = F.expr(f"d.{key} = w.{key} and t2 >= t1 and t2 <= t1 + interval {hours} hours")
    return d.join(w, near).select(F.col(f"d.{key}").alias(key), "deposit_id", "withdrawal_id")


def enrich(events: DataFrame, watch: DataFrame, on: str) -> DataFrame:
    """ST7: a stream against a list that stays as it is."""
    return events.join(watch, on, "left")


def newest_version(files: Files) -> int:
    versions = files.numbers("version")
    if not versions:
        raise ValueError(f"no version=<n> in {files.root}")
    return versions[-1]


def by_rules(
    stream: DataFrame, path: str, checkpoint: str, tables: dict[str, str], found: Callable[[DataFrame, dict[str, DataFrame]], DataFrame]
) -> None:
    """ST7: each batch against rule and watch tables as they are then.

    tables: name -> a folder of versions, ``version=<n>``. A batch reads the newest version of each and
    notes which, before anything else: run again after a failure, it reads the same ones. ``found`` gets
    the batch and the tables; what it returns is written with the versions' numbers.
    """

    def batch(df: DataFrame, i: int) -> None:
        spark = df.sparkSession
        pins = Files(spark, f"{checkpoint}/versions")
        pinned = pins.read(f"batch={i}")
        if pinned is None:
            pinned = {name: newest_version(Files(spark, at)) for name, at in tables.items()}
            pins.write(pinned, f"batch={i}")
        now = {name: spark.read.parquet(f"{at}/version={pinned[name]}") for name, at in tables.items()}
        out = found(df, now).withColumns({f"{name}_version": F.lit(n) for name, n in pinned.items()})
        out.write.mode("overwrite").parquet(f"{path}/batch={i}")
        if i > 1:
            pins.drop(f"batch={i - 2}")

    _run(stream, batch, f"{checkpoint}/stream")


def put_version(table: DataFrame, folder: str) -> int:
    """Adds a version of a rule or watch table; streams take it up with their next batch."""
    versions = Files(table.sparkSession, folder).numbers("version")
    n = (versions[-1] if versions else 0) + 1
    table.write.parquet(f"{folder}/draft")
    files = Files(table.sparkSession, folder)
    if not files.fs.rename(files.at("draft"), files.at(f"version={n}")):
        raise RuntimeError(f"version {n} could not be put in {folder}")
    return n


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there now, to a Parquet table."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


SUMS = "tag string, n long, amount decimal(38,6), ids array<long>"


def rolling_risk(stream: DataFrame, key: str, weights: DataFrame, path: str, checkpoint: str, ids: int = 10, buckets: int = 64) -> None:
    """ST9: the A17 score of each key that a batch touches, to ``path``, with the batch as its version.

    stream: key, amount, tx_id, tags (array; rows without tags count in the total). State are partial sums
    by key and tag (tag null: all rows), with the first ids; sums of a batch are added to those of its
    keys' buckets, and only its keys are scored again. ``latest_risk`` reads the result.
    """

    def batch(df: DataFrame, i: int) -> None:
        spark = df.sparkSession
        rows = df.where(F.col(key).isNotNull()).persist()
        state = Buckets(spark, f"{checkpoint}/sums", [key], T._parse_datatype_string(f"{key} {dict(rows.dtypes)[key]}, {SUMS}"), buckets)
        value = F.abs(F.col("amount").cast("decimal(38,6)"))
        names = F.array_distinct(F.transform("tags", lambda x: F.upper(x)))
        tagged = rows.select(key, "tx_id", value.alias("amount"), F.explode(names).alias("tag")).where("tag is not null")
        salt = F.pmod(F.xxhash64("tx_id"), F.lit(32))  # a tag of most rows is ranked in many tasks
        tagged = tagged.withColumn("_s", salt).withColumn("_r", F.row_number().over(Window.partitionBy(key, "tag", "_s").orderBy("tx_id")))
        new = tagged.groupBy(key, "tag").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"), F.collect_list(F.when(F.col("_r") <= ids, F.col("tx_id"))).alias("ids"))
        whole = rows.groupBy(key).agg(F.lit(None).cast("string").alias("tag"), F.count("*").alias("n"), F.sum(value).alias("amount"), F.array().cast("array<long>").alias("ids"))
        old = state.read(state.touched(rows, i), i)
        sums = old.unionByName(new).unionByName(whole).groupBy(key, "tag").agg(
            F.sum("n").alias("n"), F.sum("amount").cast("decimal(38,6)").alias("amount"), F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, ids).alias("ids"))
        state.write(sums, i)
        now = spark.read.schema(state.schema).parquet(f"{state.files.root}/batch={i}").join(rows.select(key).distinct(), key, "left_semi")
        listed = F.array_join(F.col("ids").cast("array<string>"), ",").alias("tx_ids")
        tags = now.where("tag is not null").select(key, "tag", "n", F.col("amount").cast("double").alias("amount"), listed)
        totals = now.where("tag is null").select(key, F.col("amount").cast("double").alias("total"))
        scored = bank.risk_score_of(bank.weighed(tags, weights, totals, key), key)
        out = totals.select(key).join(scored, key, "left").select(key, F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("reasons", F.lit(0)).cast("long").alias("reasons"))
        out.write.mode("overwrite").parquet(f"{path}/batch={i}")
        rows.unpersist()
        state.clean(i)

    _run(stream, batch, f"{checkpoint}/stream")


def latest_risk(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, score, reasons, version): what the last batch that touched each key found."""
    rows = spark.read.parquet(path)
    return rows.groupBy(key).agg(F.max_by(F.struct("score", "reasons", F.col("batch").cast("long").alias("version")), "batch").alias("r")).select(key, "r.*")
