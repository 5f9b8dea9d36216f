"""Running numbers and sums of groups of any size: one group may be many tasks' work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stash


def _join(rows: DataFrame, offsets: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which null keys are equal; the right side's keys go."""
    right = offsets.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return rows.join(right, on, "left").drop(*(f"_of_{k}" for k in keys))


def numbered(rows: DataFrame, group: list[str], order: list[str | Column], name: str = "n", keep: list[str] | None = None) -> DataFrame:
    """Rows with their number in their group, from 1, in the given order (nulls first).

    Rows are dealt by ranges of (group, order), sampled, so a group of any size is cut into parts of
    about equal size; a part's rows are numbered within, and the groups' rows in earlier parts are
    added. Only a part's first group can go on from an earlier part, so the added numbers are at most
    one row for each partition: small enough to broadcast whatever the rows are. Rows that are equal
    in all of ``order`` are numbered in any order and stay in one part. ``keep``: the columns to go on with.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in [*group, *order]]
    cut = rows.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("__at", F.monotonically_increasing_id())
    cut = stash(cut.select(*(keep or rows.columns), "__at"), "numbered").withColumn("__part", F.shiftright("__at", 33))
    sizes = cut.groupBy(*group, "__part").agg(F.count("*").alias("__rows"))
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("__before", F.sum("__rows").over(earlier)).where("__before > 0").drop("__rows")
    within = F.row_number().over(Window.partitionBy(*group, "__part").orderBy("__at"))
    out = _join(cut.withColumn("__n", within), F.broadcast(before), [*group, "__part"])
    return out.withColumn(name, F.col("__n") + F.coalesce("__before", F.lit(0))).drop("__n", "__before", "__part", "__at")


def running(rows: DataFrame, group: list[str], block: Column, order: list[str], sums: dict[str, Column], lasts: dict[str, Column] | None = None, previous: str | None = None) -> DataFrame:
    """Rows with running sums of their group (the row itself included), nulls counting as nothing; with
    the last value that is not null of earlier rows (``lasts``), and with the block of the row before
    (column ``previous``).

    ``block`` must not fall along ``order`` (a day, a number divided by a constant): what a block adds
    comes first, a block at a time, then rows within their block, so that a task holds a block of a group
    and not a group.
    """
    lasts = lasts or {}
    cut = rows.withColumn("__block", block)
    place = F.struct(*order)
    parts = cut.groupBy(*group, "__block").agg(
        F.count("*").alias("__n"), *(F.sum(c).alias(f"__sum_{k}") for k, c in sums.items()), *(F.max_by(c, F.when(c.isNotNull(), place)).alias(f"__last_{k}") for k, c in lasts.items()))
    blocks = Window.partitionBy(*group).orderBy("__block")
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    before = [F.sum(f"__sum_{k}").over(earlier).alias(f"__before_{k}") for k in sums] + [F.last(f"__last_{k}", ignorenulls=True).over(earlier).alias(f"__before_{k}") for k in lasts]
    before = parts.select(*group, "__block", F.lag("__block").over(blocks).alias("__from"), *before)
    within = Window.partitionBy(*group, "__block").orderBy(*order)
    own = {f"__own_{k}": F.sum(c).over(within.rowsBetween(Window.unboundedPreceding, 0)) for k, c in sums.items()}
    own |= {f"__own_{k}": F.last(c, ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, -1)) for k, c in lasts.items()}
    out = _join(cut.withColumns(own | {"__first": F.row_number().over(within) == 1}), before, [*group, "__block"])
    both = {k: F.coalesce(f"__own_{k}", F.lit(0)) + F.coalesce(f"__before_{k}", F.lit(0)) for k in sums} | {k: F.coalesce(f"__own_{k}", f"__before_{k}") for k in lasts}
    if previous:
        both[previous] = F.when(F.col("__first"), F.col("__from")).otherwise(F.col("__block"))
    names = [*sums, *lasts]
    return out.withColumns(both).drop("__block", "__first", "__from", *(f"__own_{k}" for k in names), *(f"__before_{k}" for k in names))
