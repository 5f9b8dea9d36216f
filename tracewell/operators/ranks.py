"""Exact values at ranks of groups of any size, by counting.

Small groups are sorted, each in a task. A group of more than ``LARGE`` values is never gathered: a
mergeable sketch gives a bracket that holds the rank for certain (its error is a tenth of the
bracket's width), counts of equal bands of the bracket give the band that holds it, and only that
band's distinct values are put in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values from which a group counts as large. There are no more large groups than rows / LARGE, so
#: they are broadcast.
LARGE = 1_000_000
ACCURACY, WIDTH, BANDS = 10_000, 0.001, 1024

Place = tuple[float, Callable[[Column], Column]]
LOWER_MIDDLE = lambda n: F.floor((n - 1) / 2)
UPPER_MIDDLE = lambda n: F.floor(n / 2)


def nearest(q: float) -> Callable[[Column], Column]:
    """Place min(int(q n), n - 1), from 0."""
    return lambda n: F.least(F.floor(n * F.lit(q)), n - 1)


def _on(keys: list[str]) -> tuple[dict, list]:
    """Names of a right side's keys, and the condition under which null keys are equal."""
    return {k: f"__{k}" for k in keys}, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]


def _with(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    names, on = _on(keys)
    return rows.join(F.broadcast(small.withColumnsRenamed(names)), on, how).drop(*names.values())


def has_large(rows: DataFrame, group: list[str], value: str) -> bool:
    """Whether any group has more than LARGE values: one pass that counts."""
    sizes = rows.groupBy(*group).agg(F.count(value).alias("_n"))
    return sizes.where(F.col("_n") > LARGE).limit(1).count() > 0


def placed(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """For small groups: rows with their place (``_at``, from 0, nulls last) and their group's values (``_n``)."""
    w = Window.partitionBy(*group)
    return rows.withColumns({"_at": F.row_number().over(w.orderBy(F.asc_nulls_last(value))) - 1, "_n": F.count(value).over(w)})


def chosen(value: str, places: dict[str, Place]) -> list[Column]:
    """Over ``placed`` rows: the values at the places, as aggregates."""
    return [F.max(F.when(F.col("_at") == place(F.col("_n")), F.col(value))).alias(name) for name, (_, place) in places.items()]


def values_at(rows: DataFrame, group: list[str], value: str, places: dict[str, Place]) -> DataFrame:
    """(group, name...): for each name the value at its place (from 0) of the group's values in order.

    places: name -> (share of the values below the place, the place as a function of their number). Null
    values count as none; groups without a value have no row. ``rows`` is read twice, and some times more
    where a group is large: cut its lineage before, if it is dear.
    """
    given, group = group, [f"_g{i}" for i in range(len(group))]  # no column of the caller's clashes with ours
    v = rows.select(*(F.col(g).alias(k) for g, k in zip(given, group)), F.col(value).alias("_v")).where("_v is not null")
    named = dict(zip(group, given))
    if not has_large(v, group, "_v"):
        return placed(v, group, "_v").groupBy(*group).agg(*chosen("_v", places)).withColumnsRenamed(named)
    sizes = v.groupBy(*group).agg(F.count("*").alias("_n"))
    marked = _with(v, sizes.where(F.col("_n") > LARGE), group, "left")
    small = placed(marked.where("_n is null").drop("_n"), group, "_v").groupBy(*group).agg(*chosen("_v", places))
    heavy = marked.where("_n is not null").drop("_n")
    shares = sorted({s for q, _ in places.values() for s in (max(0.0, q - WIDTH), min(1.0, q + WIDTH))})
    sketch = heavy.groupBy(*group).agg(F.count("*").alias("_n"), F.percentile_approx("_v", shares, ACCURACY).alias("_s"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    at = lambda s: F.col("_min") if s == 0 else F.col("_max") if s == 1 else F.col("_s")[shares.index(s)]
    bounds = [F.struct(F.lit(name).alias("name"), place(F.col("_n")).cast("long").alias("place"), at(max(0.0, q - WIDTH)).alias("lo"), at(min(1.0, q + WIDTH)).alias("hi")) for name, (q, place) in places.items()]
    want = sketch.select(*group, F.explode(F.array(*bounds)).alias("w")).select(*group, "w.*")
    inside = _inside(heavy, want, group)
    order = Window.partitionBy(*group, "name").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = inside.withColumn("_c", F.sum("_k").over(order) + F.col("below")).where(F.col("_c") > F.col("place"))
    one = found.groupBy(*group, "name").agg(F.min("_v").alias("_v")).groupBy(*group).agg(*(F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in places))
    return small.unionByName(one).withColumnsRenamed(named)


def _inside(heavy: DataFrame, want: DataFrame, group: list[str]) -> DataFrame:
    """(group, name, place, below, _v, _k): the distinct values of the band that holds each place, how many
    rows each has, and how many rows are below the band."""
    span = F.col("hi") - F.col("lo")
    band = F.when(F.col("_v") < F.col("lo"), -1).when(span <= 0, 0).otherwise(F.least(F.floor((F.col("_v") - F.col("lo")) / span * BANDS), F.lit(BANDS - 1))).cast("int")
    rows = _with(heavy, want, group).where("_v <= hi").withColumn("band", band)
    counts = rows.groupBy(*group, "name", "band").agg(F.count("*").alias("k"), F.max("place").alias("place"))
    upto = F.sum("k").over(Window.partitionBy(*group, "name").orderBy("band"))
    held = counts.withColumn("upto", upto).where((F.col("upto") > F.col("place")) & (F.col("upto") - F.col("k") <= F.col("place")))
    held = held.select(*group, "name", "band", (F.col("upto") - F.col("k")).alias("below"))
    chosen = _with(rows, held, [*group, "name", "band"])
    return chosen.groupBy(*group, "name", "place", "below", "_v").agg(F.count("*").alias("_k"))
