"""Two sources of the same transactions, matched one to one within a tolerance.

Amounts are decimals, so a difference of exactly the tolerance is no match.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import numbered

EXACT = "decimal(28,6)"
SIDES = ["left", "right"]


def _paired(rows: DataFrame, by: list[str], step: Decimal) -> DataFrame:
    """Rows (by, _side, _amount, _id, _n) whose number in their side of a group is equal, side by side."""
    one = lambda s, c: F.max(F.when(F.col("_side") == s, F.col(c)))
    both = rows.groupBy(*by, "_n").agg(*(one(s, f"_{c}").alias(f"{s}_{c}") for s in SIDES for c in ("id", "amount", "cell")))
    near = F.abs(F.col("left_amount") - F.col("right_amount")) < F.lit(step)
    return both.withColumn("match", F.coalesce(near, F.lit(False))).drop("_n")


def _apart(pairs: DataFrame, on: list[str]) -> DataFrame:
    """The rows of pairs that are no match."""
    side = lambda s: F.struct(F.lit(s).alias("_side"), F.col(f"{s}_id").alias("_id"), F.col(f"{s}_amount").alias("_amount"), F.col(f"{s}_cell").alias("_cell"))
    rows = pairs.where("not match").select(*on, F.explode(F.array(*map(side, SIDES))).alias("r")).select(*on, "r.*")
    return rows.where("_id is not null")


def reconcile(left: DataFrame, right: DataFrame, on: list[str], tolerance: str = "0.01", amount: str = "amount", row_id: str = "tx_id") -> DataFrame:
    """(on, left_id, left_amount, right_id, right_amount, status): every row of both sides once.

    A match agrees in ``on`` (nulls too) and differs by less than the tolerance. Amounts are dealt to cells
    as wide as the tolerance. Within a cell all amounts are near enough: each side is numbered by amount
    and id, and equal numbers match. What is left of a cell is of one side. Then neighbouring cells meet,
    first even ones with the next, then odd ones: what is left below their border is numbered from the
    border down, what is left above it from the border up. Equal numbers match if they are near enough;
    as distances to the border grow with the numbers, no pair beyond the first that is too far can be
    near. So no row stays alone while the other side has one near enough that stays alone too, and no
    pairs are made but those of equal numbers. Numbers are made by ``numbered``: a day with one amount in
    a third of all rows is many tasks' work. Rows without an amount match nothing.
    """
    step = Decimal(tolerance)
    side = lambda df, s: df.select(*on, F.lit(s).alias("_side"), F.col(row_id).alias("_id"), F.col(amount).cast(EXACT).alias("_amount"))
    rows = side(left, SIDES[0]).unionByName(side(right, SIDES[1]))
    rows = rows.withColumn("_cell", F.floor(F.col("_amount") / F.lit(step)).cast("long"))
    alone = rows.where("_amount is null").withColumns({f"{s}_id": F.when(F.col("_side") == s, F.col("_id")) for s in SIDES} | {"match": F.lit(False)})
    rows = rows.where("_amount is not null")
    pairs = _paired(numbered(rows, [*on, "_cell", "_side"], ["_amount", "_id"], "_n"), [*on, "_cell"], step)
    found = [pairs.where("match")]
    for shift in (0, 1):
        rest = _apart(pairs, on)
        lower = F.pmod(F.col("_cell") + shift, F.lit(2)) == 0
        border = F.when(lower, F.col("_cell") + 1).otherwise(F.col("_cell")).cast("decimal(20,0)") * F.lit(step)
        two = F.floor((F.col("_cell") + shift) / 2).cast("long")
        rest = rest.withColumns({"_two": two, "_cross": (F.col("_side") == SIDES[0]) == lower, "_far": F.abs(F.col("_amount") - border).cast(EXACT)})
        rest = numbered(rest, [*on, "_two", "_cross", "_side"], ["_far", "_id"], "_n")
        pairs = _paired(rest, [*on, "_two", "_cross"], step)
        found.append(pairs.where("match"))
    columns = [*on, *(f"{s}_{c}" for s in SIDES for c in ("id", "amount")), "match"]
    out = found[0].select(*columns)
    for m in found[1:]:
        out = out.unionByName(m.select(*columns))
    single = lambda s: F.when(F.col("_side") == s, F.col("_amount"))
    lone = _apart(pairs, on).select(*on, *(c for s in SIDES for c in (F.when(F.col("_side") == s, F.col("_id")).alias(f"{s}_id"), single(s).alias(f"{s}_amount"))), F.lit(False).alias("match"))
    out = out.unionByName(lone).unionByName(alone.withColumns({f"{s}_amount": F.lit(None).cast(EXACT) for s in SIDES}).select(*columns))
    status = F.when(F.col("match"), "match").when(F.col("right_id").isNull(), "left_only").otherwise("right_only")
    return out.withColumn("status", status).drop("match")


def match_report(matched: DataFrame, by: list[str]) -> DataFrame:
    """Rows of each kind, and matches as a percentage of the left side's rows (of one, if it has none)."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = matched.groupBy(*by).agg(n("match").alias("matches"), n("left_only").alias("left_only"), n("right_only").alias("right_only"))
    rate = F.col("matches") / F.greatest(F.col("matches") + F.col("left_only"), F.lit(1)) * 100
    return out.withColumn("match_rate", F.round(rate, 4))


def totals_of(rows: DataFrame, by: list[str], signed: Column) -> DataFrame:
    """Sums and counts of what came in and went out, as statements declare them."""
    into, out = F.when(signed > 0, signed), F.when(signed < 0, -signed)
    return rows.groupBy(*by).agg(
        F.coalesce(F.sum(into), F.lit(0)).cast(EXACT).alias("total_credits"), F.coalesce(F.sum(out), F.lit(0)).cast(EXACT).alias("total_debits"),
        F.count(into).cast(EXACT).alias("credit_count"), F.count(out).cast(EXACT).alias("debit_count"),
    )


def declared_checks(computed: DataFrame, declared: DataFrame, by: list[str], fields: list[str], tolerance: str = "0.01") -> DataFrame:
    """(by, field, computed, declared, match) for each field that is declared: balances, totals, counts.
    What one side lacks altogether is no match where the other declares it."""
    own = computed.select(*by, *(F.col(f).cast(EXACT).alias(f"own_{f}") for f in fields))
    both = declared.select(*by, *(F.col(f).cast(EXACT).alias(f) for f in fields)).join(own, by, "left")
    pair = lambda f: F.struct(F.lit(f).alias("field"), F.col(f"own_{f}").alias("computed"), F.col(f).alias("declared"))
    out = both.select(*by, F.explode(F.array(*map(pair, fields))).alias("f")).select(*by, "f.*").where("declared is not null")
    near = F.abs(F.col("computed") - F.col("declared")) < F.lit(Decimal(tolerance))
    return out.withColumn("match", F.coalesce(near, F.lit(False)))
