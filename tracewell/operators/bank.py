"""Operators over bank transactions, for all accounts at once.

Columns: tx_id, account_id (the key), booking_date, amount, direction CREDIT or DEBIT, channel,
category, counterparty. Every ranking has a total order, the id last. Null names count as no name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stash
from . import ranks
from .running import running

KEY = "account_id"
CHANNELS = ["CARD", "TRANSFER", "BLIK_P2P", "BLIK_MERCHANT", "CASH", "FEE", "REFUND"]


def money(c: Column | str) -> Column:
    return F.sum(c).cast("double")


def when_sum(condition: str, value: str = "amount") -> Column:
    return F.coalesce(F.sum(F.when(F.expr(condition), F.col(value))), F.lit(0)).cast("double")


CREDIT, DEBIT = "direction = 'CREDIT'", "direction = 'DEBIT'"


def month(c: str = "booking_date") -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM"), F.lit("unknown"))


def ranked(rows: DataFrame, by: list[str], column: str = "tx_id") -> DataFrame:
    """Rows with their place in their group, for ``first_ids``."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(column)))


def first_ids(n: int, name: str = "tx_ids", column: str = "tx_id") -> Column:
    """Over ``ranked`` rows: the first n ids of a group, joined by commas. No more than n are gathered."""
    return F.array_join(F.array_sort(F.collect_list(F.when(F.col("_r") <= n, F.col(column)))).cast("array<string>"), ",").alias(name)


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which null keys are equal."""
    r = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_same_{k}")) for k in keys]
    return left.join(r, on, how).drop(*(f"_same_{k}" for k in keys))


def _totals(of: str, value: str) -> Column:
    """A map of the list ``all``: each key of a column with the sum of a value, keys in order."""
    keys = F.array_sort(F.array_distinct(F.transform("all", lambda x: x[of])))
    add = lambda k: F.aggregate(F.filter("all", lambda x: x[of] == k), F.lit(0).cast("decimal(38,2)"), lambda a, x: (a + x[value]).cast("decimal(38,2)"))
    return F.map_from_arrays(keys, F.transform(keys, add))


def monthly_baseline(tx: DataFrame, key: str = KEY) -> DataFrame:
    """Counts, sums, spread, median and nearest-rank 95 % of each month, its rows by channel and its sums
    by category (null is unclassified). Where no month of a key is large, one shuffle gives all but the
    two maps; else ranks come from ``ranks``, by counting."""
    d = tx.withColumns({"amt": F.abs("amount").cast("double"), "month": month()})
    places = {"p95_amount": (0.95, ranks.nearest(0.95)), "_low": (0.5, ranks.LOWER_MIDDLE), "_high": (0.5, ranks.UPPER_MIDDLE)}
    large = ranks.has_large(d, [key, "month"], "amt")
    at = [] if large else ranks.chosen("amt", places)
    out = (d if large else ranks.placed(d, [key, "month"], "amt")).groupBy(key, "month").agg(
        F.count("*").alias("tx_count"), when_sum(CREDIT).alias("total_credit"), when_sum(DEBIT).alias("total_debit"),
        F.countDistinct(F.substring(F.lower("counterparty"), 1, 50)).alias("counterparties"), (money(F.abs("amount")) / F.count("*")).alias("mean_amount"),
        F.round(F.coalesce(F.stddev_samp("amt"), F.lit(0.0)), 4).alias("std_amount"), *at,
    )
    if large:
        out = same(out, ranks.values_at(d, [key, "month"], "amt", places), [key, "month"], "left")
    out = out.withColumn("median_amount", F.round((F.col("_low") + F.col("_high")) / 2, 4)).drop("_low", "_high")
    named = lambda c: F.coalesce(c, F.lit("unclassified")).alias(c)
    cells = d.groupBy(key, "month", named("channel"), named("category")).agg(F.count("*").cast("decimal(38,2)").alias("n"), F.sum(F.abs("amount")).cast("decimal(38,2)").alias("v"))
    lists = cells.groupBy(key, "month").agg(F.collect_list(F.struct("channel", "category", "n", "v")).alias("all"))
    maps = lists.select(key, "month", _totals("channel", "n").cast("map<string,bigint>").alias("channels"), _totals("category", "v").cast("map<string,double>").alias("categories"))
    return same(out, maps, [key, "month"])


def large_outliers(tx: DataFrame, key: str = KEY, z: float = 2.5, high: float = 4.0) -> DataFrame:
    """Amounts more than z sample deviations above the key's mean."""
    stats = tx.groupBy(key).agg(F.avg(F.abs("amount").cast("double")).alias("mean"), F.stddev_samp(F.abs("amount").cast("double")).alias("std"))
    score = (F.abs("amount").cast("double") - F.col("mean")) / F.col("std")
    out = tx.join(stats, key).where("std > 0").withColumn("zscore", score).where(F.col("zscore") > z)
    return out.select(key, "tx_id", F.col("amount").cast("double").alias("amount"), F.round("zscore", 4).alias("zscore"), F.when(F.col("zscore") > high, "high").otherwise("medium").alias("severity"))


def new_counterparty_large(tx: DataFrame, cut, key: str = KEY, share: float = 0.3) -> DataFrame:
    """After ``cut``, large amounts to names that were not there before it."""
    name = F.substring(F.lower("counterparty"), 1, 50)
    tx = tx.withColumn("name", name)
    past, now = tx.where(F.col("booking_date") < cut), tx.where((F.col("booking_date") >= cut) & (F.col("name") != ""))
    months = past.groupBy(key).agg(when_sum(DEBIT).alias("debit"), F.countDistinct(month()).alias("n"))
    fresh = now.join(past.select(key, "name").distinct(), [key, "name"], "left_anti").join(months, key)
    limit = F.col("debit") / F.col("n")
    return fresh.where((limit > 0) & (F.abs("amount") > limit * share)).select(key, "tx_id", "counterparty", F.col("amount").cast("double").alias("amount"))


def first_burst(tx: DataFrame, channel: str, days: int, least: int, key: str = KEY) -> DataFrame:
    """The first day from which ``least`` transactions fall within ``days`` days."""
    daily = tx.where(F.col("channel") == channel).groupBy(key, "booking_date").agg(F.count("*").alias("n"), money(F.abs("amount")).alias("total"))
    w = Window.partitionBy(key).orderBy(F.datediff("booking_date", F.lit("1970-01-01").cast("date"))).rangeBetween(0, days)
    hit = daily.withColumn("tx_count", F.sum("n").over(w)).withColumn("total", F.round(F.sum("total").over(w), 2)).where(F.col("tx_count") >= least)
    return hit.groupBy(key).agg(F.min_by(F.struct("booking_date", "tx_count", "total"), "booking_date").alias("f")).select(key, F.col("f.booking_date").alias("first_day"), "f.tx_count", "f.total")


def spending_over_income(tx: DataFrame, key: str = KEY, over: float = 1.2, high: float = 1.5) -> DataFrame:
    """Months whose debit exceeds their credit by the factor."""
    m = tx.groupBy(key, month().alias("month")).agg(when_sum(CREDIT).alias("credit"), when_sum(DEBIT).alias("debit"))
    m = m.where("month <> 'unknown' and credit > 0").withColumn("ratio", F.col("debit") / F.col("credit")).where(F.col("ratio") > over)
    return m.select(key, "month", "credit", "debit", F.round("ratio", 4).alias("ratio"), F.when(F.col("ratio") > high, "high").otherwise("medium").alias("severity"))


def features(tx: DataFrame, key: str = KEY) -> DataFrame:
    """Numeric features of each transaction."""
    cp = tx.groupBy(key, "counterparty").agg(F.count("*").alias("cp_n"), F.min("tx_id").alias("first_id"))
    most = cp.groupBy(key).agg(F.max("cp_n").alias("most"))
    out = tx.join(cp, [key, "counterparty"], "left").join(most, key)
    cols = [F.log1p(F.abs("amount").cast("double")).alias("f_amount"), (F.weekday("booking_date") / 6.0).alias("f_dow"), (F.dayofmonth("booking_date") / 31.0).alias("f_dom"), F.when(F.expr(CREDIT), 1.0).otherwise(0.0).alias("f_credit"), F.when(F.col("tx_id") == F.col("first_id"), 1.0).otherwise(0.0).alias("f_new"), (F.coalesce("cp_n", F.lit(0)) / F.col("most")).alias("f_frequency")]
    return out.select(key, "tx_id", *cols, *(F.when(F.col("channel") == c, 1.0).otherwise(0.0).alias(f"f_{c.lower()}") for c in CHANNELS))


def centroid_anomaly(feats: DataFrame, key: str = KEY, contamination: float = 0.05, least: int = 10) -> DataFrame:
    """Distance to the key's mean in deviations; those beyond the (1 - c) cut stand out."""
    names = [c for c in feats.columns if c.startswith("f_")]
    stats = feats.groupBy(key).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m_{c}") for c in names), *(F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"s_{c}") for c in names))
    d = feats.join(stats, key).where(F.col("n") >= least)
    part = [F.when(F.col(f"s_{c}") > 1e-9, F.pow((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}"), 2)).otherwise(0.0) for c in names]
    d = stash(d.select(key, "tx_id", F.round(F.sqrt(sum(part[1:], part[0])), 6).alias("distance")), "distances")
    at = d.groupBy(key).agg(F.max("distance").alias("most"))
    cut = ranks.values_at(d, [key], "distance", {"cut": (1 - contamination, ranks.nearest(1 - contamination))})
    return d.join(at, key).join(cut, key).where("distance > cut").select(key, "tx_id", "distance", F.round(F.col("distance") / F.col("most"), 6).alias("score"))


def income_table(tx: DataFrame, key: str = KEY) -> DataFrame:
    """Month table with a total row (month null)."""
    r = tx.withColumn("month", month()).rollup(key, "month").agg(when_sum(CREDIT).alias("income"), when_sum(DEBIT).alias("expense"), F.count("*").alias("n"), F.grouping_id().alias("level"))
    return r.where("level < 3").select(key, "month", "income", "expense", "n", F.round(F.when(F.col("income") > 0, F.col("expense") / F.col("income")), 4).alias("ratio"))


def loan_groups(tx: DataFrame, key: str = KEY, category: str = "loans") -> DataFrame:
    """Per name; a fixed instalment if the variance is under (a tenth of the mean) squared."""
    amt = F.abs("amount").cast("double")
    g = tx.where(F.col("category") == category).groupBy(key, "counterparty").agg(F.count("*").alias("n"), money(F.abs("amount")).alias("total"), F.avg(amt).alias("mean"), F.var_pop(amt).alias("variance"))
    return g.select(key, "counterparty", "n", "total", ((F.col("n") >= 2) & (F.col("variance") < F.pow(F.col("mean") * 0.1, 2))).alias("fixed_instalment"))


def cash_pattern(tx: DataFrame, key: str = KEY) -> DataFrame:
    """Totals, mean gap and class of frequency, round amounts, large and just-below deposits."""
    cash = tx.where("channel = 'CASH'")
    w = Window.partitionBy(key).orderBy("booking_date", "tx_id")
    gap = F.datediff("booking_date", F.lag("booking_date").over(w))
    g = cash.withColumn("gap", gap).groupBy(key).agg(
        F.count("*").alias("n"), when_sum(CREDIT).alias("deposited"), when_sum(DEBIT).alias("withdrawn"), F.round(F.avg("gap"), 4).alias("mean_gap"),
        F.round(F.avg(F.when(F.col("amount") % 100 == 0, 1.0).otherwise(0.0)), 4).alias("round_share"),
        F.count_if(F.expr(f"{CREDIT} and amount >= 10000")).alias("large_deposits"), F.count_if(F.expr(f"{CREDIT} and amount >= 9000 and amount < 10000")).alias("structuring"),
    )
    cls = F.when(F.col("mean_gap").isNull(), "single").when(F.col("mean_gap") <= 7, "weekly").when(F.col("mean_gap") <= 14, "fortnightly").when(F.col("mean_gap") <= 35, "monthly").otherwise("rare")
    return g.withColumn("frequency", cls)


def p2p_balance(tx: DataFrame, key: str = KEY) -> DataFrame:
    """What went to and came from each person."""
    g = tx.where("channel = 'BLIK_P2P'").groupBy(key, "counterparty").agg(F.count("*").alias("n"), when_sum(CREDIT).alias("received"), when_sum(DEBIT).alias("sent"), F.every(F.expr(CREDIT)).alias("in_"), F.every(F.expr(DEBIT)).alias("out_"))
    return g.select(key, "counterparty", "n", "received", "sent", F.round(F.col("received") - F.col("sent"), 2).alias("balance"), F.when(F.col("out_"), "all_out").when(F.col("in_"), "all_in").otherwise("both").alias("kind"))


def calendar_profile(tx: DataFrame, key: str = KEY) -> DataFrame:
    """Weekdays and thirds of the month, by grouping sets."""
    third = F.when(F.dayofmonth("booking_date") <= 10, "1-10").when(F.dayofmonth("booking_date") <= 20, "11-20").otherwise("21-31")
    d = tx.withColumn("weekday", F.weekday("booking_date")).withColumn("third", third)
    g = d.groupingSets([[F.col(key), F.col("weekday")], [F.col(key), F.col("third")]], key, "weekday", "third")
    return g.agg(F.count("*").alias("n"), money(F.abs("amount")).alias("total"))


def weekend_ratio(tx: DataFrame, key: str = KEY, over: float = 0.5) -> DataFrame:
    """Amounts of the weekend over those of the week."""
    d = tx.withColumn("weekend", F.weekday("booking_date") >= 5)
    g = d.groupBy(key).agg(when_sum("weekend").alias("weekend"), when_sum("not weekend").alias("week"))
    return g.select(key, "weekend", "week", F.round(F.when(F.col("week") > 0, F.col("weekend") / F.col("week")), 4).alias("ratio"), F.coalesce(F.col("weekend") / F.col("week") > over, F.lit(False)).alias("weekend_heavy"))


def top_per_key(df: DataFrame, key: str, by: list[Column], n: int, name: str = "rank") -> DataFrame:
    w = Window.partitionBy(key).orderBy(*by)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def summary(tx: DataFrame, key: str = KEY) -> DataFrame:
    """One row of totals a key."""
    return tx.groupBy(key).agg(F.count("*").alias("n"), when_sum(CREDIT).alias("credit"), when_sum(DEBIT).alias("debit"), F.count_if(F.expr(CREDIT)).alias("credits"), F.min("booking_date").alias("first_day"), F.max("booking_date").alias("last_day"), F.countDistinct("counterparty").alias("counterparties"), F.max("amount").cast("double").alias("largest"))


def flagged(tx: DataFrame, risky: list[str], n: int = 20, key: str = KEY) -> DataFrame:
    """Each account's largest transactions of the risky categories."""
    f = tx.where(F.col("category").isin(risky)).select(key, "tx_id", "booking_date", "category", "counterparty", F.abs("amount").cast("double").alias("amount"))
    return top_per_key(f, key, [F.desc("amount"), F.col("tx_id")], n)


def rollup_by(tx: DataFrame, column: str, n: int, key: str = KEY) -> DataFrame:
    """The n largest groups of a column."""
    g = tx.groupBy(key, column).agg(F.count("*").alias("n"), money(F.abs("amount")).alias("total"))
    return top_per_key(g, key, [F.desc("total"), F.col(column)], n)


def enrichment_rollup(tx: DataFrame, key: str = KEY) -> DataFrame:
    """Channels and categories in one pass."""
    g = tx.groupingSets([[F.col(key), F.col("channel")], [F.col(key), F.col("category")], [F.col(key)]], key, "channel", "category")
    return g.agg(F.count("*").alias("n"), when_sum(CREDIT).alias("credit"), when_sum(DEBIT).alias("debit"))


def recurring(tx: DataFrame, key: str = KEY, least: int = 2) -> DataFrame:
    """Groups of one normalised name: sums, and its days and amounts, each once."""
    name = F.regexp_replace(F.lower("counterparty"), r"[^a-z]+", "")
    g = tx.withColumn("name", F.concat_ws("|", F.lower("counterparty"), name)).groupBy(key, "name")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)).cast("array<string>"), ",")
    g = g.agg(F.count("*").alias("n"), money("amount").alias("total"), (money("amount") / F.count("*")).alias("mean"), F.min("amount").cast("double").alias("least"), F.max("amount").cast("double").alias("most"), listed(F.date_format("booking_date", "yyyy-MM-dd")).alias("days"))
    return g.where(F.col("n") >= least)


def running_balance(tx: DataFrame, key: str = KEY, opening: float = 0.0) -> DataFrame:
    """Balance after each transaction and the days since the one before, day by day of an account."""
    signed = F.when(F.expr(CREDIT), F.col("amount")).otherwise(-F.col("amount"))
    r = running(tx, [key], F.col("booking_date"), ["booking_date", "tx_id"], {"_total": signed}, previous="_day")
    gap = F.datediff("booking_date", "_day")
    return r.select(key, "tx_id", "booking_date", (F.col("_total") + F.lit(opening)).cast("double").alias("balance"), gap.alias("gap_days"), F.coalesce(gap > 5, F.lit(False)).alias("gap"))


def top_and_other(tx: DataFrame, column: str = "counterparty", n: int = 10, key: str = KEY) -> DataFrame:
    """The n largest and one row for all others."""
    g = tx.groupBy(key, column).agg(F.sum(F.abs("amount")).alias("total"), F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("total"), column)
    label = F.when(F.row_number().over(w) <= n, F.col(column)).otherwise("other")
    return g.select(key, label.alias("label"), "total", "n").groupBy(key, "label").agg(money("total").alias("total"), F.sum("n").alias("n"))


def pivot_months(tx: DataFrame, key: str = KEY) -> DataFrame:
    """Credit and debit side by side."""
    return tx.groupBy(key, month().alias("month")).pivot("direction", ["CREDIT", "DEBIT"]).agg(F.sum("amount").cast("double")).na.fill(0.0, ["CREDIT", "DEBIT"]).withColumnsRenamed({"CREDIT": "credit", "DEBIT": "debit"})


def statements(tx: DataFrame, key: str = KEY) -> DataFrame:
    """Statements of account and month out of running balances."""
    r = running_balance(tx, key).join(tx.select("tx_id", "amount", "direction"), "tx_id")
    order = F.struct("booking_date", "tx_id")
    signed = F.when(F.expr(CREDIT), F.col("amount")).otherwise(-F.col("amount")).cast("double")
    g = r.withColumn("month", month()).withColumn("signed", signed).groupBy(key, "month")
    return g.agg(F.min("booking_date").alias("period_from"), F.max("booking_date").alias("period_to"), F.round(F.min_by(F.col("balance") - F.col("signed"), order), 2).alias("opening"), F.round(F.max_by("balance", order), 2).alias("closing"), when_sum(CREDIT).alias("credit"), when_sum(DEBIT).alias("debit"), F.count("*").alias("n"))


def cross_account(st: DataFrame, key: str = KEY) -> DataFrame:
    """All statements of an account as one: first opening, last closing."""
    return st.groupBy(key).agg(F.round(F.sum("credit"), 2).alias("credit"), F.round(F.sum("debit"), 2).alias("debit"), F.sum("n").alias("n"), F.min_by("opening", "period_from").alias("opening"), F.max_by("closing", "period_to").alias("closing"), F.count("*").alias("statements"))


def balance_identity(st: DataFrame, key: str = KEY) -> DataFrame:
    """Opening + credit - debit = closing, within a cent."""
    diff = F.round(F.col("opening") + F.col("credit") - F.col("debit") - F.col("closing"), 2)
    return st.select(key, "month", diff.alias("difference"), (F.abs(diff) <= 0.01).alias("holds"))


def statement_chain(st: DataFrame, key: str = KEY) -> DataFrame:
    """From each statement to the next: missing days, overlap, balance break."""
    w = Window.partitionBy(key).orderBy("period_from", "month")
    nxt = st.withColumn("next_from", F.lead("period_from").over(w)).withColumn("next_opening", F.lead("opening").over(w)).where("next_from is not null")
    days = F.datediff("next_from", "period_to")
    kind = F.when(days > 1, "gap").when(days < 1, "overlap").otherwise("none")
    return nxt.select(key, "month", days.alias("days"), kind.alias("dates"), (F.abs(F.col("closing") - F.col("next_opening")) > 0.01).alias("balance_break"))


def validate_statements(st: DataFrame, case: str = "case_id", tolerance: float = 0.01) -> DataFrame:
    """What is wrong with the statements of a case: (case, statement_id, type, level, detail).

    st: case, statement_id, account_number, bank_id, file_hash, period_from, period_to, opening, closing,
    tx_min, tx_max, tx_count, declared. Checks: several accounts (error) or banks; a file met before
    (error); days between periods, or periods that overlap; a closing balance that is not the next
    opening one (error); transactions before or after the period; fewer than declared. A null on either
    side of a comparison is no finding. Findings of a whole case bear no statement.
    """
    level = lambda kind: F.lit("error" if kind in ("account_mismatch", "duplicate", "balance_break") else "warning")

    def finding(df: DataFrame, kind: str, detail: Column, one: Column | None = None) -> DataFrame:
        return df.select(case, (F.lit(None).cast("string") if one is None else one.cast("string")).alias("statement_id"), F.lit(kind).alias("type"), level(kind).alias("level"), detail.cast("string").alias("detail"))

    per = st.groupBy(case).agg(F.countDistinct(F.when(F.col("account_number") != "", F.col("account_number"))).alias("accounts"), F.countDistinct(F.when(F.col("bank_id") != "", F.col("bank_id"))).alias("banks"))
    one = F.col("statement_id")
    again = st.where("file_hash <> ''").withColumn("r", F.row_number().over(Window.partitionBy(case, "file_hash").orderBy("period_from", "statement_id"))).where("r > 1")
    w = Window.partitionBy(case).orderBy("period_from", "statement_id")
    nxt = st.withColumns({"next_from": F.lead("period_from").over(w), "next_opening": F.lead("opening").over(w)})
    days = F.datediff("next_from", "period_to")
    parts = [
        finding(per.where("accounts > 1"), "account_mismatch", F.col("accounts")), finding(per.where("banks > 1"), "bank_mismatch", F.col("banks")), finding(again, "duplicate", F.col("file_hash"), one),
        finding(nxt.where(days > 1), "date_gap", days - 1, one), finding(nxt.where(days < 0), "date_overlap", -days, one),
        finding(nxt.where(F.abs(F.col("closing") - F.col("next_opening")) > tolerance), "balance_break", F.round(F.col("closing") - F.col("next_opening"), 2).cast("decimal(18,2)"), one),
        finding(st.where("tx_min < period_from"), "tx_before_period", F.col("tx_min"), one), finding(st.where("tx_max > period_to"), "tx_after_period", F.col("tx_max"), one),
        finding(st.where("declared > 0 and tx_count < declared"), "tx_incomplete", F.col("declared") - F.col("tx_count"), one),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def statement_history(st: DataFrame, tx: DataFrame, risky: list[str], key: str = KEY) -> DataFrame:
    """Each statement with its rows and its risky ones."""
    r = tx.where(F.col("category").isin(risky)).groupBy(key, month().alias("month")).agg(F.count("*").alias("risky"))
    return st.join(r, [key, "month"], "left").select(key, "month", "n", F.coalesce("risky", F.lit(0)).cast("long").alias("risky"))


def label_counts(labelled: DataFrame, key: str = KEY) -> DataFrame:
    """Rows of each label, by account and (account null) in all."""
    return labelled.groupingSets([[F.col(key), F.col("label")], [F.col("label")]], key, "label").agg(F.count("*").alias("n"))


#: Fixed value: titles that say that a transfer is between own accounts.
OWN_TRANSFER = r"(?i)przelew\s+w[łl]asny|przelew\s+wewn|mi[ęe]dzy\s+rach|rachunek\s+w[łl]asny"


def internal_by_amount(tx: DataFrame, key: str = KEY, days: int = 1, title: str | None = None) -> DataFrame:
    """A debit and a credit of another account, same amount, a day apart at most. One a debit, the
    nearest; a credit may answer several. A debit whose title (column ``title``) says that it is an own
    transfer is the surer."""
    near = F.explode(F.array(*(F.date_add("booking_date", i) for i in range(-days, days + 1))))
    hint = F.coalesce(F.col(title).rlike(OWN_TRANSFER), F.lit(False)) if title else F.lit(False)
    credit = tx.where(CREDIT).select(F.col(key).alias("to_account"), F.col("tx_id").alias("credit_id"), F.col("booking_date").alias("credit_day"), "amount", near.alias("day"))
    debit = tx.where(DEBIT).select(F.col(key).alias("from_account"), F.col("tx_id").alias("debit_id"), F.col("booking_date").alias("day"), "amount", hint.alias("hint"))
    pairs = debit.join(credit, ["amount", "day"]).where("from_account <> to_account")
    far = F.abs(F.datediff("credit_day", "day"))
    best = pairs.groupBy("debit_id").agg(F.min(F.struct(far.alias("far"), "credit_id", "from_account", "to_account", "amount", "hint")).alias("b"))
    sure = F.when(F.col("b.hint"), 0.85).otherwise(0.6) + F.when(F.col("b.far") == 0, 0.1).otherwise(0.0)
    return best.select("debit_id", "b.credit_id", "b.from_account", "b.to_account", F.col("b.amount").cast("double").alias("amount"), F.round(sure, 2).alias("confidence"), F.when(F.col("b.hint"), "title_match").otherwise("amount_date").alias("method"))


def internal_by_account(debits: DataFrame, credits: DataFrame, days: int = 3, tolerance: float = 0.02) -> DataFrame:
    """The debit names the other account (column named); nearest credit there in time.

    Amounts are joined by their whole unit and its neighbours, then compared.
    """
    unit = F.floor("amount").cast("long")
    d = debits.withColumn("unit", F.explode(F.array(unit - 1, unit, unit + 1)))
    c = credits.select(F.col(KEY).alias("named"), F.col("tx_id").alias("credit_id"), F.col("booking_date").alias("credit_day"), F.col("amount").alias("credit_amount"), F.floor("amount").cast("long").alias("unit"))
    near = d.join(c, ["named", "unit"]).where((F.abs(F.col("amount") - F.col("credit_amount")) <= tolerance) & (F.abs(F.datediff("credit_day", "booking_date")) <= days) & (F.col("named") != F.col(KEY)))
    best = near.groupBy("tx_id").agg(F.min(F.struct(F.abs(F.datediff("credit_day", "booking_date")).alias("days"), "credit_id", KEY, "named")).alias("b"))
    return best.select(F.col("tx_id").alias("debit_id"), "b.credit_id", F.col(f"b.{KEY}").alias("from_account"), F.col("b.named").alias("to_account"), F.col("b.days").alias("days"))


def shared_counterparties(tx: DataFrame, key: str = KEY, least: int = 2) -> DataFrame:
    """Names that several accounts deal with."""
    return tx.where("counterparty is not null and counterparty <> ''").groupBy("counterparty").agg(F.countDistinct(key).alias("accounts"), F.count("*").alias("n"), money(F.abs("amount")).alias("total")).where(F.col("accounts") >= least)


def flow_edges(tx: DataFrame, key: str = KEY, ids: int = 20) -> DataFrame:
    """Edges of account and name, with sums, days and the first ids."""
    src = F.when(F.expr(CREDIT), F.concat(F.lit("cp:"), "counterparty")).otherwise(F.concat(F.lit("acc:"), F.col(key).cast("string")))
    dst = F.when(F.expr(CREDIT), F.concat(F.lit("acc:"), F.col(key).cast("string"))).otherwise(F.concat(F.lit("cp:"), "counterparty"))
    e = tx.select(src.alias("src"), dst.alias("dst"), F.col("channel").alias("edge_type"), "amount", "booking_date", "tx_id")
    by = ["src", "dst", "edge_type"]
    g = ranked(e, by).groupBy(*by)
    return g.agg(F.count("*").alias("n"), money(F.abs("amount")).alias("total"), F.min("booking_date").alias("first_day"), F.max("booking_date").alias("last_day"), first_ids(ids))


#: Priority of risk categories at a node.
RISK = {"gambling": 3, "crypto": 2, "loans": 2, "risky": 1, "everyday": 0}


def flow_nodes(tx: DataFrame, key: str = KEY) -> DataFrame:
    """Accounts and names with their kind, count, highest risk and the category it comes from."""
    level = F.create_map(*(x for k, v in RISK.items() for x in (F.lit(k), F.lit(v))))[F.col("category")]
    kind = F.when(F.col("channel") == "BLIK_P2P", "person").when(F.col("channel") == "CASH", "cash").when(F.col("channel") == "FEE", "bank").otherwise("merchant")
    cluster = F.max(F.struct("level", "category")).alias("m")
    t = tx.withColumns({"level": level, "kind": kind})
    cp = t.groupBy(F.concat(F.lit("cp:"), "counterparty").alias("node")).agg(F.max("kind").alias("kind"), F.max("level").alias("risk"), F.count("*").alias("n"), cluster)
    acc = t.groupBy(F.concat(F.lit("acc:"), F.col(key).cast("string")).alias("node")).agg(F.lit("account").alias("kind"), F.max("level").alias("risk"), F.count("*").alias("n"), cluster)
    return cp.unionByName(acc).withColumn("cluster", F.col("m.category")).drop("m")


def filter_graph(nodes: DataFrame, edges: DataFrame, least_risk: int) -> DataFrame:
    """Edges with a risky end, and only the nodes that they use."""
    risky = nodes.where(F.col("risk") >= least_risk).select("node")
    left = edges.join(risky.toDF("src"), "src", "left_semi")
    right = edges.join(risky.toDF("dst"), "dst", "left_semi")
    kept = left.unionByName(right).select("src", "dst").distinct()
    used = kept.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes.join(used, "node", "left_semi")


def touch_counterparties(tx: DataFrame) -> DataFrame:
    """How often each name was seen, with sums and days."""
    return tx.groupBy("counterparty").agg(F.count("*").alias("times_seen"), money(F.abs("amount")).alias("total"), F.min("booking_date").alias("first_seen"), F.max("booking_date").alias("last_seen"), F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("sources"))


def learning_queue(tx: DataFrame, labels: DataFrame) -> DataFrame:
    """Names without a decision yet."""
    return touch_counterparties(tx).select("counterparty", "times_seen").join(labels.select("counterparty"), "counterparty", "left_anti")


def apply_labels(tx: DataFrame, labels: DataFrame) -> DataFrame:
    """The label of the name, neutral without one."""
    return tx.join(labels.select(F.lower("counterparty").alias("k"), "label"), F.lower("counterparty") == F.col("k"), "left").withColumn("label", F.coalesce("label", F.lit("neutral"))).drop("k")


#: Labels that an analyst may give.
LABELS = ["neutral", "legitimate", "suspicious", "monitoring"]


def set_labels(current: DataFrame, batch: DataFrame, allowed: list[str] = LABELS) -> tuple[DataFrame, DataFrame]:
    """Labels after a batch (tx_id, label, note, seq), and what of it was refused, with the reason.

    A missing label is neutral, a missing note empty; a label that is not allowed is refused and changes
    nothing; of several for a transaction the last (by seq) counts. current: tx_id, label, note.
    """
    b = batch.withColumns({"label": F.coalesce("label", F.lit("neutral")), "note": F.coalesce("note", F.lit(""))})
    good = b.where(F.col("label").isin(allowed) & F.col("tx_id").isNotNull())
    reason = F.when(F.col("tx_id").isNull(), "no transaction").otherwise(F.concat(F.lit("invalid label "), "label"))
    refused = b.where(~F.col("label").isin(allowed) | F.col("tx_id").isNull()).select("tx_id", "label", "seq", reason.alias("reason"))
    new = good.groupBy("tx_id").agg(F.max_by(F.struct("label", "note"), F.struct("seq", "label", "note")).alias("n"))
    both = current.select("tx_id", F.struct("label", "note").alias("o")).join(new, "tx_id", "full_outer")
    return both.select("tx_id", F.coalesce("n", "o").alias("l")).select("tx_id", "l.*"), refused


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The newest row of each key."""
    return top_per_key(df, key, order, 1, "rn").drop("rn")


def risk_reasons(tags: DataFrame, weights: DataFrame, totals: DataFrame, key: str = KEY, ids: int = 10) -> DataFrame:
    """Tags (key, tag, amount, tx_id) weighed by their share of the key's total: under a tenth only in
    part; with the first ids as evidence, ranked by what they add."""
    t = ranked(tags.withColumn("tag", F.upper("tag")), [key, "tag"])
    t = t.groupBy(key, "tag").agg(F.count("*").alias("n"), money(F.abs("amount")).alias("amount"), first_ids(ids))
    return weighed(t, weights, totals, key)


def weighed(t: DataFrame, weights: DataFrame, totals: DataFrame, key: str = KEY) -> DataFrame:
    """A17 from sums: key, tag (in capitals), n, amount, tx_ids."""
    w = weights.select(F.col("tag").alias("wtag"), "weight").where("weight > 0")
    t = t.join(w.toDF("tag", "own"), "tag", "left").join(w.toDF("bare", "other"), F.regexp_replace("tag", "RISK[:_]", "") == F.col("bare"), "left")
    t = t.withColumn("weight", F.coalesce("own", "other")).where("weight is not null").drop("own", "other", "bare")
    t = t.join(totals.select(key, F.col("total").alias("all_")), key)
    pct = F.when(F.col("all_") > 0, F.col("amount") / F.col("all_") * 100).otherwise(0.0)
    t = t.withColumn("pct", pct).withColumn("delta", F.when(F.col("pct") < 10, F.least(F.col("weight"), F.col("weight") * F.col("pct") / 10)).otherwise(F.col("weight")))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("delta"), "tag"))
    return t.select(key, "tag", "n", "amount", "pct", "delta", "tx_ids", rank.alias("rank"))


def risk_score(tags: DataFrame, weights: DataFrame, totals: DataFrame, key: str = KEY) -> DataFrame:
    """The reasons' sum, at most 100."""
    return risk_score_of(risk_reasons(tags, weights, totals, key), key)


def risk_score_of(reasons: DataFrame, key: str = KEY) -> DataFrame:
    return reasons.groupBy(key).agg(F.round(F.least(F.sum("delta"), F.lit(100.0)), 4).alias("score"), F.count("*").alias("reasons"))


def evidence(tags: DataFrame, key: str = KEY, n: int = 10) -> DataFrame:
    """The first ids of each tag."""
    return ranked(tags, [key, "tag"]).groupBy(key, "tag").agg(F.count("*").alias("n"), first_ids(n))


def deduplicate(tx: DataFrame, keys: list[str], order: str = "tx_id") -> DataFrame:
    """A4: the first of equal rows."""
    return tx.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("rn = 1").drop("rn")


def resolve_entities(names: DataFrame, known: DataFrame, part: float = 0.7, fuzzy: float = 0.8) -> DataFrame:
    """Exact name, else containment with the shorter at least ``part`` of the longer, else shared words
    at ``fuzzy`` of the longer, else a new entity. Of several the best: stage, score, entity.

    Names meet known names alone, never each other: what contains a name contains its rarest piece, and
    names that share enough words share one of the rarest few of each (prefix filter), within a bound on
    their sizes.
    """
    from .references import containing

    low = lambda c: F.lower(F.trim(c))
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    a = names.select("name", low("name").alias("x")).where("name is not null").distinct()
    b = known.select(low("name").alias("y"), "entity_id").where("y is not null").distinct()
    xs, ys = a.select("x").where("x <> ''").distinct(), b.select("y").where("y <> ''").distinct()
    share = F.least(F.length("x"), F.length("y")) / F.greatest(F.length("x"), F.length("y"))
    enough = F.least(F.length("x"), F.length("y")) >= F.greatest(F.length("x"), F.length("y")) * part
    two = containing(xs, ys).where(enough).select("x", "y", share.alias("s"), F.lit(2).alias("stage"))
    own = xs.select(F.col("x").alias("v"), F.lit("x").alias("side")).unionByName(ys.select(F.col("y").alias("v"), F.lit("y").alias("side")))
    e = own.select("v", "side", F.explode(words(F.col("v"))).alias("w"))
    f = e.join(e.groupBy("w").agg(F.count("*").alias("f")), "w")
    rare = f.groupBy("v", "side").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "w"))), lambda s: s["w"]).alias("ws"))
    n = F.size("ws")
    head = rare.select("v", "side", "ws", F.explode(F.slice("ws", 1, (n - F.ceil(n * F.lit(fuzzy)) + 1).cast("int"))).alias("w"))
    of = lambda s: head.where(F.col("side") == s).select(F.col("v").alias(s), F.col("ws").alias(f"w{s}"), "w")
    pairs = of("x").join(of("y"), "w").where((F.col("x") != F.col("y")) & (F.least(F.size("wx"), F.size("wy")) >= F.greatest(F.size("wx"), F.size("wy")) * fuzzy))
    ratio = F.size(F.array_intersect("wx", "wy")) / F.greatest(F.size("wx"), F.size("wy"))
    three = pairs.select("x", "y", ratio.alias("s")).distinct().where(F.col("s") >= fuzzy).withColumn("stage", F.lit(3))
    one = b.select(F.col("y").alias("x"), "y", F.lit(1.0).alias("s"), F.lit(1).alias("stage"))
    best = one.unionByName(two).unionByName(three).join(b, "y").groupBy("x").agg(F.min(F.struct("stage", (-F.col("s")).alias("s"), "entity_id")).alias("b"))
    out = a.join(best, "x", "left")
    return out.select("name", F.col("b.entity_id").alias("entity_id"), F.when(F.col("b.stage") == 1, "exact").when(F.col("b.stage") == 2, "part").when(F.col("b.stage") == 3, "fuzzy").otherwise("new").alias("how"))
