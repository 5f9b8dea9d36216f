"""Household finance over bank transactions: recurrence, health score, months and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import city_of, first_of
from .bank import CREDIT, DEBIT, KEY, money, month, when_sum
from .running import running


def monthly_recurrence(tx: DataFrame, key: str = KEY, bucket: int = 10, low: int = 20, high: int = 40) -> DataFrame:
    """outflows of one name and rounded amount whose mean gap is about a month."""
    out = tx.where(DEBIT).withColumn("bucket", F.round(F.abs("amount").cast("double") / bucket).cast("long") * bucket)
    w = Window.partitionBy(key, "counterparty", "bucket").orderBy("booking_date", "tx_id")
    gaps = out.withColumn("gap", F.datediff("booking_date", F.lag("booking_date").over(w)))
    g = gaps.groupBy(key, "counterparty", "bucket").agg(F.count("*").alias("n"), F.avg("gap").alias("mean_gap"), money(F.abs("amount")).alias("total"))
    return g.where((F.col("n") >= 2) & F.col("mean_gap").between(low, high)).withColumn("mean_gap", F.round("mean_gap", 4))


def steps(c: Column, limits: list[tuple[float, int]], last: int) -> Column:
    """The value of the first limit that c does not exceed."""
    out = F.lit(last)
    for limit, value in reversed(limits):
        out = F.when(c <= limit, value).otherwise(out)
    return out


#: How transfers to a telephone and purchases are written.
BLIK_PHONE = r"przelew\s*(?:na|z)\s*telefon|blik\s*(?:przelew|transfer|na\s*telefon|z\s*telefonu)|przelew\s*blik\s*(?:na|z)\s*tel|przelew\s*mobilny"
BLIK_PURCHASE = r"blik\s*(?:zakup|platnosc|płatność|p[łl]atno[śs][ćc])|zakup\s*blik|transakcja\s*blik|p[łl]atno[śs][ćc]\s*blik|blik\s*(?:w\s+)?(?:sklepie|internecie|online)"

#: Weights of the eight components.
WEIGHTS = {"income_stability": 15, "balance_trend": 10, "expense_ratio": 20, "recurring_burden": 15, "risk_gambling": 15, "risk_crypto": 5, "risk_loans": 15, "risk_deficit": 5}


def health_score(tx: DataFrame, recurring: DataFrame, balances: DataFrame, key: str = KEY) -> DataFrame:
    """eight step functions of one aggregate and their weighted mean, rounded half to even."""
    of = lambda c: when_sum(f"category = '{c}'")
    a = tx.groupBy(key).agg(
        when_sum(CREDIT).alias("income"), when_sum(DEBIT).alias("expense"), of("gambling").alias("gambling"), of("crypto").alias("crypto"), of("loans").alias("loans"),
        F.count_if(F.expr(CREDIT)).alias("credits"), F.countDistinct(F.when(F.expr(CREDIT), F.col("counterparty"))).alias("sources"),
        F.greatest(F.datediff(F.max("booking_date"), F.min("booking_date")), F.lit(1)).alias("days"),
    )
    a = a.join(recurring.groupBy(key).agg(F.sum("total").alias("fixed")), key, "left").join(balances.select(key, "first_balance", "last_balance"), key, "left")
    a = a.withColumn("fixed", F.coalesce("fixed", F.lit(0.0)))
    per_month = F.col("credits") / F.greatest(F.col("days") / 30, F.lit(1.0))
    stable = F.when(F.col("credits") == 0, 10).otherwise(F.least(F.lit(100), F.when(per_month >= 2, 80).when(per_month >= 1, 60).otherwise(30) + F.when(F.col("sources") >= 2, 10).otherwise(0)))
    t = F.round(F.col("last_balance") - F.col("first_balance"), 2)
    part = lambda c, by, of: F.floor(F.least(F.abs(c) / by, F.lit(1.0)) * of).cast("int")
    trend = F.when(t > 0, 60 + part(t, 500, 40)).when(t < 0, 50 - part(t, 1000, 50)).otherwise(50)
    net = F.round(F.col("income") - F.col("expense"), 2)
    deficit = F.when(net > 0, 60 + part(net, 1000, 40)).when(net == 0, 50).otherwise(40 - part(net, 2000, 40))
    pct = lambda c: F.col(c) / F.greatest("income", "expense", F.lit(1.0)) * 100
    fixed = F.when(F.col("income") > 0, F.col("fixed") / F.col("income") * 100).when(F.col("expense") > 0, F.col("fixed") / F.col("expense") * 100).otherwise(0.0)
    ratio = F.when(F.col("income") > 0, steps(F.col("expense") / F.col("income"), [(0.7, 100), (0.9, 70), (1.0, 40), (1.2, 20)], 0)).when(F.col("expense") > 0, 10).otherwise(50)
    none = lambda c, s: F.when(F.col(c) == 0, 100).otherwise(s)
    parts = {
        "income_stability": stable, "balance_trend": trend, "expense_ratio": ratio, "recurring_burden": steps(fixed, [(30, 90), (50, 60), (70, 30)], 10),
        "risk_gambling": none("gambling", steps(pct("gambling"), [(1, 80), (5, 50), (15, 20)], 0)), "risk_crypto": none("crypto", steps(pct("crypto"), [(5, 80), (15, 50), (30, 25)], 10)),
        "risk_loans": none("loans", steps(pct("loans"), [(10, 70), (25, 40), (50, 15)], 0)), "risk_deficit": deficit,
    }
    out = a.select(key, *(c.cast("int").alias(k) for k, c in parts.items()))
    total = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0)) / sum(WEIGHTS.values())
    return out.withColumn("score", F.bround(total, 0).cast("int"))


def month_snapshots(tx: DataFrame, key: str = KEY) -> DataFrame:
    """income, expense and risky sums of each month."""
    of = lambda c: when_sum(f"category = '{c}'").alias(f"{c}_total")
    g = tx.groupBy(key, month().alias("period")).agg(when_sum(CREDIT).alias("income"), when_sum(DEBIT).alias("expense"), of("gambling"), of("crypto"), of("loans"), F.count("*").alias("n"))
    return g.withColumn("net_flow", F.round(F.col("income") - F.col("expense"), 2))


#: Metrics and how severe their change is.
METRICS = {"net_flow": "high", "income": "medium", "expense": "medium", "gambling_total": "high", "crypto_total": "medium", "loans_total": "high"}


def trends(months: DataFrame, key: str = KEY) -> DataFrame:
    """direction of each metric over the months; stable ones only if severe."""
    long = months.unpivot([key, "period"], list(METRICS), "metric", "value")
    i = F.row_number().over(Window.partitionBy(key, "metric").orderBy("period")) - 1
    g = long.withColumn("i", i.cast("double")).groupBy(key, "metric").agg(
        F.count("*").alias("n"), F.min_by("value", "period").alias("first"), F.max_by("value", "period").alias("last"), F.regr_slope("value", "i").alias("slope"),
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.max(F.abs("value")).alias("most"),
    )
    change = F.when(F.col("first") != 0, (F.col("last") - F.col("first")) / F.abs("first") * 100).when(F.col("last") > 0, 100.0).when(F.col("last") < 0, -100.0).otherwise(0.0)
    g = g.where("n >= 2 and most > 0").withColumn("change_pct", change)
    calm = F.abs("change_pct") < 10
    long_ = F.when((F.col("mean") != 0) & (F.abs(F.col("std") / F.col("mean")) > 0.5), "volatile").when(calm, "stable").when(F.col("slope") > 0, "increasing").otherwise("decreasing")
    short = F.when(calm, "stable").when(F.col("last") > F.col("first"), "increasing").otherwise("decreasing")
    severity = F.create_map(*(F.lit(x) for kv in METRICS.items() for x in kv))[F.col("metric")]
    out = g.withColumn("direction", F.when(F.col("n") >= 3, long_).otherwise(short)).withColumn("severity", severity)
    return out.where("direction <> 'stable' or severity = 'high'").select(key, "metric", "n", "direction", "severity", F.round("change_pct", 2).alias("change_pct"))


def trajectory(months: DataFrame, key: str = KEY) -> DataFrame:
    """deficit months and the direction of the risky share between first and last month."""
    risky = F.col("gambling_total") + F.col("crypto_total") + F.col("loans_total")
    g = months.groupBy(key).agg(F.count("*").alias("months"), F.count_if(F.col("net_flow") < 0).alias("deficit_months"), F.min_by(risky, "period").alias("a"), F.max_by(risky, "period").alias("z"))
    return g.select(key, "months", "deficit_months", F.round(1 - F.col("deficit_months") / F.col("months"), 4).alias("discipline"), F.when(F.col("z") > F.col("a") * 1.1, "worsening").when(F.col("z") < F.col("a") * 0.9, "improving").otherwise("steady").alias("risk_direction"))


def spending_rows(tx: DataFrame, fuel: dict[str, str], shops: dict[str, str], cities: list[str]) -> DataFrame:
    """what each outflow was: kind fuel, else BLIK (phone_transfer, online_purchase or payment), else
    shop, else other; with its station or shop and its city.

    tx: key, tx_id, booking_date, amount, direction, title, payee, bank_category. fuel and shops: pattern
    to name, in order; they are rule tables of the caller.
    """
    text = F.lower(F.concat_ws(" ", "payee", "title"))
    name = lambda rules: first_of([(F.col("text").rlike(f"(?i){p}"), n) for p, n in rules.items()])
    t = tx.where(DEBIT).withColumn("text", text).withColumns({"station": name(fuel), "shop": name(shops), "city": city_of(F.col("text"), cities)})
    blik = (F.upper(F.coalesce("bank_category", F.lit(""))) == "P.BLIK") | F.col("text").contains("blik")
    kind = F.when(F.col("text").rlike(BLIK_PHONE), "phone_transfer").when(F.col("text").rlike(BLIK_PURCHASE) | F.col("shop").isNotNull(), "online_purchase").otherwise("payment")
    return t.withColumn("kind", F.when(F.col("station").isNotNull(), "fuel").when(blik, kind).when(F.col("shop").isNotNull(), "shop").otherwise("other")).drop("text")


def top_shops(rows: DataFrame, key: str = KEY, n: int = 5) -> DataFrame:
    """the shops most often bought at, in them or online, with their share of all such purchases."""
    g = rows.where("shop is not null and kind in ('shop', 'online_purchase')").groupBy(key, "shop").agg(F.count("*").alias("n"), money(F.abs("amount")).alias("total"))
    w = Window.partitionBy(key)
    g = g.withColumn("share", F.round(F.col("n") / F.sum("n").over(w), 4)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "shop")))
    return g.where(F.col("rank") <= n)


def fuel_visits(rows: DataFrame, key: str = KEY) -> DataFrame:
    """visits to stations by city, and whether that is the home city: where most is bought (ties by name)."""
    home = rows.where("city is not null and kind in ('fuel', 'shop')").groupBy(key, "city").agg(F.count("*").alias("k")).groupBy(key).agg(F.min_by("city", F.struct(-F.col("k"), "city")).alias("home"))
    g = rows.where("kind = 'fuel'").groupBy(key, "station", F.coalesce("city", F.lit("")).alias("city")).agg(F.count("*").alias("n"), money(F.abs("amount")).alias("total"))
    return g.join(home, key, "left").select(key, "station", "city", "n", "total", F.coalesce(F.col("city") == F.col("home"), F.lit(False)).alias("at_home"), ((F.col("city") != "") & ~F.coalesce(F.col("city") == F.col("home"), F.lit(False))).alias("travel"))


def people_paid(rows: DataFrame, key: str = KEY) -> DataFrame:
    """persons that transfers to a telephone went to."""
    p = rows.where("kind = 'phone_transfer' and length(trim(payee)) >= 2")
    return p.groupBy(key, F.lower(F.trim("payee")).alias("person")).agg(F.count("*").alias("n"), money(F.abs("amount")).alias("total"), F.max("booking_date").alias("last_day"))


def standing_orders(tx: DataFrame, key: str = KEY) -> DataFrame:
    """standing orders by who gets them, with their categories."""
    s = tx.where("upper(bank_category) = 'ST.ZLEC' and length(trim(payee)) >= 2")
    g = s.groupBy(key, F.lower(F.trim("payee")).alias("recipient")).agg(F.count("*").alias("n"), money(F.abs("amount")).alias("total"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
    return g.withColumn("mean", F.round(F.col("total") / F.col("n"), 6)).withColumn("classified", F.col("categories") != "")


def reconcile_totals(st: DataFrame) -> DataFrame:
    """a statement's totals from its table, else its header, else computed, with a note."""
    pick = lambda c: F.coalesce(f"table_{c}", f"header_{c}", f"computed_{c}")
    note = lambda c: F.when(F.col(f"table_{c}").isNotNull(), "table").when(F.col(f"header_{c}").isNotNull(), "header").otherwise("computed")
    return st.select("*", pick("credit").alias("credit"), note("credit").alias("credit_from"), pick("debit").alias("debit"), note("debit").alias("debit_from"))


def balance_chain(rows: DataFrame, key: str = KEY, tolerance: float = 0.02, block: int = 4096) -> DataFrame:
    """each known balance against the known one before it and what was booked since.

    rows: key, seq (whole number), amount (signed), balance (null where unknown). A key's rows are dealt to
    blocks of ``block`` numbers.
    """
    part = F.floor(F.col("seq") / block)
    r = running(rows, [key], part, ["seq"], {"total": F.col("amount")})
    r = r.withColumn("off", F.when(F.col("balance").isNotNull(), F.col("balance") - F.col("total")))
    r = running(r, [key], part, ["seq"], {}, {"before": F.col("off")}).where("balance is not null and before is not null")
    return r.select(key, "seq", F.round(F.col("off") - F.col("before"), 2).alias("difference"), (F.abs(F.col("off") - F.col("before")) <= tolerance).alias("holds"))


def override_months(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """new rows replace old ones of the same key."""
    return old.join(new.select(*on), on, "left_anti").unionByName(new)


def merge_sections(st: DataFrame, key: list[str]) -> DataFrame:
    """sections of one currency as one: earliest, latest, first opening, last closing, sums."""
    return st.groupBy(*key).agg(F.min("period_from").alias("period_from"), F.max("period_to").alias("period_to"), F.min_by("opening", F.struct("period_from", "account_id")).alias("opening"), F.max_by("closing", F.struct("period_to", "account_id")).alias("closing"), F.round(F.sum("credit"), 2).alias("credit"), F.round(F.sum("debit"), 2).alias("debit"), F.array_join(F.array_sort(F.collect_set("account_id")).cast("array<string>"), ",").alias("accounts"))


def category_flows(tx: DataFrame, categories: Column, key: str = KEY) -> DataFrame:
    """F16: in, out and count of each of a row's categories; rows without any are unclassified."""
    e = tx.select(key, "amount", "direction", F.explode_outer(categories).alias("label")).withColumn("label", F.coalesce("label", F.lit("unclassified")))
    return e.groupBy(key, "label").agg(when_sum(CREDIT).alias("inflow"), when_sum(DEBIT).alias("outflow"), F.count("*").alias("n"))


#: Shares of all outflows above which a category is flagged: warning, then alarm.
BUDGET_FLAGS = {"gambling": (0.01, 0.05), "loans": (0.2, 0.4), "crypto": (0.05, 0.2), "risky": (0.05, 0.15)}


def budget_flags(flows: DataFrame, key: str = KEY, limits: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """F16: each category's share of all that went out, and the flag that the share earns. flows: as
    ``category_flows`` of one label a row."""
    limits = limits or BUDGET_FLAGS
    share = F.col("outflow") / F.sum("outflow").over(Window.partitionBy(key))
    low = F.create_map(*(F.lit(x) for k, (a, _) in limits.items() for x in (k, a)))[F.col("label")]
    high = F.create_map(*(F.lit(x) for k, (_, z) in limits.items() for x in (k, z)))[F.col("label")]
    f = flows.withColumn("share", share).withColumn("flag", F.when(F.col("share") > high, "alarm").when(F.col("share") > low, "warning").otherwise("none"))
    return f.select(key, "label", "outflow", F.round("share", 6).alias("share"), "flag")


def recurring_totals(recurring: DataFrame, groups: DataFrame, key: str = KEY) -> DataFrame:
    """F16: what recurs each month, by the category of the name. groups: key, counterparty, category."""
    r = recurring.join(groups, [key, "counterparty"], "left").withColumn("category", F.coalesce("category", F.lit("unclassified")))
    return r.groupBy(key, "category").agg(F.count("*").alias("series"), F.round(F.sum(F.col("total") / F.col("n")), 4).alias("a_month"), F.sum("total").alias("total"))
