"""Operators over an exchange's records, for all owners at once.

Columns: row_id, owner (the key), ts_s (epoch seconds), token, amount, tx_type, and, where a record
has them: side, market, quote_token, total_value, fiat_value, category, sheet, fee, fee_coin,
network, counterparty, direction, payment_method, status, from_address, internal. Missing values
are null. Sequences within an owner are ordered by (ts_s, row_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks
from .ledger import FIAT, PRIVACY, day, sum_if, total
from .running import numbered

OWNER = "owner"
#: Categories and types of rewards, and networks that are often used to launder.
REWARDS = ["staking_reward", "earn", "savings_interest", "interest", "cashback", "referral_bonus"]
REWARD_TYPES = ["staking_reward", "learn_reward"]
HIGH_RISK_NETWORKS = ["TRX", "TRON", "TRC20", "BSC", "BEP20", "BEP2"]


def _n(condition: str) -> Column:
    return F.count_if(F.coalesce(F.expr(condition), F.lit(False)))


BUYS = "tx_type in ('deposit', 'swap', 'buy') and coalesce(side, '') in ('BUY', '')"
SELLS = f"tx_type in ('withdrawal', 'swap', 'sell') and coalesce(side, '') in ('SELL', '') and not ({BUYS})"


def behaviour(tx: DataFrame) -> DataFrame:
    """The measures that the profiles read, one row an owner.

    Holding time: from each acquisition to the next disposal of the token, by a running minimum from
    the end; without any, the whole span. Large: over ten times the owner's mean.
    """
    order = Window.partitionBy(OWNER).orderBy("ts_s", "row_id")
    later = Window.partitionBy(OWNER, "token").orderBy(F.desc("ts_s")).rangeBetween(Window.unboundedPreceding, -1)
    positive = F.when(F.col("amount") > 0, F.col("amount").cast("double"))
    value = F.abs(F.col("fiat_value").cast("double"))
    s = tx.withColumn("gap", F.col("ts_s") - F.lag("ts_s").over(order)).withColumn("day", day()).withColumn("positive", positive).withColumn("value", F.when(value != 0, value))
    sold = F.min(F.when(F.expr(SELLS), F.col("ts_s"))).over(later)
    s = s.withColumn("held", F.when(F.expr(BUYS) & F.col("token").isNotNull(), (sold - F.col("ts_s")) / 3600))
    means = tx.select(OWNER, positive.alias("p"), F.when(value != 0, value).alias("v")).groupBy(OWNER).agg(F.avg("p").alias("mean_p"), F.avg("v").alias("mean_v"))
    s = s.join(means, OWNER)
    g = s.groupBy(OWNER).agg(
        F.count("*").alias("n"), F.greatest(F.floor((F.max("ts_s") - F.min("ts_s")) / 86400), F.lit(1)).cast("long").alias("span_days"),
        _n("tx_type in ('swap', 'buy', 'sell')").alias("swaps"), _n("tx_type in ('deposit', 'fiat_deposit', 'buy')").alias("deposits"), _n("tx_type in ('withdrawal', 'fiat_withdrawal')").alias("withdrawals"),
        F.countDistinct("token").alias("tokens"), F.coalesce(F.avg("positive"), F.lit(0.0)).alias("mean_amount"), F.coalesce(F.max("positive"), F.lit(0.0)).alias("max_amount"),
        F.coalesce(F.sum("positive"), F.lit(0.0)).alias("volume"), _n("positive > 10 * mean_p").alias("large"), F.coalesce(F.max("value"), F.lit(0.0)).alias("max_fiat"),
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("fiat_volume"), _n("value > 10 * mean_v").alias("large_fiat"), F.countDistinct("day").alias("active_days"),
        F.avg("held").alias("mean_held_h"),
        F.coalesce(F.bool_or(F.expr("sheet = 'Margin Order'")), F.lit(False)).alias("leverage"),
        _n(f"category in {tuple(REWARDS)} or tx_type in {tuple(REWARD_TYPES)}").alias("rewards"), _n("sheet = 'Card Transaction'").alias("card"), _n(f"token in {tuple(PRIVACY[:7])}").alias("privacy"),
        _n("lower(category) like '%airdrop%'").alias("airdrops"), _n("gap < 300").alias("rapid"), _n("internal").alias("internal"),
    )
    per_day = tx.groupBy(OWNER, day().alias("day")).agg(F.count("*").alias("k")).groupBy(OWNER).agg(F.max("k").alias("max_per_day"))
    both = tx.where("tx_type = 'swap' and token is not null").groupBy(OWNER, "token", day().alias("day")).agg(F.bool_or(F.expr("side = 'BUY'")).alias("b"), F.bool_or(F.expr("side = 'SELL'")).alias("s"))
    both = both.where("b and s").groupBy(OWNER).agg(F.count("*").alias("same_day"))
    held = ranks.values_at(s.select(OWNER, "held"), [OWNER], "held", {"median_held_h": (0.5, ranks.UPPER_MIDDLE)})
    g = g.join(held, OWNER, "left").join(per_day, OWNER).join(both, OWNER, "left").withColumn("same_day", F.coalesce("same_day", F.lit(0)).cast("long"))
    whole = (F.col("span_days") * 24).cast("double")
    g = g.withColumns({"mean_held_h": F.coalesce("mean_held_h", whole), "median_held_h": F.coalesce("median_held_h", whole)})
    per = F.col("n") / F.col("span_days")
    return g.withColumns({"per_day": per, "per_week": per * 7, "per_active_day": F.col("n") / F.col("active_days"), "activity": F.col("active_days") / F.col("span_days")})


#: For each profile, groups of conditions on the measures with points; of a group the
#: first that holds counts.
PROFILES: dict[str, list[list[tuple[str, int]]]] = {
    "retail_hodler": [
        [("per_day < 0.5", 25), ("per_day < 1", 10)], [("span_days > 180 and swaps < 50", 20)], [("median_held_h > 720", 20), ("median_held_h > 168", 10)],
        [("not leverage", 10)], [("large > 0 and large <= 10", 10)], [("activity < 0.1", 15)],
    ],
    "scalper": [[("rapid > 50", 30), ("rapid > 10", 15)], [("max_per_day > 50", 25), ("max_per_day > 20", 10)], [("per_day > 10", 20)], [("mean_amount > 0 and max_amount / greatest(mean_amount, 0.01) < 5", 10)]],
    "day_trader": [[("per_day >= 3", 20)], [("same_day > 5", 25), ("same_day > 0", 10)], [("median_held_h < 24", 20)], [("leverage", 15)], [("activity > 0.3", 10)]],
    "swing_trader": [
        [("median_held_h >= 48 and median_held_h <= 336", 30), ("median_held_h >= 24 and median_held_h < 48", 10)], [("per_week >= 2 and per_week <= 20", 20)],
        [("swaps > 10 and not leverage", 10), ("swaps > 10 and leverage", 15)],
    ],
    "staker_validator": [[("rewards > 5", 35), ("rewards > 0", 15)], [("rewards > 0 and swaps / greatest(n, 1) < 0.2", 25)], [("per_day < 1 and rewards > 0", 15)]],
    "whale": [
        [("max_fiat > 50000", 30), ("max_fiat > 10000", 15), ("max_fiat = 0 and max_amount > 100000", 30), ("max_fiat = 0 and max_amount > 10000", 15)],
        [("max_fiat > 0 and large_fiat > 5", 20), ("max_fiat = 0 and large > 5", 20)],
        [("max_fiat > 0 and fiat_volume > 500000", 25), ("max_fiat > 0 and fiat_volume > 100000", 10), ("max_fiat = 0 and volume > 1000000", 25), ("max_fiat = 0 and volume > 100000", 10)],
        [("per_day < 2 and max_fiat > 0 and large_fiat > 3", 10), ("per_day < 2 and max_fiat = 0 and large > 3", 10)],
    ],
    "institutional": [
        [("(fiat_volume > 500000 or (fiat_volume = 0 and volume > 500000)) and activity > 0.5", 30)], [("leverage and swaps > 100", 20)], [("per_day > 5 and activity > 0.6", 20)], [("same_day > 20", 15)],
    ],
    "alpha_hunter": [[("tokens > 30", 30), ("tokens > 15", 15)], [("airdrops > 3", 25), ("airdrops > 0", 10)], [("mean_amount > 0 and mean_amount < 100 and tokens > 10", 20)]],
    "meme_trader": [[("activity < 0.2 and per_active_day > 5", 25)], [("median_held_h < 12 and swaps > 5", 20)], [("tokens > 10 and swaps < tokens * 3", 15)]],
    "bagholder": [
        [("span_days > 90 and swaps = 0", 35), ("span_days > 180 and swaps < 5", 20)], [("deposits > 0 and withdrawals = 0", 25)], [("per_day < 0.1 and span_days > 60", 20)], [("activity < 0.05 and span_days > 90", 15)],
    ],
}


def profile_sql(groups: list[list[tuple[str, int]]]) -> str:
    return " + ".join("case " + " ".join(f"when {c} then {p}" for c, p in g) + " else 0 end" for g in groups)


def profiles(measures: DataFrame) -> DataFrame:
    """The points of each owner's profiles that have any, at most 100, best first (ties by name)."""
    scored = measures.select(OWNER, *(F.least(F.lit(100), F.expr(profile_sql(g))).cast("int").alias(k) for k, g in PROFILES.items()))
    long = scored.unpivot([OWNER], list(PROFILES), "profile", "score").where("score > 0")
    return long.withColumn("rank", F.row_number().over(Window.partitionBy(OWNER).orderBy(F.desc("score"), "profile")))


def velocity(tx: DataFrame, hot_h: float = 1.0) -> DataFrame:
    """Hours from each deposit to the owner's next withdrawal of the token, by a running minimum
    from the end; hot where the mean is under an hour."""
    later = Window.partitionBy(OWNER, "token").orderBy(F.desc("ts_s")).rangeBetween(Window.unboundedPreceding, -1)
    wait = F.min(F.when(F.col("tx_type") == "withdrawal", F.col("ts_s"))).over(later) - F.col("ts_s")
    d = tx.where("tx_type in ('deposit', 'withdrawal')").withColumn("wait", F.when(F.col("tx_type") == "deposit", wait))
    g = d.groupBy(OWNER, "token").agg(_n("tx_type = 'deposit'").alias("deposits"), _n("tx_type = 'withdrawal'").alias("withdrawals"), (F.sum("wait") / F.count("wait") / 3600).alias("mean_h"), (F.min("wait") / 3600).alias("fastest_h"))
    return g.where("mean_h is not null").withColumn("hot", F.col("mean_h") < hot_h)


def traded(tx: DataFrame) -> DataFrame:
    """What was bought and sold of each token by swaps, and fiat in and out."""
    g = tx.groupBy(OWNER, "token").agg(sum_if("tx_type = 'swap' and side = 'BUY'").alias("bought"), sum_if("tx_type = 'swap' and side = 'SELL'").alias("sold"), sum_if("tx_type = 'fiat_deposit'").alias("fiat_in"), sum_if("tx_type = 'fiat_withdrawal'").alias("fiat_out"), sum_if("sheet = 'Card Transaction'").alias("card_spending"))
    return g.where("bought > 0 or sold > 0 or fiat_in > 0 or fiat_out > 0 or card_spending > 0")


def pairs(tx: DataFrame) -> DataFrame:
    """Buys and sells of each market, with what they cost."""
    s = tx.where("tx_type = 'swap' and market <> ''")
    value = lambda c: F.coalesce(F.sum(F.when(c, F.col("total_value"))), F.lit(0)).cast("double")
    buy = F.col("side").eqNullSafe("BUY")
    return s.groupBy(OWNER, "market").agg(F.count_if(buy).alias("buys"), F.count_if(~buy).alias("sells"), value(buy).alias("buy_volume"), value(~buy).alias("sell_volume"))


def counterparties(tx: DataFrame) -> DataFrame:
    """Who an owner dealt with: sums, tokens, sheets and span."""
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return tx.where("counterparty <> ''").groupBy(OWNER, "counterparty").agg(
        F.count("*").alias("n"), sum_if("tx_type = 'deposit'").alias("total_in"), sum_if("tx_type = 'withdrawal'").alias("total_out"), listed("token").alias("tokens"),
        listed("sheet").alias("sheets"), F.min("ts_s").alias("first_s"), F.max("ts_s").alias("last_s"),
    )


def inside_and_outside(tx: DataFrame) -> DataFrame:
    """Transfers inside the exchange, deposits and withdrawals beyond it."""
    return tx.groupBy(OWNER).agg(_n("internal").alias("internal"), _n("tx_type = 'deposit' and not coalesce(internal, false)").alias("external_deposits"), _n("tx_type = 'withdrawal' and not coalesce(internal, false)").alias("external_withdrawals"))


def pay_counterparties(tx: DataFrame, sheet: str = "Pay") -> DataFrame:
    """What payments brought and took, by counterparty."""
    p = tx.where((F.col("sheet") == sheet) & (F.col("counterparty") != ""))
    return p.groupBy(OWNER, "counterparty").agg(F.count("*").alias("n"), sum_if("direction = 'IN'").alias("total_in"), sum_if("direction is null or direction <> 'IN'").alias("total_out"), F.array_join(F.array_sort(F.collect_set("token")), ",").alias("tokens"), F.min("ts_s").alias("first_s"), F.max("ts_s").alias("last_s"))


def privacy_by_action(tx: DataFrame) -> DataFrame:
    """Privacy tokens by what was done with them, and from how many addresses they came."""
    p = tx.where(F.col("token").isin(PRIVACY))
    return p.groupBy(OWNER, "token").agg(
        _n("tx_type = 'deposit'").alias("deposits"), sum_if("tx_type = 'deposit'").alias("deposited"), _n("tx_type = 'withdrawal'").alias("withdrawals"), sum_if("tx_type = 'withdrawal'").alias("withdrawn"),
        _n("tx_type = 'swap'").alias("trades"), sum_if("tx_type = 'swap'").alias("traded"), F.countDistinct(F.when(F.expr("tx_type = 'deposit' and from_address <> ''"), F.col("from_address"))).alias("sources"),
    )


def small_deposits(tx: DataFrame, least: int = 5, below: float = 1.0) -> DataFrame:
    """Addresses that sent many small amounts from outside, as a mine pays out."""
    d = tx.where("tx_type = 'deposit' and from_address <> '' and not coalesce(internal, false)")
    g = d.groupBy(OWNER, "from_address").agg(F.count("*").alias("n"), total().alias("total"), F.max_by("token", F.struct("ts_s", "row_id")).alias("token"))
    return g.where((F.col("n") >= least) & (F.col("total") / F.col("n") < below))


def margin_orders(tx: DataFrame, top: int = 15) -> DataFrame:
    """Margin orders by state, buys and sells of the filled, and each owner's top markets."""
    m = tx.where("sheet = 'Margin Order'")
    g = m.groupBy(OWNER).agg(F.count("*").alias("orders"), _n("status = 'FILLED'").alias("filled"), _n("status = 'CANCELED'").alias("cancelled"), _n("status = 'FILLED' and side = 'BUY'").alias("buys"), _n("status = 'FILLED' and side = 'SELL'").alias("sells"))
    k = m.where("status = 'FILLED' and market <> ''").groupBy(OWNER, "market").agg(F.count("*").alias("k"))
    k = k.withColumn("r", F.row_number().over(Window.partitionBy(OWNER).orderBy(F.desc("k"), "market"))).where(F.col("r") <= top)
    k = k.groupBy(OWNER).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "market"))), lambda x: x["market"]), ",").alias("markets"))
    return g.join(k, OWNER, "left").withColumn("markets", F.coalesce("markets", F.lit("")))


def temporal(tx: DataFrame, burst: int = 50) -> DataFrame:
    """Weekend and night shares, peak hour (ties to the earlier), days over ``burst`` records,
    active days over the span."""
    at = F.timestamp_seconds("ts_s")
    hours = tx.groupBy(OWNER, F.hour(at).alias("hour")).agg(F.count("*").alias("k")).groupBy(OWNER).agg(F.min_by("hour", F.struct(-F.col("k"), "hour")).alias("peak_hour"), F.max("k").alias("peak_count"), F.sum(F.when(F.col("hour") < 6, F.col("k")).otherwise(0)).alias("night"))
    days = tx.groupBy(OWNER, day().alias("day")).agg(F.count("*").alias("k"), F.max(F.weekday(at)).alias("wd")).groupBy(OWNER).agg(
        F.sum("k").alias("n"), F.count("*").alias("active_days"), F.count_if(F.col("k") > burst).alias("burst_days"), F.max("k").alias("busiest"),
        F.sum(F.when(F.col("wd") >= 5, F.col("k")).otherwise(0)).alias("weekend"), (F.datediff(F.max("day"), F.min("day"))).alias("days"),
    )
    span = tx.groupBy(OWNER).agg((F.floor((F.max("ts_s") - F.min("ts_s")) / 86400) + 1).alias("span_days"))
    share = lambda a, b: F.round(F.col(a) / F.col(b), 6)
    return days.join(hours, OWNER).join(span, OWNER).select(OWNER, "n", "weekend", share("weekend", "n").alias("weekend_share"), "night", share("night", "n").alias("night_share"), "peak_hour", "peak_count", "burst_days", "busiest", "active_days", "span_days", share("active_days", "span_days").alias("density"))


def conversions(tx: DataFrame) -> DataFrame:
    """Swaps as edges: a buy goes from the quote token to the base, all else the other way."""
    buy = F.col("side").eqNullSafe("BUY")
    e = tx.where("tx_type = 'swap' and token <> '' and quote_token <> ''").select(F.when(buy, F.col("quote_token")).otherwise(F.col("token")).alias("src"), F.when(buy, F.col("token")).otherwise(F.col("quote_token")).alias("dst"), "amount", OWNER)
    return e.groupBy(OWNER, "src", "dst").agg(F.count("*").alias("n"), total().alias("volume"))


#: Amounts that reports begin at.
THRESHOLDS = [1000, 5000, 9000, 10_000, 15_000]


def structuring(tx: DataFrame, least: int = 2) -> DataFrame:
    """Days with several deposits, or withdrawals, of less than a tenth under a threshold."""
    kind = F.when(F.col("tx_type").isin("deposit", "fiat_deposit"), "deposit").when(F.col("tx_type").isin("withdrawal", "fiat_withdrawal"), "withdrawal")
    each = F.explode(F.array(*(F.lit(x) for x in THRESHOLDS))).alias("threshold")
    near = tx.select(OWNER, day().alias("day"), kind.alias("kind"), "amount", each).where("kind is not null and amount >= threshold * 0.9 and amount < threshold")
    return near.groupBy(OWNER, "day", "kind", "threshold").agg(F.count("*").alias("n"), total().alias("total")).where(F.col("n") >= least)


def frequent_amounts(tx: DataFrame, least: int = 5, top: int = 20, unit: int = 100) -> DataFrame:
    """Amounts in whole hundreds (half to even) that recur, the most frequent of each owner."""
    g = tx.where("amount > 0").groupBy(OWNER, (F.bround(F.col("amount").cast("double") / unit, 0) * unit).cast("long").alias("rounded")).agg(F.count("*").alias("n"))
    g = g.where((F.col("rounded") > 0) & (F.col("n") >= least))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy(OWNER).orderBy(F.desc("n"), "rounded"))).where(F.col("rank") <= top)


def peer_to_peer(tx: DataFrame, sheet: str = "P2P") -> DataFrame:
    """Peer-to-peer trades: their share of all, volume, fiat volume, partners and ways to pay."""
    p = F.coalesce(F.col("sheet") == sheet, F.lit(False))
    g = tx.groupBy(OWNER).agg(
        F.count("*").alias("n"), F.count_if(p).alias("trades"), F.coalesce(F.sum(F.when(p, F.col("amount"))), F.lit(0)).cast("double").alias("volume"), F.coalesce(F.sum(F.when(p & F.col("token").isin(FIAT), F.col("amount"))), F.lit(0)).cast("double").alias("fiat_volume"),
        F.countDistinct(F.when(p & (F.col("counterparty") != ""), F.col("counterparty"))).alias("partners"), F.array_join(F.array_sort(F.collect_set(F.when(p & (F.col("payment_method") != ""), F.col("payment_method")))), ",").alias("methods"),
    )
    return g.where("trades > 0").withColumn("share", F.round(F.col("trades") / F.col("n"), 6))


def fees(tx: DataFrame) -> DataFrame:
    """Fees paid, by the coin they were paid in."""
    return tx.where("fee > 0").groupBy(OWNER, F.when(F.col("fee_coin") != "", F.col("fee_coin")).otherwise("UNKNOWN").alias("fee_coin")).agg(F.sum("fee").cast("double").alias("fees"), F.count("*").alias("n"))


def networks(tx: DataFrame) -> DataFrame:
    """Deposits and withdrawals by network, and which are of high risk."""
    g = tx.where("network <> ''").groupBy(OWNER, "network").agg(_n("tx_type = 'deposit'").alias("deposits"), _n("tx_type = 'withdrawal'").alias("withdrawals"), sum_if("tx_type = 'deposit'").alias("deposited"), sum_if("tx_type = 'withdrawal'").alias("withdrawn"))
    return g.where("deposits + withdrawals > 0").withColumn("high_risk", F.upper("network").isin(HIGH_RISK_NETWORKS))


def external_addresses(tx: DataFrame) -> DataFrame:
    """Addresses beyond the exchange that money came from or went to, in lower case."""
    e = tx.where("tx_type in ('deposit', 'withdrawal') and from_address <> '' and not coalesce(internal, false)")
    return e.groupBy(F.lower("from_address").alias("address"), "tx_type").agg(F.count("*").alias("n"), total().alias("total"), F.countDistinct(OWNER).alias("owners"), F.min("ts_s").alias("first_s"), F.max("ts_s").alias("last_s"))


def totals(tx: DataFrame) -> DataFrame:
    """Records, fiat, token flows and counterparties of each owner."""
    fiat = F.col("token").isin(FIAT)
    into = F.col("tx_type").isin("deposit", "fiat_deposit", "buy")
    out = F.col("tx_type").isin("withdrawal", "fiat_withdrawal", "sell")
    s = lambda c: F.coalesce(F.sum(F.when(c, F.col("amount"))), F.lit(0)).cast("double")
    return tx.groupBy(OWNER).agg(F.count("*").alias("n"), s(fiat & into).alias("fiat_in"), s(fiat & out).alias("fiat_out"), s(~fiat & into).alias("tokens_in"), s(~fiat & out).alias("tokens_out"), F.countDistinct(F.when(F.col("counterparty") != "", F.col("counterparty"))).alias("counterparties"))


def portfolio(tx: DataFrame, known: list[str], top: int = 15) -> DataFrame:
    """Each token's flow and fiat value, whether it is a known one, the owner's top tokens."""
    into = F.col("tx_type").isin("deposit", "fiat_deposit", "buy") | ((F.col("tx_type") == "swap") & F.col("side").eqNullSafe("BUY"))
    out = F.col("tx_type").isin("withdrawal", "fiat_withdrawal", "sell") | ((F.col("tx_type") == "swap") & F.col("side").eqNullSafe("SELL"))
    s = lambda c: F.coalesce(F.sum(F.when(c, F.col("amount"))), F.lit(0)).cast("double")
    g = tx.where("token <> ''").groupBy(OWNER, "token").agg(F.count("*").alias("n"), s(into).alias("inflow"), s(out).alias("outflow"), F.coalesce(F.sum(F.abs("fiat_value")), F.lit(0)).cast("double").alias("fiat_value"))
    g = g.withColumn("known", F.col("token").isin(known)).withColumn("rank", F.row_number().over(Window.partitionBy(OWNER).orderBy(F.desc("n"), "token")))
    return g.where(F.col("rank") <= top)


def operations(tx: DataFrame, top: int = 15) -> DataFrame:
    """Each owner's most frequent kinds of records."""
    g = tx.groupBy(OWNER, "tx_type").agg(F.count("*").alias("n"), total().alias("volume"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy(OWNER).orderBy(F.desc("n"), "tx_type"))).where(F.col("rank") <= top)


def access_log(log: DataFrame, ips: int = 3) -> DataFrame:
    """Logins of each owner: addresses, places, clients, the main country (of the most frequent
    place that names one), logins from elsewhere, and days with more than ``ips`` addresses.

    log: owner, ts_s, ip, place ("Country City"), client.
    """
    place = log.where("place is not null").groupBy(OWNER, "place").agg(F.count("*").alias("k"))
    named = F.when(F.col("place").contains(" "), F.col("place"))
    main = place.where(named.isNotNull()).groupBy(OWNER).agg(F.min_by("place", F.struct(-F.col("k"), "place")).alias("top"))
    main = main.select(OWNER, F.split_part("top", F.lit(" "), F.lit(1)).alias("country"))
    days = log.groupBy(OWNER, day().alias("day")).agg(F.countDistinct("ip").alias("ips")).groupBy(OWNER).agg(F.count_if(F.col("ips") > ips).alias("multi_ip_days"))
    elsewhere = F.col("country").isNotNull() & ~F.coalesce(F.startswith("place", "country"), F.lit(False))
    g = log.join(main, OWNER, "left").groupBy(OWNER).agg(F.count("*").alias("logins"), F.countDistinct("ip").alias("ips"), F.countDistinct("place").alias("places"), F.countDistinct("client").alias("clients"), F.min("ts_s").alias("first_s"), F.max("ts_s").alias("last_s"), F.max("country").alias("country"), F.count_if(elsewhere).alias("foreign_logins"))
    return g.join(days, OWNER)


def login_hours(log: DataFrame) -> DataFrame:
    """Logins by hour of day, and what share of the owner's they are."""
    g = log.where("ts_s is not null").groupBy(OWNER, F.hour(F.timestamp_seconds("ts_s")).cast("long").alias("hour")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(OWNER)), 4))


def many_countries(log: DataFrame, least: int = 3) -> DataFrame:
    """Days on which an owner logged in from several countries."""
    g = log.where("place is not null").groupBy(OWNER, day().alias("day"))
    country = F.split_part("place", F.lit(" "), F.lit(1))
    return g.agg(F.countDistinct(country).alias("countries"), F.count("*").alias("logins"), F.array_join(F.array_sort(F.collect_set(country)), ",").alias("names")).where(F.col("countries") >= least)


def phones_in(rows: DataFrame, key: str, text: str, prefixes: DataFrame) -> DataFrame:
    """Telephone numbers with a country code in free text, with the country of their longest
    known prefix (1 to 4 digits), by an equi-join."""
    found = F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\+\d{1,3}[ -]?(?:\(\d{1,4}\)|\d{2,4})(?:[ -]?\d{2,4}){1,3}"), 0)))
    n = rows.select(key, found.alias("found")).withColumn("number", F.concat(F.lit("+"), F.regexp_replace("found", r"\D", ""))).drop("found").distinct()
    c = n.select("number").distinct().withColumn("size", F.explode(F.sequence(F.lit(1), F.lit(4)))).withColumn("prefix", F.substr(F.col("number"), F.lit(2), F.col("size")))
    best = c.join(prefixes, "prefix").groupBy("number").agg(F.max_by("country", "size").alias("country"))
    return n.join(best, "number", "left").select(key, "number", F.coalesce("country", F.lit("unknown")).alias("country"))


def chain_balance(tx: DataFrame) -> DataFrame:
    """The balance of each address and token after the last transfer of each day it moved on.

    tx: transfer_id, ts_s, from_address, to_address, amount, token.
    """
    ends = F.explode(F.array(F.struct(F.col("from_address").alias("address"), (-F.col("amount")).alias("delta")), F.struct(F.col("to_address").alias("address"), F.col("amount").alias("delta"))))
    d = tx.select("token", day().alias("day"), ends.alias("e")).groupBy("e.address", "token", "day").agg(F.sum("e.delta").alias("delta"))
    w = Window.partitionBy("address", "token").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return d.select("address", "token", "day", F.sum("delta").over(w).cast("double").alias("balance"))


def month_flows(tx: DataFrame) -> DataFrame:
    """Each owner's months: fiat in and out, the fiat value of buys, sales and withdrawals, what was
    received and sent, and records."""
    fiat = F.col("token").isin(FIAT)
    s = lambda c, v="amount": F.coalesce(F.sum(F.when(c, F.abs(v))), F.lit(0)).cast("double")
    t = F.col("tx_type")
    return tx.groupBy(OWNER, F.date_format(day(), "yyyy-MM").alias("month")).agg(
        s(fiat & t.isin("deposit", "fiat_deposit")).alias("fiat_in"), s(fiat & ~t.isin("deposit", "fiat_deposit")).alias("fiat_out"),
        s(t == "buy", "fiat_value").alias("bought"), s(t == "sell", "fiat_value").alias("sold"), s(t == "withdrawal", "fiat_value").alias("moved_out"),
        s(t == "deposit").alias("received"), s(t == "withdrawal").alias("sent"), F.count("*").alias("n"),
    )


def daily_types(tx: DataFrame) -> DataFrame:
    """Records of each day and type, and (type null) in all."""
    return tx.withColumn("day", day()).groupingSets([[F.col(OWNER), F.col("day"), F.col("tx_type")], [F.col(OWNER), F.col("day")]], OWNER, "day", "tx_type").agg(F.count("*").alias("n"))


def exchange_flow(tx: DataFrame, currency: Column | None = None) -> DataFrame:
    """Each owner's flows by fiat value: currencies to tokens (buys), tokens to currencies (sales), tokens
    to the outside (withdrawals), staking to tokens (rewards). Other types are no flows. currency: that of
    a record's value, PLN unless given or where null. A record without a value counts with 0."""
    kind, token = F.lower("tx_type"), F.concat(F.lit("TOKEN:"), F.coalesce(F.nullif("token", F.lit("")), F.lit("UNKNOWN")))
    fiat = F.concat(F.lit("FIAT:"), F.coalesce(currency if currency is not None else F.lit("PLN"), F.lit("PLN")))
    ends = F.when(kind == "buy", F.struct(fiat.alias("src"), token.alias("dst"))).when(kind == "sell", F.struct(token.alias("src"), fiat.alias("dst")))
    ends = ends.when(kind == "withdrawal", F.struct(token.alias("src"), F.lit("EXTERNAL").alias("dst"))).when(kind.isin(REWARD_TYPES), F.struct(F.lit("STAKING").alias("src"), token.alias("dst")))
    e = tx.select(OWNER, ends.alias("e"), F.coalesce(F.abs("fiat_value"), F.lit(0)).alias("v")).where("e is not null")
    return e.groupBy(OWNER, "e.src", "e.dst").agg(F.count("*").alias("n"), F.sum("v").cast("double").alias("total"))


def exchange_flow_nodes(edges: DataFrame) -> DataFrame:
    """The nodes of ``exchange_flow``: what they are, what came in and went out, records."""
    end = lambda c, way: edges.select(OWNER, F.col(c).alias("node"), "n", *(F.when(F.lit(w == way), F.col("total")).otherwise(0.0).alias(f"total_{w}") for w in ("in", "out")))
    g = end("src", "out").unionByName(end("dst", "in")).groupBy(OWNER, "node")
    return g.agg(F.sum("n").alias("n"), F.sum("total_in").alias("total_in"), F.sum("total_out").alias("total_out")).withColumn("kind", F.lower(F.substring_index("node", ":", 1)))


#: Fixed value: the surveyed code compares a trade with so many trades of its owner after it.
AHEAD = 19


def wash_trades(tx: DataFrame, seconds: int = 300, ahead: int | None = AHEAD, block: int = 4096) -> DataFrame:
    """Of an owner's trades in order, each with the later ones that lie within the window, on the same
    market and the other side (a missing side is a side of its own): with all of them if ``ahead`` is
    None, else with those alone that are among the owner's next ``ahead`` trades, as surveyed.

    All of them: see ``_opposite_trades``. Else trades are numbered by ranges, and dealt to blocks of numbers;
    a block also gets the first few of the next, so a window of ``ahead`` rows finds all pairs, and an
    owner or a market with most of the trades is many tasks' work.
    """
    if ahead is None:
        return _opposite_trades(_trades(tx), seconds, block)
    block = max(block, ahead)  # what follows a row is in its block or at the next one's beginning
    r = numbered(_trades(tx), [OWNER], ["ts_s", "row_id"], "at").withColumn("own", F.floor((F.col("at") - 1) / block))
    first = ((F.col("at") - 1) % block) < ahead
    r = r.withColumn("block", F.explode(F.when(first & (F.col("own") > 0), F.array("own", F.col("own") - 1)).otherwise(F.array("own"))))
    w = Window.partitionBy(OWNER, "block").orderBy("at").rowsBetween(1, ahead)
    r = r.withColumn("next", F.collect_list(F.struct("row_id", "ts_s", "market", "side")).over(w)).where("own = block")
    hit = F.filter("next", lambda n: (n["market"] == F.col("market")) & (n["side"] != F.col("side")) & (n["ts_s"] - F.col("ts_s") <= seconds))
    r = r.withColumn("n", F.explode(hit))
    return r.select(OWNER, "market", F.col("row_id").alias("first_id"), F.col("n.row_id").alias("second_id"), (F.col("n.ts_s") - F.col("ts_s")).alias("seconds"))


def _trades(tx: DataFrame) -> DataFrame:
    return tx.where("tx_type = 'swap' and market <> '' and ts_s is not null").select(OWNER, "row_id", "ts_s", "market", F.coalesce("side", F.lit("")).alias("side"))


def _opposite_trades(t: DataFrame, seconds: int, block: int) -> DataFrame:
    """Each trade with all later ones of its owner and market within the window that are of another side.

    A bucket is as wide as the window, so a later trade is in the same bucket or the next one, and is dealt
    to both. Trades are counted by bucket and side first: where there are more than ``block``, the earlier ones
    are cut into rows and the later ones into columns of about so many, and each row meets each column under
    a key of its own. A bucket of one side pairs nothing, and a full one is many tasks' work.
    """
    key, bucket = [OWNER, "market", "bucket"], F.floor(F.col("ts_s") / max(seconds, 1))
    t = t.withColumn("bucket", bucket)
    later = t.withColumn("bucket", F.explode(F.array("bucket", F.col("bucket") - 1)))
    cells = later.groupBy(*key, "side").agg(F.count("*").alias("n"), F.count_if(bucket == F.col("bucket")).alias("own"))
    cells = cells.groupBy(*key).agg(F.sum("own").alias("all"), F.collect_list(F.struct("side", "n", "own")).alias("cells"))
    parts = lambda n: F.ceil(n / block).cast("int")
    deal = F.transform("cells", lambda c: F.struct(c["side"].alias("side"), parts(F.col("all") - c["own"]).alias("rows"), parts(c["n"]).alias("columns")))
    cells = cells.select(*key, F.filter(deal, lambda c: c["rows"] > 0).alias("cells")).where("size(cells) > 0")
    place = F.struct("ts_s", "row_id", "side")
    salt, part = F.xxhash64("ts_s", "row_id"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = t.join(cells, key).withColumn("cell", F.explode(F.filter("cells", lambda c: c["side"] != F.col("side"))))
    a = a.select(*key, place.alias("a"), F.pmod(salt, "cell.rows").alias("row"), part("cell.columns").alias("column"), F.col("cell.side").alias("other"))
    b = later.join(cells, key).withColumn("cell", F.explode(F.filter("cells", lambda c: c["side"] == F.col("side"))))
    b = b.select(*key, place.alias("b"), part("cell.rows").alias("row"), F.pmod(salt, "cell.columns").alias("column"), F.col("side").alias("other"))
    gap = F.col("b.ts_s") - F.col("a.ts_s")
    pairs = a.join(b, [*key, "other", "row", "column"]).where((F.col("b") > F.col("a")) & (gap <= seconds))
    return pairs.select(OWNER, "market", F.col("a.row_id").alias("first_id"), F.col("b.row_id").alias("second_id"), gap.alias("seconds"))


def wash_markets(tx: DataFrame, below: float = 0.1) -> DataFrame:
    """An owner's markets whose net is small against the gross."""
    s = tx.where("tx_type = 'swap'").groupBy(OWNER, F.coalesce("market", F.lit("")).alias("market")).agg(sum_if("side = 'BUY'").alias("bought"), sum_if("side = 'SELL'").alias("sold"))
    ratio = F.abs(F.col("bought") - F.col("sold")) / (F.col("bought") + F.col("sold"))
    return s.where("bought > 0 and sold > 0").where(ratio < below).withColumn("ratio", F.round(ratio, 6))


def fiat_currencies(tx: DataFrame) -> DataFrame:
    """Fiat in and out of each owner and currency."""
    f = tx.where("tx_type in ('fiat_deposit', 'fiat_withdrawal')")
    return f.groupBy(OWNER, "token").agg(sum_if("tx_type = 'fiat_deposit'").alias("fiat_in"), sum_if("tx_type = 'fiat_withdrawal'").alias("fiat_out"))


def fiat_ramp(tx: DataFrame) -> DataFrame:
    """Fiat in, out and net of all currencies, their records, the hours from the first fiat deposit
    to the first withdrawal that is not internal (below 0 if that came first; null without both), and
    records of person-to-person trades."""
    when = lambda c, v: F.when(F.expr(c), F.col(v))
    outside = "tx_type = 'withdrawal' and not coalesce(internal, false)"
    g = tx.groupBy(OWNER).agg(
        F.round(sum_if("tx_type = 'fiat_deposit'"), 2).alias("fiat_in"), F.round(sum_if("tx_type = 'fiat_withdrawal'"), 2).alias("fiat_out"), _n("tx_type = 'fiat_deposit'").alias("deposits"),
        _n("tx_type = 'fiat_withdrawal'").alias("withdrawals"), F.min(when("tx_type = 'fiat_deposit'", "ts_s")).alias("first_deposit_s"), F.min(when(outside, "ts_s")).alias("first_withdrawal_s"), _n("sheet = 'P2P'").alias("p2p"),
    )
    hours = F.when(F.col("first_deposit_s").isNotNull(), (F.col("first_withdrawal_s") - F.col("first_deposit_s")) / 3600)
    return g.withColumns({"net": F.round(F.col("fiat_in") - F.col("fiat_out"), 2), "hours": hours})
