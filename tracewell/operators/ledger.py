"""Operators over ledger transfers, for all addresses and owners at once.

Columns: transfer_id, ts_s (epoch seconds), from_address, to_address, amount, token, tx_type. The
owner of an exchange row is its from_address. Range joins go by time buckets: each side is dealt
to whole buckets of the window's width, so that a pair meets in one of two neighbouring ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Token groups.
FIAT = ["PLN", "USD", "EUR", "GBP", "CHF"]
PRIVACY = ["XMR", "ZEC", "DASH", "SCRT", "BEAM", "GRIN", "FIRO", "ARRR", "OXEN"]
MEME = ["PEPE", "DOGE", "SHIB", "BONK", "FLOKI", "BABYDOGE", "ELON", "WOJAK", "TURBO", "MEME", "WIF", "BOME", "SLERF", "BRETT"]
KNOWN = ["BTC", "ETH", "USDT", "USDC", "XMR", *FIAT]
OWNER = "from_address"


def amount() -> Column:
    return F.col("amount").cast("double")


def total(c: str = "amount") -> Column:
    return F.sum(c).cast("double")


def sum_if(condition: str) -> Column:
    return F.coalesce(F.sum(F.when(F.expr(condition), F.col("amount"))), F.lit(0)).cast("double")


def day() -> Column:
    return F.to_date(F.timestamp_seconds("ts_s"))


#: Points for each end that is listed, and is a mixer; and for a contract's category.
LISTED, MIXER = 100, 80
CONTRACT_POINTS = {"mixer": 80, "bridge": 20, "defi": 5}


def plain_address(c: Column | str) -> Column:
    return F.lower(F.trim(c))


def watch_matches(tx: DataFrame, watch: DataFrame, contracts: DataFrame, contract: str | None = None) -> DataFrame:
    """(transfer_id, tags, risk_score, counterparty) of transfers that meet a list.

    watch: address, kind (why it is listed; several rows an address may be). Every listed address is
    sanctioned, and a mixer too if one of its kinds says so; each end of a transfer counts for itself.
    contracts: address, name, category; met by the receiver and by the transfer's own contract
    (column ``contract``), whose name goes before. Addresses are compared without case and outer blanks.
    Points end at 100; a contract of another category gives its name alone.
    """
    w = watch.where("address is not null").groupBy(plain_address("address").alias("address"))
    w = w.agg(F.coalesce(F.bool_or(F.lower("kind").contains("mixer")), F.lit(False)).alias("mixer"))
    k = contracts.where("address is not null").groupBy(plain_address("address").alias("address")).agg(F.min(F.struct("name", "category")).alias("c"))
    k = k.select("address", F.col("c.name").alias("name"), F.col("c.category").alias("category"))
    out = tx.select("transfer_id", plain_address("from_address").alias("a1"), plain_address("to_address").alias("a2"), plain_address(contract if contract else F.lit(None).cast("string")).alias("a3"))
    for a in ("1", "2"):
        out = out.join(w.toDF(f"a{a}", f"mixer{a}"), f"a{a}", "left")
    for a in ("2", "3") if contract else ("2",):
        out = out.join(k.toDF(f"a{a}", f"name{a}", f"category{a}"), f"a{a}", "left")
    if not contract:
        out = out.withColumns({c: F.lit(None).cast("string") for c in ("name3", "category3")})
    yes = lambda c, n: F.when(c, n).otherwise(0)
    known = list(CONTRACT_POINTS)
    score, tags = F.lit(0), []
    for a in ("1", "2"):
        score += yes(F.col(f"mixer{a}").isNotNull(), LISTED) + yes(F.col(f"mixer{a}"), MIXER)
        tags += [F.when(F.col(f"mixer{a}").isNotNull(), "sanctioned"), F.when(F.col(f"mixer{a}"), "mixer")]
    for a in ("2", "3"):
        c = F.col(f"category{a}")
        score += F.coalesce(F.create_map(*(F.lit(x) for kv in CONTRACT_POINTS.items() for x in kv))[c], F.lit(0))
        tags.append(F.when(c.isin(known), c))
    tags = F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*tags)))), ",")
    out = out.select("transfer_id", tags.alias("tags"), F.least(F.lit(100), score).cast("int").alias("risk_score"), F.coalesce("name3", "name2").alias("counterparty"))
    return out.where("tags <> '' or counterparty is not null")


def exchange_rules(tx: DataFrame) -> DataFrame:
    """Points for privacy, meme and unknown tokens, large fiat and withdrawals; at most 100."""
    yes = lambda c, n: F.when(c, n).otherwise(0)
    t = F.col("token")
    s = yes(t.isin(PRIVACY), 30) + yes(t.isin(MEME), 5) + yes(t.isin(FIAT) & (F.col("amount") > 15_000), 20) + yes(~t.isin(KNOWN), 10) + yes(F.col("tx_type") == "withdrawal", 10) - yes(F.col("tx_type") == "transfer", 5)
    return tx.select("transfer_id", F.when(t.isin(KNOWN), "known").otherwise("unknown").alias("token_class"), F.greatest(F.lit(0), F.least(F.lit(100), s)).cast("int").alias("risk_score"))


def peel_chains(tx: DataFrame, least: int = 5, share: float = 0.7) -> DataFrame:
    """Senders most of whose amounts fall from one transfer to the next."""
    w = Window.partitionBy("from_address").orderBy("ts_s", "transfer_id")
    s = tx.where("amount > 0").withColumn("before", F.lag("amount").over(w))
    g = s.groupBy("from_address").agg(F.count("*").alias("n"), F.count_if(F.col("amount") < F.col("before")).alias("falls"))
    return g.where((F.col("n") >= least) & (F.col("falls") / F.greatest(F.lit(1), F.col("n") - 1) > share)).select(F.col("from_address").alias("address"), "n", "falls")


def dust(tx: DataFrame, below: float = 0.0001, least: int = 10) -> DataFrame:
    """Receivers of many tiny amounts."""
    return tx.where((F.col("amount") > 0) & (F.col("amount") < below)).groupBy(F.col("to_address").alias("address")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def round_trips(tx: DataFrame, least: int = 3) -> DataFrame:
    """Addresses that send and receive several equal (token, amount)."""
    sent = tx.select(F.col("from_address").alias("address"), "token", "amount").distinct()
    got = tx.select(F.col("to_address").alias("address"), "token", "amount").distinct()
    return sent.join(got, ["address", "token", "amount"]).groupBy("address").agg(F.count("*").alias("matching")).where(F.col("matching") >= least)


def smurfing(tx: DataFrame, near: float = 0.1, least: int = 5, receivers: int = 3) -> DataFrame:
    """Senders with many amounts close to their mean, to several receivers."""
    s = tx.where("amount > 0")
    m = s.groupBy("from_address").agg((total() / F.count("*")).alias("mean"))
    g = s.join(m, "from_address").groupBy("from_address").agg(F.count("*").alias("n"), F.count_if(F.abs(amount() - F.col("mean")) / F.greatest("mean", F.lit(0.01)) < near).alias("similar"), F.countDistinct("to_address").alias("receivers"))
    return g.where((F.col("n") >= 5) & (F.col("similar") >= least) & (F.col("receivers") >= receivers)).withColumnRenamed("from_address", "address")


def followed_by(left: DataFrame, right: DataFrame, key: list[str], seconds: int, strict: bool = True) -> DataFrame:
    """Pairs with 0 < t2 - t1 <= seconds (or 0 <=) and equal keys, by time buckets."""
    a = left.withColumn("bucket", F.explode(F.array(F.floor(F.col("t1") / seconds), F.floor(F.col("t1") / seconds) + 1)))
    b = right.withColumn("bucket", F.floor(F.col("t2") / seconds))
    gap = F.col("t2") - F.col("t1")
    return a.join(b, [*key, "bucket"]).where((gap > 0 if strict else gap >= 0) & (gap <= seconds)).drop("bucket")


def rapid_conversion(tx: DataFrame, minutes: int = 30, least: int = 2) -> DataFrame:
    """A deposit, then within the window a withdrawal of another token by the same owner."""
    d = tx.where("tx_type = 'deposit'").select(OWNER, F.col("ts_s").alias("t1"), F.col("token").alias("token1"), F.col("transfer_id").alias("deposit_id"))
    w = tx.where("tx_type = 'withdrawal'").select(OWNER, F.col("ts_s").alias("t2"), F.col("token").alias("token2"), F.col("transfer_id").alias("withdrawal_id"))
    pairs = followed_by(d, w, [OWNER], minutes * 60).where("token1 <> token2")
    return pairs.groupBy(F.col(OWNER).alias("owner")).agg(F.count("*").alias("chains"), F.min(F.col("t2") - F.col("t1")).alias("fastest_s")).where(F.col("chains") >= least)


def pass_through(tx: DataFrame, hours: int = 24) -> DataFrame:
    """Every deposit with every withdrawal of the owner within the window."""
    d = tx.where("tx_type = 'deposit'").select(OWNER, F.col("ts_s").alias("t1"), F.col("transfer_id").alias("deposit_id"))
    w = tx.where("tx_type = 'withdrawal'").select(OWNER, F.col("ts_s").alias("t2"), F.col("transfer_id").alias("withdrawal_id"))
    return followed_by(d, w, [OWNER], hours * 3600, strict=False).select(F.col(OWNER).alias("owner"), "deposit_id", "withdrawal_id", (F.col("t2") - F.col("t1")).alias("seconds"))


def structured_deposits(tx: DataFrame, near: float = 0.15, least: int = 3) -> DataFrame:
    """Fiat deposits of an owner close to their mean."""
    d = tx.where((F.col("tx_type") == "deposit") & F.col("token").isin(FIAT))
    m = d.groupBy(OWNER).agg((total() / F.count("*")).alias("mean"), F.count("*").alias("n"))
    g = d.join(m, OWNER).where("n >= 3 and mean > 0").groupBy(OWNER).agg(F.count_if(F.abs(amount() - F.col("mean")) / F.greatest("mean", F.lit(0.01)) < near).alias("similar"), F.first("mean").alias("mean"))
    return g.where(F.col("similar") >= least).withColumnRenamed(OWNER, "owner")


def meme_share(tx: DataFrame, least: int = 3, n: int = 5, share: float = 0.2) -> DataFrame:
    """Owners with a large share of meme tokens."""
    g = tx.groupBy(F.col(OWNER).alias("owner")).agg(F.count("*").alias("n"), F.count_if(F.col("token").isin(MEME)).alias("meme"))
    return g.where((F.col("n") >= n) & (F.col("meme") >= least) & (F.col("meme") / F.col("n") > share))


def privacy_usage(tx: DataFrame) -> DataFrame:
    """X11: use of privacy tokens."""
    return tx.where(F.col("token").isin(PRIVACY)).groupBy(F.col(OWNER).alias("owner")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("token")), ",").alias("tokens"), total().alias("volume"))


#: Points of each pattern and flag in the overall risk, by kind of source.
PATTERNS = {"blockchain": {"peel_chain": 30, "dust_attack": 15, "round_trip": 35, "smurfing": 40}, "exchange": {"rapid_conversion": 35, "structuring_deposits": 25, "meme_coin_concentration": 5, "privacy_coin_usage": 20}}
FLAGS = {"blockchain": {"sanctioned": 50, "mixer": 40, "privacy_coin": 20}, "exchange": {"high_value_fiat": 10, "privacy_coin": 15}}


def overall_risk(tx: DataFrame, source: str = "exchange", watch: DataFrame | None = None, contracts: DataFrame | None = None, contract: str | None = None, large_fiat: float = 15_000) -> DataFrame:
    """0.3 of the mean transfer risk, the points of the owner's (sender's) patterns, and those of its
    flags; at most 100; with the reasons, sorted. A blockchain's transfers are scored by the lists
    (watch, contracts), an exchange's by its rules."""
    owner = F.col(OWNER).alias("owner")
    named = lambda df, c, k: df.select(F.col(c).alias("owner"), F.lit(k).alias("reason")).distinct()
    flag = lambda df, c, k: named(df.where(c), OWNER, k)
    private = F.col("token").isin(PRIVACY)
    if source == "blockchain":
        scored = watch_matches(tx, watch, contracts, contract)
        found = [named(peel_chains(tx), "address", "peel_chain"), named(dust(tx), "address", "dust_attack"), named(round_trips(tx), "address", "round_trip"), named(smurfing(tx), "address", "smurfing")]
        kinds = tx.join(scored.select("transfer_id", F.split("tags", ",").alias("tags")), "transfer_id", "left")
        found += [flag(kinds, F.array_contains("tags", k), k) for k in ("sanctioned", "mixer")] + [flag(tx, private, "privacy_coin")]
    else:
        scored = exchange_rules(tx)
        found = [named(rapid_conversion(tx), "owner", "rapid_conversion"), named(structured_deposits(tx), "owner", "structuring_deposits"), named(meme_share(tx), "owner", "meme_coin_concentration"), named(privacy_usage(tx), "owner", "privacy_coin_usage")]
        found += [flag(tx, F.col("token").isin(FIAT) & (F.col("amount") > large_fiat), "high_value_fiat"), flag(tx, private, "privacy_coin")]
    mean = tx.select("transfer_id", owner).join(scored.select("transfer_id", "risk_score"), "transfer_id", "left").groupBy("owner").agg((F.sum(F.coalesce("risk_score", F.lit(0))) / F.count("*")).alias("mean"))
    reasons = found[0]
    for f in found[1:]:
        reasons = reasons.unionByName(f)
    worth = F.create_map(*(F.lit(x) for k, v in (PATTERNS[source] | FLAGS[source]).items() for x in (k, v)))
    points = reasons.groupBy("owner").agg(F.sum(worth[F.col("reason")]).alias("points"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
    out = mean.join(points, "owner", "left")
    return out.select("owner", F.round(F.least(F.lit(100.0), F.col("mean") * 0.3 + F.coalesce("points", F.lit(0))), 4).alias("risk"), F.coalesce("points", F.lit(0)).cast("long").alias("points"), F.coalesce("reasons", F.lit("")).alias("reasons"))


def address_edges(tx: DataFrame, nodes: int = 200, edges: int = 500) -> DataFrame:
    """The heaviest edges between the busiest addresses, no self loops."""
    e = tx.where("from_address <> to_address").groupBy("from_address", "to_address").agg(F.count("*").alias("n"), total().alias("total"))
    ends = e.select(F.col("from_address").alias("node"), "n").unionByName(e.select(F.col("to_address").alias("node"), "n"))
    top = ends.groupBy("node").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "node").limit(nodes).select("node")
    e = e.join(top.toDF("from_address"), "from_address", "left_semi").join(top.toDF("to_address"), "to_address", "left_semi")
    return e.orderBy(F.desc("total"), "from_address", "to_address").limit(edges)


def address_nodes(tx: DataFrame, tags: DataFrame, nodes: int = 200) -> DataFrame:
    """The busiest addresses with what came in and went out, the tags of their transfers (transfer_id,
    tags joined by commas), the level these give and what the address is."""
    t = tx.where("from_address <> to_address").join(tags.select("transfer_id", "tags"), "transfer_id", "left")
    end = lambda c, way: t.select(F.col(c).alias("node"), "amount", F.lit(way).alias("way"), F.split(F.coalesce("tags", F.lit("")), ",").alias("tags"))
    e = end("from_address", "out").unionByName(end("to_address", "in"))
    g = e.groupBy("node").agg(F.count("*").alias("n"), sum_if("way = 'in'").alias("total_in"), sum_if("way = 'out'").alias("total_out"))
    k = e.select("node", F.explode("tags").alias("tag")).where("tag <> ''").groupBy("node").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    g = g.join(k, "node", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    has = lambda *xs: F.arrays_overlap("tags", F.array(*map(F.lit, xs)))
    level = F.when(has("sanctioned"), "critical").when(has("mixer", "coinjoin"), "high").when(has("high_value", "privacy_coin"), "medium").otherwise("low")
    low = F.lower("node")
    kind = F.when(low.contains("coinjoin") | has("mixer"), "mixer").when(low.rlike("binance|coinbase|kraken|bitfinex"), "exchange").otherwise("wallet")
    out = g.withColumns({"level": level, "kind": kind, "tags": F.array_join("tags", ",")})
    return out.orderBy(F.desc("n"), "node").limit(nodes)


def wallets(tx: DataFrame) -> DataFrame:
    """Both ends of each transfer by lower-case address."""
    ends = F.explode(F.array(F.struct(F.lower("from_address").alias("address"), F.lit(0).alias("in_")), F.struct(F.lower("to_address").alias("address"), F.lit(1).alias("in_"))))
    e = tx.select("amount", "ts_s", "token", ends.alias("e")).select("amount", "ts_s", "token", "e.address", "e.in_")
    return e.groupBy("address").agg(F.count("*").alias("n"), sum_if("in_ = 1").alias("received"), sum_if("in_ = 0").alias("sent"), F.min("ts_s").alias("first_s"), F.max("ts_s").alias("last_s"), F.countDistinct("token").alias("tokens"))


def token_balances(tx: DataFrame) -> DataFrame:
    """Balance of each token on each day of the span, carried forward."""
    signed = F.when(F.col("tx_type").isin("deposit", "buy"), F.col("amount")).otherwise(-F.col("amount"))
    d = tx.groupBy("token", day().alias("day")).agg(F.sum(signed).alias("delta"))
    span = tx.agg(F.min(day()).alias("a"), F.max(day()).alias("z")).select(F.explode(F.sequence("a", "z")).alias("day"))
    frame = tx.select("token").distinct().join(F.broadcast(span))  # one row a day of the span
    w = Window.partitionBy("token").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return frame.join(d, ["token", "day"], "left").select("token", "day", F.sum(F.coalesce("delta", F.lit(0))).over(w).cast("double").alias("balance"))


def activity(tx: DataFrame) -> DataFrame:
    """Hours, weekdays and night share, by grouping sets."""
    ts = F.timestamp_seconds("ts_s")
    d = tx.withColumn("hour", F.hour(ts)).withColumn("weekday", F.weekday(ts))
    g = d.groupingSets([[F.col(OWNER), F.col("hour")], [F.col(OWNER), F.col("weekday")]], OWNER, "hour", "weekday")
    return g.agg(F.count("*").alias("n"), total().alias("total")).withColumnRenamed(OWNER, "owner")


def dormancy(tx: DataFrame, days: int = 7) -> DataFrame:
    """Pauses longer than some days."""
    w = Window.partitionBy(OWNER).orderBy("ts_s", "transfer_id")
    return tx.withColumn("before", F.lag("ts_s").over(w)).where(F.col("ts_s") - F.col("before") > days * 86400).select(F.col(OWNER).alias("owner"), "transfer_id", (F.col("ts_s") - F.col("before")).alias("seconds"))
