"""Sources and sinks: delimited records, ledgers of many formats, stations, lists, written results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Encodings that Spark's reader knows.
ENCODINGS = {"utf-8", "utf-16", "utf-16be", "utf-16le", "utf-32", "us-ascii", "iso-8859-1"}
TRANSFER = "tx_hash string, ts timestamp, from_address string, to_address string, amount decimal(38,18), token string, tx_type string, source string"


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = ";", encoding: str = "windows-1250") -> DataFrame:
    """SRC2: a delimited file of known columns; rows that do not fit are dropped.

    Spark reads few encodings; other one-byte ones are read byte for byte and then translated.
    """
    native = encoding.lower() in ENCODINGS
    df = spark.read.schema(schema).option("header", True).option("sep", sep).option("encoding", encoding if native else "iso-8859-1").option("mode", "DROPMALFORMED").csv(path)
    if native:
        return df
    high = bytes(range(128, 256))
    own, real = high.decode("latin-1"), high.decode(encoding, "replace")
    return df.select(*(F.translate(f.name, own, real).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in df.schema))


#: The columns by which files of third parties are known, by the name of their format.
SIGNATURES: dict[str, list[str]] = {
    "binance": ["user_id", "utc_time", "account", "operation", "coin", "change"],
    "binance_trade": ["date(utc)", "market", "type", "price", "amount", "total", "fee"],
    "coinbase": ["timestamp", "transaction type", "asset", "quantity purchased", "spot price"],
    "coinbase_pro": ["portfolio", "trade id", "product", "side", "created at", "size", "price", "fee"],
    "kraken": ["txid", "refid", "time", "type", "subtype", "aclass", "asset", "amount", "fee"],
    "kraken_ledger": ["txid", "refid", "time", "type", "subtype", "aclass", "asset", "amount", "fee", "balance"],
    "bybit": ["user id", "date(utc)", "coin", "type", "amount", "wallet balance"],
    "kucoin": ["uid", "account type", "time", "symbol", "direction", "amount", "fee"],
    "etherscan": ["txhash", "blockno", "unixtime", "datetime (utc)", "from", "to", "value"],
    "etherscan_token": ["txhash", "blockno", "unixtime", "datetime (utc)", "from", "to", "tokenvalue"],
    "etherscan_internal": ["txhash", "blockno", "unixtime", "datetime (utc)", "parenttxfrom", "parenttxto"],
    "blockchair": ["block_id", "hash", "time", "sender", "recipient", "value"],
    "electrum": ["transaction_hash", "label", "confirmations", "value", "fiat_value", "fee", "timestamp"],
    "metamask": ["date", "status", "type", "from", "to", "amount", "token"],
    "ledger": ["operation date", "currency ticker", "operation type", "operation amount", "operation fees"],
    "trezor": ["date & time", "type", "transaction id", "fee", "address"],
    "walletexplorer": ["date", "received from", "received amount", "sent amount", "sent to", "balance", "transaction"],
}
#: Formats that have a mapping of their own; all others go by general names.
EXCHANGES, EXPLORERS, LEDGERS, WALLETS = {"binance", "binance_trade"}, {"etherscan", "etherscan_token", "etherscan_internal"}, {"kraken", "kraken_ledger"}, {"walletexplorer"}


def plain_header(h: str) -> str:
    return h.strip().lower().replace("_", " ").replace("-", " ")


def format_of(columns: list[str], least: int = 3) -> str:
    """SRC3: the format with most columns in common, three at least, the first of equal ones; else generic."""
    own = set(map(plain_header, columns))
    n, name = 0, "generic"
    for k, s in SIGNATURES.items():
        if (m := len(own & set(map(plain_header, s)))) >= least and m > n:
            n, name = m, k
    return name


def formats_of_files(headers: DataFrame, least: int = 3) -> DataFrame:
    """SRC3: the same for many files at once. headers: file, header."""
    rows = [(i, k, h) for i, (k, s) in enumerate(SIGNATURES.items()) for h in sorted(set(map(plain_header, s)))]
    known = headers.sparkSession.createDataFrame(rows, "place int, format string, h string")  # some tens of rows
    h = F.translate(F.lower(F.trim("header")), "_-", "  ")
    own = headers.select("file", h.alias("h")).distinct()
    hit = own.join(F.broadcast(known), "h").groupBy("file", "format", "place").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    best = hit.groupBy("file").agg(F.min(F.struct((-F.col("n")).alias("n"), "place", "format")).alias("b"))
    return headers.select("file").distinct().join(best, "file", "left").select("file", F.coalesce("b.format", F.lit("generic")).alias("format"), F.coalesce(-F.col("b.n"), F.lit(0)).alias("overlap"))


def _pick(df: DataFrame, names: list[str]) -> Column:
    known = {c.strip().lower(): c for c in df.columns}
    found = [F.col(f"`{known[n]}`") for n in names if n in known]
    return F.coalesce(*found) if found else F.lit(None)


def _number(c: Column) -> Column:
    """A decimal of what is left without spaces and currency signs, commas as points; nothing is 0."""
    n = F.regexp_replace(F.regexp_replace(F.trim(c.cast("string")), ",", "."), " ", "")
    n = F.regexp_replace(F.regexp_replace(n, r"[A-Za-z$€£¥₿]+$", ""), r"^[A-Za-z$€£¥₿]+", "")
    return F.coalesce(n.try_cast("decimal(38,18)"), F.lit(0).cast("decimal(38,18)"))


def _moment(c: Column) -> Column:
    """A time of day-first, month-first or ISO text, or of seconds or milliseconds since 1970."""
    t = F.trim(c.cast("string"))
    unix = t.try_cast("double")
    unix = F.timestamp_seconds(F.when(unix > 1e12, unix / 1000).otherwise(unix))
    forms = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "MM/dd/yyyy HH:mm:ss"]
    return F.coalesce(F.when(t.rlike(r"^\d+(\.\d+)?$"), unix), *(F.try_to_timestamp(t, F.lit(f)) for f in forms))


def _kind_of(op: Column, cases: list[tuple[str, str]]) -> Column:
    out = F.lit("transfer")
    for pattern, kind in reversed(cases):
        out = F.when(F.lower(F.coalesce(op, F.lit(""))).rlike(pattern), kind).otherwise(out)
    return out


def transfers_of(df: DataFrame, wallet: str = "") -> DataFrame:
    """SRC4: a ledger of any known format as transfers (columns as in TRANSFER).

    wallet: the own address that a wallet's file does not name; its rows become one in or one out.
    Amounts are without sign; addresses of explorers are in lower case; ledgers' asset codes lose their
    leading X or Z.
    """
    kind = format_of(df.columns)
    none, p = F.lit(None), lambda *n: _pick(df, list(n))

    def rows(hash_, ts, src, dst, amount, token, tx_type, chain) -> DataFrame:
        text = lambda c: c.cast("string")
        return df.select(text(hash_).alias("tx_hash"), _moment(ts).alias("ts"), text(src).alias("from_address"), text(dst).alias("to_address"), F.abs(_number(amount)).alias("amount"), text(token).alias("token"), tx_type.alias("tx_type"), F.lit(chain).alias("source"))

    trade = [("deposit", "deposit"), ("withdraw", "withdrawal"), ("buy|sell|trade", "swap"), ("fee", "fee")]
    if kind in EXCHANGES:
        return rows(none, p("utc_time", "date(utc)"), none, none, p("change", "amount", "total"), F.upper(p("coin", "asset").cast("string")), _kind_of(p("operation", "type"), trade), "binance")
    if kind in EXPLORERS:
        contract = [("swap", "swap"), ("approve", "contract_call"), ("mint", "mint"), ("burn", "burn")]
        value = p("value_in(eth)", "value_out(eth)", "value", "tokenvalue")
        return rows(p("txhash", "transaction hash"), p("datetime (utc)", "unixtimestamp"), F.lower(p("from").cast("string")), F.lower(p("to").cast("string")), value, F.upper(F.coalesce(p("tokensymbol").cast("string"), F.lit("ETH"))), _kind_of(p("method").cast("string"), contract), "ethereum")
    if kind in LEDGERS:
        token = F.replace(F.regexp_replace(F.upper(p("asset").cast("string")), "^[XZ]", ""), F.lit("XBT"), F.lit("BTC"))
        return rows(p("txid", "refid"), p("time"), none, none, p("amount"), token, _kind_of(p("type"), [("^deposit$", "deposit"), ("^withdrawal$", "withdrawal"), ("^trade$", "swap"), ("^staking$", "staking")]), "kraken")
    if kind in WALLETS:
        got = rows(p("transaction"), p("date"), F.trim(p("received from")), F.lit(wallet), p("received amount"), F.lit("BTC"), F.lit("deposit"), "bitcoin").where("from_address <> '' and amount > 0")
        sent = rows(p("transaction"), p("date"), F.lit(wallet), F.trim(p("sent to")), p("sent amount"), F.lit("BTC"), F.lit("withdrawal"), "bitcoin").where("to_address <> '' and amount > 0")
        return got.unionByName(sent)
    general = [("deposit", "deposit"), ("withdraw", "withdrawal"), ("swap|trade|buy|sell", "swap")]
    token = F.upper(p("token", "coin", "asset", "currency", "symbol").cast("string"))
    return rows(
        p("hash", "txhash", "tx_hash", "transaction_hash"), p("timestamp", "date", "time", "datetime", "date(utc)", "created at"), p("from", "sender", "from_address"), p("to", "recipient", "to_address"),
        p("amount", "value", "quantity", "size", "total"), F.when(token != "", token).otherwise("UNKNOWN"), _kind_of(p("type", "operation", "side", "transaction type"), general), "unknown",
    )


#: Sources that are known by name.
EXCHANGE_NAMES, CHAIN_NAMES = ["binance", "kraken", "coinbase", "bybit", "kucoin"], ["bitcoin", "ethereum"]


def source_kind(transfers: DataFrame) -> DataFrame:
    """SRC5: exchange or blockchain, by a source's name, else blockchain where more than half of its rows
    have an address."""
    g = transfers.groupBy("source").agg(F.avg(F.when((F.col("from_address") != "") | (F.col("to_address") != ""), 1.0).otherwise(0.0)).alias("share"))
    by_name = F.when(F.lower("source").isin(EXCHANGE_NAMES), "exchange").when(F.lower("source").isin(CHAIN_NAMES), "blockchain")
    return g.select("source", F.coalesce(by_name, F.when(F.col("share") > 0.5, "blockchain").otherwise("exchange")).alias("kind"))


def read_stations(spark: SparkSession, path: str, mcc: int) -> DataFrame:
    """SRC6: stations of one country from a delimited dump."""
    s = spark.read.schema("radio string, mcc int, net int, area int, cell long, unit int, lon double, lat double").option("mode", "DROPMALFORMED").option("header", True).csv(path)
    return plausible(s.where(F.col("mcc") == mcc))


def plausible(stations: DataFrame) -> DataFrame:
    """SRC8: stations with a coordinate that can be."""
    return stations.where("lat between -90 and 90 and lon between -180 and 180 and not (lat = 0 and lon = 0)")


def learned_stations(records: DataFrame, keys: list[str]) -> DataFrame:
    """SRC7: stations out of records that have coordinates, the mean of each key."""
    return plausible(records).groupBy(*keys).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("n"))


def merge_watchlist(old: DataFrame, new: DataFrame) -> DataFrame:
    """SRC9: new entries replace old ones of the same lower-cased address; of several new ones for an
    address the first by all columns stays."""
    key = lambda df: df.withColumn("address", F.lower("address"))
    rest = sorted(c for c in new.columns if c != "address")
    one = key(new).groupBy("address").agg(F.min(F.struct(*rest)).alias("m")).select("address", "m.*").select(*new.columns)
    return key(old).join(one.select("address"), "address", "left_anti").unionByName(one)


def merge_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """SRC9: entities (entity, chain) of both, with all their chains and how many entries they have."""
    g = old.select("entity", "chain").unionByName(new.select("entity", "chain")).groupBy("entity")
    return g.agg(F.array_sort(F.collect_set("chain")).alias("chains"), F.count("*").alias("entries"))


def read_rules(spark: SparkSession, path: str, schema: str, one_value: bool = False) -> DataFrame:
    """SRC12: a rule or dimension table from JSON: an object a line, or (one_value) one array a file.
    Entries without the first column are left out."""
    lines = spark.read.schema(schema).option("multiLine", one_value).json(path)
    return lines.where(F.col(schema.split()[0]).isNotNull())


def read_cases(spark: SparkSession, path: str, cases: list | None = None) -> DataFrame:
    """SRC1: transactions or statements written a folder a case; only the folders of the cases are read."""
    df = spark.read.parquet(path)
    return df if cases is None else df.where(F.col("case_id").isin(cases))


def read_batch(spark: SparkSession, paths: list[str], schema: str, **options) -> DataFrame:
    """SRC13: files of one layout as one table, each row with its file."""
    parts = [read_delimited(spark, p, schema, **options).withColumn("file", F.lit(p.rstrip("/").rsplit("/", 1)[-1])) for p in paths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """SRC10: of rows with equal keys the newest stays."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order), *(F.desc(c) for c in sorted(old.columns)))
    return old.unionByName(new).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """SRC11: results as Parquet, a folder a key."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def merge_subscribers(parts: list[DataFrame]) -> DataFrame:
    """SRC13: files of one subscriber: fields from the file with a number and most records."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    order = lambda c: F.struct(F.col("msisdn").isNotNull().cast("int").alias("has"), "records", c)
    fields = [c for c in rows.columns if c not in ("subscriber", "records")]
    return rows.groupBy("subscriber").agg(F.sum("records").alias("records"), *(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order(c))).alias(c) for c in fields))
