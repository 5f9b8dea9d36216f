"""Queries over sources and sinks: files that Spark writes out of the tables and reads again, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import household as H
from ..sources import tables as S
from .bank import D
from .notes import values
from .tables import WITH_B, WITH_M

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("src1_cases", f"{WITH_B} SELECT account_id % 10 AS case_id, count(*) AS n, {D('sum(amount)')} AS total, min(booking_date) AS first_day FROM b GROUP BY 1")
def src1(t):
    at = t.scratch()
    S.write_partitioned(t.bank.withColumn("case_id", F.col("account_id") % 10), at, ["case_id"])
    return S.read_cases(t.spark, at, list(range(10))).groupBy(F.col("case_id").cast("long").alias("case_id")).agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"), F.min("booking_date").alias("first_day"))


_TEXT = "concat('Żółć ', event_type, ' Łódź ', CAST(user_id AS STRING))"


@query("src2_delimited", f"SELECT event_id, user_id AS subscriber, {_TEXT} AS note FROM events")
def src2(t):
    at = t.scratch()
    own = bytes(range(128, 256))
    real = own.decode("windows-1250", "replace")
    note = F.translate(F.expr(_TEXT), real, own.decode("latin-1"))  # what the bytes of the other encoding are in this one
    t("events").select("event_id", F.col("user_id").alias("subscriber"), note.alias("note")).write.option("sep", ";").option("header", True).option("encoding", "iso-8859-1").csv(at)
    return S.read_delimited(t.spark, at, "event_id long, subscriber long, note string")


_SIG = [(i, k, S.plain_header(h)) for i, (k, hs) in enumerate(S.SIGNATURES.items()) for h in hs]


@query("src3_formats", f"""WITH g(place, format, h) AS (VALUES {values(_SIG)}), f AS (SELECT s_suppkey, s_suppkey % 19 AS p, s_suppkey % 5 AS drop_ FROM supplier),
u AS (SELECT DISTINCT s_suppkey AS file, h FROM f JOIN (SELECT *, row_number() OVER (PARTITION BY place ORDER BY h) AS i FROM g) q ON place = p WHERE i > drop_), m AS (SELECT file, format, place, count(*) AS n FROM u JOIN g USING (h) GROUP BY 1, 2, 3 HAVING count(*) >= 3),
b AS (SELECT file, arg_min(format, (-n, place)) AS format, max(n) AS overlap FROM m GROUP BY 1) SELECT DISTINCT u.file, coalesce(format, 'generic') AS format, coalesce(overlap, 0) AS overlap FROM u LEFT JOIN b USING (file)""")
def src3(t):
    rows = [(p, i + 1, h) for p, (_, hs) in enumerate(S.SIGNATURES.items()) for i, h in enumerate(sorted(map(S.plain_header, hs)))]
    names = t.spark.createDataFrame(rows, "p int, i int, header string")
    f = t("supplier").select(F.col("s_suppkey").alias("file"), (F.col("s_suppkey") % 19).alias("p"), (F.col("s_suppkey") % 5).alias("d"))
    headers = f.join(F.broadcast(names), "p").where("i > d").select("file", F.concat(F.lit(" "), F.initcap(F.translate("header", " ", "_"))).alias("header"))
    return S.formats_of_files(headers)


#: Files of five formats out of the orders: column names, and what each column holds, as SQL of both engines.
_TS = "concat('2024-03-', lpad(CAST(o_orderkey % 28 + 1 AS STRING), 2, '0'), ' 10:', lpad(CAST(o_orderkey % 60 AS STRING), 2, '0'), ':00')"
_V = "CAST(CAST(FLOOR(o_totalprice) AS BIGINT) AS STRING)"
_OP = "CASE o_orderkey % 5 WHEN 0 THEN 'Deposit' WHEN 1 THEN 'Withdraw' WHEN 2 THEN 'Buy' WHEN 3 THEN 'Fee' ELSE 'Other' END"
_FILES = {
    "binance": {"User_ID": "'1'", "UTC_Time": _TS, "Account": "'Spot'", "Operation": _OP, "Coin": "'btc'", "Change": f"concat('-', {_V}, ' USD')"},
    "etherscan": {"Txhash": "concat('0x', CAST(o_orderkey AS STRING))", "Blockno": "'7'", "DateTime (UTC)": _TS, "From": "concat('0xAB', CAST(o_custkey AS STRING))", "To": "'0xCD'", "Value": _V, "Method": "CASE o_orderkey % 3 WHEN 0 THEN 'Swap exact' WHEN 1 THEN 'Approve' ELSE '' END"},
    "kraken": {"txid": "concat('k', CAST(o_orderkey AS STRING))", "refid": "'r'", "time": _TS, "type": "lower(" + _OP.replace("Withdraw", "Withdrawal").replace("Buy", "Trade") + ")", "subtype": "''", "aclass": "'c'", "asset": "CASE o_orderkey % 3 WHEN 0 THEN 'XXBT' WHEN 1 THEN 'ZUSD' ELSE 'dot' END", "amount": f"concat({_V}, ',5')", "fee": "'0'"},
    "walletexplorer": {"date": _TS, "received from": "CASE WHEN o_orderkey % 2 = 0 THEN ' abc ' ELSE '' END", "received amount": f"CASE WHEN o_orderkey % 2 = 0 THEN {_V} ELSE '' END", "sent amount": f"CASE WHEN o_orderkey % 2 = 1 THEN {_V} ELSE '0' END", "sent to": "CASE WHEN o_orderkey % 2 = 1 THEN 'def' ELSE '' END", "balance": "'1'", "transaction": "concat('t', CAST(o_orderkey AS STRING))"},
    "metamask": {"date": _TS, "status": "'ok'", "type": _OP, "from": "'a'", "to": "concat('b', CAST(o_custkey % 9 AS STRING))", "amount": _V, "token": "CASE WHEN o_orderkey % 2 = 0 THEN 'usdt' ELSE '' END"},
}
_T4 = lambda h, a, b, v, k, ty, src: f"SELECT {h} AS tx_hash, CAST({_TS} AS TIMESTAMP) AS ts, {a} AS from_address, {b} AS to_address, CAST({v} AS DOUBLE) AS amount, {k} AS token, {ty} AS tx_type, '{src}' AS source FROM orders"
_KRAKEN = "CASE o_orderkey % 5 WHEN 0 THEN 'deposit' WHEN 1 THEN 'withdrawal' WHEN 2 THEN 'swap' ELSE 'transfer' END"
_TRANSFERS = " UNION ALL ".join([
    _T4("NULL", "NULL", "NULL", "floor(o_totalprice)", "'BTC'", "CASE o_orderkey % 5 WHEN 0 THEN 'deposit' WHEN 1 THEN 'withdrawal' WHEN 2 THEN 'swap' WHEN 3 THEN 'fee' ELSE 'transfer' END", "binance"),
    _T4("concat('0x', CAST(o_orderkey AS VARCHAR))", "concat('0xab', CAST(o_custkey AS VARCHAR))", "'0xcd'", "floor(o_totalprice)", "'ETH'", "CASE o_orderkey % 3 WHEN 0 THEN 'swap' WHEN 1 THEN 'contract_call' ELSE 'transfer' END", "ethereum"),
    _T4("concat('k', CAST(o_orderkey AS VARCHAR))", "NULL", "NULL", "floor(o_totalprice) + 0.5", "CASE o_orderkey % 3 WHEN 0 THEN 'BTC' WHEN 1 THEN 'USD' ELSE 'DOT' END", _KRAKEN, "kraken"),
    _T4("concat('t', CAST(o_orderkey AS VARCHAR))", "CASE WHEN o_orderkey % 2 = 0 THEN 'abc' ELSE 'me' END", "CASE WHEN o_orderkey % 2 = 0 THEN 'me' ELSE 'def' END", "floor(o_totalprice)", "'BTC'", "CASE WHEN o_orderkey % 2 = 0 THEN 'deposit' ELSE 'withdrawal' END", "bitcoin") + " WHERE floor(o_totalprice) > 0",
    _T4("NULL", "'a'", "concat('b', CAST(o_custkey % 9 AS VARCHAR))", "floor(o_totalprice)", "CASE WHEN o_orderkey % 2 = 0 THEN 'USDT' ELSE 'UNKNOWN' END", "CASE o_orderkey % 5 WHEN 0 THEN 'deposit' WHEN 1 THEN 'withdrawal' WHEN 2 THEN 'swap' ELSE 'transfer' END", "unknown"),
])


def _transfers(t):
    """Each format is written as a delimited file with its header, and read as text."""
    out = None
    for columns in _FILES.values():
        at = t.scratch()
        t("orders").select(*(F.expr(e).alias(c) for c, e in columns.items())).write.option("header", True).csv(at)
        part = S.transfers_of(t.spark.read.option("header", True).csv(at), "me")
        out = part if out is None else out.unionByName(part)
    return out


query("src4_transfers", _TRANSFERS)(lambda t: _transfers(t).withColumn("amount", F.col("amount").cast("double")))
query("src5_source_kinds", f"WITH f AS ({_TRANSFERS}) SELECT source, CASE WHEN source IN ('binance', 'kraken') THEN 'exchange' WHEN source IN ('ethereum', 'bitcoin') THEN 'blockchain' WHEN avg(CASE WHEN from_address <> '' OR to_address <> '' THEN 1.0 ELSE 0.0 END) > 0.5 THEN 'blockchain' ELSE 'exchange' END AS kind FROM f GROUP BY 1")(lambda t: S.source_kind(_transfers(t)))


@query("src6_stations", f"{WITH_M} SELECT 'GSM' AS radio, 260 AS mcc, CAST(k % 5 AS INT) AS net, CAST(subscriber % 100 AS INT) AS area, event_id AS cell, CAST(1 AS INT) AS unit, lon, CASE WHEN k % 10 = 1 THEN NULL ELSE lat END AS lat FROM p WHERE k % 3 <> 0 AND k % 10 <> 1 AND k % 10 <> 2")
def src6(t):
    at = t.scratch()
    t.moves.selectExpr("'GSM' as radio", "if(k % 3 = 0, 262, 260) as mcc", "k % 5 as net", "subscriber % 100 as area", "event_id as cell", "if(k % 10 = 1, 'broken', '1') as unit", "lon", "if(k % 10 = 2, 91.5, lat) as lat").write.option("header", True).csv(at)
    return S.read_stations(t.spark, at, 260)


query("src7_learned_stations", f"{WITH_M} SELECT k % 40 AS cell, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, count(*) AS n FROM p WHERE k % 6 <> 0 GROUP BY 1")(
    lambda t: S.learned_stations(t.moves.withColumns({"cell": F.col("k") % 40, "lat": F.when(F.col("k") % 6 != 0, F.col("lat"))}), ["cell"]).withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})
)
query("src8_plausible", f"{WITH_M} SELECT event_id FROM p WHERE k % 8 > 2")(lambda t: S.plausible(t.moves.withColumns({"lat": F.expr("case k % 8 when 0 then 0.0 when 1 then -95.0 else lat end"), "lon": F.expr("case k % 8 when 0 then 0.0 when 2 then 200.0 else lon end")})).select("event_id"))
query("src9_watchlist", """WITH o AS (SELECT concat('0xA', CAST(c_custkey AS VARCHAR)) AS address, 'old' AS kind FROM customer), n AS (SELECT lower(concat('0xA', CAST(s_suppkey * 2 % 400 AS VARCHAR))) AS address, min(s_name) AS kind FROM supplier GROUP BY 1)
SELECT lower(address) AS address, kind FROM o WHERE lower(address) NOT IN (SELECT address FROM n) UNION ALL SELECT * FROM n""")(
    lambda t: S.merge_watchlist(t("customer").select(F.expr("concat('0xA', cast(c_custkey as string))").alias("address"), F.lit("old").alias("kind")), t("supplier").select(F.expr("concat('0xA', cast(s_suppkey * 2 % 400 as string))").alias("address"), F.col("s_name").alias("kind")))
)
query("src9_entities", "WITH u AS (SELECT c_nationkey AS entity, c_mktsegment AS chain FROM customer UNION ALL SELECT s_nationkey, concat('S', CAST(s_suppkey % 3 AS VARCHAR)) FROM supplier) SELECT entity, array_to_string(list_sort(list(DISTINCT chain)), ',') AS chains, count(*) AS entries FROM u GROUP BY 1")(
    lambda t: S.merge_entities(t("customer").selectExpr("c_nationkey as entity", "c_mktsegment as chain"), t("supplier").selectExpr("s_nationkey as entity", "concat('S', cast(s_suppkey % 3 as string)) as chain")).withColumn("chains", F.array_join("chains", ","))
)
query("src10_upsert", "WITH u AS (SELECT o_custkey AS cell, o_orderkey AS version FROM orders) SELECT cell, max(version) AS version FROM u GROUP BY 1")(
    lambda t: (lambda o: S.upsert(o.where("version % 2 = 0"), o.where("version % 2 = 1"), ["cell"], "version"))(t("orders").select(F.col("o_custkey").alias("cell"), F.col("o_orderkey").alias("version")))
)


@query("src11_written", f"{WITH_B} SELECT channel, category, count(*) AS n, {D('sum(amount)')} AS total FROM b GROUP BY 1, 2")
def src11(t):
    at = t.scratch()
    S.write_partitioned(t.bank, at, ["channel", "category"])
    return t.spark.read.parquet(at).groupBy("channel", "category").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"))


@query("src12_json_rules", "SELECT p_name AS pattern, p_brand AS name, min(p_partkey) AS priority FROM part GROUP BY 1, 2")
def src12(t):
    at = t.scratch()
    rules = t("part").groupBy(F.col("p_name").alias("pattern"), F.col("p_brand").alias("name")).agg(F.min("p_partkey").alias("priority"))
    rules.unionByName(t("region").selectExpr("cast(null as string) as pattern", "r_name as name", "cast(r_regionkey as bigint) as priority")).write.json(at)
    return S.read_rules(t.spark, at, "pattern string, name string, priority long")


_LAYOUT = "subscriber long, msisdn string, imsi string, records long"


@query("src13_batch", """WITH f AS (SELECT user_id AS subscriber, event_type AS file, CASE WHEN user_id % 3 = 0 OR event_type = 'view' THEN concat('+48', CAST(600000000 + user_id + CASE event_type WHEN 'view' THEN 5000 ELSE 0 END AS VARCHAR)) END AS msisdn, CASE WHEN event_type IN ('click', 'error') THEN concat('i', event_type, CAST(user_id AS VARCHAR)) END AS imsi, count(*) AS records FROM events GROUP BY 1, 2),
r AS (SELECT *, msisdn IS NOT NULL AS has FROM f) SELECT subscriber, CAST(sum(records) AS BIGINT) AS records, arg_max(msisdn, (has, records, msisdn)) FILTER (msisdn IS NOT NULL) AS msisdn, arg_max(imsi, (has, records, imsi)) FILTER (imsi IS NOT NULL) AS imsi FROM r GROUP BY 1""")
def src13(t):
    at = t.scratch()
    g = t("events").groupBy(F.col("user_id").alias("subscriber"), "event_type").agg(F.count("*").alias("records"))
    msisdn = F.expr("case when subscriber % 3 = 0 or event_type = 'view' then concat('+48', cast(600000000 + subscriber + if(event_type = 'view', 5000, 0) as string)) end")
    imsi = F.expr("case when event_type in ('click', 'error') then concat('i', event_type, cast(subscriber as string)) end")
    rows = g.select("subscriber", msisdn.alias("msisdn"), imsi.alias("imsi"), "records", "event_type")
    kinds = ["click", "error", "purchase", "signup", "view"]
    for k in kinds:  # a file of each kind, all of one layout
        rows.where(F.col("event_type") == k).drop("event_type").write.option("sep", ";").option("header", True).csv(f"{at}/{k}")
    return S.merge_subscribers([S.read_batch(t.spark, [f"{at}/{k}" for k in kinds], _LAYOUT, encoding="utf-8").drop("file")]).select("subscriber", "records", "msisdn", "imsi")


query("m1_coordinates", "SELECT event_id, round(CASE event_id % 5 WHEN 0 THEN 52 + user_id / 1000.0 WHEN 1 THEN 52.5 WHEN 2 THEN -21.25 END, 6) AS degrees FROM events")(
    lambda t: t("events").select("event_id", F.round(geo.coordinate(F.expr("case event_id % 5 when 0 then cast(52 + user_id / 1000D as string) when 1 then '523000' when 2 then ' -21,25 ' when 3 then '0' else 'none' end")), 6).alias("degrees"))
)
query("f13_entities", "WITH e AS (SELECT p_name AS name, CASE WHEN p_partkey % 4 = 0 THEN 'project' ELSE 'global' END AS scope, max(p_partkey) AS entity FROM part GROUP BY 1, 2) SELECT * FROM e WHERE scope = 'project' OR name NOT IN (SELECT name FROM e WHERE scope = 'project')")(
    lambda t: (lambda e: H.override_months(e.where("scope = 'global'"), e.where("scope = 'project'"), ["name"]))(t("part").groupBy(F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 4 == 0, "project").otherwise("global").alias("scope")).agg(F.max("p_partkey").alias("entity")))
)
