"""Queries over ledger transfers, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as L
from .tables import WITH_X

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _in(xs: list[str]) -> str:
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


DAY = "CAST(to_timestamp(ts_s) AT TIME ZONE 'UTC' AS DATE)"
TS = "(to_timestamp(ts_s) AT TIME ZONE 'UTC')"
S = "CAST(sum({}) AS DOUBLE)".format


def _if(c: str) -> str:
    return f"CAST(sum(CASE WHEN {c} THEN amount ELSE 0 END) AS DOUBLE)"


#: The lists of these queries, as a caller may have them: in any case, with several reasons.
WATCH = [("W3 ", "court order"), ("w7", "Mixer of coins"), ("W1", "mixer"), ("w3", "watched")]
CONTRACTS = [("W5", "Bridge A", "bridge"), ("w7", "Swap B", "defi"), ("W9", "Blend C", "mixer"), ("w11", "Game D", "game")]
_rows = lambda rows: ", ".join(str(r) for r in rows)
_LISTS = f"""w(address, kind) AS (VALUES {_rows(WATCH)}), k(address, name, category) AS (VALUES {_rows(CONTRACTS)}),
wx AS (SELECT transfer_id, from_address, to_address, CASE WHEN transfer_id % 7 = 0 THEN 'W9 ' WHEN transfer_id % 7 = 1 THEN 'w11' END AS contract FROM x),
wh AS (
  SELECT transfer_id, 'sanctioned' AS tag, 100 AS p FROM wx, (SELECT unnest([1, 2]) AS i) WHERE lower(trim(CASE i WHEN 1 THEN from_address ELSE to_address END)) IN (SELECT lower(trim(address)) FROM w)
  UNION ALL SELECT transfer_id, 'mixer', 80 FROM wx, (SELECT unnest([1, 2]) AS i) WHERE lower(trim(CASE i WHEN 1 THEN from_address ELSE to_address END)) IN (SELECT lower(trim(address)) FROM w WHERE lower(kind) LIKE '%mixer%')
  UNION ALL SELECT transfer_id, category, CASE category WHEN 'mixer' THEN 80 WHEN 'bridge' THEN 20 ELSE 5 END FROM wx, (SELECT unnest([1, 2]) AS i), k
    WHERE lower(trim(CASE i WHEN 1 THEN to_address ELSE contract END)) = lower(trim(address)) AND category IN ('mixer', 'bridge', 'defi')),
wt AS (SELECT transfer_id, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags, CAST(least(100, sum(p)) AS INT) AS risk_score FROM wh GROUP BY 1)"""


def _lists(t):
    return t.spark.createDataFrame(WATCH, "address string, kind string"), t.spark.createDataFrame(CONTRACTS, "address string, name string, category string"), "contract"


def with_contract(tx):
    return tx.withColumn("contract", F.when(F.col("transfer_id") % 7 == 0, "W9 ").when(F.col("transfer_id") % 7 == 1, "w11"))


def _with_contract(t):
    return with_contract(t.transfers)


query("x1_watch_matches", f"""{WITH_X}, {_LISTS} SELECT wx.transfer_id, coalesce(tags, '') AS tags, coalesce(risk_score, 0) AS risk_score, coalesce(c3.name, c2.name) AS counterparty FROM wx LEFT JOIN wt USING (transfer_id)
LEFT JOIN k c2 ON lower(trim(c2.address)) = to_address LEFT JOIN k c3 ON lower(trim(c3.address)) = lower(trim(wx.contract)) WHERE tags IS NOT NULL OR c2.name IS NOT NULL OR c3.name IS NOT NULL""")(lambda t: L.watch_matches(_with_contract(t), *_lists(t)))


_RULES = f"""r AS (SELECT transfer_id, from_address, CASE WHEN token IN {_in(L.KNOWN)} THEN 'known' ELSE 'unknown' END AS token_class,
  CAST(greatest(0, least(100, CASE WHEN token IN {_in(L.PRIVACY)} THEN 30 ELSE 0 END + CASE WHEN token IN {_in(L.MEME)} THEN 5 ELSE 0 END + CASE WHEN token IN {_in(L.FIAT)} AND amount > 15000 THEN 20 ELSE 0 END
  + CASE WHEN token NOT IN {_in(L.KNOWN)} THEN 10 ELSE 0 END + CASE WHEN tx_type = 'withdrawal' THEN 10 ELSE 0 END - CASE WHEN tx_type = 'transfer' THEN 5 ELSE 0 END)) AS INT) AS risk_score FROM x)"""
query("x2_exchange_rules", f"{WITH_X}, {_RULES} SELECT transfer_id, token_class, risk_score FROM r")(lambda t: L.exchange_rules(t.transfers))
_PEEL = """peel AS (SELECT from_address AS address, count(*) AS n, count(*) FILTER (amount < before) AS falls FROM (SELECT *, lag(amount) OVER (PARTITION BY from_address ORDER BY ts_s, transfer_id) AS before FROM x WHERE amount > 0) GROUP BY 1
  HAVING count(*) >= 5 AND count(*) FILTER (amount < before) / greatest(1, count(*) - 1) > {})"""
query("x4_peel_chains", f"{WITH_X}, {_PEEL.format(0.49)} SELECT * FROM peel")(lambda t: L.peel_chains(t.transfers, share=0.49))
query("x5_dust", f"{WITH_X} SELECT to_address AS address, count(*) AS n FROM x WHERE amount > 0 AND amount < 20000 GROUP BY 1 HAVING count(*) >= 10")(lambda t: L.dust(t.transfers, below=20_000))
_TRIP = """trip AS (SELECT a.address, count(*) AS matching FROM (SELECT DISTINCT from_address AS address, token, {0} AS amount FROM x) a JOIN (SELECT DISTINCT to_address AS address, token, {0} AS amount FROM x) b
  USING (address, token, amount) GROUP BY 1 HAVING count(*) >= 3)"""
query("x6_round_trips", f"{WITH_X}, {_TRIP.format('floor(amount / 100)')} SELECT * FROM trip")(lambda t: L.round_trips(t.transfers.withColumn("amount", F.floor(F.col("amount") / 100))))
_SMURF = """smurf AS (SELECT x.from_address AS address, count(*) AS n, count(*) FILTER (abs(CAST(amount AS DOUBLE) - mean) / greatest(mean, 0.01) < 0.1) AS similar, count(DISTINCT to_address) AS receivers
  FROM x JOIN (SELECT from_address, CAST(sum(amount) AS DOUBLE) / count(*) AS mean FROM x WHERE amount > 0 GROUP BY 1) m ON m.from_address = x.from_address WHERE amount > 0 GROUP BY 1
  HAVING count(*) >= 5 AND count(*) FILTER (abs(CAST(amount AS DOUBLE) - mean) / greatest(mean, 0.01) < 0.1) >= 5 AND count(DISTINCT to_address) >= 3)"""
query("x7_smurfing", f"{WITH_X}, {_SMURF} SELECT * FROM smurf")(lambda t: L.smurfing(t.transfers))
query("x8_rapid_conversion", f"""{WITH_X} SELECT d.from_address AS owner, count(*) AS chains, min(w.ts_s - d.ts_s) AS fastest_s FROM x d JOIN x w ON d.from_address = w.from_address AND w.ts_s - d.ts_s > 0 AND w.ts_s - d.ts_s <= 21600 AND d.token <> w.token
WHERE d.tx_type = 'deposit' AND w.tx_type = 'withdrawal' GROUP BY 1 HAVING count(*) >= 2""")(lambda t: L.rapid_conversion(t.transfers, minutes=360))
query("x27_pass_through", f"""{WITH_X} SELECT d.from_address AS owner, d.transfer_id AS deposit_id, w.transfer_id AS withdrawal_id, w.ts_s - d.ts_s AS seconds FROM x d JOIN x w ON d.from_address = w.from_address AND w.ts_s - d.ts_s BETWEEN 0 AND 86400
WHERE d.tx_type = 'deposit' AND w.tx_type = 'withdrawal'""")(lambda t: L.pass_through(t.transfers))
query("x9_structured_deposits", f"""{WITH_X}, d AS (SELECT * FROM x WHERE tx_type = 'deposit' AND token IN {_in(L.FIAT)}), m AS (SELECT from_address, CAST(sum(amount) AS DOUBLE) / count(*) AS mean FROM d GROUP BY 1 HAVING count(*) >= 3)
SELECT from_address AS owner, count(*) FILTER (abs(CAST(amount AS DOUBLE) - mean) / greatest(mean, 0.01) < 0.15) AS similar, max(mean) AS mean FROM d JOIN m USING (from_address) GROUP BY 1 HAVING count(*) FILTER (abs(CAST(amount AS DOUBLE) - mean) / greatest(mean, 0.01) < 0.15) >= 3""")(lambda t: L.structured_deposits(t.transfers))
_MEME = f"meme AS (SELECT from_address AS owner, count(*) AS n, count(*) FILTER (token IN {_in(L.MEME)}) AS meme FROM x GROUP BY 1 HAVING count(*) >= 5 AND count(*) FILTER (token IN {_in(L.MEME)}) >= 3 AND count(*) FILTER (token IN {_in(L.MEME)}) / count(*) > {{}})"
query("x10_meme_share", f"{WITH_X}, {_MEME.format(0.15)} SELECT * FROM meme")(lambda t: L.meme_share(t.transfers, share=0.15))
_PRIV = f"priv AS (SELECT from_address AS owner, count(*) AS n, array_to_string(list_sort(list(DISTINCT token)), ',') AS tokens, {S('amount')} AS volume FROM x WHERE token IN {_in(L.PRIVACY)} GROUP BY 1)"
query("x11_privacy_usage", f"{WITH_X}, {_PRIV} SELECT * FROM priv")(lambda t: L.privacy_usage(t.transfers))
_RAPID = """rapid AS (SELECT d.from_address AS owner FROM x d JOIN x w ON d.from_address = w.from_address AND w.ts_s - d.ts_s > 0 AND w.ts_s - d.ts_s <= 1800 AND d.token <> w.token WHERE d.tx_type = 'deposit' AND w.tx_type = 'withdrawal' GROUP BY 1 HAVING count(*) >= 2)"""
_STRUCT = f"""sd AS (SELECT * FROM x WHERE tx_type = 'deposit' AND token IN {_in(L.FIAT)}), sm AS (SELECT from_address, CAST(sum(amount) AS DOUBLE) / count(*) AS mean FROM sd GROUP BY 1 HAVING count(*) >= 3),
struct AS (SELECT from_address AS owner FROM sd JOIN sm USING (from_address) GROUP BY 1 HAVING count(*) FILTER (abs(CAST(amount AS DOUBLE) - mean) / greatest(mean, 0.01) < 0.15) >= 3)"""


def _overall(score: str, reasons: list[tuple[str, str, int]]) -> str:
    """score: transfer_id and risk_score; reasons: select of owners, name, points."""
    union = " UNION ".join(f"SELECT DISTINCT owner, '{k}' AS reason, {p} AS points FROM ({q}) q{i}" for i, (q, k, p) in enumerate(reasons))
    return f"""u AS ({union}), p AS (SELECT owner, CAST(sum(points) AS BIGINT) AS points, string_agg(reason, ',' ORDER BY reason) AS reasons FROM u GROUP BY 1),
m AS (SELECT from_address AS owner, sum(coalesce(risk_score, 0)) / count(*) AS mean FROM x LEFT JOIN {score} USING (transfer_id) GROUP BY 1)
SELECT owner, round(least(100.0, mean * 0.3 + coalesce(points, 0)), 4) AS risk, coalesce(points, 0) AS points, coalesce(reasons, '') AS reasons FROM m LEFT JOIN p USING (owner)"""


_PRIVATE = f"SELECT from_address AS owner FROM x WHERE token IN {_in(L.PRIVACY)}"
query("x12_overall_risk", f"""{WITH_X}, {_RULES}, {_MEME.format(0.2)}, {_RAPID}, {_STRUCT}, {_overall("(SELECT transfer_id, risk_score FROM r) r", [
    ("SELECT owner FROM rapid", "rapid_conversion", 35), ("SELECT owner FROM struct", "structuring_deposits", 25), ("SELECT owner FROM meme", "meme_coin_concentration", 5), (_PRIVATE, "privacy_coin_usage", 20),
    (f"SELECT from_address AS owner FROM x WHERE token IN {_in(L.FIAT)} AND amount > 15000", "high_value_fiat", 10), (_PRIVATE, "privacy_coin", 15),
])}""")(lambda t: L.overall_risk(t.transfers))
query("x12_chain_risk", f"""{WITH_X}, {_LISTS}, {_PEEL.format(0.7)}, {_TRIP.format('amount')}, {_SMURF}, {_overall("(SELECT transfer_id, risk_score FROM wt WHERE tags <> '') r", [
    ("SELECT address AS owner FROM peel", "peel_chain", 30), ("SELECT address AS owner FROM trip", "round_trip", 35), ("SELECT address AS owner FROM smurf", "smurfing", 40), ("SELECT to_address AS owner FROM x WHERE amount > 0 AND amount < 0.0001 GROUP BY 1 HAVING count(*) >= 10", "dust_attack", 15),
    ("SELECT from_address AS owner FROM x JOIN wt USING (transfer_id) WHERE contains(tags, 'sanctioned')", "sanctioned", 50), ("SELECT from_address AS owner FROM x JOIN wt USING (transfer_id) WHERE contains(tags, 'mixer')", "mixer", 40), (_PRIVATE, "privacy_coin", 20),
])}""")(lambda t: L.overall_risk(_with_contract(t), "blockchain", *_lists(t)))
query("x15_address_nodes", f"""{WITH_X}, {_LISTS}, e AS (SELECT from_address AS node, 'out' AS way, amount, tags FROM x LEFT JOIN wt USING (transfer_id) WHERE from_address <> to_address UNION ALL SELECT to_address, 'in', amount, tags FROM x LEFT JOIN wt USING (transfer_id) WHERE from_address <> to_address),
g AS (SELECT node, count(*) AS n, {_if("way = 'in'")} AS total_in, {_if("way = 'out'")} AS total_out FROM e GROUP BY 1), k2 AS (SELECT node, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags FROM (SELECT node, unnest(string_split(coalesce(tags, ''), ',')) AS tag FROM e) WHERE tag <> '' GROUP BY 1)
SELECT node, n, total_in, total_out, coalesce(tags, '') AS tags, CASE WHEN contains(tags, 'sanctioned') THEN 'critical' WHEN contains(tags, 'mixer') THEN 'high' ELSE 'low' END AS level, CASE WHEN contains(tags, 'mixer') THEN 'mixer' ELSE 'wallet' END AS kind FROM g LEFT JOIN k2 USING (node) ORDER BY n DESC, node LIMIT 200""")(
    lambda t: L.address_nodes(t.transfers, L.watch_matches(_with_contract(t), *_lists(t)))
)
query("x15_address_edges", f"""{WITH_X}, e AS (SELECT from_address, to_address, count(*) AS n, {S('amount')} AS total FROM x WHERE from_address <> to_address GROUP BY 1, 2),
t AS (SELECT node FROM (SELECT from_address AS node, n FROM e UNION ALL SELECT to_address, n FROM e) GROUP BY 1 ORDER BY sum(n) DESC, node LIMIT 200)
SELECT * FROM e WHERE from_address IN (SELECT node FROM t) AND to_address IN (SELECT node FROM t) ORDER BY total DESC, from_address, to_address LIMIT 500""")(lambda t: L.address_edges(t.transfers))
query("x17_wallets", f"""{WITH_X}, e AS (SELECT lower(from_address) AS address, 0 AS in_, amount, ts_s, token FROM x UNION ALL SELECT lower(to_address), 1, amount, ts_s, token FROM x)
SELECT address, count(*) AS n, {_if('in_ = 1')} AS received, {_if('in_ = 0')} AS sent, min(ts_s) AS first_s, max(ts_s) AS last_s, count(DISTINCT token) AS tokens FROM e GROUP BY 1""")(lambda t: L.wallets(t.transfers))
query("x18_token_balances", f"""{WITH_X}, d AS (SELECT token, {DAY} AS day, sum(CASE WHEN tx_type IN ('deposit', 'buy') THEN amount ELSE -amount END) AS delta FROM x GROUP BY 1, 2),
f AS (SELECT token, CAST(unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT token FROM x))
SELECT token, day, CAST(sum(coalesce(delta, 0)) OVER (PARTITION BY token ORDER BY day ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS balance FROM f LEFT JOIN d USING (token, day)""")(lambda t: L.token_balances(t.transfers))
for _name, _col in (("token_breakdown", "token"), ("operations", "tx_type"), ("counterparties", "to_address")):
    query(f"x20_{_name}", f"{WITH_X} SELECT {_col}, count(*) AS n, {S('amount')} AS total FROM x GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15")(lambda t, c=_col: t.transfers.groupBy(c).agg(F.count("*").alias("n"), L.total().alias("total")).orderBy(F.desc("n"), c).limit(15))
query("x20_month_volume", f"{WITH_X} SELECT strftime({DAY}, '%Y-%m') AS month, token, count(*) AS n, {S('amount')} AS total FROM x GROUP BY 1, 2")(lambda t: t.transfers.groupBy(F.date_format(L.day(), "yyyy-MM").alias("month"), "token").agg(F.count("*").alias("n"), L.total().alias("total")))
query("x30_activity", f"{WITH_X}, d AS (SELECT *, hour({TS}) AS hour, isodow({TS}) - 1 AS weekday FROM x) SELECT from_address AS owner, hour, weekday, count(*) AS n, {S('amount')} AS total FROM d GROUP BY GROUPING SETS ((from_address, hour), (from_address, weekday))")(
    lambda t: L.activity(t.transfers).withColumn("hour", F.col("hour").cast("long")).withColumn("weekday", F.col("weekday").cast("long"))
)
query("x30_dormancy", f"{WITH_X}, d AS (SELECT *, lag(ts_s) OVER (PARTITION BY from_address ORDER BY ts_s, transfer_id) AS before FROM x) SELECT from_address AS owner, transfer_id, ts_s - before AS seconds FROM d WHERE ts_s - before > 259200")(lambda t: L.dormancy(t.transfers, 3))
