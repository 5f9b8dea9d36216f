"""Queries over an exchange's records, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import exchange as E
from ..operators import ledger as L
from .ledger import DAY, TS, S, _if, _in
from .tables import WITH_C, WITH_E, WITH_X

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _n(c: str) -> str:
    return f"count(*) FILTER ({c})"


_BUY, _SELL = "(tx_type IN ('deposit', 'swap', 'buy') AND coalesce(side, '') IN ('BUY', ''))", "(tx_type IN ('withdrawal', 'swap', 'sell') AND coalesce(side, '') IN ('SELL', ''))"
_MEASURES = f"""{WITH_E}, o AS (SELECT *, ts_s - lag(ts_s) OVER (PARTITION BY owner ORDER BY ts_s, row_id) AS gap, {DAY} AS day, CASE WHEN amount > 0 THEN CAST(amount AS DOUBLE) END AS p, CASE WHEN fiat_value <> 0 THEN abs(CAST(fiat_value AS DOUBLE)) END AS v FROM e),
m AS (SELECT owner, avg(p) AS mp, avg(v) AS mv FROM o GROUP BY 1),
h AS (SELECT b.owner, b.row_id, (min(s.ts_s) - min(b.ts_s)) / 3600.0 AS held FROM (SELECT * FROM e WHERE {_BUY}) b JOIN (SELECT * FROM e WHERE {_SELL} AND NOT {_BUY}) s ON s.owner = b.owner AND s.token = b.token AND s.ts_s > b.ts_s GROUP BY 1, 2),
hh AS (SELECT owner, avg(held) AS mean_held_h, list_sort(list(held))[count(*) // 2 + 1] AS median_held_h FROM h GROUP BY 1),
d AS (SELECT owner, max(k) AS max_per_day FROM (SELECT owner, day, count(*) AS k FROM o GROUP BY 1, 2) GROUP BY 1),
y AS (SELECT owner, count(*) AS same_day FROM (SELECT DISTINCT owner, token, day FROM o WHERE tx_type = 'swap' AND side = 'BUY' INTERSECT SELECT DISTINCT owner, token, day FROM o WHERE tx_type = 'swap' AND side = 'SELL') GROUP BY 1),
g AS (SELECT owner, count(*) AS n, CAST(greatest(floor((max(ts_s) - min(ts_s)) / 86400), 1) AS BIGINT) AS span_days, {_n("tx_type IN ('swap', 'buy', 'sell')")} AS swaps, {_n("tx_type IN ('deposit', 'fiat_deposit', 'buy')")} AS deposits, {_n("tx_type IN ('withdrawal', 'fiat_withdrawal')")} AS withdrawals,
  count(DISTINCT token) AS tokens, coalesce(avg(p), 0) AS mean_amount, coalesce(max(p), 0) AS max_amount, coalesce(sum(p), 0) AS volume, {_n("p > 10 * mp")} AS large, coalesce(max(v), 0) AS max_fiat, coalesce(sum(v), 0) AS fiat_volume, {_n("v > 10 * mv")} AS large_fiat,
  count(DISTINCT day) AS active_days, coalesce(bool_or(sheet = 'Margin Order'), false) AS leverage, {_n(f"category IN {_in(E.REWARDS)} OR tx_type IN {_in(E.REWARD_TYPES)}")} AS rewards, {_n("sheet = 'Card Transaction'")} AS card, {_n(f"token IN {_in(L.PRIVACY[:7])}")} AS privacy,
  {_n("lower(category) LIKE '%airdrop%'")} AS airdrops, {_n("gap < 300")} AS rapid, {_n("internal")} AS internal FROM o JOIN m USING (owner) GROUP BY 1),
q AS (SELECT g.*, max_per_day, coalesce(same_day, 0) AS same_day, coalesce(mean_held_h, span_days * 24.0) AS mean_held_h, coalesce(median_held_h, span_days * 24.0) AS median_held_h, n / span_days AS per_day, n / span_days * 7 AS per_week, n / active_days AS per_active_day, active_days / span_days AS activity
  FROM g JOIN d USING (owner) LEFT JOIN y USING (owner) LEFT JOIN hh USING (owner))"""
_ROUNDED = ["mean_amount", "mean_held_h", "median_held_h", "per_day", "per_week", "per_active_day", "activity"]
query("x13_behaviour", f"{_MEASURES} SELECT * REPLACE ({', '.join(f'round(CAST({c} AS DOUBLE), 6) AS {c}' for c in _ROUNDED)}) FROM q")(lambda t: E.behaviour(t.exchange).withColumns({c: F.round(c, 6) for c in _ROUNDED}))
query("x14_profiles", f"""{_MEASURES}, u AS ({" UNION ALL ".join(f"SELECT owner, '{k}' AS profile, CAST(least(100, {E.profile_sql(v)}) AS INT) AS score FROM q" for k, v in E.PROFILES.items())})
SELECT *, row_number() OVER (PARTITION BY owner ORDER BY score DESC, profile) AS rank FROM u WHERE score > 0""")(lambda t: E.profiles(E.behaviour(t.exchange)))
query("x36_velocity", f"""{WITH_E}, d AS (SELECT a.owner, a.token, a.row_id, min(w.ts_s) - min(a.ts_s) AS wait FROM e a JOIN e w ON w.owner = a.owner AND w.token = a.token AND w.ts_s > a.ts_s WHERE a.tx_type = 'deposit' AND w.tx_type = 'withdrawal' GROUP BY 1, 2, 3),
v AS (SELECT owner, token, sum(wait) / count(*) / 3600 AS mean_h, min(wait) / 3600 AS fastest_h FROM d GROUP BY 1, 2), k AS (SELECT owner, token, {_n("tx_type = 'deposit'")} AS deposits, {_n("tx_type = 'withdrawal'")} AS withdrawals FROM e GROUP BY 1, 2)
SELECT owner, token, deposits, withdrawals, round(mean_h, 6) AS mean_h, round(fastest_h, 6) AS fastest_h, mean_h < 1 AS hot FROM v JOIN k USING (owner, token)""")(lambda t: E.velocity(t.exchange).withColumns({c: F.round(c, 6) for c in ("mean_h", "fastest_h")}))
query("x23_exchange_summary", f"""{WITH_E}, g AS (SELECT owner, token, {_if("tx_type = 'swap' AND side = 'BUY'")} AS bought, {_if("tx_type = 'swap' AND side = 'SELL'")} AS sold, {_if("tx_type = 'fiat_deposit'")} AS fiat_in, {_if("tx_type = 'fiat_withdrawal'")} AS fiat_out, {_if("sheet = 'Card Transaction'")} AS card_spending FROM e GROUP BY 1, 2)
SELECT * FROM g WHERE bought > 0 OR sold > 0 OR fiat_in > 0 OR fiat_out > 0 OR card_spending > 0""")(lambda t: E.traded(t.exchange))
query("x23_pairs", f"""{WITH_E} SELECT owner, market, {_n("side = 'BUY'")} AS buys, {_n("side IS DISTINCT FROM 'BUY'")} AS sells, CAST(coalesce(sum(total_value) FILTER (side = 'BUY'), 0) AS DOUBLE) AS buy_volume, CAST(coalesce(sum(total_value) FILTER (side IS DISTINCT FROM 'BUY'), 0) AS DOUBLE) AS sell_volume
FROM e WHERE tx_type = 'swap' AND market <> '' GROUP BY 1, 2""")(lambda t: E.pairs(t.exchange))
query("x23_counterparties", f"""{WITH_E} SELECT owner, counterparty, count(*) AS n, {_if("tx_type = 'deposit'")} AS total_in, {_if("tx_type = 'withdrawal'")} AS total_out, array_to_string(list_sort(list(DISTINCT token)), ',') AS tokens, array_to_string(list_sort(list(DISTINCT sheet)), ',') AS sheets, min(ts_s) AS first_s, max(ts_s) AS last_s
FROM e WHERE counterparty <> '' GROUP BY 1, 2""")(lambda t: E.counterparties(t.exchange))
query("x23_inside_and_outside", f"""{WITH_E} SELECT owner, {_n("internal")} AS internal, {_n("tx_type = 'deposit' AND NOT internal")} AS external_deposits, {_n("tx_type = 'withdrawal' AND NOT internal")} AS external_withdrawals FROM e GROUP BY 1""")(lambda t: E.inside_and_outside(t.exchange))
query("x26_pay_counterparties", f"""{WITH_E} SELECT owner, counterparty, count(*) AS n, {_if("direction = 'IN'")} AS total_in, {_if("direction <> 'IN'")} AS total_out, array_to_string(list_sort(list(DISTINCT token)), ',') AS tokens, min(ts_s) AS first_s, max(ts_s) AS last_s FROM e WHERE sheet = 'Pay' AND counterparty <> '' GROUP BY 1, 2""")(lambda t: E.pay_counterparties(t.exchange))
query("x28_privacy_by_action", f"""{WITH_E} SELECT owner, token, {_n("tx_type = 'deposit'")} AS deposits, {_if("tx_type = 'deposit'")} AS deposited, {_n("tx_type = 'withdrawal'")} AS withdrawals, {_if("tx_type = 'withdrawal'")} AS withdrawn, {_n("tx_type = 'swap'")} AS trades, {_if("tx_type = 'swap'")} AS traded,
  count(DISTINCT from_address) FILTER (tx_type = 'deposit' AND from_address <> '') AS sources FROM e WHERE token IN {_in(L.PRIVACY)} GROUP BY 1, 2""")(lambda t: E.privacy_by_action(t.exchange))
query("x28_small_deposits", f"""{WITH_E}, k AS (SELECT owner, from_address, count(*) AS n, {S("amount")} AS total, arg_max(token, (ts_s, row_id)) AS token FROM e WHERE tx_type = 'deposit' AND from_address <> '' AND NOT internal GROUP BY 1, 2) SELECT * FROM k WHERE n >= 5 AND total / n < 70""")(lambda t: E.small_deposits(t.exchange, below=70.0))
query("x29_margin_orders", f"""{WITH_E}, m AS (SELECT * FROM e WHERE sheet = 'Margin Order'), k AS (SELECT owner, market, count(*) AS k FROM m WHERE status = 'FILLED' AND market <> '' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY k DESC, market) AS r FROM k),
a AS (SELECT owner, string_agg(market, ',' ORDER BY r) AS markets FROM r WHERE r <= 15 GROUP BY 1), g AS (SELECT owner, count(*) AS orders, {_n("status = 'FILLED'")} AS filled, {_n("status = 'CANCELED'")} AS cancelled, {_n("status = 'FILLED' AND side = 'BUY'")} AS buys, {_n("status = 'FILLED' AND side = 'SELL'")} AS sells FROM m GROUP BY 1)
SELECT g.*, coalesce(markets, '') AS markets FROM g LEFT JOIN a USING (owner)""")(lambda t: E.margin_orders(t.exchange))
query("x30_temporal", f"""{WITH_E}, o AS (SELECT *, {DAY} AS day, hour({TS}) AS h, isodow({TS}) - 1 AS wd FROM e), hc AS (SELECT owner, h, count(*) AS k FROM o GROUP BY 1, 2), hp AS (SELECT owner, arg_min(h, (-k, h)) AS peak_hour, max(k) AS peak_count FROM hc GROUP BY 1),
dc AS (SELECT owner, day, count(*) AS k FROM o GROUP BY 1, 2), dp AS (SELECT owner, count(*) AS active_days, count(*) FILTER (k > 20) AS burst_days, max(k) AS busiest FROM dc GROUP BY 1),
g AS (SELECT owner, count(*) AS n, {_n("wd >= 5")} AS weekend, {_n("h < 6")} AS night, CAST(floor((max(ts_s) - min(ts_s)) / 86400) + 1 AS BIGINT) AS span_days FROM o GROUP BY 1)
SELECT owner, n, weekend, round(weekend / n, 6) AS weekend_share, night, round(night / n, 6) AS night_share, peak_hour, peak_count, burst_days, busiest, active_days, span_days, round(active_days / span_days, 6) AS density FROM g JOIN hp USING (owner) JOIN dp USING (owner)""")(lambda t: E.temporal(t.exchange, 20))
query("x31_conversions", f"""{WITH_E} SELECT owner, CASE WHEN side = 'BUY' THEN quote_token ELSE token END AS src, CASE WHEN side = 'BUY' THEN token ELSE quote_token END AS dst, count(*) AS n, {S("amount")} AS volume FROM e WHERE tx_type = 'swap' AND token <> '' AND quote_token <> '' GROUP BY 1, 2, 3""")(lambda t: E.conversions(t.exchange))
query("x32_structuring", f"""{WITH_E}, t(threshold) AS (VALUES {", ".join(f"({v})" for v in E.THRESHOLDS)}), k AS (SELECT owner, {DAY} AS day, CASE WHEN tx_type IN ('deposit', 'fiat_deposit') THEN 'deposit' WHEN tx_type IN ('withdrawal', 'fiat_withdrawal') THEN 'withdrawal' END AS kind, CAST(floor(amount / 20) AS DECIMAL(18,2)) AS amount FROM e)
SELECT owner, day, kind, threshold, count(*) AS n, {S("amount")} AS total FROM k JOIN t ON amount >= threshold * 0.9 AND amount < threshold WHERE kind IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2""")(lambda t: E.structuring(t.exchange.withColumn("amount", F.floor(F.col("amount") / 20).cast("decimal(18,2)"))))
query("x32_frequent_amounts", f"""{WITH_E}, k AS (SELECT owner, CAST(round_even(CAST(floor(amount / 20) AS DOUBLE) / 100, 0) * 100 AS BIGINT) AS rounded, count(*) AS n FROM e WHERE floor(amount / 20) > 0 GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY n DESC, rounded) AS rank FROM k WHERE rounded > 0) WHERE rank <= 20""")(lambda t: E.frequent_amounts(t.exchange.withColumn("amount", F.floor(F.col("amount") / 20).cast("decimal(18,2)"))))
query("x35_peer_to_peer", f"""{WITH_E}, g AS (SELECT owner, count(*) AS n, {_n("sheet = 'P2P'")} AS trades, {_if("sheet = 'P2P'")} AS volume, {_if(f"sheet = 'P2P' AND token IN {_in(L.FIAT)}")} AS fiat_volume, count(DISTINCT counterparty) FILTER (sheet = 'P2P' AND counterparty <> '') AS partners,
  coalesce(array_to_string(list_sort(list(DISTINCT payment_method) FILTER (sheet = 'P2P' AND payment_method <> '')), ','), '') AS methods FROM e GROUP BY 1) SELECT *, round(trades / n, 6) AS share FROM g WHERE trades > 0""")(lambda t: E.peer_to_peer(t.exchange))
query("x37_fees", f"""{WITH_E} SELECT owner, coalesce(nullif(fee_coin, ''), 'UNKNOWN') AS fee_coin, {S("fee")} AS fees, count(*) AS n FROM e WHERE fee > 0 GROUP BY 1, 2""")(lambda t: E.fees(t.exchange))
query("x37_networks", f"""{WITH_E}, g AS (SELECT owner, network, {_n("tx_type = 'deposit'")} AS deposits, {_n("tx_type = 'withdrawal'")} AS withdrawals, {_if("tx_type = 'deposit'")} AS deposited, {_if("tx_type = 'withdrawal'")} AS withdrawn FROM e WHERE network <> '' GROUP BY 1, 2)
SELECT *, upper(network) IN {_in(E.HIGH_RISK_NETWORKS)} AS high_risk FROM g WHERE deposits + withdrawals > 0""")(lambda t: E.networks(t.exchange))
query("x25_external_addresses", f"""{WITH_E} SELECT lower(from_address) AS address, tx_type, count(*) AS n, {S("amount")} AS total, count(DISTINCT owner) AS owners, min(ts_s) AS first_s, max(ts_s) AS last_s FROM e WHERE tx_type IN ('deposit', 'withdrawal') AND from_address <> '' AND NOT internal GROUP BY 1, 2""")(lambda t: E.external_addresses(t.exchange))
_IN, _OUT = "tx_type IN ('deposit', 'fiat_deposit', 'buy')", "tx_type IN ('withdrawal', 'fiat_withdrawal', 'sell')"
query("x22_totals", f"""{WITH_E} SELECT owner, count(*) AS n, {_if(f"token IN {_in(L.FIAT)} AND {_IN}")} AS fiat_in, {_if(f"token IN {_in(L.FIAT)} AND {_OUT}")} AS fiat_out, {_if(f"token NOT IN {_in(L.FIAT)} AND {_IN}")} AS tokens_in, {_if(f"token NOT IN {_in(L.FIAT)} AND {_OUT}")} AS tokens_out,
  count(DISTINCT counterparty) FILTER (counterparty <> '') AS counterparties FROM e GROUP BY 1""")(lambda t: E.totals(t.exchange))
query("x39_portfolio", f"""{WITH_E}, g AS (SELECT owner, token, count(*) AS n, {_if(f"{_IN} OR (tx_type = 'swap' AND side = 'BUY')")} AS inflow, {_if(f"{_OUT} OR (tx_type = 'swap' AND side = 'SELL')")} AS outflow, CAST(coalesce(sum(abs(fiat_value)), 0) AS DOUBLE) AS fiat_value, token IN {_in(L.KNOWN)} AS known FROM e WHERE token <> '' GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY n DESC, token) AS rank FROM g) WHERE rank <= 15""")(lambda t: E.portfolio(t.exchange, L.KNOWN))
query("x39_operations", f"""{WITH_E}, g AS (SELECT owner, tx_type, count(*) AS n, {S("amount")} AS volume FROM e GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY n DESC, tx_type) AS rank FROM g) WHERE rank <= 15""")(lambda t: E.operations(t.exchange))

_PLACE = "CASE k % 9 WHEN 0 THEN 'DE Berlin' WHEN 1 THEN 'FR Paris' WHEN 2 THEN 'Unknown' WHEN 3 THEN NULL WHEN 4 THEN 'PL Gdynia' ELSE 'PL Warsaw' END"
_LOG = f"{WITH_C}, l AS (SELECT concat('u', CAST(subscriber AS VARCHAR)) AS owner, CAST(floor(epoch(ts)) AS BIGINT) AS ts_s, concat('10.0.', CAST(k % 7 AS VARCHAR), '.', CAST(event_id % 3 AS VARCHAR)) AS ip, {_PLACE} AS place, record_type AS client FROM c)"


def _log(t):
    return t.cdr.select(F.concat(F.lit("u"), F.col("subscriber").cast("string")).alias("owner"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts_s"), F.concat(F.lit("10.0."), (F.col("k") % 7).cast("string"), F.lit("."), (F.col("event_id") % 3).cast("string")).alias("ip"), F.expr(_PLACE).alias("place"), F.col("record_type").alias("client"))


query("x24_access_log", f"""{_LOG}, p AS (SELECT owner, place, count(*) AS k FROM l WHERE place LIKE '% %' GROUP BY 1, 2), m AS (SELECT owner, split_part(arg_min(place, (-k, place)), ' ', 1) AS country FROM p GROUP BY 1),
d AS (SELECT owner, count(*) FILTER (ips > 3) AS multi_ip_days FROM (SELECT owner, {DAY} AS day, count(DISTINCT ip) AS ips FROM l GROUP BY 1, 2) GROUP BY 1)
SELECT owner, count(*) AS logins, count(DISTINCT ip) AS ips, count(DISTINCT place) AS places, count(DISTINCT client) AS clients, min(ts_s) AS first_s, max(ts_s) AS last_s, max(country) AS country, count(*) FILTER (country IS NOT NULL AND NOT starts_with(coalesce(place, ''), country)) AS foreign_logins, max(multi_ip_days) AS multi_ip_days
FROM l LEFT JOIN m USING (owner) JOIN d USING (owner) GROUP BY 1""")(lambda t: E.access_log(_log(t)))
query("x24_login_hours", f"{_LOG}, g AS (SELECT owner, hour({TS}) AS hour, count(*) AS n FROM l GROUP BY 1, 2) SELECT *, round(n / sum(n) OVER (PARTITION BY owner), 4) AS share FROM g")(lambda t: E.login_hours(_log(t)))
query("x38_many_countries", f"""{_LOG} SELECT owner, {DAY} AS day, count(DISTINCT split_part(place, ' ', 1)) AS countries, count(*) AS logins, array_to_string(list_sort(list(DISTINCT split_part(place, ' ', 1))), ',') AS names FROM l WHERE place IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT split_part(place, ' ', 1)) >= 3""")(lambda t: E.many_countries(_log(t)))
_PREFIXES = [("1", "US"), ("48", "PL"), ("44", "GB"), ("49", "DE"), ("33", "FR"), ("34", "ES")]


@query("x21_phones_in_text", rf"""WITH p(prefix, country) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _PREFIXES)}),
f AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\+\d{{1,3}}[ -]?(?:\(\d{{1,4}}\)|\d{{2,4}})(?:[ -]?\d{{2,4}}){{1,3}}'))) AS found FROM documents),
n AS (SELECT DISTINCT doc_id, concat('+', regexp_replace(found, '\D', '', 'g')) AS number FROM f),
r AS (SELECT doc_id, number, country, row_number() OVER (PARTITION BY doc_id, number ORDER BY length(prefix) DESC NULLS LAST) AS r FROM n LEFT JOIN p ON starts_with(substr(number, 2), prefix))
SELECT doc_id, number, coalesce(country, 'unknown') AS country FROM r WHERE r = 1""")
def x21(t):
    return E.phones_in(t("documents"), "doc_id", "text", t.spark.createDataFrame(_PREFIXES, "prefix string, country string"))


query("x19_chain_balance", f"""{WITH_X}, d AS (SELECT from_address AS address, token, {DAY} AS day, -amount AS delta FROM x UNION ALL SELECT to_address, token, {DAY}, amount FROM x), g AS (SELECT address, token, day, sum(delta) AS delta FROM d GROUP BY 1, 2, 3)
SELECT address, token, day, CAST(sum(delta) OVER (PARTITION BY address, token ORDER BY day ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS balance FROM g""")(lambda t: E.chain_balance(t.transfers))

query("x20_month_flows", f"""{WITH_E} SELECT owner, strftime({DAY}, '%Y-%m') AS month, {_if(f"token IN {_in(L.FIAT)} AND tx_type IN ('deposit', 'fiat_deposit')")} AS fiat_in, {_if(f"token IN {_in(L.FIAT)} AND tx_type NOT IN ('deposit', 'fiat_deposit')")} AS fiat_out,
  {", ".join(f"CAST(coalesce(sum(fiat_value) FILTER (tx_type = '{k}'), 0) AS DOUBLE) AS {c}" for k, c in (("buy", "bought"), ("sell", "sold"), ("withdrawal", "moved_out")))}, {_if("tx_type = 'deposit'")} AS received, {_if("tx_type = 'withdrawal'")} AS sent, count(*) AS n FROM e GROUP BY 1, 2""")(lambda t: E.month_flows(t.exchange))
query("x20_daily_types", f"{WITH_E}, d AS (SELECT owner, {DAY} AS day, tx_type FROM e) SELECT owner, day, tx_type, count(*) AS n FROM d GROUP BY GROUPING SETS ((owner, day, tx_type), (owner, day))")(lambda t: E.daily_types(t.exchange))


_EIF = "CAST(sum(CASE WHEN {} THEN amount ELSE 0 END) AS DOUBLE)".format
_CURRENCY = "CASE quote_token WHEN 'Q1' THEN 'EUR' WHEN 'Q2' THEN 'USD' ELSE 'PLN' END"
_FLOW = f"""{WITH_E}, v AS (SELECT owner, lower(tx_type) AS kind, concat('TOKEN:', coalesce(nullif(token, ''), 'UNKNOWN')) AS tok, concat('FIAT:', {_CURRENCY}) AS fiat, coalesce(abs(fiat_value), 0) AS v FROM e),
f AS (SELECT owner, fiat AS src, tok AS dst, v FROM v WHERE kind = 'buy' UNION ALL SELECT owner, tok, fiat, v FROM v WHERE kind = 'sell' UNION ALL SELECT owner, tok, 'EXTERNAL', v FROM v WHERE kind = 'withdrawal'
  UNION ALL SELECT owner, 'STAKING', tok, v FROM v WHERE kind IN ('staking_reward', 'learn_reward')),
flow AS (SELECT owner, src, dst, count(*) AS n, CAST(sum(v) AS DOUBLE) AS total FROM f GROUP BY 1, 2, 3)"""


def _flow(t):
    return E.exchange_flow(t.exchange, F.when(F.col("quote_token") == "Q1", "EUR").when(F.col("quote_token") == "Q2", "USD"))


query("x16_exchange_flow", f"{_FLOW} SELECT * FROM flow")(_flow)
query("x16_exchange_nodes", f"""{_FLOW} SELECT owner, node, CAST(sum(n) AS BIGINT) AS n, sum(i) AS total_in, sum(o) AS total_out, lower(split_part(node, ':', 1)) AS kind
FROM (SELECT owner, src AS node, n, 0.0 AS i, total AS o FROM flow UNION ALL SELECT owner, dst, n, total, 0.0 FROM flow) GROUP BY 1, 2""")(lambda t: E.exchange_flow_nodes(_flow(t)))
query("x33_wash_trades", f"""{WITH_E}, s AS (SELECT *, coalesce(side, '') AS way, row_number() OVER (PARTITION BY owner ORDER BY ts_s, row_id) AS i FROM e WHERE tx_type = 'swap' AND market <> '')
SELECT a.owner, a.market, a.row_id AS first_id, b.row_id AS second_id, b.ts_s - a.ts_s AS seconds FROM s a JOIN s b ON a.owner = b.owner AND a.market = b.market AND a.way <> b.way AND b.i > a.i AND b.ts_s - a.ts_s <= 21600""")(lambda t: E.wash_trades(t.exchange, 21_600, ahead=None))
query("x33_wash_ratio", f"""{WITH_E}, g AS (SELECT owner, coalesce(market, '') AS market, {_EIF("side = 'BUY'")} AS bought, {_EIF("side = 'SELL'")} AS sold FROM e WHERE tx_type = 'swap' GROUP BY 1, 2)
SELECT *, round(abs(bought - sold) / (bought + sold), 6) AS ratio FROM g WHERE bought > 0 AND sold > 0 AND abs(bought - sold) / (bought + sold) < 0.1""")(lambda t: E.wash_markets(t.exchange))
query("x34_fiat_currencies", f"""{WITH_E} SELECT owner, token, {_EIF("tx_type = 'fiat_deposit'")} AS fiat_in, {_EIF("tx_type = 'fiat_withdrawal'")} AS fiat_out FROM e WHERE tx_type IN ('fiat_deposit', 'fiat_withdrawal') GROUP BY 1, 2""")(lambda t: E.fiat_currencies(t.exchange))
query("x34_fiat_ramp", f"""{WITH_E}, g AS (SELECT owner, round({_EIF("tx_type = 'fiat_deposit'")}, 2) AS fiat_in, round({_EIF("tx_type = 'fiat_withdrawal'")}, 2) AS fiat_out, count(*) FILTER (tx_type = 'fiat_deposit') AS deposits, count(*) FILTER (tx_type = 'fiat_withdrawal') AS withdrawals,
  min(ts_s) FILTER (tx_type = 'fiat_deposit') AS first_deposit_s, min(ts_s) FILTER (tx_type = 'withdrawal' AND NOT internal) AS first_withdrawal_s, count(*) FILTER (sheet = 'P2P') AS p2p FROM e GROUP BY 1)
SELECT *, round(fiat_in - fiat_out, 2) AS net, (first_withdrawal_s - first_deposit_s) / 3600 AS hours FROM g""")(lambda t: E.fiat_ramp(t.exchange))
