"""Queries over bank transactions, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bank as B
from ..operators import reconcile as R
from .tables import WITH_B

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


CR, DB = "CASE WHEN direction = 'CREDIT' THEN amount ELSE 0 END", "CASE WHEN direction = 'DEBIT' THEN amount ELSE 0 END"
D = "CAST({} AS DOUBLE)".format
MONTH = "strftime(booking_date, '%Y-%m')"

_LISTED = lambda c, v, name: f"{name} AS (SELECT account_id, month, string_agg(concat(k, '=', CAST(v AS VARCHAR)), ';' ORDER BY k) AS {name} FROM (SELECT account_id, {MONTH} AS month, {c} AS k, {v} AS v FROM b GROUP BY 1, 2, 3) GROUP BY 1, 2)"


@query("a30_monthly_baseline", f"""{WITH_B}, {_LISTED("channel", "count(*)", "channels")}, {_LISTED("category", "CAST(floor(sum(amount)) AS BIGINT)", "categories")},
g AS (SELECT account_id, {MONTH} AS month, count(*) AS tx_count, {D(f"sum({CR})")} AS total_credit, {D(f"sum({DB})")} AS total_debit,
  count(DISTINCT lower(counterparty)) AS counterparties, CAST(sum(amount) AS DOUBLE) / count(*) AS mean_amount,
  round(coalesce(stddev_samp(CAST(amount AS DOUBLE)), 0), 4) AS std_amount, round(median(CAST(amount AS DOUBLE)), 4) AS median_amount,
  list_sort(list(CAST(amount AS DOUBLE)))[least(CAST(floor(count(*) * 0.95) AS BIGINT), count(*) - 1) + 1] AS p95_amount FROM b GROUP BY 1, 2)
SELECT * FROM g JOIN channels USING (account_id, month) JOIN categories USING (account_id, month)""")
def a30(t):
    text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), F.floor(e["value"]).cast("string"))), ";")
    return B.monthly_baseline(t.bank).withColumns({"channels": text("channels"), "categories": text("categories")})


query("a31_large_outliers", f"""{WITH_B}, s AS (SELECT account_id, avg(CAST(amount AS DOUBLE)) AS m, stddev_samp(CAST(amount AS DOUBLE)) AS s FROM b GROUP BY 1)
SELECT account_id, tx_id, {D("amount")} AS amount, round((amount - m) / s, 4) AS zscore, CASE WHEN (amount - m) / s > 4 THEN 'high' ELSE 'medium' END AS severity
FROM b JOIN s USING (account_id) WHERE s > 0 AND (CAST(amount AS DOUBLE) - m) / s > 1.6""")(lambda t: B.large_outliers(t.bank, z=1.6))

query("a32_new_counterparty_large", f"""{WITH_B}, p AS (SELECT account_id, CAST(sum({DB}) AS DOUBLE) / count(DISTINCT {MONTH}) AS l FROM b WHERE booking_date < DATE '2024-03-01' GROUP BY 1)
SELECT account_id, tx_id, counterparty, {D("amount")} AS amount FROM b JOIN p USING (account_id)
WHERE booking_date >= DATE '2024-03-01' AND l > 0 AND amount > l * 0.01
  AND NOT EXISTS (SELECT 1 FROM b o WHERE o.account_id = b.account_id AND o.counterparty = b.counterparty AND o.booking_date < DATE '2024-03-01')""")(
    lambda t: B.new_counterparty_large(t.bank, F.lit("2024-03-01").cast("date"), share=0.01)
)


def _burst(channel: str, days: int, least: int) -> str:
    return f"""{WITH_B}, d AS (SELECT account_id, booking_date, count(*) AS n, sum(amount) AS s FROM b WHERE channel = '{channel}' GROUP BY 1, 2),
w AS (SELECT a.account_id, a.booking_date, CAST(sum(o.n) AS BIGINT) AS tx_count, round(CAST(sum(o.s) AS DOUBLE), 2) AS total
  FROM d a JOIN d o ON a.account_id = o.account_id AND o.booking_date BETWEEN a.booking_date AND a.booking_date + {days} GROUP BY 1, 2)
SELECT account_id, booking_date AS first_day, tx_count, total FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY booking_date) AS r FROM w WHERE tx_count >= {least}) WHERE r = 1"""


query("a33_p2p_burst", _burst("BLIK_P2P", 7, 5))(lambda t: B.first_burst(t.bank, "BLIK_P2P", 7, 5))
query("a34_cash_cluster", _burst("CASH", 3, 3))(lambda t: B.first_burst(t.bank, "CASH", 3, 3))

query("a35_spending_over_income", f"""{WITH_B}, m AS (SELECT account_id, {MONTH} AS month, {D(f"sum({CR})")} AS credit, {D(f"sum({DB})")} AS debit FROM b GROUP BY 1, 2)
SELECT account_id, month, credit, debit, round(debit / credit, 4) AS ratio, CASE WHEN debit / credit > 1.5 THEN 'high' ELSE 'medium' END AS severity
FROM m WHERE credit > 0 AND debit / credit > 1.2""")(lambda t: B.spending_over_income(t.bank))

_F = f"""{WITH_B}, n AS (SELECT account_id, counterparty, count(*) AS cp_n, min(tx_id) AS first_id FROM b GROUP BY 1, 2),
m AS (SELECT account_id, max(cp_n) AS most FROM n GROUP BY 1),
f AS (SELECT account_id, tx_id, ln(1 + CAST(amount AS DOUBLE)) AS f_amount, (isodow(booking_date) - 1) / 6.0 AS f_dow, day(booking_date) / 31.0 AS f_dom,
  CASE WHEN direction = 'CREDIT' THEN 1.0 ELSE 0.0 END AS f_credit, CASE WHEN tx_id = first_id THEN 1.0 ELSE 0.0 END AS f_new, cp_n / most AS f_frequency,
  {", ".join(f"CASE WHEN channel = '{c}' THEN 1.0 ELSE 0.0 END AS f_{c.lower()}" for c in B.CHANNELS)}
  FROM b JOIN n USING (account_id, counterparty) JOIN m USING (account_id))"""
_NAMES = ["f_amount", "f_dow", "f_dom", "f_credit", "f_new", "f_frequency", *(f"f_{c.lower()}" for c in B.CHANNELS)]


@query("a36_features", f"{_F} SELECT account_id, tx_id, {', '.join(f'round(CAST({c} AS DOUBLE), 6) AS {c}' for c in _NAMES)} FROM f")
def a36(t):
    out = B.features(t.bank)
    return out.select("account_id", "tx_id", *(F.round(c, 6).alias(c) for c in _NAMES))


query("a37_centroid_anomaly", f"""{_F}, s AS (SELECT account_id, count(*) AS n, {", ".join(f"avg({c}) AS m_{c}, coalesce(stddev_samp({c}), 0) AS s_{c}" for c in _NAMES)} FROM f GROUP BY 1),
d AS (SELECT account_id, tx_id, n, round(sqrt({" + ".join(f"CASE WHEN s_{c} > 1e-9 THEN pow(({c} - m_{c}) / s_{c}, 2) ELSE 0 END" for c in _NAMES)}), 6) AS distance FROM f JOIN s USING (account_id) WHERE n >= 10),
r AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY distance, tx_id) - 1 AS place, max(distance) OVER (PARTITION BY account_id) AS most FROM d),
k AS (SELECT account_id, distance AS cut FROM r WHERE place = least(CAST(floor(n * (1 - 0.05)) AS BIGINT), n - 1))
SELECT account_id, tx_id, distance, round(distance / most, 6) AS score FROM r JOIN k USING (account_id) WHERE distance > cut""")(lambda t: B.centroid_anomaly(B.features(t.bank)))


def _tags(t):
    return t.bank.where("category <> 'everyday'").select("account_id", F.col("category").alias("tag"), "amount", "tx_id")


@query("a17_risk_score", f"""{WITH_B}, w(tag, weight) AS (VALUES ('GAMBLING', 30.0), ('LOANS', 30.0), ('CRYPTO', 25.0)),
a AS (SELECT account_id, CAST(sum(amount) AS DOUBLE) AS total FROM b GROUP BY 1),
g AS (SELECT account_id, upper(category) AS tag, CAST(sum(amount) AS DOUBLE) / max(total) * 100 AS pct FROM b JOIN a USING (account_id) WHERE category <> 'everyday' GROUP BY 1, 2)
SELECT account_id, round(least(sum(CASE WHEN pct < 10 THEN least(weight, weight * pct / 10) ELSE weight END), 100), 4) AS score, count(*) AS reasons FROM g JOIN w USING (tag) GROUP BY 1""")
def a17(t):
    weights = t.spark.createDataFrame([("GAMBLING", 30.0), ("LOANS", 30.0), ("CRYPTO", 25.0)], "tag string, weight double")
    return B.risk_score(_tags(t), weights, t.bank.groupBy("account_id").agg(B.money("amount").alias("total")))


query("a38_risk_evidence", f"""{WITH_B} SELECT account_id, category AS tag, count(*) AS n, array_to_string(list_sort(list(tx_id))[1:10], ',') AS tx_ids FROM b WHERE category <> 'everyday' GROUP BY 1, 2""")(lambda t: B.evidence(_tags(t)))
query("a39_income_table", f"""{WITH_B}, m AS (SELECT account_id, {MONTH} AS month, {D(f"sum({CR})")} AS income, {D(f"sum({DB})")} AS expense, count(*) AS n FROM b GROUP BY GROUPING SETS ((account_id, {MONTH}), (account_id)))
SELECT *, round(CASE WHEN income > 0 THEN expense / income END, 4) AS ratio FROM m""")(lambda t: B.income_table(t.bank))
query("a40_loan_groups", f"""{WITH_B} SELECT account_id, counterparty, count(*) AS n, {D("sum(amount)")} AS total,
  count(*) >= 2 AND var_pop(CAST(amount AS DOUBLE)) < pow(avg(CAST(amount AS DOUBLE)) * 0.1, 2) AS fixed_instalment FROM b WHERE category = 'loans' GROUP BY 1, 2""")(lambda t: B.loan_groups(t.bank))
query("a41_cash_pattern", f"""{WITH_B}, g AS (SELECT *, booking_date - lag(booking_date) OVER (PARTITION BY account_id ORDER BY booking_date, tx_id) AS gap FROM b WHERE channel = 'CASH'),
a AS (SELECT account_id, count(*) AS n, {D(f"sum({CR})")} AS deposited, {D(f"sum({DB})")} AS withdrawn, round(avg(gap), 4) AS mean_gap,
  round(avg(CASE WHEN amount % 100 = 0 THEN 1.0 ELSE 0.0 END), 4) AS round_share, count(*) FILTER (direction = 'CREDIT' AND amount >= 10000) AS large_deposits,
  count(*) FILTER (direction = 'CREDIT' AND amount >= 9000 AND amount < 10000) AS structuring FROM g GROUP BY 1)
SELECT *, CASE WHEN mean_gap IS NULL THEN 'single' WHEN mean_gap <= 7 THEN 'weekly' WHEN mean_gap <= 14 THEN 'fortnightly' WHEN mean_gap <= 35 THEN 'monthly' ELSE 'rare' END AS frequency FROM a""")(lambda t: B.cash_pattern(t.bank))
query("a42_p2p_balance", f"""{WITH_B} SELECT account_id, counterparty, count(*) AS n, {D(f"sum({CR})")} AS received, {D(f"sum({DB})")} AS sent, round({D(f"sum({CR})")} - {D(f"sum({DB})")}, 2) AS balance,
  CASE WHEN bool_and(direction = 'DEBIT') THEN 'all_out' WHEN bool_and(direction = 'CREDIT') THEN 'all_in' ELSE 'both' END AS kind FROM b WHERE channel = 'BLIK_P2P' GROUP BY 1, 2""")(lambda t: B.p2p_balance(t.bank))
query("a44_calendar_profile", f"""{WITH_B}, d AS (SELECT *, isodow(booking_date) - 1 AS weekday, CASE WHEN day(booking_date) <= 10 THEN '1-10' WHEN day(booking_date) <= 20 THEN '11-20' ELSE '21-31' END AS third FROM b)
SELECT account_id, weekday, third, count(*) AS n, {D("sum(amount)")} AS total FROM d GROUP BY GROUPING SETS ((account_id, weekday), (account_id, third))""")(lambda t: B.calendar_profile(t.bank).withColumn("weekday", F.col("weekday").cast("long")))
query("a44_weekend_ratio", f"""{WITH_B}, w AS (SELECT account_id, {D("sum(CASE WHEN isodow(booking_date) >= 6 THEN amount ELSE 0 END)")} AS weekend, {D("sum(CASE WHEN isodow(booking_date) < 6 THEN amount ELSE 0 END)")} AS week FROM b GROUP BY 1)
SELECT account_id, weekend, week, round(weekend / week, 4) AS ratio, weekend / week > 0.5 AS weekend_heavy FROM w""")(lambda t: B.weekend_ratio(t.bank))
query("a45_summary", f"""{WITH_B} SELECT account_id, count(*) AS n, {D(f"sum({CR})")} AS credit, {D(f"sum({DB})")} AS debit, count(*) FILTER (direction = 'CREDIT') AS credits, min(booking_date) AS first_day,
  max(booking_date) AS last_day, count(DISTINCT counterparty) AS counterparties, {D("max(amount)")} AS largest FROM b GROUP BY 1""")(lambda t: B.summary(t.bank))


def _top(column: str, n: int) -> str:
    return f"""{WITH_B}, g AS (SELECT account_id, {column}, count(*) AS n, {D("sum(amount)")} AS total FROM b GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY total DESC, {column}) AS rank FROM g) WHERE rank <= {n}"""


query("a45_flagged", f"""{WITH_B} SELECT * FROM (SELECT account_id, tx_id, booking_date, category, counterparty, {D("amount")} AS amount, row_number() OVER (PARTITION BY account_id ORDER BY amount DESC, tx_id) AS rank FROM b WHERE category IN ('gambling', 'crypto', 'loans')) WHERE rank <= 20""")(lambda t: B.flagged(t.bank, ["gambling", "crypto", "loans"]))
query("a45_top_categories", _top("category", 12))(lambda t: B.rollup_by(t.bank, "category", 12))
query("a45_top_counterparties", _top("counterparty", 20))(lambda t: B.rollup_by(t.bank, "counterparty", 20))
query("a69_by_counterparty", _top("counterparty", 50))(lambda t: B.rollup_by(t.bank, "counterparty", 50))
query("a46_enrichment_rollup", f"""{WITH_B} SELECT account_id, channel, category, count(*) AS n, {D(f"sum({CR})")} AS credit, {D(f"sum({DB})")} AS debit FROM b GROUP BY GROUPING SETS ((account_id, channel), (account_id, category), (account_id))""")(lambda t: B.enrichment_rollup(t.bank))
query("a47_recurring", f"""{WITH_B} SELECT account_id, concat_ws('|', lower(counterparty), regexp_replace(lower(counterparty), '[^a-z]+', '', 'g')) AS name, count(*) AS n, {D("sum(amount)")} AS total,
  CAST(sum(amount) AS DOUBLE) / count(*) AS mean, {D("min(amount)")} AS least, {D("max(amount)")} AS most, array_to_string(list_sort(list(DISTINCT strftime(booking_date, '%Y-%m-%d'))), ',') AS days FROM b GROUP BY 1, 2 HAVING count(*) >= 2""")(lambda t: B.recurring(t.bank))

_R = f"""{WITH_B}, r AS (SELECT *, CAST(sum(CASE WHEN direction = 'CREDIT' THEN amount ELSE -amount END) OVER (PARTITION BY account_id ORDER BY booking_date, tx_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS balance,
  booking_date - lag(booking_date) OVER (PARTITION BY account_id ORDER BY booking_date, tx_id) AS gap_days FROM b)"""
query("a48_running_balance", f"{_R} SELECT account_id, tx_id, booking_date, balance, gap_days, coalesce(gap_days > 5, false) AS gap FROM r")(lambda t: B.running_balance(t.bank).withColumn("gap_days", F.col("gap_days").cast("long")))
query("a49_top_and_other", f"""{WITH_B}, g AS (SELECT account_id, counterparty, sum(amount) AS total, count(*) AS n FROM b GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY total DESC, counterparty) AS k FROM g)
SELECT account_id, CASE WHEN k <= 10 THEN counterparty ELSE 'other' END AS label, {D("sum(total)")} AS total, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1, 2""")(lambda t: B.top_and_other(t.bank))
query("a50_pivot_months", f"""{WITH_B} SELECT account_id, {MONTH} AS month, {D(f"sum({CR})")} AS credit, {D(f"sum({DB})")} AS debit FROM b GROUP BY 1, 2""")(lambda t: B.pivot_months(t.bank))

_S = f"""{_R}, s AS (SELECT account_id, {MONTH} AS month, min(booking_date) AS period_from, max(booking_date) AS period_to,
  round(arg_min(balance - CAST(CASE WHEN direction = 'CREDIT' THEN amount ELSE -amount END AS DOUBLE), (booking_date, tx_id)), 2) AS opening, round(arg_max(balance, (booking_date, tx_id)), 2) AS closing,
  {D(f"sum({CR})")} AS credit, {D(f"sum({DB})")} AS debit, count(*) AS n FROM r GROUP BY 1, 2)"""
query("f8_statements", f"{_S} SELECT * FROM s")(lambda t: B.statements(t.bank))
query("a51_cross_account", f"""{_S} SELECT account_id, round(sum(credit), 2) AS credit, round(sum(debit), 2) AS debit, CAST(sum(n) AS BIGINT) AS n, arg_min(opening, period_from) AS opening, arg_max(closing, period_to) AS closing, count(*) AS statements FROM s GROUP BY 1""")(lambda t: B.cross_account(B.statements(t.bank)))
query("a65_balance_identity", f"""{_S} SELECT account_id, month, round(opening + credit - debit - closing, 2) + 0.0 AS difference, abs(round(opening + credit - debit - closing, 2)) <= 0.01 AS holds FROM s""")(lambda t: B.balance_identity(B.statements(t.bank)).withColumn("difference", F.col("difference") + F.lit(0.0)))
query("a66_statement_chain", f"""{_S}, l AS (SELECT *, lead(period_from) OVER w AS nf, lead(opening) OVER w AS no FROM s WINDOW w AS (PARTITION BY account_id ORDER BY period_from, month))
SELECT account_id, month, nf - period_to AS days, CASE WHEN nf - period_to > 1 THEN 'gap' WHEN nf - period_to < 1 THEN 'overlap' ELSE 'none' END AS dates, abs(closing - no) > 0.01 AS balance_break FROM l WHERE nf IS NOT NULL""")(
    lambda t: B.statement_chain(B.statements(t.bank)).withColumn("days", F.col("days").cast("long"))
)


def _near_amounts(t):
    """Amounts in whole thousands, so that equal ones occur."""
    return t.bank.withColumn("amount", F.floor(F.col("amount") / 1000).cast("decimal(18,2)"))


_TITLE = "CASE tx_id % 6 WHEN 0 THEN 'Przelew  własny' WHEN 1 THEN 'przelew wewnętrzny' WHEN 2 THEN 'między rachunkami' WHEN 3 THEN 'własny' END"
query("a53_internal_by_amount", f"""{WITH_B}, a AS (SELECT account_id, tx_id, booking_date, direction, floor(amount / 1000) AS amount, tx_id % 6 <= 2 AS hint FROM b),
p AS (SELECT d.tx_id AS debit_id, c.tx_id AS credit_id, d.account_id AS from_account, c.account_id AS to_account, d.amount, d.hint, abs(c.booking_date - d.booking_date) AS far
  FROM a d JOIN a c ON d.amount = c.amount AND d.account_id <> c.account_id AND abs(c.booking_date - d.booking_date) <= 1 WHERE d.direction = 'DEBIT' AND c.direction = 'CREDIT')
SELECT debit_id, credit_id, from_account, to_account, {D("amount")} AS amount, CAST(round(CASE WHEN hint THEN 0.85 ELSE 0.6 END + CASE WHEN far = 0 THEN 0.1 ELSE 0.0 END, 2) AS DOUBLE) AS confidence, CASE WHEN hint THEN 'title_match' ELSE 'amount_date' END AS method
FROM (SELECT *, row_number() OVER (PARTITION BY debit_id ORDER BY far, credit_id) AS r FROM p) WHERE r = 1""")(lambda t: B.internal_by_amount(_near_amounts(t).withColumn("title", F.expr(_TITLE)), title="title").withColumn("confidence", F.col("confidence").cast("double")))


@query("a52_internal_by_account", f"""{WITH_B}, a AS (SELECT account_id, tx_id, booking_date, direction, floor(amount / 1000) AS amount, account_id + tx_id % 3 - 1 AS named FROM b)
SELECT debit_id, credit_id, from_account, to_account, far AS days FROM (SELECT *, row_number() OVER (PARTITION BY debit_id ORDER BY far, credit_id) AS r FROM (
  SELECT d.tx_id AS debit_id, c.tx_id AS credit_id, d.account_id AS from_account, c.account_id AS to_account, abs(c.booking_date - d.booking_date) AS far
  FROM a d JOIN a c ON c.account_id = d.named AND c.account_id <> d.account_id AND abs(d.amount - c.amount) <= 0.02 AND abs(c.booking_date - d.booking_date) <= 3
  WHERE d.direction = 'DEBIT' AND c.direction = 'CREDIT')) WHERE r = 1""")
def a52(t):
    a = _near_amounts(t).select("account_id", "tx_id", "booking_date", "direction", "amount")
    debits = a.where("direction = 'DEBIT'").withColumn("named", F.col("account_id") + F.col("tx_id") % 3 - 1)
    return B.internal_by_account(debits, a.where("direction = 'CREDIT'")).withColumn("days", F.col("days").cast("long"))


query("a54_shared_counterparties", f"""{WITH_B} SELECT counterparty, count(DISTINCT account_id) AS accounts, count(*) AS n, {D("sum(amount)")} AS total FROM b GROUP BY 1 HAVING count(DISTINCT account_id) >= 2""")(lambda t: B.shared_counterparties(t.bank))

_E = f"""{WITH_B}, e AS (SELECT CASE WHEN direction = 'CREDIT' THEN concat('cp:', counterparty) ELSE concat('acc:', CAST(account_id AS VARCHAR)) END AS src,
  CASE WHEN direction = 'CREDIT' THEN concat('acc:', CAST(account_id AS VARCHAR)) ELSE concat('cp:', counterparty) END AS dst, channel AS edge_type, count(*) AS n, {D("sum(amount)")} AS total,
  min(booking_date) AS first_day, max(booking_date) AS last_day, array_to_string(list_sort(list(tx_id))[1:20], ',') AS tx_ids FROM b GROUP BY 1, 2, 3),
v AS (SELECT *, CASE category WHEN 'gambling' THEN 3 WHEN 'crypto' THEN 2 WHEN 'loans' THEN 2 WHEN 'risky' THEN 1 ELSE 0 END AS level, CASE channel WHEN 'BLIK_P2P' THEN 'person' WHEN 'CASH' THEN 'cash' WHEN 'FEE' THEN 'bank' ELSE 'merchant' END AS kind FROM b),
n AS (SELECT concat('cp:', counterparty) AS node, max(kind) AS kind, max(level) AS risk, count(*) AS n, arg_max(category, (level, category)) AS cluster FROM v GROUP BY 1 UNION ALL SELECT concat('acc:', CAST(account_id AS VARCHAR)), 'account', max(level), count(*), arg_max(category, (level, category)) FROM v GROUP BY 1)"""
query("a57_flow_edges", f"{_E} SELECT * FROM e")(lambda t: B.flow_edges(t.bank))
query("a57_flow_nodes", f"{_E} SELECT * FROM n")(lambda t: B.flow_nodes(t.bank))
query("a59_filter_graph", f"""{_E} SELECT * FROM n WHERE node IN (SELECT unnest([src, dst]) FROM e WHERE src IN (SELECT node FROM n WHERE risk >= 3) OR dst IN (SELECT node FROM n WHERE risk >= 3))""")(lambda t: B.filter_graph(B.flow_nodes(t.bank), B.flow_edges(t.bank), 3))
query("a61_touch_counterparties", f"""{WITH_B} SELECT counterparty, count(*) AS times_seen, {D("sum(amount)")} AS total, min(booking_date) AS first_seen, max(booking_date) AS last_seen, array_to_string(list_sort(list(DISTINCT channel)), ',') AS sources FROM b GROUP BY 1""")(lambda t: B.touch_counterparties(t.bank))


def _labels(t):
    """Decisions on some names, out of the customers."""
    own = t("customer").where("c_custkey < 60").select(F.concat(F.lit("CP"), F.col("c_custkey").cast("string")).alias("counterparty"), F.when(F.col("c_custkey") % 2 == 0, "whitelist").otherwise("blacklist").alias("label"))
    return own


_L = "l AS (SELECT concat('CP', CAST(c_custkey AS VARCHAR)) AS counterparty, CASE WHEN c_custkey % 2 = 0 THEN 'whitelist' ELSE 'blacklist' END AS label FROM customer WHERE c_custkey < 60)"
query("a20_labels", f"{WITH_B}, {_L} SELECT tx_id, counterparty, coalesce(label, 'neutral') AS label FROM b LEFT JOIN l USING (counterparty)")(lambda t: B.apply_labels(t.bank, _labels(t)).select("tx_id", "counterparty", "label"))
_BATCH = "SELECT CASE WHEN tx_id % 50 <> 3 THEN tx_id - tx_id % 2 END AS tx_id, CASE tx_id % 7 WHEN 0 THEN 'suspicious' WHEN 1 THEN 'legitimate' WHEN 2 THEN 'blocked' WHEN 3 THEN 'monitoring' END AS label, CASE WHEN tx_id % 3 = 0 THEN 'seen' END AS note, tx_id AS seq FROM {} WHERE tx_id % 4 < 3"
_CURRENT = "SELECT tx_id, 'neutral' AS label, 'old' AS note FROM {} WHERE tx_id % 3 = 0"


def _set(t):
    return B.set_labels(t.spark.sql(_CURRENT.format("{b}"), b=t.bank), t.spark.sql(_BATCH.format("{b}"), b=t.bank))


_BATCHED = f"""{WITH_B}, c AS ({_CURRENT.format("b")}), i AS (SELECT tx_id, coalesce(label, 'neutral') AS label, coalesce(note, '') AS note, seq FROM ({_BATCH.format("b")})), g AS (SELECT * FROM i WHERE label <> 'blocked' AND tx_id IS NOT NULL)"""
query("a20_set_labels", f"""{_BATCHED}, n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tx_id ORDER BY seq DESC) AS r FROM g) WHERE r = 1)
SELECT tx_id, CASE WHEN n.label IS NOT NULL THEN n.label ELSE c.label END AS label, CASE WHEN n.label IS NOT NULL THEN n.note ELSE c.note END AS note FROM c FULL JOIN n USING (tx_id)""")(lambda t: _set(t)[0])
query("a20_refused_labels", f"""{_BATCHED} SELECT tx_id, label, seq, CASE WHEN tx_id IS NULL THEN 'no transaction' ELSE concat('invalid label ', label) END AS reason FROM i WHERE label = 'blocked' OR tx_id IS NULL""")(lambda t: _set(t)[1])
query("a21_label_counts", f"{WITH_B}, {_L} SELECT account_id, coalesce(label, 'neutral') AS label, count(*) AS n FROM b LEFT JOIN l USING (counterparty) GROUP BY GROUPING SETS ((account_id, coalesce(label, 'neutral')), (coalesce(label, 'neutral')))")(lambda t: B.label_counts(B.apply_labels(t.bank, _labels(t))))
query("a63_learning_queue", f"{WITH_B}, {_L} SELECT counterparty, count(*) AS times_seen FROM b WHERE counterparty NOT IN (SELECT counterparty FROM l) GROUP BY 1")(lambda t: B.learning_queue(t.bank, _labels(t)))
#: Two sources of the same rows: amounts in whole thousands, so that equal ones occur, each source a little
#: off; each lacks a third of the rows.
_TWO = f"""{WITH_B}, s AS (
  SELECT 'left' AS side, tx_id AS id, booking_date, CAST(floor(amount / 1000) + (tx_id % 2) * 0.006 AS DECIMAL(20, 6)) AS amount FROM b WHERE tx_id % 3 <> 0
  UNION ALL SELECT 'right', tx_id, booking_date, CAST(floor(amount / 1000) + (tx_id % 5) * 0.004 AS DECIMAL(20, 6)) FROM b WHERE tx_id % 3 <> 1)"""
_SIDE = "max(CASE WHEN side = '{0}' THEN id END) AS {0}_id, max(CASE WHEN side = '{0}' THEN amount END) AS {0}_amount".format
_BOTH = f"{_SIDE('left')}, {_SIDE('right')}"
_NEAR = "coalesce(abs(left_amount - right_amount) < 0.01, false)"


def _neighbours(source: str, name: str, shift: int) -> str:
    """What ``source`` leaves, by pairs of neighbouring cells of a hundredth."""
    return f"""{name}_r AS (SELECT booking_date, 'left' AS side, left_id AS id, left_amount AS amount FROM {source} WHERE NOT {_NEAR} AND left_id IS NOT NULL
  UNION ALL SELECT booking_date, 'right', right_id, right_amount FROM {source} WHERE NOT {_NEAR} AND right_id IS NOT NULL),
{name}_c AS (SELECT *, CAST(floor(amount * 100) AS BIGINT) + {shift} AS cell FROM {name}_r),
{name}_n AS (SELECT *, cell // 2 AS two, (cell % 2 = 0) = (side = 'left') AS crossing, row_number() OVER (PARTITION BY booking_date, cell // 2, cell % 2, side
  ORDER BY abs(amount - (CASE WHEN cell % 2 = 0 THEN cell + 1 ELSE cell END - {shift}) * 0.01), id) AS n FROM {name}_c),
{name} AS (SELECT booking_date, {_BOTH} FROM {name}_n GROUP BY booking_date, two, crossing, n)"""


_MATCHED = f"""{_TWO}, s_n AS (SELECT *, floor(amount * 100) AS cell, row_number() OVER (PARTITION BY booking_date, floor(amount * 100), side ORDER BY amount, id) AS n FROM s),
one AS (SELECT booking_date, {_BOTH} FROM s_n GROUP BY booking_date, cell, n), {_neighbours("one", "even", 0)}, {_neighbours("even", "odd", 1)},
z AS (SELECT * FROM one WHERE {_NEAR} UNION ALL SELECT * FROM even WHERE {_NEAR} UNION ALL SELECT * FROM odd WHERE {_NEAR}
  UNION ALL SELECT booking_date, left_id, left_amount, NULL, NULL FROM odd WHERE NOT {_NEAR} AND left_id IS NOT NULL
  UNION ALL SELECT booking_date, NULL, NULL, right_id, right_amount FROM odd WHERE NOT {_NEAR} AND right_id IS NOT NULL),
matched AS (SELECT booking_date, left_id, {D("left_amount")} AS left_amount, right_id, {D("right_amount")} AS right_amount,
  CASE WHEN right_id IS NULL THEN 'left_only' WHEN left_id IS NULL THEN 'right_only' ELSE 'match' END AS status FROM z)"""


def _two(t):
    off = lambda m, by: (F.floor(F.col("amount") / 1000) + F.col("tx_id") % m * F.lit(by).cast("decimal(4,3)")).cast("decimal(20,6)")
    cut = lambda m, by, rest: t.bank.where(f"tx_id % 3 <> {rest}").select("tx_id", "account_id", "booking_date", "direction", off(m, by).alias("amount"))
    return cut(2, "0.006", 0), cut(5, "0.004", 1)


def _matched(t):
    return R.reconcile(*(x.select("tx_id", "booking_date", "amount") for x in _two(t)), ["booking_date"])


query("a64_reconcile", f"{_MATCHED} SELECT * FROM matched")(lambda t: _matched(t).withColumns({c: F.col(c).cast("double") for c in ("left_amount", "right_amount")}))
query("a64_match_report", f"""{_MATCHED} SELECT booking_date, count(*) FILTER (WHERE status = 'match') AS matches, count(*) FILTER (WHERE status = 'left_only') AS left_only,
  count(*) FILTER (WHERE status = 'right_only') AS right_only, round(count(*) FILTER (WHERE status = 'match') / greatest(count(left_id), 1) * 100, 4) AS match_rate FROM matched GROUP BY 1""")(lambda t: R.match_report(_matched(t), ["booking_date"]))


@query("a64_declared_checks", f"""{WITH_B}, s AS (SELECT account_id, sum({CR}) AS total_credits, sum({DB}) AS total_debits, count(*) FILTER (WHERE direction = 'CREDIT') AS credit_count, count(*) FILTER (WHERE direction = 'DEBIT') AS debit_count FROM b GROUP BY 1),
d AS (SELECT account_id, CAST(CASE account_id % 4 WHEN 0 THEN 0.004 WHEN 1 THEN 0.01 WHEN 2 THEN 1 ELSE 0 END AS DECIMAL(10, 6)) AS off, * EXCLUDE account_id FROM s),
u AS (UNPIVOT (SELECT account_id, off, total_credits::DOUBLE AS total_credits, total_debits::DOUBLE AS total_debits, credit_count::DOUBLE AS credit_count, debit_count::DOUBLE AS debit_count FROM d) ON total_credits, total_debits, credit_count, debit_count INTO NAME field VALUE computed)
SELECT account_id, field, computed, computed + off AS declared, off < 0.01 AS match FROM u WHERE NOT (field = 'debit_count' AND account_id % 5 = 0)""")
def a64_checks(t):
    """Declared totals are a little, a hundredth or a whole off, or (a fifth of the debit counts) not there."""
    own = R.totals_of(t.bank, ["account_id"], F.when(F.expr(B.CREDIT), F.col("amount")).otherwise(-F.col("amount")))
    fields = ["total_credits", "total_debits", "credit_count", "debit_count"]
    off = F.element_at(F.array(*(F.lit(x).cast("decimal(10,6)") for x in ("0.004", "0.01", "1", "0"))), (F.col("account_id") % 4 + 1).cast("int"))
    declared = own.select("account_id", *(F.when(~((F.lit(f) == "debit_count") & (F.col("account_id") % 5 == 0)), F.col(f) + off).alias(f) for f in fields))
    return R.declared_checks(own, declared, ["account_id"], fields).withColumns({c: F.col(c).cast("double") for c in ("computed", "declared")})


query("a68_latest", f"""{WITH_B} SELECT account_id, tx_id, booking_date FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY booking_date DESC, tx_id DESC) AS r FROM b) WHERE r = 1""")(lambda t: B.latest(t.bank.select("account_id", "tx_id", "booking_date"), "account_id", [F.desc("booking_date"), F.desc("tx_id")]))
query("a67_history", f"""{_S}, g AS (SELECT account_id, {MONTH} AS month, count(*) AS risky FROM b WHERE category IN ('gambling', 'crypto') GROUP BY 1, 2) SELECT account_id, month, n, coalesce(risky, 0) AS risky FROM s LEFT JOIN g USING (account_id, month)""")(lambda t: B.statement_history(B.statements(t.bank), t.bank, ["gambling", "crypto"]))
query("a4_deduplicate", f"""{WITH_B} SELECT account_id, booking_date, counterparty, min(tx_id) AS tx_id FROM b GROUP BY 1, 2, 3""")(lambda t: B.deduplicate(t.bank.select("account_id", "booking_date", "counterparty", "tx_id"), ["account_id", "booking_date", "counterparty"]))
query("a3_tx_hash", f"""{WITH_B} SELECT tx_id, substr(sha256(concat_ws('|', strftime(booking_date, '%Y-%m-%d'), CAST(amount AS VARCHAR), counterparty, category)), 1, 16) AS tx_hash FROM b""")(
    lambda t: t.bank.select("tx_id", T.tx_hash(F.col("booking_date"), F.col("amount"), F.col("counterparty"), F.col("category")).alias("tx_hash"))
)
query("a1_clean_text", r"""SELECT p_partkey, upper(trim(regexp_replace(concat('  ', p_name, '   ', p_type, ' '), '\s+', ' ', 'g'))) AS clean FROM part""")(lambda t: t("part").select("p_partkey", T.clean_text(F.concat(F.lit("  "), "p_name", F.lit("   "), "p_type", F.lit(" "))).alias("clean")))
query("a2_strip_diacritics", f"""SELECT doc_id, sha256(translate(text, '{T.MARKED}', '{T.PLAIN}')) AS plain_sha256 FROM documents""")(lambda t: t("documents").select("doc_id", F.sha2(T.strip_diacritics(F.col("text")).cast("binary"), 256).alias("plain_sha256")))
query("a5_urls", r"""SELECT page_id, len(regexp_extract_all(concat(url, ' ', html), '(?i)https?://[^\s,;"''<>]+')) AS n_urls, regexp_replace(regexp_replace(regexp_replace(lower(url), '^[a-z]+://', ''), '[/:?#].*$', ''), '^www\.', '') AS domain FROM pages""")(
    lambda t: t("pages").select("page_id", F.size(T.urls(F.concat_ws(" ", "url", "html"))).cast("long").alias("n_urls"), T.url_domain(F.col("url")).alias("domain"))
)
query("a6_direction", "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN 'CREDIT' ELSE 'DEBIT' END AS direction FROM customer")(lambda t: t("customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, "CREDIT").otherwise("DEBIT").alias("direction")))

_CH = "lower(concat_ws(' ', text, role))"
query("a7_channel", f"""SELECT conv_id, turn, CASE WHEN contains({_CH}, 'blik') THEN CASE WHEN regexp_matches({_CH}, '{T.PHONE_TRANSFER}') THEN 'BLIK_P2P' ELSE 'BLIK_MERCHANT' END
  {" ".join(f"WHEN regexp_matches({_CH}, '{p}') THEN '{c}'" for c, p in T.CHANNEL_PATTERNS)} ELSE 'OTHER' END AS channel FROM conversations""")(
    lambda t: t("conversations").select("conv_id", "turn", T.channel(F.lit(None).cast("string"), F.col("text"), F.col("role")).alias("channel"))
)
#: Patterns over part names, in order of precedence.
PARTS = [("metal", r"\b(steel|copper|brass|tin)\b"), ("round", r"\b(ring|bolt|gear)\b"), ("colour", r"\b(red|green|blue)\b")]
query("a9_first_category", f"""SELECT p_partkey, CASE {" ".join(f"WHEN regexp_matches(p_name, '{p}') THEN '{c}'" for c, p in PARTS)} ELSE 'unclassified' END AS category FROM part""")(lambda t: t("part").select("p_partkey", T.first_match(F.col("p_name"), PARTS, "unclassified").alias("category")))


def _phones(t):
    return t("customer").select("c_custkey", "c_nationkey", F.concat(F.lit("49015420323751"), (F.col("c_custkey") % 10).cast("string")).alias("imei"), F.concat(F.lit("GB"), F.lpad((F.col("c_custkey") % 97).cast("string"), 2, "0"), F.lit("WEST12345698765432")).alias("iban"))


query("a14_account_quality", """WITH n AS (SELECT c_nationkey, CAST(concat('32142829123456987654321611', lpad(CAST(c_custkey % 97 AS VARCHAR), 2, '0')) AS HUGEINT) % 97 = 1 AS ok FROM customer)
SELECT c_nationkey, count(*) AS n, count(*) FILTER (NOT ok) AS invalid, round(count(*) FILTER (NOT ok) / count(*), 4) AS invalid_share FROM n GROUP BY 1""")(
    lambda t: _phones(t).withColumn("ok", T.iban_valid(F.col("iban"))).groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("invalid"), F.round(F.count_if(~F.col("ok")) / F.count("*"), 4).alias("invalid_share"))
)


_WORDS = r"list_distinct(list_filter(regexp_split_to_array({0}, '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''))"


@query("a60_resolve_entities", f"""WITH a AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN concat(p_name, ' ltd') WHEN 1 THEN concat(p_name, '12') WHEN 2 THEN concat('the ', p_name, ' & co of ', p_brand) ELSE p_name END AS name FROM part),
k AS (SELECT name, min(p_partkey) AS entity_id FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, ' of ', p_brand, ' co the') ELSE concat(p_name, '123') END AS name FROM part) GROUP BY 1 HAVING min(p_partkey) % 2 = 0),
j AS (SELECT a.name, entity_id, lower(a.name) AS x, lower(k.name) AS y FROM a, k),
s AS (SELECT *, {_WORDS.format('x')} AS wx, {_WORDS.format('y')} AS wy, least(length(x), length(y)) / greatest(length(x), length(y)) AS part FROM j),
r AS (SELECT *, len(list_intersect(wx, wy)) / greatest(len(wx), len(wy)) AS ratio FROM s),
t AS (SELECT *, CASE WHEN x = y THEN 1 WHEN (contains(x, y) OR contains(y, x)) AND part >= 0.7 THEN 2 WHEN ratio >= 0.8 THEN 3 END AS stage FROM r),
b AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY stage, CASE stage WHEN 1 THEN -1.0 WHEN 2 THEN -part ELSE -ratio END, entity_id) AS o FROM t WHERE stage IS NOT NULL)
SELECT a.name, entity_id, CASE stage WHEN 1 THEN 'exact' WHEN 2 THEN 'part' WHEN 3 THEN 'fuzzy' ELSE 'new' END AS how FROM a LEFT JOIN (SELECT name, entity_id, stage FROM b WHERE o = 1) c USING (name)""")
def a60(t):
    known = t("part").select("p_partkey", F.expr("case p_partkey % 3 when 0 then p_name when 1 then concat(p_name, ' of ', p_brand, ' co the') else concat(p_name, '123') end").alias("name")).groupBy("name").agg(F.min("p_partkey").alias("entity_id")).where("entity_id % 2 = 0")
    names = t("part").select(F.expr("case p_partkey % 4 when 0 then concat(p_name, ' ltd') when 1 then concat(p_name, '12') when 2 then concat('the ', p_name, ' & co of ', p_brand) else p_name end").alias("name")).distinct()
    return B.resolve_entities(names, known)
