"""Queries over household finance, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bank as B
from ..operators import household as H
from .bank import _S, CR, DB, MONTH, D
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


_REC = """q AS (SELECT *, CAST(round(CAST(amount AS DOUBLE) / 10000) AS BIGINT) * 10000 AS bucket FROM b WHERE direction = 'DEBIT'),
p AS (SELECT *, booking_date - lag(booking_date) OVER (PARTITION BY account_id, counterparty, bucket ORDER BY booking_date, tx_id) AS gap FROM q),
e AS (SELECT account_id, counterparty, bucket, count(*) AS n, avg(gap) AS mean_gap, CAST(sum(amount) AS DOUBLE) AS total FROM p GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND avg(gap) BETWEEN 20 AND 40)"""
query("f2_monthly_recurrence", f"{WITH_B}, {_REC} SELECT account_id, counterparty, bucket, n, round(mean_gap, 4) AS mean_gap, total FROM e")(lambda t: H.monthly_recurrence(t.bank, bucket=10000))


def _steps(c: str, limits: list, last: int) -> str:
    return "CASE " + " ".join(f"WHEN {c} <= {x} THEN {v}" for x, v in limits) + f" ELSE {last} END"


def _pct(c: str) -> str:
    return f"({c} / greatest(income, expense, 1) * 100)"


@query("f3_health_score", f"""{WITH_B}, {_REC}, f AS (SELECT account_id, sum(total) AS fixed FROM e GROUP BY 1),
r AS (SELECT account_id, booking_date, tx_id, CAST(sum(CASE WHEN direction = 'CREDIT' THEN amount ELSE -amount END) OVER (PARTITION BY account_id ORDER BY booking_date, tx_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS balance FROM b),
l AS (SELECT account_id, arg_min(balance, (booking_date, tx_id)) AS fb, arg_max(balance, (booking_date, tx_id)) AS lb FROM r GROUP BY 1),
a AS (SELECT account_id, {D(f"sum({CR})")} AS income, {D(f"sum({DB})")} AS expense, {", ".join(f"CAST(sum(CASE WHEN category = '{c}' THEN amount ELSE 0 END) AS DOUBLE) AS {c}" for c in ("gambling", "crypto", "loans"))},
  count(*) FILTER (direction = 'CREDIT') AS credits, count(DISTINCT CASE WHEN direction = 'CREDIT' THEN counterparty END) AS sources, greatest(max(booking_date) - min(booking_date), 1) AS days FROM b GROUP BY 1),
j AS (SELECT a.*, coalesce(fixed, 0) AS fixed, round(lb - fb, 2) AS t, round(income - expense, 2) AS net, credits / greatest(days / 30, 1) AS pm FROM a LEFT JOIN f USING (account_id) LEFT JOIN l USING (account_id)),
s AS (SELECT account_id,
  CASE WHEN credits = 0 THEN 10 ELSE least(100, CASE WHEN pm >= 2 THEN 80 WHEN pm >= 1 THEN 60 ELSE 30 END + CASE WHEN sources >= 2 THEN 10 ELSE 0 END) END AS income_stability,
  CAST(CASE WHEN t > 0 THEN 60 + floor(least(abs(t) / 500, 1.0) * 40) WHEN t < 0 THEN 50 - floor(least(abs(t) / 1000, 1.0) * 50) ELSE 50 END AS INT) AS balance_trend,
  CASE WHEN income > 0 THEN {_steps("expense / income", [(0.7, 100), (0.9, 70), (1.0, 40), (1.2, 20)], 0)} WHEN expense > 0 THEN 10 ELSE 50 END AS expense_ratio,
  {_steps("CASE WHEN income > 0 THEN fixed / income * 100 WHEN expense > 0 THEN fixed / expense * 100 ELSE 0 END", [(30, 90), (50, 60), (70, 30)], 10)} AS recurring_burden,
  CASE WHEN gambling = 0 THEN 100 ELSE {_steps(_pct("gambling"), [(1, 80), (5, 50), (15, 20)], 0)} END AS risk_gambling,
  CASE WHEN crypto = 0 THEN 100 ELSE {_steps(_pct("crypto"), [(5, 80), (15, 50), (30, 25)], 10)} END AS risk_crypto,
  CASE WHEN loans = 0 THEN 100 ELSE {_steps(_pct("loans"), [(10, 70), (25, 40), (50, 15)], 0)} END AS risk_loans,
  CAST(CASE WHEN net > 0 THEN 60 + floor(least(abs(net) / 1000, 1.0) * 40) WHEN net = 0 THEN 50 ELSE 40 - floor(least(abs(net) / 2000, 1.0) * 40) END AS INT) AS risk_deficit FROM j)
SELECT *, CAST(round_even(({" + ".join(f"{k} * {w}" for k, w in H.WEIGHTS.items())}) / {sum(H.WEIGHTS.values())}.0, 0) AS INT) AS score FROM s""")
def f3(t):
    order = F.struct("booking_date", "tx_id")
    ends = B.running_balance(t.bank).groupBy("account_id").agg(F.min_by("balance", order).alias("first_balance"), F.max_by("balance", order).alias("last_balance"))
    return H.health_score(t.bank, H.monthly_recurrence(t.bank, bucket=10000), ends)


_M = f"""{WITH_B}, m AS (SELECT account_id, {MONTH} AS period, {D(f"sum({CR})")} AS income, {D(f"sum({DB})")} AS expense, {", ".join(f"CAST(sum(CASE WHEN category = '{c}' THEN amount ELSE 0 END) AS DOUBLE) AS {c}_total" for c in ("gambling", "crypto", "loans"))},
  count(*) AS n, round({D(f"sum({CR})")} - {D(f"sum({DB})")}, 2) AS net_flow FROM b GROUP BY 1, 2)"""
query("f4_month_snapshots", f"{_M} SELECT * FROM m")(lambda t: H.month_snapshots(t.bank))
query("f5_trends", f"""{_M}, u AS ({" UNION ALL ".join(f"SELECT account_id, period, '{k}' AS metric, '{s}' AS severity, {k} AS value FROM m" for k, s in H.METRICS.items())}),
i AS (SELECT *, CAST(row_number() OVER (PARTITION BY account_id, metric ORDER BY period) - 1 AS DOUBLE) AS i FROM u),
g AS (SELECT account_id, metric, severity, count(*) AS n, arg_min(value, period) AS f, arg_max(value, period) AS l, regr_slope(value, i) AS slope, avg(value) AS mean, stddev_pop(value) AS std, max(abs(value)) AS most FROM i GROUP BY 1, 2, 3),
c AS (SELECT *, CASE WHEN f <> 0 THEN (l - f) / abs(f) * 100 WHEN l > 0 THEN 100.0 WHEN l < 0 THEN -100.0 ELSE 0.0 END AS change FROM g WHERE n >= 2 AND most > 0),
d AS (SELECT *, CASE WHEN n >= 3 AND mean <> 0 AND abs(std / mean) > 0.5 THEN 'volatile' WHEN abs(change) < 10 THEN 'stable' WHEN n >= 3 AND slope > 0 THEN 'increasing' WHEN n < 3 AND l > f THEN 'increasing' ELSE 'decreasing' END AS direction FROM c)
SELECT account_id, metric, n, direction, severity, round(change, 2) AS change_pct FROM d WHERE direction <> 'stable' OR severity = 'high'""")(lambda t: H.trends(H.month_snapshots(t.bank)))
query("f6_trajectory", f"""{_M}, g AS (SELECT account_id, count(*) AS months, count(*) FILTER (net_flow < 0) AS deficit_months, arg_min(gambling_total + crypto_total + loans_total, period) AS a, arg_max(gambling_total + crypto_total + loans_total, period) AS z FROM m GROUP BY 1)
SELECT account_id, months, deficit_months, round(1 - deficit_months / months, 4) AS discipline, CASE WHEN z > a * 1.1 THEN 'worsening' WHEN z < a * 0.9 THEN 'improving' ELSE 'steady' END AS risk_direction FROM g""")(lambda t: H.trajectory(H.month_snapshots(t.bank)))
query("f9_reconcile_totals", f"""{_S}, v AS (SELECT account_id, month, CASE WHEN n % 3 = 0 THEN credit END AS table_credit, CASE WHEN n % 2 = 0 THEN credit + 1 END AS header_credit, credit AS computed_credit, CASE WHEN n % 5 = 0 THEN debit END AS table_debit, CASE WHEN n % 2 = 1 THEN debit END AS header_debit, debit AS computed_debit FROM s)
SELECT account_id, month, coalesce(table_credit, header_credit, computed_credit) AS credit, CASE WHEN table_credit IS NOT NULL THEN 'table' WHEN header_credit IS NOT NULL THEN 'header' ELSE 'computed' END AS credit_from,
  coalesce(table_debit, header_debit, computed_debit) AS debit, CASE WHEN table_debit IS NOT NULL THEN 'table' WHEN header_debit IS NOT NULL THEN 'header' ELSE 'computed' END AS debit_from FROM v""")(
    lambda t: H.reconcile_totals(
        B.statements(t.bank).selectExpr("account_id", "month", "if(n % 3 = 0, credit, null) as table_credit", "if(n % 2 = 0, credit + 1, null) as header_credit", "credit as computed_credit", "if(n % 5 = 0, debit, null) as table_debit", "if(n % 2 = 1, debit, null) as header_debit", "debit as computed_debit")
    ).select("account_id", "month", "credit", "credit_from", "debit", "debit_from")
)
query("f10_balance_chain", f"""{WITH_B}, r AS (SELECT account_id, tx_id, row_number() OVER w AS seq, CASE WHEN direction = 'CREDIT' THEN amount ELSE -amount END AS amount FROM b WINDOW w AS (PARTITION BY account_id ORDER BY booking_date, tx_id)),
s AS (SELECT *, sum(amount) OVER (PARTITION BY account_id ORDER BY seq) AS total FROM r), k AS (SELECT *, CASE WHEN tx_id % 4 <> 0 THEN CASE WHEN tx_id % 50 = 7 THEN total + 1 ELSE total END END - total AS off FROM s),
p AS (SELECT *, last_value(off IGNORE NULLS) OVER (PARTITION BY account_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k)
SELECT account_id, seq, {D("round(off - before, 2)")} AS difference, abs(off - before) <= 0.02 AS holds FROM p WHERE off IS NOT NULL AND before IS NOT NULL""")(
    lambda t: (
        lambda r: H.balance_chain(r.withColumn("total", F.sum("amount").over(B.Window.partitionBy("account_id").orderBy("seq"))).withColumn("balance", F.expr("case when tx_id % 4 <> 0 then case when tx_id % 50 = 7 then total + 1 else total end end")).drop("total")).withColumn("difference", F.col("difference").cast("double"))
    )(t.bank.select("account_id", "tx_id", F.row_number().over(B.Window.partitionBy("account_id").orderBy("booking_date", "tx_id")).alias("seq"), F.expr("case when direction = 'CREDIT' then amount else -amount end").alias("amount")))
)
query("f14_override_months", f"""{_M}, w AS (SELECT account_id, period, income FROM m), n AS (SELECT account_id, period, income + 1 AS income FROM m WHERE period >= '2024-10')
SELECT * FROM w WHERE (account_id, period) NOT IN (SELECT (account_id, period) FROM n) UNION ALL SELECT * FROM n""")(lambda t: (lambda m: H.override_months(m, m.where("period >= '2024-10'").withColumn("income", F.col("income") + 1), ["account_id", "period"]))(H.month_snapshots(t.bank).select("account_id", "period", "income")))
query("f15_merge_sections", f"""{_S} SELECT account_id % 3 AS currency, min(period_from) AS period_from, max(period_to) AS period_to, arg_min(opening, (period_from, account_id)) AS opening, arg_max(closing, (period_to, account_id)) AS closing,
  round(sum(credit), 2) AS credit, round(sum(debit), 2) AS debit, array_to_string(list_sort(list(DISTINCT account_id)), ',') AS accounts FROM s GROUP BY 1""")(lambda t: H.merge_sections(B.statements(t.bank).withColumn("currency", F.col("account_id") % 3), ["currency"]))
query("f16_category_flows", f"""{WITH_B}, e AS (SELECT account_id, amount, direction, unnest(CASE WHEN category = 'everyday' THEN ['unclassified'] WHEN tx_id % 2 = 0 THEN [category, channel] ELSE [category] END) AS label FROM b)
SELECT account_id, label, {D(f"sum({CR})")} AS inflow, {D(f"sum({DB})")} AS outflow, count(*) AS n FROM e GROUP BY 1, 2""")(
    lambda t: H.category_flows(t.bank, F.when(F.col("category") == "everyday", F.array().cast("array<string>")).when(F.col("tx_id") % 2 == 0, F.array("category", "channel")).otherwise(F.array("category")))
)
