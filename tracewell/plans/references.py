"""Queries over references in texts, devices, logs and access, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ledger as L
from ..operators import places as P
from ..operators import references as R
from .ledger import DAY, S
from .tables import WITH_B, WITH_C, WITH_N, WITH_X

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_RAW = "CASE tx_id % 13 WHEN 0 THEN '00VE02' WHEN 1 THEN '00IKZ1 x IK01' WHEN 2 THEN '00IBCB' WHEN 3 THEN '00none' WHEN 4 THEN '00DECC' ELSE '' END"
_MSG = "CASE tx_id % 17 WHEN 0 THEN '073' WHEN 1 THEN '034' WHEN 2 THEN '076' WHEN 3 THEN '999' ELSE '' END"
_case = lambda pairs: " ".join(f"WHEN {c} THEN '{v}'" for c, v in pairs)
query("a8_channel_codes", rf"""{WITH_N}, v AS (SELECT tx_id, {_RAW} AS raw, {_MSG} AS msg, lower(concat(title, ' ', payee)) AS t FROM n)
SELECT tx_id, CASE {_case((f"contains(raw, '{k}')", c) for k, c in R.RAW_CODES.items())} {_case((f"msg = '{k}'", c) for k, c in R.MESSAGE_CODES.items())} {_case((f"regexp_matches(t, '{p}')", c) for p, c in R.TITLE_CHANNELS)} ELSE 'INNE' END AS channel FROM v""")(
    lambda t: t.notes.select("tx_id", R.channel_by_codes(F.expr(_RAW), F.expr(_MSG), F.col("title"), F.col("payee")).alias("channel"))
)


@query("a16_classify_accounts", """WITH a AS (SELECT c_custkey, concat('PL61', lpad(CAST(c_custkey % 40 * 250 AS VARCHAR), 4, '0'), '0000') AS account FROM customer), b(sort, bank) AS (VALUES ('1000', 'one'), ('2500', 'two'))
SELECT DISTINCT account, 'PL' AS country, coalesce(bank, CASE WHEN substr(account, 5, 1) IN ('8', '9') THEN 'cooperative' END, 'unknown') AS bank FROM a LEFT JOIN b ON sort = substr(account, 5, 4)""")
def a16(t):
    a = t("customer").select(F.concat(F.lit("PL61"), F.lpad((F.col("c_custkey") % 40 * 250).cast("string"), 4, "0"), F.lit("0000")).alias("account")).distinct()
    return R.classify_accounts(a, t.spark.createDataFrame([("1000", "one"), ("2500", "two")], "sort string, bank string"))


query("a22_propagate_labels", f"""{WITH_B}, d AS (SELECT counterparty, max(CASE WHEN tx_id % 50 = 3 THEN 2 WHEN tx_id % 50 = 4 THEN 1 ELSE 0 END) AS d FROM b WHERE tx_id % 10 = 3 OR tx_id % 10 = 4 GROUP BY 1)
SELECT DISTINCT counterparty, CASE d WHEN 2 THEN 'blacklist' WHEN 1 THEN 'whitelist' ELSE 'neutral' END AS label FROM b LEFT JOIN d USING (counterparty)""")(
    lambda t: R.propagate_labels(t.bank.select("counterparty").distinct().withColumn("label", F.lit("neutral")), t.bank.where("tx_id % 10 in (3, 4)").selectExpr("counterparty", "case when tx_id % 50 = 3 then 'suspicious' when tx_id % 50 = 4 then 'cleared' else 'open' end as decision"))
)
query("a23_learned_category", f"""{WITH_B}, k AS (SELECT counterparty, max(category) AS learned FROM b WHERE tx_id % 100 = 0 GROUP BY 1) SELECT tx_id, coalesce(CASE WHEN tx_id % 2 = 0 THEN category END, learned, 'unclassified') AS category FROM b LEFT JOIN k USING (counterparty)""")(
    lambda t: R.learned_category(t.bank.selectExpr("tx_id", "counterparty", "if(tx_id % 2 = 0, category, null) as category"), t.bank.where("tx_id % 100 = 0").groupBy("counterparty").agg(F.max("category").alias("learned")))
)

query("a58_edge_labels", f"""{WITH_B}, l AS (SELECT tx_id, CASE WHEN tx_id % 90 = 0 THEN 'blacklist' ELSE 'suspicious' END AS label FROM b WHERE tx_id % 30 = 0)
SELECT account_id AS src, counterparty AS dst, CASE max(CASE label WHEN 'blacklist' THEN 2 WHEN 'suspicious' THEN 1 ELSE 0 END) WHEN 2 THEN 'blacklist' WHEN 1 THEN 'suspicious' ELSE 'neutral' END AS label, count(*) AS n FROM b LEFT JOIN l USING (tx_id) GROUP BY 1, 2""")(
    lambda t: R.edge_labels(t.bank.selectExpr("account_id as src", "counterparty as dst", "tx_id"), t.bank.where("tx_id % 30 = 0").selectExpr("tx_id", "if(tx_id % 90 = 0, 'blacklist', 'suspicious') as label"))
)


query("f11_entity_lookup", """WITH e AS (SELECT CASE WHEN p_partkey % 4 = 0 THEN 'project' ELSE 'global' END AS scope, lower(p_name) AS name, lower(concat(p_name, ' co')) AS alias, p_partkey AS entity FROM part WHERE p_partkey % 3 = 0),
n AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat(p_name, ' Co') WHEN 2 THEN concat('the ', p_name, ' shop') ELSE substring(p_name, 3) END AS name FROM part),
k AS (SELECT n.name, 0 AS how, scope, entity FROM n JOIN e ON lower(trim(n.name)) = e.name UNION ALL SELECT n.name, 1, scope, entity FROM n JOIN e ON lower(trim(n.name)) = alias
  UNION ALL SELECT n.name, 2, scope, entity FROM n JOIN e ON contains(lower(trim(n.name)), e.name) OR contains(e.name, lower(trim(n.name)))),
b AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY how, CASE scope WHEN 'project' THEN 0 ELSE 1 END, entity) AS r FROM k)
SELECT n.name, entity, coalesce(scope, 'none') AS scope, ['name', 'alias', 'part'][how + 1] AS how FROM n LEFT JOIN (SELECT * FROM b WHERE r = 1) b USING (name)""")(
    lambda t: R.entity_lookup(t("part").selectExpr("case p_partkey % 4 when 0 then upper(p_name) when 1 then concat(p_name, ' Co') when 2 then concat('the ', p_name, ' shop') else substring(p_name, 3) end as name").distinct(), t("part").where("p_partkey % 3 = 0").selectExpr("if(p_partkey % 4 = 0, 'project', 'global') as scope", "p_name as name", "concat(p_name, ' co') as alias", "p_partkey as entity"))
)


query("x3_token_classes", f"{WITH_X} SELECT token, token IN ('BTC', 'ETH', 'USDT', 'USDC', 'XMR', 'PLN', 'USD', 'EUR', 'GBP', 'CHF') AS known, count(*) AS n FROM x GROUP BY 1")(lambda t: t.transfers.groupBy("token").agg(F.first(F.col("token").isin(L.KNOWN)).alias("known"), F.count("*").alias("n")))
query("x29_orders", "SELECT o_orderpriority AS market, o_orderstatus AS state, count(*) AS n, rank FROM orders JOIN (SELECT o_orderpriority, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS rank FROM orders GROUP BY 1) USING (o_orderpriority) WHERE rank <= 15 GROUP BY 1, 2, 4")(
    lambda t: (lambda top: t("orders").join(top, "o_orderpriority").groupBy(F.col("o_orderpriority").alias("market"), F.col("o_orderstatus").alias("state"), "rank").agg(F.count("*").alias("n")))(
        t("orders").groupBy("o_orderpriority").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "o_orderpriority").limit(15).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("k"), "o_orderpriority"))).drop("k")
    )
)
