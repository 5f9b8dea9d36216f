"""Queries over what statements say: rules, merchants, accounts, cards, spending; each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bank as B
from ..operators import household as H
from ..operators import references as R
from ..operators import rules as U
from .bank import MONTH, D
from .tables import WITH_N

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def values(rows: list[tuple]) -> str:
    one = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


#: The analysts' tables of these queries: kind, category, subcategory, pattern, priority.
RULES = [
    ("category", "loans", "instalment", "raty", 1), ("category", "loans", "instalment", "pozyczk", 2), ("category", "loans", "instant", "chwil", 3), ("category", "gambling", "bets", r"bet\.example", 4),
    ("category", "gambling", "slips", "zaklad", 5), ("category", "transport", "fuel", "orlen|shell", 6), ("risk", "phone", "", "na telefon", 7), ("risk", "cash", "", "gotowk|kod 1", 8), ("risk", "phone", "", "blik", 9),
]
DOMAINS = [("bet.example", "gambling", "online"), ("shop.example", "shopping", "online")]
MERCHANTS = [("biedronka", "Biedronka", "groceries", "discount", 1), ("lidl", "Lidl", "groceries", "discount", 2), ("warszawa", "Warsaw shop", "other", "city", 3)]
WEIGHTS = {"GAMBLING": 30, "LOANS": 25, "PHONE": 15, "CASH": 10, "BLACKLISTED": 5, "WHITELIST_MATCH": -10, "BLACKLIST_MATCH": 30}
_LABEL = "CASE tx_id % 9 WHEN 0 THEN 'blacklist' WHEN 1 THEN 'whitelist' ELSE 'neutral' END"
_WORTH = lambda x: f"coalesce((SELECT points FROM wt WHERE name = replace(upper({x}), ':', '_')), (SELECT points FROM wt WHERE name = replace(replace(upper({x}), ':', '_'), 'RISK_', '')), 0)"


@query("a10_rule_engine", rf"""{WITH_N}, r(kind, category, subcategory, pattern, priority) AS (VALUES {values(RULES)}), dm(domain, category, subcategory) AS (VALUES {values(DOMAINS)}), mm(pattern, name, category, subcategory, priority) AS (VALUES {values(MERCHANTS)}), wt(name, points) AS (VALUES {values(list(WEIGHTS.items()))}),
t AS (SELECT tx_id, {_LABEL} AS label, lower(title) AS t, translate(lower(title), '{T.MARKED}', '{T.PLAIN}') AS a, title FROM n),
h AS (SELECT tx_id, kind, category, subcategory, min(priority) AS p, arg_min(pattern, priority) AS pattern FROM t JOIN r ON regexp_matches(t, pattern) OR regexp_matches(a, pattern) GROUP BY 1, 2, 3, 4),
o AS (SELECT kind, category, subcategory, min(priority) AS o FROM r GROUP BY 1, 2, 3),
g AS (SELECT tx_id, kind, category, subcategory, pattern, o FROM h JOIN o USING (kind, category, subcategory)),
c AS (SELECT tx_id, arg_min(category, o) AS category, arg_min(concat(category, ':', subcategory), o) AS subcategory, string_agg(concat('category:', category, ':', subcategory, '|', pattern, '|', category), ';' ORDER BY o) AS ex FROM g WHERE kind = 'category' GROUP BY 1),
k AS (SELECT tx_id, string_agg(concat('risk:', category, '|', pattern, '|', category), ';' ORDER BY o) AS ex FROM g WHERE kind = 'risk' GROUP BY 1),
u AS (SELECT tx_id, i, regexp_replace(split_part(split_part(url, '//', 2), '/', 1), '^www\.', '') AS domain FROM (SELECT tx_id, unnest(us) AS url, generate_subscripts(us, 1) AS i FROM (SELECT tx_id, regexp_extract_all(title, '(?i)https?://[^\s,;"''<>]+') AS us FROM t))),
v AS (SELECT tx_id, i, domain, category, subcategory FROM u JOIN dm USING (domain)),
w AS (SELECT tx_id, arg_min(category, i) AS category, arg_min(concat(category, ':', subcategory), i) AS subcategory, string_agg(concat('url_domain:', domain, '||', category, ':', subcategory), ';' ORDER BY i) AS ex FROM v GROUP BY 1),
m AS (SELECT tx_id, arg_min(mm.category, priority) AS category, arg_min(subcategory, priority) AS subcategory, arg_min(name, priority) AS name FROM t JOIN mm ON regexp_matches(t, pattern) GROUP BY 1),
ta AS (SELECT tx_id, category AS tag, min(o) AS o FROM g WHERE kind = 'category' GROUP BY 1, 2 UNION ALL SELECT tx_id, concat('RISK:', category), 100 + o FROM g WHERE kind = 'risk' UNION ALL SELECT tx_id, category, 200 + i FROM v UNION ALL SELECT tx_id, 'BLACKLISTED', 300 FROM t WHERE label = 'blacklist'),
tb AS (SELECT tx_id, tag, min(o) AS o FROM ta GROUP BY 1, 2), tc AS (SELECT tx_id, string_agg(tag, ',' ORDER BY o) AS tags, sum({_WORTH('tag')}) AS points FROM tb GROUP BY 1)
SELECT t.tx_id, coalesce(c.category, w.category, m.category, 'unclassified') AS category, coalesce(c.subcategory, w.subcategory, CASE WHEN w.category IS NULL THEN m.subcategory END, '') AS subcategory, coalesce(tags, '') AS tags,
  CAST(greatest(0, least(100, coalesce(points, 0) + CASE label WHEN 'blacklist' THEN 30 WHEN 'whitelist' THEN -10 ELSE 0 END)) AS INT) AS risk_score,
  concat_ws(';', c.ex, k.ex, w.ex, CASE WHEN c.category IS NULL AND w.category IS NULL AND m.category IS NOT NULL THEN concat('merchant_db:', m.category, '|', m.name, '|', m.category) END, CASE label WHEN 'whitelist' THEN 'memory:whitelist||whitelist' WHEN 'blacklist' THEN 'memory:blacklist||blacklist' END) AS explains
FROM t LEFT JOIN c USING (tx_id) LEFT JOIN k USING (tx_id) LEFT JOIN w USING (tx_id) LEFT JOIN m USING (tx_id) LEFT JOIN tc USING (tx_id)""")
def a10(t):
    return classified(rule_rows(t.notes), rule_tables(t.spark))


def rule_rows(rows):
    return rows.select("tx_id", "title", F.expr(_LABEL).alias("label"), T.urls(F.col("title")).alias("urls"))


def rule_tables(spark) -> dict:
    make = lambda rows, names: spark.createDataFrame(rows, names)
    return {
        "rules": make(RULES, "kind string, category string, subcategory string, pattern string, priority int"),
        "domains": make(DOMAINS, "domain string, category string, subcategory string"),
        "merchants": make(MERCHANTS, "pattern string, name string, category string, subcategory string, priority int"),
    }


def classified(rows, now: dict):
    return U.classify(rows, now["rules"], "tx_id", "title", WEIGHTS, "urls", now["domains"], now["merchants"], "label")


_LAB = [("fuel", "company", "orlen|shell"), ("shop", "company", "biedronka"), ("shop", "company", "lidl"), ("phone", None, "na telefon"), ("loan", "bank", "raty"), ("any", None, "blik|karta")]
_SITES = [("bet.example", "gambling"), ("shop.example", "shop")]


@query("f1_all_labels", rf"""{WITH_N}, r(label, entity_type, pattern) AS (VALUES {values(_LAB)}), s(domain, label) AS (VALUES {values(_SITES)}),
h AS (SELECT tx_id, label FROM n JOIN r ON regexp_matches(lower(title), pattern) UNION SELECT tx_id, label FROM (SELECT tx_id, regexp_replace(split_part(split_part(unnest(regexp_extract_all(title, '(?i)https?://[^\s,;"''<>]+')), '//', 2), '/', 1), '^www\.', '') AS domain FROM n) JOIN s USING (domain)),
e AS (SELECT tx_id, arg_min(entity_type, (label, entity_type)) AS entity_type FROM n JOIN r ON regexp_matches(lower(title), pattern) WHERE entity_type IS NOT NULL GROUP BY 1), g AS (SELECT tx_id, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM h GROUP BY 1)
SELECT n.tx_id, coalesce(labels, '') AS labels, coalesce(entity_type, 'none') AS entity_type FROM n LEFT JOIN g USING (tx_id) LEFT JOIN e USING (tx_id)""")
def f1(t):
    rows = t.notes.select("tx_id", "title", T.urls(F.col("title")).alias("urls"))
    return U.all_labels(rows, t.spark.createDataFrame(_LAB, "label string, entity_type string, pattern string"), "tx_id", "title", "urls", t.spark.createDataFrame(_SITES, "domain string, label string"))


_MER = [(1, "Quick loans", "lender", "(?i)pożyczk"), (2, "Orlen", "fuel", "(?i)orlen"), (2, "Orlen station", "fuel", "(?i)orlen stacja"), (3, "Biedronka", "groceries", "(?i)biedronka"), (4, "card", "card", "(?i)karta")]
_LENDERS = [(1, "Quick loans", "lender", "(?i)pożyczk|chwilówk"), (1, "Instalment bank", "lender", r"(?i)raty\b")]
_BEST = "{w}, r(priority, name, category, pattern) AS (VALUES {v}), h AS (SELECT tx_id, arg_min(name, (priority, -length(name), name)) AS merchant, arg_min(r.category, (priority, -length(name), name)) AS category FROM n JOIN r ON regexp_matches(title, pattern) GROUP BY 1)"
_CITIES = ["kraków", "warszawa", "gdańsk", "łódź"]
_CITY = "CASE " + " ".join(f"WHEN contains(lower({{0}}), '{c}') THEN '{c}'" for c in sorted(_CITIES, key=lambda c: (-len(c), c))) + " END"
_RULE = "priority int, name string, category string, pattern string"
query("a12_merchants", f"{_BEST.format(w=WITH_N, v=values(_MER))} SELECT n.tx_id, merchant, coalesce(category, 'none') AS category, {_CITY.format('title')} AS city FROM n LEFT JOIN (SELECT tx_id, merchant, category FROM h) h USING (tx_id)".replace("coalesce(category", "coalesce(h.category"))(
    lambda t: U.merchant_of(t.notes, t.spark.createDataFrame(_MER, _RULE), "tx_id", "title").join(t.notes.select("tx_id", U.city_of(F.col("title"), _CITIES).alias("city")), "tx_id")
)
query("a13_lenders", f"{_BEST.format(w=WITH_N, v=values(_LENDERS))} SELECT n.tx_id, merchant, coalesce(h.category, 'none') AS category FROM n LEFT JOIN h USING (tx_id)")(lambda t: U.merchant_of(t.notes, t.spark.createDataFrame(_LENDERS, _RULE), "tx_id", "title"))
_MOD = "CAST(concat(substr({0}, 3), '2521', substr({0}, 1, 2)) AS HUGEINT) % 97 = 1"
query("a15_accounts_in_text", rf"""{WITH_N}, t AS (SELECT tx_id, upper(title) AS x FROM n),
a AS (SELECT tx_id, substr(replace(unnest(regexp_extract_all(x, '\bPL\s?\d{{2}}(?:\s?\d{{4}}){{6}}\b')), ' ', ''), 3) AS v, 1 AS o FROM t UNION ALL SELECT tx_id, replace(unnest(regexp_extract_all(x, '\b\d{{2}}(?:\s\d{{4}}){{6}}\b')), ' ', ''), 2 FROM t
  UNION ALL SELECT tx_id, unnest(regexp_extract_all(x, '(?:NR\s+RACHUNKU|RACHUNK\w*|KONT[OA]|IBAN|NRB)[:\s]+(\d{{26}})\b', 1)), 3 FROM t),
f AS (SELECT tx_id, unnest(regexp_extract_all(x, '\bDE\d{{20}}\b')) AS v, 4 AS o FROM t),
k AS (SELECT * FROM a WHERE {_MOD.format('v')} OR (o > 1 AND substr(v, 3, 4) = '1140') UNION ALL SELECT * FROM f WHERE CAST(concat(substr(v, 5), '1314', substr(v, 3, 2)) AS HUGEINT) % 97 = 1),
d AS (SELECT tx_id, v, min(o) AS o FROM k GROUP BY 1, 2), g AS (SELECT tx_id, string_agg(v, ',' ORDER BY o) AS accounts FROM d GROUP BY 1) SELECT n.tx_id, coalesce(accounts, '') AS accounts FROM n LEFT JOIN g USING (tx_id)""")(
    lambda t: t.notes.select("tx_id", F.array_join(R.accounts_in(F.col("title"), ["1140"]), ",").alias("accounts"))
)
query("a24_keyword_kinds", f"{WITH_N} SELECT tx_id, array_to_string(list_filter([{', '.join(f'CASE WHEN regexp_matches(title, {p!r}) THEN {k!r} END' for k, p in (('cash', R.CASH), ('loan', R.LOAN), ('person', R.PERSON)))}], lambda v: v IS NOT NULL), ',') AS kinds FROM n".replace("\\\\", "\\"))(lambda t: t.notes.select("tx_id", R.keyword_kinds(F.col("title")).alias("kinds")))
_NAMES = [("Jan Kowalski", "own", 1), ("Anna Kowalska", "family", 1), ("Kowalski Jan; ul. Długa 5", "own", 0), ("Firma Sp. z o.o.", None, 0), ("Piotr Nowak", None, 1), ("Maria Wiśniewska", None, 1), ("Sklep 24", None, 0)]


@query("a55_account_discovery", rf"""{WITH_N}, k(payee, rel, person) AS (VALUES {values(_NAMES)}),
r AS (SELECT account_id, concat('ACC', CAST(account_id * 10 + tx_id % 9 + CASE WHEN payee = 'Jan Kowalski' THEN 0 ELSE 1000000 END AS VARCHAR)) AS referenced, direction, amount, booking_date, payee, title, rel, person, tx_id % 9 = 4 AND payee = 'Jan Kowalski' AS same FROM n JOIN k USING (payee)),
g AS (SELECT account_id, referenced, {D("sum(CASE WHEN direction = 'CREDIT' THEN amount ELSE 0 END)")} AS credit, {D("sum(CASE WHEN direction = 'DEBIT' THEN amount ELSE 0 END)")} AS debit, count(*) FILTER (direction = 'CREDIT') AS credits, count(*) FILTER (direction = 'DEBIT') AS debits, count(*) AS n, min(booking_date) AS first_day, max(booking_date) AS last_day,
  bool_or(same) AS same, count(*) FILTER (regexp_matches(title, 'własny')) AS own, count(*) FILTER (regexp_matches(title, '(?i)przelew\s*(na|z)\s*telefon')) AS phone, count(*) FILTER (regexp_matches(title, '(?i)wynagrodz')) AS salary FROM r GROUP BY 1, 2),
c AS (SELECT account_id, referenced, payee, rel, person, count(*) AS k, row_number() OVER (PARTITION BY account_id, referenced ORDER BY count(*) DESC, payee) AS r FROM r GROUP BY 1, 2, 3, 4, 5),
z AS (SELECT account_id, referenced, string_agg(payee, ',' ORDER BY r) FILTER (r <= 5) AS names, arg_min(rel, r) FILTER (rel IS NOT NULL) AS rel, bool_or(r = 1 AND person = 1) AS person FROM c GROUP BY 1, 2)
SELECT account_id, referenced, credit, debit, credits, debits, first_day, last_day, names, CASE WHEN same OR rel = 'own' OR (rel IS DISTINCT FROM 'family' AND own > 0 AND own * 2 >= n AND NOT (phone > 0 AND phone >= own)) THEN 'own' WHEN rel = 'family' THEN 'family'
  WHEN debits = 0 AND credits > 0 AND salary > 0 THEN 'employer' WHEN phone > 0 AND person THEN 'friend' ELSE 'third_party' END AS ownership FROM g JOIN z USING (account_id, referenced)""")
def a55(t):
    number = F.concat(F.lit("ACC"), (F.col("account_id") * 10 + F.col("tx_id") % 9 + F.when(F.col("payee") == "Jan Kowalski", 0).otherwise(1_000_000)).cast("string"))
    own = F.concat(F.lit("ACC"), (F.col("account_id") * 10 + 4).cast("string"))
    return R.account_discovery(t.notes.select("account_id", own.alias("own_number"), number.alias("referenced"), "direction", "amount", "booking_date", "payee", "holder", "title"))


_CARD = "CASE WHEN title LIKE '%4246 xxxx xxxx 9674%' THEN '4246**9674' WHEN title LIKE '%5500XXXXXXXX1111%' THEN '5500**1111' WHEN title LIKE '%*9674%' THEN '****9674' WHEN title LIKE '%kartą%' OR title LIKE '%karta%' THEN '****' ELSE '' END"


@query("a56_card_discovery", f"""{WITH_N}, v AS (SELECT *, {_CARD} AS card0, coalesce({_CITY.format('title')}, '') AS city FROM n),
k AS (SELECT DISTINCT account_id, right(card0, 4) AS last, card0 AS fullno FROM v WHERE card0 LIKE '____**____' AND card0 NOT LIKE '****%'), t AS (SELECT v.*, coalesce(CASE WHEN card0 = '****9674' THEN fullno END, card0) AS card FROM v LEFT JOIN k ON k.account_id = v.account_id AND last = '9674' AND card0 = '****9674' WHERE card0 <> ''),
g AS (SELECT account_id, card, count(*) AS n, {D("sum(CASE WHEN direction = 'CREDIT' THEN amount ELSE 0 END)")} AS credit, {D("sum(CASE WHEN direction = 'DEBIT' THEN amount ELSE 0 END)")} AS debit, count(*) FILTER (direction = 'DEBIT') AS debits, {D("max(amount)")} AS largest, min(booking_date) AS first_day, max(booking_date) AS last_day FROM t GROUP BY 1, 2),
{", ".join(f"{x} AS (SELECT account_id, card, string_agg({c}, ',' ORDER BY r) AS {x} FROM (SELECT account_id, card, {c}, row_number() OVER (PARTITION BY account_id, card ORDER BY {v} DESC, {c}) AS r FROM t WHERE {c} <> '' GROUP BY 1, 2, 3) WHERE r <= {m} GROUP BY 1, 2)" for x, c, v, m in (("categories", "category", "sum(amount)", 6), ("shops", "payee", "sum(amount)", 5), ("cities", "city", "count(*)", 8)))},
mo AS (SELECT account_id, card, string_agg(concat(m, '=', CAST(v AS VARCHAR)), ';' ORDER BY m) AS months FROM (SELECT account_id, card, {MONTH} AS m, CAST(floor(sum(amount)) AS BIGINT) AS v FROM t GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT g.*, coalesce(categories, '') AS categories, coalesce(shops, '') AS shops, coalesce(cities, '') AS cities, months FROM g LEFT JOIN categories USING (account_id, card) LEFT JOIN shops USING (account_id, card) LEFT JOIN cities USING (account_id, card) LEFT JOIN mo USING (account_id, card)
WHERE NOT (card = '****' AND debits <= 1 AND n - debits > debits AND n < 3)""")
def a56(t):
    out = R.card_discovery(t.notes.withColumn("city", U.city_of(F.col("title"), _CITIES)).withColumn("channel", F.lit("OTHER")))
    months = F.array_join(F.transform(F.map_entries("months"), lambda e: F.concat(e["key"], F.lit("="), F.floor(e["value"]).cast("string"))), ";")
    return out.withColumn("months", months)


FUEL = {"orlen": "Orlen", "shell": "Shell"}
SHOPS = {"biedronka": "Biedronka", "lidl": "Lidl"}
_TX = "lower(concat_ws(' ', payee, title))"
_SPEND = rf"""{WITH_N}, t AS (SELECT *, {_TX} AS t FROM n WHERE direction = 'DEBIT'),
s AS (SELECT *, CASE WHEN contains(t, 'orlen') THEN 'Orlen' WHEN contains(t, 'shell') THEN 'Shell' END AS station, CASE WHEN contains(t, 'biedronka') THEN 'Biedronka' WHEN contains(t, 'lidl') THEN 'Lidl' END AS shop, {_CITY.format('t')} AS city FROM t),
q AS (SELECT *, CASE WHEN station IS NOT NULL THEN 'fuel' WHEN bank_category = 'P.BLIK' OR contains(t, 'blik') THEN CASE WHEN contains(t, 'na telefon') THEN 'phone_transfer' WHEN contains(t, 'blik zakup') OR shop IS NOT NULL THEN 'online_purchase' ELSE 'payment' END WHEN shop IS NOT NULL THEN 'shop' ELSE 'other' END AS kind FROM s)"""


def _spent(t):
    return H.spending_rows(t.notes, FUEL, SHOPS, _CITIES)


query("f7_spending", f"{_SPEND} SELECT account_id, kind, count(*) AS n, {D('sum(amount)')} AS total FROM q GROUP BY 1, 2")(lambda t: _spent(t).groupBy("account_id", "kind").agg(F.count("*").alias("n"), B.money("amount").alias("total")))
query("f7_top_shops", f"""{_SPEND}, g AS (SELECT account_id, shop, count(*) AS n, {D('sum(amount)')} AS total FROM q WHERE shop IS NOT NULL AND kind IN ('shop', 'online_purchase') GROUP BY 1, 2)
SELECT * FROM (SELECT *, round(n / sum(n) OVER (PARTITION BY account_id), 4) AS share, row_number() OVER (PARTITION BY account_id ORDER BY n DESC, shop) AS rank FROM g) WHERE rank <= 5""")(lambda t: H.top_shops(_spent(t)))
query("f7_fuel_visits", f"""{_SPEND}, h AS (SELECT account_id, arg_min(city, (-k, city)) AS home FROM (SELECT account_id, city, count(*) AS k FROM q WHERE city IS NOT NULL AND kind IN ('fuel', 'shop') GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT account_id, station, coalesce(city, '') AS city, count(*) AS n, {D('sum(amount)')} AS total FROM q WHERE kind = 'fuel' GROUP BY 1, 2, 3)
SELECT g.*, coalesce(city = home, false) AS at_home, city <> '' AND NOT coalesce(city = home, false) AS travel FROM g LEFT JOIN h USING (account_id)""")(lambda t: H.fuel_visits(_spent(t)))
query("f7_people_paid", f"""{_SPEND} SELECT account_id, lower(trim(payee)) AS person, count(*) AS n, {D('sum(amount)')} AS total, max(booking_date) AS last_day FROM q WHERE kind = 'phone_transfer' GROUP BY 1, 2""")(lambda t: H.people_paid(_spent(t)))
query("f7_standing_orders", f"""{WITH_N} SELECT account_id, lower(trim(payee)) AS recipient, count(*) AS n, {D('sum(amount)')} AS total, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories, round({D('sum(amount)')} / count(*), 6) AS mean, true AS classified FROM n WHERE bank_category = 'ST.ZLEC' GROUP BY 1, 2""")(lambda t: H.standing_orders(t.notes))
query("a43_geographic_share", f"""{WITH_N}, r AS (SELECT account_id, tx_id, amount, {_CITY.format('title')} AS city FROM n), c AS (SELECT account_id, city, count(*) AS n, {D('sum(amount)')} AS total, array_to_string(list_sort(list(tx_id))[1:3], ',') AS ids FROM r WHERE city IS NOT NULL GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY n DESC, city) AS rank, sum(n) OVER (PARTITION BY account_id) AS all_n FROM c)
SELECT account_id, city, n, total, rank, round(n / all_n, 4) AS share, rank = 1 AS primary_city, CASE WHEN rank = 1 THEN '' ELSE ids END AS away_ids FROM k""")(lambda t: R.geographic_share(t.notes.withColumn("city", U.city_of(F.col("title"), _CITIES))))
query("a11_label_lookup", f"""{WITH_N}, l AS (SELECT * FROM (VALUES ('JAN KOWALSKI', 'whitelist'), ('sklep 24', 'blacklist')) v(name, label)) SELECT tx_id, coalesce(label, 'neutral') AS label FROM n LEFT JOIN l ON lower(name) = lower(payee)""")(
    lambda t: B.apply_labels(t.notes.select("tx_id", F.col("payee").alias("counterparty")), t.spark.createDataFrame([("JAN KOWALSKI", "whitelist"), ("sklep 24", "blacklist")], "counterparty string, label string")).select("tx_id", "label")
)
query("a18_masking", "SELECT c_custkey, substr(sha256(upper(regexp_replace(c_name, '[\\s-]', '', 'g'))), 1, 16) AS account_hash, concat('****', right(c_name, 4)) AS masked, concat(upper(substr(c_mktsegment, 1, 1)), '. ', upper(substr(c_name, 1, 1)), '.') AS holder FROM customer")(
    lambda t: t("customer").select("c_custkey", R.account_hash(F.col("c_name")).alias("account_hash"), R.masked(F.col("c_name")).alias("masked"), R.holder_label(F.concat_ws("  ", "c_mktsegment", "c_name")).alias("holder"))
)
query("a19_anonymous_label", "SELECT c_custkey, concat(c_mktsegment, '-', CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS VARCHAR)) AS label FROM customer")(lambda t: R.sequence_labels(t("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["c_custkey"]).select("c_custkey", "label"))
query("a62_counterparty_search", f"""{WITH_N}, a AS (SELECT DISTINCT counterparty, payee AS alias FROM n WHERE tx_id % 50 = 4), s AS (SELECT counterparty, count(*) AS times_seen FROM n GROUP BY 1)
SELECT * FROM s WHERE lower(counterparty) LIKE '%p1%' OR counterparty IN (SELECT counterparty FROM a WHERE lower(alias) LIKE '%p1%') ORDER BY times_seen DESC, counterparty LIMIT 50""")(lambda t: R.search_names(t.notes, t.notes.where("tx_id % 50 = 4").select("counterparty", F.col("payee").alias("alias")), "P1"))
query("f12_entity_stats", f"""{WITH_N} SELECT counterparty, count(DISTINCT account_id) AS accounts, count(*) AS n, {D("sum(amount)")} AS total, arg_max(category, (booking_date, tx_id)) AS last_category FROM n GROUP BY 1""")(lambda t: R.entity_stats(t.bank))

_ST = f"""{WITH_N}, m AS (SELECT account_id AS case_id, account_id * 100 + month(booking_date) AS statement_id, CASE WHEN month(booking_date) = 7 THEN 'X' ELSE 'A' END AS account_number, CASE WHEN account_id % 2 = 0 AND month(booking_date) = 3 THEN 'B2' ELSE 'B1' END AS bank_id,
  concat('h', CAST(month(booking_date) % 10 AS VARCHAR)) AS file_hash, min(booking_date) AS tx_min, max(booking_date) AS tx_max, count(*) AS tx_count, CAST(floor(sum(CASE WHEN direction = 'CREDIT' THEN amount ELSE -amount END)) AS BIGINT) AS net FROM n GROUP BY account_id, month(booking_date), month(booking_date) % 10),
s AS (SELECT *, tx_min + CASE WHEN statement_id % 5 = 0 THEN 2 ELSE 0 END AS period_from, tx_max + CASE WHEN statement_id % 4 = 0 THEN -1 WHEN statement_id % 7 = 0 THEN 3 ELSE 0 END AS period_to, CAST(net % 7 AS DOUBLE) AS opening, CAST(net % 3 AS DOUBLE) AS closing, tx_count + CASE WHEN statement_id % 6 = 0 THEN 3 ELSE 0 END AS declared FROM m)"""


def _statements(t):
    d = t.notes.withColumn("mo", F.month("booking_date"))
    net = F.floor(F.sum(F.expr("case when direction = 'CREDIT' then amount else -amount end"))).cast("long")
    m = d.groupBy(F.col("account_id").alias("case_id"), "mo").agg(F.min("booking_date").alias("tx_min"), F.max("booking_date").alias("tx_max"), F.count("*").alias("tx_count"), net.alias("net"))
    m = m.withColumn("statement_id", F.col("case_id") * 100 + F.col("mo"))
    return m.selectExpr(
        "case_id", "statement_id", "if(mo = 7, 'X', 'A') as account_number", "if(case_id % 2 = 0 and mo = 3, 'B2', 'B1') as bank_id", "concat('h', mo % 10) as file_hash", "tx_min", "tx_max", "tx_count",
        "date_add(tx_min, if(statement_id % 5 = 0, 2, 0)) as period_from", "date_add(tx_max, case when statement_id % 4 = 0 then -1 when statement_id % 7 = 0 then 3 else 0 end) as period_to",
        "cast(net % 7 as double) as opening", "cast(net % 3 as double) as closing", "tx_count + if(statement_id % 6 = 0, 3, 0) as declared",
    )


_V = "SELECT case_id, {0} AS statement_id, '{1}' AS type, '{2}' AS level, CAST({3} AS VARCHAR) AS detail FROM {4}"
_ID = "CAST(statement_id AS VARCHAR)"
query("a66_validate_statements", f"""{_ST}, l AS (SELECT *, lead(period_from) OVER w AS nf, lead(opening) OVER w AS no FROM s WINDOW w AS (PARTITION BY case_id ORDER BY period_from, statement_id)) {" UNION ALL ".join(_V.format(*x) for x in [
    ("NULL", "account_mismatch", "error", "a", "(SELECT case_id, count(DISTINCT account_number) AS a FROM s GROUP BY 1) WHERE a > 1"), ("NULL", "bank_mismatch", "warning", "a", "(SELECT case_id, count(DISTINCT bank_id) AS a FROM s GROUP BY 1) WHERE a > 1"),
    (_ID, "duplicate", "error", "file_hash", "(SELECT *, row_number() OVER (PARTITION BY case_id, file_hash ORDER BY period_from, statement_id) AS r FROM s) WHERE r > 1"), (_ID, "date_gap", "warning", "nf - period_to - 1", "l WHERE nf - period_to > 1"),
    (_ID, "date_overlap", "warning", "period_to - nf", "l WHERE nf - period_to < 0"), (_ID, "balance_break", "error", "CAST(round(closing - no, 2) AS DECIMAL(18,2))", "l WHERE abs(closing - no) > 0.01"), (_ID, "tx_before_period", "warning", "tx_min", "s WHERE tx_min < period_from"),
    (_ID, "tx_after_period", "warning", "tx_max", "s WHERE tx_max > period_to"), (_ID, "tx_incomplete", "warning", "declared - tx_count", "s WHERE tx_count < declared"),
])}""")(lambda t: B.validate_statements(_statements(t)))
_OUT = D("sum(CASE WHEN direction = 'DEBIT' THEN amount ELSE 0 END)")
_FLOWS = f"{WITH_N}, g AS (SELECT account_id, category AS label, {_OUT} AS outflow FROM n GROUP BY 1, 2)"
query("f16_budget_flags", f"""{_FLOWS}, s AS (SELECT *, outflow / sum(outflow) OVER (PARTITION BY account_id) AS share FROM g), k(label, low, high) AS (VALUES {values([(k, a, z) for k, (a, z) in H.BUDGET_FLAGS.items()])})
SELECT account_id, label, outflow, round(share, 6) AS share, CASE WHEN share > high THEN 'alarm' WHEN share > low THEN 'warning' ELSE 'none' END AS flag FROM s LEFT JOIN k USING (label)""")(lambda t: H.budget_flags(H.category_flows(t.bank, F.array("category"))))
query("f16_recurring_totals", f"""{WITH_N}, q AS (SELECT *, CAST(round(CAST(amount AS DOUBLE) / 10000) AS BIGINT) * 10000 AS bucket FROM n WHERE direction = 'DEBIT'), p AS (SELECT *, booking_date - lag(booking_date) OVER (PARTITION BY account_id, counterparty, bucket ORDER BY booking_date, tx_id) AS gap FROM q),
e AS (SELECT account_id, counterparty, bucket, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM p GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND avg(gap) BETWEEN 20 AND 40), c AS (SELECT account_id, counterparty, max(category) AS category FROM n WHERE tx_id % 3 = 0 GROUP BY 1, 2)
SELECT account_id, coalesce(category, 'unclassified') AS category, count(*) AS series, round(sum(total / n), 4) AS a_month, sum(total) AS total FROM e LEFT JOIN c USING (account_id, counterparty) GROUP BY 1, 2""")(
    lambda t: H.recurring_totals(H.monthly_recurrence(t.bank, bucket=10000), t.bank.where("tx_id % 3 = 0").groupBy("account_id", "counterparty").agg(F.max("category").alias("category")))
)
_TAGS = [("GAMBLING", 30.0), ("LOANS", 30.0), ("CRYPTO", 25.0), ("RISKY", 10.0)]
query("a17_risk_reasons", f"""{WITH_N}, w(tag, weight) AS (VALUES {values(_TAGS)}), a AS (SELECT account_id, {D("sum(amount)")} AS total FROM n GROUP BY 1),
g AS (SELECT account_id, CASE WHEN category = 'risky' THEN 'RISK:RISKY' ELSE upper(category) END AS tag, count(*) AS n, {D("sum(amount)")} AS amount, array_to_string(list_sort(list(tx_id))[1:10], ',') AS tx_ids FROM n WHERE category <> 'everyday' GROUP BY 1, 2),
p AS (SELECT g.*, weight, g.amount / total * 100 AS pct FROM g JOIN a USING (account_id) JOIN w ON w.tag = replace(g.tag, 'RISK:', '')), d AS (SELECT *, CASE WHEN pct < 10 THEN least(weight, weight * pct / 10) ELSE weight END AS delta FROM p)
SELECT account_id, tag, n, amount, round(pct, 6) AS pct, round(delta, 6) AS delta, tx_ids, row_number() OVER (PARTITION BY account_id ORDER BY delta DESC, tag) AS rank FROM d""")(
    lambda t: B.risk_reasons(
        t.bank.where("category <> 'everyday'").select("account_id", F.expr("if(category = 'risky', 'risk:risky', category)").alias("tag"), "amount", "tx_id"), t.spark.createDataFrame(_TAGS, "tag string, weight double"), t.bank.groupBy("account_id").agg(B.money("amount").alias("total"))
    ).withColumns({"pct": F.round("pct", 6), "delta": F.round("delta", 6)})
)
