"""Queries over segments, texts, headers and logs, each with the same in SQL where it can be."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import segments as S
from .tables import WITH_T

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


query("t1_best_overlap", f"""{WITH_T}, s AS (SELECT conv_id, turn AS seg, t0 + 3 AS s0, t1 + 3 AS s1 FROM t),
h AS (SELECT s.conv_id, seg, turn, speaker, CAST(least(s1, t1) - greatest(s0, t0) AS DOUBLE) AS o FROM s JOIN t ON s.conv_id = t.conv_id AND least(s1, t1) > greatest(s0, t0)),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, seg ORDER BY o DESC, turn, speaker) AS r FROM h)
SELECT s.conv_id, s.seg, coalesce(speaker, 'UNKNOWN') AS speaker, coalesce(o, 0.0) AS overlap FROM (SELECT conv_id, seg FROM s) s LEFT JOIN b ON b.conv_id = s.conv_id AND b.seg = s.seg AND r = 1""")(
    lambda t: S.best_overlap(t.turns.select("conv_id", F.col("turn").alias("seg"), (F.col("t0") + 3).alias("s0"), (F.col("t1") + 3).alias("s1")), t.turns)
)
STRONG, MODERATE = ["license", "password="], ["the", "von", "que"]
query("t2_document_detector", f"""WITH p AS (SELECT doc_id, CAST({' + '.join(f'CASE WHEN regexp_matches(lower(text), {p!r}) THEN {w} ELSE 0 END' for w, ps in ((3, STRONG), (1, MODERATE)) for p in ps)} AS INT) AS points FROM documents) SELECT doc_id, points, points >= 3 AS document FROM p""")(
    lambda t: t("documents").select("doc_id", S.weighted_patterns(F.lower("text"), STRONG, MODERATE).cast("int").alias("points"), S.is_document(F.col("text"), STRONG, MODERATE).alias("document"))
)
TERMS = ["the ", "tion", "que"]
query("t3_glossary", "SELECT doc_id, sha256(replace(replace(replace(text, 'the ', '[[T0]]'), 'tion', '[[T1]]'), 'que', '[[T2]]')) AS protected_sha256, true AS restored FROM documents")(
    lambda t: t("documents").select("doc_id", F.sha2(S.protect(F.col("text"), TERMS).cast("binary"), 256).alias("protected_sha256"), (S.restore(S.protect(F.col("text"), TERMS), TERMS) == F.col("text")).alias("restored"))
)


#: The same fold, a sentence a step, by recursion over sentences.
@query("t4_sentence_chunks", r"""WITH RECURSIVE m AS (SELECT doc_id, regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g') AS t FROM documents),
p AS (SELECT doc_id, list_filter(string_split(t, chr(1)), lambda x: trim(x, chr(32)) <> '') AS parts FROM m),
s AS (SELECT doc_id, generate_subscripts(parts, 1) AS i, len(regexp_split_to_array(trim(unnest(parts), chr(32)), '\s+')) AS n FROM p),
r AS (SELECT doc_id, i, n, 0 AS chunk, n AS words FROM s WHERE i = 1 UNION ALL SELECT s.doc_id, s.i, s.n, CASE WHEN r.words > 0 AND r.words + s.n > 400 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.words > 0 AND r.words + s.n > 400 THEN s.n ELSE r.words + s.n END FROM r JOIN s ON s.doc_id = r.doc_id AND s.i = r.i + 1)
SELECT doc_id, chunk, CAST(sum(n) AS BIGINT) AS words, count(*) AS sentences FROM r GROUP BY 1, 2""")
def t4(t):
    return S.sentence_chunks(t("documents"))


query("t5_round_robin", r"""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents), e AS (SELECT doc_id, unnest(ls) AS content, generate_subscripts(ls, 1) - 1 AS line FROM l)
SELECT doc_id, line, concat('Speaker ', CAST(line % 2 + 1 AS VARCHAR)) AS speaker, length(content) AS chars FROM e""")(lambda t: S.round_robin(t("documents")))


#: Headers as files have them, a format's columns (order, column, names, patterns, required), and for SQL, which
#: has no matching blocks, the confidences (of name and header) that reach 0.55, computed by hand.
_HEADERS = ("Amount", "Booking-Date", "amuont", "Title of transfer", "zzz", "counterparty", "AMT pln", "date", "Titel", "Payee name", "booking_date", " Kwota ")
_COLUMNS = [(1, "amount", ["amount", "kwota"], ["^amt"], True), (2, "booking_date", ["booking date"], ["^date"], True), (3, "title", ["title"], [], True), (4, "counterparty", ["counterparty"], ["payee"], False)]
_SURE = [("booking date", "Booking-Date", 1.0), ("booking date", "booking_date", 1.0), ("booking date", "date", 0.5 + 0.4 * 4 / 12), ("amount", "amuont", 10 / 12), ("title", "Title of transfer", 0.5 + 0.4 * 5 / 17), ("title", "Titel", 8 / 10)]
_text = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_GREEDY = """{name}_l AS (SELECT file, list([{{'name_of': name_of, 'opts': opts, 'pos': -1}}] ORDER BY ord) AS todo FROM {options} GROUP BY 1),
{name} AS (SELECT file, t.name_of, t.pos AS position FROM (SELECT file, unnest(list_reduce(list_concat([[{{'name_of': '', 'opts': [-2], 'pos': -1}}]], todo),
  lambda a, b: list_concat(a, [{{'name_of': b[1].name_of, 'opts': [-2], 'pos': coalesce(list_filter(b[1].opts, lambda o: NOT list_contains(list_transform(a, lambda t: t.pos), o))[1], -1)}}]))) AS t FROM {name}_l) WHERE t.pos >= 0)""".format
_DRIFT = f"""WITH f AS (SELECT s_suppkey, unnest(range(6)) AS j FROM supplier),
h AS (SELECT concat('file', CAST(s_suppkey % 50 AS VARCHAR)) AS file, CAST((s_suppkey - s_suppkey % 50) / 50 * 6 + j AS INT) AS position, {_text(_HEADERS)}[(s_suppkey * 5 + j * j + j) % 12 + 1] AS header FROM f),
e(ord, name_of, names, patterns, required) AS (VALUES {", ".join(f"({o}, '{c}', {_text(n)}, CAST({_text(p)} AS VARCHAR[]), {r})" for o, c, n, p, r in _COLUMNS)}),
sure(name, header, conf) AS (VALUES {", ".join(f"('{a}', '{b}', CAST({c!r} AS DOUBLE))" for a, b, c in _SURE)}),
files AS (SELECT DISTINCT file FROM h),
x0 AS (SELECT file, name_of, position, row_number() OVER (PARTITION BY file, name_of ORDER BY i, position) AS r FROM h JOIN (SELECT name_of, unnest(names) AS name, generate_subscripts(names, 1) AS i FROM e) ON lower(trim(header)) = name),
x AS (SELECT file, name_of, position FROM x0 WHERE r = 1),
p0 AS (SELECT h.file, ord, name_of, list(position ORDER BY position) AS opts FROM h, e WHERE len(list_filter(patterns, lambda p: regexp_matches(lower(trim(header)), p, 'i'))) > 0
  AND NOT EXISTS (SELECT 1 FROM x WHERE x.file = h.file AND (x.name_of = e.name_of OR x.position = h.position)) GROUP BY 1, 2, 3),
{_GREEDY(name="p", options="p0")},
xp AS (SELECT *, 'exact' AS how FROM x UNION ALL SELECT *, 'pattern' FROM p),
z0 AS (SELECT h.file, ord, e.name_of, position, h.header, max(conf) AS conf FROM h, e, sure WHERE sure.header = h.header AND list_contains(names, sure.name)
  AND NOT EXISTS (SELECT 1 FROM xp WHERE xp.file = h.file AND (xp.name_of = e.name_of OR xp.position = h.position)) GROUP BY ALL),
z1 AS (SELECT file, ord, name_of, list(position ORDER BY conf DESC, position) AS opts FROM z0 GROUP BY 1, 2, 3),
{_GREEDY(name="z", options="z1")},
m AS (SELECT xp.file, 'bank' AS format, name_of, header, position, how, CAST(1 AS DOUBLE) AS confidence FROM xp JOIN h USING (file, position)
  UNION ALL SELECT z.file, 'bank', z.name_of, z0.header, z.position, 'fuzzy', round(conf, 4) FROM z JOIN z0 USING (file, name_of, position))"""


def _headers(t):
    at = t("supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("j"))
    header = F.element_at(F.array(*map(F.lit, _HEADERS)), ((F.col("s_suppkey") * 5 + F.col("j") * F.col("j") + F.col("j")) % 12 + 1).cast("int"))
    place = ((F.col("s_suppkey") - F.col("s_suppkey") % 50) / 50 * 6 + F.col("j")).cast("int")
    return at.select(F.concat(F.lit("file"), (F.col("s_suppkey") % 50).cast("string")).alias("file"), F.lit("bank").alias("format"), place.alias("position"), header.alias("header"))


def _columns(t):
    return t.spark.createDataFrame([("bank", *c) for c in _COLUMNS], "format string, ord int, name_of string, names array<string>, patterns array<string>, required boolean")


query("t6_header_drift", f"{_DRIFT} SELECT * FROM m")(lambda t: S.header_matches(_headers(t), _columns(t)))
query("t6_drift_levels", f"""{_DRIFT}, g AS (SELECT file, count(*) FILTER ((how <> 'fuzzy' OR confidence >= 0.85) AND required) AS found, count(*) FILTER (how = 'fuzzy') AS likely, avg(confidence) FILTER (how = 'fuzzy') AS mean, count(DISTINCT position) FILTER (how <> 'fuzzy' OR confidence >= 0.85) AS used FROM m JOIN e USING (name_of) GROUP BY 1),
c AS (SELECT file, count(*) AS headers FROM h GROUP BY 1), v AS (SELECT file, headers, 3 - coalesce(found, 0) AS missing, coalesce(found, 0) AS found, coalesce(likely, 0) AS likely, mean, coalesce(used, 0) AS used FROM c LEFT JOIN g USING (file))
SELECT file, 'bank' AS format, CASE WHEN missing = 0 AND likely = 0 THEN 'exact' WHEN missing = 0 THEN 'drift' WHEN found > 0 THEN 'partial' ELSE 'failed' END AS level,
  round(CASE WHEN missing = 0 AND likely = 0 THEN 1.0 WHEN missing = 0 THEN mean WHEN found > 0 THEN found / 3 ELSE 0.0 END, 4) AS confidence, missing, headers - used AS extra FROM v""")(lambda t: S.drift_levels(S.header_matches(_headers(t), _columns(t)), _headers(t), _columns(t)))
query("t7_audit_page", "SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('error', 'signup') ORDER BY ts DESC, event_id LIMIT 50 OFFSET 100")(
    lambda t: S.page_of(t("events").where("event_type in ('error', 'signup')"), [F.desc("ts"), F.col("event_id")], 2, 50).select("event_id", "user_id", "event_type")
)
