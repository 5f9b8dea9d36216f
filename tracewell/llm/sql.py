"""DuckDB SQL for the queries that SQL can express."""

LOWER = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _lower(c: str) -> str:
    return LOWER.format(c=c)


def near_dups(k: int, percent: int) -> str:
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < {k} THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - {k} + 2), lambda i: array_to_string(ws[i : i + {k - 1}], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, t.b FROM r JOIN both_ways t ON t.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS c FROM r GROUP BY 1) m USING (doc_id)"""


def decontamination(size: int = 10) -> str:
    words = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {words.format(_lower("coalesce(text, '')"))} AS ws FROM documents),
i AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, {words.format(_lower("coalesce(text, '')"))} AS ws FROM benchmark WHERE item_id IS NOT NULL),
w AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {size} THEN [ws]
    ELSE list_transform(range(1, len(ws) - {size} + 2), lambda k: ws[k : k + {size - 1}]) END) AS win FROM i),
l AS (SELECT DISTINCT len(win) AS n FROM w),
g AS (
  SELECT doc_id, n, p, ws[p : p + n - 1] AS win FROM (
    SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, l WHERE len(ws) >= n)),
m AS (SELECT doc_id, p, n, item_id FROM g JOIN w USING (win)),
h AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS place FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM m GROUP BY 1)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


WHOLE = """v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""
PRODUCT = "CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT)"

TOP_K = f"""
WITH {WHOLE},
p AS (SELECT a.vec_id AS query_id, b.vec_id, {PRODUCT} AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY rank <= 5"""

HARD_NEGATIVES = f"""
WITH {WHOLE},
l AS (SELECT vec_id, q, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM v WHERE label IS NOT NULL),
p AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, {PRODUCT} AS score
  FROM l a JOIN l b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
pos AS (SELECT * FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT pos.anchor_id, pos.vec_id AS positive_id,
  CAST(row_number() OVER (PARTITION BY pos.anchor_id, pos.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
  n.vec_id AS negative_id, pos.score AS positive_score, n.score AS negative_score
FROM pos JOIN p n ON n.anchor_id = pos.anchor_id AND NOT n.same AND 80 * pos.score <= 100 * n.score AND n.score <= pos.score
QUALIFY rank <= 5"""

#: CRC-32 of a decimal id, bit by bit.
CRC32 = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
    lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295)"""

PREFIX_TRIE = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {CRC32} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, 0 AS own, t.place, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.place <= c.h
  UNION ALL SELECT c.conv_id, 1, t.place, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.place > c.h),
d AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, place) AS depth, role, text FROM r),
p AS (
  SELECT conv_id, depth, list({{'role': role, 'text': text}}) OVER (PARTITION BY conv_id ORDER BY depth) AS prefix FROM d
  UNION ALL SELECT conv_id, 0, [] FROM c),
full_length AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY 1),
n AS (SELECT depth, prefix, min(conv_id) AS node, count(*) AS n_convs FROM p GROUP BY 1, 2),
m AS (SELECT p.conv_id, p.depth, n.node, n.n_convs FROM p JOIN n USING (depth, prefix)),
own AS (
  SELECT n.node, n.depth, n.n_convs, up.node AS parent, (n.n_convs - 1) * coalesce(length(n.prefix[-1].text), 0) AS saved
  FROM n LEFT JOIN m up ON up.conv_id = n.node AND up.depth = n.depth - 1),
kids AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM own WHERE depth > 0 GROUP BY 1, 2),
under AS (
  SELECT a.node, a.depth, count(*) FILTER (WHERE k.n_children IS NULL) AS n_leaves, sum(o.saved) AS saved_tokens
  FROM own o JOIN m a ON a.conv_id = o.node AND a.depth <= o.depth LEFT JOIN kids k ON k.node = o.node AND k.depth = o.depth GROUP BY 1, 2),
e AS (SELECT m.node, m.depth, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM full_length JOIN m USING (conv_id, depth) GROUP BY 1, 2)
SELECT own.node AS conv_id, own.depth, own.parent AS parent_conv_id, own.n_convs, coalesce(kids.n_children, 0) AS n_children,
  under.n_leaves, CAST(under.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM own JOIN under USING (node, depth) LEFT JOIN kids USING (node, depth) LEFT JOIN e USING (node, depth)"""
