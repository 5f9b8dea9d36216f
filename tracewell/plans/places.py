"""Queries over movement and identity, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import places as P
from .notes import values
from .tables import WITH_C, WITH_M

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_L = f"{WITH_C}, p AS (SELECT *, 52 + 0.05 * (k % 12) AS lat, 21 + 0.03 * (k % 12) AS lon FROM c)"


def located(t):
    return t.cdr.withColumn("lat", (52 + F.lit(0.05) * (F.col("k") % 12)).cast("double")).withColumn("lon", (21 + F.lit(0.03) * (F.col("k") % 12)).cast("double"))


def _hav(a: str, b: str, c: str, d: str) -> str:
    h = f"pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)"
    return f"(2 * 6371000.0 * asin(sqrt(least({h}, 1.0))))"


_PATH = f"""l AS (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, lag(ts) OVER w AS ts0 FROM (SELECT * REPLACE (CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon) FROM p) WINDOW w AS (PARTITION BY subscriber ORDER BY ts, event_id)),
s AS (SELECT *, {_hav("lat0", "lon0", "lat", "lon")} AS metres, CAST(floor(epoch(ts)) - floor(epoch(ts0)) AS BIGINT) AS seconds FROM l WHERE lat0 IS NOT NULL)"""
query("m9_path", f"{_L}, {_PATH} SELECT subscriber, event_id, round(metres, 1) AS metres, seconds FROM s WHERE metres > 200")(lambda t: P.path(located(t)).select("subscriber", "event_id", F.round("metres", 1).alias("metres"), "seconds"))
query("m8_steps", f"""{_L}, {_PATH}, q AS (SELECT *, CASE WHEN seconds > 0 THEN metres / seconds * 3.6 END AS kmh FROM s WHERE metres > 5000)
SELECT subscriber, event_id, round(metres, 1) AS metres, seconds, CASE WHEN kmh > 250 AND metres > 100000 THEN 'plane' WHEN kmh IS NULL OR kmh > 250 THEN 'bts_hop' ELSE 'car' END AS mode FROM q""")(lambda t: P.trips(located(t)))
query("m5_home_and_work", f"""{WITH_C}, g AS (SELECT subscriber, place, count(*) FILTER (hour(ts) >= 22 OR hour(ts) < 6) AS night, count(*) FILTER (hour(ts) >= 8 AND hour(ts) < 16) AS work, count(*) FILTER (hour(ts) >= 8 AND hour(ts) < 16 AND isodow(ts) <= 5) AS week,
  count(DISTINCT CAST(ts AS DATE)) AS days FROM c GROUP BY 1, 2 HAVING count(DISTINCT CAST(ts AS DATE)) >= 3)
SELECT subscriber, arg_min(place, (-night * days, place)) AS home, arg_min(place, (CASE WHEN work > 0 THEN -days * week ELSE 0 END, place)) AS work FROM g GROUP BY 1""")(lambda t: P.home_and_work(t.cdr))
_ISL = """i AS (SELECT subscriber, event_id, ts, k >= 80 AS roaming FROM c),
j AS (SELECT *, CASE WHEN roaming <> coalesce(lag(roaming) OVER (PARTITION BY subscriber ORDER BY ts, event_id), NOT roaming) THEN 1 ELSE 0 END AS change FROM i),
k2 AS (SELECT *, sum(change) OVER (PARTITION BY subscriber ORDER BY ts, event_id) AS island FROM j),
g AS (SELECT subscriber, island, roaming, min(ts) AS from_ts, max(ts) AS to_ts, count(*) AS n FROM k2 GROUP BY 1, 2, 3),
x AS (SELECT subscriber, from_ts, to_ts, n FROM g JOIN (SELECT subscriber, max(island) AS last FROM g GROUP BY 1) USING (subscriber) WHERE roaming AND island > 1 AND island < last)"""


def _roaming(t):
    return t.cdr.withColumn("roaming", F.col("k") >= 80)


query("m10_crossings", f"{WITH_C}, {_ISL} SELECT * FROM x")(lambda t: P.crossings(_roaming(t)))
query("m11_merge_crossings", f"""{WITH_C}, {_ISL}, b AS (SELECT *, max(to_ts) OVER (PARTITION BY subscriber ORDER BY from_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x),
m AS (SELECT *, sum(CASE WHEN floor(epoch(from_ts)) - floor(epoch(before)) <= 86400 THEN 0 ELSE 1 END) OVER (PARTITION BY subscriber ORDER BY from_ts) AS trip FROM b)
SELECT subscriber, CAST(trip AS BIGINT) AS trip, min(from_ts) AS from_ts, max(to_ts) AS to_ts, CAST(sum(n) AS BIGINT) AS n, count(*) AS parts FROM m GROUP BY 1, 2""")(lambda t: P.merge_crossings(P.crossings(_roaming(t))))
query("m3_haversine", f"SELECT event_id, round({_hav('52.0', '21.0', '(52 + value / 100)', '(21 + value / 50)')}, 1) AS metres FROM events")(
    lambda t: t.cdr.select("event_id", F.round(P.haversine(F.lit(52.0), F.lit(21.0), 52 + F.col("value") / 100, 21 + F.col("value") / 50), 1).alias("metres"))
)
query("m16_bounds", f"{WITH_M} SELECT subscriber, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, min(lat) AS lat0, max(lat) AS lat1, min(lon) AS lon0, max(lon) AS lon1, count(*) AS n FROM p GROUP BY 1")(lambda t: P.bounds(t.moves))
query("m18_in_area", f"{_L} SELECT event_id FROM p WHERE {_hav('CAST(lat AS DOUBLE)', 'CAST(lon AS DOUBLE)', '52.2', '21.1')} <= 15000")(lambda t: P.in_area(located(t), 52.2, 21.1, 15000).select("event_id"))
query("m18_in_rectangle", f"{_L} SELECT event_id FROM p WHERE CAST(lat AS DOUBLE) BETWEEN 52.1 AND 52.3 AND CAST(lon AS DOUBLE) BETWEEN 21.05 AND 21.2")(lambda t: P.in_rectangle(located(t), 52.1, 21.05, 52.3, 21.2).select("event_id"))
query("m17_modal_place", f"""{WITH_C}, v AS (SELECT k % 12 AS cluster, CASE WHEN k % 7 <> 0 THEN place END AS city, concat('st', CAST(event_id % 5 AS VARCHAR)) AS street FROM c), a AS (SELECT cluster, arg_min(city, (-n, city)) AS city FROM (SELECT cluster, city, count(*) AS n FROM v WHERE city <> '' GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT cluster, arg_min(street, (-n, street)) AS street FROM (SELECT cluster, street, count(*) AS n FROM v GROUP BY 1, 2) GROUP BY 1) SELECT cluster, city, street FROM a FULL JOIN b USING (cluster)""")(
    lambda t: P.modal_labels(t.cdr.selectExpr("k % 12 as cluster", "if(k % 7 <> 0, place, null) as city", "concat('st', cast(event_id % 5 as string)) as street"), ["cluster"], ["city", "street"])
)
#: Cells out of the located records: a cell is what a site and a radio kind make.
_CELLS = f"""{WITH_M}, s AS (SELECT concat('c', CAST(k AS VARCHAR), '-', CAST(subscriber % 7 AS VARCHAR)) AS cell, min(lat) AS lat, min(lon) AS lon, CASE k % 3 WHEN 0 THEN 'uke' WHEN 1 THEN 'billing' ELSE 'opencellid' END AS source, CASE k % 2 WHEN 0 THEN 'LTE' ELSE 'GSM' END AS radio, concat('city', CAST(k % 12 AS VARCHAR)) AS city FROM p GROUP BY k, subscriber % 7)"""


def _cells(t):
    g = t.moves.groupBy("k", (F.col("subscriber") % 7).alias("m")).agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    return g.selectExpr("concat('c', cast(k as string), '-', cast(m as string)) as cell", "lat", "lon", "case k % 3 when 0 then 'uke' when 1 then 'billing' else 'opencellid' end as source", "if(k % 2 = 0, 'LTE', 'GSM') as radio", "concat('city', cast(k % 12 as string)) as city")


query("m15_cell_stats", f"{_CELLS} SELECT source, radio, count(*) AS n, count(DISTINCT city) AS cities FROM s GROUP BY GROUPING SETS ((source), (radio), ())")(lambda t: P.cell_stats(_cells(t)))
query("m14_cells_near", f"{_CELLS} SELECT *, round(abs(lat - 50.7) + abs(lon - 19.9), 6) AS distance FROM s WHERE lat BETWEEN 49.9 AND 51.5 AND lon BETWEEN 19.1 AND 20.7 ORDER BY distance, cell LIMIT 200")(lambda t: P.cells_near(_cells(t), 50.7, 19.9, 0.8))


#: Cells in greedy order, folded: a cell that no seed so far touches is a seed.
_CLUSTERS = """g AS (SELECT subscriber, CAST(trunc({y} / (500.0 / 111000)) AS BIGINT) AS cy, CAST(trunc({x} / (500.0 / 111000)) AS BIGINT) AS cx, count(*) AS n, sum({y}) AS sy, sum({x}) AS sx, min((ts, event_id)) AS seen FROM {src} GROUP BY 1, 2, 3),
go AS (SELECT *, row_number() OVER (PARTITION BY subscriber ORDER BY n DESC, seen) AS turn FROM g),
gl AS (SELECT subscriber, list([{{'cy': cy, 'cx': cx, 'turn': turn}}] ORDER BY turn) AS todo FROM go WHERE n >= 3 GROUP BY 1),
sd AS (SELECT subscriber, unnest(list_reduce(todo, lambda a, b: CASE WHEN len(list_filter(a, lambda s: abs(s.cy - b[1].cy) <= 1 AND abs(s.cx - b[1].cx) <= 1)) > 0 THEN a ELSE list_concat(a, b) END)) AS s FROM gl),
js AS (SELECT a.subscriber, a.cy, a.cx, a.n, a.sy, a.sx, min(s.turn) AS seed FROM go a JOIN sd ON sd.subscriber = a.subscriber AND abs(a.cy - s.cy) <= 1 AND abs(a.cx - s.cx) <= 1 GROUP BY ALL),
cl AS (SELECT subscriber, seed, CAST(sum(n) AS BIGINT) AS n, sum(sy) / sum(n) AS lat, sum(sx) / sum(n) AS lon, count(*) AS cells FROM js GROUP BY 1, 2),
kc AS (SELECT * EXCLUDE (seed), row_number() OVER (PARTITION BY subscriber ORDER BY n DESC, seed) AS cluster FROM cl), cs AS (SELECT * FROM kc WHERE cluster <= 30)"""
_NEAR = f"{WITH_C}, q AS (SELECT *, CAST(k * 0.004 + 50 AS DOUBLE) AS y, CAST((k % 10) * 0.003 + 20 AS DOUBLE) AS x FROM c), {_CLUSTERS.format(y='y', x='x', src='q')}"


def _near(t):
    """Points about the masts, spread so that cells have neighbours."""
    return t.cdr.withColumns({"lat": F.expr("cast(k * 0.004 + 50 as double)"), "lon": F.expr("cast((k % 10) * 0.003 + 20 as double)")})


@query("m4_clusters", f"{_NEAR} SELECT subscriber, cluster, n, cells, round(lat, 6) AS lat, round(lon, 6) AS lon FROM cs")
def m4(t):
    return P.clusters(_near(t)).select("subscriber", "cluster", "n", "cells", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("m7_nearest_cluster", f"{_NEAR}, m AS (SELECT q.subscriber, event_id, cluster, round({_hav('q.y', 'q.x', 'lat', 'lon')}, 1) AS metres FROM q JOIN cs USING (subscriber)) SELECT subscriber, event_id, arg_min(cluster, (metres, cluster)) AS cluster, min(metres) AS metres FROM m GROUP BY 1, 2")
def m7(t):
    return P.nearest_of(_near(t).select("subscriber", "event_id", "lat", "lon"), P.clusters(_near(t))).drop("lat", "lon")


_TRIPS = f"""{WITH_M}, {_CLUSTERS.format(y='lat', x='lon', src='p')}, m AS (SELECT p.subscriber, event_id, ts, cluster, round({_hav('p.lat', 'p.lon', 'cs.lat', 'cs.lon')}, 1) AS metres FROM p JOIN cs USING (subscriber)),
nr AS (SELECT subscriber, event_id, ts, arg_min(cluster, (metres, cluster)) AS cluster FROM m GROUP BY 1, 2, 3), lg AS (SELECT *, lag(cluster) OVER w AS c0, lag(ts) OVER w AS ts0 FROM nr WINDOW w AS (PARTITION BY subscriber ORDER BY ts, event_id)),
d AS (SELECT lg.subscriber, event_id, c0, lg.cluster, {_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} / 1000 AS km, CASE WHEN floor(epoch(ts)) > floor(epoch(ts0)) THEN (floor(epoch(ts)) - floor(epoch(ts0))) / 60 ELSE 0.01 END AS minutes FROM lg JOIN cs a ON a.subscriber = lg.subscriber AND a.cluster = c0 JOIN cs b ON b.subscriber = lg.subscriber AND b.cluster = lg.cluster WHERE c0 <> lg.cluster),
v AS (SELECT *, km / (minutes / 60) AS kmh, CASE WHEN km < 30 THEN km / 40 WHEN km < 150 THEN km / 70 ELSE km / 90 END * 60 AS car FROM d WHERE km >= 5),
z AS (SELECT *, CASE WHEN (minutes < 3 AND km > 5) OR (minutes < 10 AND kmh > 300) OR (minutes < 15 AND kmh > 500) THEN 'bts_hop' WHEN (km > 200 AND kmh > 200) OR (km > 400 AND minutes < car * 0.4) THEN 'plane' WHEN kmh BETWEEN 10 AND 200 OR minutes / car BETWEEN 0.3 AND 4 THEN 'car' ELSE 'unknown' END AS mode FROM v)
SELECT subscriber, event_id, c0 AS from_cluster, cluster AS to_cluster, round(km, 1) AS km, round(minutes, 1) AS minutes, round(kmh, 0) AS kmh, mode FROM z WHERE mode <> 'bts_hop'"""
query("m8_trips", _TRIPS)(lambda t: P.cluster_trips(t.moves, P.clusters(t.moves)))
_BORDER = f"""{WITH_M}, j AS (SELECT *, CASE WHEN roaming <> coalesce(lag(roaming) OVER w, NOT roaming) THEN 1 ELSE 0 END AS change, lag(ts) OVER w AS ts0, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM p WINDOW w AS (PARTITION BY subscriber ORDER BY ts, event_id)),
k AS (SELECT *, sum(change) OVER (PARTITION BY subscriber ORDER BY ts, event_id) AS island FROM j),
g AS (SELECT subscriber, island, roaming, min(ts) AS a, max(ts) AS z, count(*) AS n, coalesce(array_to_string(list_sort(list(DISTINCT country)), ','), '') AS countries, arg_max(lat, (ts, event_id)) AS la, arg_max(lon, (ts, event_id)) AS lo FROM k GROUP BY 1, 2, 3),
h AS (SELECT *, lag(z) OVER v AS left_ts, lead(a) OVER v AS back_ts, lag(la) OVER v AS lat, lag(lo) OVER v AS lon FROM g WINDOW v AS (PARTITION BY subscriber ORDER BY island)),
u AS (SELECT subscriber, left_ts, back_ts, n AS records, countries, true AS confirmed, lat, lon, coalesce(back_ts, z) AS until FROM h WHERE roaming AND (left_ts IS NOT NULL OR back_ts IS NOT NULL)
  UNION ALL SELECT subscriber, ts0, ts, 0, '', false, lat0, lon0, ts FROM j WHERE floor(epoch(ts)) - floor(epoch(ts0)) >= 172800 AND subscriber NOT IN (SELECT subscriber FROM p WHERE roaming)),
x AS (SELECT * EXCLUDE (until), round(coalesce((floor(epoch(until)) - floor(epoch(left_ts))) / 3600, 0), 1) AS absence_hours FROM u)"""
query("m10_border_crossings", f"{_BORDER} SELECT * FROM x")(lambda t: P.border_crossings(t.moves))
_AIR = [("A", 52.11, 20.81), ("B", 50.03, 19.02), ("C", 50.72, 19.95)]
_NEIGHBOURS = ["DE", "CZ", "SK", "UA", "BY", "LT", "RU"]


def _air(t):
    return t.spark.createDataFrame(_AIR, "airport string, alat double, alon double")


_NEAREST = f"""a(airport, alat, alon) AS (VALUES {values(_AIR)}), w AS (SELECT DISTINCT lat, lon FROM {{0}} WHERE lat IS NOT NULL), na AS (SELECT lat, lon, arg_min(airport, (d, airport)) AS airport, round(min(d), 1) AS metres FROM (SELECT lat, lon, airport, {_hav('lat', 'lon', 'alat', 'alon')} AS d FROM w, a) WHERE d <= 15000 GROUP BY 1, 2)"""
query("m12_crossing_mode", f"""{_BORDER}, {_NEAREST.format('x')}, q AS (SELECT x.*, airport, list_filter(string_split(countries, ','), lambda c: c <> '') AS cs FROM x LEFT JOIN na USING (lat, lon)),
f AS (SELECT *, len(list_filter(cs, lambda c: c NOT IN ({', '.join(f"'{c}'" for c in _NEIGHBOURS)}))) > 0 AS far FROM q)
SELECT * EXCLUDE (cs, far), CASE WHEN far OR (airport IS NOT NULL AND absence_hours < 12 AND len(cs) > 0) THEN 'plane' WHEN absence_hours < 6 THEN 'walk' WHEN len(cs) > 0 THEN 'car' ELSE 'unknown' END AS mode FROM f""")(lambda t: P.crossing_mode(P.border_crossings(t.moves), _air(t), _NEIGHBOURS))
query("m12_airports", f"{WITH_M}, {_NEAREST.format('p')} SELECT event_id AS id, airport, metres FROM p JOIN na USING (lat, lon)")(lambda t: P.near_airport(t.moves.select(F.col("event_id").alias("id"), "lat", "lon"), _air(t)))
query("m13_last_day_path", f"""{_BORDER}, o AS (SELECT DISTINCT x.subscriber, left_ts, ts, round(p.lat, 3) AS lat, round(p.lon, 3) AS lon FROM x JOIN p ON p.subscriber = x.subscriber AND NOT roaming AND ts <= left_ts AND ts >= left_ts - INTERVAL 24 HOUR),
e AS (SELECT subscriber, left_ts, lat, lon, min(ts) AS first_ts FROM o GROUP BY 1, 2, 3, 4) SELECT *, row_number() OVER (PARTITION BY subscriber, left_ts ORDER BY first_ts, lat, lon) AS step FROM e""")(lambda t: P.last_day_path(P.border_crossings(t.moves), t.moves))


@query("m2_resolve_points", f"""{WITH_C}, s(cell, source, lat, lon) AS (VALUES ('BTS-1', 'manual', 1.0, 1.0), ('BTS-1', 'uke', 52.1, 21.1), ('BTS-2', 'opencellid', 52.2, 21.2), ('BTS-3', 'billing', 52.3, 21.3), ('BTS-3', 'opencellid', 9.0, 9.0)),
r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY CASE source WHEN 'uke' THEN 0 WHEN 'billing' THEN 1 WHEN 'opencellid' THEN 2 ELSE 3 END) AS n FROM s),
a AS (SELECT concat('mast street ', CAST(n_nationkey AS VARCHAR)) AS address, 40.0 + n_nationkey AS lat, 10.0 + n_nationkey AS lon FROM nation)
SELECT event_id, CASE WHEN c.k % 5 = 0 THEN 50.0 ELSE coalesce(r.lat, a.lat) END AS lat, CASE WHEN c.k % 5 = 0 THEN 20.0 ELSE coalesce(r.lon, a.lon) END AS lon,
  CASE WHEN c.k % 5 = 0 THEN 'direct' WHEN r.source IS NOT NULL THEN r.source WHEN a.address IS NOT NULL THEN 'address' ELSE 'none' END AS source
FROM c LEFT JOIN r ON r.cell = c.place AND r.n = 1 LEFT JOIN a ON c.k % 7 > 1 AND a.address = concat('mast street ', CAST(c.k AS VARCHAR))""")
def m2(t):
    stations = t.spark.createDataFrame([("BTS-1", "manual", 1.0, 1.0), ("BTS-1", "uke", 52.1, 21.1), ("BTS-2", "opencellid", 52.2, 21.2), ("BTS-3", "billing", 52.3, 21.3), ("BTS-3", "opencellid", 9.0, 9.0)], "cell string, source string, lat double, lon double")
    own = t.cdr.select("event_id", F.col("place").alias("cell"), F.expr("if(k % 5 = 0, 50.0D, null)").alias("own_lat"), F.expr("if(k % 5 = 0, 20.0D, null)").alias("own_lon"), F.expr("case when k % 7 > 1 then concat('  Mast  STREET ', k, ' ') end").alias("address"))
    cache = t("nation").selectExpr("concat('Mast street ', n_nationkey) as address", "40.0D + n_nationkey as lat", "10.0D + n_nationkey as lon")
    return P.resolve_points(own, stations, cache)


_ID = "WITH i AS (SELECT c_custkey AS record_id, CAST(500000000 + c_custkey % 900 AS VARCHAR) AS number, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 700 END AS person_id, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS segment, c_nationkey % 4 AS operator FROM customer), q AS (SELECT *, CASE WHEN person_id IS NOT NULL THEN 40 ELSE 0 END + CASE WHEN name IS NOT NULL THEN 30 ELSE 0 END + CASE WHEN segment IS NOT NULL THEN 20 ELSE 0 END + 10 AS quality FROM i)"


def _ids(t):
    return t("customer").selectExpr("c_custkey as record_id", "cast(500000000 + c_custkey % 900 as string) as number", "if(c_custkey % 4 <> 0, c_custkey % 700, null) as person_id", "if(c_custkey % 3 <> 0, c_name, null) as name", "if(c_custkey % 5 <> 0, c_mktsegment, null) as segment", "c_nationkey % 4 as operator")


query("i1_canonical_number", "SELECT c_custkey, right(regexp_replace(concat('+48-', c_name), '[^0-9]', '', 'g'), 9) AS number FROM customer")(lambda t: t("customer").select("c_custkey", P.last_number(F.concat(F.lit("+48-"), "c_name")).alias("number")))
query("i4_record_quality", f"{_ID} SELECT record_id, quality FROM q")(lambda t: P.record_quality(_ids(t)).select("record_id", "quality"))
query("i5_best_records", f"{_ID} SELECT number, record_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY number ORDER BY quality DESC, record_id) AS r FROM q) WHERE r = 1")(lambda t: P.best_records(_ids(t)).select("number", "record_id", "quality"))
_FIRST = "coalesce({c}, {g}first_value({c} IGNORE NULLS) OVER (PARTITION BY {by} ORDER BY quality DESC, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING){e}) AS {c}"


def _fill(by: str, src: str, guard: str = "", end: str = "") -> str:
    return f"SELECT record_id, number, quality, {', '.join(_FIRST.format(c=c, by=by, g=guard, e=end) for c in ('person_id', 'name', 'segment', 'operator'))} FROM {src}"


query("i6_cross_enrich", f"{_ID}, a AS ({_fill('number', 'q')}) {_fill('person_id', 'a', 'CASE WHEN person_id IS NOT NULL THEN ', ' END')}")(lambda t: P.cross_enrich(_ids(t)))
query("i7_identity_groups", f"{_ID} SELECT person_id, count(DISTINCT number) AS numbers, count(DISTINCT operator) AS operators, any_value(best) AS name FROM (SELECT *, first_value(name) OVER (PARTITION BY person_id ORDER BY quality DESC, record_id) AS best FROM q WHERE person_id IS NOT NULL) GROUP BY 1 HAVING count(DISTINCT number) >= 2")(lambda t: P.identity_groups(_ids(t)))
query("i8_operator_history", f"{_ID}, d AS (SELECT *, lag(operator) OVER (PARTITION BY person_id ORDER BY record_id) AS b FROM q WHERE person_id IS NOT NULL) SELECT person_id, count(*) - 1 AS migrations, string_agg(CAST(operator AS VARCHAR), '>' ORDER BY record_id) AS path FROM d WHERE b IS NULL OR b <> operator GROUP BY 1")(
    lambda t: P.operator_history(_ids(t)).withColumn("migrations", F.col("migrations").cast("long"))
)
_NAMED = "CASE c_custkey % 9 WHEN 0 THEN 'Numer obsługiwany przez innego' WHEN 1 THEN 'brak danych' WHEN 2 THEN 'Firma Sp. z o.o.' WHEN 3 THEN 'Jan Nowak' WHEN 4 THEN 'jan' WHEN 5 THEN NULL WHEN 6 THEN '' ELSE c_name END"
_TYPE = "CASE c_custkey % 9 WHEN 0 THEN 'other_operator' WHEN 1 THEN 'not_found' WHEN 2 THEN 'company' WHEN 3 THEN CASE WHEN c_custkey % 8 = 0 THEN 'company' ELSE 'person' END WHEN 5 THEN 'unknown' WHEN 6 THEN 'unknown' ELSE CASE WHEN c_custkey % 4 <> 0 THEN 'person' WHEN c_custkey % 8 = 0 THEN 'company' ELSE 'unknown' END END"
query("i10_result_type", f"SELECT c_custkey, {_TYPE} AS kind FROM customer")(lambda t: t("customer").select("c_custkey", P.result_type(F.expr(_NAMED), F.expr("if(c_custkey % 4 <> 0, c_custkey, null)"), F.expr("if(c_custkey % 8 = 0, c_custkey, null)")).alias("kind")))
_MAIN = ["500000003", "500000010", "500000021"]


def _answers(t):
    kind = P.result_type(F.expr(_NAMED), F.expr("if(c_custkey % 4 <> 0, c_custkey, null)"), F.expr("if(c_custkey % 8 = 0, c_custkey, null)"))
    return t("customer").select(F.col("c_custkey").alias("record_id"), F.expr("cast(500000000 + c_custkey % 90 as string)").alias("number"), F.expr("cast(c_nationkey % 4 as string)").alias("operator"), F.expr("if(c_custkey % 4 <> 0, c_custkey % 70, null)").alias("person_id"), F.expr(_NAMED).alias("name"), kind.alias("kind"))


query("i9_identity_anomalies", f"""WITH i AS (SELECT CAST(500000000 + c_custkey % 90 AS VARCHAR) AS number, CAST(c_nationkey % 4 AS VARCHAR) AS operator, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 70 END AS person_id, {_NAMED} AS name, {_TYPE} AS kind FROM customer),
g AS (SELECT person_id, bool_or(number IN ({', '.join(f"'{m}'" for m in _MAIN)})) AS m, array_to_string(list_sort(list(DISTINCT number)), ',') AS detail FROM i WHERE person_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT number) >= 2)
SELECT CAST(person_id AS VARCHAR) AS subject, CASE WHEN m THEN 'multi_number_main_owner' ELSE 'multi_number_contact' END AS type, CASE WHEN m THEN 'warning' ELSE 'info' END AS severity, detail FROM g
UNION ALL SELECT number, 'number_migration', 'info', array_to_string(list_sort(list(DISTINCT operator)), ',') FROM i GROUP BY 1 HAVING count(DISTINCT operator) >= 2
UNION ALL SELECT number, 'data_enriched', 'info', min(name) FILTER (kind NOT IN ('not_found', 'other_operator')) FROM i GROUP BY 1 HAVING count(*) FILTER (kind IN ('not_found', 'other_operator')) > 0 AND count(*) FILTER (kind NOT IN ('not_found', 'other_operator') AND name IS NOT NULL) > 0""")(lambda t: P.identity_anomalies(_answers(t), _MAIN))
_FILES = f"{WITH_C}, v AS (SELECT concat('f', CAST(subscriber % 50 AS VARCHAR), '-', CAST(event_id % 3 AS VARCHAR)) AS file, event_id % 2 AS operator, unnest([concat('+48', CAST(600000000 + subscriber % 50 AS VARCHAR)), contact, CASE WHEN event_id % 5 = 0 THEN '112' END]) AS number FROM c), g AS (SELECT file, right(number, 9) AS number, count(*) AS k FROM v WHERE length(number) >= 9 GROUP BY 1, 2), s AS (SELECT file, arg_min(number, (-k, number)) AS number, max(k) AS n FROM g GROUP BY 1)"


def _files(t):
    r = t.cdr.select(F.expr("concat('f', cast(subscriber % 50 as string), '-', cast(event_id % 3 as string))").alias("file"), F.expr("concat('+48', cast(600000000 + subscriber % 50 as string))").alias("a"), F.col("contact").alias("b"), F.expr("if(event_id % 5 = 0, '112', null)").alias("c"))
    return P.file_subscriber(r, ["a", "b", "c"])


query("i2_file_subscriber", f"{_FILES} SELECT * FROM s")(_files)
query("i3_group_files", f"""{_FILES}, q AS (SELECT *, CASE WHEN right(file, 1) = '2' THEN 'y' ELSE 'x' END AS operator FROM s), h AS (SELECT number, count(*) AS files, count(DISTINCT operator) AS operators, CAST(sum(n) AS BIGINT) AS records, array_to_string(list_sort(list(file)), ',') AS names FROM q GROUP BY 1)
SELECT *, CASE WHEN files = 1 THEN 'single' WHEN operators > 1 THEN 'several_operators' ELSE 'same_operator' END AS reason FROM h""")(lambda t: P.file_groups(_files(t).withColumn("operator", F.when(F.right("file", F.lit(1)) == "2", "y").otherwise("x"))))


_HW = """hw AS (SELECT subscriber, arg_min(place, (-night * days, place)) AS home, arg_min(place, (CASE WHEN work > 0 THEN -days * week ELSE 0 END, place)) AS work FROM (SELECT subscriber, place, count(*) FILTER (hour(ts) >= 22 OR hour(ts) < 6) AS night, count(*) FILTER (hour(ts) >= 8 AND hour(ts) < 16) AS work,
  count(*) FILTER (hour(ts) >= 8 AND hour(ts) < 16 AND isodow(ts) <= 5) AS week, count(DISTINCT CAST(ts AS DATE)) AS days FROM p GROUP BY 1, 2 HAVING count(DISTINCT CAST(ts AS DATE)) >= 3) GROUP BY 1)"""
_TURN = "abs(degrees(atan2(w.lon - h.lon, w.lat - h.lat) - atan2(g.lon - h.lon, g.lat - h.lat)))"


@query("m6_transit", f"""{_L.replace('52 + 0.05 * (k % 12) AS lat', 'CAST(52 + 0.05 * (k % 12) AS DOUBLE) AS lat').replace('21 + 0.03 * (k % 12) AS lon', 'CAST(21 + 0.03 * (k % 12) AS DOUBLE) AS lon')}, {_HW},
dw AS (SELECT subscriber, place, CAST(ts AS DATE) AS day, max(hour(ts) * 60 + minute(ts)) - min(hour(ts) * 60 + minute(ts)) AS dwell FROM p GROUP BY 1, 2, 3), st AS (SELECT subscriber, place, list_sort(list(dwell))[count(*) // 2 + 1] AS dwell, count(*) AS days FROM dw GROUP BY 1, 2),
g AS (SELECT subscriber, place, count(*) AS n, count(*) FILTER (hour(ts) BETWEEN 6 AND 8 OR hour(ts) BETWEEN 16 AND 18) AS commute, min(lat) AS lat, min(lon) AS lon FROM p GROUP BY 1, 2),
j AS (SELECT g.subscriber, g.place, g.n, g.commute, st.dwell, st.days, home, work, CASE WHEN {_TURN} > 180 THEN 360 - {_TURN} ELSE {_TURN} END AS turn, {_hav('h.lat', 'h.lon', 'w.lat', 'w.lon')} AS hw, {_hav('h.lat', 'h.lon', 'g.lat', 'g.lon')} AS hc, {_hav('g.lat', 'g.lon', 'w.lat', 'w.lon')} AS cw
  FROM g JOIN st ON st.subscriber = g.subscriber AND st.place = g.place LEFT JOIN hw ON hw.subscriber = g.subscriber LEFT JOIN g h ON h.subscriber = g.subscriber AND h.place = home LEFT JOIN g w ON w.subscriber = g.subscriber AND w.place = work),
s AS (SELECT subscriber, place, CASE WHEN dwell < 15 THEN 25 ELSE 0 END + CASE WHEN commute / n > 0.7 THEN 25 ELSE 0 END + CASE WHEN home <> work AND turn <= 30 AND hc < hw * 1.3 AND cw < hw * 1.3 THEN 25 ELSE 0 END + CASE WHEN n / days <= 1.5 THEN 25 ELSE 0 END AS score FROM j WHERE NOT coalesce(place = home OR place = work, false))
SELECT subscriber, place, score, score >= 50 AS transit FROM s""")
def m6(t):
    r = located(t)
    return P.transit(r, P.home_and_work(r))
