"""Queries over call detail records, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import calls as C
from .tables import WITH_C

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


CALL = "record_type LIKE 'CALL%'"
NIGHT = "(hour({0}) >= 22 OR hour({0}) < 6)"

query("g3_deduplicate", f"{WITH_C} SELECT subscriber, contact, record_type, duration_seconds, count(*) AS n FROM (SELECT subscriber, ts, contact, record_type, duration_seconds FROM c GROUP BY ALL) GROUP BY 1, 2, 3, 4")(lambda t: C.deduplicate(t.cdr).groupBy("subscriber", "contact", "record_type", "duration_seconds").agg(F.count("*").alias("n")))
query("g7_billing_summary", f"""{WITH_C} SELECT subscriber, count(*) AS n, {", ".join(f"count(*) FILTER (record_type = '{x}') AS {x.lower()}" for x in ("CALL_OUT", "CALL_IN", "SMS_OUT", "SMS_IN", "DATA"))},
  CAST(sum(CASE WHEN {CALL} THEN duration_seconds END) AS BIGINT) AS call_seconds, count(DISTINCT contact) AS contacts, min(ts) AS first_ts, max(ts) AS last_ts FROM c GROUP BY 1""")(lambda t: C.billing_summary(t.cdr))
query("g10_temporal", f"""{WITH_C}, d AS (SELECT subscriber, hour(ts) AS hour, isodow(ts) - 1 AS weekday, strftime(ts, '%Y-%m') AS month FROM c) SELECT *, count(*) AS n FROM d GROUP BY GROUPING SETS ((subscriber, hour), (subscriber, weekday), (subscriber, month))""")(
    lambda t: C.temporal(t.cdr).withColumn("hour", F.col("hour").cast("long")).withColumn("weekday", F.col("weekday").cast("long"))
)
query("g10_peaks", f"""{WITH_C}, h AS (SELECT subscriber, 'hour' AS k, hour(ts) AS p, NULL AS m, count(*) AS n FROM c GROUP BY 1, 3 UNION ALL SELECT subscriber, 'weekday', isodow(ts) - 1, NULL, count(*) FROM c GROUP BY 1, 3 UNION ALL SELECT subscriber, 'month', year(ts) * 100 + month(ts), strftime(ts, '%Y-%m'), count(*) FROM c GROUP BY 1, 3, 4),
b AS (SELECT *, row_number() OVER (PARTITION BY subscriber, k ORDER BY n DESC, p) AS r FROM h)
SELECT subscriber, max(p) FILTER (k = 'hour') AS peak_hour, max(p) FILTER (k = 'weekday') AS peak_weekday, max(m) FILTER (k = 'month') AS peak_month FROM b WHERE r = 1 GROUP BY 1""")(lambda t: C.peaks(t.cdr).withColumns({c: F.col(c).cast("long") for c in ("peak_hour", "peak_weekday")}))
query("g22_night_ratio", f"""{WITH_C}, g AS (SELECT subscriber, count(*) AS n, count(*) FILTER (hour(ts) >= 23 OR hour(ts) < 5) AS night FROM c GROUP BY 1) SELECT *, round(night / n, 6) AS ratio, night / n > 0.3 AS flag FROM g""")(lambda t: C.night_ratio(t.cdr))
query("g11_locations", f"""{WITH_C}, g AS (SELECT subscriber, place, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days, min(ts) AS first_ts, max(ts) AS last_ts FROM c GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY subscriber ORDER BY n DESC, place) AS rank FROM g""")(lambda t: C.locations(t.cdr))
query("g12_overnight_stays", f"""{WITH_C}, h AS (SELECT subscriber, arg_min(place, (-n, place)) AS home FROM (SELECT subscriber, place, count(*) AS n FROM c GROUP BY 1, 2) GROUP BY 1),
d AS (SELECT subscriber, CAST(ts AS DATE) AS day, arg_min(place, (ts, event_id)) AS first, arg_max(place, (ts, event_id)) AS last FROM c GROUP BY 1, 2),
n AS (SELECT *, lead(first) OVER w AS nf, lead(day) OVER w AS nd FROM d WINDOW w AS (PARTITION BY subscriber ORDER BY day)),
k AS (SELECT n.*, day - CAST(row_number() OVER (PARTITION BY n.subscriber, last ORDER BY day) AS INT) AS island FROM n JOIN h USING (subscriber) WHERE last = nf AND last <> home)
SELECT subscriber, last AS place, min(day) AS from_day, max(nd) AS to_day, count(*) AS nights FROM k GROUP BY subscriber, last, island""")(lambda t: C.overnight_stays(t.cdr))
query("g13_call_lengths", f"""{WITH_C}, k AS (SELECT subscriber, CAST(sum(duration_seconds) AS DOUBLE) / count(*) AS mean_s, median(CAST(duration_seconds AS DOUBLE)) AS median_s, max(duration_seconds) AS longest_s FROM c WHERE {CALL} GROUP BY 1),
d AS (SELECT subscriber, arg_min(day, (-n, day)) AS busiest_day, max(n) AS busiest_n FROM (SELECT subscriber, CAST(ts AS DATE) AS day, count(*) AS n FROM c GROUP BY 1, 2) GROUP BY 1) SELECT * FROM k JOIN d USING (subscriber)""")(lambda t: C.call_lengths(t.cdr))
_DEV = f"{WITH_C}, d AS (SELECT *, concat('dev', CAST(k % 3 AS VARCHAR)) AS device, CASE WHEN record_type = 'DATA' THEN 'data' ELSE 'voice' END AS domain FROM c)"


def _devices(t):
    return t.cdr.withColumn("device", F.concat(F.lit("dev"), (F.col("k") % 3).cast("string")))


query("g15_device_changes", f"{_DEV}, l AS (SELECT *, lag(device) OVER (PARTITION BY subscriber, domain ORDER BY ts, event_id) AS b FROM d) SELECT subscriber, domain, event_id, ts, b AS from_device, device AS to_device FROM l WHERE b <> device")(lambda t: C.device_changes(_devices(t)))
query("g16_dual_devices", f"""{_DEV}, e AS (SELECT subscriber, domain, CASE WHEN domain = 'data' AND k % 10 < 9 THEN concat('x', CAST(subscriber % 3 AS VARCHAR)) WHEN domain = 'voice' AND k % 10 < 9 THEN 'y' ELSE device END AS device FROM d),
g AS (SELECT subscriber, domain, device, count(*) AS n FROM e GROUP BY 1, 2, 3), t AS (SELECT subscriber, domain, arg_min(device, (-n, device)) AS dev, max(n) / sum(n) AS share FROM g GROUP BY 1, 2)
SELECT v.subscriber, v.dev AS voice_device, x.dev AS data_device FROM t v JOIN t x ON v.subscriber = x.subscriber AND v.domain = 'voice' AND x.domain = 'data' WHERE v.share >= 0.8 AND x.share >= 0.8 AND v.dev <> x.dev""")(
    lambda t: C.dual_devices(_devices(t).withColumn("device", F.expr("case when record_type = 'DATA' and k % 10 < 9 then concat('x', cast(subscriber % 3 as string)) when record_type <> 'DATA' and k % 10 < 9 then 'y' else device end")))
)
query("g18_night_activity", f"""{WITH_C}, d AS (SELECT subscriber, hour(ts) AS hour, record_type, concat(CAST(isoyear(ts) AS VARCHAR), '-W', lpad(CAST(weekofyear(ts) AS VARCHAR), 2, '0')) AS week FROM c WHERE {NIGHT.format("ts")})
SELECT *, count(*) AS n FROM d GROUP BY GROUPING SETS ((subscriber, hour, record_type), (subscriber, week), (subscriber))""")(lambda t: C.night_activity(t.cdr).withColumn("hour", F.col("hour").cast("long")))
query("g19_weekend_activity", f"""{WITH_C}, d AS (SELECT *, CASE WHEN isodow(ts) = 5 AND hour(ts) >= 20 THEN 'friday_evening' WHEN isodow(ts) = 6 THEN 'saturday' WHEN isodow(ts) = 7 THEN 'sunday' WHEN isodow(ts) = 1 AND hour(ts) < 6 THEN 'monday_night' END AS segment FROM c)
SELECT subscriber, segment, count(*) AS n, count(DISTINCT contact) AS contacts FROM d WHERE segment IS NOT NULL GROUP BY 1, 2""")(lambda t: C.weekend_activity(t.cdr))
query("g20_period_anomalies", f"""{WITH_C}, g AS (SELECT subscriber, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n FROM c GROUP BY 1, 2), s AS (SELECT subscriber, CAST(sum(n) AS DOUBLE) / count(*) AS mean, stddev_pop(n) AS std, count(*) AS weeks FROM g GROUP BY 1),
k AS (SELECT *, CASE WHEN n > mean + greatest(1.5 * std, 1.0) THEN 'high' WHEN n < mean - greatest(1.5 * std, 1.0) AND mean > 2 THEN 'low' END AS kind FROM g JOIN s USING (subscriber) WHERE weeks >= 2)
SELECT subscriber, week, n, round(mean, 4) AS mean, kind FROM k WHERE kind IS NOT NULL""")(lambda t: C.period_anomalies(t.cdr))
_LONG = f"CASE WHEN duration_seconds > 1800 THEN 'long' WHEN hour(ts) < 5 AND duration_seconds >= 10 THEN 'late' END"
query("g21_long_and_late", f"{WITH_C}, k AS (SELECT *, {_LONG} AS kind FROM c WHERE {CALL}) SELECT subscriber, event_id, duration_seconds, kind FROM k WHERE kind IS NOT NULL")(lambda t: C.long_and_late(t.cdr, 1800))
_MOVE = f"""l AS (SELECT *, lag(place) OVER w AS p0, lag(ts) OVER w AS t0 FROM c WINDOW w AS (PARTITION BY subscriber ORDER BY ts, event_id)),
m AS (SELECT DISTINCT subscriber, CAST(ts AS DATE) AS day, p0 AS from_place, place AS to_place FROM l WHERE p0 <> place AND {NIGHT.format("ts")} AND {NIGHT.format("t0")} AND CAST(ts AS DATE) = CAST(t0 AS DATE))"""
query("g23_night_movement", f"{WITH_C}, {_MOVE} SELECT * FROM m")(lambda t: C.night_movement(t.cdr))
query("g24_bursts", f"""{WITH_C}, d AS (SELECT subscriber, CAST(ts AS DATE) AS day, CAST(floor(epoch(ts) / 60) AS BIGINT) AS minute FROM c), g AS (SELECT *, count(*) OVER (PARTITION BY subscriber, day ORDER BY minute RANGE BETWEEN CURRENT ROW AND 240 FOLLOWING) AS n FROM d)
SELECT subscriber, day, min(minute) AS minute, arg_min(n, minute) AS n FROM g WHERE n >= 3 GROUP BY 1, 2""")(lambda t: C.bursts(t.cdr, 3, 240))
_GAP = "e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(lag(ts) OVER (PARTITION BY subscriber ORDER BY ts, event_id))) AS BIGINT) AS gap_s FROM c)"
query("g28_inactivity_gaps", f"{WITH_C}, {_GAP} SELECT subscriber, event_id, gap_s FROM e WHERE gap_s >= 43200")(lambda t: C.inactivity_gaps(t.cdr))


@query("g26_foreign_contacts", f"""{WITH_C}, p(prefix, country) AS (VALUES ('48', 'PL'), ('4850', 'PL-50'), ('485', 'PL-5'), ('49', 'DE')), m AS (SELECT contact, arg_max(country, length(prefix)) AS country FROM (SELECT DISTINCT contact FROM c) JOIN p ON starts_with(substr(contact, 2), prefix) GROUP BY 1)
SELECT subscriber, coalesce(country, 'unknown') AS country, count(*) AS n, count(DISTINCT contact) AS contacts FROM c LEFT JOIN m USING (contact) GROUP BY 1, 2""")
def g26(t):
    return C.foreign_contacts(t.cdr, t.spark.createDataFrame([("48", "PL"), ("4850", "PL-50"), ("485", "PL-5"), ("49", "DE")], "prefix string, country string"))


query("g29_one_time_contacts", f"""{WITH_C}, g AS (SELECT subscriber, contact, max(ts) AS ts FROM c GROUP BY 1, 2 HAVING count(*) = 1) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subscriber ORDER BY ts DESC, contact) AS rank FROM g) WHERE rank <= 30""")(lambda t: C.one_time_contacts(t.cdr))
query("g33_hour_frame", f"""{WITH_C} SELECT subscriber, hour, count(event_id) AS n FROM (SELECT DISTINCT subscriber, unnest(range(24)) AS hour FROM c) f LEFT JOIN (SELECT subscriber, hour(ts) AS hour, event_id FROM c) d USING (subscriber, hour) GROUP BY 1, 2""")(lambda t: C.hour_frame(t.cdr).withColumn("hour", F.col("hour").cast("long")))
query("g33_duration_histogram", f"""{WITH_C} SELECT subscriber, CASE {" ".join(f"WHEN duration_seconds < {x} THEN {i}" for i, x in enumerate(C.BINS))} ELSE {len(C.BINS)} END AS bin, count(*) AS n FROM c WHERE {CALL} GROUP BY 1, 2""")(lambda t: C.duration_histogram(t.cdr))
query("g33_place_hours", f"""{WITH_C}, t AS (SELECT *, row_number() OVER (PARTITION BY subscriber ORDER BY n DESC, place) AS rank FROM (SELECT subscriber, place, count(*) AS n FROM c GROUP BY 1, 2))
SELECT subscriber, rank, place, hour(ts) AS hour, count(*) AS n FROM c JOIN t USING (subscriber, place) WHERE rank <= 10 GROUP BY ALL""")(lambda t: C.place_hours(t.cdr).withColumn("hour", F.col("hour").cast("long")))
query("g33_types", f"{WITH_C}, g AS (SELECT subscriber, record_type, count(*) AS n FROM c GROUP BY 1, 2) SELECT *, round(n / sum(n) OVER (PARTITION BY subscriber), 4) AS share FROM g")(lambda t: C.type_frame(t.cdr))
query("g33_top_contacts", f"""{WITH_C}, g AS (SELECT subscriber, contact, count(*) AS n, count(*) FILTER ({CALL}) AS calls, count(*) FILTER (record_type LIKE 'SMS%') AS messages FROM c GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subscriber ORDER BY n DESC, contact) AS rank FROM g) WHERE rank <= 15""")(lambda t: C.top_contacts(t.cdr))
query("g33_daily_cost", f"""{WITH_C}, g AS (SELECT subscriber, CAST(ts AS DATE) AS day, sum(CAST(floor(value * 100) AS BIGINT)) AS c FROM c GROUP BY 1, 2)
SELECT subscriber, day, CAST(c AS DOUBLE) AS cost, CAST(sum(c) OVER (PARTITION BY subscriber ORDER BY day) AS DOUBLE) AS total FROM g""")(lambda t: C.daily_cost(t.cdr.withColumn("cost", F.floor(F.col("value") * 100))))
query("g33_daily_by_type", f"{WITH_C} SELECT CAST(ts AS DATE) AS day, {', '.join(f'count(*) FILTER (record_type = {x!r}) AS {x.lower()}' for x in ('CALL_IN', 'CALL_OUT', 'DATA', 'SMS_IN', 'SMS_OUT'))} FROM c GROUP BY 1")(
    lambda t: t.cdr.groupBy(F.to_date("ts").alias("day")).pivot("record_type", ["CALL_IN", "CALL_OUT", "DATA", "SMS_IN", "SMS_OUT"]).count().na.fill(0).withColumnsRenamed({x: x.lower() for x in ("CALL_IN", "CALL_OUT", "DATA", "SMS_IN", "SMS_OUT")})
)
query("g1_phone", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN concat('+48', CAST(500000000 + c_custkey AS VARCHAR)) WHEN 1 THEN concat('+49', CAST(30000000 + c_custkey AS VARCHAR)) ELSE concat('+48', CAST(600000000 + c_custkey AS VARCHAR)) END AS phone FROM customer")(
    lambda t: t("customer").select("c_custkey", T.phone(F.expr("case c_custkey % 3 when 0 then concat('48 ', cast(500000000 + c_custkey as string)) when 1 then concat('0049-', cast(30000000 + c_custkey as string)) else cast(600000000 + c_custkey as string) end")).alias("phone"))
)
query("g4_durations", "SELECT event_id, CAST(floor(value * 20) AS BIGINT) AS seconds FROM events")(
    lambda t: t.cdr.select("event_id", T.duration_seconds(F.concat_ws(":", F.floor(F.col("duration_seconds") / 3600), F.lpad((F.floor(F.col("duration_seconds") / 60) % 60).cast("string"), 2, "0"), F.lpad((F.col("duration_seconds") % 60).cast("string"), 2, "0"))).cast("long").alias("seconds"))
)
query("g5_device_quality", "SELECT c_nationkey, count(*) AS n, count(*) FILTER (c_custkey % 10 <> 8) AS invalid FROM customer GROUP BY 1")(
    lambda t: t("customer").withColumn("ok", T.luhn_valid(F.concat(F.lit("49015420323751"), (F.col("c_custkey") % 10).cast("string")))).groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("invalid"))
)
