"""Queries over billing records with both ends, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calls as C
from .notes import values
from .tables import WITH_L

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


#: The dimensions of these queries.
TAC = [("35332208", "phone A"), ("353322", "maker X"), ("86012304", "phone B"), ("35", "body 35"), ("01", "body 01"), ("86012304", "phone C")]
EXACT = {"112": "emergency", "+48997": "emergency"}
SENDERS = {"facebook": "social", "mbank": "bank", "ing": "bank"}
PATTERNS = [(r"\*|#", "ussd"), (r"\+?48[78]0\d", "premium"), (r"\d{1,6}$", "short_code")]
SATELLITES = [("Iridium", r"\+8816", "8816"), ("Inmarsat", r"\+870", "870")]
MESSENGERS = [("WhatsApp", "messenger", "whatsapp"), ("Telegram", "messenger", "telegram"), ("Viber", "messenger", "viber"), ("Facebook", "social", "facebook")]
PREFIXES = [("48", "PL"), ("49", "DE"), ("375", "BY"), ("1", "US")]
CRITICAL = ["BY"]

_DIR = "CASE WHEN record_type IN ('CALL', 'SMS') THEN concat(record_type, CASE WHEN caller IS NOT DISTINCT FROM own AND callee IS DISTINCT FROM own THEN '_OUT' WHEN callee IS NOT DISTINCT FROM own AND caller IS DISTINCT FROM own THEN '_IN' WHEN cost IS NOT NULL THEN '_OUT' ELSE '' END) ELSE record_type END"
_D = f"{WITH_L}, d AS (SELECT * REPLACE ({_DIR} AS record_type) FROM l)"
query("g2_direction", f"{_D} SELECT event_id, record_type FROM d")(lambda t: C.directed(t.billing).select("event_id", "record_type"))
_TAC = f"t(code, name) AS (VALUES {values(TAC)}), u AS (SELECT code, min(name) AS name FROM t GROUP BY 1)"
_LOOK = "LEFT JOIN u a ON a.code = substr(imei, 1, 8) LEFT JOIN u b ON b.code = substr(imei, 1, 6) LEFT JOIN u c ON c.code = substr(imei, 1, 2)"


def _tac(t):
    return t.spark.createDataFrame(TAC, "code string, name string")


query("g6_device_lookup", f"{WITH_L}, {_TAC} SELECT event_id, coalesce(a.name, b.name, c.name) AS device FROM l {_LOOK}")(lambda t: C.device_lookup(t.billing, _tac(t)).select("event_id", "device"))
query("g14_devices", f"{WITH_L}, {_TAC}, g AS (SELECT subscriber, imei, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT CAST(ts AS DATE)) AS days FROM l GROUP BY 1, 2) SELECT g.*, coalesce(a.name, b.name, c.name) AS device FROM g {_LOOK}")(lambda t: C.devices_used(t.billing, _tac(t)))
query("g8_contact_counts", f"{WITH_L}, e AS (SELECT subscriber, own, unnest([caller, callee]) AS number FROM l) SELECT number, count(*) AS n, count(DISTINCT subscriber) AS subscribers FROM e WHERE number <> '' AND number <> own GROUP BY 1")(lambda t: C.contact_counts(t.billing))
_KIND = r"CASE WHEN contact IS NULL THEN NULL WHEN contact = '112' THEN 'emergency' WHEN contact = 'Facebook' THEN 'social' WHEN contact = 'mBank24' THEN 'bank' WHEN contact LIKE '*%' THEN 'ussd' WHEN contact LIKE '+4880%' OR contact LIKE '+4870%' AND regexp_matches(contact, '^\+48[78]0') THEN 'premium' WHEN contact = 'internetipv6' THEN 'alphanumeric' WHEN contact = '1234567' THEN 'short_code' END"
query("g17_special_numbers", f"{WITH_L}, k AS (SELECT *, {_KIND} AS kind FROM l) SELECT subscriber, contact, kind, count(*) AS n, CAST(sum(duration_seconds) AS BIGINT) AS seconds, min(CAST(ts AS DATE)) AS first_day, max(CAST(ts AS DATE)) AS last_day FROM k WHERE kind IS NOT NULL GROUP BY 1, 2, 3")(lambda t: C.special_numbers(t.billing, EXACT, SENDERS, PATTERNS))
_TO = "CASE WHEN related <> '' AND related <> own THEN related END"


def _marked(t):
    r = C.directed(t.billing)
    special = C.special_contacts(r, EXACT, SENDERS, PATTERNS).withColumnRenamed("kind", "special")
    return r.join(special, "contact", "left").withColumn("forwarded", C.forwarded_to("related").isNotNull())


query("g9_contact_profiles", f"""{_D}, k AS (SELECT *, {_KIND} AS special, record_type = 'CALL_FORWARDED' OR {_TO} IS NOT NULL AS fwd FROM d), g AS (SELECT subscriber, contact, count(*) AS n, count(*) FILTER (NOT fwd AND record_type = 'CALL_IN') AS calls_in, count(*) FILTER (NOT fwd AND record_type = 'CALL_OUT') AS calls_out,
  count(*) FILTER (fwd) AS calls_fwd, count(*) FILTER (NOT fwd AND record_type LIKE 'SMS%') AS sms, CAST(coalesce(sum(duration_seconds) FILTER (record_type LIKE 'CALL%'), 0) AS BIGINT) AS call_seconds, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT CAST(ts AS DATE)) AS active_days, count(DISTINCT place) AS places
  FROM k WHERE record_type <> 'DATA' AND special IS NULL AND contact <> '' GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subscriber ORDER BY n DESC, contact) AS rank FROM g) WHERE rank <= 10""")(lambda t: C.contact_profiles(_marked(t)))
query("g27_forwarded", f"{WITH_L} SELECT subscriber, event_id, ts, coalesce(contact, '') AS contact, coalesce({_TO}, '') AS forwarded_to, duration_seconds FROM l WHERE record_type = 'CALL_FORWARDED' OR {_TO} IS NOT NULL")(lambda t: C.forwarded_calls(t.billing, "related"))
_SAT = "CASE WHEN contact LIKE '+8816%' OR contact LIKE '8816%' THEN 'Iridium' WHEN contact LIKE '+870%' OR contact LIKE '870%' THEN 'Inmarsat' END"
query("g30_satellite", f"{WITH_L} SELECT subscriber, contact, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days, {_SAT} AS operator FROM l WHERE {_SAT} IS NOT NULL GROUP BY 1, 2")(lambda t: C.satellite_numbers(t.billing, SATELLITES))
_TEXT = "lower(concat_ws(' ', caller, callee, network, service))"
query("g31_messengers", f"""{WITH_L}, m(platform, category, pattern) AS (VALUES {values(MESSENGERS)}) SELECT subscriber, platform, category, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days, array_to_string(list_sort(list(DISTINCT record_type)), ',') AS types, count(DISTINCT contact) FILTER (contact <> own) AS contacts
FROM l JOIN m ON regexp_matches({_TEXT}, pattern) GROUP BY 1, 2, 3""")(lambda t: C.platforms(t.billing, MESSENGERS, ["caller", "callee", "network", "service"]))
query("g25_roaming", f"{WITH_L} SELECT subscriber, country, network, count(*) AS n, count(*) FILTER (record_type LIKE 'CALL%') AS calls, count(*) FILTER (record_type = 'DATA') AS data, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT CAST(ts AS DATE)) AS days FROM l WHERE country <> '' GROUP BY 1, 2, 3")(lambda t: C.roaming(t.billing))
query("g34_areas", f"{WITH_L}, g AS (SELECT subscriber, trim(split_part(place, ',', 1)) AS area, count(*) AS n, count(DISTINCT place) AS places FROM l WHERE place <> '' GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subscriber ORDER BY n DESC, area) AS rank FROM g) WHERE rank <= 10")(lambda t: C.areas(t.billing))
_NIGHT = "(hour({0}) >= 22 OR hour({0}) < 6)"
_REPORT = rf"""{_D}, p(prefix, country) AS (VALUES {values(PREFIXES)}), fc AS (SELECT contact, arg_max(country, length(prefix)) AS c FROM (SELECT DISTINCT contact FROM d WHERE contact IS NOT NULL) JOIN p ON starts_with(regexp_replace(contact, '^\+', ''), prefix) GROUP BY 1),
w AS (SELECT *, lag(ts) OVER q AS t0, lag(place) OVER q AS p0 FROM d WINDOW q AS (PARTITION BY subscriber ORDER BY ts, event_id)),
bu AS (SELECT subscriber, CAST(ts AS DATE) AS day, count(*) OVER (PARTITION BY subscriber, CAST(ts AS DATE) ORDER BY CAST(floor(epoch(ts) / 60) AS BIGINT) RANGE BETWEEN CURRENT ROW AND 30 FOLLOWING) AS k FROM d WHERE record_type LIKE 'CALL%' OR record_type LIKE 'SMS%'),
m(platform, pattern) AS (VALUES {values([(a, c) for a, _, c in MESSENGERS])}),
f AS (SELECT subscriber, 'long_call' AS type FROM d WHERE record_type LIKE 'CALL%' AND duration_seconds > 3600
  UNION ALL SELECT subscriber, 'late_night_calls' FROM d WHERE record_type LIKE 'CALL%' AND hour(ts) < 5 AND duration_seconds >= 10
  UNION ALL SELECT subscriber, 'night_activity' FROM d GROUP BY 1 HAVING count(*) FILTER (hour(ts) >= 23 OR hour(ts) < 5) / count(*) > 0.3
  UNION ALL SELECT subscriber, 'night_movement' FROM (SELECT DISTINCT subscriber, CAST(ts AS DATE), p0, place FROM w WHERE p0 <> place AND {_NIGHT.format("ts")} AND {_NIGHT.format("t0")} AND CAST(ts AS DATE) = CAST(t0 AS DATE))
  UNION ALL SELECT subscriber, 'burst_activity' FROM (SELECT DISTINCT subscriber, day FROM bu WHERE k >= 20)
  UNION ALL SELECT subscriber, 'premium_number' FROM (SELECT DISTINCT subscriber, contact FROM d WHERE regexp_matches(contact, '^\+?48[78]0\d'))
  UNION ALL SELECT subscriber, 'roaming' FROM (SELECT DISTINCT subscriber, country, network FROM d WHERE country <> '')
  UNION ALL SELECT subscriber, CASE WHEN c = 'BY' THEN 'critical' ELSE 'foreign_contacts' END FROM (SELECT DISTINCT subscriber, c FROM d JOIN fc USING (contact) WHERE c <> 'PL')
  UNION ALL SELECT subscriber, 'forwarded_calls' FROM d WHERE record_type = 'CALL_FORWARDED' OR {_TO} IS NOT NULL
  UNION ALL SELECT subscriber, 'one_time_contacts' FROM (SELECT subscriber, row_number() OVER (PARTITION BY subscriber ORDER BY contact) AS r FROM (SELECT subscriber, contact FROM d WHERE contact <> '' GROUP BY 1, 2 HAVING count(*) = 1)) WHERE r <= 30
  UNION ALL SELECT subscriber, 'satellite_numbers' FROM (SELECT DISTINCT subscriber, contact FROM d WHERE {_SAT} IS NOT NULL)
  UNION ALL SELECT subscriber, 'social_media' FROM (SELECT DISTINCT subscriber, platform FROM d JOIN m ON regexp_matches({_TEXT}, pattern))
  UNION ALL SELECT subscriber, 'inactivity_gap' FROM w WHERE floor(epoch(ts)) - floor(epoch(t0)) >= 43200),
g AS (SELECT subscriber, CASE type WHEN 'critical' THEN 'foreign_contacts' ELSE type END AS type, count(*) AS n, bool_or(type = 'critical') AS c FROM f GROUP BY 1, 2), s(type, severity) AS (VALUES {values(list(C.SEVERITY.items()))}),
z AS (SELECT subscriber, type, CASE WHEN c THEN 'critical' ELSE severity END AS severity, n FROM g JOIN s USING (type))"""


def _report(t):
    return C.anomaly_report(C.directed(t.billing), t.spark.createDataFrame(PREFIXES, "prefix string, country string"), SATELLITES, MESSENGERS, critical=CRITICAL)


query("g32_anomaly_report", f"{_REPORT} SELECT * FROM z")(_report)
query("g34_severest", f"{_REPORT} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subscriber ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, n DESC, type) AS rank FROM z) WHERE rank <= 3")(lambda t: C.severest(_report(t)))
query("g33_networks", f"""{WITH_L}, g AS (SELECT subscriber, network, count(*) AS n, row_number() OVER (PARTITION BY subscriber ORDER BY count(*) DESC, network) AS r FROM l WHERE network <> '' GROUP BY 1, 2)
SELECT subscriber, CASE WHEN r <= 2 THEN network ELSE 'other' END AS network, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY 1, 2""")(lambda t: C.network_frame(t.billing, 2))
