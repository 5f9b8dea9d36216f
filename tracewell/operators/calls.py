"""Operators over call detail records, for all subscribers at once.

Columns: event_id, subscriber (the key), ts, record_type, contact, duration_seconds, place, k. All
rankings end with a name or id, so ties have one order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks

KEY = "subscriber"


def in_order(*extra: str):
    return Window.partitionBy(KEY, *extra).orderBy("ts", "event_id")


def seconds(c: str = "ts") -> Column:
    return F.unix_timestamp(F.col(c).cast("timestamp"))


def is_call() -> Column:
    return F.col("record_type").startswith("CALL")


def deduplicate(r: DataFrame) -> DataFrame:
    """One of the records that agree in subscriber, time, contact, type and duration."""
    w = Window.partitionBy(KEY, "ts", "contact", "record_type", "duration_seconds").orderBy("event_id")
    return r.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def billing_summary(r: DataFrame) -> DataFrame:
    """Totals of each subscriber."""
    n = lambda t: F.count_if(F.col("record_type") == t).alias(t.lower())
    return r.groupBy(KEY).agg(F.count("*").alias("n"), *(n(t) for t in ("CALL_OUT", "CALL_IN", "SMS_OUT", "SMS_IN", "DATA")), F.sum(F.when(is_call(), F.col("duration_seconds"))).alias("call_seconds"), F.countDistinct("contact").alias("contacts"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def contact_profiles(r: DataFrame, top: int = 10) -> DataFrame:
    """Each contact's calls, messages, seconds and active days; the busiest of each subscriber.

    Where records say so: special (a special number: left out) and forwarded (a forwarded call).
    """
    have = set(r.columns)
    r = r if "special" in have else r.withColumn("special", F.lit(None).cast("string"))
    fwd = F.coalesce(F.col("forwarded"), F.lit(False)) if "forwarded" in have else F.lit(False)
    fwd = fwd | (F.col("record_type") == "CALL_FORWARDED")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    g = r.where("record_type <> 'DATA' and special is null and contact <> ''").groupBy(KEY, "contact").agg(
        F.count("*").alias("n"), n(~fwd & (F.col("record_type") == "CALL_IN")).alias("calls_in"), n(~fwd & (F.col("record_type") == "CALL_OUT")).alias("calls_out"), n(fwd).alias("calls_fwd"),
        n(~fwd & F.col("record_type").startswith("SMS")).alias("sms"), F.coalesce(F.sum(F.when(is_call(), F.col("duration_seconds"))), F.lit(0)).alias("call_seconds"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct(F.to_date("ts")).alias("active_days"), F.countDistinct("place").alias("places"),
    )
    w = Window.partitionBy(KEY).orderBy(F.desc("n"), "contact")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def temporal(r: DataFrame) -> DataFrame:
    """Records by hour, weekday and month, by grouping sets."""
    d = r.withColumn("hour", F.hour("ts")).withColumn("weekday", F.weekday("ts")).withColumn("month", F.date_format("ts", "yyyy-MM"))
    sets = [[F.col(KEY), F.col(c)] for c in ("hour", "weekday", "month")]
    return d.groupingSets(sets, KEY, "hour", "weekday", "month").agg(F.count("*").alias("n"))


def peaks(r: DataFrame) -> DataFrame:
    """Each subscriber's hour, weekday and month of most records (of equal ones the first)."""
    t = temporal(r)
    most = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("n", (-F.col("p")).alias("p")))).alias(f"peak_{c}")
    p = F.coalesce(F.col("hour"), F.col("weekday"), F.regexp_replace("month", "-", "").cast("int"))
    return t.withColumn("p", p).groupBy(KEY).agg(*map(most, ("hour", "weekday", "month")))


def night_ratio(r: DataFrame, first: int = 23, last: int = 5) -> DataFrame:
    """Share of records at night and the flag above 0.3."""
    night = (F.hour("ts") >= first) | (F.hour("ts") < last)
    g = r.groupBy(KEY).agg(F.count("*").alias("n"), F.count_if(night).alias("night"))
    return g.withColumn("ratio", F.round(F.col("night") / F.col("n"), 6)).withColumn("flag", F.col("night") / F.col("n") > 0.3)


def locations(r: DataFrame, top: int = 50) -> DataFrame:
    """The most used places."""
    g = r.groupBy(KEY, "place").agg(F.count("*").alias("n"), F.countDistinct(F.to_date("ts")).alias("days"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("n"), "place"))).where(F.col("rank") <= top)


def overnight_stays(r: DataFrame) -> DataFrame:
    """Nights whose evening and morning place both are not home (the most frequent place),
    chained over consecutive nights of one place."""
    order = F.struct("ts", "event_id")
    home = r.groupBy(KEY, "place").agg(F.count("*").alias("n")).groupBy(KEY).agg(F.min_by("place", F.struct(-F.col("n"), "place")).alias("home"))
    d = r.groupBy(KEY, F.to_date("ts").alias("day")).agg(F.min_by("place", order).alias("first"), F.max_by("place", order).alias("last"))
    w = Window.partitionBy(KEY).orderBy("day")
    n = d.withColumn("next_first", F.lead("first").over(w)).withColumn("next_day", F.lead("day").over(w)).join(home, KEY)
    n = n.where("last = next_first and last <> home")
    island = F.date_sub("day", F.row_number().over(Window.partitionBy(KEY, "last").orderBy("day")))
    g = n.withColumn("island", island).groupBy(KEY, F.col("last").alias("place"), "island")
    return g.agg(F.min("day").alias("from_day"), F.max("next_day").alias("to_day"), F.count("*").alias("nights")).drop("island")


def call_lengths(r: DataFrame) -> DataFrame:
    """Mean, median and longest call, and the busiest day."""
    own = r.where(is_call())
    c = own.groupBy(KEY).agg((F.sum("duration_seconds") / F.count("*")).alias("mean_s"), F.max("duration_seconds").alias("longest_s"))
    mid = ranks.values_at(own, [KEY], "duration_seconds", {"low": (0.5, ranks.LOWER_MIDDLE), "high": (0.5, ranks.UPPER_MIDDLE)})
    c = c.join(mid.select(KEY, ((F.col("low") + F.col("high")) / 2).alias("median_s")), KEY, "left").select(KEY, "mean_s", "median_s", "longest_s")
    d = r.groupBy(KEY, F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).groupBy(KEY).agg(F.min_by("day", F.struct(-F.col("n"), "day")).alias("busiest_day"), F.max("n").alias("busiest_n"))
    return c.join(d, KEY)


def device_changes(r: DataFrame, device: str = "device") -> DataFrame:
    """A device that differs from the one before in the same domain (voice or data)."""
    domain = F.when(F.col("record_type") == "DATA", "data").otherwise("voice")
    d = r.withColumn("domain", domain)
    before = F.lag(device).over(in_order("domain"))
    return d.withColumn("before", before).where(F.col("before") != F.col(device)).select(KEY, "domain", "event_id", "ts", F.col("before").alias("from_device"), F.col(device).alias("to_device"))


def dual_devices(r: DataFrame, device: str = "device", share: float = 0.8) -> DataFrame:
    """Another device dominates each domain."""
    d = r.withColumn("domain", F.when(F.col("record_type") == "DATA", "data").otherwise("voice"))
    g = d.groupBy(KEY, "domain", device).agg(F.count("*").alias("n"))
    top = g.groupBy(KEY, "domain").agg(F.min_by(device, F.struct(-F.col("n"), device)).alias("dev"), (F.max("n") / F.sum("n")).alias("share"))
    v, x = top.where("domain = 'voice'"), top.where("domain = 'data'")
    return v.select(KEY, F.col("dev").alias("voice_device"), F.col("share").alias("s1")).join(x.select(KEY, F.col("dev").alias("data_device"), F.col("share").alias("s2")), KEY).where((F.col("s1") >= share) & (F.col("s2") >= share) & (F.col("voice_device") != F.col("data_device"))).select(KEY, "voice_device", "data_device")


def night_activity(r: DataFrame) -> DataFrame:
    """22 to 6 by hour and type, by week and in all."""
    d = r.where((F.hour("ts") >= 22) | (F.hour("ts") < 6)).withColumn("hour", F.hour("ts")).withColumn("week", F.concat(F.extract(F.lit("YEAROFWEEK"), "ts").cast("string"), F.lit("-W"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0")))
    sets = [[F.col(KEY), F.col("hour"), F.col("record_type")], [F.col(KEY), F.col("week")], [F.col(KEY)]]
    return d.groupingSets(sets, KEY, "hour", "record_type", "week").agg(F.count("*").alias("n"))


def weekend_activity(r: DataFrame) -> DataFrame:
    """Friday 20:00 to Monday 06:00 in four segments."""
    wd, h = F.weekday("ts"), F.hour("ts")
    segment = F.when((wd == 4) & (h >= 20), "friday_evening").when(wd == 5, "saturday").when(wd == 6, "sunday").when((wd == 0) & (h < 6), "monday_night")
    return r.withColumn("segment", segment).where("segment is not null").groupBy(KEY, "segment").agg(F.count("*").alias("n"), F.countDistinct("contact").alias("contacts"))


def period_anomalies(r: DataFrame) -> DataFrame:
    """Weeks whose count leaves mean +- max(1.5 deviations, 1); low ones need a mean above 2.

    Compared in whole numbers (both sides times the weeks, and squared): a count right on the band's edge is
    inside, where a deviation of doubles lies on one side or the other by the order of its sums. 38 digits
    hold 10^12 records a week for 500,000 weeks.
    """
    exact = lambda c: c.cast("decimal(19,0)")
    g = r.groupBy(KEY, F.date_trunc("week", "ts").cast("date").alias("week")).agg(F.count("*").alias("n"))
    s = g.groupBy(KEY).agg(F.sum("n").alias("total"), F.sum(exact(F.col("n")) * exact(F.col("n"))).alias("squares"), F.count("*").alias("weeks"))
    off = F.col("n") * F.col("weeks") - F.col("total")
    spread = F.col("weeks") * F.col("squares") - exact(F.col("total")) * exact(F.col("total"))
    out = (4 * (exact(off) * exact(off)) > 9 * spread) & (F.abs(off) > F.col("weeks"))
    kind = F.when(out & (off > 0), "high").when(out & (F.col("total") > 2 * F.col("weeks")), "low")
    return g.join(s, KEY).where("weeks >= 2").withColumn("kind", kind).where("kind is not null").select(KEY, "week", "n", F.round(F.col("total") / F.col("weeks"), 4).alias("mean"), "kind")


def long_and_late(r: DataFrame, long_s: int = 3600, late_s: int = 10) -> DataFrame:
    """Calls over an hour, and calls from midnight to 5."""
    kind = F.when(F.col("duration_seconds") > long_s, "long").when((F.hour("ts") < 5) & (F.col("duration_seconds") >= late_s), "late")
    return r.where(is_call()).withColumn("kind", kind).where("kind is not null").select(KEY, "event_id", "duration_seconds", "kind")


def night_movement(r: DataFrame) -> DataFrame:
    """Distinct changes of place between neighbouring records of one night's hours and date."""
    night = lambda c: (F.hour(c) >= 22) | (F.hour(c) < 6)
    w = in_order()
    d = r.withColumn("p0", F.lag("place").over(w)).withColumn("t0", F.lag("ts").over(w))
    d = d.where((F.col("p0") != F.col("place")) & night("ts") & night("t0") & (F.to_date("ts") == F.to_date("t0")))
    return d.select(KEY, F.to_date("ts").alias("day"), F.col("p0").alias("from_place"), F.col("place").alias("to_place")).distinct()


def bursts(r: DataFrame, least: int = 20, minutes: int = 30) -> DataFrame:
    """The first record of each day that begins a window with many records."""
    d = r.withColumn("day", F.to_date("ts")).withColumn("minute", F.floor(seconds() / 60))
    w = Window.partitionBy(KEY, "day").orderBy("minute").rangeBetween(0, minutes)
    return d.withColumn("n", F.count("*").over(w)).where(F.col("n") >= least).groupBy(KEY, "day").agg(F.min("minute").alias("minute"), F.min_by("n", "minute").alias("n"))


def inactivity_gaps(r: DataFrame, hours: int = 12) -> DataFrame:
    """Pauses between neighbouring records."""
    d = r.withColumn("before", F.lag("ts").over(in_order()))
    gap = seconds("ts") - seconds("before")
    return d.where(gap >= hours * 3600).select(KEY, "event_id", gap.alias("gap_s"))


def with_country(r: DataFrame, prefixes: DataFrame, number: str = "contact") -> DataFrame:
    """Adds country, that of the number's longest known prefix of 1 to 5 digits, else null. There are
    111,110 such prefixes at most, so the table is broadcast, a length at a time."""
    digits = F.regexp_replace(number, r"^\+", "")
    table = prefixes.where(F.col("prefix").rlike("^[0-9]{1,5}$")).groupBy("prefix").agg(F.min("country").alias("country"))
    out, found = r, []
    for n in range(5, 0, -1):
        own = table.where(F.length("prefix") == n).select(F.col("prefix").alias(f"_p{n}"), F.col("country").alias(f"_c{n}"))
        out = out.withColumn(f"_p{n}", F.substring(digits, 1, n)).join(F.broadcast(own), f"_p{n}", "left").drop(f"_p{n}")
        found.append(f"_c{n}")
    return out.withColumn("country", F.coalesce(*found)).drop(*found)


def foreign_contacts(r: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Records and contacts of each country; contacts are looked at once each."""
    g = r.groupBy(KEY, "contact").agg(F.count("*").alias("n"))
    g = with_country(g, prefixes).groupBy(KEY, F.coalesce("country", F.lit("unknown")).alias("country"))
    return g.agg(F.sum("n").alias("n"), F.count("contact").alias("contacts"))


def one_time_contacts(r: DataFrame, newest: int = 30) -> DataFrame:
    """Contacts seen once, the newest of each subscriber."""
    g = r.groupBy(KEY, "contact").agg(F.count("*").alias("n"), F.max("ts").alias("ts")).where("n = 1")
    return g.withColumn("rank", F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("ts"), "contact"))).where(F.col("rank") <= newest).drop("n")


def directed(r: DataFrame) -> DataFrame:
    """A direction for records that have none: out where the caller is the subscriber's own number, in
    where the callee is; else, where a cost is known, out. Adds record_type anew."""
    t = F.col("record_type")
    bare = t.isin("CALL", "SMS", "MMS")
    caller, callee = F.col("caller").eqNullSafe(F.col("own")), F.col("callee").eqNullSafe(F.col("own"))
    side = F.when(caller & ~callee, "_OUT").when(callee & ~caller, "_IN").when(F.col("cost").isNotNull(), "_OUT").otherwise("")
    return r.withColumn("record_type", F.when(bare, F.concat(t, side)).otherwise(t))


#: Names of devices by the first digits of their numbers, as far as a broadcast may go.
MOST_DEVICES = 500_000


def device_lookup(r: DataFrame, devices: DataFrame, imei: str = "imei") -> DataFrame:
    """The device by type code (8 digits), else by its first 6, else by the reporting body (2).
    devices: code, name. Adds device, null where nothing fits."""
    small = devices.limit(MOST_DEVICES + 1).count() <= MOST_DEVICES
    out, names = r, []
    for n in (8, 6, 2):
        d = devices.where(F.length("code") == n).groupBy(F.col("code").alias(f"_c{n}")).agg(F.min("name").alias(f"_n{n}"))
        out = out.withColumn(f"_c{n}", F.substring(F.regexp_replace(imei, r"\D", ""), 1, n)).join(F.broadcast(d) if small else d, f"_c{n}", "left").drop(f"_c{n}")
        names.append(f"_n{n}")
    return out.withColumn("device", F.coalesce(*names)).drop(*names)


def devices_used(r: DataFrame, devices: DataFrame, imei: str = "imei") -> DataFrame:
    """Each device number of a subscriber with its name, records and span."""
    g = r.where(F.col(imei) != "").groupBy(KEY, imei).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct(F.to_date("ts")).alias("days"))
    return device_lookup(g, devices, imei)


def contact_counts(r: DataFrame) -> DataFrame:
    """Records of every number at either end that is not the subscriber's own."""
    ends = F.explode(F.array("caller", "callee")).alias("number")
    e = r.select(KEY, "own", ends).where("number <> '' and number <> own")
    return e.groupBy("number").agg(F.count("*").alias("n"), F.countDistinct(KEY).alias("subscribers"))


def standard_phone(c: Column) -> Column:
    """An ordinary number: digits of the home country, or 7 to 15 with a plus, 00 or bare from ten on."""
    d = F.regexp_replace(c, r"[^0-9+]", "")
    return ~c.rlike("[A-Za-z]") & d.rlike(r"^(\+?48[0-9]{9}|[0-9]{9}|\+[0-9]{7,15}|00[0-9]{8,15}|[0-9]{10,15})$")


def special_kind(c: Column, exact: dict[str, str], senders: dict[str, str], patterns: list[tuple[str, str]]) -> Column:
    """The kind of a special number, null for ordinary ones: exact (with or without +48), a known
    sender's name (whole; of four characters on, contained either way), the first pattern that its
    beginning fits, else alphanumeric or short_code for what is no telephone number.

    The tables are small dimensions of the caller's.
    """
    bare = lambda x: x[3:] if x.startswith("+48") else x
    number = F.regexp_replace(c, r"^\+48", "")
    low = F.lower(F.trim(c))
    out = F.when(c.rlike("[A-Za-z]"), "alphanumeric").otherwise("short_code")
    out = F.when(~standard_phone(c), out)
    for p, kind in reversed(patterns):
        out = F.when(c.rlike(f"^(?:{p})"), kind).otherwise(out)
    for name, kind in reversed(senders.items()):
        near = low.contains(name) if len(name) >= 4 else F.lit(False)
        out = F.when(near | ((F.length(low) >= 4) & F.contains(F.lit(name), low)), kind).otherwise(out)
    for name, kind in senders.items():
        out = F.when(low == name, kind).otherwise(out)
    for n, kind in reversed(exact.items()):
        out = F.when((c == n) | (number == bare(n)), kind).otherwise(out)
    return F.when(F.coalesce(c, F.lit("")) != "", out)


def special_contacts(r: DataFrame, exact: dict[str, str], senders: dict[str, str], patterns: list[tuple[str, str]]) -> DataFrame:
    """(contact, kind) of the special ones, each contact looked at once: exact numbers by an
    equi-join, the others as in ``special_kind``."""
    bare = F.regexp_replace("contact", r"^\+48", "")
    c = r.select("contact").where("contact <> ''").distinct().withColumn("_bare", bare)
    rows = {}
    for n, kind in exact.items():
        rows.setdefault(n.removeprefix("+48"), kind)
    table = r.sparkSession.createDataFrame(list(rows.items()), "_bare string, _exact string")
    c = c.join(F.broadcast(table), "_bare", "left")
    return c.select("contact", F.coalesce("_exact", special_kind(F.col("contact"), {}, senders, patterns)).alias("kind")).where("kind is not null")


def special_numbers(r: DataFrame, exact: dict[str, str], senders: dict[str, str], patterns: list[tuple[str, str]]) -> DataFrame:
    """Special numbers of each subscriber with their records, seconds and days."""
    g = r.groupBy(KEY, "contact").agg(F.count("*").alias("n"), F.sum("duration_seconds").alias("seconds"), F.min(F.to_date("ts")).alias("first_day"), F.max(F.to_date("ts")).alias("last_day"))
    return g.join(special_contacts(g, exact, senders, patterns), "contact").select(KEY, "contact", "kind", "n", "seconds", "first_day", "last_day")


def forwarded_to(*fields: str) -> Column:
    """The first of the fields that names a number other than the subscriber's own."""
    return F.coalesce(*(F.when((F.col(f) != "") & (F.col(f) != F.col("own")), F.col(f)) for f in fields))


def forwarded_calls(r: DataFrame, *fields: str) -> DataFrame:
    """Forwarded calls, by type or by a field that names where to."""
    to = forwarded_to(*fields)
    f = r.where((F.col("record_type") == "CALL_FORWARDED") | to.isNotNull())
    return f.select(KEY, "event_id", "ts", F.coalesce("contact", F.lit("")).alias("contact"), F.coalesce(to, F.lit("")).alias("forwarded_to"), "duration_seconds")


def satellite_operator(number: str, rules: list[tuple[str, str, str]]) -> Column:
    """The satellite network that a number's prefix fits, by the first rule (operator, pattern with a
    plus, pattern of digits), in order of confidence; null for others."""
    n = F.regexp_replace(F.regexp_replace(number, r"[^0-9+]", ""), "^00", "+")
    digits = F.regexp_replace(n, r"\+", "")
    out = F.lit(None).cast("string")
    for name, plus, bare in reversed(rules):
        out = F.when(n.rlike(f"^(?:{plus})") | digits.rlike(f"^(?:{bare})"), name).otherwise(out)
    return F.when(F.length(n) >= 6, out)


def satellite_numbers(r: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Contacts whose number is of a satellite network. Numbers are looked at once each."""
    g = r.where("contact <> ''").groupBy(KEY, "contact").agg(F.count("*").alias("n"), F.countDistinct(F.to_date("ts")).alias("days"))
    return g.withColumn("operator", satellite_operator("contact", rules)).where("operator is not null")


def platforms(r: DataFrame, rules: list[tuple[str, str, str]], fields: list[str]) -> DataFrame:
    """Names of messengers and networks in a record's texts; all that fit count. rules: platform,
    category, pattern."""
    text = F.lower(F.concat_ws(" ", *fields))
    hits = [F.when(F.col("_t").rlike(f"(?i){p}"), F.struct(F.lit(n).alias("platform"), F.lit(c).alias("category"))) for n, c, p in rules]
    e = r.withColumn("_t", text).select(KEY, "ts", "record_type", "contact", "own", F.explode(F.array(*hits)).alias("h")).where("h is not null")
    other = F.when(F.col("contact") != F.col("own"), F.col("contact"))
    types = F.array_join(F.array_sort(F.collect_set("record_type")), ",")
    return e.groupBy(KEY, "h.platform", "h.category").agg(
        F.count("*").alias("n"), F.countDistinct(F.to_date("ts")).alias("days"), types.alias("types"), F.countDistinct(other).alias("contacts"),
    )


def roaming(r: DataFrame) -> DataFrame:
    """Records in each foreign country and network, with their span."""
    return r.where("country <> ''").groupBy(KEY, "country", "network").agg(F.count("*").alias("n"), F.count_if(is_call()).alias("calls"), F.count_if(F.col("record_type") == "DATA").alias("data"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct(F.to_date("ts")).alias("days"))


def areas(r: DataFrame, top: int = 10) -> DataFrame:
    """Places rolled up to the city that their label begins with, the most used of each subscriber."""
    city = F.trim(F.regexp_extract("place", "^([^,]*)", 1))
    g = r.where("place <> ''").groupBy(KEY, city.alias("area")).agg(F.count("*").alias("n"), F.countDistinct("place").alias("places"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("n"), "area"))).where(F.col("rank") <= top)


#: Premium numbers of the home country, and how severe each group of findings is.
PREMIUM = r"^\+?48[78]0\d"
SEVERITY = {
    "long_call": "info", "late_night_calls": "warning", "night_activity": "warning", "night_movement": "warning", "burst_activity": "warning", "premium_number": "info", "roaming": "info",
    "foreign_contacts": "info", "forwarded_calls": "warning", "one_time_contacts": "info", "satellite_numbers": "warning", "social_media": "info", "inactivity_gap": "info",
}


def _found(counts: dict[str, Column], worse: dict[str, Column] = {}) -> Column:
    """(type, severity, n) of the groups with findings, out of a subscriber's counts."""
    severity = lambda t: F.when(worse[t], "critical").otherwise(SEVERITY[t]) if t in worse else F.lit(SEVERITY[t])
    each = [F.when(n > 0, F.struct(F.lit(t).alias("type"), severity(t).alias("severity"), n.cast("long").alias("n"))) for t, n in counts.items()]
    return F.inline(F.array_compact(F.array(*each)))


def _found_in_cells(r: DataFrame, prefixes: DataFrame, satellites: list, messengers: list, home: str, critical: list[str], forwarding: list[str]) -> DataFrame:
    """Findings that need no order: records are added up by contact, network abroad and platform in one
    shuffle, and these sums by subscriber."""
    cell = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    own = [cell("contact", F.col("contact"), F.lit(None).cast("string")), F.when(F.col("country") != "", cell("roaming", F.col("country"), F.col("network")))]
    social = [F.when(F.col("_t").rlike(f"(?i){p}"), cell("social", F.lit(n), F.lit(c))) for n, c, p in messengers]
    marks = {
        "long": is_call() & (F.col("duration_seconds") > 3600), "late": is_call() & (F.hour("ts") < 5) & (F.col("duration_seconds") >= 10),
        "night": (F.hour("ts") >= 23) | (F.hour("ts") < 5), "fwd": (F.col("record_type") == "CALL_FORWARDED") | forwarded_to(*forwarding).isNotNull(),
    }
    r = r.withColumn("_t", F.lower(F.concat_ws(" ", "caller", "callee", "network", "service")))
    e = r.select(KEY, *(m.alias(k) for k, m in marks.items()), F.explode(F.array(*own, *social)).alias("f")).where("f is not null")
    cells = e.groupBy(KEY, "f.kind", "f.a", "f.b").agg(F.count("*").alias("n"), *(F.count_if(k).alias(k) for k in marks))
    contact = F.col("kind") == "contact"
    cells = cells.withColumn("contact", F.when(contact & (F.col("a") != ""), F.col("a")))
    abroad = F.when(~F.col("country").isin(home), F.col("country"))
    total = lambda c: F.coalesce(F.sum(F.when(contact, F.col(c))), F.lit(0)).alias(c)
    g = with_country(cells, prefixes).groupBy(KEY).agg(
        *map(total, ["n", *marks]), F.collect_set(abroad).alias("countries"), F.count_if(F.col("contact").rlike(PREMIUM)).alias("premium"),
        F.count_if(F.col("contact").isNotNull() & (F.col("n") == 1)).alias("once"), F.count_if(satellite_operator("contact", satellites).isNotNull()).alias("satellite"),
        F.count_if(F.col("kind") == "roaming").alias("roaming"), F.count_if(F.col("kind") == "social").alias("social"),
    )
    counts = {
        "long_call": F.col("long"), "late_night_calls": F.col("late"), "night_activity": (F.col("night") / F.col("n") > 0.3).cast("int"), "premium_number": F.col("premium"),
        "roaming": F.col("roaming"), "foreign_contacts": F.size("countries"), "forwarded_calls": F.col("fwd"), "one_time_contacts": F.least("once", F.lit(30)),
        "satellite_numbers": F.col("satellite"), "social_media": F.col("social"),
    }
    return g.select(KEY, _found(counts, {"foreign_contacts": F.arrays_overlap("countries", F.lit(list(critical)))} if critical else {}))


def _found_in_order(r: DataFrame, least: int = 20, minutes: int = 30, hours: int = 12) -> DataFrame:
    """Findings between neighbours: moves and bursts within a day, pauses within and between days, so a
    window holds a day's records or a subscriber's days."""
    talk = is_call() | F.col("record_type").startswith("SMS")
    d = r.select(KEY, "event_id", "ts", "place", F.coalesce(talk, F.lit(False)).alias("talk"), F.to_date("ts").alias("day"), F.floor(seconds() / 60).alias("minute"))
    w, near = in_order("day"), Window.partitionBy(KEY, "day").orderBy("minute").rangeBetween(0, minutes)
    d = d.withColumn("p0", F.lag("place").over(w)).withColumn("t0", F.lag("ts").over(w)).withColumn("k", F.count_if("talk").over(near))
    night = lambda c: (F.hour(c) >= 22) | (F.hour(c) < 6)
    move = F.when((F.col("p0") != F.col("place")) & night("ts") & night("t0"), F.struct("p0", "place"))
    pause = lambda a, b: F.count_if(seconds(b) - seconds(a) >= hours * 3600)
    days = d.groupBy(KEY, "day").agg(
        F.countDistinct(move).alias("moves"), F.max(F.col("talk") & (F.col("k") >= least)).alias("burst"), pause("t0", "ts").alias("gaps"), F.min("ts").alias("first"), F.max("ts").alias("last"),
    )
    days = days.withColumn("before", F.lag("last").over(Window.partitionBy(KEY).orderBy("day")))
    bursts_ = F.count_if(F.col("burst") & F.col("day").isNotNull())
    g = days.groupBy(KEY).agg(F.sum("moves").alias("moves"), bursts_.alias("bursts"), (F.sum("gaps") + pause("before", "first")).alias("gaps"))
    return g.select(KEY, _found({"night_movement": F.col("moves"), "burst_activity": F.col("bursts"), "inactivity_gap": F.col("gaps")}))


def anomaly_report(r: DataFrame, prefixes: DataFrame, satellites: list[tuple[str, str, str]], messengers: list[tuple[str, str, str]], home: str = "PL", critical: list[str] = (), forwarding: list[str] = ("related",)) -> DataFrame:
    """How many findings each subscriber has of each group, with the group's severity; contacts in a
    critical country make foreign contacts critical. Groups without findings have no row. Records are read
    twice: once by contact, once by day."""
    cells = _found_in_cells(r, prefixes, satellites, messengers, home, critical, forwarding)
    return cells.unionByName(_found_in_order(r))


def severest(report: DataFrame, n: int = 3) -> DataFrame:
    """The most severe groups of each subscriber."""
    order = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return report.withColumn("rank", F.row_number().over(Window.partitionBy(KEY).orderBy(order, F.desc("n"), "type"))).where(F.col("rank") <= n)


def hour_frame(r: DataFrame) -> DataFrame:
    """All 24 hours of each subscriber, zeros included."""
    hours = F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour")
    frame = r.select(KEY).distinct().select(KEY, hours)
    g = r.groupBy(KEY, F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    return frame.join(g, [KEY, "hour"], "left").select(KEY, "hour", F.coalesce("n", F.lit(0)).alias("n"))


def place_hours(r: DataFrame, top: int = 10) -> DataFrame:
    """Records by hour of each subscriber's busiest places."""
    w = Window.partitionBy(KEY).orderBy(F.desc("n"), "place")
    places = r.where("place <> ''").groupBy(KEY, "place").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    g = r.groupBy(KEY, "place", F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    return g.join(places.select(KEY, "place", "rank"), [KEY, "place"]).select(KEY, "rank", "place", "hour", "n")


def type_frame(r: DataFrame) -> DataFrame:
    """Records of each type and their share."""
    g = r.groupBy(KEY, "record_type").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(KEY)), 4))


def top_contacts(r: DataFrame, top: int = 15) -> DataFrame:
    """The contacts of most records, with calls and messages apart."""
    g = r.where("contact <> ''").groupBy(KEY, "contact").agg(F.count("*").alias("n"), F.count_if(is_call()).alias("calls"), F.count_if(F.col("record_type").startswith("SMS")).alias("messages"))
    w = Window.partitionBy(KEY).orderBy(F.desc("n"), "contact")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def network_frame(r: DataFrame, top: int = 12) -> DataFrame:
    """Records by network, the rest as one."""
    g = r.where("network <> ''").groupBy(KEY, "network").agg(F.count("*").alias("n"))
    w = Window.partitionBy(KEY).orderBy(F.desc("n"), "network")
    g = g.withColumn("network", F.when(F.row_number().over(w) <= top, F.col("network")).otherwise("other"))
    return g.groupBy(KEY, "network").agg(F.sum("n").alias("n"))


def daily_cost(r: DataFrame, cost: str = "cost") -> DataFrame:
    """The cost of each day, and in all up to it."""
    g = r.where(F.col(cost).isNotNull()).groupBy(KEY, F.to_date("ts").alias("day")).agg(F.sum(cost).alias("c"))
    w = Window.partitionBy(KEY).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return g.select(KEY, "day", F.col("c").cast("double").alias("cost"), F.sum("c").over(w).cast("double").alias("total"))


#: Upper limits of the duration bins in seconds.
BINS = [10, 30, 60, 120, 300, 600, 1800]


def duration_histogram(r: DataFrame) -> DataFrame:
    """Eight bins of call lengths."""
    b = F.lit(len(BINS))
    for i, x in reversed(list(enumerate(BINS))):
        b = F.when(F.col("duration_seconds") < x, i).otherwise(b)
    return r.where(is_call()).groupBy(KEY, b.cast("int").alias("bin")).agg(F.count("*").alias("n"))
