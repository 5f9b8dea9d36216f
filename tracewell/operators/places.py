"""Operators over places and movement, and over subscriber identities.

Located records: subscriber (the key), event_id, ts, lat, lon. Clusters are made of grid cells, so
what is grouped never grows beyond a key's distinct cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import grid, haversine
from ..sources.scratch import stash
from . import ranks

KEY = "subscriber"


def _large(df: DataFrame) -> DataFrame:
    """A table that grows with the records, to be joined by sorting: by the size of its file, which is packed
    well, Spark would broadcast it, and on the driver it is many times that."""
    return df.hint("merge")


def cells(r: DataFrame, metres: float = 500.0) -> DataFrame:
    """Counts, sums and first record of grid cells."""
    g = r.where("lat is not null and lon is not null").withColumn("cy", grid(F.col("lat"), metres)).withColumn("cx", grid(F.col("lon"), metres))
    return g.groupBy(KEY, "cy", "cx").agg(F.count("*").alias("n"), F.sum("lat").alias("sum_lat"), F.sum("lon").alias("sum_lon"), F.min(F.struct("ts", "event_id")).alias("first"))


def _about(df: DataFrame) -> DataFrame:
    """Each cell's turn at the nine cells about it; own: at itself."""
    d = F.explode(F.array(*(F.struct(F.lit(dy).alias("y"), F.lit(dx).alias("x")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)))).alias("d")
    own = (F.col("d.y") == 0) & (F.col("d.x") == 0)
    return df.select(KEY, "cy", "cx", "turn", d).select(KEY, (F.col("cy") + F.col("d.y")).alias("cy"), (F.col("cx") + F.col("d.x")).alias("cx"), "turn", own.alias("own"))


def seeds(c: DataFrame, least: int, log: list[int] | None = None) -> DataFrame:
    """The cells at which greedy visiting (by turn: most records first) begins a cluster.

    A cell with enough records begins one if none of its neighbours before it in the order does. Rounds
    find them all at once: a cell before all its undecided neighbours begins one, which decides those
    neighbours; what is left goes on to the next round. log: gets the number of undecided cells of each
    round. What is met about a cell is added up there, not joined to it.
    """
    left = stash(c.where(F.col("n") >= least).select(KEY, "cy", "cx", "turn"), "cells")
    found, n = [], left.count()
    while n:
        if log is not None:
            log.append(n)
        at = _about(left).groupBy(KEY, "cy", "cx").agg(F.min("turn").alias("best"), F.max(F.when(F.col("own"), F.col("turn"))).alias("turn"))
        new = stash(at.where("best = turn").drop("best"), "seeds")
        found.append(new)
        decided = _about(new).select(KEY, "cy", "cx", F.lit(None).cast("int").alias("turn"), F.lit(True).alias("decided"))
        both = left.withColumn("decided", F.lit(False)).unionByName(decided).groupBy(KEY, "cy", "cx").agg(F.max("turn").alias("turn"), F.bool_or("decided").alias("decided"))
        left = stash(both.where("turn is not null and not decided").drop("decided"), "cells")
        n = left.count()
    out = found[0] if found else left
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def clusters(r: DataFrame, least: int = 3, top: int = 30, metres: float = 500.0, log: list[int] | None = None) -> DataFrame:
    """M4: greedy clusters: cells in the order of their records (of equal ones the one seen first) begin a
    cluster, if they have enough, and take their neighbours that none has taken; each key's largest."""
    turn = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("n"), "first", "cy", "cx"))
    c = stash(cells(r, metres).withColumn("turn", turn).drop("first"), "cells")
    takes = _about(seeds(c, least, log)).groupBy(KEY, "cy", "cx").agg(F.min("turn").alias("seed"))
    joined = c.join(_large(takes), [KEY, "cy", "cx"])
    of_seed = lambda x: F.max(F.when(F.col("turn") == F.col("seed"), F.col(x)))
    g = joined.groupBy(KEY, "seed").agg(of_seed("cy").alias("seed_y"), of_seed("cx").alias("seed_x"), F.sum("n").alias("n"), (F.sum("sum_lat") / F.sum("n")).alias("lat"), (F.sum("sum_lon") / F.sum("n")).alias("lon"), F.count("*").alias("cells"))
    w = Window.partitionBy(KEY).orderBy(F.desc("n"), "seed")
    return g.withColumn("cluster", F.row_number().over(w)).where(F.col("cluster") <= top).drop("seed")


def home_and_work(r: DataFrame, days: int = 3) -> DataFrame:
    """M5: the place of most night records times days, and that of most working ones."""
    night = (F.hour("ts") >= 22) | (F.hour("ts") < 6)
    work = (F.hour("ts") >= 8) & (F.hour("ts") < 16)
    g = r.groupBy(KEY, "place").agg(F.count_if(night).alias("night"), F.count_if(work).alias("work"), F.count_if(work & (F.weekday("ts") < 5)).alias("week"), F.countDistinct(F.to_date("ts")).alias("days")).where(F.col("days") >= days)
    home, job = F.col("night") * F.col("days"), F.when(F.col("work") > 0, F.col("days") * F.col("week")).otherwise(0)
    return g.groupBy(KEY).agg(F.min_by("place", F.struct(-home, "place")).alias("home"), F.min_by("place", F.struct(-job, "place")).alias("work"))


def path(r: DataFrame, least_m: float = 200.0) -> DataFrame:
    """M9: steps longer than some metres between neighbouring records, with speed."""
    w = Window.partitionBy(KEY).orderBy("ts", "event_id")
    d = r.withColumn("lat0", F.lag("lat").over(w)).withColumn("lon0", F.lag("lon").over(w)).withColumn("ts0", F.lag("ts").over(w)).where("lat0 is not null")
    m = haversine(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"))
    s = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.col("ts0").cast("timestamp"))
    return d.withColumn("metres", m).withColumn("seconds", s).where(F.col("metres") > least_m)


def car_minutes(km: Column) -> Column:
    """Minutes by car: 40, 70 or 90 km/h for short, middle and long ways."""
    return F.when(km < 30, km / 40).when(km < 150, km / 70).otherwise(km / 90) * 60


def travel_mode(km: Column, minutes: Column, kmh: Column) -> Column:
    """M8: bts_hop for what nobody can do in the time, plane for long ways at speed, car for what a car
    does, else unknown."""
    car = car_minutes(km)
    hop = ((minutes < 3) & (km > 5)) | ((minutes < 10) & (kmh > 300)) | ((minutes < 15) & (kmh > 500))
    plane = ((km > 200) & (kmh > 200)) | ((km > 400) & (minutes < car * 0.4))
    drive = kmh.between(10, 200) | (minutes / car).between(0.3, 4.0)
    return F.when(hop, "bts_hop").when(plane, "plane").when(drive, "car").otherwise("unknown")


def cluster_trips(r: DataFrame, centres: DataFrame, least_km: float = 5.0) -> DataFrame:
    """M8: changes of the nearest cluster from one record to the next, between clusters far enough apart,
    with the time since the record before; hops between masts are left out."""
    near = _nearest(r.select(KEY, "event_id", "ts", "lat", "lon"), centres, KEY).select(KEY, "event_id", "ts", "b")
    w = Window.partitionBy(KEY).orderBy("ts", "event_id")
    d = near.withColumns({"b0": F.lag("b").over(w), "ts0": F.lag("ts").over(w)}).where("b0.cluster <> b.cluster")
    d = d.withColumns({"c0": F.col("b0.cluster"), "cluster": F.col("b.cluster")})
    km = haversine(F.col("b0.clat"), F.col("b0.clon"), F.col("b.clat"), F.col("b.clon")) / 1000
    s = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.col("ts0").cast("timestamp"))
    d = d.withColumns({"km": km, "minutes": F.when(s > 0, s / 60).otherwise(0.01)}).where(F.col("km") >= least_km)
    d = d.withColumn("kmh", F.col("km") / (F.col("minutes") / 60))
    d = d.withColumn("mode", travel_mode(F.col("km"), F.col("minutes"), F.col("kmh"))).where("mode <> 'bts_hop'")
    return d.select(KEY, "event_id", F.col("c0").alias("from_cluster"), F.col("cluster").alias("to_cluster"), F.round("km", 1).alias("km"), F.round("minutes", 1).alias("minutes"), F.round("kmh", 0).alias("kmh"), "mode")


def border_crossings(r: DataFrame, gap_hours: int = 48) -> DataFrame:
    """For subscribers that ever roam, runs of roaming records between the last home record and the
    first one after (null: not back yet); for all others, pauses of ``gap_hours`` and more.

    A run at the beginning has no home record before it; without one after it either it is nothing.
    """
    sec = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    w = Window.partitionBy(KEY).orderBy("ts", "event_id")
    change = F.when(F.col("roaming") != F.coalesce(F.lag("roaming").over(w), ~F.col("roaming")), 1).otherwise(0)
    d = r.withColumn("change", change).withColumn("island", F.sum("change").over(w))
    order = F.struct("ts", "event_id")
    g = d.groupBy(KEY, "island", "roaming").agg(F.min("ts").alias("a"), F.max("ts").alias("z"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("country")), ",").alias("countries"), F.max_by(F.struct("lat", "lon"), order).alias("at"))
    v = Window.partitionBy(KEY).orderBy("island")
    g = g.withColumns({"left_ts": F.lag("z").over(v), "back_ts": F.lead("a").over(v), "at": F.lag("at").over(v)}).where("roaming and (left_ts is not null or back_ts is not null)")
    one = g.select(KEY, "left_ts", "back_ts", F.col("n").alias("records"), "countries", F.lit(True).alias("confirmed"), F.col("at.lat").alias("lat"), F.col("at.lon").alias("lon"), ((sec("z") - sec("left_ts")) / 3600).alias("so_far"))
    never = r.groupBy(KEY).agg(F.bool_or("roaming").alias("any")).where("not any").select(KEY)
    h = r.join(never, KEY, "left_semi").withColumns({"left_ts": F.lag("ts").over(w), "lat0": F.lag("lat").over(w), "lon0": F.lag("lon").over(w)}).where(sec("ts") - sec("left_ts") >= gap_hours * 3600)
    two = h.select(KEY, "left_ts", F.col("ts").alias("back_ts"), F.lit(0).cast("long").alias("records"), F.lit("").alias("countries"), F.lit(False).alias("confirmed"), F.col("lat0").alias("lat"), F.col("lon0").alias("lon"), F.lit(None).cast("double").alias("so_far"))
    hours = F.coalesce((sec("back_ts") - sec("left_ts")) / 3600, F.when(F.col("back_ts").isNull(), F.col("so_far")), F.lit(0.0))
    return one.unionByName(two).withColumn("absence_hours", F.round(hours, 1)).drop("so_far")


def near_airport(points: DataFrame, airports: DataFrame, metres: float = 15_000.0) -> DataFrame:
    """The nearest airport (airport, alat, alon) within some metres of each point (id, lat, lon), by an
    equi-join on bands of latitude. Points without one have no row."""
    width = metres / 111_000.0
    band = lambda c: F.floor(F.col(c) / width)
    a = airports.withColumn("band", F.explode(F.array(*(band("alat") + i for i in (-1, 0, 1)))))
    near = points.withColumn("band", band("lat")).join(a, "band").withColumn("metres", haversine(F.col("lat"), F.col("lon"), F.col("alat"), F.col("alon"))).where(F.col("metres") <= metres)
    return near.groupBy("id").agg(F.min(F.struct("metres", "airport")).alias("b")).select("id", "b.airport", F.round("b.metres", 1).alias("metres"))


def crossing_mode(c: DataFrame, airports: DataFrame, neighbours: list[str]) -> DataFrame:
    """Plane, car or walk for each crossing, from the last point at home, how long and where to."""
    c = c.withColumn("id", F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct("lat", "lon")))
    a = near_airport(c.where("id is not null").select("id", "lat", "lon").distinct(), airports).select("id", "airport")
    at = F.filter(F.split("countries", ","), lambda x: x != "")
    far = F.size(F.filter(at, lambda x: ~x.isin(*neighbours))) > 0
    some = F.size(at) > 0
    by_air = F.col("airport").isNotNull() & (far | ((F.col("absence_hours") < 12) & some))
    mode = F.when(by_air | far, "plane").when(F.col("absence_hours") < 6, "walk").when(some, "car").otherwise("unknown")
    return c.join(a, "id", "left").withColumn("mode", mode).drop("id")


def last_day_path(c: DataFrame, r: DataFrame) -> DataFrame:
    """The places at home in the 24 hours before each crossing, each 100 m square once, in order; by an
    equi-join on days."""
    day = F.to_date("left_ts")
    a = c.where("left_ts is not null").select(KEY, "left_ts", F.explode(F.array(day, F.date_sub(day, 1))).alias("day")).distinct()
    home = r.where("not roaming and lat is not null and lon is not null").select(KEY, "ts", "lat", "lon", F.to_date("ts").alias("day"))
    j = a.join(home, [KEY, "day"]).where("ts <= left_ts and ts >= left_ts - interval 24 hours")
    g = j.groupBy(KEY, "left_ts", F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon")).agg(F.min("ts").alias("first_ts"))
    return g.withColumn("step", F.row_number().over(Window.partitionBy(KEY, "left_ts").orderBy("first_ts", "lat", "lon")))


def bounds(r: DataFrame) -> DataFrame:
    """Centre and bounds of each subscriber's points."""
    return r.groupBy(KEY).agg(F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"), F.min("lat").alias("lat0"), F.max("lat").alias("lat1"), F.min("lon").alias("lon0"), F.max("lon").alias("lon1"), F.count("*").alias("n"))


def cells_near(cells_: DataFrame, lat: float, lon: float, box: float, limit: int = 200) -> DataFrame:
    """Cells within a box about a point, the nearest first by the sum of both differences."""
    d = F.abs(F.col("lat") - lat) + F.abs(F.col("lon") - lon)
    own = cells_.where(F.col("lat").between(lat - box, lat + box) & F.col("lon").between(lon - box, lon + box))
    return own.withColumn("distance", F.round(d, 6)).orderBy("distance", "cell").limit(min(limit, 200))


def cell_stats(cells_: DataFrame) -> DataFrame:
    """Cells by source, by radio and in all, with distinct cities."""
    return cells_.groupingSets([[F.col("source")], [F.col("radio")], []], "source", "radio").agg(F.count("*").alias("n"), F.countDistinct("city").alias("cities"))


def modal_labels(r: DataFrame, by: list[str], labels: list[str]) -> DataFrame:
    """The most frequent value of each label (ties by name)."""
    out = None
    for c in labels:
        g = r.where(F.col(c) != "").groupBy(*by, c).agg(F.count("*").alias("k")).groupBy(*by).agg(F.min_by(c, F.struct(-F.col("k"), c)).alias(c))
        out = g if out is None else out.join(g, by, "full_outer")
    return out


def trips(r: DataFrame, least_m: float = 5000.0) -> DataFrame:
    """M8: longer steps by mode: plane beyond 250 km/h and 100 km, implausible hops, else car."""
    p = path(r, least_m)
    kmh = F.when(F.col("seconds") > 0, F.col("metres") / F.col("seconds") * 3.6)
    mode = F.when((kmh > 250) & (F.col("metres") > 100_000), "plane").when(kmh.isNull() | (kmh > 250), "bts_hop").otherwise("car")
    return p.select(KEY, "event_id", F.round("metres", 1).alias("metres"), "seconds", mode.alias("mode"))


def crossings(r: DataFrame) -> DataFrame:
    """Runs of roaming records between home ones (gaps and islands)."""
    w = Window.partitionBy(KEY).orderBy("ts", "event_id")
    change = F.when(F.col("roaming") != F.coalesce(F.lag("roaming").over(w), ~F.col("roaming")), 1).otherwise(0)
    d = r.withColumn("change", change).withColumn("island", F.sum("change").over(w))
    g = d.groupBy(KEY, "island", "roaming").agg(F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"), F.count("*").alias("n"))
    last = g.groupBy(KEY).agg(F.max("island").alias("last"))
    return g.where("roaming").join(last, KEY).where("island > 1 and island < last").select(KEY, "from_ts", "to_ts", "n")


def merge_crossings(c: DataFrame, days: int = 1) -> DataFrame:
    """Crossings at most so many days apart are one."""
    w = Window.partitionBy(KEY).orderBy("from_ts")
    gap = F.unix_timestamp(F.col("from_ts").cast("timestamp")) - F.unix_timestamp(F.col("before").cast("timestamp"))
    d = c.withColumn("before", F.max("to_ts").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("new", F.when(gap <= days * 86400, 0).otherwise(1))
    d = d.withColumn("trip", F.sum("new").over(w))
    return d.groupBy(KEY, "trip").agg(F.min("from_ts").alias("from_ts"), F.max("to_ts").alias("to_ts"), F.sum("n").alias("n"), F.count("*").alias("parts"))


def plain_place(c: Column) -> Column:
    """An address as the cache knows it: small letters, single blanks."""
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")


def resolve_points(r: DataFrame, stations: DataFrame, addresses: DataFrame | None = None) -> DataFrame:
    """M2: the record's own point, else that of its cell from the best source, else that of its address
    (column address) in the cache (address, lat, lon; of several rows of one the smallest point)."""
    rank = F.when(F.col("source") == "uke", 0).when(F.col("source") == "billing", 1).when(F.col("source") == "opencellid", 2).otherwise(3)
    best = stations.groupBy("cell").agg(F.min_by(F.struct("lat", "lon", "source"), F.struct(rank, "lat", "lon")).alias("s"))
    out = r.join(best, "cell", "left").withColumn("c", F.lit(None).cast("struct<lat:double,lon:double>"))
    if addresses is not None:
        known = addresses.where("lat is not null and lon is not null").groupBy(plain_place("address").alias("_a")).agg(F.min(F.struct("lat", "lon")).alias("c"))
        out = out.drop("c").withColumn("_p", plain_place("address")).join(known, F.col("_p") == F.col("_a"), "left")
    own, cell, cached = F.col("own_lat").isNotNull(), F.col("s").isNotNull(), F.col("c").isNotNull()
    pick = lambda x: F.when(own, F.col(f"own_{x}")).when(cell, F.col(f"s.{x}")).otherwise(F.col(f"c.{x}")).alias(x)
    return out.select("event_id", pick("lat"), pick("lon"), F.when(own, "direct").when(cell, F.col("s.source")).when(cached, "address").otherwise("none").alias("source"))


def _nearest(points: DataFrame, centres: DataFrame, key: str) -> DataFrame:
    """Each point with its nearest centre in b: metres, cluster, clat, clon."""
    at = points.select(key, "lat", "lon").where("lat is not null and lon is not null").distinct()
    j = at.join(_large(centres.select(key, "cluster", F.col("lat").alias("clat"), F.col("lon").alias("clon"))), key)
    m = haversine(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"))
    best = j.groupBy(key, "lat", "lon").agg(F.min(F.struct(F.round(m, 1).alias("metres"), "cluster", "clat", "clon")).alias("b"))
    return points.join(_large(best), [key, "lat", "lon"])


def nearest_of(points: DataFrame, centres: DataFrame, key: str = KEY) -> DataFrame:
    """M7: each point's nearest centre of its key (a key has some tens at most), and how far it is. Places
    are measured once, not once for each of their records; all columns of the points stay."""
    return _nearest(points, centres, key).select(*points.columns, "b.cluster", "b.metres")


def in_area(r: DataFrame, lat: float, lon: float, metres: float) -> DataFrame:
    """Records inside a circle, boxed first."""
    d = metres / 111_000.0
    box = r.where(F.col("lat").between(lat - d, lat + d))
    return box.where(haversine(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon)) <= metres)


def in_rectangle(r: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """Records inside a rectangle, borders included; one whose west is beyond its east crosses the
    180th meridian."""
    lon = F.col("lon").between(west, east) if west <= east else (F.col("lon") >= west) | (F.col("lon") <= east)
    return r.where(F.col("lat").between(south, north) & lon)


def last_number(c: Column, n: int = 9) -> Column:
    """The last digits of a number."""
    return F.right(F.regexp_replace(c, r"\D", ""), F.lit(n))


def record_quality(ids: DataFrame) -> DataFrame:
    """I4: points for each field that is filled."""
    filled = lambda c, p: F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), p).otherwise(0)
    return ids.withColumn("quality", filled("person_id", 40) + filled("name", 30) + filled("segment", 20) + filled("operator", 10))


def best_records(ids: DataFrame) -> DataFrame:
    """The best record of each number, ties by record."""
    w = Window.partitionBy("number").orderBy(F.desc("quality"), "record_id")
    return record_quality(ids).withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def cross_enrich(ids: DataFrame) -> DataFrame:
    """Missing fields from the best record of the number, then of the person. The best known value of
    each field is found by group before records are joined with it, so records without a number or a
    person, however many, are no group."""
    fields = ["person_id", "name", "segment", "operator"]
    out = record_quality(ids).select("record_id", "number", "quality", *fields)
    order = F.struct((-F.col("quality")).alias("q"), "record_id")
    for by in ("number", "person_id"):
        known = out.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("_by"))
        best = known.agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(f"_{c}") for c in fields))
        out = out.join(best, F.col(by) == F.col("_by"), "left").select("record_id", "number", "quality", *(F.coalesce(c, f"_{c}").alias(c) for c in fields))
    return out


def identity_groups(ids: DataFrame, least: int = 2) -> DataFrame:
    """Numbers and operators of each person, and the name of the best record."""
    g = record_quality(ids).where("person_id is not null").groupBy("person_id").agg(F.countDistinct("number").alias("numbers"), F.countDistinct("operator").alias("operators"), F.min_by("name", F.struct(-F.col("quality"), "record_id")).alias("name"))
    return g.where(F.col("numbers") >= least)


def file_subscriber(r: DataFrame, columns: list[str]) -> DataFrame:
    """The number that stands most often in a file's columns (ties by number), and how often."""
    n = r.select("file", F.explode(F.array(*(last_number(F.col(c)) for c in columns))).alias("number")).where("length(number) = 9")
    g = n.groupBy("file", "number").agg(F.count("*").alias("k"))
    return g.groupBy("file").agg(F.min_by("number", F.struct(-F.col("k"), "number")).alias("number"), F.max("k").alias("n"))


def file_groups(files: DataFrame) -> DataFrame:
    """The files of each subscriber (file, operator, number, n) and what confirms them: one operator only,
    several operators, or a single file."""
    g = files.groupBy("number").agg(F.count("*").alias("files"), F.countDistinct("operator").alias("operators"), F.sum("n").alias("records"), F.array_join(F.array_sort(F.collect_set("file")).cast("array<string>"), ",").alias("names"))
    return g.withColumn("reason", F.when(F.col("files") == 1, "single").when(F.col("operators") > 1, "several_operators").otherwise("same_operator"))


#: What a record says that names nobody, that another operator serves it, and companies' marks.
NO_DATA, ELSEWHERE = ["brak danych", "nie przydzielony", "nie znaleziono"], ["obsługiwany przez", "przeniesiony"]
COMPANIES = ["sp. z o.o", "sp. zo.o", "spółka", "s.a.", "sp.j.", "sp.k.", "fundacja", "stowarzyszenie", "urząd", "szkoła", "zakład", "przedsiębiorstwo", "firma", "gospodarstwo", "bank ", "poczta polska", "centrum "]


def result_type(name: Column, person_id: Column, company_id: Column) -> Column:
    """What an answer is: another operator's number, nobody, a company, a person, or unknown."""
    low = F.lower(F.trim(name))
    says = lambda xs: sum((F.when(low.contains(x), 1).otherwise(0) for x in xs), F.lit(0)) > 0
    words = F.split(F.trim(name), r"\s+")
    looks = F.size(words).between(2, 4) & F.forall(words, lambda w: w.rlike(r"^\p{Lu}"))
    out = F.when(says(ELSEWHERE), "other_operator").when(says(NO_DATA), "not_found").when(says(COMPANIES), "company")
    out = out.when(F.coalesce(person_id.cast("string"), F.lit("")) != "", "person").when(F.coalesce(company_id.cast("string"), F.lit("")) != "", "company").when(looks, "person").otherwise("unknown")
    return F.when(F.coalesce(name, F.lit("")) == "", "unknown").otherwise(out)


def identity_anomalies(ids: DataFrame, main: list[str]) -> DataFrame:
    """Persons with several numbers (a main subscriber's own, or a contact's), numbers that changed
    operator, and numbers that one operator knew nothing of and another named.

    ids: record_id, number, operator, person_id, name, kind (as ``result_type``). main: the main numbers.
    """
    g = ids.where("person_id is not null").groupBy("person_id").agg(F.countDistinct("number").alias("n"), F.max(F.col("number").isin(*main)).alias("m"), F.array_join(F.array_sort(F.collect_set("number")), ",").alias("detail")).where("n >= 2")
    several = g.select(F.col("person_id").cast("string").alias("subject"), F.when(F.col("m"), "multi_number_main_owner").otherwise("multi_number_contact").alias("type"), F.when(F.col("m"), "warning").otherwise("info").alias("severity"), "detail")
    m = ids.groupBy("number").agg(F.countDistinct("operator").alias("n"), F.array_join(F.array_sort(F.collect_set("operator")).cast("array<string>"), ",").alias("detail")).where("n >= 2")
    moved = m.select(F.col("number").alias("subject"), F.lit("number_migration").alias("type"), F.lit("info").alias("severity"), "detail")
    none = F.col("kind").isin("not_found", "other_operator")
    e = ids.groupBy("number").agg(F.count_if(none).alias("without"), F.count_if(~none & F.col("name").isNotNull()).alias("with_"), F.min(F.when(~none, F.col("name"))).alias("detail")).where("without > 0 and with_ > 0")
    filled = e.select(F.col("number").alias("subject"), F.lit("data_enriched").alias("type"), F.lit("info").alias("severity"), "detail")
    return several.unionByName(moved).unionByName(filled)


def operator_history(ids: DataFrame) -> DataFrame:
    """I8: operators of each person in the order of their records."""
    w = Window.partitionBy("person_id").orderBy("record_id")
    d = ids.where("person_id is not null").withColumn("before", F.lag("operator").over(w)).where("before is null or before <> operator")
    h = F.array_sort(F.collect_list(F.struct("record_id", "operator")))
    return d.groupBy("person_id").agg(h.alias("h")).select("person_id", (F.size("h") - 1).alias("migrations"), F.array_join(F.transform("h", lambda x: x["operator"].cast("string")), ">").alias("path"))


def transit(r: DataFrame, labels: DataFrame) -> DataFrame:
    """M6: places on the way, by four signals of 25 points: short stays (upper median under 15
    minutes), commuting hours (6 to 9 and 16 to 19) over 70 %, near the line from home to work, and
    at most 1.5 records a day. Home and work themselves are left out.

    r: key, place, ts, lat, lon; labels: key, home, work.
    """
    minute = F.hour("ts") * 60 + F.minute("ts")
    day = r.groupBy(KEY, "place", F.to_date("ts").alias("day")).agg((F.max(minute) - F.min(minute)).alias("dwell"))
    stay = ranks.values_at(day, [KEY, "place"], "dwell", {"dwell": (0.5, ranks.UPPER_MIDDLE)}).join(day.groupBy(KEY, "place").agg(F.count("*").alias("days")), [KEY, "place"])
    h = F.hour("ts")
    g = r.groupBy(KEY, "place").agg(F.count("*").alias("n"), F.count_if(h.between(6, 8) | h.between(16, 18)).alias("commute"), F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    g = g.join(stay, [KEY, "place"])
    at = g.select(KEY, "place", "lat", "lon")
    one = labels.join(at.toDF(KEY, "home", "hlat", "hlon"), [KEY, "home"], "left").join(at.toDF(KEY, "work", "wlat", "wlon"), [KEY, "work"], "left")
    g = g.join(one, KEY, "left")
    c = F.col
    turn = F.abs(F.degrees(F.atan2(c("wlon") - c("hlon"), c("wlat") - c("hlat")) - F.atan2(c("lon") - c("hlon"), c("lat") - c("hlat"))))
    turn = F.when(turn > 180, 360 - turn).otherwise(turn)
    hw, hc, cw = haversine(c("hlat"), c("hlon"), c("wlat"), c("wlon")), haversine(c("hlat"), c("hlon"), c("lat"), c("lon")), haversine(c("lat"), c("lon"), c("wlat"), c("wlon"))
    between = (c("home") != c("work")) & (turn <= 30) & (hc < hw * 1.3) & (cw < hw * 1.3)
    points = lambda x: F.when(x, 25).otherwise(0)
    score = points(c("dwell") < 15) + points(c("commute") / c("n") > 0.7) + points(between) + points(c("n") / c("days") <= 1.5)
    own = (c("place") == c("home")) | (c("place") == c("work"))
    return g.where(~F.coalesce(own, F.lit(False))).select(KEY, "place", score.alias("score"), (score >= 50).alias("transit"))
