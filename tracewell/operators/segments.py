"""Operators over text segments, document detection, headers and logs."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_diacritics


def best_overlap(segments: DataFrame, turns: DataFrame, width: float = 60.0) -> DataFrame:
    """Each segment (conv_id, seg, s0, s1) gets the turn's speaker with the most overlap, the
    first of equal ones, else UNKNOWN. Both sides are dealt to time buckets they touch."""
    buckets = lambda a, z: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(z) / width))).alias("bucket")
    s = segments.select("*", buckets("s0", "s1"))
    t = turns.select("conv_id", "turn", "speaker", "t0", "t1", buckets("t0", "t1"))
    shared = F.least("s1", "t1") - F.greatest("s0", "t0")
    hit = s.join(t, ["conv_id", "bucket"]).where(shared > 0)
    best = hit.groupBy("conv_id", "seg").agg(F.min(F.struct((-shared).cast("double").alias("o"), "turn", "speaker")).alias("b"))
    return segments.select("conv_id", "seg").join(best, ["conv_id", "seg"], "left").select("conv_id", "seg", F.coalesce("b.speaker", F.lit("UNKNOWN")).alias("speaker"), F.coalesce(-F.col("b.o"), F.lit(0.0)).alias("overlap"))


def weighted_patterns(text: Column, strong: list[str], moderate: list[str]) -> Column:
    """Three points for each strong pattern, one for each moderate one."""
    return sum((F.when(text.rlike(p), w).otherwise(0) for w, ps in ((3, strong), (1, moderate)) for p in ps), F.lit(0))


def is_document(text: Column, strong: list[str], moderate: list[str], least: int = 3) -> Column:
    """The decision: three points make it one."""
    return weighted_patterns(F.lower(F.coalesce(text, F.lit(""))), strong, moderate) >= least


def protect(text: Column, terms: list[str]) -> Column:
    """Glossary terms, in order, to marks that translation leaves alone."""
    for i, term in enumerate(terms):
        text = F.replace(text, F.lit(term), F.lit(f"[[T{i}]]"))
    return text


def restore(text: Column, terms: list[str]) -> Column:
    for i, term in enumerate(terms):
        text = F.replace(text, F.lit(f"[[T{i}]]"), F.lit(term))
    return text


def sentence_chunks(docs: DataFrame, words: int = 400, page: int = 256) -> DataFrame:
    """T4: whole sentences gathered greedily up to a number of words (a longer one stands alone).

    A fold over a text's sentences keeps where chunks begin, in pages of ``page`` numbers, so that what it
    copies at a new chunk does not grow with the text; sizes are then summed between beginnings.
    """
    parts = F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda x: F.trim(x) != "")
    sizes = F.transform(parts, lambda x: F.size(F.split(F.trim(x), r"\s+")))
    none = F.array().cast("array<int>")

    def step(a, n):
        full = (a["n"] > 0) & (a["n"] + n > words)
        turned = F.size(a["now"]) >= page
        pages = F.when(full & turned, F.concat(a["pages"], F.array(a["now"]))).otherwise(a["pages"])
        now = F.when(full, F.when(turned, F.array(a["i"])).otherwise(F.concat(a["now"], F.array(a["i"])))).otherwise(a["now"])
        return F.struct((a["i"] + 1).alias("i"), F.when(full, n).otherwise(a["n"] + n).alias("n"), now.alias("now"), pages.alias("pages"))

    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("n"), none.alias("now"), F.array().cast("array<array<int>>").alias("pages"))
    first = F.aggregate("sizes", zero, step, lambda a: F.concat(F.array(F.lit(0)), F.flatten(a["pages"]), a["now"]))
    d = docs.select("doc_id", sizes.alias("sizes")).where(F.size("sizes") > 0)
    d = d.select("doc_id", "sizes", first.alias("first"))
    ends = F.concat(F.slice("first", F.lit(2), F.size("first")), F.array(F.size("sizes")))
    d = d.select("doc_id", F.posexplode(F.zip_with("first", ends, lambda a, z: F.struct(a.alias("a"), (z - a).alias("k"), F.slice("sizes", a + 1, z - a).alias("sizes")))).alias("chunk", "c"))
    total = F.aggregate("c.sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select("doc_id", "chunk", total.alias("words"), F.col("c.k").cast("long").alias("sentences"))


def round_robin(lines: DataFrame, speakers: int = 2) -> DataFrame:
    """T5: lines of a text in turn to the speakers; empty lines do not count."""
    own = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return lines.select("doc_id", F.posexplode(own).alias("line", "content")).select("doc_id", "line", F.concat(F.lit("Speaker "), (F.col("line") % speakers + 1).cast("string")).alias("speaker"), F.length("content").alias("chars"))


#: From which confidence a likely header is named, and from which it is taken.
CONSIDER, ACCEPT = 0.55, 0.85


def plain_header(c: Column) -> Column:
    """Small letters without diacritics; marks that join words are blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(strip_diacritics(F.lower(F.trim(c)), fold_l=True), r"[_.\-/]+", " "), r"\s+", " "))


def block_ratio(a: Column, b: Column) -> Column:
    """Twice the characters in matching blocks over both lengths: the longest common block, then in the
    same way what is left of it and what is right of it. For distinct pairs of headers, which are few."""

    def ratios(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(left, right)])

    return F.pandas_udf(ratios, "double")(a, b)


def header_confidence(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (name, header) with their confidence: 1 if equal in plain form; if one contains the
    other, half and two fifths of their lengths' share; or the ratio of matching blocks, if that is more."""
    p = pairs.select("name", "header").distinct().withColumns({"a": plain_header("name"), "b": plain_header("header")}).where("a <> '' and b <> ''")
    share = F.least(F.length("a"), F.length("b")) / F.greatest(F.length("a"), F.length("b"))
    inside = F.when(F.col("a") == F.col("b"), 1.0).when(F.col("a").contains(F.col("b")) | F.col("b").contains(F.col("a")), 0.5 + share * 0.4).otherwise(0.0)
    return p.select("name", "header", F.greatest(inside, block_ratio("a", "b")).alias("confidence"))


def _assign(options: DataFrame) -> DataFrame:
    """Columns in order take the first of their options that none before has taken.

    options: file, ord, name_of, position, header, confidence; best first means the higher confidence, then
    the smaller position. A file's headers and a format's columns are some tens.
    """
    own = options.groupBy("file", "ord", "name_of").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "position", "header"))).alias("o"))
    todo = own.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("ord", "name_of", "o"))).alias("todo"))
    kind = "array<struct<name_of:string,position:int,header:string,confidence:double>>"

    def step(a, x):
        free = F.try_element_at(F.filter(x["o"], lambda o: ~F.array_contains(F.transform(a, lambda t: t["position"]), o["position"])), F.lit(1))
        taken = F.array(F.struct(x["name_of"].alias("name_of"), free["position"].alias("position"), free["header"].alias("header"), (-free["c"]).alias("confidence")))
        return F.when(free.isNull(), a).otherwise(F.concat(a, taken.cast(kind)))

    done = todo.select("file", F.explode(F.aggregate("todo", F.array().cast(kind), step)).alias("t"))
    return done.select("file", "t.*")


def header_matches(headers: DataFrame, expected: DataFrame, consider: float = CONSIDER) -> DataFrame:
    """(file, format, name_of, header, position, how, confidence): which header each expected column is.

    headers: file, format, position, header. expected: format, ord, name_of, names (array), patterns
    (array), required. Three stages, each for what the one before has left: a header equal to one of the
    names (case aside; the first name that is there); the first free header that fits one of the
    patterns; the free header of most confidence, from ``consider`` on (how = fuzzy).
    """
    text = F.lower(F.trim("header"))
    h = headers.select("file", "format", F.col("position").cast("int").alias("position"), "header", text.alias("text"))
    e = expected.select("format", "ord", "name_of", "names", "patterns")
    files = h.select("file", "format").distinct()
    names = e.select("format", "name_of", F.posexplode("names").alias("at", "n")).select("format", "name_of", "at", F.lower("n").alias("text"))
    equal = h.join(names, ["format", "text"]).groupBy("file", "name_of").agg(F.min(F.struct("at", "position", "header")).alias("b"))
    found = equal.select("file", "name_of", "b.position", "b.header", F.lit(1.0).alias("confidence"), F.lit("exact").alias("how"))
    for stage in ("pattern", "fuzzy"):
        open_ = files.join(e, "format").join(found.select("file", "name_of"), ["file", "name_of"], "left_anti")
        free = h.where("text <> ''").join(found.select("file", "position"), ["file", "position"], "left_anti").drop("format")
        pairs = open_.join(free, "file")
        if stage == "pattern":
            fits = F.exists("patterns", lambda p: F.rlike("text", F.concat(F.lit("(?i)"), p)))
            options = pairs.where(fits).select("file", "ord", "name_of", "position", "header", F.lit(1.0).alias("confidence"))
        else:
            by_name = pairs.select("file", "ord", "name_of", "position", "header", F.explode("names").alias("name"))
            sure = by_name.join(header_confidence(by_name), ["name", "header"]).groupBy("file", "ord", "name_of", "position", "header").agg(F.max("confidence").alias("confidence"))
            options = sure.where(F.col("confidence") >= consider)
        found = found.unionByName(_assign(options).withColumn("how", F.lit(stage)))
    return files.join(found, "file").select("file", "format", "name_of", "header", "position", "how", F.round("confidence", 4).alias("confidence"))


def drift_levels(matches: DataFrame, headers: DataFrame, expected: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """Each file's level. exact: all required columns without a likely match; drift: all, some by likely
    matches taken (from ``accept`` on); partial: some; failed: none, or a format without columns.

    With it the confidence (1, the likely ones' mean, or the share of required columns), missing required
    columns, and headers that no column has.
    """
    wanted = expected.groupBy("format").agg(F.count_if("required").alias("wanted"))
    files = headers.where(F.trim("header") != "").groupBy("file", "format").agg(F.count("*").alias("headers"))
    taken = (F.col("how") != "fuzzy") | (F.col("confidence") >= accept)
    m = matches.join(expected.select("format", "name_of", "required"), ["format", "name_of"])
    g = m.groupBy("file", "format").agg(
        F.count_if(taken & F.col("required")).alias("found"), F.count_if(F.col("how") == "fuzzy").alias("likely"),
        F.avg(F.when(F.col("how") == "fuzzy", F.col("confidence"))).alias("mean"), F.countDistinct(F.when(taken, F.col("position"))).alias("used"))
    z = lambda c: F.coalesce(c, F.lit(0))
    out = files.join(wanted, "format", "left").join(g, ["file", "format"], "left")
    missing = z("wanted") - z("found")
    level = F.when(F.col("wanted").isNull(), "failed").when((missing == 0) & (z("likely") == 0), "exact").when(missing == 0, "drift").when(z("found") > 0, "partial").otherwise("failed")
    sure = F.when(level == "exact", 1.0).when(level == "drift", F.col("mean")).when(level == "partial", F.col("found") / F.col("wanted")).otherwise(0.0)
    return out.select("file", "format", level.alias("level"), F.round(sure, 4).alias("confidence"), missing.alias("missing"), (F.col("headers") - z("used")).alias("extra"))


def page_of(log: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page of a filtered log."""
    return log.orderBy(*order).offset(page * size).limit(size)


def latest_number(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("rn = 1").drop("rn")
