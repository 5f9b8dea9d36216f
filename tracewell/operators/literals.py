"""An index of regular expressions by the literals that their matches must contain.

For thousands of patterns against any number of texts: a text's pieces of three characters are
looked up in the index (an equi-join), and only what is found is tried with its pattern.
"""

from __future__ import annotations

import re._parser as parser
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 3
#: Rows of the index up to which it is broadcast (some 100 bytes each); beyond, Spark decides.
BROADCAST = 200_000


def necessary(pattern: str) -> list[str] | None:
    """Literals of which every match (case aside) contains at least one, each of PIECE characters or
    more; None where there are no such, or the pattern is in a dialect that cannot be read here."""
    try:
        found = _sets(parser.parse(pattern))
    except (parser.error, OverflowError, RecursionError):
        return None
    good = [s for s in found if min(map(len, s)) >= PIECE]
    return sorted(max(good, key=lambda s: (min(map(len, s)), -len(s)))) if good else None


def _sets(items) -> list[set[str]]:
    """Sets of literals, each such that every match of the sequence contains one of the set."""
    out, run = [], ""

    def flush():
        nonlocal run
        if run:
            out.append({run})
        run = ""

    for kind, value in items:
        if kind is parser.LITERAL:
            run += chr(value).lower()
            continue
        flush()
        if kind is parser.SUBPATTERN:
            out += _sets(value[-1])
        elif kind in (parser.MAX_REPEAT, parser.MIN_REPEAT, parser.POSSESSIVE_REPEAT) and value[0] > 0:
            out += _sets(value[2])
        elif kind is parser.BRANCH:
            parts = [[s for s in _sets(p) if min(map(len, s)) >= PIECE] for p in value[1]]
            if all(parts):
                out.append(set().union(*(max(p, key=lambda s: min(map(len, s))) for p in parts)))
    flush()
    return out


def pieces(c: Column) -> Column:
    """The different pieces of PIECE characters of a text."""
    n = F.length(c) - PIECE + 1
    at = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    cut = F.array_distinct(F.transform(at, lambda i: F.substr(c, i, F.lit(PIECE))))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))


def matches(rows: DataFrame, key: str, texts: list[str], patterns: list[str], exact: bool = False) -> DataFrame:
    """(key, number): rows and the numbers of the patterns (their places in the list) that one of the texts
    has; once each. texts: columns without nulls, in lower case and compared without case, unless ``exact``."""
    flag = "" if exact else "(?i)"
    spark = rows.sparkSession
    literals = {i: necessary(p) for i, p in enumerate(patterns)}
    cut = lambda s: {s[k : k + PIECE] for k in range(len(s) - PIECE + 1)}
    shared = Counter(p for found in literals.values() if found for s in found for p in cut(s))
    index = [(min(cut(s), key=lambda p: (shared[p], p)), s, i, f"{flag}{patterns[i]}") for i, found in literals.items() if found for s in found]
    loose = [i for i, found in literals.items() if not found]
    texts_ = [F.col(t) for t in texts]
    low = [F.lower(t) for t in texts_] if exact else texts_
    has = lambda p: _any(F.rlike(t, p) for t in texts_)
    none = spark.createDataFrame([], f"{key} {dict(rows.dtypes)[key]}, number int")
    out = none
    if index:
        table = spark.createDataFrame(index, "piece string, literal string, number int, pattern string")
        table = F.broadcast(table) if len(index) <= BROADCAST else table
        own = F.array_distinct(F.concat(*map(pieces, low)))
        near = rows.select(key, *texts, F.explode(own).alias("piece")).join(table, "piece")
        near = near.where(_any(t.contains(F.col("literal")) for t in low)).where(has(F.col("pattern")))
        out = near.select(key, "number").distinct()
    if loose:
        # One row holds them all. Only rows that one alternation of all fits are tried with each.
        one = spark.createDataFrame([([(i, f"{flag}{patterns[i]}") for i in loose],)], "tried array<struct<number:int,pattern:string>>")
        any_of = F.lit(flag + "|".join(f"(?:{p})" for p in dict.fromkeys(patterns[i] for i in loose)))
        own = rows.select(key, *texts).where(has(any_of)).crossJoin(F.broadcast(one))
        own = own.select(key, *texts, F.explode("tried").alias("p")).where(has(F.col("p.pattern"))).select(key, "p.number").distinct()
        out = out.unionByName(own) if index else own
    return out


def _any(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out | c
    return out
