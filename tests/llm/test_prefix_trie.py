"""Operator 13 against a plain reading, with odd rows, long chains and conversations of many blocks."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tracewell.llm import prefix_trie as P
from tracewell.llm.common import remainder

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows, every=100, heads=6):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % heads
        built[c] = tuple(turns.get(c - int(math.fmod(c, every)), [])[:h] + v[h:])
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    for p, m in members.items():
        ids = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out[min(m), len(p)] = (min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ids.encode()).hexdigest())
    return out


def trie(spark, rows, parts=3):
    names = ["place", "digest", "n", "base", "depth", "k0", "kind", "leaves", "last", "chars"]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *(f"'z' AS {c}" for c in names)).repartition(parts)
    got = P.prefix_trie(*P.respliced(P.turns_of(df), remainder("conv_id", 6), 100))
    return {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in got.collect()}


def test_like_a_plain_reading(spark):
    rng = random.Random(6)
    rows = []
    for c in [*range(40), *range(100, 130), 250, 399, 10**15 + 7, -5, -250]:
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bé", "", "c😀"])) for t in range(rng.randint(1, 8))]
    rows += [(300, None, None, None), (300, 1, None, "x"), (300, 1, None, "x"), (301, 5, "user", "y" * 5000), (None, 1, "user", "lost"), (302, None, "b", "2"), (302, None, "a", "1")]
    assert trie(spark, rows) == plain(rows)


def test_copies_chains_and_blocks(spark, monkeypatch):
    """Many members at one node, a conversation of many blocks, a chain with side branches, which all
    need rounds of both kinds."""
    monkeypatch.setattr(P, "BLOCK", 16)
    monkeypatch.setattr(P, "RUN_BITS", 3)
    rows = [(c, t, "user", f"same {t}") for c in range(700, 760) for t in range(3)]
    rows += [(5000 + k, t, "user", f"long {t}") for k in range(3) for t in range(120 if k == 0 else 30 + 20 * k)]
    rows += [(6000 + 100 * k, t, "user", f"stem {t}" if t < 3 * k else f"side {k}") for k in range(1, 20) for t in range(3 * k + 1)]
    assert trie(spark, rows, 5) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "a", "b")], [(1, 0, None, None)], [(77, 0, "u", "only turn, cut away or not")]])
def test_few_rows(spark, rows):
    assert trie(spark, rows, 1) == plain(rows)


def test_numbers_go_on_through_parts(spark):
    """One conversation's turns are cut into several parts and numbered without a gap."""
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(1).alias("conv_id"), (F.col("id") * 7919 % 5000).alias("turn"), F.lit("u").alias("role"), F.col("id").cast("string").alias("text"))
    got = defaultdict(list)
    turns = P.turns_of(df)
    for r in turns.collect():
        got[r["conv_id"]].append(r["place"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in got.values()) and len(got[1]) > 3000
