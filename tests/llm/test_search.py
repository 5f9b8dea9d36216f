"""Operators 11 and 12 against brute force, with ties, odd rows and scores of any size."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import negatives, scores, top_k

SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(rows):
    out = {}
    for i, v, lab in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        key = (list(v), lab if lab is not None else -1)
        if i not in out or key < out[i][0]:
            out[i] = (key, [math.floor(256 * x) for x in v], lab)
    dim = max(set(sizes := [len(q) for _, q, _ in out.values()]), key=lambda d: (sizes.count(d), -d), default=0)
    return {i: (q, lab) for i, (_, q, lab) in out.items() if len(q) == dim}


def product(a, b):
    return min(max(sum(x * y for x, y in zip(a, b)), -(2**63)), 2**63 - 1)


def brute_top(rows, every, k):
    own, out = usable(rows), {}
    for q in (i for i in own if i % every == 0):
        best = sorted((-product(own[q][0], v), i) for i, (v, _) in own.items() if i != q)[:k]
        out |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(best)}
    return out


def brute_negatives(rows, every, k=5):
    own, out = {i: x for i, x in usable([r for r in rows if r[2] is not None]).items()}, set()
    for a in (i for i in own if i % every == 0):
        order = sorted((-product(own[a][0], v), i, lab) for i, (v, lab) in own.items() if i != a)
        for ps, p, lab in [x for x in order if x[2] == own[a][1]][:k]:
            found = [(s, n) for s, n, other in order if other != own[a][1] and 80 * -ps <= 100 * -s <= 100 * -ps][:k]
            out |= {(a, p, r + 1, n, -ps, -s) for r, (s, n) in enumerate(found)}
    return out


def some_rows(rng, n, dim, steps=None):
    value = (lambda: rng.choice(steps)) if steps else (lambda: rng.uniform(-0.4, 0.5))
    return [(i, [value() for _ in range(dim)], rng.randrange(3)) for i in range(n)]


def odd_rows(dim):
    flat = [0.25] * dim
    return [
        (None, flat, 1), (5000, None, 1), (5010, [None] * dim, 1), (5020, [float("nan")] * dim, 1), (5030, [float("inf")] * dim, 1), (5040, flat[:-1], 1),
        (5050, [0.0] * dim, 1), (5060, flat, None), (5070, flat, 2), (5070, flat, 2), (5080, flat, 0), (5080, [0.1] * dim, 1),
    ]


def frame(spark, rows, parts=4):
    names = ["score", "rank", "v", "query_id", "part", "asked", "ids", "kind", "at", "need"]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", *(f"'z' AS {c}" for c in names)).repartition(parts)


def as_singles(rows):
    """Components as a column of floats holds them."""
    single = lambda x: x if x is None else float(np.float32(x))
    return [(i, v if v is None else [single(x) for x in v], lab) for i, v, lab in rows]


@pytest.mark.parametrize("steps", [None, [0.0, 0.25]])
def test_top_k_like_brute_force(spark, monkeypatch, steps):
    rng = random.Random(3)
    rows = as_singles(some_rows(rng, 300, 6, steps) + odd_rows(6))
    monkeypatch.setattr(top_k, "BITS", 3)  # several rounds
    monkeypatch.setattr(scores, "BATCH", 16)
    df = frame(spark, rows)
    got = top_k.top_k(df, df.where("vec_id % 5 = 0"), 4)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint"]
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got.collect()} == brute_top(rows, 5, 4)


def test_top_k_of_equal_vectors_few_rows_and_none(spark):
    rows = [(i, [0.5, 0.5], 0) for i in range(400)] + [(400, [0.6, 0.5], 0)]
    df = frame(spark, as_singles(rows), 7)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in top_k.top_k(df, df.where("vec_id = 100"), 3).collect()}
    assert got == {(100, 1): 400, (100, 2): 0, (100, 3): 1}
    few = top_k.top_k(df.where("vec_id < 3"), df.where("vec_id = 0"), 5).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(few, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]
    one = df.where("vec_id = 0")
    assert top_k.top_k(one, one, 5).count() == 0
    assert top_k.top_k(df.limit(0), df.limit(0), 5).count() == 0


@pytest.mark.parametrize("size", [3e6, 3e9, 3e25])
def test_top_k_of_large_components(spark, size):
    """Beyond what doubles hold exactly, and beyond a long, where scores end at its ends."""
    rng = random.Random(int(size) % 97)
    rows = as_singles([(i, [rng.uniform(-size, size) for _ in range(3)], 0) for i in range(60)])
    df = frame(spark, rows)
    got = top_k.top_k(df, df.where("vec_id % 10 = 0"), 5)
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got.collect()} == brute_top(rows, 10, 5)


@pytest.mark.parametrize("steps", [None, [0.0, 0.25], [-0.5, 0.25]])
def test_negatives_like_brute_force(spark, monkeypatch, steps):
    rng = random.Random(4)
    rows = as_singles(some_rows(rng, 260, 5, steps) + odd_rows(5))
    monkeypatch.setattr(scores, "BATCH", 16)
    got = negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0)
    assert {tuple(r) for r in got.collect()} == brute_negatives(rows, 10)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_negatives_of_one_large_label_and_none(spark):
    rows = as_singles([(i, [0.5, 0.01 * (i % 7)], int(i % 9 == 0)) for i in range(500)])
    got = {tuple(r) for r in negatives.hard_negatives(frame(spark, rows, 9), F.col("vec_id") % 100 == 0).collect()}
    assert got == brute_negatives(rows, 100)
    df = frame(spark, rows)
    assert negatives.hard_negatives(df.limit(0), F.lit(True)).count() == 0
    assert negatives.hard_negatives(df, F.lit(False)).count() == 0
    assert negatives.hard_negatives(df.withColumn("label", F.lit(None).cast("int")), F.lit(True)).count() == 0


def test_keys_sort_as_wanted():
    rng = random.Random(5)
    ends = [-(2**63), 2**63 - 1, 0, -1, 1, *(rng.randint(-(2**63), 2**63 - 1) for _ in range(20))]
    keys = [(rng.choice(ends), rng.choice(ends), rng.randrange(2), rng.choice(ends)) for _ in range(500)]
    assert [negatives.unpack(negatives.pack(*k)) for k in keys] == keys
    assert sorted(keys, key=lambda k: (k[0], -k[1], k[2], k[3])) == [negatives.unpack(b) for b in sorted(negatives.pack(*k) for k in keys)]


def test_the_iterator_holds_open_windows_only():
    """A negative as good as a positive but of a smaller id is in its window; a closed window stays so."""
    rows = [(7, 100, 0, 50), (7, 100, 1, 3), (7, 99, 1, 2), (7, 90, 0, 60), (7, 79, 1, 4), (7, 72, 1, 5), (7, 71, 1, 6), (8, 5, 1, 1)]
    got = defaultdict(list)
    for anchor, positive, rank, negative, _, _ in negatives.mine((negatives.pack(*r) for r in rows), 5, 80, 100):
        got[anchor, positive].append((rank, negative))
    assert got == {(7, 50): [(1, 3), (2, 2)], (7, 60): [(1, 4), (2, 5)]}
