import random

import numpy as np
from pyspark.sql import functions as F

from tracewell.llm import near_dups
from tracewell.llm.near_dups import near_duplicates, words_of


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = words_of(t.encode() if t is not None else None)
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def corpus(n=240, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    base = [[word() for _ in range(rng.randint(20, 90))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 8])):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w).upper() if i % 7 == 0 else "  ".join(w)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "x" * 200_000)]


def test_like_brute_force(spark):
    rows = corpus()
    for k in (2, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("sig", F.lit(2)).repartition(5)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df, k, 80).collect()}
        assert got == brute(rows, k, 80)


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, None)], "doc_id long, text string")
    got = sorted(near_duplicates(df, 2).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    assert [(r["doc_id"], r["component_id"], r["kept"]) for r in got[:3]] == [(1, 1, True), (1, 1, True), (2, 1, False)]
    assert near_duplicates(df.limit(0), 2).count() == 0


def test_short_pairs_pass_the_screens():
    """Pairs at similarity 0.8 exactly, of few shingles: (of one, of the other, of both)."""
    rng = np.random.default_rng(1)
    for a, b, both in ((5, 4, 4), (10, 8, 8), (9, 9, 8)):
        for _ in range(300):
            h = rng.integers(0, 2**63, a + b - both, dtype=np.uint64)
            for which, lanes, slack in ((near_dups._REST, near_dups.WIDE, near_dups.WIDE_SLACK), (near_dups._BANDED, near_dups.HASHES, near_dups.SLACK)):
                x, y = (near_dups.packed(near_dups.minima(np.sort(s), which)).view(np.uint64) for s in (h[:a], np.concatenate([h[:both], h[a:]])))
                d = x ^ y
                differ = int(np.bitwise_count((d | (d >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum())
                assert (1 - differ / lanes - 0.25) / 0.75 >= 0.8 - slack


def test_crowded_short_texts_like_brute_force(spark):
    rng = random.Random(14)
    rows = []
    for _ in range(25):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(9)) for _ in range(rng.randint(5, 15))]
        for _ in range(40):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                i = rng.randrange(len(w))
                w[i : i + 1] = rng.choice([[], [w[i], "z"], [rng.choice("xyz")]])
            rows.append((rng.randrange(10**9), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df, 2, 80).collect()}
    assert got == brute(rows, 2, 80)


def test_buckets_larger_than_a_block_like_brute_force(spark, monkeypatch):
    """Blocks of 16 rows: hot buckets are salted, their rows cut into blocks of the main component and
    of others, hubs of the components joined without a shuffle of their rows."""
    monkeypatch.setattr(near_dups, "BLOCK", 16)
    rng = random.Random(21)
    shared = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(260):
        w = list(shared)
        for _ in range(rng.choice([1, 1, 2, 6, 7])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df, 2, 80).collect()}
    assert got == brute(rows, 2, 80)


def test_components_of_stars_and_chains(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", 8)
    edges = [(1, i) for i in range(2, 60)] + [(i, i + 1) for i in range(100, 140)] + [(59, 100)] + [(200, 201), (202, 201), (200, 201)]
    got = {r["node"]: r["label"] for r in near_dups.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in [*range(1, 60), *range(100, 141)]} | {i: 200 for i in (200, 201, 202)}


def test_one_id_with_two_texts(spark):
    rows = [(5, "a b c d e"), (5, "k l m n o"), (1, "a b c d e"), (3, "k l m n o"), (9, "k l m n o"), (7, "q r s")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(df, 2).collect())
    assert got == [(1, 1, True), (3, 1, False), (5, 1, False), (5, 1, False), (7, 7, True), (9, 1, False)]
