"""Operator 3: nearest neighbours by an adaptive scan over dimensions.

Vectors are searched for the largest inner product. One more component, the root of M^2 - |x|^2
(M: the largest norm), makes that a search for the smallest distance. A random rotation spreads
what a vector holds evenly over all components, so that the squared distance over the first d of
D components, times D/d, estimates the whole; its error falls with d.

* Index: centroids of a bounded sample (``SAMPLE`` rows, ``lists`` centroids); every row goes to
  its nearest centroid's list. Lists are cut into blocks of about ``BLOCK`` rows by a hash of the
  id, so a list with a third of all rows is many tasks' work.
* Search: a query probes its nearest lists, as many as hold 97 % of the true neighbours in the
  sample, where both are known. Each (list, block) is one task that holds the
  block's vectors by columns. Blocks of ``STEP`` columns are added to the partial distances; after
  each, the hypothesis "nearer than the twentieth so far" is rejected, and the candidate abandoned,
  where the estimate exceeds the twentieth by the factor (1 + EPSILON / sqrt(d))^2.
* What survives is measured on the original vectors in double precision, one component after
  another, so equal vectors get equal scores; ties go to the smaller vec_id.

Defined results: vectors that are null, zero, of another length than the sample's most common one,
or hold null or non-finite components take no part; fewer candidates than k are all returned; of
the different vectors that rows of one vec_id have, the smallest by its components is the one; an
empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, pick, ship, stash

SAMPLE, BLOCK, STEP, EPSILON = 20_000, 4096, 16, 2.1
QUERIES, CHUNK, PARTS = 512, 256, 8
#: Share of the true neighbours that the probed lists are to hold, and queries it is measured on.
RECALL, TRIED = 0.97, 256
#: Lists: one for each ROWS rows, at most this many (their centroids are broadcast: 8 MB at 256
#: components).
ROWS, MOST_LISTS = 1024, 4096


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>): rows that take part."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    return own.where(finite & F.exists("v", lambda x: x != 0))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = _near(x, c, 1)[:, 0]
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def _near(x: np.ndarray, c: np.ndarray, p: int) -> np.ndarray:
    """Numbers of the p nearest centroids, nearest first, in blocks of rows."""
    out = []
    for i in range(0, len(x), 1024):
        d = (c * c).sum(1)[None, :] - 2 * x[i : i + 1024] @ c.T
        part = np.argpartition(d, min(p, len(c)) - 1, axis=1)[:, :p]
        out.append(np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), 1, kind="stable"), 1))
    return np.concatenate(out) if out else np.empty((0, p), np.int64)


class Index:
    """Rotation, norm bound and centroids: of a size that does not grow with the rows."""

    def __init__(self, sample: np.ndarray, norm: float, lists: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.dim, self.norm = sample.shape[1], norm
        self.rotation = np.linalg.qr(rng.standard_normal((self.dim + 1, self.dim + 1)))[0]
        self.centroids = _kmeans(self.rows(sample), min(lists, len(sample)), rng)

        self.probes = self._probes(sample, rng)

    def _probes(self, sample: np.ndarray, rng: np.random.Generator, k: int = 20) -> int:
        """How many lists hold RECALL of the sample's own true neighbours, by brute force."""
        x = sample[rng.permutation(len(sample))[:TRIED]]
        lists = _near(self.rows(sample), self.centroids, 1)[:, 0]
        order = _near(self.queries(x), self.centroids, len(self.centroids))
        place = np.argsort(order, axis=1)
        k = min(k + 1, len(sample))
        true = np.argpartition(-(x @ sample.T), k - 1, axis=1)[:, :k]
        need = np.take_along_axis(place, lists[true], 1) + 1
        return int(np.quantile(need, RECALL, method="higher"))

    def rows(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.norm**2 - (x * x).sum(1)))
        return np.concatenate([x, rest[:, None]], 1) @ self.rotation.T

    def queries(self, q: np.ndarray) -> np.ndarray:
        """Scaled to the norm bound: the order of the distances does not depend on it."""
        q = q * (self.norm / np.sqrt((q * q).sum(1)))[:, None]
        return np.concatenate([q, np.zeros((len(q), 1))], 1) @ self.rotation.T


def fit(vectors: DataFrame, lists: int | None = None) -> Index | None:
    """``vectors``: as ``usable`` returns. One pass for the size and norm, one for the sample."""
    size = F.size("v")
    n2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    stats = {r["d"]: r for r in vectors.groupBy(size.alias("d")).agg(F.count("*").alias("n"), F.max(n2).alias("m")).collect()}
    if not stats:
        return None
    d = max(stats, key=lambda k: (stats[k]["n"], -k))
    n = stats[d]["n"]
    draw = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1_000_000)) / 1e6
    rows = vectors.where((size == d) & (draw < min(1.0, SAMPLE / n))).select("v").toArrow().column(0)
    if not len(rows):
        rows = vectors.where(size == d).limit(1).select("v").toArrow().column(0)
    x = np.array(rows.to_pylist(), np.float64)
    return Index(x, math.sqrt(stats[d]["m"]) * (1 + 1e-9), lists or min(MOST_LISTS, max(1, n // ROWS)))


def scan(ids: np.ndarray, columns: np.ndarray, q: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that the adaptive scan keeps, k for each query at least, if there
    are. columns: a row for each component; q: a row for each query; own: the queries' ids."""
    dim, n = columns.shape
    near = np.full((len(q), k), np.inf)  # each query's nearest so far
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, n, CHUNK):
        x, bound = columns[:, a : a + CHUNK], near[:, -1]
        z = min(STEP, dim)
        dist = _squares(q[:, :z], x[:z])
        i, j = np.nonzero(_may(dist, z, dim, bound[:, None]) & (own[:, None] != ids[None, a : a + CHUNK]))
        dist = dist[i, j]
        while z < dim and len(i):
            for c in range(z, min(dim, z + STEP)):
                dist += (x[c, j] - q[i, c]) ** 2
            z = min(dim, z + STEP)
            keep = _may(dist, z, dim, bound[i])
            i, j, dist = i[keep], j[keep], dist[keep]
        full = np.full((len(q), x.shape[1]), np.inf)
        full[i, j] = dist
        near = np.sort(np.concatenate([near, full], 1), axis=1)[:, :k]
        kept.append((i, a + j, dist))
    i, j, dist = (np.concatenate(c) for c in zip(*kept))
    last = dist <= near[i, -1] * (1 + 1e-9) + 1e-12  # equal distances stay, whatever rounding did
    return i[last], j[last]


def _may(dist: np.ndarray, z: int, dim: int, bound: np.ndarray) -> np.ndarray:
    """The hypothesis "nearer than the bound" stands, from the first z components."""
    return dist * (dim / z) <= bound * ((1 + EPSILON / math.sqrt(z)) ** 2 if z < dim else 1 + 1e-9) + 1e-12


def _squares(q: np.ndarray, columns: np.ndarray) -> np.ndarray:
    return (q * q).sum(1)[:, None] + (columns * columns).sum(0)[None, :] - 2 * q @ columns


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, component by component: equal rows get equal
    scores wherever they stand."""
    out = np.zeros(len(x))
    for c in range(x.shape[1]):
        out += x[:, c] * q[:, c]
    return out


def best(i: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The places of each query's k best, ties to the smaller id."""
    order = np.lexsort((ids, -score, i))
    first = np.flatnonzero(np.concatenate([[True], i[order][1:] != i[order][:-1]])) if len(order) else np.empty(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.concatenate([first, [len(order)]])))
    return order[rank < k]


FOUND = "query_id long, part int, ids array<long>, scores array<double>"


def _single(rows: DataFrame) -> DataFrame:
    """One row for each vec_id. Only ids are shuffled, but for those that several rows have."""
    several = stash(rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"), "several")
    if not several.limit(1).count():
        return rows
    few = rows.join(several, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("v", *(c for c in rows.columns if c not in ("vec_id", "v")))).alias("m"))
    return pick(rows, several, "left_anti", "vec_id").unionByName(few.select("vec_id", "m.*"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, probes: int | None = None, lists: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for each row of ``queries``, against all of ``vectors``."""
    spark = vectors.sparkSession
    ship(spark)
    own, asked = usable(vectors), usable(queries)
    index = fit(own, lists)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    probes = min(len(index.centroids), probes or index.probes)
    share, d = spark.sparkContext.broadcast(index), index.dim

    def place(batches):
        for p in batches:
            x = np.array(p["v"].tolist(), np.float64).reshape(len(p), d)
            yield p.assign(list=_near(share.value.rows(x), share.value.centroids, 1)[:, 0])

    def probe(batches):
        for p in batches:
            x = np.array(p["v"].tolist(), np.float64).reshape(len(p), d)
            near = _near(share.value.queries(x), share.value.centroids, probes)
            yield p.assign(lists=[r.tolist() for r in near])

    one = own.where(F.size("v") == d).mapInPandas(place, "vec_id long, v array<double>, list int")
    one = _single(stash(one, "lists"))
    sizes = F.broadcast(one.groupBy("list").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks")))  # a row for each centroid
    cut = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    held = one.join(sizes, "list").select("list", cut.alias("block"), "vec_id", "v")
    ask = _single(asked.where(F.size("v") == d)).mapInPandas(probe, "vec_id long, v array<double>, lists array<int>")
    ask = ask.select("vec_id", "v", F.explode("lists").alias("list")).join(sizes, "list")
    ask = ask.select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "vec_id", "v")
    # A block's queries are dealt out as its rows are: one task has a bounded share of both.
    load = stash(ask.groupBy("list", "block").agg(F.ceil(F.count("*") / F.lit(QUERIES)).cast("int").alias("turns")), "load")
    if load.count() <= BROADCAST_IDS:
        load = F.broadcast(load)
    turn = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("turns")).cast("int")
    ask = ask.join(load, ["list", "block"]).select("list", "block", turn.alias("turn"), "vec_id", "v")
    held = held.join(load, ["list", "block"]).select("list", "block", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "vec_id", "v")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "part": [], "ids": [], "scores": []})
        if not len(left) or not len(right):
            return none
        ids, x = left["vec_id"].to_numpy(), np.array(left["v"].tolist(), np.float64)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        columns = np.ascontiguousarray(share.value.rows(x).T)
        q, asked_ids = np.array(right["v"].tolist(), np.float64), right["vec_id"].to_numpy()
        i, j = scan(ids, columns, share.value.queries(q), asked_ids, k)
        score = exact(x[j], q[i])
        keep = best(i, ids[j], score, k)
        if not len(keep):
            return none
        cut = np.flatnonzero(np.diff(i[keep])) + 1
        first = i[keep][np.concatenate([[0], cut])]
        return pd.DataFrame({"query_id": asked_ids[first], "part": int(left["list"].iloc[0]) % PARTS, "ids": np.split(ids[j[keep]], cut), "scores": np.split(score[keep], cut)})

    keys = ["list", "block", "turn"]
    found = held.groupBy(*keys).cogroup(ask.groupBy(*keys)).applyInPandas(search, FOUND)
    # A row for each query and task; the parts of a query are merged first.
    entries = F.transform(F.arrays_zip("scores", "ids"), lambda e: F.struct((-e["scores"]).alias("s"), e["ids"].alias("vec_id"), e["scores"].alias("score")))
    merged = lambda c: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), 1, k).alias("top")
    first = found.select("query_id", "part", entries.alias("top")).groupBy("query_id", "part").agg(merged("top"))
    top = first.groupBy("query_id").agg(merged("top"))
    return top.select("query_id", F.posexplode("top").alias("pos", "t")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "t.vec_id", "t.score")
