"""Whole-number inner products that operators 11 and 12 share.

Rows are read by name. Components x become floor(256 * x); rows whose vector is null, holds null or
non-finite components, or has another length than the most common one (the shorter of equally common
ones) take no part, nor do rows without an id; of the different rows of one vec_id, the smallest by its
components (then its label) is the one. Products are exact; beyond a long they stay at its ends.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ann import _single
from .common import stash

#: Queries that a job compares all rows with; rows and queries that are multiplied at once.
BATCH, BATCH_BYTES, ROWS, COLUMNS = 4096, 32 << 20, 1024, 512


def finite(vectors: DataFrame, *more: Column) -> DataFrame:
    """(vec_id, v array<double>, more): rows that take part, one for each id, as a written table."""
    v = F.col("embedding").cast("array<double>")
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), *more).where("vec_id is not null and v is not null")
    own = own.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    own = stash(own, "vectors")
    one = _single(own)
    return own if one is own else stash(one, "vectors")


def shape(vectors: DataFrame) -> tuple[int, float] | None:
    """The most common length and a bound of the norm of 256 * x, rounded down."""
    n2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    stats = {r["d"]: r for r in vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(n2).alias("m")).collect()}
    if not stats:
        return None
    d = max(stats, key=lambda k: (stats[k]["n"], -k))
    return d, 256 * stats[d]["m"] ** 0.5 + d**0.5 + 1


def batches(queries: DataFrame, dim: int):
    """Arrow tables of some ``BATCH`` rows, dealt by a hash of the id, of at most a few BATCH_BYTES."""
    most = max(64, min(BATCH, BATCH_BYTES // (8 * max(dim, 1))))
    n = -(-queries.count() // most)
    for b in range(n):
        part = queries.where(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(n)) == b).toArrow()
        if part.num_rows:
            yield part.sort_by("vec_id")


def matrix(column, n: int, dim: int) -> np.ndarray:
    """Rows of an Arrow column of lists, as whole numbers."""
    values = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    x = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, dim)
    return np.floor(np.clip(x, -1e300, 1e300) * 256)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A row for each of x, a column for each of q: floats up to 2^53, longs up to 2^62, else whole
    numbers of any size that end at a long's ends."""
    top = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1]
    if top < 2**53:
        return (x @ q.T).astype(np.int64)
    if top < 2**62:
        return x.astype(np.int64) @ q.T.astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    big = np.dot(whole(x), whole(q.T))
    return np.minimum(np.maximum(big, -(2**63)), 2**63 - 1).astype(np.int64)


def chunks(arrow_batches, dim: int):
    """(ids, rows, batch's further columns) of at most ROWS rows."""
    for b in arrow_batches:
        for a in range(0, b.num_rows, ROWS):
            part = b.slice(a, ROWS)
            yield part.column(0).to_numpy(), matrix(part.column(1), part.num_rows, dim), part.columns[2:]


def own_rows(ids: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the queries' own rows; ``queries`` are sorted."""
    at = np.searchsorted(queries, ids)
    hit = np.flatnonzero(at < len(queries))
    hit = hit[queries[at[hit]] == ids[hit]]
    return hit, at[hit]


class Best:
    """The k best of each of n places so far: higher scores first, ties to smaller ids."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, np.iinfo(np.int64).min)
        self.at, self.ids, self.scores = (np.empty(0, np.int64) for _ in range(3))

    def add(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(at):
            return
        at, ids, scores = np.concatenate([self.at, at]), np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, ~scores, at))  # ~s falls as s rises and never overflows
        at, ids, scores = at[order], ids[order], scores[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        rank = np.arange(len(at)) - np.repeat(first, np.diff(np.concatenate([first, [len(at)]])))
        keep = rank < self.k
        self.at, self.ids, self.scores = at[keep], ids[keep], scores[keep]
        full = rank == self.k - 1
        self.least[at[full]] = scores[full]

    def groups(self):
        """(places, lists of ids, lists of scores), best first."""
        cut = np.flatnonzero(np.diff(self.at)) + 1
        first = self.at[np.concatenate([[0], cut])] if len(self.at) else self.at
        return first, np.split(self.ids, cut), np.split(self.scores, cut)
