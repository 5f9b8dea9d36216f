"""Operator 12: exact top-k search by distributed histogram selection.

Queries are broadcast in batches of a bounded size; rows are never shuffled. Each batch:

* Every row is scored against every query of the batch, in blocks. Each task counts scores in 2^BITS
  bins of each query's range (at first what Cauchy and Schwarz allow) and gives the counts of the bins
  from above until k scores are counted: what lies below cannot hold the kth.
* The counts are summed over all tasks; the bin that holds the kth score is the query's next range, and
  the scores above it are taken off k. Rounds go on until a bin is one value: the kth score itself.
* A last pass keeps the scores that reach it. Of ties at the kth score, however many, a task keeps the
  k smallest ids; so do the merges.

Defined results: see ``scores``; queries that take no part have no rows; fewer candidates than k are
all returned; the zero vector takes part; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, ship
from .scores import COLUMNS, Best, batches, chunks, finite, matrix, own_rows, products, shape

BITS = 10
COUNTS = "at int, need long, bins array<int>, counts array<long>"
FOUND = "query_id long, part int, ids array<long>, scores array<long>"
RESULT = "query_id long, rank int, vec_id long, score long"


class Ranges:
    """Each query's range of scores [low, low + 2^bits), and how many of the best are to be found in it."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, norm: float):
        bound = max((float(np.sqrt((r * r).sum())) for r in q), default=0.0) * norm
        self.ids, self.q, self.bits, self.step = ids, q, 64, BITS
        while self.bits > 1 and 2.0 ** (self.bits - 2) > bound:
            self.bits -= 1
        self.low = np.full(len(ids), -(2 ** (self.bits - 1)), np.int64)
        self.need = np.full(len(ids), k, np.int64)
        self.found = np.ones(len(ids), bool)  # false: fewer candidates than k, all are returned

    def narrow(self, rows: list) -> None:
        """rows: (query's place, bin of its kth score, scores above that bin)."""
        shift = max(0, self.bits - self.step)
        self.found[:] = False
        for r in rows:
            self.low[r["at"]] = (int(self.low[r["at"]]) + (r["bin"] << shift) + 2**63) % 2**64 - 2**63
            self.need[r["at"]] -= r["above"]
            self.found[r["at"]] = True
        self.bits = shift
        self.low[~self.found] = -(2**63)


def histogram(ids: np.ndarray, x: np.ndarray, r: Ranges, counts: np.ndarray) -> None:
    """Adds the scores of rows to ``counts``, a line of bins for each query."""
    shift = np.uint64(max(0, r.bits - r.step))
    rows, cols = own_rows(ids, r.ids)
    for a in range(0, len(r.ids), COLUMNS):
        z = min(len(r.ids), a + COLUMNS)
        up = products(x, r.q[a:z]).view(np.uint64) - r.low[a:z].view(np.uint64)  # modulo 2^64: right for any range
        inside = up < np.uint64(1 << r.bits) if r.bits < 64 else np.ones(up.shape, bool)
        mine = (cols >= a) & (cols < z)
        inside[rows[mine], cols[mine] - a] = False
        inside &= r.found[a:z]
        place = (up >> shift).astype(np.int64) + counts.shape[1] * np.arange(z - a)
        counts[a:z] += np.bincount(place[inside], minlength=(z - a) * counts.shape[1]).reshape(z - a, -1)


def upper(counts: np.ndarray, need: np.ndarray) -> pa.RecordBatch:
    """The bins of each query from above until as many are counted as it needs."""
    total = counts[:, ::-1].cumsum(1)[:, ::-1]
    keep = (counts > 0) & (total - counts < need[:, None])
    at, bins = np.nonzero(keep)
    cut = np.flatnonzero(np.diff(at)) + 1
    first = at[np.concatenate([[0], cut])] if len(at) else at
    lists = [np.split(bins.astype(np.int32), cut), np.split(counts[keep].astype(np.int64), cut)]
    if not len(at):
        lists = [[], []]
    columns = [pa.array(first, pa.int32()), pa.array(need[first], pa.int64()), pa.array(lists[0], pa.list_(pa.int32())), pa.array(lists[1], pa.list_(pa.int64()))]
    return pa.record_batch(columns, names=["at", "need", "bins", "counts"])


def found_batch(query_ids: np.ndarray, best: Best, part: int) -> pa.RecordBatch:
    at, ids, scores = best.groups()
    if not len(at):
        ids, scores = [], []
    return pa.record_batch([pa.array(query_ids[at], pa.int64()), pa.array(np.full(len(at), part), pa.int32()), pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.int64()))], names=["query_id", "part", "ids", "scores"])


def merged(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) from tasks' lists, by parts of a query first."""
    entries = F.transform(F.arrays_zip("scores", "ids"), lambda e: F.struct(F.bitwise_not(e["scores"]).alias("s"), e["ids"].alias("vec_id"), e["scores"].alias("score")))
    top = lambda c: F.slice(F.array_sort(F.flatten(F.collect_list(c))), 1, k).alias("top")
    parts = found.select("query_id", "part", entries.alias("top")).groupBy("query_id", "part").agg(top("top"))
    one = parts.groupBy("query_id").agg(top("top"))
    return one.select("query_id", F.posexplode("top").alias("pos", "t")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "t.vec_id", "t.score")


def part_of_task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId() % 64


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest inner products of each row of ``queries``."""
    spark = vectors.sparkSession
    ship(spark)
    rows = finite(vectors)
    known = shape(rows)
    if known is None:
        return spark.createDataFrame([], RESULT)
    dim, norm = known
    rows, asked = rows.where(F.size("v") == dim), finite(queries).where(F.size("v") == dim)
    out = new_path(spark, "top")
    spark.createDataFrame([], RESULT).write.parquet(out)
    for batch in batches(asked, dim):
        r = Ranges(batch["vec_id"].to_numpy(), matrix(batch["v"], batch.num_rows, dim), k, norm)
        while r.bits:
            _narrow(rows, r, dim)
        share = spark.sparkContext.broadcast(r)

        def reach(arrow_batches, share=share):
            r = share.value
            best = Best(len(r.ids), k)
            for ids, x, _ in chunks(arrow_batches, dim):
                mine, own = own_rows(ids, r.ids)
                for a in range(0, len(r.ids), COLUMNS):
                    z = min(len(r.ids), a + COLUMNS)
                    score = products(x, r.q[a:z])
                    keep = score >= np.maximum(r.low[a:z], best.least[a:z])
                    here = (own >= a) & (own < z)
                    keep[mine[here], own[here] - a] = False
                    i, j = np.nonzero(keep)
                    best.add(a + j, ids[i], score[i, j])
            yield found_batch(r.ids, best, part_of_task())

        merged(rows.mapInArrow(reach, FOUND), k).write.mode("append").parquet(out)
        share.unpersist()
    return spark.read.schema(RESULT).parquet(out)


def _narrow(rows: DataFrame, r: Ranges, dim: int) -> None:
    """One round: counts of all rows' scores, the kth score's bin of each query (a row for each query of
    the batch comes to the driver)."""
    share = rows.sparkSession.sparkContext.broadcast(r)

    def count(arrow_batches):
        r = share.value
        counts = np.zeros((len(r.ids), 1 << min(r.step, r.bits)), np.int32)
        for ids, x, _ in chunks(arrow_batches, dim):
            histogram(ids, x, r, counts)
        yield upper(counts, r.need)

    some = rows.mapInArrow(count, COUNTS).select("at", "need", F.explode(F.arrays_zip("bins", "counts")).alias("b"))
    bins = some.groupBy("at", F.col("b.bins").alias("bin")).agg(F.sum("b.counts").alias("n"), F.max("need").alias("need"))
    reached = bins.withColumn("total", F.sum("n").over(Window.partitionBy("at").orderBy(F.desc("bin"))))
    kth = reached.where("total >= need").groupBy("at").agg(F.max(F.struct("bin", (F.col("total") - F.col("n")).alias("above"))).alias("b"))
    r.narrow(kth.select("at", "b.bin", "b.above").collect())
    share.unpersist()
