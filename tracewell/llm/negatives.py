"""Operator 11: hard-negative mining by a secondary-sort shuffle.

An anchor's positives are its best rows of the same label; a positive's negatives are the best rows of
other labels whose score lies between a share of the positive's score and that score.

Anchors are broadcast in batches of a bounded size; rows are never shuffled, only scores are:

* A first pass over all rows keeps each task's best rows of the anchor's label; merged, they are the
  positives and with them the windows of scores that negatives must lie in.
* A second pass keeps, for each window, each task's first rows of other labels in it. No row beyond can
  be returned, so what is shuffled does not grow with a label's or an anchor's rows.
* Both kinds are packed into byte keys (anchor, descending score, kind, id), whose order as bytes is the
  order wanted; repartitionAndSortWithinPartitions deals them by anchor and sorts the whole key. One
  iterator goes through a partition: a positive opens a window, a negative is given to each open
  window that it lies in until that has enough. It holds an anchor's open windows, not its rows.

Defined results: see ``scores``; rows without a label take no part; a window of a negative score is
empty, as its lower end lies above; fewer positives or negatives than asked for are all returned; an
empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_path, ship
from .scores import COLUMNS, Best, batches, chunks, finite, matrix, own_rows, products, shape
from .top_k import FOUND, found_batch, merged, part_of_task

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
PAIR = "query_id long, score long, vec_id long"
POSITIVE, NEGATIVE = 0, 1
KEY, FLIP = struct.Struct(">QQBQ"), 1 << 63


def pack(anchor: int, score: int, kind: int, row: int) -> bytes:
    """Bytes in whose order anchors and ids rise, scores fall, and positives come before negatives."""
    return KEY.pack(anchor + FLIP, ~score + FLIP, kind, row + FLIP)


def unpack(key: bytes) -> tuple[int, int, int, int]:
    anchor, score, kind, row = KEY.unpack(key)
    return anchor - FLIP, ~(score - FLIP), kind, row - FLIP


def mine(keys, most: int, low: int, high: int):
    """Result rows from sorted keys. A window is a list: positive, its score, the least score, negatives
    so far."""
    now, windows = None, []
    for key in keys:
        anchor, score, kind, row = unpack(key)
        if anchor != now:
            now, windows = anchor, []
        if kind == POSITIVE:
            windows.append([row, score, -(-low * score // high), 0])
            continue
        windows = [w for w in windows if w[3] < most and w[2] <= score]
        for w in windows:
            w[3] += 1
            yield anchor, w[0], w[3], row, w[1], score


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """One row for each anchor, positive and negative. vectors: vec_id, embedding, label (whole number);
    anchors: which rows are. A negative's score is low/high of the positive's at least."""
    spark = vectors.sparkSession
    ship(spark)
    label = F.col("label").cast("long")
    rows = finite(vectors.where("label is not null"), label.alias("label"), F.coalesce(anchors, F.lit(False)).alias("asked"))
    known = shape(rows)
    if known is None:
        return spark.createDataFrame([], RESULT)
    dim = known[0]
    rows = rows.where(F.size("v") == dim)
    asked, rows = rows.where("asked").drop("asked"), rows.drop("asked")
    out = new_path(spark, "negatives")
    spark.createDataFrame([], RESULT).write.parquet(out)
    for batch in batches(asked, dim):
        best = merged(_positives(rows, batch, dim, positives), positives).select("query_id", "score", "vec_id").toArrow()
        if not best.num_rows:
            continue
        pairs = _negatives(rows, batch, dim, best, negatives, low, high).select(*PAIR.replace(" long", "").split(", "), F.lit(NEGATIVE).alias("kind"))
        pairs = pairs.unionByName(spark.createDataFrame(best).withColumn("kind", F.lit(POSITIVE)))
        keyed = pairs.rdd.map(lambda r: (pack(r["query_id"], r["score"], r["kind"], r["vec_id"]), None))
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = keyed.repartitionAndSortWithinPartitions(n, lambda key: zlib.crc32(key[:8]))
        found = dealt.mapPartitions(lambda part: mine((key for key, _ in part), negatives, low, high))
        spark.createDataFrame(found, RESULT).write.mode("append").parquet(out)
    return spark.read.schema(RESULT).parquet(out)


def _positives(rows: DataFrame, batch: pa.Table, dim: int, k: int) -> DataFrame:
    """Each task's k best rows of each anchor's label."""
    share = rows.sparkSession.sparkContext.broadcast((batch["vec_id"].to_numpy(), matrix(batch["v"], batch.num_rows, dim), batch["label"].to_numpy()))

    def best_of_label(arrow_batches):
        asked, q, labels = share.value
        best = Best(len(asked), k)
        for ids, x, (own_labels,) in chunks(arrow_batches, dim):
            at, own = own_rows(ids, asked)
            for a in range(0, len(asked), COLUMNS):
                z = min(len(asked), a + COLUMNS)
                score = products(x, q[a:z])
                keep = (own_labels.to_numpy()[:, None] == labels[a:z]) & (score >= best.least[a:z])
                here = (own >= a) & (own < z)
                keep[at[here], own[here] - a] = False
                i, j = np.nonzero(keep)
                best.add(a + j, ids[i], score[i, j])
        yield found_batch(asked, best, part_of_task())

    return rows.mapInArrow(best_of_label, FOUND)


def _negatives(rows: DataFrame, batch: pa.Table, dim: int, best: pa.Table, k: int, low: int, high: int) -> DataFrame:
    """Each task's first k rows of other labels in each window; a row that several windows keep is
    given once."""
    asked = batch["vec_id"].to_numpy()
    at, scores = np.searchsorted(asked, best["query_id"].to_numpy()), best["score"].to_numpy()
    windows = sorted({(int(a), int(s)) for a, s in zip(at, scores) if -(-low * int(s) // high) <= s})
    of = np.array([a for a, _ in windows], np.int64)
    top = np.array([s for _, s in windows], np.int64)
    least = np.array([-(-low * s // high) for _, s in windows], np.int64)
    share = rows.sparkSession.sparkContext.broadcast((asked, matrix(batch["v"], batch.num_rows, dim), batch["label"].to_numpy(), of, top, least))

    def first_in_windows(arrow_batches):
        asked, q, labels, of, top, least = share.value
        best = Best(len(of), k)
        for ids, x, (own_labels,) in chunks(arrow_batches, dim):
            for a in range(0, len(asked), COLUMNS):
                z = min(len(asked), a + COLUMNS)
                b, e = np.searchsorted(of, [a, z])
                if b == e:
                    continue
                score = products(x, q[a:z])
                other = own_labels.to_numpy()[:, None] != labels[a:z]
                for w in range(b, e, COLUMNS):
                    cut = slice(w, min(e, w + COLUMNS))
                    s = score[:, of[cut] - a]
                    keep = other[:, of[cut] - a] & (s <= top[cut]) & (s >= np.maximum(least[cut], best.least[cut]))
                    i, j = np.nonzero(keep)
                    best.add(w + j, ids[i], s[i, j])
        pairs = np.unique(np.stack([of[best.at], best.scores, best.ids], 1), axis=0) if len(best.at) else np.empty((0, 3), np.int64)
        yield pa.record_batch([pa.array(asked[pairs[:, 0]]), pa.array(pairs[:, 1]), pa.array(pairs[:, 2])], names=["query_id", "score", "vec_id"])

    return rows.mapInArrow(first_in_windows, PAIR)
