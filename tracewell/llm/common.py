"""Helpers that several operators of this subpackage share.

Inputs are read by name (``doc_id``, ``text``), so that any further columns, clashing names
included, are never touched.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that a broadcast may hold; larger sets are joined by shuffle.
BROADCAST_IDS = 2_000_000

_SHIPPED: set[str] = set()
#: Gives what the C library holds free back to the system, where there is such a function.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, which may not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(os.path.realpath(tempfile.mkdtemp()), "tracewell.zip")
    with zipfile.ZipFile(out, "w") as z:
        for d, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    p = os.path.join(d, n)
                    z.write(p, os.path.relpath(p, os.path.dirname(root)))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what ``spark.checkpoint.dir`` names. Only where all
    runs on one machine (a local master, as in tests) and none is set, it is one of our own."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="tracewell-")
        spark.sparkContext.setCheckpointDir(d)
    return d


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tracewell/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: lineage ends there."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(col: str, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % F.lit(m)


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id long, raw binary): the whole texts; null stays null."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))


def pick(df: DataFrame, ids: DataFrame, how: str, key: str = "doc_id") -> DataFrame:
    """Rows of ``df`` whose key is (left_semi) or is not (left_anti) in ``ids``.

    ``ids`` is broadcast only where a count shows that it is small; else both sides are shuffled.
    """
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, key, how)


def slices(batches, rows: int = 256, most: int = 4 << 20):
    """Small pieces of the incoming Arrow batches, by rows and bytes, to bound a worker's memory."""
    for b in batches:
        size = np.ones(b.num_rows, np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
                size += pc.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False)
        ends, i = np.cumsum(size), 0
        while i < b.num_rows:
            j = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right"))
            j = max(i + 1, min(i + rows, j))
            yield b.slice(i, j - i)
            i = j
    pa.default_memory_pool().release_unused()  # the worker serves later stages too
    if _TRIM:
        _TRIM(0)
