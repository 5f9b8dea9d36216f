"""Keyed state of streams that work batch by batch, in hash buckets.

A key's state is in the bucket of its hash. A batch reads and writes the buckets of its own keys
alone: each bucket has a folder of its last version, ``batch=<i>/bucket=<b>``, and the one before it, so
that a batch that is run again after a failure finds what it found the first time and replaces what it
wrote. One further bucket in turn is rewritten in each batch, so that what has been forgotten goes
from buckets without traffic too.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Files:
    """The few file operations needed, on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.at().getFileSystem(self.conf)

    def at(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def names(self, *parts: str) -> list[str]:
        p = self.at(*parts)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def numbers(self, prefix: str, *parts: str) -> list[int]:
        """The numbers of the entries named prefix=number, rising."""
        return sorted(int(n.split("=")[1]) for n in self.names(*parts) if n.startswith(f"{prefix}="))

    def drop(self, *parts: str) -> None:
        self.fs.delete(self.at(*parts), True)

    def read(self, *parts: str) -> dict | None:
        p = self.at(*parts)
        if not self.fs.exists(p):
            return None
        stream = self.fs.open(p)
        text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def write(self, value: dict, *parts: str) -> None:
        out = self.fs.create(self.at(*parts), True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()


class Buckets:
    def __init__(self, spark: SparkSession, root: str, key: list[str], schema: T.StructType, buckets: int = 64):
        self.spark, self.key, self.schema, self.n = spark, key, schema, buckets
        self.files = Files(spark, root)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.n)).cast("int")

    def versions(self, before: int) -> dict[int, list[int]]:
        """bucket -> the batches, rising, that wrote it before the given one."""
        out: dict[int, list[int]] = {}
        for i in self.files.numbers("batch"):
            if i < before:
                for b in self.files.numbers("bucket", f"batch={i}"):
                    out.setdefault(b, []).append(i)
        return out

    def touched(self, rows: DataFrame, batch: int) -> list[int]:
        """The buckets of the rows' keys (no more numbers than buckets), and the one whose turn it is."""
        own = {r[0] for r in rows.select(self.bucket()).distinct().collect()}
        return sorted(own | {batch % self.n})

    def read(self, buckets: list[int], batch: int) -> DataFrame:
        """The state that batches before this one left in the buckets."""
        last = {b: v[-1] for b, v in self.versions(batch).items()}
        paths = [f"{self.files.root}/batch={last[b]}/bucket={b}" for b in buckets if b in last]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def write(self, state: DataFrame, batch: int) -> None:
        """The buckets' new version. A bucket that has lost all its keys keeps its old one, which readers
        must know to be forgotten."""
        rows = state.select(*self.schema.names).withColumn("bucket", self.bucket())
        rows.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.files.root}/batch={batch}")

    def clean(self, batch: int) -> None:
        """Drops versions that neither this batch, if run again, nor later ones read."""
        for b, v in self.versions(batch).items():
            for i in v[:-1]:
                self.files.drop(f"batch={i}", f"bucket={b}")
        for i in self.files.numbers("batch"):
            if i < batch - 1 and not self.files.numbers("bucket", f"batch={i}"):
                self.files.drop(f"batch={i}")
