"""Tables that cut lineage, in the folder that driver and executors share.

Results read them lazily, so they stay until ``sweep`` is called.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: dict[str, list[str]] = {}


def shared(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of this machine only where all runs on it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="tracewell-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` and reads it back."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> int:
    """Deletes what this application has written; results that read it are void then. Their number."""
    conf, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    made = _MADE.pop(spark.sparkContext.applicationId, [])
    for p in made:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)
    return len(made)
