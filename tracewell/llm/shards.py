"""Operator 10: sharding by size-tiered compaction. DataFrame operations only.

A store is a folder of immutable Parquet shards and a manifest. ``append`` writes arrivals as they
are dealt out, without a shuffle, as small shards. ``compact`` takes shards of a size tier (tier t
holds sizes of ``fan**t`` times the smallest tier's) once ``fan`` of them have gathered, and merges
them into as few files as the target size allows; what has reached half the target is left alone.
Merging reads the small files and writes each merged file from whole ones: no shuffle either.

Every change is a new manifest version: a file of one JSON line a shard, written under another
name and put in place by a rename that fails if the version is there already. Readers see the old
version or the new one whole. A writer that comes second adds its shards to the version that came
first; a merge whose sources are gone by then is given up. A lost executor's half-written files
never are in a manifest.

Nothing is removed by writers, so every version stays readable. ``vacuum`` removes versions older
than the last ``keep`` and files that none of the kept names, if they are older than ``older_s``
seconds: what another writer has written but not committed yet is younger, as long as no write takes
that long.

Defined results: an empty arrival adds no shard; an empty store reads as no rows; rows are stored
as they are, nulls, repeated rows, very long texts and all columns included, whatever their names;
ties in size go by shard id.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = "shard_id long, name string, n_rows long, n_bytes long, tier int, version long"


class Conflict(RuntimeError):
    """Another writer has committed this version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, target_bytes: int = 128 << 20, fan: int = 4, least_bytes: int = 1 << 20):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.target, self.fan, self.least = target_bytes, fan, least_bytes
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self._conf)

    def version(self) -> int:
        """The last committed version; 0 before the first."""
        fs, at = self._fs(), self._path("manifest")
        if not fs.exists(at):
            return 0
        names = (s.getPath().getName() for s in fs.listStatus(at))
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """A row for each shard."""
        v = self.version() if version is None else version
        if not v:
            return self.spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(FIELDS)))
        return self.spark.read.schema(FIELDS).json(f"{self.root}/manifest/v{v:010d}.json").where("shard_id is not null")

    def _entries(self, version: int) -> list[dict]:
        return [r.asDict() for r in self.manifest(version).orderBy("shard_id").collect()]  # a line a shard

    def _commit(self, base: int, entries: list[dict]) -> int:
        fs, new = self._fs(), base + 1
        draft, final = self._path("manifest", f".{uuid.uuid4().hex}"), self._path("manifest", f"v{new:010d}.json")
        out = fs.create(draft, False)
        out.write(bytearray("".join(json.dumps(e) + "\n" for e in entries).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.isAbsolute() and draft.toUri().getScheme() else fs.getUri(), self._conf)
        how = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = getattr(self._jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        try:
            context.rename(draft, final, how)
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(final):
                raise Conflict(f"version {new} is there") from e
            raise
        return new

    def tier(self, n_bytes: int) -> int:
        t = 0
        while n_bytes > self.least * self.fan**t:
            t += 1
        return t

    def _write(self, rows: DataFrame) -> list[dict]:
        """Writes a new folder; its files, without ids and version yet. Empty files are no shards."""
        folder = uuid.uuid4().hex
        rows.select(*(F.col(f"`{f.name}`") for f in self.schema)).write.parquet(f"{self.root}/data/{folder}")
        written = self.spark.read.schema(self.schema).parquet(f"{self.root}/data/{folder}")
        of = written.metadataColumn("_metadata")
        files = written.groupBy(of["file_name"].alias("name"), of["file_size"].alias("n_bytes")).agg(F.count("*").alias("n_rows"))
        return [{"name": f"{folder}/{r['name']}", "n_rows": r["n_rows"], "n_bytes": r["n_bytes"], "tier": self.tier(r["n_bytes"])} for r in files.orderBy("name").collect()]

    def _add(self, files: list[dict], instead: list[dict] = ()) -> int | None:
        """Commits files in the place of others; over again where another writer came first. None if
        the others are not in the store any more."""
        gone = {e["shard_id"] for e in instead}
        while True:
            base = self.version()
            old = self._entries(base)
            if not gone <= {e["shard_id"] for e in old}:
                return None
            first = 1 + max((e["shard_id"] for e in old), default=-1)
            new = [{"shard_id": first + i, **f, "version": base + 1} for i, f in enumerate(files)]
            try:
                return self._commit(base, [e for e in old if e["shard_id"] not in gone] + new)
            except Conflict:
                continue

    def append(self, rows: DataFrame) -> int:
        """Writes an arrival and commits it; the new version."""
        return self._add(self._write(rows))

    def compact(self) -> int:
        """Merges tiers until none has ``fan`` shards; the last version. Each tier is one commit."""
        while True:
            base = self.version()
            small = [e for e in self._entries(base) if 2 * e["n_bytes"] < self.target]
            tiers = sorted({e["tier"] for e in small})
            full = next((t for t in tiers if sum(e["tier"] == t for e in small) >= self.fan), None)
            if full is None:
                return base
            own = [e for e in small if e["tier"] == full]
            n = max(1, round(sum(e["n_bytes"] for e in own) / self.target))
            files = self._write(self._read(own).coalesce(n))
            if len(files) >= len(own):
                return base
            self._add(files, own)

    def vacuum(self, keep: int = 10, older_s: float = 86_400.0) -> None:
        """See above. ``older_s`` must exceed the time that any write takes."""
        fs, last = self._fs(), self.version()
        kept = [v for v in range(max(1, last - keep + 1), last + 1)]
        named = {e["name"] for v in kept for e in self._entries(v)}
        for v in range(1, kept[0] if kept else 1):
            fs.delete(self._path("manifest", f"v{v:010d}.json"), False)
        before = (time.time() - older_s) * 1000
        if not fs.exists(self._path("data")):
            return
        for s in fs.listStatus(self._path("data")):
            files = [(f"{s.getPath().getName()}/{f.getPath().getName()}", f) for f in fs.listStatus(s.getPath())]
            if s.getModificationTime() < before and not any(n in named for n, _ in files) and all(f.getModificationTime() < before for _, f in files):
                fs.delete(s.getPath(), True)
                continue
            for name, f in files:
                if name.endswith(".parquet") and name not in named and f.getModificationTime() < before:
                    fs.delete(f.getPath(), False)

    def _read(self, entries: list[dict]) -> DataFrame:
        if not entries:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.root}/data/{e['name']}" for e in entries))

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self._entries(self.version() if version is None else version))

    def placed(self, version: int | None = None) -> DataFrame:
        """All rows (column row, a struct of the stored columns) with their shard (column shard: shard_id,
        shard_rows, shard_bytes, tier, version), so that no stored name clashes with the store's own."""
        v = self.version() if version is None else version
        own = ("shard_id", F.col("n_rows").alias("shard_rows"), F.col("n_bytes").alias("shard_bytes"), "tier", "version")
        shards = self.manifest(v).select(F.regexp_extract("name", "[^/]+$", 0).alias("file"), F.struct(*own).alias("shard"))
        entries = self._entries(v)
        row = F.struct(*(F.col(f"`{f.name}`") for f in self.schema)).alias("row")
        if not entries:
            return self._read([]).select(row, F.lit(None).cast(shards.schema["shard"].dataType).alias("shard"))
        own_rows = self._read(entries)
        return own_rows.select(row, own_rows.metadataColumn("_metadata")["file_name"].alias("file")).join(shards, "file").select("row", "shard")


def store_by_arrivals(docs: DataFrame, root: str, arrivals: list[tuple[int, int]], parts: int, target_bytes: int) -> ShardStore:
    """Appends ``docs`` as arrivals, each the rows whose hash of doc_id modulo ``parts`` is in its range
    (a null doc_id has the hash of no value, 42), and compacts after each."""
    store = ShardStore(docs.sparkSession, root, docs.schema, target_bytes)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts))
    for a, z in arrivals:
        store.append(docs.where((part >= a) & (part < z)))
        store.compact()
    return store
