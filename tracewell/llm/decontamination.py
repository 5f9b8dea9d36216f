"""Operator 6: benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of ``size`` words (a shorter item is one window). Each window is a
set of shingles (up to three words). For exact containment all of a window's shingles must occur,
so in any order of shingles its prefix of one is necessary: shingles are ordered by rarity (how
often they occur in all documents, ties by hash) and only each window's rarest is joined with the
documents' shingles. A match at place p of the document and offset o of the window is kept only if
the window would lie within the text (p - o >= 0, p - o + length <= words), and then the window's
words are compared with the text's one by one.

The benchmark is counted first. Up to ``BROADCAST_WINDOWS`` windows, the tables go to the tasks and
documents are read twice (once to count, once to match) without any shuffle of texts; beyond,
counts and matches are shuffled joins of the same rows.

Defined results: null texts have no words, null items no windows; documents without words get 0;
items with equal windows all count; an item repeated under one id counts once; an
item without an id takes no part; a repeated document gets a row each, one without a doc_id is
searched like all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices, stash, texts
from .near_dups import _M2, _Hashes, _mix

SHINGLE = 3
BROADCAST_WINDOWS = 500_000
#: Parts that a shingle's occurrences are dealt to in the shuffled join, and what stands for no doc_id.
PARTS, NO_ID = 32, -(2**63) + 11
#: Digits, lower-case letters and all bytes from 0x80 are of words; A-Z are lowered first.
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.translate(_KEEP).split() if raw else []


def _roll(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = max(0, len(h) - k + 1)
    out = np.full(n, np.uint64(k))
    for j in range(k):
        out = _mix(out * _M2 + h[j : j + n])
    return out


def _hashes(words: list[bytes], memo: _Hashes) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def windows(items: DataFrame, size: int = 10) -> DataFrame:
    """(item_id string, words binary: the window's words joined by a space), distinct."""

    def run(batches):
        for b in slices(batches):
            ids, out = [], []
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words_of(raw)
                for at in range(max(1, len(w) - size + 1) if w else 0):
                    ids.append(i)
                    out.append(b" ".join(w[at : at + size]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.binary())], names=["item_id", "words"])

    ship(items.sparkSession)
    own = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("raw")).where("item_id is not null")
    return own.mapInArrow(run, "item_id string, words binary").distinct()


def _shingles(windows_: DataFrame) -> DataFrame:
    """(words, width, offset, hash): each distinct window's shingles."""

    def run(batches):
        memo = _Hashes()
        for b in slices(batches, 1024):
            w, k, at, h = [], [], [], []
            for raw in b.column(0).to_pylist():
                ws = raw.split(b" ")
                width = min(SHINGLE, len(ws))
                for o, x in enumerate(_roll(_hashes(ws, memo), width).view(np.int64).tolist()):
                    w.append(raw), k.append(width), at.append(o), h.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(k, pa.int32()), pa.array(at, pa.int32()), pa.array(h, pa.int64())], names=["words", "width", "offset", "hash"])

    return windows_.select("words").distinct().mapInArrow(run, "words binary, width int, offset int, hash long")


def _places(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, place, n): all shingles of all texts."""

    def run(batches):
        memo = _Hashes()
        for b in slices(batches):
            ids, hs, at, size = [], [], [], []
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = _hashes(words_of(raw), memo)
                for k in range(1, SHINGLE + 1):
                    x = _roll(h, k).view(np.int64)
                    ids.append(np.full(len(x), i)), hs.append(x), at.append(np.arange(len(x))), size.append(np.full(len(x), len(h)))
            cols = [np.concatenate(c).astype(np.int64) if c else np.empty(0, np.int64) for c in (ids, hs, at, size)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["doc_id", "hash", "place", "n"])

    return _keyed(docs).mapInArrow(run, "doc_id long, hash long, place long, n long")


def _keyed(docs: DataFrame) -> DataFrame:
    """As ``texts``, with a number for documents without a doc_id, so that they can be joined. What is
    proposed to the wrong document of a number is not confirmed there."""
    return texts(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))


class _Table:
    """A sorted table of hashes; a bit table on their low 20 bits sifts what is looked up."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.sieve = hashes, np.zeros(1 << 20, bool)
        self.sieve[hashes & 0xFFFFF] = True

    def places(self, x: np.ndarray) -> np.ndarray:
        """Where in x a hash of the table stands."""
        maybe = np.flatnonzero(self.sieve[x & 0xFFFFF])
        if not len(maybe):
            return maybe
        y = x[maybe]
        return maybe[self.hashes[np.minimum(np.searchsorted(self.hashes, y), len(self.hashes) - 1)] == y]


def _counts(docs: DataFrame, table, widths: list[int]) -> DataFrame:
    """(hash, count) of the table's shingles in all texts, summed within each batch first."""

    def run(batches):
        memo, t = _Hashes(), _Table(table.value)
        total = np.zeros(len(t.hashes), np.int64)
        for b in slices(batches):
            h = [_hashes(words_of(raw), memo) for raw in b.column(1).to_pylist()]
            for k in widths:
                x = np.concatenate([_roll(y, k).view(np.int64) for y in h]) if h else np.empty(0, np.int64)
                total += np.bincount(np.searchsorted(t.hashes, x[t.places(x)]), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(t.hashes[some]), pa.array(total[some])], names=["hash", "count"])

    return texts(docs).mapInArrow(run, "hash long, count long").groupBy("hash").agg(F.sum("count").alias("count"))


def _rarest(shingles: DataFrame, counts: DataFrame) -> DataFrame:
    """(words, width, offset, hash): each window's rarest shingle, its necessary prefix.

    A shingle that no document holds is the rarest; its window then matches nothing.
    """
    first = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "hash", "offset", "width")).alias("p")
    return shingles.join(counts, "hash", "left").groupBy("words").agg(first).where("p.count > 0").select("words", "p.width", "p.offset", "p.hash")


def _spans(n: int, found: list[tuple[int, int]]) -> int:
    hit = np.zeros(n + 1, np.int64)
    for a, z in found:
        hit[a] += 1
        hit[z] -= 1
    return int((np.cumsum(hit[:n]) > 0).sum())


KIND = "doc_id long, n_words long, n_hit long, spans array<struct<start:int,end:int>>, items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _row(n: int, hits: dict[tuple[int, int], list[str]]):
    spans: list[list[int]] = []
    for a, z in sorted(hits):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], z)
        else:
            spans.append([a, z])
    items = sorted({x for v in hits.values() for x in v})
    return _spans(n, list(hits)), [{"start": a, "end": z} for a, z in spans], items


def _match(docs: DataFrame, prefixes, items) -> DataFrame:
    """prefixes: sorted hashes, and for each the windows (words, width, offset); items: by words."""

    def run(batches):
        memo = _Hashes()
        widths = prefixes.value["widths"]
        table, by_hash, of = _Table(prefixes.value["hash"]), prefixes.value["windows"], items.value
        for b in slices(batches):
            n, hit, spans, names = [], [], [], []
            for raw in b.column(1).to_pylist():
                w = words_of(raw)
                h = _hashes(w, memo)
                found: dict[tuple[int, int], list[str]] = {}
                for k in widths:
                    x = _roll(h, k).view(np.int64)
                    for p in table.places(x).tolist():
                        for words, width, offset in by_hash[int(x[p])]:
                            at, z = p - offset, p - offset + len(words)
                            if width == k and at >= 0 and z <= len(w) and w[at:z] == words:
                                found.setdefault((at, z), []).extend(of[b" ".join(words)])
                a, s, i = _row(len(w), found)
                n.append(len(w)), hit.append(a), spans.append(s), names.append(i)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(spans, _SPANS), pa.array(names, pa.list_(pa.string()))], names=["doc_id", "n_words", "n_hit", "spans", "items"])

    return texts(docs).mapInArrow(run, KIND)


def _joined(docs: DataFrame, prefixes: DataFrame, wins: DataFrame) -> DataFrame:
    """The same by shuffled joins, for a benchmark of any size."""
    length = F.size(F.split(F.col("words").cast("string"), " "))
    # A shingle that is everywhere is dealt to PARTS tasks; the prefixes, of the benchmark's size, go to each.
    places = _places(docs).withColumn("part", F.pmod(F.xxhash64("doc_id", "place"), F.lit(PARTS)).cast("int"))
    each = prefixes.withColumn("length", length).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    near = places.join(each, ["hash", "part"]).withColumn("at", F.col("place") - F.col("offset"))
    near = near.where("at >= 0 and at + length <= n").select("doc_id", "at", "words").distinct()
    near = near.join(wins.groupBy("words").agg(F.collect_set("item_id").alias("of")), "words")
    by_doc = near.groupBy("doc_id").agg(F.collect_list(F.struct("at", "words", "of")).alias("maybe"))

    def run(batches):
        for b in slices(batches):
            n, hit, spans, names = [], [], [], []
            for raw, maybe in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                w = words_of(raw)
                found: dict[tuple[int, int], list[str]] = {}
                for m in maybe or []:
                    words = m["words"].split(b" ")
                    if w[m["at"] : m["at"] + len(words)] == words:
                        found.setdefault((m["at"], m["at"] + len(words)), []).extend(m["of"])
                a, s, i = _row(len(w), found)
                n.append(len(w)), hit.append(a), spans.append(s), names.append(i)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(spans, _SPANS), pa.array(names, pa.list_(pa.string()))], names=["doc_id", "n_words", "n_hit", "spans", "items"])

    found = _keyed(docs).join(by_doc, "doc_id", "left").mapInArrow(run, KIND)
    return found.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def contaminated(docs: DataFrame, items: DataFrame, size: int = 10, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items): words of each text inside a window, and whose."""
    spark = docs.sparkSession
    wins = stash(windows(items, size), "windows")
    shingles = stash(_shingles(wins), "shingles")
    if wins.count() > broadcast_windows:
        counts = _places(docs).join(shingles.select("hash").distinct(), "hash", "left_semi").groupBy("hash").agg(F.count("*").alias("count"))
        return _joined(docs, stash(_rarest(shingles, counts), "prefixes"), wins)
    table = np.sort(np.array(shingles.select("hash").distinct().toArrow().column(0).to_numpy(), np.int64))
    widths = [r["width"] for r in shingles.select("width").distinct().collect()]  # 1 to SHINGLE
    counts = _counts(docs, spark.sparkContext.broadcast(table), widths)
    got = _rarest(shingles, counts).toArrow().to_pylist()
    by_hash: dict[int, list] = {}
    for r in got:
        by_hash.setdefault(r["hash"], []).append((r["words"].split(b" "), r["width"], r["offset"]))
    of: dict[bytes, list[str]] = {}
    for r in wins.toArrow().to_pylist():
        of.setdefault(r["words"], []).append(r["item_id"])
    prefixes = {"hash": np.array(sorted(by_hash), np.int64), "windows": by_hash, "widths": widths}
    return _match(docs, spark.sparkContext.broadcast(prefixes), spark.sparkContext.broadcast(of))


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
