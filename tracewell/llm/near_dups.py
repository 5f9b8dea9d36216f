"""Operator 4: near-duplicates by b-bit MinHash.

A text's set holds its distinct k-word shingles (words: runs of bytes other than ASCII white
space, A-Z lowered). 160 minima give 32 bands of five; each minimum keeps its low two bits,
packed into five longs. Band buckets propose pairs, bit counts of the packed signatures give a
collision-corrected similarity that screens them, and the full sets confirm each link.

* Texts with equal sets are one representative from the start (grouping by a 128-bit hash of
  the set), so a group of copies, however large, costs one signature row.
* Round one links each bucket's members to the bucket's smallest. After its components are
  known, round two takes from each bucket the pairs of *different* components only, screened by
  wide signatures (2,048 further minima) block by block. All pairs of a bucket are thus either
  joined already or compared; none is capped or dropped. A bucket of more than ``BLOCK`` rows is
  split over tasks by a salt.
* A pair at similarity 0.8 shares no band with probability (1 - 0.8**5)**32 = 3e-6.

Defined results: null or empty texts have no shingles and link with nothing; a text with fewer
than k words is one shingle; ties are broken by the smaller doc_id; repeated rows of one doc_id
are one document and each gets its row; rows of one doc_id with different texts are linked; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, pick, ship, slices, stash, texts

BANDS, ROWS, BITS = 32, 5, 2
HASHES = BANDS * ROWS
#: Minima of the wide signatures that pairs of different components are screened by.
WIDE = 2048
#: A pair is compared in full if its estimate is no further than this below the threshold: five
#: standard deviations of the estimates at least.
SLACK, WIDE_SLACK = 0.2, 0.055
#: Rows of a bucket that one task compares with as many others; larger buckets are cut.
BLOCK = 1024
MEMO = 100_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_RNG = np.random.default_rng(20240229)
_A = (_RNG.integers(0, 2**32, HASHES + WIDE, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_X = _RNG.integers(0, 2**32, HASHES + WIDE, dtype=np.uint64).astype(np.uint32)
_BANDED, _REST = slice(0, HASHES), slice(HASHES, HASHES + WIDE)


class _Hashes(dict):
    """A word's 64-bit hash, remembered up to a bound."""

    def __missing__(self, w: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[w] = h = xxhash.xxh64_intdigest(w)
        return h


def words_of(raw: bytes | None) -> list[bytes]:
    """bytes.lower and bytes.split know ASCII only, which is what the definition says."""
    return raw.lower().split() if raw else []


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _M1
    return h ^ (h >> np.uint64(32))


def shingle_hashes(words: list[bytes], k: int, memo: _Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    width = min(k, len(h))
    out = np.full(n, np.uint64(width))
    for j in range(width):
        out = _mix(out * _M2 + h[j : j + n])
    return np.unique(out)


def minima(u: np.ndarray, which: slice = _BANDED) -> np.ndarray:
    x = (u ^ (u >> np.uint64(32))).astype(np.uint32)
    a, flip = _A[which, None], _X[which, None]
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 256):
        best = np.minimum(best, (a * (x[None, i : i + 256] ^ flip)).min(1))
    return best


def band_keys(m: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for j in range(ROWS):
        key = _mix(key * _M2 + m.reshape(BANDS, ROWS)[:, j].astype(np.uint64))
    return key.view(np.int64)


def packed(m: np.ndarray) -> np.ndarray:
    """Low bits of the minima, 32 lanes of two bits to a long.

    Minima are mixed with their lane's number first: the low bits of a * x alone depend on those of
    x only, so that two shingles would agree in all lanes or in none.
    """
    lane = np.arange(1, len(m) + 1, dtype=np.uint64) * _M1
    low = (_mix((m ^ lane) * _M2) & np.uint64(2**BITS - 1)).reshape(-1, 64 // BITS)
    return np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=1).view(np.int64)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, set_hash, sig, keys) for each row; no hash, sig and keys where n is 0."""

    def run(batches):
        memo = _Hashes()
        for b in slices(batches):
            n, ids, sig, keys = [], [], [], []
            for raw in b.column(1).to_pylist():
                u = shingle_hashes(words_of(raw), k, memo)
                n.append(len(u))
                m = minima(u) if len(u) else None
                ids.append(xxhash.xxh128_digest(u.tobytes()) if len(u) else None)
                sig.append(packed(m) if len(u) else None)
                keys.append(band_keys(m) if len(u) else None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(sig, longs), pa.array(keys, longs)],
                names=["doc_id", "n", "set_hash", "sig", "keys"],
            )

    ship(docs.sparkSession)
    return texts(docs).mapInArrow(run, "doc_id long, n long, set_hash binary, sig array<long>, keys array<long>")


def wide_signatures(docs: DataFrame, k: int) -> DataFrame:
    """(rep, n, wide, keys): packed low bits of further minima, and the band keys again."""

    def run(batches):
        memo = _Hashes()
        for b in slices(batches):
            u = [shingle_hashes(words_of(raw), k, memo) for raw in b.column(1).to_pylist()]
            longs = pa.list_(pa.int64())
            cols = [pa.array([packed(minima(x, _REST)) for x in u], longs), pa.array([band_keys(minima(x)) for x in u], longs)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in u], pa.int64()), *cols], names=["rep", "n", "wide", "keys"])

    return texts(docs).mapInArrow(run, "rep long, n long, wide array<long>, keys array<long>").dropDuplicates(["rep", "n", "keys"])


def _pairs_of(key: int, across: bool, rep, label, n, block, wide, keys, percent: int):
    """The pairs of one bucket, or of two of its blocks, that must be compared in full: of different
    components, near in size and by wide signatures, each in its first common band only."""
    lanes, chance = WIDE, 2.0**-BITS
    most = lanes * (1 - (chance + (percent / 100 - WIDE_SLACK) * (1 - chance)))
    for i in range(0, len(rep), 64):
        own = slice(i, i + 64)
        ok = label[own, None] < label[None, :]
        if across:
            ok &= block[own, None] != block[None, :]
        small, large = np.minimum(n[own, None], n[None, :]), np.maximum(n[own, None], n[None, :])
        a, b = np.nonzero(ok & (small * 100 >= large * percent))
        a += i
        for j in range(0, len(a), 16384):
            x, y = a[j : j + 16384], b[j : j + 16384]
            same = keys[x] == keys[y]
            first = keys[x, same.argmax(1)] == key
            x, y = x[first], y[first]
            d = wide[x] ^ wide[y]
            d = (d | (d >> np.uint64(1))) & np.uint64(0x5555555555555555)
            near = np.bitwise_count(d).sum(1, dtype=np.int64) <= most
            if near.any():
                yield np.minimum(rep[x[near]], rep[y[near]]), np.maximum(rep[x[near]], rep[y[near]])


def _across_components(open_: DataFrame, wide: DataFrame, percent: int) -> DataFrame:
    """(a, b) to compare, out of the buckets (key, salt, salts, rep, label) that hold several components.

    Most of a large bucket is one component, whose own pairs need no comparison. So its rows and all
    others are cut into blocks apart, and only pairs of blocks of which one holds others are dealt to
    tasks, none of which gets more than two blocks.
    """
    each = open_.groupBy("key", "label").agg(F.count("*").alias("c"), F.first("salts").alias("salts"))
    main = F.max(F.struct("c", "label")).alias("m")
    cut = each.groupBy("key").agg(main, F.sum("c").alias("all"), F.first("salts").alias("salts"))
    n = lambda c: F.greatest(F.ceil(c / F.lit(BLOCK)), F.lit(1)).cast("int")
    cut = cut.select("key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("m.label").alias("main"), n(F.col("m.c")).alias("own"), n(F.col("all") - F.col("m.c")).alias("others"))
    within = F.pmod(F.xxhash64("rep"), F.when(F.col("label") == F.col("main"), F.col("own")).otherwise(F.col("others")))
    most = F.when(F.col("label") == F.col("main"), F.col("others") - 1).otherwise(F.col("own") + F.col("others") - 1)
    rows = open_.join(cut, ["key", "salt"]).withColumn("block", (within + F.when(F.col("label") == F.col("main"), F.col("others")).otherwise(0)).cast("int"))
    rows = rows.select("key", "rep", "label", "block", F.explode(F.sequence(F.lit(0), most)).alias("other"))
    rows = rows.select("key", "rep", "label", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    dealt = rows.join(wide, "rep").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def run(batches):
        held: list[np.ndarray] | None = None

        def compare(g):
            head, rep, label, n, block, w, k = g
            for a, b in _pairs_of(int(head[0, 0]), head[0, 1] != head[0, 2], rep, label, n, block, w, k, percent):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            flat = lambda c, kind: np.asarray(b.column(c).flatten()).view(kind).reshape(b.num_rows, -1)
            col = lambda c: np.asarray(b.column(c)).astype(np.int64)
            new = [np.stack([col("key"), col("lo"), col("hi")], 1), col("rep"), col("label"), col("n"), col("block"), flat("wide", np.uint64), flat("keys", np.int64)]
            held = new if held is None else [np.concatenate(c) for c in zip(held, new)]
            ends = np.flatnonzero((held[0][1:] != held[0][:-1]).any(1)) + 1
            at = 0
            for z in ends.tolist():
                yield from compare([c[at:z] for c in held])
                at = z
            held = [c[at:] for c in held]
        if held is not None:
            yield from compare(held)

    return dealt.select("key", "lo", "hi", "rep", "label", "n", "block", "wide", "keys").mapInArrow(run, "a long, b long")


def estimate(a: str, b: str):
    """Similarity from two packed signatures, corrected for lanes that agree by chance."""
    lanes = 0
    for i in range(HASHES * BITS // 64):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        lanes = lanes + F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(F.lit(0x5555555555555555)))
    chance = 2.0**-BITS
    return (1 - lanes / F.lit(float(HASHES)) - chance) / (1 - chance)


def _screen(pairs: DataFrame, percent: int) -> DataFrame:
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    return pairs.where((small * 100 >= large * percent) & (estimate("sig_a", "sig_b") >= percent / 100 - SLACK))


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The (a, b) whose full sets reach the similarity."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    own = texts(pick(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ids, "left_semi"))
    left = own.select(F.col("doc_id").alias("a"), F.col("raw").alias("raw_a"))
    right = own.select(F.col("doc_id").alias("b"), F.col("raw").alias("raw_b"))

    def shingles(raw):
        w = words_of(raw)
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    def run(batches):
        last, held = None, set()
        for s in slices(batches, 64):
            keep = []
            for a, ra, rb in zip(s.column(0).to_pylist(), s.column(2).to_pylist(), s.column(3).to_pylist()):
                if a != last:
                    last, held = a, shingles(ra)
                x = shingles(rb)
                both = len(held & x)
                keep.append(both > 0 and 100 * both >= percent * (len(held) + len(x) - both))
            yield s.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "raw_a", "raw_b")
    return both.mapInArrow(run, "a long, b long").distinct()


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row for a key. Rows of a key that more than
    ``BLOCK`` rows of ``left`` have stay where they are: their keys, one in ``BLOCK`` rows at most, are
    counted and broadcast. The others are shuffled."""
    hot = stash(left.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select(key), "hot")
    n = hot.limit(BROADCAST_IDS + 1).count()
    if not n or n > BROADCAST_IDS:
        return left.join(right, key, how)
    hot = F.broadcast(hot)
    few = right.join(hot, key, "left_semi")
    return left.join(hot, key, "left_semi").join(F.broadcast(few), key, how).unionByName(left.join(hot, key, "left_anti").join(right, key, how))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of the edges (a, b) can reach.

    Labels take the smallest of their neighbours', then jump to their label's label, until
    nothing changes: rounds grow with the logarithm of a chain. Each round's table is written to
    the shared folder.
    """
    both = stash(edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other").distinct(), "edges")
    labels = stash(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("label")), "labels")
    while True:
        near = join_hot(both, labels.toDF("other", "l"), "other").groupBy("node").agg(F.min("l").alias("l"))
        low = labels.join(near, "node").select("node", "label", F.least("label", "l").alias("low"))
        up = labels.toDF("low", "up")
        new = stash(join_hot(stash(low, "low"), up, "low").select("node", F.least("low", "up").alias("label"), (F.least("low", "up") < F.col("label")).alias("moved")), "labels")
        labels = new.select("node", "label")
        if not new.where("moved").limit(1).count():
            return labels


def _of_one_id(own: DataFrame, heads: DataFrame) -> DataFrame:
    """(a, b): representatives of the different texts that rows of one doc_id have."""
    several = own.where("n > 0").groupBy("doc_id").agg(F.min("set_hash").alias("x"), F.max("set_hash").alias("y")).where("x < y").select("doc_id")
    each = own.join(several, "doc_id", "left_semi").select("doc_id", "set_hash").distinct().join(heads, "set_hash").select("doc_id", "rep")
    return each.join(each.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``."""
    own = stash(signatures(docs, k), "signatures")
    heads = stash(own.where("n > 0").groupBy("set_hash").agg(F.min("doc_id").alias("rep")), "heads")
    reps = stash(
        own.where("n > 0").select("set_hash", F.col("doc_id").alias("rep"), "n", "sig", "keys").join(heads, ["set_hash", "rep"]).dropDuplicates(["rep", "set_hash"]).drop("set_hash"),
        "representatives",
    )
    rows = reps.select("rep", F.explode("keys").alias("key"))
    buckets = rows.groupBy("key").agg(F.min("rep").alias("first"), F.max("rep").alias("last"), F.count("*").alias("n")).where("first < last")
    # A large bucket's rows are dealt to several tasks from here on, by the salt beside its key.
    salts = F.greatest(F.ceil(F.col("n") / F.lit(BLOCK)), F.lit(1)).cast("int").alias("salts")
    shared = join_hot(rows, stash(buckets.select("key", "first", salts), "shared"), "key")
    shared = stash(shared.withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int")), "buckets")
    sides = reps.select("rep", "n", "sig")
    left, right = sides.toDF("a", "n_a", "sig_a"), sides.toDF("b", "n_b", "sig_b")

    star = shared.where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
    tried = stash(_screen(star.join(left, "a").join(right, "b"), percent).select("a", "b"), "pairs")
    edges = stash(confirmed(tried, docs, k, percent).union(_of_one_id(own, heads)), "links")
    label = components(edges)

    known = stash(shared.join(label.toDF("rep", "label"), "rep", "left").select("key", "salt", "salts", "rep", F.coalesce("label", "rep").alias("label")), "known")
    apart = known.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.first("salts").alias("salts")).where("x < y")
    apart = apart.select("key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    open_ = stash(known.join(apart, ["key", "salt"]), "open")
    asked = pick(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), open_.select(F.col("rep").alias("doc_id")).distinct(), "left_semi")
    wide = stash(wide_signatures(asked, k), "wide")
    cross = _across_components(open_, wide, percent).distinct().join(tried, ["a", "b"], "left_anti")
    more = stash(confirmed(stash(cross, "pairs"), docs, k, percent), "links")
    if more.limit(1).count():
        label = components(edges.union(more))

    to = stash(heads.join(label.toDF("rep", "label"), "rep", "left").select("set_hash", F.coalesce("label", "rep").alias("component")), "components")
    out = own.select("doc_id", "n", "set_hash").join(to, "set_hash", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
