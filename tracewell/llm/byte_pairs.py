"""Operator 5: byte-level BPE encoding and decoding in numpy.

A text is split by the tokenizer's pattern; each distinct piece is encoded once per worker (a bounded
memory is kept). Pieces are put in buckets of like length, a padded matrix of ids each.
In every round every row merges its leftmost pair of minimum rank: pair ranks come from an open
hash table in numpy, the merged column is taken out of the row (compaction), and only the two pairs
beside the merge are looked up anew. Rows without a pair leave the matrix. Beyond ``LONG`` bytes,
where a round for each merge over the whole row would take quadratic time, the same merges in the
same order are done with a heap.

Decoding copies the bytes of all ids of a batch by one gather.

Defined results: null and empty texts give no ids and decode to no bytes; repeated rows are encoded
alike. Texts are never cut. Special tokens are ordinary text.
"""

from __future__ import annotations

import array
import base64
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices

LONG = 512
MEMO = 120_000
NONE = np.int32(2**31 - 1)
_RUN = re.compile(r"\s\s")
_MULT = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Ranks of byte strings, with the ranks of pairs in a hash table."""

    def __init__(self, data: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        tokens = [b""] * (max(self.rank.values(), default=-1) + 1)
        for t, r in self.rank.items():
            tokens[r] = t
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte = np.array([self.rank.get(bytes([b]), -1) for b in range(256)], np.int32)
        k, r = array.array("q"), array.array("i")
        for t, rank in self.rank.items():
            for i in range(1, len(t)):
                left, right = self.rank.get(t[:i]), self.rank.get(t[i:])
                if left is not None and right is not None:
                    k.append((left << 32) | right)
                    r.append(rank)
        k, r = np.array(k, np.int64), np.array(r, np.int32)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(k)) * 2))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        at, self.probes = self._slot(k), 0
        while len(k):  # each round seats one key in each free slot; the others go one on
            free = self.keys[at] == -1
            s, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[s], self.ranks[s] = k[won], r[won]
            rest = np.ones(len(k), bool)
            rest[won] = False
            k, r, at = k[rest], r[rest], (at[rest] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, k: np.ndarray) -> np.ndarray:
        return ((k.astype(np.uint64) * _MULT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE where there is none; ids below 0 are padding."""
        k = (a.astype(np.int64) << 32) | (b.astype(np.int64) & 0xFFFFFFFF)
        out = np.full(k.shape, NONE, np.int32)
        todo = np.flatnonzero(((a >= 0) & (b >= 0)).ravel())
        flat, res = k.ravel(), out.ravel()
        at = self._slot(flat[todo])
        for _ in range(self.probes):
            if not len(todo):
                break
            seen = self.keys[at]
            hit = seen == flat[todo]
            res[todo[hit]] = self.ranks[at[hit]]
            go = ~hit & (seen != -1)
            todo, at = todo[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return res.reshape(k.shape)


def _rows(v: Vocabulary, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pieces of like length, one after another, and how many each has."""
    n, size = len(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
    ids = np.full((n, int(size.max())), -1, np.int32)
    first = np.cumsum(size) - size
    ids[np.repeat(np.arange(n), size), np.arange(int(size.sum())) - np.repeat(first, size)] = v.byte[np.frombuffer(b"".join(pieces), np.uint8)]
    who, rank = np.arange(n), v.pair(ids[:, :-1], ids[:, 1:])
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(who):
        best = rank.min(1) if rank.shape[1] else np.full(len(who), NONE)
        over = best == NONE
        if over.any():
            out = ids[over]
            done.append((who[over], (out >= 0).sum(1), out[out >= 0]))
            who, ids, rank, best = who[~over], ids[~over], rank[~over], best[~over]
            if not len(who):
                break
        at = rank.argmin(1)  # the leftmost of the minimum
        r, w = np.arange(len(who)), ids.shape[1]
        ids[r, at] = best  # a token's id is its rank
        keep = np.ones(ids.shape, bool)
        keep[r, at + 1] = False
        ids = ids[keep].reshape(len(who), w - 1)
        keep = keep[:, 1:]  # the merged pair's column is the one left of the merged id's
        rank = rank[keep].reshape(len(who), w - 2)
        right = np.flatnonzero(at < w - 2)
        rank[right, at[right]] = v.pair(ids[right, at[right]], ids[right, at[right] + 1])
        left = np.flatnonzero(at > 0)
        rank[left, at[left] - 1] = v.pair(ids[left, at[left] - 1], ids[left, at[left]])
    return _ordered(*map(np.concatenate, zip(*done)))


def _ordered(who: np.ndarray, size: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(who, kind="stable")
    return _gather(flat, (np.cumsum(size) - size)[order], size[order]), size[order]


def _heap(v: Vocabulary, piece: bytes) -> np.ndarray:
    """The same merges of one long piece: a heap of (rank, place) over a linked list."""
    rank, n = v.rank, len(piece)
    nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n

    def push(i):
        j = nxt[i]
        if j < n and (r := rank.get(piece[i : end[j]])) is not None:
            heapq.heappush(todo, (r, i, end[i], end[j]))

    todo: list = []
    for i in range(n - 1):
        push(i)
    while todo:
        _, i, mid, last = heapq.heappop(todo)
        j = nxt[i] if alive[i] else n
        if j >= n or end[i] != mid or end[j] != last:
            continue
        end[i], nxt[i], alive[j] = last, nxt[j], False
        if nxt[i] < n:
            prv[nxt[i]] = i
        push(i)
        if prv[i] >= 0:
            push(prv[i])
    return np.array([rank[piece[i : end[i]]] for i in range(n) if alive[i]], np.int32)


def encode_pieces(v: Vocabulary, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces, one after another, and how many each has; by buckets of like length."""
    done = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32))]
    buckets: dict[int, list[int]] = {}
    for i, p in enumerate(pieces):
        buckets.setdefault(len(p) if len(p) <= 16 else 1 << (len(p) - 1).bit_length(), []).append(i)
    for width, own in buckets.items():
        step = max(1, 1_000_000 // max(width, 1))
        for a in range(0, len(own), step):
            part = own[a : a + step]
            if width > LONG:
                each = [_heap(v, pieces[i]) for i in part]
                flat, size = np.concatenate(each), np.array(list(map(len, each)), np.int64)
            else:
                flat, size = _rows(v, [pieces[i] for i in part])
            done.append((np.array(part, np.int64), size, flat))
    return _ordered(*map(np.concatenate, zip(*done)))


class _Chunks(dict):
    """Numbers of the chunks already encoded (a space and what follows it up to the next one);
    their ids lie one after another in ``flat``."""

    def __init__(self, v: Vocabulary, pattern: str):
        self.v, self.pattern, self.split = v, pattern, regex.compile(pattern).findall
        self.reset()

    def reset(self):
        self.clear()
        self.flat, self.start, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one after another, and how many each has; each distinct piece once."""
        each = [self.split(t) for t in texts]
        number = {p: i for i, p in enumerate(dict.fromkeys(p for ps in each for p in ps))}
        flat, size = encode_pieces(self.v, [p.encode() for p in number])
        n = np.fromiter(map(len, each), np.int64, len(each))
        which = np.fromiter((number[p] for ps in each for p in ps), np.int64, int(n.sum()))
        ids = _gather(flat, (np.cumsum(size) - size)[which], size[which])
        ends = np.concatenate([[0], np.cumsum(size[which])])[np.concatenate([[0], np.cumsum(n)])]
        return ids, np.diff(ends)

    def learn(self, new: list[str]):
        ids, size = self.encode([" " + c for c in new])
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, ids])
        self.update(zip(new, range(len(self), len(self) + len(new))))


def _gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` that begin at ``start``, one after another."""
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    return values[np.repeat(start - (end - size), size) + np.arange(total)]


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


def encode_texts(texts: list[str | None], memo: _Chunks) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after another, and how many each text has.

    A piece takes no space but before itself. So, where no two white-space characters meet, a text
    can be cut before each space, and what was encoded once is looked up. The beginning of a text
    and texts where they meet are split by the pattern as they are.
    """
    if len(memo) > MEMO:
        memo.reset()
    whole = [t if t and _RUN.search(t) else None for t in texts]
    each = [t.split(" ") if t and not w else [""] for t, w in zip(texts, whole)]
    begin_ids, begin_n = memo.encode([w or c[0] for w, c in zip(whole, each)])
    if new := list(dict.fromkeys(x for c in each for x in c[1:] if x not in memo)):
        memo.learn(new)
    n = np.array([len(c) for c in each], np.int64)
    place = np.cumsum(n) - n
    number = np.zeros(int(n.sum()), np.int64)
    rest = np.ones(len(number), bool)
    rest[place] = False
    number[rest] = np.fromiter((i for c in each for i in map(memo.__getitem__, c[1:])), np.int64, int(rest.sum()))
    base = len(memo.flat)
    start, size = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
    start[rest], size[rest] = memo.start[number[rest]], memo.size[number[rest]]
    start[place], size[place] = base + np.cumsum(begin_n) - begin_n, begin_n
    ids = _gather(np.concatenate([memo.flat, begin_ids]), start, size)
    ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n)])]
    return ids, np.diff(ends)


def decode_ids(v: Vocabulary, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes one after another, and how many each text has."""
    width = v.size[ids]
    out = _gather(v.blob, v.start[ids], width)
    ends = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(sizes)])]
    return out, np.diff(ends)


_KNOWN: dict[bytes, _Chunks] = {}


def _known(data: bytes, pattern: str) -> _Chunks:
    """A worker's tasks, one after another, share one vocabulary and one bounded memory."""
    key = hashlib.sha256(data).digest()
    if key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[key] = _Chunks(Vocabulary(data), pattern)
    if pattern and _KNOWN[key].pattern != pattern:
        _KNOWN[key] = _Chunks(_KNOWN[key].v, pattern)
    return _KNOWN[key]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>). ``path``: the rank file on the driver; its bytes (under 2 MB) are
    broadcast, as executors may not have it."""
    data = docs.sparkSession.sparkContext.broadcast(_read(path))

    def run(batches):
        memo = _known(data.value, pattern)
        for b in slices(batches, 512):
            ids, n = encode_texts(b.column(1).to_pylist(), memo)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(_offsets(n), pa.array(ids))], names=["doc_id", "ids"])

    ship(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded binary); null ids decode to no bytes."""
    data = encoded.sparkSession.sparkContext.broadcast(_read(path))

    def run(batches):
        v = _known(data.value, "").v
        for b in slices(batches):
            lists = b.column(1)
            n = np.diff(np.asarray(lists.offsets))
            out, size = decode_ids(v, np.asarray(lists.flatten()), n)
            raw = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, _offsets(size).buffers()[1], pa.py_buffer(np.ascontiguousarray(out))])
            yield pa.RecordBatch.from_arrays([b.column(0), lists, raw], names=["doc_id", "ids", "decoded"])

    ship(encoded.sparkSession)
    own = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return own.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): ``encode`` and ``decode`` of the ids in one pass, so that a task needs
    one Python worker, not two."""
    data = docs.sparkSession.sparkContext.broadcast(_read(path))

    def run(batches):
        memo = _known(data.value, pattern)
        for b in slices(batches):
            ids, n = encode_texts(b.column(1).to_pylist(), memo)
            out, size = decode_ids(memo.v, ids, n)
            raw = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, _offsets(size).buffers()[1], pa.py_buffer(np.ascontiguousarray(out))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(_offsets(n), pa.array(ids)), raw], names=["doc_id", "ids", "decoded"])

    ship(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digest(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
