"""Operator 9: token counts of a unigram vocabulary by a count-only Viterbi pass.

The vocabulary is the pieces and scores of a public piece model, read as a unigram model: of all
ways to cut a text into pieces, that of the highest total score counts. An Aho-Corasick automaton
finds every piece in a text in one pass; dynamic programming over characters carries, for each
place, only the best score and its number of pieces (no way back is kept, as no pieces are asked
for). The rules are the tokenizer's:

* a space becomes U+2581, and one is put before the text;
* a character that no piece of one character covers may stand alone at the lowest score less 10;
  it counts as its UTF-8 bytes if the vocabulary has byte pieces, else a run of such is one;
* of equal scores the one whose last piece is longest stands: beginnings are tried from left to
  right and only a higher score replaces what is there.

No piece goes on past a U+2581 that follows another character, so texts are cut before each; the
best cut of the whole is that of the parts, and parts seen before are looked up (a bounded memory).

Only the model's ordinary pieces are matched: its control and byte pieces (``<s>``, ``<0x41>``), where
they are written out in a text, are ordinary text, as the tokenizer itself has it.

Defined results: null counts as empty; empty texts have no pieces; repeated rows count alike; texts
are counted whole, in time in proportion to their length.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices

MARK = "▁"
PENALTY = 10.0
MEMO = 400_000


def read_pieces(path: str) -> tuple[list[tuple[str, float]], bool]:
    """(piece, score) of the model's ordinary pieces, and whether it has all byte pieces."""
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    own = [(p.piece, p.score) for p in m.pieces if p.type == p.Type.NORMAL or p.type == p.Type.USER_DEFINED]
    return own, sum(p.type == p.Type.BYTE for p in m.pieces) == 256


class Counter(dict):
    """Pieces in a part, remembered."""

    def __init__(self, pieces: list[tuple[str, float]], byte_pieces: bool):
        self.find, self.bytes = ahocorasick.Automaton(), byte_pieces
        for p, s in pieces:
            self.find.add_word(p, (len(p), float(s)))
        self.find.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - PENALTY
        #: Parts may be cut before a mark only if no piece has one after another character.
        self.parts = not any(MARK in p.lstrip(MARK) for p, _ in pieces)

    def __missing__(self, part: str) -> int:
        n = self.count(part)
        if len(part) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[part] = n
        return n

    def count(self, text: str) -> int:
        """Number of pieces of the best cut."""
        n = len(text)
        begins: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for last, (size, score) in self.find.iter(text):
            begins[last - size + 1].append((size, score))
        score = [float("-inf")] * (n + 1)
        count, lone = [0] * (n + 1), [False] * (n + 1)  # lone: the last piece is an unknown one
        score[0] = 0.0
        for i in range(n):
            here, c, single = score[i], count[i], False
            for size, s in begins[i]:
                single = single or size == 1
                if here + s > score[i + size]:
                    score[i + size], count[i + size], lone[i + size] = here + s, c + 1, False
            if not single and here + self.unknown > score[i + 1]:
                score[i + 1], lone[i + 1] = here + self.unknown, True
                count[i + 1] = c + (len(text[i].encode("utf-8", "replace")) if self.bytes else not lone[i])
        return count[n]

    def total(self, text: str | None) -> int:
        if not text:
            return 0
        whole = MARK + text.replace(" ", MARK)
        if not self.parts:
            return self.count(whole)
        first, *rest = whole.split(MARK)  # the first is empty: the text begins with a mark
        if "" not in rest:
            return sum(map(self.__getitem__, rest_marked(rest)))
        return sum(self[p] for p in marked_runs(rest))


def rest_marked(rest: list[str]) -> list[str]:
    return [MARK + r for r in rest]


def marked_runs(rest: list[str]) -> list[str]:
    """Marks that follow each other belong to the part after them: pieces may hold several."""
    out, marks = [], ""
    for r in rest:
        marks += MARK
        if r:
            out.append(marks + r)
            marks = ""
    return out + [marks] if marks else out


_KNOWN: dict[bytes, Counter] = {}


def _counter(pieces, byte_pieces) -> Counter:
    """A worker's tasks, one after another, share the automaton and memory."""
    key = hashlib.sha256(repr((len(pieces), pieces[:50], pieces[-50:], byte_pieces)).encode()).digest()
    if key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[key] = Counter(pieces, byte_pieces)
    return _KNOWN[key]


def piece_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens), a row for each row of ``docs``. ``path``: the model on the driver; its
    pieces (some tens of thousands) are broadcast."""
    share = docs.sparkSession.sparkContext.broadcast(read_pieces(path))

    def run(batches):
        c = _counter(*share.value)
        for b in slices(batches):
            n = np.array([c.total(t) for t in b.column(1).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n)], names=["doc_id", "n_tokens"])

    ship(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_tokens long")
