"""Operator 7: language by a string kernel with Nystroem landmarks and kernel ridge regression.

The blended spectrum of a text is the set of its character n-grams of 1 to 3 (lower-cased, white
space as one space). The kernel of two texts is the share of n-grams present in both, normalised:
|A and B| / sqrt(|A| |B|), over the n-grams that at least ``LEAST`` landmarks hold (one, where each
language has one landmark; A and B are the texts' sets among these: what no landmark knows tells
nothing of a language). ``LANDMARKS`` training texts of each language stand for all others:
with K their own kernel matrix, a text's features are its kernel values against them times
K^(-1/2). One ridge regression a language against the rest is fitted on these features, classes
weighted alike.

Scoring works on blocks of texts: a presence matrix (texts x n-grams of the landmarks) times the
landmarks' presence matrix gives all kernel values; a second product gives all languages' scores.
The softmax of the scaled scores is the returned one.

The fit uses a bounded sample: ``TRAIN`` texts a language (about), drawn by a hash of the id. The
languages are those of the training rows, however many; none is left out. From ``MOST_LANDMARKS`` /
``LANDMARKS`` languages on each has fewer landmarks, from ``MOST_TRAIN`` / ``TRAIN`` on fewer texts, but one
landmark and ``LEAST_TRAIN`` texts at the least: beyond that the model grows with the languages, never with the
rows.

Defined results: null texts and texts without a letter are ``und`` with score 0; rows without a
language are not learned from; without any training row all is ``und``. Ties (scores
that agree to four places) go to the language that sorts first. Repeated rows get equal results. Texts are read whole, whatever their length. A
letter is what Unicode calls one (category L): fractions, circled and Roman numbers are none.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, slices

LANDMARKS, TRAIN = 48, 400
#: Landmarks and texts of all languages together, and the texts that every language keeps.
MOST_LANDMARKS, MOST_TRAIN, LEAST_TRAIN = 2400, 40_000, 32
#: n-grams that occur in fewer landmarks than this tell little and are left out.
LEAST = 2
RIDGE, SHARP = 1e-2, 8.0
_LETTER = regex.compile(r"\p{L}")  # as the fit asks of its rows
_SPACE = re.compile(r"\s+")
_P = np.uint64(0x9E3779B97F4A7C15)


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams, repeats included: three characters of 21 bits each."""
    c = np.frombuffer(_SPACE.sub(" ", f" {text.lower()} ").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    two = (c[:-1] << np.uint64(21)) | c[1:]
    return np.concatenate([c, two, (two[:-1] << np.uint64(21)) | c[2:]])


class Places:
    """Where a known n-gram's column is: a hash table in numpy; -1 for the others."""

    def __init__(self, codes: np.ndarray):
        self.bits = max(8, int(len(codes) * 4).bit_length())
        self.key = np.zeros(1 << self.bits, np.uint64)
        self.col = np.full(1 << self.bits, -1, np.int32)
        left, at, self.probes = np.arange(len(codes)), self._slot(codes), 0
        while len(left):
            free = self.col[at] < 0
            s, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.key[s], self.col[s] = codes[left[won]], left[won]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, at = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, x: np.ndarray) -> np.ndarray:
        return ((x * _P) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out, todo, at = np.full(len(x), -1, np.int32), np.arange(len(x)), self._slot(x)
        for _ in range(self.probes):
            col = self.col[at]
            hit = (col >= 0) & (self.key[at] == x[todo])
            out[todo[hit]] = col[hit]
            go = ~hit & (col >= 0)
            todo, at = todo[go], (at[go] + 1) & ((1 << self.bits) - 1)
            if not len(todo):
                break
        return out


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray
    landmarks: np.ndarray  # presence, n-grams x landmarks, each over the root of its size
    weights: np.ndarray  # landmarks x languages
    base: np.ndarray


def presence(texts: list[str], places: Places, width: int) -> np.ndarray:
    x = np.zeros((len(texts), width), np.float32)
    for i, t in enumerate(texts):
        col = places(grams(t))
        x[i, col[col >= 0]] = 1
    return x


def fit_texts(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """rows: (text, language), in a fixed order."""
    of: dict[str, list[str]] = {}
    for t, x in rows:
        of.setdefault(x, []).append(t)
    langs = sorted(of)
    if not langs:
        return None
    number = {x: i for i, x in enumerate(langs)}
    landmarks = max(1, min(landmarks, MOST_LANDMARKS // len(langs)))
    chosen = [t for x in langs for t in of[x][:landmarks]]
    all_ = np.concatenate([np.unique(grams(t)) for t in chosen])
    codes, n = np.unique(all_, return_counts=True)
    codes = codes[n >= min(LEAST, landmarks, len(chosen))]
    places = Places(codes)
    marks = presence(chosen, places, len(codes))
    marks /= np.sqrt(np.maximum(marks.sum(1, keepdims=True), 1))
    k = (marks @ marks.T).astype(np.float64)
    value, vector = np.linalg.eigh(k)
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    feats = []
    for i in range(0, len(rows), 128):
        x = presence([t for t, _ in rows[i : i + 128]], places, len(codes))
        feats.append((x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))) @ marks.T)
    phi = np.concatenate(feats).astype(np.float64) @ root
    y = np.array([number[x] for _, x in rows])
    w = 1.0 / np.bincount(y, minlength=len(langs))[y]
    mean = np.average(phi, 0, w)
    target = 2.0 * (y[:, None] == np.arange(len(langs))[None, :]) - 1
    middle = np.average(target, 0, w)
    a = (phi - mean) * np.sqrt(w)[:, None]
    own = np.linalg.solve(a.T @ a + ridge * np.eye(a.shape[1]), a.T @ ((target - middle) * np.sqrt(w)[:, None]))
    return Model(langs, codes, marks.T.astype(np.float32).copy(), (root @ own).astype(np.float32), (middle - mean @ own).astype(np.float32))


def predict_texts(m: Model, places: Places, texts: list[str]) -> tuple[list[str], np.ndarray]:
    x = presence(texts, places, len(m.codes))
    kernel = (x @ m.landmarks) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    s = (kernel @ m.weights + m.base).astype(np.float64) * SHARP
    p = np.exp(s - s.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    top = np.round(s, 4).argmax(1)
    return [m.langs[i] for i in top], p[np.arange(len(top)), top]


def fit(docs: DataFrame, train: Column) -> Model | None:
    """From a sample of the rows that ``train`` allows: TRAIN of each language, about."""
    known = docs.where(train & F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = known.groupBy("lang").count().collect()  # a row a language
    if not counts:
        return None
    each = max(LEAST_TRAIN, min(TRAIN, MOST_TRAIN // len(counts)))
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, each / r["count"])) for r in counts], "lang string, part double")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) / 1e6
    drawn = known.join(F.broadcast(shares), "lang").where(draw < F.col("part"))
    rows = drawn.where(F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang").toArrow().to_pylist()
    rows.sort(key=lambda r: (hash_order(r["doc_id"]), r["text"]))
    return fit_texts([(r["text"], r["lang"]) for r in rows])


def hash_order(i: int | None) -> int:
    return ((i or 0) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score), a row for each row of ``docs``."""
    ship(docs.sparkSession)
    share = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = share.value
        places = Places(m.codes) if m else None
        for b in slices(batches, 128):
            texts = b.column(1).to_pylist()
            own = [i for i, t in enumerate(texts) if m and t and _LETTER.search(t)]
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            if own:
                langs, p = predict_texts(m, places, [texts[i] for i in own])
                score[own] = p
                for i, x in zip(own, langs):
                    pred[i] = x
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, train: Column) -> DataFrame:
    return predict(docs, fit(docs, train))
