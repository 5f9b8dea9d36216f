"""Operator 1: toxic passages by maximum-scoring segment search.

1. Token log-odds: on a bounded, balanced sample of labelled rows, documents of either class that
   hold a token are counted (all tokens that the sample shows three times take part), and each class gets an informative Dirichlet prior (``PRIOR`` pseudo-
   documents spread as the token is in the whole sample). A log-odds counts only as far as its
   lower confidence bound goes (``Z`` standard deviations of the posterior). Tokens are words and,
   for words that the sample does not hold, their beginnings of 6, 5 or 4 characters.
2. Every text is scanned once: token scores, less a small drift for each token, are searched for
   all maximal-scoring segments in linear time (a stack of candidate segments).
3. Segment scores are calibrated by extreme-value statistics: lambda solves sum p*exp(lambda*s)=1
   over the scores of clean tokens, K is fitted on clean texts' excess segments, and a segment of
   score S in m tokens is expected K*m*exp(-lambda*S) times by chance. A document's evidence is the
   sum of -log of these over its segments; a logistic map, fitted on the part of the sample that the
   log-odds did not see, takes it to a probability.

Defined results: null and empty texts have no segments and get the score of no evidence; a
document without labels takes part in no fit; several labels of one document count as toxic if one
does; without a toxic and a clean label, every score is that of no evidence, below 1e-17. A repeated
row is scored like the first. Whole texts are scanned, in time in proportion to their length; of
segments of equal score each counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, ship, slices, stash, texts

#: Labelled documents of each class that the classifier is fitted on, at most (on average).
SAMPLE = 10_000
PRIOR, Z, DRIFT, LOWEST = 50.0, 2.0, 0.1, -2.0
STARTS = (6, 5, 4)
MEMO = 100_000
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() or c == 39 else 32 for c in range(256))


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    base: float = -50.0
    drift: float = DRIFT


def tokens(raw: bytes | None) -> list[bytes]:
    return raw.translate(_KEEP).split() if raw else []


def starts(word: bytes) -> list[str]:
    """The word's key, then those of its beginnings, longest first."""
    w = word.decode("utf-8", "replace").lower()
    return [w, *(f"{w[:n]}*" for n in STARTS if len(w) >= n)]


class _Scores(dict):
    """A word's score: its own, else that of its longest known beginning, else none."""

    def __init__(self, model: Model):
        self.known, self.drift = model.scores, model.drift

    def __missing__(self, w: bytes) -> float:
        if len(self) >= MEMO:
            self.clear()
        self[w] = s = next((self.known[x] for x in starts(w) if x in self.known), 0.0) - self.drift
        return s


def segments(s: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), in order, in linear time.

    A stack holds candidates with the running totals before and after them; a new positive score
    joins to the last candidate that begins lower, as long as that one ends below it.
    """
    total = np.cumsum(s, dtype=np.float64)
    stack: list[list] = []  # start, end, total before, total after, place of the last lower beginning
    for i in np.flatnonzero(s > 0).tolist():
        new = [i, i + 1, total[i - 1] if i else 0.0, total[i], -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= new[3]:
                new[4] = j
                stack.append(new)
                break
            new[0], new[2] = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, after - before) for a, b, before, after, _ in stack]


def evidence(found: list[tuple[int, int, float]], m: int, lam: float, k: float) -> tuple[float, list[float]]:
    """A text's evidence, and how often each segment is expected by chance."""
    by_chance = [k * max(m, 1) * math.exp(-min(lam * s, 600.0)) for _, _, s in found]
    return sum(max(0.0, -math.log(max(e, 1e-300))) for e in by_chance), by_chance


def _sample(docs: DataFrame, labels: DataFrame, train) -> DataFrame | None:
    """(doc_id, raw, toxic, fit, weight): one row of each distinct labelled text, bounded by SAMPLE;
    None where a class has no label."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & train).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return None
    share = {t: min(1.0, SAMPLE / n[t]) for t in (0, 1)}
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1_000_000)) / 1e6
    part = F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])
    chosen = known.where(draw < part).withColumn("weight", 1 / part)
    rows = texts(docs).join(F.broadcast(chosen), "doc_id").where(F.col("raw").isNotNull())
    held = stash(rows.withColumn("h", F.xxhash64("raw")), "labelled")
    one = held.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("most"))
    return held.drop("toxic").join(F.broadcast(one), ["h", "doc_id"]).withColumn("fit", F.crc32(F.col("h").cast("string")) % 10 < 7).select("doc_id", "raw", F.col("most").alias("toxic"), "fit", "weight")


def _log_odds(rows: DataFrame) -> dict[str, float]:
    def run(batches):
        for b in slices(batches, 512):
            seen: dict[str, list[int]] = {}
            for raw, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for t in {x for w in set(tokens(raw)) for x in starts(w)}:
                    seen.setdefault(t, [0, 0])[toxic] += 1
            both = np.array(list(seen.values()), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["token", "clean", "toxic"])

    fit = rows.where("fit")
    size = {r["toxic"]: r["count"] for r in fit.groupBy("toxic").count().collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    if not n0 or not n1:
        return {}
    seen = fit.select("raw", "toxic").mapInArrow(run, "token string, clean long, toxic long").groupBy("token").agg(F.sum("clean").alias("y0"), F.sum("toxic").alias("y1")).where("y0 + y1 >= 3")
    prior = (F.col("y0") + F.col("y1") + 1) * (PRIOR / (n0 + n1))
    a0, a1 = F.col("y0") + prior, F.col("y1") + prior
    odds = F.log(a1 / (n1 + PRIOR - F.col("y1"))) - F.log(a0 / (n0 + PRIOR - F.col("y0")))
    sure = F.abs(odds) - Z * F.sqrt(1 / a0 + 1 / a1)
    t = seen.select("token", odds.alias("odds"), sure.alias("sure")).where("sure > 0").toArrow()  # tokens of the bounded sample
    sure_, odds_ = np.array(t.column("sure")), np.array(t.column("odds"))
    return dict(zip(t.column("token").to_pylist(), np.maximum(np.sign(odds_) * sure_, LOWEST).tolist()))


def fit(docs: DataFrame, labels: DataFrame, train=None) -> Model:
    """``train``: a condition on doc_id for the labels that may be learned from."""
    ship(docs.sparkSession)
    rows = _sample(docs, labels, F.lit(True) if train is None else train)
    model = Model(_log_odds(rows) if rows else {}, drift=DRIFT)
    if not model.scores:
        return model
    share = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        memo = _Scores(share.value)
        for b in slices(batches):
            best, m, seen = [], [], []
            for raw in b.column(0).to_pylist():
                s = np.fromiter(map(memo.__getitem__, tokens(raw)), np.float64)
                best.append([x for _, _, x in segments(s)])
                m.append(len(s))
                v, n = np.unique(np.round(s, 1), return_counts=True)
                seen.append(dict(zip(v.tolist(), n.tolist())))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(m, pa.int64()), pa.array(best, pa.list_(pa.float64())), pa.array([list(x.items()) for x in seen], pa.map_(pa.float64(), pa.int64()))], names=["toxic", "weight", "m", "best", "seen"])

    held = rows.where("not fit").select("raw", "toxic", "weight").mapInArrow(run, "toxic int, weight double, m long, best array<double>, seen map<double,long>")
    got = held.toArrow().to_pylist()  # 30 % of the bounded sample, a few numbers each
    clean = [r for r in got if not r["toxic"]]
    if not clean or len(clean) == len(got):
        return model
    counts: dict[float, int] = {}
    for r in clean:
        for v, n in r["seen"]:
            counts[v] = counts.get(v, 0) + n
    model.lam, model.k = chance(counts, [(x, r["m"]) for r in clean for x in r["best"]], sum(r["m"] for r in clean))
    x = np.array([math.log1p(evidence([(0, 0, s) for s in r["best"]], r["m"], model.lam, model.k)[0]) for r in got])
    model.slope, model.base = logistic(x, np.array([r["toxic"] for r in got], float), np.array([r["weight"] for r in got]))
    return model


def chance(counts: dict[float, int], found: list[tuple[float, int]], total: int) -> tuple[float, float]:
    """lambda and K of the scores that clean texts give."""
    s, n = np.array(list(counts)), np.array(list(counts.values()), float)
    if not (s > 0).any() or (s * n).sum() >= 0:
        return 1.0, 1.0 / max(total, 1)
    low, high = 1e-6, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (low, mid) if np.log((n * np.exp(np.minimum(mid * s, 500.0))).sum() / n.sum()) > 0 else (mid, high)
    lam = low
    at = float(np.median([x for x, _ in found])) if found else 0.0
    over = sum(x >= at for x, _ in found)
    return lam, max(over, 1) / max(total, 1) * math.exp(min(lam * at, 500.0))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and base by Newton steps, with a weak pull of the slope to 0."""
    a = np.stack([x, np.ones_like(x)], 1)
    b, pull, w = np.zeros(2), np.diag([1e-3, 1e-6]), w * len(w) / w.sum()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -40, 40)))
        step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + pull, a.T @ (w * (y - p)) - pull @ b)
        b = b + np.clip(step, -5, 5)
    return max(float(b[0]), 0.0), float(b[1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_tokens, segments: array of start, end, score and expected count)."""
    ship(docs.sparkSession)
    share = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = share.value
        memo = _Scores(m)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))
        for b in slices(batches):
            out, n, parts = [], [], []
            for raw in b.column(1).to_pylist():
                s = np.fromiter(map(memo.__getitem__, tokens(raw)), np.float64)
                found = segments(s)
                x, by_chance = evidence(found, len(s), m.lam, m.k)
                out.append(1 / (1 + math.exp(-max(-40.0, min(40.0, m.slope * math.log1p(x) + m.base)))))
                n.append(len(s))
                parts.append([{"start": a, "end": e, "score": v, "expected": c} for (a, e, v), c in zip(found, by_chance) if c < 1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64()), pa.array(n, pa.int64()), pa.array(parts, kind)], names=["doc_id", "score", "n_tokens", "segments"])

    return texts(docs).mapInArrow(run, "doc_id long, score double, n_tokens long, segments array<struct<start:int,end:int,score:double,expected:double>>")


def toxicity(docs: DataFrame, labels: DataFrame, train=None, threshold: float = 0.7) -> DataFrame:
    """``score`` with ``predicted``, by a model fitted on the labelled rows that ``train`` allows."""
    return score(docs, fit(docs, labels, train)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def trained(m: int = 3, rest: int = 1):
    """The labels that may be learned from: crc32(doc_id) mod m is not ``rest``."""
    return remainder("doc_id", m) != rest
