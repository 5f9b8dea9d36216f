"""Operator 2: log-probability of texts under a causal self-attention model trained in numpy.

Words (runs of bytes other than ASCII white space, A-Z lowered) are spelled in subword ids: the
public byte-level merges, of which the first ``IDS`` are a vocabulary of their own right, over a
space and the word; a text ends with ``END``. Words are spelled once, into a table of ids.

* The model: one causal attention layer with query, key and value rows of each id and a bias for
  each distance; the attended value and the last two ids feed one hidden layer, and the next id is
  predicted in three steps of one in sixteen: ids stand in the order of their bytes, and their places'
  digits to the base of 16 are predicted one after another.
* Context windows: 64 ids, moved on by 32. Each window's last 32 ids are queries, so every id is
  scored once, with 32 to 63 ids before it; windows of many texts are one batch with one mask.
* The score is the sum of the logarithms of all ids' probabilities and the end's. Each is a
  distribution over ids, and texts are spelled in one way only, so the probabilities of all texts sum
  to 1 at most.
* Training: biases begin at the ids' counts over all training documents. Where the tasks begin is found by
  a first fit on the driver on a bounded sample (``SAMPLE`` documents, ``STEPS`` batches of ``BATCH`` windows).
  From there each task learns from every window of its training documents (``LEARN`` is all), and the
  tasks' models, each the mean of its steps, are averaged by Spark, each weighted by its windows: every
  training document's every id is learned from. Padding is no target.
* Words' counts (for the base) are summed in each task, then by shuffle. The ``FREQUENT`` most
  frequent go to the tasks; all other words' counts are joined to their occurrences.

In scoring, exponentials are a piecewise linear function of 3 % error, normalised by its own sums.
Words are cut into ids by a library that applies the merges.

Defined results: null is the empty text, which is one end token; an empty table gives an empty
result; without training documents, counts are 0, the base is uniform over V = 0 words and the
end, and the model is as it begins; repeated rows get a row each. Texts are scored whole, in time
in proportion to their length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byte_pairs import Vocabulary, _gather, _read
from .common import ship, slices, stash
from .near_dups import words_of

WAYS, STEPS_DEEP = 16, 3
ALL = WAYS**STEPS_DEEP
IDS = ALL - 2
END, PAD = IDS, IDS + 1
#: Of the hidden units the first is always 1: its weights are the biases.
WIDTH, HIDDEN, SPAN = 16, 32, 32
#: Hidden values are cut off here, so that the logits' range is known.
TOP = np.float32(6.0)
SAMPLE, STEPS, BATCH = 1500, 600, 96
#: The share of all training documents' windows that the tasks learn from (all), the windows of a step there, and their rate.
LEARN, PACE, RATE = 1.0, 256, 0.006
AT_ONCE, ROWS_AT_ONCE = 128, 1024
FREQUENT, MEMO, ADD = 250_000, 200_000, 0.1
#: Bytes of texts, and of ids, that a worker has in hand at once.
TEXT_BYTES, ID_BYTES = 1 << 20, 1 << 20
_MASK = np.arange(SPAN)[:, None] + SPAN - np.arange(2 * SPAN)[None, :]  # how far back a key is; below 0: ahead
FIXED = ("x", "y", "w")  # what feeds the hidden layer
ROWS = ("x", "y", "q", "k", "v")  # tables of a row an id
#: Windows whose attention is in the processor's cache at once.
IN_CACHE = 32

#: The bits of the float exp(x) are about SCALE * x + SHIFT, to 3 %.
SCALE, SHIFT = np.float32(12102203.0), np.float32(1064866805.0)
_LOW, _HIGH = SHIFT - 80 * SCALE, SHIFT + 85 * SCALE
_SCRATCH: dict[tuple[str, type], np.ndarray] = {}


def _scratch(name: str, shape: tuple[int, ...], kind=np.float32) -> np.ndarray:
    """An array to write over, of the same memory each time: a worker has one thread."""
    size, own = math.prod(shape), (name, kind)
    if own not in _SCRATCH or len(_SCRATCH[own]) < size:
        _SCRATCH[own] = np.empty(size, kind)
    return _SCRATCH[own][:size].reshape(shape)


def bits_exp(x: np.ndarray, name: str) -> np.ndarray:
    """exp of what was multiplied by SCALE and moved by SHIFT already."""
    np.clip(x, _LOW, _HIGH, out=x)
    out = _scratch(name, x.shape, np.int32)
    np.copyto(out, x, casting="unsafe")
    return out.view(np.float32)


def _ends(group: np.ndarray, n: int) -> list[int]:
    return np.cumsum(np.bincount(group, minlength=n)).tolist()


@dataclass
class Attention:
    p: dict[str, np.ndarray]
    place: np.ndarray  # of each id in the order of bytes

    @staticmethod
    def fresh(v: Vocabulary, rng: np.random.Generator, count: np.ndarray | None = None) -> Attention:
        """Biases begin at the ids' counts."""
        order = sorted(range(IDS), key=lambda i: bytes(v.blob[v.start[i] : v.start[i] + v.size[i]])) + [END, PAD]
        place = np.empty(ALL, np.int64)
        place[order] = np.arange(ALL)
        n = lambda *s, by=0.1: (rng.standard_normal(s) * by).astype(np.float32)
        p = {"q": n(ALL, WIDTH), "k": n(ALL, WIDTH), "v": n(ALL, WIDTH), "x": n(ALL, HIDDEN), "y": n(ALL, HIDDEN), "w": n(WIDTH, HIDDEN, by=0.3)}
        p |= {"far": np.zeros(2 * SPAN, np.float32), "b": np.zeros(HIDDEN, np.float32)}
        for k in FIXED:
            p[k][:, 0] = 0
        p["b"][0] = 1
        share = np.full(ALL, 0.1)
        share[place] += 0 if count is None else count
        for d in range(STEPS_DEEP):
            p[f"o{d}"] = n(WAYS**d, HIDDEN, WAYS)
            s = share.reshape(WAYS**d, WAYS, -1).sum(2)
            p[f"o{d}"][:, 0] = np.log(s / s.sum(1, keepdims=True))
        return Attention(p, place)

    def steps(self, target: np.ndarray) -> list[tuple[str, np.ndarray, np.ndarray]]:
        """For each step: its weights' name, the group that a target's place lies in, its digit there."""
        at = self.place[target]
        return [(f"o{d}", at // WAYS ** (STEPS_DEEP - d), at // WAYS ** (STEPS_DEEP - d - 1) % WAYS) for d in range(STEPS_DEEP)]

    def ready(self) -> Attention:
        """For scoring: the factors of the exponentials are put into the weights once."""
        p = dict(self.p)
        p["q"] = p["q"] * (SCALE / np.float32(math.sqrt(WIDTH)))
        p["bias"] = np.where(_MASK >= 0, p["far"][np.maximum(_MASK, 0)], np.float32(-40.0)) * SCALE + SHIFT
        for d in range(STEPS_DEEP):
            p[f"o{d}"] = p[f"o{d}"] * SCALE
            p[f"o{d}"][:, 0] += SHIFT
        p["x"] = p["x"] + p["b"]
        p["kv"] = np.concatenate([p.pop("k"), p.pop("v")], 1)
        return Attention({k: np.ascontiguousarray(v, np.float32) for k, v in p.items()}, self.place)

    def probability(self, ids: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of each target (windows, SPAN), by a model that is ``ready``."""
        n = target.size
        h = _scratch("h", (n, HIDDEN))
        for i in range(0, len(ids), AT_ONCE):
            self._attend(ids[i : i + AT_ONCE], h[i * SPAN : (i + AT_ONCE) * SPAN])
        np.clip(h, 0, TOP, out=h)
        goal = target.ravel()
        order = np.argsort((self.place[goal] // WAYS).astype(np.uint16), kind="stable")
        hs = np.take(h, order, 0, _scratch("hs", (n, HIDDEN)), "clip")
        e, digits = _scratch("e", (STEPS_DEEP, n, WAYS)), []
        for d, (name, group, digit) in enumerate(self.steps(goal[order])):
            i = 0
            for c, j in enumerate(_ends(group, WAYS**d)):  # the rows of one group are one product
                if i < j:
                    np.matmul(hs[i:j], self.p[name][c], out=e[d, i:j])
                i = j
            digits.append(digit)
        e = bits_exp(e, "ee")
        own = e[np.arange(STEPS_DEEP)[:, None], np.arange(n)[None, :], np.array(digits)]
        own /= (e.reshape(-1, WAYS) @ np.ones(WAYS, np.float32)).reshape(STEPS_DEEP, n)
        out = np.empty(n, np.float32)
        out[order] = own.prod(0)
        return out.reshape(target.shape)

    def _attend(self, ids: np.ndarray, h: np.ndarray) -> None:
        """Writes the hidden values of the windows' last halves, not yet cut off, to h."""
        p, n, own = self.p, len(ids), ids[:, SPAN:]
        take = lambda w, at, name: np.take(p[w], at, 0, _scratch(name, (*at.shape, p[w].shape[1])), "clip")
        kv = take("kv", ids, "kv")
        s = np.matmul(take("q", own, "q"), kv[..., :WIDTH].transpose(0, 2, 1), out=_scratch("s", (n, SPAN, 2 * SPAN)))
        s += p["bias"]
        a = bits_exp(s, "a")
        z = np.matmul(a, kv[..., WIDTH:], out=_scratch("z", (n, SPAN, WIDTH))).reshape(n * SPAN, WIDTH)
        z /= (a.reshape(n * SPAN, -1) @ np.ones(2 * SPAN, np.float32))[:, None]
        np.matmul(z, p["w"], out=h)
        h += take("x", own, "x").reshape(h.shape)
        h += take("y", ids[:, SPAN - 1 : -1], "y").reshape(h.shape)

    def gradient(self, ids: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean loss of the real targets, and its gradient. ids: rows of the tables, (windows, 2 * SPAN)."""
        p, n, own, goal = self.p, len(ids), ids[:, SPAN:], self.place[target.ravel()]
        kind, root, size = p["w"].dtype.type, np.float32(1 / math.sqrt(WIDTH)), n * SPAN
        scratch = lambda name, shape: _scratch(name, shape, kind)
        take = lambda w, at, name: np.take(p[w], at, 0, scratch(name, (*at.shape, p[w].shape[1])), "clip")
        q, k, v = take("q", own, "q"), take("k", ids, "k"), take("v", ids, "v")
        q *= root
        bias = np.where(_MASK >= 0, p["far"][np.maximum(_MASK, 0)], np.float32(-40.0))
        a, z, share = scratch("a", (n, SPAN, 2 * SPAN)), scratch("z", (n, SPAN, WIDTH)), scratch("share", (n, SPAN, 1))
        pieces = [slice(i, i + IN_CACHE) for i in range(0, n, IN_CACHE)]
        for r in pieces:  # a are exponentials: what they are multiplied with is divided by their sums
            np.matmul(q[r], k[r].transpose(0, 2, 1), out=a[r])
            a[r] += bias
            np.divide(1, _exps(a[r]), out=share[r].reshape(-1))
            np.matmul(a[r], v[r], out=z[r])
        z *= share
        flat_z = z.reshape(size, WIDTH)
        h = np.matmul(flat_z, p["w"], out=scratch("h", (size, HIDDEN)))
        h += np.take(p["x"] + p["b"], own.ravel(), 0, scratch("t", h.shape), "clip")
        h += take("y", ids[:, SPAN - 1 : -1].ravel(), "t")
        np.clip(h, 0, TOP, out=h)

        real = np.flatnonzero(target.ravel() != PAD)  # in the order of their targets' places
        real = real[np.argsort(goal[real].astype(np.uint16), kind="stable")]
        goal, m = goal[real], len(real)
        first = _firsts(goal // WAYS)
        group = goal[first] // WAYS  # the targets of one are of one group in each step: the steps are one product
        w = np.concatenate([p[f"o{d}"][group // WAYS ** (STEPS_DEEP - d - 1)] for d in range(STEPS_DEEP)], 2)
        parts = list(zip(range(len(first)), first.tolist(), [*first[1:].tolist(), m]))
        hs = np.take(h, real, 0, scratch("hs", (m, HIDDEN)), "clip")
        e, dhs, dw = scratch("e", (m, STEPS_DEEP * WAYS)), scratch("dhs", hs.shape), scratch("dw", w.shape)
        for c, i, j in parts:
            np.dot(hs[i:j], w[c], out=e[i:j])
        sums, of_one = _exps(e.reshape(m, STEPS_DEEP, WAYS)).reshape(m, STEPS_DEEP), kind(1 / max(1, m))
        digits = np.stack([goal // WAYS ** (STEPS_DEEP - d - 1) % WAYS for d in range(STEPS_DEEP)], 1)
        at = np.arange(0, e.size, WAYS).reshape(digits.shape) + digits
        said = np.take(e, at, mode="clip") / sums
        loss = -np.log(said.prod(1) + 1e-30).sum() * of_one
        np.divide(of_one, sums, out=sums)
        by_step = e.reshape(-1, WAYS)
        by_step *= sums.reshape(-1, 1)
        e.ravel()[at] = (said - 1) * of_one
        for c, i, j in parts:
            np.dot(hs[i:j].T, e[i:j], out=dw[c])
            np.dot(e[i:j], w[c].T, out=dhs[i:j])
        dhs *= (hs > 0) & (hs < TOP)
        dhs[:, 0] = 0
        grad = {}
        for d in range(STEPS_DEEP):
            own_dw, over, g = dw[..., d * WAYS : (d + 1) * WAYS], group // WAYS ** (STEPS_DEEP - d - 1), np.zeros_like(p[f"o{d}"])
            if d == STEPS_DEEP - 1:
                g[over] = own_dw
            else:
                begin = _firsts(over).tolist()
                for i, j in zip(begin, [*begin[1:], len(over)]):
                    g[over[i]] = own_dw[i:j].sum(0)
            grad[f"o{d}"] = g

        dh = scratch("dh", (size + 1, HIDDEN))  # the last row is of no place
        dh[:] = 0
        dh[real] = dhs
        grad["b"], grad["w"] = np.ones(size, kind) @ dh[:size], flat_z.T @ dh[:size]
        dz = np.matmul(dh[:size], p["w"].T, out=scratch("dz", (size, WIDTH)))
        less = np.einsum("ij,ij->i", dz, flat_z).reshape(share.shape) * share
        dz = dz.reshape(z.shape)
        dz *= share
        dq, dkv = scratch("dq", q.shape), scratch("dkv", (n, 2 * SPAN, 2 * WIDTH))
        far = np.zeros_like(bias)
        for r in pieces:
            np.matmul(a[r].transpose(0, 2, 1), dz[r], out=dkv[r, :, WIDTH:])
            ds = np.matmul(dz[r], v[r].transpose(0, 2, 1), out=scratch("ds", a[r].shape))
            ds -= less[r]
            ds *= a[r]
            far += ds.sum(0)
            np.matmul(ds.transpose(0, 2, 1), q[r], out=dkv[r, :, :WIDTH])
            np.matmul(ds, k[r], out=dq[r])
        grad["far"] = np.bincount(np.maximum(_MASK, 0).ravel(), (far * (_MASK >= 0)).ravel(), 2 * SPAN).astype(np.float32)

        # Where a window goes on from the one before, its first half is that one's last: their sums by place
        # come before the sums by id.
        on = (ids[1:, :SPAN] == ids[:-1, SPAN:]).all(1)
        last, begin = np.flatnonzero(np.append(~on, True)), np.flatnonzero(np.append(True, ~on))
        every, after = np.arange(size), np.arange(1, size + 1)
        after[last * SPAN + SPAN - 1] = size
        both = scratch("both", (n, SPAN, 2 * WIDTH))
        np.add(dkv[:-1, SPAN:], dkv[1:, :SPAN], out=both[:-1])
        both[last] = dkv[last, SPAN:]
        same = _same(own.ravel())
        total = {w: np.zeros((len(p["x"]), i), kind) for w, i in (("x", HIDDEN), ("y", HIDDEN), ("q", WIDTH), ("kv", 2 * WIDTH))}
        _sum_rows(same, dh, every, total["x"])
        _sum_rows(same, dh, after, total["y"])
        _sum_rows(same, dq.reshape(size, WIDTH), every, total["q"])
        _sum_rows(same, both.reshape(size, 2 * WIDTH), every, total["kv"])
        _sum_rows(_same(ids[begin, SPAN - 1]), dh, begin * SPAN, total["y"])
        _sum_rows(_same(ids[begin, :SPAN].ravel()), dkv.reshape(-1, 2 * WIDTH), (begin[:, None] * 2 * SPAN + np.arange(SPAN)).ravel(), total["kv"])
        total["q"] *= root
        kv = total.pop("kv")
        return loss, grad | total | {"k": kv[:, :WIDTH], "v": kv[:, WIDTH:]}

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def filled(self, values: np.ndarray) -> Attention:
        """A model of the same form out of what ``flat`` gives."""
        p, i = {}, 0
        for k in sorted(self.p):
            a = self.p[k]
            p[k], i = values[i : i + a.size].reshape(a.shape).astype(np.float32), i + a.size
        return Attention(p, self.place)


def _exps(x: np.ndarray) -> np.ndarray:
    """Exponentials, in place, and their sums over the last axis. What would leave the floats' range is cut off."""
    np.clip(x, -60, 60, out=x)
    np.exp(x, out=x)
    return x.reshape(-1, x.shape[-1]) @ np.ones(x.shape[-1], x.dtype)


class Adam:
    """Steps from a model on. Of the tables it holds the rows of ids met so far: those of others have no
    gradient and stay as they are."""

    def __init__(self, begin: Attention):
        self.begin, self.step, self.ids, self.row = begin, 0, np.empty(0, np.int64), np.full(ALL, -1)
        self.model = Attention({k: a[:0] if k in ROWS else a.copy() for k, a in begin.p.items()}, begin.place)
        self.first, self.second, self.mean = ({k: np.zeros_like(a) for k, a in self.model.p.items()} for _ in range(3))

    def rows(self, ids: np.ndarray) -> np.ndarray:
        """Where the ids' rows are."""
        new = np.flatnonzero((np.bincount(ids.ravel(), minlength=ALL) > 0) & (self.row < 0))
        self.row[new] = len(self.ids) + np.arange(len(new))
        self.ids = np.concatenate([self.ids, new])
        for k in ROWS if len(new) else ():
            own = self.begin.p[k][new]
            for held, more in ((self.model.p, own), (self.mean, own), (self.first, 0 * own), (self.second, 0 * own)):
                held[k] = np.concatenate([held[k], more])
        return self.row[ids]

    def whole(self, held: dict[str, np.ndarray]) -> Attention:
        """The model of all ids, by ``mean`` or the weights of ``model``."""
        p = {k: a.copy() for k, a in self.begin.p.items()}
        for k, a in held.items():
            p[k][self.ids if k in ROWS else slice(None)] = a
        return Attention(p, self.begin.place)

    def __call__(self, ids: np.ndarray, target: np.ndarray, rate: float) -> None:
        self.step += 1
        pace, root = np.float32(rate / (1 - 0.9**self.step)), np.float32(1 / math.sqrt(1 - 0.99**self.step))
        for k, g in self.model.gradient(ids, target)[1].items():
            first, second, t = self.first[k], self.second[k], _scratch("adam", g.shape)
            first *= np.float32(0.9)
            first += np.multiply(g, np.float32(0.1), out=t)
            second *= np.float32(0.99)
            np.multiply(g, g, out=t)
            t *= np.float32(0.01)
            second += t
            np.sqrt(second, out=t)
            t *= root
            t += np.float32(1e-8)
            np.divide(first, t, out=t)
            t *= pace
            self.model.p[k] -= t

    def into_mean(self, share: float) -> None:
        for k, a in self.mean.items():
            t = np.subtract(self.model.p[k], a, out=_scratch("adam", a.shape))
            t *= np.float32(share)
            a += t


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])[: len(x)])


def _same(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that brings equal ids together, where each id's begin, and the ids."""
    own = ids.astype(np.uint16)
    order = np.argsort(own, kind="stable")
    i = own[order]
    first = _firsts(i)
    return order, first, i[first]


def _sum_rows(same: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
    """Adds to each id's row in out the sum of its rows of x. at: where in x the row of each place is."""
    order, first, ids = same
    if len(first):
        rows = np.take(x, at[order], 0, _scratch("sorted", (len(order), x.shape[1]), x.dtype.type), "clip")
        out[ids] += np.add.reduceat(rows, first, axis=0)


def windows(flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts' ids, one text after another (each ends with END): windows, targets, and places of
    the real targets. A text's inputs are END and all its ids but the last; PAD fill the window before.
    """
    blocks = -(-size // SPAN)
    at, ends = np.cumsum(blocks) - blocks, np.cumsum(size)
    target = np.full(int(blocks.sum()) * SPAN, PAD, np.int64)
    ids = np.full(len(target), PAD, np.int64)
    where = np.repeat(at * SPAN - (ends - size), size) + np.arange(int(size.sum()))
    target[where] = flat
    before = np.concatenate([[END], flat[:-1]])
    before[ends[:-1]] = END
    ids[where] = before
    ids = ids.reshape(-1, SPAN)
    left = np.concatenate([np.full((1, SPAN), PAD), ids[:-1]])
    left[at] = PAD
    return np.concatenate([left, ids], 1), target.reshape(-1, SPAN), where


class Spelling(dict):
    """Words' numbers; their ids, one after another in ``flat``; how often each was seen."""

    def __init__(self, v: Vocabulary):
        self.cut = tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=v.rank, special_tokens={})._encode_single_piece
        self.reset()

    def reset(self):
        self.clear()
        self.flat, self.start, self.size = np.array([END], np.int32), np.zeros(1, np.int64), np.ones(1, np.int64)
        self.count, self.new = np.zeros(1, np.int64), []
        self[b""] = 0  # no word is empty: this is the end

    def __missing__(self, w: bytes) -> int:
        self.new.append(b" " + w)
        self[w] = n = len(self)
        return n

    def __call__(self, each: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of all words, all ids, and how many of these each text has. Each list ends in b""."""
        n = np.fromiter(map(len, each), np.int64, len(each))
        number = np.fromiter(map(self.__getitem__, chain.from_iterable(each)), np.int64, int(n.sum()))
        if self.new:
            ids = [self.cut(w) for w in self.new]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))])
            self.count = np.concatenate([self.count, np.zeros(len(ids), np.int64)])
            self.new = []
        size = self.size[number]
        return number, _gather(self.flat, self.start[number], size), np.add.reduceat(size, np.cumsum(n) - n)


def vocabulary(data: bytes) -> Vocabulary:
    """The public ranks below IDS: a byte-level vocabulary of its own right."""
    return Vocabulary(b"\n".join(x for x in data.splitlines() if x and int(x.split()[1]) < IDS))


class Words:
    """The words of ids. Each begins with a space, and END has no bytes."""

    def __init__(self, v: Vocabulary):
        self.size, self.start, self.blob = np.append(v.size, 0), np.append(v.start, 0), v.blob

    def __call__(self, flat: np.ndarray) -> list[bytes]:
        return _gather(self.blob, self.start[flat], self.size[flat]).tobytes().split(b" ")[1:]


def id_probabilities(model: Attention, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each id of texts, by a model that is ``ready``."""
    ids, target, where = windows(flat, size)
    step = ROWS_AT_ONCE
    return np.concatenate([model.probability(ids[i : i + step], target[i : i + step]) for i in range(0, len(ids), step)]).ravel()[where]


def train(seqs: list[np.ndarray], data: bytes, seed: int = 5, count: np.ndarray | None = None) -> Attention:
    """The first fit, on the texts' ids. count: of each id in all texts, if these are not all."""
    rng = np.random.default_rng(seed)
    flat = np.concatenate([np.empty(0, np.int64), *seqs])
    model = Attention.fresh(vocabulary(data), rng, np.bincount(flat, minlength=ALL) if count is None else count)
    if len(seqs):
        x, y, _ = windows(flat, np.array(list(map(len, seqs))))
        adam = Adam(model)
        x = adam.rows(x)
        for step in range(1, STEPS + 1):
            pick = rng.integers(0, len(x), BATCH)
            adam(x[pick], y[pick], 0.02 * min(1.0, step / 30) * (1 - 0.8 * step / STEPS))
        model = adam.whole(adam.model.p)
    return model


def learn(ids: DataFrame, model: Attention) -> Attention:
    """Goes on from ``model`` in each task over LEARN of its windows; the average of the tasks' models.
    ids: (row, ids binary)."""
    shared = ids.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        adam, rng, weight = Adam(shared.value), np.random.default_rng(TaskContext.get().partitionId()), 0
        x, y = np.empty((0, 2 * SPAN), np.int64), np.empty((0, SPAN), np.int64)

        def step():
            nonlocal x, y, weight
            own, x = x[:PACE], x[PACE:]
            adam(own, y[:PACE], RATE)
            y, weight = y[PACE:], weight + len(own)
            adam.into_mean(len(own) / weight)

        for b in slices(batches, 256, ID_BYTES):
            seqs = [np.frombuffer(i, np.int16) for i in b.column(1).to_pylist()]
            all_x, all_y, _ = windows(np.concatenate(seqs).astype(np.int64), np.array(list(map(len, seqs))))
            pick = np.flatnonzero(rng.random(len(all_x)) < LEARN)
            all_x, all_y = (all_x, all_y) if len(pick) == len(all_x) else (all_x[pick], all_y[pick])
            x, y = np.concatenate([x, adam.rows(all_x)]), np.concatenate([y, all_y])
            while len(x) >= PACE:
                step()
        if len(x):
            step()
        if weight:
            out = adam.whole(adam.mean).flat().astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out * weight), pa.array(np.full(len(out), float(weight)))], names=["at", "sum", "weight"])

    ship(ids.sparkSession)
    parts = ids.select("row", "ids").mapInArrow(run, "at int, sum double, weight double")
    got = parts.groupBy("at").agg((F.sum("sum") / F.sum("weight")).alias("value")).toArrow()  # a row a weight of the model
    if not got.num_rows:
        return model
    values = model.flat()
    values[got.column("at").to_numpy()] = got.column("value").to_numpy()
    return model.filled(values)


TEXT, WORD, ID = 0, 1, 2
SPELLED = "kind int, row long, doc_id long, train boolean, n long, ids binary, word binary"


def spelled(docs: DataFrame, condition: Column, data: bytes) -> DataFrame:
    """Rows of three kinds: TEXT (row, doc_id, train, n words and the end, ids of 16 bits), and the tasks'
    counts over the documents that the condition allows: WORD (word, n; b"" is the end), ID (row: the id, n)."""
    shared = docs.sparkSession.sparkContext.broadcast(data)
    names = [f.split()[0] for f in SPELLED.split(", ")]
    kinds = dict(zip(names, [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()]))

    def batch(kind: int, **cols) -> pa.RecordBatch:
        size = len(cols["n"])
        cols["kind"] = pa.array(np.full(size, kind, np.int32))
        return pa.RecordBatch.from_arrays([cols[c] if c in cols else pa.nulls(size, kinds[c]) for c in names], names=names)

    def words(spell: Spelling) -> Iterator[pa.RecordBatch]:
        seen = np.flatnonzero(spell.count)
        all_ = list(spell)
        for i in range(0, len(seen), 1 << 16):
            at = seen[i : i + (1 << 16)]
            yield batch(WORD, word=pa.array([all_[j] for j in at.tolist()], pa.binary()), n=pa.array(spell.count[at]))

    def run(batches):
        spell = Spelling(vocabulary(shared.value))
        row, seen = TaskContext.get().partitionId() << 36, np.zeros(ALL, np.int64)
        for b in slices(batches, 1024, TEXT_BYTES):
            if len(spell) > MEMO:
                yield from words(spell)
                spell.reset()
            each = [[*words_of(raw), b""] for raw in b.column(1).to_pylist()]
            number, flat, size = spell(each)
            n = np.fromiter(map(len, each), np.int64, len(each))
            own = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            spell.count += np.bincount(number[np.repeat(own, n)], minlength=len(spell))
            seen += np.bincount(flat[np.repeat(own, size)], minlength=ALL)
            ends = np.concatenate([[0], np.cumsum(size) * 2]).astype(np.int32)
            ids = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(flat.astype(np.int16))])
            yield batch(TEXT, row=pa.array(row + np.arange(len(n))), doc_id=b.column(0), train=b.column(2), n=pa.array(n), ids=ids)
            row += len(n)
        yield from words(spell)
        some = np.flatnonzero(seen)
        yield batch(ID, row=pa.array(some), n=pa.array(seen[some]))

    ship(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"), F.coalesce(condition, F.lit(False)).alias("train"))
    return own.mapInArrow(run, SPELLED)


def language_scores(docs: DataFrame, condition: Column, path: str) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score), a row for each row of ``docs``."""
    spark = docs.sparkSession
    data = _read(path)
    table = stash(spelled(docs, condition, data), "spelled")
    counts = stash(table.where(F.col("kind") == WORD).groupBy("word").agg(F.sum("n").alias("c")), "counts")
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.max(F.when(F.length("word") == 0, F.col("c"))), F.lit(0)).alias("end")).first()
    room = sums["n"] + ADD * (sums["v"] + 1)
    top = counts.orderBy(F.desc("c"), "word").limit(FREQUENT).toArrow()
    known = dict(zip(top.column("word").to_pylist(), top.column("c").to_pylist()))
    own = table.where(F.col("kind") == TEXT)
    draw = F.pmod(F.xxhash64("doc_id", "ids"), F.lit(1_000_000)) / 1e6
    rows = own.where(F.col("train") & (draw < min(1.0, SAMPLE / max(sums["end"], 1)))).select("ids", draw.alias("draw")).toArrow().to_pylist()
    sample = [np.frombuffer(r["ids"], np.int16).astype(np.int64) for r in sorted(rows, key=lambda r: (r["draw"], r["ids"]))]
    each = table.where(F.col("kind") == ID).groupBy("row").agg(F.sum("n").alias("n")).toArrow()  # 4,096 ids at most
    model = learn(own.where("train"), train(sample, data, count=np.bincount(each.column("row").to_numpy(), each.column("n").to_numpy(), ALL)))
    shared = spark.sparkContext.broadcast((model.ready(), data, known, int(sums["end"]), room, len(top) >= FREQUENT))

    def run(batches):
        m, d, c, end, r, more = shared.value
        words = Words(vocabulary(d))
        for b in slices(batches, 256, ID_BYTES):
            n = b.column(2).to_numpy()
            ids = b.column(3)
            size = pc.binary_length(ids).to_numpy().astype(np.int64) // 2
            flat = np.frombuffer(b"".join(ids.to_pylist()), np.int16).astype(np.int64)
            score = np.add.reduceat(np.log10(id_probabilities(m, flat, size) + np.float32(1e-35), dtype=np.float64), np.cumsum(size) - size)
            all_ = words(flat)
            at = np.cumsum(n) - n
            cs = np.full(int(n.sum()), float(end))
            real = np.ones(len(cs), bool)
            real[at + n - 1] = False
            cs[real] = np.fromiter(map(c.get, all_, repeat(0)), np.float64, len(all_))
            base, rare = np.log10((cs + ADD) / r), (cs == 0) & more & real
            base[rare] = 0
            left = pa.array([all_[i] for i in np.flatnonzero(rare[real]).tolist()], pa.binary())
            ends = np.concatenate([[0], np.cumsum(np.add.reduceat(rare.astype(np.int64), at))]).astype(np.int32)
            sums_ = [pa.array(np.add.reduceat(x, at)) for x in ((cs > 0).astype(np.int64), base)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *sums_, pa.array(score), pa.ListArray.from_arrays(pa.array(ends), left)], names=["row", "doc_id", "n", "k", "base", "score", "rare"])

    ship(spark)
    own = own.select("row", "doc_id", "n", "ids").mapInArrow(run, "row long, doc_id long, n long, k long, base double, score double, rare array<binary>")
    own = stash(own, "scores")
    rare = own.select("row", F.explode("rare").alias("word")).join(counts, "word", "left")
    rare = rare.groupBy("row").agg(F.sum((F.col("c") > 0).cast("long")).alias("k2"), F.sum(F.log10((F.coalesce("c", F.lit(0)) + ADD) / room)).alias("base2"))
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return own.drop("rare").join(rare, "row", "left").select(
        "doc_id", F.col("n").alias("n_tokens"), plus("k", "k2").alias("n_known"), F.lit(sums["n"]).cast("long").alias("train_tokens"),
        plus("base", "base2").alias("base_score"), "score",
    )
