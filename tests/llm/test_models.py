"""Operators that learn: held-out results, brute force and edge cases."""

import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tracewell.llm import ann, byte_pairs, language_id, language_model, queries, toxicity
from tracewell.llm.common import remainder
from tracewell.llm.near_dups import words_of
from tracewell.llm.shards import Conflict, ShardStore, store_by_arrivals

SYLLABLES = {"en": "th on er in the ing of re st", "de": "sch ung ein der ich tz pf keit", "es": "ción os ar la que ña mente do"}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_id(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang := rng.choice(list(SYLLABLES)), rng.randint(4, 60)), lang) for i in range(300)]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "123 !!", "de"), (1003, "some text", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1)).repartition(3)
    got = {r["doc_id"]: r for r in language_id.identify(df, remainder("doc_id", 4) != 2).collect()}
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and len(got) == len(rows)
    held = [i for i, _, _ in rows[:300] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i]["lang_pred"] == rows[i][2] for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = language_id.identify(df.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert language_id.identify(df.limit(0), F.lit(True)).count() == 0


def test_toxicity(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        w, toxic = prose(rng, rng.choice(list(SYLLABLES)), rng.randint(10, 60)).split(), rng.random() < 0.2
        if toxic:
            at = rng.randrange(len(w))
            w[at:at] = [rng.choice(["vilor", "vilank", "grubot", "skarn"]) + rng.choice(["", "s", "ed"]) for _ in range(3)]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    rows += [(2000, None), (2001, ""), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit(9)).repartition(3)
    marks = spark.createDataFrame([*labels, (1, 1, None), (None, 1, 1), (5000, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, marks, toxicity.trained()).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i]["predicted"] == labels[i][2] for i in held]) > 0.95
    assert got[2000]["score"] == got[2001]["score"] and got[2000]["predicted"] == 0
    assert {r["predicted"] for r in toxicity.toxicity(docs, marks.limit(0)).collect()} == {0}
    assert toxicity.toxicity(docs.limit(0), marks).count() == 0


def test_segments_like_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(300):
        s = rng.integers(-3, 4, rng.integers(1, 14)).astype(float)

        def parts(a, z):
            """The best stretch (the shortest, then first, of equal ones), then both sides of it."""
            all_ = [(-s[i:j].sum(), j - i, i, j) for i in range(a, z) for j in range(i + 1, z + 1)]
            if not all_ or -min(all_)[0] <= 0:
                return []
            x, _, i, j = min(all_)
            return [*parts(a, i), (i, j, -x), *parts(j, z)]

        assert sum(x for _, _, x in toxicity.segments(s)) == sum(x for _, _, x in parts(0, len(s)))
        assert max((x for _, _, x in toxicity.segments(s)), default=0) == max((x for _, _, x in parts(0, len(s))), default=0)


def test_language_model(spark, monkeypatch):
    monkeypatch.setattr(language_model, "STEPS", 150)
    monkeypatch.setattr(language_model, "FREQUENT", 400)
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.choice(list(SYLLABLES)), rng.randint(1, 90)).replace("the", "The")) for i in range(250)] + [(900, None), (901, " \n"), (3, "the the")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("c", F.lit(1)).withColumn("score", F.lit(1)).repartition(3)
    count, train = Counter(), lambda i: zlib.crc32(str(i).encode()) % 10 != 0
    split = lambda t: [*words_of((t or "").encode()), b""]
    for i, t in rows:
        if train(i):
            count.update(split(t))
    n, v = sum(count.values()), len(count)
    want = sorted((i, len(w), sum(count[x] > 0 for x in w), round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for i, w in ((i, split(t)) for i, t in rows))
    got = language_model.language_scores(df, remainder("doc_id", 10) != 0, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n and math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    held = [r for r in got if not train(r["doc_id"])]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert language_model.language_scores(df.limit(0), F.lit(True), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).count() == 0


def merges():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read()


def test_attention_is_causal_and_sums_to_one():
    rng = np.random.default_rng(0)
    m = language_model.Attention.fresh(language_model.vocabulary(merges()), rng)
    ids, target, where = language_model.windows(rng.integers(0, 200, 103), np.array([70, 1, 32]))
    assert len(where) == 103 and (target.ravel()[where] != language_model.PAD).all()
    ready = m.ready()
    a = ready.probability(ids, target)
    other = ids.copy()
    other[:, -1] = 7  # the last id of a window is not seen by the positions before it
    assert np.allclose(a[:, :-1], ready.probability(other, target)[:, :-1])
    one = np.repeat(ids[:1], language_model.ALL, 0)
    all_ = np.repeat(target[:1], language_model.ALL, 0)
    all_[:, 3] = np.arange(language_model.ALL)
    assert abs(ready.probability(one, all_)[:, 3].astype(float).sum() - 1) < 1e-3
    for k in ("q", "far", "w", "o0", "o1", "o2", "y", "v", "k"):
        m.p = {k: a.astype(np.float64) for k, a in m.p.items()}
        loss, grad = m.gradient(ids, target)
        at = np.unravel_index(np.abs(grad[k]).argmax(), grad[k].shape)
        m.p[k][at] += 1e-4
        up = m.gradient(ids, target)[0]
        m.p[k][at] -= 2e-4
        down = m.gradient(ids, target)[0]
        m.p[k][at] += 1e-4
        assert abs((up - down) / 2e-4 - grad[k][at]) < 0.02 * abs(grad[k][at]) + 1e-6, k


def test_a_trained_model_is_a_distribution(monkeypatch):
    """After several contexts, the probabilities of all ids sum to 1; so those of all words sum to less."""
    monkeypatch.setattr(language_model, "STEPS", 80)
    rng, data = random.Random(4), merges()
    v = language_model.vocabulary(data)
    _, flat, size = language_model.Spelling(v)([[*prose(rng, "en", 40).encode().split(), b""] for _ in range(120)])
    seqs = np.split(flat.astype(np.int64), np.cumsum(size)[:-1])
    ready = language_model.train(seqs, data).ready()
    for own in seqs[:3]:
        for cut in (0, 1, 17, 40):
            head = own[:cut]
            tries = np.concatenate([np.append(head, i) for i in range(language_model.ALL)]).astype(np.int64)
            p = language_model.id_probabilities(ready, tries, np.full(language_model.ALL, cut + 1)).reshape(language_model.ALL, -1)
            assert abs(p[:, -1].astype(float).sum() - 1) < 2e-3


def plain_logs(m, own: list[int]) -> list[float]:
    """log10 of each id's probability by the text alone: one position after another, in double precision."""
    p, span, ways = {k: a.astype(np.float64) for k, a in m.p.items()}, language_model.SPAN, language_model.WAYS
    said, out = [language_model.END, *own[:-1]], []
    for t, goal in enumerate(own):
        back = range((t // span - 1) * span, t + 1)  # the whole block before, and this one up to here
        keys = [said[j] if j >= 0 else language_model.PAD for j in back]
        a = np.exp(p["k"][keys] @ p["q"][said[t]] / np.sqrt(language_model.WIDTH) + np.array([p["far"][t - j] for j in back]))
        h = (a / a.sum()) @ p["v"][keys] @ p["w"] + p["x"][said[t]] + p["y"][keys[-2]] + p["b"]
        h, log, group = np.clip(h, 0, float(language_model.TOP)), 0.0, 0
        for d in range(language_model.STEPS_DEEP):
            digit = m.place[goal] // ways ** (language_model.STEPS_DEEP - d - 1) % ways
            e = np.exp(h @ p[f"o{d}"][group])
            log, group = log + np.log10(e[digit] / e.sum()), group * ways + digit
        out.append(log)
    return out


def test_scores_are_those_of_a_plain_reading(spark, monkeypatch):
    """Windows, mask, attention and the three steps, by a loop over positions: to rounding with exact
    exponentials, to their 3 % a factor with the ones that scoring takes."""
    monkeypatch.setattr(language_model, "STEPS", 60)
    rng, data, kept, learn = random.Random(6), merges(), {}, language_model.learn
    texts = [prose(rng, "en", n) for n in (30, 1, 90, 31, 32, 33, 64)] + [None, ""] + [prose(rng, "de", 25) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def keep(ids, model):
        kept["model"] = learn(ids, model)
        return kept["model"]

    monkeypatch.setattr(language_model, "learn", keep)
    got = {r["doc_id"]: r["score"] for r in language_model.language_scores(df, F.col("doc_id") % 5 != 0, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).collect()}
    spell = language_model.Spelling(language_model.vocabulary(data))
    _, flat, size = spell([[*words_of((t or "").encode()), b""] for t in texts])
    flat, model = flat.astype(np.int64), kept["model"]
    plain = [plain_logs(model, own.tolist()) for own in np.split(flat, np.cumsum(size)[:-1])]
    for i, logs in enumerate(plain):
        assert abs(got[i] - sum(logs)) < 0.02 * len(logs), i
    exact = lambda x, name: np.exp((x.astype(np.float64) - float(language_model.SHIFT)) / float(language_model.SCALE)).astype(np.float32)
    monkeypatch.setattr(language_model, "bits_exp", exact)
    p = language_model.id_probabilities(model.ready(), flat, size)
    assert np.allclose(np.log10(p.astype(float)), np.concatenate(plain), atol=2e-3)
    assert max(map(len, plain)) > 3 * language_model.SPAN


def small_windows():
    lengths = np.array([70, 1, 32, 40])
    flat = np.random.default_rng(4).integers(0, 60, lengths.sum()) * 64
    return flat, lengths, *language_model.windows(flat, lengths)[:2]


def test_the_gradient_is_that_of_a_plain_reading():
    """By differences of the plain loss; the same for windows that follow each other and for any order, and
    scores made in between change nothing."""
    rng = np.random.default_rng(3)
    m = language_model.Attention.fresh(language_model.vocabulary(merges()), rng)
    for k, by in (("o0", 0.2), ("o1", 0.2), ("o2", 0.2), ("far", 0.3), ("q", 0.5), ("k", 0.5)):
        m.p[k] += (rng.standard_normal(m.p[k].shape) * by).astype(np.float32)
    m.p = {k: a.astype(np.float64) for k, a in m.p.items()}
    flat, lengths, ids, target = small_windows()
    loss, grad = m.gradient(ids, target)
    plain = lambda: -sum(sum(plain_logs(m, own.tolist())) for own in np.split(flat, np.cumsum(lengths)[:-1])) * math.log(10) / len(flat)
    assert np.isclose(loss, plain(), atol=1e-6)
    for k, g in grad.items():
        top = np.argsort(np.abs(g).ravel())[-4:]
        for at in zip(*np.unravel_index(top, g.shape)):
            was, out = m.p[k][at], []
            for by in (1e-6, -1e-6):
                m.p[k][at] = was + by
                out.append(plain())
            m.p[k][at] = was
            assert np.isclose((out[0] - out[1]) / 2e-6, g[at], rtol=1e-3, atol=1e-6), (k, at)
    scores = m.ready().probability(ids, target)
    order = rng.permutation(len(ids))
    other = m.gradient(ids[order], target[order])[1]
    assert all(np.allclose(g, other[k], atol=1e-6) for k, g in grad.items())
    assert (m.ready().probability(ids, target) == scores).all()


def test_steps_hold_only_the_rows_of_ids_met_and_are_those_of_a_whole_model():
    m = language_model.Attention.fresh(language_model.vocabulary(merges()), np.random.default_rng(3))
    _, _, ids, target = small_windows()
    whole, adam = language_model.Attention({k: a.copy() for k, a in m.p.items()}, m.place), language_model.Adam(m)
    first, second, total = ({k: np.zeros(a.shape) for k, a in m.p.items()} for _ in range(3))
    for n in range(1, 5):
        part = slice(0, 2) if n < 3 else slice(1, None)  # new ids come in the third step
        for k, g in whole.gradient(ids[part], target[part])[1].items():
            first[k], second[k] = first[k] * 0.9 + 0.1 * g, second[k] * 0.99 + 0.01 * np.square(g.astype(float))
            whole.p[k] -= (0.01 * first[k] / (1 - 0.9**n) / (np.sqrt(second[k] / (1 - 0.99**n)) + 1e-8)).astype(np.float32)
            total[k] += whole.p[k]
        adam(adam.rows(ids[part]), target[part], 0.01)
        adam.into_mean(1 / n)
        assert sorted(adam.ids) == sorted(set(ids[: 2 if n < 3 else None].ravel().tolist())) and len(adam.model.p["k"]) == len(adam.ids) < 70
    for k, a in adam.whole(adam.model.p).p.items():
        assert np.allclose(a, whole.p[k], atol=2e-3) and np.abs(a - whole.p[k]).mean() < 1e-5, k
        assert np.abs(adam.whole(adam.mean).p[k] - total[k] / 4).mean() < 1e-5, k


def test_windows_hold_32_ids_of_context():
    ids, target, where = language_model.windows(np.arange(150), np.array([150]))
    span = target.shape[1]
    for place, at in enumerate(where):
        window, i = divmod(int(at), span)
        seen = (ids[window, : span + i + 1] != language_model.PAD).sum()  # the text's start included
        assert seen >= min(place + 1, 33), place


def test_words_come_back_from_ids():
    v = language_model.vocabulary(merges())
    texts = [b"The  red fox\xff\xfe", b"", b" \n", "日本 é\u00a0x".encode(), b"a " * 50]
    each = [[*words_of(t), b""] for t in texts]
    _, flat, size = language_model.Spelling(v)(each)
    assert language_model.Words(v)(flat) == [w for ws in each for w in ws[:-1]] and len(size) == len(texts)


def test_nearest(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1500, 24)) * rng.uniform(0.5, 2, (1500, 1))
    x[100:400] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 24), (5040, [float("nan")] * 24), (5060, [None] + [1.0] * 23), (5080, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("list", F.lit(1)).repartition(4)
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), 20, lists=6).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(got) == list(range(0, 1500, 20))
    hit = []
    for q, found in got.items():
        s = x @ x[q]
        s = np.round(s, 9)
        s[q] = -np.inf
        true = np.lexsort((np.arange(1500), -s))[:20]
        hit.append(len(set(true) & {v for v, _ in found.values()}) / 20)
        assert sorted(found) == list(range(1, 21))
        assert all(abs(p - x[v] @ x[q]) < 1e-9 for v, p in found.values())
        assert [v for v, _ in (found[r] for r in range(1, 21))] == [v for v, _ in sorted(found.values(), key=lambda t: (-t[1], t[0]))]
    assert np.mean(hit) >= 0.9
    assert ann.nearest(df, df, 20).where("query_id > 1500").count() == 0
    few = ann.nearest(df.where("vec_id < 5"), df.where("vec_id = 0"), 20)
    assert [r["rank"] for r in few.orderBy("rank").collect()] == [1, 2, 3, 4]
    assert ann.nearest(df.limit(0), df, 20).count() == 0


def test_shards(spark, tmp_path):
    rows = [(i, "text " * (i % 50), None if i % 9 == 0 else "s") for i in range(2000)] + [(None, None, None), (1, "text ", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tier string").repartition(6)
    store = store_by_arrivals(df, str(tmp_path / "s"), [(0, 3), (3, 4), (4, 5), (5, 8)], 8, 64 << 20)
    assert sorted(map(str, store.read().collect())) == sorted(map(str, df.collect()))
    shards = store.manifest().collect()
    assert len(shards) < 4 and sum(s["n_rows"] for s in shards) == len(rows) and store.version() > 4
    before = store.version()
    assert store.append(df.limit(0)) == before + 1 and len(store.manifest().collect()) == len(shards)
    other = ShardStore(spark, str(tmp_path / "s"), df.schema)
    other.append(df.limit(3))
    try:
        store._commit(before + 1, [])
        raise AssertionError("the second writer must not win")
    except Conflict:
        pass
    assert store.read(before + 1).count() == len(rows) and store.read().count() == len(rows) + 3
    empty = ShardStore(spark, str(tmp_path / "e"), df.schema)
    assert empty.read().count() == 0 and empty.placed().count() == 0


def test_shards_of_two_writers(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(60)], "doc_id long, text string").repartition(3)
    one, two = (ShardStore(spark, str(tmp_path / "w"), df.schema, fan=2) for _ in range(2))
    one.append(df.where("doc_id < 20"))
    files = two._write(df.where("doc_id >= 40"))  # written, not committed yet
    one.append(df.where("doc_id >= 20 and doc_id < 40"))
    one.compact()
    one.vacuum()
    two._add(files)
    ids = lambda d: sorted(r["doc_id"] for r in d.collect())
    assert ids(two.read()) == list(range(60))
    assert ids(two.read(1)) == list(range(20)) and ids(two.read(2)) == list(range(40))  # older versions stay
    sources = one._entries(2)
    merged = two._write(two._read(sources))
    assert one.compact() == one.version() and two._add(merged, sources) is None  # its sources are merged already
    assert ids(two.read()) == list(range(60))
    time.sleep(1.1)
    one.vacuum(keep=1, older_s=1)
    assert ids(one.read()) == list(range(60))
    left = [p for p in (tmp_path / "w" / "data").rglob("*.parquet")]
    assert len(left) == len(one.manifest().collect())


def test_tiers_like_a_plain_reading(spark, tmp_path):
    """The shards' layout after each arrival is what the rules give on a list of sizes."""
    store = ShardStore(spark, str(tmp_path / "t"), spark.createDataFrame([], "x long").schema, target_bytes=40_000, fan=3, least_bytes=1000)
    rng = random.Random(1)
    for n in [50, 400, 60, 70, 3000, 80, 90, 100, 500, 6000, 450]:
        store.append(spark.createDataFrame([(rng.getrandbits(60),) for _ in range(n)], "x long").coalesce(1))
        before = store._entries(store.version())
        store.compact()
        after = store._entries(store.version())
        assert sum(e["n_rows"] for e in after) == sum(e["n_rows"] for e in before)
        for e in after:
            assert e["tier"] == next(t for t in range(20) if e["n_bytes"] <= 1000 * 3**t)
        small = Counter(e["tier"] for e in after if 2 * e["n_bytes"] < 40_000)
        assert all(c < 3 for c in small.values()), small
        was = Counter(e["tier"] for e in before if 2 * e["n_bytes"] < 40_000)
        if all(c < 3 for c in was.values()):
            assert after == before  # nothing to merge: nothing is rewritten


def test_placed(spark, tmp_path):
    df = spark.createDataFrame([(i, "t") for i in range(100)], "doc_id long, text string").repartition(5)
    got = store_by_arrivals(df, str(tmp_path / "p"), [(0, 8)], 8, 1 << 20).placed()
    assert got.groupBy("row.doc_id").count().where("count <> 1").count() == 0 and got.count() == 100
    assert {r["shard_rows"] for r in got.select("shard.shard_rows").distinct().collect()} == {100}


def test_shards_of_clashing_names(spark, tmp_path):
    """Stored columns named as the store's own come back as they were; so do a null id and a long text."""
    names = ["shard_id", "shard_rows", "shard_bytes", "tier", "version", "file", "row", "shard", "name", "n_rows", "n_bytes", "_metadata", "a.b"]
    rows = [(i, "t") for i in range(40)] + [(None, "no id"), (7, "long " * 200_000), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    df = df.select("*", *(F.lit(f"own {c}").alias(c) for c in names))
    d = str(tmp_path / "tables")
    df.write.parquet(f"{d}/documents.parquet")
    store = store_by_arrivals(df, str(tmp_path / "c"), [(0, 4), (4, 8)], 8, 1 << 20)
    got = store.placed().select("row.*", F.col("shard.shard_id").alias("in_shard")).toPandas()
    assert sorted(got["doc_id"].fillna(-1)) == sorted(-1 if i is None else i for i, _ in rows)
    assert all((got[c] == f"own {c}").all() for c in names) and got["in_shard"].notna().all()
    out = queries.op10_shards(spark, d)
    assert out.columns == ["doc_id", "n_bytes", "text_sha256", "shard_id", "shard_rows", "shard_bytes", "tier", "version"]
    assert out.count() == len(rows) and out.agg(F.max("n_bytes")).first()[0] == 1_000_000


def test_words_of_training_texts_are_counted_and_all_texts_spelled(spark):
    data = merges()
    rng = random.Random(8)
    rows = [(i, prose(rng, "en", rng.choice([1, 2, 5, 70]))) for i in range(300)] + [(500, None), (501, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    words = Counter(w for i, t in rows if i % 3 for w in [*words_of((t or "").encode()), b""])
    made = language_model.spelled(df, F.col("doc_id") % 3 != 0, data).collect()
    seen = Counter()
    for r in made:
        if r["kind"] == language_model.WORD:
            seen[bytes(r["word"])] += r["n"]
    assert seen == words
    v, of = language_model.vocabulary(data), dict(rows)
    texts = [r for r in made if r["kind"] == language_model.TEXT]
    assert sorted(r["doc_id"] for r in texts) == sorted(of)
    for r in texts:
        ids = np.frombuffer(r["ids"], np.int16).astype(np.int64)
        assert language_model.Words(v)(ids) == words_of((of[r["doc_id"]] or "").encode()) and ids[-1] == language_model.END
        flat, _ = byte_pairs.encode_pieces(v, [b" " + w for w in words_of((of[r["doc_id"]] or "").encode())])
        assert ids[:-1].tolist() == flat.tolist()  # the same merges as the operator's own


def test_more_training_documents_help_the_score(spark, monkeypatch):
    """The first fit's sample is of one size; what the tasks learn from grows."""
    monkeypatch.setattr(language_model, "STEPS", 30)
    monkeypatch.setattr(language_model, "SAMPLE", 80)
    monkeypatch.setattr(language_model, "LEARN", 1.0)
    rng = random.Random(12)
    words = [f"{a}{b}{c}" for a in "bdgklm" for b in "aeiou" for c in "nrst"]
    follow = {w: rng.sample(words, 2) for w in words}

    def text():
        w = [rng.choice(words)]
        while len(w) < 40:
            w.append(rng.choice(follow[w[-1]]))
        return " ".join(w)

    held = [(i, text()) for i in range(40)]
    gain = []
    for n in (100, 2000):
        df = spark.createDataFrame(held + [(1000 + i, text()) for i in range(n)], "doc_id long, text string")
        got = language_model.language_scores(df, F.col("doc_id") >= 1000, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).where("doc_id < 1000").collect()
        gain.append(sum(r["score"] - r["base_score"] for r in got) / sum(r["n_tokens"] for r in got))
    assert gain[1] > gain[0] + 0.02, gain


def test_every_training_document_is_learned_from(spark, monkeypatch):
    """Whichever document a task has, its ids move the model; the biases begin at all documents' counts."""
    data = merges()
    texts = [f"the {w} fox" for w in ("red", "blue", "old", "sly", "wet", "shy")] + ["the red fox " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    made = language_model.spelled(df, F.col("doc_id") != 0, data).cache()
    own = made.where(F.col("kind") == language_model.TEXT).select("doc_id", "row", "ids").cache()
    ids = {r["doc_id"]: np.frombuffer(r["ids"], np.int16).astype(np.int64) for r in own.collect()}
    count = np.bincount(np.concatenate([ids[i] for i in ids if i]), minlength=language_model.ALL)
    assert Counter({i: n for i, n in enumerate(count.tolist()) if n}) == sum((Counter({r["row"]: r["n"]}) for r in made.where(F.col("kind") == language_model.ID).collect()), Counter())
    start = language_model.train([], data, count=count)
    assert np.isclose(np.exp(start.p["o0"][0, 0]).sum(), 1) and np.argmax(start.p["o0"][0, 0]) == np.argmax(np.bincount(start.place, count).reshape(16, -1).sum(1))
    for i in ids:
        got = language_model.learn(own.where(F.col("doc_id") == i).coalesce(1), start)
        moved = np.flatnonzero((got.p["k"] != start.p["k"]).any(1))
        assert set(ids[i][:-1]) <= set(moved.tolist()), i
    assert (language_model.learn(own.where("doc_id < 0"), start).flat() == start.flat()).all()
    started = []
    monkeypatch.setattr(language_model, "STEPS", 5)
    monkeypatch.setattr(language_model, "SAMPLE", 2)
    monkeypatch.setattr(language_model, "train", lambda seqs, data, count: started.append((len(seqs), count)) or start)
    language_model.language_scores(df, F.col("doc_id") != 0, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    assert started[0][0] < 6 and (started[0][1] == count).all()


def test_very_long_and_repeated_texts_are_scored_whole(spark, monkeypatch):
    monkeypatch.setattr(language_model, "STEPS", 20)
    long_ = "the red fox " * 60_000
    rows = [(1, long_), (1, long_), (2, "the red fox"), (3, "x" * 100_000), (None, "the red fox"), *[(10 + i, "the red fox") for i in range(30)]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = language_model.language_scores(df, F.lit(True), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_tokens"], r["score"]))
    assert len(got) == len(rows) and by[1][0] == (180_001, pytest.approx(by[1][1][1], rel=1e-6)) and by[3][0][0] == 2
    assert by[None][0] == (4, pytest.approx(by[2][0][1], rel=1e-5)) and all(math.isfinite(r["score"]) for r in got)


def test_padding_is_no_target_and_short_texts_are_trained_on(monkeypatch):
    data = merges()
    monkeypatch.setattr(language_model, "STEPS", 60)
    spell = language_model.Spelling(language_model.vocabulary(data))
    _, flat, size = spell([[b"the"] * 200 + [b""], *[[b"red", b"fox", b""]] * 60])
    model = language_model.train(np.split(flat.astype(np.int64), np.cumsum(size)[:-1]), data)
    _, flat, size = spell([[b"red", b"fox", b""]])
    ids, target, where = language_model.windows(flat, size)
    assert np.log(model.ready().probability(ids, target).ravel()[where]).mean() > -1
    _, grad = model.gradient(ids, target)
    at = model.place[language_model.PAD]
    assert grad["o2"][at // language_model.WAYS, 0, at % language_model.WAYS] >= 0  # nothing draws towards padding


def test_many_languages_are_all_learned(spark, monkeypatch):
    """Far more languages than landmarks allow for at full number: each keeps a landmark and texts."""
    monkeypatch.setattr(language_id, "MOST_LANDMARKS", 500)
    monkeypatch.setattr(language_id, "MOST_TRAIN", 600)
    word = lambda i: chr(0x4E00 + 3 * i) + chr(0x4E01 + 3 * i) + chr(0x4E02 + 3 * i)
    rows = [(k * 1000 + i, f"{word(i)} {word(i)}{k}", f"lang{i:03d}") for i in range(260) for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(df, F.lit(True)).collect()}
    assert got == {i: x for i, _, x in rows}


def test_language_of_ties_numbers_long_and_repeated_texts(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, lang := list(SYLLABLES)[i % 3], 30), lang) for i in range(120)]
    long_ = prose(rng, "de", 60_000)
    rows += [(500, "½ ² ① Ⅷ ١", None), (501, long_, None), (501, long_, None), (502, "ß", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {}
    for r in language_id.identify(df, F.col("doc_id") < 500).collect():
        got.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert got[500] == [("und", 0.0)] and len(got[501]) == 2 and got[501][0] == got[501][1] and got[501][0][0] == "de"
    assert got[502][0][0] in SYLLABLES
    same = spark.createDataFrame([(i, "same text", "ba"[i % 2]) for i in range(20)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.identify(same, F.lit(True)).collect()} == {"a"}  # the one that sorts first


def test_language_like_a_plain_kernel_machine():
    """The same predictions from sets, a kernel computed pair by pair and a plain ridge regression."""
    rng = random.Random(7)
    rows = [(prose(rng, lang := list(SYLLABLES)[i % 3], 12), lang) for i in range(60)]
    model = language_id.fit_texts(rows, landmarks=8)
    langs = sorted(SYLLABLES)
    marks = [set(language_id.grams(t).tolist()) for a in langs for t in [t for t, x in rows if x == a][:8]]
    held = Counter(g for m in marks for g in m)
    known = {g for g, n in held.items() if n >= language_id.LEAST}

    def kernel(a, b):
        a, b = a & known, b & known
        return len(a & b) / math.sqrt(max(len(a), 1) * max(len(b), 1))

    k = np.array([[kernel(a, b) for b in marks] for a in marks])
    value, vector = np.linalg.eigh(k)
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    phi = np.array([[kernel(set(language_id.grams(t).tolist()), m) for m in marks] for t, _ in rows]) @ root
    y = np.array([[1.0 if x == a else -1.0 for a in langs] for _, x in rows])
    w = np.full(len(rows), 1 / 20)
    mean, middle = np.average(phi, 0, w), np.average(y, 0, w)
    a = (phi - mean) * np.sqrt(w)[:, None]
    own = np.linalg.solve(a.T @ a + language_id.RIDGE * np.eye(a.shape[1]), a.T @ ((y - middle) * np.sqrt(w)[:, None]))
    texts = [prose(rng, list(SYLLABLES)[i % 3], 9) for i in range(30)]
    new = np.array([[kernel(set(language_id.grams(t).tolist()), m) for m in marks] for t in texts]) @ root
    scores = (new - mean) @ own + middle
    got, _ = language_id.predict_texts(model, language_id.Places(model.codes), texts)
    assert got == [langs[i] for i in scores.argmax(1)]


def test_toxicity_of_ties_long_and_repeated_texts(spark):
    model = toxicity.Model({"vilor": 2.0, "calm": -1.0}, lam=0.8, k=0.05, slope=2.0, base=-4.0, drift=0.1)
    long_ = "calm day " * 60_000 + "vilor vilor vilor " + "calm day " * 60_000
    rows = [(1, long_), (1, long_), (2, "vilor x vilor"), (3, "vilor " * 30_000), (4, None)]
    got = {}
    for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert len(got[1]) == 2 and got[1][0] == got[1][1] and got[1][0]["n_tokens"] == 240_003
    assert [(s["start"], s["end"]) for s in got[1][0]["segments"]] in ([(120_000, 120_003)], []) and got[3][0]["score"] > 0.9
    two = toxicity.segments(np.array([1.0, -3.0, 1.0, -3.0, 1.0]))
    assert two == [(0, 1, 1.0), (2, 3, 1.0), (4, 5, 1.0)]  # equal ones each count


def test_toxicity_like_a_plain_reading(spark):
    """Scores from the fitted model by quadratic search of segments, expected counts and the logistic map."""
    rng = random.Random(9)
    model = toxicity.Model({"bad": 1.5, "worse": 2.5, "good": -1.0, "bad*": 0.7}, lam=0.9, k=0.2, slope=1.7, base=-3.0, drift=0.1)
    words = ["bad", "worse", "good", "x", "y", "BAD", "badly", "badder"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 14))) for _ in range(80)]
    model.scores["badl*"] = 0.4
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score(df, model).collect():
        s = []
        for w in texts[r["doc_id"]].lower().split():
            s.append(next((model.scores[k] for k in (w, *(f"{w[:n]}*" for n in (6, 5, 4) if len(w) >= n)) if k in model.scores), 0.0) - 0.1)

        def parts(a, z):
            tries = [(-round(sum(s[i:j]), 9), j - i, i, j) for i in range(a, z) for j in range(i + 1, z + 1)]
            if not tries or -min(tries)[0] <= 0:
                return []
            x, _, i, j = min(tries)
            return [*parts(a, i), -x, *parts(j, z)]

        x = sum(max(0.0, -math.log(model.k * max(len(s), 1) * math.exp(-model.lam * v))) for v in parts(0, len(s)))
        assert abs(r["score"] - 1 / (1 + math.exp(-(model.slope * math.log1p(x) + model.base)))) < 1e-6, texts[r["doc_id"]]


def test_nearest_of_a_repeated_id(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(80)]
    rows += [(7, [9.0] * 8), (7, [-9.0] * 8), (7, rows[7][1]), (20, rows[20][1]), (33, rows[33][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    first = {i: min(v for j, v in rows if j == i) for i, _ in rows}
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), 5, lists=3, probes=3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for q in (0, 20, 40, 60):
        true = sorted((-sum(a * b for a, b in zip(first[q], v)), i) for i, v in first.items() if i != q)[:5]
        assert [i for _, i in sorted(got[q])] == [i for _, i in true]
