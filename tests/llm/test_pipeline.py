"""The stages one after another, against a plain reading of each stage's decision."""

import base64
import hashlib
import random

import public_tokenizers
import tiktoken

import corpus_pipeline
from tracewell.llm.pseudonyms import Vault
from tracewell.llm.queries import KEY
from test_near_dups import brute


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["th", "on", "er", "ing", "re", "st", "al"]) for _ in range(rng.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n))
    docs, labels = [], []
    for i in range(420):
        t = text(rng.randint(30, 80)).split()
        toxic = i % 5 == 0
        if toxic:
            t[5:5] = ["vilor", "grubot", "skarn", "vilor"]
        docs.append([i, " ".join(t), "en", f"src{i % 3}", 0])
        labels.append((i, 1, int(toxic)))
    item = text(25)
    docs += [[500, f"{text(20)} {item} {text(20)}", "en", "s", 0], [501, f"{text(40)} {' '.join(item.split()[:9])} {text(9)}", "en", "s", 0]]
    docs += [[502, f"{text(30)} mail bob@example.com +1 (229) 555-4838", "en", "s", 0], [503, None, None, None, None], [504, "", "en", "s", 0]]
    docs += [[600 + k, docs[1][1] + (" extra" if k else ""), "en", "s", 0] for k in range(3)]
    for d in docs:
        d[4] = len(d[1]) if d[1] is not None else None
    d = str(tmp_path)
    spark.createDataFrame([tuple(x) for x in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")

    now, kept = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, d)
        out.write.parquet(f"{d}/{name}")
        assert name == "tokens" or out.columns == now.columns
        now = spark.read.parquet(f"{d}/{name}")
        kept[name] = {r["doc_id"]: r for r in now.collect()}

    of = {x[0]: x[1] for x in docs}
    toxic = {i for i, _, t in labels if t}
    first = set(kept["toxicity"])
    assert len(toxic & first) <= 2 and len(first) >= len(of) - len(toxic) - 2
    best = brute([(i, of[i]) for i in sorted(first)], 5, 80)
    second = {i for i, (_, _, k) in best.items() if k}
    assert set(kept["near_duplicates"]) == second and not {600, 601, 602} & second
    assert set(kept["decontamination"]) == second - {500} and 501 in second
    vault = Vault(KEY)
    for i, r in kept["pseudonyms"].items():
        assert r["text"] == (vault.rewrite(of[i])[0] if of[i] else of[i])
        assert r["n_chars"] == (len(r["text"]) if r["text"] is not None else None)
    assert "bob@" not in kept["pseudonyms"][502]["text"] and "555-4838" not in kept["pseudonyms"][502]["text"]
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, r in kept["tokens"].items():
        ids = enc.encode_ordinary(kept["pseudonyms"][i]["text"] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert set(kept["tokens"]) == second - {500}


def test_odd_tables(spark, tmp_path):
    """Columns that clash with the operators' own, repeated rows, nulls, a very long text; then no rows."""
    names = ["n", "sig", "keys", "score", "predicted", "raw", "ids", "n_hit", "kept", "label", "rep", "hash", "row"]
    long_ = "calm words of a long text " * 20_000
    rows = [(1, "one two three four five six", "en"), (1, "one two three four five six", "en"), (None, "without an id at all", None), (2, long_, "en"), (3, None, "en"), (4, "", None), (5, "one two three four five six", "en")]
    for at, docs in (("some", rows), ("none", [])):
        d = str(tmp_path / at)
        df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
        for c in names:
            df = df.selectExpr("*", f"'z' AS {c}")
        df.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        now = spark.read.parquet(f"{d}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, d)
            assert name == "tokens" or out.columns == df.columns
            out.write.parquet(f"{d}/{name}")
            now = spark.read.parquet(f"{d}/{name}")
        got = sorted((r["doc_id"] or 0) for r in now.collect())
        assert got == ([0, 1, 1, 2, 3, 4] if docs else []), got
