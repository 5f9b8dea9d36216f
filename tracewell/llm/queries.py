"""The queries opN_<name> and their SQL."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from . import byte_pairs, sql
from .common import remainder, shared_dir, table
from .decontamination import contaminated, digest
from .ann import nearest
from .language_id import identify
from .language_model import language_scores
from .near_dups import near_duplicates
from .negatives import hard_negatives
from .piece_counts import piece_counts
from .prefix_trie import prefix_trie, respliced, turns_of
from .pseudonyms import pseudonymise
from .shards import store_by_arrivals
from .top_k import top_k
from .toxicity import toxicity, trained

#: The pseudonyms' key in the registered queries. Users pass a secret of their own.
KEY = b"tracewell example key"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")

MULTI_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_toxicity(spark, sf_dir):
    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), trained(3, 1))
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted", F.size("segments").cast("long").alias("n_segments"))


def op2_language_model(spark, sf_dir):
    out = language_scores(table(spark, sf_dir, "documents"), remainder("doc_id", 10) != 0, MULTI_BPE)
    return out.withColumn("held_out", remainder("doc_id", 10) == 0)


def op3_nearest(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op4_near_dups(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op5_byte_pairs(spark, sf_dir):
    return byte_pairs.digest(byte_pairs.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN))


def op6_decontamination(spark, sf_dir):
    return digest(contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10))


def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return identify(docs, remainder("doc_id", 4) != 2).withColumn("held_out", remainder("doc_id", 4) == 2)


def op8_pseudonyms(spark, sf_dir):
    out = pseudonymise(table(spark, sf_dir, "documents"), KEY)
    kinds = F.array_join(F.transform("entities", lambda e: e["kind"]), ",")
    return out.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), kinds.alias("kinds"))


def op9_piece_counts(spark, sf_dir):
    return piece_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_shards(spark, sf_dir):
    """Three eighths of the documents arrive first, then an eighth five times; each row with its shard."""
    root = f"{shared_dir(spark).rstrip('/')}/tracewell/shards-{uuid.uuid4().hex}"
    store = store_by_arrivals(table(spark, sf_dir, "documents"), root, [(0, 3), (3, 4), (4, 5), (5, 6), (6, 7), (7, 8)], 8, 64 << 20)
    rows = store.placed().select("row.doc_id", "row.text", "shard.*")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return rows.select("doc_id", size.alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"), "shard_id", "shard_rows", "shard_bytes", "tier", "version")


def op11_hard_negatives(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op13_prefix_trie(spark, sf_dir):
    turns = turns_of(table(spark, sf_dir, "conversations"))
    return prefix_trie(*respliced(turns, remainder("conv_id", 6), 100))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_language_model": op2_language_model,
    "op3_nearest": op3_nearest,
    "op4_near_dups": op4_near_dups,
    "op5_byte_pairs": op5_byte_pairs,
    "op6_decontamination": op6_decontamination,
    "op7_language_id": op7_language_id,
    "op8_pseudonyms": op8_pseudonyms,
    "op9_piece_counts": op9_piece_counts,
    "op10_shards": op10_shards,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_top_k": op12_top_k,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE_SQL: dict[str, str] = {
    "op4_near_dups": sql.near_dups(2, 80),
    "op6_decontamination": sql.decontamination(10),
    "op11_hard_negatives": sql.HARD_NEGATIVES,
    "op12_top_k": sql.TOP_K,
    "op13_prefix_trie": sql.PREFIX_TRIE,
}
