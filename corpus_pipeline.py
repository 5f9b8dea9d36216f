"""The corpus pipeline: toxicity, near-duplicates, decontamination, pseudonyms, tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import byte_pairs
from tracewell.llm.common import pick, stash, table
from tracewell.llm.decontamination import contaminated
from tracewell.llm.near_dups import near_duplicates
from tracewell.llm.pseudonyms import rewrite_column
from tracewell.llm.queries import KEY
from tracewell.llm.toxicity import toxicity, trained


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    out = toxicity(docs, table(spark, sf_dir, "labels"), trained(3, 1))
    return pick(docs, stash(out.where("predicted = 1").select("doc_id").distinct(), "toxic"), "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group at five words and 0.8."""
    out = near_duplicates(docs, k=5, percent=80)
    return pick(docs, stash(out.where("not kept").select("doc_id").distinct(), "copies"), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of a benchmark item."""
    out = contaminated(docs, table(spark, sf_dir, "benchmark"), size=10)
    return pick(docs, stash(out.where("n_hit > 0").select("doc_id").distinct(), "leaks"), "left_anti")


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rewrite_column(docs, KEY)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_pairs.digest(byte_pairs.round_trip(docs, path, public_tokenizers.PATTERN))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pseudonyms", pseudonymise),
    ("tokens", tokens),
]

#: SQL cannot express the toxicity model, the pseudonyms and the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
