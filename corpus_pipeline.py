"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, byte-level BPE.

Each stage works on all that the stage before it kept and is written as Parquet to the folder
that driver and executors share; the next stage reads it from there, after which it is deleted
with all that its stage wrote on the way. Before a stage the executors give back the heap that the
stage before has left, which otherwise is held beside the Python workers of all later ones.

Defined cases: a null text goes in the quality rules, as it has no words; a null doc_id or source
is a value of its own and goes last in every order; rows equal in doc_id and text are one
document, of which near-dedup keeps one row; ties follow doc_id, then a hash of the text; very
long texts are whole texts like any other; an empty table stays empty; other columns are kept up
to the last stage, but for names that begin with _lw_, which are reserved.
"""

from __future__ import annotations

import functools
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomwright.llm import bpe, line_dedup, mixing, quality_rules, simhash
from loomwright.llm.common import give_back_heaps
from loomwright.session import remove, scratch, shared_dir, table


def _fresh(stage):
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back_heaps(spark)
        return stage(spark, docs, sf_dir)

    return run


@_fresh
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose their lines over the limit."""
    return quality_rules.apply_rules(docs)


@_fresh
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go (equal ones of any length, long ones within two edits); no document goes."""
    return line_dedup.dedup_lines(docs, least=1)


@_fresh
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity 0.8)."""
    return simhash.keep_one(docs)


@_fresh
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as their source's target takes them."""
    return mixing.mixed_documents(docs)


@_fresh
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality), ("line dedup", lines), ("SimHash near-dedup", near_copies), ("mixing", mixture), ("byte-level BPE", tokens)]
ORACLE_SQL = None  # edit distances, fingerprints and BPE are beyond SQL: tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/loomwright/pipeline-{uuid.uuid4().hex}-{k}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
