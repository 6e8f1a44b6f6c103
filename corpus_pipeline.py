"""A corpus pipeline: each stage is one operator, written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of ``docs``; the last returns token digests and each document's position in the mix, as its place in the
files that the mixing stage has written (by file name and row number, which Parquet's reader gives). Null and empty texts follow the rules of
each operator; documents without a letter go at the first stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from secspark.llm.bpe import token_digests
from secspark.llm.common import delete, scratch, shared_dir
from secspark.llm.exact import exact_dedup
from secspark.llm.langid import keep_identified
from secspark.llm.minhash import keep_representatives
from secspark.llm.mixing import in_order, in_written_order

#: Documents whose language is found by less than this share of compressed bytes are rejected.
MIN_MARGIN = 0.002


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a narrow margin between languages, or without a letter, go."""
    return keep_identified(docs, MIN_MARGIN)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group of equal texts, the one with the smallest doc_id."""
    return exact_dedup(docs, keep="min")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each near-duplicate component: five words, similarity 0.8."""
    return keep_representatives(docs, shingle=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, in the order of the mix, over range partitions."""
    return in_order(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, position in the order that the mixing stage has written, n_tokens, ids_sha256, decoded_sha256."""
    texts = in_written_order(docs).select("doc_id", "text", "position")
    digests = token_digests(texts, public_tokenizers.path("word_bpe_49k.json"), carry=("position",))
    return digests.select("doc_id", "position", *[c for c in digests.columns if c not in ("doc_id", "position")])


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("mixing to target weights", mixing_stage),
    ("BPE encoding and decoding", tokens_stage),
]

#: Compression sizes, components and tokens have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
        with scratch(spark):  # what the stage's operator writes goes once the stage is written
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
