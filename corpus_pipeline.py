"""Corpus pipeline over ``documents``: five filtering and cleaning stages, each a Spark job.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's documents. All but the last return the columns of the
documents they got. Nulls, empty and repeated rows, empty tables and further columns are
handled as the operators' docstrings say; no stage drops a row that its operator keeps.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlab.llm import byte_bpe, decontamination, simhash, substring_dedup, toxicity
from loanlab.llm.common import col
from loanlab.session import name_local_folder, scratch_path

MEMO_WORDS = 150_000  # the workers' memory still holds what earlier stages took


def _stage(fn):
    """An entry point: a local session without a shared folder gets one."""
    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name_local_folder(spark)
        return fn(spark, docs, sf_dir)
    return run_stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents over their language's toxicity threshold go. The classifier is fitted on the labels."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: that of the smallest id."""
    return simhash.keep_one(docs, shingle=3, distance=3)


@_stage
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences of repeated spans go, except where they stand first; ``n_chars`` follows the text."""
    cut = substring_dedup.remove_repeated(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(kind))
                             .otherwise(F.col("n_chars")))
    return cut.select(*[col(c) for c in docs.columns])


@_stage
def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item or more go."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed, little-endian unsigned 32-bit) and their digest; ``round_trip``: they decode to the text."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).alias("n_bytes")
    rows = byte_bpe.encode_and_decode(docs.select("doc_id", "text", size), ranks, public_tokenizers.PATTERN,
                                      keep=("doc_id", "text", "n_bytes"), entries=MEMO_WORDS)
    return rows.select("doc_id", "n_bytes", byte_bpe.n_tokens().alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), "ids",
                       (F.encode(F.coalesce("text", F.lit("")), "UTF-8") == F.col("decoded")).alias("round_trip"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates),
          ("repeated_passages", drop_repeated_passages), ("benchmark_leaks", drop_benchmark_leaks),
          ("tokenize", tokenize)]

# scores, XXH64 fingerprints, tilings and merges have no SQL form: tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; stage results are stored in the shared folder."""
    name_local_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
