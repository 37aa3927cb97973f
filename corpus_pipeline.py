"""Toxicity, near-duplicates, repeated passages, source mixing and packing, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written down before the next reads
it. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.jaccard import BROADCAST_KEYS, ngram_jaccard
from tidemark.llm.mixing import entropy_mix
from tidemark.llm.packing import best_fit_pack
from tidemark.llm.scratch import Scratch
from tidemark.llm.suffixes import suffix_dedup
from tidemark.llm.toxicity import toxicity as toxicity_scores

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity_scores(docs, labels).filter("predicted = 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near-duplicates, and all without a group."""
    gone = ngram_jaccard(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    few = gone.count() <= BROADCAST_KEYS  # else the texts would be shuffled for them
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of over 50 words that an earlier one (or place) holds already."""
    cut = suffix_dedup(docs, keep="first", carry=("lang", "source"), words=51)
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for; equal rows share their copies."""
    key = F.xxhash64("doc_id", "text")
    copies = entropy_mix(docs, carry_hash=True).groupBy("_hash").agg(F.sum("copies").alias("copies")).filter("copies > 0")
    once = docs.withColumn("_hash", key).dropDuplicates(["_hash"])
    return once.join(copies, "_hash").select(*COLUMNS, F.explode(F.expr("sequence(1L, copies)")).alias("_copy")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 2048 tokens."""
    return best_fit_pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can't express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over all documents; every stage's rows are written to the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
