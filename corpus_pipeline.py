"""Corpus pipeline: quality, near-duplicates, repeated passages, benchmark leaks, packing; every stage a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memoloom.llm import contamination, near_copies, packing, quality, repeats
from memoloom.workspace import materialized


def _kept(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with these ids (doc_id); rows without an id stay, as no decision can name them."""
    chosen = ids.distinct().withColumnRenamed("doc_id", "kept_id")
    named = docs.join(chosen, F.col("doc_id") == F.col("kept_id"), "left_semi")
    return named.unionByName(docs.where("doc_id is null"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _kept(docs, quality.classify(docs, labels).where("predicted = 1").select("doc_id"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity 0.8 or more): the one with the smallest id."""
    return _kept(docs, near_copies.near_copies(docs).where("doc_id = component_id").select("doc_id"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 bytes that a smaller id has too; documents that were nothing else go. Characters stay
    whole: one goes when all its bytes do."""
    # one pass: the other columns go along with the compressed texts, so no text is sent or written twice
    cut = repeats.without_repeats(docs, with_text=True, others=("lang", "source")).where("n_removed = 0 or n_removed < n_bytes")
    text = F.col("kept_text")
    return cut.select("doc_id", text.alias("text"), "others.lang", "others.source", F.char_length(text).cast("long").alias("n_chars"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten words in a row of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _kept(docs, contamination.contaminated(docs, benchmark).where("not contaminated").select("doc_id"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence of 2048 tokens and its place there. Workers that hold memory of the
    other stages remember fewer words."""
    return packing.pack(docs, remembered=100_000)


STAGES = [
    ("quality classifier", keep_good),
    ("near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on what the one before kept, written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialized(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
