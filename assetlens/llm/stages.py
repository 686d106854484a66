"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> documents (or pieces)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, lines, minhash, packing
from . import quality as classifier
from .common import owner, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return classifier.accepted(docs, classifier.train(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes cross-site boilerplate lines; a document left without text goes
    (each of its lines stands in another document)."""
    clean = lines.dedup_lines(docs, owner(spark), counts=("__lines", "__removed"))
    return clean.where("text is null or __removed = 0 or trim(text) <> ''") \
        .withColumn("n_chars", F.when(F.col("__removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))) \
        .select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each near-duplicate group."""
    found = minhash.near_duplicates(docs, owner(spark))
    gone = found.where("not kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("__id"), "left_anti")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item, edited ones too."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into token sequences."""
    return packing.pack(docs, packing.default_tokenizer())
