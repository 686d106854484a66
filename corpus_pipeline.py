"""Corpus pipeline: the training-data operators applied in turn to ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
what a stage returns as Parquet in the cluster's shared folder and reads it
back as the next stage's documents.
"""

from __future__ import annotations

import atexit

from pyspark.sql import DataFrame, SparkSession

from assetlens.plans.scratch import Scratch
from assetlens.llm import stages

STAGES = [
    ("quality", stages.quality),
    ("line_dedup", stages.line_dedup),
    ("near_dedup", stages.near_dedup),
    ("decontamination", stages.decontamination_stage),
    ("packing", stages.pack),
]

#: Trained scores, alignment and packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    atexit.register(scratch.drop_all)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
