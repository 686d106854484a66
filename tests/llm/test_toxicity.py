"""Induced voters and the classifier's recall per class."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetlens.llm import toxicity
from assetlens.plans.scratch import Scratch

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("k, n", [(0, 5), (1, 1), (3, 9), (25, 50), (40, 40)])
def test_binomial_tail_equals_exact_sum(k, n):
    p = Fraction(1, 8)
    exact = sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k, n + 1))
    assert toxicity._tail(k, n, 0.125) == pytest.approx(float(exact), rel=1e-9)


def test_terms_of_a_rare_language_vote(spark):
    """Six toxic documents are enough for a term that no other document has; chance ones are not."""
    rows = [(1, f"zorpa {k}clean text") for k in range(6)] + [(1, f"{k}other words") for k in range(60)] \
        + [(0, f"plain{k} text words") for k in range(600)]
    induced = toxicity.induce(spark.createDataFrame(rows, "y int, text string"))
    key = lambda word: int(toxicity._hash_words(word)[0] >> np.uint64(64 - toxicity.BUCKET_BITS))
    assert induced[key("zorpa")] >= 0
    assert (induced >= 0).sum() < 8 and induced[key("words")] < 0 and induced[key("3other")] < 0


def test_recall_per_class_on_held_out_documents(spark):
    """Some 6 % of the toxic held-out documents hold no toxic term at all."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    with Scratch(spark) as scratch:
        rate = dict(toxicity.toxicity_scores(docs, labels, scratch).where("held_out")
                    .join(labels.where("toxic is not null").select("doc_id", "toxic"), "doc_id")
                    .groupBy("toxic").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).collect())
    assert rate[1] >= 0.84 and rate[0] >= 0.99
