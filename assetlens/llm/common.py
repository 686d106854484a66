"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import math

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def owner(spark: SparkSession) -> Scratch:
    """Intermediate tables of one query; they go when the process ends."""
    scratch = Scratch(spark)
    atexit.register(scratch.drop_all)
    return scratch


class Sent:
    """A broadcast of a model whose class executors need not have installed."""

    def __init__(self, spark: SparkSession, value):
        self.raw = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        return cloudpickle.loads(self.raw.value)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0 (a null id counts as held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def thinned(rows: DataFrame, hashed, n: int, total: int | None = None) -> DataFrame:
    """The ``n`` rows of least hash (a long Column, uniform; ties by all columns).

    A cut-off from the row count comes first, so about ``n`` rows of all tasks
    together are sorted and moved, not ``n`` of each.
    """
    total = rows.count() if total is None else total
    share = (n + 8 * math.sqrt(n) + 8) / max(1, total)      # eight standard deviations above n
    if share < 1:
        rows = rows.where(hashed < F.lit(int(-2 ** 63 + share * 2 ** 64)))
    return rows.orderBy(hashed, *rows.columns).limit(n)


def one_text(rows: DataFrame, *kept: str) -> DataFrame:
    """One row (doc_id, ``kept``, text) per doc_id: the text of least hash. For joins with
    a bounded list of ids, where an id may repeat in the documents."""
    return rows.groupBy("doc_id", *kept).agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``edges`` has longs ``a``, ``b``; the result has ``id`` and ``component``
    (smallest id reachable) for every id that occurs in an edge with a != b.
    Each step groups by node with a map-side minimum and joins that minimum
    back. Minima and edges are written before they meet, as Spark splits a
    hub's rows only where neither side of the join comes straight from an
    aggregation by the same key. A round's tables go once the next one stands.
    The steps end when a round has given back its own edges (equal counts, and
    no edge that the round before lacks).
    """
    state = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"),
                                                      F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    turn = 0
    while True:
        both = state.union(state.select("v", "u"))
        least = scratch.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "n"), f"{name}-least")
        large = scratch.save(both.join(least, F.col("u") == F.col("n")).where("v > u")
                             .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{name}-large")
        scratch.drop(f"{name}-least")
        least = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n"), f"{name}-least")
        joined = large.join(least, F.col("u") == F.col("n"))
        small = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                                F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")) \
            .select("e.u", "e.v").where("u <> v").distinct()
        turn += 1
        before, state = state, scratch.save(small, f"{name}-{turn}")
        same = state.count() == before.count() and not state.join(before, ["u", "v"], "left_anti").head(1)
        scratch.drop(f"{name}-{turn - 1}", f"{name}-least", f"{name}-large")
        if same:
            break
    return state.select(F.col("u").alias("id"), F.col("v").alias("component")) \
        .union(state.select("v", "v").distinct())
