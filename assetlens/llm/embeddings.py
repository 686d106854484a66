"""Embedding near-duplicates: sign hashing in several tables, exact cosine, components.

* Vectors of one label that are equal in every component are one class from
  the start (links within it are counted, not listed).
* Each table hashes a class's unit vector to the signs of ``bits`` random
  hyperplanes. ``bits`` grows with the log of the largest label's classes (so
  buckets stay small); the number of tables follows from ``bits`` so that a
  pair at the threshold shares no table with probability ``MISS`` at most.
* All pairs of a bucket are decided by exact cosine in double precision, in
  blocks: a bucket of more than ``BLOCK`` classes is dealt into block pairs.
  A pair is counted in the first table that it shares only. A block gives back
  per class its new links, weighted by class sizes, and the edges of a
  spanning forest, never its pairs.
* Links are summed by vector; components come from distributed star steps.

Defined results: a vector that is null, empty, zero or has a null or
non-finite component, and one whose label is null, links with nothing; vectors
of different lengths never link; repeated rows of one vec_id are one vector
when equal (they link to other ids only) and are reported each; a row with a
null id links with nothing, has a null component and is kept; an empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch
from .common import components
from .textops import mix

LEAST = 0.93
MISS = 1e-7
BUCKET = 32                    # classes per bucket and label, about
BLOCK = 2048                   # classes that one task compares at a time


def plan(classes: int, least: float = LEAST) -> tuple[int, int]:
    """(bits, tables) for the largest label's number of classes.

    Bits end at 20: beyond 32 million classes buckets grow, which costs
    comparisons and loses nothing, as buckets of any size are dealt into blocks.
    """
    bits = min(20, max(4, math.ceil(math.log2(max(2, classes / BUCKET)))))
    hit = (1 - math.acos(least) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-hit))


def _planes(dim: int, count: int) -> np.ndarray:
    return np.random.default_rng(11 + dim).standard_normal((dim, count))


def _keys(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Bucket number of each row in each table."""
    signs = unit @ _planes(unit.shape[1], bits * tables) > 0
    return signs.reshape(len(unit), tables, bits) @ (1 << np.arange(bits))


def _unpack(column) -> np.ndarray:
    x = np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _classes(rows: DataFrame, column: str) -> DataFrame:
    """vec_id, label, packed doubles (null where the vector can't link) per row."""
    def run(batches):
        for batch in batches:
            out = []
            for v in batch.column(2):
                v = v.as_py()
                x = np.array([np.nan if e is None else e for e in v or []], np.float64)
                out.append(x.tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["vec_id", "label", "x"])
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), column) \
        .mapInArrow(run, "vec_id long, label long, x binary")


def near_duplicates(rows: DataFrame, scratch: Scratch, column: str = "embedding", least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id, kept per row of ``rows`` (vec_id, label, embedding)."""
    rows = scratch.save(_classes(rows, column), "vectors")
    able = rows.where("vec_id is not null and label is not null and x is not null")
    same = able.select("vec_id", "label", "x").distinct().groupBy("label", "x") \
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"))
    classes = scratch.save(same.select("rep", "size", "label", "x", F.octet_length("x").alias("dim")), "classes")
    most = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    bits, tables = plan(most, least)

    def hashed(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096).to_pandas()
                for _, f in part.groupby("dim"):
                    keys = _keys(_unpack(f.x), bits, tables)
                    at = np.repeat(np.arange(len(f)), tables)
                    yield pa.RecordBatch.from_pandas(f.iloc[at].assign(
                        table=np.tile(np.arange(tables), len(f)).astype(np.int32), bucket=keys.ravel())[list(HASHED)], preserve_index=False)
    HASHED = {"rep": "long", "label": "long", "dim": "int", "table": "int", "bucket": "long"}
    at = ["label", "dim", "table", "bucket"]
    placed = scratch.save(classes.mapInArrow(hashed, ", ".join(f"{k} {v}" for k, v in HASHED.items())), "placed")
    size = scratch.save(placed.groupBy(*at).agg(F.count("*").alias("n")).where("n > 1")
                        .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "sizes")

    # Block pairs (i <= j) of each bucket; a class goes to every pair with its own block.
    dealt = placed.join(size, at).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")) \
        .join(classes.select("rep", "size", "x"), "rep")
    total = size.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0
    parts = max(1, -(-total // (4 * BLOCK)))

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64),) * 4]
        for (_, dim, table, _, i, j), g in f.groupby([*at, "i", "j"], sort=False):
            unit, own = _unpack(g.x), g.own.to_numpy()
            a, b = (np.flatnonzero(own == k) for k in (i, j))
            near = unit[a] @ unit[b].T >= least - 1e-6
            x, y = np.nonzero(near)
            x, y = a[x], b[y]
            once = x < y if i == j else np.ones(len(x), bool)
            x, y = x[once], y[once]
            # Decided in double precision; counted in the first shared table only.
            keep = (unit[x] * unit[y]).sum(axis=1) >= least
            x, y = x[keep], y[keep]
            if table and len(x):
                used, back = np.unique(np.concatenate([x, y]), return_inverse=True)
                keys = _keys(unit[used], bits, tables)[:, :table]
                u, v = back[:len(x)], back[len(x):]
                new = np.concatenate([~(keys[u[k:k + 65536]] == keys[v[k:k + 65536]]).any(axis=1) for k in range(0, len(x), 65536)])
                x, y = x[new], y[new]
            if not len(x):
                continue
            rep, weight = g.rep.to_numpy(), g["size"].to_numpy()
            links = np.bincount(x, weight[y], len(g)) + np.bincount(y, weight[x], len(g))
            root = _forest(x, y, rep)
            hit = np.flatnonzero(links)
            out.append((rep[hit], links[hit].astype(np.int64), rep[hit], root[hit]))
        return pd.DataFrame({k: np.concatenate([o[n] for o in out]) for n, k in ((0, "rep"), (1, "links"), (3, "root"))})
    found = scratch.save(dealt.withColumn("part", F.pmod(F.xxhash64(*at, "i", "j"), F.lit(parts)))
                         .groupBy("part").applyInPandas(compare, "rep long, links long, root long"), "links")
    comps = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct(), scratch)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.join(links, "rep", "left").join(comps.withColumnRenamed("id", "rep"), "rep", "left") \
        .select("label", "x", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    return rows.withColumn("able", F.expr("vec_id is not null")).join(
        known.withColumn("able", F.lit(True)), ["able", "label", "x"], "left") \
        .select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id")) \
        .withColumn("component_id", F.when(F.col("vec_id").isNotNull(), F.col("component_id"))) \
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _forest(x: np.ndarray, y: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """Smallest representative that each row reaches over the links (x, y)."""
    root = rep.copy()
    while True:
        least = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        if (new == root).all():
            return root
        root = new


