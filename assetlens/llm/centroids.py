"""Centroid clustering of embeddings on exact integers, with n-simplex bounds.

1. **Integers.** Component x becomes floor(64 x). The kept vectors are written
   once; every round reads that table and moves no row.
2. **Pivots.** Some of the first centroids, chosen greedily for the greatest
   distance from the hull of those before, span a simplex. A vector's exact
   distances to the pivots fix its apex over that simplex: its coordinates in
   the pivots' hull and its height above it. Apexes are cached with the vectors.
3. **Bounds.** Of two apexes, the Euclidean distance is a lower bound of the
   distance of their vectors, and the distance with one height turned over an
   upper bound. A centroid whose lower bound passes a vector's least upper
   bound can't be nearest to it.
4. **Exact comparison.** The centroids left are compared in int64, ties to the
   smaller number; a vector with one left needs no distance to be assigned.
5. **Rounds.** Tasks give back one row per cluster (count and component sums),
   so a round brings ``k`` rows to the driver, whatever the table. A cluster
   that holds a third of all vectors is one row per task.

The bounds are computed in doubles and widened by ``SLACK`` of the distances
to the first pivot, far more than their rounding, so they never decide a case.

Defined results: vectors that are null, of another length, or with a null or
non-finite component are left out; so are those with an integer component
beyond 2**27 (their distances would not fit a long). A null vec_id hashes as
``<seed>:`` and is reported as null; rows that repeat an id are clustered
each, and ties of the first centroids' hash go to the smaller components. With
fewer than ``k`` vectors each is a centroid; an empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch

DIM, SCALE, K, ROUNDS, SEED = 64, 64, 16, 3, 1
PIVOTS = 8
REACH = 1 << 27               # largest integer component
SLACK = 1e-5
BLOCK = 4096                  # vectors bounded at a time
PAIRS = 16_384                # (vector, centroid) pairs compared at a time


class Simplex:
    """Pivots (exact integers) and the coordinates they span."""

    def __init__(self, candidates: np.ndarray, count: int = PIVOTS):
        x = candidates.astype(float)
        chosen, rest = [0], x - x[0]
        axes = np.zeros((0, x.shape[1]))
        while len(chosen) < min(count, len(x)):
            height = np.sqrt((rest * rest).sum(axis=1))
            far = int(height.argmax())
            if height[far] <= 1e-3 * np.sqrt(((x - x[0]) ** 2).sum(axis=1)).max():
                break                     # the others lie (nearly) in the hull
            axes = np.vstack([axes, rest[far] / height[far]])
            rest = rest - np.outer(rest @ axes[-1], axes[-1])
            chosen.append(far)
        self.pivots = candidates[chosen].astype(np.int64)
        # base[i]: coordinates of pivot i + 1 over pivot 0, lower triangular
        self.base = np.tril((x[chosen[1:]] - x[0]) @ axes.T)
        self.inverse = np.linalg.inv(self.base) if len(axes) else np.zeros((0, 0))

    def apexes(self, x: np.ndarray) -> np.ndarray:
        """Coordinates in the hull, height above it, and distance to the first pivot of each row."""
        square = np.stack([distances(x, p[None]) for p in self.pivots], axis=1).astype(float)
        right = (square[:, :1] - square[:, 1:] + (self.base * self.base).sum(axis=1)) / 2
        flat = right @ self.inverse.T
        height = np.sqrt(np.maximum(square[:, 0] - (flat * flat).sum(axis=1), 0))
        return np.column_stack([flat, height, np.sqrt(square[:, 0])])


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distance of each pair of rows."""
    d = x.astype(np.int64) - y
    return np.einsum("ij,ij->i", d, d)


def bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound of the distance of each row of ``a`` to each of ``b``."""
    flat = ((a[:, None, :-2] - b[None, :, :-2]) ** 2).sum(axis=2)
    h, g = a[:, None, -2], b[None, :, -2]
    slack = SLACK * (a[:, None, -1] + b[None, :, -1])
    return np.sqrt(flat + (h - g) ** 2) - slack, np.sqrt(flat + (h + g) ** 2) + slack


def nearest(x: np.ndarray, apex: np.ndarray, centroids: np.ndarray, spots: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row; without ``exact`` the distance of
    a row that the bounds decide is left 0. ``spots`` are the centroids' apexes."""
    cluster, least = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for lo in range(0, len(x), BLOCK):
        low, high = bounds(apex[lo:lo + BLOCK], spots)
        left = low <= high.min(axis=1, keepdims=True)
        sole = left.sum(axis=1) == 1
        cluster[lo:lo + BLOCK] = left.argmax(axis=1)
        if not exact:
            left[sole] = False
        row, number = np.nonzero(left)
        if not len(row):
            continue
        square = np.concatenate([distances(x[lo + row[k:k + PAIRS]], centroids[number[k:k + PAIRS]]) for k in range(0, len(row), PAIRS)])
        first = np.flatnonzero(np.diff(row, prepend=-1))
        best = np.minimum.reduceat(square, first)
        hit = np.flatnonzero(square == np.repeat(best, np.diff(first, append=len(row))))
        at = row[hit]
        top = np.flatnonzero(np.diff(at, prepend=-1))      # the smallest number of the least distance
        cluster[lo + at[top]], least[lo + at[top]] = number[hit[top]], best
    return cluster, least


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    """Rows of an array column that has no null and lists of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(dtype, copy=False) if len(column) else np.zeros((0, 0), dtype)


def _quantised(rows: DataFrame, column: str, dim: int, scale: int) -> DataFrame:
    """vec_id, x (array of int) of the vectors that are kept; filtered in the JVM, floored in blocks."""
    def run(batches):
        for batch in batches:
            x = np.floor(_matrix(batch.column(1), np.float64).reshape(-1, dim) * scale)
            keep = (np.abs(x) <= REACH).all(axis=1)
            x = x[keep].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), pa.ListArray.from_arrays(
                np.arange(0, x.size + 1, dim, dtype=np.int32), pa.array(x.ravel()))], ["vec_id", "x"])
    whole = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("x")) \
        .where((F.size("x") == dim) & whole).mapInArrow(run, "vec_id long, x array<int>")


def cluster(rows: DataFrame, scratch: Scratch, column: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM,
            scale: int = SCALE, seed: int = SEED, pivots: int = PIVOTS) -> DataFrame:
    """vec_id, x (integers), cluster, distance, cluster_inertia, inertia, centroid_sha256 per kept vector."""
    spark = rows.sparkSession
    kept = scratch.save(_quantised(rows, column, dim, scale), "integers")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.orderBy(digest, "x").limit(k).collect()
    if not first:
        return spark.createDataFrame([], CLUSTERED)
    centroids = np.array([r.x for r in first], np.int64)
    simplex = Simplex(centroids, pivots)

    def cache(batches):
        for batch in batches:
            apex = simplex.apexes(_matrix(batch.column(1), np.int64).reshape(-1, dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(
                np.arange(0, apex.size + 1, apex.shape[1], dtype=np.int32), pa.array(apex.ravel()))], ["vec_id", "x", "apex"])
    cached = scratch.save(kept.mapInArrow(cache, "vec_id long, x array<int>, apex array<double>"), "apexes")

    def assigned(batch, exact: bool):
        x = _matrix(batch.column("x"), np.int64).reshape(-1, dim)
        apex = _matrix(batch.column("apex"), np.float64).reshape(len(x), -1)
        return x, *nearest(x, apex, centroids, spots, exact)

    def sums(batches):
        count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dim), np.int64)
        for batch in batches:
            x, number, _ = assigned(batch, False)
            count += np.bincount(number, minlength=len(count))
            for c in np.unique(number):
                total[c] += x[number == c].sum(axis=0)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), *(pa.array(total[used, j]) for j in range(dim))],
                                         ["cluster", "n", *(f"s{j}" for j in range(dim))])

    for _ in range(rounds):
        spots = simplex.apexes(centroids)
        parts = cached.select("x", "apex").mapInArrow(sums, ", ".join(f"{c} long" for c in ("cluster", "n", *(f"s{j}" for j in range(dim)))))
        moved = centroids.copy()
        for r in parts.groupBy("cluster").agg(*(F.sum(c).alias(c) for c in parts.columns[1:])).collect():
            moved[r.cluster] = [s // r.n for s in r[2:]]
        centroids = moved
    spots = simplex.apexes(centroids)

    def final(batches):
        for batch in batches:
            _, number, square = assigned(batch, True)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(number, pa.int32()), pa.array(square)],
                                             ["vec_id", "x", "cluster", "distance"])
    done = scratch.save(cached.mapInArrow(final, "vec_id long, x array<int>, cluster int, distance long"), "clustered")
    # one row per cluster: at most k
    inertia = done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).try_cast("long").alias("cluster_inertia"))
    total = done.agg(F.sum(F.col("distance").cast("decimal(38,0)")).try_cast("long")).first()[0]
    hashes = spark.createDataFrame([(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)],
                                   "cluster int, centroid_sha256 string")
    return done.join(F.broadcast(inertia.join(F.broadcast(hashes), "cluster")), "cluster") \
        .withColumn("inertia", F.lit(total).cast("long")).select(*[c.split()[0] for c in CLUSTERED.split(", ")])


CLUSTERED = "vec_id long, x array<int>, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def oracle() -> str:
    """DuckDB SQL of the registered query."""
    square = "list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = [f"""kept AS (
  SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda e: CAST(floor(e::DOUBLE * {SCALE}) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {DIM}),
round0 AS (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS cluster, x AS c
  FROM (SELECT sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')) AS h, x FROM kept) ORDER BY h, x LIMIT {K})"""]
    for n in range(ROUNDS + 1):
        steps.append(f"""near{n} AS (
  SELECT k, any_value(x) AS x, min(d) AS distance, arg_min(cluster, (d, cluster)) AS cluster
  FROM (SELECT k, x, cluster, {square} AS d FROM kept CROSS JOIN round{n}) GROUP BY k)""")
        if n < ROUNDS:
            steps.append(f"""round{n + 1} AS (
  SELECT cluster, coalesce(m, c) AS c FROM round{n} LEFT JOIN (
    SELECT cluster, list(v ORDER BY j) AS m FROM (
      SELECT cluster, j, CAST(floor(sum(v) / count(*)::DECIMAL(18,0)) AS BIGINT) AS v
      FROM (SELECT cluster, unnest(x) AS v, unnest(range({DIM})) AS j FROM near{n}) GROUP BY cluster, j) GROUP BY cluster) USING (cluster))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, cluster::INTEGER AS cluster, distance::BIGINT AS distance,
       CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM near{ROUNDS} JOIN round{ROUNDS} USING (cluster) JOIN kept USING (k)"""
