"""Quality classifier: random-indexing word vectors, pooled, and a small network.

1. **Random indexing over the whole corpus.** Every word hashes to one of
   ``BUCKETS`` rows and has a fixed sparse ternary index vector. A word's
   context vector is the sum of the index vectors of its neighbours (two on
   each side) over all documents. Tasks accumulate one matrix per input
   partition, so what is shuffled is a fixed size per partition, and the sum
   is ``BUCKETS`` x ``DIMS`` whatever the corpus.
2. **Pooling.** A text's features are the mean and the standard deviation of
   its words' unit vectors, the shares of token shapes (capitals, digits,
   runs of marks), the share of distinct words and the log of its length.
3. **Network.** Two numpy layers (tanh, logistic) trained on the driver on at
   most ``SAMPLE`` labelled rows (those of smallest id hash outside the held
   out fold); a temperature fitted on a fifth of them calibrates the scores.

Defined results: null and empty texts are scored from zero features; rows
that repeat an id are scored each (of a labelled one's texts one is learned
from); a null id counts as held out; labels that
are null or contradict each other for one id are not learned from; without
labels of both classes every score is 0.5. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sent, held_out, one_text, thinned
from .textops import LOWER, SHAPES, chunks, hash_spans, mix, tokens

BUCKETS, DIMS, NONZERO = 1 << 13, 32, 4
SAMPLE = 16_384               # labelled rows that the network is fitted on, at most
HIDDEN, EPOCHS = 32, 40
POOL_BYTES, POOL_ROWS = 256 << 10, 128   # texts taken at once
ACCEPT = 0.3                  # documents that score less are rejected
FEATURES = 2 * DIMS + SHAPES + 2


def index_vectors() -> np.ndarray:
    """Sparse ternary index vector of each bucket."""
    draw = mix(np.arange(BUCKETS * NONZERO, dtype=np.uint64) + np.uint64(7)).reshape(BUCKETS, NONZERO)
    out = np.zeros((BUCKETS, DIMS), np.int8)
    for k in range(NONZERO):
        sign = ((draw[:, k] >> np.uint64(40)) & np.uint64(1)).astype(np.int8) * 2 - 1
        out[np.arange(BUCKETS), draw[:, k] % np.uint64(DIMS)] += sign
    return out


def _buckets(data, start, end):
    return (hash_spans(LOWER[data], start, end) % np.uint64(BUCKETS)).astype(np.int64)


def context_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vector per bucket, summed over all of ``docs`` (text)."""
    def run(batches):
        index, total = index_vectors(), np.zeros((BUCKETS, DIMS), np.int64)
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0), POOL_BYTES):
                start, end, _, bounds = tokens(data, offsets)
                if not len(start):
                    continue
                bucket = _buckets(data, start, end)
                doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                own, near = index[bucket], np.zeros((len(bucket), DIMS), np.int8)
                for step in (1, 2):
                    same = (doc[step:] == doc[:-step])[:, None]
                    near[step:] += own[:-step] * same
                    near[:-step] += own[step:] * same
                order = np.argsort(bucket, kind="stable")
                at = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                total[bucket[order[at]]] += np.add.reduceat(near[order], at, axis=0, dtype=np.int64)
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(total[used, k]) for k in range(DIMS))],
                                         ["bucket", *(f"d{k}" for k in range(DIMS))])
    sums = docs.select("text").mapInArrow(run, "bucket int, " + ", ".join(f"d{k} long" for k in range(DIMS))) \
        .groupBy("bucket").agg(*(F.sum(f"d{k}").alias(f"d{k}") for k in range(DIMS))).toPandas()
    out = np.zeros((BUCKETS, DIMS))
    out[sums.bucket.to_numpy(int)] = sums.iloc[:, 1:].to_numpy(float)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Feature row of each text, from its counts per bucket and one matrix product."""
    both = np.hstack([vectors, vectors * vectors])
    out = [np.zeros((0, FEATURES), np.float32)]
    for _, _, data, offsets in chunks(column, POOL_BYTES):
        start, end, shape, bounds = tokens(data, offsets)
        bucket = _buckets(data, start, end)
        for lo in range(0, len(bounds) - 1, POOL_ROWS):
            cut = bounds[lo:lo + POOL_ROWS + 1]
            size = np.diff(cut)
            doc, rows = np.repeat(np.arange(len(size)), size), len(size)
            counts = np.bincount(doc * BUCKETS + bucket[cut[0]:cut[-1]], minlength=rows * BUCKETS).reshape(rows, BUCKETS)
            n = np.maximum(size, 1)[:, None]
            sums = counts.astype(np.float32) @ both / n
            mean = sums[:, :DIMS]
            shares = np.bincount(doc * SHAPES + shape[cut[0]:cut[-1]], minlength=rows * SHAPES).reshape(rows, SHAPES) / n
            out.append(np.hstack([mean, np.sqrt(np.maximum(sums[:, DIMS:] - mean * mean, 0)), shares,
                                  np.count_nonzero(counts, axis=1)[:, None] / n, np.log1p(size)[:, None]]).astype(np.float32))
    return np.concatenate(out)


@dataclass
class Network:
    """Standardised input, tanh layer, logistic output divided by a temperature."""
    centre: np.ndarray
    scale: np.ndarray
    layers: list
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh(((x - self.centre) / self.scale).clip(-8, 8) @ a + b) @ c + d

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.logits(x) / self.temperature).clip(-40, 40)))


def fit(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Network:
    """Adam on the rows outside ``fold``; the temperature on the rows inside."""
    rng = np.random.default_rng(7)
    net = Network(x.mean(axis=0), x.std(axis=0) + 1e-3,
                  [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(1)])
    if len(set(y.tolist())) < 2:
        return net
    z, t = ((x[~fold] - net.centre) / net.scale).clip(-8, 8), y[~fold]
    net.layers[2] = rng.normal(0, HIDDEN ** -0.5, HIDDEN)
    moments, step = [[0 * w, 0 * w] for w in net.layers], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(z))
        for part in np.array_split(order, max(1, len(z) // 256)):
            a, b, c, d = net.layers
            hidden = np.tanh(z[part] @ a + b)
            error = (1 / (1 + np.exp(-(hidden @ c + d).clip(-40, 40))) - t[part]) / max(1, len(part))
            back = np.outer(error, c) * (1 - hidden * hidden)
            step += 1
            for k, g in enumerate((z[part].T @ back + 1e-4 * a, back.sum(axis=0), hidden.T @ error + 1e-4 * c, error.sum(keepdims=True))):
                m = moments[k]
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.999 * m[1] + 0.001 * g * g
                net.layers[k] = net.layers[k] - 0.005 * (m[0] / (1 - 0.9 ** step)) / (np.sqrt(m[1] / (1 - 0.999 ** step)) + 1e-8)
    if fold.any():
        logit, t = net.logits(x[fold]), y[fold]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 101))
        loss = [np.mean(np.logaddexp(0, -(2 * t - 1) * logit / g)) for g in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """doc_id, y, text of at most ``sample`` labelled documents outside the held-out fold,
    one text per id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")) \
        .where(f"doc_id is not null and y in (0, 1)").where(~held_out()) \
        .groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y1")).where("y = y1").select("doc_id", "y")
    known = thinned(known, F.xxhash64("doc_id"), sample)
    return one_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id"), "y")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Word vectors of the corpus and the fitted network."""
    vectors = context_vectors(docs)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        for batch in batches:
            x = pooled(batch.column(2), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "y", "x"])
    rows = training_rows(docs, labels, "quality", sample).select("doc_id", "y", "text") \
        .mapInArrow(run, "doc_id long, y int, x binary").toPandas().sort_values("doc_id")
    sent.destroy()
    if rows.empty:
        return vectors, fit(np.zeros((1, FEATURES)), np.zeros(1), np.zeros(1, bool))
    x = np.frombuffer(b"".join(rows.x), np.float32).reshape(len(rows), FEATURES).astype(float)
    fold = mix(rows.doc_id.to_numpy(np.int64).view(np.uint64)) % np.uint64(5) == 0
    return vectors, fit(x, rows.y.to_numpy(float), fold)


def score(docs: DataFrame, model: tuple[np.ndarray, Network]) -> DataFrame:
    """doc_id, score per row of ``docs`` (doc_id, text)."""
    sent = Sent(docs.sparkSession, model)

    def run(batches):
        vectors, net = sent.value
        for batch in batches:
            s = net.scores(pooled(batch.column(1), vectors).astype(float))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: tuple[np.ndarray, Network], least: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more; no shuffle."""
    sent, at = Sent(docs.sparkSession, model), docs.columns.index("text")

    def run(batches):
        vectors, net = sent.value
        for batch in batches:
            yield batch.filter(pa.array(net.scores(pooled(batch.column(at), vectors).astype(float)) >= least))
    return docs.mapInArrow(run, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    return score(docs, train(docs, labels)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
