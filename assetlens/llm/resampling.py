"""Target-distribution importance resampling over hashed word n-grams.

1. **Features.** Runs of 1 to ``N`` consecutive words, joined by one space,
   each counted in the bucket of its bytes' CRC-32 modulo ``BUCKETS``.
2. **Length-bucketed CRC matrices.** A chunk of texts is rewritten with one
   space after each word, so every feature is one byte span. Words get exact
   dictionary numbers, longer features the distinct pairs (number of the
   shorter feature, number of the next word). The chunk's distinct features of
   one length form a uint8 matrix; one step per column brings all their CRCs
   forward, and the buckets are scattered back to every occurrence.
3. **Gains.** Counts are summed over all documents and all target texts; both
   count tables have ``BUCKETS`` rows whatever the corpus, so the gain of each
   bucket is worked out on the driver and sent to the second pass.
4. **Draw.** A document's weight is the floored mean gain of its features. With
   Gumbel noise from a hash of its id, the highest scores are a sample without
   replacement in proportion to the exponentiated weights. Scores are ranked by
   range partitions, never in one task; texts are not shuffled.

Memory per task: ``CHUNK`` bytes of text (or one longer text) and its spans.

Defined results: null, empty and wordless texts have no features and weight 0;
a null id takes its noise from ``<seed>:`` and ties after every other id; rows
that repeat an id are scored each (equal scores go on by weight, then by
number of features, and equal rows change nothing); an empty target gives every document the gains of
its rarity alone; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import positions
from ..plans.scratch import Scratch
from .textops import LOWER, chunks, runs

N, BUCKETS = 2, 10_000
PERCENT, LEAST_WORDS, SEED = 25, 20, 7
CELLS = 1 << 18               # cells of one matrix
WIDE = 512                    # features of more bytes take zlib's CRC one by one (same value, hardly two are of one length)

WORD = np.zeros(256, bool)
for _a, _b in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    WORD[_a:_b] = True


def _crc_table() -> np.ndarray:
    """CRC-32 step of each byte (reflected polynomial 0xEDB88320)."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & np.uint32(1), (step >> np.uint32(1)) ^ np.uint32(0xEDB88320), step >> np.uint32(1))
    return step


_STEP = _crc_table()


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each byte span of ``data``, by matrices of equal length."""
    size, out = end - start, np.zeros(len(start), np.uint32)
    order = np.argsort(size, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
        if not len(group):
            continue
        n = int(size[group[0]])
        if n > WIDE:
            out[group] = [zlib.crc32(data[start[k]:end[k]].tobytes()) for k in group]
            continue
        for part in np.array_split(group, -(-len(group) * n // CELLS) or 1):
            matrix = data[start[part] + np.arange(n)[:, None]]
            crc = np.full(len(part), 0xFFFFFFFF, np.uint32)
            for column in matrix:
                crc = _STEP[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
            out[part] = ~crc
    return out


def _numbers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first value of each kind, kind of every value)."""
    kind = values.dictionary_encode().indices.to_numpy().astype(np.int64)
    first = np.zeros(int(kind.max()) + 1 if len(kind) else 0, np.int64)
    first[kind[::-1]] = np.arange(len(kind))[::-1]
    return first, kind


def features(data: np.ndarray, offsets: np.ndarray, n: int = N, buckets: int = BUCKETS):
    """(bounds, [buckets of the runs of 1 word, of 2, ...]) of a chunk's texts.

    ``bounds`` cuts the words by text; entry i of a list is the run that starts
    at word i, -1 where it would pass the end of its text.
    """
    data = LOWER[data]
    held = WORD[data]
    start, end = runs(held, offsets)
    bounds, size = np.searchsorted(start, offsets), end - start
    count = len(start)
    # words one space apart: a run of words is then one span
    edge = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.full(edge[-1], 0x20, np.uint8)
    text[np.arange(edge[-1] - count) + np.repeat(np.arange(count), size)] = data[held]
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), count, [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(text)])
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(count)     # words from here to the text's end
    out, word = [], None
    for k in range(n):
        whole = np.flatnonzero(left > k)
        if word is None:
            first, kind = _numbers(spans)
            word = kind
        else:
            first, kind = _numbers(pa.array(run[whole] * (count + 1) + word[whole + k]))
        at = whole[first]
        crc = crc32(text, edge[at], edge[at + k + 1] - 1)
        found, run = np.full(count, -1, np.int64), np.full(count, -1, np.int64)
        found[whole] = (crc % np.uint32(buckets)).astype(np.int64)[kind]
        run[whole] = kind
        out.append(found)
    return bounds, out


def bucket_counts(texts: DataFrame, n: int = N, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket, over all of ``texts`` (text); one row per bucket and task is shuffled."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                for found in features(data, offsets, n, buckets)[1]:
                    total += np.bincount(found[found >= 0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["bucket", "n"])
    out = np.zeros(buckets, np.int64)
    for row in texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket, floor(1000 ln) of its smoothed share of the target over that of the source."""
    buckets = len(source)
    s, t = float(source.sum()) + buckets, float(target.sum()) + buckets
    return np.array([math.floor(1000 * math.log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, n: int = N) -> DataFrame:
    """doc_id, n_words, n_features, weight per row of ``docs``."""
    def run(batches):
        table = np.append(gain, 0)                # -1 (no run here) gains nothing
        for batch in batches:
            words, held, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for lo, hi, data, offsets in chunks(batch.column(1)):
                bounds, found = features(data, offsets, n, len(gain))
                total = np.concatenate([[0], np.cumsum(sum(table[f] for f in found))])
                words[lo:hi] = size = np.diff(bounds)
                held[lo:hi] = many = sum(np.maximum(size - k, 0) for k in range(n))
                weight[lo:hi] = (total[bounds[1:]] - total[bounds[:-1]]) // np.maximum(many, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(held), pa.array(weight)],
                                             ["doc_id", "n_words", "n_features", "weight"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, scratch: Scratch, n: int = N, buckets: int = BUCKETS, percent: int = PERCENT,
             least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank per row of ``docs``.

    ``target`` (text) is the distribution to draw towards. Of the documents
    with ``least_words`` words, ``percent`` in a hundred are drawn and have a
    rank, 1 being the highest score; the others' rank is null.
    """
    gain = gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets))
    noise = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), F.lit(8)), 16, 10)
    scored = scratch.save(weights(docs, gain, n).withColumn("score", F.col("weight") + F.floor(
        F.lit(-1000.0) * F.log(-F.log((noise.cast("double") + 0.5) / 4294967296.0))).cast("long")), "scored")
    able = F.col("n_words") >= least_words
    drawn = scored.where(able).agg(F.floor(F.count("*") * percent / 100).alias("drawn"))
    ranked = positions(scored, [able.desc(), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("weight"), F.asc("n_features")])
    return ranked.withColumn("_drawn", drawn.scalar()) \
        .select(*scored.columns, F.when(able & (F.col("_pos") <= F.col("_drawn")), F.col("_pos")).alias("rank"))


def sample(docs: DataFrame, resampled: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id was drawn."""
    ids = resampled.where("rank is not null").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(ids, F.col("doc_id").cast("long") == F.col("__id"), "left_semi")


def oracle(n_buckets: int = BUCKETS) -> str:
    """DuckDB SQL of the registered query."""
    bytes_ = "list_transform(range(octet_length(encode(f))), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT))"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH steps AS (
  SELECT list(c ORDER BY i) AS step FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM range(256) t(i))),
texts AS (
  SELECT 's' AS side, row_number() OVER () AS k, doc_id, text FROM documents
  UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark),
words AS (
  SELECT side, k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts),
runs AS (
  SELECT side, k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words),
crcs AS (
  SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_}),
           lambda c, b: xor(c // 256, step[xor(c, b) % 256 + 1])), 4294967295) % {n_buckets} AS bucket
  FROM (SELECT DISTINCT f FROM runs), steps),
counts AS (
  SELECT bucket, sum((side = 's')::INT) AS s, sum((side = 't')::INT) AS t FROM runs JOIN crcs USING (f) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * ((sum(s) OVER ())::DOUBLE + {n_buckets})
           / ((s + 1)::DOUBLE * ((sum(t) OVER ())::DOUBLE + {n_buckets})))) AS BIGINT) AS gain FROM counts),
sums AS (SELECT k, sum(gain) AS total FROM runs JOIN crcs USING (f) JOIN gains USING (bucket) WHERE side = 's' GROUP BY k),
weighed AS (
  SELECT doc_id, len(w) AS n_words, len(w) + greatest(len(w) - 1, 0) AS n_features,
         CASE WHEN len(w) = 0 THEN 0 ELSE CAST(floor(total::DOUBLE / (2 * len(w) - 1)) AS BIGINT) END AS weight
  FROM words LEFT JOIN sums USING (k) WHERE side = 's'),
scored AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 8) AS BIGINT) + 0.5::DOUBLE)
           / 4294967296))) AS BIGINT) AS score FROM weighed),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST, weight, n_features) AS place,
         count(*) OVER (PARTITION BY n_words >= {LEAST_WORDS}) AS n FROM scored)
SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CASE WHEN n_words >= {LEAST_WORDS} AND place <= {PERCENT} * n // 100 THEN place END AS rank
FROM ranked"""
