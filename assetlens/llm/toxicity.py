"""Toxicity: weak supervision, then a linear classifier on posterior labels.

* **Voters.** Each fires on a text or abstains: five small insult lexicons,
  patterns (an insult near a pronoun, several different insults, shouting,
  strings of marks) and terms that training labels set apart (words and word
  beginnings of 4 to 6 bytes, which carry over to inflected forms and to other
  languages; dealt to ``INDUCED`` voters by how telling they are).
* **Label model.** Vote patterns are counted over all documents (at most
  2**voters rows). A generative model with a latent label is fitted by EM on
  those counts: a class prior, per-class fire rates (accuracies) and, for
  correlated voters, the best tree of pairwise dependences given the label
  (re-estimated every round), so that agreeing voters that copy each other
  don't count twice. Patterns of labelled training rows keep their label.
* **Classifier.** Logistic regression on hashed words and word beginnings,
  trained on the driver on at most ``SAMPLE`` documents outside the held-out
  fold with the label model's posteriors as soft labels (given a training
  label, that label). It scores every
  whole text.

Defined results: null and empty texts get the classifier's score without
features (its intercept); rows that repeat an id are scored each (one of an
id's texts is learned from); a null id
counts as held out and is never learned from; null or contradicting labels of
an id are ignored; without labels the lexicons and patterns alone vote; an
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch
from .common import held_out, one_text, thinned
from .quality import training_rows
from .textops import LOWER, chunks, hash_spans, shingle_sets, span_hasher, tokens

# Insult lexicons of the voters.
LEXICONS = {
    "intellect": "idiot idiots moron morons stupid dumb imbecile cretin fool dunce halfwit",
    "worth": "worthless useless pathetic loser losers failure nobody waste",
    "disgust": "disgusting scum trash filth filthy vile garbage vermin repulsive gross",
    "mockery": "clown clowns joke freak creep weirdo pig rat",
    "hostility": "hate kill die shut damn hell bastard bitch fuck fucking shit asshole crap",
}
PRONOUNS = "you your you're u he she they him her them i are is"

SAMPLE = 12_288               # documents that the classifier is fitted on, at most
LABELLED = 16_384             # labelled rows that terms are induced from, at most
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
CHUNK = 256 << 10
PREFIXES = (4, 5, 6)
INDUCED = 4
TELLING = 5                   # least likelihood ratio of a term that votes
VOTERS = len(LEXICONS) + 4 + INDUCED
ROUNDS = 1000


def _hash_words(text: str) -> np.ndarray:
    raw = [w.encode() for w in text.split()]
    data = np.frombuffer(b"".join(raw), np.uint8)
    end = np.cumsum([len(w) for w in raw])
    return np.sort(hash_spans(data, end - [len(w) for w in raw], end))


def _in(sorted_set: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_set, x), len(sorted_set) - 1)
    return sorted_set[at] == x


def keys_of(data, offsets):
    """(document, term bucket) of every word and word beginning, as they come;
    token hashes; and (document, shape, bounds) of the tokens."""
    start, end, shape, bounds = tokens(data, offsets)
    spans = span_hasher(LOWER[data])
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    word = shape < 3
    whole = spans(start, end)
    docs, keys = [doc[word]], [whole[word]]
    for size in PREFIXES:
        long = word & (end - start > size)
        docs.append(doc[long])
        keys.append(spans(start[long], start[long] + size) ^ np.uint64(size << 56))
    return np.concatenate(docs), (np.concatenate(keys) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), whole, (doc, shape, bounds)


def terms(data, offsets):
    """Distinct (document, term bucket) pairs, in order."""
    doc, key, _, _ = keys_of(data, offsets)
    pairs = np.unique(doc * BUCKETS + key)
    return pairs // BUCKETS, pairs % BUCKETS


def vote_bits(data, offsets, induced: np.ndarray) -> np.ndarray:
    """Bit k of a text's number is set when voter k fires."""
    doc, key, whole, (at, shape, bounds) = keys_of(data, offsets)
    n = len(bounds) - 1
    fires = np.zeros((n, VOTERS), bool)
    insult = np.zeros(len(whole), bool)
    for k, text in enumerate(LEXICONS.values()):
        hit = _in(_hash_words(text), whole)
        fires[at[hit], k] = True
        insult |= hit
    k = len(LEXICONS)
    near, pronoun = np.zeros(len(whole), bool), _in(_hash_words(PRONOUNS), whole)
    for step in (1, 2, 3):
        near[step:] |= pronoun[:-step] & (at[step:] == at[:-step])
    fires[at[insult & near], k] = True
    hits = np.unique(np.stack([at[insult].astype(np.uint64), whole[insult]]), axis=1)[0].astype(np.int64)
    fires[:, k + 1] = np.bincount(hits, minlength=n)[:n] >= 2
    size = np.maximum(np.diff(bounds), 1)
    fires[:, k + 2] = np.bincount(at[shape == 2], minlength=n)[:n] > 0.3 * size
    fires[:, k + 3] = np.bincount(at[shape == 5], minlength=n)[:n] > 0.1 * size
    voter = induced[key]
    fires[doc[voter >= 0], k + 4 + voter[voter >= 0]] = True
    return fires @ (1 << np.arange(VOTERS))


def distinct_texts(rows: DataFrame, by: str) -> DataFrame:
    """One row per ``by`` and fingerprint (least five-word shingle), so that groups
    of copies don't make their ordinary words look telling. For bounded samples."""
    def run(batches):
        for batch in batches:
            least = [int(s[0].view(np.int64)) if len(s) else 0 for s in shingle_sets(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(least, pa.int64())],
                                             ["doc_id", by, "text", "mark"])
    kind = dict(rows.dtypes)[by]
    return rows.select("doc_id", by, "text").mapInArrow(run, f"doc_id long, {by} {kind}, text string, mark long") \
        .groupBy(by, "mark").agg(F.min_by(F.struct("doc_id", "text"), F.struct("doc_id", F.xxhash64("text"))).alias("r")) \
        .select("r.doc_id", by, "r.text")


def _tail(k: int, n: int, p: float) -> float:
    """Probability of ``k`` or more of ``n`` at rate ``p``."""
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
           for i in range(int(k), int(n) + 1)]
    return min(1.0, sum(map(math.exp, log)))


def induce(rows: DataFrame) -> np.ndarray:
    """Voter of each term bucket (-1: none), from labelled training rows (y, text).

    A term votes when it is at least ``TELLING`` times likelier in documents
    labelled toxic, with one added to each count, and so many of its documents
    being toxic is, by chance, not expected of even one of the terms (binomial
    tail). So rare languages need few documents, and the bar rises with the
    vocabulary. The most telling terms share the first voter, and so on.
    """
    def run(batches):
        for batch in batches:
            counts, n = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
            y = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in chunks(batch.column(1), CHUNK):
                doc, key = terms(data, offsets)
                for c in (0, 1):
                    counts[c] += np.bincount(key[y[lo + doc] == c], minlength=BUCKETS)
                    n[c] += int((y[lo:hi] == c).sum())
            used = np.flatnonzero(counts.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(counts[0, used], n[0])),
                                              pa.array(np.append(counts[1, used], n[1]))], ["key", "c0", "c1"])
    found = rows.select("y", "text").mapInArrow(run, "key long, c0 long, c1 long") \
        .groupBy("key").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).toPandas().set_index("key")
    out = np.full(BUCKETS, -1, np.int64)
    if len(found):
        n0, n1 = found.loc[-1, "c0"], found.loc[-1, "c1"]
        found = found[found.index >= 0]
        ratio = ((found.c1 + 1) / (n1 + 2) / ((found.c0 + 1) / (n0 + 2))).to_numpy()
        c0, c1 = found.c0.to_numpy(), found.c1.to_numpy()
        good = np.array([k for k in np.flatnonzero(ratio >= TELLING)
                         if _tail(c1[k], c0[k] + c1[k], (n1 + 1) / (n0 + n1 + 2)) * len(found) < 1], np.int64)
        good = good[np.argsort(-ratio[good], kind="stable")]
        out[found.index.to_numpy()[good]] = np.arange(len(good)) * INDUCED // max(1, len(good))
    return out


def _tree(votes, weight):
    """Parent of each voter (-1: root) in the best tree of dependences given the label."""
    m = votes.shape[1]
    info = np.zeros((m, m))
    total = weight.sum()
    for y in (0, 1):
        w = weight[:, y]
        n = w.sum() + 1e-9
        p1 = np.clip(votes.T @ w / n, 1e-9, 1 - 1e-9)
        p11 = (votes * w[:, None]).T @ votes / n
        for a, pa_, b, pb_, joint in ((1, p1, 1, p1, p11), (1, p1, 0, 1 - p1, p1[:, None] - p11),
                                      (0, 1 - p1, 1, p1, p1[None, :] - p11),
                                      (0, 1 - p1, 0, 1 - p1, 1 - p1[:, None] - p1[None, :] + p11)):
            joint = np.clip(joint, 1e-12, 1)
            info += n / total * joint * np.log(joint / np.clip(np.outer(pa_, pb_), 1e-12, 1))
    parent, inside = np.full(m, -1), [0]
    while len(inside) < m:
        rest = [k for k in range(m) if k not in inside]
        k, j = max(((k, j) for k in rest for j in inside), key=lambda e: info[e])
        parent[k] = j
        inside.append(k)
    return parent


class LabelModel:
    """P(label) and P(voter | its parent voter, label), fitted by EM on pattern counts."""

    def __init__(self, patterns: np.ndarray, known: np.ndarray, counts: np.ndarray):
        votes = (patterns[:, None] >> np.arange(VOTERS) & 1).astype(float)
        strong = votes[:, :len(LEXICONS)].any(axis=1) | votes[:, -INDUCED:].any(axis=1)
        q = np.where(known >= 0, known, np.where(strong, 0.9, 0.02)).astype(float)
        for _ in range(30):
            weight = np.stack([counts * (1 - q), counts * q], axis=1)
            self.prior = (weight.sum(axis=0) + 1) / (weight.sum() + 2)
            self.parent = _tree(votes, weight)
            self.rate = np.empty((VOTERS, 2, 2))          # voter, parent's vote, label
            for k, p in enumerate(self.parent):
                above = votes[:, p] if p >= 0 else np.zeros(len(votes))
                for v in (0, 1):
                    w = weight * (above == v)[:, None]
                    base = (weight.T @ votes[:, k] + 0.5) / (weight.sum(axis=0) + 1)
                    self.rate[k, v] = (w.T @ votes[:, k] + 2 * base) / (w.sum(axis=0) + 2)
            new = np.where(known >= 0, known, self.posterior(patterns))
            done = np.abs(new - q).max(initial=0) < 1e-6
            q = new
            if done:
                break

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        votes = patterns[:, None] >> np.arange(VOTERS) & 1
        log = np.tile(np.log(self.prior), (len(votes), 1))
        for k, p in enumerate(self.parent):
            rate = self.rate[k][votes[:, p] if p >= 0 else np.zeros(len(votes), int)]
            log += np.log(np.where(votes[:, k, None] == 1, rate, 1 - rate).clip(1e-9))
        return 1 / (1 + np.exp((log[:, 0] - log[:, 1]).clip(-50, 50)))


def votes_of(docs: DataFrame, induced: np.ndarray) -> DataFrame:
    """doc_id, votes per row."""
    sent = docs.sparkSession.sparkContext.broadcast(induced)

    def run(batches):
        for batch in batches:
            bits = [np.zeros(0, np.int64)] + [vote_bits(d, o, sent.value) for _, _, d, o in chunks(batch.column(1), CHUNK)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(bits), pa.int64())], ["doc_id", "votes"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, votes long")


def _regression(key: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of buckets and intercept: Adagrad on soft labels with an l2 penalty.

    ``key`` holds the rows' buckets, one row's (``sizes``) after another's; they are
    read in blocks of rows, here and in every round, so that only a block is ever widened.

    Only buckets that eight rows or more have, and which tell the classes
    apart beyond chance (three standard errors), get a weight.
    """
    n1, n0, count = (weight * y).sum(), (weight * (1 - y)).sum(), len(sizes)
    bounds = np.concatenate([[0], np.cumsum(sizes)])

    def blocks():
        for lo in range(0, count, 512):
            hi = min(count, lo + 512)
            yield slice(lo, hi), key[bounds[lo]:bounds[hi]], np.repeat(np.arange(hi - lo, dtype=np.int16), sizes[lo:hi])
    have, p1, p0 = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS), np.zeros(BUCKETS)
    for rows, part, doc in blocks():
        have += np.bincount(part, minlength=BUCKETS)
        p1 += np.bincount(part, (weight * y)[rows][doc], BUCKETS)
        p0 += np.bincount(part, (weight * (1 - y))[rows][doc], BUCKETS)
    p1, p0, both = p1 / max(n1, 1e-9), p0 / max(n0, 1e-9), have / max(count, 1)
    told = (have >= 8) & (np.abs(p1 - p0) > 3 * np.sqrt(both * (1 - both) * (1 / max(y.sum(), 1) + 1 / max((1 - y).sum(), 1))) + 0.002)
    names, place = np.flatnonzero(told), (np.cumsum(told) - 1).astype(np.int32)
    kept = [(rows, place[part[told[part]]], doc[told[part]]) for rows, part, doc in blocks()]
    del key
    w, b = np.zeros(len(names)), float(np.log((n1 + 1) / (n0 + 1)))
    g2, b2, step = np.full(len(names), 1e-8), 1e-8, 0.3
    scale = weight / weight.sum()
    for _ in range(ROUNDS):
        g, gb = 1e-5 * w, 0.0
        for rows, col, doc in kept:
            z = np.bincount(doc, w[col], rows.stop - rows.start) + b
            error = (1 / (1 + np.exp(-z.clip(-40, 40))) - y[rows]) * scale[rows]
            g += np.bincount(col, error[doc], len(names))
            gb += error.sum()
        g2, b2 = g2 + g * g, b2 + gb * gb
        w, b = w - step * g / np.sqrt(g2), b - step * gb / np.sqrt(b2)
    out = np.zeros(BUCKETS, np.float32)
    out[names] = w
    return out, b


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> tuple[np.ndarray, float]:
    """Weights and intercept of the linear classifier."""
    known = training_rows(docs, labels, "toxic", LABELLED)
    induced = induce(distinct_texts(known, "y"))
    votes = scratch.save(votes_of(docs, induced), "votes")
    ids = known.select("doc_id", "y").distinct()
    counts = votes.where(~held_out()).join(F.broadcast(ids), "doc_id", "left") \
        .unionByName(votes.where(held_out()).withColumn("y", F.lit(None).cast("int"))) \
        .groupBy("votes", "y").agg(F.count("*").alias("n")).toPandas()
    if counts.empty:
        return np.zeros(BUCKETS, np.float32), 0.0
    model = LabelModel(counts.votes.to_numpy(np.int64), counts.y.fillna(-1).to_numpy(float), counts.n.to_numpy(float))

    # Half of the sample from either side of the posterior, weighted back to the corpus.
    patterns = np.unique(counts.votes.to_numpy(np.int64))
    q = model.posterior(patterns)
    spark = docs.sparkSession
    side = spark.createDataFrame([(int(p), float(x)) for p, x in zip(patterns, q)], "votes long, q double")
    pool = votes.where("doc_id is not null").where(~held_out()).join(F.broadcast(side), "votes") \
        .join(F.broadcast(ids), "doc_id", "left").withColumn("q", F.coalesce(F.col("y").cast("double"), "q")).drop("y")
    total = dict(pool.groupBy((F.col("q") >= 0.5).alias("hot")).count().collect())
    draw = lambda hot: pool.where(F.col("q") >= 0.5 if hot else F.col("q") < 0.5) \
        .groupBy("doc_id").agg(F.max("q").alias("q"))
    drawn = thinned(draw(True), F.xxhash64("doc_id"), SAMPLE // 2).union(thinned(draw(False), F.xxhash64("doc_id"), SAMPLE // 2)) \
        .groupBy("doc_id").agg(F.max("q").alias("q"))

    def run(batches):
        for batch in batches:
            out = []
            for lo, hi, data, offsets in chunks(batch.column(1), CHUNK):
                doc, key = terms(data, offsets)
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                out += [key[cut[k]:cut[k + 1]].astype(np.int32).tobytes() for k in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["q", "keys"])
    rows = one_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id"), "q")
    rows = distinct_texts(rows, "q").select("q", "text").mapInArrow(run, "q double, keys binary").toPandas()
    if rows.empty:
        return np.zeros(BUCKETS, np.float32), 0.0
    rows = rows.sort_values(["q", "keys"], kind="stable")[:SAMPLE]
    y = rows.q.to_numpy()
    hot = y >= 0.5
    weight = np.where(hot, total.get(True, 0) / max(hot.sum(), 1), total.get(False, 0) / max((~hot).sum(), 1))
    keys = list(rows["keys"])
    del rows
    return _regression(np.frombuffer(b"".join(keys), np.int32), np.array([len(k) // 4 for k in keys], np.int64), y, weight)


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        w, b = sent.value
        for batch in batches:
            out = [np.zeros(0)]
            for lo, hi, data, offsets in chunks(batch.column(1), CHUNK):
                doc, key, _, _ = keys_of(data, offsets)
                told = w[key] != 0
                pairs = np.unique(doc[told] * BUCKETS + key[told])
                out.append(np.bincount(pairs // BUCKETS, w[pairs % BUCKETS], hi - lo) + b)
            s = 1 / (1 + np.exp(-np.concatenate(out).clip(-40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    return score(docs, train(docs, labels, scratch)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
