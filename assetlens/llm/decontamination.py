"""Benchmark decontamination: n-gram seeds, rare ones alone, then Smith-Waterman.

1. Document frequency of every benchmark trigram over the whole corpus
   (counted per task, summed by trigram).
2. Rare seeds of an item: among its trigrams that occur in the corpus at all,
   the rarest half (``LEAST_SEEDS`` at least).
3. Each document's trigrams are matched with all trigrams of the items. Hits
   of one item that lie near one diagonal form a window; a window with a rare
   seed, or with two different trigrams of any frequency, is aligned with the
   item by Smith-Waterman over words. So trigrams that live on only in another
   copy of the item can't crowd out those of an edited copy. The score is the
   alignment's share of a perfect one; ``LEAST_SCORE`` or more is a leak.

Windows reach as far as an alignment of the least score can, and pairs are
left out before the alignment only where the item's words that the document
holds are too few for that score; neither changes the result.

The benchmark is the stated query set: it is sent to the tasks in blocks of at
most ``BLOCK_BYTES`` of text (and one item), whatever its size, and documents
are never shuffled. Words are runs of letters and digits, A-Z lower-cased.

Defined results: null and empty texts or items match nothing; items of fewer
than ``N`` words have no trigram and can't leak, nor can a copy edited so
densely that no trigram is left; ``seeds`` counts the different trigrams of the
item in the aligned window; repeated documents or items are reported each; rows with a null id are scanned too (null id in the
result); empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sent
from .textops import LOWER, chunks, hash_spans, mix, ngrams, tokens

N = 3
LEAST_SEEDS = 8
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST_SCORE = 0.5
BLOCK_BYTES = 8 << 20
SLOTS = 1 << 20                # hits times items that are looked at together
REPORT = "doc_id long, item_id long, score double, start_word long, end_word long, seeds long"


def word_hashes(data, offsets):
    """(word hashes, bounds) of a chunk; punctuation is left out."""
    start, end, shape, _ = tokens(data, offsets)
    start, end = start[shape < 4], end[shape < 4]
    return hash_spans(LOWER[data], start, end), np.searchsorted(start, offsets)


def _grams(hashes, bounds):
    """Trigram at each word, and whether it lies within one text."""
    grams = ngrams(hashes, N)
    inside = np.ones(len(hashes), bool)
    for k in range(1, N):
        ends = bounds[1:] - k
        inside[ends[(ends >= bounds[:-1])]] = False
    return grams, inside[:len(grams)]


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(score, start, end) of the best local alignment of ``b`` within ``a``."""
    width = len(a)
    steps = np.arange(width + 1) * -GAP
    row, came = np.zeros(width + 1, np.int64), np.arange(width + 1)
    best, where = 0, (0, 0)
    for word in b:
        diagonal = row[:-1] + np.where(a == word, MATCH, MISMATCH)
        above = row + GAP
        new, source = above.copy(), came.copy()
        take = diagonal >= above[1:]
        new[1:][take], source[1:][take] = diagonal[take], came[:-1][take]
        fresh = new <= 0
        new[fresh], source[fresh] = 0, np.arange(width + 1)[fresh]
        # A gap along the row: the best earlier cell less the distance.
        lifted = new + steps
        top = np.maximum.accumulate(lifted)
        at = np.maximum.accumulate(np.where(lifted == top, np.arange(width + 1), 0))
        new = top - steps
        source = source[at]
        k = int(new.argmax())
        if new[k] > best:
            best, where = int(new[k]), (int(source[k]), k)
        row, came = new, source
    return best, *where


class Index:
    """Items of one block, their trigrams (sorted), where each lies and whether it is rare."""

    def __init__(self, items: list, texts: list):
        self.items, self.words = items, []
        for _, _, data, offsets in chunks(pa.array(texts, pa.string())):
            hashes, bounds = word_hashes(data, offsets)
            self.words += [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.flat = np.concatenate([np.zeros(0, np.uint64), *self.words])
        self.ends = np.cumsum(self.size)
        per = [ngrams(w, N) for w in self.words]
        self.gram = np.concatenate([np.zeros(0, np.uint64), *per])
        self.item = np.repeat(np.arange(len(per)), [len(p) for p in per])
        self.at = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(p)) for p in per)])
        by = np.lexsort((self.at, self.item, self.gram))
        self.gram, self.item, self.at = self.gram[by], self.item[by], self.at[by]
        self.key, self.first = np.unique(self.gram, return_index=True)
        self.last = np.append(self.first[1:], len(self.gram))
        self.rare = np.zeros(len(self.gram), bool)

    def hits(self, grams, inside):
        """(position, key number) of each word whose trigram is in the index."""
        if not len(self.key):
            return np.zeros((2, 0), np.int64)
        at = np.minimum(np.searchsorted(self.key, grams), len(self.key) - 1)
        pos = np.flatnonzero((self.key[at] == grams) & inside)
        return pos, at[pos]

    def mark_rare(self, frequency: np.ndarray):
        """Mark each item's rare seeds, given the document frequency of each key."""
        df = frequency[np.searchsorted(self.key, self.gram)]
        by = np.lexsort((self.at, self.gram, df, self.item))
        by = by[df[by] > 0]
        item, gram = self.item[by], self.gram[by]
        new = np.ones(len(by), bool)
        new[1:] = (item[1:] != item[:-1]) | (gram[1:] != gram[:-1])
        rank = np.cumsum(new) - 1
        start = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(start, item[new] + 1, 1)
        count, start = start[1:], np.cumsum(start)
        self.rare[by[rank - start[item] < np.maximum(LEAST_SEEDS, (count[item] + 1) // 2)]] = True

    def held(self, words: np.ndarray) -> np.ndarray:
        """Of each item, how many of its words are among ``words``."""
        total = np.concatenate([[0], np.cumsum(np.isin(self.flat, words))])
        return total[self.ends] - total[self.ends - self.size]


def _slots(index: Index, pos, key, doc, hashes, bounds, least: float):
    """(position, slot, document) of every hit and item, some whole documents at a time."""
    many = index.last[key] - index.first[key]

    def expand(a, b):
        n = many[a:b]
        slot = np.repeat(index.first[key[a:b]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(pos[a:b], n), slot, np.repeat(doc[a:b], n)
    total = np.concatenate([[0], np.cumsum(many)])
    cut = np.append(np.flatnonzero(np.diff(doc, prepend=-1)), len(doc))
    lo = 0
    while lo < len(cut) - 1:
        hi = max(lo + 1, int(np.searchsorted(total[cut], total[cut[lo]] + SLOTS, "right")) - 1)
        a, b = cut[lo], cut[hi]
        if total[b] - total[a] <= SLOTS:
            yield expand(a, b)
        else:                  # one document: only items of which it holds enough words
            d = doc[a]
            able = index.held(hashes[bounds[d]:bounds[d + 1]]) >= least * index.size
            parts = []
            while a < b:
                c = min(b, max(a + 1, int(np.searchsorted(total, total[a] + SLOTS, "right")) - 1))
                part = expand(a, c)
                keep = able[index.item[part[1]]]
                parts.append([x[keep] for x in part])
                a = c
            yield tuple(np.concatenate(x) for x in zip(*parts))
        lo = hi


def _able(index: Index, doc, item, hashes, bounds, least: float) -> np.ndarray:
    """Whether each pair's document holds enough words of the item to reach ``least``."""
    salt = lambda d: mix(d.astype(np.uint64) + np.uint64(1))
    docs = np.unique(doc)
    size = bounds[docs + 1] - bounds[docs]
    at = np.repeat(bounds[docs], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    known = np.unique(hashes[at] ^ salt(np.repeat(docs, size)))
    out = np.zeros(len(doc), bool)
    step = max(1, SLOTS // max(1, int(index.size.max())))
    for k in range(0, len(doc), step):
        d, i = doc[k:k + step], item[k:k + step]
        n = index.size[i]
        end = np.cumsum(n)
        at = np.repeat(index.ends[i] - n, n) + np.arange(n.sum()) - np.repeat(end - n, n)
        asked = index.flat[at] ^ salt(np.repeat(d, n))
        found = known[np.minimum(np.searchsorted(known, asked), len(known) - 1)] == asked
        out[k:k + step] = np.add.reduceat(found, end - n, dtype=np.int64) >= least * n
    return out


def leaks(column: pa.Array, index: Index, least: float):
    """(row, item number, score, start word, end word, seeds), best per row and item."""
    for lo, _, data, offsets in chunks(column):
        hashes, bounds = word_hashes(data, offsets)
        pos, key = index.hits(*_grams(hashes, bounds))
        if not len(pos):
            continue
        doc = np.searchsorted(bounds, pos, "right") - 1
        for pos, slot, doc in _slots(index, pos, key, doc, hashes, bounds, least):
            best = _aligned(index, pos, slot, doc, hashes, bounds, least)
            for (d, i), found in best.items():
                yield lo + d, i, *found


def _aligned(index: Index, pos, slot, doc, hashes, bounds, least: float) -> dict:
    """(document, item number) -> (score, start word, end word, seeds) of its best window."""
    item, begin = index.item[slot], pos - index.at[slot]
    by = np.lexsort((pos, begin, item, doc))
    slot, item, begin, doc = slot[by], item[by], begin[by], doc[by]
    # An alignment of the least score has so many gaps at most.
    drift = np.floor(2 * index.size * (1 - least)).astype(np.int64)
    turn = np.ones(len(doc), bool)
    turn[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (np.diff(begin) > drift[item[1:]])
    window = np.cumsum(turn) - 1
    first = np.flatnonzero(turn)
    last = np.append(first[1:], len(doc)) - 1
    key = np.searchsorted(index.key, index.gram[slot])
    by = np.lexsort((key, window))
    other = np.ones(len(doc), bool)
    other[1:] = (key[by][1:] != key[by][:-1]) | (window[by][1:] != window[by][:-1])
    seeds = np.bincount(window[by], other, len(first)).astype(np.int64)
    rare = np.bincount(window, index.rare[slot], len(first)) > 0
    asked = np.flatnonzero((seeds >= 2) | rare)
    if len(asked):
        asked = asked[_able(index, doc[first[asked]], item[first[asked]], hashes, bounds, least)]
    best = {}
    for w in asked.tolist():
        a, b = first[w], last[w]
        words, d = index.words[item[a]], int(doc[a])
        pad = int(drift[item[a]])
        x = max(int(bounds[d]), int(begin[a]) - pad)
        y = min(int(bounds[d + 1]), int(begin[b]) + len(words) + pad)
        if np.isin(words, hashes[x:y]).sum() < least * len(words):
            continue
        value, s, e = smith_waterman(hashes[x:y], words)
        value /= MATCH * len(words)
        name = (d, int(item[a]))
        if value >= least and value > best.get(name, (0,))[0]:
            best[name] = (value, x - int(bounds[d]) + s, x - int(bounds[d]) + e, int(seeds[w]))
    return best


def indexes(docs: DataFrame, benchmark: DataFrame):
    """One seeded :class:`Index` per block of the benchmark."""
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    for block in range(blocks):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        rows.sort(key=lambda r: (r.item_id is None, r.item_id, r.text))
        index = Index([r.item_id for r in rows], [r.text for r in rows])
        sent = Sent(docs.sparkSession, index)

        def count(batches):
            index = sent.value
            total = np.zeros(len(index.key), np.int64)
            for batch in batches:
                for _, _, data, offsets in chunks(batch.column(0)):
                    hashes, bounds = word_hashes(data, offsets)
                    pos, key = index.hits(*_grams(hashes, bounds))
                    doc = np.searchsorted(bounds, pos, "right") - 1
                    pairs = np.unique(doc * max(1, len(total)) + key)
                    total += np.bincount(pairs % max(1, len(total)), minlength=len(total))
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["k", "n"])
        frequency = np.zeros(len(index.key), np.int64)
        for k, n in docs.select("text").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
            frequency[k] = n
        index.mark_rare(frequency)
        yield Sent(docs.sparkSession, index)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """doc_id, item_id, score, start_word, end_word, seeds per document and leaked item."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = docs.sparkSession.createDataFrame([], REPORT)
    for sent in indexes(docs, benchmark):
        def run(batches, sent=sent):
            index = sent.value
            for batch in batches:
                found = list(leaks(batch.column(1), index, least))
                ids = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                rest = [pa.array([f[k] for f in found], t) for k, t in ((2, pa.float64()), (3, pa.int64()), (4, pa.int64()), (5, pa.int64()))]
                yield pa.RecordBatch.from_arrays([ids, pa.array([index.items[f[1]] for f in found], pa.int64()), *rest],
                                                 ["doc_id", "item_id", "score", "start_word", "end_word", "seeds"])
        out = out.union(docs.mapInArrow(run, REPORT))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """``docs`` without the documents that hold a leaked item; no shuffle."""
    schema, at = docs.schema, docs.columns.index("text")
    for sent in indexes(docs, benchmark):
        def run(batches, sent=sent):
            index = sent.value
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[f[0] for f in leaks(batch.column(at), index, least)]] = False
                yield batch.filter(pa.array(keep))
        docs = docs.mapInArrow(run, schema)
    return docs
