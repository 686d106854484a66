"""Cost-balanced packing of documents into token sequences.

Attention over a piece of n tokens costs ``n * LINEAR + n * n * QUADRATIC``.
Whole stretches of ``capacity`` tokens are sequences of their own. The rests
(shorter than a sequence, so bounded) are dealt into pools of about ``POOL``
documents by a hash of id, text, input partition and, for equal rows of a
partition, their number there; so a lost task deals its rows again as before,
and equal rows, even a third of the table, go to many pools. Each pool opens as many sequences as its tokens
fill, and documents in descending cost go to the sequence of lowest cost that
still has room; where none has room, the document is cut to fill the sequence
with the most room. Every sequence but a pool's last is then full. The last
one needs no padding when its length is a power of two.

Tokenising happens once; what is shuffled is one row per document with the
ids of its rest and the checksums of its full stretches. Several rows of one
id are told apart by their order within the pool.

Defined results: a null or empty text has only the end token; rows that repeat
an id are packed each; rows with a null id too (doc_id null); an empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import mix

CAPACITY = 2048
END = 1                        # id that ends a document
POOL = 2048                    # documents per pool, about
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
SPECIAL = "<|endoftext|>"      # the vocabulary's one special token

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    """Path of the public 50k byte-pair vocabulary."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def cost(length: int) -> float:
    return LINEAR * length + QUADRATIC * length * length


def encoder(path: str):
    """text -> ids, as the tokenizer file at ``path`` encodes without added special tokens.

    The rule: a byte-pair vocabulary ``x.json`` is read from its ranks
    ``x.tiktoken`` where they lie beside it (the same ids, three times faster).
    Texts that contain the special token's string, and vocabularies without
    ranks, go to the file's own tokenizer, which is opened when first needed.
    """
    exact = []

    def slow(text):
        if not exact:
            from tokenizers import Tokenizer
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            exact.append(Tokenizer.from_file(path))
        return exact[0].encode(text, add_special_tokens=False).ids
    ranks = os.path.splitext(path)[0] + ".tiktoken"
    if not os.path.exists(ranks):
        return slow
    import base64

    import public_tokenizers
    import tiktoken
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return lambda text: slow(text) if SPECIAL in text else fast.encode_ordinary(text)


def assign(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) of each piece; items shorter than ``capacity``.

    All sequences with room are searched: one heap of (cost, sequence) per
    amount of room, and a segment tree over the amounts with the least entry of
    each stretch, so the cheapest with room for n is found in logarithmic time.
    """
    total = sum(lengths)
    opened = -(-total // capacity)
    room = [capacity] * opened
    if opened:
        room[-1] = total - capacity * (opened - 1)
    last = room[-1] if opened else 0
    spent = [0.0] * opened
    leaves = 1 << capacity.bit_length()
    none = (float("inf"), 0)
    tree = [none] * (2 * leaves)
    heaps = {}

    def settle(amount: int):
        heap = heaps.get(amount)
        at = leaves + amount
        tree[at] = heap[0] if heap else none
        while at > 1:
            at >>= 1
            tree[at] = min(tree[2 * at], tree[2 * at + 1])

    def cheapest(n: int):
        lo, hi, best = leaves + n, 2 * leaves, none
        while lo < hi:
            if lo & 1:
                best = min(best, tree[lo])
                lo += 1
            lo >>= 1
            hi >>= 1
        return best

    def most() -> int:
        at = 1
        while at < leaves:
            at = 2 * at + (tree[2 * at + 1] != none)
        return min(k for _, k in heaps[at - leaves])

    for k, amount in enumerate(room):
        heaps.setdefault(amount, []).append((0.0, k))
    for amount in heaps:
        settle(amount)
    out = []
    todo = [(-cost(n), k, 0, n) for k, n in enumerate(lengths) if n]
    heapq.heapify(todo)
    while todo:
        _, item, start, n = heapq.heappop(todo)
        found = cheapest(n)
        at = found[1] if found != none else most()
        amount = room[at]
        take = min(n, amount)
        out.append((item, start, take, at, (capacity if at < opened - 1 else last) - amount))
        heap = heaps[amount]
        if found != none:
            heapq.heappop(heap)
        else:
            heap.remove((spent[at], at))
            heapq.heapify(heap)
        settle(amount)
        room[at] -= take
        spent[at] += cost(take)
        if room[at]:
            heapq.heappush(heaps.setdefault(room[at], []), (spent[at], at))
            settle(room[at])
        if take < n:
            heapq.heappush(todo, (-cost(n - take), item, start + take, n - take))
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document: see ``PIECES``; ids_crc32 is over
    little-endian unsigned 32-bit ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("key"))
    pools = max(1, -(-docs.count() // POOL))

    def encode(batches):
        to_ids, task, seen = encoder(tokenizer), TaskContext.get().partitionId(), {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                total, full, rest, place = [], [], [], []
                for key in part.column(2).to_pylist():
                    seen[key] = count = seen.get(key, -1) + 1
                    place.append((key, task, count))
                lots = np.array(place, np.int64).view(np.uint64)
                pool = mix(mix(mix(lots[:, 0]) ^ lots[:, 1]) ^ lots[:, 2]) % np.uint64(pools)
                for text in part.column(1):
                    ids = np.array([*to_ids(text.as_py() or ""), END], "<u4")
                    whole = len(ids) // capacity
                    total.append(len(ids))
                    full.append([zlib.crc32(ids[k * capacity:(k + 1) * capacity].tobytes()) for k in range(whole)])
                    rest.append(ids[whole * capacity:].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pool.astype(np.int32)), part.column(0), pa.array(total, pa.int64()), pa.array(full, pa.list_(pa.int64())), pa.array(rest, pa.binary())],
                    ["pool", "doc_id", "tokens", "full", "rest"])

    def pool(f: pd.DataFrame) -> pd.DataFrame:
        f = f.assign(sums=[tuple(x) for x in f.full]).sort_values(["doc_id", "tokens", "sums", "rest"], kind="stable", ignore_index=True)
        base = int(f.pool.iloc[0]) << 32
        out, used = [], 0
        ids = [None if pd.isna(x) else int(x) for x in f.doc_id]
        for k, sums in enumerate(f.sums):
            for j, crc in enumerate(sums):
                out.append((ids[k], j * capacity, capacity, crc, int(f.tokens[k]), base + used, 0))
                used += 1
        rests = list(f.rest)
        for item, start, n, at, offset in assign([len(r) // 4 for r in rests], capacity):
            first = len(f.sums[item]) * capacity
            out.append((ids[item], first + start, n, zlib.crc32(rests[item][4 * start:4 * (start + n)]), int(f.tokens[item]), base + used + at, offset))
        out = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        return out.astype({"doc_id": "Int64"})

    return rows.mapInArrow(encode, "pool int, doc_id long, tokens long, full array<long>, rest binary") \
        .groupBy("pool").applyInPandas(pool, PIECES)
