"""Near-duplicate documents by b-bit MinHash.

Each text becomes its set of distinct five-word shingles (64-bit hashes).
128 minima are taken per set; bands of four full minima give candidate
buckets, and the two low bits of each minimum, packed into 32 bytes, give a
collision-corrected similarity estimate by counting equal bit pairs. Pairs
whose estimate is far below the threshold are dropped; the others are decided
exactly on full sets.

Shape of the job:

* Equal sets collapse first (a 128-bit digest of the set, map-side minimum),
  so a group of exact copies is one representative from there on.
* A bucket never becomes all pairs. A linear pass verifies every member with
  the hubs (least ids) of its buckets that it shares most bands with. What is
  then connected needs no further pairs. Buckets that still hold several
  components are chained into clusters, and members outside a cluster's
  largest component are compared with all others in pairs of blocks of bounded
  size: estimates first, full sets where an estimate allows a link. A pair of
  blocks returns one link per member and other component, never its pairs.
* Hot keys meet in skew-splittable joins or in blocks; components are
  computed by distributed star steps.
* Texts move only for sets that share a bucket: a bitmap of bounded size sifts
  the others out where they are read, before the exact join by id.

Defined results: null and empty texts have an empty set and link with
nothing; rows that repeat an id are linked with each other, whatever their
texts, and links of any of its texts are the id's (ids lie below 2**61); a row with a null id links with
nothing, has a null component and is kept; an empty table gives an empty
result; columns other than id and text are ignored.
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
from .textops import mix, shingle_sets

PERMUTATIONS = 128
BITS = 2
ROWS = 4                       # minima per band: 32 bands miss a pair at 0.75 with probability 5e-6
MARGIN = 0.22                  # of the estimate, 4.6 standard errors at 0.75
HUBS = 2                       # hubs that the linear pass verifies per member
NODES = 1 << 61                # further sets of a repeated id are nodes from here on; ids lie below
BLOCK_BYTES = 4 << 20          # of shingle sets in one block of a cluster, about; a task compares two blocks at a time
SIEVE_BITS = 16                # per wanted id: passes about one in sixteen of the other rows
SIEVE_WORDS = 1 << 20          # of 64 bits, at most; a fuller sieve passes more rows

SIGNATURE = "doc_id long, n_shingles long, digest binary, sig binary, bands array<long>"


def digest(s: np.ndarray) -> bytes:
    """128 bits of a set of hashes, whatever their order."""
    mixed = mix(s)
    return np.array([s.sum(dtype=np.uint64) ^ np.uint64(len(s)), (mixed * (mixed >> np.uint64(32) | np.uint64(1))).sum(dtype=np.uint64)]).tobytes()


def _signatures(sets, permutations: int, rows: int):
    """Per set: digest, packed low bits, band keys (None for an empty set)."""
    seeds = mix(np.arange(1, 2 * permutations + 1, dtype=np.uint64))
    mul = (seeds[:permutations] | np.uint64(1)).astype(np.uint32)
    add = (seeds[permutations:] >> np.uint64(32)).astype(np.uint32)
    salt = np.arange(permutations // rows, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    power = np.uint64(0x9E3779B97F4A7C15) ** np.arange(rows, dtype=np.uint64)
    for s in sets:
        if not len(s):
            yield None
            continue
        low = (s >> np.uint64(16)).astype(np.uint32)
        least = np.full(permutations, 0xFFFFFFFF, np.uint32)
        for k in range(0, len(low), 2048):
            np.minimum(least, (low[k:k + 2048, None] * mul + add).min(axis=0), out=least)
        bands = mix((least.reshape(-1, rows).astype(np.uint64) * power).sum(axis=1, dtype=np.uint64) + salt)
        kept = mix(least.astype(np.uint64)) & np.uint64((1 << BITS) - 1)
        bits = np.unpackbits(kept.astype(np.uint8)[:, None], axis=1)[:, -BITS:]
        yield digest(s), np.packbits(bits.ravel()).tobytes(), bands.view(np.int64)


def signatures(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, digest, sig, bands per row; nulls for an empty set."""
    def run(batches):
        for batch in batches:
            sizes, rows = [], []
            def sets():
                for s in shingle_sets(batch.column(1), words):
                    sizes.append(len(s))
                    yield s
            rows = list(_signatures(sets(), PERMUTATIONS, ROWS))
            part = lambda k: [r and r[k] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(part(0), pa.binary()),
                 pa.array(part(1), pa.binary()), pa.array([r and r[2] for r in rows], pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "digest", "sig", "bands"])
    return docs.select("doc_id", "text").mapInArrow(run, SIGNATURE)


def estimates(sig: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of packed signatures (rows of uint8; they broadcast)."""
    x = np.bitwise_xor(sig, other)
    differ = np.bitwise_count((x | (x >> 1)) & 0x55).sum(axis=-1, dtype=np.int32)
    share = 1 - differ / (x.shape[-1] * 4)
    return (share - 2.0 ** -BITS) / (1 - 2.0 ** -BITS)


def _rows(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)


def _estimate(pairs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of (a, b, sa, sb) whose estimate is ``least`` or more."""
    def run(frames):
        for f in frames:
            if len(f):
                yield f.loc[estimates(_rows(f.sa), _rows(f.sb)) >= least, ["a", "b"]]
    return pairs.select("a", "b", "sa", "sb").mapInPandas(run, "a long, b long")


def _cross(members: DataFrame, least: float, percent: int) -> DataFrame:
    """Links (a, b) across the components of each cluster.

    ``members`` has cluster, id, comp, sig and set. In a cluster of more than
    ``BLOCK_BYTES`` of sets the members of its largest component and the others
    are dealt into blocks of that size each, and every block of the others
    meets itself and each later block, so no task holds more than two blocks.
    Members outside the largest component are the queries: each is estimated
    against the other block and, where an estimate in another component is
    ``least`` or more, decided on full sets. A query gives back one link per
    component and block at most. Smaller clusters are one block each, several
    to a task.
    """
    bytes_ = F.octet_length("set").cast("long")
    blocks = lambda m: F.ceil(m / BLOCK_BYTES).cast("int")
    sizes = members.groupBy("cluster", "comp").agg(F.sum(bytes_).alias("m")).groupBy("cluster") \
        .agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.max("m").alias("m"), F.sum("m").alias("all")) \
        .withColumn("small", F.col("all") <= BLOCK_BYTES) \
        .select("cluster", "main", "small", F.when(F.col("small"), 1).otherwise(blocks(F.col("all") - F.col("m"))).alias("rest"),
                F.when(F.col("small"), 0).otherwise(blocks(F.col("m"))).alias("mains"))
    total = members.agg(F.sum(bytes_)).first()[0] or 0
    parts = max(1, total // (2 * BLOCK_BYTES))
    dealt = members.join(sizes, "cluster").withColumn("query", F.expr("comp <> main")) \
        .withColumn("own", F.expr("CAST(CASE WHEN small THEN 0 WHEN query THEN pmod(xxhash64(id), rest) "
                                  "ELSE rest + pmod(xxhash64(id), mains) END AS INT)")) \
        .withColumn("other", F.explode(F.expr("sequence(0, CASE WHEN query THEN rest + mains ELSE rest END - 1)"))) \
        .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")) \
        .withColumn("part", F.when(F.col("small"), F.pmod(F.xxhash64("cluster"), F.lit(parts)))
                    .otherwise(F.xxhash64("cluster", "i", "j")))

    def run(f):
        a, b = [], []
        for (_, i, j), g in f.groupby(["cluster", "i", "j"], sort=True):
            own = g.own.to_numpy()
            asked, others = np.flatnonzero(g["query"].to_numpy() & (own == i)), np.flatnonzero(own == j)
            if not len(asked) or not len(others):
                continue
            ids, comps, sig = g.id.to_numpy(), g.comp.to_numpy(), _rows(g.sig)
            size = np.array([len(s) // 8 for s in g.set])
            names, code = np.unique(np.frombuffer(b"".join(g.set), np.uint64), return_inverse=True)
            end = np.cumsum(size)
            held = np.zeros(len(names), bool)
            theirs = np.concatenate([code[end[k] - size[k]:end[k]] for k in others])
            start = np.cumsum(size[others]) - size[others]
            signed = sig[others]
            for q in asked:
                near = (estimates(sig[q], signed) >= least) & (comps[others] != comps[q])
                if not near.any():
                    continue
                mine = code[end[q] - size[q]:end[q]]
                held[mine] = True
                common = np.add.reduceat(held[theirs], start, dtype=np.int64)
                held[mine] = False
                near &= 100 * common >= percent * (size[others] + size[q] - common)
                found = others[near]
                found = found[np.unique(comps[found], return_index=True)[1]]
                a += [ids[q]] * len(found)
                b += ids[found].tolist()
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})
    return dealt.select("cluster", "i", "j", "own", "id", "comp", "sig", "set", "query", "part").groupBy("part") \
        .applyInPandas(run, "a long, b long")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union on the full sets."""
    x = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("x"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("set").alias("y"))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y") \
        .mapInArrow(run, "a long, b long")


def _sifted(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is among the written ``ids`` (doc_id), which are distinct.

    A bitmap of hashed ids goes to every task, so that the join by id, where it
    is a shuffle, moves few rows that it then drops. The bitmap never exceeds
    ``SIEVE_WORDS``; what it passes is decided by that join.
    """
    words = min(SIEVE_WORDS, 1 << math.ceil(math.log2(max(1, ids.count() * SIEVE_BITS / 64))))
    place = F.xxhash64("doc_id")
    word = place.bitwiseAND(words - 1).alias("__word")
    bit = F.expr("shiftleft(1L, CAST(shiftrightunsigned(xxhash64(doc_id), 58) AS INT))").alias("__bit")
    masks = ids.select(word, bit).groupBy("__word").agg(F.bit_or("__bit").alias("__mask"))
    return rows.select("*", word, bit).join(F.broadcast(masks), "__word").where("__mask & __bit <> 0") \
        .select(*rows.columns).join(ids, "doc_id")      # not a semi join: Spark would put that below the sieve


def _sets(docs: DataFrame, nodes: DataFrame, scratch: Scratch, words: int, repeated: bool) -> DataFrame:
    """Node (as doc_id) and packed shingle set of ``nodes`` (digest, rep, node).

    Sets are made from the representatives' texts and told apart by digest
    where an id is ``repeated``; equal rows then give one set.
    """
    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                 pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "digest", "set"])
    ids = scratch.save(nodes.select(F.col("rep").alias("doc_id")).distinct(), "wanted")
    sets = _sifted(docs.select("doc_id", "text"), ids).mapInArrow(run, "doc_id long, digest binary, set binary")
    if not repeated:
        return sets.select("doc_id", "set")
    return sets.join(nodes, (F.col("doc_id") == F.col("rep")) & (sets["digest"] == nodes["digest"])) \
        .groupBy("node").agg(F.min("set").alias("set")).withColumnRenamed("node", "doc_id")


def near_duplicates(docs: DataFrame, scratch: Scratch, words: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    least = percent / 100 - MARGIN
    sig = scratch.save(signatures(docs, words), "signatures")

    # A node per distinct set: its smallest id. An id that stands for several sets
    # (rows that repeat it) names one of their nodes, the others take numbers beyond all ids.
    named = sig.where("doc_id is not null and digest is not null")
    mark = F.xxhash64("digest")
    reps = scratch.save(named.groupBy("digest").agg(F.min("doc_id").alias("rep")), "digests")
    shared = scratch.save(reps.groupBy(F.col("rep").alias("r")).agg(F.min(mark).alias("first"), F.count("*").alias("n"))
                          .where("n > 1").select("r", "first"), "shared-ids")
    nodes = scratch.save(reps.join(shared, F.col("rep") == F.col("r"), "left").select(
        "digest", "rep", F.when(F.coalesce(mark != F.col("first"), F.lit(False)), mark.bitwiseAND(NODES - 1) + NODES).otherwise(F.col("rep")).alias("node")), "nodes")
    again = named.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(mark).alias("x"), F.max(mark).alias("y")).where("n > 1")
    again = scratch.save(again.select("doc_id", (F.col("x") < F.col("y")).alias("several")), "repeated-ids")
    repeated = bool(again.head(1))
    # The sets of one id are linked.
    owned = scratch.save(named.join(again.where("several"), "doc_id", "left_semi").select("doc_id", "digest").distinct()
                         .join(nodes, "digest").select("doc_id", "node"), "owned")
    least_node = scratch.save(owned.groupBy(F.col("doc_id").alias("d")).agg(F.min("node").alias("b")), "least-owned")
    own_links = owned.join(least_node, F.col("doc_id") == F.col("d")).select(F.col("node").alias("a"), "b").where("a <> b")

    one = F.min_by(F.struct("sig", "bands"), "digest")
    rep = scratch.save(named.join(nodes.select(F.col("rep").alias("doc_id"), "digest", F.col("node").alias("id")), ["doc_id", "digest"])
                       .groupBy("id").agg(one.alias("s")).select("id", "s.sig", "s.bands"), "reps")

    # Buckets that two or more representatives share, written before the members meet them.
    bands = rep.select("id", F.explode("bands").alias("key"))
    shared = scratch.save(bands.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last"))
                          .where("hub < last").select("key", "hub"), "shared")
    members = scratch.save(bands.join(shared, "key"), "members")
    touched = members.select("id").distinct().join(rep.select("id", "sig"), "id")

    # Linear pass: the hubs (least ids of buckets) that a member shares most bands with.
    most = members.where("id <> hub").groupBy("id", "hub").agg(F.count("*").alias("n")).groupBy("id") \
        .agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "hub")), False), 1, HUBS).alias("t")) \
        .select(F.col("id").alias("b"), F.explode("t.hub").alias("a"))
    likely = most.join(touched.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a") \
        .join(touched.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    best = _estimate(likely, least)
    held = scratch.save(nodes.join(members.select(F.col("id").alias("node")).distinct(), "node", "left_semi"), "held")
    sets = scratch.save(_sets(docs, held, scratch, words, repeated), "sets")
    links = scratch.save(_verify(best, sets, percent).union(own_links), "links-0")
    comps = components(links, scratch, "cc-0")

    # What is still apart within a bucket is decided within clusters of such buckets.
    placed = members.join(comps, "id", "left").select("key", "hub", "id", F.coalesce("component", "id").alias("comp"))
    apart = placed.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("key")
    apart = scratch.save(apart, "apart-keys")
    placed = scratch.save(placed.join(apart, "key", "left_semi").select("id", "hub", "comp").distinct(), "apart")
    clusters = components(placed.select(F.col("id").alias("a"), F.col("hub").alias("b")), scratch, "clusters")
    cluster = scratch.save(placed.select("id", "comp").distinct().join(clusters.withColumnRenamed("component", "cluster"), "id")
                           .join(touched, "id").join(sets.withColumnRenamed("doc_id", "id"), "id"), "cluster")
    links = scratch.save(links.union(_cross(cluster, least, percent)), "links-1")
    comps = components(links, scratch, "cc-1")
    scratch.drop("sets", "members", "apart", "cluster")

    # Null digests (empty sets) and null ids stay out of the joins.
    alone = sig.where("doc_id is null or digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.join(nodes, "digest").join(comps.withColumnRenamed("id", "node"), "node", "left") \
        .select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id")).union(alone) \
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
