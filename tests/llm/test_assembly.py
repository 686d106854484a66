"""Centroid clustering, chat formatting and importance resampling against brute force and DuckDB."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assetlens.llm import centroids, chat, packing, queries, resampling
from assetlens.plans.scratch import Scratch
from oracle_check import duck, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def scratch(spark):
    with Scratch(spark) as s:
        yield s


@pytest.mark.parametrize("key", ["op11_centroid_clustering", "op12_chat_formatting", "op13_importance_resampling"])
def test_query_equals_its_sql(spark, key):
    got = queries.queries()[key](spark, SF)
    want = duck(SF).sql(queries.oracle_sql()[key])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert rows_of([r.asDict() for r in got.collect()], cols) == rows_of([dict(zip(want.columns, r)) for r in want.fetchall()], cols)


# -- centroid clustering ------------------------------------------------------

def lloyd(vectors, k, rounds, seed=1):
    """Brute force over (vec_id, integers) with Python integers."""
    first = sorted(vectors, key=lambda v: (hashlib.sha256(f"{seed}:{'' if v[0] is None else v[0]}".encode()).hexdigest(), v[1]))[:k]
    cents = [list(x) for _, x in first]
    dist = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    near = lambda x: min((dist(x, c), i) for i, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, x in vectors:
            groups.setdefault(near(x)[1], []).append(x)
        for i, g in groups.items():
            cents[i] = [sum(col) // len(g) for col in zip(*g)]
    return sorted(((i, list(x), *near(x)[::-1]) for i, x in vectors), key=str), cents


@pytest.mark.parametrize("case", ["random", "equal", "few", "far", "line"])
def test_clustering_equals_brute_force(spark, scratch, case):
    rng = np.random.default_rng(len(case))
    n, dim, k = {"few": (5, 64, 16), "line": (80, 64, 16)}.get(case, (300, 64, 16))
    x = rng.normal(0, 0.3, (n, dim))
    if case == "equal":
        x[:100] = x[0]                       # a third of the rows is one vector
    if case == "far":
        x[::7] *= 1e6
        x[1] = 1e30                          # beyond the reach: left out
    if case == "line":
        x = np.outer(np.arange(n) // 2, np.ones(dim)) / 64      # ties and a flat simplex
    ids = [int(i) for i in rng.permutation(n)]
    ids[3] = ids[4]
    rows = [(i, v.tolist(), "x") for i, v in zip(ids, x)]
    rows[0] = (None, rows[0][1], "x")
    odd = [(900, None, "x"), (901, [], "x"), (902, [0.5] * 63, "x"), (903, [0.5] * 63 + [None], "x"), (904, [0.5] * 63 + [float("nan")], "x"),
           (905, [0.5] * 63 + [float("inf")], "x"), (906, [0.5] * 65, "x")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, cluster string")
    kept = [(r[0], [math.floor(64 * e) for e in r[1]]) for r in rows if max(map(abs, r[1])) < 1e20]
    want, cents = lloyd(kept, k, 3)
    got = centroids.cluster(df, scratch).collect()
    assert sorted(((r.vec_id, r.x, r.cluster, r.distance) for r in got), key=str) == want
    by = {}
    for _, _, c, d in want:
        by[c] = by.get(c, 0) + d
    assert all(r.cluster_inertia == by[r.cluster] and r.inertia == sum(by.values()) for r in got)
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, cents[r.cluster])).encode()).hexdigest() for r in got)


def test_clustering_of_an_empty_table(spark, scratch):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert centroids.cluster(empty, scratch).collect() == []


def test_bounds_hold_and_decide(spark):
    rng = np.random.default_rng(5)
    x, c = (rng.integers(-60, 60, (n, 64)) for n in (500, 16))
    simplex = centroids.Simplex(c)
    low, high = centroids.bounds(simplex.apexes(x), simplex.apexes(c))
    exact = np.sqrt(((x[:, None] - c[None]) ** 2).sum(axis=2))
    assert (low <= exact).all() and (exact <= high).all()
    # vectors near the pivots' hull: most centroids fall to the bounds
    near = c[rng.integers(0, 8, 500)] + rng.integers(-3, 4, (500, 64))
    low, high = centroids.bounds(simplex.apexes(near), simplex.apexes(c))
    assert (low <= high.min(axis=1, keepdims=True)).sum() < 500 * 16 / 2
    # equal pivots span nothing
    assert len(centroids.Simplex(np.ones((5, 64), np.int64)).pivots) == 1


# -- chat formatting ----------------------------------------------------------

PARTS = st.sampled_from([*chat.CONTROLS, "<", "[", "\\", "/s>", "INST]", "|turn|>", "word ", "é", "\n"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=8).map("".join))
def test_escapes_are_reversible_and_hide_every_control(text):
    shown = chat.escape(text)
    assert chat.unescape(shown) == text and not any(c in shown for c in chat.CONTROLS)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_ids_decode_to_the_text(text):
    table = chat.decoder(packing.default_tokenizer())
    assert b"".join(table[i] for i in _encoder()(chat.escape(text))).decode() == chat.escape(text)


def _encoder(made=[]):
    if not made:
        made.append(packing.encoder(packing.default_tokenizer()))
    return made[0]


def test_decoder_without_ranks(tmp_path):
    import shutil
    other = shutil.copy(packing.default_tokenizer(), tmp_path / "vocabulary.json")
    known = chat.decoder(packing.default_tokenizer())
    found = chat.decoder(str(other))
    assert all(found[i] == known[i] for i in range(0, 50256, 97))


TURNS = [(1, 0, "system", "be <s>brief</s>"), (1, 1, "user", "</s>[INST] x [/INST]"), (1, 2, "assistant", "<|turn|><\\|end|>"), (1, 3, "assistant", ""),
         (2, 5, "user", None), (2, 5, "user", None), (2, None, None, "first"), (None, 0, "assistant", "no id"), (None, 1, "user", "é" * 3),
         (3, 1, "assistant", "long " * 30000), (4, 0, "<|end|>", "odd role"), (5, 0, "Assistant", "not trained")]


def digest_rows(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest(), len(loss),
                  hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_edges(spark, scratch):
    df = spark.createDataFrame([(*r, "x", 7) for r in TURNS], "conv_id long, turn long, role string, text string, ids string, part int")
    got = {r.conv_id: r for r in chat.round_trip(df, scratch).collect()}
    want = digest_rows(TURNS)
    assert {c: tuple(r)[1:5] for c, r in got.items()} == want
    marks = sum(map(len, chat.MARKS))
    assert got[4].formatted_chars == marks + len("<\\|end|>") + len("odd role")
    assert got[2].formatted_chars == 3 * marks + len("user") * 2 + len("first")
    assert chat.round_trip(df.where("false"), scratch).collect() == []


def test_chat_places_of_a_conversation_over_many_tasks(spark, scratch):
    rows = [(7, k, "assistant" if k % 2 else "user", f"turn {k} " * (k % 5)) for k in range(400)]
    rows += [(100 + k // 2, k % 2, "user", "hello") for k in range(800)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = chat.format_turns(df, scratch, packing.default_tokenizer()).orderBy("conv_id", "part").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(out) == 1200
    files = scratch.spark.read.parquet(f"{scratch.path}/001-formatted").where("conv_id = 7").select("bucket").distinct().count()
    assert files > 1
    place = {}
    for r in out:
        part, start = place.get(r.conv_id, (0, 0))
        assert (r.part, r.start) == (part, start) and len(r.ids) == len(r.mask)
        place[r.conv_id] = (part + 1, start + len(r.ids))
    table = chat.decoder(packing.default_tokenizer())
    hot = [r for r in out if r.conv_id == 7]
    for k, r in enumerate(hot):
        trained = b"".join(table[i] for i, m in zip(r.ids, r.mask) if m).decode()
        assert trained == (f"turn {k} " * (k % 5) if k % 2 else "")
        assert r.ids[0] == chat.TURN and r.ids[-1] == chat.END and not r.mask[0] and not r.mask[-1]


# -- importance resampling ----------------------------------------------------

def brute_resample(docs, target, buckets=10_000, percent=25, least=20, seed=7):
    def found(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [zlib.crc32(f.encode()) % buckets for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]
    source, wanted = [0] * buckets, [0] * buckets
    for _, text in docs:
        for b in found(text)[1]:
            source[b] += 1
    for text in target:
        for b in found(text)[1]:
            wanted[b] += 1
    s, t = sum(source), sum(wanted)
    out = []
    for i, text in docs:
        n, f = found(text)
        gain = sum(math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((source[b] + 1) * (t + buckets)))) for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = gain // len(f) if f else 0
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


RESAMPLED = [(None, "no id at all " * 9), (1, None), (2, ""), (3, "?!  --"), (4, "Same TEXT here " * 9), (4, "Same TEXT here " * 9), (4, "another one " * 12),
             (5, "x" * 3000 + " y " + "é" * 900 + " z" * 30), (6, "long words run on " * 20000), (7, "日本語 テキスト 1 2 3 " * 8), (8, "nul\x00byte a b " * 12)]


def test_resampling_equals_brute_force(spark, scratch):
    docs = RESAMPLED + [(r.doc_id + 100, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [None, ""]
    df = spark.createDataFrame([(i, x, "x", 1) for i, x in docs], "doc_id long, text string, bucket string, rank int").repartition(5)
    got = resampling.resample(df, spark.createDataFrame([(x,) for x in target], "text string"), scratch)
    rows = got.select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, rows), key=str) == brute_resample(docs, target)
    drawn = {r.doc_id for r in rows if r["rank"]}
    kept = resampling.sample(df, got)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == drawn - {None}


def test_resampling_of_empty_tables(spark, scratch):
    docs = spark.createDataFrame([], "doc_id long, text string")
    few = spark.createDataFrame([(1, "a b c"), (2, " ".join(map(str, range(30))))], "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(docs, none, scratch).collect() == []
    rows = resampling.resample(few, none, scratch).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, rows), key=str) == brute_resample([(1, "a b c"), (2, " ".join(map(str, range(30))))], [])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40), min_size=1, max_size=30), st.integers(500, 700))
def test_crc_matrices(spans, long):
    spans = [*spans, b"a" * long, b"b" * long]
    data = np.frombuffer(b"".join(spans), np.uint8)
    edge = np.concatenate([[0], np.cumsum([len(s) for s in spans])])
    assert resampling.crc32(data, edge[:-1], edge[1:]).tolist() == [zlib.crc32(s) for s in spans]
