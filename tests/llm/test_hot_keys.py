"""Hot keys, repeated ids and bounded samples of the training-data operators."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetlens.llm import common, lines, minhash, packing, quality, stages, substrings, warc
from assetlens.plans.scratch import Scratch

from test_llm import frame


@pytest.fixture()
def scratch(spark):
    with Scratch(spark) as s:
        yield s


@pytest.fixture()
def small_partitions(spark):
    """Limits at which a few thousand rows count as a skewed partition."""
    low = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
           "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
           "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.files.maxPartitionBytes": "32k", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k, None) for k in low}
    for k, v in low.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_hot_payload_is_split(spark, scratch, small_partitions):
    rng = np.random.default_rng(1)
    noise = ["".join(map(chr, rng.integers(97, 123, 1200))) for _ in range(400)]
    # URLs of random letters, so that the partitions keep their size when compressed
    rows = [(k, "".join(map(chr, rng.integers(97, 123, 400))), "error page " * 150 if k % 3 == 0 else noise[k % 400]) for k in range(2400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    out = warc.marked(pages, scratch)
    assert "skew=true" in final_plan(out)
    last = max(k for k in range(2400) if k % 3 == 0)
    assert {r.refers_to for r in out.where("page_id % 3 = 0").collect()} == {None, last}


def test_hub_of_the_components_is_split(spark, scratch, small_partitions, monkeypatch):
    plans, save = [], Scratch.save

    def spy(self, df, name):
        out = save(self, df, name)
        if name.endswith("-large"):
            plans.append(final_plan(df))
        return out
    monkeypatch.setattr(Scratch, "save", spy)
    pairs = spark.range(4000).selectExpr("1000000 + 2 * id AS a", "1000001 + 2 * id AS b")
    edges = spark.range(300000).selectExpr("0L AS a", "5000000 + (xxhash64(id) & 281474976710655) AS b").union(pairs).repartition(8)
    got = common.components(edges, scratch)
    assert "skew=true" in plans[0]
    assert got.where("component = 0").count() == 300001 - (300000 - edges.where("a = 0").select("b").distinct().count())
    assert got.where("id between 1000000 and 1008000 and component = id - id % 2").count() == 8000


def test_components_of_a_long_chain(spark, scratch):
    edges = spark.createDataFrame([(k + 1, k) for k in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in common.components(edges, scratch).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}
    assert common.components(edges.where("false"), scratch).count() == 0


BASE = [f"w{k}" for k in range(100)]
OTHER = [f"v{k}" for k in range(100)]


def near(words, at):
    return " ".join(w if k != at else "changed" for k, w in enumerate(words))


@pytest.mark.parametrize("ids", [(7, 9, 10), (70, 9, 10), (7, 90, 3)])
def test_links_of_every_text_of_a_repeated_id(spark, scratch, ids):
    twice, x, y = ids
    rows = [(twice, " ".join(BASE)), (twice, " ".join(OTHER)), (twice, " ".join(OTHER)), (x, near(OTHER, 20)), (y, near(BASE, 70)), (500, "alone in the world"),
            (600, None), (None, " ".join(BASE))]
    got = minhash.near_duplicates(frame(spark, rows), scratch).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.doc_id in ids} == {min(ids)}
    assert [(r.component_id, r.kept) for r in got if r.doc_id in (500, 600, None)].count((None, True)) == 1
    assert all(r.component_id == r.doc_id for r in got if r.doc_id in (500, 600))


def exchanges(plan):
    """(columns, rows written) of each shuffle of an executed plan."""
    kind = plan.nodeName()
    if kind == "Exchange":
        yield plan.output().mkString(","), plan.metrics().apply("shuffleRecordsWritten").value()
    inner = [plan.executedPlan()] if kind == "AdaptiveSparkPlan" else [plan.plan()] if "QueryStage" in kind else \
        [plan.children().apply(k) for k in range(plan.children().size())]
    for below in inner:
        yield from exchanges(below)


@pytest.mark.parametrize("words", [1 << 20, 1])     # with one word the sieve passes every row
def test_texts_that_share_no_bucket_are_not_shuffled(spark, scratch, small_partitions, monkeypatch, words):
    monkeypatch.setattr(minhash, "SIEVE_WORDS", words, raising=False)
    rows = [(k, " ".join(f"d{k}w{i}" for i in range(40))) for k in range(3000)]
    rows += [(10000 + k, near([f"d{k}w{i}" for i in range(40)], 0)) for k in range(0, 3000, 50)] + [(None, "no id"), (20000, None)]
    moved, save = [], Scratch.save

    def spy(self, df, name):
        out = save(self, df, name)
        if name == "sets":
            df.collect()
            moved.extend(n for columns, n in exchanges(df._jdf.queryExecution().executedPlan()) if "text#" in columns)
            assert {r.doc_id for r in out.collect()} == {k for k in range(0, 3000, 50)} | {10000 + k for k in range(0, 3000, 50)}
        return out
    monkeypatch.setattr(Scratch, "save", spy)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows), scratch).collect()}
    assert got == {k: k - 10000 if k and 10000 <= k < 20000 else k for k, _ in rows}
    assert len(moved) == 1 and 120 <= moved[0] and (words == 1 or moved[0] < 1000)


def test_line_dedup_is_linear_in_a_documents_lines(spark, scratch):
    shared = [f"shared line {k}" for k in range(40000)]
    rows = [(d, "\n".join(f"own {d}.{k}\n{s}" for k, s in enumerate(shared)), f"site{d}") for d in range(9)]
    t0 = time.time()
    out = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), scratch).collect()}
    assert time.time() - t0 < 150
    assert out[0].text == rows[0][1] and out[0].n_removed == 0
    assert out[5].n_removed == 40000 and out[5].n_lines == 80000 and out[5].text == "\n".join(f"own 5.{k}" for k in range(40000))


def test_line_dedup_edges(spark, scratch):
    rows = [(k, f"common\nown {k}\n\ncommon", f"s{k}", 777, 5, "x") for k in range(8)] + [
        (8, None, "s8", 1, 1, "x"), (9, "", None, 2, 2, "x"), (None, "common", "s9", 3, 3, "x"), (3, "common\nown 3\n\ncommon", "s3", 777, 5, "x"), (11, "common", "z", 4, 6, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_removed int, n_chars long, n_lines string")
    out = stages.line_dedup(spark, docs, None)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs.columns and got[0].n_removed == 777 and got[0].n_lines == "x"
    assert got[0].text == "common\nown 0\n" and got[4].text == "own 4\n" and got[8].text is None and got[9].text == "" and got[None].text == "common"
    assert 11 not in got            # nothing of it is left
    empty = lines.dedup_lines(docs.where("false"), scratch)
    assert empty.count() == 0 and set(empty.columns) == set(docs.columns)


def test_packing_deals_equal_rows_into_many_pools(spark, monkeypatch):
    monkeypatch.setattr(packing, "POOL", 64)
    rows = [(5, "the same row")] * 1000 + [(k, f"row {k} " * (k % 9)) for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    out = packing.pack(docs, packing.default_tokenizer()).collect()
    hot = [r for r in out if r.doc_id == 5 and r.doc_tokens < 10]
    assert sum(r.length for r in hot) >= 1000 * hot[0].doc_tokens
    pools = {}
    for r in hot:
        pools[r.sequence_id >> 32] = pools.get(r.sequence_id >> 32, 0) + 1
    assert len(pools) > 20 and max(pools.values()) < 150
    assert packing.pack(docs.where("false"), packing.default_tokenizer()).count() == 0


def test_samples_are_the_rows_of_least_hash(spark):
    rows = spark.range(20000).selectExpr("id AS doc_id")
    hashed = F.xxhash64("doc_id")
    want = [r.doc_id for r in rows.orderBy(hashed).limit(300).collect()]
    out = common.thinned(rows, hashed, 300)
    assert [r.doc_id for r in out.collect()] == want
    # what is sorted is thinned before, not the first rows of every task
    assert rows.where(hashed < F.lit(int(-2 ** 63 + (300 + 8 * 300 ** 0.5 + 8) / 20000 * (2 ** 64 - 1)))).count() < 700
    assert common.thinned(rows, hashed, 19900).count() == 19900
    assert common.thinned(rows, hashed, 30000).count() == 20000 and common.thinned(rows.where("false"), hashed, 5).count() == 0


def test_one_labelled_id_on_a_third_of_the_documents(spark):
    rows = [(1 if k % 3 == 0 else k, f"text {k}") for k in range(900)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(900)], "doc_id long, quality int, toxic int")
    out = quality.training_rows(frame(spark, rows), labels, "quality", 10_000)
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == len(set(ids)) and len(ids) < 700


def test_removed_bytes_equal_window_by_window_marking():
    rng = np.random.default_rng(1)
    for _ in range(100):
        texts = [rng.integers(97, 100, rng.integers(0, 300)).astype(np.uint8) for _ in range(5)]
        data, offsets = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        marks = substrings.text_marks(data, offsets)
        run, mask, ends, expected = [], [], [0], np.zeros(len(data), bool)
        for k, text in enumerate(texts):
            at = 0
            while at + substrings.LENGTH <= len(text):
                n = int(min(rng.integers(1, 36), len(text) - substrings.LENGTH - at + 1))
                m = int(rng.integers(0, 1 << n)) if rng.random() < 0.3 else 0
                other = int(rng.random() < 0.1)      # a run of another text of the same id
                run.append((at << substrings.RUN_BITS | n) << substrings.TEXT_BITS | int(marks[k]) ^ other)
                mask.append(m)
                for w in range(n):
                    if m >> w & 1 and not other:
                        expected[offsets[k] + at + w:offsets[k] + at + w + substrings.LENGTH] = True
                at += n
            ends.append(len(run))
        got = substrings.gone(data, offsets, np.array(ends), np.array(run, np.int64), np.array(mask, np.int64))
        assert (got == expected).all()
