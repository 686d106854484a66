"""The training-data operators against brute force, and their edge cases."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assetlens.llm import (decontamination, embeddings, licenses, lines, minhash, packing, quality,
                           substrings, toxicity, warc)
from assetlens.plans.scratch import Scratch

SF = "/root/testdata/sf0.001"
EDGE = [(None, "a text without an id " * 5), (1, None), (2, ""), (3, "word"), (4, "same text here " * 9),
        (4, "same text here " * 9), (5, "same text here " * 9), (6, "long " * 30000)]


@pytest.fixture()
def scratch(spark):
    with Scratch(spark) as s:
        yield s


def frame(spark, rows, schema="doc_id long, text string"):
    """With extra columns whose names the operators use themselves."""
    names = [c.split()[0] for c in schema.split(", ")]
    df = spark.createDataFrame(rows, schema)
    return df.selectExpr(*names, *[f"'x' AS {c}" for c in ("score", "h", "d", "run", "id", "key", "comp", "part")])


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def word_sets(texts):
    out = {}
    for i, t in texts:
        raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())
        w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
        out[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def test_minhash_equals_brute_force(spark, scratch):
    docs = documents(spark)
    sets = word_sets(docs.select("doc_id", "text").collect())
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, scratch).collect()}
    assert all(got[i].component_id == find(i) and got[i].n_shingles == len(sets[i]) for i in ids)


def test_minhash_near_group_and_edges(spark, scratch):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    rows = [(100 + k, " ".join(w if rng.random() > 0.02 else f"x{k}" for w in base)) for k in range(60)]
    got = minhash.near_duplicates(frame(spark, EDGE + rows), scratch).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(EDGE) + 60 and by[5].component_id == 4 and by[4].kept and not by[5].kept
    assert by[1].n_shingles == by[2].n_shingles == 0 and by[1].kept and by[3].n_shingles == 1
    assert by[None].kept and by[None].component_id is None
    assert minhash.near_duplicates(frame(spark, []), scratch).count() == 0


@pytest.mark.parametrize("main", [0, 40])
def test_minhash_family_of_templated_pages(spark, scratch, monkeypatch, main):
    """A hot cluster whose members are nearly all apart: right links, and no task with more than two blocks."""
    rng = np.random.default_rng(8)
    template = [f"t{k}" for k in range(200)]
    rows = [(k, " ".join(template + [f"p{k}w{i}" for i in range(60)])) for k in range(240)]
    rows += [(1000 + k, t + " a few more words") for k, t in rows[:30]]
    rows += [(2000 + k, " ".join(w if rng.random() > 0.01 else f"m{k}" for w in template[:150])) for k in range(main)]
    sets = word_sets(rows)
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    root = {i: i for i in sets}
    for _ in range(8):
        for a in sets:
            root[a] = min(root[b] for b in sets if near(a, b))
    block, held = 1 << 16, []
    monkeypatch.setattr(minhash, "BLOCK_BYTES", block)
    kind = type(spark.range(0))
    group = kind.groupBy

    def spy(self, *by):
        if [b for b in by if isinstance(b, str)] == ["part"]:
            held.append(group(self, "part").agg(F.sum(F.octet_length("set")).alias("n")).agg(F.max("n")).first()[0])
        return group(self, *by)
    monkeypatch.setattr(kind, "groupBy", spy)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows), scratch).collect()}
    assert got == root
    assert sum(len(s) for s in sets.values()) * 8 > 8 * block and 0 < held[0] < 4 * block


def removed(rows):
    first, out = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if first.setdefault(b[s:s + 50], i) < i:
                gone[s:s + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("limit", [1 << 15, 2])
def test_substrings_equal_brute_force(spark, scratch, limit):
    rows = [tuple(r) for r in documents(spark).select("doc_id", "text").limit(60).collect()]
    rows += [(1000, "é" * 40 + "shared passage of well over fifty bytes, repeated in two documents. " + "tail"),
             (1001, "other head; shared passage of well over fifty bytes, repeated in two documents. end")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in substrings.dedup(frame(spark, rows), scratch, limit=limit).collect()}
    assert got == removed(rows)


def test_substrings_edges(spark, scratch):
    got = substrings.dedup(frame(spark, EDGE), scratch).collect()
    assert len(got) == len(EDGE)
    by = {r.doc_id: r for r in got}
    assert by[5].n_removed == by[5].n_bytes and by[4].n_removed == 0 and by[1].n_bytes == 0
    assert by[None].n_removed == 0
    assert substrings.dedup(frame(spark, []), scratch).count() == 0


def test_embeddings_equal_brute_force(spark, scratch):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    x = np.concatenate([base, base[:20] + 0.12 * rng.standard_normal((20, 16)), base[:5], base[:5]]).astype(np.float32)
    rows = [(k, [float(v) for v in r], k % 2 if k >= 60 else k % 3) for k, r in enumerate(x)]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, rows[0][1], None), (None, rows[0][1], 0)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int"), scratch)
    by = {r.vec_id: r for r in got.collect()}
    v = np.array([r[1] for r in rows])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    link = (u @ u.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    comp = np.arange(len(rows))
    for _ in range(len(rows)):
        comp = np.minimum(comp, np.where(link, comp, len(rows)).min(axis=1))
    assert [by[k].n_links for k in range(len(rows))] == link.sum(axis=1).tolist()
    assert [by[k].component_id for k in range(len(rows))] == comp.tolist()
    assert all(by[k].n_links == 0 and by[k].kept for k in (900, 901, 902, 903)) and by[None].component_id is None


def test_warc_round_trip(spark, scratch):
    long = "<p>é" * 400
    rows = [(1, "http://a/", long), (2, "http://b/", long), (3, None, "short"), (4, "u", "short"), (5, "u", None)]
    index = scratch.save(warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), f := scratch.folder("w"), scratch), "i")
    got = {r.page_id: r for r in warc.read(index, f).collect()}
    assert (got[1].record_type, got[1].refers_to, got[1].html) == ("revisit", 2, None)
    assert got[2].record_type == got[3].record_type == got[4].record_type == "response" and bytes(got[2].html) == long.encode()
    assert got[5].payload_bytes == 0 and got[3].url is None
    assert all(r.payload_digest == hashlib.sha1((h or "").encode()).hexdigest() for r, h in ((got[k], t) for k, _, t in rows))


def test_warc_ranges_coalesce():
    assert list(warc.ranges([0, 10, 20, 500_000], [10, 10, 5, 7])) == [(0, 3, 0, 25), (3, 4, 500_000, 500_007)]


def test_packing(spark):
    from tokenizers import Tokenizer
    path = packing.default_tokenizer()
    exact = Tokenizer.from_file(path)
    docs = documents(spark).select("doc_id", "text").union(spark.createDataFrame([(9001, None), (9002, "a <|endoftext|> b")], "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = packing.pack(docs, path).collect()
    seen, sequences = {}, {}
    for r in rows:
        seen.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in texts.items():
        ids = np.array([*exact.encode(t, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(seen[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_packing_searches_all_sequences():
    """Every piece goes to the cheapest of all sequences with room; a cut only where none has room."""
    rng = np.random.default_rng(4)
    for lengths in ([2000] * 100 + [1500] * 30 + [40] * 50, rng.integers(1, 2048, 400).tolist(), rng.geometric(0.003, 600).clip(1, 2047).tolist(), []):
        total = sum(lengths)
        rooms = [2048] * (-(-total // 2048))
        if rooms:
            rooms[-1] = total - 2048 * (len(rooms) - 1)
        size, left, spent = rooms[:], list(lengths), [0.0] * len(rooms)
        for item, start, n, at, offset in packing.assign(lengths, 2048):
            fit = [k for k, r in enumerate(rooms) if r >= left[item]]
            if fit:
                assert n == left[item] and at == min(fit, key=lambda k: (spent[k], k))
            else:
                assert n == rooms[at] == max(rooms)
            assert start == lengths[item] - left[item] and offset == size[at] - rooms[at]
            rooms[at] -= n
            left[item] -= n
            spent[at] += packing.cost(n)
        assert not any(left) and not any(rooms)


def test_packing_spreads_rows_of_one_id(spark, monkeypatch):
    """Equal rows, and rows of one id with texts of one length, are dealt into many pools and all packed."""
    monkeypatch.setattr(packing, "POOL", 32)
    rows = [(None, None)] * 300 + [(7, "equal words")] * 300 + [(8, f"text {k:04d}") for k in range(300)]
    got = packing.pack(frame(spark, rows), packing.default_tokenizer()).collect()
    for i in (None, 7, 8):
        mine = [r for r in got if r.doc_id == i]
        assert sum(r.start == 0 for r in mine) == 300
        assert sum(r.length for r in mine) == sum(r.doc_tokens for r in mine if r.start == 0)
        assert len({r.sequence_id >> 32 for r in mine}) > 10


def test_lines_equal_oracle(spark, scratch):
    import duckdb
    got = sorted(tuple(r) for r in lines.dedup_lines(documents(spark), scratch, 3).select("doc_id", "n_lines", "n_removed", "text").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert got == sorted(con.execute(lines.oracle(3)).fetchall())


def test_lines_edges(spark, scratch):
    rows = [(k, "boiler plate\nown line %d" % k, f"s{k}") for k in range(9)] + [(50, None, "s"), (51, "", None), (None, "boiler plate", "s")]
    by = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), scratch).collect()}
    assert by[0].text == "boiler plate\nown line 0" and by[5].text == "own line 5" and by[5].n_removed == 1
    assert by[50].text is None and by[51].text == "" and by[None].text == "boiler plate"


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, " ".join(f"q{k}" for k in range(30))), (2, None), (3, "too short")], "item_id long, text string")
    words = [f"q{k}" for k in range(30)]
    edited = [w if k % 9 else "edit" for k, w in enumerate(words)]
    rows = [(10, "before " * 50 + " ".join(words) + " after" * 50), (11, "Start " + " ".join(edited).upper()), (12, "clean " * 80), (13, None)]
    got = {r.doc_id: r for r in decontamination.contaminated(frame(spark, rows), bench).collect()}
    assert set(got) == {10, 11} and got[10].score == 1 and 0.5 <= got[11].score < 1
    left = decontamination.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert {r.doc_id for r in left.collect()} == {12, 13}


def aligned(docs, items, least=0.5):
    """(doc, item) -> score, from the alignment of every document with every item."""
    code = {}
    words = lambda t: np.array([code.setdefault(w, len(code)) for w in re.findall(r"[a-z0-9]+", (t or "").lower())])
    out = {}
    for d, t in docs:
        for i, x in items:
            a, b = words(t), words(x)
            score = decontamination.smith_waterman(a, b)[0] / (2 * len(b)) if len(a) and len(b) > 2 else 0
            if score >= least:
                out[d, i] = score
    return out


def test_decontamination_equals_brute_force(spark, monkeypatch):
    """Edited copies beside an exact copy, which alone holds the trigrams that the edits destroyed."""
    rng = np.random.default_rng(5)
    items = [(i, "which of the following is true " + " ".join(f"i{i}w{k}" for k in range(54))) for i in range(12)]
    items += [(50, "three words only"), (51, None)]
    docs = [(0, "start " * 30 + items[0][1] + " end" * 30)]
    for i, edit in enumerate([lambda k: k % 4 == 3, lambda k: k % 5 == 4, lambda k: k % 6 == 5, lambda k: rng.random() < 0.2,
                              lambda k: rng.random() < 0.25, lambda k: 20 <= k < 40]):
        w = items[i][1].split()
        docs.append((100 + i, items[i][1]))
        docs.append((200 + i, "lead in " * 9 + " ".join(f"e{k}" if edit(k) else x for k, x in enumerate(w)) + " tail" * 9))
        docs.append((300 + i, " ".join(w[:25] + [f"ins{k}" for k in range(45)] + w[25:])))
    docs += [(400, "which of the following is true " * 40), (401, "here are three words only"), (402, None), (403, " ".join(x for _, x in items[:12]))]
    want = aligned(docs, items)
    assert {(200 + i, i) for i in range(5)} <= {k for k, v in want.items() if v < 0.8}
    found = decontamination.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.score for r in found} == want
    # Small pieces in this process; without frequencies, two different trigrams decide.
    for slots in (8, 100):
        monkeypatch.setattr(decontamination, "SLOTS", slots)
        index = decontamination.Index([i for i, _ in items[:12]], [t for _, t in items[:12]])
        got = decontamination.leaks(pa.array([t for _, t in docs], pa.string()), index, 0.5)
        assert {(docs[f[0]][0], items[f[1]][0]): f[2] for f in got} == {k: v for k, v in want.items() if k[1] != 50}


def test_smith_waterman_equals_the_full_table():
    rng = np.random.default_rng(2)
    for _ in range(40):
        a, b = rng.integers(4, size=12), rng.integers(4, size=9)
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontamination.smith_waterman(a, b)[0] == h.max()


@pytest.mark.parametrize("score, label", [("quality", "quality"), ("toxicity", "toxic")])
def test_classifiers_on_held_out_documents(spark, scratch, score, label):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_scores(docs, labels) if score == "quality" else toxicity.toxicity_scores(docs, labels, scratch)
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r[label] for r in rows) >= 0.95 * len(rows)


def test_classifier_edges(spark, scratch):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for got in (quality.quality_scores(frame(spark, EDGE), labels), toxicity.toxicity_scores(frame(spark, EDGE), labels, scratch)):
        rows = got.collect()
        assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 for r in rows)


def test_licenses(spark):
    docs = documents(spark)
    rows = docs.select("doc_id", "text").collect()
    notices = {(r.doc_id, k) for r in rows for k, line in enumerate((r.text or "").split("\n"))
               if re.search(r"Licen[cs]e|All rights reserved", line)}
    got = licenses.scan(docs).collect()
    assert {(r.doc_id, r.paragraph) for r in got if r.family != "unknown"} == notices


def test_pipeline(spark):
    import corpus_pipeline
    docs, first = documents(spark), None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        first = first or docs.columns
        if name != "packing":
            assert out.columns == first
        docs = out
    assert docs.count() > 0


def test_pipeline_run_equals_recomputed_stages(spark, monkeypatch):
    """run(), with its writes and rereads: each stage's rows from a plain recomputation on its own input."""
    import corpus_pipeline
    import duckdb
    seen = {}

    def kept(name, stage):
        def run(spark, docs, sf_dir):
            seen[name] = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
            return stage(spark, docs, sf_dir)
        return name, run
    monkeypatch.setattr(corpus_pipeline, "STAGES", [kept(*s) for s in corpus_pipeline.STAGES])
    pieces = corpus_pipeline.run(spark, SF).collect()
    source = {r.doc_id: r.text for r in documents(spark).select("doc_id", "text").collect()}
    assert seen["quality"] == source and all(source[i] == t for i, t in seen["line_dedup"].items())

    con, before = duckdb.connect(), seen["line_dedup"]
    frame_ = documents(spark).toPandas()
    con.register("documents", frame_[frame_.doc_id.isin(list(before))])
    want = {i: t for i, _, gone, t in con.execute(lines.oracle()).fetchall() if t is None or not gone or t.strip(" ")}
    assert seen["near_dedup"] == want

    sets = word_sets(want.items())
    root = {i: i for i in sets}
    near = {a: [b for b in sets if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])] or [a] for a in sets}
    while (new := {a: min(root[b] for b in near[a] + [a]) for a in sets}) != root:
        root = new
    want = {i: t for i, t in want.items() if not sets[i] or root[i] == i}
    assert seen["decontamination"] == want

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {d for d, _ in aligned(want.items(), items)}
    want = {i: t for i, t in want.items() if i not in leaked}
    assert leaked and seen["packing"] == want

    from tokenizers import Tokenizer
    exact = Tokenizer.from_file(packing.default_tokenizer())
    for i, text in want.items():
        ids = np.array([*exact.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = sorted((r for r in pieces if r.doc_id == i), key=lambda r: r.start)
        assert sum(r.length for r in mine) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes()) for r in mine)
    assert {r.doc_id for r in pieces} == set(want)
