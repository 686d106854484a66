"""Licence scan: families on ordinary notices, wrapped or not; paragraphs; samples; edge cases."""

import textwrap

import numpy as np
import pyarrow as pa
import pytest

from assetlens.llm import licenses
from assetlens.llm.textops import chunks

SF = "/root/testdata/sf0.01"
EACH = "doc_id long, text string"

GPL = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
       "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.")
# Hand-labelled paragraphs.
LABELLED = [
    ("gpl", GPL),
    ("agpl", GPL.replace("GNU General", "GNU Affero General")),
    ("lgpl", GPL.replace("GNU General", "GNU Lesser General").replace("program", "library")),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
            'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
            'the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met:"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
               'with the License.'),
    ("apache", "Apache License, Version 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "ISC License"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 "
            "which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-v20.html"),
    ("epl", "Eclipse Public License v2.0"),
    ("agpl", "GNU Affero General Public License, version 3"),
    ("gpl", "Distributed under the GNU General Public License v3.0"),
    ("lgpl", "GNU Lesser General Public License version 2.1"),
    ("mit", "The MIT License (MIT)"),
    ("mpl", "Mozilla Public License Version 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("unknown", "Licensed under the Open Moon Licence, version 1.2."),
    ("unknown", "Released under the Foo License."),
    ("unknown", "Licensed under the Harbour Open Source License, version 1.0."),
    ("unknown", "SPDX-License-Identifier: Zlib"),
    ("none", "The driver renewed her license at the office on Monday and went home."),
    ("none", "Permission was granted to build the new bridge over the river."),
    ("none", "They modified the program to run on the old machine."),
    ("none", "The general public was not admitted to the free concert."),
    ("none", "All members reserved seats for the evening show."),
    ("none", "A copy of the letter was obtained by the paper."),
]
SHAPES = {"one line": lambda t: t,
          "wrapped at 64": lambda t: "\n".join(textwrap.wrap(t, 64)),
          "wrapped at 78": lambda t: "\n".join(textwrap.wrap(t, 78)),
          "comment": lambda t: "\n".join(" * " + x for x in textwrap.wrap(t, 74))}


@pytest.fixture(scope="module")
def model(spark):
    return licenses.train(spark.read.parquet(f"{SF}/documents.parquet"))


@pytest.mark.parametrize("shape", SHAPES)
def test_families_of_ordinary_notices(spark, model, shape):
    """Precision and recall over families of 0.9 or more; nothing in ordinary text."""
    docs = spark.createDataFrame([(k, SHAPES[shape](t)) for k, (_, t) in enumerate(LABELLED)], EACH)
    got = {}
    for r in licenses.scan(docs, model).collect():
        got.setdefault(r.doc_id, set()).add(r.family)
    known = [k for k, (family, _) in enumerate(LABELLED) if family not in ("none", "unknown")]
    right = sum(got.get(k) == {LABELLED[k][0]} for k in known)
    named = sum(bool(f - {"unknown"}) for f in got.values())
    assert right >= 0.9 * len(known) and right >= 0.9 * named, got
    assert all(got.get(k) == {"unknown"} for k, (family, _) in enumerate(LABELLED) if family == "unknown"), got
    assert not any(k in got for k, (family, _) in enumerate(LABELLED) if family == "none"), got


def test_notices_inside_a_document(spark, model):
    """Blank lines, unrelated neighbours and several notices; rows number the first line."""
    prose = "the old harbour town lies on the northern shore and its people fish"
    text = "\n".join([prose, "Released under the MIT License.", prose, "", *textwrap.wrap(LABELLED[1][1], 70), "", prose,
                      "Licensed under the Apache License, Version 2.0.", prose + ".", prose])
    rows = licenses.scan(spark.createDataFrame([(1, text)], EACH), model).collect()
    lines = text.split("\n")
    assert [(r.family, r.paragraph) for r in rows] == [("mit", 1), ("agpl", 5), ("apache", lines.index("Licensed under the Apache License, Version 2.0."))]
    assert rows[0].text == lines[1] and rows[1].text == lines[5]       # the first line with the family's name


def joined_plainly(text: str) -> list[bool]:
    """Whether a line continues the one before, by the definition."""
    pad, lines = set(" \t\r\x0b\x0c\n*#/;-"), text.split("\n")
    core = lambda x: x.strip("".join(pad))
    out = [False]
    for a, b in zip(lines, lines[1:]):
        size = len(a.rstrip("".join(pad)))
        rest = b[len(b) - len(b.lstrip("".join(pad))):]
        word = len(rest.split()[0]) if rest.split() else 0
        out.append(bool(core(a)) and bool(core(b)) and size <= 120 and size + 1 + word >= 60 and core(a)[-1] not in ".!?:")
    return out


def test_paragraphs_equal_the_definition():
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(200):
        lines = [" ".join("abcdefghij"[:int(rng.integers(1, 10))] for _ in range(int(rng.integers(0, 18)))) + rng.choice(["", ".", ":", " *", ","])
                 for _ in range(int(rng.integers(1, 9)))]
        texts.append("\n".join(rng.choice(["", " * ", "# "]) + line for line in lines))
    for lo, hi, data, offsets in chunks(pa.array(texts + ["", None, "\n\n", "x" * 5000]), 4096):
        start, end, doc, joins = licenses.line_spans(data, offsets)
        for k in range(hi - lo):
            text = (texts + ["", "", "\n\n", "x" * 5000])[lo + k]
            want = joined_plainly(text)
            assert joins[doc == k].tolist() == want[:int((doc == k).sum())]
            assert [data[a:b].tobytes().decode() for a, b in zip(start[doc == k], end[doc == k])] == text.splitlines(keepends=True)


def test_edges(spark, model):
    long = "word " * 60_000 + "\n" + "Released under the MIT License.\n" + "plain words " * 20
    rows = [(None, "Released under the MIT License."), (1, None), (2, ""), (3, "\n\n \n"), (4, "All rights reserved."),
            (4, "All rights reserved."), (5, long)]
    docs = spark.createDataFrame(rows, EACH).selectExpr("*", *[f"'x' AS {c}" for c in ("paragraph", "family", "h", "keys", "probability", "similarity")])
    got = sorted(((r.doc_id or 0, r.paragraph, r.family) for r in licenses.scan(docs, model).collect()))
    assert got == [(0, 0, "mit"), (4, 0, "proprietary"), (4, 0, "proprietary"), (5, 1, "mit")]
    empty = docs.where("doc_id = 99")
    assert licenses.scan(empty, model).collect() == []
    assert licenses.scan(empty).collect() == []                     # fitted on the templates alone
    assert {r.family for r in licenses.scan(docs).collect()} - {"unknown"} == {"mit", "proprietary"}


def test_sample_is_the_paragraphs_of_least_hash(spark):
    """Distinct ones, whatever repeats; long ones too."""
    texts = [f"sentence number {k} of the plain text" for k in range(400)] + ["the same line of every page"] * 400 \
        + ["long paragraph " * 1000, "Released under the MIT License."]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], EACH).repartition(7)
    hashes = set()
    for _, _, data, offsets in chunks(pa.array(texts[:-1])):
        hashes |= set(licenses._paragraph_hashes(data, offsets)[2].tolist())
    for n in (20, 10_000):
        rows = licenses.ordinary(docs, n).collect()
        assert [r.h for r in rows] == sorted(hashes)[:n]
    assert len(rows) == 402
    assert max(len(r.passage.split()) for r in rows) == licenses.PASSAGE


def test_every_notice_of_the_documents(spark):
    """The query's rows against a plain search for the notices' own words."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    words = {"Apache License": "apache", "MIT License": "mit", "GNU General Public": "gpl", "All rights reserved": "proprietary", "CC BY-NC": "cc-by-nc"}
    want = {(r.doc_id, k, family) for r in rows for k, line in enumerate((r.text or "").split("\n"))
            for mark, family in words.items() if mark in line}
    assert {(r.doc_id, r.paragraph, r.family) for r in licenses.scan(docs).collect()} == want
