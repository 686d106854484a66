"""License scan: a trained paragraph classifier confirmed by templates.

* **Paragraphs.** A line, or a run of lines that hard wrapping has cut: a line
  break continues a paragraph when the line is at most ``WRAP[1]`` bytes long,
  would have passed ``WRAP[0]`` with the next line's first word, doesn't end a
  sentence, and the next line isn't blank. Comment marks and white space at
  line ends don't count. The lines of a joined paragraph are scored by
  themselves, too, so a notice between unrelated lines is found by its line.
* **Classifier.** Multinomial logistic regression on hashed word 1- and
  2-grams (present or not). It is trained on the driver on notices made from
  the templates (whole, with words dropped, or inside other words) and on at
  most ``SAMPLE`` distinct paragraphs of the corpus; classes are ``none`` and
  the licence families. Notices whose telling words are swapped for ordinary
  ones have a target spread over all families: an unfamiliar licence is not
  ``none``, but no family is likely. Other words of notices in any order
  between ordinary ones are ``none``: it takes their phrases to make a notice.
* **Calibration.** A temperature; the probability of ``none`` below which a
  paragraph is a notice, where a false alarm costs ``ALARM`` missed notices, as
  ordinary paragraphs are by far the most; and the least family probability
  that keeps errors lowest. All three come from held-out notices, swapped ones
  and paragraphs. A notice that falls short of the least is ``unknown``.
* **Confirmation.** Each prediction is compared with all templates: the share
  of a template's weight that a longest common subsequence with the paragraph
  keeps, within twice the template's length. A word weighs the more, the fewer
  families use it. The paragraph is ``unknown`` when its family's share is
  below ``CONFIRM``, or when a rival confirmed family keeps more weight (the
  Affero notice holds all words of the plain one).

Every paragraph of every text is scored; documents are not shuffled.

Defined results: null, empty and blank paragraphs give no row; repeated rows
and ids are scanned each; a row with a null id is scanned (null id in the
result); an empty table gives an empty result. A paragraph is numbered by its
first line (from 0). Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sent
from .textops import LOWER, SPACE, chunks, hash_spans, mix, ngrams, span_hasher, tokens

# Short notices of the families, as their texts and stewards give them.
TEMPLATES = {
    "mit": ["MIT License", "Released under the MIT License.",
            "Licensed under the MIT license. See the LICENSE file in the project root.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
            "SPDX-License-Identifier: MIT"],
    "apache": ["Licensed under the Apache License, Version 2.0.",
               "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
               "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
               "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS",
               "SPDX-License-Identifier: Apache-2.0"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
            "GNU General Public License v3.0", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.",
             "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
             "GNU Affero General Public License v3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 3.",
             "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
             "GNU Lesser General Public License v3.0", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "bsd": ["BSD 3-Clause License", "Released under the BSD License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
            "SPDX-License-Identifier: BSD-3-Clause"],
    "isc": ["ISC License", "Released under the ISC License.",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
            "SPDX-License-Identifier: ISC"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
            "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "epl": ["Licensed under the Eclipse Public License, version 2.0.",
            "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution",
            "Eclipse Public License v2.0", "SPDX-License-Identifier: EPL-2.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.",
                 "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.",
                 "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc0": ["This work is dedicated to the public domain under CC0 1.0 Universal.", "Released into the public domain."],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited.",
                    "Proprietary and confidential. No part may be reproduced without written permission."],
}
FAMILIES = ["none", *TEMPLATES]

BUCKETS = 1 << 15
SAMPLE = 4096                  # corpus paragraphs that the classifier is fitted on, at most
COPIES = 60                    # notices made from each template
CONFIRM = 0.6
ROUNDS = 80
CHUNK = 256 << 10
WRAP = (60, 120)               # bytes: a wrapped line reaches the first and stays within the second
ALARM = 10                     # missed notices that weigh as much as a false alarm
TELLING = 1.2                  # weight above which a template's word tells its family
PASSAGE = 24                   # words of a sampled paragraph that may surround a notice
REPORT = "doc_id long, paragraph long, family string, probability double, similarity double, text string"

_PAD = SPACE.copy()            # bytes that don't count at line ends: white space and comment marks
_PAD[[ord(c) for c in "*#/;-"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:"]] = True


def line_spans(data, offsets):
    """Start and end of the chunk's lines (within texts), the text of each, and
    whether a line continues the paragraph of the one before."""
    feeds = np.flatnonzero(data == 0x0A)
    start = np.unique(np.concatenate([offsets[:-1], feeds + 1]))
    start = start[start < len(data)]
    doc = np.searchsorted(offsets, start, "right") - 1
    end = np.append(start[1:], len(data))
    solid = np.flatnonzero(~_PAD[data])
    a, b = np.searchsorted(solid, start), np.searchsorted(solid, end)
    held = b > a
    first, last = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    first[held], last[held] = solid[a[held]], solid[b[held] - 1]
    gaps = np.flatnonzero(SPACE[data])
    word = np.append(gaps, len(data))[np.searchsorted(gaps, first)] - first     # first word's length
    size = last + 1 - start
    joins = np.zeros(len(start), bool)
    joins[1:] = held[1:] & held[:-1] & (doc[1:] == doc[:-1]) & (size[:-1] <= WRAP[1]) \
        & (size[:-1] + 1 + np.minimum(word[1:], end[1:] - first[1:]) >= WRAP[0])
    at = np.flatnonzero(joins[1:])
    joins[at + 1] = ~_STOP[data[last[at]]]
    return start, end, doc, joins


def spans(data, offsets):
    """Paragraphs and, for joined ones, their lines too: start, end, text, first
    line (within the text), paragraph (within the chunk), whether it is a paragraph."""
    start, end, doc, joins = line_spans(data, offsets)
    heads = np.flatnonzero(~joins)
    tails = np.append(heads[1:], len(start))
    number = np.arange(len(start)) - np.searchsorted(doc, doc)
    several = np.repeat(tails - heads > 1, tails - heads)
    para = np.cumsum(~joins) - 1
    line = np.flatnonzero(several)
    return (np.concatenate([start[heads], start[line]]), np.concatenate([end[tails - 1] if len(heads) else end, end[line]]),
            np.concatenate([doc[heads], doc[line]]), np.concatenate([number[heads], number[line]]),
            np.concatenate([para[heads], para[line]]), np.arange(len(heads) + len(line)) < len(heads))


def grams(data, offsets, start, end):
    """(span number, bucket) pairs, distinct, of spans ``start``..``end`` of whole lines."""
    a, b, shape, _ = tokens(data, offsets)
    a, b = a[shape < 4], b[shape < 4]
    one = hash_spans(LOWER[data], a, b)
    two = ngrams(one, 2)
    lo, hi = np.searchsorted(a, start), np.searchsorted(a, end)

    def numbered(lo, hi, x):
        n = np.maximum(hi - lo, 0)
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        return np.repeat(np.arange(len(n)), n), x[at]
    s1, k1 = numbered(lo, hi, one)
    s2, k2 = numbered(lo, hi - 1, two)
    key = (mix(np.concatenate([k1, k2])) % np.uint64(BUCKETS)).astype(np.int64)
    pairs = np.unique(np.concatenate([s1, s2]) * BUCKETS + key)
    return pairs // BUCKETS, pairs % BUCKETS


def _words(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    start, end, shape, _ = tokens(data, np.array([0, len(data)]))
    return hash_spans(LOWER[data], start[shape < 4], end[shape < 4])


def word_weights() -> dict[int, float]:
    """Weight of each template word's hash: log of families over those that use it."""
    used = [set(np.concatenate([_words(t) for t in texts]).tolist()) for texts in TEMPLATES.values()]
    return {w: math.log((1 + len(used)) / sum(w in u for u in used)) for w in set().union(*used)}


class Templates:
    """Weighted words of every template; compares paragraphs with them."""

    def __init__(self):
        weights = word_weights()
        self.known = [(family, t, np.array([weights[w] for w in t.tolist()]))
                      for family, texts in TEMPLATES.items() for t in map(_words, texts)]
        self.vocabulary = np.array(sorted(weights), np.uint64)

    def compare(self, words: np.ndarray, predicted: str = "") -> dict[str, tuple[float, float]]:
        """Family -> (share, weight kept) of its best template. Shares below ``CONFIRM``
        are worked out for the ``predicted`` family only."""
        best = {family: (0.0, 0.0) for family in TEMPLATES}
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        hits = np.isin(self.vocabulary, words[self.vocabulary[at] == words])
        held = set(self.vocabulary[hits].tolist())
        for family, t, weight in self.known:
            # No window can keep more than the template's words that occur at all.
            if sum(x for w, x in zip(t.tolist(), weight) if w in held) < CONFIRM * weight.sum() and family != predicted:
                continue
            order = np.argsort(t, kind="stable")
            at = np.minimum(np.searchsorted(t[order], words), len(t) - 1)
            worth = np.where(t[order][at] == words, weight[order][at], 0.0)
            sums, size = np.concatenate([[0.0], np.cumsum(worth)]), 2 * len(t)
            lo = np.arange(0, max(1, len(words) - len(t)), len(t))
            bag = sums[np.minimum(lo + size, len(words))] - sums[lo]
            total = weight.sum()
            for k in np.flatnonzero((bag >= CONFIRM * total) | (family == predicted) & (bag == bag.max()) & (bag > 0)):
                kept = self._common(words[lo[k]:lo[k] + size], t, weight)
                best[family] = max(best[family], (kept / total, kept))
        return best

    @staticmethod
    def _common(words, t, weight) -> float:
        row = np.zeros(len(words) + 1)
        for w, x in zip(t, weight):
            new = row.copy()
            new[1:] = np.maximum(new[1:], row[:-1] + x * (words == w))
            row = np.maximum.accumulate(new)
        return float(row[-1])

    def confirmed(self, words: np.ndarray, family: str) -> tuple[float, bool]:
        """The family's share, and whether it passes and no rival that passes keeps more."""
        found = self.compare(words, family)
        share, kept = found[family]
        rival = max((k for f, (s, k) in found.items() if f != family and s >= CONFIRM), default=0.0)
        return share, share >= CONFIRM and kept >= rival - 1e-9

    def resembles(self, words: np.ndarray) -> bool:
        return max(s for s, _ in self.compare(words).values()) >= CONFIRM


def _notices(rng, filler: list[list[str]]):
    """(text, target) made from the templates; ``filler`` are passages of ordinary paragraphs."""
    weights, out = word_weights(), []
    spread = np.append(0.0, np.full(len(TEMPLATES), 1 / len(TEMPLATES)))
    other = [w for f in filler for w in f] or ["word"]
    for c, family in enumerate(FAMILIES[1:], 1):
        for template in TEMPLATES[family]:
            words = template.split()
            telling = [max((weights.get(h, 0.0) for h in _words(w).tolist()), default=0.0) > TELLING for w in words]
            for k in range(COPIES):
                kept, target = list(words), np.eye(len(FAMILIES))[c]
                if k % 6 == 5:
                    kept = [other[int(rng.integers(len(other)))] if own else w for w, own in zip(words, telling)]
                    if sum(telling) > 0.6 * len(words):
                        continue
                    target = spread
                elif k % 4 and len(kept) > 4:
                    kept = [w for w, own in zip(words, telling) if own or rng.random() > 0.1]
                if k % 3 == 2:
                    for side in (0, 1):
                        extra = filler[int(rng.integers(len(filler)))] if filler else []
                        extra = extra[:int(rng.integers(PASSAGE))]
                        kept = kept + extra if side else extra + kept
                if k % 7 == 6:
                    kept = ["Copyright", "2024", *kept]
                out.append((" ".join(kept), target))
    every = [w for texts in TEMPLATES.values() for t in texts for w in t.split()
             if max((weights[h] for h in _words(w).tolist()), default=9) <= TELLING]
    for k in range(len(out) // 4):
        kept = [every[i] for i in rng.integers(len(every), size=int(rng.integers(2, 12)))]
        kept += [other[i] for i in rng.integers(len(other), size=int(rng.integers(PASSAGE)))]
        out.append((" ".join(kept[i] for i in rng.permutation(len(kept))), np.eye(len(FAMILIES))[0]))
    return out


def _sparse(texts: list[str]) -> list[np.ndarray]:
    """Buckets of each text."""
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    span, key = grams(np.frombuffer(b"".join(raw), np.uint8), offsets, offsets[:-1], offsets[1:])
    return np.split(key, np.searchsorted(span, np.arange(1, len(raw))))


class Classifier:
    """Weights per bucket and family, temperature, most of ``none`` and least of a family.

    ``prose`` holds (buckets, passage) of ordinary paragraphs.
    """

    def __init__(self, prose: list[tuple[np.ndarray, str]]):
        rng = np.random.default_rng(5)
        made = _notices(rng, [p.split() for _, p in prose])
        none = np.eye(len(FAMILIES))[0]
        # Empty ones stand for paragraphs whose words were never seen; passages for short ones.
        rows = _sparse([t for t, _ in made] + [p for _, p in prose]) + [k for k, _ in prose] \
            + [np.zeros(0, np.int64)] * (len(prose) // 2 + 1)
        goal = np.array([g for _, g in made] + [none] * (len(rows) - len(made)))
        order = rng.permutation(len(rows))
        rows, goal = [rows[k] for k in order], goal[order]
        line, key = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows).astype(np.int64)
        cut = len(rows) * 4 // 5
        self.w, self.b = np.zeros((BUCKETS, len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
        self.temperature, self.least, self.most = 1.0, 0.5, 0.5
        here = line < cut
        used, col = np.unique(key[here], return_inverse=True)
        row = line[here]
        goal = goal.astype(np.float32)
        w, b = np.zeros((len(used), len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
        g2, b2 = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
        by = np.argsort(col, kind="stable")
        heads = np.flatnonzero(np.diff(col[by], prepend=-1))
        at = np.searchsorted(row, np.arange(cut + 1))
        for _ in range(ROUNDS):
            z = np.zeros((cut, len(FAMILIES)), np.float32) + b
            held = np.flatnonzero(np.diff(at))
            z[held] += np.add.reduceat(w[col], at[held], axis=0)
            error = (_softmax(z) - goal[:cut]) / cut
            g = np.add.reduceat(error[row[by]], heads, axis=0) + 1e-5 * w
            gb = error.sum(axis=0)
            g2 += g * g
            b2 += gb * gb
            w -= 0.3 * g / np.sqrt(g2)
            b -= 0.3 * gb / np.sqrt(b2)
        self.w[used], self.b = w, b
        here = line >= cut
        z, goal = self.logits(line[here] - cut, key[here], len(rows) - cut), goal[cut:]
        if len(goal):
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
            self.temperature = float(min(grid, key=lambda t: -(goal * np.log(_softmax(z / t) + 1e-12)).sum(axis=1).mean()))
            p = _softmax(z / self.temperature)
            best, top = p[:, 1:].argmax(axis=1) + 1, p[:, 1:].max(axis=1)
            right, notice = goal[np.arange(len(goal)), best] == 1, goal.max(axis=1) * (goal[:, 0] == 0) == 1
            wrong = lambda t: int(((top >= t) & ~right | (top < t) & notice).sum())
            plain = goal[:, 0] == 1
            cost = lambda t: ALARM * int((plain & (p[:, 0] < t)).sum()) + int((~plain & (p[:, 0] >= t)).sum())
            self.most = float(min(np.arange(0.1, 0.501, 0.05), key=lambda t: (cost(t), t)))
            self.least = float(min(np.arange(0.3, 0.951, 0.05), key=lambda t: (wrong(t), abs(t - 0.5))))

    def logits(self, line, key, count):
        z = np.zeros((count, len(FAMILIES)))
        if len(line):
            head = np.flatnonzero(np.diff(line, prepend=-1))
            z[line[head]] = np.add.reduceat(self.w[key], head, axis=0)
        return z + self.b

    def predict(self, data, offsets, start, end):
        """(span, family number, probability) of spans that aren't ``none``."""
        p = _softmax(self.logits(*grams(data, offsets, start, end), len(start)) / self.temperature)
        hit = np.flatnonzero(p[:, 0] < self.most)
        best = p[hit, 1:].argmax(axis=1) + 1 if len(hit) else hit
        return hit, best, p[hit, best]


def _softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _paragraph_hashes(data, offsets):
    """Start, end and content hash of a chunk's paragraphs that hold a word."""
    start, end, _, _, _, whole = spans(data, offsets)
    a, b, shape, _ = tokens(data, offsets)
    a = a[shape < 3]
    worded = whole & (np.searchsorted(a, end) > np.searchsorted(a, start))
    start, end = start[worded], end[worded]
    return start, end, span_hasher(LOWER[data])(start, end).view(np.int64)


def ordinary(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(h, keys, passage) of at most ``sample`` distinct paragraphs that resemble no template.

    Paragraphs of least content hash: a cut-off from the number of distinct
    ones, so that all tasks together send about ``sample``, once per batch. A
    paragraph goes as its buckets (all of it, ``BUCKETS`` at most) and a passage.
    """
    def hashes(batches):
        for batch in batches:
            found = [np.zeros(0, np.int64)] + [_paragraph_hashes(d, o)[2] for _, _, d, o in chunks(batch.column(0), CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)))], ["h"])
    total = docs.select("text").mapInArrow(hashes, "h long").agg(F.approx_count_distinct("h", 0.02)).first()[0]
    share = 1.2 * (sample + 8 * math.sqrt(sample) + 8) / max(1, total)       # the count is within some 6 %
    limit = int(-2 ** 63 + share * 2 ** 64) if share < 1 else 2 ** 63 - 1

    def taken(batches):
        known = Templates()
        for batch in batches:
            out = {}
            for _, _, data, offsets in chunks(batch.column(0), CHUNK):
                start, end, h = _paragraph_hashes(data, offsets)
                low = np.flatnonzero(h <= limit)
                span, key = grams(data, offsets, start[low], end[low])
                cut = np.searchsorted(span, np.arange(len(low) + 1))
                for k, at in enumerate(low):
                    text = data[start[at]:end[at]].tobytes().decode("utf-8", "replace")
                    if int(h[at]) not in out and not known.resembles(_words(text)):
                        passage = " ".join(w[:64] for w in text.split(None, PASSAGE)[:PASSAGE])
                        out[int(h[at])] = key[cut[k]:cut[k + 1]].astype(np.int32).tobytes(), passage
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array([v[0] for v in out.values()], pa.binary()),
                                              pa.array([v[1] for v in out.values()], pa.string())], ["h", "keys", "passage"])
    return docs.select("text").mapInArrow(taken, "h long, keys binary, passage string") \
        .groupBy("h").agg(F.min(F.struct("keys", "passage")).alias("r")).select("h", "r.keys", "r.passage") \
        .orderBy("h").limit(sample)


def train(docs: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Classifier fitted on the templates and a bounded sample of the corpus's paragraphs."""
    return Classifier([(np.frombuffer(r["keys"], np.int32), r.passage) for r in ordinary(docs, sample).collect()])


def scan(docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """``REPORT``: one row per paragraph that holds a licence notice, known or not.

    A joined paragraph of a known family is reported as its first line that has the
    family by itself, or else whole; one without a known family as its
    lines of known families, or else whole, if it is ``unknown``.
    """
    sent = Sent(docs.sparkSession, model or train(docs))

    def notices(model, templates, data, offsets):
        start, end, doc, line, para, whole = spans(data, offsets)
        groups = {}
        for k, family, q in zip(*model.predict(data, offsets, start, end)):
            raw = data[start[k]:end[k]].tobytes().decode("utf-8", "replace").rstrip("\n")
            like, sure = templates.confirmed(_words(raw), FAMILIES[family])
            name = FAMILIES[family] if q >= model.least and sure else "unknown"
            groups.setdefault(int(para[k]), []).append((bool(whole[k]), name, (int(doc[k]), int(line[k]), name, float(q), like, raw)))
        for group in groups.values():
            main = next((g for g in group if g[0]), None)
            if main and main[1] != "unknown":
                yield next((g for g in group if not g[0] and g[1] == main[1]), main)[2]
            else:
                lines = [g[2] for g in group if not g[0] and g[1] != "unknown"]
                yield from lines or ([main[2]] if main else [])

    def run(batches):
        model, templates = sent.value, Templates()
        for batch in batches:
            out = [(lo + doc, *rest) for lo, _, data, offsets in chunks(batch.column(1), CHUNK)
                   for doc, *rest in sorted(notices(model, templates, data, offsets))]
            ids = batch.column(0).take(pa.array([o[0] for o in out], pa.int64()))
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([o[k + 1] for o in out], t) for k, t in enumerate(kinds))],
                                             ["doc_id", "paragraph", "family", "probability", "similarity", "text"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, REPORT)
