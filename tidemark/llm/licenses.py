"""Licence scans: a trained paragraph classifier, calibrated on held-out paragraphs, confirmed by templates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import chunks, words
from .common import text_of

#: Notices by which works name their licence, in the words that the licences' own pages recommend.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Apache 2.0 licensed.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "MIT licensed.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GPLv3.",
        "Licensed under the GPL version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Affero General Public License, version 3.",
        "Released under the AGPLv3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "eupl": [
        "Licensed under the EUPL, Version 1.2 or later.",
        "Licensed under the European Union Public Licence.",
        "SPDX-License-Identifier: EUPL-1.2",
    ],
    "cc_by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc_nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
        "Licensed under CC BY-NC-ND 4.0.",
    ],
    "cc_nd": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ],
    "public_domain": [
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "reserved": [
        "All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ],
}
#: Notices of licences without a family of their own; they train and calibrate the unknown class.
STRANGE = [
    "Licensed under the Artistic License 2.0.",
    "This software is provided under the zlib license.",
    "Licensed under the Eclipse Public License, version 2.0.",
    "Released under the Boost Software License, Version 1.0.",
    "Distributed under the terms of the Common Development and Distribution License.",
    "This file is available under the Open Database License.",
    "Licensed under the Microsoft Public License.",
    "Released under the Do What You Want license.",
    "This font is licensed under the SIL Open Font License, Version 1.1.",
    "Use of this dataset is subject to the terms of the community license agreement.",
    "Licensed under the Python Software Foundation License.",
    "This program is distributed under the terms of the PostgreSQL License.",
]
#: Sentences that use the same words and name no licence.
OTHER = [
    "She got her driving license in the spring and was released under strict conditions.",
    "The museum is open to the public and free of charge on the first day of any month.",
    "Version 2.0 of the report was distributed to any person who asked for a copy.",
    "The general public may use the software without restriction of time.",
    "He was granted permission to copy the source and to modify the following terms.",
    "The Apache helicopter was licensed for export under the treaty.",
    "All seats were reserved and all rights of way were kept.",
    "Students at MIT released a report under the lead of the faculty.",
    "The foundation published a version of the notice for the common good.",
    "This work is hard and the conditions are met with or without help.",
    "Creative people share common ideas; the attribution of this work is not settled.",
    "The above list of conditions must be included in all substantial portions of the plan.",
    "The restaurant lost its license after the new version of the law.",
    "Doctors are licensed by the state and the public trusts them.",
    "The union of European students published its public terms.",
    "The work was available in all forms and the files were open.",
]
UNKNOWN = "unknown"
#: Share of a template's word triples (pairs, if it has fewer than 8 words) that a stretch must hold.
CONTAINED = 0.6
#: Share of the held-out paragraphs without the licence that may pass a probability.
FALSE_ACCEPT = 0.005
#: A paragraph of more tokens is read in stretches of this many, each half over the one before.
STRETCH = 320
#: Documents of the corpus whose paragraphs train and calibrate the class of plain prose, picked by a hash.
PROSE = 500

_low = np.arange(256, dtype=np.uint8)
_low[65:91] += 32
#: A token is a run of letters, digits and bytes beyond ASCII.
_no_token = np.ones(256, bool)
_no_token[48:58] = _no_token[97:123] = _no_token[128:] = False

_PAIR, _TRIPLE = np.uint64(3), np.uint64(5)


class Tokens:
    """The tokens of a chunk of texts and their paragraphs, the lines between lines without a token, in stretches.

    h, row, line: of each token; par, at: its paragraph and place there; first: the first token of each paragraph.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = _low[data]
        self.h, self.row, start, _ = words(low, offsets, _no_token)
        feeds = np.concatenate([[0], np.cumsum(data == 10)])
        self.line = feeds[start] - feeds[offsets[self.row]]
        n = len(self.h)
        self.next = np.zeros(n, bool)
        self.next[:-1] = (self.row[1:] == self.row[:-1]) & (self.line[1:] - self.line[:-1] <= 1)
        head = np.ones(n, bool)
        head[1:] = ~self.next[:-1]
        self.first = np.flatnonzero(head)
        self.par = np.cumsum(head) - 1
        self.at = np.arange(n) - self.first[self.par] if n else np.zeros(0, np.int64)
        self.size = np.diff(np.append(self.first, n))
        half = STRETCH // 2
        self.windows = np.maximum(1, -(-self.size // half) - 1)
        self.base = np.cumsum(self.windows) - self.windows
        self.pairs = np.flatnonzero(self.next)
        self.pair_codes = self.h[self.pairs] * _PAIR + self.h[self.pairs + 1]

    def stretches(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(stretch, index into tokens): each token with the one or two stretches that hold it."""
        k = self.at[tokens] // (STRETCH // 2)
        own, most = self.base[self.par[tokens]], self.windows[self.par[tokens]]
        here, back = np.flatnonzero(k < most), np.flatnonzero(k > 0)
        return np.concatenate([(own + k)[here], (own + k)[back] - 1]), np.concatenate([here, back])

    def span(self, stretch: int) -> tuple[int, int]:
        """First and last token (exclusive) of a stretch."""
        par = int(np.searchsorted(self.base, stretch, "right")) - 1
        a = int(self.first[par]) + int(stretch - self.base[par]) * (STRETCH // 2)
        return a, min(a + STRETCH, int(self.first[par] + self.size[par]))


def tokens_of(texts: list[str]) -> Tokens:
    raw = [t.encode() for t in texts]
    return Tokens(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))


@cache
def profiles() -> list[tuple[str, int, int, np.ndarray]]:
    """(family, words, 2 or 3, codes of its pairs or triples) of each template."""
    out = []
    for family, texts in TEMPLATES.items():
        for t in texts:
            h = tokens_of([t]).h
            codes = h[:-1] * _PAIR + h[1:]
            n = 2
            if len(h) >= 8:
                n, codes = 3, codes[:-1] * _TRIPLE + h[2:]
            out.append((family, len(h), n, np.unique(codes)))
    return out


def confirmed(h: np.ndarray) -> dict[str, float]:
    """Of each family, the largest share of one of its templates that lies within the template's length in the tokens h.

    A place counts for the family whose template covers the most there: what lies inside a better covered place of
    another family is not told.
    """
    pairs = h[:-1] * _PAIR + h[1:]
    codes = {2: pairs, 3: pairs[:-1] * _TRIPLE + h[2:]}
    found: list[tuple[float, int, str, int, int]] = []
    for family, length, n, parts in profiles():
        at = np.flatnonzero(np.isin(codes[n], parts))
        if len(at) < CONTAINED * len(parts) - 1e-9:
            continue
        # two ends move over the places; the distinct parts between them are counted
        names, count, low, distinct, best = codes[n][at].tolist(), {}, 0, 0, (0, 0, 0)
        for i, name in enumerate(names):
            count[name] = count.get(name, 0) + 1
            distinct += count[name] == 1
            while at[i] - at[low] > length + 3:
                count[names[low]] -= 1
                distinct -= count[names[low]] == 0
                low += 1
            if distinct > best[0]:
                best = (distinct, int(at[low]), int(at[i]) + n)
        share = best[0] / len(parts)
        if share >= CONTAINED - 1e-9:
            found.append((share, best[0], family, best[1], best[2]))
    out: dict[str, float] = {}
    for share, many, family, a, b in found:
        beaten = any(f != family and a < d and c < b and (s, k) > (share, many) for s, k, f, c, d in found)
        if not beaten:
            out[family] = max(out.get(family, 0.0), share)
    return out


class Classifier:
    """Logistic regressions over sparse word n-grams: one for each family, and one for any licence at all.

    Trained on notices that lose words and stand in prose, on licences without a family, on sentences that use the same
    words, and on paragraphs of the corpus; two thirds train it. On the others Platt's method calibrates the
    probabilities, and the least one of each output lets FALSE_ACCEPT of the paragraphs without it pass.
    """

    def __init__(self, prose: list[str], seed: int = 7, copies: int = 24, epochs: int = 10, rate: float = 0.3, ridge: float = 2e-4):
        rng = np.random.default_rng(seed)
        self.names = [*TEMPLATES, "licence"]
        notices = [(t, k) for k, ts in enumerate(TEMPLATES.values()) for t in ts]
        known = tokens_of([t for t, _ in notices] + STRANGE + OTHER)
        self.vocabulary = np.unique(np.concatenate([known.h, known.pair_codes]))
        filler = [w for t in prose + OTHER for w in t.split()]
        cases: list[tuple[str, list[int]]] = []
        last = len(self.names) - 1
        for _ in range(copies):
            for t, k in notices:
                cases.append((self.varied(t, rng, filler), [k, last]))
            for t in STRANGE:
                cases += [(self.varied(t, rng, filler), [last])] * 2
            for t in OTHER:
                cases += [(self.varied(t, rng, filler), [])] * 2
            for _ in range(8):  # two notices in one paragraph
                (a, i), (b, j) = (notices[x] for x in rng.integers(0, len(notices), 2))
                cases.append((self.varied(a, rng, filler) + "\n" + self.varied(b, rng, filler), [i, j, last]))
        cases += [(t, []) for t in prose]
        order = rng.permutation(len(cases))
        rows = self.by_text(tokens_of([cases[i][0] for i in order]), len(cases))
        y = np.zeros((len(cases), len(self.names)))
        for i, c in enumerate(order):
            y[i, cases[c][1]] = 1
        held = np.arange(len(cases)) % 3 == 2
        self.w, self.b = np.zeros((len(self.vocabulary), len(self.names))), np.full(len(self.names), -2.0)
        square, square_b = np.full_like(self.w, 1e-8), np.full_like(self.b, 1e-8)
        for _ in range(epochs):
            for i in np.flatnonzero(~held):
                x = rows[i]
                g = 1 / (1 + np.exp(-np.clip(self.w[x].sum(0) + self.b, -30, 30))) - y[i]
                step = g + ridge * self.w[x]
                square[x] += step**2
                square_b += g**2
                self.w[x] -= rate * step / np.sqrt(square[x])
                self.b -= rate * g / np.sqrt(square_b)
        z = np.array([self.w[rows[i]].sum(0) + self.b for i in np.flatnonzero(held)])
        self.platt = np.array([platt(z[:, k], y[held][:, k]) for k in range(len(self.names))])
        p = self.probability(z)
        self.least = np.array([max(0.5, self.bound(p[y[held][:, k] == 0, k])) for k in range(len(self.names))])

    @staticmethod
    def bound(p: np.ndarray) -> float:
        return float(np.nextafter(np.sort(p)[int(len(p) * (1 - FALSE_ACCEPT))], 1)) if len(p) else 0.5

    @staticmethod
    def varied(text: str, rng: np.random.Generator, filler: list[str]) -> str:
        """text with a few words lost, wrapped or not, and prose on either side."""
        loss = rng.choice([0.0, 0.0, 0.05, 0.15])
        w = [x for x in text.split() if rng.random() > loss] or text.split()
        if rng.random() < 0.3:
            w = [x + ("\n" if i % 9 == 8 else "") for i, x in enumerate(w)]

        def pad() -> str:
            n, at = int(rng.choice([0, 0, 3, 30, 120])), int(rng.integers(0, len(filler)))
            return " ".join(filler[at : at + n])

        return " ".join([pad(), " ".join(w), pad()]).strip()

    def features(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """(stretch, place in the vocabulary) of the words and word pairs of each stretch, once each."""
        v = self.vocabulary
        hit, where = [], []
        for codes, tokens in ((t.h, np.arange(len(t.h))), (t.pair_codes, t.pairs)):
            if len(codes):
                place = np.minimum(np.searchsorted(v, codes), len(v) - 1)
                ok = v[place] == codes
                hit.append(tokens[ok])
                where.append(place[ok])
        if not hit:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        stretch, of = t.stretches(np.concatenate(hit))
        both = np.unique(stretch * len(v) + np.concatenate(where)[of])
        return both // len(v), both % len(v)

    def by_text(self, t: Tokens, n: int) -> list[np.ndarray]:
        """The features of each of n training texts, which are one paragraph each, long ones cut to their first stretch."""
        stretch, place = self.features(t)
        par = np.searchsorted(t.base, stretch, "right") - 1
        whole = stretch == t.base[par]
        row = t.row[t.first[par[whole]]]
        return np.split(place[whole], np.searchsorted(row, np.arange(1, n)))

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z * self.platt[:, 0] + self.platt[:, 1], -30, 30)))

    def score(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """(stretches, probabilities) of all stretches with a word of the vocabulary; any other is plain prose."""
        stretch, place = self.features(t)
        which, start = np.unique(stretch, return_index=True)
        if not len(which):
            return which, np.zeros((0, len(self.names)))
        return which, self.probability(np.add.reduceat(self.w[place], start) + self.b)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, str, float]]:
        """(row, paragraph, family, probability) of each paragraph's licences.

        The classifier reads every paragraph. What it takes for a licence is compared with the templates: a family that it
        finds and that a template confirms is told, else the licence is unknown.
        """
        t = Tokens(data, offsets)
        which, p = self.score(t)
        out: dict[tuple[int, int, str], float] = {}
        strange: dict[tuple[int, int], float] = {}
        for i in np.flatnonzero((p >= self.least).any(axis=1)):
            a, b = t.span(int(which[i]))
            row, par = int(t.row[a]), int(t.par[a])
            sure = confirmed(t.h[a:b])
            told = [k for k in np.flatnonzero(p[i, :-1] >= self.least[:-1]) if self.names[k] in sure]
            for k in told:
                key = (row, par, self.names[k])
                out[key] = max(out.get(key, 0.0), float(p[i, k]))
            if not told and p[i, -1] >= self.least[-1]:
                strange[row, par] = max(strange.get((row, par), 0.0), float(p[i, -1]))
        named = {(row, par) for row, par, _ in out}
        out |= {(row, par, UNKNOWN): x for (row, par), x in strange.items() if (row, par) not in named}
        return [(*key, x) for key, x in sorted(out.items())]


def platt(z: np.ndarray, y: np.ndarray, steps: int = 30) -> tuple[float, float]:
    """Slope and offset that make the logits z probabilities of y, by Newton's method with Platt's smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    goal = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    x = np.column_stack([z, np.ones(len(z))])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = x.T @ (p - goal) + np.array([1e-3 * (a - 1), 1e-3 * b])
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        da, db = np.linalg.solve(h, g)
        a, b = max(0.05, a - np.clip(da, -1, 1)), b - np.clip(db, -1, 1)
    return a, b


def prose_of(docs: DataFrame, rows: int = PROSE) -> list[str]:
    """The paragraphs of about `rows` documents, without those that a template matches: whole texts, by a hash of them."""
    slim = docs.select(text_of(docs).alias("text")).filter("length(text) > 0")
    n = slim.count()
    share = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, rows / max(n, 1))))
    got = sorted(r[0] for r in slim.filter(share).select("text").distinct().collect())
    parts = [p for text in got for p in text.split("\n\n") if p.strip()]
    return [p for p in parts if not confirmed(tokens_of([p]).h)]


def scan(docs: DataFrame, prose: int = PROSE) -> DataFrame:
    """doc_id, n_paragraphs (paragraphs and families that name a licence), families (comma-joined, sorted), score (highest).

    Paragraphs are the lines of a whole text between lines without a letter or digit (comment marks are none, so wrapped
    notices are one). All are scored by the classifier, a very long one in stretches; templates confirm what it
    finds. A licence that has no family, or that no template confirms, is `unknown`. The classifier is trained when the
    scan is planned, with the paragraphs of about `prose` documents as plain prose. Null
    text is empty; score is 0 without licences; repeated rows are scanned each; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(Classifier(prose_of(docs, prose)))
    slim = docs.select("doc_id", text_of(docs).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = model.value
        for batch in batches:
            n = batch.num_rows
            count, names, top = np.zeros(n, np.int64), [set() for _ in range(n)], np.zeros(n)
            for start, _, data, offsets in chunks(batch.column(1)):
                for row, _, family, p in judge(data, offsets):
                    count[start + row] += 1
                    names[start + row].add(family)
                    top[start + row] = max(top[start + row], p)
            told = pa.array([",".join(sorted(x)) for x in names], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count), told, pa.array(top)], ["doc_id", "n_paragraphs", "families", "score"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, n_paragraphs long, families string, score double")
