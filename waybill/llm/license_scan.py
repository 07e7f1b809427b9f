"""Licence scans: a trained paragraph classifier, confirmed by templates.

Sparse word n-grams (one to three words) go into a multinomial logistic regression over licence families and an
unknown class. It is trained on the templates below: whole, cut, mutated, mixed into other words and with fields
filled in; negatives are shuffled template words, near misses and prose made of the templates' common words. Temperature
scaling on held-out variants calibrates the probabilities; under ``CONFIDENT`` a passage is unknown. A prediction then
stands only if the passage agrees with a template of its family: by the share of the template's n-grams that it
holds, or of its own that the template holds.

Paragraphs are runs of lines between blank ones, once comment markers are taken off, so that a notice counts once
however it is wrapped. Notices also stand among other lines without a blank one. So a paragraph is read in units
(sentences and lines); units that share two words in a row with a template are related, runs of related ones
(``GAP`` others between them at most) are passages, and these are what is classified: a passage most of which is in the
templates of one family is that family's, unless its units are whole notices of several; else, if units alone tell
families, each of them and what follows it; else the passage as it is.

A passage of three words or more without two template words in a row can't agree: its n-grams would be single words, at
most half of its own n-grams and of any template's. That is why units that aren't related need no classifier.
Every whole text is read, in one scan without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN, CONFIDENT, AGREES, MAX_N = "unknown", 0.6, 0.6, 3
#: Units without template words that a passage may hold between related ones.
GAP = 1
#: Share of a template that a unit holds if it is a notice by itself.
COMPLETE = 0.9

#: Licence families and notices that name them (fixed wordings of public licences).
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
        "Licensed under the GNU Lesser General Public License, version 3.",
    ],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD 3-Clause License.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "Licensed under the Mozilla Public License, version 2.0."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Licensed under the ISC License."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.", "Released under CC0 1.0 Universal."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "proprietary": ["All rights reserved. No part of this work may be reproduced without written permission.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."],
}
#: Sentences that use the words of licences and grant nothing.
NEAR_MISSES = [
    "The driver lost his license and had to pay a fee to the public office.",
    "This version of the general plan was released in 2004.",
    "The software was distributed with the copy of the book.",
    "A license is required to work as a driver under the law.",
    "All rights of the author are related to this work.",
    "The apache helicopter is a version of the machine.",
    "Students at MIT have released a public file.",
    "Free software is used for any purpose.",
]

_WORD = re.compile(r"[a-z0-9][a-z0-9.+]*[a-z0-9+]|[a-z0-9]").findall
#: Comment markers of the usual languages at either end of a line.
_MARKERS = re.compile(r"^[\s]*(?:(?:/\*+|\*+/|\*|//+|#+!?|--+|;+|%+|<!--+|\"{3}|'{3}|REM\b|dnl\b|\.\\\")[\s]*)+|[\s]*(?:\*+/|--+>|\"{3}|'{3}|[\s]\*+)[\s]*$").sub
_UNIT = re.compile(r"(?<=[.!?;])\s+").split


def words_of(paragraph: str) -> list[str]:
    return _WORD(paragraph.lower())


def grams(words: list[str], most: int = MAX_N) -> list[str]:
    return [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


@dataclass
class Model:
    families: list[str]
    vocabulary: dict[str, int]
    weights: np.ndarray  # n-grams by families; the last family is unknown
    bias: np.ndarray
    temperature: float
    idf: np.ndarray
    templates: dict[str, list[frozenset[str]]]

    def __post_init__(self) -> None:
        self.single = {w for g in self.vocabulary for w in g.split()}
        self.pairs = {g for g in self.vocabulary if g.count(" ") == 1}
        self.known = {f: frozenset().union(*t) for f, t in self.templates.items()}

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Indices and values: tf (1 + log) times idf, length 1 over all n-grams, unseen ones at the largest idf."""
        counts = Counter(grams(words))
        known = [(self.vocabulary[g], 1 + np.log(c)) for g, c in counts.items() if g in self.vocabulary]
        at = np.array([k for k, _ in known], np.int64)
        value = np.array([v for _, v in known]) * self.idf[at] if known else np.empty(0)
        unseen = (len(counts) - len(known)) * float(self.idf.max()) ** 2 * 0.25
        return at, value / np.sqrt((value**2).sum() + unseen) if len(at) else value

    def probabilities(self, words: list[str]) -> np.ndarray:
        at, value = self.features(words)
        z = (self.bias + value @ self.weights[at]) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def agreement(self, words: list[str], family: str) -> float:
        """The best template's larger share: of its n-grams held by the paragraph, of the paragraph's held by it."""
        own = frozenset(grams(words))
        return max(max(len(own & t) / len(t), len(own & t) / max(1, len(own))) for t in self.templates[family])

    def inside(self, words: list[str], family: str) -> float:
        """The share of a passage's n-grams that the family's templates hold."""
        own = frozenset(grams(words))
        return len(own & self.known[family]) / max(1, len(own))

    def holds(self, words: list[str], family: str) -> float:
        """The largest share of a template of the family that a passage holds."""
        own = frozenset(grams(words))
        return max(len(own & t) / len(t) for t in self.templates[family])

    def related(self, words: list[str]) -> bool:
        """Two words in a row as in a template."""
        return not self.single.isdisjoint(words) and any(f"{a} {b}" in self.pairs for a, b in zip(words, words[1:], strict=False))

    def classify(self, paragraph: str) -> tuple[str, float, float]:
        """Family or unknown, its calibrated probability, agreement with the family's templates."""
        return self.classify_words(words_of(paragraph))

    def classify_words(self, words: list[str]) -> tuple[str, float, float]:
        if len(words) < 2:
            return UNKNOWN, 1.0, 0.0
        p = self.probabilities(words)
        best = int(p.argmax())
        if best == len(self.families) or p[best] < CONFIDENT:
            return UNKNOWN, float(1 - p[: len(self.families)].max()), 0.0
        agrees = self.agreement(words, self.families[best])
        return (self.families[best] if agrees >= AGREES else UNKNOWN), float(p[best]), agrees


@dataclass
class Unit:
    """Words of a sentence or line, and the lines that it stands on."""

    words: list[str]
    first: int
    last: int


def paragraphs(text: str) -> Iterator[list[tuple[int, str]]]:
    """Runs of lines (number, line without comment markers) between blank ones; a line of markers alone is blank."""
    held: list[tuple[int, str]] = []
    for i, line in enumerate(text.split("\n")):
        bare = _MARKERS("", line).strip()
        if bare:
            held.append((i, bare))
        elif held:
            yield held
            held = []
    if held:
        yield held


def units_of(paragraph: list[tuple[int, str]]) -> list[Unit]:
    found = [Unit(words_of(x), i, i) for i, line in paragraph for x in _UNIT(line)]
    return [u for u in found if u.words]


def passages(units: list[Unit], model: Model, gap: int = GAP) -> Iterator[list[Unit]]:
    """Runs of units from a related one to a related one. Two words in a row may be on two units: the words of a
    unit are seen with the last of the unit before and the first of the one after."""
    run: list[Unit] = []
    end = 0  # units of the run up to its last related one
    for i, u in enumerate(units):
        around = units[i - 1].words[-1:] * (i > 0) + u.words + (units[i + 1].words[:1] if i + 1 < len(units) else [])
        if len(u.words) <= 2 or model.related(around):
            run.append(u)
            end = len(run) if model.related(around) or not end else end
        elif run:
            run.append(u)
            if len(run) - end > gap:
                yield run[:end]
                run, end = [], 0
    if run:
        yield run[:end]


def notices(paragraph: list[tuple[int, str]], model: Model) -> list[dict]:
    """The confirmed licences of a paragraph: first and last line, family, probability, agreement."""
    found = []

    def tell(some: list[Unit], told: tuple[str, float, float]) -> None:
        if told[0] != UNKNOWN:
            found.append({"first_line": some[0].first, "last_line": some[-1].last, "family": told[0], "probability": told[1], "agreement": told[2]})

    for run in passages(units_of(paragraph), model):
        words = [w for u in run for w in u.words]
        whole = model.classify_words(words)
        if len(run) == 1:
            tell(run, whole)
            continue
        alone = [model.classify_words(u.words) for u in run]
        complete = {t[0] for u, t in zip(run, alone, strict=True) if t[0] != UNKNOWN and model.holds(u.words, t[0]) >= COMPLETE}
        if len(complete) < 2 and whole[0] != UNKNOWN and model.inside(words, whole[0]) >= AGREES:
            tell(run, whole)
            continue
        heads = [i for i, t in enumerate(alone) if t[0] != UNKNOWN]
        if not heads:
            tell(run, whole)
            continue
        cuts = [i for n, i in enumerate(heads) if n == 0 or alone[i][0] != alone[heads[n - 1]][0]]
        for s, e in zip(cuts, [*cuts[1:], len(run)], strict=True):
            more = model.classify_words([w for u in run[s:e] for w in u.words])
            last = max(i for i in heads if i < e)
            # What follows the unit belongs to it as far as the family stays the same.
            tell(run[s:e] if more[0] == alone[s][0] else run[s : last + 1], more if more[0] == alone[s][0] else alone[s])
    return found


def _mutated(words: list[str], rng: np.random.Generator) -> list[str]:
    """One word in fifteen or so changed, lost or doubled."""
    out = []
    for w in words:
        kind = rng.random() * 15
        out += ["".join(rng.choice(list("aeinorstlhd"), rng.integers(2, 9)))] if kind < 0.5 else [] if kind < 0.8 else [w, w] if kind < 1 else [w]
    return out


def variants(seed: int, each: int) -> tuple[list[list[str]], list[int]]:
    """Training paragraphs as words, and their families (the last: unknown)."""
    rng = np.random.default_rng(seed)
    families = list(TEMPLATES)
    common = [w for t in TEMPLATES.values() for s in t for w in words_of(s)]
    filler = lambda n: ["".join(rng.choice(list("aeinorstlhd"), rng.integers(2, 9))) for _ in range(n)]
    rows: list[list[str]] = []
    labels: list[int] = []

    def add(words: list[str], label: int) -> None:
        if words:
            rows.append(words)
            labels.append(label)

    for f, family in enumerate(families):
        for template in TEMPLATES[family]:
            own = words_of(template)
            add(own, f)
            for _ in range(each):
                new = list(own)
                if len(new) > 12:  # part of a long notice
                    keep = rng.integers(max(8, len(new) // 4), len(new) + 1)
                    at = rng.integers(0, len(new) - keep + 1)
                    new = new[at : at + keep]
                elif rng.random() < 0.3:  # a short one with other words around it
                    new = filler(rng.integers(0, 4)) + new + filler(rng.integers(0, 4))
                add(_mutated(new, rng) if len(new) > 12 and rng.random() < 0.4 else new, f)
            for _ in range(each):  # its words without its order
                add(list(rng.permutation(own))[: rng.integers(1, len(own) + 1)], len(families))
    for _ in range(each * len(families)):
        add(filler(rng.integers(3, 40)), len(families))
        add(list(rng.choice(common, rng.integers(1, 5))) + filler(rng.integers(3, 30)), len(families))
    for sentence in NEAR_MISSES * each:
        own = words_of(sentence)
        at = rng.integers(0, len(own) // 2)
        add(own[at:] + filler(rng.integers(0, 5)), len(families))
    return rows, labels


@lru_cache(maxsize=1)
def fit(seed: int = 11, each: int = 20, ridge: float = 3e-4, steps: int = 250) -> Model:
    """Train on the driver: a few thousand short paragraphs made of the templates, whatever the corpus."""
    rows, labels = variants(seed, each)
    df = Counter(g for r in rows for g in set(grams(r)))
    held = {g for t in TEMPLATES.values() for s in t for g in grams(words_of(s))}
    vocabulary = {g: i for i, g in enumerate(sorted(held))}
    idf = np.array([np.log((1 + len(rows)) / (1 + df[g])) + 1 for g in vocabulary])
    families = list(TEMPLATES)
    templates = {f: [frozenset(grams(words_of(s))) for s in TEMPLATES[f]] for f in families}
    k = len(families) + 1
    model = Model(families, vocabulary, np.zeros((len(vocabulary), k)), np.zeros(k), 1.0, idf, templates)
    at, value, owner = [], [], []
    for i, r in enumerate(rows):
        a, v = model.features(r)
        at.append(a)
        value.append(v)
        owner.append(np.full(len(a), i))
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    x[np.concatenate(owner), np.concatenate(at)] = np.concatenate(value)
    y = np.eye(k, dtype=np.float32)[labels]
    w, b = np.zeros((len(vocabulary), k), np.float32), np.zeros(k, np.float32)
    vw, vb = w.copy(), b.copy()
    for _ in range(steps):  # Nesterov's gradient
        z = x @ (w + 0.9 * vw) + b + 0.9 * vb
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - y) / len(rows)
        vw = 0.9 * vw - 20 * (x.T @ g + ridge * w)
        vb = 0.9 * vb - 2 * g.sum(axis=0)
        w, b = w + vw, b + vb
    model.weights, model.bias = w.astype(float), b.astype(float)
    fresh, truth = variants(seed + 1, 3)
    logits = np.stack([model.bias + v @ model.weights[a] for a, v in map(model.features, fresh)])

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        return float(-(z[np.arange(len(z)), truth] - np.log(np.exp(z).sum(axis=1))).mean())

    model.temperature = min(np.geomspace(0.1, 5, 60), key=loss)
    return model


_NOTICE = pa.struct([("first_line", pa.int32()), ("last_line", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("agreement", pa.float64())])
#: Paragraphs whose result a worker keeps, and letters of those it keeps.
_KEPT, _SHORT = 20_000, 400


def _scanner(model: Model):
    kept: dict[tuple[str, ...], list[dict]] = {}

    def told(paragraph: list[tuple[int, str]]) -> list[dict]:
        key = tuple(x for _, x in paragraph)
        if sum(map(len, key)) > _SHORT:
            return notices(paragraph, model)
        known = kept.get(key)
        if known is None:
            if len(kept) > _KEPT:
                kept.clear()
            known = kept[key] = notices(list(enumerate(key)), model)
        begin = paragraph[0][0]
        return [n | {"first_line": n["first_line"] + begin, "last_line": n["last_line"] + begin} for n in known]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, hits = batch.column(0).to_pylist(), [], []
            for text in batch.column(1):
                found: list[dict] = []
                count = 0
                for paragraph in paragraphs(text.as_py() or ""):
                    count += 1
                    found += told(paragraph)
                counts.append(count)
                hits.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(hits, pa.list_(_NOTICE))], names=["doc_id", "n_paragraphs", "licences"])

    return run


def scan_licences(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row a row of ``docs`` (doc_id, text; others are ignored): doc_id, n_paragraphs, licences (first_line,
    last_line, family, calibrated probability, template agreement of each confirmed notice, in order).

    Null, empty and blank texts have no paragraphs; repeated rows each get their row; lines and paragraphs may be of any
    length. An empty table gives an empty result.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scanner(model or fit()), "doc_id long, n_paragraphs long, licences array<struct<first_line:int,last_line:int,family:string,probability:double,agreement:double>>")
