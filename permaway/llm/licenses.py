"""Licence scans: a sparse n-gram logistic regression over paragraphs, in DataFrame functions only.

A paragraph is a line; a line of more than ``LONG`` characters is cut at sentence
ends.  A candidate has enough word pairs of the templates that one could confirm
it (``_candidate``).  Features are the distinct words and
word pairs of the folded paragraph, hashed into ``WIDTH`` places; the classes are
the licence families and ``unknown``.

Training (on the driver, from the templates below and fixed unrelated sentences,
bounded by construction) perturbs templates: words go, come and change, pieces
are cut out, notices run into other prose.  The weights are fitted with an L1
penalty, so most are zero.  A temperature and a threshold, chosen on held-back
perturbations, calibrate the probabilities: below the threshold a paragraph is
``unknown``.  A prediction counts only if a template of its family confirms it:
``CONFIRM`` of the template's word pairs occur in the paragraph, or of the
paragraph's (four at least) in the template.

Defined cases: null or empty text has no paragraphs and no licence; ties go to the
earlier paragraph, then to the first family by name; repeated rows get equal results.
"""

from __future__ import annotations

import json
import random
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 4096
LONG = 400
CONFIRM = 0.7
UNKNOWN = "unknown"
#: Notices and characteristic sentences of public licences.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "bsd": (
        "Released under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/ (Mozilla Public License).",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ),
    "public-domain": (
        "This work has been dedicated to the public domain.",
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work (CC0).",
        "Licensed under CC0 1.0 Universal, public domain dedication.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright 2020 Example Corporation. All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher.",
        "This software is proprietary and confidential; unauthorized copying of this file is strictly prohibited under copyright law.",
    ),
}
#: Sentences with such words that state no licence.
UNRELATED = (
    "He lost his driving licence after the accident last year.",
    "The restaurant applied for a licence to sell wine.",
    "She asked permission to leave the room early.",
    "The product comes with a two year warranty on all parts.",
    "They discussed copyright reform in parliament for weeks.",
    "The income was redistributed among the poorer regions.",
    "Most of his photographs are in a private collection, not in the public domain.",
    "The licensing board will meet on Tuesday to discuss fishing licences.",
    "Human rights and civil rights were reserved for the last chapter.",
    "A television licence costs more than it did ten years ago.",
    "Without a warrant the officers could not enter the house.",
    "The court held that the copyright claim had no merit.",
    "Poetic licence allows the author to change the order of events.",
    "The weather was fine and the children played in the garden until dark.",
    "Public transport in the city is free of charge on weekends.",
)

_WORD = re.compile(r"[a-z0-9]+")
#: The same split in the engine: what is no letter or digit separates words.
_SEPARATORS = "[^a-z0-9]+"
_SENTENCE = r"(?<=[.!?])\s+"


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _features(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


def _place(feature: str) -> int:
    h = xxhash.xxh64(feature.encode(), seed=42).intdigest()
    return (h - (1 << 64) if h >> 63 else h) % WIDTH


def _perturbed(rng: random.Random, text: str, noise: list[str]) -> list[str]:
    words = _words(text)
    words = [w for w in words if rng.random() > 0.06] or words
    words = [rng.choice(noise) if rng.random() < 0.04 else w for w in words]
    if rng.random() < 0.2:
        words = [str(rng.randint(1990, 2030)) if w.isdigit() and len(w) == 4 else w for w in words]
    if len(words) > 14 and rng.random() < 0.3:
        a = rng.randint(0, len(words) - 12)
        words = words[a : a + rng.randint(10, len(words) - a)]
    if rng.random() < 0.25:
        words = [rng.choice(noise) for _ in range(rng.randint(1, 12))] + words
    if rng.random() < 0.25:
        words += [rng.choice(noise) for _ in range(rng.randint(1, 12))]
    return words


class Model:
    """Weights, bias, temperature and threshold of the classes (``unknown`` first)."""

    def __init__(self, copies: int = 40, seed: int = 5, penalty: float = 2e-4):
        rng = random.Random(seed)
        self.classes = [UNKNOWN, *sorted(TEMPLATES)]
        syllables = "an be con da el for ga hi in jo ka lo mer nu or per qui ra sta ti un ver".split()
        noise = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(4000)] + "the of and to in a is that it was for on are as with they at be this from or by not".split() * 20
        rows, labels = [], []
        for c, name in enumerate(self.classes):
            for text in TEMPLATES.get(name, UNRELATED):
                for _ in range(copies):
                    rows.append(_perturbed(rng, text, noise))
                    labels.append(c)
        anchors = "license licence licensed copyright rights reserved warranty permission public domain redistribution under version".split()
        for _ in range(40 * copies):
            n = rng.randint(2, 60)
            rows.append([rng.choice(anchors) if rng.random() < 0.06 else rng.choice(noise) for _ in range(n)])
            labels.append(0)
        y = np.array(labels)
        places = [np.unique([_place(f) for f in _features(r)]) for r in rows]
        held = np.array([rng.random() < 0.25 for _ in rows])
        self.weights, self.bias = self._fit([p for p, h in zip(places, held, strict=True) if not h], y[~held], penalty)
        self._calibrate([p for p, h in zip(places, held, strict=True) if h], y[held])

    def _logits(self, places: list[np.ndarray]) -> np.ndarray:
        return np.array([self.bias + self.weights[p].sum(0) / np.sqrt(max(1, len(p))) for p in places])

    def _fit(self, places: list[np.ndarray], y: np.ndarray, penalty: float, steps: int = 150) -> tuple[np.ndarray, np.ndarray]:
        """Accelerated proximal gradient steps on the multinomial loss with an L1 penalty."""
        n, c = len(places), len(self.classes)
        row = np.repeat(np.arange(n), [len(p) for p in places])
        col = np.concatenate(places)
        val = np.repeat([1 / np.sqrt(max(1, len(p))) for p in places], [len(p) for p in places])
        target = np.eye(c)[y]
        w, b = np.zeros((WIDTH, c)), np.zeros(c)
        v, vb, t, rate = w.copy(), b.copy(), 1.0, 4.0
        by_row = np.concatenate([[0], np.cumsum([len(p) for p in places])])[:-1]
        order = np.argsort(col, kind="stable")
        used, by_col = np.unique(col[order], return_index=True)
        for _ in range(steps):
            z = np.add.reduceat(v[col] * val[:, None], by_row, axis=0) + vb
            p = np.exp(z - z.max(1, keepdims=True))
            gap = (p / p.sum(1, keepdims=True) - target) / n
            grad = np.zeros_like(w)
            grad[used] = np.add.reduceat((gap[row] * val[:, None])[order], by_col, axis=0)
            w2 = v - rate * grad
            w2 = np.sign(w2) * np.maximum(0, np.abs(w2) - rate * penalty)
            b2 = vb - rate * gap.sum(0)
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            v, vb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
            w, b, t = w2, b2, t2
        return w, b

    def _calibrate(self, places: list[np.ndarray], y: np.ndarray) -> None:
        z = self._logits(places)
        best = None
        for heat in np.geomspace(0.2, 3, 30):
            p = z / heat
            p = p - p.max(1, keepdims=True)
            loss = float(np.mean(np.log(np.exp(p).sum(1)) - p[np.arange(len(y)), y]))
            if best is None or loss < best[0]:
                best = (loss, float(heat))
        self.heat = best[1]
        p = np.exp(z / self.heat - (z / self.heat).max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        top, sure = p[:, 1:].argmax(1) + 1, p[:, 1:].max(1)
        cuts = np.linspace(0.2, 0.9, 36)
        right = [np.mean(np.where(sure >= x, top, 0) == y) for x in cuts]
        self.threshold = float(cuts[int(np.argmax(right))])
        self.accuracy = float(max(right))


@lru_cache(maxsize=1)
def trained() -> Model:
    return Model()


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it occurs there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _neighbours(words: Column) -> Column:
    """Neighbouring words; none for fewer than two."""
    rest = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), rest), F.slice(words, F.lit(2), rest), lambda a, b: F.concat_ws(" ", a, b))


def _pairs(words: Column) -> Column:
    return F.array_distinct(_neighbours(words))


def _template_pairs() -> list[list[str]]:
    return [sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}) for texts in TEMPLATES.values() for w in map(_words, texts)]


def _key_pairs() -> set[str]:
    """So many pairs of each template, the longest ones, that a text with ``CONFIRM`` of the template's pairs cannot lack them all."""
    keys: set[str] = set()
    for pairs in _template_pairs():
        lacking = max(k for k in range(len(pairs)) if len(pairs) - k >= CONFIRM * len(pairs))
        keys.update(sorted(pairs, key=lambda x: (-len(x), x))[: lacking + 1])
    return keys


def _split(p: Column) -> Column:
    return F.filter(F.split(p, _SEPARATORS), lambda w: w != "")


def _candidate(p: Column) -> Column:
    """Whether some template could confirm a folded paragraph: true wherever ``_classified`` could say so."""
    known, keys = sorted({x for t in _template_pairs() for x in t}), sorted(_key_pairs())

    def own(pairs: Column, hits: Column) -> Column:
        return (F.size(hits) >= 4) & _let(F.size(F.array_distinct(hits)), lambda n: (n >= 4) & (n >= F.lit(CONFIRM) * F.size(F.array_distinct(pairs))))

    def enough(pairs: Column) -> Column:
        return _let(F.filter(pairs, lambda x: x.isin(known)), lambda hits: F.exists(hits, lambda x: x.isin(keys)) | own(pairs, hits))

    return _let(_split(p), lambda w: _let(_neighbours(w), enough))


def _literal(value, kind: str) -> Column:
    """A constant of nested arrays, folded by the optimiser."""
    return F.from_json(F.lit(json.dumps({"x": value})), f"x {kind}")["x"]


def _classified(model: Model) -> Callable[[Column], Column]:
    """From a folded paragraph to struct(family, score, confirmed)."""
    n = len(model.classes)
    weights = _literal([round(float(x), 6) for x in (model.weights / model.heat).ravel()], "array<double>")
    bias = _literal([float(x) for x in model.bias / model.heat], "array<double>")
    names = _literal(model.classes, "array<string>")
    templates = _literal([[]] + [[sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}) for w in map(_words, TEMPLATES[c])] for c in model.classes[1:]], "array<array<array<string>>>")
    classes = F.sequence(F.lit(0), F.lit(n - 1))

    def logits(at: Column) -> Column:
        scale = F.sqrt(F.greatest(F.size(at), F.lit(1)).cast("double"))
        return F.transform(classes, lambda c: F.get(bias, c) + F.aggregate(at, F.lit(0.0), lambda a, k: a + F.get(weights, k * n + c)) / scale)

    def decided(z: Column) -> Column:
        top, known = F.array_max(z), F.array_max(F.slice(z, 2, n - 1))
        return F.struct((F.array_position(F.slice(z, 2, n - 1), known)).cast("int").alias("c"), (F.exp(known - top) / F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - top))).alias("score"))

    def confirmed(pairs: Column, c: Column) -> Column:
        def fits(t: Column) -> Column:
            return _let(F.size(F.array_intersect(pairs, t)), lambda own: (own >= F.lit(CONFIRM) * F.size(t)) | ((own >= 4) & (own >= F.lit(CONFIRM) * F.size(pairs))))

        return F.exists(F.get(templates, c), fits)

    def judged(pairs: Column, d: Column) -> Column:
        known = d["score"] >= model.threshold
        return F.struct(F.when(known, F.get(names, d["c"])).otherwise(F.lit(UNKNOWN)).alias("family"), d["score"].alias("score"), (known & confirmed(pairs, d["c"])).alias("confirmed"))

    def of(p: Column) -> Column:
        places = lambda w, pairs: F.array_distinct(F.transform(F.array_union(F.array_distinct(w), pairs), lambda f: F.pmod(F.xxhash64(f), F.lit(WIDTH)).cast("int")))
        return _let(_split(p), lambda w: _let(_pairs(w), lambda pairs: _let(logits(places(w, pairs)), lambda z: _let(decided(z), lambda d: judged(pairs, d)))))

    return of


def scan_paragraphs(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per candidate paragraph: doc_id, paragraph (number), family, score, confirmed."""
    low = F.lower(F.col("text").cast("string"))
    pieces = F.flatten(F.transform(F.split(low, "\n"), lambda x: F.when(F.length(x) > LONG, F.split(x, _SENTENCE)).otherwise(F.array(x))))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(pieces).alias("paragraph", "p")).where(_candidate(F.col("p")))
    return found.select("doc_id", "paragraph", _classified(model or trained())(F.col("p")).alias("x")).select("doc_id", "paragraph", "x.*")


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per document with a confirmed licence: doc_id, licence (best score), score, n_paragraphs (confirmed), families."""
    hits = scan_paragraphs(docs, model).where("confirmed")
    best = F.min(F.struct((-F.col("score")).alias("s"), "paragraph", "family"))
    each = hits.groupBy("doc_id").agg(best.alias("b"), F.count_distinct("paragraph").alias("n_paragraphs"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"))
    return each.select("doc_id", F.col("b.family").alias("licence"), (-F.col("b.s")).alias("score"), F.col("n_paragraphs").cast("long").alias("n_paragraphs"), "families")


def digest(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Every document with its licence, or null where none was confirmed."""
    found = scan(docs, model).withColumnRenamed("doc_id", "_id")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    joined = ids.join(found, ids["doc_id"].eqNullSafe(found["_id"]), "left")
    return joined.select("doc_id", "licence", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("n_paragraphs", F.lit(0).cast("long")).alias("n_paragraphs"), F.coalesce("families", F.lit("")).alias("families"))
