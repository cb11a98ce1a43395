"""Licence scan of paragraphs: a trained word n-gram classifier, a calibrated unknown class, template comparison.

Training rows are made from the templates (set among words of sampled paragraphs, some words lost) and from sampled
paragraphs as the unknown class; the sample is bounded by SAMPLE and chosen by hash, so it does not depend on order.
A multinomial logistic regression over sparse word 1- and 2-grams is fitted. Its temperature is calibrated on rows of
templates (one of each family that has several) and sampled paragraphs that a first fit has not seen; the second fit has
all rows. A paragraph is unknown where that class is the likeliest, or the families together are under MIN_PROBABILITY. A
prediction is confirmed when the paragraph holds enough of the five-word shingles of one of the family's templates.

A paragraph is a line, or a run of lines that are not confirmed alone, without a blank one between them, whose words are
mostly the templates' (a notice that is wrapped): these are joined. Comment marks are no words, so they do not matter.

Defined cases: null and empty texts have no paragraph with words; ties between families go to the first in name order;
repeated rows each give their rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

SHINGLE, SIMILARITY, MIN_PROBABILITY = 5, 0.8, 0.5
#: Paragraphs in the training sample at most, and words of each that are used.
SAMPLE, SAMPLE_WORDS = 2000, 120
UNKNOWN = "unknown"
#: Share of a line's words that are the templates' from which it may be part of a wrapped notice, and such words it has at least.
WRAPPED_SHARE, WRAPPED_WORDS = 0.6, 2
#: Notices and paragraphs of public licence texts by family.
TEMPLATES = {
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
        "Licensed under the GNU Affero General Public License, version 3.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
        "Released under the BSD 3-Clause License.",
    ],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Dedicated to the public domain under CC0 1.0."],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "Licensed under the GNU Lesser General Public License, version 3.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Released under the Mozilla Public License, version 2.0.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}
_word = re.compile(r"\w+")


def words_of(line: str) -> list[str]:
    return _word.findall(line.lower())


def _grams(words: list[str]) -> set:
    return {*words, *zip(words, words[1:])}


def _shingles(words: list[str]) -> set:
    n = min(SHINGLE, len(words))
    return set(zip(*(words[k:] for k in range(n)))) if n else set()


_SHINGLES = {family: [_shingles(words_of(t)) for t in texts] for family, texts in TEMPLATES.items()}


def similarity(words: list[str], family: str) -> float:
    """The largest share of a template's shingles that the paragraph holds."""
    found = {n: set(zip(*(words[k:] for k in range(n)))) for n in {len(next(iter(t))) for t in _SHINGLES[family]}}
    return max(len(t & found[len(next(iter(t)))]) / len(t) for t in _SHINGLES[family])


@dataclass
class Model:
    families: list[str]
    index: dict
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def probabilities(self, words: list[str]) -> np.ndarray:
        at = [i for g in _grams(words) if (i := self.index.get(g)) is not None]
        logits = (self.weights[at].sum(0) if at else 0) / np.sqrt(max(len(at), 1)) + self.bias
        e = np.exp((logits - logits.max()) / self.temperature)
        return e / e.sum()


def sample_paragraphs(docs: DataFrame, bound: int = SAMPLE) -> list[str]:
    """One line of each of at most `bound` different texts, those with the smallest hashes.

    The number of rows sets a hash limit under which about twice the bound are expected, so tasks send only those.
    """
    share = min(1.0, 2 * bound / max(docs.count(), 1))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    h = F.xxhash64("text")
    near = docs.select("text", h.alias("h"), F.pmod(h, F.lit(1 << 32)).alias("rank")).where(F.col("rank") < int(share * (1 << 32)))
    picked = near.select("h", "rank", F.element_at(lines, (F.pmod("h", F.size(lines)) + 1).cast("int")).alias("line"))
    picked = picked.select("h", "rank", F.array_join(F.slice(F.split("line", " "), 1, SAMPLE_WORDS), " ").alias("line")).groupBy("h", "rank").agg(F.min("line").alias("line"))
    return [r["line"] for r in picked.orderBy("rank", "h").limit(bound).collect()]


def training_rows(sample: list[str], seed: int = 7, copies: int = 24) -> list[tuple[list[str], str, int]]:
    """Labelled rows (words, family, template number): each template among other words and with words lost, sampled paragraphs as unknown."""
    rng, rows, number = np.random.default_rng(seed), [], 0
    known = [w for w in map(words_of, sample) if w and not any(similarity(w, f) >= 0.5 for f in TEMPLATES)]
    for family in sorted(TEMPLATES):
        for text in TEMPLATES[family]:
            number += 1
            for k in range(copies):
                words = words_of(text)
                if k % 4 == 3 and len(words) > 6:
                    words = [w for w in words if rng.random() > 0.1]
                around = known[rng.integers(len(known))] if known and k % 2 else []
                at = rng.integers(len(around) + 1)
                rows.append(([*around[:at], *words, *around[at:]], family, number))
    return rows + [(w, UNKNOWN, -1 - k) for k, w in enumerate(known)]


class Sparse:
    """Rows of grams as positions and values, in row order; products with dense weights, and their transposes."""

    def __init__(self, rows: list[list[str]], index: dict):
        found = [sorted(i for g in _grams(words) if (i := index.get(g)) is not None) for words in rows]
        self.sizes = np.array([len(f) for f in found], np.int64)
        self.columns = np.array([i for f in found for i in f], np.int64)
        self.rows = np.repeat(np.arange(len(rows)), self.sizes)
        self.values = (1 / np.sqrt(np.maximum(self.sizes, 1)))[self.rows]
        self.order = np.argsort(self.columns, kind="stable")
        self.width = len(index)

    @staticmethod
    def _sums(parts: np.ndarray, into: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, parts.shape[1]))
        if len(parts):
            first = np.flatnonzero(np.diff(into, prepend=-1))
            out[into[first]] = np.add.reduceat(parts, first)
        return out

    def times(self, weights: np.ndarray) -> np.ndarray:
        return self._sums(weights[self.columns] * self.values[:, None], self.rows, len(self.sizes))

    def transposed_times(self, dense: np.ndarray) -> np.ndarray:
        by = self.order
        return self._sums(dense[self.rows[by]] * self.values[by, None], self.columns[by], self.width)


def _regression(rows: list, families: list[str], index: dict, steps: int, rate: float, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression, each class of equal weight, by gradient steps with momentum."""
    x, y = Sparse([r[0] for r in rows], index), np.array([families.index(r[1]) for r in rows], np.int64)
    weight = (1 / np.maximum(np.bincount(y, minlength=len(families)), 1))[y]
    weight = weight / max(weight.sum(), 1e-9)
    w, b, target = np.zeros((len(index), len(families))), np.zeros(len(families)), np.eye(len(families))[y]
    speed_w, speed_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        g = (_softmax(x.times(w) + b) - target) * weight[:, None]
        speed_w = 0.9 * speed_w - rate * (x.transposed_times(g) + decay * w)
        speed_b = 0.9 * speed_b - rate * g.sum(0)
        w, b = w + speed_w, b + speed_b
    return w, b


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def held_out(rows: list[tuple[list[str], str, int]]) -> np.ndarray:
    """Which rows are for calibration: those of the last template of each family with several, and every fifth unknown one."""
    of: dict[str, set[int]] = {}
    for _, family, number in rows:
        of.setdefault(family, set()).add(number)
    last = {max(numbers) for family, numbers in of.items() if family != UNKNOWN and len(numbers) > 1}
    return np.array([number in last or number < 0 and number % 5 == 4 for _, _, number in rows], bool)


def fit(rows: list[tuple[list[str], str, int]], steps: int = 200, rate: float = 2.0, decay: float = 1e-4) -> Model:
    """Fits without the held-out rows, finds the temperature that tells unknown ones from others best on these, and fits again with all rows."""
    families = [UNKNOWN, *sorted(TEMPLATES)]
    index = {g: k for k, g in enumerate(sorted({g for texts in TEMPLATES.values() for t in texts for g in _grams(words_of(t))}, key=str))}
    held = held_out(rows)
    first = _regression([r for r, h in zip(rows, held) if not h], families, index, steps, rate, decay)
    seen = [r for r, h in zip(rows, held) if h]
    z = Sparse([r[0] for r in seen], index).times(first[0]) + first[1]
    y = np.array([families.index(r[1]) for r in seen], np.int64)

    def loss(t: float) -> float:
        unknown = np.clip(_softmax(z / t)[:, 0], 1e-12, 1 - 1e-12)
        return float(-np.log(np.where(y == 0, unknown, 1 - unknown)).mean())

    low, high = math.log(0.05), math.log(20.0)
    while len(y) and high - low > 1e-3:
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if loss(math.exp(a)) < loss(math.exp(b)) else (a, high)
    w, b = _regression(rows, families, index, steps, rate, decay)
    return Model(families, index, w, b, math.exp((low + high) / 2) if len(y) else 1.0)


def paragraphs_of(text: str, vocabulary: set[str]) -> Iterator[list[tuple[int, list[str]]]]:
    """Lines (number, words) that have a word of the vocabulary: alone, or together where they may be parts of a wrapped notice."""
    run: list[tuple[int, list[str]]] = []
    for pos, line in enumerate(text.split("\n")):
        words = words_of(line)
        n = sum(w in vocabulary for w in words)
        if n >= WRAPPED_WORDS and n >= WRAPPED_SHARE * len(words):
            run.append((pos, words))
            continue
        if run:
            yield run
            run = []
        if n:
            yield [(pos, words)]
    if run:
        yield run


def notices(lines: list[tuple[int, list[str]]], model: Model, min_probability: float, least: float) -> Iterator[tuple]:
    """(pos, family, probability, similarity, confirmed): lines that are confirmed alone, and the lines between them joined."""

    def judged(words: list[str]) -> tuple | None:
        p = model.probabilities(words)
        k = int(p.argmax())
        if not k or 1 - p[0] < min_probability:
            return None
        s = similarity(words, model.families[k])
        return model.families[k], round(float(p[k]), 4), round(s, 4), s >= least

    rest: list[tuple[int, list[str]]] = []
    for pos, words in [*lines, (-1, [])]:
        alone = judged(words) if words else None
        if pos >= 0 and not (alone and alone[3]):
            rest.append((pos, words))
            continue
        if rest and (found := judged([w for _, line in rest for w in line])):
            yield rest[0][0], *found
        rest = []
        if alone:
            yield pos, *alone


def scan(docs: DataFrame, model: Model, min_probability: float = MIN_PROBABILITY, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, pos, family, probability, similarity, confirmed) of the paragraphs that are predicted to be of a family; pos is the first line's number."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size is that of the templates' n-grams

    def make(c: dict[str, list]) -> dict[str, list]:
        out, model = [], sent.value
        alone = {g for g in model.index if isinstance(g, str)}
        for doc_id, text in zip(c["doc_id"], c["text"]):
            for lines in paragraphs_of(text or "", alone):
                out += [(doc_id, *found) for found in notices(lines, model, min_probability, least)]
        return dict(zip(("doc_id", "pos", "family", "probability", "similarity", "confirmed"), zip(*out) if out else [[]] * 6))

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, pos int, family string, probability double, similarity double, confirmed boolean")


def licence_scan(docs: DataFrame) -> DataFrame:
    """Fits on the bounded sample and scans every line of every document."""
    return scan(docs, fit(training_rows(sample_paragraphs(docs))))
