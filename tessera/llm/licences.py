"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

Texts fall into paragraphs (lines with a word, joined up to a line without one, so that wrapped text is whole). What
is scored are the lines of a paragraph and overlapping windows of its words, of lengths that hold any clause. Hashed
one- and two-word features go into a sparse logistic regression with one class for each licence family and one for
unknown text. It is trained on the driver from the templates
below, cut and distorted with a fixed seed, against a bounded hash sample of corpus lines as the unknown class
(``Settings.unknown`` documents). On a held-out quarter of the samples a temperature is chosen that makes probabilities
most likely, and then the threshold on the families' summed probability that at most ``Settings.false_share`` of the
unknown lines reach; what is below it is unknown. What passes is compared with every family, both ways: in one stretch
of the line or window, at least half of whose word pairs are the clause's, ``Settings.cover`` of the pairs of one clause
must occur, and half of those that no other family's clauses have, so that a licence does not confirm its near
relations. Look-alikes (Affero, NonCommercial-ShareAlike, NoDerivatives) are families of their own. A line or window
that says that something is not released, licensed or distributed confirms nothing.

Executors get the weights (buckets x classes, a fixed size) and the clauses' word pairs, and scan whole texts in Arrow
batches.

Defined cases: null is the empty text, which has no paragraphs; a text without licences has empty lists and zeros;
repeated rows are scanned one by one; other columns do not matter; an empty table gives no rows, and its unknown
class is learned from nothing but distorted words; of several texts of one id the smallest may be learned from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import wordbytes as wb

#: Sentences of public licences and of the notes that name them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "bsd": (
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "isc": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "Licensed under the Eclipse Public License, version 2.0.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-nc-sa": (
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ),
    "cc-by-nd": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has dedicated all copyright and related rights to this work to the public domain worldwide under CC0 1.0.",
    ),
}
FAMILIES = tuple(TEMPLATES)
UNKNOWN = len(FAMILIES)
#: Words of a window and steps between windows; the longest clause has under 49 words.
WINDOWS = ((16, 4), (32, 8), (64, 16))
#: Bytes up to the next blank that can belong to a span's first or last word.
JOINED = 40
WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


@dataclass(frozen=True)
class Settings:
    """unknown: documents whose paragraphs stand for unknown text, at most; copies: distorted copies of each clause; batch: samples of a gradient step."""

    unknown: int = 400
    copies: int = 30
    buckets: int = 1 << 14
    epochs: int = 12
    batch: int = 32
    rate: float = 0.5
    decay: float = 1e-5
    false_share: float = 0.002
    cover: float = 0.7
    seed: int = 3


def word_pairs(text: str) -> list[tuple[str, str]]:
    words = WORD.findall(text.lower())
    return list(zip(words[:-1], words[1:], strict=True)) if len(words) > 1 else [(w, "") for w in words]


def pairs_of(text: str) -> frozenset[tuple[str, str]]:
    return frozenset(word_pairs(text))


CLAUSES = {f: [pairs_of(c) for c in clauses] for f, clauses in TEMPLATES.items()}
#: Of each clause the word pairs that no other family has.
OWN = {f: [c.difference(*(x for g in CLAUSES if g != f for x in CLAUSES[g])) for c in clauses] for f, clauses in CLAUSES.items()}

#: Words which, after a "not", say that a licence does not hold; what clauses say themselves is no denial.
DENIED = frozenset((no, w) for no in ("not", "never", "longer") for w in ("released", "licensed", "covered", "distributed", "available", "published", "offered", "under"))
DENIED = DENIED.difference(*(c for clauses in CLAUSES.values() for c in clauses))

#: Letters and digits keep their value in lower case; everything else separates words.
FOLD = np.full(256, 32, np.uint8)
for _b in (*range(48, 58), *range(97, 123), *range(128, 256)):
    FOLD[_b] = _b
for _b in range(65, 91):
    FOLD[_b] = _b + 32
FOLD[10] = 10


class Paragraphs:
    """The paragraphs and the lines with a word of some documents, with hashed features of their words and word pairs."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, buckets: int):
        c = wb.Chunk(FOLD[data], offsets)
        cuts = np.union1d(c.offsets[:-1], np.flatnonzero(c.data == 10) + 1)
        cuts = cuts[cuts < len(c.data)]
        ends = np.append(cuts[1:], len(c.data)) if len(cuts) else cuts
        first, last = np.searchsorted(c.starts, cuts), np.searchsorted(c.starts, ends)
        full = last > first
        #: words of line i are line_first[i] to line_last[i]
        self.line_first, self.line_last = first[full], last[full]
        doc = np.searchsorted(c.offsets, cuts[full], "right") - 1
        at = np.flatnonzero(full)
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (np.diff(doc) > 0)
        head = np.flatnonzero(new)
        self.first = self.line_first[head]
        self.last = np.append(self.first[1:], len(c.starts)) if len(head) else self.first
        self.starts, self.doc = cuts[full][head], doc[head]
        self.word_starts, self.word_ends = c.starts, c.ends
        words = c.word_hashes()
        mask = np.uint64(buckets - 1)
        self.words = (words & mask).astype(np.int64)
        two = wb.runs(words, 2)
        self.pairs = np.append((two & mask).astype(np.int64), 0)[: len(words)]

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last word, and paragraph, of all lines and windows; a paragraph's last window ends where it ends."""
        first, last = [self.line_first], [self.line_last]
        size = self.last - self.first
        for length, step in WINDOWS:
            n = 1 + np.maximum(0, -(-(size - length) // step))
            of = np.repeat(np.arange(len(size)), n)
            k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            a = self.first[of] + np.minimum(k * step, np.maximum(0, size[of] - length))
            first.append(a)
            last.append(np.minimum(a + length, self.last[of]))
        # one number for each span, as its first word says its paragraph
        a, b = np.divmod(np.unique(np.concatenate(first) * (len(self.words) + 1) + np.concatenate(last)), len(self.words) + 1)
        return a, b, np.searchsorted(self.first, a, "right") - 1

    def logits(self, weights: np.ndarray, bias: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Class scores of spans of words: weights summed over features, by the root of their number."""
        one, two = (np.zeros((len(self.words) + 1, len(bias))) for _ in range(2))
        np.cumsum(weights[self.words], axis=0, dtype=np.float64, out=one[1:])
        np.cumsum(weights[self.pairs], axis=0, dtype=np.float64, out=two[1:])
        total = one[last] - one[first] + two[last - 1] - two[first]
        return total / np.sqrt(2 * (last - first) - 1)[:, None] + bias

    def text(self, data: np.ndarray, first: int, last: int) -> str:
        """The bytes of a span. Parts of a hyphenated word are words of their own to the classifier; here it stays whole."""
        begin, end = self.word_starts[first], self.word_ends[last - 1]
        after = wb.BLANK[data[end : end + JOINED]]
        before = wb.BLANK[data[max(0, begin - JOINED) : begin]][::-1]
        end += int(after.argmax()) if after.any() else len(after)
        begin -= int(before.argmax()) if before.any() else len(before)
        return data[begin:end].tobytes().decode("utf-8", "replace")

    def features(self, i: int) -> np.ndarray:
        a, b = self.first[i], self.last[i]
        return np.concatenate([self.words[a:b], self.pairs[a : b - 1]])


def probabilities(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


@dataclass
class Model:
    weights: np.ndarray
    bias: np.ndarray
    threshold: float


def distorted(clause: str, rng: np.random.Generator, filler: list[str]) -> str:
    """A copy of a clause with words left out or changed, cut short, or with other words around it."""
    words = clause.split()
    if len(words) > 14 and rng.random() < 0.5:
        n = int(rng.integers(10, len(words)))
        at = int(rng.integers(0, len(words) - n + 1))
        words = words[at : at + n]
    out = [w for w in words if rng.random() > 0.06]
    some = lambda n: [filler[i] for i in rng.integers(0, len(filler), n)]
    if rng.random() < 0.4:
        out = some(int(rng.integers(1, 12))) + out
    if rng.random() < 0.4:
        out += some(int(rng.integers(1, 12)))
    return " ".join(out)


def no_clause(text: str, cover: float) -> bool:
    """Whether the text has less than ``cover`` of the word pairs of every clause."""
    own = pairs_of(text)
    return all(len(own & c) < cover * len(c) for clauses in CLAUSES.values() for c in clauses)


def learned(lines: list[str], s: Settings) -> Model:
    """Fits the regression on distorted clauses and the given unknown lines, and sets the threshold."""
    rng = np.random.default_rng(s.seed)
    lines = [x for x in lines if no_clause(x, s.cover)]
    filler = sorted({w for x in lines for w in x.split()}) or ["lorem", "ipsum", "dolor", "sit", "amet"]
    cases = [(distorted(c, rng, filler), k) for k, f in enumerate(FAMILIES) for c in TEMPLATES[f] for _ in range(s.copies)]
    # words of the clauses in any order, and filler, are unknown too
    bags = [np.array(w, object) for w in ([w for clauses in TEMPLATES.values() for c in clauses for w in c.split()], filler, filler)]
    cases += [(" ".join(rng.choice(bags[k % 3], int(rng.integers(3, 40)))), UNKNOWN) for k in range(600)]
    cases += [(x, UNKNOWN) for x in lines]
    texts = pa.array([t.replace("\n", " ") or "x" for t, _ in cases])
    data, offsets = wb.text_bytes(texts)
    p = Paragraphs(data, offsets, s.buckets)
    label = np.array([k for _, k in cases])[p.doc]
    n = len(label)
    test = rng.random(n) < 0.25
    weights = np.zeros((s.buckets, UNKNOWN + 1), np.float32)
    bias = np.zeros(UNKNOWN + 1, np.float32)
    train = np.flatnonzero(~test)
    found = {i: p.features(i) for i in train.tolist()}
    for epoch in range(s.epochs):
        rate = s.rate * (1 - epoch / s.epochs)
        order = rng.permutation(train).tolist()
        for batch in (order[k : k + s.batch] for k in range(0, len(order), s.batch)):
            sizes = np.array([len(found[i]) for i in batch])
            flat, scale = np.concatenate([found[i] for i in batch]), (1 / np.sqrt(sizes))[:, None].astype(np.float32)
            g = probabilities(np.add.reduceat(weights[flat], np.cumsum(sizes) - sizes, axis=0) * scale + bias)
            g[np.arange(len(batch)), label[batch]] -= 1
            # the batch's gradient, summed once for each different feature
            by_feature = np.argsort(flat, kind="stable")
            own, first = np.unique(flat[by_feature], return_index=True)
            weights[own] -= rate * np.add.reduceat(np.repeat(g * scale, sizes, axis=0)[by_feature], first, axis=0)
            bias -= rate * 0.1 * g.sum(axis=0)
        weights *= 1 - s.decay * len(train)
    held, truth = p.logits(weights, bias, p.first, p.last)[test], label[test]
    scales = np.geomspace(0.25, 4, 41)
    scale = float(scales[np.argmax([np.log(probabilities(held * x)[np.arange(len(truth)), truth] + 1e-12).sum() for x in scales])]) if len(truth) else 1.0
    # calibrated logits: the temperature goes into the weights
    weights, bias, held = weights * np.float32(scale), bias * np.float32(scale), held * scale
    unknown = np.sort(1 - probabilities(held)[truth == UNKNOWN, UNKNOWN]) if len(truth) else np.zeros(0)
    threshold = float(np.nextafter(unknown[int((1 - s.false_share) * (len(unknown) - 1))], 1)) if len(unknown) else 0.5
    return Model(weights, bias, threshold)


def fit(docs: DataFrame, s: Settings = Settings(), key: str = "doc_id", text: str = "text") -> Model:
    """Learns the unknown class from the lines of paragraphs without a clause, of at most ``s.unknown`` documents of the corpus."""
    ids = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(s.unknown)
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(ids), "id")
    rows = rows.groupBy("id").agg(F.min("text").alias("text"))
    texts = sorted(r["text"] or "" for r in rows.select("text").collect())
    paragraphs = [x for t in texts for x in re.split(r"\n(?:[^\w\n]*\n)+", t) if no_clause(x, s.cover)]
    return learned([x for t in paragraphs for x in t.split("\n") if x.strip()], s)


def confirmed(text: str, family: str, cover: float) -> float:
    """The largest share of a clause's word pairs in a stretch of the text that is made of them; 0 below ``cover``."""
    return confirmed_families(text, cover).get(family, 0.0)


def confirmed_families(text: str, cover: float) -> dict[str, float]:
    """The families that the text confirms, with the share of each."""
    pairs = word_pairs(text)
    own, found = frozenset(pairs), {}
    if not DENIED.isdisjoint(own):
        return found
    for family in FAMILIES:
        best = 0.0
        for c, apart in zip(CLAUSES[family], OWN[family], strict=True):
            if len(own & c) >= max(cover, best) * len(c) and 2 * len(own & apart) >= len(apart):
                inside = frozenset(stretch(pairs, c))
                share = len(inside) / len(c)
                if share >= cover and 2 * len(inside & apart) >= len(apart):
                    best = max(best, share)
        if best:
            found[family] = best
    return found


def stretch(pairs: list[tuple[str, str]], clause: frozenset[tuple[str, str]]) -> set[tuple[str, str]]:
    """The clause's pairs in the run of pairs where those of the clause outweigh the others most."""
    best = score = start = 0
    span = (0, 0)
    for i, p in enumerate(pairs):
        score += 1 if p in clause else -1
        if score <= 0:
            score, start = 0, i + 1
        elif score > best:
            best, span = score, (start, i + 1)
    return {p for p in pairs[slice(*span)] if p in clause}


FINDINGS = "n_paragraphs long, n_predicted long, n_confirmed long, families array<string>, best_family string, best_probability double, best_cover double"


def scanned(docs: DataFrame, model: Model, s: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and the FINDINGS of every row; families are the confirmed ones in order of name."""

    def scan(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple]:
        p = Paragraphs(data, offsets, s.buckets)
        n_paragraphs = np.bincount(p.doc, minlength=len(offsets) - 1).tolist()
        first, last, owner = p.spans()
        prob = probabilities(p.logits(model.weights, model.bias, first, last))
        predicted: dict[int, set[int]] = {}
        hits: dict[int, list[tuple[str, float, float, int]]] = {}
        for i in np.flatnonzero(1 - prob[:, UNKNOWN] >= model.threshold).tolist():
            text, d, at = p.text(data, first[i], last[i]), int(p.doc[owner[i]]), int(owner[i])
            predicted.setdefault(d, set()).add(at)
            for family, share in confirmed_families(text, s.cover).items():
                hits.setdefault(d, []).append((family, float(prob[i, FAMILIES.index(family)]), share, at))
        for d, n in enumerate(n_paragraphs):
            sure = hits.get(d, [])
            top = max(sure, key=lambda h: (h[2], h[1], h[0]), default=(None, 0.0, 0.0, 0))
            yield n, len(predicted.get(d, ())), len({h[3] for h in sure}), sorted({h[0] for h in sure}), *top[:3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.float64(), pa.float64()]
        for b in batches:
            data, offsets = wb.text_bytes(b.column(1))
            rows = [r for i, j in wb.chunks(offsets) for r in scan(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=[key, *(f.split()[0] for f in FINDINGS.split(", "))])

    rows = docs.select(F.col(key), F.col(text).cast("string"))
    return rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, {FINDINGS}")
