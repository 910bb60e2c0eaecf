"""License scans: paragraphs to licence families by logistic regression over sparse word n-grams, confirmed by templates.

A paragraph is a run of up to eight lines between blank ones (very long lines count by sentences), so that notices are
found on one line or wrapped over several, behind comment marks or not. Every run of lines of every text is scored: a run's
weights are the sums of its lines', so that costs little more than scoring the lines. What the model, calibrated on families
that it was not trained on, gives to a family is compared with the family's templates before it counts.
"""

from __future__ import annotations

import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, mix

# Notices of each family, as they stand in files; {y} and {n} are a year and a name.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Apache License Version 2.0, January 2004",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "The MIT License (MIT) Copyright (c) {y} {n}",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, version 2.1.",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
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
    "cc0": ("To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"),
    "proprietary": (
        "All rights reserved.",
        "Copyright (c) {y} {n}. All rights reserved.",
        "No part of this publication may be reproduced or transmitted in any form without prior written permission.",
    ),
}
NAMES = tuple(sorted(TEMPLATES))
UNKNOWN = "unknown"
# Ordinary sentences with words of licences.
ORDINARY = (
    "I lost my driving licence on the way home.",
    "The licence fee was paid last year.",
    "Copyright is a legal term that courts have defined.",
    "All rights belong to those who fight for them.",
    "Permission to land was granted by the tower.",
    "The software works without warranty cards.",
    "She reserved all the rooms of the public house.",
    "The university has a license for this program and its source code.",
    "Modification of the terms needs a general agreement of both.",
    "The foundation published a library of free books under its own name.",
)

#: Hashed word 1-, 2- and 3-grams.
SLOTS = 1 << 15
#: Lines of a paragraph; a line of more than LONG characters counts by its sentences.
RUNS, LONG = (1, 2, 3, 4, 6, 8), 400
#: Words that are summed at once.
AT_ONCE = 100_000
#: What trains the unknown class: paragraphs of up to NEGATIVE_WORDS words from about NEGATIVE_DOCS whole documents (a share by hash), NEGATIVES of them at most.
NEGATIVE_DOCS, NEGATIVES, NEGATIVE_WORDS = 2_000, 4_000, 120
COPIES, EPOCHS, BATCH, RATE, DECAY, SEED = 60, 12, 128, 0.3, 1e-5, 7
#: Families are held out in so many turns to calibrate what the model says of those it doesn't know.
TURNS = 3
#: Least share of a template's bigrams in a paragraph (or the reverse) that confirms a prediction.
ALIKE = 0.5

_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
_LINE = re.compile(r"[^\n]*\n?")
_SENTENCE = re.compile(r"(?s).+?(?:[.!?](?=\s)|\Z)")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


class _Hashes(dict):
    """Word to its 64-bit hash, remembered for a while."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        data = word.encode()
        out = self[word] = zlib.crc32(data) << 32 | zlib.crc32(data, 0x5BD1E995)
        return out


_HASHES = _Hashes()


def slots(w: list[str], block: np.ndarray | None = None) -> np.ndarray:
    """Rows of three: the slots of the 1-, 2- and 3-gram that begin at each word; SLOTS stands for none. Grams stay in one block."""
    h = np.fromiter(map(_HASHES.__getitem__, w), np.uint64, len(w))
    out = np.full((len(w), 3), SLOTS, np.int32)
    for k in range(3):
        if len(w) > k:
            run = h[: len(h) - k]
            for j in range(1, k + 1):
                run = mix(run + _STEP) + h[j : len(h) - k + j]
            at = mix(run + np.uint64(k)) % np.uint64(SLOTS)
            out[: len(run), k] = at if block is None else np.where(block[: len(run)] == block[k:], at, SLOTS)
    return out


def _bigrams(w: list[str]) -> set:
    return set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)}


_SHAPES = {f: [_bigrams(words(t.format(y="", n=""))) for t in ts] for f, ts in TEMPLATES.items()}


def likeness(w: list[str], family: str) -> float:
    """How much of a template of the family the words hold, at best; of long ones, how much of the words one holds, which counts a little less."""
    own = _bigrams(w)
    return max(max(len(own & s) / len(s), 0.9 * len(own & s) / len(own) if len(own) >= 12 else 0) for s in _SHAPES[family])


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


@dataclass
class Model:
    """Weights (SLOTS x families and unknown, and a row of zeros), biases, and what calibrates them: the temperature of the softmax and the least probability."""

    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    sure: float = 0.6

    def sums(self, at: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights and numbers of grams of the pieces that begin at starts, each with a word at least."""
        total, n = np.zeros((len(starts), len(self.bias))), np.add.reduceat((at < SLOTS).sum(1), starts)
        for i in range(0, len(at), AT_ONCE):
            j = min(i + AT_ONCE, len(at))
            a, b = np.searchsorted(starts, i, "right") - 1, np.searchsorted(starts, j)
            total[a:b] += np.add.reduceat(self.weights[at[i:j]].sum(1), np.maximum(starts[a:b] - i, 0))
        return total, n

    def probabilities(self, total: np.ndarray, n: np.ndarray) -> np.ndarray:
        return _softmax((self.bias + total / np.sqrt(np.maximum(n, 1))[:, None]) / self.temperature)

    def judge(self, paragraph: str) -> tuple[str, float, float]:
        """(family or unknown, calibrated probability, likeness to its templates)."""
        w = words(paragraph)
        if not w:
            return UNKNOWN, 1.0, 0.0
        p = self.probabilities(*self.sums(slots(w), np.zeros(1, int)))[0]
        k = int(p.argmax())
        if k == len(NAMES):
            return UNKNOWN, float(p[k]), 0.0
        alike = likeness(w, NAMES[k])
        return (NAMES[k] if p[k] >= self.sure and alike >= ALIKE else UNKNOWN), float(p[k]), alike

    def paragraphs(self, text: str) -> list[tuple[str, int, int]]:
        """(family or unknown, start, end) of the text's licensed paragraphs and of those that speak of a licence but that no family explains, in order.

        Of runs of lines that overlap the one most like its template counts, then the shortest.
        """
        lines = [(a, b, k) for k, block in enumerate(blocks(text)) for a, b in block]
        if not lines:
            return []
        w = [words(text[a:b]) for a, b, _ in lines]
        block, size = np.array([k for _, _, k in lines]), [len(x) for x in w]
        total, n = self.sums(slots([x for line in w for x in line], np.repeat(block, size)), np.concatenate([[0], np.cumsum(size)[:-1]]))
        total, n = np.vstack([np.zeros((1, total.shape[1])), np.cumsum(total, 0)]), np.concatenate([[0], np.cumsum(n)])
        found = []
        for size in (x for x in RUNS if x <= len(lines)):
            whole = np.flatnonzero(block[size - 1 :] == block[: len(block) - size + 1])  # runs within a block, by their first line
            if not len(whole):
                continue
            p = self.probabilities(total[whole + size] - total[whole], n[whole + size] - n[whole])
            best = p.argmax(1)
            for j in np.flatnonzero(best < len(NAMES)).tolist():
                i, k = whole[j], best[j]
                alike = likeness([x for line in w[i : i + size] for x in line], NAMES[k]) if p[j, k] >= self.sure else 0.0
                found.append((alike >= ALIKE, alike, float(p[j, k]), -size, lines[i][0], lines[i + size - 1][1], NAMES[k]))
        out: list[tuple[str, int, int]] = []
        for ok, _, _, _, a, b, family in sorted(found, key=lambda x: (not x[0], *(-v for v in x[1:4]), x[4])):
            if all(b <= c or d <= a for _, c, d in out):
                out.append((family if ok else UNKNOWN, a, b))
        return sorted(out, key=lambda x: x[1:])


def blocks(text: str) -> list[list[tuple[int, int]]]:
    """Spans of the lines that hold words, by blocks between lines that hold none."""
    out: list[list] = [[]]
    for m in _LINE.finditer(text):
        a, b = m.span()
        parts = [(a, b)] if b - a <= LONG else [x.span() for x in _SENTENCE.finditer(text, a, b)]
        for a, b in parts:
            line = text[a:b]
            if _WORD.search(line.lower()):
                a, b = a + len(line) - len(line.lstrip()), b - len(line) + len(line.rstrip())
                out[-1].append((a, b))
            elif out[-1]:
                out.append([])
    return [x for x in out if x]


def _samples(negatives: list[str], families: list[int], rnd: random.Random, copies: int) -> tuple[list[list[str]], list[int]]:
    """Labelled paragraphs: the families' templates with words lost and prose around them; the corpus's own, ordinary sentences and templates cut to shreds as unknown."""
    prose = [w for n in negatives for w in words(n)] or ["the", "of", "and"]
    x, y = [], []
    for k in families:
        for t in TEMPLATES[NAMES[k]]:
            w = words(t.format(y=str(rnd.randrange(1990, 2030)), n=" ".join(rnd.choices(prose, k=2))))
            for c in range(copies):
                kept = [v for v in w if c < 5 or rnd.random() > 0.08]
                around = [rnd.choice(prose) for _ in range(rnd.choice((0, 0, 1, 3, 8)))]
                cut = rnd.randrange(len(around) + 1)
                shred = [v for v in w if rnd.random() < 0.25] + [rnd.choice(prose) for _ in range(len(w))]
                rnd.shuffle(shred)
                x += [around[:cut] + kept + around[cut:], shred]
                y += [k, len(NAMES)]
    for n in (*negatives, *ORDINARY * 5):
        x.append(words(n))
        y.append(len(NAMES))
    some = [i for i, w in enumerate(x) if w]
    return [x[i] for i in some], [y[i] for i in some]


def _packed(x: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([slots(w) for w in x]), np.concatenate([[0], np.cumsum([len(w) for w in x])])


def _fit(x: list[list[str]], y: list[int], rnd: random.Random) -> Model:
    """Multinomial logistic regression by AdaGrad over batches of the samples."""
    classes = len(NAMES) + 1
    model = Model(np.zeros((SLOTS + 1, classes), np.float32), np.zeros(classes))
    seen, seen_bias = np.full((SLOTS + 1, classes), 1e-6, np.float32), np.full(classes, 1e-6)
    packed = [slots(w) for w in x]
    order = list(range(len(x)))
    for _ in range(EPOCHS):
        rnd.shuffle(order)
        for i in range(0, len(order), BATCH):
            part = order[i : i + BATCH]
            at = np.concatenate([packed[j] for j in part])
            size = np.array([len(packed[j]) for j in part])
            total, n = model.sums(at, np.concatenate([[0], np.cumsum(size)[:-1]]))
            g = model.probabilities(total, n)
            g[np.arange(len(part)), [y[j] for j in part]] -= 1
            bias = g.mean(0)
            seen_bias += bias * bias
            model.bias -= RATE * bias / np.sqrt(seen_bias)
            rows, where = np.unique(at, return_inverse=True)
            step = np.repeat((g / np.sqrt(n)[:, None] / len(part)).astype(np.float32), size * 3, 0)
            order_ = np.argsort(where.ravel(), kind="stable")
            grad = np.add.reduceat(step[order_], np.searchsorted(where.ravel()[order_], np.arange(len(rows))))
            seen[rows] += grad * grad
            model.weights[rows] -= RATE * grad / np.sqrt(seen[rows]) + DECAY * model.weights[rows]
            model.weights[SLOTS] = 0
    return model


def fit(negatives: list[str]) -> Model:
    """The model of all families, calibrated on families that models without them have not seen.

    In each turn a third of the families is left out of the fit; their paragraphs then count as unknown, beside new ones of
    the others and prose that was held out. The temperature is the likeliest one over all turns; the least probability is the one
    that best tells families that were known from those that weren't.
    """
    rnd = random.Random(SEED)
    every = list(range(len(NAMES)))
    logits, truth = [], []
    for turn in range(TURNS):
        out = every[turn::TURNS]
        known = [k for k in every if k not in out]
        model = _fit(*_samples([n for i, n in enumerate(negatives) if i % TURNS != turn], known, rnd, COPIES // 2), rnd)
        held = [n for i, n in enumerate(negatives) if i % TURNS == turn]
        for ks, as_unknown in ((known, False), (out, True)):
            x, y = _samples(held, ks, rnd, 10)
            at, starts = _packed(x)
            total, n = model.sums(at, starts[:-1])
            z = model.bias + total / np.sqrt(np.maximum(n, 1))[:, None]
            z[:, out] = -1e9
            logits.append(z)
            truth.append(np.array([len(NAMES) if as_unknown else k for k in y]))
    z, y = np.concatenate(logits), np.concatenate(truth)
    loss = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean()
    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0, 4.0), key=loss)
    p, familiar = _softmax(z / temperature)[:, : len(NAMES)].max(1), y < len(NAMES)
    sure = max((0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9), key=lambda s: (p[familiar] >= s).mean() + (p[~familiar] < s).mean())
    model = _fit(*_samples(negatives, every, rnd, COPIES), rnd)
    model.temperature, model.sure = temperature, sure
    return model


def _ordinary(batches):
    """Paragraphs of whole documents that are like no template."""
    for pdf in batches:
        out = []
        for text in pdf["text"]:
            for block in blocks(text):
                for i in range(len(block)):
                    for size in (1, 3):
                        if i + size <= len(block):
                            p = " ".join(text[block[i][0] : block[i + size - 1][1]].split())
                            w = words(p)
                            if len(w) <= NEGATIVE_WORDS and max(likeness(w, f) for f in NAMES) < ALIKE:
                                out.append(p)
        yield pd.DataFrame({"p": out}, dtype=object)


def train(docs: DataFrame) -> Model:
    """The model, with paragraphs that are like no template, licence words or not, from about NEGATIVE_DOCS whole documents as unknown."""
    bounded_batches(docs.sparkSession)
    n = max(1, docs.count())
    share = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(1_000_000 * min(1, NEGATIVE_DOCS / n))
    some = docs.where("text IS NOT NULL").where(share).select("text").mapInPandas(_ordinary, "p string").distinct()
    return fit(sorted(r["p"] for r in some.orderBy(F.xxhash64("p"), "p").limit(NEGATIVES).collect()))


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row of docs: doc_id, licenses (sorted families, comma-joined), n_licenses, n_unknown, spans.

    spans: family:start:end (code points, end exclusive) of each licensed paragraph, in order, with
    unknown for those that speak of a licence but that no family explains. Null or empty texts have none;
    an empty table gives no rows; null or equal doc_ids and repeated rows don't matter, rows are judged one by one by their
    texts; very long texts and lines are read whole, lines of more than LONG characters by sentences. Families of equal probability go by
    name. Other columns are ignored, whatever their names. The model is trained on docs unless it is given.
    """
    model = train(docs) if model is None else model
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for pdf in batches:
            out = []
            for i, text in zip(pdf["doc_id"].astype("Int64").array, pdf["text"]):
                found = sent.value.paragraphs(text) if isinstance(text, str) else []
                families = sorted({f for f, _, _ in found} - {UNKNOWN})
                out.append((i, ",".join(families), len(families), sum(f == UNKNOWN for f, _, _ in found), ",".join(f"{f}:{a}:{b}" for f, a, b in found)))
            yield pd.DataFrame(out, columns=["doc_id", "licenses", "n_licenses", "n_unknown", "spans"]).astype({"doc_id": "Int64"})

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, licenses string, n_licenses int, n_unknown int, spans string")
