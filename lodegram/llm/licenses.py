"""Licence scans: word n-gram logistic regression over paragraphs, with templates to confirm it."""

from __future__ import annotations

import re
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodegram.llm.common import mapped

UNKNOWN = "unknown"
TEMPLATES: dict[str, list[str]] = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License.",
        "This project is available under the Apache 2.0 license.",
        "Unless required by applicable law or agreed to in writing, it is distributed without warranties.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This software is distributed under the terms of the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "The above copyright notice and this permission notice shall be included in all copies.",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and modify it under the terms of the GNU General Public License.",
        "Distributed under the GNU GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "Distributed under the GNU LGPL version 2.1 or later.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted.",
        "Redistributions of source code must retain the above copyright notice and this list of conditions.",
        "Redistributions in binary form must reproduce the above copyright notice in the documentation.",
        "Neither the name of the copyright holder nor the names of its contributors may endorse products.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "mpl": [
        "This source code is subject to the terms of the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "agpl": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "Distributed under the GNU AGPL version 3 or later.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the Eclipse Public License 2.0.",
        "Eclipse Public License, v1.0",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "isc": [
        "Permission to use, copy, modify, and distribute this software for any purpose is hereby granted.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Released under the Unlicense.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright 2020 by the authors. All rights reserved.",
        "No part of this publication may be reproduced without prior written permission.",
    ],
}
#: Paragraphs of no family, many with the words of licences.
OTHERS = """The driver must show a valid license at the counter.
He lost his fishing license in the river last spring.
Our software helps people to write better code.
You have the right to remain silent.
The general public was invited to the opening.
This version is newer than the one before it.
Permission to enter the building was refused.
The library is open from nine to five.
Apache helicopters flew over the valley in the morning.
Students of the institute released a report under embargo.
The work is done and the workers went home.
All seats are reserved for members of the club.
Creative people are common in this town.
The terms of the agreement were discussed for hours.
Free of charge, the tour takes you around the harbour.
A copy of the letter was sent to every person in the office.
The source of the river is high in the mountains.
Commercial traffic is forbidden on this road.
Distributed systems are hard to reason about.
Redistribution of wealth was the theme of the debate.
The file was saved under another name.
An international team of scientists published the result.
The rights of the tenants are set out in the contract.
Attribution of the painting to the master is in doubt.
Any license plate with the number 2 was checked.
She released the dog and it ran across the field.""".splitlines()

BUCKETS, ROUNDS, SEED = 1 << 15, 400, 11
#: Share of a template's content words that a paragraph must have, and the precision on held-out
#: variants to which the least probability is set.
CONTAINED, PRECISION = 0.6, 0.995
#: Words of the lines that are read as one notice with a line that is none by itself: a shorter and a longer window.
WINDOWS = (24, 48)
STOP = frozenset("a an and any are at by for from in is it its may not of on or the this to under with you your can be all no".split())
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
_DIGITS = re.compile(r"[0-9]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features(tokens: list[str]) -> np.ndarray:
    """Hashed words and pairs of words; numbers alike."""
    t = ["#" if w[0].isdigit() else _DIGITS.sub("#", w) for w in tokens]
    grams = {*t, *(f"{a} {b}" for a, b in zip(t, t[1:]))}
    return np.fromiter((zlib.crc32(g.encode()) % BUCKETS for g in grams), np.int64, len(grams))


def content(tokens: list[str]) -> set[str]:
    """The words that tell something, numbers in them alike."""
    return {_DIGITS.sub("#", w) for w in tokens if w not in STOP and not w[0].isdigit()}


class Sparse:
    """Rows of a few columns each, all of a row's entries alike: sums by column or row without a dense matrix."""

    def __init__(self, rows: list[np.ndarray]) -> None:
        self.n = np.array([len(r) for r in rows])
        self.first = np.cumsum(self.n) - self.n
        self.cols = np.concatenate(rows) if rows else np.empty(0, np.int64)
        self.rows = np.repeat(np.arange(len(rows)), self.n)
        self.value = (1 / np.sqrt(np.maximum(self.n, 1)))[self.rows]

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.n), w.shape[1]))
        full = self.n > 0
        if full.any():
            out[full] = np.add.reduceat(w[self.cols] * self.value[:, None], self.first[full])
        return out

    def transposed_times(self, d: np.ndarray, columns: int) -> np.ndarray:
        part = d[self.rows] * self.value[:, None]
        return np.stack([np.bincount(self.cols, part[:, k], columns) for k in range(d.shape[1])], 1)


def variant(rng: np.random.RandomState, text: str) -> str:
    """A paragraph with words left out, numbers changed, or other words around it."""
    t = text.split()
    if rng.rand() < 0.5 and len(t) > 4:
        del t[rng.randint(len(t))]
    t = [re.sub(r"\d", str(rng.randint(1, 5)), w) for w in t]
    if rng.rand() < 0.4:
        t = [*rng.choice(OTHERS).split()[: rng.randint(1, 6)], *t]
    return " ".join(t).upper() if rng.rand() < 0.1 else " ".join(t)


class Classifier:
    """Multinomial logistic regression, trained here on variants of the templates (bounded by their number)."""

    def __init__(self, per: int = 40) -> None:
        self.families = [*TEMPLATES, UNKNOWN]
        rng = np.random.RandomState(SEED)

        def made(n: int) -> tuple[list[np.ndarray], np.ndarray]:
            x, y = [], []
            for k, f in enumerate(self.families):
                for t in TEMPLATES.get(f, OTHERS):
                    for _ in range(n if f != UNKNOWN else max(1, n // 4)):
                        x.append(features(words(variant(rng, t) if f != UNKNOWN else " ".join(w for w in t.split() if rng.rand() > 0.15))))
                        y.append(k)
            return x, np.array(y)

        (x, y), (xv, yv) = made(per), made(per // 2)
        used = np.unique(np.concatenate([*x, np.empty(0, np.int64)]))
        self.column = np.full(BUCKETS, -1)
        self.column[used] = np.arange(len(used))
        m, mv = self.matrix(x), self.matrix(xv)
        k = len(self.families)
        self.w, self.b = np.zeros((len(used), k)), np.zeros(k)
        self.b[-1] = 1.0  # a paragraph without a known n-gram is of no family
        goal = np.eye(k)[y]
        for _ in range(ROUNDS):
            off = self.soft(m.times(self.w) + self.b) - goal
            self.w -= 4.0 * (m.transposed_times(off, len(used)) / len(y) + 1e-4 * self.w)
            self.b[:-1] -= 0.5 * off.mean(0)[:-1]
        # calibration on held-out variants: a temperature for the probabilities, then the least probability
        z = mv.times(self.w) + self.b
        self.heat = min((0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=lambda t: -np.log(self.soft(z / t)[np.arange(len(yv)), yv] + 1e-12).mean())
        p = self.soft(z / self.heat)
        best, top = p.argmax(1), p.max(1)
        claims = best != k - 1
        self.least = next((c for c in np.arange(0.3, 1.0, 0.01) if (right := (best == yv)[claims & (top >= c)]).size and right.mean() >= PRECISION), 0.99)
        self.content = [(f, t, content(words(t))) for f, ts in TEMPLATES.items() for t in ts]
        common = {"mit", "version", "file", "files", "works", "person", "source", "use", "general", "public", "2.0", "later", "project", "part", "written", "prior", "free", "copy", "modify", "purpose", "name", "names", "list", "form", "code", "products", "received", "along", "obtain", "one", "made", "must", "above", "program", "should", "have", "shall", "included", "required", "law", "writing", "binary", "domain", "if", "was", "holder", "into", "without", "documentation"}
        # a word with numbers is found by what is before them
        self.anchor_words = sorted({w.split("#")[0].rstrip("-.") for _, _, c in self.content for w in c} - common)
        # no paragraph can have enough of a template's content without one of the anchors
        assert all(len(c & common) < CONTAINED * len(c) for _, _, c in self.content)

    def matrix(self, rows: list[np.ndarray]) -> Sparse:
        own = (self.column[r] for r in rows)
        return Sparse([c[c >= 0] for c in own])

    @staticmethod
    def soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def classify(self, paragraph: str) -> tuple[str, float, str | None]:
        """Family, its probability, the template that confirms it; 'unknown' if none does."""
        t = words(paragraph)
        p = self.soft((self.matrix([features(t)]).times(self.w) + self.b) / self.heat)[0]
        k = int(p.argmax())
        if self.families[k] != UNKNOWN and p[k] >= self.least:
            have = content(t)
            share, text = max((len(c & have) / len(c), x) for f, x, c in self.content if f == self.families[k])
            if share >= CONTAINED:
                return self.families[k], float(p[k]), text
        return UNKNOWN, float(p[-1]), None


class _Notices:
    """The notices of one text: lines that are one by themselves, else windows of lines without an empty one."""

    def __init__(self, text: str, known) -> None:
        self.lines, self.known = text.split("\n"), known
        self.windows: dict[tuple[int, int], tuple[tuple, int]] = {}

    def window(self, begin: int, most: int) -> tuple[tuple, int]:
        """Result and last line of the lines from begin on that go on while those after the first have less than so
        many words. A first line gives its last words, a last one its first. Empty lines and notices end it."""
        if (begin, most) not in self.windows:
            parts, last, size = [" ".join(self.lines[begin].split()[-most:])], begin, 0
            while size < most and last + 1 < len(self.lines) and self.lines[last + 1].strip() and self.known(self.lines[last + 1])[2] is None:
                last += 1
                t = self.lines[last].split()
                parts.append(" ".join(t[: most - size]))
                size += len(t)
            self.windows[begin, most] = (self.known(" ".join(parts)) if last > begin else (UNKNOWN, 0.0, None), last)
        return self.windows[begin, most]

    def around(self, line: int, after: int) -> tuple[int, int, tuple] | None:
        """First line, last line and result of the notice with that line, which begins after another line."""
        begin, size = line, 0
        while True:
            for most in WINDOWS:
                result, last = self.window(begin, most)
                if result[2] is not None and last >= line:
                    return begin, last, result
            begin -= 1
            if begin <= after or size >= WINDOWS[-1] or not self.lines[begin].strip() or self.known(self.lines[begin])[2] is not None:
                return None
            size += len(self.lines[begin].split())


def _scanner(model: Classifier):
    def run(batches):
        anchors = ahocorasick.Automaton()
        for w in model.anchor_words:
            anchors.add_word(w, len(w))
        anchors.make_automaton()
        seen: dict[str, tuple] = {}

        def known(paragraph: str) -> tuple:
            if paragraph not in seen:
                if len(seen) > 10_000:
                    seen.clear()
                seen[paragraph] = model.classify(paragraph)
            return seen[paragraph]

        for batch in batches:
            ids, rows = batch.column("doc_id"), []
            for i, text in enumerate(batch.column("text").to_pylist()):
                if not text:
                    continue
                low = text.lower()
                if len(low) != len(text):  # so that places agree
                    low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
                done = number = counted = 0
                notices, covered = None, -1
                for end, length in anchors.iter(low):
                    at = end - length + 1
                    if at < done or (at and low[at - 1].isalnum()) or (end + 1 < len(low) and low[end + 1].isalnum()):
                        continue
                    begin, stop = low.rfind("\n", 0, at) + 1, low.find("\n", end)
                    done = len(low) if stop < 0 else stop
                    number += low.count("\n", counted, begin)
                    counted = begin
                    if number <= covered:
                        continue
                    result = known(text[begin:done])
                    if result[2] is not None:
                        covered = number
                    else:
                        notices = notices or _Notices(text, known)
                        if found := notices.around(number, covered):
                            first, covered, result = found
                            rows.append((i, first, *result))
                            continue
                    rows.append((i, number, *result))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(np.round(np.array(cols[3], float), 6), pa.float64()), pa.array(cols[4], pa.string())],
                ["doc_id", "paragraph", "family", "probability", "template"],
            )

    return run


def scan(spark: SparkSession, docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """doc_id, paragraph (number of its first line, from 0), family, probability, template: a row for each paragraph
    with a word of a licence.

    Paragraphs are lines that are a notice by themselves, else the lines around one, without an empty line or another
    notice, that are a notice together (WINDOWS words at most beyond the first line); else single lines. The family is the classifier's if its calibrated probability is enough and
    a template of the family has CONTAINED of its content words in the paragraph; else 'unknown', with a null
    template and the probability of no family. Paragraphs without any of the templates' anchor words can't
    be confirmed; they are 'unknown' and give no row. Null and empty texts give none; texts are read
    whole; repeated rows give their rows each. Other columns than doc_id and text aren't read.
    """
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").transform(mapped, _scanner(model or Classifier()), f"doc_id {kind}, paragraph int, family string, probability double, template string")
