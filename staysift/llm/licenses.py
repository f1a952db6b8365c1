"""License scans: winnowed fingerprints of templates pick candidates, banded alignment confirms them.

A text's words are cut into overlapping grams; of each few neighbouring grams the one with the least
hash is its fingerprint, so any WINDOW + GRAM - 1 equal words in a row share one. The fingerprints
of all templates form an inverted index. A template whose fingerprints fall into a text near a
common diagonal is aligned with that stretch of the text word by word, inside a band around it.

Edits may leave no such run of equal words, in a short notice or all over a long one. What the
coverage forces is the number of template words in a stretch of bounded length, in any order: the
stretches that reach it, counted over an index of single words, are candidates too.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from staysift.llm.work import once, texts_of

GRAM, WINDOW = 3, 3
BAND, COVERAGE = 12, 0.8
_WORD = re.compile(r"[^\W_]+")
_KNOWN = 300_000

# Public notices and license texts, in the wording by which they are recognised.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except"
        " in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in"
        " writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT"
        " WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the"
        " GNU General Public License as published by the Free Software Foundation, either version 3 of"
        " the License, or (at your option) any later version."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without"
        " fee is hereby granted, provided that the above copyright notice and this permission notice"
        " appear in all copies."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
        " associated documentation files (the \"Software\"), to deal in the Software without restriction,"
        " including without limitation the rights to use, copy, modify, merge, publish, distribute,"
        " sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is"
        " furnished to do so, subject to the following conditions:"
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
    ),
}


def word_hashes(words: list[str]) -> np.ndarray:
    known: dict[str, int] = once("license words", dict)
    if len(known) > _KNOWN:
        known.clear()
    out = []
    for w in words:
        h = known.get(w)
        if h is None:
            b = w.encode()
            h = zlib.crc32(b) << 32 | zlib.crc32(b, 1)
            if len(w) <= 64:
                known[w] = h
        out.append(h)
    return np.array(out, np.uint64)


def winnow(hashes: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of a sequence of word hashes and their places (ascending).

    A sequence with fewer grams than a window gives its least gram, with fewer words than a gram
    none.
    """
    n = len(hashes) - gram + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    mixed = np.zeros(n, np.uint64)
    for i in range(gram):
        mixed = (mixed ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    width = min(window, n)
    views = np.lib.stride_tricks.sliding_window_view(mixed, width)
    # The last of equal least grams, as winnowing has it.
    at = np.unique(np.arange(len(views)) + width - 1 - np.argmin(views[:, ::-1], axis=1))
    return mixed[at], at


def least_of(size: int, coverage: float) -> int:
    """The fewest words of a template of ``size`` words that are a match."""
    least = max(1, int(coverage * size))
    return least if least >= coverage * size else least + 1


def longest_of(size: int, coverage: float) -> int:
    """The longest stretch of text, in words, that a match of such a template may take."""
    longest = int((size + 1) / coverage) + 1
    return longest if longest * coverage <= size + 1 else longest - 1


class Index:
    """Inverted index of the templates' fingerprints."""

    def __init__(self, templates: dict[str, str], gram: int = GRAM, window: int = WINDOW):
        self.names = sorted(templates)
        self.words = [_WORD.findall(templates[n].lower()) for n in self.names]
        self.gram, self.window = gram, window
        rows = []
        for t, words in enumerate(self.words):
            # Every gram of a template: a text's fingerprint may be any of them.
            hashes = word_hashes(words)
            every, at = winnow(hashes, gram, 1)
            rows += [(int(f), t, int(p)) for f, p in zip(every, at)]
        rows.sort()
        self.prints = np.array([r[0] for r in rows], np.uint64)
        self.template = np.array([r[1] for r in rows], np.int64)
        self.place = np.array([r[2] for r in rows], np.int64)
        # Single words: sorted hashes, and which templates hold each (the last row: none does).
        self.vocabulary = np.unique(np.concatenate([word_hashes(w) for w in self.words] + [np.zeros(0, np.uint64)]))
        self.holds = np.zeros((len(self.vocabulary) + 1, len(self.names)), bool)
        for t, words in enumerate(self.words):
            self.holds[np.searchsorted(self.vocabulary, word_hashes(words)), t] = True
        self.bags = [Counter(w) for w in self.words]

    def dense(self, hashes: np.ndarray, coverage: float) -> list[tuple[int, int]]:
        """Template and first place of each stretch that may hold ``coverage`` of the template.

        The stretch is as long as a match may be and starts with a word of the template.
        """
        out = []
        if not len(hashes) or not len(self.vocabulary):
            return out
        ids = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        ids[self.vocabulary[ids] != hashes] = len(self.vocabulary)
        known = np.flatnonzero(ids < len(self.vocabulary))  # only these count and start a stretch
        held = self.holds[ids[known]]
        for t in np.flatnonzero(held.sum(axis=0) >= [least_of(len(w), coverage) for w in self.words]):
            at = known[held[:, t]]
            size = len(self.words[t])
            ends = np.searchsorted(at, at + longest_of(size, coverage))
            starts = at[ends - np.arange(len(at)) >= least_of(size, coverage)]
            out += [(int(t), int(a)) for a in starts]
        return out

    def hits(self, hashes: np.ndarray) -> list[tuple[int, int, int]]:
        """Template, place in the text and place in the template of each shared fingerprint."""
        prints, at = winnow(hashes, self.gram, self.window)
        low = np.searchsorted(self.prints, prints, "left")
        high = np.searchsorted(self.prints, prints, "right")
        return [
            (int(self.template[r]), int(at[i]), int(self.place[r]))
            for i in np.flatnonzero(high > low)
            for r in range(low[i], high[i])
        ]


def align(template: list[str], text: list[str], shift: int, band: int) -> list[tuple[int, int]]:
    """Longest common subsequence of a template and a stretch of text, as pairs of places.

    Only cells within ``band`` words of the diagonal ``text place = template place + shift``
    are filled. Equal words match; skips on either side are free.
    """
    m, width = len(template), 2 * band + 1
    best = [[0] * (width + 2) for _ in range(m + 1)]
    for i in range(1, m + 1):
        word, row, above = template[i - 1], best[i], best[i - 1]
        for c in range(1, width + 1):
            j = i - 1 + shift + c - 1 - band
            # One row up, the same text place is one column to the right.
            value = max(row[c - 1], above[c + 1])
            if 0 <= j < len(text) and text[j] == word:
                value = max(value, above[c] + 1)
            row[c] = value
    pairs, i, c = [], m, width
    while i > 0 and c > 0:
        j = i - 1 + shift + c - 1 - band
        here = best[i][c]
        if 0 <= j < len(text) and text[j] == template[i - 1] and here == best[i - 1][c] + 1:
            pairs.append((i - 1, j))
            i -= 1
        elif here == best[i][c - 1]:
            c -= 1
        else:
            i, c = i - 1, c + 1
            if c > width:
                c = width
    return pairs[::-1]


def scan_text(text: str, index: Index, coverage: float = COVERAGE, band: int = BAND):
    """Matches in one text: template name, matched words, template words, first and last character.

    Every stretch that holds ``coverage`` of a template in order is reported, or lies across a match
    with as many words or more. Hits of one template whose diagonals and places lie close together
    are one candidate; the band around the diagonal is ``band`` words, or a quarter of a shorter template. A match
    keeps ``coverage`` of the template's words or more, within a stretch of text not much longer. Of
    matches that lie inside one with more matched words none is reported again.
    """
    lowered = text.lower()
    if len(lowered) != len(text):  # a few characters change length; places would shift
        lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    spans = [m.span() for m in _WORD.finditer(lowered)]
    words = [lowered[a:b] for a, b in spans]
    found, places = [], []
    hashes = word_hashes(words)
    hits = sorted(index.hits(hashes))
    i = 0
    while i < len(hits):
        t, first, place = hits[i]
        template, j = index.words[t], i + 1
        near = max(1, min(band, len(template) // 4))  # so that two notices in a row stay two
        diagonals = [first - place]
        while (
            j < len(hits) and hits[j][0] == t and hits[j][1] - first <= len(template) + near
            and abs(hits[j][1] - hits[j][2] - diagonals[0]) <= near
        ):
            diagonals.append(hits[j][1] - hits[j][2])
            j += 1
        shift = int(np.median(diagonals))
        pairs = align(template, words, shift, near)
        if pairs and len(pairs) >= coverage * len(template):
            a, b = pairs[0][1], pairs[-1][1]
            if (b - a + 1) * coverage <= len(template) + 1:
                found.append((len(pairs), len(template), index.names[t], spans[a][0], spans[b][1]))
                places.append((t, len(pairs), a, b))
        i = j
    for t, a in index.dense(hashes, coverage):
        template = index.words[t]
        least, longest = least_of(len(template), coverage), longest_of(len(template), coverage)
        stretch = words[a : a + longest]
        # No alignment holds more words than the two have in common in any order.
        most = sum((Counter(stretch) & index.bags[t]).values())
        if most < least or any(o == t and first <= a <= last and n >= most for o, n, first, last in places):
            continue
        pairs = align(template, stretch, 0, max(len(template) - least, longest - least))
        if len(pairs) >= least:
            first, last = a + pairs[0][1], a + pairs[-1][1]
            near_ones = [p for p in places if p[0] == t and p[2] <= last and first <= p[3]]
            if all(p[1] < len(pairs) for p in near_ones):
                gone = {(index.names[t], spans[p[2]][0], spans[p[3]][1]) for p in near_ones}
                found = [f for f in found if f[2:] not in gone]
                places = [p for p in places if p not in near_ones]
                places.append((t, len(pairs), first, last))
                found.append((len(pairs), len(template), index.names[t], spans[first][0], spans[last][1]))
    found.sort(key=lambda f: (-f[0], -f[0] / f[1], f[2], f[3]))
    kept = []
    for f in found:
        if not any(k[3] <= f[3] and f[4] <= k[4] for k in kept):
            kept.append(f)
    return sorted((name, hit, size, a, b) for hit, size, name, a, b in kept)


def scan_licenses(
    df: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None,
    coverage: float = COVERAGE, band: int = BAND,
) -> DataFrame:
    """One row per match: ``key``, ``license``, ``matched`` and ``template_words``, ``coverage``,
    ``start`` and ``stop`` (characters of the text), ``matched_text``.

    Whole texts are scanned. Null, empty and clean texts give no rows; null and repeated keys are
    kept as they are, so repeated rows give repeated matches. Templates need a word or more.
    Other columns are not read.
    """
    chosen = TEMPLATES if templates is None else templates
    kind = dict(df.dtypes)[key]
    index = Index(chosen)

    def rows(batches):
        names = [key, "license", "matched", "template_words", "coverage", "start", "stop", "matched_text"]
        for batch in batches:
            out = []
            for i, text in enumerate(texts_of(batch.column(1))):
                for name, hit, size, a, b in scan_text(text, index, coverage, band):
                    out.append((i, name, hit, size, hit / size, a, b, text[a:b]))
            if out:
                at, *columns = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), *map(pa.array, columns)], names=names
                )

    schema = (
        f"`{key}` {kind}, license string, matched long, template_words long, coverage double,"
        " start long, stop long, matched_text string"
    )
    return df.select(F.col(key), F.col(text).alias("_text")).mapInArrow(rows, schema)
