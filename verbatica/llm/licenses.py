"""License scan: winnowed fingerprints find candidates, banded alignment measures them.

Words are lower-cased runs of letters and digits.  Of the hashes of 3 words each template keeps the smaller of any two in a
row; the inverted index from such a hash to templates and places is broadcast (its size depends on the templates only).
Documents are winnowed alike, so a copied stretch of at least 4 words of a template gives a hit.  From the first hit that no
match covers yet the template is aligned with the words there, within ``BAND`` of the hit's diagonal, for the longest common
subsequence.  A candidate is reported if at least ``COVERAGE`` of the template's words match, with its span in the text.

Every document is scanned whole, in the partition where it lies; nothing is shuffled.  A text may give several rows, one for
each place; a null or empty text gives none, and repeated rows give their rows each.  Templates without words are refused;
templates of fewer than 3 words have no hash of 3 and are looked for word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import table
from .textops import code_points, code_table, lower_table, portions, runs, token_hashes, window_hashes

GRAM, BAND, COVERAGE = 3, 8, 0.8
#: Notices and opening terms of public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT terms": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def _words(texts: list[str]) -> tuple[np.ndarray, ...]:
    cps, text_start = code_points(texts)
    start, end = runs(code_table(str.isalnum)[cps])
    return token_hashes(lower_table()[cps], start, end), start, end, np.searchsorted(start, text_start), text_start


def winnowed(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the kept hashes of 3 words; texts end at first[1:]."""
    n = np.diff(first)
    count = np.maximum(n - GRAM + 1, 0)
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ends = np.cumsum(count)
    place = np.repeat(first[:-1] - (ends - count), count) + np.arange(total)
    h = window_hashes(words, place, GRAM)
    inner = np.ones(total, bool)
    inner[ends[count > 0] - 1] = False  # the last of a text has no right neighbour
    keep = np.zeros(total, bool)
    left = np.flatnonzero(inner)
    keep[np.where(h[left] <= h[left + 1], left, left + 1)] = True
    keep[ends[count == 1] - 1] = True
    return place[keep], h[keep]


def aligned(template: np.ndarray, words: np.ndarray, offset: int, band: int = BAND) -> tuple[int, int, int]:
    """Longest common subsequence within band of the diagonal word = place + offset: (matches, first word, last word + 1).

    Of equally long ones that which ends first, then that which begins last.
    """
    best: dict[int, tuple[int, int, int]] = {}  # by word: matches, minus the end, first word; over the rows so far
    for i, t in enumerate(template.tolist()):
        lo, hi = max(0, i + offset - band), min(len(words), i + offset + band + 1)
        row: dict[int, tuple[int, int, int]] = {}
        run = row[lo - 1] = best.get(lo - 1, (0, 0, 0))
        for j in range(lo, hi):
            here = max(run, best.get(j, (0, 0, 0)))
            if words[j] == t:
                m, _, first = best.get(j - 1, (0, 0, 0))
                here = max(here, (m + 1, -j - 1, first if m else j))
            run = row[j] = here
        best = row
    m, end, first = max(best.values(), default=(0, 0, 0))
    return m, first, -end


class Index:
    """Templates' words, and for each kept hash the templates and places where it stands."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words = [_words([templates[name]])[0] for name in self.names]
        if any(not len(w) for w in self.words):
            raise ValueError("a template has no words")
        found = [(int(h), t, int(p)) for t, w in enumerate(self.words) for p, h in zip(*winnowed(w, np.array([0, len(w)])), strict=True)]
        self.hash = np.array(sorted({h for h, _, _ in found}), dtype=np.uint64)
        self.short = [t for t, w in enumerate(self.words) if len(w) < GRAM]
        self.at: dict[int, list[tuple[int, int]]] = {}
        for h, t, p in found:
            self.at.setdefault(h, []).append((t, p))


def matches(index: Index, texts: list[str]) -> list[tuple[int, str, float, int, int, int]]:
    """(number of the text, template, coverage, matched words, start, end) of every match, in code points of the text."""
    words, start, end, first, text_start = _words(texts)
    out = []
    for t in index.short:
        n = len(index.words[t])
        at = np.flatnonzero(np.logical_and.reduce([words[k : len(words) - n + 1 + k] == w for k, w in enumerate(index.words[t])])) if len(words) >= n else []
        stop = 0
        for p in at:
            d = int(np.searchsorted(first, p, side="right")) - 1
            if p >= stop and p + n <= first[d + 1]:
                stop, base = p + n, int(text_start[d])
                out.append((d, index.names[t], 1.0, n, int(start[p]) - base, int(end[p + n - 1]) - base))
    place, h = winnowed(words, first)
    if not len(index.hash) or not len(h):
        return sorted(out)
    near = np.minimum(np.searchsorted(index.hash, h), len(index.hash) - 1)
    hit = np.flatnonzero(index.hash[near] == h)
    doc = np.searchsorted(first, place[hit], side="right") - 1
    seeds: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for d, p, key in zip(doc.tolist(), place[hit].tolist(), h[hit].tolist(), strict=True):
        for t, q in index.at[key]:
            seeds.setdefault((d, t), []).append((p - int(first[d]), q))
    for (d, t), places in sorted(seeds.items()):
        own, template, base = words[first[d] : first[d + 1]], index.words[t], int(text_start[d])
        stop, refused = 0, None  # the end of the last match; the diagonal that was last refused, and as far as it went
        for p, q in sorted(places):
            if p < stop or refused and abs(p - q - refused[0]) <= BAND // 2 and p < refused[1]:
                continue
            lo = max(stop, p - q - BAND)
            m, s, e = aligned(template, own[lo : p - q + len(template) + BAND], p - q - lo)
            if m >= COVERAGE * len(template):
                stop = lo + e
                out.append((d, index.names[t], m / len(template), m, int(start[first[d] + lo + s]) - base, int(end[first[d] + lo + e - 1]) - base))
            else:
                refused = (p - q, p - q + len(template))
    return sorted(out)


def scanned(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, license, coverage, matched_words, start, end) of every match."""
    held = docs.sparkSession.sparkContext.broadcast(Index(templates))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(batches, most=500_000):
            got = matches(held.value, texts)
            ids = batch.column(batch.schema.get_field_index("doc_id")).take(pa.array([g[0] for g in got], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array([g[k] for g in got], t) for k, t in ((1, pa.string()), (2, pa.float64()), (3, pa.int32()), (4, pa.int64()), (5, pa.int64()))]],
                                             names=["doc_id", "license", "coverage", "matched_words", "start", "end"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, license string, coverage double, matched_words int, start long, end long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))


QUERIES = {"op2_license_scan": (query, None)}
