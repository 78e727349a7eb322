"""License scans: winnowed fingerprints pick candidates, banded alignment reports matches."""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logsluice.llm.common import pick
from logsluice.llm.hashing import PLACES, Words, mix, text_slices, words_of

GRAM = 3
WINDOW = 2
BAND = 8
MIN_COVERAGE = 0.75
MATCH, MISS = 1.0, -0.5

# Opening excerpts of public licenses, and notices that name them.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS '
        "OF ANY KIND, either express or implied. See the License for the specific language governing permissions "
        "and limitations under the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce "
        "the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}

INNER = np.zeros(256, bool)
INNER[48:58] = True
INNER[97:123] = True
INNER[128:] = True


def _words(texts: list[str]) -> Words:
    return words_of(next(text_slices(pa.array(texts), 1 << 40)), INNER)


def grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of GRAM words, and their first words; none runs over a row's end."""
    h, n = words.hashes, len(words.hashes) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    made = np.zeros(n, np.uint64)
    for i in range(GRAM):
        made += h[i : n + i] * PLACES[i]
    row = words.row_of()
    at = np.flatnonzero(row[:n] == row[GRAM - 1 :])
    return mix(made[at]), at


def winnow(hashes: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which grams are fingerprints: the least of WINDOW neighbouring ones of a row, and all of short rows."""
    chosen = np.zeros(len(hashes), bool)
    if not len(hashes):
        return chosen
    new = np.ones(len(hashes), bool)
    new[1:] = row[at[1:]] != row[at[:-1]]
    left = np.diff(np.append(np.flatnonzero(new), len(hashes)))
    first = np.repeat(np.flatnonzero(new), left)
    size = np.repeat(left, left)
    place = np.arange(len(hashes)) - first
    starts = np.flatnonzero((place + WINDOW <= size) | (place == 0))
    best = starts.copy()
    for step in range(1, WINDOW):
        other = np.minimum(starts + step, len(hashes) - 1)
        inside = first[other] == first[starts]
        better = inside & (hashes[other] <= hashes[best])  # the last of equal ones
        best = np.where(better, other, best)
    chosen[best] = True
    return chosen


@dataclass
class Index:
    """Fingerprints of all templates, sorted, with template and first word of each."""

    names: list[tuple[str, int]]
    words: list[np.ndarray]
    hashes: np.ndarray
    template: np.ndarray
    place: np.ndarray


def build_index(templates: Mapping[str, list[str]]) -> Index:
    names = [(name, i) for name, texts in templates.items() for i in range(len(texts))]
    words = _words([text for texts in templates.values() for text in texts])
    hashes, at = grams(words)
    row = words.row_of()
    # A document's fingerprints depend on its own neighbours at the ends of a match, so
    # every gram of the templates is in the index; only documents are winnowed.
    order = np.argsort(hashes, kind="stable")
    return Index(
        names,
        [words.hashes[words.rows[i] : words.rows[i + 1]] for i in range(len(names))],
        hashes[order],
        row[at][order],
        (at - words.rows[:-1][row[at]])[order],
    )


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int = BAND) -> tuple[float, int, int, int]:
    """Best local alignment near a diagonal: (score, matched words, first word, end) in ``text``.

    Cell (i, j) pairs word i of the template with word j of the text, |j - i - diagonal| <= band.
    A match gains MATCH; a replaced, left out or added word loses -MISS. Of equal scores
    the first in reading order wins.
    """
    best = (0.0, 0, 0, 0)
    before: dict[int, tuple[float, int, int]] = {}
    for i in range(len(template)):
        row: dict[int, tuple[float, int, int]] = {}
        low, high = max(0, i + diagonal - band), min(len(text), i + diagonal + band + 1)
        for j in range(low, high):
            same = template[i] == text[j]
            score, matched, first = before.get(j - 1, (0.0, 0, j))
            cell = (score + MATCH, matched + 1, first) if same else (score + MISS, matched, first)
            for score, matched, first in (before.get(j, (0.0, 0, j)), row.get(j - 1, (0.0, 0, j))):
                if score + MISS > cell[0]:
                    cell = (score + MISS, matched, first)
            if cell[0] > 0:
                row[j] = cell
                if cell[0] > best[0]:
                    best = (*cell, j + 1)
        before = row
    return best


def find(index: Index, text: np.ndarray, template: int, hits: list[tuple[int, int]], least: float) -> list[tuple]:
    """Matches of one template in one text: (coverage, first word, end), not overlapping.

    Hits (word of the text, word of the template) on diagonals within the band of
    each other, and no farther apart than the template is long, make one candidate region.
    The best match of all regions is taken; then the words left and right of it are aligned
    again, in its region and in each that overlaps it, until nothing reaches ``least``. So
    short notices in a row, which share a region, are found each.
    """
    words, found = index.words[template], []
    hits = sorted(hits, key=lambda h: (h[0] - h[1], h[0]))
    regions: list[list[int]] = []
    for at, place in hits:
        diagonal = at - place
        if regions and diagonal - regions[-1][0] <= BAND and abs(at - regions[-1][1]) <= len(words) + BAND:
            regions[-1][1] = max(regions[-1][1], at)
        else:
            regions.append([diagonal, at])
    waiting: list[tuple] = []
    taken: list[tuple[int, int]] = []  # sorted

    def look(diagonal: int, low: int, high: int) -> None:
        """Puts the best match among the words low .. high - 1 on the heap, if one is left there."""
        parts = [(low, high)]
        while parts:
            low, high = parts.pop()
            if high - low < least * len(words):
                continue
            _, matched, first, end = align(words, text[low:high], diagonal - low)
            if matched >= least * len(words):
                heapq.heappush(waiting, (-matched / len(words), low + first, low + end, diagonal, low, high))
            elif matched:
                parts += [(low, low + first), (low + end, high)]

    for diagonal, _ in regions:
        low = max(0, diagonal - BAND)
        look(diagonal, low, min(len(text), max(0, diagonal) + len(words) + 2 * BAND))
    while waiting:
        coverage, first, end, diagonal, low, high = heapq.heappop(waiting)
        near = taken[max(0, bisect_left(taken, (low, low)) - 1) : bisect_left(taken, (high, high))]
        if all(b <= first or end <= a for a, b in near):
            insort(taken, (first, end))
            found.append((-coverage, first, end))
            near = sorted([*near, (first, end)])
        for a, b in near:
            look(diagonal, low, min(a, high))
            low = max(low, b)
        look(diagonal, low, high)
    return sorted(found, key=lambda m: m[1])


MATCHES = (
    "doc_id long, license string, template int, coverage double, first_word long, n_words long, start long, end long"
)


def scan_licenses(
    docs: DataFrame, templates: Mapping[str, list[str]] | None = None, min_coverage: float = MIN_COVERAGE
) -> DataFrame:
    """Where documents repeat the notice or the opening wording of a license.

    Needs ``doc_id`` and ``text``; other columns are ignored. Returns one row per
    match: doc_id, license, template (number of its wording), coverage (share of the
    template's words that match, in order), first_word, n_words, and start and end as
    code points of the text. Words are runs of letters and digits, A-Z lower-cased.

    The templates are notices and opening excerpts, not whole licenses: coverage and span
    refer to the excerpt, and a whole license goes on after the span's end.

    The templates' word runs form an inverted index that every task holds (its size is
    that of the templates). A document's winnowed fingerprints look it up; hits of a
    template near one diagonal make a candidate, which is aligned with the template in a
    band around it. A task reads each text once; nothing is shuffled.

    A null or empty text and one without license words give no row; repeated rows
    give their matches each; a license repeated in a text gives a match each time.
    Matches of different templates may overlap. An empty table gives no rows.
    """
    index = build_index(templates or TEMPLATES)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch.column(1)):
                words = words_of(part, INNER)
                row = words.row_of()
                hashes, at = grams(words)
                chosen = winnow(hashes, at, row)
                hashes, at = hashes[chosen], at[chosen]
                left = np.searchsorted(index.hashes, hashes, "left")
                right = np.searchsorted(index.hashes, hashes, "right")
                hits: dict[tuple[int, int], list[tuple[int, int]]] = {}
                for g in np.flatnonzero(right > left):
                    r = int(row[at[g]])
                    for k in range(left[g], right[g]):
                        hits.setdefault((r, int(index.template[k])), []).append(
                            (int(at[g] - words.rows[r]), int(index.place[k]))
                        )
                out = []
                for (r, t), places in sorted(hits.items()):
                    text = words.hashes[words.rows[r] : words.rows[r + 1]]
                    for coverage, first, end in find(index, text, t, places, min_coverage):
                        begin = part.bounds[r]
                        span = [
                            len(part.data[begin:stop].tobytes().decode(errors="replace"))
                            for stop in (words.starts[words.rows[r] + first], words.ends[words.rows[r] + end - 1])
                        ]
                        doc = batch.column(0)[part.lo + r].as_py()
                        out.append((doc, *index.names[t], coverage, first, end - first, *span))
                if out:
                    kinds = (pa.int64(), pa.string(), pa.int32(), pa.float64(), *[pa.int64()] * 4)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                        [x.split()[0] for x in MATCHES.split(", ")],
                    )

    return pick(docs, doc_id="long", text="string").mapInArrow(scan, MATCHES)
