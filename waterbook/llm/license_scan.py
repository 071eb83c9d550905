"""License scans: winnowed template fingerprints and banded alignment.

Templates are cut into words (runs of letters, digits and bytes beyond ASCII,
A-Z as a-z). Of the hashes of their k-word runs a winnowed selection, the least
of every ``window`` neighbours, goes into an inverted index from hash to
(template, place); any run of ``k + window - 1`` template words in a document
hits it. Hits that lie close together and near one diagonal make a candidate
region; a banded local alignment of the template's words with the region's
words finds which are matched, in order, and the span from the first to the
last. A match is reported when it covers enough of the template.

Defined results: null, empty and wordless texts match nothing. Templates with
fewer than k words are refused; equal templates each match. Rows are scanned
one by one: repeated rows repeat their matches, null ids are kept. Extra
columns are ignored. Spans are offsets in code points.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shingles import Hasher, U, mix, pieces

#: Notices of public licenses, by the name that is reported.
NOTICES = {
    "MIT (line)": "Released under the MIT License.",
    "Apache-2.0 (line)": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 (line)": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 (line)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 (line)": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 (line)": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}

MATCH, MISMATCH, GAP = 2, -2, -1


def word_hasher() -> Hasher:
    """Hashes words of letters, digits and bytes beyond ASCII."""
    h = Hasher()
    plain = np.zeros(256, dtype=bool)
    plain[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    h.space = ~plain
    return h


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    if len(words) < k:
        return words[:0]
    out = np.zeros(len(words) - k + 1, dtype=np.uint64)
    for i in range(k):
        out = (out ^ words[i : len(words) - k + 1 + i]) * U(0x9E3779B97F4A7C15)
        out ^= out >> U(29)
    return mix(out)


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the last least hash of every window."""
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))] if len(hashes) else [], dtype=np.int64)
    all_windows = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(len(all_windows)) + window - 1 - all_windows.argmin(axis=1))


class TemplateIndex:
    """Inverted index of template fingerprints."""

    def __init__(self, templates: list[tuple[str, str]], k: int, window: int):
        hasher = word_hasher()
        self.k = k
        self.names = [name for name, _ in templates]
        self.words = [hasher.words(text.encode())[0] for _, text in templates]
        if short := [n for n, w in zip(self.names, self.words, strict=True) if len(w) < k]:
            raise ValueError(f"templates of fewer than {k} words: {short}")
        found = [(runs(w, k)[p], t, p) for t, w in enumerate(self.words) for p in winnow(runs(w, k), window)]
        found.sort()
        self.hashes = np.array([f[0] for f in found], dtype=np.uint64)
        self.template = np.array([f[1] for f in found], dtype=np.int64)
        self.place = np.array([f[2] for f in found], dtype=np.int64)
        self.maybe = np.zeros(1 << 18, dtype=bool)
        self.maybe[self.hashes >> U(46)] = True

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in ``hashes``, template, and place there, of every match."""
        look = np.flatnonzero(self.maybe[hashes >> U(46)])
        low, high = (np.searchsorted(self.hashes, hashes[look], side) for side in ("left", "right"))
        n = high - low
        at = np.repeat(look, n)
        entry = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else low
        return at, self.template[entry], self.place[entry]


def regions(at: np.ndarray, template: np.ndarray, place: np.ndarray, gap: int, band: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Template, first and last document place, least, largest and first
    diagonal of every chain of hits of one template that lie close to each
    other and move forward in it; a step back starts another copy."""
    order = np.lexsort((place, at, template))
    current, reached = None, 0
    for i in order:
        t, a, d = int(template[i]), int(at[i]), int(at[i] - place[i])
        near = current and current[0] == t and a - current[2] <= gap and min(abs(d - current[3]), abs(d - current[4])) <= band
        if near and place[i] > reached:
            current = (t, current[1], a, min(d, current[3]), max(d, current[4]), current[5])
        else:
            if current:
                yield current
            current = (t, a, a, d, d, d)
        reached = int(place[i])
    if current:
        yield current


def align(template: np.ndarray, words: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Best local alignment with diagonals (place in ``words`` less place in
    the template) from ``low`` to ``high``: matched words, and the places of
    the first and last in ``words``; (0, -1, -1) if none matches."""
    width = high - low + 1
    # a cell: score, matches, first place, last place
    none = (0, 0, -1, -1)
    above, best = [none] * (width + 1), none
    for i, w in enumerate(template.tolist()):
        row, left = [], none
        for b in range(width):
            j = i + low + b
            if not 0 <= j < len(words):
                row.append(none)
                left = none
                continue
            cell = above[b]  # same diagonal, one word up
            if int(words[j]) == w:
                cell = (cell[0] + MATCH, cell[1] + 1, cell[2] if cell[1] else j, j)
            else:
                cell = (cell[0] + MISMATCH, *cell[1:])
            for other in (above[b + 1], left):  # a template word, or a document word, left out
                if other[0] + GAP > cell[0]:
                    cell = (other[0] + GAP, *other[1:])
            if cell[0] <= 0:
                cell = none
            elif cell[:2] > best[:2]:
                best = cell
            row.append(cell)
            left = cell
        above = [*row, none]
    return best[1], best[2], best[3]


def best_matches(found: dict[tuple[int, int, int], int], sizes: list[int], alternatives: bool = False) -> list[tuple[int, int, int, int]]:
    """Of matches (template, first, last): matched words, those that no better
    one shares words with; ``alternatives``: no better one of the same
    template. Matches that overlap must share words unless the words inserted
    into the better have room for those of the other."""
    rank = lambda x: (sizes[x[0][0]] + x[0][2] - x[0][1] - 3 * x[1], x[0])
    taken: list[tuple[int, int, int, int]] = []  # first, last, template, matched
    widest = 0
    for (t, a, b), matched in sorted(found.items(), key=rank):
        near = taken[bisect.bisect(taken, (a - widest,)) : bisect.bisect(taken, (b + 1,))]
        over = [x for x in near if x[1] >= a and (x[2] == t or not alternatives)]
        if not any(x[2] == t or x[1] - x[0] + 1 - x[3] < matched for x in over):
            bisect.insort(taken, (a, b, t, matched))
            widest = max(widest, b - a)
    return sorted((t, matched, a, b) for a, b, t, matched in taken)


RESULT = "template string, matched int, template_words int, inserted int, coverage double, start bigint, end bigint"


def _scan_batches(templates: list[tuple[str, str]], k: int, window: int, gap: int, band: int, least: float, alternatives: bool, key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(words: np.ndarray, at: np.ndarray, template: np.ndarray, place: np.ndarray, index: TemplateIndex) -> list[tuple[int, int, int, int]]:
        """(template, matched words, first and last word) of one document."""
        found: dict[tuple[int, int, int], int] = {}
        chains = list(regions(at, template, place, gap, band))
        floor = {}  # end of the last match of a template
        for (t, first, last, low, high, _), after in zip(chains, [*chains[1:], None], strict=True):
            size = len(index.words[t])
            start = max(0, min(low, first) - band, floor.get(t, 0))
            stop = min(len(words), max(high + size, last + index.k) + band)
            if after and after[0] == t and after[5] > last:  # where the next copy starts
                stop = min(stop, after[5])
            matched, a, b = align(index.words[t], words[start:stop], low - band - start, high + band - start)
            if matched >= least * size:
                found[t, a + start, b + start] = matched
                floor[t] = b + start + 1
        return best_matches(found, [len(w) for w in index.words], alternatives)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, index = word_hasher(), TemplateIndex(templates, k, window)
        for batch in batches:
            keys, texts, rows = batch.column(0), [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()], []
            for begin, end in pieces(texts):
                part = texts[begin:end]
                words, starts = hasher.words(b" ".join(part))
                edges = np.cumsum([0, *(len(x) + 1 for x in part)])
                first = np.searchsorted(starts, edges)
                at, template, place = index.hits(runs(words, k))
                owner = np.searchsorted(first, at, side="right") - 1
                inside = at + k <= first[np.minimum(owner + 1, len(first) - 1)] if len(at) else np.zeros(0, dtype=bool)
                at, template, place, owner = at[inside], template[inside], place[inside], owner[inside]
                for d in np.unique(owner):
                    own = owner == d if len(owner) < 4096 else slice(np.searchsorted(owner, d), np.searchsorted(owner, d, side="right"))
                    base = first[d]
                    mine, places = words[base : first[d + 1]], starts[base : first[d + 1]] - edges[d]
                    for t, matched, a, b in scan(mine, at[own] - base, template[own], place[own], index):
                        data, stop = part[d], int(places[b])
                        while stop < len(data) and not hasher.space[data[stop]]:
                            stop += 1
                        lead = len(data[: int(places[a])].decode("utf-8"))
                        rows.append((begin + int(d), index.names[t], matched, len(index.words[t]), b - a + 1 - matched, matched / len(index.words[t]), lead, lead + len(data[int(places[a]) : stop].decode("utf-8"))))
            if rows:
                who, *columns = zip(*rows, strict=True)
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(who)), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], [key, *[x.split()[0] for x in RESULT.split(", ")]])

    return run


def scan(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    key: str = "doc_id",
    text: str = "text",
    k: int = 3,
    window: int = 2,
    gap: int = 60,
    band: int = 12,
    least_coverage: float = 0.8,
    alternatives: bool = False,
    max_template_chars: int = 50_000_000,
) -> DataFrame:
    """Matches of templates (name: text) in every whole text: key and RESULT.

    The templates travel with the tasks; ``max_template_chars`` is the checked
    bound of that. A chain of hits breaks where more than ``gap`` words lie
    between two; the alignment may leave the chain's diagonals by ``band``.
    ``alternatives`` keeps the matches of other templates on the same words.
    """
    given = sorted((templates or NOTICES).items())
    if sum(len(t) for _, t in given) > max_template_chars:
        raise ValueError("more template text than max_template_chars")
    TemplateIndex(given, k, window)  # refuses short templates here, not in a task
    rows = docs.select(key, text)
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(_scan_batches(given, k, window, gap, band, least_coverage, alternatives, key), f"`{key}` {kind}, {RESULT}")
