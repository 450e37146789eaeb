"""Licence scans by patience alignment in bounded regions.

A text and a template are aligned as sequences of words (ASCII letters and
digits, lower case), region by region: a region is a stretch of the text with
at most one and a half times the template's words (and four) that the template
holds and few others (``OTHERS``, or half the template's length).  A region
begins at every word that the template holds; for templates of more than
``STEPS`` words, at every (length / STEPS)-th one, and is longer by as much, so
that each stretch lies in one.

In a region, equal words at both ends of a range are matched, then the words
that are unique in both the text's and the template's range become anchors: the
longest run of them that rises in both (patience sorting) is matched, and the
gaps between them are aligned in the same way.  Where that leaves words of the
template over, as where a notice's words repeat or stray before it, the region's
longest common subsequence is taken instead, so no choice of an anchor loses a
match.  The best region counts, of equal ones the one with the tightest matches.
The coverage is the share of the template's words that
are matched there, and a licence is found where it reaches ``COVERAGE``.

The shipped templates (``TEMPLATES`` and ``texts()``) hold words of each other's, as
those of LGPL and GPL do.  Of two whose matches overlap in the text, only the one
with more matched words is a find, or, with as many, the one of greater coverage.

Words that the template does not hold cannot match and only part the ranges, so
each text is reduced to the template's words first.  A text or region whose words
could not reach the coverage even if all of them were matched, counted with
repetition, is not aligned; that skips no find.

Defined results.  Null, empty or word-less texts have no licence.  Of several
found licences the best has the greatest coverage, then the longest template,
then the first name.  Repeated documents are judged alike.  Other columns are
kept and may have any name but those that begin with ``lic_``.  A text may hold
any number of licences; each template is reported once.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterator, Mapping, Sequence
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .kernels import ALNUM, Words, row_slices, text_bytes

COVERAGE = 0.8
#: Words in a region that the template does not hold, at least; places in a template's length where regions begin.
OTHERS, STEPS = 16, 32

#: Notices of common licences and excerpts of their texts.  ``texts()`` has the whole texts.
TEMPLATES = {
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
           "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
           "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
           "conditions: The above copyright notice and this permission notice shall be included in all copies or "
           "substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
           "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                    "that the following conditions are met: 1. Redistributions of source code must retain the above "
                    "copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary "
                    "form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
                    "in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                  "compliance with the License. You may obtain a copy of the License at "
                  "http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                        "General Public License as published by the Free Software Foundation, either version 3 of the "
                        "License, or (at your option) any later version.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                        "General Public License as published by the Free Software Foundation; either version 2 of the "
                        "License, or (at your option) any later version.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
                         "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of "
                         "the License, or (at your option) any later version.",
    "LGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                         "Lesser General Public License as published by the Free Software Foundation, either version 3 of "
                         "the License, or (at your option) any later version.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                         "Affero General Public License as published by the Free Software Foundation, either version 3 of "
                         "the License, or (at your option) any later version.",
    "AGPL-3.0 title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2",
    "LGPL-3.0 notice": "This work is licensed under the GNU Lesser General Public License, version 3",
    "LGPL-2.1 notice": "This work is licensed under the GNU Lesser General Public License, version 2.1",
    "AGPL-3.0 notice": "This work is licensed under the GNU Affero General Public License, version 3",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
                      "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "EPL-2.0 notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public "
                      "License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "BSD notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD named": "Released under the BSD License.",
    "Apache named": "Released under the Apache License.",
    "ISC named": "Released under the ISC License.",
    "MPL named": "Released under the Mozilla Public License.",
    "GPL named": "Released under the GNU General Public License.",
    "Unlicense notice": "This is free and unencumbered software released into the public domain.",
    "CC0-1.0 notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
                      "to this work.",
    **{f"CC-{kind}-4.0 notice": f"Licensed under CC {kind} 4.0." for kind in ("BY", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND")},
    **{f"CC-{kind}-4.0 named": f"This work is licensed under a Creative Commons {name} 4.0 International License."
       for kind, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"),
                          ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
                          ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))},
}


def texts() -> dict[str, str]:
    """The whole texts in ``license_texts``, as ``<name> text``."""
    files = (resources.files(__package__) / "license_texts").iterdir()
    return {f"{f.name.removesuffix('.txt')} text": f.read_text("utf-8") for f in sorted(files, key=lambda f: f.name)
            if f.name.endswith(".txt")}


def align(text: Sequence, template: Sequence, at: Sequence[int] | None = None, least: int = 1) -> list[tuple[int, int]]:
    """Matched ``(place in text, place in template)`` of the best region, rising in both; ``least`` or more of them, or none.

    ``at`` holds the places of ``text`` in the text that it was reduced from.
    """
    if not len(text) or not len(template):
        return []
    at = np.arange(len(text)) if at is None else np.asarray(at)
    begin, end = _regions(at, len(template))
    reach = _reach(text, template, begin, end)
    masks, least, best, spread, region = _masks(template), max(least, 1), 0, 0, []
    for r in np.lexsort((begin, -reach)):
        if reach[r] < max(best, least) or reach[r] == best == spread:
            break
        part = text[begin[r]:end[r]]
        pairs = patience(part, template)
        if len(pairs) < len(template):
            common = deque(_growth(part, masks, len(template)), 1)[0].bit_count()
            pairs = _longest(part, template, common) if common >= max(best, least) else []
        if not pairs or len(pairs) < max(best, least):
            continue
        pairs = [(int(begin[r]) + i, j) for i, j in pairs]
        wide = int(at[pairs[-1][0]] - at[pairs[0][0]]) + 1
        if (-len(pairs), wide, pairs[0]) < (-best, spread, region[0] if region else ()):
            best, spread, region = len(pairs), wide, pairs
    return region


def _regions(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the regions among words at the places ``at``, for a template of ``size`` words."""
    step = max(1, size // STEPS)
    begin = np.arange(0, len(at), step)
    others = at - np.arange(len(at))  # words before each that the template does not hold
    far = others[np.minimum(begin + step, len(at)) - 1] + max(OTHERS, size // 2)
    return begin, np.minimum(begin + size + size // 2 + 3 + step, np.searchsorted(others, far, "right"))


def _reach(text: Sequence, template: Sequence, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words of the template that each region could match in any order."""
    text, reach = np.asarray(text), np.zeros(len(begin), np.int64)
    order = np.argsort(text, kind="stable")
    for w, most in Counter(template).items():
        places = order[np.searchsorted(text, w, "left", order):np.searchsorted(text, w, "right", order)]
        if len(places):
            reach += np.minimum(np.searchsorted(places, end) - np.searchsorted(places, begin), most)
    return reach


def _masks(template: Sequence) -> dict:
    masks: dict = {}
    for j, w in enumerate(template):
        masks[w] = masks.get(w, 0) | 1 << j
    return masks


def _growth(text: Sequence, masks: Mapping, size: int) -> Iterator[int]:
    """After each word of ``text``, as bits, the template's places at which the longest common subsequence grows."""
    row, whole = 0, (1 << size) - 1
    for w in text:
        x = row | masks.get(w, 0)
        row = x & (x ^ (x - (row << 1 | 1))) & whole
        yield row


def _longest(text: Sequence, template: Sequence, n: int) -> list[tuple[int, int]]:
    """A longest common subsequence, of ``n`` words, in the shortest stretch among those that end first."""
    size, masks = len(template), _masks(template)
    b = next(i for i, row in enumerate(_growth(text, masks, size), 1) if row.bit_count() == n)
    back = _growth(text[:b][::-1], _masks(template[::-1]), size)
    a = b - next(i for i, row in enumerate(back, 1) if row.bit_count() == n)
    rows = [0, *_growth(text[a:b], masks, size)]
    upto = lambda i, j: (rows[i] & ((1 << j) - 1)).bit_count()
    pairs, i, j = [], b - a, size
    while i and j:
        if upto(i - 1, j) == upto(i, j):
            i -= 1
        elif upto(i, j - 1) == upto(i, j):
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((a + i, j))
    return pairs[::-1]


def patience(text: Sequence, template: Sequence) -> list[tuple[int, int]]:
    """Matched ``(place in text, place in template)`` by words that are unique in both and their equal neighbours."""
    found: list[tuple[int, int]] = []
    ranges = [(0, len(text), 0, len(template))]
    while ranges:
        a, b, c, d = ranges.pop()
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a == b or c == d:
            continue
        in_text, in_template = Counter(text[a:b]), Counter(template[c:d])
        where = {w: i for i, w in enumerate(text[a:b], a) if in_text[w] == 1}
        unique = [(where[w], j) for j, w in enumerate(template[c:d], c) if in_template[w] == 1 and w in where]
        if not unique:
            continue
        anchors = rising(unique)
        found += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        ranges += [(x + 1, y, u + 1, v) for (x, u), (y, v) in zip(edges, edges[1:], strict=False) if x + 1 < y and u + 1 < v]
    return sorted(found)


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of ``pairs`` (in order of the second) that rises in the first, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, (x, _) in enumerate(pairs):
        p = bisect_left(tops, x)
        back.append(piles[p - 1] if p else -1)
        tops[p:p + 1], piles[p:p + 1] = [x], [i]
    out, i = [], piles[-1]
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def _words(text: str) -> list[bytes]:
    buf, offsets = text_bytes(pa.array([text], pa.string()))
    words = Words(buf, offsets, ALNUM, lower=True)
    return [words.joined(i, i + 1) for i in range(len(words))]


def _hashes(words: Sequence[bytes]) -> np.ndarray:
    buf, offsets = text_bytes(pa.array([b" ".join(words).decode()], pa.string()))
    return Words(buf, offsets, ALNUM, lower=True).hashes()


FOUND = T.ArrayType(T.StructType([
    T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()),
    T.StructField("matched", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType())]))
_FOUND = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int64()),
                             ("first_word", pa.int64()), ("last_word", pa.int64())]))


class _Compiled:
    """Templates as numbers of their words."""

    def __init__(self, templates: Mapping[str, str]):
        self.names = list(templates)
        words = [_words(templates[n]) for n in self.names]
        vocabulary = sorted({w for t in words for w in t})
        number = {w: i for i, w in enumerate(vocabulary)}
        self.templates = [[number[w] for w in t] for t in words]
        self.counts = [np.bincount(np.array(t, np.int64), minlength=len(vocabulary)) for t in self.templates]
        hashes = _hashes(vocabulary)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]


def _apart(found: list[dict]) -> list[dict]:
    """Of finds that overlap in the text, those with the most matched words."""
    kept: list[dict] = []
    for f in sorted(found, key=lambda f: (-f["matched"], -f["coverage"], f["license"])):
        if all(f["last_word"] < k["first_word"] or k["last_word"] < f["first_word"] for k in kept):
            kept.append(f)
    return kept


def _scan(known, coverage: float, apart: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = known.value
        length = {n: len(x) for n, x in zip(t.names, t.templates, strict=True)}
        size = len(t.hashes)
        for batch in batches:
            column = batch.schema.get_field_index("text")
            for lo, n in row_slices(batch.column(column)):
                part = batch.slice(lo, n)
                words = Words(*text_bytes(part.column(column)), ALNUM, lower=True)
                hashes = words.hashes()
                at = np.searchsorted(t.hashes, hashes).clip(max=max(size - 1, 0))
                own = np.flatnonzero(t.hashes[at] == hashes) if size else np.zeros(0, np.int64)
                word, of = t.order[at[own]] if size else own, words.of_text()[own]
                held, times = np.unique(of * size + word, return_counts=True)
                held_by, held_word = (held // size, held % size) if size else (held, held)
                found: list[list[dict]] = [[] for _ in range(n)]
                first = np.searchsorted(of, np.arange(n + 1))
                for k, template in enumerate(t.templates):
                    if not template:
                        continue
                    least = math.ceil(coverage * len(template))
                    reach = np.bincount(held_by, np.minimum(times, t.counts[k][held_word]), minlength=n)
                    for d in np.flatnonzero(reach >= max(least, 1)):
                        place = np.arange(first[d], first[d + 1])
                        place = place[t.counts[k][word[place]] > 0]
                        at = own[place] - words.first[d]
                        pairs = align(word[place].tolist(), template, at, least)
                        if pairs:
                            found[d].append({"license": t.names[k], "coverage": len(pairs) / len(template), "matched": len(pairs),
                                             "first_word": int(at[pairs[0][0]]), "last_word": int(at[pairs[-1][0]])})
                if apart:
                    found = [_apart(x) for x in found]
                for x in found:
                    x.sort(key=lambda f: (-f["coverage"], -length[f["license"]], f["license"]))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(words.counts(), pa.int64()), pa.array(found, _FOUND)],
                    [*part.schema.names, "lic_words", "lic_found"])
    return run


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` plus ``lic_words`` (words) and ``lic_found`` (the licences found, best first).

    Own ``templates`` are judged each for itself, also where their matches overlap.
    """
    schema = T.StructType([*docs.schema.fields, T.StructField("lic_words", T.LongType()), T.StructField("lic_found", FOUND)])
    known = docs.sparkSession.sparkContext.broadcast(_Compiled({**TEMPLATES, **texts()} if templates is None else templates))
    return docs.mapInArrow(_scan(known, coverage, templates is None), schema)
