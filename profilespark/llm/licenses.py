"""License scans by patience alignment.

Where a text holds words that mark licences, the stretch around them is aligned with each template: words that occur once in both are
paired, the longest increasing subsequence of the pairs anchors the alignment, and the gaps between anchors are aligned in the same way;
a gap without such words falls back to its longest common run. The coverage is the share of the template's words that are aligned.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_size, plain, texts

COVERAGE = 0.8
REACH = 12  # words between marking words of one stretch, and around it
GAP = 0.5  # what a word between aligned words costs, an aligned word being worth one

# The wording of public licences and notices.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Released under the MIT License.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "BSD notice": "Released under the BSD License.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0 notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0 notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "EPL-2.0 notice": "Licensed under the Eclipse Public License, Version 2.0.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0 notice": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0 notice": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0 notice": "Licensed under CC BY-NC-ND 4.0.",
    "All rights reserved": "All rights reserved.",
}
# What tells a licence from those of like wording; each phrase must stand unbroken in the stretch found.
ANCHORS = {
    "GPL-3.0": ["gnu general public license", "version 3"],
    "GPL-3.0 notice": ["gnu general public license", "version 3"],
    "MPL-2.0": ["mozilla public license"],
    "Apache-2.0 notice": ["apache license version 2 0"],
    "MIT notice": ["mit license"],
    "CC-BY-NC-4.0 notice": ["cc by nc 4 0"],
    "GPL-2.0": ["gnu general public license", "version 2 of"],
    "GPL-2.0 notice": ["gnu general public license", "version 2"],
    "LGPL-2.1": ["gnu lesser general public license", "version 2 1"],
    "LGPL-3.0": ["gnu lesser general public license", "version 3"],
    "LGPL-3.0 notice": ["gnu lesser general public license", "version 3"],
    "AGPL-3.0": ["gnu affero general public license", "version 3"],
    "AGPL-3.0 notice": ["gnu affero general public license", "version 3"],
    "Unlicense": ["unencumbered software"],
    "BSD notice": ["bsd license"],
    "EPL-2.0 notice": ["eclipse public license version 2 0"],
    "CC-BY-4.0 notice": ["cc by 4 0"],
    "CC-BY-SA-4.0 notice": ["cc by sa 4 0"],
    "CC-BY-ND-4.0 notice": ["cc by nd 4 0"],
    "CC-BY-NC-SA-4.0 notice": ["cc by nc sa 4 0"],
    "CC-BY-NC-ND-4.0 notice": ["cc by nc nd 4 0"],
}
# Words of the templates that ordinary texts are full of, which mark nothing.
COMMON = set("a above all and any are as at be but by can either file following for form form free if in is it kind later law list may must not of on one or other person shall so software source subject terms that the this to under use v was where whom with without work writing you your 0 2 3 4 http https www org copy code version".split())
WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def licence_words(data: bytes) -> list[bytes]:
    """Runs of letters and digits, A-Z lower-cased."""
    return WORD.findall(data.lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of the pairs (in order of the first number) that rises in the second."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, x) in enumerate(pairs):
        pile = bisect_left(tops, x)
        before[k] = at[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(x)
            at.append(k)
        else:
            tops[pile], at[pile] = x, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _longest_run(t: list, x: list) -> tuple[int, int, int]:
    where: dict = {}
    for j, word in enumerate(x):
        where.setdefault(word, []).append(j)
    best, runs = (0, 0, 0), {}
    for i, word in enumerate(t):
        now = {}
        for j in where.get(word, ()):
            n = now[j] = runs.get(j - 1, 0) + 1
            if n > best[2]:
                best = (i - n + 1, j - n + 1, n)
        runs = now
    return best


def patience(t: list, x: list) -> list[tuple[int, int]]:
    """Aligned positions of equal words in ``t`` and ``x``, rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(t), 0, len(x))]
    while todo:
        t0, t1, x0, x1 = todo.pop()
        if t0 >= t1 or x0 >= x1:
            continue
        in_t, in_x = Counter(t[t0:t1]), Counter(x[x0:x1])
        place = {w: j for j, w in enumerate(x[x0:x1], x0) if in_x[w] == 1}
        anchors = _increasing([(i, place[w]) for i, w in enumerate(t[t0:t1], t0) if in_t[w] == 1 and w in place])
        if not anchors:
            i, j, n = _longest_run(t[t0:t1], x[x0:x1])
            anchors = [(t0 + i + k, x0 + j + k) for k in range(n)]
        if anchors:
            out += anchors
            edges = [(t0 - 1, x0 - 1), *anchors, (t1, x1)]
            todo += [(a[0] + 1, b[0], a[1] + 1, b[1]) for a, b in zip(edges, edges[1:])]
    return sorted(out)


def _best_stretch(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The part of an alignment worth most: a point an aligned word, less GAP for every word of the text in between."""
    best, best_value, start, value = (0, 0), 0.0, 0, 0.0
    for k, (_, x) in enumerate(pairs):
        value -= GAP * (x - pairs[k - 1][1] - 1) if k else 0
        if value <= 0:
            start, value = k, 0.0
        value += 1
        if value > best_value:
            best, best_value = (start, k + 1), value
    return pairs[best[0] : best[1]]


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float, anchors: dict[str, list[str]] | None = None) -> None:
        self.templates = {name: licence_words(text.encode()) for name, text in templates.items()}
        self.counts = {name: Counter(t) for name, t in self.templates.items()}
        self.anchors = {name: [f" {p} ".encode() for p in phrases] for name, phrases in (anchors or {}).items()}
        self.coverage = coverage
        known = {w for t in self.templates.values() for w in t}
        self.marks = {w for w in known if w.decode() not in COMMON}

    def __call__(self, data: bytes) -> list[tuple[str, int, int, int, float]]:
        """(template, aligned words, first word, word after the last, coverage) of the licences of a text, in order, without overlaps."""
        words = licence_words(data)
        if self.marks.isdisjoint(words):
            return []
        hits = [i for i, w in enumerate(words) if w in self.marks]
        out: list[tuple[str, int, int, int, float]] = []
        start = 0
        for k in range(1, len(hits) + 1):
            if k == len(hits) or hits[k] - hits[k - 1] > REACH:
                out += self._region(words, max(0, hits[start] - REACH), min(len(words), hits[k - 1] + REACH + 1))
                start = k
        return sorted(set(out), key=lambda r: (r[2], r[0]))

    def _told(self, name: str, words: list[bytes]) -> bool:
        """Whether the stretch holds every phrase that tells the licence from its likes."""
        text = b" " + b" ".join(words) + b" "
        return all(p in text for p in self.anchors.get(name, ()))

    def _region(self, words: list[bytes], lo: int, hi: int) -> list[tuple[str, int, int, int, float]]:
        found, todo = [], [(lo, hi)]
        while todo:
            lo, hi = todo.pop()
            part, best = words[lo:hi], None
            have = Counter(part)
            for name, t in self.templates.items():
                if sum(min(n, have[w]) for w, n in self.counts[name].items()) < self.coverage * len(t):
                    continue
                pairs = _best_stretch(patience(t, part))
                if pairs and len(pairs) >= self.coverage * len(t) and (best is None or len(pairs) > best[1]) and self._told(name, part[pairs[0][1] : pairs[-1][1] + 1]):
                    best = (name, len(pairs), lo + pairs[0][1], lo + pairs[-1][1] + 1, len(pairs) / len(t))
            if best:
                found.append(best)
                todo += [(lo, best[2]), (best[3], hi)]
        return found


def _scan(batches: Iterator[pa.RecordBatch], templates: dict[str, str], coverage: float, anchors: dict[str, list[str]]) -> Iterator[pa.RecordBatch]:
    scan = Scanner(templates, coverage, anchors)
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
    for batch in by_size(batches, "text"):
        source, rows = [], []
        for row, data in enumerate(texts(batch, "text")):
            for found in scan(data):
                source.append(row)
                rows.append(found)
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int64())), *columns], names=["doc_id", "license", "n_words", "start_word", "end_word", "coverage"])


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per licence found in a whole text: doc_id, license, n_words (aligned), start_word, end_word (exclusive), coverage.

    Words are runs of letters and digits, A-Z read as a-z. Of templates that fit the same stretch the one with most aligned words counts,
    of equals the first. Null and empty texts and those without licences have no rows; repeated rows and null ids are scanned like any
    other; an empty table gives an empty result; further columns are ignored.
    """
    source = plain(docs, doc_id=doc_id, text=text)
    chosen, anchors = (TEMPLATES, ANCHORS) if templates is None else (templates, {})
    return source.mapInArrow(lambda batches: _scan(batches, chosen, coverage, anchors), f"doc_id {dict(source.dtypes)['doc_id']}, license string, n_words int, start_word int, end_word int, coverage double")
