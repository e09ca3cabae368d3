"""Operator 7: license scans by patience alignment.

A text and a license template are aligned as in a patience diff: words that occur
once in both are anchors, the longest increasing subsequence of their positions
is kept, and the gaps between the anchors are aligned the same way, down to equal
ends. Coverage is the aligned share of the template's words. A license is
reported where coverage reaches ``LEAST``.

A place begins at a word of the template and is at most ``SLACK`` template sizes
long (plus ``GAPS`` for a notice with a holder in it). Before aligning, places are
left out by exact bounds only: a stretch can reach the coverage only if it holds
that many words of the template, and a common subsequence of that length. Every
other place is aligned. Licenses that share most of their words are told apart by
the words in ``MUST``, which the alignment has to hold. Of places that overlap,
whatever their license (``NOTICES`` stand apart), the one with the most aligned words is reported, then the
better covered, the shorter, the first, and the license that sorts first; so a text
may report a license several times, back to back as well.

Defined edge cases: a null or empty text reports nothing; repeated rows each report;
a null id is carried through; a very long text is scanned whole; an empty table gives
an empty result; other columns are ignored; templates are a parameter.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

LEAST, SLACK = 0.8, 1.5
TOKEN = re.compile(r"\w+")

# Public license texts, notices and one-line statements.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-3-Clause-extra": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-short-line": "Licensed under CC BY 4.0.",
    "reserved-line": "Copyright. All rights reserved.",
    "rights-line": "All rights reserved.",
}
#: Words of a template that its alignment must hold, because related licenses differ in them.
MUST = {
    "Apache-2.0-line": "apache", "MIT-line": "mit", "GPL-2.0": "general 2", "GPL-3.0": "general 3", "AGPL-3.0": "affero 3", "LGPL-2.1": "lesser 2 1",
    "GPL-2.0-line": "general 2", "GPL-3.0-line": "general 3", "CC-BY-line": "attribution", "CC-BY-SA-line": "attribution sharealike", "CC-BY-NC-line": "by nc", "CC-BY-short-line": "by",
    "MPL-2.0": "mozilla", "EPL-2.0": "eclipse", "reserved-line": "copyright reserved", "rights-line": "rights reserved",
}
#: Words of years and holders that may stand in the notice.
GAPS = {"reserved-line": 20}
#: Notices name no license; each is reported beside whatever overlaps it.
NOTICES = frozenset(["reserved-line", "rights-line"])


def words(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, sorted by the first, that increases in the second."""
    tails: list[int] = []
    index: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        back.append(index[k - 1] if k else -1)
        if k == len(tails):
            tails.append(b)
            index.append(i)
        else:
            tails[k], index[k] = b, i
    out = []
    i = index[-1] if index else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a, b) -> list[tuple[int, int]]:
    """Aligned positions (in a, in b) of two sequences, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:  # equal ends
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        at_a, at_b = _once(a, a0, a1), _once(b, b0, b1)
        anchors = increasing(sorted((i, at_b[w]) for w, i in at_a.items() if w in at_b))
        pa_, pb_ = a0, b0
        for i, j in anchors:
            out.append((i, j))
            todo.append((pa_, i, pb_, j))
            pa_, pb_ = i + 1, j + 1
        if anchors:
            todo.append((pa_, a1, pb_, b1))
    return sorted(out)


def _once(x, lo: int, hi: int) -> dict:
    seen: dict = {}
    for i in range(lo, hi):
        seen[x[i]] = -1 if x[i] in seen else i
    return {w: i for w, i in seen.items() if i >= 0}


def places(mine: np.ndarray, size: int, least: float, gap: int = 0) -> list[tuple[int, int]]:
    """Every stretch of a text that can reach the coverage by its number of template words, which ``mine`` marks."""
    width = max(size, int(size * SLACK)) + gap
    total = np.concatenate([[0], np.cumsum(mine)])
    start = np.flatnonzero(mine)
    end = np.minimum(start + width, len(mine))
    ok = total[end] - total[start] >= least * size
    return list(zip(start[ok].tolist(), end[ok].tolist(), strict=True))


def growth(stretch: list[str], masks: dict[str, int], size: int) -> list[tuple[int, int]]:
    """(end, length) wherever the longest common subsequence with the template grows, by bits."""
    full = (1 << size) - 1
    v, n, out = full, 0, []
    for i, w in enumerate(stretch):
        u = v & masks.get(w, 0)
        if u:
            v = ((v + u) | (v - u)) & full
            if size - v.bit_count() > n:
                n += 1
                out.append((i + 1, n))
    return out


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None, least: float = LEAST):
        self.least = least
        self.templates = [(name, words(t)) for name, t in (templates or TEMPLATES).items()]
        self.distinct = [frozenset(t) for _, t in self.templates]
        self.every = frozenset().union(*self.distinct)
        self.must = [frozenset(MUST.get(name, "").split()) for name, _ in self.templates]
        self.masks = [{w: sum(1 << i for i, x in enumerate(t) if x == w) for w in t} for _, t in self.templates]

    def align(self, stretch: list[str], t: list[str], masks: dict[str, int]) -> list[tuple[int, int]]:
        """The best alignment of a stretch or of a shorter one with the same start, if it reaches the coverage."""
        need = self.least * len(t)
        grown = growth(stretch, masks, len(t))
        if not grown or grown[-1][1] < need:
            return []  # no alignment is longer than the longest common subsequence
        most, best = grown[-1][1], []
        tight = [e for e, n in reversed(grown) if n >= need]
        for e in tight:
            best = max(best, patience(stretch[:e], t), key=len)
            if len(best) == most:
                return best
        if len(best) < need:  # words that come again hide anchors; other ends may bare them
            for e in range(int(need), len(stretch) + 1):
                if stretch[e - 1] in masks or e == len(stretch):
                    best = max(best, patience(stretch[:e], t), key=len)
        return best if len(best) >= need else []

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, start, end, aligned words) by place."""
        got = words(text)
        common = self.every.intersection(got)
        out = []
        if not common:
            return out
        found = set()
        for (name, t), own, must, masks in zip(self.templates, self.distinct, self.must, self.masks, strict=True):
            # Each missing word costs at least one position of the template.
            if not must <= common or len(own - common) > (1 - self.least) * len(t):
                continue
            mine = np.fromiter((w in own for w in got), bool, len(got))
            for lo, hi in places(mine, len(t), self.least, GAPS.get(name, 0)):
                pairs = self.align(got[lo:hi], t, masks)
                if pairs and must <= {t[j] for _, j in pairs}:
                    found.add((-len(pairs), -len(pairs) / len(t), pairs[-1][0] - pairs[0][0] + 1, lo + pairs[0][0], name))
        taken: dict[str, bytearray] = {}
        for n, share, span, lo, name in sorted(found):
            mine = taken.setdefault(name if name in NOTICES else "license", bytearray(len(got)))
            if 1 not in mine[lo : lo + span]:
                mine[lo : lo + span] = b"\1" * span
                out.append((name, -share, lo, lo + span, -n))
        return sorted(out, key=lambda r: (r[2], r[0]))


FOUND = "doc_id long, license string, coverage double, word_start long, word_end long, n_aligned long"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """One row for each place where a license was found."""
    scanner = Scanner(templates, least)

    def run(batches):
        for batch in slices(batches):
            rows = [(d, *r) for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in scanner.scan(text)]
            if rows:
                kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "license", "coverage", "word_start", "word_end", "n_aligned"])

    return docs.select("doc_id", "text").mapInArrow(run, FOUND)


def op7(docs: DataFrame) -> DataFrame:
    return scan(docs)
