"""License scans by patience alignment of texts with license templates.

Words are anchors if they are unique in both the text and the template; the longest increasing
subsequence of their places gives the frame of the alignment, and the gaps between its anchors
are aligned in the same way, where other words are unique. Coverage is the share of a template's
words that are aligned.

A text can hold a notice several times, or among words that repeat, so alignment runs on
regions: stretches around the template's key words (those that are rare in prose), of up to three
times the template. A set of key words is large enough that a text without any of them
cannot reach the coverage, so texts in which an automaton finds none are settled unread.

Every region of every template is found; of regions that overlap, the one with the most aligned
words stays, so a notice counts as the most specific of the templates that it matches.

Defined results: null and empty texts hold no license; repeated rows are scanned each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from mailweave.llm.common import held, parts

#: Share of a template's words that must be aligned.
COVERAGE = 0.85
#: The clauses that two licenses share, and the third of one of them.
_BSD = """
    Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
    conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
    this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
    distribution. {third} THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
    IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
    PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
    INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
    SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY
    OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
    OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
    promote products derived from this software without specific prior written permission."""
#: Notices and texts of well-known public licenses.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met"
    ),
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation"
    ),
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "Released under the MIT License.",
    "mit-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction"
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "proprietary": "All rights reserved. No part of this work may be reproduced without written permission.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "lgpl-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation"
    ),
    "agpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation"
    ),
    "mit-text": """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
        PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-text": """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
    "zlib-text": """
        This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
        any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the
        original software. If you use this software in a product, an acknowledgment in the product documentation would be
        appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. 3. This notice may not be removed or altered from any source
        distribution.""",
    "boost-1.0-notice": """
        Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute,
        and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the
        Software is furnished to do so, all subject to the following""",
    "bsd-2-clause-text": _BSD.format(third=""),
    "bsd-3-clause-text": _BSD.format(third=_BSD_THIRD),
}
#: Words that are too common in prose to be key words.
COMMON = frozenset(
    "a all an and any are as at be by can copy file following for form forms free general in is it may met no not of or "
    "other part person program public purpose reserved rights source subject terms that the this to use version with "
    "without work you".split()
)
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def longest_increasing(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect.bisect_left(tops, v)
        back.append(piles[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[k], piles[k] = v, i
    out = []
    i = piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned pairs (place in text, place in template), increasing in both."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:  # common start
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:  # common end
            b, d = b - 1, d - 1
            found.append((b, d))
        if a >= b or c >= d:
            continue
        many_a, many_b = Counter(text[a:b]), Counter(template[c:d])
        at = {w: i for i, w in enumerate(template[c:d], c) if many_b[w] == 1}
        both = [(i, at[w]) for i, w in enumerate(text[a:b], a) if many_a[w] == 1 and w in at]
        frame = [both[k] for k in longest_increasing([j for _, j in both])]
        if not frame:
            continue
        found += frame
        edges = [(a - 1, c - 1), *frame, (b, d)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges[:-1], edges[1:], strict=True)]
    return sorted(found)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float):
        import ahocorasick

        self.coverage = coverage
        self.templates = {k: words_of(t) for k, t in templates.items()}
        self.keys: dict[str, frozenset] = {}
        for name, words in self.templates.items():
            rare = sorted({w for w in words if w not in COMMON}, key=lambda w: (-len(w), w))
            chosen: set[str] = set()
            # until a text that has none of them misses too much
            for w in rare:
                if sum(x in chosen for x in words) > (1 - coverage) * len(words):
                    break
                chosen.add(w)
            if sum(x in chosen for x in words) <= (1 - coverage) * len(words):
                chosen = set(words)
            self.keys[name] = frozenset(chosen)
        self.automaton = ahocorasick.Automaton()
        for w in frozenset().union(*self.keys.values()):
            self.automaton.add_word(w, w)
        self.automaton.make_automaton()

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """Found licenses as (template, coverage, start, end) in code points, every occurrence of each template.

        A stretch of text that holds an occurrence is searched again on both sides of it.
        """
        if next(self.automaton.iter(text.lower()), None) is None:
            return []
        spans = [(m.start(), m.end(), m[0].lower()) for m in _WORD.finditer(text)]
        words = [w for _, _, w in spans]
        places: dict[str, list[int]] = {}
        every = frozenset().union(*self.keys.values())
        for i, w in enumerate(words):
            if w in every:
                places.setdefault(w, []).append(i)
        every_region: list[tuple[int, float, int, int, str]] = []
        for name, template in self.templates.items():
            hits = sorted(i for w in self.keys[name] for i in places.get(w, ()))
            reach, found, k = len(template), [], 0
            while k < len(hits):
                last = k
                while last + 1 < len(hits) and hits[last + 1] - hits[k] < reach:
                    last += 1
                todo = [(max(0, hits[k] - reach), min(len(words), hits[last] + reach + 1))]
                while todo:
                    a, b = todo.pop()
                    pairs = align(words[a:b], template)
                    share = len(pairs) / len(template)
                    if share >= self.coverage:
                        first, end = a + pairs[0][0], a + pairs[-1][0] + 1
                        found.append((share, first, end))
                        todo += [(a, first), (end, b)]
                k = last + 1
            # a stretch can mix copies: each place where a key word puts the template is tried by itself
            starts = {i - j for i in hits for j, w in enumerate(template) if w == words[i]}
            for a in sorted(x for x in starts if -reach < x):
                b, a = min(len(words), a + reach), max(0, a)
                pairs = align(words[a:b], template)
                if pairs and len(pairs) / len(template) >= self.coverage:
                    found.append((len(pairs) / len(template), a + pairs[0][0], a + pairs[-1][0] + 1))
            # regions of neighbouring stretches overlap: the higher share stays, then the shorter, then the first
            kept: list[tuple[int, int, float]] = []
            for share, first, end in sorted(set(found), key=lambda x: (-x[0], x[2] - x[1], x[1])):
                if all(end <= f or first >= e for f, e, _ in kept):
                    kept.append((first, end, share))
            every_region += [(-round(share * len(template)), -share, f, e, name) for f, e, share in kept]
        # the most aligned words first, then the higher coverage, the earlier place and the name
        best: list[tuple[int, int, str, float]] = []
        for _, less, f, e, name in sorted(every_region):
            at = bisect.bisect_left(best, (f,))
            if (at == len(best) or best[at][0] >= e) and (not at or best[at - 1][1] <= f):
                best.insert(at, (f, e, name, -less))
        return [(name, share, spans[f][0], spans[e - 1][1]) for f, e, name, share in best]



def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id and ``found``, the array of (template, coverage, start, end), of every row of ``docs``."""
    templates = dict(templates or TEMPLATES)
    key = (tuple(sorted(templates.items())), coverage)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = held(key, lambda: Scanner(templates, coverage))
        for pdf in parts(batches, keeps=key):
            found = [
                [{"template": n, "coverage": c, "start": s, "end": e} for n, c, s, e in scanner.scan(t)] if isinstance(t, str) else []
                for t in pdf["text"]
            ]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].array, "found": found})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(
        scan, f"doc_id {kind}, found array<struct<template: string, coverage: double, start: int, end: int>>"
    )
