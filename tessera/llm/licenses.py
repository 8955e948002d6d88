"""License scans by patience alignment.

Where enough of a template can be, words that occur once in both the text and the template are anchors; their longest
increasing subsequence is kept, and the gaps between anchors are aligned the same way, down to gaps without anchors.
The aligned share of the template is its coverage.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from functools import lru_cache
from math import ceil

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches

WORD = re.compile(r"[^\W_]+")
#: Share of a template's words that must align, and share of the words of the span that must.
COVERAGE = 0.8
DENSITY = 0.5
#: Words that tell licenses of one wording apart, besides numbers: those of a template must all align.
TELLING = frozenset("affero lesser nc sa nd noncommercial sharealike".split())

# Well-known notices, as published.
BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
GNU_NOTICE = (
    "This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {license} License as published by the "
    "Free Software Foundation, either version {version} of the License, or (at your option) any later version."
)
CC_NOTICE = "This work is licensed under a Creative Commons {kind} {version} License."
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "MIT line": "Released under the MIT License.",
    "GPL-2.0 line": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0 line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS "
        "ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
        "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA "
        "OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": f"{BSD_TERMS} {BSD_DISCLAIMER}",
    "BSD-3-Clause": (
        f"{BSD_TERMS} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        f"derived from this software without specific prior written permission. {BSD_DISCLAIMER}"
    ),
    "GPL-2.0-or-later": GNU_NOTICE.format(work="program", license="General Public", version=2),
    "GPL-3.0-or-later": GNU_NOTICE.format(work="program", license="General Public", version=3),
    "LGPL-2.1-or-later": GNU_NOTICE.format(work="library", license="Lesser General Public", version="2.1"),
    "LGPL-3.0-or-later": GNU_NOTICE.format(work="library", license="Lesser General Public", version=3),
    "AGPL-3.0-or-later": GNU_NOTICE.format(work="program", license="Affero General Public", version=3),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/"
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means."
    ),
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "CC-BY-4.0": CC_NOTICE.format(kind="Attribution", version="4.0 International"),
    "CC-BY-SA-4.0": CC_NOTICE.format(kind="Attribution-ShareAlike", version="4.0 International"),
    "CC-BY-NC-4.0": CC_NOTICE.format(kind="Attribution-NonCommercial", version="4.0 International"),
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.",
}


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned positions of equal words, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: i for i, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        pairs = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place]
        anchors = increasing(pairs)
        out += anchors
        if anchors:
            for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
                todo.append((i + 1, k, j + 1, m))
    return sorted(out)


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs (ordered by the first) that increases in the second, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        before.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(j)
            piles.append(n)
        else:
            tops[at], piles[at] = j, n
    out, n = [], piles[-1] if piles else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


class Scanner:
    """Templates with their pivots: the longest words, so many that a sufficient coverage must hold one of them."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE, density: float = DENSITY):
        self.coverage, self.density = coverage, density
        self.templates = {name: words(text) for name, text in templates.items()}
        self.telling = {name: {w for w in own if w.isdigit() or w in TELLING} for name, own in self.templates.items()}
        self.pivots: dict[str, set[str]] = {}
        self.found = ahocorasick.Automaton()
        for name, own in self.templates.items():
            picked, missing = set(), len(own) - ceil(coverage * len(own))
            count = Counter(own)
            for word in sorted(count, key=lambda w: (-len(w), w)):
                picked.add(word)
                missing -= count[word]
                if missing < 0:
                    break
            self.pivots[name] = picked
            for word in picked:
                self.found.add_word(word, word)
        self.found.make_automaton()

    def scan(self, text: str | None) -> list[dict]:
        """Occurrences of templates in a whole text: license, first and last word (from 0), matched words, coverage."""
        low = (text or "").lower()
        hit = {word for _, word in self.found.iter(low)} if low else ()
        if not hit:
            return []
        own = WORD.findall(low)
        places: dict[str, list[int]] = {}
        for i, word in enumerate(own):
            if word in hit:
                places.setdefault(word, []).append(i)
        out = []
        for name, template in self.templates.items():
            reach = ceil(len(template) / self.density)
            at = sorted(i for w in self.pivots[name] for i in places.get(w, ()))
            out += self._windows(name, template, own, at, reach)
        return _widest(out)

    def _windows(self, name: str, template: list[str], own: list[str], at: list[int], reach: int) -> list[dict]:
        out, done = [], -1
        count, need = Counter(template), self.coverage * len(template)
        # The words of a template inside a window that slides from pivot to pivot, and how many of them it can use.
        inside, usable, start, stop = Counter(), 0, 0, 0
        for i in at:
            if i <= done:
                continue
            # An occurrence that holds this pivot and none before it lies within reach of it.
            low, high = max(done + 1, i - reach), min(len(own), i + reach + 1)
            if low >= stop:
                inside, usable, start, stop = Counter(), 0, low, low
            for word in own[stop:high]:
                if word in count:
                    usable += inside[word] < count[word]
                    inside[word] += 1
            for word in own[start:low]:
                if word in count:
                    usable -= inside[word] <= count[word]
                    inside[word] -= 1
            start, stop = low, high
            if usable < need or any(inside[w] < count[w] for w in self.telling[name]):
                continue
            pairs = self._held(name, patience(own[low:high], template), low, i, template)
            if inside[own[i]] > count[own[i]]:
                # The window may hold several copies, whose words are no anchors: this pivot is pinned, the others cut off.
                pinned = [self._held(name, self._pinned(template, own, i, j, low, high), 0, i, template) for j, w in enumerate(template) if w == own[i]]
                pairs = max([pairs, *pinned], key=lambda p: (2 * len(p) - (p[-1][0] - p[0][0] + 1), len(p)) if p else (-len(own), 0))
            if pairs:
                first, last = pairs[0][0], pairs[-1][0]
                out.append({"license": name, "first_word": first, "last_word": last, "matched": len(pairs), "coverage": len(pairs) / len(template)})
                done = last
        return out

    def _held(self, name: str, pairs: list[tuple[int, int]], low: int, i: int, template: list[str]) -> list[tuple[int, int]]:
        """The dense part of `pairs`, in words of the text, if it covers enough of the template, all its telling words
        among it, and spans word `i`."""
        pairs = [(low + a, b) for a, b in self._dense(pairs)]
        if len(pairs) < self.coverage * len(template) or not pairs[0][0] <= i <= pairs[-1][0]:
            return []
        return pairs if sum(template[b] in self.telling[name] for _, b in pairs) == sum(w in self.telling[name] for w in template) else []

    @staticmethod
    def _pinned(template: list[str], own: list[str], i: int, j: int, low: int, high: int) -> list[tuple[int, int]]:
        """Word `i` of the text aligned with word `j` of the template, and both sides of it up to where the word comes
        again more often than the template has it."""
        word = template[j]
        before, after = (side.count(word) for side in (template[:j], template[j + 1 :]))
        left = [k for k in range(i - 1, low - 1, -1) if own[k] == word]
        right = [k for k in range(i + 1, high) if own[k] == word]
        low = left[before] + 1 if len(left) > before else low
        high = right[after] if len(right) > after else high
        head = [(low + a, b) for a, b in patience(own[low:i], template[:j])]
        tail = [(i + 1 + a, j + 1 + b) for a, b in patience(own[i + 1 : high], template[j + 1 :])]
        return [*head, (i, j), *tail]

    def _dense(self, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The run of aligned words with the most of them less the words between, weighed so that its density suffices."""
        weight = self.density / (1 - self.density)
        best, kept, sum_, start, before = 0.0, (0, 0), 0.0, 0, 0
        for n, (a, _) in enumerate(pairs):
            sum_ -= weight * (a - before - 1)
            if sum_ <= 0:
                sum_, start = 0.0, n
            sum_, before = sum_ + 1, a
            if sum_ > best:
                best, kept = sum_, (start, n + 1)
        return pairs[slice(*kept)]


def _widest(found: list[dict]) -> list[dict]:
    """Of occurrences that overlap, the one with more matched words stays; ties go to the smaller name."""
    kept: list[dict] = []
    for f in sorted(found, key=lambda f: (-f["matched"], f["license"], f["first_word"])):
        if all(f["last_word"] < k["first_word"] or k["last_word"] < f["first_word"] for k in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: f["first_word"])


@lru_cache(maxsize=4)
def _scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(dict(templates))


def scan(df: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col, license, first_word, last_word, matched, coverage`: one row for each occurrence in each row of `df`.

    Null and empty texts hold none; null ids and repeated rows stay as they are; no row is shuffled; other columns are
    not read. An empty table gives an empty result.
    """
    fixed = tuple((templates or TEMPLATES).items())
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch: dict[str, list]) -> dict[str, list]:
        scanner = _scanner(fixed)
        rows = [(key, f) for key, text in zip(batch["key"], batch["text"], strict=True) for f in scanner.scan(text)]
        return {"key": [k for k, _ in rows]} | {n: [f[n] for _, f in rows] for n in ("license", "first_word", "last_word", "matched", "coverage")}

    source = df.select(df[id_col].alias("key"), df[text_col].alias("text"))
    return map_batches(source, run, f"key {kind}, license string, first_word long, last_word long, matched long, coverage double").select(F.col("key").alias(id_col), "license", "first_word", "last_word", "matched", "coverage")
