"""License scan by patience alignment.

Template and text are aligned as words. Words that stand once in both are anchors; the longest increasing run of them is kept; between
them the rest is aligned in the same way, after equal words at both ends of a gap. The share of the template's words that
found a partner is its coverage.

Where to align: to cover a template, a text must hold one word at least of any set of its words that
outnumbers the words it may miss. The longest such words are looked for by an automaton in one pass of each text; only places
around them are aligned, so texts without them cost no more than that pass.

Defined results: a row for each text and template whose coverage reaches the threshold, with the best place (the first of equals)
in code points of the text. Every place of a template that reaches the threshold counts: where places of templates overlap, that with the best fit (twice
the partners, by the words of template and place) stays, of equals the one with more words; a template's row is the best of its places that stay. Words are compared in lower case, other signs are ignored. Null and empty texts have no
row. Repeated rows give repeated rows, an empty table or no templates an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import ceil

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from vacantia.llm.common import keyed, ship, slices

WORD = re.compile(r"\w+")

# Notices and licenses as they are published.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to
endorse or promote products derived from this software without specific prior written permission.""",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "MIT notice": "Released under the MIT License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "MPL-2.0 header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
You can obtain one at https://mozilla.org/MPL/2.0/.""",
}


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, sorted by the first number, that increases in the second too."""
    tops, ends, back = [], [], [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        back[k] = ends[at - 1] if at else -1
        tops[at:at + 1], ends[at:at + 1] = [j], [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, increasing in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {a[i]: i for i in range(a0, a1)}
        anchors = increasing(sorted((place[b[j]], j) for j in range(b0, b1) if once_b[b[j]] == 1 and once_a[b[j]] == 1))
        for (i, j), (i2, j2) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True) if anchors else ():
            todo.append((i + 1, i2, j + 1, j2))
        out.extend(anchors)
    return sorted(out)


class Stretches:
    """Stretches of words that do not overlap."""

    def __init__(self) -> None:
        self.starts, self.ends = [], []

    def free(self, a: int, z: int) -> bool:
        k = bisect_left(self.starts, a)
        return (k == len(self.starts) or z < self.starts[k]) and (k == 0 or self.ends[k - 1] < a)

    def add(self, a: int, z: int) -> None:
        k = bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, z)


def settled(pool: list[tuple[float, int, str, int, int]]) -> list[tuple[float, int, str, int, int]]:
    """Of places (fit, partners, template, first word, last word), those that stay: none overlap, and no other could be added.

    A template puts forward the places with most partners, the first of equals; of those put forward the best fit stays.
    Where they lost, the template's other places come next.
    """
    kept, taken = [], Stretches()
    while pool:
        own: dict[str, Stretches] = defaultdict(Stretches)
        forward = []
        for x in sorted(pool, key=lambda x: (-x[1], x[3], x[4])):
            if own[x[2]].free(x[3], x[4]):
                own[x[2]].add(x[3], x[4])
                forward.append(x)
        for x in sorted(forward, key=lambda x: (-x[0], -x[1], x[2], x[3])):
            if taken.free(x[3], x[4]):
                taken.add(x[3], x[4])
                kept.append(x)
        pool = [x for x in pool if taken.free(x[3], x[4])]
    return kept


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float) -> None:
        self.threshold, self.words, self.seeds = threshold, {}, {}
        by: dict[str, set[str]] = defaultdict(set)
        for name, text in templates.items():
            words = WORD.findall(text.lower())
            if not words:
                continue
            self.words[name] = words
            spare, seeds = len(words) - ceil(threshold * len(words)), {}
            for w, n in sorted(Counter(words).items(), key=lambda x: (-len(x[0]), x[0])):
                if sum(seeds.values()) > spare:
                    break
                seeds[w] = n
            self.seeds[name] = seeds
            for w in seeds:
                by[w].add(name)
        self.automaton = ahocorasick.Automaton()
        for w, names in by.items():
            self.automaton.add_word(w, names)
        if by:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(template, coverage, start, end) of each template that the text covers."""
        if not text or not len(self.automaton):
            return []
        names = set().union(*(found for _, found in self.automaton.iter(text.lower())))
        if not names:
            return []
        places = [(m.start(), m.end()) for m in WORD.finditer(text)]
        words = [text[a:z].lower() for a, z in places]
        at: dict[str, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            at[w].append(i)
        pool = []
        for name in sorted(names):
            template, found = self.words[name], {}
            n, slack = len(template), max(3, len(template) // 4)
            starts = sorted({i - j for j, w in enumerate(template) if w in self.seeds[name] for i in at.get(w, ())})
            for s in starts:
                a = max(0, s - slack)
                pairs = patience(words[a:max(0, s + n + slack)], template)
                if pairs and len(pairs) >= self.threshold * n:
                    found[a + pairs[0][0], a + pairs[-1][0]] = max(len(pairs), found.get((a + pairs[0][0], a + pairs[-1][0]), 0))
            pool += [(2 * k / (n + z - a + 1), k, name, a, z) for (a, z), k in found.items()]
        best = {}
        for x in settled(pool):
            if x[2] not in best or (-x[1], x[3]) < (-best[x[2]][1], best[x[2]][3]):
                best[x[2]] = x
        return sorted((name, round(n / len(self.words[name]), 6), places[a][0], places[z][1]) for _, n, name, a, z in best.values())


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """``id, license, coverage, match_start, match_end``; the templates are a list given by the caller, not data."""
    ship(docs.sparkSession)
    rows = keyed(docs, id_col, text_col, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for b in slices(batches):
            take, found = [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                for m in scanner.scan(text):
                    take.append(k)
                    found.append(m)
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 4, (pa.string(), pa.float64(), pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), *columns], names=["id", "license", "coverage", "match_start", "match_end"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, license string, coverage double, match_start int, match_end int")
