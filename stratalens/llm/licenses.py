"""Licence notices and texts in documents, by Dice similarity of word bigrams with templates."""

from __future__ import annotations

import bisect
import math
import pkgutil
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stratalens.llm.text import only

#: Lowest similarity of a match.
MIN_DICE = 0.8

# Wording of public licences and of the notices that name them.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        'the Software.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
        "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
        "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at\n"
        "http://www.apache.org/licenses/LICENSE-2.0\n"
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        'on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
        "the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version.\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General "
        "Public License for more details.\nYou should have received a copy of the GNU General Public License along with "
        "this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "This document is confidential and proprietary. All rights reserved."),
]

#: Licences whose whole text is a file in ``license_texts``, beside the notices above.
WHOLE_TEXTS = (
    "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense", "CC0-1.0",
)
TEMPLATES += [(name, pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode("utf-8")) for name in WHOLE_TEXTS]

_WORD = re.compile(r"[^\W_]+")


class Match(NamedTuple):
    license: str
    dice: float
    first_line: int
    last_line: int


def bigrams(text: str) -> frozenset[tuple[str, str]]:
    """Pairs of neighbouring words of the normalised text: lower case, words only."""
    found = _WORD.findall(text.lower())
    return frozenset(zip(found, found[1:]))


def dice(a: frozenset, b: frozenset) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


class Templates:
    """Templates by size, and which of them hold a bigram."""

    def __init__(self, templates: Sequence[tuple[str, str]], min_dice: float) -> None:
        self.names = [name for name, _ in templates]
        self.sets = [bigrams(text) for _, text in templates]
        self.min_dice = min_dice
        self.holders: dict[tuple[str, str], list[int]] = defaultdict(list)
        for i, pairs in enumerate(self.sets):
            for pair in pairs:
                self.holders[pair].append(i)
        # Fewer common bigrams than this cannot reach the similarity, however tight the window.
        self.needs = [max(1, math.ceil(min_dice / (2 - min_dice) * len(s) - 1e-9)) for s in self.sets]
        # Two sets whose sizes are further apart than this cannot reach the similarity.
        self.reach = (2 - min_dice) / min_dice + 1e-9
        self.largest = max((len(s) for s in self.sets), default=0) * self.reach

    def best(self, unit: frozenset) -> tuple[str, float] | None:
        """The most similar template, with templates of unfit size left out before bigrams are compared."""
        size = len(unit)
        if not size or size > self.largest:
            return None
        shared: Counter[int] = Counter()
        for pair in unit & self.holders.keys():
            for i in self.holders[pair]:
                if size <= len(self.sets[i]) * self.reach and len(self.sets[i]) <= size * self.reach:
                    shared[i] += 1
        scored = [(2 * n / (size + len(self.sets[i])), -i) for i, n in shared.items()]
        top, place = max(scored, default=(0.0, 0))
        return (self.names[-place], top) if top >= self.min_dice else None

    def windows(self, i: int, pairs: list[tuple[str, str]]) -> list[tuple[float, int, int, list[int]]]:
        """The windows of ``pairs`` that are most like template ``i``, none overlapping another: (similarity,
        first, last, places of bigrams of the template)."""
        size, need = len(self.sets[i]), self.needs[i]
        number = {pair: k for k, pair in enumerate(dict.fromkeys(pairs))}
        at = [number[pair] for pair in pairs]
        mine = np.array([pair in self.sets[i] for pair in pairs])
        found, ranges = [], [(0, len(pairs))]
        while ranges:
            low, high = ranges.pop()
            places = np.flatnonzero(mine[low:high]) + low
            if len({at[p] for p in places.tolist()}) < need:
                continue
            best = sorted(self._from_each(at, mine, places, high, size), key=lambda w: (-w[0], w[1]))
            taken: list[tuple[int, int]] = []
            for score, first, last in best:
                k = bisect.bisect(taken, (first, last))
                if (k == 0 or taken[k - 1][1] < first) and (k == len(taken) or taken[k][0] > last):
                    taken.insert(k, (first, last))
                    found.append((score, first, last, (np.flatnonzero(mine[first : last + 1]) + first).tolist()))
            if taken:  # a window that gave way may leave a shorter one beside the better
                ranges += zip([low, *(last + 1 for _, last in taken)], [*(first for first, _ in taken), high])
        return found

    def _from_each(self, at: list[int], mine: np.ndarray, places: np.ndarray, high: int, size: int) -> Iterator[tuple[float, int, int]]:
        """The best window that begins at each of ``places``. A bigram counts once in a window: where its
        first occurrence leaves, the next one starts to count."""
        low = int(places[0])
        after: dict[int, int] = {}
        follows = [0] * (high - low)
        for p in range(high - 1, low - 1, -1):
            follows[p - low] = after.get(at[p], -1)
            after[at[p]] = p
        new = np.zeros(high - low)
        new[[p - low for p in after.values()]] = 1
        hits = new * mine[low:high]
        gone = low
        for first in places.tolist():
            for p in range(gone - low, first - low):
                if follows[p] >= 0:
                    new[follows[p] - low] = 1
                    hits[follows[p] - low] = mine[follows[p]]
            gone = first
            reach = int(size * self.reach) + 2
            while True:
                here = slice(first - low, first - low + reach)
                within = np.cumsum(new[here])
                # Windows of more different bigrams than fit the size bound cannot match.
                if within[-1] > size * self.reach or first + reach >= high:
                    break
                reach *= 2
            shared = np.cumsum(hits[here])
            scores = 2 * shared / (within + size)
            top = int(np.argmax(scores))
            if scores[top] >= self.min_dice - 1e-12:
                yield float(scores[top]), first, first + top

    def scan(self, text: str | None) -> list[Match]:
        """Matches of the windows over the words of the whole text that are most like each template.

        A window may begin and end at any word, in the middle of a line or of a paragraph. Of matches on
        the same words, the one with more common bigrams stays, then the more similar one.
        """
        lower = (text or "").lower()
        found = _WORD.findall(lower)
        common: Counter[int] = Counter()
        for pair in set(zip(found, found[1:])) & self.holders.keys():
            common.update(self.holders[pair])
        likely = [i for i, n in common.items() if n >= self.needs[i]]
        if not likely:
            return []
        pairs = list(zip(found, found[1:]))
        windows = [(len({pairs[p] for p in places}), *w, places, i) for i in likely for *w, places in self.windows(i, pairs)]
        if not windows:
            return []
        starts = [m.start() for m in _WORD.finditer(lower)]
        breaks = [m.start() for m in re.finditer("\n", lower)]
        line = lambda word: bisect.bisect(breaks, starts[word])
        chosen, used = [], set()
        for _, score, first, last, places, i in sorted(windows, key=lambda w: (-w[0], -w[1], w[2], w[-1])):
            if 2 * len(used.intersection(places)) <= len(places):
                used.update(places)
                chosen.append((first, Match(self.names[i], score, line(first), line(last + 1))))
        return [match for _, match in sorted(chosen)]


def scan_licenses(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = tuple(TEMPLATES),
    min_dice: float = MIN_DICE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, matches`` for every row of ``docs``: structs of license, dice, first and last line.

    The templates are a parameter of fixed size that every task holds. Rows are read where they lie;
    nothing is shuffled. Windows over the words of the whole text are compared by the Dice coefficient of their
    sets of word bigrams; a template of which the text has fewer bigrams than ``min_dice`` asks for is never compared.

    Edge cases: null, empty and one-word texts match nothing; ties between templates go to the first one;
    every row is judged by its own text; an empty table gives an empty result; other columns are ignored.
    """
    base = only(docs, doc_id=id_col, text=text_col)
    known = list(templates)
    match = pa.struct(
        [("license", pa.string()), ("dice", pa.float64()), ("first_line", pa.int64()), ("last_line", pa.int64())]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Templates(known, min_dice)
        for batch in batches:
            found = [[m._asdict() for m in scanner.scan(text.as_py())] for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(match))], ["doc_id", "matches"])

    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(
        scan,
        f"doc_id {kind}, matches array<struct<license: string, dice: double, first_line: bigint, last_line: bigint>>",
    )
