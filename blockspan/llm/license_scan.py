"""License scans by winnowed fingerprints and banded alignment (operator 10).

Templates become words; hashes of ``k`` words in a row are winnowed (of each ``window``
hashes the least is kept) into an inverted index from hash to templates and places. It is
as large as the templates are and goes to every task. A document that has too few of a
template's words for the coverage, wherever they stand, is done with it. Else all of its
hashes are looked up; hits that lie on diagonals near each other, within a template's length, make
a candidate region. A banded alignment of the region's words with the template's words
reports what part of the template is there and where in the text.

Changed words can take away all kept hashes. But if d words may be missing, one of any
d + 1 is there: so the places of the template's d + 1 longest words (the rarest, mostly)
make further regions, in what the first regions leave.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequences import Words, mix

U = np.uint64

_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {title} as published by"
    " the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This"
    " program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty"
    " of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {title} for more details."
)
#: Notices, standard headers and parts of licenses. Whole texts of long ones
#: (Apache, GNU, MPL, CC) are not here; ``templates`` takes them.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        ' documentation files (the "Software"), to deal in the Software without restriction, including without limitation'
        " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and"
        " to permit persons to whom the Software is furnished to do so, subject to the following conditions"
    ),
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance'
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "BSD-grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met"
    ),
    "ISC-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT-warranty": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE'
        " WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR"
        " COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR"
        " OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSD-2-Clause-conditions": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following"
        " disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and"
        " the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "BSD-3-Clause-condition": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"
        " derived from this software without specific prior written permission."
    ),
    "BSD-disclaimer": (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,'
        " INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE"
        " DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,"
        " SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR"
        " SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,"
        " WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE"
        " OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
        " distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    **{f"{name}-header": _GNU.format(title=title, version=version) for name, title, version in (
        ("GPL-2.0", "GNU General Public License", 2), ("GPL-3.0", "GNU General Public License", 3),
        ("LGPL-3.0", "GNU Lesser General Public License", 3), ("AGPL-3.0", "GNU Affero General Public License", 3),
    )},
}


def grams(w: np.ndarray, k: int) -> np.ndarray:
    n = len(w) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    h = np.zeros(n, U)
    for i in range(k):
        h = mix(h ^ w[i : i + n].astype(U), i + 1)
    return h


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of each window, the rightmost of equals."""
    if len(h) <= window:
        return np.array([len(h) - 1 - int(h[::-1].argmin())]) if len(h) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(h, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - views.argmin(1))


@dataclass
class Index:
    """Winnowed fingerprints of all templates."""

    templates: dict[str, str]
    k: int
    window: int
    names: list[str] = field(init=False)
    words: list[np.ndarray] = field(init=False)
    places: dict[int, list[tuple[int, int]]] = field(init=False)
    coverage: float = 0.8

    def __post_init__(self) -> None:
        self.names = list(self.templates)
        self.words = [Words(t).ids for t in self.templates.values()]
        self.places = {}
        for t, w in enumerate(self.words):
            if len(w) < self.k:
                raise ValueError(f"template {self.names[t]} has fewer than {self.k} words")
            h = grams(w, self.k)
            # A template shorter than a window's reach keeps all its hashes.
            for at in winnow(h, self.window) if len(h) > 2 * self.window else range(len(h)):
                self.places.setdefault(int(h[at]), []).append((t, int(at)))
        self.known = np.array(sorted(self.places), U)
        if not self.words:
            return
        self.vocabulary = np.unique(np.concatenate(self.words))
        self.weights = np.stack([np.bincount(np.searchsorted(self.vocabulary, w), minlength=len(self.vocabulary)) for w in self.words])
        self.sizes = np.array([len(w) for w in self.words])
        # Place in the template and word, of as many words as can't all be missing.
        self.sure = []
        for t, w in zip(self.templates.values(), self.words, strict=True):
            need = sum(n < self.coverage * len(w) for n in range(len(w) + 1))  # fewest that suffice
            at = np.argsort(-Words(t).lengths, kind="stable")[: len(w) - need + 1]
            self.sure.append([(int(q), w[q]) for q in at])

    def possible(self, w: np.ndarray, coverage: float) -> np.ndarray:
        """Templates of whose words the text has enough, in any order."""
        return np.flatnonzero(self.weights @ np.isin(self.vocabulary, w) >= coverage * self.sizes)


def align(region: np.ndarray, template: np.ndarray, band: int) -> tuple[int, int, int]:
    """Longest common subsequence within ``band`` of any diagonal of the region's surplus:
    words matched, and the region's first and last matched word.

    Of equally long ones the one that ends first and begins last is taken.
    """
    n, m = len(region), len(template)
    width = band + max(0, n - m)
    score, begin = np.zeros(m + 1, np.int64), np.full(m + 1, -1, np.int64)
    best = (0, -1, -1)
    for i in range(n):
        equal = template == region[i]
        low, high = max(0, i - width), min(m, i + band + 1)
        equal[:low] = equal[high:] = False
        if not equal.any():
            continue
        new, first = score.copy(), begin.copy()
        for j in np.flatnonzero(equal):
            c, b = score[j] + 1, i if score[j] == 0 else begin[j]
            if c > new[j + 1] or c == new[j + 1] and b > first[j + 1]:
                new[j + 1], first[j + 1] = c, b
        # Carry maxima to the right.
        for j in range(1, m + 1):
            if new[j] < new[j - 1] or new[j] == new[j - 1] and first[j] < first[j - 1]:
                new[j], first[j] = new[j - 1], first[j - 1]
        score, begin = new, first
        if score[m] > best[0] or score[m] == best[0] and begin[m] > best[1]:
            best = (int(score[m]), int(begin[m]), i)
    return best


def regions(hits: list[tuple[int, int]], length: int, slack: int) -> list[tuple[int, int]]:
    """Word ranges that may hold the template, from hits (place in text, place in template)."""
    out: list[list[int]] = []
    for begin in sorted(p - q for p, q in hits):
        a, b = begin - slack, begin + length + slack
        if out and begin - out[-1][2] <= slack:
            out[-1][1], out[-1][2] = b, begin
        else:
            out.append([a, b, begin])
    return [(max(0, a), b) for a, b, _ in out]


def scan(text: str, index: Index, coverage: float) -> list[tuple[str, float, int, int]]:
    """Template, coverage and span (in characters) of each find."""
    words = Words(text)
    w = words.ids
    if not index.words:
        return []
    possible = index.possible(w, coverage)
    if not len(possible):
        return []
    h = grams(w, index.k)
    # Every hash is looked up, so that none depends on how a window falls.
    at = np.flatnonzero(index.known[np.searchsorted(index.known[:-1], h)] == h)
    hits: dict[int, list[tuple[int, int]]] = {t: [] for t in possible.tolist()}
    for p in at:
        for t, q in index.places[int(h[p])]:
            if t in hits:
                hits[t].append((int(p), q))
    found = []
    for t, own in hits.items():
        template, size = index.words[t], len(index.words[t])
        slack = max(2, size // 4)
        free = np.ones(len(w), bool)
        open_ = w.astype(np.int64)

        def held(parts: list[tuple[int, int]]) -> None:
            for a, b in parts:
                region = open_[a:b]
                if np.count_nonzero(np.isin(template, region)) < coverage * size:
                    continue
                matched, first, last = align(region, template, slack)
                if matched >= coverage * size:
                    found.append((index.names[t], matched / size, *words.span(a + first, a + last)))
                    taken.append((a + first, a + last + 1))

        taken: list[tuple[int, int]] = []
        held(regions(own, size, slack))
        for a, b in taken:
            free[a:b] = False
            open_[a:b] = -1
        held(regions([(int(p), q) for q, x in index.sure[t] for p in np.flatnonzero((w == x) & free)], size, slack))
    return sorted(found, key=lambda f: (f[2], -f[3], f[0]))


def _scan(batches: Iterator[pa.RecordBatch], index: Index, coverage: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[list] = [[] for _ in range(6)]
        for i, text in enumerate(batch["text"].to_pylist()):
            for nth, found in enumerate(scan(text, index, coverage) if text else ()):
                for column, value in zip(rows, (i, nth, *found), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int64(), pa.int64())
        columns = [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch["id"].take(columns[0]), *columns[1:]], ["id", "nth", "license", "coverage", "span_start", "span_end"])


def license_scan(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, str] | None = None,
    coverage: float = 0.8,
    k: int = 3,
    window: int = 4,
) -> DataFrame:
    """A row for each find of a license text: id, ``nth``, ``license``, ``coverage``,
    ``span_start``, ``span_end``.

    ``coverage`` is the part of the template's words that the text has in order, at least
    the one asked for; the span is in characters, its end exclusive. Case and punctuation
    make no difference. Finds are numbered in the order of the text; the same license found
    twice has two rows, templates that overlap are all reported. Null and empty texts have
    no rows, null ids stay null, repeated rows are each scanned, other columns (of whatever
    name) are not read, an empty table gives an empty one. ``templates`` stand in for the
    fixed ones; none at all find nothing; one of fewer than ``k`` words is a ValueError.
    """
    index = Index(TEMPLATES if templates is None else templates, k, window, coverage)
    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, nth int, license string, coverage double, span_start long, span_end long"
    return source.mapInArrow(lambda it: _scan(it, index, coverage), schema).withColumnRenamed("id", id_col)
