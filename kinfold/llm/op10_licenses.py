"""License scans: MinHash bands over overlapping text windows, then exact containment.

Texts and license templates are taken as sequences of five-word shingles. Windows of 1, 2, 4, ... shingles slide over a
text, those of more than four by a quarter of their size. A window is looked up by bands of its MinHash signature among the
windows, of the same size, of all templates; ROWS minima to a band and BANDS bands give a window of similarity 0.8 to a
template's window a chance of 1 - (1 - 0.8 ** ROWS) ** BANDS, over 0.9999999, to be retrieved. What is retrieved is then
verified: of the template's distinct shingles, compared word by word, CONTAINED percent must lie around the window. Every
occurrence counts: one ends where a shingle of the template comes once more than the template has it.

The signatures of a slice of texts are made together, in numpy: minima over a window of twice the size are minima of two
windows. Templates are few and part of this module (or a parameter); their tables go to every task.

Defined cases: null and empty texts and texts under five words match nothing; very long texts are scanned whole, in
stretches that overlap; what lies within another match is left out, of equal spans that with fewer of its template's
shingles, then that of the later template; repeated rows give repeated results; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, deque
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import WordHashes, keeps, map_texts, mix, shingle_hashes, table
from .op8_decontaminate import words_of

SHINGLE, CONTAINED = 5, 80
ROWS, BANDS, LARGEST = 2, 16, 32
#: Words that are hashed together.
STRETCH = 1 << 16
TABLE_BITS = 18

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.'
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."

#: (license, text). Wording of public licenses and of usual notices.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "This software is distributed under the terms of the MIT license."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", _BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("GPL-2.0", _GPL.format(name="General Public License", n="2")),
    ("GPL-3.0", _GPL.format(name="General Public License", n="3")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", _GPL.format(name="Lesser General Public License", n="3")),
    ("AGPL-3.0", _GPL.format(name="Affero General Public License", n="3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]


def chance(similarity: float, rows: int = ROWS, bands: int = BANDS) -> float:
    """That a window of this similarity is retrieved."""
    return 1 - (1 - similarity**rows) ** bands


_A = mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64)) | np.uint64(1)
_hashes = WordHashes()
keeps(__name__, _hashes.place.clear)


def minima(h: np.ndarray):
    """(size, band keys of all windows of so many shingles): keys[band, position], for sizes 1, 2, 4, ... LARGEST."""
    with np.errstate(over="ignore"):
        m = ((h[None, :] * _A[:, None]) >> np.uint64(32)).astype(np.uint32)
        w = 1
        while True:
            step = max(1, w // 4)
            some = m[:, ::step]
            yield w, (some[0::2] * np.uint32(0x9E3779B1)) ^ (some[1::2] * np.uint32(0x85EBCA77) + np.uint32(w)), step
            if w == LARGEST or m.shape[1] <= w:
                return
            m = np.minimum(m[:, :-w], m[:, w:])
            w *= 2


class Index:
    """Windows of the templates by size and band."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.names = [name for name, _ in templates]
        self.words = [words_of(text.encode()) for _, text in templates]
        self.shingles = [Counter(tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)) for w in self.words]
        self.maps: dict[int, np.ndarray] = {}
        self.keys: dict[int, list[dict[int, set[int]]]] = {}
        for t, words in enumerate(self.words):
            n = len(words) - SHINGLE + 1
            if n < 1:
                continue
            h = shingle_hashes(_hashes(words), SHINGLE)
            largest = 1 << (min(n, LARGEST).bit_length() - 1)
            with np.errstate(over="ignore"):
                m = ((h[None, :] * _A[:, None]) >> np.uint64(32)).astype(np.uint32)
            w = 1
            while w < largest:
                m = np.minimum(m[:, :-w], m[:, w:])
                w *= 2
            keys = (m[0::2] * np.uint32(0x9E3779B1)) ^ (m[1::2] * np.uint32(0x85EBCA77) + np.uint32(w))
            seen = self.maps.setdefault(w, np.zeros((BANDS, 1 << TABLE_BITS), dtype=bool))
            by = self.keys.setdefault(w, [{} for _ in range(BANDS)])
            for b in range(BANDS):
                seen[b, keys[b] >> np.uint32(32 - TABLE_BITS)] = True
                for k in keys[b].tolist():
                    by[b].setdefault(k, set()).add(t)

    def candidates(self, h: np.ndarray) -> list[tuple[int, int, int]]:
        """(first shingle, size, template) of the windows of h that share a band with a window of a template."""
        out = set()
        if not len(h):
            return []
        for w, keys, step in minima(h):
            if w not in self.maps:
                continue
            for b in range(BANDS):
                at = np.flatnonzero(self.maps[w][b][keys[b] >> np.uint32(32 - TABLE_BITS)])
                for p, k in zip(at.tolist(), keys[b][at].tolist(), strict=True):
                    for t in self.keys[w][b].get(k, ()):
                        out.add((p * step, w, t))
        return sorted(out)

    def verified(self, words: list[bytes], found: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """(template, first word, word after the last, permille of the template's shingles) of true matches."""
        regions: dict[int, list[list[int]]] = {}
        for p, w, t in found:
            n = len(self.words[t])
            a, b = max(0, p - n), min(len(words), p + w + SHINGLE - 1 + n)
            own = regions.setdefault(t, [])
            if own and a <= own[-1][1]:
                own[-1][1] = max(b, own[-1][1])
            else:
                own.append([a, b])
        return [x for t, own in regions.items() for a, b in own for x in self.occurrences(t, words, a, b)]

    def occurrences(self, t: int, words: list[bytes], a: int, b: int) -> list[tuple[int, int, int, int]]:
        """Matches of a template in words a to b, apart and in order.

        Hits are taken in one after the other. While they are too few for a match, those that come again, or lie more than
        three lengths of the template back, are dropped at the front; a match goes on until a hit comes once too often.
        """
        own, out = self.shingles[t], []
        need, reach = -(-CONTAINED * len(own) // 100), 3 * len(self.words[t]) + 2 * LARGEST
        held: deque[tuple[int, tuple]] = deque()
        seen: Counter = Counter()

        def close() -> None:
            if held and len(seen) >= need:
                out.append((t, held[0][0], held[-1][0] + SHINGLE, 1000 * len(seen) // len(own)))

        for i in range(a, b - SHINGLE + 1):
            g = tuple(words[i : i + SHINGLE])
            if g not in own:
                continue
            if len(seen) >= need and (seen[g] == own[g] or i - held[-1][0] > reach):
                close()
                held.clear()
                seen = Counter()
            held.append((i, g))
            seen[g] += 1
            while len(seen) < need and (seen[held[0][1]] > own[held[0][1]] or i - held[0][0] > reach):
                first = held.popleft()[1]
                seen[first] -= 1
                if not seen[first]:
                    del seen[first]
        close()
        return out


@lru_cache(4)
def index_of(templates: tuple[tuple[str, str], ...]) -> Index:
    return Index(list(templates))


def matches(texts: list[bytes], index: Index) -> list[list[tuple[str, int, int, int]]]:
    """(license, first word, word after the last, permille) of each text; what lies within another match is left out."""
    words = [words_of(x) for x in texts]
    found: list[list] = [[] for _ in texts]
    stretch: list[tuple[int, int, np.ndarray]] = []

    def flush() -> None:
        if not stretch:
            return
        starts = np.cumsum([0, *(len(h) for _, _, h in stretch)])
        for p, w, t in index.candidates(np.concatenate([h for _, _, h in stretch])):
            k = int(np.searchsorted(starts, p, "right")) - 1
            # A window over a border belongs to either side; verification looks at one text at a time.
            while k < len(stretch) and starts[k] < p + w:
                i, at, _ = stretch[k]
                found[i].append((max(0, p - int(starts[k])) + at, w, t))
                k += 1
        stretch.clear()

    held = 0
    for i, ws in enumerate(words):
        if len(ws) < SHINGLE:
            continue
        h = shingle_hashes(_hashes(ws), SHINGLE)
        for at in range(0, len(h), STRETCH):
            part = h[at : at + STRETCH + 2 * LARGEST]
            stretch.append((i, at, part))
            held += len(part)
            if held >= STRETCH:
                flush()
                held = 0
    flush()
    out = []
    for ws, f in zip(words, found, strict=True):
        got = index.verified(ws, sorted(f)) if f else []
        best, edge = [], -1
        # Those that begin earlier, or reach further, come first; what ends no later than one of them lies within it.
        for x in sorted(got, key=lambda x: (x[1], -x[2], -x[3], x[0])):
            if x[2] > edge:
                best.append(x)
                edge = x[2]
        out.append(sorted((index.names[t], a, b, c) for t, a, b, c in best))
    return out


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_matches", T.LongType()), T.StructField("licenses", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("best_permille", T.LongType())])


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = tuple(TEMPLATES)) -> DataFrame:
    """One row per row of docs (doc_id, text): licenses found, and license:first word:word after the last of each match."""

    def f(_, texts: list[bytes]) -> dict:
        got = matches(texts, index_of(templates))
        return {
            "n_matches": [len(x) for x in got], "licenses": [",".join(sorted({y[0] for y in x})) for x in got],
            "spans": [",".join(f"{n}:{a}:{b}" for n, a, b, _ in sorted(x, key=lambda y: (y[1], y))) for x in got], "best_permille": [max((y[3] for y in x), default=0) for x in got],
        }

    return map_texts(docs.select("doc_id", "text"), f, SCHEMA, as_bytes=True)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
