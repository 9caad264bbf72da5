"""Operator 2: license scans.

Each unit of a text (the whole text, its paragraphs, and their lines) is normalised to words and held against
licence templates by the Dice coefficient of their sets of word bigrams. A template can only reach the least
coefficient t if its set's size is between t / (2 - t) and (2 - t) / t times the unit's; others are pruned.
So are runs of adjoining sentences and lines, since a licence in a longer text is several paragraphs and a notice may stand in a
line; they count where they match better than units of comparable length that they overlap.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import records

_AS_IS = (
    "IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Short licence texts and customary notices, by SPDX identifier; whole texts of longer licences are in license_texts.
NOTICES: list[tuple[str, str]] = [
    ("MIT", "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE " + _AS_IS),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("ISC", "ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", _BSD_GRANT + " " + _BSD_END),
    ("BSD-3-Clause", _BSD_GRANT + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    *((f"CC-{kind}-4.0", f"Licensed under CC {kind} 4.0.") for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")),
    *((f"CC-{kind}-4.0", f"This work is licensed under a Creative Commons {name} 4.0 International License.") for kind, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"))),
]


def templates() -> list[tuple[str, str]]:
    """The notices, and each file of license_texts as (its name, its text)."""
    files = sorted((f for f in resources.files(__package__).joinpath("license_texts").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    return NOTICES + [(f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in files]


_WORD = re.compile(r"[^\W_]+")
_NOTICE = re.compile(r"^.{0,16}\bcopyright\b.{0,8}(\(c\)|©|[0-9]{4}).*$", re.I | re.M)
_SENTENCE = re.compile(r"[^\n]+?(?:[.!?](?=\s)|(?=\n)|\Z)")
_BLANK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")


def bigrams(text: str) -> set[str]:
    """The word bigrams of a text without its copyright lines, lower-cased; of a single word, the word."""
    words = _WORD.findall(_NOTICE.sub("", text).lower() if "opyright" in text or "OPYRIGHT" in text else text.lower())
    return set(map(" ".join, zip(words, words[1:]))) if len(words) > 1 else set(words)


class Scanner:
    def __init__(self, known: list[tuple[str, str]] | None = None, least: float = 0.8):
        self.least = least
        #: By size, so that those within a unit's bounds are a slice.
        self.sets = sorted(((name, bigrams(text)) for name, text in (templates() if known is None else known)), key=lambda x: len(x[1]))
        self.sizes = [len(g) for _, g in self.sets]
        self.known = set().union(*(g for _, g in self.sets))

    def best(self, grams: set[str]) -> tuple[float, str] | None:
        """The template of the largest coefficient, of equal ones the first by name, if that is large enough."""
        n, t = len(grams), self.least
        first = bisect.bisect_left(self.sizes, n * t, key=lambda m: m * (2 - t))
        last = bisect.bisect_right(self.sizes, n * (2 - t), key=lambda m: m * t)
        if first >= last or len(shared := grams & self.known) * (2 - t) < n * t:
            return None
        found = [(2 * len(shared & held) / (n + len(held)), name) for name, held in self.sets[first:last]]
        found = [x for x in found if x[0] >= t]
        return min(found, key=lambda x: (-x[0], x[1])) if found else None

    def scan(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """(start, end, licence, coefficient) of each unit that matches, in code points, by place."""
        text, out = text or "", {}

        def look(start: int, end: int) -> None:
            if (start, end) not in out and (hit := self.best(bigrams(text[start:end]))):
                out[start, end] = hit

        at, paragraphs = 0, []
        for gap in _BLANK.finditer(text):
            paragraphs.append((at, gap.start()))
            at = gap.end()
        paragraphs.append((at, len(text)))
        look(0, len(text))
        for start, end in paragraphs:
            if end - start < len(text):
                look(start, end)
            line = start
            for part in text[start:end].split("\n"):
                if len(part) < end - start:
                    look(line, line + len(part))
                line += len(part) + 1
        for start, end, name, score in self.runs(text, out):
            out[start, end] = (score, name)
        return [(s, e, name, score) for (s, e), (score, name) in sorted(out.items())]

    def runs(self, text: str, units: dict[tuple[int, int], tuple[float, str]]) -> list[tuple[int, int, str, float]]:
        """The best runs of adjoining sentences. A run counts unless a better or equal one, or such a unit, lies across it that is of comparable
        length: twice as long at most, or half as long at least. So a whole licence counts beside a notice that it holds."""
        t, shared = self.least, bigrams(text) & self.known
        if any(s == 0 and e == len(text) and score == 1 for (s, e), (score, _) in units.items()):
            return []  # nothing matches better
        # of a match, at least t / (2 - t) of the template's bigrams are in the text
        most = bisect.bisect_right(self.sizes, len(shared) * (2 - t), key=lambda m: m * t)
        held = [i for i in range(most) if len(shared & self.sets[i][1]) * (2 - t) >= self.sizes[i] * t]
        if not held:
            return []
        plain = _NOTICE.sub(lambda m: " " * len(m[0]), text) if "opyright" in text or "OPYRIGHT" in text else text
        places, words, of = [], [], []  # of each sentence its place; all words and the sentence of each
        said: list[tuple[str, ...]] = []
        for m in _SENTENCE.finditer(plain):
            if found := _WORD.findall(m[0].lower()):
                words += found
                of += [len(places)] * len(found)
                said.append(tuple(found))
                places.append((m.start() + len(m[0]) - len(m[0].lstrip()), m.start() + len(m[0].rstrip())))
        grams = list(map(" ".join, zip(words, words[1:])))
        first: dict[int, int] = {}
        for j, a in enumerate(of):
            first.setdefault(a, j)
        found = []
        for i in held:
            name, grams_of = self.sets[i]
            m = len(grams_of)
            for a in sorted({of[j] for j, g in enumerate(grams) if g in grams_of}):
                seen, k, best = set(), 0, None
                for j in range(first[a], len(words)):
                    if j + 1 == len(words) or of[j + 1] != of[j]:  # a sentence ends
                        score = 2 * k / (len(seen) + m)
                        if score >= t and (best is None or score >= best[0]):
                            best = (score, of[j])
                        # with what a later start has as well, going on can't be better
                        if j + 1 == len(words) or said[of[j + 1]] == said[a]:
                            break
                    if grams[j] not in seen:
                        if k == m:  # all are there: more can't be better
                            break
                        seen.add(grams[j])
                        k += grams[j] in grams_of
                        if len(seen) * t > m * (2 - t):
                            break
                if best:
                    found.append((-best[0], name, a, best[1]))
        taken = [(s, e, score) for (s, e), (score, _) in units.items()]

        def rival(s: int, e: int, score: float) -> bool:
            """Whether something at least as good, of comparable length, lies there already."""
            return any(a < e and s < b and other >= score and 2 * min(b - a, e - s) >= max(b - a, e - s) for a, b, other in taken)

        out = []
        for score, name, a, b in sorted(found):
            start, end = places[a][0], places[b][1]
            if not rival(start, end, -score):
                taken.append((start, end, 1.0))
                out.append((start, end, name, -score))
        return out


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None, least: float = 0.8, keep: bool = True, text: str = "text", key: str = "doc_id") -> DataFrame:
    """With the templates *known* (name, text), or those of templates(), one row per row of *docs*: key, license (of the best match, null if there is none), dice, n_matches, spans, and
    with *keep* matches (array of start, end, license, dice).

    Of equal coefficients the first match in the text counts. Null and empty texts match nothing. Every unit of a whole text is
    scanned, repeated rows each; other columns are not read; a null key stays null; an empty table gives no rows.
    """
    fields = "struct<license:string,dice:double,n_matches:int,spans:string" + ",matches:array<struct<start:int,end:int,license:string,dice:double>>" * keep + ">"
    kinds = {"license": pa.string(), "dice": pa.float64(), "n_matches": pa.int32(), "spans": pa.string()}
    if keep:
        kinds["matches"] = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("license", pa.string()), ("dice", pa.float64())]))

    @F.arrow_udf(fields)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(known, least)
        for texts in batches:
            rows = []
            for t in texts:
                hits = scanner.scan(t.as_py())
                top = max(hits, key=lambda h: h[3], default=(0, 0, None, 0.0))
                row = (top[2], top[3], len(hits), ",".join(f"{n}:{s}:{e}" for s, e, n, _ in hits))
                rows.append((*row, [dict(zip(("start", "end", "license", "dice"), h)) for h in hits]) if keep else row)
            yield records(rows, **kinds)

    return docs.select(F.col(key), found(F.col(text)).alias("_f")).select(key, "_f.*")
