"""Licence scan by a generalised suffix automaton of licence words.

The automaton holds every run of words of all templates.  A text is streamed through it word by word; the state and
the matched length at each word are its matching statistics: the longest run of template words that ends
there.  Whole phrases (the base phrases and licence names) are read off the states, as a phrase ends at
a word when its state is on the suffix path.  Runs that can not be extended and have at least ``least`` words are
anchors; anchors of one long template, in order in both the text and the template and at most ``gap`` words of
text apart, are chained so that they cover the most template words.  A chain that covers ``share`` of
its template is a span; of overlapping spans the one that covers most stays.

The score of a text is the largest over its spans and base phrases of (covered share) x w / (w + 2), w the covered words: a bare
"mit license" gives 0.5, a whole licence text nearly 1.

The templates are a parameter, broadcast with the function: some hundred bytes for each of their words (the given ones
have about two thousand).  A text is read in blocks of a megabyte; what is held of it is its anchors.

Defined results: a null or empty text has no words, null first and last words, empty labels and score 0; very
long texts are read whole; of spans that cover equally much of a text the earlier one, then the smaller label stays; repeated rows give equal rows; an
empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from typing import NamedTuple

from pyspark.sql import DataFrame

from siltstone.llm.common import hold, per_document
from siltstone.llm.words import word_blocks

#: Base phrases and their labels (fixed values).
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Names of licences; a name counts as a whole.
NAMES = {
    "mit": ["MIT License", "SPDX-License-Identifier: MIT"],
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "gpl-2.0": ["GNU General Public License, version 2", "GNU GPL version 2", "SPDX-License-Identifier: GPL-2.0"],
    "gpl-3.0": ["GNU General Public License, version 3", "GNU GPL version 3", "SPDX-License-Identifier: GPL-3.0"],
    "lgpl-2.1": ["GNU Lesser General Public License, version 2.1", "SPDX-License-Identifier: LGPL-2.1"],
    "lgpl-3.0": ["GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0"],
    "agpl-3.0": ["GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0"],
    "mpl-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "bsd-2-clause": ["BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"],
    "bsd-3-clause": ["BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"],
    "isc": ["ISC License", "SPDX-License-Identifier: ISC"],
    "zlib": ["zlib License", "SPDX-License-Identifier: Zlib"],
    "bsl-1.0": ["Boost Software License, Version 1.0", "SPDX-License-Identifier: BSL-1.0"],
    "epl-2.0": ["Eclipse Public License, Version 2.0", "Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0"],
    "unlicense": ["SPDX-License-Identifier: Unlicense"],
    "cc0-1.0": ["CC0 1.0", "SPDX-License-Identifier: CC0-1.0"],
}
#: Creative Commons names follow one rule.
_COMMONS = {"by": "Attribution", "sa": "ShareAlike", "nc": "NonCommercial", "nd": "NoDerivatives"}
for _kind in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"):
    for _version in ("3.0", "4.0"):
        _long = " ".join(_COMMONS[x] for x in _kind.split())
        NAMES[f"cc {_kind} {_version}".replace(" ", "-")] = [
            f"CC {_kind} {_version}", f"Creative Commons {_long} {_version}", f"licenses/{_kind.replace(' ', '-')}/{_version}"
        ]

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
_BSD_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED
TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def _gnu(name: str, version: str) -> str:
    """The notice that programs under a GNU licence carry."""
    return f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free
    Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it
    will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
    {name} for more details. You should have received a copy of the GNU {name} along with this program."""


#: Licence texts and notices; a part of them counts by the words it covers.
TEXTS = {
    "mit": [
        f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. {_WARRANTY}"""
    ],
    "isc": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
        WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
        LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE."""
    ],
    "bsd-2-clause": [f"{_BSD_CONDITIONS} {_BSD_WARRANTY}"],
    "bsd-3-clause": [f"{_BSD_CONDITIONS} {_BSD_NAME} {_BSD_WARRANTY}"],
    "apache-2.0": [
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
        obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License."""
    ],
    "gpl-2.0": [_gnu("General Public License", "2")],
    "gpl-3.0": [_gnu("General Public License", "3")],
    "lgpl-2.1": [_gnu("Lesser General Public License", "2.1")],
    "lgpl-3.0": [_gnu("Lesser General Public License", "3")],
    "agpl-3.0": [_gnu("Affero General Public License", "3")],
    "mpl-2.0": [
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at http://mozilla.org/MPL/2.0/."""
    ],
    "zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
        arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications,
        and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented;
        you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation
        would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being
        the original software. 3. This notice may not be removed or altered from any source distribution."""
    ],
    "bsl-1.0": [
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
        covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative
        works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"""
    ],
    "unlicense": [
        f"""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
        means. {_WARRANTY}"""
    ],
}


class Span(NamedTuple):
    """A covered template: words ``start`` to ``end`` (exclusive) of the text."""

    label: str
    start: int
    end: int
    covered: int
    share: float


class Automaton:
    """Generalised suffix automaton of phrases and long templates."""

    def __init__(self, phrases: list[tuple[str, str]], texts: list[tuple[str, str]], base: int) -> None:
        """``phrases`` and ``texts`` are (text, label); the first ``base`` phrases are counted as base phrases."""
        self.numbers: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        split = [[w for b in word_blocks(t) for w in b] for t, _ in (*phrases, *texts)]
        words = [[self.numbers.setdefault(w, len(self.numbers) + 1) for w in s] for s in split]
        for run in words:
            last = 0
            for w in run:
                last = self._extend(last, w)
        self.labels = [label for _, label in (*phrases, *texts)]
        self.sizes, self.base, first_text = [len(w) for w in words], base, len(phrases)
        #: Phrases that end wherever a state is reached, as (length, phrase), and places of long templates, as (template, end).
        self.phrases: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        self.places: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for n, run in enumerate(words):
            state = 0
            for end, w in enumerate(run, 1):
                state = self.next[state][w]
                if n >= first_text:
                    self.places[state].append((n, end))
            if n < first_text and run:
                self.phrases[state] += ((len(run), n),)
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for v in order:
            self.phrases[v] += self.phrases[self.link[v]]
        for v in reversed(order):
            self.places[self.link[v]] += self.places[v]
        self.places[0] = []

    def _state(self, length: int, link: int, to: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(to)
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """``q`` itself, if ``p`` and the word are its longest run; else a copy of it that is."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, p: int, w: int) -> int:
        if w in self.next[p]:
            return self._split(p, w, self.next[p][w])
        new = self._state(self.length[p] + 1, 0, {})
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w, self.next[p][w])
        return new

    def stream(self, text: str, least: int) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Number of words, whole phrases as (end, phrase), and maximal runs of ``least`` words or more as (end, state, length)."""
        get, following, link, length, phrases = self.numbers.get, self.next, self.link, self.length, self.phrases
        whole, runs = [], []
        at, v, n = 0, 0, 0
        for words in word_blocks(text):
            for at, w in enumerate([get(x, 0) for x in words], at + 1):
                if not w:
                    if n >= least:
                        runs.append((at - 1, v, n))
                    v = n = 0
                    continue
                to = following[v].get(w)
                if to is None:
                    if n >= least:
                        runs.append((at - 1, v, n))
                    while v and to is None:
                        v = link[v]
                        to = following[v].get(w)
                    n = length[v]
                    if to is None:
                        continue
                v, n = to, n + 1
                for size, phrase in phrases[v]:
                    if size <= n:
                        whole.append((at, phrase))
        if n >= least:
            runs.append((at, v, n))
        return at, whole, runs

    def chained(self, runs: list[tuple[int, int, int]], gap: int) -> dict[int, list[tuple[int, int, int]]]:
        """Per long template its chains as (start, end, covered words): for every anchor the best that ends in it."""
        out: dict[int, list[tuple[int, int, int]]] = {}
        near: dict[int, list[tuple[int, int, int, int]]] = {}
        for end, state, n in runs:
            for template, stop in self.places[state]:
                held = [c for c in near.get(template, ()) if c[0] >= end - n - gap]
                best = (n, end - n)
                for d, t, covered, start in held:
                    if d < end and t < stop:
                        best = max(best, (covered + min(n, end - d, stop - t), start))
                held.append((end, stop, *best))
                near[template] = held
                out.setdefault(template, []).append((best[1], end, best[0]))
        return out

    def spans(self, whole: list[tuple[int, int]], runs: list[tuple[int, int, int]], share: float, gap: int) -> list[Span]:
        """Spans of names and covered templates, in order; of overlapping ones the one that covers most."""
        found = [Span(self.labels[p], end - self.sizes[p], end, self.sizes[p], 1.0) for end, p in whole if p >= self.base]
        for template, chains in self.chained(runs, gap).items():
            size = self.sizes[template]
            found += [Span(self.labels[template], a, b, c, c / size) for a, b, c in chains if c >= share * size]
        starts: list[int] = []
        kept: list[Span] = []
        for s in sorted(set(found), key=lambda s: (-s.covered, -s.share, s.start, s.end, s.label)):
            i = bisect_left(starts, s.start)
            if not (i and kept[i - 1].end > s.start or i < len(kept) and starts[i] < s.end):
                starts.insert(i, s.start)
                kept.insert(i, s)
        return kept


_HELD: dict[tuple, Automaton] = {}


def _automaton(names: dict[str, list[str]], texts: dict[str, list[str]]) -> Automaton:
    """The one automaton a worker keeps."""
    hold("licences", _HELD.clear)
    phrases = [*BASE, *[(t, label) for label, all_ in names.items() for t in all_]]
    long = [(t, label) for label, all_ in texts.items() for t in all_]
    key = (tuple(phrases), tuple(long))
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Automaton(phrases, long, len(BASE))
    return _HELD[key]


def scan_licences(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", names: dict[str, list[str]] = NAMES, texts: dict[str, list[str]] = TEXTS,
    least: int = 4, share: float = 0.5, gap: int = 40,
) -> DataFrame:
    """One row per record: id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans, spans.

    ``names`` and ``texts`` map labels to whole phrases and to long templates.
    """

    def run(all_: list[str]) -> dict[str, list]:
        machine = _automaton(names, texts)
        out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_spans", "spans")}
        for text in all_:
            n, whole, runs = machine.stream(text, least)
            base = [(end - machine.sizes[p], p) for end, p in whole if p < machine.base]
            spans = machine.spans(whole, runs, share, gap) if whole or runs else []
            own = {machine.labels[p] for _, p in base}
            weights = [(1.0, machine.sizes[p]) for _, p in base] + [(s.share, s.covered) for s in spans]
            starts = [a for a, _ in base]
            row = (
                n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)),
                ",".join(sorted(own | {s.label for s in spans})), max((part * w / (w + 2) for part, w in weights), default=0.0),
                len(spans), [s._asdict() for s in spans],
            )
            for name, value in zip(out, row, strict=True):
                out[name].append(value)
        return out

    schema = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_spans long"
    return per_document(df, id_col, text_col, f"{schema}, spans array<struct<label:string,start:long,end:long,covered:long,share:double>>", run)
