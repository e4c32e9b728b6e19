"""Licence scan by matching statistics over a generalised suffix automaton of licence tokens.

The automaton holds every substring of every template. A document's words stream through it; words outside the templates'
vocabulary reset it, so only runs of known words are stepped. Where the longest match cannot be extended and is long
enough, each of its places in the templates is a match. For each template, dynamic programming chains matches that advance in both text and
template within a gap so that the chain covers the most words of the template; the best chains that do not meet in the text are its spans. A template of which
enough is covered, half of it or ``ENOUGH`` words, gives its label. A stretch of text counts for the templates that hold its longest match.

Defined cases: a null text counts as empty: no words, no labels, score 0; repeated rows get equal results; an empty table gives an
empty result; texts are streamed whole; of chains that cover as much the first in the text counts; only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sourceloom.llm.text import blocks, letters_only, word_hashes, words_block

#: The phrases of the query's contract and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Texts of public licences, and the notices by which others are applied, with the label that a covered text gives.
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (
    "it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details. "
    "You should have received a copy of the GNU {0}General Public License along with this program. If not, see https://www.gnu.org/licenses/."
)
TEMPLATES = (
    ("mit", _MIT),
    ("bsd", _BSD_HEAD + _BSD_NAMES + _BSD_TAIL),
    ("bsd", _BSD_HEAD + _BSD_TAIL),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
            'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, '
            "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
               'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
               "See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify " + _GNU.format("")),
    ("gpl", "This program is free software: you can redistribute it and/or modify " + _GNU.format("Affero ")),
    ("gpl", "This program is free software: you can redistribute it and/or modify " + _GNU.format("Lesser ")),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
             "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
             "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
             "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."),
)
LONG = 4
GAP = 12
COVERED = 0.5
ENOUGH = 24  # covered words, where half of the template is more
_BETWEEN = letters_only()


class SuffixAutomaton:
    """Generalised over several token sequences; each state knows the places (sequence, end) where its strings occur."""

    def __init__(self, sequences: list[list[int]]):
        self.next, self.link, self.length = [{}], [-1], [0]
        places: list[set[tuple[int, int]]] = [set()]
        for number, sequence in enumerate(sequences):
            last = 0
            for end, token in enumerate(sequence, 1):
                last = self._extend(last, token, places)
                places[last].add((number, end))
        for state in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                places[self.link[state]] |= places[state]
        self.places = [sorted(p) for p in places]

    def _state(self, length: int, moves: dict, link: int, places: list) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        places.append(set())
        return len(self.length) - 1

    def _split(self, p: int, q: int, token: int, places: list) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], places)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, token: int, places: list) -> int:
        if token in self.next[last]:
            q = self.next[last][token]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, token, places)
        new, p = self._state(self.length[last] + 1, {}, 0, places), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, token, places)
        return new

    def maximal(self, tokens: list[int], least: int) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of the matching statistics that the next token does not extend."""
        state = size = 0
        for end, token in enumerate(tokens):
            grown = token in self.next[state]
            if not grown and size >= least:
                yield end, size, state
            while state and token not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if token in self.next[state]:
                state, size = self.next[state][token], size + 1
        if size >= least:
            yield len(tokens), size, state


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        hashes, first = word_hashes(words_block([t for _, t in templates]), between=_BETWEEN)
        self.labels = [label for label, _ in templates]
        self.vocabulary = np.unique(hashes)
        numbers = np.searchsorted(self.vocabulary, hashes).tolist()
        sequences = [numbers[a:b] for a, b in zip(first, first[1:])]
        self.sizes = [len(s) for s in sequences]
        self.automaton = SuffixAutomaton(sequences)
        hashes, first = word_hashes(words_block([p for p, _ in PHRASES]), between=_BETWEEN)
        self.phrases = [hashes[a:b] for a, b in zip(first, first[1:])]

    def base(self, hashes: np.ndarray) -> list[np.ndarray]:
        """For each phrase the places where its words stand."""
        out = []
        for phrase in self.phrases:
            at = np.flatnonzero(hashes == phrase[0])
            at = at[at + len(phrase) <= len(hashes)]
            for k in range(1, len(phrase)):
                at = at[hashes[at + k] == phrase[k]]
            out.append(at)
        return out

    def matches(self, hashes: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """For each template (end in the text, end in the template, length) of its matches, by the end in the text."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == hashes
        edge = np.diff(np.r_[False, known, False].astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = ends - starts >= LONG
        found: dict[int, list[tuple[int, int, int]]] = {}
        for a, b in zip(starts[long].tolist(), ends[long].tolist()):
            for end, size, state in self.automaton.maximal(at[a:b].tolist(), LONG):
                for number, stop in self.automaton.places[state]:
                    found.setdefault(number, []).append((a + end, stop, size))
        return found

    def spans(self, hashes: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(start, end, template, covered words) of the chains, words from 0."""
        out = []
        for number, found in self.matches(hashes).items():
            out += [(a, b, number, covered) for a, b, covered in chains(found)]
        return out


def chains(found: list[tuple[int, int, int]], gap: int = GAP) -> list[tuple[int, int, int]]:
    """(start, end, covered words) of the chains of one template's matches (end in the text, end in the template, length) that cover most and do not meet in the text.

    A match follows another that ends at most ``gap`` words before it begins, in the text and in the template, and adds the words by which it goes beyond it in both.
    """
    longest = max((size for *_, size in found), default=0)
    best: list[tuple[int, int]] = []  # covered, match before or -1
    recent: list[int] = []
    for k, (end, stop, size) in enumerate(found):
        recent = [j for j in recent if end - found[j][0] <= gap + longest]
        covered, before = size, -1
        for j in recent:
            d, t = end - found[j][0], stop - found[j][1]
            if d > 0 and t > 0 and d - size <= gap and t - size <= gap and best[j][0] + min(size, d, t) > covered:
                covered, before = best[j][0] + min(size, d, t), j
        best.append((covered, before))
        recent.append(k)
    out: list[tuple[int, int, int]] = []
    taken: list[tuple[int, int]] = []
    for k in sorted(range(len(found)), key=lambda k: (-best[k][0], found[k])):
        first = k
        while best[first][1] >= 0:
            first = best[first][1]
        a, b = found[first][0] - found[first][2], found[k][0]
        i = bisect_left(taken, (a, b))
        if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or taken[i][0] >= b):
            taken.insert(i, (a, b))
            out.append((a, b, best[k][0]))
    return sorted(out)


def license_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, places, spans): places of base phrases (label, start), chained spans (label, start, end, covered words and share)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        place = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
        span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64()), ("covered", pa.float64())]))
        for block in blocks(batches, text):
            hashes, first = word_hashes(block, between=_BETWEEN)
            places, spans = [], []
            for a, b in zip(first.tolist(), first[1:].tolist()):
                h = hashes[a:b]
                places.append([{"label": PHRASES[k][1], "start": s} for k, at in enumerate(scanner.base(h)) for s in at.tolist()])
                spans.append([{"label": scanner.labels[n], "start": s, "end": e, "words": c, "covered": c / scanner.sizes[n]} for s, e, n, c in sorted(scanner.spans(h))])
            cols = [block.rows.column(0), pa.array(np.diff(first), pa.int64()), pa.array(places, place), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n_words", "places", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, places array<struct<label:string,start:long>>, spans array<struct<label:string,start:long,end:long,words:long,covered:double>>"
    return docs.select(id_col, text).mapInArrow(scan, schema).withColumnRenamed("id", id_col)


def license_digest(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The scan as the query's columns; the score is the largest covered share that gives a label, and at least one half beside a base phrase; else 0."""
    found = license_spans(docs, id_col, text)
    return found.selectExpr(
        f"`{id_col}`", "n_words", "cast(size(places) as long) AS n_base",
        "array_min(transform(places, p -> p.start)) AS first_word", "array_max(transform(places, p -> p.start)) AS last_word",
        "array_join(array_sort(array_distinct(transform(places, p -> p.label))), ',') AS base_labels",
        f"array_join(array_sort(array_union(transform(places, p -> p.label), transform(filter(spans, s -> s.covered >= {COVERED}D or s.words >= {ENOUGH}), s -> s.label))), ',') AS labels",
        f"greatest(coalesce(array_max(transform(filter(spans, s -> s.covered >= {COVERED}D or s.words >= {ENOUGH}), s -> s.covered)), 0D), if(size(places) > 0, {COVERED}D, 0D)) AS score",
    )
