"""Licence scans by a generalised suffix automaton of licence words.

One automaton holds every template and every phrase. Texts stream through it: at each word it
gives the matching statistics, the length of the longest stretch ending there that some template
contains. A phrase stands wherever its state is on the suffix links of the current one. Stretches of
``LONG`` words or more chain, in order, into the span of the template that they cover.

Words that no template has, and pairs that no template has side by side, can't be in a match of
two words, so whole slices are reduced to the runs that can before the automaton walks them. Words
are compared by their bytes: a slice's distinct ones are looked up among the templates'.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernels, store

# The phrases of the contract and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Well-known notices, as their licences word them. GNU notices differ in a word or two,
# and so do the Creative Commons ones; of overlapping spans the best covered one stands.
_GNU = "{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, {2} any later version. {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details."
_NO_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _NO_WARRANTY + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("mit", "Licensed under the MIT license"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", _GNU.format("This program", "General Public License", "either version 3 of the License, or (at your option)")),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", _GNU.format("This library", "Lesser General Public License", "either version 2.1 of the License, or (at your option)")),
    ("lgpl", "licensed under the GNU Lesser General Public License, version 3"),
    ("agpl", _GNU.format("This program", "Affero General Public License", "either version 3 of the License, or (at your option)")),
    ("agpl", "licensed under the GNU Affero General Public License, version 3"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("bsd", _BSD_HEAD),
    ("bsd", _BSD_HEAD + " " + _BSD_TWO),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("boost", "Distributed under the Boost Software License, Version 1.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("cc0", "Licensed under CC0 1.0"),
    *((f"cc-{code}", f"Licensed under CC {code} {version}") for version in ("4.0", "3.0") for code in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")),
    *((f"cc-{code}", f"This work is licensed under a Creative Commons {name} {version} International License") for version in ("4.0",) for code, name in (("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nc", "Attribution-NonCommercial"), ("by-nd", "Attribution-NoDerivatives"), ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives"))),
)
#: Words in a long match; words of the text between chained matches; covered share of a template to be found.
LONG = 4
GAP = 12
COVERED = 0.7


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[bytes]:
    return [w.encode() for w in _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))]


class Automaton:
    """A generalised suffix automaton of word sequences. ends[s]: (sequence, index of its last
    word) of each place of the stretches of state s."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [set()]
        for n, words in enumerate(sequences):
            last = 0
            for at, w in enumerate(words):
                last = self._extend(last, w)
                s = last
                while s > 0:
                    self.ends[s].add((n, at))
                    s = self.link[s]
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):  # clones come late
            if self.link[s] > 0:
                self.ends[self.link[s]] |= self.ends[s]

    def _state(self, length: int, link: int, arrows: dict[int, int], ends: set) -> int:
        self.next.append(arrows)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(ends)
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), set(self.ends[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new = self._state(self.length[last] + 1, 0, {}, set())
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """State and match length after each word."""
        state = length = 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                length += 1
            yield state, length


class Scanner:
    def __init__(self, phrases: tuple, templates: tuple):
        self.sequences = [*phrases, *templates]
        self.n_phrases = len(phrases)
        split = [words_of(t) for t, _ in phrases] + [words_of(t) for _, t in templates]
        self.labels = [label for _, label in phrases] + [label for label, _ in templates]
        vocabulary = sorted({w for s in split for w in s})
        ids = {w: i for i, w in enumerate(vocabulary)}
        self.words = [[ids[w] for w in s] for s in split]
        self.automaton = Automaton(self.words)
        self.vocabulary = pa.array(vocabulary, pa.large_binary())
        self.pairs = np.zeros((len(vocabulary), len(vocabulary)), bool)
        for s in self.words:
            self.pairs[s[:-1], s[1:]] = True
        #: for each state, the phrases that its stretches may end with
        self.phrases = [[(n, len(self.words[n])) for n in range(self.n_phrases) if any(e == (n, len(self.words[n]) - 1) for e in ends)] for ends in self._chain_ends()]

    def _chain_ends(self) -> Iterator[set]:
        a = self.automaton
        for s in range(len(a.link)):
            out, t = set(), s
            while t > 0:
                out |= {e for e in a.ends[t] if e[0] < self.n_phrases and a.length[t] >= e[1] + 1 > a.length[a.link[t]]}
                t = a.link[t]
            yield out

    def runs(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, list[int]]]]:
        """Words of each text, and the runs of known neighbours: text, first word, word ids."""
        starts, ends, first = kernels.words(data, offsets, kernels.ALNUM)
        own, distinct = kernels.distinct(data, starts, ends, kernels.ALNUM)
        ids = np.append(pc.fill_null(pc.index_in(distinct, self.vocabulary), -1).to_numpy(zero_copy_only=False), -1)[own]
        side = (ids[:-1] >= 0) & (ids[1:] >= 0)
        side[first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(ids))] - 1] = False
        side &= self.pairs[ids[:-1], ids[1:]]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], side.view(np.int8), [0]])))
        text = np.searchsorted(first, edges[::2], "right") - 1
        return np.diff(first), [(t, a - int(first[t]), ids[a : b + 1].tolist()) for t, a, b in zip(text.tolist(), edges[::2].tolist(), edges[1::2].tolist(), strict=True)]

    def scan(self, runs: list[tuple[int, list[int]]]) -> list[tuple[str, int, int, float, bool]]:
        """Spans of one text: label, first word, end word, covered share, whether a phrase."""
        found, long = [], {}
        a = self.automaton
        for first, words in runs:
            stats = list(a.statistics(words))
            for i, (state, length) in enumerate(stats):
                for n, size in self.phrases[state]:
                    if size <= length:
                        found.append((self.labels[n], first + i + 1 - size, first + i + 1, 1.0, True))
                if length >= LONG and (i + 1 == len(stats) or stats[i + 1][1] != length + 1):
                    for n, at in a.ends[state]:
                        if n >= self.n_phrases:
                            long.setdefault(n, []).append((first + i + 1 - length, first + i + 1, at + 1 - length, at + 1))
        found += self._best([x for n, matches in sorted(long.items()) for x in self._chain(n, matches)])
        return sorted(found, key=lambda x: (x[1], x[2], not x[4], x[0]))

    @staticmethod
    def _best(spans: list[tuple[str, int, int, float, bool]]) -> list[tuple[str, int, int, float, bool]]:
        """Spans without those of which a better covered one of another label holds half the words;
        of equally covered ones the longer stands. Accepted ones of a label may overlap, so the
        nearest are found by start, back as far as the longest reaches."""
        out: list[tuple[str, int, int, float, bool]] = []
        starts: list[int] = []
        by_start: list[tuple[str, int, int, float, bool]] = []
        longest = 0
        for span in sorted(spans, key=lambda x: (-x[3], x[1] - x[2], x[1], x[0])):
            label, start, end, *_ = span
            low, high = bisect_left(starts, start - longest), bisect_left(starts, end)
            if not any(o[0] != label and 2 * (min(end, o[2]) - max(start, o[1])) > end - start for o in by_start[low:high]):
                at = bisect_right(starts, start)
                starts.insert(at, start)
                by_start.insert(at, span)
                longest = max(longest, end - start)
                out.append(span)
        return out

    def _chain(self, n: int, matches: list[tuple[int, int, int, int]]) -> list[tuple[str, int, int, float, bool]]:
        """Chains of matches in order in both text and template, best covered first, disjoint."""
        chains: list[list] = []  # start, end, template end, covered words
        for start, end, low, high in sorted(matches):
            best = [start, end, high, high - low]
            for c in reversed(chains):
                if c[1] < start - GAP - 2 * len(self.words[n]):
                    break
                skip = max(0, c[1] - start, c[2] - low)
                if start - c[1] <= GAP and c[0] < start and high > c[2] and skip < high - low and c[3] + high - low - skip > best[3]:
                    best = [c[0], end, high, c[3] + high - low - skip]
            chains.append(best)
        out: list[tuple[str, int, int, float, bool]] = []
        starts, ends = [], []  # of the accepted ones, in order; they are disjoint
        for start, end, _, covered in sorted(chains, key=lambda c: (-c[3], c[0])):
            share = covered / len(self.words[n])
            at = bisect_right(starts, start)
            if (at == 0 or ends[at - 1] <= start) and (at == len(starts) or starts[at] >= end):
                starts.insert(at, start)
                ends.insert(at, end)
                out.append((self.labels[n], start, end, min(1.0, share), False))
        return out


@cache
def scanner(phrases: tuple, templates: tuple) -> Scanner:
    return Scanner(phrases, templates)


SPANS = "array<struct<label:string,first_word:bigint,end_word:bigint,covered:double,base:boolean>>"
_ARROW = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("covered", pa.float64()), ("base", pa.bool_())])


def scan_licenses(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), phrases: tuple = PHRASES, templates: tuple = TEMPLATES) -> DataFrame:
    """The columns ``keep``, n_words and spans: every place of a phrase (base) and every chain of
    long matches with the share of its template that it covers; words count from 0.

    A-Z are lower-cased; words are runs of letters, digits and non-ASCII characters. Null or empty
    text: no words, no spans. Whole texts of any length are scanned; repeated rows get a result
    each; an empty table gives an empty one; other columns are dropped, so none can clash.
    """
    schema = store.widened(df, keep, f"n_words bigint, spans {SPANS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(phrases, templates)
        for batch in batches:
            for part in kernels.slices(batch, "_text"):
                data, offsets = kernels.texts(part.column("_text"))
                counts, runs = own.runs(kernels.LOWER[data], offsets)
                by_text: dict[int, list] = {}
                for t, first, ids in runs:
                    by_text.setdefault(t, []).append((first, ids))
                spans = [[dict(zip(_ARROW.names, x, strict=True)) for x in own.scan(by_text[i])] if i in by_text else [] for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(_ARROW))], schema.names)

    return kernels.in_tasks(df.select(*keep, F.col(text).alias("_text")), run, schema)
