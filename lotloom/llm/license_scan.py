"""Licence scan: a generalised suffix automaton of licence tokens, run over the words of each text.

The automaton holds every substring of every template. Streaming the words of a text through it
gives the matching statistics: at each word, the longest stretch of template words that ends
there. Long stretches are chained, in the order of the text and of the template, into covered
template spans; a template that is covered well enough is a label. A base phrase stands wherever
the stretch that ends at a word has the phrase as its end.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, vectext

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices of public licences, and the label that a covered notice gives.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "cc-by-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/.",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "apache-line": "Licensed under the Apache License, Version 2.0",
    "gpl-line": "This work is licensed under the GNU General Public License, version 3",
    "mit-line": "Released under the MIT License",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0",
}

#: Shortest stretch, in words, that a chain takes; largest gap in the text between two of them.
LEAST, GAP = 3, 12
#: Share of a template that a chain covers before its label is given.
COVERED = 0.6


def words_of(text: str | None) -> list[str]:
    """Words as the contract has them: A-Z lowered, then runs of 0-9, a-z and anything not ASCII."""
    out = vectext.Words(pa.array([text or ""], pa.large_string()))
    return [out.names[k] for k in out.codes]


class Automaton:
    """Suffix automaton of many token sequences; states are numbers, 0 is the start.

    ``ends[state]`` lists (sequence, place after its last token) for each occurrence of the
    state's substrings.
    """

    def __init__(self, sequences: list[list[int]]):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for number, sequence in enumerate(sequences):
            last = 0
            for place, token in enumerate(sequence, 1):
                last = self._grown(last, token)
                self.ends[last].append((number, place))
        for state in sorted(range(1, len(self.step)), key=self.longest.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]].extend(self.ends[state])
        self.ends = [sorted(set(x)) for x in self.ends]

    def _state(self, longest: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.longest.append(longest)
        self.link.append(link)
        self.ends.append([])
        return len(self.step) - 1

    def _split(self, above: int, token: int, target: int) -> int:
        """The state for above+token where its transition leads to something longer."""
        fresh = self._state(self.longest[above] + 1, dict(self.step[target]), self.link[target])
        self.link[target] = fresh
        while above >= 0 and self.step[above].get(token) == target:
            self.step[above][token] = fresh
            above = self.link[above]
        return fresh

    def _grown(self, last: int, token: int) -> int:
        there = self.step[last].get(token)
        if there is not None:  # another sequence has these tokens already
            return there if self.longest[there] == self.longest[last] + 1 else self._split(last, token, there)
        fresh, above = self._state(self.longest[last] + 1, {}, 0), last
        while above >= 0 and token not in self.step[above]:
            self.step[above][token] = fresh
            above = self.link[above]
        if above >= 0:
            target = self.step[above][token]
            self.link[fresh] = target if self.longest[target] == self.longest[above] + 1 else self._split(above, token, target)
        return fresh

    def statistics(self, tokens: list[int]) -> list[tuple[int, int]]:
        """(state, length of the longest stretch that ends there) for each token."""
        state, length, out = 0, 0, []
        for token in tokens:
            while state and token not in self.step[state]:
                state = self.link[state]
                length = self.longest[state]
            if token in self.step[state]:
                state, length = self.step[state][token], length + 1
            out.append((state, length))
        return out


class Scanner:
    """The automaton of base phrases and templates, ready to run over coded words."""

    def __init__(self, base: dict[str, str], templates: dict[str, str]):
        self.labels = [*base.values(), *templates]
        sequences = [words_of(x) for x in (*base, *templates.values())]
        self.number: dict[str, int] = {}
        for w in (w for s in sequences for w in s):
            self.number.setdefault(w, len(self.number))
        self.sizes = [len(s) for s in sequences]
        self.n_base = len(base)
        self.automaton = Automaton([[self.number[w] for w in s] for s in sequences])
        #: by state: base phrases that its longest substring ends with, those of shorter ends included
        self.phrases = [[k for k, end in ends if k < self.n_base and end == self.sizes[k] <= longest] for ends, longest in zip(self.automaton.ends, self.automaton.longest, strict=True)]
        for state in sorted(range(1, len(self.phrases)), key=self.automaton.longest.__getitem__):
            above = self.phrases[self.automaton.link[state]]
            self.phrases[state] = sorted({*self.phrases[state], *above})

    def runs(self, tokens: list[int], first: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Of one run of template words: base phrases (number, start), and long stretches (start, length, state)."""
        found, long, statistics = [], [], self.automaton.statistics(tokens)
        for place, (state, length) in enumerate(statistics):
            found += [(k, first + place + 1 - self.sizes[k]) for k in self.phrases[state] if self.sizes[k] <= length]
            if length >= LEAST and (place + 1 == len(statistics) or statistics[place + 1][1] <= length):
                long.append((first + place + 1 - length, length, state))
        return found, long

    def chained(self, long: list[tuple[int, int, int]]) -> dict[int, float]:
        """Template by number: the share of its words that the best chain covers."""
        best: dict[int, float] = {}
        by: dict[int, list[tuple[int, int, int]]] = {}
        for start, length, state in long:
            for k, end in self.automaton.ends[state]:
                if k >= self.n_base:
                    by.setdefault(k, []).append((start, end - length, length))
        for k, pieces in by.items():
            pieces.sort()
            worth: list[int] = []
            for i, (start, there, length) in enumerate(pieces):
                most = length
                for j in range(i - 1, -1, -1):
                    s, t, n = pieces[j]
                    if start - s > GAP + self.sizes[k]:
                        break
                    cut = max(0, s + n - start, t + n - there)
                    if s < start and t < there and cut < length and start - s - n <= GAP:
                        most = max(most, worth[j] + length - cut)
                worth.append(most)
            best[k] = min(1.0, max(worth) / self.sizes[k])
        return best


@functools.cache
def _scanner(base: tuple, templates: tuple) -> Scanner:
    return Scanner(dict(base), dict(templates))


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,words:long>>"


def license_scan(docs: DataFrame, base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text), scanned as a whole.

    n_base counts every place of every base phrase; first_word and last_word are the smallest and
    largest start of one, null where there is none. labels adds the templates of which a chain
    covers COVERED or more. score: 1 where a base phrase stands, else the largest share covered.
    spans: the base phrases and long stretches with the start and length in words.
    Null and empty texts have no words and score 0. Null or repeated ids stay as they are, each
    row with a result of its own. An empty table gives no rows. Other columns are not read. Nothing is shuffled.
    """
    scratch.small_batches(docs.sparkSession)
    known = (tuple(base.items()), tuple(templates.items()))

    def scanned(batches):
        scanner = _scanner(*known)
        for batch in batches:
            words = vectext.Words(vectext.filled(batch.column(1)))
            number = np.array([scanner.number.get(w, -1) for w in words.names], np.int64)
            token = number[words.codes] if len(words.codes) else np.zeros(0, np.int64)
            at = np.flatnonzero(token >= 0)
            owner = np.searchsorted(words.offsets, at, side="right") - 1
            found: dict[int, list] = {}
            if len(at):  # runs of template words that stand side by side in one text; one word alone is no phrase
                cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(owner) != 0)) + 1
                begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]])
                for b, e in zip(begin[end - begin > 1].tolist(), end[end - begin > 1].tolist(), strict=True):
                    doc = int(owner[b])
                    phrases, long = scanner.runs(token[at[b:e]].tolist(), int(at[b] - words.offsets[doc]))
                    if phrases or long:
                        kept = found.setdefault(doc, [[], []])
                        kept[0] += phrases
                        kept[1] += long
            rows = []
            for doc in range(batch.num_rows):
                phrases, long = found.get(doc, ((), ()))
                share = scanner.chained(long) if long else {}
                starts = [s for _, s in phrases]
                basic = sorted({scanner.labels[k] for k, _ in phrases})
                more = {scanner.labels[k] for k, x in share.items() if x >= COVERED}
                spans = [{"label": scanner.labels[k], "start": s, "words": scanner.sizes[k]} for k, s in phrases] + [{"label": None, "start": s, "words": n} for s, n, _ in long]
                rows.append((len(starts), min(starts, default=None), max(starts, default=None), ",".join(basic), ",".join(sorted({*basic, *more})), 1.0 if basic else max(share.values(), default=0.0), spans))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int64())])))
            made = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words.lengths, pa.int64()), *made], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scanned, SCHEMA)


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every document, against the base phrases and the notices."""
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
