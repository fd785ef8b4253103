"""Licence scan: a generalised suffix automaton of licence words, matching statistics, chains of long matches.

The automaton of all templates (a few thousand words; built once in each worker) reads a text's words as a stream and
knows, at every word, the longest stretch ending there that some template contains. Stretches that can't be extended and
have at least `least` words are placed in their templates and chained by dynamic programming: in order in text and template,
with gaps of at most `gap` words, overlaps trimmed, so that a chain covers as many template words as it can. Chains of a
template within as many words of one of them as the template has form one covered span; a span that covers the share `cover`
of the template's words, each counted once, gives its label.

Words outside the templates' vocabulary reset the automaton, so that only runs of vocabulary words are streamed one by one.
Base phrases (labels that always hold where a phrase stands) are found by comparing word hashes at every place.

Defined cases: null or empty text has no words: zeros, null places, empty labels, score 0. Repeated rows give repeated
results. Extra columns are ignored. Texts are read whole, whatever their length.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernel as K
from .support import fields, id_type, map_arrow

#: Phrases whose places are base labels.
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
#: Wording of licences and of the notices that refer to them.
TEMPLATES: dict[str, list[str]] = {
    "mit": [
        "released under the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "apache-2": [
        "licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "cc-by-nc": ["licensed under CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by": ["licensed under CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "gpl-3": [
        "licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "bsd-3": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "mpl-2": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "all-rights-reserved": ["all rights reserved"],
}
LEAST, GAP, COVER = 3, 12, 0.6


def word_hashes(text: str) -> np.ndarray:
    for _, _, hashed, _ in K.words(pa.array([text]), K.ALNUM):
        return hashed
    return np.zeros(0, np.uint64)


class Automaton:
    """Generalised suffix automaton over sequences of word numbers, with the places (sequence, end) of every state."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        places: list[set[tuple[int, int]]] = [set()]
        for k, sequence in enumerate(sequences):
            last = 0
            for end, word in enumerate(sequence, 1):
                last = self._extend(last, word, places)
                places[last].add((k, end))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.size[s]):
            places[self.link[state]] |= places[state]
        self.places = [sorted(p) for p in places]

    def _extend(self, last: int, word: int, places: list) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.size[q] == self.size[last] + 1 else self._clone(last, word, q, places)
        new = self._state(self.size[last] + 1, {}, 0, places)
        while last != -1 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last != -1:
            q = self.next[last][word]
            self.link[new] = q if self.size[q] == self.size[last] + 1 else self._clone(last, word, q, places)
        return new

    def _state(self, size: int, following: dict[int, int], link: int, places: list) -> int:
        self.next.append(following)
        self.size.append(size)
        self.link.append(link)
        places.append(set())
        return len(self.next) - 1

    def _clone(self, last: int, word: int, q: int, places: list) -> int:
        copy = self._state(self.size[last] + 1, dict(self.next[q]), self.link[q], places)
        self.link[q] = copy
        while last != -1 and self.next[last].get(word) == q:
            self.next[last][word] = copy
            last = self.link[last]
        return copy

    def matches(self, words: list[int], least: int) -> Iterator[tuple[int, int, int]]:
        """(state, length, end) of stretches of words that can't be extended to the right and have at least `least` words."""
        state = length = 0
        for i, word in enumerate(words):
            if length >= least and word not in self.next[state]:
                yield state, length, i
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
        if length >= least:
            yield state, length, len(words)


class Scanner:
    def __init__(self, templates: dict[str, list[str]], base: dict[str, str], least: int, gap: int, cover: float):
        self.least, self.gap, self.cover = least, gap, cover
        texts = [(label, t) for label, own in templates.items() for t in own] + list(base.items())
        hashed = [word_hashes(t) for _, t in texts]
        self.labels = [label for label, _ in texts]
        self.vocabulary = np.unique(np.concatenate(hashed))
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
        sequences = [np.searchsorted(self.vocabulary, h).tolist() for h in hashed]
        self.sizes = [len(s) for s in sequences]
        self.automaton = Automaton(sequences)
        self.base = [(label, np.searchsorted(self.vocabulary, word_hashes(t))) for label, t in base.items()]

    def numbers(self, hashed: np.ndarray) -> np.ndarray:
        """Numbers of the words in the vocabulary; -1 for others."""
        out = np.full(len(hashed), -1, np.int32)
        at = np.flatnonzero(self.filter[(hashed & np.uint64(0xFFFF)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.vocabulary, hashed[at]), len(self.vocabulary) - 1)
        good = self.vocabulary[place] == hashed[at]
        out[at[good]] = place[good]
        return out

    def phrases(self, numbers: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, str]]]:
        """Places (first word, label) of the base phrases in each document."""
        out: list[list[tuple[int, str]]] = [[] for _ in range(len(offsets) - 1)]
        for label, phrase in self.base:
            at = np.flatnonzero(numbers == phrase[0])
            at = at[at + len(phrase) <= len(numbers)]
            for k in range(1, len(phrase)):
                at = at[numbers[at + k] == phrase[k]]
            doc = np.searchsorted(offsets, at, "right") - 1
            inside = at + len(phrase) <= offsets[doc + 1]
            for d, a in zip(doc[inside].tolist(), (at - offsets[doc])[inside].tolist(), strict=True):
                out[d].append((a, label))
        return out

    def runs(self, numbers: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """(document, first word, numbers) of the runs of at least `least` vocabulary words."""
        at = np.flatnonzero(numbers >= 0)
        if not len(at):
            return
        doc = np.searchsorted(offsets, at, "right") - 1
        cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(doc) > 0)) + 1
        start, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]])
        for s, e in zip(start[end - start >= self.least].tolist(), end[end - start >= self.least].tolist(), strict=True):
            yield int(doc[s]), int(at[s] - offsets[doc[s]]), numbers[at[s] : at[s] + e - s].tolist()

    def spans(self, numbers: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int, int]]]:
        """(template, first word, last word + 1, covered words of the template) of the covered spans in each document."""
        matches: list[dict[int, list]] = [defaultdict(list) for _ in range(len(offsets) - 1)]
        for doc, first, words in self.runs(numbers, offsets):
            for state, length, end in self.automaton.matches(words, self.least):
                for template, to in self.automaton.places[state]:
                    matches[doc][template].append((first + end - length, first + end, to - length, to))
        return [sorted((span for t, m in own.items() for span in self._together(t, chains_of(m, self.gap))), key=lambda c: c[1:]) for own in matches]

    def _together(self, template: int, chains: list[list[tuple[int, int, int, int]]]) -> Iterator[tuple[int, int, int, int]]:
        """Chains near one another put together, starting from those that cover most."""
        size = self.sizes[template]
        chains = sorted(chains)
        starts = [c[0][0] for c in chains]
        free = [True] * len(chains)
        for k in sorted(range(len(chains)), key=lambda k: (-_covered(chains[k]), k)):
            if not free[k]:
                continue
            low, high = starts[k] - size, chains[k][-1][1] + size
            near = [i for i in range(bisect_left(starts, low), bisect_right(starts, high)) if free[i] and chains[i][-1][1] <= high]
            for i in near:
                free[i] = False
            pieces = [piece for i in near for piece in chains[i]]
            yield template, pieces[0][0], max(p[1] for p in pieces), _covered(pieces)


def _covered(pieces: list[tuple[int, int, int, int]]) -> int:
    """Template words in any of the pieces."""
    total = reached = 0
    for lo, hi in sorted(p[2:] for p in pieces):
        total += max(0, hi - max(lo, reached))
        reached = max(reached, hi)
    return total


def chains_of(matches: list[tuple[int, int, int, int]], gap: int) -> list[list[tuple[int, int, int, int]]]:
    """Chains of matches (start, end in the text; lo, hi in the template), the one that covers most first, each word of the text in one at most.

    A chain's matches follow one another in text and template. Where two overlap, the later one loses its first words. Of chains that
    cover equally many words, the one that ends first is taken. Only matches that end less than a gap before another's start, or within
    it, can come before it, so the work grows with matches times those in one such stretch.
    """
    matches = sorted(matches, key=lambda m: (m[1], m[3], m[0]))
    ends = [m[1] for m in matches]
    best, before, cut = [], [], []
    for j, (start, end, lo, hi) in enumerate(matches):
        score, link, lost = hi - lo, -1, 0
        for i in range(bisect_left(ends, start - gap, 0, j), j):
            _, end_i, _, hi_i = matches[i]
            trim = max(0, end_i - start, hi_i - lo)
            if trim < hi - lo and start + trim - end_i <= gap and best[i] + hi - lo - trim > score:
                score, link, lost = best[i] + hi - lo - trim, i, trim
        best.append(score)
        before.append(link)
        cut.append(lost)
    used = [False] * len(matches)
    taken: list[tuple[int, int]] = []
    out = []
    for j in sorted(range(len(matches)), key=lambda j: (-best[j], j)):
        chain = []
        while j >= 0 and not used[j]:
            used[j] = True
            start, end, lo, hi = matches[j]
            lost = cut[j]
            chain.append((start + lost, end, lo + lost, hi))
            j = before[j]
        chain.reverse()
        if not chain:
            continue
        at = bisect_left(taken, (chain[0][0], 0))
        inside = at < len(taken) and taken[at][0] < chain[-1][1] or at > 0 and taken[at - 1][1] > chain[0][0]
        if not inside:  # else another reading of words already taken
            insort(taken, (chain[0][0], chain[-1][1]))
            out.append(chain)
    return out


@lru_cache(4)
def _scanner(key: tuple) -> Scanner:
    templates, base, least, gap, cover = key
    return Scanner({k: list(v) for k, v in templates}, dict(base), least, gap, cover)


def scan_licences(
    docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, base: dict[str, str] = BASE, least: int = LEAST, gap: int = GAP, cover: float = COVER
) -> DataFrame:
    """A row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans: label, start and end (words) and share of the template covered, of every covered span that gives a label.
    """
    key = (tuple((k, tuple(v)) for k, v in templates.items()), tuple(base.items()), least, gap, cover)
    schema = fields(
        ("doc_id", id_type(docs)), ("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"),
        ("labels", "string"), ("score", "double"), ("spans", "array<struct<label:string,start:long,end:long,share:double>>"),
    )
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))

    def scan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        s = _scanner(key)
        for i, j, hashed, offsets in K.words(batch.column(1), K.ALNUM):
            numbers = s.numbers(hashed)
            rows = []
            for places, found in zip(s.phrases(numbers, offsets), s.spans(numbers, offsets), strict=True):
                known = {label for _, label in places}
                shares = [(s.labels[t], a, b, c / s.sizes[t]) for t, a, b, c in found]
                spans = [{"label": label, "start": a, "end": b, "share": x} for label, a, b, x in shares if x >= s.cover]
                labels = known | {x["label"] for x in spans}
                at = [a for a, _ in places]
                rows.append((len(places), min(at, default=None), max(at, default=None), ",".join(sorted(known)), ",".join(sorted(labels)), max([x[3] for x in shares], default=0.0), spans))
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.array(np.diff(offsets), pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=schema.names
            )

    return map_arrow(docs.select("doc_id", "text"), scan, schema)


ORACLE_SQL = None
