"""Licence scans by patience alignment (operator 5).

Texts and templates are compared as lower-cased words without punctuation.  The places of a template's
telling words (its words outside a short list of common ones) are put together in passages, and every
passage is aligned with the template: equal words at both ends are matched; words that occur once in the
passage and once in the template are anchors; the longest increasing subsequence of anchors stays, and
the gaps between anchors are aligned in the same way.  Coverage is the matched share of the template.
Only what can't reach the asked coverage is skipped: texts that lack too many of the telling words, and
places from where too few of the template's words follow.  A passage may hold several notices: from each
place stretches of about a template's length are aligned, the best is taken and both sides are searched on.
Each text is scanned whole in the task that reads it; templates are a short parameter.

Defined results: a null text has no words and no licence; a text of any length is scanned whole; of equal coverage the first template in the
table is named; repeated rows are scanned one by one; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Names and wording of licence notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MIT-line", "Released under the MIT License."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)
COMMON = frozenset("the a an of and or to in is it this you for with by on at are be as not if from any under can was one".split())
TOKEN = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
Pair = tuple[int, int]


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def longest_increasing(pairs: list[Pair]) -> list[Pair]:
    """The longest run of pairs, given in order of their first place, whose second places increase."""
    tops: list[int] = []  # least last place of an increasing run of each length
    last: list[int] = []
    before: list[int] = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        if at == len(tops):
            tops.append(j)
            last.append(k)
        else:
            tops[at], last[at] = j, k
        before[k] = last[at - 1] if at else -1
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[Pair]:
    """Places of a and b that patience alignment matches, in order."""
    found: list[Pair] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            found.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        place_a, place_b = once(a, i, i_end), once(b, j, j_end)
        anchors = longest_increasing(sorted((p, place_b[w]) for w, p in place_a.items() if w in place_b))
        if anchors:
            found += anchors
            ends = [*anchors, (i_end, j_end)]
            starts = [(i, j), *((p + 1, q + 1) for p, q in anchors)]
            todo += [(p, p_end, q, q_end) for (p, q), (p_end, q_end) in zip(starts, ends, strict=True)]
    return sorted(found)


def once(words: list[str], low: int, high: int) -> dict[str, int]:
    """Places of the words that occur once in words[low:high]."""
    place: dict[str, int] = {}
    twice = set()
    for k in range(low, high):
        w = words[k]
        if w in place:
            twice.add(w)
        else:
            place[w] = k
    return {w: k for w, k in place.items() if w not in twice}


def passages(places: list[int], reach: int, size: int) -> Iterator[tuple[int, int]]:
    """Word ranges around places that follow each other within ``reach`` words."""
    start = 0
    for k in range(1, len(places) + 1):
        if k == len(places) or places[k] - places[k - 1] > reach:
            yield max(0, places[start] - reach), min(size, places[k - 1] + reach + 1)
            start = k


class Template:
    """A template's words, of which ``need`` are to be matched."""

    def __init__(self, name: str, words: list[str], least: float):
        self.name, self.words = name, words
        self.need = next((n for n in range(1, len(words) + 1) if n >= least * len(words)), len(words) + 1)
        self.missing = len(words) - self.need
        self.want = Counter(words)
        self.telling = frozenset(words) - COMMON
        if sum(w not in self.telling for w in words) >= self.need:
            self.telling = frozenset(words)
        # as far as telling words are apart if as many as may be missing are
        at = [k for k, w in enumerate(words) if w in self.telling]
        self.reach = max(4, len(words) // 4, *(y - x for x, y in zip(at, at[self.missing + 1 :], strict=False)))

    def bounds(self, words: list[str], low: int, high: int) -> list[int]:
        """For each place the most words that can be matched in the longest stretch from there."""
        size = len(self.words) + 2 * self.reach
        have: Counter[str] = Counter()
        total, out = 0, []
        for k in range(high - 1, low - 1, -1):
            if k + size < high and (w := words[k + size]) in self.want:
                have[w] -= 1
                total -= have[w] < self.want[w]
            if (w := words[k]) in self.want:
                total += have[w] < self.want[w]
                have[w] += 1
            out.append(total)
        return out[::-1]

    def aligned(self, words: list[str], low: int, high: int) -> tuple[int, int, int] | None:
        """Matched words, minus the length and the first place, if as many are matched as needed."""
        pairs = align(words[low:high], self.words)
        return (len(pairs), pairs[0][0] - pairs[-1][0] - 1, low + pairs[0][0]) if len(pairs) >= self.need else None

    def best(self, words: list[str], places: Iterable[int], high: int) -> tuple[int, int, int] | None:
        """The most words matched, then the shortest and first notice, among those from the first that is found to one length later."""
        n, best, stop = len(self.words), None, high
        for k in places:
            if k >= stop:
                break
            for size in (n, n + self.reach, n + 2 * self.reach):
                if found := self.aligned(words, k, min(k + size, high)):
                    stop = min(stop, k + n)
                    if best is None or found[:2] > best[:2]:
                        best = found
                if k + size >= high:
                    break
            if best and best[:2] == (n, -n):
                break
        return best

    def notices(self, words: list[str], low: int, high: int) -> list[tuple[int, int, int]]:
        """First word, last (exclusive) and matched words of all notices in a passage, in order."""
        out: list[tuple[int, int, int]] = []
        todo: list[tuple[int, int, list[int] | None]] = [(low, high, None)]
        while todo:
            low, high, places = todo.pop()
            if high - low < self.need:
                continue
            # behind a notice the bounds are those from before it, since they look ahead only
            start = bisect_left(places, low) if places is not None else 0
            if places is None or start == len(places):
                if sum((Counter(w for w in words[low:high] if w in self.want) & self.want).values()) < self.need:
                    continue
            if places is None:
                places = [k for k, n in enumerate(self.bounds(words, low, high), low) if n >= self.need and words[k] in self.want]
            ahead = (places[i] for i in range(start, len(places)))
            found = self.best(words, ahead, high) or self.aligned(words, low, high)
            if found:
                first, end = found[2], found[2] - found[1]
                out.append((first, end, found[0]))
                todo += [(low, first, None), (end, high, places)]
        return sorted(out)


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.templates = [(name, tokens(text)) for name, text in templates]
        self.plans: dict[float, tuple[list[Template], frozenset[str]]] = {}

    def scan(self, text: str, least: float) -> list[tuple[str, int, int, int, float]]:
        """licence, first and last word (exclusive), matched words and coverage of each notice that covers ``least`` of a template."""
        if least not in self.plans:
            made = [Template(name, words, least) for name, words in self.templates if words]
            self.plans[least] = made, frozenset().union(*(t.telling for t in made))
        templates, telling = self.plans[least]
        words = tokens(text)
        hits = [k for k, w in enumerate(words) if w in telling]
        found = []
        for t in templates:
            mine = [k for k in hits if words[k] in t.telling]
            if len(t.telling) - len({words[k] for k in mine}) > t.missing:
                continue
            for low, high in passages(mine, t.reach, len(words)):
                if len(t.telling.difference(words[low:high])) <= t.missing:
                    found += [(t.name, a, b, n, n / len(t.words)) for a, b, n in t.notices(words, low, high)]
        return found


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """One row for every input row: doc_id, n_words, n_found, license and coverage of the best passage (null if none), and all passages as ``found``."""
    item = pa.struct([("license", pa.string()), ("first_word", pa.int32()), ("end_word", pa.int32()), ("matched", pa.int32()), ("coverage", pa.float64())])
    kept = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_found", pa.int32()), ("license", pa.string()), ("coverage", pa.float64()), ("found", pa.list_(item))])
    names = [f.name for f in item]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            rows: list[list] = [[] for _ in range(5)]
            for cell in batch.column("text"):
                text = cell.as_py() or ""
                found = scanner.scan(text, least)
                best = max(found, key=lambda x: x[4]) if found else None
                values = len(tokens(text)), len(found), best and best[0], best and best[4], [dict(zip(names, x, strict=True)) for x in found]
                for column, value in zip(rows, values, strict=True):
                    column.append(value)
            columns = [pa.array(x, f.type) for x, f in zip(rows, list(kept)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], schema=kept)

    schema = "doc_id long, n_words long, n_found int, license string, coverage double, found array<struct<license:string,first_word:int,end_word:int,matched:int,coverage:double>>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
