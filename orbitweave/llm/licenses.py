"""License scans by patience alignment.

Words (letters and digits, lower-cased) that occur once in the text window and once in the template
are anchors; the longest increasing subsequence of their places is kept, and the gaps between anchors are
aligned the same way. Coverage is the share of the template's words that are matched in order.

A document that lacks too many of a template's words is not looked at further. Of the others only the words
that the template has are looked at, in runs with at most half a template's foreign words between neighbours
(``GAP`` or more): that is the limit of a match. A window of a run is aligned where it holds enough of the template's words, as a
multiset, to reach the coverage at all, at its widest (``SPREAD`` times the template) and at its narrowest.

A template's naming words (``NAMING``: mit, nc, 3 ...) must be among the matched ones, and none of the words
that make another license of it (``OTHERWISE``: lesser, affero, sa ...) may stand between them unmatched. Of
matches that overlap, the best is reported: most matched words, less those missing and those in between.

Cases: a null or empty text matches nothing; equal texts match alike and repeated rows are reported each;
a license may occur several times in a text, each is reported with its place; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitweave.llm.textblocks import map_batches

COVERAGE, GAP, SPREAD = 0.8, 3, 2.25
# Short notices of public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT": "Released under the MIT License",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "GPL-3.0": "licensed under the GNU General Public License, version 3",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "licensed under a Creative Commons Attribution 4.0 International License",
    "proprietary": "All rights reserved",
    "BSD-notice": "Released under the BSD License",
    "ISC-notice": "Released under the ISC License",
    "GPL-2.0": "licensed under the GNU General Public License, version 2",
    "LGPL-3.0": "licensed under the GNU Lesser General Public License, version 3",
    "LGPL-2.1": "licensed under the GNU Lesser General Public License, version 2.1",
    "AGPL-3.0": "licensed under the GNU Affero General Public License, version 3",
    "LGPL-header": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL-header": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0",
    "CC-BY-SA-4.0-name": "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-4.0-name": "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC0-1.0": "released under CC0 1.0 Universal",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}
#: Whole texts, as ``NAME-text``.
TEMPLATES |= {f"{f.stem}-text": f.read_text(encoding="utf-8") for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
#: Words of a notice without which it names another license, or none.
NAMING = {
    "Apache-2.0": "apache 2 0",
    "Apache-2.0-header": "apache 2 0",
    "MIT": "mit",
    "GPL-3.0": "gnu general 3",
    "GPL-header": "gnu general",
    "MPL-2.0": "mozilla 2 0",
    "CC-BY-NC-4.0": "cc by nc 4 0",
    "CC-BY-4.0": "creative commons attribution 4 0",
    "BSD-notice": "bsd",
    "ISC-notice": "isc",
    "GPL-2.0": "gnu general 2",
    "LGPL-3.0": "gnu lesser 3",
    "LGPL-2.1": "gnu lesser 2 1",
    "AGPL-3.0": "gnu affero 3",
    "LGPL-header": "gnu lesser",
    "AGPL-header": "gnu affero",
    "CC-BY-4.0-notice": "cc by 4 0",
    "CC-BY-SA-4.0": "cc by sa 4 0",
    "CC-BY-ND-4.0": "cc by nd 4 0",
    "CC-BY-NC-SA-4.0": "cc by nc sa 4 0",
    "CC-BY-NC-ND-4.0": "cc by nc nd 4 0",
    "CC-BY-SA-4.0-name": "creative commons attribution sharealike 4 0",
    "CC-BY-NC-4.0-name": "creative commons attribution noncommercial 4 0",
    "CC0-1.0": "cc0 1 0",
}
OTHERWISE = {
    "gnu": frozenset(["lesser", "library", "affero"]),
    "cc": frozenset(["sa", "nc", "nd"]),
    "creative": frozenset(["sharealike", "noncommercial", "noderivatives", "noderivs"]),
}
_WORD = re.compile(r"[^\W_]+")


def word_list(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of pairs (first ends rising) whose second ends rise too."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        back.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(b)
            at.append(k)
        else:
            tops[pile], at[pile] = b, k
    out = []
    k = at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places (in a, in b), in order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: k for k, w in enumerate(b[b0:b1], b0) if once_b[w] == 1}
        anchors = _increasing([(k, place[w]) for k, w in enumerate(a[a0:a1], a0) if once_a[w] == 1 and w in place])
        if not anchors:
            continue
        out += anchors
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(p[0] + 1, q[0], p[1] + 1, q[1]) for p, q in zip(ends, ends[1:])]
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str, coverage: float):
        self.name, self.words = name, word_list(text)
        self.need = max(1, -int(-coverage * len(self.words) // 1))
        self.count = Counter(self.words)
        #: Foreign words that may stand between two matched ones.
        self.gap = max(GAP, len(self.words) // 2)
        #: Long words first: they are the likeliest to be missing.
        self.tests = sorted(self.count, key=lambda w: (-len(w), w))
        self.otherwise = frozenset().union(*(OTHERWISE[w] for w in OTHERWISE if w in self.count))
        #: The first places of the naming words.
        self.naming = {self.words.index(w) for w in NAMING.get(name, "").split() if w in self.count}

    def possible(self, have: set[str], n: int) -> bool:
        """Whether a text of ``n`` words that has these distinct ones may match."""
        if n < self.need or not all(self.words[k] in have for k in self.naming):
            return False
        missing = 0
        for w in self.tests:
            if w not in have:
                missing += self.count[w]
                if missing > len(self.words) - self.need:
                    return False
        return True

    def find(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(first word, end, matched words) of matches from left to right, without overlaps."""
        at = [k for k, w in enumerate(words) if w in self.count or w in self.otherwise]
        lo = 0
        for hi in range(1, len(at) + 1):
            if hi == len(at) or at[hi] - at[hi - 1] > self.gap + 1:
                if hi - lo >= self.need:
                    run = at[lo:hi]
                    for a, b, n in self._find_in_run([words[k] for k in run]):
                        yield run[a], run[b - 1] + 1, n
                lo = hi

    def _narrowest(self, words: list[str], begin: int, k: int) -> int:
        """The last place from which the words up to ``k`` are still enough."""
        held, common = Counter(), 0
        while k > begin and common < self.need:
            k -= 1
            held[words[k]] += 1
            common += held[words[k]] <= self.count[words[k]]
        return k

    def _find_in_run(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        size = len(self.words)
        width = int(SPREAD * size) + 2
        held, common, begin = Counter(), 0, 0
        k = again = 0
        while k < len(words):
            w = words[k]
            if w in self.count:
                held[w] += 1
                common += held[w] <= self.count[w]
            if k - begin >= width:
                old = words[begin]
                if old in self.count:
                    common -= held[old] <= self.count[old]
                    held[old] -= 1
                begin += 1
            k += 1
            if common >= self.need and k >= again:
                at = begin
                matched = patience(words[at : k + size - self.need], self.words)
                if len(matched) < self.need:
                    at = self._narrowest(words, begin, k)
                    narrow = patience(words[at : k + size - self.need], self.words)
                    # Each further word adds one match at most; for a short notice the next word is tried all the same.
                    again = k + (self.need - max(len(matched), len(narrow)) if size > 64 else 1)
                    matched = narrow
                if len(matched) >= self.need:  # aligned again from where the match begins, as far as the missing words may be
                    at += matched[0][0]
                    whole = patience(words[at : k + 2 * (size - len(matched)) + 2], self.words)
                    matched = whole if len(whole) >= len(matched) else [(a - matched[0][0], b) for a, b in matched]
                    end = at + matched[-1][0] + 1
                    taken = {a for a, _ in matched}
                    between = (at + a for a in range(matched[0][0], matched[-1][0]) if a not in taken and words[at + a] in self.otherwise)
                    other = next((a for a in between if words[a] != "library" or words[a - 1] == "gnu"), None)
                    if other is not None:
                        end = other + 1
                    elif self.naming <= {b for _, b in matched}:
                        yield at + matched[0][0], end, len(matched)
                    else:  # the next words may bring the name
                        end = at + matched[0][0] + 1
                    held, common, begin, k, again = Counter(), 0, end, end, end


def _best(found: list[tuple[int, int, int, Template]]) -> list[tuple[int, int, int, Template]]:
    """Of matches (start, end, matched words, template) that overlap, the best."""
    kept: list[tuple[int, int, int, Template]] = []
    for m in sorted(found, key=lambda m: m[2] - (len(m[3].words) - m[2]) - (m[1] - m[0] - m[2]), reverse=True):
        if all(m[1] <= a or b <= m[0] for a, b, _, _ in kept):
            kept.append(m)
    return kept


@lru_cache(maxsize=4)
def _templates(given: tuple[tuple[str, str], ...], coverage: float) -> list[Template]:
    return [Template(n, t, coverage) for n, t in given]


def scan_text(text: str | None, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> list[tuple[str, int, int, float]]:
    """(license, start, end, coverage) with places in characters."""
    if not text:
        return []
    lower = text.lower()
    if len(lower) != len(text):  # a letter whose lower case is longer: the places must stay those of the text
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    words = _WORD.findall(lower)
    have = set(words)
    found = [(a, b, n, t) for t in _templates(tuple(templates.items()), coverage) if t.possible(have, len(words)) for a, b, n in t.find(words)]
    if not found:
        return []
    spans = [m.span() for m in _WORD.finditer(lower)]
    return [(t.name, spans[a][0], spans[b - 1][1], n / len(t.words)) for a, b, n, t in _best(found)]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, license, start_char, end_char, coverage`` of every license notice in the texts."""
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("coverage", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *m) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in scan_text(t, templates, coverage)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, run, "doc_id long, license string, start_char long, end_char long, coverage double")
