"""License scans by patience alignment.

A text and a template are sequences of words. Common ends are matched first; words that occur once in both are
anchors, of which the longest increasing subsequence is kept; the gaps between anchors are aligned the same way.
Coverage is the share of the template's words that are matched. A notice may stand anywhere in a text and more than
once, so templates are aligned with windows of STRETCH times their length: a window is tried where it holds enough of
the template's words, and the scan goes on behind a match. A match needs the template's naming words.

Null and empty texts have no match. Repeated rows are repeated in the result, rows without an id are scanned too.
Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import bounded_batches

LEAST, STRETCH = 0.8, 1.5
_WORD = re.compile(r"[a-z0-9]+")

# Public license notices, each with the words that must be among the matched ones.
NOTICES = [
    ("Apache-2.0", "apache 2", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "apache 2 license", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
        under the License."""),
    ("MIT", "mit", "Released under the MIT License."),
    ("MIT", "sublicense", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
        furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
        copies or substantial portions of the Software."""),
    ("GPL-3.0", "gnu general 3", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "gnu general 3 later", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("CC-BY-NC-4.0", "cc by nc 4", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "creative commons attribution 4", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-2-Clause", "redistributions binary", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("ISC", "purpose fee", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies."""),
    ("LGPL-3.0", "gnu lesser general 3", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "gnu lesser general 2 1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "gnu affero general 3", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("GPL-2.0", "gnu general 2", "This work is licensed under the GNU General Public License, version 2."),
    *[(f"{name}-or-later", f"gnu general {must} later", f"""This {what} is free software: you can redistribute it and/or modify it under the terms of
        the GNU {kind} General Public License as published by the Free Software Foundation, either version {number} of the License, or (at your
        option) any later version.""") for name, must, what, kind, number in [
            ("LGPL-3.0", "lesser 3", "program", "Lesser", "3"), ("LGPL-2.1", "lesser 2 1", "library", "Lesser", "2.1"),
            ("AGPL-3.0", "affero 3", "program", "Affero", "3"), ("GPL-2.0", "2", "program", "", "2")]],
    ("MPL-2.0", "mozilla 2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("EPL-2.0", "eclipse 2", """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which
        is available at https://www.eclipse.org/legal/epl-2.0/"""),
    ("BSD-3-Clause", "redistributions binary neither endorse", """Redistribution and use in source and binary forms, with or without modification, are
        permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list
        of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of
        the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without
        specific prior written permission."""),
    ("Unlicense", "unencumbered", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means."""),
    *[(f"CC-{kind.upper().replace(' ', '-')}-4.0", f"cc {kind} 4", f"Licensed under CC {kind} 4.0.")
      for kind in ("by", "by sa", "by nd", "by nc sa", "by nc nd")],
    *[(f"CC-{kind.upper().replace(' ', '-')}-4.0", f"creative commons {name.lower()} 4",
       f"This work is licensed under a Creative Commons {name} 4.0 International License.") for kind, name in [
        ("by sa", "Attribution-ShareAlike"), ("by nd", "Attribution-NoDerivatives"), ("by nc", "Attribution-NonCommercial"),
        ("by nc sa", "Attribution-NonCommercial-ShareAlike"), ("by nc nd", "Attribution-NonCommercial-NoDerivatives")]],
    ("CC0-1.0", "cc0 1", "Licensed under CC0 1.0."),
    ("CC0-1.0", "cc0 universal", "This work is dedicated to the public domain under CC0 1.0 Universal."),
]


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def align(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """Matched positions (in a, in b) by patience alignment, ascending in both."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        anchors = increasing(unique_in_both(a, a0, a1, b, b0, b1))
        out += anchors
        edge = (a0 - 1, b0 - 1)
        for anchor in [*anchors, (a1, b1)] if anchors else []:
            gaps.append((edge[0] + 1, anchor[0], edge[1] + 1, anchor[1]))
            edge = anchor
    return sorted(out)


def unique_in_both(a, a0: int, a1: int, b, b0: int, b1: int) -> list[tuple[int, int]]:
    """Positions of the words that occur once in a[a0:a1] and once in b[b0:b1], in the order of a."""
    in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
    place = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
    return [(i, place[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in place]


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence with increasing second parts: pairs are laid on piles, each pointing to the pile before."""
    tops: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for i, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        before.append(ends[pile - 1] if pile else -1)
        tops[pile:pile + 1] = [j]
        ends[pile:pile + 1] = [i]
    out, at = [], ends[-1] if ends else -1
    while at >= 0:
        out.append(pairs[at])
        at = before[at]
    return out[::-1]


class Template:
    def __init__(self, name: str, must: str, text: str):
        self.name, self.words, self.must = name, words_of(text), set(words_of(must))
        self.count = Counter(self.words)
        self.need = ceil(LEAST * len(self.words))
        self.window = ceil(STRETCH * len(self.words))

    def possible(self, present: set[str]) -> bool:
        """Whether a text with these words can reach the coverage at all."""
        return self.must <= present and sum(n for w, n in self.count.items() if w in present) >= self.need

    def matches(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(first word, behind the last word, matched words) of each match, from left to right."""
        return ((at[0], at[-1] + 1, len(at)) for at in self.matched(words))

    def matched(self, words: list[str]) -> Iterator[list[int]]:
        """The places of the matched words of each match, from left to right."""
        places = [i for i, w in enumerate(words) if w in self.count]
        held: Counter = Counter()
        shared, right, least = 0, 0, 0
        for left, at in enumerate(places):
            while right < len(places) and places[right] < at + self.window:
                w = words[places[right]]
                held[w] += 1
                shared += held[w] <= self.count[w]
                right += 1
            if at >= least and shared >= self.need:
                found = align(words[at:at + self.window], self.words)
                if len(found) >= self.need and self.must <= {self.words[j] for _, j in found}:
                    yield [at + i for i, _ in found]
                    least = at + found[-1][0] + 1
            w = words[at]
            shared -= held[w] <= self.count[w]
            held[w] -= 1


def scan(text: str, templates: Sequence[Template]) -> list[tuple[str, int, int, int, int, float]]:
    """(license, template, start, end, matched words, coverage) of every match; code points, end exclusive.

    Of matches of one license that overlap, those with more matched words stay, ties to the earlier template. Of matches
    of different licenses that share at least half of the words of one, the same holds: the most specific text wins.
    """
    lower = text.lower()
    if len(lower) != len(text):  # a few characters get longer in lower case
        lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    words = _WORD.findall(lower)
    present = set(words)
    found = []
    for number, template in enumerate(templates):
        if template.possible(present):
            found += [(template.name, number, at[0], at[-1] + 1, len(at), set(at)) for at in template.matched(words)]
    if not found:
        return []
    kept: list[tuple[str, int, int, int, int, set[int]]] = []
    for f in sorted(found, key=lambda f: (-f[4], f[1], f[2])):
        if not any(f[2] < k[3] and k[2] < f[3] and (f[0] == k[0] or 2 * len(f[5] & k[5]) >= f[4]) for k in kept):
            kept.append(f)
    spans = [m.span() for m in _WORD.finditer(lower)]
    return sorted((name, number, spans[a][0], spans[b - 1][1], n, n / len(templates[number].words)) for name, number, a, b, n, _ in kept)


def scan_table(docs: DataFrame, notices: Sequence[tuple[str, str, str]] = tuple(NOTICES), id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Per row: id and `matches`, an array of (license, template, start, end, matched, coverage)."""
    bounded_batches(docs.sparkSession)
    notices = list(notices)
    kind = dict(docs.select(id_col).dtypes)[id_col]
    fields = [("license", pa.string()), ("template", pa.int32()), ("start", pa.int64()), ("end", pa.int64()),
              ("matched", pa.int64()), ("coverage", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = [Template(*n) for n in notices]
        names = [f[0] for f in fields]
        for batch in batches:
            found = [[dict(zip(names, m, strict=True)) for m in scan(t.as_py(), templates)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.struct(fields)))], [id_col, "matches"])

    match = "license: STRING, template: INT, start: BIGINT, end: BIGINT, matched: BIGINT, coverage: DOUBLE"
    return docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("_t")).mapInArrow(
        run, f"`{id_col}` {kind}, matches ARRAY<STRUCT<{match}>>")
