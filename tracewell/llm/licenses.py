"""License scans by patience alignment of texts with license templates.

Words unique to both a stretch of text and a template are anchors; the longest run of anchors in the same
order is kept, and the gaps between them are aligned in the same way. Coverage is the share of the template's
words that are aligned. Stretches of a text are looked at around each occurrence of the template word that
is rarest in the text, so long texts and repeated licenses are whole.

Defined results: null and empty texts have no license; of several templates the one with the highest coverage, then the
most words, then the first name is a document's license; repeated rows are scanned each; texts of any length are scanned whole; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import released

#: Notices and permission texts of public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
    "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
    "See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
    "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
    "notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal "
    "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
    "notice shall be included in all copies or substantial portions of the Software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
    "You can obtain one at http://mozilla.org/MPL/2.0/.",
}
THRESHOLD = 0.8
WORD = re.compile(r"[a-z0-9]+")


class Template(NamedTuple):
    name: str
    words: list[str]
    guards: list[str]


class Match(NamedTuple):
    name: str
    coverage: float
    start: int
    end: int
    n_words: int


def prepare(templates: dict[str, str], threshold: float = THRESHOLD) -> list[Template]:
    """Templates with guards: words of which any text that covers ``threshold`` of the template has at least one."""
    found = []
    for name, text in sorted(templates.items()):
        words = WORD.findall(text.lower())
        counts, guards, left = Counter(words), [], len(words)
        for w in sorted(counts, key=lambda w: (-len(w), w)):
            if left < threshold * len(words):
                break
            guards.append(w)
            left -= counts[w]
        found.append(Template(name, words, guards))
    return found


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence."""
    ends, at, back = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(ends, v)
        back.append(at[k - 1] if k else -1)
        if k == len(ends):
            ends.append(v)
            at.append(i)
        else:
            ends[k], at[k] = v, i
    path, i = [], at[-1] if at else -1
    while i >= 0:
        path.append(i)
        i = back[i]
    return path[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Patience alignment: pairs of places of equal words, increasing in both."""
    found, work = [], [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place]
        kept = [anchors[k] for k in longest_increasing([j for _, j in anchors])]
        if not kept:
            continue
        found += kept
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *kept], [*kept, (a1, b1)], strict=True):
            work.append((i + 1, k, j + 1, m))
    return sorted(found)


def scan(text: str | None, templates: list[Template], threshold: float = THRESHOLD) -> list[Match]:
    """Every stretch of a text that covers a template, by place."""
    low = (text or "").lower()
    near = [t for t in templates if any(g in low for g in t.guards)]
    if not near:
        return []
    if len(low) != len(text):  # lower case has other places; words are ASCII, so only their case matters
        low = text.translate({c: c + 32 for c in range(65, 91)})
    spans = [m.span() for m in WORD.finditer(low)]
    words = [low[a:b] for a, b in spans]
    places: dict[str, list[int]] = {}
    wanted = {w for t in near for w in t.words}
    for i, w in enumerate(words):
        if w in wanted:
            places.setdefault(w, []).append(i)
    found = []
    for t in near:
        n, counts = len(t.words), Counter(t.words)
        used: set[int] = set()  # places of words in matches
        inside: set[int] = set()  # places between the first and last of them
        # Any covering stretch has some guard, but not all of them have the same one.
        for g in sorted((g for g in t.guards if g in places), key=lambda g: len(places[g])):
            before, at_all = t.words.index(g), places[g]
            for k, at in enumerate(at_all):
                if at in inside:
                    continue
                lo, hi = max(0, at - before - before // 4 - 2), min(len(words), at + (n - before) + (n - before) // 4 + 2)
                windows = [(lo, hi)]
                if counts[g] == 1:  # notices one after another: between the same word of its neighbours this one is an anchor
                    alone = (max(lo, at_all[k - 1] + 1 if k else 0), min(hi, at_all[k + 1] if k + 1 < len(at_all) else hi))
                    windows = [alone] if alone == (lo, hi) else [alone, (lo, hi)]
                if used and not inside.isdisjoint(range(lo, hi)):  # beside a match, the stretch is looked at again without it
                    windows.append((next((i + 1 for i in range(at, lo - 1, -1) if i in inside), lo), next((i for i in range(at, hi) if i in inside), hi)))
                for a, b in windows:
                    pairs = align(words[a:b], t.words)
                    # Words of a match don't count for another.
                    if len(pairs) >= threshold * n and sum(a + i not in used for i, _ in pairs) >= threshold * n:
                        found.append(Match(t.name, len(pairs) / n, spans[a + pairs[0][0]][0], spans[a + pairs[-1][0]][1], n))
                        used.update(a + i for i, _ in pairs)
                        inside.update(range(a + pairs[0][0], a + pairs[-1][0] + 1))
                        break
    return sorted(found, key=lambda m: (m.start, m.end, m.name))


def scan_documents(documents: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, coverage, n_matches, matches) of every document; license is null where none is covered."""
    prepared = prepare(templates or TEMPLATES, threshold)

    def run(batches):
        kind = pa.list_(pa.struct([("name", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            rows = [scan(t, prepared, threshold) for t in batch.column(1).to_pylist()]
            best = [min(r, key=lambda m: (-m.coverage, -m.n_words, m.name), default=None) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([b and b.name for b in best], pa.string()), pa.array([b.coverage if b else 0.0 for b in best], pa.float64()),
                    pa.array([len(r) for r in rows], pa.int32()), pa.array([[{k: getattr(m, k) for k in ("name", "coverage", "start", "end")} for m in r] for r in rows], kind),
                ],
                ["doc_id", "license", "coverage", "n_matches", "matches"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        lambda batches: released(run(batches)), f"doc_id {kind}, license string, coverage double, n_matches int, matches array<struct<name:string,coverage:double,start:int,end:int>>"
    )
