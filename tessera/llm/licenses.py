"""License scans by patience alignment.

A template's words are aligned with a passage of the text: words that occur once in both are anchors, the longest
increasing run of them is kept, and the gaps between are aligned in the same way. Coverage is the share of the
template's words that are aligned. Passages are where a template's telling words stand close together.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import lean, slices

#: License texts and notices (fixed values): name, text, words that must be aligned, words that may not stand in the passage.
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_ADVERT = "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."
_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_GNU = "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
_VERBATIM = "GNU {kind} PUBLIC LICENSE Version {version}, {date} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_WHOLE = (
    ("MIT", _MIT + ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "above", ""),
    ("MIT-0", _MIT + ".", "", "above"),
    ("ISC", _ISC + ", provided that the above copyright notice and this permission notice appear in all copies.", "provided", ""),
    ("0BSD", _ISC + ".", "", "provided"),
    ("BSD-2-Clause", _BSD, "", "neither endorse"),
    ("BSD-3-Clause", f"{_BSD} {_NAMES}", "neither endorse", "advertising"),
    ("BSD-4-Clause", f"{_BSD} {_ADVERT} {_NAMES}", "advertising endorse", ""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "", ""),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", "apache 2.0", ""),
    ("GPL-3.0", _GNU.format(what="program", kind="General", version="3"), "general 3", "affero lesser library"),
    ("GPL-2.0", _GNU.format(what="program", kind="General", version="2"), "general 2", "affero lesser library"),
    ("LGPL-3.0", _GNU.format(what="library", kind="Lesser General", version="3"), "lesser 3", "affero"),
    ("LGPL-2.1", _GNU.format(what="library", kind="Lesser General", version="2.1"), "lesser 2.1", "affero"),
    ("AGPL-3.0", _GNU.format(what="program", kind="Affero General", version="3"), "affero 3", "lesser"),
    ("GPL-3.0", _VERBATIM.format(kind="GENERAL", version="3", date="29 June 2007"), "general 3", "affero lesser"),
    ("GPL-2.0", _VERBATIM.format(kind="GENERAL", version="2", date="June 1991"), "general 2", "affero lesser"),
    ("LGPL-3.0", _VERBATIM.format(kind="LESSER GENERAL", version="3", date="29 June 2007"), "lesser 3", "affero"),
    ("LGPL-2.1", _VERBATIM.format(kind="LESSER GENERAL", version="2.1", date="February 1999"), "lesser 2.1", "affero"),
    ("AGPL-3.0", _VERBATIM.format(kind="AFFERO GENERAL", version="3", date="19 November 2007"), "affero 3", "lesser"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "", ""),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0", "eclipse 2.0", ""),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html", "eclipse v1.0", ""),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\"); You may not use this work except in compliance with the Licence.", "eupl 1.2", ""),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "unencumbered", ""),
)
_PHRASES = (
    ("MIT", "Released under the MIT License.", "mit license", ""),
    ("MIT", "Licensed under the MIT License.", "mit license", ""),
    ("BSD", "Released under the BSD License.", "bsd license", ""),
    ("BSD", "Licensed under the BSD License.", "bsd license", ""),
    ("ISC", "Released under the ISC License.", "isc license", ""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache license 2.0", ""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu general public license 3", "affero lesser"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", "gnu general public license 2", "affero lesser"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", "gnu lesser general public license 3", "affero"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", "gnu affero general public license 3", "lesser"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0.", "mozilla public license 2.0", ""),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", "cc by 4.0", ""),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "cc by-sa 4.0", ""),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "cc by-nc 4.0", ""),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0.", "cc by-nd 4.0", ""),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0.", "cc by-nc-sa 4.0", ""),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0.", "cc0 1.0", ""),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1.", "gnu lesser general public license 2.1", "affero"),
    ("Unlicense", "Released under the Unlicense.", "unlicense", ""),
)
#: The long names of the Creative Commons licenses (fixed values).
_COMMONS = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))


def _catalog() -> tuple[tuple[str, str, str, str], ...]:
    """Texts and phrases, the long names, and an identifier line for each license that has a version-exact name."""
    long = tuple((f"CC-{x}-4.0", f"This work is licensed under a Creative Commons {y} 4.0 International License.", f"creative commons {y.lower()} 4.0", "") for x, y in _COMMONS)
    base = _WHOLE + _PHRASES + long
    names = dict.fromkeys(x[0] for x in base if x[0] != "BSD")
    lines = []
    for name in names:
        for end in ("", "-only", "-or-later") if "GPL" in name else ("",):
            lines.append((name, f"SPDX-License-Identifier: {name}{end}", f"spdx-license-identifier {name.lower()}{end}", ""))
    return base + tuple(lines)


TEMPLATES = _catalog()
#: Words too common to point at a template (fixed values).
COMMON = frozenset("a above all and any appear are as at be by can code copies copy do either file files following for form forms free general granted if in included including is it later list may met must not notice obtain of on one option or other permitted person persons program provided public released rights shall so software source subject terms that the this to under use version with without work you your".split())
LEAST = 0.8
_WORD = re.compile(r"[a-z0-9]+(?:[.\-'][a-z0-9]+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by the first, whose second rises: patience piles with links back."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        back.append(at[p - 1] if p else -1)
        tops[p:] = [j, *tops[p + 1 :]]
        at[p:] = [k, *at[p + 1 :]]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places (in a, in b), rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 and a0 < a1 and b0 < b1 and a[a0] == b[b0]:  # next to an anchor; a passage's own ends are none
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a1 < len(a) and a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if nb[w] == 1 and na[w] == 1}
        run = _rising([(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if w in place])
        if not run:
            continue
        out += run
        ends = [(a0 - 1, b0 - 1), *run, (a1, b1)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:])]
    return sorted(out)


class Scanner:
    def __init__(self, templates=TEMPLATES, least: float = LEAST):
        import ahocorasick

        self.least = least
        self.templates = [(name, words(text), frozenset(key.split()), frozenset(no.split())) for name, text, key, no in templates]
        self.telling = [frozenset(t) - COMMON - {"license", "licensed"} or frozenset(t) - COMMON for _, t, _, _ in self.templates]
        for (name, t, _, _), w in zip(self.templates, self.telling, strict=True):
            if not w:
                raise ValueError(f"no telling word in {name}")
        self.of: dict[str, list[int]] = {}
        for k, ws in enumerate(self.telling):
            for w in ws:
                self.of.setdefault(w, []).append(k)
        self.any = ahocorasick.Automaton()
        for w in self.of:
            self.any.add_word(w, w)
        self.any.make_automaton()

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, word after the last) of the best passage of each license found, best first. Of
        passages that overlap, the one with most words of its template counts; a license whose passage gives way so may
        still have another."""
        if not text:
            return []
        low = text.lower()
        if next(self.any.iter(low), None) is None:
            return []
        own = words(low)
        hits: dict[int, list[int]] = {}
        for i, w in enumerate(own):
            for k in self.of.get(w, ()):
                hits.setdefault(k, []).append(i)
        found = [p for k, at in hits.items() for p in self._passages(own, k, at)]
        kept: list[tuple[str, float, int, int]] = []
        ends: list[int] = []  # kept passages by where they begin; as they do not overlap, their ends rise too
        starts: list[int] = []
        for _, _, name, cover, a, b in sorted(((-n, -cover, name, cover, a, b) for name, cover, a, b, n in found), key=lambda x: (x[0], x[1], x[2], x[4])):
            i = bisect_left(starts, a)
            if (i == 0 or ends[i - 1] <= a) and (i == len(starts) or b <= starts[i]):
                starts.insert(i, a)
                ends.insert(i, b)
                kept.append((name, cover, a, b))
        best: dict[str, tuple[str, float, int, int]] = {}
        for x in kept:
            if x[0] not in best or (-x[1], x[2]) < (-best[x[0]][1], best[x[0]][2]):
                best[x[0]] = x
        return sorted(best.values(), key=lambda x: (-x[1], x[0]))

    def _passages(self, own: list[str], k: int, at: list[int]) -> Iterator[tuple[str, float, int, int, int]]:
        """(license, coverage, first word, word after the last, aligned words) of the passages of one template, each once. at:
        where its telling words stand. A place inside a passage that is covered whole is not looked at again, and no window
        without enough different telling words is aligned."""
        name, t, key, no = self.templates[k]
        reach = len(t) + len(t) // 2 + 2
        need = max(1, int(len(self.telling[k]) - (1 - self.least) * len(t)))
        seen: set[tuple] = set()
        done = -1  # the end of the last whole passage
        i = 0
        while i < len(at):
            j = i
            while j + 1 < len(at) and at[j + 1] - at[j] <= reach:
                j += 1
            group = at[i : j + 1]
            if len({own[x] for x in group}) >= need:
                for x, lo, hi in self._windows(own, group, t, reach):
                    if x < done or (lo, hi) in seen:
                        continue
                    seen.add((lo, hi))
                    inside = group[bisect_left(group, lo) : bisect_left(group, hi)]
                    if len({own[y] for y in inside}) < need:
                        continue
                    pairs = align(own[lo:hi], t)
                    if len(pairs) >= self.least * len(t) and key <= {t[y] for _, y in pairs} and pairs[-1][0] - pairs[0][0] < reach:
                        a, b = lo + pairs[0][0], lo + pairs[-1][0] + 1
                        if not no.isdisjoint(own[a:b]):
                            continue
                        if len(pairs) == len(t):
                            done = max(done, b)
                        if (a, b, "p") not in seen:
                            seen.add((a, b, "p"))
                            yield name, len(pairs) / len(t), a, b, len(pairs)
            i = j + 1

    @staticmethod
    def _windows(own: list[str], at: list[int], t: list[str], reach: int) -> Iterator[tuple[int, int, int]]:
        """(place, from, to) of passages to align: those where a telling word stands at its place in the template, exactly and
        with some room, then wide ones that overlap."""
        slack = len(t) // 10
        for x in at:
            for j, w in enumerate(t):
                if w == own[x]:
                    yield x, max(0, x - j), max(0, x - j + len(t))
                    if slack:
                        yield x, max(0, x - j - slack), max(0, x - j + len(t) + slack)
        last = None
        for x in at:
            if last is None or x - last >= max(1, reach // 2):
                last = x
                yield x, max(0, x - reach), min(len(own), x + reach)


RESULT = "doc_id long, license string, coverage double, first_word int, end_word int, licenses array<string>"


def scan_licenses(docs: DataFrame, templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """One row for each row of docs (doc_id, text): the best covered license with its coverage and place (in words), and
    all licenses found. None found, a null or an empty text: null, 0.0 and an empty list. Ties go to the first name. Rows
    with one doc_id each have a row, a null doc_id stays null; an empty table gives an empty result. A text takes memory in
    proportion to its words, and time in proportion to its telling words."""

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner(templates, least)
        for t in slices(batches, 1):
            got = [s.scan(x.as_py()) for x in t.column(1)]
            best = [g[0] if g else (None, 0.0, None, None) for g in got]
            yield pa.RecordBatch.from_arrays(
                [t.column(0).combine_chunks(), pa.array([x[0] for x in best], pa.string()), pa.array([float(x[1]) for x in best], pa.float64()), pa.array([x[2] for x in best], pa.int32()), pa.array([x[3] for x in best], pa.int32()), pa.array([sorted(x[0] for x in g) for g in got], pa.list_(pa.string()))],
                ["doc_id", "license", "coverage", "first_word", "end_word", "licenses"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT)
