"""License scans by conditional compression.

Candidate regions are the words around each word that notices use (HINT), as far to both sides as the longest template reaches, so a
notice lies whole within a region wherever its lines break. Within regions the candidate blocks are the places where at most ``max_changed`` of a template's words are
missing or added. The search of the places is exact: such a place holds one of ``changes + 1`` pieces of the template unchanged, and around each
piece the least differences are computed. A candidate block is compressed alone and with the template as a zstandard raw-content dictionary, and blocks
are ranked by the bytes that they save: of those that overlap, the one whose dictionary saves most stands, then the next, until none is left. Ranks
put candidates in order and exclude none (over a long text another dictionary changes an encoder's choices so much that a notice in it may not show in
the sum). A notice's row gives the lines it lies on.

Lines with a hint, merged where at most ``gap`` lines lie between, of which no notice is confirmed have a row with a null license and the
template that saves the largest share, with its differences.

A null or empty text has no blocks. Equal documents give equal rows. Templates are a parameter (name to text); ties go by name. A template
must have more hint words than words that may change, else it could be missed, and is refused.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts

#: The usual wording of public licenses' notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-2.0-or-later-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "LGPL-2.1-or-later-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}

HINT = r"(?i)licen[sc]|copyright|distribut|software|permission|creative commons|\bcc by|\bspdx|public domain|warrant|disclaim|unencumber|mozilla|\bmpl\b"
_HINT = re.compile(HINT)
_WORD = re.compile(r"[^\W_]+(?:[.\-'][^\W_]+)*")
BLOCKS = "doc_id long, start long, length long, license string, best string, saved double, missing int, added int"


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def blocks(text: str, gap: int = 2) -> list[tuple[int, str]]:
    """(offset in characters, block)."""
    found, at, last = [], 0, None
    for i, line in enumerate(text.split("\n")):
        if _HINT.search(line):
            if last is not None and i - last <= gap + 1:
                found[-1][1] = at + len(line)
            else:
                found.append([at, at + len(line)])
            last = i
        at += len(line) + 1
    return [(s, text[s:e]) for s, e in found]


def differences(template: list[str], block: list[str]) -> tuple[int, int]:
    """(words of the template that the block misses, words it adds between the template's first and last matched words)."""
    same = [m for m in SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if m.size]
    matched = sum(m.size for m in same)
    return len(template) - matched, (same[-1].b + same[-1].size - same[0].b - matched) if same else 0


def closest(template: list[str], own: list[str]) -> list[tuple[int, int, int]]:
    """For each end in ``own``: (words missing and added, start, end) of the place with the least of both; of equals the shortest."""
    # column[i]: least cost and, negated, the start of a place that ends here and holds the template's first i words
    column, found = [(i, 0) for i in range(len(template) + 1)], []
    for end, word in enumerate(own, 1):
        new = [(0, -end)]
        for i, w in enumerate(template):
            (down, at), (along, before) = new[i], column[i + 1]
            least = min((down + 1, at), (along + 1, before))
            new.append(min(least, column[i]) if w == word else least)
        column = new
        found.append((column[-1][0], -column[-1][1], end))
    return found


class Scanner:
    def __init__(self, templates: dict[str, str], level: int = 3, max_changed: float = 0.1, kept: int = 10_000):
        self.templates = {name: words(text) for name, text in sorted(templates.items())}
        # no checksum, size or dictionary id in the frames: only content is compared
        own = {"level": level, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
        self.plain = zstandard.ZstdCompressor(**own)
        self.given = {name: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(templates[name].encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), **own) for name in self.templates}
        self.kept = kept
        self.seen: OrderedDict[tuple[str, str | None], tuple] = OrderedDict()
        self.changes = {name: min(int(max_changed * len(t)), len(t) - 1) for name, t in self.templates.items()}
        self.reach = max((len(t) + self.changes[name] for name, t in self.templates.items()), default=0)
        for name in self.templates:
            if len(_HINT.findall(templates[name])) <= self.changes[name]:
                raise ValueError(f"{name} has too few words that notices use")
        self.pieces: dict[str, list[tuple[list[str], str, int]]] = {}
        for name, t in self.templates.items():
            n = self.changes[name] + 1
            for k in range(n):
                start, end = k * len(t) // n, (k + 1) * len(t) // n
                self.pieces.setdefault(t[start], []).append((t[start:end], name, start))

    def _kept(self, text: str, name: str | None, compute) -> tuple:
        if (text, name) not in self.seen:
            if len(self.seen) >= self.kept:
                self.seen.popitem(last=False)
            self.seen[text, name] = compute(text, name)
        return self.seen[text, name]

    def _saving(self, text: str, name: str) -> tuple[int, float]:
        """(bytes, share of the compressed size) that the template saves."""
        data = text.encode()
        alone = len(self.plain.compress(data))
        given = len(self.given[name].compress(data))
        return alone - given, 1 - given / alone

    def _unconfirmed(self, block: str, _) -> tuple:
        share, name = min(((self._saving(block, name)[1], name) for name in self.given), key=lambda x: (-x[0], x[1]))
        return None, name, share, *differences(self.templates[name], words(block))

    def regions(self, text: str, at: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """(first word, end) of candidate blocks: words around hints, merged where they meet. ``at``: the words' places in the text."""
        found: list[list[int]] = []
        starts = [s for s, _ in at]
        for m in _HINT.finditer(text):
            k = bisect_right(starts, m.start()) - 1
            lo, hi = max(0, k - self.reach), min(len(at), k + self.reach + 1)
            if found and lo <= found[-1][1]:
                found[-1][1] = hi
            else:
                found.append([lo, hi])
        return [(lo, hi) for lo, hi in found]

    def places(self, own: list[str]) -> list[tuple[str, int, int, int, int]]:
        """(template, first word, end, missing, added): of each template the closest places that don't overlap one another."""
        near: dict[str, set[tuple[int, int]]] = {}
        exact: dict[str, set[tuple[int, int, int]]] = {}
        for at, word in enumerate(own):
            for piece, name, offset in self.pieces.get(word, ()):
                if own[at : at + len(piece)] == piece:
                    start, slack = at - offset, self.changes[name]
                    end = start + len(self.templates[name])
                    if start >= 0 and own[start:end] == self.templates[name]:
                        exact.setdefault(name, set()).add((0, start, end))
                    else:
                        near.setdefault(name, set()).add((max(start - slack, 0), end + slack))
        found = []
        for name in {**exact, **near}:
            template, costs, taken = self.templates[name], exact.get(name, set()), []
            for lo, hi in near.get(name, ()):
                costs |= {(cost, lo + s, lo + e) for cost, s, e in closest(template, own[lo:hi]) if cost <= self.changes[name]}
            for cost, s, e in sorted(costs):
                if all(e <= x or y <= s for x, y in taken):
                    taken.append((s, e))
                    same = (len(template) + e - s - cost) // 2
                    found.append((name, s, e, len(template) - same, e - s - same))
        return found

    def notices(self, text: str) -> list[tuple]:
        """(first character, end, template, missing, added) of each notice of the text."""
        at = [m.span() for m in _WORD.finditer(text)]
        found = []
        for lo, hi in self.regions(text, at):
            places = self.places([text[s:e].lower() for s, e in at[lo:hi]])
            found += [(at[lo + s][0], at[lo + e - 1][1], name, missing, added) for name, s, e, missing, added in places]
        order = lambda x: (-self._kept(text[x[0] : x[1]], x[2], self._saving)[0], x[3] + x[4], x[2], x[0])
        taken: list[tuple] = []
        for x in sorted(found, key=order):
            if all(x[1] <= y[0] or y[1] <= x[0] for y in taken):
                taken.append(x)
        return taken

    def rows(self, text: str, gap: int = 2) -> list[tuple]:
        """(start, length, license or None, best template, its saving, words missing, words added), by start."""
        cores = [(s, s + len(block)) for s, block in blocks(text, gap)]
        notices = self.notices(text)
        found = []
        for s, e in cores:
            if not any(x[0] < e and s < x[1] for x in notices):
                found.append((s, e - s, *self._kept(text[s:e], None, self._unconfirmed)))
        for s, e, name, missing, added in notices:
            lo, hi = text.rfind("\n", 0, s) + 1, text.find("\n", e)
            block = text[lo : hi if hi >= 0 else len(text)]
            found.append((lo, len(block), name, name, self._kept(block, name, self._saving)[1], missing, added))
        return sorted(found, key=lambda x: (x[0], x[1], x[3]))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", gap: int = 2, max_changed: float = 0.1) -> DataFrame:
    """BLOCKS: a row for each notice of each document, and for each candidate block without one."""
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, max_changed=max_changed)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32()]
        names = [x.split()[0] for x in BLOCKS.split(", ")]
        for b in batches:
            rows = [(doc, *row) for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for row in scanner.rows(text, gap)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    small_batches(docs.sparkSession)
    return texts(docs, id_col, text_col).where(F.col("text").rlike(HINT)).mapInArrow(run, BLOCKS)
