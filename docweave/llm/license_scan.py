"""License scans: winnowed fingerprints pick candidates, a banded alignment decides.

Templates are read as words. Hashes of a few consecutive words are winnowed (the smallest of every ``window``
neighbours is kept) into an inverted index of template and place. A text's grams that hit the
index give diagonals; each group of near diagonals is aligned with its template in a band, and what
covers enough of the template is reported with its span in the text.

How long grams and windows are follows from the template: a copy that lacks so few of its words that it still covers enough keeps
a run of template words that is at least so long, and a gram of every such run is in the index. So no copy with replaced or left out words is
lost; a copy into which words are put all over the place, so that no run of it is left, may be.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_column

# Wording of public licenses and of the notices that name them (fixed values).
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "mit-notice": "Released under the MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")
#: What a text word that the template lacks takes off an alignment's score. A word in a template word's place takes less off: all that may be replaced, together, less than a match brings.
GAP = 0.25


def _data(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").translate(_TABLE)


def _gram_keys(ids: np.ndarray, k: int) -> np.ndarray:
    """One number for each k-gram of word numbers; -1 where a word is in no template."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.int64)
    key, known = np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(k):
        part = ids[i : i + n]
        key = key * 100_003 + part
        known &= part >= 0
    return np.where(known, key, -1)


def grams_for(words: int, least: float, most: int) -> tuple[int, int]:
    """(gram length, window) for a template: what is left of it when it is covered to ``least`` has a run of gram length + window - 1 words."""
    need = max(1, -int(-least * words // 1))
    run = -(-need // (words - need + 1))
    k = max(1, min(most, run - 1 if run > 2 else run))
    return k, max(1, run - k + 1)


class Scanner:
    """Inverted index of the templates; built once in each worker."""

    def __init__(self, templates: dict[str, str], most: int = 3, band: int = 24, least: float = 0.8):
        self.least = least
        self.names = sorted(templates)
        words = [_data(templates[n]).split() for n in self.names]
        self.number = {w: i for i, w in enumerate(sorted({w for ws in words for w in ws}))}
        self.templates = [np.array([self.number[w] for w in ws], dtype=np.int64) for ws in words]
        # half width of the alignment: how far left out words may move the rest; a template of few words may follow itself at once
        self.bands = [max(1, min(band, int((1 - least) * len(ws)) + 1, len(ws) // 3)) for ws in words]
        self.index: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for t, ids in enumerate(self.templates):
            k, window = grams_for(len(ids), least, most)
            keys = _gram_keys(ids, k)
            hashes = [crc32(int(x).to_bytes(8, "little")) for x in keys]
            picked = set()
            for i in range(max(1, len(hashes) - window + 1)):
                part = range(i, min(i + window, len(hashes)))
                picked.add(min(part, key=lambda j: (hashes[j], -j)))
            for at in sorted(picked):
                self.index.setdefault(k, {}).setdefault(int(keys[at]), []).append((t, at))
        self.keys = {k: np.array(sorted(index), dtype=np.int64) for k, index in self.index.items()}

    def align(self, template: np.ndarray, text: list[int], shift: int, band: int) -> tuple[int, int, int]:
        """Template words matched in order along the band around ``shift`` (text place minus template place), and the span in the text [from, to).

        A match counts one, a text word skipped inside the span takes ``GAP`` off, so that a span doesn't reach over
        a copy's ends for the sake of a word that happens to stand there; a replaced word takes off less, see ``GAP``.
        """
        swap = min(GAP, 0.9 / (int((1 - self.least) * len(template)) + 1))
        width = 2 * band + 1
        none = (0.0, -1, -1, 0)  # score, first text word, last text word, matched
        best = [none] * (width + 2)
        low, count = shift - band - 1, len(text)
        for i, word in enumerate(template.tolist()):
            row = [none] * (width + 2)
            for d in range(1, width + 1):
                j = low + i + d
                got, left = best[d + 1], row[d - 1]
                if left[0] - GAP > got[0]:
                    got = (left[0] - GAP, *left[1:])
                if 0 <= j < count and text[j] == word:
                    s, a, _, m = best[d]
                    if s + 1 >= got[0]:
                        got = (s + 1, j if a < 0 else a, j, m + 1)
                elif best[d][0] - swap > got[0]:
                    got = (best[d][0] - swap, *best[d][1:])
                row[d] = got
            best = row
        _, start, stop, matched = max(best, key=lambda x: (x[0], x[3], x[1]))
        return matched, start, stop + 1

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first and end character of the original text), by place."""
        data = _data(text)
        words = data.split()
        get = self.number.get
        ids = np.array([get(w, -1) for w in words], dtype=np.int64)
        numbers = ids.tolist()
        diagonals: dict[int, list[int]] = {}
        for k, wanted in self.keys.items():
            keys = _gram_keys(ids, k)
            for at in np.flatnonzero(np.isin(keys, wanted)).tolist() if len(keys) else []:
                for t, place in self.index[k][int(keys[at])]:
                    diagonals.setdefault(t, []).append(at - place)
        if not diagonals:
            return []
        found = []
        for t, shifts in diagonals.items():
            shifts.sort()
            seen = -(10**9)
            for s in shifts:
                if s - seen <= self.bands[t]:
                    continue
                seen = s
                matched, a, b = self.align(self.templates[t], numbers, s, self.bands[t])
                coverage = matched / len(self.templates[t])
                if coverage >= self.least and (b - a) <= len(self.templates[t]) / self.least + self.bands[t]:
                    found.append((self.names[t], coverage, a, b))
        if not found:
            return []
        kept = fullest(found)
        at = [m.span() for m in _WORD.finditer(data)]
        chars = np.cumsum((np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8) & 0xC0) != 0x80)
        return sorted(((n, c, int(chars[at[a][0]]) - 1, int(chars[at[b - 1][1] - 1])) for n, c, a, b in kept), key=lambda x: (x[2], x[0]))


def fullest(found: list[tuple[str, float, int, int]]) -> list[tuple[str, float, int, int]]:
    """Of overlapping reports (license, coverage, from, to) of one license the fullest stays; of equally full ones the first, then the shorter."""
    kept: list[tuple[str, float, int, int]] = []
    places: dict[str, tuple[list[int], list[int]]] = {}  # by license: starts of the kept reports, and their stops, both rising
    for x in sorted(found, key=lambda x: (x[0], -x[1], x[2], x[3])):
        starts, stops = places.setdefault(x[0], ([], []))
        i = bisect_left(starts, x[3])  # kept reports do not overlap: only the last that starts before the end can
        if not i or stops[i - 1] <= x[2]:
            starts.insert(i, x[2])
            stops.insert(i, x[3])
            kept.append(x)
    return kept


def scan_column(text: Column, templates: dict[str, str] | None = None, least: float = 0.8) -> Column:
    """Array of structs license, coverage, start, stop (characters of the whole original text)."""
    chosen = TEMPLATES if templates is None else templates

    def start():
        scanner = Scanner(chosen, least=least)
        return lambda texts: [[dict(zip(("license", "coverage", "start", "stop"), x, strict=True)) for x in scanner.scan(t)] for t in texts]

    return arrow_column("array<struct<license:string,coverage:double,start:bigint,stop:bigint>>", start, text)


def licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """``id_col`` and ``matches`` of every row.

    A match covers at least ``least`` of its template's words, in order, near one diagonal. Null and empty texts
    have none. A license that occurs twice is reported twice, also side by side; different licenses may overlap. Repeated rows
    return repeated rows, an empty table none. Other columns are ignored. No shuffle.
    """
    return df.select(F.col(id_col), scan_column(F.col(text_col), templates, least).alias("matches"))
