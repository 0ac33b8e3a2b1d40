"""License texts in documents: MinHash bands over overlapping text windows retrieve templates, exact containment verifies.

Words are runs of letters and digits in lower case. A window is a run of consecutive five-word shingles, and windows start at
every shingle, so they overlap in all but one. A window's MinHash values are its least shingle hashes under several mixings;
bands of them are looked up among the bands of all windows of the templates. A template's window length follows from its
size (1, 4 or 8 shingles): a copy that keeps 0.8 of the template's shingles keeps a run of that many in place, since an edit
breaks up to five neighbouring shingles, and a window without an edit equals the template's window, so all its bands agree. A
window that shares 0.8 of its shingles is found with probability 1 - (1 - 0.8^ROWS)^BANDS, 0.98. In a window of one shingle,
which the shortest notices have, every MinHash value is that shingle's, so its bands are one and find it for certain. Around every window found,
the share of the template's shingles that the text holds is counted exactly; at least 0.8 is a match. Where one window's
surroundings hold less, those of the windows that follow are joined to them, as a copy may be interrupted by other words.

Templates are a bounded parameter and travel with the code; nothing is shuffled.

Defined cases: a null or empty text has no match; a template of fewer than five words is one shingle; a text that holds a
template several times gives a row for each place; parts that are more than four times the template's size apart are not one
copy; two templates that share wording can both match one place; very long texts are scanned whole; repeated rows give repeated
matches, null ids matches with a null id; an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SLICE_BYTES, slices, text_buffer, trim
from .hashing import mixed, word_hashes
from .tokens import _LOWER

WORDS = 5
BANDS, ROWS = 4, 2
THRESHOLD = 0.8
#: Window lengths and the least template size, in shingles, for which each is used.
WINDOWS = ((8, 32), (4, 8), (1, 1))
#: Sizes of its template that an interruption of a copy can have.
APART = 4
_FILTER_BITS = 22

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

#: Wording of public licenses and notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
    "permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy "
    "of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is "
    "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
    "Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
    "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
    "DAMAGE.",
    "BSD-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission.",
    "MIT-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
    "IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
    "Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
    "Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
    "Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the "
    "Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
    "obtain one at http://mozilla.org/MPL/2.0/.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
    "http://www.eclipse.org/legal/epl-2.0.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
    "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
    "redistribute it freely, subject to the following restrictions:",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
    "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain "
    "worldwide. This software is distributed without any warranty.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0-notice": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
}


def text_shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, offsets of the texts into them); a text of 1 to words - 1 words has one shingle."""
    n = len(data)
    solid = _WORD[data]
    begin = np.zeros(n + 1, bool)
    begin[offsets] = True
    first, last = solid.copy(), solid.copy()
    if n:
        first[1:] &= ~solid[:-1] | begin[1:n]
        last[:-1] &= ~solid[1:] | begin[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    h = word_hashes(_LOWER[data], start, end) if len(start) else np.zeros(0, np.uint64)
    bounds = np.searchsorted(start, offsets)
    count = np.diff(bounds)
    left = np.repeat(bounds[1:], count) - np.arange(len(h))
    total = np.zeros(len(h), np.uint64)
    for j in range(words):
        part = np.zeros(len(h), np.uint64)
        part[: max(0, len(h) - j)] = h[j:]
        total = total * np.uint64(0x100000001B3) + np.where(left > j, part, np.uint64(0))
    lead = np.zeros(len(h), bool)
    lead[bounds[:-1][count > 0]] = True
    keep = (left >= words) | (lead & (left < words))
    sizes = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    return mixed(total[keep]), np.concatenate([[0], np.cumsum(sizes)])


def window_bands(shingles: np.ndarray, width: int) -> np.ndarray:
    """bands x windows: keys of the windows of ``width`` shingles that start at each shingle (the last ones wrap into padding)."""
    if width == 1:
        return mixed(shingles)[None, :]
    values = []
    for k in range(BANDS * ROWS):
        v = mixed(shingles ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64))
        step = 1
        while step < width:  # windows of 1, 2, 4 ... width
            w = v.copy()
            w[: len(v) - step] = np.minimum(v[: len(v) - step], v[step:])
            v, step = w, 2 * step
        values.append(v)
    return np.stack([mixed(sum((values[b * ROWS + r] * np.uint64(2 * r + 3) for r in range(ROWS)), np.uint64(b))) for b in range(BANDS)])


class Index:
    """Bands of all windows of the templates, by window length."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.shingles = []
        rows: dict[int, list[tuple[int, int, int]]] = {}
        for t, text in enumerate(templates.values()):
            raw = np.frombuffer(text.encode(), np.uint8)
            s, _ = text_shingles(raw, np.array([0, len(raw)]))
            self.shingles.append(s)
            if len(s):
                width = next(w for w, least in WINDOWS if len(s) >= least)
                for key, at in zip(window_bands(s, width)[:, : len(s) - width + 1].T, range(len(s)), strict=False):
                    rows.setdefault(width, []).extend((int(k), t, at) for k in key)
        self.sets = [set(s.tolist()) for s in self.shingles]
        self.tables = {}
        for width, found in rows.items():
            found.sort()
            keys = np.array([r[0] for r in found], np.uint64)
            hint = np.zeros(1 << _FILTER_BITS, bool)
            hint[(keys & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
            self.tables[width] = (keys, np.array([r[1] for r in found]), np.array([r[2] for r in found]), hint)

    def candidates(self, shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Distinct rows (text, template, where the template would start) of windows that share a band."""
        out = []
        sizes = np.diff(offsets)
        text = np.repeat(np.arange(len(sizes)), sizes)
        for width, (keys, template, at, hint) in self.tables.items():
            room = offsets[text + 1] - np.arange(len(shingles)) >= width
            for band in window_bands(shingles, width):
                may = np.flatnonzero(hint[(band & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] & room)
                lo, hi = np.searchsorted(keys, band[may], "left"), np.searchsorted(keys, band[may], "right")
                n = hi - lo
                place = np.repeat(may, n)
                k = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                out.append(np.stack([text[place], template[k], place - offsets[text[place]] - at[k]], 1))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)

    def _joined(self, found: list[list[int]], i: int, own: np.ndarray, reach: int, slack: int) -> tuple[float, list[int]]:
        """Containment and places of the template's shingles from candidate ``i`` to the last one that adds to them, before the next whole copy."""
        text, t, start = found[i]
        size, wanted = len(self.shingles[t]), self.sets[t]
        held: list[int] = []
        seen: set[int] = set()
        at, grown = max(0, start - slack, reach), start
        while i < len(found) and found[i][:2] == [text, t] and found[i][2] < grown + (APART + 1) * size:
            end = min(len(own), found[i][2] + size + slack)
            if len(wanted.intersection(own[max(0, found[i][2] - slack, reach) : end].tolist())) >= THRESHOLD * len(wanted):
                break  # a whole copy of its own
            if end > at:
                new = [(j, x) for j, x in enumerate(own[at:end].tolist(), at) if x in wanted]
                if any(x not in seen for _, x in new):
                    held += [j for j, _ in new]
                    seen.update(x for _, x in new)
                    grown = found[i][2]
                at = end
            i += 1
        return len(seen) / len(wanted), held

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, str, int, int, float]]:
        """(text, template, first word, word behind the last, containment) of every place that holds a template."""
        shingles, bounds = text_shingles(data, offsets)
        out = []
        found = self.candidates(shingles, bounds).tolist()
        i = 0
        key, reach = None, 0
        while i < len(found):
            text, t, start = found[i]
            size, wanted = len(self.shingles[t]), self.sets[t]
            if (text, t) != key:
                key, reach = (text, t), 0
            own = shingles[bounds[text] : bounds[text + 1]]
            slack, first = max(2, size // 4), i
            best: tuple[float, list[int]] = (0.0, [])
            while i < len(found) and found[i][:2] == [text, t] and found[i][2] < start + size:  # the starts of one place
                lo, hi = max(0, found[i][2] - slack, reach), min(len(own), found[i][2] + size + slack)
                held = [j for j, x in enumerate(own[lo:hi].tolist(), lo) if x in wanted]
                share = len({int(own[j]) for j in held}) / len(wanted)
                if share > best[0]:
                    best = (share, held)
                i += 1
            if best[0] < THRESHOLD:
                best = self._joined(found, first, own, reach, slack)
            if best[0] >= THRESHOLD:
                held = best[1]
                while own[held[-1]] in own[held[:-1]]:  # the ends repeat what the place holds already: a neighbouring copy's
                    held = held[:-1]
                while own[held[0]] in own[held[1:]]:
                    held = held[1:]
                reach = held[-1] + 1
                out.append((text, self.names[t], held[0], held[-1] + WORDS, best[0]))
        return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, first_word, end_word, containment: a row for each place of docs (doc_id, text) that holds a template."""
    templates = TEMPLATES if templates is None else templates
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b in slices(offsets, SLICE_BYTES // 2):
                found = index.matches(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                cols = list(zip(*found, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([a + i for i in cols[0]], pa.int64())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.float64())],
                    names=["doc_id", "license", "first_word", "end_word", "containment"],
                )
        trim()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, license string, first_word long, end_word long, containment double")
