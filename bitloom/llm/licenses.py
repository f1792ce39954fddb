"""License scans: winnowed fingerprints of templates, an inverted index, banded alignment.

The templates' fingerprints are the minima of hashes of some consecutive words over windows of such
hashes. All such hashes of a document are looked up in the index of these; as every hash of the
document is looked up, a common run of gram + window - 1 words is sure to share one. Of a template of
n words COVERAGE leaves a run of 2 words at least, of 10 words 3, of 20 words 4, however the missing
words are dealt out: ``sizes`` follows that, so no text that reaches it by missing or other words is
lost. Hits of one template whose diagonals lie within the band make a candidate, which is aligned
locally by dynamic programming within the band: matched words of the template over its length is the
coverage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bitloom.llm.common import arrow_map, slices

BAND = 6
#: Share of a template's words that must match for a report, or so many of its words: a part of a long text.
COVERAGE, PART_WORDS = 0.8, 40

# Notices, opening sentences and short whole texts of public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}

TEMPLATES["MIT-whole"] = TEMPLATES["MIT-text"] + """, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
TEMPLATES["BSD-2-Clause-whole"] = TEMPLATES["BSD"] + """: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_SPLIT = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_SPLIT).split()


def sizes(words: int) -> tuple[int, int]:
    """Words of a gram and grams of a window for a template of so many words."""
    return (min(2, words), 1) if words < 10 else (3, 1) if words < 20 else (3, 2)


class Templates:
    """Words, fingerprints and their inverted index, by words of a gram."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.names = sorted(templates)
        self.words = [words_of(templates[n]) for n in self.names]
        known = sorted({w for words in self.words for w in words})
        #: word to number from 1; words that no template has are 0
        self.number = {w: i + 1 for i, w in enumerate(known)}
        self.codes = [np.array([self.number[w] for w in words], np.int64) for words in self.words]
        self.index: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for gram in {sizes(len(c))[0] for c in self.codes if len(c)}:
            of = [(t, c) for t, c in enumerate(self.codes) if len(c) and sizes(len(c))[0] == gram]
            entries = sorted({(h, t, p) for t, codes in of for h, p in winnow(codes, gram, sizes(len(codes))[1])})
            self.index[gram] = tuple(np.array([e[k] for e in entries], kind) for k, kind in enumerate((np.uint64, np.int64, np.int64)))


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """A hash for each run of ``gram`` words."""
    n = len(codes) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(gram):
        h = (h ^ codes[k : k + n].astype(np.uint64)) * _STEPS[k]
        h ^= h >> np.uint64(29)
    return h


def winnow(codes: np.ndarray, gram: int, size: int) -> list[tuple[int, int]]:
    """(hash, place) of the rightmost minimum of each window of ``size`` hashes; a short sequence is one window."""
    h = gram_hashes(codes, gram)
    picked = set()
    for a in range(max(1, len(h) - size + 1) if len(h) else 0):
        window = h[a : a + size]
        picked.add(a + len(window) - 1 - int(np.argmin(window[::-1])))
    return [(int(h[p]), p) for p in sorted(picked)]


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """Banded local alignment of a template with a stretch of words: matched words, begin and end in ``text``.

    A match gains two, an unmatched word on either side costs one; words before and behind the best
    part of either are free. Cells stay within ``band`` of ``diagonal`` (place in text - place in
    template). Of equals the alignment with more matches, then the one that begins and ends later.
    """
    low, width = diagonal - band, 2 * band + 1
    nothing = (0, 0, 0)  # score, matched words, begin
    row: list[tuple[int, int, int]] = [nothing] * width
    best, end = nothing, 0
    for i, word in enumerate(template.tolist(), 1):
        new: list[tuple[int, int, int]] = []
        for k in range(width):
            j = i + low + k
            if j < 0 or j > len(text):
                new.append(nothing)
                continue
            cell = (0, 0, j)
            if j:
                gain = (2, 1) if text[j - 1] == word else (-1, 0)
                was = row[k] if row[k][0] else (0, 0, j - 1)
                cell = max(cell, (was[0] + gain[0], was[1] + gain[1], was[2]))
            if k + 1 < width and row[k + 1][0] > 1:
                cell = max(cell, (row[k + 1][0] - 1, *row[k + 1][1:]))
            if k and j and new[k - 1][0] > 1:
                cell = max(cell, (new[k - 1][0] - 1, *new[k - 1][1:]))
            new.append(cell)
            if cell[0] and (*cell, j) > (*best, end):
                best, end = cell, j
        row = new
    return (best[1], best[2], end) if best[0] else nothing


def scan(text: str | None, templates: Templates) -> list[tuple[str, float, int, int]]:
    """(template, coverage, begin, end in words) of all templates found, in order of place."""
    words = words_of(text)
    codes = np.fromiter((templates.number.get(w, 0) for w in words), np.int64, len(words))
    candidates: dict[int, list[int]] = {}
    for gram, (hashes, template, place) in templates.index.items():
        h = gram_hashes(codes, gram)
        low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        for i in np.flatnonzero(high > low).tolist():
            for k in range(int(low[i]), int(high[i])):
                candidates.setdefault(int(template[k]), []).append(i - int(place[k]))
    found = []
    for t, diagonals in candidates.items():
        taken: list[int] = []
        for d in sorted(diagonals):
            if taken and d - taken[-1] <= BAND // 2:
                continue
            taken.append(d)
        n, here = len(templates.codes[t]), []
        for d in taken:
            lo, hi = max(0, d - BAND), min(len(codes), d + n + BAND)
            if hi <= lo:
                continue
            matched, begin, end = align(templates.codes[t], codes[lo:hi], d - lo)
            if matched >= COVERAGE * n or matched >= PART_WORDS:
                here.append((matched, lo + begin, lo + end))
        # of those that overlap the one with most matched words
        chosen: list[tuple[int, int, int]] = []
        for m, a, b in sorted(here, key=lambda x: (-x[0], x[1:])):
            if all(b <= x or a >= y for _, x, y in chosen):
                chosen.append((m, a, b))
        found += [(templates.names[t], m / n, a, b) for m, a, b in chosen]
    return sorted(found, key=lambda f: (f[2], f[3], f[0]))


MATCHES = "doc_id long, license string, coverage double, first_word long, last_word long"


def licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row for each license text found: doc_id, license, coverage, first_word, last_word (behind the last).

    A text counts if it has COVERAGE of a template's words, or PART_WORDS of them in one place. A longer
    template and one that it contains are both reported. Null and short texts have none; repeated documents have rows
    each. The templates are a fixed table of some kilobytes, which each task gets with its code.
    """
    chosen = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(chosen)
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                rows = [(doc, *hit) for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True) for hit in scan(text, known)]
                if rows:
                    kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in MATCHES.split(", ")])

    return arrow_map(docs.select("doc_id", "text"), run, MATCHES)


def query(docs: DataFrame) -> DataFrame:
    """The license texts of all documents (see ``licenses``)."""
    return licenses(docs)
