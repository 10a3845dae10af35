"""License scans: winnowed fingerprints pick candidate places, banded alignment measures them.

Templates are short license notices, the paragraphs of licenses, and whole texts where paragraphs alone do not tell near
licenses apart (the two of BSD, the GNU family): of those the one with most matched words wins.  Their word trigrams are winnowed into an inverted index
of some thousand hashes.  A document is hashed whole; hits of its winnowed trigrams in the index, gathered by template
and diagonal, are candidates; local alignments within a band around each such diagonal find all notices there.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import BODIES
from .shingles import gram_hashes, word_spans

GRAM_WORDS = 3
#: The least hash of so many neighbouring trigrams is a fingerprint, in templates and documents alike.
WINDOW = 2
#: Words by which an alignment may leave its diagonal.
BAND = 12
#: Share of a template's words that an alignment must match to be reported.
LEAST_COVERAGE = 0.7
MATCH, MISMATCH, GAP = 2, -1, -1
#: Windows of one text whose alignments are remembered for the same words further on.
SEEN_WINDOWS = 4096

# License notices as their licenses print them.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."],
}

# The standard notices that licenses of one family share but for a few words.
_GNU = (
    "This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by "
    "the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version."
)
_GNU_WARRANTY = (
    " This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
    "FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details. You should have received a copy of the GNU {kind}General Public License along with this {what}"
)
_GNU_SEE = ". If not, see <https://www.gnu.org/licenses/>."
_GNU_WRITE = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"
_BSD_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution."
)
_BSD_NAMES = (
    " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission."
)
_BSD_DISCLAIMER = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_DISCLAIMER = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE {who} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)


def _gnu(kind: str, version: str, what: str = "program") -> list[str]:
    """The standard notice's first paragraph, and all of it."""
    new = version == "3"
    own = {"what": what, "kind": kind, "version": version, "mark": ":" if new else ";", "comma": "," if new else ";"}
    return [_GNU.format(**own), (_GNU + _GNU_WARRANTY).format(**own) + (_GNU_SEE if new else _GNU_WRITE)]


for _name, _texts in {
    "Apache-2.0": ["Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"],
    "MIT": [
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        _MIT_DISCLAIMER.format(who="AUTHORS OR COPYRIGHT HOLDERS"),
    ],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", _gnu("", "3")[1]],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991", _gnu("", "2")[1]],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", *_gnu("Lesser ", "3")],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", *_gnu("Lesser ", "2.1", "library")],
    "LGPL-2.0": ["This work is licensed under the GNU Library General Public License, version 2.", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991", *_gnu("Library ", "2", "library")],
    "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", *_gnu("Affero ", "3")],
    "BSD-2-Clause": [_BSD_CLAUSES, _BSD_CLAUSES + _BSD_DISCLAIMER],
    "BSD-3-Clause": [_BSD_CLAUSES + _BSD_NAMES, _BSD_CLAUSES + _BSD_NAMES + _BSD_DISCLAIMER],
    "ISC": [
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY "
        "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
        "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, "
        "the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the "
        "public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and "
        "future rights to this software under copyright law. " + _MIT_DISCLAIMER.format(who="AUTHORS") + " For more information, please refer to <https://unlicense.org/>"
    ],
}.items():
    TEMPLATES[_name] = TEMPLATES.get(_name, []) + _texts
for _name, _texts in BODIES.items():
    TEMPLATES[_name] = TEMPLATES.get(_name, []) + _texts


def winnow(grams: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the least hash (the last of equals) of every ``window`` neighbouring ones."""
    if len(grams) == 0:
        return np.zeros(0, dtype=np.int64)
    window = min(window, len(grams))
    views = np.lib.stride_tricks.sliding_window_view(grams, window)
    return np.unique(np.arange(len(views)) + window - 1 - views[:, ::-1].argmin(axis=1))


class TemplateIndex:
    """Fingerprints of all templates: sorted hashes with the template and position of each."""

    def __init__(self, templates: dict[str, list[str]]):
        self.templates = [(name, number, word_spans(text)[0]) for name, texts in sorted(templates.items()) for number, text in enumerate(texts)]
        rows = [(h, t, i) for t, (_, _, words) in enumerate(self.templates) for g in [gram_hashes(words, GRAM_WORDS)] for i in winnow(g).tolist() for h in [int(g[i])]]
        rows.sort()
        self.hashes = np.array([r[0] for r in rows], dtype=np.uint64)
        self.where = np.array([r[1:] for r in rows], dtype=np.int64).reshape(-1, 2)

    def hits(self, words: np.ndarray) -> np.ndarray:
        """Rows of (template, diagonal, word) for every fingerprint of the document that a template has."""
        grams = gram_hashes(words, GRAM_WORDS)
        at = winnow(grams)
        at = at[np.isin(grams[at], self.hashes)]
        low, high = np.searchsorted(self.hashes, grams[at], "left"), np.searchsorted(self.hashes, grams[at], "right")
        sizes = high - low
        entry = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        word = np.repeat(at, sizes)
        return np.column_stack([self.where[entry, 0], word - self.where[entry, 1], word])


def align(template: np.ndarray, words: np.ndarray, band: int = BAND) -> tuple[int, int, int, int]:
    """Best local alignment with ``words[i]`` near ``template[i - band]``: score, matched words, first word, end word."""
    previous: dict[int, tuple[int, int, int]] = {}
    best = (0, 0, 0, 0)
    for i, word in enumerate(template.tolist()):
        row: dict[int, tuple[int, int, int]] = {}
        left = (0, 0, 0)
        for j in range(i, min(len(words), i + 2 * band + 1)):
            diagonal, up = previous.get(j - 1, (0, 0, j)), previous.get(j, (0, 0, j))
            hit = int(words[j]) == word
            cell = max((diagonal[0] + (MATCH if hit else MISMATCH), diagonal[1] + hit, diagonal[2]), (up[0] + GAP, up[1], up[2]), (left[0] + GAP, left[1], left[2]), key=lambda c: (c[0], c[1]))
            left = cell if cell[0] > 0 else (0, 0, j + 1)
            row[j] = left
            if left[0] > best[0]:
                best = (left[0], left[1], left[2], j + 1)
        previous = row
    return best


def _reachable(template: np.ndarray, padded: np.ndarray, band: int = BAND) -> int:
    """At least as many words as an alignment in the band can match."""
    short = len(template) + 2 * band - len(padded)
    views = np.lib.stride_tricks.sliding_window_view(np.concatenate([padded, np.zeros(max(0, short), dtype=np.uint64)]), 2 * band + 1)
    return int((views[: len(template)] == template[:, None]).any(axis=1).sum())


def _alignments(template: np.ndarray, padded: np.ndarray, least: float) -> list[tuple[int, int, int]]:
    """(matched words, first word, end word) of notices side by side in one window: the best, then those before and after it."""
    found, ranges = [], [(0, len(padded))]
    while ranges:
        low, high = ranges.pop()
        part = np.zeros_like(padded)
        part[low:high] = padded[low:high]
        if _reachable(template, part) < least * len(template):
            continue
        score, matched, a, b = align(template, part)
        if score <= 0:
            continue
        if matched / len(template) >= least:
            found.append((matched, a, b))
        ranges += [(low, a), (b, high)]
    return found


def _apart(found: set[tuple]) -> list[tuple]:
    """Of rows that overlap, the one with most matched words (then the better covered, then the first), in order of place."""
    firsts: list[int] = []
    kept: list[tuple] = []
    for row in sorted(found, key=lambda r: (-r[0], -r[1], r[2], r[4], r[5])):
        at = bisect_left(firsts, row[2])
        if (at == 0 or kept[at - 1][3] <= row[2]) and (at == len(kept) or row[3] <= firsts[at]):
            firsts.insert(at, row[2])
            kept.insert(at, row)
    return kept


def scan_text(text: str, index: TemplateIndex, least: float = LEAST_COVERAGE) -> list[tuple]:
    """(license, template, coverage, first character, end character, matched words) of the notices in a text.

    Every diagonal with a hit gets its window, unless a complete notice already explains all its hits, and every window
    gives all notices side by side in it.  Of alignments that overlap, the one with most matched words is kept (then the
    better covered, then the first).
    """
    words, starts, ends = word_spans(text)
    found: set[tuple] = set()
    hits = index.hits(words)
    if not len(hits):
        return []
    hits = hits[np.lexsort([hits[:, 1], hits[:, 0]])]
    new = np.flatnonzero(np.append(True, (np.diff(hits[:, 0]) != 0) | (np.diff(hits[:, 1]) > BAND)))
    seen: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
    known, common = -1, np.zeros(0, dtype=np.int64)
    for part in np.split(hits, new[1:]):
        name, number, template = index.templates[part[0, 0]]
        t, size = int(part[0, 0]), len(template) + 2 * BAND + 1
        if t != known:
            known, common = t, np.append(0, np.cumsum(np.isin(words, template)))
        diagonals, first_hit = np.unique(part[:, 1], return_index=True)
        own = dict(zip(diagonals.tolist(), np.split(part[:, 2], first_hit[1:]), strict=True))
        whole = np.zeros(0, dtype=np.int64)
        centres = np.append(int(np.median(part[:, 1])), diagonals)
        # Windows that hold too few of the template's words cannot give a notice.
        enough = common[np.clip(centres - BAND + size, 0, len(words))] - common[np.clip(centres - BAND, 0, len(words))] >= least * len(template)
        for centre in dict.fromkeys(centres[enough].tolist()):
            if centre in own and len(whole) and np.isin(own[centre], whole).all():
                continue
            first = centre - BAND
            lead = max(0, -first)
            # A window cut by the text's start is moved along the band by words that match nothing.
            padded = np.concatenate([np.zeros(lead, dtype=np.uint64), words[max(0, first) : first + size]])
            key = (t, padded.tobytes())
            if key not in seen:
                if len(seen) >= SEEN_WINDOWS:
                    seen.clear()
                seen[key] = _alignments(template, padded, least)
            for matched, a, b in seen[key]:
                a, b = max(a, lead) + max(0, first) - lead, b + max(0, first) - lead
                found.add((matched, matched / len(template), a, b, name, number))
                if matched == len(template) == b - a:
                    # Grams that begin in a complete notice and end behind it are left to their own windows.
                    whole = np.append(whole[whole > centre - len(template) - 2 * BAND], np.arange(a, max(a + 1, b - GRAM_WORDS + 1)))
    data, out, char, byte = text.encode("utf-8", "surrogatepass"), [], 0, 0
    length = lambda low, high: len(data[low:high].decode("utf-8", "surrogatepass"))
    for matched, coverage, a, b, name, number in _apart(found):
        begin = char + length(byte, int(starts[a]))
        char, byte = begin + length(int(starts[a]), int(ends[b - 1])), int(ends[b - 1])
        out.append((name, number, coverage, begin, char, matched))
    return out


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, key: str = "doc_id", text: str = "text", least: float = LEAST_COVERAGE) -> DataFrame:
    """One row per notice found: ``doc_id``, ``license``, ``template`` (its number), ``coverage`` (matched share of the
    template's words), ``first_char``, ``end_char``, ``matched_words``, ``matched_text``.

    Words are runs of ASCII letters and digits, whatever stands between them.  The index holds the templates alone, so
    it travels with the task; no rows are exchanged and a document, however often it occurs, is scanned by itself.
    Null and empty texts and an empty table give no rows; repeated rows give theirs again; null keys stay; other columns are not
    read.  Texts of any length are scanned whole; of
    overlapping notices that with most matched words stays, then the better covered, the first, and the first license and template.
    """
    index = TemplateIndex(TEMPLATES if templates is None else templates)
    kind = docs.select(F.col(key)).schema[0].dataType
    # Keys travel as text: a batch that holds a null would round large numbers.
    rows = docs.select(F.col(key).cast("string").alias("doc_id"), F.col(text).alias("text"))
    schema = rows.drop("text").schema.add("license", "string").add("template", "integer").add("coverage", "double").add("first_char", "long").add("end_char", "long").add("matched_words", "integer").add("matched_text", "string")

    def scan(batches):
        for batch in batches:
            out = []
            for doc, whole in zip(batch["doc_id"], batch["text"], strict=True):
                if isinstance(whole, str) and whole:
                    out += [(doc, *row, whole[row[3] : row[4]]) for row in scan_text(whole, index, least)]
            yield pd.DataFrame(out, columns=["doc_id", "license", "template", "coverage", "first_char", "end_char", "matched_words", "matched_text"])

    found = rows.mapInPandas(scan, schema)
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))
