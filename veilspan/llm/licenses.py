"""License scans by conditional compression.

A block of text that could be a license notice is compressed with each known template as a raw Zstandard dictionary. The template
that saves most against plain compression is the likeliest; the winners are confirmed by comparing words one by one.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_right
from itertools import accumulate

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import text_of

# Wording of public notices and license texts, by SPDX-like id.
TEMPLATES: dict[str, str] = {
    "Apache-2.0/line": "Licensed under the Apache License, Version 2.0.",
    "MIT/line": "Released under the MIT License.",
    "GPL-3.0/line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0/line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0/line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0/line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0/line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "BSD/line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
# Words of which a notice has at least one.
CUES = r"(?i)licen[cs]e|copyright|spdx|permission is hereby|permission to use|redistribut|public domain|creative commons|\bcc (?:by|0)|warrant(?:y|ies)"
BLOCK_CHARS = 4096  # longer blocks are scanned in overlapping windows of so many characters
LEAST_GAIN = 0.35
WORD = re.compile(r"\w+(?:[.\-+]\w+)*")
SCHEMA_FIELDS = "block int, start long, n_chars long, license string, gain double, exact boolean, missing int, added int, differences string"


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Scanner:
    """Holds a compressor for each template; made once for each Python worker and set of templates."""

    def __init__(self, templates: dict[str, str], level: int = 3):
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)
        self.known = []
        for name, text in sorted(templates.items()):
            data = zstandard.ZstdCompressionDict(self.form(text), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.known.append((name, words(text), zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=False, write_checksum=False)))

    @staticmethod
    def form(text: str) -> bytes:
        return " ".join(text.lower().split()).encode("utf-8", "surrogatepass")

    def rank(self, text: str) -> list[tuple[float, str]]:
        """Templates by the share of the plain size that they save, highest first, ties by name."""
        data = self.form(text)
        plain = max(1, len(self.plain.compress(data)) - 9)  # of a frame's own bytes
        return sorted(((1 - max(0, len(c.compress(data)) - 9) / plain, name) for name, _, c in self.known), key=lambda x: (-x[0], x[1]))

    def confirm(self, text: str, name: str) -> tuple[int, int, list[str]]:
        """Words of the template that the block lacks, words inside the match that the template lacks, and both as text."""
        want = next(w for n, w, _ in self.known if n == name)
        have = words(text)
        runs = [m for m in difflib.SequenceMatcher(None, want, have, autojunk=False).get_matching_blocks() if m.size]
        if not runs:
            return len(want), 0, [f"-{' '.join(want)}"]
        # The notice ends where its last words match; what stands before and after it in the block is other text.
        steps, at, to = [], 0, runs[0].b
        missing = added = 0
        for m in [*runs, None]:
            gone, new = (want[at : m.a], have[to : m.b]) if m else (want[at:], [])
            if gone:
                missing += len(gone)
                steps.append("-" + " ".join(gone))
            if new:
                added += len(new)
                steps.append("+" + " ".join(new))
            if m:
                at, to = m.a + m.size, m.b + m.size
        return missing, added, steps

    def scan(self, text: str, least_gain: float) -> tuple | None:
        """The best template among those within a small margin of the best gain, by fewest wording differences."""
        ranked = self.rank(text)
        gain = ranked[0][0]
        if gain < least_gain:
            return None
        near = [(sum((d := self.confirm(text, name))[:2]), -g, name, d) for g, name in ranked if g >= max(least_gain, gain - 0.15)]
        _, g, name, (missing, added, steps) = min(near)
        want = next(len(w) for n, w, _ in self.known if n == name)
        if missing + added > 0.5 * want:
            return None
        return name, -g, missing + added == 0, missing, added, " ".join(steps)


    def near(self, text: str, cues: re.Pattern, done: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """(start, end) of the parts of a text about a cue that have the words of a template, whatever the lines; done: parts known already."""
        found = list(WORD.finditer(text))
        have, starts = [m[0].lower() for m in found], [m.start() for m in found]
        out: dict[tuple[int, int], None] = {}
        for cue in cues.finditer(text):
            if any(s <= cue.start() and cue.end() <= e for s, e in done):
                continue
            at = max(0, bisect_right(starts, cue.start()) - 1)
            for _, want, _ in self.known:
                n, slack = len(want), max(2, len(want) // 10)
                low = max(0, at - n - slack)
                part = have[low : at + n + slack]
                kinds = set(want)
                if len(kinds.intersection(part)) < 0.5 * len(kinds):
                    continue
                place: dict[str, list[int]] = {}
                for j, w in enumerate(want):
                    place.setdefault(w, []).append(j)
                votes = [0] * (len(part) + n + slack + 1)  # by where the template would begin, plus n
                for i, w in enumerate(part):
                    for j in place.get(w, ()):
                        votes[i - j + n] += 1
                total = list(accumulate(votes, initial=0))
                first = max(range(len(votes) - slack), key=lambda d: total[d + slack] - total[d]) - n
                s = max(0, first - slack)
                runs = [m for m in difflib.SequenceMatcher(None, want, part[s : first + n + 2 * slack], autojunk=False).get_matching_blocks() if m.size]
                if sum(m.size for m in runs) >= 0.5 * n:
                    end = found[low + s + runs[-1].b + runs[-1].size - 1].end()
                    out[found[low + s + runs[0].b].start(), end + (text[end : end + 1] in (".", ")"))] = None
        return list(out)

    def scan_text(self, text: str, cues: re.Pattern, size: int, least_gain: float) -> list[tuple]:
        """(block, start, n_chars, *scan) of the blocks of cue lines, and of the parts about cues, that a template explains; where
        they overlap, of the one that agrees with the template in most words."""
        out, last = [], -1
        for n, start, block in blocks(text, cues, size):
            last = n
            if found := self.scan(block, least_gain):
                out.append((n, start, len(block), *found))
        sizes = {name: len(want) for name, want, _ in self.known}
        # a block of a few words more or less may be the start of a longer notice: only what is exact in itself and has no cue beside it is done
        done = [(x[1], x[1] + x[2]) for x in out if x[5] and not any(y is not x and abs(y[1] - x[1] - x[2]) < 2 for y in out) and sizes[x[3]] >= 20]
        for s, e in self.near(text, cues, done):
            # a few words out of the midst of prose must agree almost all
            if (found := self.scan(text[s:e], least_gain)) and (sizes[found[0]] >= 20 or found[3] + found[4] <= 0.2 * sizes[found[0]]):
                last += 1
                out.append((last, s, e - s, *found))
        kept: list[tuple] = []
        for x in sorted(out, key=lambda x: (x[6] + x[7] - sizes[x[3]], x[0])):
            if all(x[1] >= y[1] + y[2] or y[1] >= x[1] + x[2] for y in kept):
                kept.append(x)
        return sorted(kept)


def blocks(text: str, cues: re.Pattern, size: int) -> list[tuple[int, int, str]]:
    """Number, start and text of the lines, or runs of lines, that have a cue. Consecutive lines of one notice stay together."""
    out, n, at = [], 0, 0
    for part in re.split(r"(\n[ \t\r]*\n)", text) if "\n\n" in text or "\n" in text else [text]:
        lines, pos = part.split("\n"), at
        hot = [bool(cues.search(x)) for x in lines]
        i = 0
        while i < len(lines):
            if hot[i]:
                j = i
                while j + 1 < len(lines) and hot[j + 1]:
                    j += 1
                s = pos + sum(len(x) + 1 for x in lines[:i])
                block = "\n".join(lines[i : j + 1])
                if len(block) <= size:
                    out.append((n, s, block))
                else:  # windows that overlap by half, those with a cue
                    for k in range(0, len(block) - size // 2, size // 2):
                        if cues.search(block[k : k + size]):
                            out.append((n, s + k, block[k : k + size]))
                            n += 1
                n += 1
                i = j
            i += 1
        at += len(part)
    return out


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str | Column = "text", templates: dict[str, str] | None = None, least_gain: float = LEAST_GAIN, cues: str = CUES, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each block that a template explains: doc_id, block, start and n_chars (characters), license, gain, exact, missing,
    added (words), differences ("-" for the template's words that are absent, "+" for others in their place).

    Blocks are lines with a cue, with their neighbours that have one, and parts of the text about a cue that have the words of a
    template, over several lines or within a long one; these are numbered after the others. Of blocks that overlap there is one row. Null and empty texts give no row, repeated rows one each.
    Texts of any length are scanned whole; ties go to the name that sorts first; an empty table gives an empty result; further columns are
    ignored, whatever their names. Texts without a cue never reach Python. No shuffle.
    """
    known, pattern = dict(templates or TEMPLATES), re.compile(cues)
    block_chars = max(block_chars, 2 * max(map(len, known.values()), default=0))  # a template of any length fits into a window

    def run(frames):
        scanner = Scanner(known)
        for pdf in frames:
            rows = []
            for doc, text in zip(pdf.doc_id, pdf.text):
                rows += [(doc, *x) for x in scanner.scan_text(text, pattern, block_chars, least_gain)]
            yield pd.DataFrame(rows, columns=["doc_id", "block", "start", "n_chars", "license", "gain", "exact", "missing", "added", "differences"])

    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    return own.where(F.col("text").rlike(cues)).mapInPandas(run, "doc_id long, " + SCHEMA_FIELDS)
