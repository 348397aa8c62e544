"""License scans by conditional compression.

Blocks of text with license words are compressed alone and with each template as a raw zstandard
dictionary. Templates are ranked by how much they shorten the block, and the best one whose exact
wording differences are small is a license of the block. Its words are cut out, and what is left before
and after them is scanned again until nothing is confirmed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweft.llm.common import text_of

#: Wordings of common licenses and notices, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
        " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in"
        ' writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,'
        " either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the'
        ' "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,'
        " distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to"
        " the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions"
        ' of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE'
        " WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS"
        " BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN"
        " CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are"
        " met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
        " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the"
        " documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its"
        " contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Licensed under the BSD 3-Clause License.",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are"
        " met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
        " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the"
        " documentation and/or other materials provided with the distribution.",
        "Licensed under the BSD 2-Clause License.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the"
        " above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this"
        " file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
}
#: The disclaimers that end the full texts of these licenses.
BSD_DISCLAIMER = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED'
    " TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR"
    " CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,"
    " PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF"
    " LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS"
    " SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
ISC_DISCLAIMER = (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF'
    " MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY"
    " DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,"
    " ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
for _name, _end in (("BSD-3-Clause", BSD_DISCLAIMER), ("BSD-2-Clause", BSD_DISCLAIMER), ("ISC", ISC_DISCLAIMER)):
    TEMPLATES[_name] = (TEMPLATES[_name][0] + _end, *TEMPLATES[_name])
TEMPLATES["Unlicense"] += (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or"
    " distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
)
TEMPLATES["EPL-2.0"] = ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",)
#: The GNU and Creative Commons families, by rule.
for _spdx, _kind, _versions in (("GPL", "", ("2", "3")), ("LGPL", "Lesser ", ("2.1", "3")), ("AGPL", "Affero ", ("3",))):
    for _version in _versions:
        TEMPLATES[f"{_spdx}-{_version}" + ".0" * ("." not in _version)] = (
            f"This work is licensed under the GNU {_kind}General Public License, version {_version}.",
            f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {_kind}General Public License as published by"
            f" the Free Software Foundation, either version {_version} of the License, or (at your option) any later version.",
        )
for _kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
    for _version in ("3.0", "4.0"):
        TEMPLATES[f"CC-{_kind}-{_version}"] = (f"Licensed under CC {_kind} {_version}.", f"This work is licensed under CC {_kind} {_version}.")

CUE = r"(?i)licen[cs]|copyright|permission|redistribut|spdx|\bCC[ -]BY\b|public domain|free software|unencumbered"
#: Least share of a block's bytes that a template must save, and most words of the template that may be missing (percent).
LEAST_SAVED = 0.2
MOST_MISSING_PCT = 10
#: Lines without a license word that may stand between two lines of one block.
GAP = 2
#: Words of the templates that say nothing about licenses.
COMMON = frozenset("a an and any are as at be by can for from if in is its it may no not of on one or so that the their this to was with you".split())
#: Words that make another license of a name when they are added to it.
NAME_WORDS = frozenset(("lesser", "library", "affero"))
#: Punctuation that ends a wording.
STOP = re.compile(r"[^\w\s]*")
#: Windows of a long block, in longest licenses, and the parts whose result a worker remembers.
WINDOW_LICENSES = 3
REMEMBERED = 1024
WORD = re.compile(r"[\w.+-]*\w")
LINE = re.compile(r"[^\n]+")
#: What ends in a stop before a capital letter; only looked at where a line as a whole fits no template.
SENTENCE = re.compile(r"\S.*?(?:[.!?](?=\s+[A-Z])|$)")


class Scanner:
    """Templates as words and as raw dictionaries."""

    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES):
        self.cue = re.compile(CUE)
        self.alone = zstandard.ZstdCompressor(level=19)
        self.templates = []
        self.vocabulary = {w for wordings in templates.values() for wording in wordings for w in WORD.findall(wording.lower())} - COMMON
        for name, wordings in templates.items():
            for wording in wordings:
                raw = " ".join(wording.lower().split()).encode()
                dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                self.templates.append((name, WORD.findall(wording.lower()), zstandard.ZstdCompressor(level=19, dict_data=dictionary)))
        #: No license is longer, in words: all of a template and the words that may be added to it.
        self.longest = max(len(wanted) * (100 + 2 * MOST_MISSING_PCT) // 100 + 1 for _, wanted, _ in self.templates)
        #: Wordings that are no part of a longer one: a line that holds one needs no look at its neighbours.
        joined = [" ".join(wanted) for _, wanted, _ in self.templates]
        self.whole = {one for one in joined if not any(f" {one} " in f" {other} " for other in joined if other != one)}
        self.remembered = lru_cache(REMEMBERED)(self.best)

    def blocks(self, text: str) -> Iterator[tuple[int, int]]:
        """Start and end of the runs of lines with template words, over gaps of up to ``GAP`` other lines.

        A line belongs to a run if it has a license word or at least half of its words, common ones left out, are words of templates.
        """
        start, end, gap, cued, at = -1, -1, 0, False, 0
        for line in text.split("\n"):
            cue = bool(self.cue.search(line))
            if cue or self.like_a_template(line):
                if start < 0:
                    start, cued = at, False
                end, gap, cued = at + len(line), 0, cued or cue
            elif start >= 0:
                gap += 1
                if gap > GAP:
                    if cued:
                        yield start, end
                    start = -1
            at += len(line) + 1
        if start >= 0 and cued:
            yield start, end

    def like_a_template(self, line: str) -> bool:
        words = [w for w in WORD.findall(line.lower()) if w not in COMMON]
        return bool(words) and 2 * sum(w in self.vocabulary for w in words) >= len(words)

    def match(self, words: list[str], wanted: list[str]) -> tuple[int, int, int, int] | None:
        """(first matched word, end, template words missing in the text, other words inside the matched part).

        The longest common run places the template; its other words are looked for as far around as the allowed
        differences reach. A part at an end that is shorter than the gap to the next one doesn't count.
        """
        run = SequenceMatcher(None, words, wanted, autojunk=False).find_longest_match()
        if not run.size:
            return None
        slack = len(wanted) * 2 * MOST_MISSING_PCT // 100 + 1
        low = max(0, run.a - run.b - slack)
        near = words[low : run.a + len(wanted) - run.b + slack]
        parts = [m for m in SequenceMatcher(None, near, wanted, autojunk=False).get_matching_blocks() if m.size]
        while len(parts) > 1 and parts[0].size < parts[1].a - parts[0].a - parts[0].size:
            parts.pop(0)
        while len(parts) > 1 and parts[-1].size < parts[-1].a - parts[-2].a - parts[-2].size:
            parts.pop()
        same, first, end = sum(m.size for m in parts), parts[0].a, parts[-1].a + parts[-1].size
        return low + first, low + end, len(wanted) - same, end - first - same

    def names_differ(self, words: list[str], wanted: list[str]) -> bool:
        """Whether a part of the template's name (a word with a digit or a hyphen) is missing, or one is added to it."""
        return not {w for w in wanted if re.search(r"[\d-]", w)} <= set(words) or bool(NAME_WORDS & set(words) - set(wanted))

    def scan(self, text: str | None) -> list[tuple]:
        """(start, end, license, saved, missing, added) of the confirmed licenses of a text, by start."""
        return sorted(found for start, end in self.blocks(text or "") for found in self.within(text, start, end))

    def within(self, text: str, start: int, end: int) -> Iterator[tuple]:
        """The licenses of text[start:end]: first lines that hold a whole wording to the word, then windows of what is left."""
        at = start
        for line in LINE.finditer(text[start:end]) if "\n" in text[start:end] else ():
            found = self.cue.search(line[0]) and self.remembered(line[0])
            if found and found[4] == found[5] == 0 and " ".join(WORD.findall(line[0][found[0] : found[1]].lower())) in self.whole:
                first, last = (start + line.start() + place for place in found[:2])
                yield first, last, *found[2:]
                yield from self.windows(text, at, first)
                at = last
        yield from self.windows(text, at, end)

    def windows(self, text: str, start: int, end: int) -> Iterator[tuple]:
        """The licenses of text[start:end], window by window.

        A window is ``WINDOW_LICENSES`` times the longest license. A license counts in the window in which it begins more than
        the longest one before the end, so it stands in it whole; the next window begins there or after the last
        license. So the time is linear in the length.
        """
        places = [m.start() for m in WORD.finditer(text, start, end)]
        first = 0
        while len(places) - first > WINDOW_LICENSES * self.longest:
            last = first + WINDOW_LICENSES * self.longest
            border = following = places[last - self.longest]
            for found in self.inside(text, start, places[last]):
                if found[0] < border:
                    yield found
                    following = max(following, found[1])
            start, first = following, bisect_left(places, following)
        yield from self.inside(text, start, end)

    def inside(self, text: str, start: int, end: int) -> Iterator[tuple]:
        """The licenses of one window: the best one, then those before and after its words; where none fits, line by line, then sentence by sentence."""
        todo = [(start, end)]
        while todo:
            start, end = todo.pop()
            part = text[start:end]
            if not self.cue.search(part):
                continue
            found = self.remembered(part)
            if found:
                yield (start + found[0], start + found[1], *found[2:])
                todo += [(start, start + found[0]), (start + found[1], end)]
            else:
                pieces = list((LINE if "\n" in part else SENTENCE).finditer(part))
                todo += [(start + m.start(), start + m.end()) for m in pieces if m[0] != part]

    def best(self, block: str):
        """(start, end, license, saved, missing, added) of the best confirmed template (the earlier one of two that save as much), or None."""
        raw = " ".join(block.lower().split()).encode()
        places = list(WORD.finditer(block))
        words = [m[0].lower() for m in places]
        size = len(self.alone.compress(raw))
        ranked = sorted(((size - len(c.compress(raw))) / size, -i) for i, (_, _, c) in enumerate(self.templates))
        for saved, i in reversed(ranked):
            name, wanted, _ = self.templates[-i]
            if saved < LEAST_SAVED * min(1.0, len(wanted) / max(1, len(words))):
                continue
            match = self.match(words, wanted)
            if not match:
                continue
            first, end, missing, added = match
            small = missing * 100 <= MOST_MISSING_PCT * len(wanted) and added * 100 <= 2 * MOST_MISSING_PCT * len(wanted)
            if small and not self.names_differ(words[first:end], wanted):
                return places[first].start(), STOP.match(block, places[end - 1].end()).end(), name, round(saved, 4), missing, added
        return None


def license_scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """doc_id, start, end (code points), license, saved, n_missing, n_added of every confirmed license.

    A block of lines can hold several, each with the span of its own words. Blocks are runs of lines with license words; JVM regular expressions leave other documents out before
    any Python runs. ``saved`` is the share of compressed bytes that the template saves, of the block (its window, if it is long) or what other
    licenses leave of it; of templates that save as much the earlier one wins;
    ``n_missing`` and ``n_added`` are the exact wording differences in words. Null and empty texts have no
    blocks, null doc_id stays null, repeated rows each give rows, an empty table gives no rows, other
    columns are ignored.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates)
        for batch in batches:
            out = [(doc_id, *found) for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True) for found in scanner.scan(text)]
            yield pd.DataFrame(out, columns=["doc_id", "start", "end", "license", "saved", "n_missing", "n_added"])

    candidates = docs.filter(text_of().rlike(CUE)).select(F.col("doc_id").cast("string"), "text")
    out = candidates.mapInPandas(rows, "doc_id string, start long, end long, license string, saved double, n_missing long, n_added long")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
