"""License scans by sentence-rule recognition.

A text is cut into sentences; comment marks, case, punctuation and white space are
normalised away. Each sentence is looked up among the known licence sentences, which gives
its identifier; where it isn't one itself, every run of its lines that is gives one, as lines
without a stop are one sentence. The identifiers, in order, are matched against the licence
rules, ordered themselves: the first rule takes its identifiers first. Between two identifiers
of a match at most `gap` sentences may stand that are not known. Work grows with a text, not
with its square: lines are normalised once, and a known sentence is tried where its first word
begins a line.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

# Licence sentences by identifier. `*` stands for any words, one at least.
SENTENCES: dict[str, tuple[str, ...]] = {
    "apache-2-line": ("Licensed under the Apache License, Version 2.0", "Released under the Apache License, Version 2.0"),
    "apache-2-head": ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License',),
    "apache-2-copy": ("You may obtain a copy of the License at", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    "apache-2-basis": ('Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',),
    "apache-2-see": ("See the License for the specific language governing permissions and limitations under the License",),
    "mit-line": ("Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License"),
    "mit-grant": ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',),
    "mit-notice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",),
    "mit-as-is": ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',),
    "mit-liability": ("IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",),
    "bsd-grant": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",),
    "bsd-binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",),
    "bsd-names": ("Neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "bsd-as-is": ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',),
    "isc-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    "gpl-3-line": ("This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3"),
    "gpl-3-later": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "gpl-2-later": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",),
    "gpl-hope": ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",),
    "gpl-details": ("See the GNU General Public License for more details",),
    "gpl-received": ("You should have received a copy of the GNU General Public License along with this program",),
    "mpl-2": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "cc-by-nc-4-line": ("Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0"),
    "cc-by-4-line": ("Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "cc-by-sa-4-line": ("Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0"),
    "cc0-line": ("Dedicated to the public domain under CC0 1.0",),
    "unlicense": ("This is free and unencumbered software released into the public domain",),
    "lgpl-later": ("This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "lgpl-2-later": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",),
    "agpl-later": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "zlib-as-is": ("This software is provided 'as-is', without any express or implied warranty",),
    "zlib-grant": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",),
    "bsl-line": ("Distributed under the Boost Software License, Version 1.0",),
    "epl-2-line": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
    "ofl-line": ("This Font Software is licensed under the SIL Open Font License, Version 1.1",),
    "all-rights": ("All rights reserved",),
}

# Licences by the identifiers that make them, in the order in which they are tried.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("apache-2-head", "apache-2-copy", "apache-2-basis", "apache-2-see")),
    ("Apache-2.0", ("apache-2-head", "apache-2-copy")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl-3-later", "gpl-hope", "gpl-details", "gpl-received")),
    ("GPL-3.0-or-later", ("gpl-3-later",)),
    ("GPL-2.0-or-later", ("gpl-2-later", "gpl-hope", "gpl-details", "gpl-received")),
    ("GPL-2.0-or-later", ("gpl-2-later",)),
    ("Apache-2.0", ("apache-2-line",)),
    ("Apache-2.0", ("apache-2-head",)),
    ("MIT", ("mit-line",)),
    ("ISC", ("isc-grant",)),
    ("GPL-3.0-only", ("gpl-3-line",)),
    ("MPL-2.0", ("mpl-2",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-line",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-line",)),
    ("CC-BY-4.0", ("cc-by-4-line",)),
    ("CC0-1.0", ("cc0-line",)),
    ("Unlicense", ("unlicense",)),
    ("LGPL-3.0-or-later", ("lgpl-later",)),
    ("LGPL-2.1-or-later", ("lgpl-2-later",)),
    ("AGPL-3.0-or-later", ("agpl-later",)),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("BSL-1.0", ("bsl-line",)),
    ("EPL-2.0", ("epl-2-line",)),
    ("OFL-1.1", ("ofl-line",)),
)

# Licences that a file may name by an identifier line.
SPDX = "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BlueOak-1.0.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-2.0 MS-PL NCSA OFL-1.1 OSL-3.0 PostgreSQL Python-2.0 Unlicense UPL-1.0 Vim X11 Zlib".split()
SENTENCES |= {f"spdx-{name.lower()}": (f"SPDX-License-Identifier: {name}",) for name in SPDX}
RULES += tuple((name, (f"spdx-{name.lower()}",)) for name in SPDX)

_MARKS = re.compile(r"\n[ \t]*(?://+|/\*+|\*+/?|#+|;+|--+|%+|<!--|rem\b)[ \t]?", re.IGNORECASE)
# a stop before white space, but for "v. 2.0" and the like; a blank line, or a colon at the end of a line
_END = re.compile(r"(?<=[.!?])(?:(?<!\b[vV]\.)(?<!\b[vV]er\.)(?<!\b[vV]ers\.)|(?!\s+\d))\s+|\n[ \t]*\n\s*|(?<=:)[ \t]*\n")
_OTHER = re.compile(r"[^a-z0-9*]+")


def normalise(sentence: str) -> str:
    return _OTHER.sub(" ", sentence.lower()).strip()


_SPDX_HEAD = "spdx-license-identifier:"
_SPDX_NAMES = {name.lower(): f"spdx-{name.lower()}" for name in SPDX}
# names from before licences told "only" from "or later"
_SPDX_NAMES |= {name.lower().removesuffix(end) + sign: f"spdx-{name.lower()}" for name in SPDX for end, sign in (("-only", ""), ("-or-later", "+")) if name.lower().endswith(end)}


def spdx_names(line: str) -> list[str]:
    """Identifiers of the licences in an SPDX line, joined by OR or AND, with exceptions by WITH; none if it is no such line or names others."""
    line = line.strip()
    rest = line[len(_SPDX_HEAD) :].removesuffix("-->").rstrip("*/. \t") if line.lower().startswith(_SPDX_HEAD) else ""
    words = rest.replace("(", " ").replace(")", " ").split()
    out, want = [], "name"
    for word in words:
        operator = word.upper() in ("OR", "AND", "WITH")
        if operator != (want == "operator"):
            return []
        if want == "name":
            if word.lower() not in _SPDX_NAMES:
                return []
            out.append(_SPDX_NAMES[word.lower()])
        want = "exception" if word.upper() == "WITH" else "name" if operator else "operator"
    return out if want == "operator" else []


class _Places:
    """A text of words and where its lines end, with the next place of a part remembered: places only move on."""

    def __init__(self, text: str, ends: set[int]):
        self.text, self.ends = text, ends
        self.found: dict[tuple[str, bool], tuple[int, int]] = {}

    def next(self, part: str, at: int, to_end: bool) -> int:
        """The first end, at or after `at`, of the part as whole words; to_end: at which a line ends too. -1 if there is none."""
        since, place = self.found.get((part, to_end), (0, 0))
        if since and since <= at and (place < 0 or at + len(part) <= place):
            return place
        since, key = at, f" {part}"
        place = self.text.find(key, at - 1)
        while place >= 0 and not self._fits(place + len(key), to_end):
            place = self.text.find(key, place + 1)
        place = place + len(key) if place >= 0 else -1
        self.found[part, to_end] = since, place
        return place

    def _fits(self, end: int, to_end: bool) -> bool:
        return end in self.ends if to_end else end == len(self.text) or self.text[end] == " "

    def match(self, parts: list[str], at: int) -> int:
        """Where a sentence that begins at `at` and fills whole lines ends, given what stands between its `*`; -1 if it doesn't begin there."""
        if not self.text.startswith(parts[0], at):
            return -1
        end = at + len(parts[0])
        if len(parts) == 1:
            return end if end in self.ends else -1
        if not self._fits(end, False):
            return -1
        for k, part in enumerate(parts[1:], 2):
            word = self.text.find(" ", end + 1)  # one word at least stands for the `*`
            if not part:
                return min((e for e in self.ends if e > end + 1), default=-1)
            if word < 0 or (end := self.next(part, word + 1, k == len(parts))) < 0:
                return -1
        return end


class Recogniser:
    def __init__(self, sentences: dict[str, Sequence[str]], rules: Sequence[tuple[str, Sequence[str]]], gap: int):
        self.rules, self.gap = rules, gap
        self.exact: dict[str, str] = {}
        # by first word and longest first
        self.lines: dict[str, list[tuple[str, list[str]]]] = {}
        for t, name in sorted(((t, name) for name, texts in sentences.items() for t in map(normalise, texts)), key=lambda x: -len(x[0])):
            self.lines.setdefault(t.split()[0], []).append((name, [p.strip() for p in t.split("*")]))
            if "*" not in t:
                self.exact[t] = name
        self.open = {word: wild for word, known in self.lines.items() if (wild := [x for x in known if len(x[1]) > 1])}

    def known(self, sentence: str) -> list[str]:
        """Identifier of a sentence; if it isn't known, those of its runs of lines that are, in order and without overlap."""
        raw = [(" ".join(normalise(x).replace("*", "").split()), x) for x in sentence.split("\n")]
        raw = [x for x in raw if x[0]]
        lines = [x[0] for x in raw]
        if got := self._look(" ".join(lines)):
            return [got]
        if len(lines) < 2:
            return spdx_names(raw[0][1]) if lines and lines[0].startswith("spdx ") else []
        text, out, at, k = " ".join(lines), [], 0, 0
        starts = list(accumulate((len(x) + 1 for x in lines), initial=0))
        places = _Places(text, {x - 1 for x in starts[1:]})
        while k < len(lines):
            at, end = starts[k], -1
            for name, parts in self.lines.get(lines[k].split(" ", 1)[0], ()):
                if (end := places.match(parts, at)) >= 0:
                    out.append(name)
                    break
            if end < 0 and lines[k].startswith("spdx "):
                out += spdx_names(raw[k][1])
            k = k + 1 if end < 0 else bisect_left(starts, end + 1)
        return out

    def _look(self, clean: str) -> str | None:
        first = clean.split(" ", 1)[0]
        if first not in self.lines:
            return None
        if got := self.exact.get(clean):
            return got
        return next((name for name, parts in self.open.get(first, ()) if _Places(clean, {len(clean)}).match(parts, 0) >= 0), None)

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int]]]:
        """Sentences, the known ones in them by place, and (licence, first place, last place) of the matches in text order."""
        if not text:
            return 0, [], []
        body = _MARKS.sub("\n", f"\n{text}")
        sentences = [s for s in _END.split(body) if s.strip()]
        found = [(k, name) for k, s in enumerate(sentences) for name in self.known(s)]
        free = [True] * len(found)
        matches = []
        places: dict[str, list[int]] = {}
        for a, (_, name) in enumerate(found):
            places.setdefault(name, []).append(a)
        for licence, ids in self.rules if found else ():
            for a in places.get(ids[0], ()):
                run = range(a, a + len(ids))
                if run.stop <= len(found) and all(free[b] and found[b][1] == ids[b - a] for b in run) and all(found[b + 1][0] - found[b][0] <= 1 + self.gap for b in run[:-1]):
                    for b in run:
                        free[b] = False
                    matches.append((a, licence, found[a][0], found[run[-1]][0]))
        return len(sentences), found, [m[1:] for m in sorted(matches)]


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_sentences", pa.int64()), ("licenses", pa.list_(pa.string())), ("sentence_ids", pa.list_(pa.string())),
    ("matches", pa.list_(pa.struct([("license", pa.string()), ("first_sentence", pa.int32()), ("last_sentence", pa.int32())]))),
])


def scan_licenses(
    docs: DataFrame,
    *,
    sentences: dict[str, Sequence[str]] = SENTENCES,
    rules: Sequence[tuple[str, Sequence[str]]] = RULES,
    gap: int = 2,
) -> DataFrame:
    """(doc_id, n_sentences, licenses, sentence_ids, matches) for each row of docs(doc_id, text).

    licenses      distinct licences found, sorted
    sentence_ids  identifiers of the known sentences, in text order
    matches       (license, first_sentence, last_sentence) of each rule match, in text order

    Null, empty and blank texts have no sentences and no licences. Whole texts are read,
    however long. Equal texts get equal results; a doc_id may be null or repeat; other columns
    are ignored; an empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Recogniser(sentences, rules, gap)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                got = [scanner.scan(t) for t in part["text"].to_pylist()]
                yield pa.record_batch([
                    part["doc_id"],
                    pa.array([g[0] for g in got], pa.int64()),
                    pa.array([sorted({m[0] for m in g[2]}) for g in got], pa.list_(pa.string())),
                    pa.array([[name for _, name in g[1]] for g in got], pa.list_(pa.string())),
                    pa.array([[{"license": m[0], "first_sentence": m[1], "last_sentence": m[2]} for m in g[2]] for g in got], _OUT.field("matches").type),
                ], schema=_OUT)

    return docs.mapInArrow(run, "doc_id long, n_sentences long, licenses array<string>, sentence_ids array<string>, matches array<struct<license:string,first_sentence:int,last_sentence:int>>")
