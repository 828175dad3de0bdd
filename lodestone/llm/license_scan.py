"""Operator 2: licence scans by template markup.

A template is wording with marks: `<<optional>> ... <</optional>>` encloses wording that may be left
out, `<<var;least;most>>` stands for any `least` to `most` words, and a word list in
`<<one;a|b|c>>` for one of them. It is compiled into an automaton over words: a text has the
template's label where the automaton accepts a run of its words, so its mandatory wording stands
there exactly. Words are runs of bytes other than ASCII signs, A-Z lower-cased; layout and punctuation
don't count. The automaton starts only where its rarest fixed opening stands, found by a byte search.

Besides, fixed phrases are counted at all places (overlapping ones too): these are the base.

Null counts as an empty text, without words. Every whole text is read, whatever its length; equal
texts have equal results; no rows are dropped. Columns but the id and the text are not looked at.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from . import kernels as K

#: Bytes that are no part of a word become blanks, and A-Z is lower-cased.
PLAIN = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 65 <= b <= 90 else b for b in range(256))

BASE = {b"mit license": "mit", b"apache license": "apache", b"general public license": "gpl"}

#: What many grants end with.
_DISCLAIMER = "this software is provided <<one;by|as>> <<var;0;24>> <<optional>>is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed <<optional>>in no event shall <<var;1;16>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage<</optional>><</optional>>"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<optional>>1 <</optional>>redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<optional>>2 <</optional>>redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "

#: label: (certainty, template). Whole texts of well-known grants, and notices that refer to them.
TEMPLATES: dict[str, tuple[float, str]] = {
    "mit": (0.9, "<<one;released|licensed|distributed|available>> under the <<optional>>terms of the <</optional>>MIT License"),
    "mit-text": (1.0, "permission is hereby granted free of charge to any person obtaining a copy of this <<optional>>software and associated documentation files <</optional>><<var;0;12>> to deal in the software without restriction"),
    "mit-full": (1.0, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<optional>>including the next paragraph <</optional>>shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement <<optional>>in no event shall <<var;1;16>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software<</optional>>"),
    "apache-2.0": (0.95, "licensed under the Apache License <<optional>>version <</optional>>2.0"),
    "apache-2.0-notice": (1.0, "licensed under the apache license version 2.0 the license you may not use this <<one;file|software|work|project>> except in compliance with the license you may obtain a copy of the license at <<optional>><<one;http|https>> www apache org licenses license 2.0 <</optional>>unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    "gpl": (0.9, "<<one;licensed|released|distributed>> under the <<optional>>terms of the <</optional>><<optional>>GNU <</optional>>General Public License"),
    "gpl-2.0": (0.95, "GNU General Public License <<optional>>as published by the free software foundation <</optional>><<optional>>either <</optional>><<one;version|v>> 2"),
    "gpl-3.0": (0.95, "GNU General Public License <<optional>>as published by the free software foundation <</optional>><<optional>>either <</optional>><<one;version|v>> 3"),
    "gpl-notice": (1.0, "this program is free software you can redistribute it and or modify it under the terms of the gnu <<optional>><<one;lesser|library|affero>> <</optional>>general public license as published by the free software foundation either version <<one;1|2|3>> <<optional>><<one;0|1>> <</optional>>of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu <<optional>><<one;lesser|library|affero>> <</optional>>general public license for more details <<optional>>you should have received a copy of the gnu <<optional>><<one;lesser|library|affero>> <</optional>>general public license along with this program<</optional>>"),
    "lgpl": (0.95, "GNU <<one;lesser|library>> General Public License"),
    "agpl": (0.95, "GNU Affero General Public License"),
    "mpl-2.0": (0.95, "Mozilla Public License <<var;0;2>> 2.0"),
    "mpl-2.0-notice": (1.0, "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at <<optional>><<one;http|https>> <</optional>><<optional>>www <</optional>>mozilla org mpl 2.0"),
    "bsd": (0.9, "<<one;licensed|released|distributed>> under the <<optional>>terms of the <</optional>><<optional>><<one;new|modified|simplified|2|3>> <</optional>><<optional>>clause <</optional>>BSD License"),
    "bsd-text": (1.0, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    "bsd-2-clause": (1.0, _BSD + _DISCLAIMER),
    "bsd-3-clause": (1.0, _BSD + "<<optional>>3 <</optional>>neither the name of <<var;1;16>> nor the names of <<one;its|any>> contributors may be used to endorse or promote products derived from this software without specific prior written permission " + _DISCLAIMER),
    "isc-text": (1.0, "permission to use copy modify and <<optional>>or <</optional>>distribute this software for any purpose with or without fee is hereby granted"),
    "isc-full": (1.0, "permission to use copy modify and <<optional>>or <</optional>>distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<var;1;8>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness <<optional>>in no event shall <<var;1;8>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software<</optional>>"),
    "zlib-text": (1.0, "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    "boost-1.0": (1.0, "<<one;distributed|licensed>> under the boost software license version 1.0"),
    "cc-by-nc": (0.95, "<<one;licensed|released|available>> under <<optional>>a <</optional>>CC BY NC <<optional>><<one;sa|nd>> <</optional>><<var;0;2>>"),
    "cc-by": (0.9, "<<one;licensed|released|available>> under <<optional>>a <</optional>>CC BY <<one;1|2|3|4>> 0"),
    "cc-by-sa": (0.95, "<<one;licensed|released|available>> under <<optional>>a <</optional>>CC BY SA"),
    "cc0": (0.95, "CC0 <<optional>>1.0 <</optional>><<optional>>universal <</optional>>public domain dedication"),
    "unlicense": (1.0, "this is free and unencumbered software released into the public domain <<optional>>anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means<</optional>>"),
    "all-rights-reserved": (0.8, "<<optional>>copyright <<var;0;8>> <</optional>>all rights reserved"),
}

#: Second wordings of these labels.
ALSO: list[tuple[str, float, str]] = [
    ("gpl", 0.9, "redistribute it and or modify it under the <<optional>>terms of the <</optional>><<optional>>GNU <</optional>>General Public License"),
    ("gpl-2.0", 0.95, "GNU General Public License <<optional>>as published by the free software foundation <</optional>><<optional>>either <</optional>>v2"),
    ("gpl-3.0", 0.95, "GNU General Public License <<optional>>as published by the free software foundation <</optional>><<optional>>either <</optional>>v3"),
]


class Automaton:
    """States with moves on words; a move on None takes any word, an empty move none.

    accepts(words, at) is the end of the longest run from `at` that is accepted, or -1.
    """

    def __init__(self, template: str):
        self.moves: list[list[tuple[frozenset[bytes] | None, int]]] = [[]]
        self.empty: list[list[int]] = [[]]
        self.opening: list[bytes] = []  # fixed words that every match begins with
        parts = re.split(r"(<<.*?>>)", template)
        state, opened, fixed = 0, [], True
        for part in parts:
            if part == "<<optional>>":
                opened.append(state)
                fixed = False
            elif part == "<</optional>>":
                if not opened:
                    raise ValueError("an optional region is closed that wasn't opened")
                self.empty[opened.pop()].append(state)
            elif part.startswith("<<var;"):
                least, most = map(int, part[2:-2].split(";")[1:])
                fixed = False
                ends = []
                for k in range(most):
                    if k >= least:
                        ends.append(state)
                    state = self._next(state, None)
                for e in ends:
                    self.empty[e].append(state)
            elif part.startswith("<<one;"):
                words = [w.encode().translate(PLAIN).split() for w in part[2:-2].split(";")[1].split("|")]
                if any(len(w) != 1 for w in words):
                    raise ValueError("alternatives are single words")
                fixed = False
                state = self._next(state, frozenset(w[0] for w in words))
            elif part.startswith("<<"):
                raise ValueError(f"unknown mark {part}")
            else:
                for w in part.encode().translate(PLAIN).split():
                    state = self._next(state, frozenset((w,)))
                    if fixed:
                        self.opening.append(w)
        if opened:
            raise ValueError("an optional region isn't closed")
        self.final = state
        if self.final in self._closure({0}):
            raise ValueError("a template needs mandatory wording")
        #: Where a match may begin: words it can begin with, None if any.
        firsts = [m for s in self._closure({0}) for m, _ in self.moves[s]]
        self.first = None if None in firsts else frozenset().union(*firsts)
        #: The longest fixed run of mandatory words, which a text must hold at all.
        self.needs = max(self._mandatory(parts), key=lambda r: len(b" ".join(r)), default=[])

    def _next(self, state: int, words: frozenset[bytes] | None) -> int:
        self.moves.append([])
        self.empty.append([])
        self.moves[state].append((words, len(self.moves) - 1))
        return len(self.moves) - 1

    @staticmethod
    def _mandatory(parts: list[str]) -> list[list[bytes]]:
        depth, runs = 0, []
        for p in parts:
            if p == "<<optional>>":
                depth += 1
            elif p == "<</optional>>":
                depth -= 1
            elif not p.startswith("<<") and not depth and (w := p.encode().translate(PLAIN).split()):
                runs.append(w)
        return runs

    def _closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    def accepts(self, words: list[bytes], at: int) -> int:
        states, best = self._closure({0}), -1
        while True:
            if self.final in states:
                best = at
            if at >= len(words) or not states:
                return best
            w = words[at]
            states = self._closure({t for s in states for m, t in self.moves[s] if m is None or w in m})
            at += 1


class Scanner:
    """All templates and base phrases over one text at a time."""

    def __init__(self, templates: dict[str, tuple[float, str]] | None = None, phrases: dict[bytes, str] | None = None):
        self.phrases = [(b" " + p + b" ", p.count(b" ") + 1, label) for p, label in (BASE if phrases is None else phrases).items()]
        wordings = [(label, *t) for label, t in (TEMPLATES if templates is None else templates).items()] + (ALSO if templates is None else [])
        self.templates = [(label, sure, a, b" " + b" ".join(a.needs) + b" " if a.needs else b" ") for label, sure, t in wordings for a in (Automaton(t),)]
        #: A text without any of these has no label; one search tells.
        words = {p[0].split()[-1] for p in self.phrases} | {max(a.needs, key=len) for *_, a, _ in self.templates if a.needs}
        free = any(not a.needs for *_, a, _ in self.templates)  # a template without a fixed run may match anywhere
        self.any = None if free else re.compile(b"|".join(re.escape(w) for w in sorted(words)) or rb"(?!)")

    def scan(self, raw: bytes) -> tuple[int, int, int | None, int | None, list[str], list[tuple[str, float, int, int]]]:
        """n_words, n_base, first and last start, base labels, and (label, certainty, start, end) of template matches, in words."""
        plain = raw.translate(PLAIN)
        words = plain.split()
        n = len(words)
        if self.any is not None and not self.any.search(plain):
            return n, 0, None, None, [], []
        joined = b" " + b" ".join(words) + b" "
        starts, labels, found, list_ = [], set(), [], words
        for phrase, _, label in self.phrases:
            at, before, place = joined.find(phrase), 0, 0  # word `place` begins at `before`
            while at >= 0:
                place += joined.count(b" ", before, at)
                before = at
                starts.append(place)
                labels.add(label)
                at = joined.find(phrase, at + 1)
        for label, sure, automaton, needs in self.templates:
            if needs not in joined:
                continue
            at = 0
            firsts = range(n) if automaton.first is None else [i for w in automaton.first for i in _places(list_, w)]
            for i in sorted(firsts):
                if i < at:
                    continue
                end = automaton.accepts(list_, i)
                if end > i:
                    found.append((label, sure, i, end))
                    at = end
        return n, len(starts), min(starts, default=None), max(starts, default=None), sorted(labels), found


def _places(words: list[bytes], word: bytes) -> list[int]:
    out, at = [], -1
    try:
        while True:
            at = words.index(word, at + 1)
            out.append(at)
    except ValueError:
        return out


def scan_licenses(docs: DataFrame, templates: dict[str, tuple[float, str]] | None = None, phrases: dict[bytes, str] | None = None, spans: bool = False) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of docs (doc_id, text); with spans also the matches.

    score: the greatest certainty of a matched template, half where only a base phrase stands, else 0.
    """
    base.ship(docs.sparkSession)
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double" + ", matches array<struct<label:string,start:long,end:long>>" * spans

    def run(batches):
        scanner = Scanner(templates, phrases)
        for batch in base.gathered(batches):
            rows = []
            for _, _, data, offsets in K.text_chunks(batch.column(1)):
                raw = data.tobytes()
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    n, n_base, first, last, base_labels, found = scanner.scan(raw[a:b])
                    score = max((f[1] for f in found), default=0.5 if n_base else 0.0)
                    row = (n, n_base, first, last, ",".join(base_labels), ",".join(sorted({*base_labels, *(f[0] for f in found)})), score)
                    rows.append((*row, [{"label": f[0], "start": f[2], "end": f[3]} for f in found]) if spans else row)
            if not rows:
                continue
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()] + [pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))] * spans
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", *["matches"] * spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
