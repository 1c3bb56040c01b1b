"""License scans: notices written as templates with optional and replaceable regions, matched as token automata.

A template is text with <<optional>>..<<end>> regions and <<var:max>> places that stand for 0 to max
words. It accepts a run of words if the mandatory wording matches word by word.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded

#: Words: what is neither an ASCII letter's lower case, a digit nor beyond ASCII parts them. A-Z are lower-cased first.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

# Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices of public licenses, as templates.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license <<optional>>version<<end>> 2.0",
    "cc-by-nc-4.0": "licensed under <<optional>>a<<end>> <<optional>>the<<end>> cc by nc 4.0 <<optional>>license<<end>>",
    "gpl-3.0": "licensed under the <<optional>>terms of the<<end>> <<optional>>gnu<<end>> general public license <<optional>>as published by the free software foundation<<end>> <<optional>>either<<end>> version 3 <<optional>>or later<<end>>",
    "mit": "<<optional>>released<<end>> <<optional>>licensed<<end>> under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "isc-text": "permission to use copy modify <<optional>>and or<<end>> <<optional>>and<<end>> distribute this software for any purpose with or without fee is hereby granted",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl-text": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation <<var:4>> version <<var:1>> of the license",
    "mit-full": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<optional>>including the next paragraph<<end>> shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<var:12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd-full": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<var:1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<var:1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution <<optional>><<var:1>> neither the name of <<var:16>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission<<end>> this software is provided by <<var:12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var:12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "isc-full": "permission to use copy modify <<optional>>and or<<end>> <<optional>>and<<end>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<var:8>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<var:8>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "zlib-full": "this software is provided as is without any express or implied warranty in no event will the <<var:4>> be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions <<var:1>> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required <<var:1>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software <<var:1>> this notice may not be removed or altered from any source distribution",
    "apache-2.0-full": "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<var:1>> www apache org licenses license 2.0 <<optional>>txt<<end>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "gpl-full": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version <<var:1>> of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details <<optional>>you should have received a copy of the gnu general public license along with <<var:3>> if not see<<end>>",
    "copyright-mit": "copyright <<optional>>c<<end>> <<var:12>> <<optional>>all rights reserved<<end>> permission is hereby granted free of charge",
}


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


@dataclass
class Automaton:
    """States are places in the template; arcs hold a word, or None for any word. skip: arcs without a word."""

    arcs: list[tuple[bytes | None, int] | None]
    skip: dict[int, list[int]]
    final: int

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.skip.get(todo.pop(), ()):
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def first(self) -> set[bytes]:
        got = {self.arcs[s][0] for s in self.closure({0}) if self.arcs[s]}
        if None in got or self.final in self.closure({0}):
            raise ValueError("a template has to begin with a word")
        return got

    def longest(self, words: list[bytes], at: int) -> int:
        """The end of the longest run accepted from at on, or -1."""
        states, end, i = self.closure({0}), -1, at
        while states:
            if self.final in states:
                end = i
            if i == len(words):
                break
            w = words[i]
            states = self.closure({a[1] for s in states if (a := self.arcs[s]) and (a[0] is None or a[0] == w)})
            i += 1
        return end


def compile_template(template: str) -> Automaton:
    arcs: list = []
    skip: dict[int, list[int]] = defaultdict(list)
    opened: list[int] = []
    for piece in re.split(r"(<<[^>]*>>)", template):
        if piece == "<<optional>>":
            opened.append(len(arcs))
            arcs.append(None)  # a state of its own, so that regions that follow each other stay apart
            skip[len(arcs) - 1].append(len(arcs))
        elif piece == "<<end>>":
            if not opened:
                raise ValueError("<<end>> without <<optional>>")
            skip[opened.pop()].append(len(arcs))
        elif m := re.fullmatch(r"<<var:(\d+)>>", piece):
            for k in range(int(m[1])):
                skip[len(arcs)].append(len(arcs) + int(m[1]) - k)
                arcs.append((None, len(arcs) + 1))
        elif piece.startswith("<<"):
            raise ValueError(f"unknown mark {piece}")
        else:
            for w in words_of(piece):
                arcs.append((w, len(arcs) + 1))
    if opened:
        raise ValueError("<<optional>> without <<end>>")
    arcs.append(None)
    return Automaton(arcs, dict(skip), len(arcs) - 1)


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None):
        self.phrases = [(tuple(words_of(p)), label) for p, label in (PHRASES if phrases is None else phrases).items()]
        self.automata = [(label, compile_template(t)) for label, t in (TEMPLATES if templates is None else templates).items()]
        starts: dict[bytes, list] = defaultdict(list)
        for label, a in self.automata:
            for w in a.first():
                starts[w].append((label, a))
        self.starts = dict(starts)
        self.begin = frozenset(self.starts) | {p[0] for p, _ in self.phrases}

    def scan(self, text: str) -> dict:
        """Places of base phrases and spans (label, first word, end) of accepted templates."""
        words = words_of(text)
        places, base, spans = [], set(), []
        if not self.begin.isdisjoint(words):
            for i, w in enumerate(words):
                if w not in self.begin:
                    continue
                for p, label in self.phrases:
                    if w == p[0] and tuple(words[i : i + len(p)]) == p:
                        places.append(i)
                        base.add(label)
                for label, a in self.starts.get(w, ()):
                    if (end := a.longest(words, i)) >= 0:
                        spans.append((label, i, end))
        return {"n_words": len(words), "places": places, "base": sorted(base), "spans": spans}


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """(id, n_words, places array<long>, base array<string>, spans array<struct<label,first,end>>) of whole texts.

    Null is an empty text, which holds nothing. Each row, also one without an id or with another's, has its own result; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())])
        for b in bounded(batches):
            got = [scanner.scan(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([g["n_words"] for g in got], pa.int64()),
                    pa.array([g["places"] for g in got], pa.list_(pa.int64())),
                    pa.array([g["base"] for g in got], pa.list_(pa.string())),
                    pa.array([[dict(zip(("label", "first", "end"), s)) for s in g["spans"]] for g in got], pa.list_(span)),
                ],
                names=["id", "n_words", "places", "base", "spans"],
            )

    got = df.select(df[id_col].cast("long").alias("id"), df[text_col]).mapInArrow(run, "id long, n_words long, places array<long>, base array<string>, spans array<struct<label:string,first:long,end:long>>")
    return got.withColumnRenamed("id", id_col)
