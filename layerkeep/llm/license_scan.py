"""License scans: template-markup matching.

A template is the license's wording with markup, in the manner of the public
SPDX templates: ``<<optional>> ... <</optional>>`` wraps words that may be
missing, ``<<var;min;max>>`` stands for a replaceable run of so many words. A
template compiles into a token automaton (one state after each element);
``accepts`` walks it over the words of a text and accepts exactly where all
mandatory words stand in order with nothing else between them. A phrase
without markup compiles into the same automaton, a plain chain.

``TEXTS`` hold whole license texts, all of whose mandatory words must stand in
order; ``NOTICES`` are sentences that name a license.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased: ASCII
letters and digits and everything beyond ASCII. Null text counts as empty: no
words, no labels, score 0. Very long texts are scanned whole; an empty table gives
an empty result. Every row is answered alone, so repeated rows, null
ids and other columns change nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import id_text, leaving_tidy, rows_of, table

#: Phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices that name a license, as templates; each adds its own label.
NOTICES = {
    "mit-notice": "released under the <<optional>>terms of the<</optional>> mit license",
    "apache-2.0-notice": "licensed under the apache license <<optional>>version<</optional>> 2 0",
    "gpl-3.0-notice": "<<optional>>this work is<</optional>> licensed under the gnu general public license <<optional>>version<</optional>> 3",
    "gpl-or-later-notice": "gnu general public license <<optional>>as published by the free software foundation<</optional>> either version <<var;1;1>> of the license or at your option any later version",
    "cc-by-4.0-notice": "licensed under <<optional>>a<</optional>> <<optional>>creative commons<</optional>> cc by <<optional>>nc<</optional>> <<optional>>sa<</optional>> 4 0",
    "copyright-notice": "copyright <<optional>>c<</optional>> <<var;1;8>> all rights reserved",
}
#: The whole mandatory wording of license texts and of the notices that licenses tell one to attach, as templates.
TEXTS = {
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute <<optional>>distribute with modifications<</optional>> sublicense and or sell copies of the software and to permit persons to whom the software is "
        "furnished to do so subject to the following conditions the above copyright notice and this permission notice <<optional>>including the next paragraph<</optional>> shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall <<var;1;10>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
    ),
    "isc-text": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and <<var;1;5>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall <<var;1;5>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action "
        "arising out of or in connection with the use or performance of this software"
    ),
    "bsd-text": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "<<optional>>1<</optional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "<<optional>>2<</optional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "<<optional>><<optional>>3<</optional>> neither the name of <<var;1;12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission<</optional>> "
        "this software is provided by <<var;1;8>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
        "in no event shall <<var;1;8>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
        "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
    ),
    "zlib-text": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "<<optional>>1<</optional>> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
        "<<optional>>2<</optional>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software "
        "<<optional>>3<</optional>> this notice may not be removed or altered from any source distribution"
    ),
    "apache-2.0-header": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "<<var;1;1>> www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"
    ),
    "gpl-header": (
        "this <<var;1;1>> is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version <<var;1;1>> of the license or at your option any later version "
        "this <<var;1;1>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"
    ),
}
TEMPLATES = NOTICES | TEXTS

#: Bytes of UTF-8 that are no part of a word become a space; A-Z become a-z.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


@dataclass
class Automaton:
    """States are numbers; ``step[s]`` has the words that lead on, ``any_[s]`` the states after any word, ``skip[s]`` the states reached without one."""

    step: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    any_: list[list[int]] = field(default_factory=lambda: [[]])
    skip: list[list[int]] = field(default_factory=lambda: [[]])

    def state(self) -> int:
        self.step.append({})
        self.any_.append([])
        self.skip.append([])
        return len(self.step) - 1

    def closure(self, states) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.skip[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def start_words(self) -> set[bytes] | None:
        """Words that a match can start with; None: any word."""
        at = self.closure([0])
        return None if any(self.any_[s] for s in at) else {w for s in at for w in self.step[s]}

    def accepts(self, words: list[bytes], i: int) -> int:
        """The end of the longest match that starts at word ``i``, or -1."""
        last, end, at = len(self.step) - 1, -1, self.closure([0])
        while at:
            if last in at:
                end = i
            if i == len(words):
                break
            w = words[i]
            at = self.closure({t for s in at for t in ([self.step[s][w]] if w in self.step[s] else []) + self.any_[s]})
            i += 1
        return end


def compile_template(template: str) -> Automaton:
    """The automaton of a template; its last state accepts."""
    out, here, opened = Automaton(), 0, []
    for part in re.split(r"(<<[^>]*>>)", template):
        if part == "<<optional>>":
            opened.append(here)
        elif part == "<</optional>>":
            after = out.state()
            out.skip[here].append(after)
            out.skip[opened.pop()].append(after)
            here = after
        elif part.startswith("<<var"):
            low, high = (int(x) for x in part.strip("<>").split(";")[1:])
            leave = []
            for k in range(high):
                if k >= low:
                    leave.append(here)
                nxt = out.state()
                out.any_[here].append(nxt)
                here = nxt
            after = out.state()
            for s in [*leave, here]:
                out.skip[s].append(after)
            here = after
        else:
            for w in words_of(part):
                nxt = out.state()
                out.step[here][w] = nxt
                here = nxt
    if opened or here != len(out.step) - 1 or not out.step[0] and not out.skip[0] and not out.any_[0]:
        raise ValueError(f"not a template: {template!r}")
    return out


class Scanner:
    """All automata of a scan, entered only at words that can start one."""

    def __init__(self, base: dict[str, str], templates: dict[str, str]):
        self.automata = [(label, compile_template(x), True) for x, label in base.items()]
        self.automata += [(label, compile_template(x), False) for label, x in templates.items()]
        self.by_start: dict[bytes, list[int]] = {}
        for k, (label, a, _) in enumerate(self.automata):
            if not (starts := a.start_words()):
                raise ValueError(f"the template of {label} must begin with a word")
            for w in starts:
                self.by_start.setdefault(w, []).append(k)
        self.starts = frozenset(self.by_start)

    def places(self, words: list[bytes]) -> Iterator[tuple[int, int, str, bool]]:
        """(start, end, label, whether of the base) for every place."""
        present = self.starts.intersection(words)
        todo = []
        for w in present:
            i = -1
            try:
                while True:
                    i = words.index(w, i + 1)
                    todo.append(i)
            except ValueError:
                pass
        for i in sorted(todo):
            for k in self.by_start[words[i]]:
                label, a, base = self.automata[k]
                if (end := a.accepts(words, i)) >= 0:
                    yield i, end, label, base


SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))),
])
DDL = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:long,end:long,label:string>>"


def answer(scanner: Scanner, words: list[bytes]) -> tuple:
    found = list(scanner.places(words))
    base = [x for x in found if x[3]]
    own = {x[2] for x in found if not x[3]}
    score = 1.0 if not own.isdisjoint(TEXTS) else 0.9 if own else 0.75 if base else 0.0
    return (
        len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None,
        ",".join(sorted({x[2] for x in base})), ",".join(sorted({x[2] for x in found})), score,
        [{"start": s, "end": e, "label": label} for s, e, label, _ in found],
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Per row: counts, labels, score (1: a whole license text or header; 0.9: a notice that names a license; 0.75: a base phrase only) and the spans in words."""

    def run(batches):
        scanner = Scanner(base, templates)
        for batch in batches:
            for ids, texts in rows_of(batch):
                cols = zip(*(answer(scanner, words_of(x or "")) for x in texts), strict=True)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, f.type) for c, f in zip(cols, list(SCHEMA)[1:], strict=True))], schema=SCHEMA)

    return id_text(docs, id_col, text_col).mapInArrow(leaving_tidy(run), DDL)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")
