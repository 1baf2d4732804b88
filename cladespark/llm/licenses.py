"""Template-markup matching: license notices as token automata with optional and replaceable regions.

A template is plain wording with markup: `[[...]]` is optional (may nest), `{{n}}` stands
for any 0 to n words. A match whose wording ends in a version number must not be followed
by another number. Templates compile to automata over words; a place in a text is
accepted when the mandatory wording matches word for word and in order. Only places whose
word can start a template are tried, in texts that hold the template's rarest-looking
mandatory word, so almost all texts cost a few array operations.

Null text counts as empty; it has no words, no labels and a score of 0. Rows are judged
one by one, whatever their ids; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship
from .words import code_of, slices, words

#: Fixed phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Parts of the two BSD notices.
_BSD_HEAD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "[[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
)
_BSD_TAIL = (
    "this software is provided by {{10}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall {{12}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
    "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)

#: Start of a machine-readable line; other licenses may be offered before.
_SPDX = "spdx license identifier [[{{6}} or]] "
#: Head of the notices that the free software foundation recommends, and what follows the license's name.
_FSF = "redistribute it and or modify it under the terms of [[version {{2}} of]] the gnu "
_BY_FSF = " as published by the free software foundation [[either]] version "
_LATER = " [[of the license]] [[only]] [[or at your option any later version]]"

#: Notices by label, in the markup above.
TEMPLATES = {
    "mit-notice": [
        "[[this {{4}} is]] released under the [[terms of the]] mit [[open source]] license",
        "[[this {{4}} is]] licensed under the [[terms of the]] mit [[open source]] license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files {{3}} to deal in the software without restriction",
    ],
    "apache-2.0": [
        "licensed under the apache license [[version]] 2 0 [[the license]]",
        "[[this {{4}} is]] released under the apache license [[version]] 2 0",
        _SPDX + "apache 2 0",
    ],
    "gpl-2.0": ["licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] [[version]] 2 [[of the license]] [[or at your option any later version]]", _FSF + "general public license" + _BY_FSF + "2" + _LATER, "under the terms of the gnu general public license version 2 [[only]] as published by the free software foundation", _SPDX + "gpl 2 0"],
    "gpl-3.0": ["licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] [[version]] 3 [[of the license]] [[or at your option any later version]]", _FSF + "general public license" + _BY_FSF + "3" + _LATER, "under the terms of the gnu general public license version 3 [[only]] as published by the free software foundation", _SPDX + "gpl 3 0"],
    "lgpl": ["licensed under the [[terms of the]] gnu lesser general public license [[version {{2}}]]", "licensed under the [[terms of the]] gnu library general public license [[version {{2}}]]", _FSF + "lesser general public license as published by the free software foundation", _FSF + "library general public license as published by the free software foundation", _SPDX + "lgpl"],
    "cc-by-nc-4.0": ["licensed under [[a]] [[the]] [[creative commons]] cc by nc 4 0 [[international]] [[license]]", "licensed under a creative commons attribution noncommercial 4 0 [[international]] license", _SPDX + "cc by nc 4 0"],
    "cc-by-4.0": ["licensed under [[a]] [[the]] cc by 4 0 [[international]] [[license]]", "licensed under a creative commons attribution 4 0 [[international]] license", _SPDX + "cc by 4 0"],
    "cc-by-sa-4.0": ["licensed under [[a]] [[the]] cc by sa 4 0 [[international]] [[license]]", "licensed under a creative commons attribution sharealike 4 0 [[international]] license", _SPDX + "cc by sa 4 0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "[[released]] [[licensed]] under the [[terms of the]] {{2}} bsd [[style]] license"],
    "mpl-2.0": ["subject to the terms of the mozilla public license [[v]] [[version]] 2 0", _SPDX + "mpl 2 0"],
    "lgpl-2.1": [_FSF + "lesser general public license" + _BY_FSF + "2 1" + _LATER, _SPDX + "lgpl 2 1"],
    "lgpl-3.0": [_FSF + "lesser general public license" + _BY_FSF + "3" + _LATER, _SPDX + "lgpl 3 0"],
    "agpl-3.0": [_FSF + "affero general public license" + _BY_FSF + "3" + _LATER, "licensed under the [[terms of the]] gnu affero general public license [[version]] 3", _SPDX + "agpl 3 0"],
    "mit-spdx": [_SPDX + "mit"],
    "isc-spdx": [_SPDX + "isc"],
    "bsd-2-clause-spdx": [_SPDX + "bsd 2 clause"],
    "bsd-3-clause-spdx": [_SPDX + "bsd 3 clause"],
    "cc0-1.0": ["creative commons [[legal code]] cc0 1 0 universal [[public domain dedication]]", "licensed under [[the]] [[creative commons]] cc0 1 0", _SPDX + "cc0 1 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain", _SPDX + "unlicense"],
    "public-domain": ["released into the public domain", "placed in the public domain", "dedicated to the public domain"],
    # Whole notices: wording between the optional heads and the replaceable names is mandatory.
    "mit-text": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights "
        "to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall {{12}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and {{8}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall {{8}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action "
        "arising out of or in connection with the use or performance of this software"
    ],
    "bsd-2-clause": [_BSD_HEAD + _BSD_TAIL],
    "bsd-3-clause": [_BSD_HEAD + "[[3]] neither the name of {{10}} nor the names of [[its]] [[their]] contributors may be used to endorse or promote products derived from this software without specific prior written permission " + _BSD_TAIL],
}

_MARK = re.compile(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+")


@lru_cache(maxsize=1)
def _numbers() -> frozenset:
    return frozenset(code_of(str(i)) for i in range(1000))


@dataclass
class Automaton:
    """edges[state]: word hash -> next states; skips[state]: states reached without a word; anywhere[state]: states reached by any word."""

    label: str
    edges: list[dict[int, list[int]]] = field(default_factory=list)
    skips: list[list[int]] = field(default_factory=list)
    anywhere: list[list[int]] = field(default_factory=list)
    required: set[str] = field(default_factory=set)
    numbered: bool = False  # the last mandatory word is a number: another number must not follow

    def state(self) -> int:
        self.edges.append({})
        self.skips.append([])
        self.anywhere.append([])
        return len(self.edges) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for x in self.skips[todo.pop()]:
                if x not in states:
                    states.add(x)
                    todo.append(x)
        return states

    def longest(self, code: list[int], at: int) -> int:
        """End of the longest match from word at, or -1."""
        now, best = self.closure({0}), -1
        final = len(self.edges) - 1
        while now:
            if final in now and not (self.numbered and at < len(code) and code[at] in _numbers()):
                best = at
            if at >= len(code):
                break
            now = self.closure({y for x in now for y in (*self.edges[x].get(code[at], ()), *self.anywhere[x])})
            at += 1
        return best


def compile_template(label: str, markup: str) -> Automaton:
    auto = Automaton(label)
    here, opened = auto.state(), []
    for m in _MARK.findall(markup):
        if m == "[[":
            opened.append(here)
        elif m == "]]":
            auto.skips[opened.pop()].append(here)
        elif m.startswith("{{"):
            for _ in range(int(m[2:-2])):
                nxt = auto.state()
                auto.anywhere[here].append(nxt)
                auto.skips[here].append(nxt)
                here = nxt
        else:
            nxt = auto.state()
            auto.edges[here].setdefault(code_of(m), []).append(nxt)
            here = nxt
            if not opened:
                auto.required.add(m)
                auto.numbered = m.isdigit()
    if opened:
        raise ValueError(f"{label}: an optional region isn't closed")
    end = auto.state()
    auto.skips[here].append(end)
    return auto


@lru_cache(maxsize=8)
def _compiled(templates: tuple) -> tuple:
    autos = [compile_template(label, t) for label, t in templates]
    firsts = [sorted({w for s in a.closure({0}) for w in a.edges[s]}) for a in autos]
    key = [code_of(max(a.required, key=lambda w: (len(w), w))) for a in autos]
    return autos, firsts, np.array(sorted(set(key)), np.uint64), key


def _scan(phrases: dict, templates: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        autos, firsts, keys, key_of = _compiled(templates)
        known = [(np.array([code_of(w) for w in p.split()], np.uint64), label) for p, label in phrases.items()]
        for batch in batches:
            size = len(batch)
            n, n_base = np.zeros(size, np.int64), np.zeros(size, np.int64)
            first, last = np.full(size, -1), np.full(size, -1)
            base: list[set] = [set() for _ in range(size)]
            more: list[set] = [set() for _ in range(size)]
            spans: list[list] = [[] for _ in range(size)]
            for s in slices(batch.column("text")):
                w = words(s, "alnum", lower=True)
                n[s.lo : s.hi] = w.counts
                row = w.row()
                for codes, label in known:
                    k = len(codes)
                    if len(w.code) < k:
                        continue
                    at = np.flatnonzero(w.code[: len(w.code) - k + 1] == codes[0])
                    for j in range(1, k):
                        at = at[w.code[at + j] == codes[j]]
                    at = at[row[at] == row[at + k - 1]]
                    for r, x in zip(row[at].tolist(), (at - w.first[row[at]]).tolist(), strict=True):
                        r += s.lo
                        n_base[r] += 1
                        first[r] = x if first[r] < 0 else min(first[r], x)
                        last[r] = max(last[r], x)
                        base[r].add(label)
                        spans[r].append((x, x + k))
                for r in np.unique(row[np.isin(w.code, keys)]).tolist():
                    code = w.code[w.first[r] : w.first[r + 1]]
                    listed, seen = code.tolist(), set(code.tolist())
                    for auto, starts, key in zip(autos, firsts, key_of, strict=True):
                        if key in seen:
                            for at in np.flatnonzero(np.isin(code, np.array(starts, np.uint64))).tolist():
                                if (end := auto.longest(listed, at)) > at:
                                    more[r + s.lo].add(auto.label)
                                    spans[r + s.lo].append((at, end))
            score = []
            for i in range(size):
                covered, to = 0, 0
                for a, b in sorted(spans[i]):
                    covered += max(0, b - max(a, to))
                    to = max(to, b)
                score.append(covered / n[i] if covered else 0.0)
            none = first < 0
            join = lambda x: ",".join(sorted(x))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none), pa.array([join(x) for x in base]), pa.array([join(x | y) for x, y in zip(base, more, strict=True)]), pa.array(score, pa.float64())],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return run


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score (share of words in matches) of each row."""
    ship(docs.sparkSession)
    flat = tuple((label, t) for label, ts in (TEMPLATES if templates is None else templates).items() for t in ts)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select("doc_id", "text").mapInArrow(_scan(PHRASES if phrases is None else phrases, flat), schema)
