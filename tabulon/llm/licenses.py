"""Operator 7: licence scans with a suffix automaton of licence tokens."""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, byte_class, byte_parts, span_hashes, spans, table, text_hash

#: Words: runs of digits, letters a-z and non-ASCII bytes, after lower-casing A-Z.
WORD = byte_class(b"0123456789abcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 128)

#: Phrases of the base labels (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Public licences and notices as words, by label: whole texts where they are short, else the passages that stand for them (fixed values).
_MIT_GRANT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"
)
_MIT_REST = (
    "and to permit persons to whom the software is furnished to do so subject to the following conditions "
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_BSD_START = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_BSD_END = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
    "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_BSD_NAME = "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_ISC_GRANT = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
_ISC_REST = (
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
)
TEMPLATES = (
    ("mit", f"{_MIT_GRANT} {_MIT_REST}"),
    ("mit", _MIT_GRANT),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", f"{_BSD_START} {_BSD_NAME} {_BSD_END}"),
    ("bsd", f"{_BSD_START} {_BSD_END}"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "licensed under the bsd 3 clause license"),
    ("isc", f"{_ISC_GRANT} {_ISC_REST}"),
    ("isc", _ISC_GRANT),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program if not see"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("bsl-1", "distributed under the boost software license version 1 0"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("proprietary", "all rights reserved"),
)

#: A match of fewer words isn't chained; of two words in a chain the later is at most GAP words on; a span covers this share of its template.
LEAST, GAP, COVER = 3, 6, 0.75


@dataclass
class Automaton:
    """The generalised suffix automaton of the templates: states with links, lengths and edges by word id."""

    edges: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: For each state the templates and end positions of its words there.
    ends: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])
    templates: dict[int, list[int]] = field(default_factory=dict)
    spots: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.edges.append(edges), self.link.append(link), self.length.append(length), self.ends.append(set())
        return len(self.edges) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of q for the words that end in p's longest one and c."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.edges[q]))
        self.link[q] = copy
        while p >= 0 and self.edges[p].get(c) == q:
            self.edges[p][c] = copy
            p = self.link[p]
        return copy

    def extend(self, last: int, c: int) -> int:
        if (q := self.edges[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.edges[p]:
            self.edges[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.edges[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def add(self, k: int, words: list[int]) -> None:
        last = 0
        for c in words:
            last = self.extend(last, c)

    def mark(self, k: int, words: list[int]) -> None:
        """Enters where template k ends in each state along its suffix links."""
        self.templates[k] = words
        at = 0
        for i, c in enumerate(words):
            at = self.edges[at][c]
            s = at
            while s > 0:
                self.ends[s].add((k, i))
                s = self.link[s]

    def spots_of(self, state: int) -> list[tuple[int, int, int]]:
        """Where in templates (template, end) words that end in state stand, with how many of them stand there; 0 for the state's own words, as long as matched."""
        if state not in self.spots:
            out, s, size, known = [], state, 0, set()
            while s > 0 and (s == state or self.length[s] >= LEAST):
                out += [(k, e, size) for k, e in self.ends[s] - known]
                known |= self.ends[s]
                s = self.link[s]
                size = self.length[s] if s >= 0 else 0
            self.spots[state] = out
        return self.spots[state]

    def matches(self, words: list[int]) -> list[tuple[int, int, int, int]]:
        """All matches of LEAST words or more that go on neither before nor after: (last word, words, template, its last word there), in order.

        The matching statistics of words say how long the longest match that
        ends at each word is; the shorter ones, at other places, stand along the
        suffix links."""
        out, at, n = [], 0, 0
        for i, c in enumerate(words):
            while at and c not in self.edges[at]:
                at = self.link[at]
                n = self.length[at]
            if c in self.edges[at]:
                at = self.edges[at][c]
                n += 1
            else:
                n = 0
            if n >= LEAST:
                after = words[i + 1] if i + 1 < len(words) else -2
                for k, e, size in self.spots_of(at):
                    own = self.templates[k]
                    if (size or n) >= LEAST and (e + 1 == len(own) or own[e + 1] != after):
                        out.append((i, size or n, k, e))
        return out


def chained(matches: list[tuple[int, int, int]], least: float) -> list[tuple[int, int, int]]:
    """Spans (first word, last word, words covered) of one template's matches (last word, words, last word in the template): chains that cover least words or more, together as many as can be without overlaps.

    A chain goes on in text and template alike, and leaves no more than GAP
    words of text out between two that it has; it may take a part of a match.
    Of chains that end at a word the one with the most words counts, of equal
    ones the shortest, so a fragment before a licence is left out rather than
    begun with. Dynamic programming over words, then over their chains."""
    pairs: dict[int, set[int]] = {}
    for i, n, e in matches:
        for d in range(n):
            pairs.setdefault(i - d, set()).add(e - d)
    best: dict[int, dict[int, tuple[int, int]]] = {}  # text word: template word: words of the best chain that ends there, and its first
    total = 0
    out: list[tuple[int, int, tuple]] = [(-1, 0, ())]  # last word, words of the best spans up to it, and these, as a list of links
    for i in sorted(pairs):
        before = [(e, v) for j in range(i - GAP, i) for e, v in best.get(j, {}).items()]
        row = best[i] = {}
        for e in pairs[i]:
            row[e] = max(((n + 1, first) for f, (n, first) in before if f < e), default=(1, i))
        best.pop(i - GAP - 1, None)
        n, first = max(row.values())
        if n >= least:
            k = bisect.bisect_left(out, first, key=lambda x: x[0]) - 1  # the best spans that end before it
            if out[k][1] + n > total:
                total = out[k][1] + n
                out.append((i, total, (out[k][2], (first, i, n))))
    spans_, chain = [], out[-1][2]
    while chain:
        chain, span = chain
        spans_.append(span)
    return spans_[::-1]


@dataclass
class Scanner:
    vocabulary: np.ndarray
    phrases: list[tuple[list[int], str]]
    automaton: Automaton
    sizes: list[int]
    labels: list[str]

    def spans(self, words: list[int], at: int) -> list[tuple[str, int, int, float]]:
        """Template spans (label, first word, last word, share covered) in words (-1 where no template has one) that begin at word at."""
        own: dict[int, list[tuple[int, int, int]]] = {}
        for i, n, k, e in self.automaton.matches(words):
            own.setdefault(k, []).append((i, n, e))
        # one that covers too little in all needn't be chained
        return [(self.labels[k], at + first, at + last, min(1.0, n / self.sizes[k])) for k, found in own.items() if sum(n for _, n, _ in found) >= COVER * self.sizes[k] for first, last, n in chained(found, COVER * self.sizes[k])]


@functools.cache
def scanner(templates: tuple = TEMPLATES, phrases: tuple = tuple(PHRASES.items())) -> Scanner:
    words = sorted({w for _, t in templates for w in t.split()} | {w for p, _ in phrases for w in p.split()}, key=text_hash)
    ids = {w: k for k, w in enumerate(words)}
    a = Automaton()
    lists = [[ids[w] for w in t.split()] for _, t in templates]
    for k, x in enumerate(lists):
        a.add(k, x)
    for k, x in enumerate(lists):
        a.mark(k, x)
    return Scanner(np.array([text_hash(w) for w in words], np.uint64), [([ids[w] for w in p.split()], label) for p, label in phrases], a, [len(x) for x in lists], [label for label, _ in templates])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple = TEMPLATES, phrases: tuple = tuple(PHRASES.items())) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    labels joins the base labels with those of template spans; score is 1 with a
    base phrase, else the largest covered share. Null and empty texts have no
    words, no labels and score 0; null ids and repeated rows come back as they
    are. Each template's matches are chained by themselves, so one that stands
    within a longer one's match is found too. Only runs of words that some
    template has reach the automaton: any other word ends every match."""
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:int,last:int,covered:double>>"
    span_type = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("covered", pa.float64())]))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sc = scanner(templates, phrases)
        for batch in batches:
            for i, j, offsets, data in byte_parts(batch.column(1)):
                data = LOWER[data]
                starts, ends, first = spans(WORD[data], offsets)
                hashes = span_hashes(data, starts, ends)
                found = np.searchsorted(sc.vocabulary, hashes)
                found[found == len(sc.vocabulary)] = 0
                ids = np.where(sc.vocabulary[found] == hashes, found, -1)
                rows = j - i
                n_base, low, high = np.zeros(rows, np.int64), [None] * rows, [None] * rows
                base: list[set[str]] = [set() for _ in range(rows)]
                more: list[list[dict]] = [[] for _ in range(rows)]
                row_of = np.repeat(np.arange(rows), np.diff(first))
                for words, label in sc.phrases:
                    m = len(ids) - len(words) + 1
                    if m <= 0:
                        continue
                    hit = np.ones(m, bool)
                    for k, w in enumerate(words):
                        hit &= ids[k : k + m] == w
                    for at in np.flatnonzero(hit):
                        r = row_of[at]
                        if row_of[at + len(words) - 1] == r:
                            place = int(at - first[r])
                            n_base[r] += 1
                            base[r].add(label)
                            low[r] = place if low[r] is None else min(low[r], place)
                            high[r] = place if high[r] is None else max(high[r], place)
                runs, stops, _ = spans(ids >= 0, first)
                long = stops - runs >= LEAST
                runs, stops = runs[long], stops[long]
                # runs that are near enough for a chain go to the automaton together
                apart = np.concatenate([[True], (runs[1:] - stops[:-1] > GAP) | (row_of[runs[1:]] != row_of[runs[:-1]])]) if len(runs) else np.empty(0, bool)
                for a, b in zip(runs[apart], stops[np.append(apart[1:], True)] if len(runs) else stops, strict=True):
                    r = row_of[a]
                    more[r] += [{"label": x, "first": f, "last": e, "covered": c} for x, f, e, c in sc.spans(ids[a:b].tolist(), int(a - first[r]))]
                labels = [",".join(sorted(base[r] | {x["label"] for x in more[r]})) for r in range(rows)]
                scores = [1.0 if base[r] else max((x["covered"] for x in more[r]), default=0.0) for r in range(rows)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, rows), pa.array(np.diff(first).astype(np.int64)), pa.array(n_base), pa.array(low, pa.int64()), pa.array(high, pa.int64()),
                     pa.array([",".join(sorted(x)) for x in base], pa.string()), pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(more, span_type)],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scanned, schema)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """license_scan() of all documents without the spans; an empty table gives no rows."""
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")
