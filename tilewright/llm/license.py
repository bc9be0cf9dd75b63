"""License scans by template matching.

A template is wording with markup: [[ ... ]] encloses an optional region, {{n}} stands for up to n replaceable words.
Each template is compiled into an automaton over tokens (words), with states at the gaps between its words; optional
regions add empty moves, replaceable ones loops that any word feeds. A text is accepted where the automaton reaches its
end, which needs all mandatory words in order and exactly; the longest such match is the template's place. Texts are
scanned once for the words that templates start with; the automaton runs from there only.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tilewright.llm.common import keyed_texts, small_batches, table, tidy, utf8, worker_cache

#: Words of any script; A-Z are lowered before. On UTF-8 bytes, where other scripts' letters are bytes from 128 up.
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+").findall

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# fixed values: wordings of public licenses and of the notices that name them; their labels are this operator's own
TEMPLATES = {
    "mit-notice": "released under the [[terms of the]] mit [[open source]] license",
    "mit-text": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
        including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so
        subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software
        the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and {{2}}
        in no event shall {{8}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software
        or the use or other dealings in the software""",
    "apache-2-notice": "licensed under the apache license version 2 [[0]] [[the license]]",
    "apache-2-terms": """you may not use {{2}} file except in compliance with the license you may obtain a copy of the license at {{8}} unless required by applicable law or agreed to in writing
        software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied
        see the license for the specific language governing permissions and limitations under the license""",
    "cc-by-nc-notice": "licensed under [[a]] [[the]] [[creative commons]] cc by nc [[{{2}} license]]",
    "cc-by-notice": "this work is licensed under a creative commons attribution [[{{4}} international]] license",
    "gpl-notice": "this {{3}} is licensed under the [[terms of the]] gnu general public license version 3",
    "gpl-or-later": "under the terms of the gnu general public license as published by the free software foundation either version {{2}} of the license or at your option any later version",
    "bsd-text": """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution
        [[[[3]] neither the name of {{8}} nor the names of {{2}} contributors may be used to endorse or promote products derived from this software without specific prior written permission]]
        this software is provided by {{6}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed
        in no event shall {{6}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services
        loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise
        arising in any way out of the use of this software even if advised of the possibility of such damage""",
    "isc-text": """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and {{4}} disclaims all warranties with regard to this software
        including all implied warranties of merchantability and fitness in no event shall {{4}} be liable for any special direct indirect or consequential damages or any damages whatsoever
        resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software""",
    "0bsd-text": """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is and {{4}} disclaims all warranties
        with regard to this software including all implied warranties of merchantability and fitness in no event shall {{4}} be liable for any special direct indirect or consequential damages
        or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action
        arising out of or in connection with the use or performance of this software""",
    "mpl-2-notice": "this source code form is subject to the terms of the mozilla public license v 2 0 [[if a copy of the mpl was not distributed with this file you can obtain one at {{8}}]]",
}


#: States of an automaton, and words that it reads, at most.
WINDOW = 400


class Automaton:
    """Token automaton of one template: edges by word, by any word, and empty ones."""

    def __init__(self, template: str):
        self.words: list[dict[bytes, int]] = [{}]
        self.any: list[int | None] = [None]
        self.empty: list[set[int]] = [set()]
        opened, self.mandatory = [], 0
        state = 0

        def new() -> int:
            self.words.append({})
            self.any.append(None)
            self.empty.append(set())
            return len(self.words) - 1

        for item in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[0-9a-z\x80-\U0010ffff]+", template.lower()):
            if item == "[[":
                opened.append(state)
            elif item == "]]":
                self.empty[opened.pop()].add(state)
            elif item[0] == "{":
                last = [state]
                for _ in range(int(item[2:-2])):
                    nxt = new()
                    self.any[state] = nxt
                    state = nxt
                    last.append(state)
                end = new()
                for s in last:
                    self.empty[s].add(end)
                state = end
            else:
                nxt = new()
                self.words[state][item.encode()] = nxt
                self.mandatory += not opened
                state = nxt
        if opened:
            raise ValueError("an optional region isn't closed")
        self.end = state
        self.reach = [self._closure(s) for s in range(len(self.words))]
        #: words that a match can start with; None if any can
        first = self.reach[0]
        self.first = None if any(self.any[s] is not None for s in first) or self.end in first else {w for s in first for w in self.words[s]}
        if len(self.words) > WINDOW:
            raise ValueError(f"a template may have {WINDOW} states at most")

    def _closure(self, state: int) -> frozenset[int]:
        out, todo = {state}, [state]
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return frozenset(out)

    def match(self, words: list[bytes], at: int) -> tuple[int | None, int]:
        """(end of the longest match from word at, None without any; words read until no state was left)."""
        states, k = self.reach[0], at
        end = at if self.end in states else None
        while k < len(words):
            nxt: set[int] = set()
            for s in states:
                if (t := self.words[s].get(words[k])) is not None:
                    nxt |= self.reach[t]
                if (t := self.any[s]) is not None:
                    nxt |= self.reach[t]
            if not nxt:
                break
            states, k = nxt, k + 1
            if self.end in states:
                end = k
        return end, k - at


def scan(text: bytes, phrases: list[tuple[list[bytes], str]], automata: list[tuple[str, Automaton]], starts: dict[bytes, list[int]]):
    """(number of words, starts of the phrases' places with labels, (label, first word, end) of templates, best share of
    wording read)."""
    words = _WORDS(text.lower())
    joined = b" ".join([b"", *words, b""])
    found, matches, best = [], [], 0.0

    def places(wording: bytes):
        """Index of the first word of each place of these words."""
        at, place, counted = joined.find(wording), 0, 0
        while at >= 0:
            place += joined.count(b" ", counted, at)
            counted = at
            yield place
            at = joined.find(wording, at + 1)

    for phrase, label in phrases:
        found += [(place, label) for place in places(b" ".join([b"", *phrase, b""]))]
    for word, which in starts.items():
        for place in places(b" " + word + b" "):
            window = words[place : place + WINDOW]
            for k in which:
                label, automaton = automata[k]
                end, read = automaton.match(window, 0)
                if end is not None:
                    matches.append((label, place, place + end))
                    best = 1.0
                elif read > 1:
                    best = max(best, min(0.99, read / automaton.mandatory))
    if found:
        best = 1.0
    return len(words), found, sorted(matches, key=lambda m: (m[1], m[0])), best


def license_labels(documents: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches) of every row.

    n_base: places of phrases, overlapping ones too. labels: those of phrases and templates, distinct, sorted,
    comma-joined; empty strings without any. score: 1 with any label, else the largest share of a template's mandatory
    wording that was read in a row from its first word. matches: (label, first_word, end) of each template's places, in
    words. A null text is empty, with no words and nulls for places. Null
    and repeated ids keep their rows, other columns are ignored. One pass without an exchange.
    """
    small_batches(documents.sparkSession)
    own = [([w.encode() for w in p.split()], label) for p, label in (PHRASES if phrases is None else phrases).items()]
    wording = TEMPLATES if templates is None else templates

    def run(batches):
        cache = worker_cache()
        key = "license:" + repr(sorted(wording.items()))
        if key not in cache:
            automata = [(label, Automaton(t)) for label, t in wording.items()]
            starts: dict[bytes, list[int]] = {}
            for k, (label, a) in enumerate(automata):
                if a.first is None:
                    raise ValueError(f"{label}: a template must start with a mandatory word")
                for w in a.first:
                    starts.setdefault(w, []).append(k)
            cache[key] = automata, starts
        automata, starts = cache[key]
        for batch in batches:
            rows = []
            for text in utf8(batch.column("text")):
                n, found, matches, best = scan(text, own, automata, starts)
                base, labels = {label for _, label in found}, {label for label, *_ in matches}
                rows.append((n, len(found), min(found)[0] if found else None, max(found)[0] if found else None, ",".join(sorted(base)), ",".join(sorted(base | labels)), best, [{"label": label, "first_word": a, "end": b} for label, a, b in matches]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])

    return keyed_texts(documents).mapInArrow(tidy(run), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,first_word:long,end:long>>")


def op4_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(table(spark, sf_dir, "documents"))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4_license that SQL can make too."""
    return op4_license(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


LICENSE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (SELECT doc_id, len(ws) AS n, list_filter(range(0, len(ws)), lambda i: ws[i + 1:i + 4] = ['under', 'the', 'mit', 'license']) AS mit,
  list_filter(range(0, len(ws)), lambda i: ws[i + 1:i + 4] = ['apache', 'license', 'version', '2']) AS apache, list_filter(range(0, len(ws)), lambda i: ws[i + 1:i + 3] = ['cc', 'by', 'nc']) AS cc FROM w),
a AS (SELECT *, mit || apache || cc AS places FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
  array_to_string(list_filter([CASE WHEN len(apache) > 0 THEN 'apache-2' END, CASE WHEN len(cc) > 0 THEN 'cc-by-nc' END, CASE WHEN len(mit) > 0 THEN 'mit' END], lambda x: x IS NOT NULL), ',') AS base_labels FROM a
"""
