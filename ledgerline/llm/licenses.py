"""License scans by template-markup matching.

A template is text with markup: ``<<optional>> ... <<end>>`` encloses wording that may be missing, and
``<<any:n>>`` stands for up to n words of any kind (a name, a year); all other words are mandatory.  Templates
and texts are read as the same word sequence (lower case, words of letters and digits), so layout and marks
never matter.  A template is compiled into a token automaton: states are places in the wording, a word moves
along it, optional regions and replaceable ones add moves.  A text has the template's label if some run of its
words takes the automaton from start to end, so all mandatory wording matches exactly and in order.

Base labels come from set phrases that stand as consecutive words.  All in one pass over whole texts, without
a shuffle; automata are simulated with sets of states from words that can start a template, so a start costs at
most a template's length with its replaceable words, and the whole is linear in the text.  Replaceable regions are
bounded: a longer holder's name than the region allows doesn't match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerline.llm.common import own_columns

#: Words that are phrases, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Labels and templates of short notices, in the common wording, with what may vary marked.
NOTICES = {
    "apache-2.0": "licensed under the apache license <<optional>> version <<end>> 2.0",
    "mit-notice": "<<optional>> released <<end>> <<optional>> distributed <<end>> under the <<optional>> terms of the <<end>> mit license",
    "gpl-3.0": "<<optional>> this work is <<end>> licensed under the gnu general public license <<optional>> version <<end>> 3",
    "cc-by-nc-4.0": "licensed under <<optional>> the <<end>> <<optional>> creative commons <<end>> <<optional>> attribution noncommercial <<end>> cc by nc 4.0",
    "cc-by-4.0": "licensed under <<optional>> the <<end>> <<optional>> creative commons <<end>> cc by 4.0",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of <<any:6>> and associated documentation files",
    "bsd-terms": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "copyright-notice": "copyright <<optional>> c <<end>> <<any:8>> all rights reserved",
}

_BSD_SOURCE = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
    the following conditions are met: <<optional>> 1 <<end>> Redistributions of source code must retain the above copyright
    notice, this list of conditions and the following disclaimer. <<optional>> 2 <<end>> Redistributions in binary form must
    reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or
    other materials provided with the distribution."""
_BSD_NAMES = """<<optional>> 3 <<end>> Neither the name of <<any:20>> nor the names of its contributors may be used to endorse or
    promote products derived from this software without specific prior written permission."""
_BSD_DISCLAIMER = """This software is provided by <<any:20>> "as is" and any express or implied warranties, including, but not
    limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event
    shall <<any:20>> be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including,
    but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption)
    however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or
    otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."""

#: Labels and templates of whole licenses and file headers (their public wording; names and numbering may vary).
LICENSES = {
    "mit-full": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice <<optional>> (including the next paragraph) <<end>> shall be included in all copies or
        substantial portions of the Software. The Software is provided "as is", without warranty of any kind, express or
        implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and
        noninfringement. In no event shall <<any:20>> be liable for any claim, damages or other liability, whether in an action
        of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in
        the software.""",
    "isc-full": """Permission to use, copy, modify, <<optional>> and <<end>> <<optional>> or <<end>> distribute this software for any
        purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear
        in all copies. The software is provided "as is" and <<any:20>> disclaims all warranties with regard to this software
        including all implied warranties of merchantability and fitness. In no event shall <<any:20>> be liable for any special,
        direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether
        in an action of contract, negligence or other tortious action, arising out of or in connection with the use or
        performance of this software.""",
    "bsd-2-clause": f"{_BSD_SOURCE} {_BSD_DISCLAIMER}",
    "bsd-3-clause": f"{_BSD_SOURCE} {_BSD_NAMES} {_BSD_DISCLAIMER}",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 <<optional>> (the "License") <<end>>; you may not use this file
        except in compliance with the License. You may obtain a copy of the License at <<any:8>> Unless required by applicable
        law or agreed to in writing, software distributed under the License is distributed on an "as is" basis, without warranties
        or conditions of any kind, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""",
    "gpl-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        <<optional>> Affero <<end>> <<optional>> Lesser <<end>> General Public License as published by the Free Software
        Foundation, either version <<any:1>> of the License, or (at your option) any later version. This program is distributed in
        the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness
        for a particular purpose. See the GNU <<optional>> Affero <<end>> <<optional>> Lesser <<end>> General Public License for
        more details.""",
}
TEMPLATES = NOTICES | LICENSES

#: Bytes that are no part of a word become spaces, A-Z become a-z.
TO_WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str | bytes | None) -> list[bytes]:
    """Words of a text: runs of digits, letters and anything beyond ASCII, A-Z lower-cased."""
    data = text.encode() if isinstance(text, str) else text or b""
    return data.translate(TO_WORDS).split()


@dataclass
class Automaton:
    """A compiled template: per state, words that move on, states that are reached freely, and whether any word moves on."""

    label: str
    words: list[dict[bytes, int]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    any: list[list[int]] = field(default_factory=list)
    end: int = 0

    def state(self) -> int:
        self.words.append({})
        self.free.append([])
        self.any.append([])
        return len(self.words) - 1

    def closed(self, states: set[int]) -> frozenset[int]:
        """These states and all that are reached from them freely."""
        out, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return frozenset(out)

    def starts(self) -> set[bytes]:
        """Words with which an accepted run can begin."""
        return {w for s in self.closed({0}) for w in self.words[s]}

    def match(self, words: list[bytes], at: int) -> int | None:
        """End of the longest accepted run of words from ``at``, or None."""
        states, found = self.closed({0}), None
        for i in range(at, len(words) + 1):
            if self.end in states:
                found = i
            if i == len(words):
                break
            nxt = {self.words[s][words[i]] for s in states if words[i] in self.words[s]}
            nxt.update(t for s in states for t in self.any[s])
            if not nxt:
                break
            states = self.closed(nxt)
        return found


def compiled(label: str, template: str) -> Automaton:
    """Automaton of one template."""
    auto = Automaton(label)
    here, opened = auto.state(), []
    for part in re.split(r"(<<[^>]*>>)", template):
        if part == "<<optional>>":
            opened.append(here)
        elif part == "<<end>>":
            if not opened:
                raise ValueError(f"{label}: <<end>> without <<optional>>")
            start = opened.pop()
            after = auto.state()
            auto.free[here].append(after)
            auto.free[start].append(after)
            here = after
        elif m := re.fullmatch(r"<<any:(\d+)>>", part):
            states = [auto.state() for _ in range(int(m[1]) + 1)]
            auto.free[here].append(states[0])
            for a, b in zip(states, states[1:], strict=False):
                auto.any[a].append(b)
                auto.free[a].append(states[-1])
            here = states[-1]
        elif part.startswith("<<"):
            raise ValueError(f"{label}: unknown markup {part}")
        else:
            for word in words_of(part):
                nxt = auto.state()
                auto.words[here][word] = nxt
                here = nxt
    if opened:
        raise ValueError(f"{label}: <<optional>> without <<end>>")
    auto.end = here
    if auto.end in auto.closed({0}):
        raise ValueError(f"{label}: no mandatory wording")
    return auto


class Scanner:
    """All phrases and templates, ready for texts."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.phrases = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]
        self.automata = [compiled(label, t) for label, t in templates.items()]
        self.by_start: dict[bytes, list[Automaton]] = {}
        for auto in self.automata:
            for w in auto.starts():
                self.by_start.setdefault(w, []).append(auto)
        # A word that every run of the template must hold: texts without it aren't walked.
        self.must = {a.label: self._mandatory(templates[a.label]) for a in self.automata}

    @staticmethod
    def _mandatory(template: str) -> bytes:
        while "<<optional>>" in template:
            shorter = re.sub(r"<<optional>>(?:(?!<<optional>>|<<end>>).)*<<end>>", " ", template)
            if shorter == template:
                break
            template = shorter
        return max(words_of(re.sub(r"<<any:\d+>>", " ", template)), key=len)

    def scan(self, text: str | bytes | None) -> tuple[int, int, int | None, int | None, list[str], list[str], list[tuple[int, int, str]]]:
        """(words, base places, first, last start of a place, base labels, all labels, template spans)."""
        words = words_of(text)
        line = b" " + b" ".join(words) + b" "
        places, base = [], set()
        for phrase, label in self.phrases:
            at, counted, word = line.find(phrase), 0, -1
            while at >= 0:
                word += line.count(b" ", counted, at + 1)  # words up to here, counted once
                counted = at + 1
                places.append(word)
                base.add(label)
                at = line.find(phrase, at + 1)
        due = {a.label for a in self.automata if b" " + self.must[a.label] + b" " in line}
        spans = []
        if due:
            starts = {w for w, autos in self.by_start.items() if any(a.label in due for a in autos)}
            for i, w in enumerate(words):
                if w in starts:
                    for auto in self.by_start[w]:
                        if auto.label in due and (end := auto.match(words, i)) is not None:
                            spans.append((i, end, auto.label))
        found = {label for _, _, label in spans}
        return len(words), len(places), min(places, default=None), max(places, default=None), sorted(base), sorted(base | found), spans


def scan(documents: DataFrame, key: str = "doc_id", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Scan whole texts for licenses.

    Returns the key, n_words, n_base (places of set phrases), first_word and last_word (their smallest and
    largest first word, from 0; null without places), base_labels and labels (distinct, sorted, joined by
    commas; labels also holds those of templates), score and spans (first word, end, label of each template
    that matched).  score is 1 if the whole wording of a template (a notice or a license) matched, 0.5 if only set phrases stand in the
    text, 0 otherwise.  Defined results: a null text is empty; an empty text has no words, labels "" and score
    0; repeated rows are scanned alike; an empty table gives no rows; further columns are not looked at.
    """
    fields = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:long,end:long,label:string>>"
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch in batches:
            rows = []
            for x in batch.column(1):
                n, base, first, last, base_labels, labels, spans = scanner.scan(x.as_buffer().to_pybytes() if x.is_valid else b"")
                score = 1.0 if spans else 0.5 if base else 0.0
                rows.append((n, base, first, last, ",".join(base_labels), ",".join(labels), score, [{"start": a, "end": b, "label": c} for a, b, c in spans]))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]], names=[key, *names])

    source = own_columns(documents, [key, "text"])
    kind = source.schema[key].dataType.simpleString()
    return source.mapInArrow(work, f"`{key}` {kind}, {fields}")
