"""License scans by template markup.

A template is a license's wording with markup: <<beginOptional>> ... <<endOptional>> may be left out, and
<<var;name="n";match="regex";min=1;max=3>> stands for that many words, each matching the regex (default: any 0 to 12 words).
Words are compared without case and marks. Each template becomes a token automaton: a state lies between tokens, an
optional region adds a way around it, a replaceable one a chain of word tests. A passage is accepted if the automaton reads
it from its first to its last word, so mandatory wording has to match exactly; the longest reading from each place counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import column, tune

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE <<var;name="who";max=5>> BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be
included in all copies or substantial portions of the Software. """ + _WARRANTY
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY <<var;name="who";min=1;max=12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;name="liable";min=1;max=12>>
BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAME = """Neither the name of <<var;name="holder";min=1;max=12>> nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission"""
_GNU = """This <<var;name="what";max=3>> is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of the GNU
{} as published by the Free Software Foundation <<var;name="which";max=2>> version <<var;name="version";match="[0-9]+";min=1;max=2>> of the License<<beginOptional>>,
or (at your option) any later version<<endOptional>>."""
_GNU_WARRANTY = """ This <<var;name="that";max=3>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details."""

#: name -> template
TEMPLATES = {
    "GPL-notice": '<<beginOptional>>This <<var;name="what";max=3>> is<<endOptional>> licensed under <<beginOptional>>the terms of<<endOptional>> the GNU General Public License<<beginOptional>> as published by the Free Software Foundation<<endOptional>>, version <<var;name="version";match="[0-9]+";min=1;max=2>>',
    "LGPL-notice": '<<beginOptional>>This <<var;name="what";max=3>> is<<endOptional>> licensed under <<beginOptional>>the terms of<<endOptional>> the GNU Lesser General Public License, version <<var;name="version";match="[0-9]+";min=1;max=2>>',
    "CC-notice": '<<beginOptional>>This <<var;name="what";max=3>> is<<endOptional>> licensed under <<beginOptional>>a<<endOptional>> CC <<var;name="terms";match="by|nc|sa|nd";min=1;max=3>> <<var;name="version";match="[0-9]+";min=1;max=2>>',
    "MIT-notice": '<<var;name="verb";match="released|licensed|distributed|available";min=1;max=1>> under <<beginOptional>>the terms of<<endOptional>> the MIT License',
    "BSD-notice": '<<var;name="verb";match="released|licensed|distributed|available";min=1;max=1>> under the <<var;name="clauses";match="new|simplified|modified|2|3|clause";min=0;max=2>> BSD License',
    "Apache-notice": 'Licensed under the Apache License, Version <<var;name="version";match="[0-9]+";min=1;max=2>>',
    "Apache-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at <<var;name="address";max=9>> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MPL-notice": 'This Source Code Form is subject to the terms of the Mozilla Public License, v. <<var;name="version";match="[0-9]+";min=1;max=2>>',
    "MPL-header": 'This Source Code Form is subject to the terms of the Mozilla Public License, v. <<var;name="version";match="[0-9]+";min=1;max=2>>. If a copy of the MPL was not distributed with this file, You can obtain one at <<var;name="address";min=1;max=7>>',
    "GPL-header": _GNU.format("General Public License") + _GNU_WARRANTY.format("General Public License"),
    "LGPL-header": _GNU.format("Lesser General Public License") + _GNU_WARRANTY.format("Lesser General Public License"),
    "AGPL-header": _GNU.format("Affero General Public License") + _GNU_WARRANTY.format("Affero General Public License"),
    "CC-header": 'This work is licensed under <<beginOptional>>a<<endOptional>><<beginOptional>>the<<endOptional>> Creative Commons <<var;name="terms";match="attribution|noncommercial|non|commercial|sharealike|share|alike|noderivatives|noderivs|no|derivatives";min=1;max=6>> <<var;name="version";match="[0-9]+";min=1;max=2>> <<var;name="port";max=2>> License',
    "MIT": _MIT,
    "BSD-2-clause": _BSD + " " + _BSD_DISCLAIMER,
    "BSD-3-clause": _BSD + " <<beginOptional>>3.<<endOptional>> " + _BSD_NAME + ". " + _BSD_DISCLAIMER,
    "BSD-3-addition": _BSD_NAME,
    "ISC": """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="who";min=1;max=6>> DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;name="liable";min=1;max=6>> BE LIABLE FOR ANY
SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of
this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to
the following restrictions: <<beginOptional>>1.<<endOptional>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. <<beginOptional>>2.<<endOptional>> Altered source versions must be
plainly marked as such, and must not be misrepresented as being the original software. <<beginOptional>>3.<<endOptional>> This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the
author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and
to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under
copyright law. """ + _WARRANTY,
    "SPDX-tag": 'SPDX License Identifier <<var;name="identifier";min=1;max=4>>',
}

_TOKEN = re.compile(r"\w+")
_MARK = re.compile(r"<<(.*?)>>", re.S)


def tokens(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in _TOKEN.finditer(text)]


class Automaton:
    """States 0 .. n; words[s]: the word from s to s + 1, or a test; skips[s]: states reached from s without a word."""

    def __init__(self, template: str) -> None:
        self.words: list[str | re.Pattern] = []
        self.skips: dict[int, set[int]] = {}
        open_: list[int] = []
        at = 0
        for m in [*_MARK.finditer(template), None]:
            for word, _, _ in tokens(template[at : m.start() if m else None]):
                self.words.append(word)
            if m is None:
                break
            at = m.end()
            kind, *rest = m[1].split(";")
            if kind == "beginOptional":
                open_.append(len(self.words))
            elif kind == "endOptional":
                if not open_:
                    raise ValueError("an optional region ends that never began")
                self.skips.setdefault(open_.pop(), set()).add(len(self.words))
            elif kind == "var":
                fields = dict(f.split("=", 1) for f in rest)
                test = re.compile(fields.get("match", '"\\w+"').strip('"'))
                low, high = int(fields.get("min", 0)), int(fields.get("max", 12))
                first = len(self.words)
                self.words += [test] * high
                for s in range(first + low, first + high):
                    self.skips.setdefault(s, set()).add(first + high)
            else:
                raise ValueError(f"unknown markup {kind}")
        if open_:
            raise ValueError("an optional region doesn't end")
        self.end = len(self.words)
        self._next: dict[tuple[frozenset[int], str], frozenset[int]] = {}
        self.start = self._closed({0})
        if self.end in self.start:
            raise ValueError("a template needs mandatory wording")

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo, out = list(states), set(states)
        while todo:
            for t in self.skips.get(todo.pop(), ()):
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return frozenset(out)

    def step(self, states: frozenset[int], word: str) -> frozenset[int]:
        """The states after a word; remembered as long as there are few."""
        key = states, word
        if key not in self._next:
            if len(self._next) > 20_000:
                self._next.clear()
            self._next[key] = self._closed({s + 1 for s in states if s < self.end and (self.words[s] == word if isinstance(self.words[s], str) else self.words[s].fullmatch(word))})
        return self._next[key]

    def longest(self, words: list[str], i: int) -> int:
        """The end of the longest accepted run of words from i, or -1."""
        states, best = self.start, -1
        while states and i < len(words):
            states = self.step(states, words[i])
            i += 1
            if self.end in states:
                best = i
        return best

    def begins(self, word: str) -> bool:
        return bool(self.step(self.start, word))

    def literals(self) -> set[str]:
        """Words that every accepted passage holds: those in no optional or replaceable region."""
        optional = set()
        for a, ends in self.skips.items():
            optional |= set(range(a, max(ends)))
        return {w for s, w in enumerate(self.words) if isinstance(w, str) and s not in optional}


class Scanner:
    """Automata, and for each word that was seen those that can begin with it."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.automata = {k: Automaton(t) for k, t in templates.items()}
        self.starts: dict[str, list[tuple[str, Automaton]]] = {}

    def beginning(self, word: str) -> list[tuple[str, Automaton]]:
        if word not in self.starts:
            if len(self.starts) > 200_000:
                self.starts.clear()
            self.starts[word] = [(k, a) for k, a in self.automata.items() if a.begins(word)]
        return self.starts[word]

    def scan(self, text: str) -> list[tuple[str, int, int, int]]:
        """(template, start, end, words) of all accepted passages, characters of text; for each template those that don't overlap, leftmost and longest."""
        toks = tokens(text)
        words = [t[0] for t in toks]
        out, ends = [], dict.fromkeys(self.automata, 0)
        for i, w in enumerate(words):
            for name, a in self.beginning(w):
                if i >= ends[name] and (end := a.longest(words, i)) > i:
                    out.append((name, toks[i][1], toks[end - 1][2], end - i))
                    ends[name] = end
        return sorted(out, key=lambda f: (f[1], f[2], f[0]))

    def trigger(self) -> str | None:
        """A pattern that every text with an accepted passage matches: the longest mandatory word of each template; None where a template has none."""
        words = [max(sorted(a.literals()), key=len, default=None) for a in self.automata.values()]
        return None if None in words else "(?i)" + "|".join(sorted({re.escape(w) for w in words}))


def licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, start, end, n_words) of every passage that a template accepts.

    Null, empty and wordless texts have none. Rows with a null doc_id are reported with a null doc_id, repeated rows each. A text of
    any length is read whole, in time in proportion: no passage is longer than its template. A template needs mandatory wording or
    mandatory replaceable words; one without a fixed word makes every text be read. An empty table gives an empty result, as do
    no templates. Other columns don't matter.
    """
    tune(docs.sparkSession)
    templates = TEMPLATES if templates is None else templates
    pattern = Scanner(templates).trigger()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for b in batches:
            some = range(b.num_rows) if pattern is None else pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(b["text"], pattern), False)).to_pylist()
            rows = [(k, *f) for k in some for f in scanner.scan(b["text"][k].as_py())]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.record_batch({"doc_id": b["doc_id"].take(pa.array(cols[0], pa.int64())), "license": pa.array(cols[1], pa.string()), **{n: pa.array(c, pa.int32()) for n, c in zip(("start", "end", "n_words"), cols[2:])}})

    rows = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text")).filter("text IS NOT NULL")
    return rows.mapInArrow(run, "doc_id long, license string, start int, end int, n_words int")
