"""License scans by template markup.

A template is license wording with two kinds of markup: ``[[ ... ]]`` is an optional region and ``{{n}}`` or
``{{n:example}}`` a replaceable one of at most ``n`` words. Templates compile to one nondeterministic token automaton;
mandatory words must match exactly (A-Z lower-cased, punctuation ignored), optional regions may be absent, replaceable
ones hold any words. The automaton starts where the first mandatory words of a template stand, so the scan costs one
substring search per template plus the few places found.

``WHOLE`` templates are whole published texts: a text whose mandatory wording differs anywhere has no such label. Excerpts have
labels and lower weights of their own and give way to the whole text; statements name a license. The four base phrases are templates without markup. Texts are judged whole, one by one, without a shuffle. Null and
empty texts have no words, no labels and score 0. An empty table gives no rows. Repeated rows are judged alike; input columns of any name stay in ``row``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .common import WORD_BYTES, annotate

# Phrases and labels of the base scan.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Whole published license texts with markup; label, text.
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
    OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {{10:THE AUTHORS OR COPYRIGHT
    HOLDERS}} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING
    FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and [[ associated ]]
    documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
    to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
    whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
    permission notice [[ (including the next paragraph) ]] shall be included in all copies or substantial portions of the
    Software."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
    provided that the above copyright notice and this permission notice appear in all copies."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: [[ 1. ]] Redistributions of source code must retain the above copyright notice, this list of
    conditions and the following disclaimer. [[ 2. ]] Redistributions in binary form must reproduce the above copyright notice,
    this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
    distribution."""
_BSD_NAMES = """[[ 3. ]] Neither the name of {{12:the copyright holder}} nor the names of its contributors may be used to endorse or
    promote products derived from this software without specific prior written permission."""
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY {{12:THE COPYRIGHT HOLDERS AND CONTRIBUTORS}} "AS IS" AND ANY EXPRESS OR IMPLIED
    WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
    DISCLAIMED. IN NO EVENT SHALL {{12:THE COPYRIGHT HOLDER OR CONTRIBUTORS}} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
    SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
    LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
    STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF
    ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
    License."""
WHOLE = (
    ("mit", _MIT + " " + _AS_IS),
    ("isc", _ISC + """ THE SOFTWARE IS PROVIDED "AS IS" AND {{10:THE AUTHOR}} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
        INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {{10:THE AUTHOR}} BE LIABLE FOR ANY
        SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
        PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
        USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd-2-clause", _BSD + " " + _BSD_AS_IS),
    ("bsd-3-clause", _BSD + " " + _BSD_NAMES + " " + _BSD_AS_IS),
    ("apache-2.0", _APACHE + """ You may obtain a copy of the License at {{10:http://www.apache.org/licenses/LICENSE-2.0}} Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
        any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: [[ 1. ]] The origin of this software must not be misrepresented; you must not claim that you wrote the
        original software. If you use this software in a product, an acknowledgment in the product documentation would be
        appreciated but is not required. [[ 2. ]] Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. [[ 3. ]] This notice may not be removed or altered from any source
        distribution."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of
        this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for
        the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an
        overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. """
     + _AS_IS),
)
# Excerpts, which count only where none of the named whole texts is accepted; label, weight, template.
EXCERPTS = (
    ("mit-excerpt", 0.8, _MIT, ("mit",)),
    ("isc-excerpt", 0.8, _ISC, ("isc",)),
    ("bsd-excerpt", 0.8, _BSD, ("bsd-2-clause", "bsd-3-clause")),
    ("unlicense-excerpt", 0.8, """This is free and unencumbered software released into the public domain.""", ("unlicense",)),
)
# Statements and notices that name a license; label, weight, template.
STATED = (
    ("apache-2.0", 0.9, """Licensed under the Apache License, Version 2[[ .0 ]]"""),
    ("gpl-3.0", 0.9, """licensed under the GNU General Public License, version 3"""),
    ("gpl-2.0", 0.9, """licensed under the GNU General Public License, version 2"""),
    ("gpl-notice", 0.9, """{{8:This program}} is free software[[ ; you can redistribute ]][[ : you can redistribute ]] it
        and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation"""),
    ("cc-by-nc", 0.9, """licensed under CC BY-NC [[ {{2:4.0}} ]]"""),
    ("cc-by-sa", 0.9, """licensed under CC BY-SA [[ {{2:4.0}} ]]"""),
    ("mit", 0.9, """released under the [[ {{2:terms of the}} ]] MIT License"""),
    ("mpl-2.0", 0.9, """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."""),
)
TEMPLATES = (*[(label, 1.0, text) for label, text in WHOLE], *[e[:3] for e in EXCERPTS], *STATED)
UNLESS = {e[0]: set(e[3]) for e in EXCERPTS}
BASE_WEIGHT = 0.6

FOUND = ("n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
         "score double, matches array<struct<label:string,first:bigint,last:bigint>>")


def parse(template: str) -> list:
    """Template as a list of words, ``("any", n)`` for replaceable and ``("maybe", list)`` for optional regions."""
    stack: list[list] = [[]]
    for mark in re.findall(r"\[\[|\]\]|\{\{\d+(?::[^}]*)?\}\}|[^\[\]{}]+|[\[\]{}]", template):
        if mark == "[[":
            stack.append([])
        elif mark == "]]":
            inner = stack.pop()
            stack[-1].append(("maybe", inner))
        elif mark.startswith("{{"):
            stack[-1].append(("any", int(re.match(r"\{\{(\d+)", mark)[1])))
        else:
            stack[-1].extend(mark.encode().translate(WORD_BYTES).split())
    if len(stack) != 1:
        raise ValueError("optional region not closed")
    return stack[0]


class TokenAutomaton:
    """States of one template: ``steps[state]`` maps a word to states, ``free[state]`` takes any word, ``skip`` none."""

    def __init__(self, template: str):
        parts = parse(template)
        while parts and not isinstance(parts[0], bytes):  # leading markup binds nothing
            parts = parts[1:]
        if not parts:
            raise ValueError("template without mandatory words")
        self.lead = [parts[0]]
        for part in parts[1:]:
            if not isinstance(part, bytes):
                break
            self.lead.append(part)
        self.steps: list[dict[bytes, int]] = []
        self.free: list[int | None] = []
        self.skip: list[list[int]] = []
        self.final = self._chain(parts, self._add())

    def _add(self) -> int:
        self.steps.append({})
        self.free.append(None)
        self.skip.append([])
        return len(self.steps) - 1

    def _chain(self, parts: list, at: int) -> int:
        for part in parts:
            if isinstance(part, bytes):
                to = self._add()
                self.steps[at][part] = to
            elif part[0] == "any":
                to = self._add()
                self.skip[at].append(to)
                for _ in range(part[1]):
                    step = self._add()
                    self.free[at] = step
                    self.skip[step].append(to)
                    at = step
            else:
                inside, to = self._add(), self._add()
                self.skip[at] += [inside, to]
                self.skip[self._chain(part[1], inside)].append(to)
            at = to
        return at

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for to in self.skip[todo.pop()]:
                if to not in states:
                    states.add(to)
                    todo.append(to)
        return states

    def shortest(self, words: list[bytes], at: int) -> int | None:
        """Position after the shortest accepted run of words from ``at``."""
        states = self._closed({0})
        while self.final not in states:
            if at >= len(words) or not states:
                return None
            word = words[at]
            states = self._closed({to for s in states for to in (self.steps[s].get(word), self.free[s]) if to is not None})
            at += 1
        return at


class Scanner:
    def __init__(self, base: dict[str, str], templates):
        self.base = [(label, TokenAutomaton(phrase)) for phrase, label in base.items()]
        self.templates = [(label, weight, TokenAutomaton(text)) for label, weight, text in templates]

    @staticmethod
    def _places(line: bytes, lead: list[bytes]):
        """Word positions at which the lead stands; ``line`` has one blank before and after every word."""
        needle = b" " + b" ".join(lead) + b" "
        at, seen, word = line.find(needle), 0, 0
        while at >= 0:
            word += line.count(b" ", seen, at)
            seen = at
            yield word
            at = line.find(needle, at + 1)

    def scan(self, text: bytes | None) -> dict:
        words = text.translate(WORD_BYTES).split() if text else []
        line = b" " + b" ".join(words) + b" "
        starts, base, labels, matches, score = [], set(), set(), [], 0.0
        for label, automaton in self.base:
            for at in self._places(line, automaton.lead):
                if automaton.shortest(words, at) is not None:
                    starts.append(at)
                    base.add(label)
        whole: set[str] = set()
        for label, weight, automaton in self.templates:
            if UNLESS.get(label, set()) & whole:
                continue
            for at in self._places(line, automaton.lead):
                end = automaton.shortest(words, at)
                if end is not None:
                    labels.add(label)
                    if weight == 1.0:
                        whole.add(label)
                    score = max(score, weight)
                    matches.append({"label": label, "first": at, "last": end - 1})
        return {"n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None),
                "last_word": max(starts, default=None), "base_labels": ",".join(sorted(base)),
                "labels": ",".join(sorted(base | labels)), "score": max(score, BASE_WEIGHT if base else 0.0),
                "matches": matches}


def scan_licenses(docs: DataFrame, keep: list[str] | None = None, base: dict[str, str] | None = None,
                  templates=TEMPLATES) -> DataFrame:
    """License labels of every text: columns ``row`` and ``found`` (see ``FOUND``).

    ``score`` is the weight of the strongest accepted template, ``BASE_WEIGHT`` for a phrase alone, else 0.
    """
    scanner = Scanner(BASE if base is None else base, templates)

    def per_batch(texts):
        found = [scanner.scan(text) for text in texts]
        return {name: [x[name] for x in found] for name in found[0]}

    return annotate(docs, FOUND, per_batch, keep)
