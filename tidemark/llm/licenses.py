"""Licence recognition by sentence rules.

Texts are cut into sentences and normalised (lower case, letters and digits only,
single spaces).  A sentence that the table of known licence sentences holds has that
sentence's identifier.  A known sentence may have a slot for a holder, written
``{holder}``: any number of words of one paragraph, with full stops among them (as in
``Inc.``), up to where the sentence goes on.  An SPDX line is an expression: each of
its licences is a known sentence, with its exception where it has a known one; ``+``
and the names of GNU versions without "only" or "later" are read as SPDX says.  A
notice ("distributed under the terms of the MIT License") is a known sentence within
any other, unless the name goes on as another licence's ("MIT-style").  A rule is an ordered list of identifiers; it matches where
its identifiers follow each other in the text with at most ``gap`` other sentences
between two of them.  Longer rules are tried first, and a sentence serves one match.

A text is cut in two ways, because licences come as wrapped paragraphs and as single
lines: at ends of sentences across line breaks, and at line breaks too.  A known
sentence counts once, wherever either cut finds it, and what a wrapped one holds on a
line of its own does not count beside it.

A text that lacks, for every known sentence, one of its words needs no cutting: words
are looked for in the lower-cased text, which no white space or mark can hide.

Defined results: null and empty texts have no sentences; a null id is passed through;
repeated rows are judged row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm._shared import annotate

# The licences' own wording, common notices and identifiers.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "IN NO EVENT SHALL {holder} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of {holder} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "The name of {holder} may not be used to endorse or promote products derived from this software without specific prior written permission.",
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "you may not use this file except in compliance with the License.",
    "You may obtain a copy of the License at",
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_GNU = "This {work} is free software; you can redistribute it and/or modify it under the terms of "
_GNU_NAMES = (("GPL", "GNU General Public License"), ("LGPL", "GNU Lesser General Public License"), ("AGPL", "GNU Affero General Public License"))
_GNU_VERSIONS = {"GPL": ("2", "3"), "LGPL": ("2.1", "3"), "AGPL": ("3",)}
_CC = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
_SPDX = "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 MS-PL OFL-1.1 Unlicense WTFPL Zlib".split()


_EXCEPTIONS = "Bison-exception-2.2 Classpath-exception-2.0 GCC-exception-3.1 LLVM-exception Linux-syscall-note OpenSSL-exception".split()
#: How notices name a licence, without the word License that may follow.
_NOTICES = (
    ("MIT", "MIT"), ("BSD-2-Clause", "BSD 2-Clause"), ("BSD-2-Clause", "2-Clause BSD"), ("BSD-3-Clause", "BSD 3-Clause"), ("BSD-3-Clause", "3-Clause BSD"), ("ISC", "ISC"), ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License 2.0"), ("Apache-2.0", "Apache 2.0"), ("MPL-2.0", "Mozilla Public License 2.0"), ("MPL-2.0", "Mozilla Public License, version 2.0"), ("MPL-2.0", "MPL 2.0"), ("BSL-1.0", "Boost Software License 1.0"),
    ("EPL-2.0", "Eclipse Public License 2.0"), ("Unlicense", "Unlicense"), ("Zlib", "zlib"),
)


def _gnu_notices() -> list[tuple[str, tuple[str, ...]]]:
    """The notices of every version: "or later" in two punctuations, "only" in three wordings, of a program and of a library."""
    out = []
    for short, name in _GNU_NAMES:
        for version in _GNU_VERSIONS[short]:
            full = version if "." in version else f"{version}.0"
            for work in ("program", "library"):
                start, foundation = _GNU.format(work=work), "as published by the Free Software Foundation"
                out += [(f"{short}-{full}-or-later", (f"{start}the {name} {foundation}{mark} either version {version} of the License, or (at your option) any later version.",)) for mark in ",;"]
                out += [
                    (f"{short}-{full}-only", (f"{start}the {name} version {version} {foundation}.",)),
                    (f"{short}-{full}-only", (f"{start}version {version} of the {name} {foundation}.",)),
                    (f"{short}-{full}-only", (f"{start}the {name} {foundation}; version {version} of the License.",)),
                ]
    return out


#: Licence and the sentences of one of its rules, in their order.  A text that leaves "only" or "or later" open has the version's name.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", _MIT[:3]), ("MIT", _MIT), ("MIT", ("Released under the MIT License.",)), ("MIT", ("Licensed under the MIT License.",)), ("MIT", ("This project is licensed under the MIT License.",)),
    ("BSD-2-Clause", _BSD[:3]), ("BSD-3-Clause", _BSD[:4]), ("BSD-3-Clause", (*_BSD[:3], _BSD[4])),
    ("ISC", (f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.",)), ("0BSD", (f"{_ISC}.",)),
    ("Apache-2.0", _APACHE), ("Apache-2.0", ("Licensed under the Apache License, Version 2.0.",)),
    ("Apache-2.0", ("\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.", "\"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.")),
    *_gnu_notices(),
    ("GPL-3.0-only", ("This work is licensed under the GNU General Public License, version 3.",)),
    ("GPL-3.0", ("The GNU General Public License is a free, copyleft license for software and other kinds of works.",)),
    ("GPL-2.0", ("The licenses for most software are designed to take away your freedom to share and change it.", "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.")),
    ("LGPL-2.1", ("The licenses for most software are designed to take away your freedom to share and change it.", "By contrast, the GNU General Public Licenses are intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.")),
    ("LGPL-3.0", ("This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",)),
    ("AGPL-3.0", ("The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",)),
    ("MPL-2.0", ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.")),
    ("MPL-2.0", ("\"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.",)),
    ("EPL-2.0", ("\"Secondary License\" means either the GNU General Public License, Version 2.0, or any later versions of that license, including any exceptions or additional permissions as identified by the initial Contributor.",)),
    ("EPL-1.0", ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",)),
    ("EPL-2.0", ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",)),
    ("Zlib", ("This software is provided 'as-is', without any express or implied warranty.", "In no event will the authors be held liable for any damages arising from the use of this software.")),
    ("BSL-1.0", ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",)),
    ("Unlicense", ("This is free and unencumbered software released into the public domain.",)), ("CC0-1.0", ("This work is dedicated to the public domain under CC0 1.0.",)),
    *((f"CC-{short}-4.0", (f"Licensed under CC {short} 4.0.",)) for short, _ in _CC),
    *((f"CC-{short}-4.0", (f"This work is licensed under a Creative Commons {name} 4.0 International License.",)) for short, name in _CC),
    *((f"CC-{short}-4.0", (f"By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons {name} 4.0 International Public License (\"Public License\").",)) for short, name in _CC),
    *((name, (f"SPDX-License-Identifier: {name}",)) for name in _SPDX),
    *((f"{name} WITH {exception}", (f"SPDX-License-Identifier: {name} WITH {exception}",)) for name in _SPDX for exception in _EXCEPTIONS if name.startswith(("GPL", "LGPL", "AGPL", "Apache"))),
)

_SENTENCE = re.compile(r"(?<=[.!?;:])\s+|\n\s*\n")
_LINE = re.compile(r"(?<=[.!?;:])\s+|\n")
#: Where a known sentence names somebody.
SLOT = "{holder}"
TAG = "SPDX-License-Identifier:"
_WORDS = re.compile(r"[^\W_]+")
_SPDX_LINE = re.compile(r"SPDX-License-Identifier:[ \t]*([^\n]*)", re.I)
_SPDX_TERM = re.compile(r"([A-Za-z0-9][A-Za-z0-9.-]*\+?)(?:[ \t]+WITH[ \t]+([A-Za-z0-9][A-Za-z0-9.-]*))?", re.I)
#: A slot's words, and what may stand between them: no blank line.
_GAP = r"(?:(?!\n[ \t]*\n)[\W_])+"
#: What makes another licence of a name, or none.
_OTHERWISE = r"(?:[\W_]*(?:0|style|styled|like|type|inspired|derived|compatible|variant|modern|clear|attribution|no|modified|with|plus|exception|or[\W_]+later|nuclear|patent|lbnl|views)(?![^\W_]))"
_BULLET = re.compile(r"^(?:\W+|\(?\w{1,2}[.)])\s+")


def normal(sentence: str) -> str:
    return " ".join(_WORDS.findall(sentence.lower()))


class Rules:
    """Known sentences by identifier, and rules over identifiers."""

    def __init__(self, rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES):
        self.identifiers: dict[str, int] = {}
        self.slots: list[tuple[re.Pattern, int]] = []
        self.rules: list[tuple[str, tuple[int, ...]]] = []
        for name, sentences in rules:
            keys = [key for s in sentences for part in ([s] if SLOT in s or s.startswith(TAG) else _SENTENCE.split(s)) if (key := " {} ".join(filter(None, map(normal, part.split(SLOT)))))]
            if not keys:
                raise ValueError(f"no words in the rule for {name}")
            self.rules.append((name, tuple(self.identifiers.setdefault(k, len(self.identifiers)) for k in keys)))
        self.rules.sort(key=lambda r: -len(r[1]))
        self.words: dict[str, list[list[str]]] = {}  # the other words of known sentences, by their longest one
        for key in self.identifiers:
            longest, *rest = sorted(set(key.replace("{}", " ").split()), key=lambda w: (-len(w), w))
            self.words.setdefault(longest, []).append(rest)
        gap, tag = r"[\W_]+", normal(TAG)
        for key, number in self.identifiers.items():
            if "{}" in key:
                before, *rest = [gap.join(map(re.escape, part.split())) for part in key.split("{}")]
                # The words end where the sentence goes on; where it begins again, it has not gone on.
                words = rf"{gap}(?:(?!{before}(?![^\W_]))[^\W_]+{_GAP})+?"
                self.slots.append((re.compile(r"(?<![^\W_])" + words.join([before, *rest]) + r"(?![^\W_])", re.I), number))
        #: SPDX lines of one licence, however their spaces are written; numbers of licences by name for expressions; patterns of notices.
        self.lines = [(re.compile(r"(?<![^\W_])" + gap.join(map(re.escape, key.split())) + r"(?=[^\w\n]*(?:\n|\Z))", re.I), number) for key, number in self.identifiers.items() if key.startswith(f"{tag} ")]
        self.tagged = {key.removeprefix(tag).strip(): number for key, number in self.identifiers.items() if key.startswith(f"{tag} ")}
        self.notices = []
        if any(name in {n for n, _ in _NOTICES} and sentences[0].startswith(TAG) for name, sentences in rules):
            for name, words in _NOTICES:
                title = gap.join(map(re.escape, _WORDS.findall(words)))
                verb = rf"(?:licen[sc]ed|distributed|released|published|available|provided|covered){gap}under{gap}(?:the{gap})?(?:terms{gap}of{gap}(?:the{gap})?)?"
                number = self.tagged[normal(name)]
                self.notices.append((re.compile(rf"(?<![^\W_]){verb}{title}(?![^\W_])(?!{_OTHERWISE})(?:{gap}(?:software{gap})?licen[sc]e(?![^\W_])(?!{_OTHERWISE}))?", re.I), number))

    def possible(self, text: str) -> bool:
        """Whether a text holds all words of some known sentence, hence whether it may hold the sentence."""
        low = text.lower()
        if "spdx-license-identifier" in low or (self.notices and "under" in low and any(v in low for v in ("licensed", "licenced", "distributed", "released", "published", "available", "provided", "covered"))):
            return True
        return any(longest in low and any(all(w in low for w in rest) for rest in others) for longest, others in self.words.items())

    def sequence(self, text: str) -> list[tuple[int, int]]:
        """(sentence number, identifier) of the known sentences, in text order."""
        found: dict[tuple[int, int], int] = {}
        starts: list[int] = []
        for cut in (_SENTENCE, _LINE):
            at = 0
            for m in [*cut.finditer(text), None]:
                end = m.start() if m else len(text)
                raw = text[at:end]
                if cut is _LINE and raw.strip():
                    starts.append(at)
                key = normal(raw)
                number = self.identifiers.get(key)
                if number is None:
                    shorter = _BULLET.sub("", raw.lstrip(), count=1)
                    number = self.identifiers.get(normal(shorter)) if shorter != raw else None
                if number is not None:
                    found[end, number] = at
                at = m.end() if m else end
        for pattern, number in [*self.slots, *self.notices, *(self.lines if "spdx" in text.lower() else [])]:
            for m in pattern.finditer(text):
                found[m.end(), number] = m.start()
        for line in _SPDX_LINE.finditer(text):
            for m in _SPDX_TERM.finditer(text, line.start(1), line.end(1)):
                number = self._tagged(m[1], m[2])
                if number is not None:
                    found[m.end() if m[2] else m.end(1), number] = m.start()
        return self._numbered(found, starts)

    def _tagged(self, name: str, exception: str | None) -> int | None:
        """The number of a licence of an SPDX line; an exception that is not known leaves the licence unknown too."""
        later = name.endswith("+")
        names = [name.rstrip("+")] if not later else []
        if re.match(r"(?:A|L)?GPL-[\d.]+\+?$", name, re.I):
            names = [f"{name.rstrip('+')}-{'or-later' if later else 'only'}"]
        return next((self.tagged[key] for n in names if (key := normal(f"{n} WITH {exception}" if exception else n)) in self.tagged), None)

    @staticmethod
    def _numbered(found: dict[tuple[int, int], int], starts: list[int]) -> list[tuple[int, int]]:
        """Sentences are numbered by where they end among all others; the pieces of a wrapped sentence are no others."""
        spans, last = [], -1
        for at, end, number in sorted(((at, end, number) for (end, number), at in found.items()), key=lambda s: (s[0], -s[1])):
            if end > last:
                spans.append((at, end, number))
                last = end
        out, position, k = [], 0, 0
        for at, end, number in spans:
            while k < len(starts) and starts[k] < at:
                position, k = position + 1, k + 1
            out.append((position, number))
            while k < len(starts) and starts[k] < end:
                k += 1
            position += 1
        return out

    def match(self, sequence: list[tuple[int, int]], gap: int) -> list[str]:
        """Names of the rules that match, once per match."""
        used, names = [False] * len(sequence), []
        for name, wanted in self.rules:
            for first in range(len(sequence)):
                taken = self._from(sequence, used, first, wanted, gap)
                if taken:
                    names.append(name)
                    for k in taken:
                        used[k] = True
        return sorted(names)

    @staticmethod
    def _from(sequence: list[tuple[int, int]], used: list[bool], first: int, wanted: tuple[int, ...], gap: int) -> list[int]:
        taken, k = [], first
        for number in wanted:
            while k < len(sequence) and (used[k] or sequence[k][1] != number):
                if not taken:
                    return []
                k += 1
            if k == len(sequence) or (taken and sequence[k][0] - sequence[taken[-1]][0] - 1 > gap):
                return []
            taken.append(k)
            k += 1
        return taken


FIELDS = [("n_known", T.LongType()), ("licenses", T.ArrayType(T.StringType()))]


def scan(docs: DataFrame, text_col: str = "text", rules: tuple = RULES, gap: int = 1) -> DataFrame:
    """``docs`` with n_known (known licence sentences) and licenses (a name per match, sorted); columns of those names are replaced."""

    def make():
        table = Rules(rules)

        def apply(texts: pa.Array) -> list:
            known, names = [], []
            for text in texts.to_pylist():
                sequence = table.sequence(text) if text and table.possible(text) else []
                known.append(len(sequence))
                names.append(table.match(sequence, gap) if sequence else [])
            return [known, names]

        return apply

    return annotate(docs, text_col, FIELDS, make)
