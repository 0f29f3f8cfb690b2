import random
import re

import pytest

from tidemark.llm import licenses as op
from tidemark.llm.queries import op7_licenses

MIT, BSD = op._MIT[:3], [x.replace(op.SLOT, "the copyright holder") for x in op._BSD]
HOLDERS = ("the copyright holder", "Foo, Inc.", "the University of California, Berkeley", "THE AUTHORS OR COPYRIGHT HOLDERS", "the <organization>")


def filled(sentences, holder="the copyright holder"):
    return [x.replace(op.SLOT, holder) for x in sentences]


def wrap(text, width=60):
    out, line = [], ""
    for word in text.split():
        if len(line) + len(word) > width:
            out.append(line)
            line = ""
        line = f"{line} {word}".strip()
    return "\n".join([*out, line])


@pytest.mark.parametrize(
    ("text", "names"),
    [
        (None, []), ("", []), ("no law here", []), ("Intro text.\nReleased under the MIT License.\nMore.", ["MIT"]), ("junk without an end\nreleased UNDER the  mit license\nmore", ["MIT"]),
        ("\n\n".join(wrap(s) for s in MIT), ["MIT"]), (wrap(" ".join(MIT)), ["MIT"]), (MIT[0] + "\nUnknown one. " + MIT[1] + " " + MIT[2], ["MIT"]),
        (MIT[0] + " One. Two. " + MIT[1] + " " + MIT[2], []), (MIT[1] + " " + MIT[0] + " " + MIT[2], []), (MIT[0], []),
        (f"{BSD[0]}\n\n1. {wrap(BSD[1])}\n\n2. {wrap(BSD[2])}\n", ["BSD-2-Clause"]), (f"{BSD[0]}\n* {BSD[1]}\n* {BSD[2]}\n* {BSD[3]}", ["BSD-3-Clause"]),
        ("Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0.", ["Apache-2.0", "CC-BY-NC-4.0", "CC-BY-NC-4.0"]),
        ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not\nuse this file except in compliance with the License. You may obtain a copy of the License at\n", ["Apache-2.0"]),
        ("# SPDX-License-Identifier: MIT\nx", ["MIT"]),
        *((f"{BSD[0]}\n1. {BSD[1]}\n2. {BSD[2]}\n3. {wrap(filled(op._BSD, h)[3])}\n", ["BSD-3-Clause"]) for h in HOLDERS),
        *((f"{BSD[0]}\n1. {BSD[1]}\n2. {BSD[2]}\n3. {wrap(filled(op._BSD, h)[4])}\n", ["BSD-3-Clause"]) for h in HOLDERS),
        *((wrap(" ".join(filled(op._MIT, h))) + "\n", ["MIT"]) for h in HOLDERS),
        ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.\n", ["LGPL-2.1-or-later"]),
        (" * This program is free software; you can redistribute it and/or modify it\n * under the terms of the GNU General Public License version 2 as\n * published by the Free Software Foundation.\n", ["GPL-2.0-only"]),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ["GPL-3.0-or-later"]),
        ("\"Secondary License\" means either the GNU General Public License,\nVersion 2.0, or any later versions of that license, including any\nexceptions or additional permissions as identified by the initial\nContributor.\n", ["EPL-2.0"]),
        ("1. Definitions.\n\n\"License\" shall mean the terms and conditions for use, reproduction,\nand distribution as defined by Sections 1 through 9 of this document.\n\n\"Licensor\" shall mean the copyright owner or entity authorized by\nthe copyright owner that is granting the License.\n", ["Apache-2.0"]),
        ("1.1. \"Contributor\"\n    means each individual or legal entity that creates, contributes to\n    the creation of, or owns Covered Software.\n", ["MPL-2.0"]),
        ("Neither the name of a thing nor of another", []), (BSD[3], []),
        (f"{BSD[0]}\n1. {BSD[1]}\n2. {BSD[2]}\n3. {wrap(filled(op._BSD, ' '.join(f'holder{k}' for k in range(60)))[3])}\n", ["BSD-3-Clause"]),
        (f"{BSD[0]}\n1. {BSD[1]}\n2. {BSD[2]}\n3. Neither the name of one.\n\nOther text, nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ["BSD-2-Clause"]),
        ("This software is licensed under the MIT license.", ["MIT"]), ("Distributed under the MIT License.", ["MIT"]), ("It is distributed under the\n# terms of the MIT license, and more.", ["MIT"]), ("Released under the MIT-style license.", []),
        ("Licensed under the MIT-0 license.", []), ("Licensed under BSD 3-Clause Clear License.", []), ("Available under the 3-Clause BSD License", ["BSD-3-Clause"]), ("Provided under the terms of the Apache License 2.0 with modifications", []),
        ("Licensed under the Apache License 2.0, see LICENSE.", ["Apache-2.0"]), ("SPDX-License-Identifier: (MIT OR GPL-2.0+) AND Zlib", ["GPL-2.0-or-later", "MIT", "Zlib"]), ("SPDX-License-Identifier: GPL-2.0", ["GPL-2.0-only"]),
        ("// SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception\n", ["Apache-2.0 WITH LLVM-exception"]), ("SPDX-License-Identifier: GPL-2.0-only WITH Some-new-exception OR MIT", ["MIT"]), ("SPDX-License-Identifier: MIT-0", []), ("SPDX-License-Identifier: LicenseRef-mine", []),
        ("Licensed under CC BY 4.0. Licensed under the MIT License.", ["CC-BY-4.0", "MIT"]), ("in no event shall " * 20_000, []),
    ],
)
def test_rules(text, names):
    rules = op.Rules()
    assert rules.match(rules.sequence(text or ""), 1) == names


def test_whole_table_against_line_search(spark):
    d = "/root/testdata/sf0.01"
    lines = {op.normal(s[0]): name for name, s in op.RULES if len(s) == 1}
    assert not any(op.SLOT in s for name, own in op.RULES if len(own) == 1 for s in own)
    rows = {r.doc_id: r for r in op7_licenses(spark, d).collect()}
    hits = 0
    for doc, text in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect():
        want = sorted(n for line in (text or "").split("\n") for own in [op.normal(line)] for key, n in lines.items() if key in own and (re.search(rf"(?:^|[.!?;:] ){re.escape(key)}$", own) or own == key))
        assert rows[doc].licenses == ",".join(want)
        hits += bool(want)
    assert hits > 10


def test_nulls_repeats_and_names(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License.", "own"), (1, "Released under the MIT License.", "own"), (None, None, "own"), (2, "", "x"), (3, "word " * 100_000 + "\nLicensed under CC BY 4.0.", "y")], "doc_id long, text string, LICENSES string")
    assert sorted((r.n_known, r.licenses) for r in op.scan(df).collect()) == [(0, []), (0, []), (1, ["CC-BY-4.0"]), (1, ["MIT"]), (1, ["MIT"])]
    assert op.scan(df.limit(0)).collect() == []


def test_every_rule_is_found_however_its_spaces_are_written(spark):
    gaps = ("\n", "  ", "\u00a0", "\n# ", "\r\n * ")
    rows = [(n, name, gap.join(" ".join(filled(sentences)).split(" "))) for n, (name, sentences) in enumerate(op.RULES) for gap in gaps]
    df = spark.createDataFrame(rows, "rule int, name string, text string")
    assert [(r.name, r.text) for r in op.scan(df).collect() if r.licenses != [r.name]] == []
    rules = op.Rules()
    for name, sentences in op.RULES:
        words = " ".join(filled(sentences)).split(" ")
        for k in range(1, len(words), 1 if len(words) < 120 else 9):
            text = f"{' '.join(words[:k])}\n{' '.join(words[k:])}"
            assert rules.possible(text) and rules.match(rules.sequence(text), 1) == [name]


def test_known_sentences_count_in_any_company(spark):
    texts = ["some words\n// SPDX-License-Identifier: MIT\nmore", "some\nSPDX-License-Identifier: MIT */\nmore SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: MIT OR Apache-2.0", "MIT\nmit ISC", MIT[1]]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")
    assert [(r.n_known, r.licenses) for r in op.scan(df).orderBy("doc_id").collect()] == [(1, ["MIT"]), (2, ["GPL-2.0-only", "MIT"]), (2, ["Apache-2.0", "MIT"]), (0, []), (1, [])]


def brute(lines, rules, gap):
    """Names that the rules give for sentences of which each stands on a line: longer rules first, each from every line on, over lines that no match has used."""
    used, names = set(), []
    for name, wanted in sorted(rules, key=lambda r: -len(r[1])):
        for first in range(len(lines)):
            taken = []
            for sentence in wanted:
                found = next((k for k in range(taken[-1] + 1 if taken else first, len(lines)) if k not in used and lines[k] == sentence), None)
                if found is None or (taken and found - taken[-1] - 1 > gap) or (not taken and found != first):
                    taken = []
                    break
                taken.append(found)
            if taken:
                names.append(name)
                used |= set(taken)
    return sorted(names)


def test_rules_of_several_sentences_against_plain_search(spark):
    rng = random.Random(11)
    known = [f"known sentence {w} here." for w in ("one", "two", "three", "four", "five")]
    rules = tuple((f"L{n}", tuple(rng.choice(known) for _ in range(rng.randrange(1, 5)))) for n in range(9))
    docs = []
    for n in range(400):
        lines = [rng.choice(known) if rng.random() < 0.8 else f"other words {rng.randrange(9)} there." for _ in range(rng.randrange(14))]
        docs.append((n, lines))
    df = spark.createDataFrame([(n, rng.choice(["\n", "\n\n"]).join(lines)) for n, lines in docs], "doc_id int, text string").repartition(3)
    for gap in (0, 1, 3):
        got = {r.doc_id: (r.n_known, r.licenses) for r in op.scan(df, rules=rules, gap=gap).collect()}
        held = {s for _, wanted in rules for s in wanted}
        assert got == {n: (sum(x in held for x in lines), brute(lines, rules, gap)) for n, lines in docs}
    assert sum(len(x) > 1 for _, x in got.values()) > 50
