import hashlib
import random
import re

import pytest

from tidemark.llm import fill_middle as op

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", "char": r"(?s:.)"}


@pytest.mark.parametrize("unit", sorted(UNITS))
def test_index_against_listed_units(unit):
    rng = random.Random(3)
    events = op.automaton(unit, op.Sentinels())
    for _ in range(2000):
        text = "".join(rng.choice("ab\n \té😀<\x0b\x85\x00") for _ in range(rng.randrange(14)))
        listed = re.findall(UNITS[unit], text)
        index = op.UnitIndex(text, unit, events)
        assert index.count == len(listed) and "".join(listed) == text
        assert [index.end_of(k) for k in range(len(listed) + 1)] == [len("".join(listed[:k])) for k in range(len(listed) + 1)]


def brute(text, doc_id, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(UNITS["line"], text)
    h = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_documents_against_plain_python(spark):
    texts = [None, "", "\n", "\n\n", "one", "one\ntwo\n", "a<P", ">\n<", "has <S>\nin\nit", "x<M>", "<<P>>\n", "<", "é\n😀\n\x85", "lines\n" * 300_000, "word " * 400_000]
    texts += ["".join(random.Random(n).choice("ab\n<>PSM ") for _ in range(n)) for n in range(120)]
    rows = [(n, t, n, "own") for n, t in enumerate(texts)] + [(1, "", 0, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N long, form string")
    for rate in (100, 40):
        got = op.restore(op.transform(docs, rate=rate)).collect()
        assert len(got) == len(rows) and all(r.restored == (texts[r.doc_id] or "") for r in got)
        assert all((r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(texts[r.doc_id], r.doc_id, rate=rate) for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"} and set(op.transform(docs).columns) == {"doc_id", "n", "form", "prefix_chars", "middle_chars", "output"}


def test_other_sentinels_null_ids_and_empty_table(spark):
    marks = op.Sentinels("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>")
    docs = spark.createDataFrame([(None, "a\nb\nc\n<P>"), (None, "a\nb\nc\n<P>")], "doc_id long, text string")
    got = op.restore(op.transform(docs, unit="word", sentinels=marks), sentinels=marks).collect()
    assert got[0] == got[1] and got[0].restored == "a\nb\nc\n<P>" and got[0].form != "plain" and got[0].output.count("<|fim_") == 3
    assert op.restore(op.transform(docs.limit(0))).count() == 0
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>"), ("<P>", "x<P>y", "<M>"), ("xy", "yz", "<M>")):
        with pytest.raises(ValueError):
            op.Sentinels(*bad)
    with pytest.raises(ValueError):
        op.transform(docs, unit="verse")
