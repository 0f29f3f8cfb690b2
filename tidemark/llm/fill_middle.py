"""Fill-in-the-middle transformation of documents.

A text is cut into units (lines, words or code points); two cuts chosen by a hash of
the document's id give a prefix, a middle and a suffix, which are written with
sentinels in prefix-suffix-middle (psm) or suffix-prefix-middle (spm) order, so that a
model learns to fill the middle in.

Units are never listed.  One Aho-Corasick automaton scans a text for *events*: the
ASCII characters at which the kind of character can change (the newline for lines,
white space for words, none for code points) and the sentinels.  Between two events
the number of units follows by arithmetic, so ``UnitIndex`` keeps the events alone and
answers "where does unit k end" from them.  A text that holds a sentinel stays plain:
its parts could not be told apart again.

``transform`` gives form, cut sizes and the output text; ``restore`` rebuilds the text
from output and form alone.

Defined results: a null or empty text has no units, is plain and its output is empty;
a null id is hashed as the empty text; repeated rows get the same result each; a text
of one unit can lie whole in any part; columns of ``docs`` with the name of a result
are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm._shared import annotate

#: Characters that change the kind, by unit.
CHANGES = {"line": "\n", "word": " \t\n\r\x0b\x0c", "char": ""}


@dataclass(frozen=True)
class Sentinels:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        if not all(marks) or len(set(marks)) < 3:
            raise ValueError("sentinels must be three different, non-empty strings")
        # Otherwise one could begin within the text, or within another, and end in the mark itself.
        for a in marks:
            for b in marks:
                if any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))) or (a != b and a in b):
                    raise ValueError(f"sentinels overlap: {a!r} and {b!r}")


def automaton(unit: str, sentinels: Sentinels) -> ahocorasick.Automaton:
    """Finds the events of ``unit``: 0 at a change of kind, 1 at the end of a sentinel."""
    found = ahocorasick.Automaton()
    for c in CHANGES[unit]:
        found.add_word(c, 0)
    for mark in (sentinels.prefix, sentinels.suffix, sentinels.middle):
        found.add_word(mark, 1)
    found.make_automaton()
    return found


class UnitIndex:
    """The units of one text by their sparse events.

    line: up to and with a newline, or what follows the last one; word: white space and
    the word after it, or white space at the end; char: one code point.
    """

    def __init__(self, text: str, unit: str, events: ahocorasick.Automaton):
        self.size, self.unit, self.has_sentinel = len(text), unit, False
        ends = array("q")  # where units end, but for the last if it ends with the text
        last = -1  # the last change before this one
        for at, mark in events.iter(text):
            if mark:
                self.has_sentinel = True
                return
            if unit == "line":
                ends.append(at + 1)
            elif at > last + 1:  # the gap between two white spaces is one word, and ends here
                ends.append(at)
            last = at
        self.ends = ends
        tail = 0 if self.size == (ends[-1] if ends else 0) else 1
        self.count = self.size if unit == "char" else len(ends) + tail

    def end_of(self, k: int) -> int:
        """The position after the first ``k`` units."""
        if k <= 0:
            return 0
        if k >= self.count:
            return self.size
        return k if self.unit == "char" else self.ends[k - 1]


def draws(seed: int, doc_id: object) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers from the hash of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def cut(text: str | None, doc_id: object, unit: str, seed: int, rate: int, spm_rate: int, marks: Sentinels, events: ahocorasick.Automaton) -> tuple:
    """n, form, prefix_chars, middle_chars and output of one document; ``n`` counts the units also of plain texts."""
    text = text or ""
    index = UnitIndex(text, unit, events)
    if index.has_sentinel:
        plain = UnitIndex(text, unit, automaton_of_changes(unit))
        return plain.count, "plain", None, None, text
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or h3 % 100 >= rate:
        return index.count, "plain", None, None, text
    low, high = sorted((h1 % (index.count + 1), h2 % (index.count + 1)))
    a, b = index.end_of(low), index.end_of(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        return index.count, "spm", a, b - a, f"{marks.suffix}{suffix}{marks.prefix}{prefix}{marks.middle}{middle}"
    return index.count, "psm", a, b - a, f"{marks.prefix}{prefix}{marks.suffix}{suffix}{marks.middle}{middle}"


def automaton_of_changes(unit: str) -> ahocorasick.Automaton:
    """Finds the changes of kind only: for the units of a text that holds a sentinel."""
    found = ahocorasick.Automaton()
    for c in CHANGES[unit] or "\x00":
        found.add_word(c, 0)
    found.make_automaton()
    return found


def rebuild(output: str, form: str, marks: Sentinels) -> str:
    """The text from which ``cut`` has made ``output``."""
    if form == "plain":
        return output
    first, second = (marks.prefix, marks.suffix) if form == "psm" else (marks.suffix, marks.prefix)
    at = output.index(second, len(first))
    end = output.index(marks.middle, at + len(second))
    one, two, middle = output[len(first) : at], output[at + len(second) : end], output[end + len(marks.middle) :]
    return one + middle + two if form == "psm" else two + middle + one


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", seed: int = 7, rate: int = 100, spm_rate: int = 50, sentinels: Sentinels | None = None) -> DataFrame:
    """``docs`` without ``text_col``, with n, form, prefix_chars, middle_chars and output.

    ``rate`` per cent of the texts are transformed, ``spm_rate`` per cent of those in
    suffix-prefix-middle order.  No shuffle; whole texts.
    """
    if unit not in CHANGES:
        raise ValueError(f"unit must be one of {sorted(CHANGES)}")
    marks = sentinels or Sentinels()
    fields = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())]

    def make():
        events = automaton(unit, marks)

        def apply(texts: pa.Array, ids: pa.Array) -> list:
            rows = [cut(t, i, unit, seed, rate, spm_rate, marks, events) for t, i in zip(texts.to_pylist(), ids.to_pylist(), strict=True)]
            return [list(c) for c in zip(*rows, strict=True)]

        return apply

    return annotate(docs, text_col, fields, make, drop=[text_col], beside=[id_col])


def restore(transformed: DataFrame, form_col: str = "form", output_col: str = "output", sentinels: Sentinels | None = None) -> DataFrame:
    """``transformed`` with ``restored``, the exact text that each output was made from."""
    marks = sentinels or Sentinels()

    def make():
        def apply(outputs: pa.Array, forms: pa.Array) -> list:
            return [[rebuild(o or "", f, marks) for o, f in zip(outputs.to_pylist(), forms.to_pylist(), strict=True)]]

        return apply

    return annotate(transformed, output_col, [("restored", T.StringType())], make, beside=[form_col])
