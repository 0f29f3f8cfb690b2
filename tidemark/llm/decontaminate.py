"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A benchmark item is cut into windows of ``window`` consecutive words; an item of
fewer words, but not none, is one window.  The windows of one length form one
pattern set.  For each set a shift table, indexed by the hash of a block of two
words, says how far the search may jump; buckets by the hash of the last block, with
the hash of the first block as a prefix check, select the windows that may end at a
position, and a direct comparison confirms them.  Blocks that no window holds allow
a jump over nearly a whole window, so a clean text is passed at a fraction of its
words.

The tables are flat arrays: 30 to 45 bytes a window, besides the items' words once.
The items travel to the executors in blocks of ``max_block_windows`` windows, or one
item: about 100 MB in a worker.  A benchmark of more than that takes one pass over
the documents per block; what a pass finds is written, and its block dropped from the
executors, before the next one begins.

Defined results: a null or word-less text has no words and is clean; an item
without words has no windows; rows that repeat an item id are one item; a null
item id is written ``null``; an empty benchmark hits nothing; repeated documents
are judged row by row.
"""

from __future__ import annotations

import uuid
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._shared import annotate, batches_of, no_collection, written

#: Lower-cases A-Z and turns every ASCII byte outside 0-9 a-z into a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
HITS = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("hit_spans", SPANS), ("item_ids", T.ArrayType(T.StringType()))]


def words_of(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 ``text``: runs of digits, letters a-z after folding, and anything beyond ASCII."""
    return text.translate(_FOLD).split() if text else []


class WuManber:
    """Search tables for windows of one length: stretches of ``words`` that begin at ``starts``.

    Hashes are Python's own of the words, so tables serve the process that built them.
    """

    def __init__(self, length: int, words: list[bytes], starts: array):
        self.length, self.block, self.words = length, min(2, length), words
        jump = min(length - self.block + 1, 255)
        bits = max(8, (4 * len(starts)).bit_length())
        self.mask = (1 << bits) - 1
        self.shift = bytearray([jump]) * (1 << bits)
        suffix_bits = max(8, len(starts).bit_length())
        self.suffix_mask = (1 << suffix_bits) - 1
        sizes = array("I", bytes(4 * ((1 << suffix_bits) + 1)))
        shift, mask, block = self.shift, self.mask, self.block
        for start in starts:
            for end in range(max(block, length - jump + 1), length + 1):
                slot = hash(tuple(words[start + end - block : start + end])) & mask
                if shift[slot] > length - end:
                    shift[slot] = length - end
            sizes[(hash(tuple(words[start + length - block : start + length])) & self.suffix_mask) + 1] += 1
        for n in range(1, len(sizes)):
            sizes[n] += sizes[n - 1]
        self.buckets, filled = sizes, array("I", sizes)
        self.starts, self.prefixes = array("I", bytes(4 * len(starts))), array("I", bytes(4 * len(starts)))
        for start in starts:
            slot = hash(tuple(words[start + length - block : start + length])) & self.suffix_mask
            at = filled[slot]
            self.starts[at], self.prefixes[at] = start, hash(tuple(words[start : start + block])) & 0xFFFFFFFF
            filled[slot] = at + 1

    def find(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(start, start of the window) of every occurrence in ``words``."""
        found, at, total, length, shift, mask, own = [], self.length - 1, len(words), self.length, self.shift, self.mask, self.words
        two = self.block == 2
        while at < total:
            mark = hash((words[at - 1], words[at]) if two else (words[at],))
            step = shift[mark & mask]
            if step:
                at += step
                continue
            first, last = self.buckets[mark & self.suffix_mask], self.buckets[(mark & self.suffix_mask) + 1]
            if first < last:
                start = at - length + 1
                prefix = hash(tuple(words[start : start + self.block])) & 0xFFFFFFFF
                for n in range(first, last):
                    if self.prefixes[n] == prefix:
                        window = self.starts[n]
                        if words[start : at + 1] == own[window : window + length]:
                            found.append((start, window))
            at += 1
        return found


class Windows:
    """All windows of some benchmark items, one search table per window length.

    A window that several places hold is one pattern, at the first of them; the items
    of the others are listed by it.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.words: list[bytes] = []
        self.names: list[str] = []
        self.begins, vocabulary = array("I"), {}
        lengths: dict[int, array] = {}
        self.others: dict[int, set[str]] = {}  # by the start of a pattern: further items that hold it
        for item, text in items:
            words = words_of(text)
            size = min(window, len(words))
            if not size:
                continue
            begin = len(self.words)
            self.names.append(item)
            self.begins.append(begin)
            self.words += [vocabulary.setdefault(w, w) for w in words]
            lengths.setdefault(size, array("I")).extend(range(begin, begin + len(words) - size + 1))
        self.tables = [WuManber(size, self.words, self._patterns(size, starts)) for size, starts in sorted(lengths.items())]

    def _patterns(self, size: int, starts: array) -> array:
        """One start per distinct window: those with equal hashes are compared."""
        words, kept = self.words, array("I")
        marks = array("q", (hash(tuple(words[s : s + size])) for s in starts))
        group: list[int] = []
        last = None
        for n in sorted(range(len(starts)), key=marks.__getitem__):
            start = starts[n]
            if marks[n] != last:
                last, group = marks[n], []
            same = next((g for g in group if words[g : g + size] == words[start : start + size]), None)
            if same is None:
                group.append(start)
                kept.append(start)
            elif self._item(start) != self._item(same):
                self.others.setdefault(same, set()).add(self._item(start))
        return kept

    def _item(self, start: int) -> str:
        return self.names[bisect_right(self.begins, start) - 1]

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        spans, items = [], set()
        for table in self.tables:
            for start, window in table.find(words):
                spans.append((start, start + table.length))
                items.add(self._item(window))
                items |= self.others.get(window, set())
        return spans, items


def merged(spans) -> list[tuple[int, int]]:
    """Disjoint ascending spans with the same cover."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


_tables: dict[str, Windows] = {}


def _windows(packed: Broadcast, window: int) -> Windows:
    """Built once per worker process and broadcast block, which carries its own name."""
    name, items = packed.value
    if name not in _tables:
        _tables.clear()
        with no_collection():
            _tables[name] = Windows(items, window)
    return _tables[name]


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, max_windows: int) -> Iterator[list[tuple[str, bytes]]]:
    """Lists of (id, UTF-8 text), each of ``max_windows`` windows or one item; at most as many items come to the driver at a time."""
    items = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("null")).alias("item"), F.col(f"`{text_col}`").cast("binary").alias("text")).where("text is not null and length(text) > 0")
    block, held = [], 0
    for row in items.toLocalIterator():
        text = bytes(row["text"])
        count = len(words_of(text))
        count = max(1, count - window + 1) if count else 0
        if block and held + count > max_windows:
            yield block
            block, held = [], 0
        if count:
            block.append((row["item"], text))
            held += count
    if block:
        yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, max_block_windows: int = 2_000_000) -> DataFrame:
    """``docs`` with n_words, n_hit, hit_spans (word positions, end excluded) and item_ids (sorted as strings).

    Columns of ``docs`` that have these names are replaced.
    """
    sc, packed, first = docs.sparkSession.sparkContext, None, True
    for block in item_blocks(benchmark, item_col, item_text_col, window, max_block_windows):
        if packed:
            docs = written(_pass(docs, text_col, packed, window, first), "contamination")
            packed.destroy()
            first = False
        packed = sc.broadcast((uuid.uuid4().hex, block))
    return _pass(docs, text_col, packed or sc.broadcast(("none", [])), window, first)


def _pass(docs: DataFrame, text_col: str, packed: Broadcast, window: int, first: bool) -> DataFrame:
    if first:

        def make():
            windows = _windows(packed, window)

            def apply(texts: pa.Array) -> list:
                rows = []
                for text in texts.cast(pa.binary()).to_pylist():
                    words = words_of(text)
                    spans, items = windows.search(words)
                    spans = merged(spans) if spans else spans
                    rows.append((len(words), sum(e - s for s, e in spans), [{"start": s, "end": e} for s, e in spans], sorted(items)))
                return [list(x) for x in zip(*rows, strict=True)]

            return apply

        return annotate(docs, text_col, HITS, make)
    schema = docs.schema

    def more(batches):
        windows = _windows(packed, window)
        for batch in batches_of(batches, text_col):
            at = [batch.schema.get_field_index(n) for n in ("n_hit", "hit_spans", "item_ids")]
            hit, held, ids = (batch.column(k).to_pylist() for k in at)
            for n, text in enumerate(batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist()):
                spans, items = windows.search(words_of(text))
                if spans:
                    spans = merged(spans + [(x["start"], x["end"]) for x in held[n]])
                    hit[n], held[n], ids[n] = sum(e - s for s, e in spans), [{"start": s, "end": e} for s, e in spans], sorted(items | set(ids[n]))
            columns = list(batch.columns)
            for k, values in zip(at, (hit, held, ids), strict=True):
                columns[k] = pa.array(values, batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(more, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with the columns of ``docs``."""
    aside = {c: f"{c}__own" for c in docs.columns if c.lower() in {n for n, _ in HITS}}
    found = find_contamination(docs.withColumnsRenamed(aside), benchmark, **options)
    return found.where("n_hit = 0").select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])
