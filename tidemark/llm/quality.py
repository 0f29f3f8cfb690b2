"""Quality rules with cross-document line frequency.

Two verdicts decide whether a document is kept.

* Base rules, from its own text: too few words, or too many words inside repeated
  three-word windows.
* Line frequency: lines are normalised (A-Z lower-cased, digits to 0, white space to
  single spaces) and hashed; for each host, the distinct documents that hold a line
  are counted; lines in more than ``line_limit`` of them are removed; a document that
  keeps less than ``kept_share`` of its words is depleted and rejected.  Copies of a
  text count as one document, so a text is not rejected for being copied;
  ``count_copies`` counts each of them.

A verdict depends on host and text only.  It is made once per pair of them and joined
back to the rows; pairs that many rows share, and lines that many documents share,
are split off and broadcast, under a bound that follows from their share.

``judge`` gives the verdicts and counts the words of lines above the limit;
``filter_quality`` gives the kept rows, their texts without those lines.

Defined results: null and empty texts have no words, fail the base rules and are
rejected; null hosts are one host; repeated rows get the same verdict each; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._shared import annotate, batches_of, give_back, split_hot_join, written

SYMBOLS = b"#*$%&|<>"
_WHITE = b" \t\n\r\x0b\x0c"
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))

MEASURES = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType())]
RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept"]
_LINES = T.ArrayType(T.StructType([T.StructField("line", T.LongType()), T.StructField("words", T.LongType())]))


def repeat_words(words: list, window: int = 3) -> int:
    """Words inside windows of ``window`` words that the text has twice or more."""
    grams = list(zip(*(words[k:] for k in range(window)), strict=False))
    counts = Counter(grams)
    if len(counts) == len(grams):
        return 0
    covered = end = 0
    for at, gram in enumerate(grams):
        if counts[gram] > 1:
            covered += at + window - max(end, at)
            end = at + window
    return covered


def _line(line: bytes) -> tuple[int, int]:
    """The hash of a normalised line, and its words."""
    parts = line.translate(_NORMAL).split()
    return xxhash.xxh64_intdigest(b" ".join(parts)) - (1 << 63), len(parts)


def without_lines(text: str, gone: set[int]) -> str:
    """``text`` without the lines whose hashes are in ``gone``; blank lines stay."""
    return b"\n".join(x for x in text.encode().split(b"\n") if not x.strip() or _line(x)[0] not in gone).decode()


def measure(text: str | None) -> tuple[tuple[int, ...], dict[int, int]]:
    """MEASURES of a text, and the words under each hash of a normalised line."""
    if not text:
        return (0, 0, 0, 0, 0), {}
    data = text.encode()
    words = data.split()
    full = [x for x in data.split(b"\n") if x.strip()]
    lines: dict[int, int] = {}
    for line in full:
        key, n = _line(line)
        lines[key] = lines.get(key, 0) + n
    white = len(data) - len(data.translate(None, _WHITE))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    return (len(words), len(text) - white, symbols, len(full) - len(set(full)), repeat_words(words)), lines


def _make():
    def apply(texts: pa.Array) -> list:
        found = [measure(t) for t in texts.to_pylist()]
        columns = [list(c) for c in zip(*(m for m, _ in found), strict=True)] or [[] for _ in MEASURES]
        return [*columns, [[{"line": k, "words": n} for k, n in lines.items()] for _, lines in found]]

    return apply


def judge(docs: DataFrame, id_cols: list[str] | None = None, text_col: str = "text", host_col: str = "source", line_limit: int = 100, kept_share: float = 0.5, min_words: int = 50, max_repeat_percent: int = 50, count_copies: bool = False) -> DataFrame:
    """``docs`` (or only its ``id_cols``) with RESULTS; columns of those names are replaced.

    ``removed_words`` counts the words of lines above the limit.
    """
    columns = [c for c in id_cols or docs.columns if c.lower() not in RESULTS]
    joined = _judged(docs, columns, text_col, host_col, line_limit, kept_share, min_words, max_repeat_percent, count_copies)
    return joined.select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(columns)], *RESULTS)


def _judged(docs: DataFrame, columns: list[str], text_col: str, host_col: str, line_limit: int, kept_share: float, min_words: int, max_repeat_percent: int, count_copies: bool, gone: bool = False) -> DataFrame:
    """``columns`` of ``docs`` as own_0, own_1, ..., with RESULTS and, on demand, the hashes of the lines above the limit (``gone``)."""
    text, host = F.col(f"`{text_col}`"), F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit(""))
    key = F.concat(F.coalesce(F.md5(text.cast("binary")), F.lit("null")), F.lit("@"), host)
    source = docs.select(host.alias("host"), key.alias("row_key"), text.alias("body"))
    seen = annotate(source, "body", [*MEASURES, ("lines", _LINES)], _make, drop=["body"])
    # One row per text and host: equal keys have equal measures and lines.
    texts = seen.groupBy("row_key").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("host", *(n for n, _ in MEASURES), "lines")])
    texts = written(texts, "quality-texts")

    lines = texts.select("row_key", "host", "copies", F.explode("lines").alias("l")).select("row_key", "host", "copies", "l.line", "l.words")
    often = lines.groupBy("host", "line").agg(F.count("*").alias("n"), F.sum("copies").alias("rows")).where(F.col("rows" if count_copies else "n") > line_limit)
    often = written(often.select("host", "line", "n"), "quality-lines", 4)
    removed = split_hot_join(lines, often, ["host", "line"], "n").groupBy("row_key")
    removed = removed.agg(F.sum("words").alias("removed_words"), *([F.collect_list("line").alias("gone")] if gone else []))

    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    verdict = texts.drop("lines", "host").join(removed, "row_key", "left").withColumns({"base_failed": base, "removed_words": F.coalesce("removed_words", F.lit(0)).cast("long")})
    verdict = verdict.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("removed_words") >= F.lit(kept_share) * F.col("n_words")))
    verdict = written(verdict.select("row_key", "copies", *RESULTS, *(["gone"] if gone else [])), "quality-verdicts", 2)

    own = docs.select(key.alias("row_key"), *[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(columns)])
    return split_hot_join(own, verdict, ["row_key"], "copies")


def filter_quality(docs: DataFrame, text_col: str = "text", host_col: str = "source", line_limit: int = 100, kept_share: float = 0.5, min_words: int = 50, max_repeat_percent: int = 50, count_copies: bool = False) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``; lines above the limit are taken out of their texts."""
    joined = _judged(docs, docs.columns, text_col, host_col, line_limit, kept_share, min_words, max_repeat_percent, count_copies, gone=True).where("kept")
    own = [f"own_{i}" for i in range(len(docs.columns))]
    text = own[[c.lower() for c in docs.columns].index(text_col.lower())]
    joined = joined.select(*own, "gone")
    schema = T.StructType(joined.schema.fields[:-1])

    def run(batches):
        for batch in batches_of(batches, text, 8 << 20):
            at = batch.schema.get_field_index(text)
            values = batch.columns[:-1]
            if batch.column(len(own)).null_count < batch.num_rows:
                rows = zip(batch.column(at).to_pylist(), batch.column(len(own)).to_pylist(), strict=True)
                values[at] = pa.array([without_lines(t, set(hashes)) if hashes else t for t, hashes in rows], values[at].type)
            yield pa.RecordBatch.from_arrays(values, names=own)
        give_back()

    return joined.mapInArrow(run, schema).select(*[F.col(o).alias(c) for o, c in zip(own, docs.columns, strict=True)])
