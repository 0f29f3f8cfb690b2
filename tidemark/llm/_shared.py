"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.storage import filesystem, publish, remove_intermediate, shared_folder, written

__all__ = ["annotate", "batches_of", "filesystem", "give_back", "no_collection", "publish", "remove_intermediate", "shared_folder", "split_hot_join", "written"]


def give_back() -> None:
    """Return freed memory of this worker process to the system: the next task may be one of another kind."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


@contextlib.contextmanager
def no_collection():
    """Without Python's cycle collector, which would walk large tables of strings again and again; gives memory back at the end."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()
        give_back()


def batches_of(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 16 << 20, max_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` (text or binary) holds about ``max_bytes``, or one row."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if col.nbytes <= max_bytes and batch.num_rows <= max_rows:
            if batch.num_rows:
                yield batch
            continue
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.binary_length(col), 0).to_pylist()
        start = size = 0
        for i, n in enumerate(sizes):
            if i > start and (size + n > max_bytes or i - start >= max_rows):
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < len(sizes):
            yield batch.slice(start)


def annotate(docs: DataFrame, text_col: str, fields: list[tuple[str, T.DataType]], make: Callable[[], Callable[..., list]], drop: Iterable[str] = (), beside: Iterable[str] = ()) -> DataFrame:
    """``docs`` with columns computed from ``text_col`` a batch at a time, without a shuffle.

    ``make()`` runs once per task and returns the function from the text array to
    one array (or list of values) per field; it also gets the arrays of the columns
    ``beside``, in their order.  A column of ``docs`` that has the name of a field (in
    any case) is replaced by it.
    """
    made, beside = {n.lower() for n, _ in fields}, tuple(beside)
    gone = {*made, *(d.lower() for d in drop)}
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in made or c == text_col or c in beside])
    kept = [c for c in own.columns if c.lower() not in gone]
    schema = T.StructType([own.schema[c] for c in kept] + [T.StructField(n, t) for n, t in fields])
    arrow = [to_arrow_type(t) for _, t in fields]

    def run(batches):
        apply = make()
        for batch in batches_of(batches, text_col, 8 << 20):
            values = apply(*[batch.column(batch.schema.get_field_index(c)) for c in (text_col, *beside)])
            new = [v if isinstance(v, pa.Array) else pa.array(v, type=t) for v, t in zip(values, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept] + new, names=schema.names)
        del apply
        give_back()

    return own.mapInArrow(run, schema)


def split_hot_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total_share: int = 2000, how: str = "inner") -> DataFrame:
    """``left`` join ``right`` on ``keys``, where ``right`` is unique on them and ``weight`` counts their rows in ``left``.

    Keys with more than 1/``total_share`` of all rows number fewer than
    ``total_share``, so that part of ``right`` has a proven bound and is broadcast:
    rows of a hot key stay where they are.  The rest is joined by a shuffle in
    which no key weighs more than that share.  ``right`` is read once to learn the
    weights and again to join: give it as a written table where it is dear to make.
    """
    total, most = right.agg(F.sum(weight), F.max(weight)).head()
    limit = max(1, (total or 0) // total_share)
    if (most or 0) <= limit:
        return left.join(right, keys, how)
    hot = right.where(F.col(weight) > limit)
    in_hot = left.join(F.broadcast(hot), keys, "inner")
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.where(F.col(weight) <= limit), keys, how)
    return in_hot.unionByName(rest)
