"""Sessions in pickle files: nested dictionaries of arrays, read without running them.

A pickle is a program; Python's own reader would call whatever it names.  ``structure``
interprets a closed set of its instructions, those that build dictionaries, lists,
texts, numbers and numeric arrays, and calls nothing: a file that names anything else,
or uses another instruction, is an error.  Arrays are found as places in the file, so
reading the structure skips their data, and a task reads only its share of the rows.

``spark.read.format("session_pickle")`` gives a row per sample: file, subject, signal
(the keys on the way to the array, joined by ``/``), channel (of two-dimensional
arrays, else 0), idx and value; NaN is NULL.
"""

from __future__ import annotations

import ast
import pickle
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSelector, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.schema import SAMPLES
from tidemark.storage import filesystem, publish

SCHEMA = "file string, subject string, signal string, channel int, idx long, value double"
_ARROW = pa.schema([("file", pa.string()), ("subject", pa.string()), ("signal", pa.string()), ("channel", pa.int32()), ("idx", pa.int64()), ("value", pa.float64())])

#: The names that a numeric array's pickle holds; each stands for a step of building it, and is never called.
KNOWN = {
    ("numpy.core.multiarray", "_reconstruct"): "array", ("numpy._core.multiarray", "_reconstruct"): "array", ("numpy", "ndarray"): "class", ("numpy", "dtype"): "dtype",
    ("numpy.core.numeric", "_frombuffer"): "buffer", ("numpy._core.numeric", "_frombuffer"): "buffer", ("_codecs", "encode"): "bytes",
    ("__builtin__", "bytes"): "no bytes", ("builtins", "bytes"): "no bytes",
    ("numpy.core.multiarray", "scalar"): "scalar", ("numpy._core.multiarray", "scalar"): "scalar",
}
#: Longer byte strings stay in the file until their rows are read.
KEPT = 1 << 12
#: Rates of the signals of the wearables' recordings (chest and wrist), in samples a second.
RATES = {"signal/chest/ECG": ("ECG", 700), "signal/chest/Resp": ("Resp", 700), "signal/wrist/BVP": ("PPG", 64), "signal/wrist/EDA": ("EDA", 4), "signal/wrist/TEMP": ("Temp", 4)}


class PickleError(ValueError):
    """The file holds what is not understood, or not allowed."""


@dataclass
class Name:
    step: str


@dataclass
class Kind:
    """An array's type of numbers."""

    code: str
    order: str = "="

    def numpy(self) -> np.dtype:
        found = np.dtype(self.code)
        if found.kind not in "biuf":
            raise PickleError(f"arrays of {self.code!r} are not read")
        return found.newbyteorder(self.order) if self.order in "<>" else found


@dataclass
class Blob:
    """Bytes, or their place in the file."""

    size: int
    at: int = -1
    data: bytes = b""


@dataclass
class Array:
    shape: tuple = ()
    kind: Kind | None = None
    columns_first: bool = False
    blob: Blob | None = None

    def checked(self) -> Array:
        n = int(np.prod(self.shape, dtype=object)) if all(isinstance(s, int) and s >= 0 for s in self.shape) else -1
        if self.kind is None or self.blob is None or n < 0 or n * self.kind.numpy().itemsize != self.blob.size:
            raise PickleError("an array's data do not fit its shape")
        return self


_MARK = object()


def structure(stream, size: int) -> object:
    """What a pickle describes, with arrays as places in it."""
    stack: list = []
    memo: dict[int, object] = {}

    def take(n: int) -> bytes:
        data = stream.read(n) if 0 <= n <= size else b""
        if len(data) != n:
            raise PickleError("the file ends early")
        return data

    def number(form: str) -> int:
        return struct.unpack(form, take(struct.calcsize(form)))[0]

    def line() -> bytes:
        out = bytearray()
        while (c := take(1)) != b"\n":
            out += c
            if len(out) > 1 << 16:
                raise PickleError("a line is too long")
        return bytes(out)

    def blob(n: int) -> Blob:
        if n <= KEPT:
            return Blob(n, data=take(n))
        at = stream.tell()
        if not 0 <= n <= size - at:
            raise PickleError("the file ends early")
        stream.seek(at + n)
        return Blob(n, at)

    def pop():
        if not stack or stack[-1] is _MARK:
            raise PickleError("an instruction lacks its operand")
        return stack.pop()

    def to_mark() -> list:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k] is _MARK:
                items = stack[k + 1 :]
                del stack[k:]
                return items
        raise PickleError("an instruction lacks its operands")

    def fill(table, items: list) -> None:
        if not isinstance(table, dict) or len(items) % 2:
            raise PickleError("no dictionary to fill")
        for k, v in zip(items[::2], items[1::2], strict=True):
            key = _text(k) if isinstance(k, Blob) else k
            if not isinstance(key, (str, int, float, bool, type(None))):
                raise PickleError("a key is no text or number")
            table[key] = v

    def remember(n: int) -> None:
        if not stack:
            raise PickleError("nothing to remember")
        memo[n] = stack[-1]

    def recall(n: int) -> None:
        if n not in memo:
            raise PickleError("nothing remembered there")
        stack.append(memo[n])

    def named(module: object, name: object) -> None:
        step = KNOWN.get((module, name))
        if step is None:
            raise PickleError(f"the file names {module}.{name}")
        stack.append(Name(step))

    lengths = {b"T": "<i", b"U": "<B", b"B": "<I", b"C": "<B", b"\x8e": "<Q", b"\x96": "<Q"}  # byte strings
    texts = {b"X": "<I", b"\x8c": "<B", b"\x8d": "<Q"}
    numbers = {b"J": "<i", b"K": "<B", b"M": "<H", b"G": ">d"}
    fixed = {b"N": None, b"\x88": True, b"\x89": False}
    empty = {b"}": dict, b"]": list, b")": tuple}
    while True:
        op = take(1)
        if op == b".":
            return pop()
        if op in lengths:
            stack.append(blob(number(lengths[op])))
        elif op in texts:
            stack.append(take(number(texts[op])).decode("utf-8", "replace"))
        elif op in numbers:
            stack.append(number(numbers[op]))
        elif op in fixed:
            stack.append(fixed[op])
        elif op in empty:
            stack.append(empty[op]())
        elif op == b"\x80":
            take(1)
        elif op == b"\x95":
            take(8)
        elif op == b"(":
            stack.append(_MARK)
        elif op == b"\x8a":
            stack.append(int.from_bytes(take(number("<B")), "little", signed=True))
        elif op in b"IL":
            text = line().rstrip(b"L")
            stack.append(text == b"01" if text in (b"00", b"01") else _number(text, int))
        elif op == b"F":
            stack.append(_number(line(), float))
        elif op == b"S":
            data = ast.literal_eval(line().decode("ascii", "replace"))
            stack.append(Blob(len(data), data=data.encode("latin-1")))
        elif op == b"V":
            stack.append(line().decode("raw-unicode-escape"))
        elif op in (b"p", b"q", b"r", b"\x94"):
            remember(len(memo) if op == b"\x94" else _number(line(), int) if op == b"p" else number("<B" if op == b"q" else "<I"))
        elif op in (b"g", b"h", b"j"):
            recall(_number(line(), int) if op == b"g" else number("<B" if op == b"h" else "<I"))
        elif op == b"s":
            v, k = pop(), pop()
            fill(stack[-1] if stack else None, [k, v])
        elif op == b"u":
            items = to_mark()
            fill(stack[-1] if stack else None, items)
        elif op in b"ae":
            items = [pop()] if op == b"a" else to_mark()
            if not stack or not isinstance(stack[-1], list):
                raise PickleError("no list to extend")
            stack[-1].extend(items)
        elif op == b"d":
            table: dict = {}
            fill(table, to_mark())
            stack.append(table)
        elif op in b"lt":
            items = to_mark()
            stack.append(items if op == b"l" else tuple(items))
        elif op in (b"\x85", b"\x86", b"\x87"):
            items = [pop() for _ in range(op[0] - 0x84)][::-1]
            stack.append(tuple(items))
        elif op == b"0":
            pop()
        elif op == b"2":
            remember(-1)
            recall(-1)
        elif op == b"c":
            named(line().decode("utf-8", "replace"), line().decode("utf-8", "replace"))
        elif op == b"\x93":
            name, module = pop(), pop()
            named(module, name)
        elif op == b"R":
            arguments, name = pop(), pop()
            stack.append(_built(name, arguments))
        elif op == b"b":
            state = pop()
            _completed(stack[-1] if stack else None, state)
        else:
            raise PickleError(f"instruction {op!r} is not read")


def _number(text: bytes, kind):
    try:
        return kind(text)
    except ValueError:
        raise PickleError("a number is malformed") from None


def _text(value: object) -> object:
    return value.data.decode("latin-1") if isinstance(value, Blob) and value.at < 0 else value


def _built(name: object, arguments: object):
    """What a step of building an array stands for."""
    if not isinstance(name, Name) or not isinstance(arguments, tuple):
        raise PickleError("a call of what is no step of an array")
    if name.step == "array":
        return Array()
    if name.step == "dtype" and arguments:
        return Kind(str(_text(arguments[0])))
    if name.step == "bytes" and len(arguments) == 2 and isinstance(arguments[0], str) and _text(arguments[1]) == "latin1":
        data = arguments[0].encode("latin-1")
        return Blob(len(data), data=data)
    if name.step == "no bytes" and arguments == ():
        return Blob(0)
    if name.step == "buffer" and len(arguments) == 4 and isinstance(arguments[0], Blob) and isinstance(arguments[1], Kind) and isinstance(arguments[2], tuple):
        return Array(arguments[2], arguments[1], _text(arguments[3]) == "F", arguments[0]).checked()
    if name.step == "scalar" and len(arguments) == 2 and isinstance(arguments[0], Kind) and isinstance(arguments[1], Blob) and arguments[1].at < 0:
        return np.frombuffer(arguments[1].data, arguments[0].numpy(), 1)[0].item()
    raise PickleError(f"a step {name.step} with other operands than an array's")


def _completed(target: object, state: object) -> None:
    if isinstance(target, Kind) and isinstance(state, tuple) and len(state) > 1 and _text(state[1]) in ("<", ">", "|", "="):
        target.order = _text(state[1])
    elif isinstance(target, Array) and isinstance(state, tuple) and len(state) == 5 and isinstance(state[1], tuple) and isinstance(state[2], Kind) and isinstance(state[4], Blob):
        target.shape, target.kind, target.columns_first, target.blob = state[1], state[2], bool(state[3]), state[4]
        target.checked()
    else:
        raise PickleError("a state of what is no array")


def arrays_of(value: object, path: str = "") -> Iterator[tuple[str, Array]]:
    """The arrays of one or two dimensions in nested dictionaries, by the keys that lead to them."""
    if isinstance(value, dict):
        for key, item in value.items():
            yield from arrays_of(item, f"{path}/{key}" if path else str(key))
    elif isinstance(value, Array) and 1 <= len(value.shape) <= 2:
        yield path, value


def rows_of(stream, array: Array, share: int, shares: int, block: int = 1 << 16) -> Iterator[tuple[int, np.ndarray]]:
    """First row and values (rows by channels) of blocks of a share of an array's rows."""
    n, width = array.shape[0], array.shape[1] if len(array.shape) == 2 else 1
    kind = array.kind.numpy()
    first, last = n * share // shares, n * (share + 1) // shares

    def values(at: int, count: int) -> np.ndarray:
        if array.blob.at < 0:
            return np.frombuffer(array.blob.data, kind, count, at * kind.itemsize)
        stream.seek(array.blob.at + at * kind.itemsize)
        return np.frombuffer(stream.read(count * kind.itemsize), kind, count)

    for at in range(first, last if width else first, max(1, block // max(1, width))):
        m = min(last - at, max(1, block // max(1, width)))
        if array.columns_first:
            yield at, np.stack([values(c * n + at, m) for c in range(width)], axis=1).astype(float)
        else:
            yield at, values(at * width, m * width).reshape(m, width).astype(float)


@dataclass
class Shares(InputPartition):
    """Shares of files: (path, share, shares)."""

    parts: list[tuple[str, int, int]]

    def __init__(self, parts):
        self.parts = parts


class PickleReader(DataSourceReader):
    def __init__(self, path: str, partitions: int, share_bytes: int):
        self.path, self.most, self.share_bytes = path, partitions, share_bytes

    def partitions(self) -> list[Shares]:
        files, name = filesystem(self.path)
        info = files.get_file_info(name)
        if info.type == FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [(self.path, info.size)] if info.type == FileType.File else [
            (f"{self.path.rstrip('/')}/{f.base_name}", f.size) for f in files.get_file_info(FileSelector(name)) if f.type == FileType.File and f.base_name.endswith((".pkl", ".pickle"))
        ]
        parts = [(path, k, n) for path, size in sorted(found) for n in [max(1, -(-size // self.share_bytes))] for k in range(n)]
        few = max(1, min(self.most, len(parts)))
        return [Shares(parts[k::few]) for k in range(few)]

    def read(self, partition: Shares) -> Iterator[pa.RecordBatch]:
        for path, share, shares in partition.parts:
            files, name = filesystem(path)
            with files.open_input_file(name) as stream:
                session = structure(stream, stream.size())
                own = _text(session.get("subject")) if isinstance(session, dict) else None
                subject = str(own) if own is not None else path.rpartition("/")[2].rpartition(".")[0]
                for signal, array in arrays_of(session):
                    for first, values in rows_of(stream, array, share, shares):
                        n, width = values.shape
                        flat = values.ravel()
                        columns = [pa.array([path] * flat.size), pa.array([subject] * flat.size), pa.array([signal] * flat.size), pa.array(np.tile(np.arange(width, dtype="i4"), n)), pa.array(np.repeat(np.arange(first, first + n), width)), pa.array(flat, from_pandas=True)]
                        yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)


class PickleSource(DataSource):
    """Options: path, partitions (64 at most) and shareBytes (files over that are read by several tasks)."""

    @classmethod
    def name(cls) -> str:
        return "session_pickle"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PickleReader:
        if not self.options.get("path"):
            raise ValueError("the session_pickle source needs a path")
        return PickleReader(self.options["path"], int(self.options.get("partitions", 64)), int(self.options.get("sharebytes", self.options.get("shareBytes", 64 << 20))))


def read_pickles(spark: SparkSession, path: str, partitions: int = 64, share_bytes: int = 64 << 20) -> DataFrame:
    """file, subject, signal, channel, idx and value of the sessions at ``path`` (a file, or a folder of .pkl files)."""
    spark.dataSource.register(PickleSource)
    return spark.read.format("session_pickle").option("partitions", partitions).option("shareBytes", share_bytes).load(path)


def read_sessions(spark: SparkSession, path: str, rates: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """samples (subject_id, modality, fs, idx, value) of the signals that ``rates`` names, each with its modality and rate; their first channel."""
    rates = rates or RATES
    known = F.create_map(*[x for s, (m, fs) in rates.items() for x in (F.lit(s), F.struct(F.lit(m).alias("modality"), F.lit(fs).alias("fs")))])
    rows = read_pickles(spark, path).where(F.col("channel") == 0).withColumn("_m", F.try_element_at(known, F.col("signal"))).where("_m IS NOT NULL")
    return rows.select(F.col("subject").alias("subject_id"), "_m.modality", "_m.fs", "idx", "value").select(*[F.col(f.name).cast(f.dataType) for f in SAMPLES])


def write_pickles(samples: DataFrame, folder: str, protocol: int = 2) -> DataFrame:
    """A pickle per subject from subject_id, signal (keys joined by ``/``), channel, idx (from 0) and value; subject_id and path.

    A session is one task's.  A missing value is NaN.
    """

    def run(table: pa.Table) -> pa.Table:
        subject = table.column("subject_id")[0].as_py()
        session: dict = {"subject": subject}
        for signal in sorted(set(table.column("signal").to_pylist())):
            own = table.filter(pc.equal(table.column("signal"), signal))
            idx, channel = own.column("idx").to_numpy(), own.column("channel").to_numpy()
            values = np.full((int(idx.max()) + 1, int(channel.max()) + 1), np.nan)
            values[idx, channel] = own.column("value").to_pandas()
            *way, last = signal.split("/")
            at = session
            for key in way:
                at = at.setdefault(key, {})
            at[last] = values
        path = f"{folder}/{subject}.pkl"
        publish(path, lambda out: out.write(pickle.dumps(session, protocol)))
        return pa.table({"subject_id": [subject], "path": [path]})

    rows = samples.select(F.col("subject_id").cast("string"), "signal", F.col("channel").cast("int"), F.col("idx").cast("long"), F.col("value").cast("double"))
    return rows.groupBy("subject_id").applyInArrow(run, "subject_id string, path string")
