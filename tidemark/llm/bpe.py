"""Byte-level BPE encoding and decoding with a global shuffle of distinct words.

Encoding has three steps:

1. A task splits its documents into pre-tokens and numbers the distinct ones of a
   chunk of documents (``chunk_bytes`` of text) in the order they appear.  The
   documents, as sequences of those numbers, go to one file per chunk in the shared
   folder; a number's place in the sequence is the position of the pre-token.  What
   remains to be shuffled is each distinct word once per chunk, so a word that is
   everywhere weighs one entry per chunk; the words of a chunk that hash to the same
   bucket travel as one compressed row.
2. The rows are shuffled by bucket, each bucket to a task of its own.  The task merges
   each distinct word of the corpus once, by rank, and sends its ids back to every
   chunk that has it.  It remembers ``memo_words`` words; a bucket with more of them
   starts again from none, which costs time and changes nothing.
3. The rows are shuffled by chunk, and the documents are reassembled by position.

There are as many buckets as shuffle partitions, but ``max_buckets`` at most, and a
chunk holds ``chunk_bytes`` of text or what a task has: rows grow with the text, not
with its square.

Steps 1 and 2 meet in a written table: a lost executor repeats its own tasks only,
and chunk files that a failed task left are named by no row.

Decoding looks ids up in the table of token bytes, whose size the vocabulary bounds.
``encode_corpus`` does it in step 3 on demand: the ids then do not go through a second
Python worker beside the one that assembles them.

Defined results: null and empty texts have no ids and decode to no bytes; documents
that repeat are encoded row by row; an id outside the table is an error; columns
named as those that are made, ``ids`` or ``decoded``, are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import secrets
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._shared import batches_of, filesystem, give_back, no_collection, publish, shared_folder, written
from tidemark.llm.sstable import gather, split_pieces

WORDS = "chunk long, place int, bucket int, n int, words binary"
CODES = "chunk long, place int, bucket int, n int, codes binary"
#: Fixed value: the byte-level pre-token pattern of which no match reaches over a space that a visible character follows.
PIECEWISE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _pack(*parts: bytes) -> bytes:
    """Byte strings as one, compressed."""
    import zstandard

    return zstandard.compress(np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(parts), 3)


def _unpack(data: bytes, count: int) -> list[bytes]:
    import zstandard

    raw, at, out = zstandard.decompress(data), 4 * count, []
    for n in np.frombuffer(raw, "<u4", count):
        out.append(raw[at : at + n])
        at += int(n)
    return out


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: lines of base64 bytes and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}


class WordEncoder:
    """Ids of single pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.model = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.kind = "<u2" if max(ranks.values(), default=0) < 1 << 16 else "<u4"

    def pack(self, word: str) -> bytes:
        return np.array(self.model.encode_ordinary(word), self.kind).tobytes()


class TokenDecoder:
    """Bytes of lists of ids."""

    def __init__(self, ranks_path: str):
        flat, self.starts, self.sizes = token_table(ranks_path)
        self.flat = np.frombuffer(flat, "u1")

    def decode(self, lists: pa.ListArray) -> pa.Array:
        """Each list's bytes; null lists give null."""
        ids = np.asarray(lists.flatten())
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes) or self.sizes[ids].min() < 0):
            raise ValueError("an id is not in the token table")
        counts = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], "i8")
        ends = np.concatenate([[0], np.cumsum(self.sizes[ids])])[np.concatenate([[0], np.cumsum(counts)])]
        data = _gathered(self.flat, self.starts, self.sizes, ids).tobytes()
        missing = lists.is_null().to_pylist()
        return pa.array([None if m else data[a:b] for m, a, b in zip(missing, ends, ends[1:])], pa.binary())


class _Chunk:
    """Documents of one chunk as sequences of word numbers."""

    def __init__(self, pattern):
        self.split, self.words, self.pieces = pattern.findall, {}, {}
        self.tables: list[pa.RecordBatch] = []
        self.bytes = 0

    def _words(self, text: str) -> bytes:
        words = self.words
        return array("I", [words.setdefault(w, len(words)) for w in self.split(text)]).tobytes()

    def add(self, batch: pa.RecordBatch, text_at: int, piecewise: bool) -> None:
        sequences, known = [], self.pieces
        for text in batch.column(text_at).to_pylist():
            if not text:
                sequences.append(b"")
            elif piecewise:
                head, spaced = split_pieces(text)
                for piece in set(spaced).difference(known):
                    known[piece] = self._words(f" {piece}")
                sequences.append(self._words(head) + b"".join(map(known.__getitem__, spaced)))
            else:
                sequences.append(self._words(text))
        self.bytes += batch.column(text_at).nbytes
        values = np.frombuffer(b"".join(sequences), "<u4")
        ends = np.cumsum([0, *(len(s) // 4 for s in sequences)]).astype("<i4")
        column = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
        rest = [c for i, c in enumerate(batch.columns) if i != text_at]
        names = [n for i, n in enumerate(batch.schema.names) if i != text_at]
        self.tables.append(pa.RecordBatch.from_arrays([*rest, column], names=[*(f"c{i}" for i in range(len(names))), "seq"]))

    def save(self, folder: str) -> int:
        name = secrets.randbits(62)

        def fill(out) -> None:
            with pa.ipc.new_stream(out, self.tables[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                for table in self.tables:
                    stream.write_batch(table)

        publish(f"{folder}/chunk-{name}", fill)
        return name

    def rows(self, name: int, place: int, buckets: int) -> pa.RecordBatch:
        """Its words by bucket: ascending numbers, sizes and bytes.  Bucket 0 always has a row, so that no chunk is without one."""
        numbers: list[list[int]] = [[] for _ in range(buckets)]
        words: list[list[bytes]] = [[] for _ in range(buckets)]
        for word, number in self.words.items():
            data = word.encode()
            bucket = zlib.crc32(data) % buckets
            numbers[bucket].append(number)
            words[bucket].append(data)
        rows = []
        for bucket, (own, data) in enumerate(zip(numbers, words, strict=True)):
            if own or bucket == 0:
                steps, sizes = np.diff(np.array(own, "<u4"), prepend=np.uint32(0)).astype("<u4"), np.array([len(d) for d in data], "<u4")
                rows.append((name, place, bucket, len(own), _pack(steps.tobytes(), sizes.tobytes(), b"".join(data))))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "place", "bucket", "n", "words"])


def encode_corpus(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", chunk_bytes: int = 32 << 20, piecewise: bool | None = None, max_buckets: int = 4096, memo_words: int = 2_000_000, decoded: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (array<int>) in the place of ``text_col``; a column of the name ``ids`` is replaced.

    With ``decoded``, what ``decode_corpus`` makes of the result: the bytes of the ids too.
    ``ranks_path`` must be readable on every executor.  ``piecewise`` splits texts at
    spaces first; it is right only for patterns of which no match reaches over a space
    that a visible character follows, and on where the pattern is known to be one.
    """
    piecewise = pattern == PIECEWISE if piecewise is None else piecewise
    spark = docs.sparkSession
    folder = shared_folder(spark, "bpe-chunks")
    made = {"ids": T.ArrayType(T.IntegerType())} | ({"decoded": T.BinaryType()} if decoded else {})
    kept = [c for c in docs.columns if c.lower() not in (*made, text_col.lower())]
    source = docs.select(F.col(f"`{text_col}`").alias("own text"), *[F.col(f"`{c}`") for c in kept])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(parts, max_buckets)

    def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from pyspark import TaskContext

        compiled, chunk, place = regex.compile(pattern), None, TaskContext.get().partitionId()
        with no_collection():
            for batch in batches_of(batches, "own text", 2 << 20):
                chunk = chunk or _Chunk(compiled)
                chunk.add(batch, 0, piecewise)
                if chunk.bytes >= chunk_bytes:
                    yield chunk.rows(chunk.save(folder), place, buckets)
                    chunk, place = None, (place + 7919) % (1 << 30)
            if chunk:
                yield chunk.rows(chunk.save(folder), place, buckets)
            chunk = batch = None

    words = written(source.mapInArrow(chunks, WORDS), "bpe-words")

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(load_ranks(ranks_path), pattern)
        known: dict[bytes, bytes] = {}
        width = np.dtype(encoder.kind).itemsize
        with no_collection():
            for batch in batches:
                out = []
                for data in batch.column(4).to_pylist():
                    if len(known) > memo_words:
                        known.clear()
                    steps, sizes, blob = _unpack(data, 3)
                    ends = np.cumsum(np.frombuffer(sizes, "<u4")).tolist()
                    found, at = [], 0
                    for end in ends:
                        word = blob[at:end]
                        at = end
                        packed = known.get(word)
                        if packed is None:
                            packed = known[word] = encoder.pack(word.decode())
                        found.append(packed)
                    counts = np.array([len(p) // width for p in found], "<u4")
                    out.append(_pack(steps, counts.tobytes(), b"".join(found)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.binary())], names=["chunk", "place", "bucket", "n", "codes"])
            known.clear()
            encoder = None

    encoded = words.repartitionById(buckets, "bucket").mapInArrow(encode, CODES)
    kind = WordEncoder(load_ranks(ranks_path), pattern).kind
    schema = T.StructType([source.schema[c] for c in kept] + [T.StructField(c, t) for c, t in made.items()])

    def assemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = TokenDecoder(ranks_path) if decoded else None
        chunk, own = None, []
        for batch in batches:
            for name, codes in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if name != chunk:
                    if own:
                        yield from _reassembled(folder, chunk, own, kind, schema.names, decoder)
                    chunk, own = name, []
                own.append(codes)
        if own:
            yield from _reassembled(folder, chunk, own, kind, schema.names, decoder)
        decoder = batch = own = codes = None
        give_back()

    return encoded.repartitionById(parts, "place").sortWithinPartitions("chunk").mapInArrow(assemble, schema)


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, items: np.ndarray) -> np.ndarray:
    """What ``gather`` gives for ``items``, some at a time: it needs 24 bytes for each element."""
    some = [items[at : at + (1 << 16)] for at in range(0, len(items), 1 << 16)]
    return np.concatenate([flat[:0], *(gather(flat, starts[own], sizes[own]) for own in some)])


def _reassembled(folder: str, chunk: int, parts: list[bytes], kind: str, names: list[str], decoder: TokenDecoder | None = None) -> Iterator[pa.RecordBatch]:
    """The documents of a chunk, with ids and on demand their bytes, from the codes of all its buckets."""
    numbers, counts, flat = [], [], []
    for codes in parts:
        steps, sizes, blob = _unpack(codes, 3)
        numbers.append(np.cumsum(np.frombuffer(steps, "<u4"), dtype="i8"))
        counts.append(np.frombuffer(sizes, "<u4").astype("i8"))
        flat.append(blob)
    flat = np.frombuffer(b"".join(flat), kind)
    number, count = np.concatenate(numbers), np.concatenate(counts)
    starts, sizes = np.zeros(len(number), "i8"), np.zeros(len(number), "i8")
    starts[number], sizes[number] = np.cumsum(count) - count, count
    files, path = filesystem(f"{folder}/chunk-{chunk}")
    with files.open_input_stream(path) as stream, pa.ipc.open_stream(stream) as reader:
        for saved in reader:
            for at in range(0, saved.num_rows, 512):
                part = saved.slice(at, 512)
                lists = part.column(part.num_columns - 1)
                sequence = np.asarray(lists.flatten())
                ends = np.asarray(lists.offsets).astype("i8")
                ends -= ends[0]
                ids = _gathered(flat, starts, sizes, sequence).astype("<i4")
                cuts = np.concatenate([[0], np.cumsum(sizes[sequence])])[ends].astype("<i4")
                column = pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids))
                made = [column] if decoder is None else [column, decoder.decode(column)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=names)


def token_table(ranks_path: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Bytes of all tokens, and each id's start and size in them (-1: no such id)."""
    ranks = load_ranks(ranks_path)
    top = max(ranks.values(), default=-1) + 1
    starts, sizes, at, flat = np.zeros(top, "i8"), np.full(top, -1, "i8"), 0, []
    for token, rank in ranks.items():
        starts[rank], sizes[rank] = at, len(token)
        flat.append(token)
        at += len(token)
    return b"".join(flat), starts, sizes


def decode_corpus(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded`` (binary): the bytes of its ids; a column of that name is replaced, null ids give null."""
    own = encoded.select(*[F.col(f"`{c}`") for c in encoded.columns if c.lower() != "decoded"])
    schema = T.StructType([*own.schema.fields, T.StructField("decoded", T.BinaryType())])

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = TokenDecoder(ranks_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                lists = batch.column(batch.schema.get_field_index(ids_col))
                yield pa.RecordBatch.from_arrays([*batch.columns, decoder.decode(lists)], names=schema.names)
        decoder = whole = batch = lists = None
        give_back()

    return own.mapInArrow(decode, schema)


def digests() -> list:
    """n_tokens, ids_sha256 (of the decimal ids joined by a space) and decoded_sha256 of decoded rows, as columns."""
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return [F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")]
