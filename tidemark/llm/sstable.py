"""Token-id output as sorted-string-table shards.

File format (integers little-endian unless said otherwise)::

    block*      zstd( entry* ), entries in ascending key order
      entry     varint shared, varint unshared, varint value bytes, key suffix, value
    index       per block: varint key bytes, last key, varint offset, varint length, varint crc32, varint tokens before
    bloom       u32 hash count, bit array
    footer      u64 index offset, u64 index bytes, u64 bloom offset, u64 bloom bytes, u64 entries, u64 tokens, 8 bytes magic

A key is the document id as 8 big-endian bytes with the sign bit turned, so that
byte order is number order; a null id is the empty key and comes first.  ``shared``
counts the leading bytes that a key has in common with the one before it in its
block.  A value is one width byte (2 or 4) and the token ids at that width.

Shards are made by a range shuffle of the documents on their id: shard k holds
smaller ids than shard k + 1.  A task streams its sorted documents through the
encoder into its shard and publishes the finished file under a name of its own,
so a task that runs again leaves nothing half-written that anyone reads: only the
files named in the committed manifest count.  After ``max_docs`` documents or
``max_bytes`` a task goes on in another shard, so that index and filter, which a
writer and a reader hold whole, are bounded; everything else is streamed.

Defined results: a null or empty text is a document with the end id only; rows
that repeat an id stand next to each other, ordered by their text (also where the
next shard begins between them); the strings of a tokenizer's special tokens in a
text become those tokens, as in the library's own call; an empty table gives no
shards.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm._shared import batches_of, filesystem, no_collection, publish, shared_folder, written

MAGIC = b"TMSST\x00\x00\x01"
FOOTER = struct.Struct("<6Q8s")
BLOCK_BYTES = 64 << 10
BLOOM_BITS, BLOOM_HASHES = 10, 7
MANIFEST = "shard long, path string, bytes long, docs long, tokens long, first_key binary, last_key binary"


def varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _bloom_pair(key: bytes) -> tuple[int, int]:
    return xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1


def _bloom_bits(one: int, two: int, bits: int, hashes: int) -> Iterator[int]:
    return ((one + k * two) % bits for k in range(hashes))


class Writer:
    """Streams entries in ascending key order into one shard."""

    def __init__(self, out):
        self.out, self.at, self.block, self.index, self.keys = out, 0, bytearray(), bytearray(), array("Q")
        self.last, self.tokens, self.before, self.docs = b"", 0, 0, 0
        self.first_key: bytes | None = None
        self.pack = zstandard.ZstdCompressor(level=1).compress

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, key: bytes, value: bytes, tokens: int) -> None:
        if self.first_key is None:
            self.first_key = key
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last = key
        self.tokens += tokens
        self.docs += 1
        self.keys.extend(_bloom_pair(key))
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if not self.block:
            return
        packed = self.pack(bytes(self.block))
        self.index += varint(len(self.last)) + self.last + varint(self.at) + varint(len(packed)) + varint(zlib.crc32(packed)) + varint(self.before)
        self._put(packed)
        self.block.clear()
        self.before = self.tokens

    def close(self) -> None:
        self._flush()
        bits = max(64, self.docs * BLOOM_BITS + 7 & ~7)
        bloom = bytearray(bits // 8)
        for n in range(0, len(self.keys), 2):
            for bit in _bloom_bits(self.keys[n], self.keys[n + 1], bits, BLOOM_HASHES):
                bloom[bit >> 3] |= 1 << (bit & 7)
        bloom_block = struct.pack("<I", BLOOM_HASHES) + bytes(bloom)
        index_at = self.at
        self._put(bytes(self.index))
        bloom_at = self.at
        self._put(bloom_block)
        self._put(FOOTER.pack(index_at, bloom_at - index_at, bloom_at, len(bloom_block), self.docs, self.tokens, MAGIC))


class Reader:
    """One shard: scans in key order, and looks keys up by Bloom filter, index and block."""

    def __init__(self, uri: str):
        files, path = filesystem(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        index_at, index_len, bloom_at, bloom_len, self.docs, self.tokens, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token shard")
        bloom = self.file.read_at(bloom_len, bloom_at)
        self.hashes, self.bloom = struct.unpack("<I", bloom[:4])[0], bloom[4:]
        index, at, self.blocks = self.file.read_at(index_len, index_at), 0, []
        while at < len(index):
            n, at = read_varint(index, at)
            key, at = index[at : at + n], at + n
            fields = []
            for _ in range(4):
                x, at = read_varint(index, at)
                fields.append(x)
            self.blocks.append((key, *fields))

    def close(self) -> None:
        self.file.close()

    def _entries(self, block: tuple) -> Iterator[tuple[bytes, bytes]]:
        _, offset, length, crc, _ = block
        packed = self.file.read_at(length, offset)
        if zlib.crc32(packed) != crc:
            raise ValueError("a block of a token shard is damaged")
        data, at, last = zstandard.decompress(packed), 0, b""
        while at < len(data):
            shared, at = read_varint(data, at)
            unshared, at = read_varint(data, at)
            size, at = read_varint(data, at)
            last = last[:shared] + data[at : at + unshared]
            at += unshared
            yield last, data[at : at + size]
            at += size

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for block in self.blocks:
            for key, value in self._entries(block):
                yield id_of(key), unpack(value)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Token ids of every entry under ``doc_id``: none, one, or as many as the id was repeated."""
        key, bits = key_of(doc_id), len(self.bloom) * 8
        if not all(self.bloom[b >> 3] & 1 << (b & 7) for b in _bloom_bits(*_bloom_pair(key), bits, self.hashes)):
            return []
        found, at = [], bisect_left(self.blocks, key, key=lambda b: b[0])
        while at < len(self.blocks):
            for k, value in self._entries(self.blocks[at]):
                if k == key:
                    found.append(unpack(value))
            if self.blocks[at][0] != key:
                break
            at += 1
        return found


def unpack(value: bytes) -> np.ndarray:
    return np.frombuffer(value, "<u2" if value[0] == 2 else "<u4", offset=1).astype("<u4")


#: Marks that form a pre-token of their own after letters (the apostrophe may start a contraction and is left out).
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_chars() -> dict[int, str]:
    """The byte-level alphabet: visible Latin-1 characters stand for themselves, the other bytes for 256, 257, ..."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(256 + n) for n, b in enumerate(hidden)}


BYTE_CHARS = _byte_chars()


class TextEncoder:
    """Ids of whole texts by the tokenizers library, as packed bytes of ``width`` per id.

    Where the tokenizer is byte-level with the usual pre-token pattern and no
    normaliser, a text may be cut before every single space that a visible
    character follows: no pre-token reaches over such a cut.  A text that holds the
    string of an added token is encoded whole.  The pieces recur, so
    a worker process keeps the ids of about ``memo_size`` of them; when there are
    more it starts again from those of the batch at hand.  A piece of letters is one
    pre-token and goes straight to the library's BPE model; punctuation that follows
    the letters is a pre-token of its own.
    """

    def __init__(self, path: str, memo_size: int = 1_200_000, special_as_text: bool = False):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = special_as_text
        self.width = 2 if self.model.get_vocab_size() <= 1 << 16 else 4
        spec = json.loads(self.model.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.piecewise = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", False) and not pre.get("add_prefix_space", True)
        self.added = [t["content"] for t in spec.get("added_tokens") or () if not (special_as_text and t.get("special"))]
        self.spaced: dict[str, bytes] = {}  # by piece without the space it starts with
        self.tails: dict[str, bytes] = {}
        self.memo_size = memo_size

    def _ids(self, texts: list[str]) -> list[bytes]:
        code, out = "H" if self.width == 2 else "I", []
        for at in range(0, len(texts), 1000):
            out += [array(code, e.ids).tobytes() for e in self.model.encode_batch_fast(texts[at : at + 1000], add_special_tokens=False)]
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of pieces that consist of a space and letters."""
        code, merge, table = "H" if self.width == 2 else "I", self.model.model.tokenize, BYTE_CHARS
        return [array(code, [t.id for t in merge(f" {w}".encode().decode("latin-1").translate(table))]).tobytes() for w in words]

    def _learn(self, missing: list[str]) -> None:
        spaced, tails, words, rest, ended = self.spaced, self.tails, set(), [], []
        for piece in missing:
            word = piece.rstrip(PUNCTUATION)
            if not word.isalpha():
                rest.append(piece)
            elif word == piece:
                words.add(word)
            else:
                if word not in spaced:
                    words.add(word)
                ended.append((piece, word, piece[len(word) :]))
        new = list(words)
        spaced.update(zip(new, self._words(new), strict=True))
        spaced.update(zip(rest, self._ids([f" {p}" for p in rest]), strict=True))
        for tail in {t for _, _, t in ended} - tails.keys():
            tails[tail] = self._ids([tail])[0]
        spaced.update((piece, spaced[word] + tails[tail]) for piece, word, tail in ended)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts`` (no nulls), one after the other, and where each text's begin and end."""
        kind = "<u2" if self.width == 2 else "<u4"
        if not self.piecewise:
            whole = self._ids(texts.to_pylist())
            return np.frombuffer(b"".join(whole), kind), np.cumsum([0, *(len(w) // self.width for w in whole)])
        parts = pc.split_pattern(texts, " ")
        offsets = np.asarray(parts.offsets).astype("i8")
        coded = parts.flatten().dictionary_encode()
        offsets -= offsets[0]
        at, pieces = np.asarray(coded.indices).astype("i8"), coded.dictionary.to_pylist()
        firsts = offsets[:-1]
        # A text is cut at its spaces if a visible character follows each; else it is encoded whole, by its pieces' slower way.
        odd = np.array([not p or p[0].isspace() for p in pieces], bool)
        in_run = odd[at]
        in_run[firsts] = False
        whole = np.add.reduceat(in_run, firsts).astype(bool) if len(firsts) else in_run
        for string in self.added:
            whole |= np.asarray(pc.match_substring(texts, string)).astype(bool)
        heads = [pieces[n] for n in at[firsts]]
        if whole.any():
            for n in np.flatnonzero(whole):
                heads[n] = texts[int(n)].as_py()
            at[np.repeat(whole, np.diff(offsets))] = -1
        ids = list(map(self.spaced.get, pieces))
        new = [n for n, x in enumerate(ids) if x is None]
        self._learn([pieces[n] for n in new if not odd[n]])
        for n in new:
            ids[n] = self.spaced.get(pieces[n], b"")  # odd pieces have no use
        ids += self._ids(heads)
        ids.append(b"")
        at[firsts] = len(pieces) + np.arange(len(heads))
        sizes = np.array([len(x) for x in ids], "i8") // self.width
        begins = np.cumsum(sizes) - sizes
        lengths = sizes[at]
        flat = gather(np.frombuffer(b"".join(ids), kind), begins[at], lengths)
        if len(self.spaced) > self.memo_size:
            self.spaced, self.tails = dict(zip(pieces, ids)), {}
            for n in np.flatnonzero(odd):
                self.spaced.pop(pieces[n], None)
        return flat, np.concatenate([[0], np.cumsum(lengths)])[offsets]


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[starts[0] : starts[0] + sizes[0]], then the next, as one array."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


_encoders: dict[str, TextEncoder] = {}


def encoder_for(path: str) -> TextEncoder:
    """The worker process's encoder for a tokenizer file: its memo serves one task after the other."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


_run = re.compile(r" (?:\s|$)")


def split_pieces(text: str) -> tuple[str, list[str]]:
    """The first piece of ``text``, and the others without the space that each starts with.

    A cut stands before every space that a visible character follows; other white
    space stays with what comes before it.  The byte-level pre-tokens of the pieces,
    one after the other, are those of ``text``.
    """
    parts = text.split(" ")
    if not _run.search(text):
        return parts[0], parts[1:]
    pieces: list[list[str]] = [[parts[0]]]
    for part in parts[1:]:
        if part and not part[0].isspace():
            pieces.append([part])
        else:
            pieces[-1].append(part)
    whole = [" ".join(p) for p in pieces]
    return whole[0], whole[1:]


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, partitions: int | None = None, max_docs: int = 1 << 19, max_bytes: int = 1 << 30) -> DataFrame:
    """Write the token ids of all ``docs`` and return the manifest: a row per shard, in key order by ``shard``.

    ``tokenizer_path`` must be readable on every executor.  ``folder`` is a new
    one in the shared folder unless given.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "token-shards")
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("body"))
    dealt = rows.repartitionByRange(partitions, "id", F.xxhash64("body")).sortWithinPartitions("id", F.xxhash64("body"), "body")

    def entries(batches: Iterable[pa.RecordBatch], encoder: TextEncoder) -> Iterator[tuple[bytes, bytes, int]]:
        width = bytes([encoder.width])
        end = np.array([end_id], "<u2" if encoder.width == 2 else "<u4").tobytes()
        for batch in batches_of(batches, "body", 16 << 20, 1 << 14):
            flat, cuts = encoder.encode(batch.column(1))
            for doc, a, b in zip(batch.column(0).to_pylist(), cuts, cuts[1:]):
                yield key_of(doc), width + flat[a:b].tobytes() + end, int(b - a) + 1

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, part = TaskContext.get().partitionId(), 0
        with no_collection():
            stream = entries(batches, encoder_for(tokenizer_path))
            entry = next(stream, None)
            while entry is not None:
                uri = f"{folder}/shard-{task:06d}-{part:04d}-{uuid.uuid4().hex}.sst"
                made: list = []

                def fill(out) -> None:
                    nonlocal entry
                    writer = Writer(out)
                    while entry is not None and writer.docs < max_docs and writer.at < max_bytes:
                        writer.add(*entry)
                        entry = next(stream, None)
                    writer.close()
                    made.append(writer)

                publish(uri, fill)
                w = made[0]
                yield pa.RecordBatch.from_pylist([{"shard": (task << 24) + part, "path": uri, "bytes": w.at, "docs": w.docs, "tokens": w.tokens, "first_key": w.first_key, "last_key": w.last}])
                part += 1

    return written(dealt.mapInArrow(write, MANIFEST), "token-manifest")


def _located(manifest: DataFrame) -> DataFrame:
    """path and base (tokens of all shards before it) of every shard, a task each."""
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.select("path", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("base")).repartition(max(1, manifest.count()))


def _documents(path: str, base: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """Id, start and tokens of every document of a shard."""
    reader = Reader(path)
    for doc, tokens in reader.scan():
        yield doc, base, tokens
        base += len(tokens)
    reader.close()


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (with the end id) of every document, from the files."""

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                rows, size = [], 0
                for found in _documents(row["path"], row["base"]):
                    rows.append(found)
                    size += len(found[2])
                    if size >= 1 << 20:
                        yield _rows(rows)
                        rows, size = [], 0
                if rows:
                    yield _rows(rows)

    return _located(manifest).mapInArrow(read, "doc_id long, start long, ids array<int>")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    ids, starts, values = zip(*rows, strict=True)
    offsets = np.cumsum([0, *(len(v) for v in values)]).astype("<i4")
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values).astype("<i4")))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), lists], names=["doc_id", "start", "ids"])


def digest_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers) of every document, from the files."""

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                documents = _documents(row["path"], row["base"])
                while found := [(doc, start, len(tokens), zlib.crc32(tokens.tobytes())) for doc, start, tokens in islice(documents, 1 << 14)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _located(manifest).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, doc_id: int | None) -> list[list[int]]:
    """Ids under one document id, by the manifest's key ranges and each shard's filter and index."""
    key = key_of(doc_id)
    found = []
    for row in manifest.where((F.col("first_key") <= F.lit(key)) & (F.col("last_key") >= F.lit(key))).orderBy("shard").collect():
        reader = Reader(row.path)
        found += [x.tolist() for x in reader.get(doc_id)]
        reader.close()
    return found
