import io
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from tidemark.llm import sstable as op
from tidemark.llm.queries import op2_token_shards

PATH = public_tokenizers.path("byte_bpe_50k.json")


def model():
    return Tokenizer.from_file(PATH)


def brute(docs):
    t, at, out = model(), 0, []
    for doc, text in sorted(docs, key=lambda r: (r[0] is not None, r[0])):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def pieces(text):
    head, spaced = op.split_pieces(text)
    return [head, *(f" {p}" for p in spaced)]


def test_pieces_keep_pre_tokens():
    rng, pattern = random.Random(1), regex.compile(public_tokenizers.PATTERN)
    alphabet = ["a", "B", " ", " ", "\n", "\t", "é", "7", "'s", "'ll", ".", "$", " ", "　", "\x1c", "一", "\r"]
    for _ in range(30_000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 9)))
        assert pattern.findall(text) == [x for p in pieces(text) for x in pattern.findall(p)]


def test_encoder_gives_the_ids_of_whole_texts():
    rng, whole = random.Random(9), model()
    for small in (10, 10**6):
        encoder = op.TextEncoder(PATH, memo_size=small)
        bits = ["word", "Über", "naïve", "漢字", "ª", "ǅ", "x\u0301", "a1", "it's", "don't.", "end.", "end,", '"(', "...", "_", "a_b", "%%", "'", "ende'.", "Ⅷ", "１２", "🙂", "<|endoftext|>", "a<|endoftext|>", "<|endoftext|>.", "\n", "\u00a0", "a\u200bb"]
        for _ in range(300):
            texts = [" ".join(rng.choice(bits) + rng.choice(["", "", ".", ",", "?!", "\n", "'s", "%%%"]) for _ in range(rng.randrange(30))) for _ in range(5)]
            flat, cuts = encoder.encode(pa.array([*texts, " ", "", "  a", "b  c", "d "]))
            got = [flat[a:b].tolist() for a, b in zip(cuts, cuts[1:])]
            texts += [" ", "", "  a", "b  c", "d "]
            assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("n", [0, 1, 7, 9000])
def test_file_round_trip_and_lookup(tmp_path, n):
    path = tmp_path / "x.sst"
    rows = [(None, b"\x02" + np.array([5], "<u2").tobytes())] * min(n, 1) + [(i, b"\x02" + np.arange(i % 50, dtype="<u2").tobytes()) for i in range(-n // 2, n // 2) for _ in range(1 + (i % 1000 == 0))]
    out = io.BytesIO()
    w = op.Writer(out)
    for doc, value in rows:
        w.add(op.key_of(doc), value, (len(value) - 1) // 2)
    w.close()
    path.write_bytes(out.getvalue())
    r = op.Reader(str(path))
    assert r.docs == len(rows) and [(d, t.tolist()) for d, t in r.scan()] == [(d, np.frombuffer(v, "<u2", offset=1).tolist()) for d, v in rows]
    assert r.get(10**12) == []
    if n == 9000:
        assert len(r.blocks) > 5
        for i in (-4500, -1000, 0, 1, 777, 3000, 4499):
            assert [x.tolist() for x in r.get(i)] == [list(range(i % 50))] * (1 + (i % 1000 == 0))
        assert [x.tolist() for x in r.get(None)] == [[5]]


def test_nulls_repeats_and_empty_tables(spark):
    docs = [(3, "a b"), (3, "a b"), (-5, None), (None, "null id"), (9, ""), (10**15, " x\n\n  y  " * 3000), (1, "hello <|endoftext|> there"), (2, "<|endoftext|>")]
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, ids int")
    manifest = op.write_shards(df, PATH, partitions=3)
    got = [(r.doc_id, r.start, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in op.read_shards(manifest).orderBy("start").collect()]
    assert got == brute(docs)
    assert [r.ids for r in op.read_shards(manifest).where("doc_id = 1").collect()] == [[31373, 220, 50256, 612, 0]]
    small = op.write_shards(df, PATH, partitions=2, max_docs=2)
    assert small.count() > 3 and small.agg({"docs": "max"}).head()[0] == 2
    assert [tuple(r) for r in op.digest_shards(small).orderBy("start").collect()] == brute(docs)
    assert op.lookup(small, 3) == op.lookup(manifest, 3) and op.lookup(small, -5) == [[0]]
    assert op.lookup(manifest, 3) == [[*model().encode("a b").ids, 0]] * 2 and op.lookup(manifest, 4) == [] and op.lookup(manifest, 9) == [[0]]
    empty = op.write_shards(df.limit(0), PATH)
    assert empty.count() == 0 and op.read_shards(empty).count() == 0


def test_query_over_whole_table(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert [tuple(r) for r in op2_token_shards(spark, d).orderBy("doc_id").collect()] == brute(docs)
