import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken

from corpus_pipeline import token_ids_stage
from tidemark.llm import bpe as op
from tidemark.llm.queries import op3_bpe

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=op.load_ranks(RANKS), special_tokens={})


def test_same_ids_as_the_library_and_exact_round_trip(spark):
    rng, one = random.Random(3), library()
    bits = ["the", " ", "  ", "\n", "Ünï", "it's", " we'll", "1234", "%%", "漢字", "🙂", "\t", " x", "<|endoftext|>", "　"]
    texts = [None, "", " ", "\n\n a", "a" * 3000, " " * 2000 + "b"] + ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(300)]
    docs = spark.createDataFrame([(i % 250, t, "kept", i) for i, t in enumerate(texts)], "doc_id long, text string, IDS string, n int").repartition(5)
    for options in ({}, {"chunk_bytes": 500}, {"piecewise": False}, {"max_buckets": 2, "memo_words": 3, "chunk_bytes": 900}):
        rows = op.decode_corpus(op.encode_corpus(docs, RANKS, PATTERN, **options), RANKS).collect()
        assert len(rows) == len(texts)
        for r in rows:
            assert r.doc_id == r.n % 250
            assert r.ids == one.encode_ordinary(texts[r.n] or "")
            assert bytes(r.decoded) == (texts[r.n] or "").encode()


def test_empty_table_null_ids_and_unknown_id(spark):
    assert op.encode_corpus(spark.createDataFrame([], "text string, a int"), RANKS, PATTERN).collect() == []
    lists = spark.createDataFrame([(1, [50, 51]), (2, None), (3, [])], "k int, ids array<int>")
    assert [(r.k, r.decoded if r.decoded is None else bytes(r.decoded)) for r in op.decode_corpus(lists, RANKS).orderBy("k").collect()] == [(1, library().decode_bytes([50, 51])), (2, None), (3, b"")]
    with pytest.raises(Exception, match="token table"):
        op.decode_corpus(spark.createDataFrame([([50256],)], "ids array<int>"), RANKS).collect()


def test_a_pattern_that_reaches_over_spaces_is_not_cut_at_them(spark):
    pattern = r"\S+ \S+|\s+|\S+"
    one = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=op.load_ranks(RANKS), special_tokens={})
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(("to be or not", "a b", "the cat sat on the mat  twice"))], "n int, text string")
    assert op.PIECEWISE == PATTERN
    for r in op.encode_corpus(docs, RANKS, pattern).join(docs, "n").collect():
        assert r.ids == one.encode_ordinary(r.text)


def test_a_chunk_has_a_row_per_bucket_or_word_at_most():
    chunk = op._Chunk(__import__("regex").compile(PATTERN))
    chunk.words = {f" w{n}": n for n in range(50)}
    assert chunk.rows(1, 0, 8).num_rows <= 8 and chunk.rows(1, 0, 4096).num_rows <= 51


def test_query_over_whole_table(spark):
    d, one = "/root/testdata/sf0.001", library()
    want = []
    for doc, text in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect():
        ids = one.encode_ordinary(text or "")
        want.append((doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(tuple(r) for r in op3_bpe(spark, d).collect()) == sorted(want)


def test_ids_and_their_bytes_in_one_step(spark):
    texts = [None, "", " a", "x y  z" * 50, "\n\n漢字 🙂 it's"] * 30
    docs = spark.createDataFrame([(i, t, b"old", [1]) for i, t in enumerate(texts)], "doc_id long, text string, Decoded binary, ids array<int>").repartition(4)
    one, both = library(), op.encode_corpus(docs, RANKS, PATTERN, chunk_bytes=700, decoded=True)
    assert both.dtypes == [("doc_id", "bigint"), ("ids", "array<int>"), ("decoded", "binary")]
    rows = both.collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        assert r.ids == one.encode_ordinary(texts[r.doc_id] or "") and bytes(r.decoded) == (texts[r.doc_id] or "").encode()
    other = op.decode_corpus(op.encode_corpus(docs, RANKS, PATTERN), RANKS)
    assert sorted(other.collect()) == sorted(rows)
    assert op.encode_corpus(docs.limit(0), RANKS, PATTERN, decoded=True).collect() == []


@pytest.mark.parametrize("stage", ["op3_bpe", "pipeline"])
def test_ids_are_assembled_and_decoded_in_one_worker(spark, stage):
    sf_dir = "/root/testdata/sf0.001"
    made = op3_bpe(spark, sf_dir) if stage == "op3_bpe" else token_ids_stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    last = plan[: plan.index("RepartitionByExpression")]
    assert last.count("MapInArrow") == 1, plan


def test_a_long_text_is_assembled_in_little_memory(tmp_path):
    text = "".join(f" w{i % 5000}" for i in range(1_000_000))
    chunk, encoder = op._Chunk(regex.compile(PATTERN)), op.WordEncoder(op.load_ranks(RANKS), PATTERN)
    chunk.add(pa.RecordBatch.from_arrays([pa.array([text]), pa.array([7])], names=["text", "n"]), 0, True)
    name = chunk.save(f"file://{tmp_path}")
    words = [encoder.pack(w) for w in chunk.words]
    steps, counts = [min(i, 1) for i in range(len(words))], [len(w) // 2 for w in words]
    codes = op._pack(np.array(steps, "<u4").tobytes(), np.array(counts, "<u4").tobytes(), b"".join(words))
    tracemalloc.start()
    (batch,) = op._reassembled(f"file://{tmp_path}", name, [codes], encoder.kind, ["n", "ids"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    ids = batch.column(1)[0].as_py()
    assert library().decode(ids) == text
    assert peak < 22 * len(ids), peak
