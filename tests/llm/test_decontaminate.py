import random
import re

from pyspark.sql import functions as F

from tidemark.llm import decontaminate as op
from tidemark.llm.queries import op1_decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, window):
    def words(t):
        return WORD.findall((t or "").translate(FOLD))

    windows = {}
    for item, text in items:
        w = words(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add("null" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (own := windows.get(tuple(w[i : i + k]))) is not None:
                    hit |= set(range(i, i + k))
                    found |= own
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def run(spark, docs, items, window, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = op.find_contamination(d, b, window=window, **options).collect()
    for r in got:
        assert sum(s.end - s.start for s in r.hit_spans) == r.n_hit
    return sorted([(r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in got], key=str)


def test_random_texts_in_one_and_many_blocks(spark):
    rng = random.Random(5)
    vocabulary = ["a", "B", "cc", "Ünï", "7", "d-d", "É"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", ".", "\n"]) for _ in range(n))
    items = [(i, text(rng.randrange(0, 12))) for i in range(20)] + [(3, "zz yy xx"), (None, "null item words here"), (99, None)]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(40)] + [(7, "zz, yy; XX!"), (None, "Null item WORDS here"), (41, None), (42, ""), (42, ""), (43, "zz yy xx " * 4000)]
    for window in (1, 2, 3, 5, 10):
        want = brute(docs, items, window)
        assert run(spark, docs, items, window) == want
    assert run(spark, docs, items, 4, max_block_windows=6) == brute(docs, items, 4)


def test_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "some words", 5, "x")], "doc_id long, text string, N_words int, extra string")
    none = spark.createDataFrame([], "item_id long, text string")
    row = op.find_contamination(docs, none).head()
    assert (row.n_words, row.n_hit, row.extra) == (2, 0, "x")
    assert op.decontaminate(docs, none).collect() == docs.collect()
    assert op.find_contamination(docs.limit(0), none).count() == 0


def test_query_over_whole_table(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    got = op1_decontaminate(spark, d).select("doc_id", "n_words", "n_hit", F.col("n_items")).collect()
    want = [(a, b, c, len(x)) for a, b, c, x in brute(docs, items, 10)]
    assert sorted([tuple(r) for r in got], key=str) == want and any(r[2] for r in got)


def test_one_block_is_live_at_a_time_and_its_tables_are_bounded(spark, monkeypatch):
    import sys
    import tracemalloc

    from pyspark import SparkContext

    live, most, made = set(), [], SparkContext.broadcast

    def broadcast(self, value):
        out = made(self, value)
        live.add(out)
        most.append(len(live))
        gone = out.destroy
        out.destroy = lambda *a: (live.discard(out), gone(*a))
        return out

    monkeypatch.setattr(SparkContext, "broadcast", broadcast)
    items = [(i, f"alpha{i} beta{i} gamma{i} delta{i}") for i in range(9)]
    docs = [(i, f"x {t} y") for i, t in items] + [(20, "none of it")]
    got = run(spark, docs, items, 3, max_block_windows=5)
    assert got == brute(docs, items, 3) and len(most) == 5 and max(most) <= 2  # the next block is made after the last is gone
    assert len(live) == 1

    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(20_000)}" for _ in range(200_000)).encode()
    tracemalloc.start()
    windows = op.Windows([("a", text[: len(text) // 2]), ("b", text[len(text) // 2 :])], 10)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    table = windows.tables[0]
    flat = sum(sys.getsizeof(x) for x in (table.shift, table.buckets, table.starts, table.prefixes))
    assert flat < 45 * 200_000 and held < 60 * 200_000


def test_windows_that_many_items_hold(spark):
    items = [(i, "one two three four five" if i % 2 else f"one two three n{i} five") for i in range(300)]
    docs = [(1, "zero one two three four five six"), (2, "one two three n8 five"), (3, "one two three four"), (4, "two three four")]
    for window in (3, 4, 5):
        assert run(spark, docs, items, window) == brute(docs, items, window)
