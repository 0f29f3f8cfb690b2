import heapq
import random
import zlib
from collections import Counter, defaultdict

from tidemark.llm import sharding as op
from tidemark.llm.queries import op4_shards


def one_at_a_time(classes, shards):
    heap, loads, out = [(0, s) for s in range(shards)], [0] * shards, []
    for size, count in sorted(classes, reverse=True):
        given = [0] * shards
        for _ in range(count):
            load, s = heapq.heappop(heap)
            given[s] += 1
            loads[s] = load + size
            heapq.heappush(heap, (load + size, s))
        out.append((size, given))
    return out, loads


def test_schedule_is_that_of_one_group_at_a_time():
    rng = random.Random(2)
    for _ in range(500):
        classes = list({rng.randrange(1, 50): rng.choice([1, 2, 5, 40, 300]) for _ in range(rng.randrange(8))}.items())
        shards = rng.choice([1, 2, 3, 7, 24])
        want, loads = one_at_a_time(classes, shards)
        got = list(op.schedule(sorted(classes, reverse=True), shards))
        mine = [sum(size * given[s] for size, given in got) for s in range(shards)]
        assert mine == loads and [(s, sum(g)) for s, g in got] == [(s, sum(g)) for s, g in want]
        assert got == want


def verify(rows, docs, shards):
    """rows: (doc_id, size, crc, law, shard, slot, grown) ; docs: (doc_id, text)."""
    data = [(d, (t or "").encode()) for d, t in docs]
    assert Counter((r[0], r[1], r[2]) for r in rows) == Counter((d, len(b) + 8, zlib.crc32(b)) for d, b in data)
    assert all(r[3] == "bytes" and r[6] is None and 0 <= r[4] < shards for r in rows)
    slots, loads, of = defaultdict(list), [0] * shards, defaultdict(set)
    for r in rows:
        slots[r[4]].append(r[5])
        loads[r[4]] += r[1]
        of[r[1], r[2]].add(r[4])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in of.values())
    groups = Counter()
    for _, b in data:
        groups[b] += len(b) + 8
    assert sorted(loads) == sorted(one_at_a_time(list(Counter(groups.values()).items()), shards)[1])


def test_groups_ties_nulls_and_repeats(spark):
    rng = random.Random(4)
    docs = [(i % 90, rng.choice(["same", "é" * rng.randrange(30), "x" * rng.randrange(9), None, ""])) for i in range(400)] + [(None, "n")] * 3 + [(1, "hot")] * 300
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, size int, shard int")
    first = sorted((tuple(r) for r in op.assign_shards(df, 5).collect()), key=str)
    verify(first, docs, 5)
    for part in (1, 3):  # classes come to the driver a few at a time
        assert sorted((tuple(r) for r in op.assign_shards(df.repartition(7), 5, part_classes=part).collect()), key=str) == first
    assert op.assign_shards(df.limit(0), 5).collect() == []
    long = spark.createDataFrame([(i, "é" * 500_000 if i == 3 else f"t{i}") for i in range(9)], "doc_id long, text string")
    verify([tuple(r) for r in op.assign_shards(long, 3).collect()], [tuple(r) for r in long.collect()], 3)


def test_query_over_whole_table(spark):
    d = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    verify([tuple(r) for r in op4_shards(spark, d).collect()], docs, 24)


def test_many_rows_of_one_id_and_of_none(spark):
    from pyspark.sql import functions as F

    n = 100_000
    docs = spark.range(n).select(F.when(F.col("id") % 4 == 1, 7).when(F.col("id") % 4 == 2, F.col("id")).alias("doc_id"), F.when(F.col("id") % 4 == 3, "one text").otherwise(F.concat(F.lit("text "), F.col("id") % 5000)).alias("text"))
    got = op.assign_shards(docs, 4).toPandas()
    assert len(got) == n and got.doc_id.isna().sum() == n // 2
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
        places = own.sort_values("slot").doc_id.isna().to_numpy()
        assert abs(int((places[1:] != places[:-1]).sum())) <= 2  # rows without an id stand together
