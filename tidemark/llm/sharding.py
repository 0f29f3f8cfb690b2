"""Sharding by longest-processing-time scheduling.

Rows that must stay together form a group (here: equal texts); the groups, largest
first, each go to the shard with the least load so far, taken from a heap.

Groups of one size are interchangeable, so the schedule only has to say how many
groups of each size every shard gets.  The driver runs the heap over the table of
sizes (one row per distinct size: at most sqrt(2 * total bytes) rows), which comes to
it in descending parts of ``part_classes`` rows and leaves it, part by part, as files
in the shared folder; it takes a run of equal groups in strides, with the same outcome
as one group at a time.  Everything else stays distributed.  Groups of a size are
numbered by the SHA-256 of their text: ranges of the hash are counted first, and a place
is found within its range.  Rows of a shard are numbered by the MD5 of their id and the
hash of their text; the ranges of these are cut where the rows are, so that one id on
many rows, or none, fills several ranges.

Law ``bytes``: shard sizes are near equal, unless one group alone is larger.

Defined results: a null text has no bytes and shares the group of the empty text; a
row's size is its bytes plus ``overhead``; repeated rows are one group and have
slots of their own; rows with equal ids are numbered by their text's hash, rows with
a null id first, and rows with both equal in any order; an empty table gives an empty result; columns of ``docs`` other than
the two named are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._shared import publish, shared_folder, split_hot_join, written

PLAN = "group_size long, n long, given array<long>"


def schedule(classes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int]]]:
    """For each (size, count), which come by descending size: how many groups of it each shard gets.

    Greedy: each group goes to the least loaded shard, the lowest number first among
    equals.  While no two loads differ by more than a size, a run of equal groups
    goes round the shards in a fixed order, so whole rounds are taken at once.
    """
    heap = [(0, s) for s in range(shards)]
    for size, count in classes:
        given, left = [0] * shards, count
        while left:
            if size == 0:
                given[heap[0][1]] += left
                break
            rounds = left // shards
            if rounds and max(heap)[0] - heap[0][0] <= size and _in_order(heap, size):
                for at, (load, shard) in enumerate(heap):
                    given[shard] += rounds
                    heap[at] = (load + rounds * size, shard)
                left -= rounds * shards
                continue
            load, shard = heapq.heappop(heap)
            until = min(heap)[0] if heap else load + left * size
            n = min(left, max(1, (until - load) // size))
            given[shard] += n
            left -= n
            heapq.heappush(heap, (load + n * size, shard))
        yield size, given


def _in_order(heap: list[tuple[int, int]], size: int) -> bool:
    """Whether a round of one group each leaves every shard due once: no shard is due twice before another."""
    low, high = min(heap), max(heap)
    return (low[0] + size, low[1]) > high


def _planned(classes: DataFrame, shards: int, part_classes: int) -> DataFrame:
    """The schedule of ``classes`` (a written table of group_size, n) as a table; a part of it is in the driver at a time."""
    spark = classes.sparkSession
    count = classes.count()
    if not count:
        return spark.createDataFrame([], PLAN)
    ordered = classes.repartitionByRange(-(-count // part_classes), F.desc("group_size")).sortWithinPartitions(F.desc("group_size"))
    folder, held, number = shared_folder(spark, "shard-plan"), [], 0

    def save() -> None:
        table = pa.table({"group_size": pa.array([s for s, _ in held], pa.int64()), "n": pa.array([sum(g) for _, g in held], pa.int64()), "given": pa.array([g for _, g in held], pa.list_(pa.int64()))})
        publish(f"{folder}/part-{number:06d}.parquet", lambda out: pq.write_table(table, out))

    for row in schedule(((r["group_size"], r["n"]) for r in ordered.toLocalIterator()), shards):
        held.append(row)
        if len(held) >= part_classes:
            save()
            held, number = [], number + 1
    if held:
        save()
    return spark.read.schema(PLAN).parquet(folder)


def _numbered(rows: DataFrame, within: str, mark: str, out: str, digits: int) -> DataFrame:
    """``rows`` with ``out``: their place, from 0, in the order of ``mark`` (a hexadecimal hash that no two rows share) among the rows of one value of ``within``.

    Places are counted in ranges of the first ``digits`` digits, so a value that all rows share is spread over 16 ** digits tasks.
    """
    ranged = rows.withColumn("_range", F.substring(mark, 1, digits))
    counts = ranged.groupBy(within, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    based = counts.select(within, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(within, "_range").orderBy(mark)
    return ranged.join(based, [within, "_range"]).withColumn(out, F.col("_base") + F.row_number().over(inside) - 1).drop("_range", "_base")


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8, part_classes: int = 100_000) -> DataFrame:
    """id_col, size, text_crc32, law, shard, slot and grown_shard of every row of ``docs``."""
    spark = docs.sparkSession
    digits = next(d for d in range(1, 8) if 16**d >= int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    rows = written(
        docs.select(F.col(f"`{id_col}`").alias("id"), F.sha2(text, 256).alias("text_hash"), (F.length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text).alias("crc")),
        "shard-rows",
    )
    groups = rows.groupBy("text_hash").agg(F.count("*").alias("members"), F.first("size").alias("each"))
    groups = written(groups.select("text_hash", "members", (F.col("members") * F.col("each")).alias("group_size")), "shard-groups")
    plan = _planned(written(groups.groupBy("group_size").agg(F.count("*").alias("n")), "shard-classes", 4), shards, part_classes)
    placed = split_hot_join(_numbered(groups, "group_size", "text_hash", "rank", digits), plan, ["group_size"], "n")
    # The shard is the first whose cumulated share of the class exceeds the group's rank in it.
    ahead = F.aggregate("given", F.struct(F.lit(0).alias("shard"), F.lit(0).cast("long").alias("sum")), lambda a, g: F.struct((a["shard"] + (a["sum"] + g <= F.col("rank")).cast("int")).alias("shard"), (a["sum"] + g).alias("sum")))
    shard_of = written(placed.select("text_hash", "members", ahead["shard"].alias("shard")), "shard-groups-placed")

    assigned = split_hot_join(rows, shard_of, ["text_hash"], "members").withColumn("mark", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")))
    # The row number tells rows apart that agree in all else; it is written with them, and so are the ranges.
    assigned = written(assigned.select("id", "size", "crc", "shard", "mark", "text_hash", F.monotonically_increasing_id().alias("row")), "shard-assigned")
    order = [F.col("mark"), F.asc_nulls_first("id"), F.col("text_hash"), F.col("row")]
    ranged = assigned.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("shard"), *order)
    ranged = written(ranged.withColumn("range", F.spark_partition_id()), "shard-ranges")
    counts = ranged.groupBy("shard", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    based = counts.select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "range").orderBy(*order)
    # Ranges follow each other, so there is one row per range, and one more per shard that begins within a range.
    slotted = ranged.join(F.broadcast(based), ["shard", "range"]).withColumn("slot", F.col("base") + F.row_number().over(inside) - 1)
    return slotted.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
