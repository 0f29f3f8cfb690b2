"""Hard negatives by an orthogonal PCA rotation with exact verification.

For each anchor, its positives are the nearest rows of its label; hard negatives are
the nearest rows of other labels whose score lies in a band below that of a positive.
Scores are inner products of vectors quantised to integers, so results are exact.

Search: the second moments of all vectors give an orthogonal rotation under which the
leading components hold most of the length.  Block by block, the partial products of
leading components are accumulated; what the rest can add is bounded by the norms of
the two remainders plus a slack for rounding.  A pair whose bound falls short of what
its anchor still needs is discarded early; survivors of all stages are verified by
integer products.

Work and state:

* Equal vectors of one label are one class of rows.  In any ranking by score and id
  only the ``positives + 1`` smallest ids of a class can matter, so a class keeps
  those and no others, before the shuffle where possible; anchors that are equal are
  searched once.  A vector that a third of all rows share costs no more than another.
* Anchors go in blocks to tasks, each of which reads one share of the rows as a stream
  from the shared folder and holds one block of both.  Shares are a fixed number, so
  candidates grow with the anchors, not with anchors times rows.  No pair is ever a
  row of a table.

Defined results: rows whose id or label is null, whose vector is null, or which have a
null or non-finite component take no part; vectors of different length are compared
over the components that both have; an empty vector scores 0 with all; of the rows
of one id the one with the least (label, vector) takes part; ties go to the smaller
id; an anchor without positives, or a positive without rows in its band, has no row;
a vector longer than 2**27 (quantised) is an error, as its products leave the 64-bit
range; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._shared import filesystem, give_back, split_hot_join, written

ANCHOR_BLOCK, ROW_BLOCK = 1024, 4096
#: Anchors that a hash deals to one block on average, so that few blocks are over ANCHOR_BLOCK.
DEALT = 896
#: The longest quantised vector whose products with others, times a hundred, are exact in 64 bits.
LONGEST = 1 << 27
_NONE, _ALL = np.iinfo("i8").min, np.iinfo("i8").max


def quantised(vector: str, scale: int) -> str:
    """SQL: the components as floor(scale * x), exact integers."""
    return f"transform({vector}, x -> cast(floor({scale}D * cast(x as double)) as bigint))"


def prepare(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int, label: Column | None = None) -> DataFrame:
    """id, label (long) and q (the integers) of the rows that take part, one per id."""
    usable = f"`{id_col}` IS NOT NULL AND `{label_col}` IS NOT NULL AND `{vector_col}` IS NOT NULL AND forall(`{vector_col}`, x -> x IS NOT NULL AND NOT isnan(x) AND abs(cast(x as double)) < double('infinity'))"
    own = rows.where(usable).select(
        F.col(f"`{id_col}`").cast("long").alias("id"), (F.col(f"`{label_col}`") if label is None else label).cast("long").alias("label"), F.expr(quantised(f"`{vector_col}`", scale)).alias("q")
    )
    norm = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    own = own.withColumn("q", F.when(norm <= float(LONGEST) ** 2, F.col("q")).otherwise(F.raise_error(F.lit(f"a quantised vector is longer than {LONGEST}")).cast("array<bigint>")))
    return own.groupBy("id").agg(F.min(F.struct("label", "q")).alias("r")).select("id", "r.label", "r.q")


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` smallest ids of every (label, vector)."""
    place = F.row_number().over(Window.partitionBy("label", "q").orderBy("id"))
    return rows.withColumn("_n", place).where(F.col("_n") <= keep).drop("_n")


def second_moments(rows: DataFrame) -> np.ndarray:
    """The sum of q q' over all rows: one matrix per task, added up by row of the matrix."""

    def run(batches):
        total = np.zeros((0, 0))
        for batch in batches:
            for at in range(0, batch.num_rows, ROW_BLOCK):
                q = _dense(batch.column(0).slice(at, ROW_BLOCK))
                total = _grown(total, q.shape[1])
                total[: q.shape[1], : q.shape[1]] += q.T @ q
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "sums"])

    parts = rows.select("q").mapInArrow(run, "i int, sums array<double>").select("i", F.posexplode("sums").alias("j", "s"))
    cells = parts.groupBy("i", "j").agg(F.sum("s").alias("s")).collect()  # as many as the square of the components, however many rows there are
    total = np.zeros((0, 0))
    if cells:
        total = _grown(total, 1 + max(c["j"] for c in cells))
        for c in cells:
            total[c["i"], c["j"]] = c["s"]
    return total


def _grown(matrix: np.ndarray, width: int) -> np.ndarray:
    if width <= len(matrix):
        return matrix
    return np.pad(matrix, ((0, width - len(matrix)),) * 2)


def _dense(column: pa.Array, width: int = 0) -> np.ndarray:
    """Lists of integers as rows of doubles, short ones filled with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    width = max(width, int(lengths.max()) if len(lengths) else 0)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


class Rotation:
    """An orthogonal rotation, leading components first, and the stages in which they are added up."""

    def __init__(self, moments: np.ndarray):
        d = len(moments)
        values, vectors = np.linalg.eigh((moments + moments.T) / 2) if d else (np.zeros(0), np.zeros((0, 0)))
        self.matrix = np.ascontiguousarray(vectors[:, np.argsort(-values)])
        # Products under the rotation differ from those without by this share of the two norms at most:
        # how far it is from orthogonal, and the rounding of sums of d terms.
        skew = float(np.abs(self.matrix.T @ self.matrix - np.eye(d)).sum(axis=1).max()) if d else 0.0
        self.slack = 2 * skew + 16 * (d + 4) * np.finfo(float).eps
        held = np.cumsum(np.maximum(values[np.argsort(-values)], 0))
        share = held / held[-1] if d and held[-1] > 0 else np.ones(d)
        cuts = {int(np.searchsorted(share, s) + 1) for s in (0.5, 0.75, 0.9)} | {d}
        self.stages = sorted(min(c, d) for c in cuts if c)

    def turn(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rotated rows, and for each stage the norm of what it leaves (the whole norm first)."""
        turned = q @ self.matrix
        tail = np.cumsum((turned**2)[:, ::-1], axis=1)[:, ::-1] if turned.shape[1] else turned
        rest = [np.sqrt(tail[:, s]) if s < turned.shape[1] else np.zeros(len(q)) for s in (0, *self.stages)]
        return turned, np.array(rest)


def survivors(rotation: Rotation, a: tuple, b: tuple, allowed: np.ndarray, need: np.ndarray, most: np.ndarray, at_least: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (rows of ``a``, rows of ``b``) that can score from ``need`` to ``most`` of their anchor, by growing partial products.

    ``a`` and ``b`` come from ``Rotation.turn``.  Where ``at_least`` is not 0, pairs are
    also discarded that fall below what that many others of the block surely score.
    """
    (x, x_rest), (y, y_rest) = a, b
    alive, rows, cols = allowed, np.arange(len(x)), np.arange(len(y))
    partial = np.zeros(alive.shape)
    start = 0
    for stage, end in enumerate(rotation.stages or [0], 1):
        partial += x[rows, start:end] @ y[cols, start:end].T
        start = end
        spread = np.outer(x_rest[stage][rows], y_rest[stage][cols]) if rotation.stages else np.zeros(alive.shape)
        spread += rotation.slack * np.outer(x_rest[0][rows], y_rest[0][cols]) + 1e-6
        if at_least and alive.shape[1] >= at_least:
            sure = np.where(alive & (partial + spread <= most[rows, None]), partial - spread, -np.inf)
            need = need.copy()
            need[rows] = np.maximum(need[rows], np.partition(sure, -at_least, axis=1)[:, -at_least])
        alive = alive & (partial + spread >= need[rows, None]) & (partial - spread <= most[rows, None])
        keep_rows, keep_cols = alive.any(axis=1), alive.any(axis=0)
        if not keep_rows.any():
            return np.zeros(0, "i8"), np.zeros(0, "i8")
        if keep_rows.mean() * keep_cols.mean() < 0.7:
            alive, partial = alive[np.ix_(keep_rows, keep_cols)], partial[np.ix_(keep_rows, keep_cols)]
            rows, cols = rows[keep_rows], cols[keep_cols]
    i, j = np.nonzero(alive)
    return rows[i], cols[j]


def products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The integer products of the rows a[i] and b[j], a bounded number at a time."""
    out = np.empty(len(i), "i8")
    step = max(1, (1 << 21) // max(1, a.shape[1]))
    for at in range(0, len(i), step):
        out[at : at + step] = np.einsum("ij,ij->i", a[i[at : at + step]], b[j[at : at + step]])
    return out


class Best:
    """For each of some slots the ``k`` rows first by (score descending, id ascending)."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.slot, self.score, self.id = np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "i8")
        self.last = np.full(slots, _NONE)  # the score of a slot's k-th row, once it has one

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        new = score >= self.last[slot]
        slot, score, ids = (np.concatenate([old, x[new]]) for old, x in zip((self.slot, self.score, self.id), (slot, score, ids), strict=True))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.searchsorted(slot, slot)
        keep = np.arange(len(slot)) - first < self.k
        self.slot, self.score, self.id = slot[keep], score[keep], ids[keep]
        full = (np.arange(len(slot)) - first)[keep] == self.k - 1
        self.last[self.slot[full]] = self.score[full]


def _row_blocks(paths: list[str]):
    """The rows of Parquet files of the shared folder, a block at a time: id, label, integers."""
    for path in paths:
        files, name = filesystem(path)
        with files.open_input_file(name) as source:
            for batch in pq.ParquetFile(source).iter_batches(ROW_BLOCK, columns=["id", "label", "q"]):
                if batch.num_rows:
                    yield batch.column("id").to_numpy(), batch.column("label").to_numpy(), batch.column("q")


def _search(anchors: DataFrame, rows: DataFrame, rotation: Rotation, width: int, shares: int, k: int, banded: bool) -> DataFrame:
    """For each anchor (class_id, label, q and, if ``banded``, lows and highs) its first ``k`` rows: slot, id, score.

    Without bands: of the same label.  With bands: of other labels, for each band.
    """
    spark = rows.sparkSession
    files = sorted(rows.inputFiles())
    shares = max(1, min(shares, len(files)))
    dealt = [files[n::shares] for n in range(shares)]
    packed = spark.sparkContext.broadcast((rotation, dealt))
    columns = ["class_id", "label", "q", *(["lows", "highs"] if banded else [])]
    block = F.pmod(F.xxhash64("class_id"), F.lit(max(1, -(-anchors.count() // DEALT))))
    work = anchors.select(*columns, F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), block.alias("block"))
    work = work.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "share", "block")

    def run(batches):
        rotation, dealt = packed.value
        for batch in batches:
            share_of = batch.column(batch.num_columns - 2).to_numpy()
            for share in np.unique(share_of):
                mine = batch.filter(pa.array(share_of == share))
                for at in range(0, mine.num_rows, ANCHOR_BLOCK):
                    yield _block(mine.slice(at, ANCHOR_BLOCK), dealt[share], rotation, width, k, banded)
        give_back()

    return work.mapInArrow(run, "class_id long, slot int, id long, score long")


def _block(anchors: pa.RecordBatch, paths: list[str], rotation: Rotation, width: int, k: int, banded: bool) -> pa.RecordBatch:
    """One block of anchors against one share of the rows."""
    ids, labels = anchors.column(0).to_numpy(), anchors.column(1).to_numpy()
    a = _dense(anchors.column(2), width)
    turned, a_int, n = rotation.turn(a), a.astype("i8"), len(ids)
    if banded:
        lows, highs = _bands(anchors.column(3), _ALL), _bands(anchors.column(4), _NONE)
    else:
        lows, highs = np.full((n, 1), _NONE), np.full((n, 1), _ALL)
    slots = lows.shape[1]
    best = Best(n * slots, k)
    for row_ids, row_labels, column in _row_blocks(paths):
        b = _dense(column, width)
        b_turned, b_int = rotation.turn(b), b.astype("i8")
        same = labels[:, None] == row_labels[None, :]
        need = np.maximum(lows, best.last.reshape(n, slots)).astype(float)
        i, j = survivors(rotation, turned, b_turned, ~same if banded else same, need.min(axis=1), highs.max(axis=1).astype(float), 0 if banded and slots > 1 else k)
        if not len(i):
            continue
        score = products(a_int, b_int, i, j)
        for slot in range(slots):
            fits = (score >= lows[i, slot]) & (score <= highs[i, slot])
            best.add(i[fits] * slots + slot, score[fits], row_ids[j[fits]])
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[best.slot // slots]), pa.array((best.slot % slots).astype("i4")), pa.array(best.id), pa.array(best.score)], names=["class_id", "slot", "id", "score"]
    )


def _bands(column: pa.Array, absent: int) -> np.ndarray:
    """Lists of bounds as a table, with ``absent`` where an anchor has fewer bands than another."""
    lists = column.to_pylist()
    out = np.full((len(lists), max([1, *(len(x) for x in lists)])), absent)
    for n, values in enumerate(lists):
        out[n, : len(values)] = values
    return out


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of what all shares found; a slot has ``k`` rows of each share at most."""
    order = Window.partitionBy("class_id", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchor: str = "id % 50 = 0", label: Column | None = None,
         scale: int = 256, positives: int = 5, negatives: int = 3, low_percent: int = 50, high_percent: int = 95, shares: int = 32) -> DataFrame:
    """anchor_id, positive_id, positive_score, rank, negative_id and negative_score.

    ``anchor``: SQL over id and label that names the anchors; ``label``: the label that
    counts, if not ``label_col`` itself.  Negatives of a positive score from
    ``low_percent`` to ``high_percent`` of its score.
    """
    own = written(prepare(rows, id_col, vector_col, label_col, scale, label), "negatives-rows")
    some = classes(own, max(positives + 1, negatives))
    kept = written(some, "negatives-classes")
    moments = second_moments(kept)
    rotation, width = Rotation(moments), len(moments)

    chosen = own.where(anchor).withColumn("key", F.md5(F.concat_ws(",", F.col("label").cast("string"), F.array_join("q", ",")).cast("binary")))
    anchors = written(chosen.groupBy("key").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"), F.min("label").alias("label"), F.first("q").alias("q")), "negatives-anchors")
    near = written(_merged(_search(anchors, kept, rotation, width, shares, positives + 1, False), positives + 1), "negatives-positives")

    # The band of a negative score would end before it begins.
    bands = near.where("score >= 0").withColumns({"low": F.expr(f"({low_percent} * score + 99) div 100"), "high": F.expr(f"{high_percent} * score div 100")})
    bands = bands.groupBy("class_id").agg(F.sort_array(F.collect_list(F.struct("rank", "low", "high"))).alias("b"))
    banded = anchors.select("class_id", "label", "q").join(bands, "class_id").select("class_id", "label", "q", "b.rank", F.col("b.low").alias("lows"), F.col("b.high").alias("highs"))
    banded = written(banded, "negatives-bands")
    below = _merged(_search(banded, kept, rotation, width, shares, negatives, True), negatives)
    below = below.join(banded.select("class_id", F.col("rank").alias("places")), "class_id").select(
        "class_id", F.element_at("places", F.col("slot") + 1).alias("place"), F.struct("rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).alias("n")
    )
    below = below.groupBy("class_id", "place").agg(F.sort_array(F.collect_list("n")).alias("found"))
    pairs = near.select("class_id", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(below, ["class_id", "place"], "left")
    pairs = pairs.groupBy("class_id").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score", "found"))).alias("pairs"))
    ready = written(anchors.select("key", "copies", "class_id").join(pairs, "class_id").select("key", "copies", "pairs"), "negatives-pairs")

    own_pairs = F.slice(F.filter("pairs", lambda p: p["positive_id"] != F.col("id")), 1, positives)
    full = split_hot_join(chosen.select("id", "key"), ready, ["key"], "copies").select(F.col("id").alias("anchor_id"), F.explode(own_pairs).alias("p"))
    full = full.select("anchor_id", "p.positive_id", "p.positive_score", F.inline("p.found"))
    return full.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
