"""How far segments lie apart: time warping, relative density ratio, effect size.

Effect sizes come from per-segment sufficient statistics in plain SQL.  The two
others need the rows of both segments: a task gets two blocks of the segments of one
series and scores their pairs, ``PAIRS_A_TASK`` at most.  A segment is copied once per
block of its series, not once per pair.  Pairs of nearly equal lengths, of whatever
series, are scored together.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.operators.frames import spread
from tidemark.operators.joins import pairs

PAIRS_A_TASK = 2000
#: Pairs and their cells (pairs of rows) that wait to be scored, and cells that are warped, or whose density ratios are fitted, at once.
PAIRS_HELD, CELLS_HELD, WARPED, FITTED = 20_000, 1 << 23, 1 << 17, 1 << 15


def local_costs(x: np.ndarray, y: np.ndarray, metric: str | Callable = "euclidean") -> np.ndarray:
    """Distances between the rows of x and y: euclidean, sqeuclidean, cityblock or a callable on two rows."""
    x, y = (v.reshape(-1, 1) if v.ndim == 1 else v for v in (np.asarray(x, float), np.asarray(y, float)))
    if callable(metric):
        return np.array([[metric(a, b) for b in y] for a in x])
    delta = x[:, None, :] - y[None, :, :]
    if metric == "cityblock":
        return np.abs(delta).sum(axis=2)
    d2 = (delta**2).sum(axis=2)
    if metric == "sqeuclidean":
        return d2
    if metric != "euclidean":
        raise ValueError(f"no metric {metric}")
    return np.sqrt(d2)


def accumulated(costs: np.ndarray, band: int | None = None, slope: float = 1.0) -> np.ndarray:
    """Cheapest cost of a warping path to every cell, by anti-diagonals.

    Steps: diagonal, or along one series at ``slope`` times the predecessor's total.
    ``band`` bounds the distance from the diagonal.
    """
    n, m = costs.shape
    if band is not None and band < abs(n - m):
        raise ValueError("the band must reach over the difference in length")
    total = np.full((n + 1, m + 1), np.inf)
    total[0, 0] = 0.0
    for k in range(n + m - 1):
        i = np.arange(max(0, k - m + 1), min(n, k + 1))
        j = k - i
        if band is not None:
            near = np.abs(i - j) <= band
            i, j = i[near], j[near]
        step = np.minimum(total[i, j], slope * np.minimum(total[i, j + 1], total[i + 1, j]))
        total[i + 1, j + 1] = costs[i, j] + step
    return total[1:, 1:]


def warping_path(total: np.ndarray) -> list[tuple[int, int]]:
    """Cells of the cheapest path; of equal predecessors (to nine places) the diagonal one, then the one above."""
    i, j = total.shape[0] - 1, total.shape[1] - 1
    path = [(i, j)]
    while i or j:
        options = [(a, b) for a, b in ((i - 1, j - 1), (i - 1, j), (i, j - 1)) if a >= 0 and b >= 0]
        i, j = min(options, key=lambda c: round(total[c], 9))
        path.append((i, j))
    return path[::-1]


def dtw_distance(x: np.ndarray, y: np.ndarray, metric: str = "euclidean", band: int | None = None, slope: float = 1.0) -> float:
    if not len(x) or not len(y):
        raise ValueError("warping needs rows in both series")
    return float(accumulated(local_costs(x, y, metric), band, slope)[-1, -1])


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(-1)[..., :, None] + (b**2).sum(-1)[..., None, :] - 2 * a @ np.swapaxes(b, -1, -2), 0)


def relative_divergence(reference: np.ndarray, test: np.ndarray, alpha: float = 0.5, centres: int = 100, ridge: float = 0.1, seed: int = 0) -> float:
    """Relative Pearson divergence of test rows against reference rows, by least squares on Gaussian kernels.

    Kernel centres are the test rows, or ``centres`` of them chosen by ``seed``; the
    width is the median heuristic over both sets.
    """
    both = np.concatenate([test, reference])
    d2 = _cross(both, both)[np.triu_indices(len(both), 1)]
    positive = d2[d2 > 1e-15]
    width = float(np.median(positive)) if len(positive) else 1.0  # 2 sigma^2 with sigma^2 = median / 2
    middle = test if len(test) <= centres else test[np.sort(np.random.default_rng(seed).permutation(len(test))[:centres])]
    on_ref, on_test = np.exp(-_cross(middle, reference) / width), np.exp(-_cross(middle, test) / width)
    h_matrix = (1 - alpha) / len(reference) * on_ref @ on_ref.T + alpha / len(test) * on_test @ on_test.T
    weights = np.linalg.solve(h_matrix + ridge * np.eye(len(middle)), on_test.mean(axis=1))
    ratio_ref, ratio_test = weights @ on_ref, weights @ on_test
    return float(ratio_test.mean() - 0.5 * (alpha * (ratio_test**2).mean() + (1 - alpha) * (ratio_ref**2).mean()) - 0.5)


def segment_divergence(a: np.ndarray, b: np.ndarray) -> float:
    """``relative_divergence`` from a (reference) to b, 0 for under five rows, negative or undefined values."""
    if len(a) < 5 or len(b) < 5:
        return 0.0
    try:
        value = relative_divergence(a, b)
    except np.linalg.LinAlgError:
        return 0.0
    return max(0.0, value) if np.isfinite(value) else 0.0


def _alike(pairs: list[tuple[np.ndarray, np.ndarray]], chosen: list[int], cells: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers of pairs of nearly equal lengths, the stacks of their first and second rows, filled up with zeros, and their lengths."""
    groups: dict[tuple, list[int]] = {}
    for at in chosen:
        a, b = pairs[at]
        groups.setdefault((-(-len(a) // 4) * 4, -(-len(b) // 4) * 4, a.shape[1]), []).append(at)
    for (n, m, width), members in groups.items():
        share = max(1, cells // max(1, n * m))
        for own in (members[k : k + share] for k in range(0, len(members), share)):
            sides = []
            for side, most in ((0, n), (1, m)):
                lengths = np.array([len(pairs[at][side]) for at in own])
                stack = np.zeros((len(own), most, width))
                stack[np.arange(most) < lengths[:, None]] = np.concatenate([pairs[at][side] for at in own])
                sides.append((stack, lengths))
            yield np.array(own), sides[0][0], sides[1][0], sides[0][1], sides[1][1]


def dtw_distances(pairs: list[tuple[np.ndarray, np.ndarray]], metric: str | Callable = "euclidean", band: int | None = None, slope: float = 1.0) -> np.ndarray:
    """``dtw_distance`` of many pairs; ``band`` is widened to a pair's difference in length.

    What a pair is filled up with lies behind its last cell, which no path there passes.
    """
    out = np.zeros(len(pairs))
    if callable(metric):
        for at, (x, y) in enumerate(pairs):
            out[at] = dtw_distance(x, y, metric, None if band is None else max(band, abs(len(x) - len(y))), slope)
        return out
    if metric not in ("euclidean", "sqeuclidean", "cityblock"):
        raise ValueError(f"no metric {metric}")
    if any(not len(x) or not len(y) for x, y in pairs):
        raise ValueError("warping needs rows in both series")
    for own, x, y, n, m in _alike(pairs, list(range(len(pairs))), WARPED):
        rows, columns = x.shape[1], y.shape[1]
        costs = np.zeros((rows, columns, len(own)))
        for a, b in zip(np.moveaxis(x, 2, 0), np.moveaxis(y, 2, 0), strict=True):
            delta = a.T[:, None, :] - b.T[None, :, :]
            costs += np.abs(delta) if metric == "cityblock" else delta * delta
        if metric == "euclidean":
            np.sqrt(costs, out=costs)
        reach = None if band is None else np.maximum(band, np.abs(n - m))
        # Totals of two diagonals before, of the one before, by row and one on; a pair is done on the diagonal of its last cell.
        older, old, last = np.full((rows + 1, len(own)), np.inf), np.full((rows + 1, len(own)), np.inf), n + m - 2
        older[0] = 0.0
        for k in range(int(last.max()) + 1):
            i = np.arange(max(0, k - columns + 1), min(rows, k + 1))
            low, high = int(i[0]), int(i[-1]) + 1
            step = costs[i, k - i] + np.minimum(older[low:high], slope * np.minimum(old[low:high], old[low + 1 : high + 1]))
            if reach is not None:
                step[np.abs(2 * i - k)[:, None] > reach] = np.inf
            new = np.full_like(old, np.inf)
            new[low + 1 : high + 1] = step
            done = np.flatnonzero(last == k)
            out[own[done]] = new[n[done], done]
            older, old = old, new
    return out


def segment_divergences(pairs: list[tuple[np.ndarray, np.ndarray]], alpha: float = 0.5, centres: int = 100, ridge: float = 0.1) -> np.ndarray:
    """``segment_divergence`` of many pairs.

    Kernel values of what a pair is filled up with are set to 0, so that such a centre gets no weight.
    """
    out, together = np.zeros(len(pairs)), []
    for at, (a, b) in enumerate(pairs):
        if len(b) > centres or not (np.isfinite(a).all() and np.isfinite(b).all()):
            out[at] = segment_divergence(a, b)
        elif len(a) >= 5 and len(b) >= 5:
            together.append(at)
    for own, reference, test, n, m in _alike(pairs, together, FITTED):
        on_n, on_m = np.arange(reference.shape[1]) < n[:, None], np.arange(test.shape[1]) < m[:, None]
        d_ref, d_test = _cross(test, reference), _cross(test, test)
        up_ref, up_test = np.triu_indices(reference.shape[1], 1), np.triu_indices(test.shape[1], 1)
        d2 = np.concatenate([d_ref.reshape(len(own), -1), d_test[:, *up_test], _cross(reference, reference)[:, *up_ref]], axis=1)
        real = np.concatenate([(on_m[:, :, None] & on_n[:, None, :]).reshape(len(own), -1), on_m[:, up_test[1]], on_n[:, up_ref[1]]], axis=1) & (d2 > 1e-15)
        d2[~real] = np.inf
        d2.sort(axis=1)
        count, each = real.sum(axis=1), np.arange(len(own))
        width = np.where(count > 0, (d2[each, np.maximum(count - 1, 0) // 2] + d2[each, np.minimum(count // 2, d2.shape[1] - 1)]) / 2, 1.0)[:, None, None]
        on_ref, on_test = np.exp(-d_ref / width) * (on_m[:, :, None] & on_n[:, None, :]), np.exp(-d_test / width) * (on_m[:, :, None] & on_m[:, None, :])
        h_matrix = ((1 - alpha) / n)[:, None, None] * (on_ref @ np.swapaxes(on_ref, 1, 2)) + (alpha / m)[:, None, None] * (on_test @ np.swapaxes(on_test, 1, 2))
        try:
            weights = np.linalg.solve(h_matrix + ridge * np.eye(test.shape[1]), on_test.sum(axis=2, keepdims=True) / m[:, None, None])
        except np.linalg.LinAlgError:
            out[own] = [segment_divergence(*pairs[at]) for at in own]
            continue
        ratio_ref, ratio_test = (weights * on_ref).sum(axis=1), (weights * on_test).sum(axis=1)
        value = ratio_test.sum(axis=1) / m - 0.5 * (alpha * (ratio_test**2).sum(axis=1) / m + (1 - alpha) * (ratio_ref**2).sum(axis=1) / n) - 0.5
        out[own] = np.where(np.isfinite(value), np.maximum(value, 0.0), 0.0)
    return out


def segment_rows(vectors: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, seg and data: the vectors of each segment in order."""
    rows = vectors.join(segments.hint("merge"), keys).where("w >= start AND w < end")
    return rows.groupBy(*keys, "seg").agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "x"))), lambda s: s["x"]).alias("data"))


def _matrices(column: pa.Array) -> list[np.ndarray]:
    """The rows of each segment of a column of arrays of vectors, missing values as NaN."""
    if not len(column):
        return []
    rows = column.flatten()
    widths, lengths = rows.value_lengths().to_numpy(False), column.value_lengths().to_numpy(False)
    if column.null_count or rows.null_count or (len(widths) and widths.min() != widths.max()):
        return [np.array(x, float) for x in column.to_pylist()]
    flat = rows.flatten().to_numpy(False).astype(float).reshape(len(rows), widths[0] if len(widths) else 0)
    return np.split(flat, np.cumsum(lengths)[:-1])


def _by_pairs(data: DataFrame, keys: list[str], fields: list[tuple[str, T.DataType, pa.DataType]], score: Callable[[list[tuple[np.ndarray, np.ndarray]]], list[list[tuple]]], per_task: int, most: int = PAIRS_HELD) -> DataFrame:
    """keys, seg_i < seg_j and ``fields``: the rows that ``score`` gives for each of up to ``most`` pairs of segments of ``data`` (keys, seg, data).

    A series' segments are cut into blocks of so many that two blocks make ``per_task``
    pairs; a task gets two blocks, or one with itself, and so a segment is copied once
    per block.
    """
    size = max(1, math.isqrt(per_task))
    session = Window.partitionBy(*keys)
    blocks = F.ceil(F.count(F.lit(1)).over(session) / size).cast("int")
    own = F.floor((F.row_number().over(session.orderBy("seg")) - 1) / size).cast("int")
    rows = data.select(*keys, "seg", "data", own.alias("_own"), blocks.alias("_blocks")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.select(*keys, "seg", "data", "_own", F.least("_own", "_other").alias("_low"), F.greatest("_own", "_other").alias("_high"))
    schema = T.StructType([*(data.schema[k] for k in keys), T.StructField("seg_i", data.schema["seg"].dataType), T.StructField("seg_j", data.schema["seg"].dataType), *(T.StructField(name, kind) for name, kind, _ in fields)])

    kept = [*keys, "_low", "_high"]

    kinds = [*(to_arrow_type(f.dataType) for f in schema.fields[: len(keys) + 2]), *(kind for _, _, kind in fields)]

    def scored(held: list[tuple]) -> pa.RecordBatch:
        found = [(*names, *row) for (names, _, _), rows in zip(held, score([(x, y) for _, x, y in held]), strict=True) for row in rows]
        return pa.RecordBatch.from_arrays([pa.array([row[c] for row in found], kind) for c, kind in enumerate(kinds)], names=schema.names)

    def of_two(key: tuple, members: list[tuple]) -> Iterator[tuple]:
        *own, low, high = key
        for n, (seg_i, block, x) in enumerate(members):
            if block == low:
                for seg_j, other, y in members[n + 1 :]:
                    if other == high:
                        yield (*own, seg_i, seg_j), x, y

    def found(batches) -> Iterator[tuple]:
        last, members = None, []
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            for key, seg, block, x in zip(zip(*(column(k).to_pylist() for k in kept), strict=True), column("seg").to_pylist(), column("_own").to_pylist(), _matrices(column("data")), strict=True):
                if key != last:
                    if len(members) > 1:
                        yield from of_two(last, members)
                    last, members = key, []
                members.append((seg, block, x))
        if len(members) > 1:
            yield from of_two(last, members)

    def run(batches):
        held, cells = [], 0
        for pair in found(batches):
            held.append(pair)
            cells += len(pair[1]) * len(pair[2])
            if len(held) >= most or cells >= CELLS_HELD:
                yield scored(held)
                held, cells = [], 0
        if held:
            yield scored(held)

    return spread(rows, kept).sortWithinPartitions(*kept, "seg").mapInArrow(run, schema)


def pair_distances(data: DataFrame, keys: list[str], methods: tuple[str, ...] = ("DTW", "RuLSIF"), normalise: bool = True, metric: str | Callable = "euclidean", band: int | None = None, slope: float = 1.0, per_task: int = PAIRS_A_TASK) -> DataFrame:
    """keys, seg_i, seg_j, method, d for every pair of segments of ``data`` (keys, seg, data).

    ``metric``, ``band`` (widened to the difference in length) and ``slope`` shape the
    warping; ``normalise`` divides its distance by the longer length.
    """

    def score(both: list[tuple[np.ndarray, np.ndarray]]) -> list[list[tuple]]:
        out = []
        for method in methods:
            if method == "DTW":
                d = dtw_distances(both, metric, band, slope) / ([max(len(a), len(b)) for a, b in both] if normalise else 1)
            else:
                d = segment_divergences(both)
            out.append([(method, one) for one in d.tolist()])
        return [list(rows) for rows in zip(*out, strict=True)]

    return _by_pairs(data, keys, [("method", T.StringType(), pa.string()), ("d", T.DoubleType(), pa.float64())], score, per_task)


def warping_paths(data: DataFrame, keys: list[str], metric: str = "euclidean", per_task: int = PAIRS_A_TASK) -> DataFrame:
    """keys, seg_i, seg_j, d (not normalised) and path (array of i, j) of the cheapest warping of every pair of segments."""
    cell = T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())]))

    def one(a: np.ndarray, b: np.ndarray) -> list[tuple]:
        total = accumulated(local_costs(a, b, metric))
        return [(float(total[-1, -1]), [{"i": i, "j": j} for i, j in warping_path(total)])]

    def score(both: list[tuple[np.ndarray, np.ndarray]]) -> list[list[tuple]]:
        return [one(a, b) for a, b in both]

    return _by_pairs(data, keys, [("d", T.DoubleType(), pa.float64()), ("path", cell, pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32())])))], score, per_task, PAIRS_A_TASK)


def mean_shifts(stats: DataFrame, keys: list[str]) -> DataFrame:
    """keys, seg_i, seg_j, effect and centroid, from ``segment_stats`` in one pass over the pairs of segments.

    ``effect``: root mean square over features of Cohen's d, where a feature with under
    three valid rows on a side, or without spread, counts as 0; ``centroid``: distance
    between the mean vectors.
    """
    both = pairs(stats, [*keys, "feature"], "seg", ["n", "mean", "var"])
    pooled = F.sqrt(((F.col("n_i") - 1) * F.col("var_i") + (F.col("n_j") - 1) * F.col("var_j")) / (F.col("n_i") + F.col("n_j") - 2))
    rows = both.withColumn("_p", F.when((F.col("n_i") >= 3) & (F.col("n_j") >= 3), pooled)).withColumn("_g", F.col("mean_i") - F.col("mean_j"))
    rows = rows.withColumn("_d", F.when(F.col("_p") > 1e-12, F.col("_g") / F.when(F.col("_p") > 1e-12, F.col("_p"))).otherwise(0.0))
    return rows.groupBy(*keys, "seg_i", "seg_j").agg(F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("effect"), F.sqrt(F.sum(F.col("_g") * F.col("_g"))).alias("centroid"))


def effect_sizes(stats: DataFrame, keys: list[str]) -> DataFrame:
    """keys, seg_i, seg_j, method and d: the effect of ``mean_shifts`` as a distance."""
    return mean_shifts(stats, keys).select(*keys, "seg_i", "seg_j", F.lit("Cohen's d").alias("method"), F.col("effect").alias("d"))


def sliding_divergence(vectors: DataFrame, keys: list[str], half: int = 25, alpha: float = 0.5) -> DataFrame:
    """keys, w and d: divergence of the ``half`` rows before w (test) from the ``half`` from w on (reference); NULL near the ends."""
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("w")
        x = np.array(table.column("x").to_pylist(), float)
        scores: list[float | None] = [None] * len(x)
        for t in range(half, len(x) - half):
            scores[t] = frame_divergence(x[t - half : t + half], half, alpha)
        own = {k: pa.array([table.column(k)[0].as_py()] * len(x), table.schema.field(k).type) for k in keys}
        return pa.table({**own, "w": table.column("w").cast(pa.int64()), "d": pa.array(scores, pa.float64())})

    return spread(vectors.select(*keys, "w", "x"), keys).groupBy(*keys).applyInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "w long, d double"]))


def frame_divergence(frame: np.ndarray, half: int, alpha: float = 0.5) -> float:
    """Divergence of the first half of a frame (test) from the second (reference), features scaled to unit spread."""
    spread = frame.std(axis=0)
    frame = frame / np.where(spread == 0, 1.0, spread)
    return relative_divergence(frame[half:], frame[:half], alpha)
