"""Change points: one exact penalised dynamic programme per series.

The programme minimises the costs of segments plus a penalty for each.  It goes over
the ends from left to right and keeps, for each start, what the cost needs: for a
kernel the sum of the kernel over the rows from there on, which one more row changes by
one pass over its kernel values; for the other models running sums, of which a segment
is a difference.  So memory grows with the length of a series, not with its square.
Starts that can be in no best segmentation any more are pruned, and with them the
kernel values before the first that is left.  All penalties share one sweep.

Of short series many go through it at once: the costs of all their segments are one
table a series, and a step is taken for all of them together, over all starts.

A missing value in a vector is filled from its feature's neighbours, linearly, as
``gap_fill`` does; vectors of one series that differ in length are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.functions.dsp import fill_gaps
from tidemark.operators.frames import gathered, spread

#: Rows of distances that are computed at once, and distances that are sorted to find a median.
ROWS, FEW = 128, 1 << 20
#: Rows of a series that is swept together with others; pairs of rows of all that are swept at once, and of those whose kernel is taken at once.
SHORT, CELLS, NEAR = 256, 1 << 20, 1 << 16


def _distance_blocks(x: np.ndarray) -> Iterator[np.ndarray]:
    """The squared distances of all pairs of rows, a block of rows at a time."""
    norms = (x * x).sum(axis=1)
    for at in range(0, len(x), ROWS):
        own = slice(at, at + ROWS)
        d2 = np.maximum(norms[own, None] + norms[None, at:] - 2 * (x[own] @ x[at:].T), 0)
        yield d2[np.triu_indices(len(d2), 1, d2.shape[1])]


def median_distance(x: np.ndarray) -> float:
    """The median of the squared distances of all pairs of rows; 0 without pairs.

    Counted by ranges of distance, ever finer around the median, until few are left to
    be sorted: no table of pairs.
    """
    pairs = len(x) * (len(x) - 1) // 2
    if not pairs:
        return 0.0
    wanted = np.array([(pairs - 1) // 2, pairs // 2])
    low, high, below, inside = 0.0, 4.0 * float(((x - x.mean(axis=0)) ** 2).sum(axis=1).max()), 0, pairs
    least = 1e-18 * high
    while inside > FEW and high > least and high - low > 1e-11 * high:
        counts = np.zeros(4096, "i8")
        for d2 in _distance_blocks(x):
            counts += np.histogram(d2, 4096, (low, high))[0]
        edges, ahead = np.linspace(low, high, 4097), below + np.cumsum(counts)
        first, last = np.searchsorted(ahead, wanted, side="right").clip(0, 4095)
        if last > first:  # the two middle values stand on either side of an edge
            parts = [(d2[d2 < edges[last]].max(initial=0.0), d2[d2 >= edges[last]].min(initial=np.inf)) for d2 in _distance_blocks(x)]
            return float((max(p[0] for p in parts) + min(p[1] for p in parts)) / 2)
        below = int(ahead[first - 1]) if first else below
        low, high, inside = edges[first], edges[first + 1], int(counts[first])
    if inside > FEW:  # equal but for rounding
        return float(min(d2[d2 >= low].min(initial=np.inf) for d2 in _distance_blocks(x)))
    left = np.sort(np.concatenate([d2[(d2 >= low) & (d2 <= high)] for d2 in _distance_blocks(x)]))
    return float(left[np.clip(wanted - below, 0, len(left) - 1)].mean())


class Kernel:
    """Gaussian kernel: sum of k(i, i) less the mean of k(i, j) over the segment's rows; ``gamma``, or 1 / median squared distance (1 if that is 0)."""

    splits = True

    def __init__(self, x: np.ndarray, gamma: float | None = None):
        self.x, self.norms = x, (x * x).sum(axis=1)
        self.gamma = gamma if gamma is not None else 1 / (median_distance(x) or 1.0)
        self.begin()

    def begin(self) -> None:
        self.end, self.sums = 0, np.zeros(len(self.x) + 1)  # the kernel over the rows from each start to the end

    def advance(self, end: int, first: int) -> None:
        """Go on to ``end``; starts before ``first`` are not asked for any more."""
        while self.end < end:
            some = slice(self.end, min(end, self.end + ROWS))
            d2 = np.maximum(self.norms[some, None] + self.norms[None, first : some.stop] - 2 * (self.x[some] @ self.x[first : some.stop].T), 0)
            k = np.exp(-self.gamma * d2)
            for row, t in zip(k, range(some.start, some.stop), strict=True):
                if t >= first:
                    self.sums[first:t] += 2 * np.cumsum(row[: t - first][::-1])[::-1]
                    self.sums[first : t + 1] += 1
            self.end = some.stop

    def to(self, starts: np.ndarray, end: int) -> np.ndarray:
        if end != self.end:
            if end < self.end:
                self.begin()
            self.advance(end, 0)
        return (end - starts) - self.sums[starts] / (end - starts)


class Sums:
    """Models whose cost follows from the number, the sum and (``squares``) the products of the segment's rows."""

    splits = True

    def __init__(self, rows: np.ndarray, cost: Callable, squares: bool, total: np.ndarray | None = None):
        self.cost = cost
        self.sums = np.concatenate([np.zeros((1, rows.shape[1])), np.cumsum(rows, axis=0)])
        self.total = np.concatenate([[0.0], np.cumsum(total if total is not None else np.zeros(len(rows)))])
        if squares:
            self.at = np.triu_indices(rows.shape[1])
            self.products = np.concatenate([np.zeros((1, len(self.at[0]))), np.cumsum(rows[:, self.at[0]] * rows[:, self.at[1]], axis=0)])
        self.squares = squares

    def begin(self) -> None:
        pass

    def advance(self, end: int, first: int) -> None:
        pass

    def to(self, starts: np.ndarray, end: int) -> np.ndarray:
        n, s = (end - starts).astype(float), self.sums[end] - self.sums[starts]
        if not self.squares:
            return self.cost(n, s, self.total[end] - self.total[starts])
        full = np.zeros((len(starts), s.shape[1], s.shape[1]))
        full[:, self.at[0], self.at[1]] = full[:, self.at[1], self.at[0]] = self.products[end] - self.products[starts]
        return self.cost(n, s, full)


class Rows:
    """A cost that looks at the segment's rows themselves."""

    def __init__(self, x: np.ndarray, cost: Callable[[np.ndarray], float], splits: bool):
        self.x, self.cost, self.splits = x, cost, splits

    def begin(self) -> None:
        pass

    def advance(self, end: int, first: int) -> None:
        pass

    def to(self, starts: np.ndarray, end: int) -> np.ndarray:
        return np.array([float(self.cost(self.x[s:end])) for s in starts])


def _residual(design: np.ndarray, cross: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Residual sums of squares of regressions, from the products of regressors, with the target and of the target."""
    solved = np.linalg.pinv(design, 1e-10, hermitian=True) @ cross[:, :, None]
    return np.maximum(target - (cross * solved[:, :, 0]).sum(axis=1), 0)


def _centred(x: np.ndarray) -> np.ndarray:
    return x - x.mean(axis=0) if len(x) else x


def _spread(rows: np.ndarray) -> Sums:
    """Squared distances from the segment's mean."""
    return Sums(rows, lambda n, s, t: np.maximum(t - (s * s).sum(axis=1) / n, 0), False, (rows * rows).sum(axis=1))


def _normal(x: np.ndarray, epsilon: float = 1e-6) -> Sums:
    """Rows times the log determinant of the segment's covariance, to which ``epsilon`` is added on the diagonal."""
    own = np.eye(x.shape[1]) * epsilon

    def cost(n, s, p):
        mean = s / n[:, None]
        return n * np.linalg.slogdet(p / n[:, None, None] - mean[:, :, None] * mean[:, None, :] + own)[1]

    return Sums(_centred(x), cost, True)


def _linear(x: np.ndarray) -> Sums:
    """Residual of the first column's regression on the others."""
    return Sums(x, lambda n, s, p: _residual(p[:, 1:, 1:], p[:, 1:, 0], p[:, 0, 0]), True)


def _autoregressive(x: np.ndarray, order: int = 4) -> Sums:
    """Residual of the first column's regression on its ``order`` values before and a constant, over the rows that have these in the segment."""
    y = _centred(x[:, 0])
    rows = np.zeros((len(y), order + 2))
    rows[:, 0], rows[:, -1] = y, 1.0
    for k in range(1, order + 1):
        rows[k:, k] = y[:-k]
    sums = Sums(rows, lambda n, s, p: _residual(p[:, 1:, 1:], p[:, 1:, 0], p[:, 0, 0]), True)
    whole = sums.to
    # The first rows of a segment have no values before them in it.
    sums.to = lambda starts, end: np.where(end - starts > order, whole(np.minimum(starts + order, end - 1), end), 0.0)
    return sums


def _rank(x: np.ndarray) -> Sums:
    """Less the length times the squared mean of the rows' ranks, in units of the ranks' covariance."""
    ordered = np.sort(x, axis=0)
    ranks = np.stack([(np.searchsorted(o, c, "left") + np.searchsorted(o, c, "right") + 1) / 2 for o, c in zip(ordered.T, x.T, strict=True)], axis=1) if len(x) else x
    ranks = _centred(ranks)
    inverse = np.linalg.pinv(np.atleast_2d(ranks.T @ ranks / max(1, len(x) - 1)), hermitian=True)
    return Sums(ranks, lambda n, s, t: -np.einsum("ij,jk,ik->i", s, inverse, s) / n, False)


def _mahalanobis(x: np.ndarray, metric: np.ndarray | None = None) -> Sums:
    """Squared distances from the segment's mean in ``metric``, or in the inverse covariance of all rows."""
    own = _centred(x)
    metric = np.linalg.pinv(np.atleast_2d(own.T @ own / max(1, len(x) - 1)), hermitian=True) if metric is None else np.asarray(metric, float)
    values, vectors = np.linalg.eigh(metric)
    return _spread(own @ vectors * np.sqrt(np.maximum(values, 0)))


def _cosine(x: np.ndarray) -> Sums:
    """Squared distances from the segment's mean of rows of length one (a row of zeros stays)."""
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return _spread(x / np.where(length > 0, length, 1.0))


#: Cost models by name, each made of a series' rows and the model's parameters.
MODELS: dict[str, Callable] = {
    "rbf": Kernel, "l2": lambda x: _spread(_centred(x)), "l1": lambda x: Rows(x, lambda rows: np.abs(rows - np.median(rows, axis=0)).sum(), True),
    "normal": _normal, "linear": _linear, "ar": _autoregressive, "rank": _rank, "mahalanobis": _mahalanobis, "cosine": _cosine,
}


def Cost(x: np.ndarray, model: str | Callable = "rbf", gamma: float | None = None, **parameters):  # noqa: N802
    """Costs of the segments [s, e) of one series: a name of ``MODELS`` with its parameters, or a function of the segment's rows."""
    if callable(model):
        return Rows(x, model, False)
    if model not in MODELS:
        raise ValueError(f"no kernel or cost model is called {model}; there are {', '.join(MODELS)}")
    return MODELS[model](x, **({"gamma": gamma} if gamma is not None else {}), **parameters)


class _Programme:
    """The cheapest segmentations up to each end, for one penalty."""

    def __init__(self, n: int, penalty: float, min_size: int):
        self.penalty, self.min_size = penalty, min_size
        self.total, self.before = np.full(n + 1, np.inf), np.zeros(n + 1, "i8")
        self.total[0] = 0.0
        self.starts, self.until = np.zeros(1, "i8"), np.array([n + 1])  # starts in play, and the end from which each is out

    def first(self, end: int) -> int:
        return int(self.starts[0]) if len(self.starts) else end

    def step(self, cost, end: int, final: bool) -> None:
        keep = self.until > end
        self.starts, self.until = self.starts[keep], self.until[keep]
        able = int(np.searchsorted(self.starts, end - self.min_size, side="right"))
        starts = self.starts[:able]
        if len(starts):
            values = self.total[starts] + cost.to(starts, end)
            best = int(np.flatnonzero(values <= values.min() + 1e-9)[0])
            self.total[end], self.before[end] = values[best] + self.penalty, starts[best]
            if cost.splits and not final:
                # From ``end`` on, a cut here does better than a segment from such a start can; it may stand ``min_size`` later.
                beaten = values > self.total[end] + 1e-6
                self.until[:able][beaten] = np.minimum(self.until[:able][beaten], end + self.min_size)
            self.starts, self.until = np.append(self.starts, end), np.append(self.until, len(self.total))

    def cuts(self, n: int) -> list[int]:
        found, at = [], int(self.before[n])
        while at > 0:
            found.append(at)
            at = int(self.before[at])
        return found[::-1]


def segmentations(cost, n: int, penalties: list[float], min_size: int = 10, jump: int = 1) -> list[list[int]]:
    """For each penalty the inner boundaries of the cheapest segmentation; segments have ``min_size`` rows at least, cuts lie on multiples of ``jump``.

    Of equal totals (to 1e-9) the one whose last segment starts earliest is taken.  A
    series too short for two segments has no cut.
    """
    programmes = [_Programme(n, p, min_size) for p in penalties]
    cost.begin()
    for end in [e for e in range(0, n, jump) if e >= min_size] + ([n] if n else []):
        cost.advance(end, min(p.first(end) for p in programmes))
        for p in programmes:
            p.step(cost, end, end == n)
    return [p.cuts(n) for p in programmes]


def best_cuts(cost, n: int, penalty: float, min_size: int = 10, jump: int = 1) -> list[int]:
    """``segmentations`` for one penalty."""
    return segmentations(cost, n, [penalty], min_size, jump)[0]


def _kernel_tables(x: np.ndarray, gamma: float | None = None) -> np.ndarray:
    """``Kernel`` of the segments [s, e) of every series of a stack (series, rows, columns), at [:, e, s]."""
    count, n, _ = x.shape
    upper, middle = np.ravel_multi_index(np.triu_indices(n, 1), (n, n)), [max(0, n * (n - 1) // 2 - 1) // 2, n * (n - 1) // 4]
    length = np.abs(np.arange(n + 1)[None, :] - np.arange(n + 1)[:, None]).astype(float)
    per, table, share = np.maximum(length, 1), np.zeros((count, n + 1, n + 1)), max(1, NEAR // (n + 1) ** 2)
    for at in range(0, count, share):  # a few series' tables stay near the processor
        own, sums = x[at : at + share], table[at : at + share]
        d2, part = np.zeros((len(own), n, n)), np.empty((len(own), n, n))
        for c in np.moveaxis(own, 2, 0):
            np.subtract(c[:, :, None], c[:, None, :], out=part)
            part *= part
            d2 += part
        width = gamma
        if width is None:
            ordered = np.partition(d2.reshape(len(own), -1)[:, upper], middle, axis=1) if n > 1 else np.zeros((len(own), 1))
            median = ordered[:, middle].mean(axis=1)[:, None, None]
            width = 1 / np.where(median > 0, median, 1.0)
        d2 *= -width
        np.exp(d2, out=d2)
        np.cumsum(d2, axis=1, out=part)
        np.cumsum(part, axis=2, out=sums[:, 1:, 1:])
        whole = np.einsum("kii->ki", sums).copy()
        sums *= 2
        sums -= whole[:, None, :]
        sums -= whole[:, :, None]
        sums /= per
        sums += length
    return table


def _median_tables(x: np.ndarray, least: int) -> np.ndarray:
    """The model ``l1`` of the segments of ``least`` rows on of every series of a stack, as ``_kernel_tables``."""
    count, n, _ = x.shape
    table, columns = np.zeros((count, n + 1, n + 1)), np.ascontiguousarray(np.moveaxis(x, 1, 2))
    for size in range(max(1, least), n + 1):
        rows = np.sort(np.lib.stride_tricks.sliding_window_view(columns, size, axis=2), axis=3)
        half, starts = size // 2, np.arange(n - size + 1)
        table[:, starts + size, starts] = rows[..., size - half :].sum(axis=(1, 3)) - rows[..., :half].sum(axis=(1, 3))
    return table


def cost_tables(x: np.ndarray, model: str = "rbf", gamma: float | None = None, least: int = 1, **parameters) -> np.ndarray:
    """``Cost`` of the segments [s, e) of ``least`` rows on of every series of a stack (series, rows, columns), at [:, e, s]."""
    count, n, width = x.shape
    if model == "rbf":
        return _kernel_tables(x, **({"gamma": gamma} if gamma is not None else {}), **parameters)
    if model == "l1" and not parameters and gamma is None:
        return _median_tables(x, least)
    starts, ends = np.triu_indices(n + 1, max(1, least))
    table, share = np.zeros((count, n + 1, n + 1)), max(1, CELLS // (width + 2) ** 2)
    for own, rows in zip(table, x, strict=True):
        cost = Cost(rows, model, gamma, **parameters)
        for at in range(0, len(starts), share):
            s, e = starts[at : at + share], ends[at : at + share]
            own[e, s] = cost.to(s, e)
    return table


def swept(table: np.ndarray, penalty: float, min_size: int = 10, jump: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Number of the series and cut of all that ``segmentations`` finds, from ``cost_tables``.

    No start is pruned: a pruned one is never best.
    """
    count, n = len(table), table.shape[1] - 1
    total, before = np.full((count, n + 1), np.inf), np.zeros((count, n + 1), "i8")
    total[:, 0] = 0.0
    each = np.arange(count)
    for end in [e for e in range(0, n, jump) if e >= min_size] + ([n] if n else []):
        able = end - min_size + 1  # starts before that; the total is infinite where none may stand
        if able > 0:
            values = total[:, :able] + table[:, end, :able]
            best = (values <= values.min(axis=1, keepdims=True) + 1e-9).argmax(axis=1)
            total[:, end], before[:, end] = values[each, best] + penalty, best
    series, cuts, at = [], [], before[:, n]
    while (at > 0).any():
        each, at = each[at > 0], at[at > 0]
        series.append(each)
        cuts.append(at)
        at = before[each, at]
    return (np.concatenate(series), np.concatenate(cuts)) if series else (np.zeros(0, "i8"), np.zeros(0, "i8"))


@dataclass(frozen=True)
class Sweep:
    """One model's way over the series: its name in the result, its cost as ``Cost`` takes it, its penalties, and the columns of the vectors that it sees (all without)."""

    name: str
    penalties: tuple[float, ...] | list[float]
    model: str | Callable = "rbf"
    gamma: float | None = None
    columns: list[int] | None = None
    parameters: dict = field(default_factory=dict)

    def over(self, x: np.ndarray, min_size: int, jump: int) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """A penalty, and number of the series and cut of all cuts for it, of a stack of series."""
        x = x if self.columns is None else np.ascontiguousarray(x[:, :, self.columns])
        if callable(self.model) or x.shape[1] > SHORT or not x.size:
            found = [segmentations(Cost(rows, self.model, self.gamma, **self.parameters), len(rows), self.penalties, min_size, jump) for rows in x]
            for n, penalty in enumerate(self.penalties):
                yield penalty, np.repeat(np.arange(len(x)), [len(own[n]) for own in found]), np.concatenate([np.array(own[n], "i8") for own in found])
        else:
            table = cost_tables(x, self.model, self.gamma, min_size, **self.parameters)
            for penalty in self.penalties:
                yield penalty, *swept(table, penalty, min_size, jump)


def _series(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """Key and rows (missing as NaN) of one series after the other, from keys and x in order of keys and rows."""
    key, parts = None, []

    def whole() -> tuple[tuple, np.ndarray]:
        lengths = np.concatenate([p[1] for p in parts])
        if lengths.min() != lengths.max():
            raise ValueError("vectors of one series differ in length")
        return key, np.concatenate([p[0] for p in parts]).reshape(len(lengths), lengths[0])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        codes = [c.dictionary_encode("encode").indices.to_numpy() for c in columns]
        starts = np.concatenate([[0], np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1])
        x = batch.column(batch.schema.get_field_index("x"))
        lengths, flat = x.value_lengths().fill_null(0).to_numpy(False), x.flatten().to_numpy(False).astype(float)
        place = np.concatenate([[0], np.cumsum(lengths)])
        for at, end in zip(starts, np.append(starts, batch.num_rows)[1:], strict=True):
            own = tuple(c[at].as_py() for c in columns)
            if own != key:
                if parts:
                    yield whole()
                key, parts = own, []
            parts.append((flat[place[at] : place[end]], lengths[at:end]))
    if parts:
        yield whole()


def boundaries_by_model(vectors: DataFrame, keys: list[str], sweeps: list[Sweep], min_size: int = 10, jump: int = 1) -> DataFrame:
    """keys, penalty, cp and model: the change points of every series of ``vectors`` (keys, w, x array<double>), for every penalty of every one of ``sweeps``.

    All models share one pass over the series.
    """
    kinds = {f.name: f.dataType for f in vectors.schema.fields}
    schema = T.StructType([*(T.StructField(k, kinds[k]) for k in keys), T.StructField("penalty", T.DoubleType()), T.StructField("cp", T.IntegerType()), T.StructField("model", T.StringType())])
    types = [to_arrow_type(kinds[k]) for k in keys]

    def cuts(names: list[tuple], x: np.ndarray) -> Iterator[pa.Table]:
        own = [pa.array([n[k] for n in names], kind) for k, kind in enumerate(types)]
        for sweep in sweeps:
            for penalty, series, cp in sweep.over(x, min_size, jump):
                at = pa.array(series)
                yield pa.table([*(c.take(at) for c in own), pa.array(np.full(len(cp), penalty, float)), pa.array(cp, pa.int32()), pa.array([sweep.name] * len(cp), pa.string())], schema.names)

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: dict[tuple, list] = {}
        cells = 0
        for key, x in _series(batches, keys):
            x = x if np.isfinite(x).all() else np.column_stack([fill_gaps(c) for c in x.T])
            if len(x) > SHORT:
                yield from cuts([key], x[None])
                continue
            held.setdefault(x.shape, []).append((key, x))
            cells += (len(x) + 1) ** 2
            if cells >= CELLS:
                for own in held.values():
                    yield from cuts([k for k, _ in own], np.stack([x for _, x in own]))
                held, cells = {}, 0
        for own in held.values():
            yield from cuts([k for k, _ in own], np.stack([x for _, x in own]))

    rows = spread(vectors.select(*keys, "w", "x"), keys).sortWithinPartitions(*keys, "w").select(*keys, "x")
    return rows.mapInArrow(lambda batches: gathered(tables(batches)), schema)


def boundaries(vectors: DataFrame, keys: list[str], penalties: list[float] | tuple[float, ...] = (1.0,), min_size: int = 10, jump: int = 1, model: str | Callable = "rbf", gamma: float | None = None, **parameters) -> DataFrame:
    """keys, penalty and cp: the change points of every series of ``vectors`` (keys, w, x array<double>), for every penalty.

    ``model``, ``gamma`` and ``parameters`` shape the cost as ``Cost`` says.
    """
    return boundaries_by_model(vectors, keys, [Sweep("", [float(p) for p in penalties], model, gamma, None, parameters)], min_size, jump).drop("model")


def squared_distances(vectors: DataFrame, keys: list[str], item: str = "w", x: str = "x") -> DataFrame:
    """keys, i < j and d2 of all pairs of rows of one series."""
    a = vectors.select(*keys, F.col(item).alias("i"), F.col(x).alias("_a"))
    b = vectors.select(*keys, F.col(item).alias("j"), F.col(x).alias("_b"))
    d2 = F.aggregate(F.zip_with("_a", "_b", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    return a.join(b, keys).where("i < j").select(*keys, "i", "j", d2.alias("d2"))


def bandwidths(d2: DataFrame, keys: list[str]) -> DataFrame:
    """gamma = 1 / median of d2 (1 if it is 0), and sigma = sqrt(half the median of the positive d2)."""
    return d2.groupBy(*keys).agg(F.expr("percentile(d2, 0.5D)").alias("med"), F.expr("percentile(d2, 0.5D) FILTER (WHERE d2 > 0)").alias("med_pos")).select(
        *keys, F.when(F.col("med") > 0, 1 / F.when(F.col("med") > 0, F.col("med"))).otherwise(1.0).alias("gamma"), F.sqrt(0.5 * F.col("med_pos")).alias("sigma")
    )


def segment_costs(segments: DataFrame, d2: DataFrame, keys: list[str]) -> DataFrame:
    """``segments`` (keys, seg, start, end) with the kernel cost of each, from the pair distances."""
    gamma = bandwidths(d2, keys)
    hit = segments.join(d2, keys).where("i >= start AND j < end").join(gamma, keys)
    sums = hit.groupBy(*keys, "seg").agg(F.sum(F.exp(-F.col("gamma") * F.col("d2"))).alias("off"))
    n = (F.col("end") - F.col("start")).cast("double")
    return segments.join(sums, [*keys, "seg"], "left").withColumn("cost", n - (n + 2 * F.coalesce("off", F.lit(0.0))) / n).drop("off")


def segment_stats(features: DataFrame, segments: DataFrame, keys: list[str], value: str = "norm") -> DataFrame:
    """Per segment and feature: n, mean, population std and sample variance of the valid rows."""
    rows = features.join(segments.hint("merge"), keys).where("w >= start AND w < end")
    return rows.groupBy(*keys, "seg", "feature").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.var_samp(value).alias("var"))
