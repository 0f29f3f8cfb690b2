"""Recursive Butterworth filters, there and back, on series that may span tasks.

A filter is a small linear system: a state of a few numbers carries everything that
earlier samples do to later ones.  A series is cut into blocks; each block by itself
gives the state that it would leave from rest; since the system is linear, the states
at the blocks' starts follow from these alone, by a scan over one short row per block;
then each block is filtered from its own start.  Blocks are filtered anywhere in the
cluster, and no task holds a series' samples.

Edges are as usual for such filters: the series is continued by its odd reflection for
three times the filter's order and more, and both passes begin in the state that a
constant input of their first value would leave.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.frames import gap_fill, iqr_clip, median_filter
from tidemark.storage import written

BLOCK = 512


def butterworth(order: int, fs: float, low: float | None = None, high: float | None = None) -> np.ndarray:
    """Second-order sections (b0 b1 b2, 1 a1 a2) of a band-pass (both bounds), low-pass (``high``) or high-pass (``low``) filter.

    The analogue prototype's poles are moved to the warped band and mapped by the
    bilinear transform; conjugate poles share a section.
    """
    if not (low or high) or any(f is not None and not 0 < f < fs / 2 for f in (low, high)) or (low and high and low >= high):
        raise ValueError("cut-offs must lie between 0 and half the rate, in order")
    warp = lambda f: 2 * fs * np.tan(np.pi * f / fs)
    poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    if low and high:
        width, middle = warp(high) - warp(low), warp(low) * warp(high)
        half = poles * width / 2
        root = np.sqrt(half**2 - middle + 0j)
        poles, zeros, gain = np.concatenate([half + root, half - root]), np.array([1.0, -1.0] * order), width**order
        gain *= np.real((2 * fs) ** order / np.prod(2 * fs - poles))
    elif high:
        poles = poles * warp(high)
        zeros, gain = -np.ones(order), np.real(warp(high) ** order / np.prod(2 * fs - poles))
    else:
        poles = warp(low) / poles
        zeros, gain = np.ones(order), np.real((2 * fs) ** order / np.prod(2 * fs - poles))
    poles = (2 * fs + poles) / (2 * fs - poles)
    pairs = [(p, np.conj(p)) for p in poles if p.imag > 1e-12]
    alone = sorted(p.real for p in poles if abs(p.imag) <= 1e-12)
    pairs += [tuple(alone[k : k + 2]) for k in range(0, len(alone), 2)]
    pairs.sort(key=lambda pair: abs(pair[0]))
    sections, left = [], list(zeros)
    for pair in pairs:
        own = [left.pop(0) for _ in pair]
        b, a = np.real(np.poly(own)), np.real(np.poly(pair))
        sections.append([*b, *[0.0] * (3 - len(b)), *a, *[0.0] * (3 - len(a))])
    out = np.array(sections)
    out[0, :3] *= gain
    return out


@dataclass
class System:
    """A cascade of sections as one system: state' = a state + b x, y = c state + d x."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: float
    order: int

    @classmethod
    def of(cls, sections: np.ndarray) -> System:
        n = 2 * len(sections)

        def step(state: np.ndarray, x: float) -> tuple[np.ndarray, float]:
            new = np.empty(n)
            for k, (b0, b1, b2, _, a1, a2) in enumerate(sections):
                y = b0 * x + state[2 * k]
                new[2 * k], new[2 * k + 1] = b1 * x - a1 * y + state[2 * k + 1], b2 * x - a2 * y
                x = y
            return new, x

        columns = [step(np.eye(n)[k], 0.0) for k in range(n)]
        b, d = step(np.zeros(n), 1.0)
        poles = int(sum(2 - (s[5] == 0) - (s[5] == 0 and s[4] == 0) for s in sections))
        return cls(np.stack([c[0] for c in columns], axis=1), b, np.array([c[1] for c in columns]), d, poles)

    @property
    def pad(self) -> int:
        return 3 * (self.order + 1)

    def steady(self) -> np.ndarray:
        """The state that a constant input of 1 leaves."""
        return np.linalg.solve(np.eye(len(self.b)) - self.a, self.b)

    def block(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For blocks of ``size``: what the state adds to each output, the response of outputs to inputs, and what each input adds to the last state."""
        states = np.empty((size + 1, len(self.b)))  # a^k b
        seen = np.empty((size, len(self.b)))  # c a^k
        states[0], row = self.b, self.c
        for k in range(size):
            seen[k], row = row, row @ self.a
            states[k + 1] = self.a @ states[k]
        response = np.concatenate([[self.d], states[: size - 1] @ self.c])
        late = np.subtract.outer(np.arange(size), np.arange(size))
        return seen, np.where(late >= 0, response[np.maximum(late, 0)], 0.0), states[:size][::-1].T


def zero_phase(samples: DataFrame, keys: list[str], sections: np.ndarray, idx: str = "idx", value: str = "value", out: str = "filtered") -> DataFrame:
    """keys, ``idx`` and ``out``: series 0..n-1 filtered forward and back; gaps are filled before (linear, nearest at the ends).

    A series that is too short for the reflection is reflected as far as it goes.
    """
    system = System.of(sections)
    rows = gap_fill(samples.select(*keys, F.col(idx).cast("long").alias("_i"), F.col(value).cast("double").alias("_x")), keys, "_i", "_x", "_v").select(*keys, "_i", "_v")
    ends = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min_by("_v", "_i").alias("_first"), F.max_by("_v", "_i").alias("_last"))
    pad, i, n = F.least(F.lit(system.pad), F.col("_n") - 1), F.col("_i"), F.col("_n")
    place = lambda at, v: F.struct(at.cast("long").alias("at"), v.alias("v"))
    copies = F.array(
        place(pad + i, F.col("_v")), F.when((i >= 1) & (i <= pad), place(pad - i, 2 * F.col("_first") - F.col("_v"))),
        F.when((i >= n - 1 - pad) & (i <= n - 2), place(pad + 2 * (n - 1) - i, 2 * F.col("_last") - F.col("_v"))),
    )
    wide = rows.join(ends, keys).select(*keys, F.explode(F.filter(copies, lambda x: x.isNotNull())).alias("_p"))
    blocks = wide.groupBy(*keys, F.expr(f"_p.at div {BLOCK}").alias("block")).agg(F.transform(F.sort_array(F.collect_list("_p")), lambda p: p["v"]).alias("x"))
    blocks = written(blocks, "filter-blocks")
    there = written(_pass(blocks, keys, system, False), "filter-forward")
    back = _pass(there, keys, system, True)
    spread = back.select(*keys, (F.col("block") * BLOCK).alias("_b"), F.posexplode("x").alias("_k", out)).join(ends.select(*keys, "_n"), keys)
    at = F.col("_b") + F.col("_k") - pad
    return spread.where((at >= 0) & (at < n)).select(*keys, at.alias(idx), out)


def _pass(blocks: DataFrame, keys: list[str], system: System, backward: bool) -> DataFrame:
    """``blocks`` (keys, block, x) filtered in one direction."""
    spark = blocks.sparkSession
    packed = spark.sparkContext.broadcast((system, system.block(BLOCK)))
    kinds = ", ".join(f"{k} {blocks.schema[k].dataType.simpleString()}" for k in keys)

    def ends(batches):
        own, (_, _, reach) = packed.value
        for batch in batches:
            lists = [np.asarray(x, float)[:: -1 if backward else 1] for x in batch.column(len(keys) + 1).to_pylist()]
            # A shorter block stands at the end of the inputs that it does not have: rest before it changes nothing.
            filled = np.stack([np.concatenate([np.zeros(BLOCK - len(x)), x]) for x in lists]) if lists else np.zeros((0, BLOCK))
            columns = [*batch.columns[: len(keys) + 1], pa.array(list(filled @ reach.T), pa.list_(pa.float64())), pa.array([x[0] for x in lists], pa.float64()), pa.array([len(x) for x in lists], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "block", "left", "first", "size"])

    short = blocks.select(*keys, "block", "x").mapInArrow(ends, f"{kinds}, block long, left array<double>, first double, size int")

    def scan(table: pa.Table) -> pa.Table:
        own = packed.value[0]
        table = table.sort_by([("block", "descending" if backward else "ascending")])
        whole = np.linalg.matrix_power(own.a, BLOCK)
        state, states = own.steady() * table.column("first")[0].as_py(), []
        for left, size in zip(table.column("left").to_pylist(), table.column("size").to_pylist(), strict=True):
            states.append(state)
            state = (whole if size == BLOCK else np.linalg.matrix_power(own.a, size)) @ state + left
        return pa.table({**{k: table.column(k) for k in keys}, "block": table.column("block"), "start": pa.array(states, pa.list_(pa.float64()))})

    starts = short.groupBy(*keys).applyInArrow(scan, f"{kinds}, block long, start array<double>")

    def run(batches):
        own, (seen, response, _) = packed.value
        for batch in batches:
            states = np.array(batch.column(len(keys) + 2).to_pylist(), float).reshape(batch.num_rows, -1)
            lists = [np.asarray(x, float)[:: -1 if backward else 1] for x in batch.column(len(keys) + 1).to_pylist()]
            filled = np.stack([np.concatenate([x, np.zeros(BLOCK - len(x))]) for x in lists]) if lists else np.zeros((0, BLOCK))
            made = filled @ response.T + states @ seen.T
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys) + 1], pa.array([y[: len(x)][:: -1 if backward else 1] for x, y in zip(lists, made, strict=True)], pa.list_(pa.float64()))], names=[*keys, "block", "x"])

    return blocks.join(starts, [*keys, "block"]).select(*keys, "block", "x", "start").mapInArrow(run, f"{kinds}, block long, x array<double>")


def band_pass(samples: DataFrame, keys: list[str], fs: float, low: float, high: float, order: int = 3, **columns: str) -> DataFrame:
    """Band-pass; the upper bound is at most 0.95 of half the rate."""
    return zero_phase(samples, keys, butterworth(order, fs, low, min(high, 0.95 * fs / 2)), **columns)


def low_pass(samples: DataFrame, keys: list[str], fs: float, high: float, order: int = 5, **columns: str) -> DataFrame:
    return zero_phase(samples, keys, butterworth(order, fs, high=high), **columns)


#: Pass bands in Hz of the filtered modalities.
BANDS = {"ECG": (0.5, 40.0), "PPG": (0.4, 8.0), "Resp": (0.05, 1.0)}


def denoise(samples: DataFrame, keys: list[str], modality: str, fs: float, clip: float, idx: str = "idx", value: str = "value", out: str = "clean") -> DataFrame:
    """A modality's cleaning: gaps filled, values clipped beyond ``clip`` interquartile ranges, spikes taken out by medians, then its filter.

    ECG, PPG and Resp are band-passed; EDA is median-filtered over half a second and
    low-passed below 1 Hz (if it has over 15 samples); other modalities are
    median-filtered over three seconds.
    """
    rows = gap_fill(samples.select(*keys, idx, F.col(value).cast("double").alias("_x")), keys, idx, "_x", "_g")
    rows = iqr_clip(rows, keys, clip, "_g", "_c").select(*keys, idx, "_c")
    if modality in BANDS:
        low, high = BANDS[modality]
        return band_pass(rows, keys, fs, low, high, idx=idx, value="_c", out=out)
    kernel = max(3, int((0.5 if modality == "EDA" else 3.0) * fs) | 1)
    rows = median_filter(rows, keys, kernel, idx, "_c", "_m").select(*keys, idx, "_m")
    high = min(1.0, 0.8 * fs / 2)
    if modality != "EDA" or not 0 < high < fs / 2:
        return rows.withColumnRenamed("_m", out)
    smooth = low_pass(rows, keys, fs, high, 2, idx=idx, value="_m", out="_s")
    sized = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return sized.join(smooth, [*keys, idx]).select(*keys, idx, F.when(F.col("_n") > 15, F.col("_s")).otherwise(F.col("_m")).alias(out))
