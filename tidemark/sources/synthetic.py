"""Deterministic series for given subjects: regime changes, distance tables and physiological signals.

Subjects are a number of made-up ones, for tests, or rows of a table: then each has a
session, whose rates its columns may give, so that what is made grows with the table.
Noise comes from a hash of the position, so rows can be made on any executor in any
order and are the same each time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.frames import spread
from tidemark.schema import MODALITY_RATE

#: Cuts, levels (three features per segment) and labelled outlier segments of the regime series.
REGIME_LENGTH = 200
REGIME_CUTS = (35, 72, 110, 148, 180)
REGIME_LEVELS = ((0.30, 0.20, 0.50), (0.30, 0.20, 0.50), (0.72, 0.78, 0.22), (0.31, 0.21, 0.51), (0.30, 0.20, 0.50), (0.55, 0.58, 0.35))
REGIME_OUTLIERS = (2, 5)


def noise(*columns: Column | str, seed: int = 0) -> Column:
    """Roughly standard normal: the centred sum of twelve uniform hashes."""
    own = [F.col(c) if isinstance(c, str) else c for c in columns]
    parts = [F.xxhash64(*own, F.lit(seed * 100 + k)).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30) for k in range(12)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total - 6.0


def _subjects(spark: SparkSession, subjects: int | DataFrame) -> DataFrame:
    """subject_id, and further columns of a table of subjects."""
    if isinstance(subjects, int):
        return spark.range(subjects).select(F.concat(F.lit("S"), F.col("id")).alias("subject_id"))
    return subjects.withColumn("subject_id", F.col("subject_id").cast("string"))


def regimes(spark: SparkSession, subjects: int | DataFrame = 1, seed: int = 0) -> DataFrame:
    """subject_id, w, feature, norm: six segments of steady, two-mode, wavy, steady, rising and steady shape."""
    rows = spread(_subjects(spark, subjects).select("subject_id"), ["subject_id"]).select("subject_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(REGIME_LENGTH - 1).cast("long"))).alias("w"))
    rows = rows.withColumn("feature", F.explode(F.array(*[F.lit(f"f{k}") for k in range(3)])))
    seg = sum((F.col("w") >= c).cast("int") for c in REGIME_CUTS)
    starts = F.array(*[F.lit(c) for c in (0, *REGIME_CUTS)])
    ends = F.array(*[F.lit(c) for c in (*REGIME_CUTS, REGIME_LENGTH)])
    level = F.array(*[F.array(*[F.lit(x) for x in row]) for row in REGIME_LEVELS])
    rows = rows.withColumn("seg", seg).withColumn("u", (F.col("w") - starts[F.col("seg")]) / (ends[F.col("seg")] - starts[F.col("seg")] - 1))
    k = F.substring("feature", 2, 1).cast("int")
    wild = noise("subject_id", "w", "feature", seed=seed + 1)
    side = F.when(F.pmod(F.xxhash64("subject_id", "w", F.lit(seed)), F.lit(2)) == 0, 0.06).otherwise(-0.06)
    shape = F.when(F.col("seg") == 1, side + 0.02 * wild).when(F.col("seg") == 2, F.abs(F.sin(F.col("u") * 4 * math.pi)) * 0.10 + 0.015 * wild)
    shape = shape.when(F.col("seg") == 4, (F.col("u") * 2 - 1) * 0.08 + 0.015 * wild).otherwise(0.025 * wild)
    return rows.select("subject_id", "w", "feature", (level[F.col("seg")][k] + shape).alias("norm"))


def distance_tables(spark: SparkSession, segments: int = 6, high: dict[str, tuple[int, ...]] | None = None, seed: int = 0, subjects: int | DataFrame = 1) -> DataFrame:
    """subject_id, seg_i < seg_j, method, d: distances around 0.3, and around 1 where a method's high segments take part."""
    high = high or {"DTW": (2,), "RuLSIF": (5,), "Cohen's d": (2, 5)}
    pairs = F.array(*[F.struct(F.lit(i).alias("seg_i"), F.lit(j).alias("seg_j"), F.lit(m).alias("method")) for m in high for i in range(segments) for j in range(i + 1, segments)])
    rows = spread(_subjects(spark, subjects).select("subject_id"), ["subject_id"]).select("subject_id", F.inline(pairs))
    table = F.create_map(*[x for m, own in high.items() for x in (F.lit(m), F.array(*[F.lit(s) for s in own]))])
    far = F.array_contains(table[F.col("method")], F.col("seg_i")) | F.array_contains(table[F.col("method")], F.col("seg_j"))
    return rows.withColumn("d", F.when(far, 1.0).otherwise(0.3) + 0.05 * noise("subject_id", "seg_i", "seg_j", "method", seed=seed))


def physiology(spark: SparkSession, subjects: int | DataFrame = 1, seconds: int = 120, heart_hz: float = 1.2, breath_hz: float = 0.25) -> DataFrame:
    """samples of five modalities with known rates: beats at ``heart_hz``, breaths at ``breath_hz``, a skin response every 20 s.

    Columns ``heart_hz`` and ``breath_hz`` of a table of subjects come before the arguments.
    A subject's samples are made where the subject's row is and come together: modality
    by modality, in order.
    """
    people = _subjects(spark, subjects)
    rate = lambda name, value: F.col(name) if name in people.columns else F.lit(value)
    people = spread(people.select("subject_id", rate("heart_hz", heart_hz).alias("_heart"), rate("breath_hz", breath_hz).alias("_breath")), ["subject_id"])
    series = people.select("*", F.inline(F.array(*[F.struct(F.lit(m).alias("modality"), F.lit(fs).alias("fs")) for m, fs in MODALITY_RATE.items()])))
    rows = series.withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("fs").cast("long") * seconds - 1)))
    t, pi2 = F.col("idx") / F.col("fs"), 2 * math.pi
    beat = F.pmod(t + 0.02 * F.sin(pi2 * F.col("_breath") * t), 1 / F.col("_heart"))
    waves = {
        "ECG": F.exp(-((beat - 0.3) ** 2) / (2 * 0.012**2)) + 0.15 * F.exp(-((beat - 0.55) ** 2) / (2 * 0.04**2)),
        "PPG": F.exp(-((beat - 0.55) ** 2) / (2 * 0.08**2)),
        "Resp": F.sin(pi2 * F.col("_breath") * t),
        "EDA": 5.0 + 0.002 * t + 0.4 * F.exp(-((F.pmod(t, F.lit(20.0)) - 8.0) ** 2) / (2 * 1.2**2)),
        "Temp": 33.0 + 0.2 * F.sin(pi2 * t / 300),
    }
    jitters = {"ECG": 0.01, "PPG": 0.01, "Resp": 0.02, "EDA": 0.002, "Temp": 0.002}
    wave = jitter = F
    for m in MODALITY_RATE:
        wave, jitter = wave.when(F.col("modality") == m, waves[m]), jitter.when(F.col("modality") == m, jitters[m])
    return rows.select("subject_id", "modality", "fs", "idx", (wave + jitter * noise("subject_id", "idx", "modality")).alias("value"))


#: The multipliers of the 64-bit hash that Spark's ``xxhash64`` is.
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def _u(x: int) -> np.uint64:
    return np.uint64(x & (1 << 64) - 1)


def _turned(h: np.ndarray, bits: int, factor: int, plus: int = 0) -> np.ndarray:
    return ((h << _u(bits)) | (h >> _u(64 - bits))) * _u(factor) + _u(plus)


def _mixed(h: np.ndarray) -> np.ndarray:
    for bits, factor in ((33, _P2), (29, _P3)):
        h = (h ^ (h >> _u(bits))) * _u(factor)
    return h ^ (h >> _u(32))


def noise_values(first: int, idx: np.ndarray, word: str, seed: int = 0) -> np.ndarray:
    """``noise`` of a first column whose ``xxhash64`` is ``first``, positions ``idx`` and a word of under eight bytes."""
    out = np.empty(len(idx))
    for at in range(0, len(idx), 1 << 13):  # blocks that stay near the processor
        own = idx[at : at + (1 << 13)].astype(np.uint64)
        h = _mixed(_turned(_u(first + _P5 + 8) ^ _turned(own * _u(_P2), 31, _P1), 27, _P1, _P4))
        left = word.encode()
        h = h + _u(_P5 + len(left))
        if len(left) >= 4:
            h, left = _turned(h ^ _u(int.from_bytes(left[:4], "little") * _P1), 23, _P2, _P3), left[4:]
        for byte in left:
            h = _turned(h ^ _u(byte * _P5), 11, _P1)
        h = _mixed(h) + _u(_P5 + 4)
        total, a, b = np.zeros(len(own), np.uint64), np.empty_like(h), np.empty_like(h)
        for k in range(12):  # the number seed * 100 + k goes in last: in place, for these are most of the work
            np.bitwise_xor(h, _u((seed * 100 + k) * _P1), out=a)
            np.bitwise_or(np.left_shift(a, _u(23), out=b), np.right_shift(a, _u(41), out=a), out=a)
            np.add(np.multiply(a, _u(_P2), out=a), _u(_P3), out=a)
            for bits, factor in ((33, _P2), (29, _P3)):
                np.multiply(np.bitwise_xor(a, np.right_shift(a, _u(bits), out=b), out=a), _u(factor), out=a)
            np.bitwise_xor(a, np.right_shift(a, _u(32), out=b), out=a)
            np.add(total, np.bitwise_and(a, _u((1 << 30) - 1), out=a), out=total)
        out[at : at + (1 << 13)] = total.astype(float) / (1 << 30) - 6.0
    return out


def series(spark: SparkSession, subjects: int | DataFrame = 1, seconds: int = 120, heart_hz: float = 1.2, breath_hz: float = 0.25, modalities: tuple[str, ...] = tuple(MODALITY_RATE)) -> DataFrame:
    """The series of ``physiology``, a row each (subject_id, modality, fs and what its values hang on), a subject's one after the other.

    ``made_series`` makes their values in the task of the kernel that takes them, so that
    no row per sample is made, nor handed to Python.
    """
    people = _subjects(spark, subjects)
    rate = lambda name, value: F.col(name) if name in people.columns else F.lit(value)
    people = spread(people.select("subject_id", rate("heart_hz", heart_hz).alias("heart"), rate("breath_hz", breath_hz).alias("breath")), ["subject_id"])
    kinds = F.array(*[F.struct(F.lit(m).alias("modality"), F.lit(MODALITY_RATE[m]).alias("fs")) for m in modalities])
    rows = people.withColumn("kind", F.explode(kinds))
    return rows.select("subject_id", "kind.modality", "kind.fs", F.lit(seconds).alias("seconds"), "heart", "breath", F.xxhash64("subject_id").alias("hash"))


def made_series(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, np.ndarray]]:
    """(subject, modality), rate and values of one series after the other of the rows of ``series``."""
    for batch in batches:
        for row in batch.to_pylist():
            m, fs, breath = row["modality"], row["fs"], row["breath"]
            idx, pi2 = np.arange(fs * row["seconds"]), 2 * math.pi
            t = idx / fs
            if m in ("ECG", "PPG"):
                beat = np.fmod(t + 0.02 * np.sin(pi2 * breath * t), 1 / row["heart"])
                beat = np.where(beat < 0, np.fmod(beat + 1 / row["heart"], 1 / row["heart"]), beat)
            if m == "ECG":
                wave, jitter = np.exp(-((beat - 0.3) ** 2) / (2 * 0.012**2)) + 0.15 * np.exp(-((beat - 0.55) ** 2) / (2 * 0.04**2)), 0.01
            elif m == "PPG":
                wave, jitter = np.exp(-((beat - 0.55) ** 2) / (2 * 0.08**2)), 0.01
            elif m == "Resp":
                wave, jitter = np.sin(pi2 * breath * t), 0.02
            elif m == "EDA":
                wave, jitter = 5.0 + 0.002 * t + 0.4 * np.exp(-((np.fmod(t, 20.0) - 8.0) ** 2) / (2 * 1.2**2)), 0.002
            else:
                wave, jitter = 33.0 + 0.2 * np.sin(pi2 * t / 300), 0.002
            yield (row["subject_id"], m), fs, wave + jitter * noise_values(row["hash"], idx, m)
