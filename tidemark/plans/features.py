"""The nineteen windowed features of a session, and their normalised table."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dsp
from tidemark.operators import frames
from tidemark.schema import CLIP_RANGES, FEATURE_MODALITY
from tidemark.sources import synthetic

_RAW = "w long, t double, feature string, raw double"
_RAW_TABLE = pa.schema({"subject_id": pa.string(), "w": pa.int64(), "t": pa.float64(), "feature": pa.string(), "raw": pa.float64()})


def _windows(x: np.ndarray, fs: float, window: float, step: float, how) -> tuple[np.ndarray, np.ndarray]:
    size, hop = int(window * fs), max(1, int(step * fs))
    if len(x) < size or size < 1:
        return np.zeros(0), np.zeros(0)
    parts = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
    centres = (np.arange(len(parts)) * hop + size / 2) / fs
    values = np.full(len(parts), np.nan)
    whole = bool(np.isfinite(x).all())
    how = {np.nanmean: np.mean, np.nanstd: np.std}.get(how, how) if whole else how  # the same numbers without looking for missing ones
    block = max(1, (1 << (16 if whole else 21)) // size)  # windows overlap: some 16 MB of copies at a time, or what stays near the processor
    for at in range(0, len(parts), block):
        own = parts[at : at + block]
        if whole:
            values[at : at + block] = how(own, axis=1)
            continue
        enough = np.isfinite(own).sum(axis=1) >= int(0.5 * size)
        if enough.any():
            values[at : at + block][enough] = how(own[enough], axis=1)
    return centres, values


def _per_second(t: np.ndarray, x: np.ndarray, seconds: float) -> np.ndarray:
    ok = np.isfinite(x)
    return np.interp(np.arange(int(seconds)), t[ok], x[ok]) if ok.any() else np.full(int(seconds), np.nan)


def _ecg(x: np.ndarray, fs: int, peaks: np.ndarray, window: float, step: float) -> dict:
    if len(peaks) < 10:
        raise ValueError("under ten heart beats in the ECG")
    found = dsp.hrv(peaks, fs, window, step)
    t = found.pop("t")
    rate = _per_second(peaks[:-1] / fs, 60000 / dsp.intervals(peaks, fs), len(x) / fs)
    return {name: (t, values) for name, values in found.items()} | {"Inst HR": _windows(rate, 1, window, step, np.nanmean)}


def _ppg(x: np.ndarray, fs: int, beats: np.ndarray, beat_fs: int, window: float, step: float) -> dict:
    peaks, seconds = dsp.ppg_peaks(x, fs), len(x) / fs
    if len(peaks) < 3:
        return {}
    rate = _per_second(peaks[:-1] / fs, 60 * fs / np.diff(peaks), seconds)
    height = np.interp(np.arange(len(x)), peaks, np.abs(x[peaks]))
    out = {"Pulse Rate": _windows(rate, 1, window, step, np.nanmean), "PAV": _windows(height, fs, window, step, np.nanstd)}
    hits, beats = [], beats * fs // beat_fs
    for beat, after in zip(beats, beats[1:]):
        end = min(beat + int(0.5 * fs), len(x), after)
        begin = beat + int(0.1 * fs)
        if end - begin >= 3:
            delay = (begin + int(np.argmax(x[begin:end])) - beat) / fs
            if 0.1 <= delay <= 0.5:
                hits.append((beat / fs, 1000 * delay))
    if len(hits) > 10:
        at, delay = np.array(hits).T
        out["PTT"] = _windows(_per_second(at, delay, seconds), 1, window, step, np.nanmean)
    return out


def _resp(x: np.ndarray, fs: int, window: float, step: float) -> dict:
    peaks, troughs = dsp.breaths(x, fs)
    seconds = len(x) / fs
    if len(peaks) < 3 or len(troughs) < 3:
        return {}
    slow = _per_second(troughs[1:] / fs, 60 * fs / np.diff(troughs), seconds)
    quick = _per_second(peaks[:-1] / fs, 60 * fs / np.diff(peaks), seconds)
    low = np.interp(peaks, troughs, x[troughs])
    volume = _per_second(peaks[1:] / fs, (x[peaks] - low)[1:] * fs / np.diff(peaks), seconds)
    return {name: _windows(v, 1, window, step, np.nanmean) for name, v in (("Breath Rate", slow), ("RVT", volume), ("Inst Breath Rate", quick))}


def _eda(x: np.ndarray, fs: int, window: float, step: float, tonic: str = "mean") -> dict:
    size = int(4 * fs) | 1
    if tonic == "high-pass":
        tonic = dsp.tonic_by_high_pass(x, fs)
    else:
        tonic = dsp.moving_mean(np.pad(x, size // 2, mode="symmetric"), size)[size // 2 : size // 2 + len(x)] if len(x) > size else x
    phasic = x - tonic
    peaks = dsp.scr_peaks(phasic, fs)
    marks = np.zeros(len(x))
    marks[peaks] = 1
    out = {"SCL": _windows(tonic, fs, window, step, np.nanmean), "SCR Freq": _windows(marks, fs, window, step, np.sum), "Phasic Amp": _windows(np.abs(phasic), fs, window, step, np.nanmean)}
    rises = dsp.rise_times(phasic, peaks, fs)
    if len(peaks) > 2 and np.isfinite(rises).sum() > 3:
        out["SCR Rise Time"] = _windows(_per_second(peaks / fs, rises, len(x) / fs), 1, window, step, np.nanmean)
    return out


def _temp(x: np.ndarray, fs: int, window: float, step: float) -> dict:
    return {"Skin Temp": _windows(x, fs, window, step, np.nanmean), "dSkin Temp": _windows(np.gradient(x, 1 / fs) if len(x) > 1 else x, fs, window, step, np.nanmean)}


def session_features(signals: dict[str, tuple[int, np.ndarray]], window: float = 30.0, step: float = 1.0, tonic: str = "mean") -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Features by name, each with its window centres, from the raw signals (rate, values) of one session.

    ``tonic``: how the slow part of skin conductance is taken, by a moving ``mean`` or a ``high-pass``.
    """
    clean = {m: (fs, dsp.denoise(x, fs, m, CLIP_RANGES[m])) for m, (fs, x) in signals.items()}
    out: dict = {}
    beats = dsp.r_peaks(clean["ECG"][1], clean["ECG"][0]) if "ECG" in clean and len(clean["ECG"][1]) else np.zeros(0, int)
    if "ECG" in clean:
        out |= _ecg(clean["ECG"][1], clean["ECG"][0], beats, window, step)
    if "PPG" in clean:
        fs, x = clean["PPG"]
        out |= _ppg(x, fs, beats, clean["ECG"][0] if "ECG" in clean else fs, window, step)
    if "Resp" in clean:
        out |= _resp(clean["Resp"][1], clean["Resp"][0], window, step)
    if "EDA" in clean:
        out |= _eda(clean["EDA"][1], clean["EDA"][0], window, step, tonic)
    if "Temp" in clean:
        out |= _temp(clean["Temp"][1], clean["Temp"][0], window, step)
    return out


def raw_features(samples: DataFrame, window: float = 30.0, step: float = 1.0, together: bool = False, made: bool = False) -> DataFrame:
    """subject_id, w, t, feature, raw: one session is one task's memory (its signals are some tens of MB).

    ``together`` as in ``in_order``, with a subject's modalities one after the other, as ``physiology`` makes them.
    ``made``: ``samples`` are the rows of ``synthetic.series``, whose values are made on the spot.
    """

    def table(subject: str, signals: dict[str, tuple[int, np.ndarray]]) -> pa.Table:
        parts = [pa.table([[subject] * len(v), np.arange(len(v)), t, [name] * len(v), pa.array(v, pa.float64(), from_pandas=True)], _RAW_TABLE) for name, (t, v) in session_features(signals, window, step).items()]
        return pa.concat_tables(parts) if parts else _RAW_TABLE.empty_table()

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        found = synthetic.made_series(batches) if made else frames.whole_series(batches, keys, together)
        for subject, own in itertools.groupby(found, lambda one: one[0][0]):
            yield table(subject, {key[1]: (fs, x) for key, fs, x in own})

    keys = ["subject_id", "modality"]
    return (samples if made else frames.in_order(samples, keys, together)).mapInArrow(lambda batches: frames.gathered(tables(batches)), f"subject_id string, {_RAW}")


def feature_table(raw: DataFrame) -> DataFrame:
    """The normalised table: cut to the shortest feature, without constant or sparse features, in [0, 1], gaps filled."""
    keys = ["subject_id", "feature"]
    rows = frames.truncate_to_shortest(raw, ["subject_id"])
    rows = frames.robust_normalise(frames.drop_constant(rows, keys, "raw"), keys, "raw", "norm")
    rows = frames.gap_fill(frames.drop_sparse(rows, keys, "norm"), keys, "w", "norm", "filled")
    return with_modality(rows).select("subject_id", "w", "t", "feature", "modality", "raw", F.col("filled").alias("norm"))


def with_modality(rows: DataFrame) -> DataFrame:
    """``rows`` with the modality of their feature, NULL for a feature that is none of the nineteen."""
    table = F.create_map(*[F.lit(x) for pair in FEATURE_MODALITY.items() for x in pair])
    return rows.withColumn("modality", F.try_element_at(table, F.col("feature")))


def vectors(features: DataFrame, keys: list[str], value: str = "norm") -> DataFrame:
    """keys, w and x: the features of a window as one array, in the order of their names."""
    return features.groupBy(*keys, "w").agg(F.transform(F.sort_array(F.collect_list(F.struct("feature", F.col(value).alias("v")))), lambda s: s["v"]).alias("x"))
