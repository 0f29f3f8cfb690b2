"""From a feature table (or raw samples) to scored segments, end to end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import divergence, joins, rdi, segment, validate
from tidemark.plans.features import feature_table, raw_features, vectors
from tidemark.schema import AFFECTIVE
from tidemark.storage import written


@dataclass(frozen=True)
class Options:
    window: float = 30.0
    step: float = 1.0
    penalty: float = 1.0
    min_size: int = 10
    n_perm: int = 10_000
    seed: int = 42
    affective: tuple[str, ...] = AFFECTIVE
    methods: tuple[str, ...] = ("DTW", "RuLSIF", "Cohen's d")


@dataclass(frozen=True)
class Result:
    """Tables of a run.  Features, boundaries and segments are written to the shared folder by the run, so that the Python kernels behind them run once; the others are lazy."""

    features: DataFrame
    boundaries: DataFrame
    segments: DataFrame
    distances: DataFrame
    consensus: DataFrame
    events: DataFrame
    permutation: DataFrame


def segment_table(rows: DataFrame, keys: list[str], penalty: float, min_size: int) -> tuple[DataFrame, DataFrame]:
    """Change points, and segments (keys, seg, start, end), of a feature table's ``vectors`` (written ones: they are read twice); both are written."""
    cuts = written(segment.boundaries(rows, keys, [penalty], min_size), "boundaries")
    lengths = rows.groupBy(*keys).agg((F.max("w") + 1).cast("int").alias("n"))
    return cuts, written(joins.segments_from_boundaries(cuts, lengths, keys), "segments")


def all_distances(features: DataFrame, segments: DataFrame, keys: list[str], methods: tuple[str, ...], rows: DataFrame | None = None) -> DataFrame:
    """keys, seg_i < seg_j, method and d for the methods asked for; ``rows``: the ``vectors`` of the feature table, where they are at hand."""
    own = [m for m in methods if m != "Cohen's d"]
    out = divergence.pair_distances(divergence.segment_rows(vectors(features, keys) if rows is None else rows, segments, keys), keys, tuple(own)) if own else None
    if "Cohen's d" in methods:
        effect = divergence.effect_sizes(segment.segment_stats(features, segments, keys), keys)
        out = out.unionByName(effect) if out is not None else effect
    return out


def run_features(features: DataFrame, events: DataFrame, options: Options = Options()) -> Result:  # noqa: B008
    """Segments, distances, scores and the permutation test of every subject in a feature table."""
    keys = ["subject_id"]
    features = written(features, "features")
    rows = written(vectors(features, keys), "vectors")
    cuts, segments = segment_table(rows, keys, options.penalty, options.min_size)
    distances = all_distances(features, segments, keys, options.methods, rows)
    scored = rdi.score_segments(distances, segments, keys, options.methods)
    times = features.groupBy(*keys, "w").agg(F.min("t").alias("t"))
    placed = joins.affective(joins.events_by_segment(segments, times, events, keys), options.affective)
    units = scored.hint("merge").join(placed.select(*keys, "seg", "is_event"), [*keys, "seg"]).select(*keys, F.col("seg").alias("unit"), F.col("consensus").alias("score"), "is_event")
    return Result(features, cuts, segments, distances, scored, placed, validate.permutation_seeded(units, keys, options.n_perm, options.seed))


def run(samples: DataFrame, events: DataFrame, options: Options = Options(), together: bool = False, made: bool = False) -> Result:  # noqa: B008
    """The whole chain from raw samples (subject_id, modality, fs, idx, value) and point events (subject_id, t, name); ``together`` and ``made`` as in ``raw_features``."""
    return run_features(feature_table(raw_features(samples, options.window, options.step, together, made)), events, options)
