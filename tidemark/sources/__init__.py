"""Readers of recordings, event stamps, ratings, cohort records and cached results; a store for scored sessions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.schema import MODALITY_CHANNEL, MODALITY_RATE, SAMPLES
from tidemark.sources.workbook import cell, read_workbook
from tidemark.storage import publish, written

STAMPS = "subject_id string, event string, year int, month int, day int, hour int, minute int, second int"
NULLS = "obs_aff_mean double, obs_non_mean double, p_pooled double, r_rb_pooled double, null_aff array<double>, phase_tests map<string, struct<null: array<double>, obs_aff: double, obs_other: double, p: double, r_rb: double>>"
ABLATION = "modality string, event string, mean_auc double, per_subj_sids array<string>, per_subj_aucs array<double>"
TRAJECTORIES = "modality string, offsets array<int>, scores array<double>"
DIRECTIONS = "feature string, deltas array<double>"
RECORDS = "subject string, group string, seg_idx int, events array<string>, in_experiment boolean, consensus double, dtw double, rulsif double, cohens_d double"


def read_recordings(spark: SparkSession, path: str, header_lines: int = 20) -> DataFrame:
    """Text recordings, a file per subject: subject_id, row_idx, channel (from 1) and value.

    Lines after the header are split at white space; what is no number, or missing in
    a short line, is NULL, also in lines before a channel first appears.  Lines are
    numbered within their file by the byte order in which Spark reads them, so files
    of any size are split.  The files are read once, here: the lines of a block follow
    one another in the task that reads it, and are written with their place.
    """
    cells = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "").alias("cells")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), cells)
    lines = written(lines, "recording-lines")
    parts = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    subject = F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("subject_id")  # of a block, not of each line: a search through the path is slow
    base = parts.select("file", "block", subject, (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first")).alias("base"))
    numbered = lines.join(base, ["file", "block"]).withColumn("line", F.col("base") + F.col("n"))
    rows = numbered.where(F.col("line") >= header_lines).select("subject_id", (F.col("line") - header_lines).alias("row_idx"), "cells")
    width = rows.groupBy("subject_id").agg(F.max(F.size("cells")).alias("width"))
    rows = rows.join(width, "subject_id").where("width > 0")
    cell = rows.select("subject_id", "row_idx", "cells", F.explode(F.sequence(F.lit(1), F.col("width"))).alias("channel"))
    return cell.select("subject_id", "row_idx", "channel", F.expr("nullif(try_cast(try_element_at(cells, channel) AS double), double('NaN'))").alias("value"))


def write_recordings(recording: DataFrame, folder: str, header_lines: int = 20) -> DataFrame:
    """Text recordings, a file per subject, from subject_id, row_idx, channel (from 1) and value; subject_id and path of the files.

    A recording is one task's; what is missing at the end of a line is left out, and
    elsewhere written ``NaN``.
    """

    def run(table: pa.Table) -> pa.Table:
        subject = table.column("subject_id")[0].as_py()
        lines: dict[int, dict[int, float]] = {}
        for row, channel, value in zip(*(table.column(c).to_pylist() for c in ("row_idx", "channel", "value")), strict=True):
            lines.setdefault(row, {})[channel] = value
        path = f"{folder}/{subject}.txt"

        def fill(out) -> None:
            out.write(b"".join(b"# header\n" for _ in range(header_lines)))
            for _, cells in sorted(lines.items()):
                width = max((c for c, v in cells.items() if v is not None), default=0)
                out.write((" ".join("NaN" if cells.get(c) is None else repr(cells[c]) for c in range(1, width + 1)) + "\n").encode())

        publish(path, fill)
        return pa.table({"subject_id": [subject], "path": [path]})

    return recording.select(F.col("subject_id").cast("string"), F.col("row_idx").cast("long"), F.col("channel").cast("int"), F.col("value").cast("double")).groupBy("subject_id").applyInArrow(run, "subject_id string, path string")


def modality_samples(recording: DataFrame, raw_rate: int = 2000, window: DataFrame | None = None) -> DataFrame:
    """samples of the five modalities at their working rates; ``window`` (subject_id, t0, t1) clips the session first."""
    rows = recording
    if window is not None:
        rows = rows.join(window, "subject_id").where((F.col("row_idx") >= F.floor(F.col("t0") * raw_rate)) & (F.col("row_idx") < F.floor(F.col("t1") * raw_rate)))
        rows = rows.withColumn("row_idx", F.col("row_idx") - F.floor(F.col("t0") * raw_rate))
    table = F.create_map(*[x for m, c in MODALITY_CHANNEL.items() for x in (F.lit(c), F.struct(F.lit(m).alias("modality"), F.lit(MODALITY_RATE[m]).alias("fs")))])
    rows = rows.withColumn("_m", F.try_element_at(table, F.col("channel"))).where("_m IS NOT NULL")
    factor = (F.lit(raw_rate) / F.col("_m.fs")).cast("long")
    return rows.where(F.col("row_idx") % factor == 0).select("subject_id", "_m.modality", "_m.fs", F.floor(F.col("row_idx") / factor).cast("long").alias("idx"), "value")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples of modalities from Parquet tables, also with a folder per subject: subject_id, modality, fs, idx and value."""
    return spark.read.schema(SAMPLES).parquet(path)


def save_samples(samples: DataFrame, path: str) -> None:
    """Store samples as ``save_scored`` does sessions: a subject's rows together, in order, in one of a few files."""
    rows = samples.select(*SAMPLES.fieldNames()).repartition("subject_id")
    rows.sortWithinPartitions("subject_id", "modality", "idx").write.mode("overwrite").parquet(path)


def read_artifact_labels(spark: SparkSession, path: str) -> DataFrame:
    """subject_id, idx and flag from CSV files of labels (1: artifact) by sample."""
    rows = spark.read.csv(path, header=True, schema="subject_id string, idx long, label int")
    return rows.select("subject_id", "idx", (F.col("label") == 1).alias("flag"))


def read_stamps(spark: SparkSession, path: str) -> DataFrame:
    """Event stamps from CSV files with a header: subject_id, event, year, month, day, hour, minute and second."""
    return spark.read.csv(path, header=True, schema=STAMPS)


def read_stamps_workbook(spark: SparkSession, path: str) -> DataFrame:
    """Event stamps from workbooks with a sheet per subject, whose columns are Event, Year, Month, Day, Hour, Minute and Second in any order.

    Sheets of one name in several workbooks are one subject's; a cell that is no number is missing.
    """
    parts = ("year", "month", "day", "hour", "minute", "second")
    return read_workbook(spark, path).select(F.col("sheet").alias("subject_id"), cell("event").alias("event"), *[cell(p).try_cast("double").cast("int").alias(p) for p in parts])


def relative_stamps(stamps: DataFrame, origin: str = "Data Start", shift: str | None = "Video Start") -> DataFrame:
    """subject_id, event and t in seconds after ``origin`` (after ``shift`` too, and not before it, where that is given).

    ``stamps``: subject_id, event, year, month, day, hour, minute, second; missing clock parts are 0.
    """
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    at = stamps.withColumn("ts", F.make_timestamp_ntz(F.col("year"), F.col("month"), F.col("day"), z("hour"), z("minute"), z("second")))
    w = Window.partitionBy("subject_id")
    rows = at.withColumn("_o", F.max(F.when(F.col("event") == origin, F.col("ts"))).over(w))
    rows = rows.withColumn("t", F.timestamp_diff("SECOND", F.col("_o"), F.col("ts")).cast("double"))
    if shift is not None:
        rows = rows.withColumn("t", F.col("t") - F.max(F.when(F.col("event") == shift, F.col("t"))).over(w)).where("t >= 0")
    return rows.select("subject_id", "event", "t")


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """subject, emotion, condition and rating from CSV files of that header."""
    return spark.read.csv(path, header=True, schema="subject string, emotion string, condition string, rating string")


def read_ratings_workbook(spark: SparkSession, path: str) -> DataFrame:
    """subject, emotion, condition and rating from workbooks with a sheet per subject: a row per emotion, which its first column names, and a column per condition."""
    rows = read_workbook(spark, path).select(F.col("sheet").alias("subject"), F.col("cells")[0]["value"].alias("emotion"), F.explode(F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0)))).alias("c"))
    return rows.select("subject", "emotion", F.col("c.column").alias("condition"), F.col("c.value").alias("rating"))


def read_records(spark: SparkSession, path: str, group: str | None = None) -> DataFrame:
    """Cohort segment records from JSON lines; ``group`` tags them."""
    rows = spark.read.schema(RECORDS).json(path)
    return rows.withColumn("group", F.lit(group)) if group else rows


def read_null_distributions(spark: SparkSession, path: str) -> DataFrame:
    """side (pooled, or the name of a phase), n, the null's mean and largest difference, and the cached p and rank-biserial, from JSON lines of permutation results."""
    rows = spark.read.schema(NULLS).json(path)
    phase = F.transform(F.map_entries("phase_tests"), lambda e: F.struct(e["key"].alias("side"), e["value"]["null"].alias("null"), e["value"]["p"].alias("p"), e["value"]["r_rb"].alias("r")))
    whole = F.array(F.struct(F.lit("pooled").alias("side"), F.col("null_aff").alias("null"), F.col("p_pooled").alias("p"), F.col("r_rb_pooled").alias("r")))
    each = rows.select(F.explode(F.concat(whole, F.coalesce(phase, F.expr("array()").cast("array<struct<side:string,null:array<double>,p:double,r:double>>")))).alias("t"))
    mean = F.aggregate("t.null", F.lit(0.0), lambda a, x: a + x) / F.when(F.size("t.null") > 0, F.size("t.null"))
    return each.select("t.side", F.size("t.null").alias("n"), mean.alias("null_mean"), F.array_max("t.null").alias("null_max"), "t.p", "t.r")


def read_ablation(spark: SparkSession, path: str) -> DataFrame:
    """modality (NULL in a baseline's file), event, subject and auc from JSON lines of detection results by subject."""
    rows = spark.read.schema(ABLATION).json(path)
    return rows.select("modality", "event", F.explode(F.arrays_zip(F.col("per_subj_sids").alias("subject"), F.col("per_subj_aucs").alias("auc"))).alias("p")).select("modality", "event", "p.subject", "p.auc")


def read_trajectories(spark: SparkSession, path: str) -> DataFrame:
    """modality, off and score from JSON lines of event-locked trajectories."""
    rows = spark.read.schema(TRAJECTORIES).json(path)
    return rows.select("modality", F.explode(F.arrays_zip(F.col("offsets").alias("off"), F.col("scores").alias("score"))).alias("p")).select("modality", "p.off", "p.score")


def read_directions(spark: SparkSession, path: str) -> DataFrame:
    """feature and delta (its change at an event) from JSON lines."""
    return spark.read.schema(DIRECTIONS).json(path).select("feature", F.explode("deltas").alias("delta"))


def union_cohorts(cohorts: dict[str, DataFrame]) -> DataFrame:
    """All records, tagged with their cohort; columns that a cohort lacks are NULL."""
    tagged = [df.withColumn("group", F.lit(name)) for name, df in cohorts.items()]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def save_scored(df: DataFrame, path: str) -> None:
    """Store scored sessions by subject: each subject's rows are together in one of a few files, so one subject is found by the files' statistics.

    A folder per subject would be a file per subject and task, which a large cohort does not bear.
    """
    df.repartition("subject_id").sortWithinPartitions("subject_id").write.mode("overwrite").parquet(path)


def load_scored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
