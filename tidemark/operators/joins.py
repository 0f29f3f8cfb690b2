"""Joins between series, segments and point events.

Each carries an equality on the subject, and range conditions an equality on a time
bin or one order of time besides: hash or sort-merge joins and windows, never products
of what one subject has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def segments_from_boundaries(boundaries: DataFrame, lengths: DataFrame, keys: list[str]) -> DataFrame:
    """seg, start and end (half-open) of every series in ``lengths`` (keys, n) cut at ``boundaries`` (keys, cp)."""
    starts = lengths.select(*keys, F.lit(0).alias("start")).unionByName(boundaries.select(*keys, F.col("cp").cast("int").alias("start")))
    w = Window.partitionBy(*keys).orderBy("start")
    # A table of the cohort's series or segments is never broadcast: its file is many times smaller than its rows in memory.
    rows = starts.hint("merge").join(lengths, keys).withColumns({"seg": F.row_number().over(w) - 1, "end": F.coalesce(F.lead("start").over(w), F.col("n").cast("int"))})
    return rows.select(*keys, "seg", "start", "end")


def events_by_segment(segments: DataFrame, times: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """``segments`` with t0, t1 and ``events``: names of the events in [t0, t1], in order of time, duplicates kept.

    ``times``: keys, w, t of the windows; ``events``: keys, t, name.  The bounds are
    the centres of the first and last window, so an event in the step between two
    segments, or before the first centre, belongs to none.
    """
    first = times.select(*keys, F.col("w").alias("start"), F.col("t").alias("t0"))
    last = times.select(*keys, (F.col("w") + 1).alias("end"), F.col("t").alias("t1"))
    # Sizes of generated rows are guessed too low: no side may be broadcast for that, a merge keeps to what memory there is.
    spans = segments.join(first.hint("merge"), [*keys, "start"]).join(last.hint("merge"), [*keys, "end"])
    hit = covering(events.select(*keys, F.col("t").cast("double").alias("_t"), F.col("name").alias("_name")), spans.select(*keys, "t0", "t1", "seg"), keys, "_t", "t0", "t1", ["seg"])
    lists = hit.groupBy(*keys, "seg").agg(F.transform(F.sort_array(F.collect_list(F.struct("_t", "_name"))), lambda x: x["_name"]).alias("events"))
    return spans.join(lists.hint("merge"), [*keys, "seg"], "left").withColumn("events", F.coalesce("events", F.array().cast("array<string>")))


def covering(points: DataFrame, spans: DataFrame, keys: list[str], at: str, low: str, high: str, columns: list[str]) -> DataFrame:
    """``points`` that lie in one of the spans [low, high] of their series, with its ``columns``; spans of a series do not overlap.

    Points and spans are put in one order of time; the span that began last is the only
    one that can hold a point.  A series is sorted once, whatever it has of both.  A
    point on the end of one span and the start of the next belongs to the next.
    """
    own = [c for c in points.columns if c not in keys]
    span = F.struct(F.col(low).alias("low"), F.col(high).cast("double").alias("high"), *[F.col(c) for c in columns])
    begun = spans.where(F.col(low).isNotNull() & F.col(high).isNotNull()).select(*keys, F.col(low).cast("double").alias("_at"), F.lit(0).alias("_kind"), span.alias("_span"))
    both = points.withColumns({"_at": F.col(at).cast("double"), "_kind": F.lit(1)}).unionByName(begun, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_span", F.last("_span", True).over(order)).where("_kind = 1 AND _at <= _span.high")
    return found.select(*keys, *own, *[F.col(f"_span.{c}").alias(c) for c in columns])


def within(points: DataFrame, spans: DataFrame, keys: list[str], at: str, low: str, high: str, width: float) -> DataFrame:
    """Every point joined with every span [low, high) that holds it; spans may overlap and are ``width`` long at most.

    The join is on equality of the series *and* of a time bin ``width`` long: a span
    lies in two bins at most and is copied into both, a point lies in one.  So a point
    meets the spans around it, not all of its series.
    """
    bin_of = lambda c: F.floor(c / float(width)).cast("long")
    cut = spans.where(F.col(high) > F.col(low)).withColumn("_bin", F.explode(F.sequence(bin_of(F.col(low)), bin_of(F.col(high)))))
    return points.withColumn("_bin", bin_of(F.col(at))).join(cut, [*keys, "_bin"]).where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_bin")


def affective(df: DataFrame, names: tuple[str, ...] | list[str], events: str = "events", out: str = "is_event") -> DataFrame:
    """Whether any event of a row is one of ``names``."""
    return df.withColumn(out, F.coalesce(F.arrays_overlap(events, F.array(*[F.lit(n) for n in names])), F.lit(False)))


def merge_event_names(df: DataFrame, aliases: dict[str, str], events: str = "events", out: str = "merged") -> DataFrame:
    """Canonical event names, the first of each kept in its place."""
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return df.withColumn(out, F.array_distinct(F.transform(events, lambda n: F.coalesce(F.element_at(table, n), n))))


def pairs(df: DataFrame, keys: list[str], item: str, columns: list[str]) -> DataFrame:
    """Every pair i < j of items of one series, with ``columns`` of both (suffixes _i and _j)."""
    left = df.select(*keys, F.col(item).alias(f"{item}_i"), *[F.col(c).alias(f"{c}_i") for c in columns])
    right = df.select(*keys, F.col(item).alias(f"{item}_j"), *[F.col(c).alias(f"{c}_j") for c in columns])
    return left.join(right, keys).where(F.col(f"{item}_i") < F.col(f"{item}_j"))


def first_peak_after(beats: DataFrame, samples: DataFrame, keys: list[str], fs: int, low: float = 0.1, high: float = 0.5, least: int = 10) -> DataFrame:
    """Transit time in ms from each beat (keys, beat idx) to the highest sample in the window after it.

    The window is [beat + low, min(beat + high, next beat)) in seconds; it must hold
    three samples, the first of equal maxima counts, the last beat has no window, and
    series with ``least`` hits or fewer have none.
    """
    w = Window.partitionBy(*keys).orderBy("beat")
    spans = beats.withColumn("_next", F.lead("beat").over(w)).where("_next IS NOT NULL")
    spans = spans.withColumns({"_a": F.col("beat") + int(low * fs), "_b": F.least(F.col("beat") + int(high * fs), F.col("_next"))})
    found = within(samples.select(*keys, F.col("idx").alias("_i"), F.col("value").alias("_v")), spans, keys, "_i", "_a", "_b", max(1, int(high * fs)))
    best = found.groupBy(*keys, "beat").agg(F.count("_v").alias("n"), F.max_by("_i", F.struct("_v", -F.col("_i"))).alias("peak")).where("n >= 3")
    best = best.withColumn("ptt", (F.col("peak") - F.col("beat")) * 1000.0 / fs).where(F.col("ptt").between(low * 1000, high * 1000))
    enough = best.groupBy(*keys).count().where(F.col("count") > least).select(*keys)
    return best.join(enough, keys, "left_semi").select(*keys, "beat", "peak", "ptt")


def align_by_position(features: DataFrame, quality: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``features`` (keys, w, from 0) with ``q``: the quality series (keys, k from 0, q) of any length, linearly interpolated at equal relative position.

    One join: a series' qualities travel as one array, of as many entries as it has
    quality windows.  Series without quality are left out, or have a NULL q (``how`` left).
    """
    series = quality.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "q"))), lambda x: x["q"]).alias("_q"))
    rows = features.join(series, keys, how).withColumn("_T", F.max("w").over(Window.partitionBy(*keys)))
    rows = rows.withColumn("_at", F.when(F.col("_T") > 0, F.col("w") * (F.size("_q") - 1) / F.col("_T")).otherwise(0.0))
    low, high = F.floor("_at").cast("int"), F.least(F.ceil("_at").cast("int"), F.size("_q") - 1)
    line = F.col("_q")[low] + (F.col("_q")[high] - F.col("_q")[low]) * (F.col("_at") - low)
    return rows.withColumn("q", line).drop("_q", "_T", "_at")


def expand_labels(records: DataFrame, keys: list[str], position: str, flag: str, offsets: list[int], out: str = "y") -> DataFrame:
    """``records`` with 1 where a flagged row stands at a distance of one of ``offsets`` before it, else 0."""
    marks = records.where(F.col(flag)).select(*keys, F.explode(F.array(*[F.col(position) + o for o in offsets])).alias(position)).distinct().withColumn(out, F.lit(1))
    return records.join(marks, [*keys, position], "left").withColumn(out, F.coalesce(out, F.lit(0)))


def expand_to_rows(segments: DataFrame, rows: DataFrame, keys: list[str], score: str) -> DataFrame:
    """``rows`` (keys, w) with the score of the segment that covers w; NULL where none does."""
    spread = segments.where(F.col("end") > F.col("start")).select(*keys, F.explode(F.sequence(F.col("start").cast("long"), F.col("end").cast("long") - 1)).alias("w"), score)
    return rows.join(spread, [*keys, "w"], "left")


def paired_ratings(ratings: DataFrame, before: str, after: str, also: Sequence[str] = ()) -> DataFrame:
    """subject, emotion, before and after: complete numeric pairs; names match without regard to case and outer blanks.

    Numeric columns in ``also`` come along as before_<name> and after_<name>.
    """
    number = lambda c: F.expr(f"try_cast({c} AS double)").alias(c)
    clean = ratings.select(F.col("subject"), F.lower(F.trim("emotion")).alias("emotion"), F.lower(F.trim("condition")).alias("condition"), number("rating"), *map(number, also))
    side = lambda name, c: F.max(F.when(F.col("condition") == name.strip().lower(), F.col(c)))
    one = clean.groupBy("subject", "emotion").agg(
        side(before, "rating").alias("before"), side(after, "rating").alias("after"), *[side(n, c).alias(f"{out}_{c}") for c in also for n, out in ((before, "before"), (after, "after"))]
    )
    return one.where("before IS NOT NULL AND after IS NOT NULL")
