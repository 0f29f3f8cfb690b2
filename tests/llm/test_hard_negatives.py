import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives as op

SCHEMA = "vec_id long, embedding array<float>, label int, Score string"


def brute(rows, every=50, positives=5, negatives=3):
    own = {}
    for i, v, label, *_ in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            one = (label, [math.floor(256 * float(np.float32(x))) for x in v])
            own[i] = min(own.get(i, one), one)
    out = []
    for a, (label, q) in own.items():
        if a % every:
            continue
        score = {b: sum(x * y for x, y in zip(q, p, strict=False)) for b, (_, p) in own.items() if b != a}
        first = sorted((b for b in score if own[b][0] == label), key=lambda b: (-score[b], b))[:positives]
        for p in first:
            below = sorted((b for b in score if own[b][0] != label and 50 * score[p] <= 100 * score[b] <= 95 * score[p]), key=lambda b: (-score[b], b))[:negatives]
            out += [(a, p, k, b, score[p], score[b]) for k, b in enumerate(below, 1)]
    return sorted(out)


def mined(spark, rows, **options):
    got = op.mine(spark.createDataFrame(rows, SCHEMA), **options)
    assert got.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    return sorted(map(tuple, got.collect()))


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 24)) * np.linspace(2, 0.1, 24)
    rows = [(n, [float(x) for x in centres[n % 6] + rng.normal(size=24) * 0.3], int(rng.integers(0, 3)), "x") for n in range(1500)]
    want = brute(rows)
    assert mined(spark, rows) == want and len(want) > 300


def test_a_vector_of_a_third_of_all_rows_ties_and_repeats(spark):
    rng = np.random.default_rng(6)
    rows = [(n, [1.0, 0.5, 0.25] if n % 3 == 0 else [float(x) for x in rng.integers(-3, 4, 3) / 4], n % 4, "x") for n in range(900)]
    rows += rows[:40] + [(100, [0.5, 0.5, 0.5], 9, "an id with another vector"), (150, [2.0, 0.0, 0.0], 0, "the same")]
    want = brute(rows)
    assert mined(spark, rows) == want and mined(spark, rows, shares=1) == want and len(want) > 100


def test_what_takes_no_part_and_odd_vectors(spark):
    rows = [(0, [1.0, 1.0], 1, "a"), (1, [1.0, 1.0], 1, "a"), (2, [1.0, 0.5], 2, "a"), (3, [1.0, 0.4], None, "a"), (None, [1.0, 0.4], 2, "a"), (4, None, 2, "a"), (5, [float("nan"), 1.0], 2, "a")]
    rows += [(6, [float("inf"), 1.0], 2, "a"), (7, [None, 1.0], 2, "a"), (8, [1.0], 2, "short"), (9, [0.6, 0.7, 5.0], 3, "long"), (10, [], 3, "empty"), (50, [], 3, "empty"), (100, [-1.0, -1.0], 7, "alone"), (-50, [0.5], 1, "a")]
    want = brute(rows)
    assert mined(spark, rows) == want and {r[0] for r in want} >= {0, 50, -50}
    assert mined(spark, [r for r in rows if r[0] is None]) == []
    with pytest.raises(Exception, match="longer than"):
        mined(spark, [(0, [3e9], 1, "a"), (1, [1.0], 1, "a")])


def test_bounds_hold_and_discard():
    rng = np.random.default_rng(7)
    q = np.floor(256 * rng.normal(size=(400, 32)) * np.linspace(1, 0.02, 32))
    rotation = op.Rotation(q.T @ q)
    a, b = q[:50], q[50:]
    exact = a @ b.T
    need = np.sort(exact, axis=1)[:, -4]
    allowed = np.ones(exact.shape, bool)
    i, j = op.survivors(rotation, rotation.turn(a), rotation.turn(b), allowed, need, np.full(50, np.inf), 0)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(x, y) for x, y in np.argwhere(exact >= need[:, None]).tolist()}
    i, j = op.survivors(rotation, rotation.turn(a), rotation.turn(b), allowed, np.full(50, -np.inf), np.full(50, np.inf), 4)
    assert len(i) == 200 and (op.products(a.astype("i8"), b.astype("i8"), i, j) >= need[i]).all()
    assert rotation.stages[0] < 16 and len(rotation.stages) > 2


def test_label_override_and_parameters(spark):
    rows = [(n, [1.0 + n / 100, 0.3], n % 2, "x") for n in range(60)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = op.mine(frame, label=F.col("label") * 0 + F.when(F.col("vec_id") < 30, 1).otherwise(2), anchor="id = 20", positives=2, negatives=4, low_percent=0, high_percent=100).collect()
    assert {(r.positive_id, r.rank) for r in got} == set() or all(r.negative_id >= 30 and r.negative_score <= r.positive_score for r in got)
