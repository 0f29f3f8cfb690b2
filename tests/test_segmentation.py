import subprocess
import sys
import time

import numpy as np
import pytest

from tidemark.operators import segment as sg


def plain_cost(x, model, **p):
    """Cost of a segment's rows, one at a time, by definition."""
    whole = x
    ranks = np.stack([[(c < v).sum() + ((c == v).sum() + 1) / 2 for v in c] for c in x.T], axis=1)
    ranks = ranks - ranks.mean(axis=0)

    def spread(rows):
        return ((rows - rows.mean(axis=0)) ** 2).sum()

    def cost(s, e):
        rows = whole[s:e]
        n = e - s
        if model == "rbf":
            d2 = ((whole[:, None] - whole[None]) ** 2).sum(-1)
            k = np.exp(-d2[s:e, s:e] / np.median(d2[np.triu_indices(len(whole), 1)]))
            return np.trace(k) - k.sum() / n
        if model == "l2":
            return spread(rows)
        if model == "l1":
            return np.abs(rows - np.median(rows, axis=0)).sum()
        if model == "normal":
            return n * np.linalg.slogdet(np.cov(rows.T, bias=True).reshape(x.shape[1], -1) + 1e-6 * np.eye(x.shape[1]))[1]
        if model == "linear":
            return ((rows[:, 0] - rows[:, 1:] @ np.linalg.lstsq(rows[:, 1:], rows[:, 0], rcond=1e-6)[0]) ** 2).sum()
        if model == "ar":
            k = p.get("order", 4)
            if n <= k:
                return 0.0
            design = np.column_stack([rows[k - j : n - j, 0] for j in range(1, k + 1)] + [np.ones(n - k)])
            return ((rows[k:, 0] - design @ np.linalg.lstsq(design, rows[k:, 0], rcond=1e-6)[0]) ** 2).sum()
        if model == "rank":
            mean = ranks[s:e].mean(axis=0)
            return -n * mean @ np.linalg.inv(np.atleast_2d(np.cov(ranks.T))) @ mean
        if model == "mahalanobis":
            inverse = p["metric"] if "metric" in p else np.linalg.inv(np.atleast_2d(np.cov(whole.T)))
            return sum(r @ inverse @ r for r in rows - rows.mean(axis=0))
        return spread(rows / np.linalg.norm(rows, axis=1, keepdims=True))

    return cost


def plain_cuts(cost, n, penalty, min_size, jump):
    """The programme over all starts, without pruning."""
    total, before = {0: 0.0}, {}
    for end in [e for e in range(0, n, jump) if e >= min_size] + [n]:
        best = None
        for s in [s for s in total if end - s >= min_size]:
            value = total[s] + cost(s, end) + penalty
            if best is None or value < best[0] - 1e-9:
                best = (value, s)
        if best:
            total[end], before[end] = best
    cuts, at = [], before.get(n, 0)
    while at:
        cuts.append(at)
        at = before[at]
    return cuts[::-1]


@pytest.mark.parametrize(("model", "p", "penalty"), [("rbf", {}, 1.0), ("l2", {}, 4.0), ("l1", {}, 4.0), ("normal", {}, 8.0), ("linear", {}, 3.0), ("ar", {}, 3.0), ("ar", {"order": 2}, 3.0), ("rank", {}, 4.0), ("mahalanobis", {}, 5.0), ("mahalanobis", {"metric": np.diag([1.0, 2.0, 0.5])}, 5.0), ("cosine", {}, 0.6)])
def test_models_against_their_definition(model, p, penalty):
    for seed in range(3):
        rng = np.random.default_rng(seed)
        x = np.concatenate([rng.normal(m, 0.6, (17, 3)) for m in (1, 3, 0.5, 2)]) @ np.array([[1, 0.3, 0], [0, 1, 0.2], [0, 0, 1.0]])
        cost, plain = sg.Cost(x, model, **p), plain_cost(x, model, **p)
        cost.begin()
        for end in (9, 30, 31, len(x)):
            cost.advance(end, 0)
            starts = np.arange(0, end - 6)
            assert np.allclose(cost.to(starts, end), [plain(s, end) for s in starts], atol=1e-6)
        for min_size, jump in ((7, 1), (6, 4), (9, 3)):
            pens = [penalty / 4, penalty, penalty * 3]
            assert sg.segmentations(cost, len(x), pens, min_size, jump) == [plain_cuts(plain, len(x), q, min_size, jump) for q in pens]


def test_pruning_keeps_starts_that_short_ends_need():
    """With segments of several grid steps at least, a start that looks beaten may still be needed for the next ends."""
    for seed in range(40):
        rng = np.random.default_rng(seed)
        x = np.repeat(rng.normal(size=(12, 2)), rng.integers(1, 9, 12), axis=0) + rng.normal(0, 0.05, (1, 2))
        for min_size, jump in ((8, 1), (9, 2), (5, 5)):
            cost = sg.Cost(x, "l2")
            assert sg.best_cuts(cost, len(x), 0.4, min_size, jump) == plain_cuts(plain_cost(x, "l2"), len(x), 0.4, min_size, jump)


def test_median_distance_without_a_table(monkeypatch):
    rng = np.random.default_rng(3)
    tables = [rng.normal(size=(n, 4)) for n in (1, 2, 3, 200, 901)] + [np.zeros((300, 2)), rng.integers(0, 3, (400, 2)).astype(float), np.repeat([[0.0], [5.0]], 60, axis=0)]
    for few in (1 << 20, 500, 1):
        monkeypatch.setattr(sg, "FEW", few)
        for x in tables:
            d2 = ((x[:, None] - x[None]) ** 2).sum(-1)[np.triu_indices(len(x), 1)]
            assert np.isclose(sg.median_distance(x), np.median(d2) if len(d2) else 0.0, rtol=1e-9, atol=1e-12)


LONG = """
import numpy as np
from tidemark.operators import segment as sg
rng = np.random.default_rng(0)
x = np.concatenate([rng.normal(rng.normal(size=19) * 0.5, 0.3, (250, 19)) for _ in range(200)])
cuts = sg.segmentations(sg.Cost(x, gamma=0.08), len(x), [1.0, 5.0])
assert all(c == list(range(250, 50_000, 250)) for c in cuts)
print(next(int(x.split()[1]) // 1024 for x in open("/proc/self/status") if x.startswith("VmHWM")))  # of this program alone
"""


def test_fifty_thousand_rows_in_bounded_memory():
    done = subprocess.run([sys.executable, "-c", LONG], capture_output=True, text=True, timeout=300, check=True)
    assert int(done.stdout) < 500


def test_unknown_models_and_own_functions():
    with pytest.raises(ValueError, match="cosine"):
        sg.Cost(np.zeros((3, 1)), "no")
    cost = sg.Cost(np.r_[np.zeros(10), np.ones(10)][:, None], lambda rows: float(np.ptp(rows)))
    assert sg.best_cuts(cost, 20, 0.3, 4) == [10] and not cost.splits


STACKED = [("rbf", {}, 0.5), ("l2", {}, 0.5), ("l1", {}, 0.5), ("normal", {}, 3.0), ("linear", {}, 0.2), ("ar", {"order": 1}, 0.1), ("rank", {}, 2.0), ("mahalanobis", {"metric": np.diag([1.0, 2.0, 3.0])}, 1.0), ("cosine", {}, 0.5)]


@pytest.mark.parametrize(("model", "p", "penalty"), STACKED)
def test_many_short_series_are_swept_as_each_alone(model, p, penalty):
    """Also series with equal rows, whose totals tie, on grids, and of one row."""
    for n, count in ((30, 40), (61, 8), (7, 5), (1, 2)):
        rng = np.random.default_rng(n)
        x = np.round(rng.random((count, n, 3)), 1) * (rng.random((count, n, 1)) < 0.4)
        x[0] = 0.0
        for min_size, jump in ((3, 1), (4, 2), (5, 3)):
            series, cuts = sg.swept(sg.cost_tables(x, model, least=min_size, **p), penalty, min_size, jump)
            got = [sorted(cuts[series == k].tolist()) for k in range(count)]
            assert got == [sg.best_cuts(sg.Cost(own, model, **p), n, penalty, min_size, jump) for own in x]


def test_many_short_series_take_little_time_each():
    """One by one they took 6 ms each with the kernel and 16 with the median, on the same machine."""
    x, began = np.random.default_rng(0).random((2000, 30, 5)), time.time()
    for model in ("rbf", "l1"):
        for part in np.split(x, 2):
            sg.swept(sg.cost_tables(part, model, least=3), 0.5, 3)
    assert time.time() - began < 12


def test_models_share_a_pass(spark):
    """Series of several lengths, one too long for a stack, missing values, batches that cut series, and a model that sees some columns."""
    rng, rows, whole = np.random.default_rng(2), [], {}
    for k, n in enumerate([12, 30, 30, 5, sg.SHORT + 20, 30, 1]):
        x = rng.random((n, 3)).round(2) + 2 * (np.arange(n) >= n // 2)[:, None]
        whole[k] = x
        rows += [(k, w, [None if w == 3 and c == 1 and 1 < k else float(v) for c, v in enumerate(own)]) for w, own in enumerate(x)]
        if k > 1 and n > 3:
            x[3, 1] = (x[2, 1] + x[4, 1]) / 2
    sweeps = [sg.Sweep("kernel", [0.5, 2.0]), sg.Sweep("first two", [0.2], "linear", columns=[0, 1]), sg.Sweep("own", [0.5], lambda own: float(np.ptp(own[:, 0])))]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        table = spark.createDataFrame(rows, "k int, w int, x array<double>")
        got = {tuple(r) for r in sg.boundaries_by_model(table, ["k"], sweeps[:2], 4).collect()}
        small = {tuple(r) for r in sg.boundaries_by_model(table.where("k < 3"), ["k"], sweeps[2:], 4).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {(k, q, c, s.name) for k, x in whole.items() for s in sweeps[:2] for q in s.penalties for c in sg.best_cuts(sg.Cost(x[:, s.columns] if s.columns else x, s.model), len(x), q, 4)}
    assert got == want and {k for k, *_ in got} >= {0, 1, 2, 4, 5}
    assert small == {(k, 0.5, c, "own") for k in range(3) for c in sg.best_cuts(sg.Cost(whole[k], sweeps[2].model), len(whole[k]), 0.5, 4)}
