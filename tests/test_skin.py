import numpy as np

from tidemark.operators import skin as op

S = ["subject_id"]


def conductance(n, fs=4.0, seed=1):
    rng = np.random.default_rng(seed)
    driver = np.zeros(n)
    driver[rng.choice(n, n // 60, replace=False)] = rng.uniform(0.5, 2.0, n // 60)
    t = np.arange(n) / fs
    decay = np.exp(-t[: int(20 * fs)] / 2.0) - np.exp(-t[: int(20 * fs)] / 0.7)
    return 5 + 0.3 * np.sin(t / 40) + t / 500 + np.convolve(driver, decay)[:n] + rng.normal(size=n) * 0.002, driver


def descended(y, fs, sweeps=4000):
    """The same minimum by exact steps in one weight after the other, and its objective."""
    phasic, tonic, splines = op.design(len(y), fs)
    full, n = np.column_stack([phasic, tonic]), len(y)
    q = full.T @ full
    q[np.arange(n, n + splines), np.arange(n, n + splines)] += op.GAMMA
    c = -(full.T @ y)
    c[: n - 2] += op.ALPHA
    # Free weights are solved for together, the driver's one by one.
    free = np.arange(n - 2, full.shape[1])
    x = np.zeros(full.shape[1])
    back = np.linalg.pinv(q[np.ix_(free, free)], 1e-13, hermitian=True)
    reduced = q[: n - 2, : n - 2] - q[: n - 2, n - 2 :] @ back @ q[n - 2 :, : n - 2]
    slope = c[: n - 2] - q[: n - 2, n - 2 :] @ back @ c[n - 2 :]
    p, g = np.zeros(n - 2), slope.copy()
    for _ in range(sweeps):
        moved = 0.0
        for k in range(n - 2):
            step = max(-p[k], -g[k] / reduced[k, k])
            if step:
                p[k] += step
                g += step * reduced[:, k]
                moved = max(moved, abs(step))
        if moved < 1e-10:
            break
    x[: n - 2], x[free] = p, back @ (-c[n - 2 :] - q[n - 2 :, : n - 2] @ p)
    return tonic @ x[n:], phasic @ x[:n], objective(y, tonic @ x[n:] + phasic @ x[:n], p, x[n : n + splines])


def objective(y, fitted, p, weights):
    return ((fitted - y) ** 2).sum() / 2 + op.ALPHA * p.sum() + op.GAMMA / 2 * (weights**2).sum()


def test_solver_against_descent():
    for seed, n in ((1, 120), (2, 200), (3, 7)):
        y, _ = conductance(n, seed=seed) if n > 60 else (np.array([1.0, 2, 1, 3, 2, 2, 5]), None)
        tonic, phasic, driver = op.solve(y, 4.0)
        want_tonic, want_phasic, _ = descended(y, 4.0)
        assert np.allclose(phasic, want_phasic, atol=2e-4) and np.allclose(tonic, want_tonic, atol=2e-4) and driver.min() >= 0
    for n in (1, 2, 3):
        tonic, phasic, _ = op.solve(np.full(n, 3.0), 4.0)
        assert np.allclose(tonic + phasic, 3.0, atol=1e-2)


def test_parts_of_known_signals():
    y, driver = conductance(960)
    tonic, phasic, found = op.solve(y, 4.0)
    t = np.arange(960) / 4
    assert np.corrcoef(tonic, 5 + 0.3 * np.sin(t / 40) + t / 500)[0, 1] > 0.9 and np.abs(tonic + phasic - y).max() < 0.1
    near = np.convolve(driver > 0, np.ones(5), "same") > 0
    assert found[near].sum() > 0.9 * found.sum()


def test_blocks_against_the_whole_series(spark):
    y, _ = conductance(1500)
    rows = spark.createDataFrame([("a", n, float(v) if n % 97 else None) for n, v in enumerate(y)] + [("b", n, 1.0) for n in range(3)], "subject_id string, idx long, value double")
    got = op.decompose(rows, S, 4.0).toPandas()
    own = got[got.subject_id == "a"].sort_values("idx")
    filled = np.interp(np.arange(1500), [n for n in range(1500) if n % 97], [v for n, v in enumerate(y) if n % 97])
    tonic, phasic, _ = op.solve(filled, 4.0)
    assert own.idx.tolist() == list(range(1500)) and len(got) == 1503
    assert np.abs(own.phasic.to_numpy() - phasic).max() < 0.05 * np.ptp(phasic) and np.abs(own.tonic.to_numpy() - tonic).max() < 0.1 * np.ptp(y)


def is_minimum(y, part):
    """Nothing gets less by another driver, spline or line: what makes a convex programme's minimum, whatever has found it."""
    n, left = len(y), y - part.tonic.to_numpy() - part.phasic.to_numpy()
    phasic, tonic, splines = op.design(n, 4.0)
    price = op.ALPHA - phasic[:, : n - 2].T @ left
    assert price.min() > -1e-3 and np.abs(price * part.driver.to_numpy()[2:]).max() < 1e-2
    assert np.abs(tonic[:, splines:].T @ left).max() < 1e-3
    rest = part.tonic.to_numpy() - tonic[:, :splines] @ (tonic[:, :splines].T @ left) / op.GAMMA
    line = np.polynomial.polynomial.polyfit(np.arange(n), rest, 1)
    assert np.abs(rest - line[0] - line[1] * np.arange(n)).max() < 1e-2
