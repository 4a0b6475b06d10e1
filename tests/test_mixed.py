"""Random-intercept models against dense solutions."""

import numpy as np
import pytest

from fenloom.operators import mixed as M


def dense_reml(y, w, x, block, ratio):
    z = (block[:, None] == np.unique(block)[None, :]).astype(float)
    v = np.diag(1 / w) + ratio * z @ z.T
    vi = np.linalg.inv(v)
    a = np.linalg.inv(x.T @ vi @ x)
    beta = a @ x.T @ vi @ y
    rest = (y - x @ beta) @ vi @ (y - x @ beta)
    n, p = x.shape
    return np.linalg.slogdet(v)[1] - np.linalg.slogdet(a)[1] + (n - p) * np.log(rest), beta, a, rest / (n - p)


def argmin(f, lo, hi, steps=200):
    g = (np.sqrt(5) - 1) / 2
    for _ in range(steps):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if f(a) < f(b) else (a, hi)
    return (lo + hi) / 2


def test_fifty_features_against_a_dense_solve(spark):
    r = np.random.default_rng(4)
    block, group = np.arange(36) % 9, np.array(list("ABC"))[np.arange(36) // 12]
    rows, truth = [], {}
    coefs = {"A-B": {"A": 1.0, "B": -1.0}, "A-rest": {"A": 1.0, "B": -0.5, "C": -0.5}}
    x = (group[:, None] == np.array(list("ABC"))[None, :]).astype(float)
    for f in range(50):
        w = r.uniform(0.3, 3, 36)
        y = x @ r.normal(size=3) + r.normal(size=9)[block] * (0 if f % 5 == 0 else r.uniform(0.1, 2)) + r.normal(size=36) / np.sqrt(w)
        rows += [(f, g, f"p{b}", float(e), float(k)) for g, b, e, k in zip(group, block, y, w)]
        u = argmin(lambda t: dense_reml(y, w, x, block, np.exp(t))[0], -14, 5)
        ratio = np.exp(u) if dense_reml(y, w, x, block, np.exp(u))[0] < dense_reml(y, w, x, block, 0.0)[0] else 0.0
        truth[f] = (ratio, *dense_reml(y, w, x, block, ratio), y, w)
    df = spark.createDataFrame(rows, "feature_id int, group string, block string, e double, weight double").repartition(5)
    got = M.block_contrasts(df, coefs).collect()
    assert len(got) == 100
    for g in got:
        ratio, dev, beta, a, s2, y, w = truth[g.feature_id]
        c = np.array([coefs[g.contrast].get(k, 0.0) for k in "ABC"])
        assert dense_reml(y, w, x, block, g.ratio)[0] <= dev + 1e-9
        assert g.ratio == pytest.approx(ratio, rel=1e-4, abs=1e-4)
        assert g.log_fc == pytest.approx(c @ beta, rel=1e-4, abs=1e-5) and g.s2 == pytest.approx(s2, rel=1e-4)
        assert g.unscaled == pytest.approx(np.sqrt(c @ a @ c), rel=1e-4)
        if ratio == 0:
            assert g.df == g.df_s2 == 33
        else:  # Satterthwaite from numeric derivatives of the dense restricted likelihood
            def minus(s, t):
                d, _, _, v = dense_reml(y, w, x, block, t)
                return (33 * s + d - 33 * np.log(v * 33) + v * 33 / np.exp(s)) / 2
            s, t, h, k = np.log(s2), g.ratio, 1e-3, 1e-3 * g.ratio
            hess = np.array([
                [(minus(s + h, t) - 2 * minus(s, t) + minus(s - h, t)) / h**2,
                 (minus(s + h, t + k) - minus(s + h, t - k) - minus(s - h, t + k) + minus(s - h, t - k)) / (4 * h * k)],
                [0, (minus(s, t + k) - 2 * minus(s, t) + minus(s, t - k)) / k**2]])
            hess[1, 0] = hess[0, 1]
            var = lambda t: c @ dense_reml(y, w, x, block, t)[2] @ c
            slope = np.array([s2 * var(t), s2 * (var(t + k) - var(t - k)) / (2 * k)])
            assert g.df == pytest.approx(2 * (s2 * var(t)) ** 2 / (slope @ np.linalg.inv(hess) @ slope), rel=0.02)
    out = M.moderate(M.block_contrasts(df, coefs)).collect()
    assert len(out) == 100 and all(0 <= r.p <= 1 and r.df_total >= r.df - 1e-9 for r in out)


def test_missing_groups_and_no_rows(spark):
    kind = "feature_id int, group string, block string, e double, weight double"
    rows = [(1, g, b, float(k % 5), 1.0) for k, (g, b) in enumerate([(g, b) for g in "AB" for b in "xyz"] * 2)]
    rows += [(2, "A", "x", 1.0, 1.0), (2, "A", "y", 2.0, 1.0), (3, "A", None, 1.0, 1.0)]
    got = M.block_contrasts(spark.createDataFrame(rows, kind), {"A-B": {"A": 1.0, "B": -1.0}}).collect()
    assert [r.feature_id for r in got] == [1]
    assert M.block_contrasts(spark.createDataFrame([], kind), {"A-B": {"A": 1.0, "B": -1.0}}).count() == 0


def dense_poisson(y, x, block, variance):
    """beta and the intercepts by Newton on the full penalised likelihood; Laplace deviance."""
    z = (block[:, None] == np.unique(block)[None, :]).astype(float)
    k = z.shape[1] if variance else 0
    xz = np.hstack([x, z[:, :k]])
    pen = np.diag(np.r_[np.zeros(x.shape[1]), np.full(k, 1 / variance if variance else 0)])
    b = np.zeros(xz.shape[1])
    b[0] = np.log(y.mean())
    for _ in range(100):
        mu = np.exp(xz @ b)
        b = b + np.linalg.solve(xz.T @ (mu[:, None] * xz) + pen, xz.T @ (y - mu) - pen @ b)
    mu = np.exp(xz @ b)
    cov = np.linalg.inv(xz.T @ (mu[:, None] * xz) + pen)[: x.shape[1], : x.shape[1]]
    u = b[x.shape[1]:]
    dev = -2 * (y * np.log(mu) - mu).sum() + ((u * u).sum() / variance + np.log1p(variance * (z.T @ mu)).sum() if variance else 0)
    return dev, b[: x.shape[1]], u, cov


def test_poisson_intercepts_against_numpy(spark):
    r = np.random.default_rng(6)
    block = np.repeat(np.arange(25), 12)
    a, b = np.arange(300) % 3, np.arange(300) // 3 % 2
    y = r.poisson(np.exp(0.5 + 0.3 * a - 0.4 * b + 0.2 * a * b + r.normal(size=25)[block] * 0.6))
    df = spark.createDataFrame([(f"t{i}", int(j), int(k), float(v)) for i, j, k, v in zip(a, b, block, y)],
                               "t string, week int, plant int, y double").repartition(4)
    m = M.PoissonIntercepts(df, "y", ("t", "week"), "plant", narrow=6)
    x = np.stack([np.ones(300), a == 1, a == 2, b == 1, (a == 1) * b, (a == 2) * b], axis=1).astype(float)
    assert m.names == ["Intercept", "t[t1]", "t[t2]", "week[1]", "t[t1]:week[1]", "t[t2]:week[1]"]
    best = argmin(lambda v: dense_poisson(y, x, block, v)[0], 0.01, 5, 60)
    assert m.variance == pytest.approx(best, rel=2e-3)
    dev, beta, u, cov = dense_poisson(y, x, block, m.variance)
    assert m.deviance == pytest.approx(dev) and np.allclose(m.beta, beta, atol=1e-7)
    assert np.allclose([c.se for c in m.coefficients.collect()], np.sqrt(np.diag(cov)), rtol=1e-6)
    got = {c.block: c for c in m.intercepts.collect()}
    assert np.allclose([got[k].estimate for k in range(25)], u, atol=1e-7) and all(c.sd > 0 for c in got.values())


def test_poisson_without_block_effects(spark):
    rows = [("a", 1, k, 2.0) for k in range(6)] + [("b", 1, k, 4.0) for k in range(6)] + [("b", 2, 1, 3.0)]
    m = M.PoissonIntercepts(spark.createDataFrame(rows, "t string, week int, plant int, y double"), "y", ("t", "week"), "plant")
    assert m.variance == 0 and np.allclose(np.exp(m.beta), [2, 2, 0.75])
