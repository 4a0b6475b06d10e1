"""Logistic growth columns against planted curves."""

import numpy as np
import pytest

from fenloom.operators.growth import _curve, logistic_growth


def test_planted_curves_come_back(spark):
    r = np.random.default_rng(3)
    rows, truth = [], {}
    for g in range(60):
        k, n0, rate = r.uniform(0.5, 5000), r.uniform(0.005, 0.2), r.uniform(0.1, 0.9)
        t = np.sort(r.uniform(0, 30, r.integers(12, 40)))
        y = k / (1 + (1 / n0 - 1) * np.exp(-rate * t))
        truth[g] = (k, n0 * k, rate)
        rows += [(g, float(a), float(b)) for a, b in zip(t, y)]
    got = logistic_growth(spark.createDataFrame(rows, "g int, t double, y double").repartition(7), ["g"], "t", "y").collect()
    assert len(got) == 60
    for x in got:
        assert x.converged
        assert (x.k, x.n0, x.r) == pytest.approx(truth[x.g], rel=1e-5)


def test_noisy_curves_are_at_a_least_sum_of_squares(spark):
    r = np.random.default_rng(4)
    t = np.tile(np.arange(20.0), 3)
    y = 8 / (1 + np.exp(-0.5 * (t - 9))) + r.normal(size=60) * 0.3
    x = logistic_growth(spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(t, y)], "g string, t double, y double"),
                        ["g"], "t", "y").first()
    p = np.array([[np.log(x.k), x.r, np.log(x.k / x.n0 - 1) / x.r]])
    f, j = _curve(p, t[None])
    assert x.n == 60 and x.sse == pytest.approx(((y - f) ** 2).sum())
    for a in range(3):
        for step in (-1e-3, 1e-3):
            q = p.copy()
            q[0, a] += step
            assert ((y - _curve(q, t[None])[0]) ** 2).sum() > x.sse


def test_groups_without_a_curve(spark):
    kind = "g string, t double, y double"
    rows = [("few", 1.0, 2.0), ("few", 2.0, 3.0), ("zero", 1.0, 0.0), (None, 1.0, 1.0), ("null", None, 1.0), ("null", 2.0, None)]
    rows += [("zero", float(k), 0.0) for k in range(9)]
    got = {x.g: x for x in logistic_growth(spark.createDataFrame(rows, kind), ["g"], "t", "y").collect()}
    assert set(got) == {"few", "zero", None} and all(x.k is None and not x.converged for x in got.values())
    assert logistic_growth(spark.createDataFrame([], kind), ["g"], "t", "y").count() == 0
