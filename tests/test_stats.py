"""Tail areas, models and adjustments."""

import math

import numpy as np
import pytest

from fenloom.functions import tails as T
from fenloom.operators import expression as V
from fenloom.operators import models as M
from fenloom.operators import topics


def test_tails_at_known_points():
    # one degree of freedom is the Cauchy law; two have closed forms too
    assert T.t_two_sided(1.0, 1) == pytest.approx(0.5)
    assert T.t_two_sided(2.0, 2) == pytest.approx(1 - 2 / math.sqrt(6))
    assert T.f_upper(3.0, 2, 10) == pytest.approx((1 + 2 * 3.0 / 10) ** -5)
    assert T.f_upper(4.0, 1, 7) == pytest.approx(T.t_two_sided(2.0, 7))
    assert T.digamma(1.0) == pytest.approx(-0.5772156649015329)
    assert T.trigamma(1.0) == pytest.approx(math.pi**2 / 6)
    for y in (0.01, 1.0, 30.0):
        assert T.trigamma(T.trigamma_inverse(y)) == pytest.approx(y)


def test_bh(spark):
    rng = np.random.default_rng(3)
    p = np.round(rng.random(60) ** 3, 2)
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(p)], "id int, p double")
    m = len(p)
    order = np.argsort(p)
    adj = np.minimum.accumulate((p[order] * m / np.arange(1, m + 1))[::-1])[::-1]
    want = dict(zip(order, np.minimum(adj, 1)))
    for ranges in (1, 4):
        got = {r.id: r.padj for r in V.bh_adjust(df, ranges=ranges).collect()}
        assert all(got[k] == pytest.approx(want[k]) for k in want)
        assert all(got[k] >= p[k] - 1e-12 for k in got)


def test_gamma_closed_form_is_the_fit(spark):
    rng = np.random.default_rng(8)
    rows = [(str(g), float(v)) for g, s in (("a", 2.0), ("b", 5.0), ("c", 9.0)) for v in rng.gamma(3, s, 40)]
    df = spark.createDataFrame(rows, "g string, y double")
    closed = {r.parameter: r.estimate for r in M.fit_factor(df, "y", "g", "c", "gamma").collect()}
    fit = {r.parameter: r.estimate for r in M.fit_glm(df, "y ~ g", "gamma", "log").collect()}
    assert fit["Intercept"] == pytest.approx(closed["Intercept"], abs=1e-6)
    assert fit["g_a"] == pytest.approx(closed["a"], abs=1e-6)


def test_two_way_anova_against_least_squares(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 3, 70), rng.integers(0, 4, 70)
    y = a * 1.5 + b * 0.3 + rng.normal(size=70)
    df = spark.createDataFrame([(int(i), int(j), float(v)) for i, j, v in zip(a, b, y)], "a int, b int, y double")
    got = {r.term: r for r in M.anova(df, "y", ["a", "b"]).collect()}

    def rss(*cols):
        x = np.hstack([np.ones((70, 1)), *cols])
        return ((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum()

    ia, ib = np.eye(3)[a], np.eye(4)[b]
    cell = np.eye(12)[a * 4 + b]
    r = [rss(), rss(ia), rss(ia, ib), rss(cell)]
    assert got["a"].ss == pytest.approx(r[0] - r[1])
    assert got["b"].ss == pytest.approx(r[1] - r[2])
    assert got["a:b"].ss == pytest.approx(r[2] - r[3])
    assert (got["a"].df, got["b"].df, got["a:b"].df, got["Residual"].df) == (2, 3, 6, 58)
    assert 0 < got["a"].p < 1


def test_topics_are_distributions(spark):
    rows = [(f"s{s}", f, float(20 if (f < 5) == (s < 4) else 1)) for s in range(8) for f in range(10)]
    c = topics.communities(spark.createDataFrame(rows, "sample_id string, feature_id int, abundance double"), 2, iters=5)
    theta = c.theta.groupBy("sample_id").sum("probability").collect()
    phi = c.phi.groupBy("topic").sum("probability").collect()
    assert len(theta) == 8 and len(phi) == 2
    assert all(r[1] == pytest.approx(1, abs=1e-6) for r in [*theta, *phi])


def test_intervals_are_ordered(spark):
    df = spark.createDataFrame([(d, "b", float((d * 37) % 101)) for d in range(101)], "draw int, parameter string, value double")
    r = M.flag_nonzero(M.intervals(df)).first()
    assert r.ll <= r.l <= r.m <= r.h <= r.hh
    assert r.nonzero == "nonzero"


def test_half_even_and_text(spark):
    from pyspark.sql import functions as F

    from fenloom.functions import scalar as X

    df = spark.createDataFrame([(0.5, "a_b_c_d"), (1.5, "a_b"), (2.5, "a")], "v double, t string")
    head, tail = X.split_at("t", "_", 2)
    got = df.select(X.round_even("v").alias("r"), head.alias("h"), tail.alias("t")).collect()
    assert [r.r for r in got] == [0.0, 2.0, 2.0]
    assert [(r.h, r.t) for r in got] == [("a_b", "c_d"), ("a_b", ""), ("a", "")]
    assert df.select(X.case_when((F.col("v") > 1, "x"), (F.col("v") > 2, "y")).alias("c")).collect()[0].c is None
