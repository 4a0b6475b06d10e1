"""Group moments of log counts against the dense table."""

import numpy as np
import pytest

from fenloom.operators.expression import group_moments, voom


def _dense(spark, seed=1, features=70, samples=23):
    r = np.random.default_rng(seed)
    y = r.poisson(r.gamma(0.3, 8, (features, 1)), (features, samples)) * (r.random((features, samples)) < 0.4)
    y[0], y[1] = 0, 0
    y[1, 3] = 5  # one feature nowhere, one in one sample
    eff = r.uniform(50, 5000, samples)
    group = np.array(list("aabbbccccc" * 3))[:samples]
    group[-1] = "d"  # a level of one sample
    counts = spark.createDataFrame([(f"s{j}", f"f{i}", float(y[i, j])) for i in range(features) for j in range(samples) if y[i, j] or i == 0],
                                   "sample_id string, feature_id string, abundance double").repartition(4)
    sheet = spark.createDataFrame([(f"s{j}", group[j], float(eff[j])) for j in range(samples)], "sample_id string, group string, eff double")
    return y, eff, group, counts, sheet


def test_moments(spark):
    y, eff, group, counts, sheet = _dense(spark)
    e = np.log2((y + 0.5) / eff * 1e6)
    got = {(r.feature_id, r.group): r for r in group_moments(counts, sheet).collect()}
    present = [i for i in range(len(y)) if y[i].any() or i == 0]
    assert len(got) == len(present) * 4
    for i in present:
        for g in "abcd":
            x, row = e[i, group == g], got[f"f{i}", g]
            assert row.n == len(x) and row.m == pytest.approx(x.mean(), abs=1e-10)
            assert (row.v is None) if len(x) == 1 else row.v == pytest.approx(x.var(ddof=1), abs=1e-9)


def test_every_cell_has_a_weight(spark):
    y, eff, group, counts, sheet = _dense(spark, 2)
    factors = sheet.selectExpr("sample_id", "eff - 1 AS total", "1.0D AS factor")
    rows = voom(counts, factors, sheet.filter("sample_id <> 's5'"), "group").collect()
    present = [i for i in range(len(y)) if y[i].any() or i == 0]
    assert len(rows) == len(present) * (len(eff) - 1) and all(r.weight > 0 for r in rows)
    want = np.log2((y + 0.5) / eff * 1e6)
    assert all(r.e == pytest.approx(want[int(r.feature_id[1:]), int(r.sample_id[1:])]) for r in rows)
    # a feature seen in the left-out sample alone is all zeros in the others
    alone = voom(counts.unionByName(spark.createDataFrame([("s5", "lone", 3.0)], counts.schema)), factors,
                 sheet.filter("sample_id <> 's5'"), "group").filter("feature_id = 'lone'").collect()
    assert len(alone) == len(eff) - 1
