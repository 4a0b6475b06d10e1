"""Range-wise order statistics agree with pandas, whatever the number of ranges."""

import numpy as np
import pandas as pd
import pytest

from fenloom.operators import ordering as O


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(5)
    n = 400
    v = rng.integers(0, 60, n).astype(float)
    v[: n // 3] = 7.0  # one value holds a third of the rows
    return pd.DataFrame({"id": np.arange(n), "g": rng.choice(["a", "b", "c"], n, p=[0.7, 0.2, 0.1]), "v": v,
                         "w": rng.integers(1, 5, n)})


@pytest.mark.parametrize("ranges", [1, 6])
def test_running_total(spark, pdf, ranges):
    got = O.running_total(spark.createDataFrame(pdf), ["g"], "v", "w", "cum", ranges=ranges).toPandas()
    want = pdf.groupby(["g", "v"])["w"].sum().groupby("g").cumsum()
    assert {(r.g, r.v): r.cum for r in got.itertuples()} == want.to_dict()
    down = O.running_total(spark.createDataFrame(pdf), ["g"], "v", "w", "cum", descending=True, ranges=ranges).toPandas()
    total = pdf.groupby("g")["w"].sum()
    per = pdf.groupby(["g", "v"])["w"].sum()
    for r in down.itertuples():
        assert r.cum == total[r.g] - want[(r.g, r.v)] + per[(r.g, r.v)]


@pytest.mark.parametrize("ranges", [1, 6])
def test_quantiles_and_ranks(spark, pdf, ranges):
    df = spark.createDataFrame(pdf)
    got = O.exact_quantiles(df, ["g"], "v", {"q1": 0.25, "q9": 0.9}, ranges=ranges).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert got.loc[g, "q1"] == pytest.approx(part["v"].quantile(0.25))
        assert got.loc[g, "q9"] == pytest.approx(part["v"].quantile(0.9))
    ranks = O.average_rank(df, "v", ["g"], ranges=ranges).toPandas().set_index("id")["rank"].sort_index()
    assert np.allclose(ranks, pdf.groupby("g")["v"].rank())


def test_quantiles_without_groups(spark, pdf):
    got = O.exact_quantiles(spark.createDataFrame(pdf), [], "v", {"m": 0.5}, ranges=4).first()
    assert got["m"] == pdf["v"].median()


@pytest.mark.parametrize("ranges", [1, 5])
def test_forward_fill_suffix_min_next(spark, pdf, ranges):
    d = pdf.copy()
    d["x"] = d["v"].where(d["v"] % 5 == 0).astype(object).where(lambda s: s.notna(), None)
    df = spark.createDataFrame([(int(r.id), r.g, r.v, r.x) for r in d.itertuples()], "id long, g string, v double, x double")
    got = O.forward_fill(df, ["x"], ["g"], "id", ranges=ranges).toPandas().sort_values("id")
    want = d.assign(x=d["x"].astype(float)).groupby("g")["x"].ffill()
    assert np.allclose(got["x"].to_numpy(dtype=float), want, equal_nan=True)
    low = O.suffix_min(df.select("id", "g", "v"), ["g"], "id", "v", "m", ranges=ranges).toPandas().sort_values("id")
    want = d.iloc[::-1].groupby("g")["v"].cummin().iloc[::-1]
    assert np.array_equal(low["m"].to_numpy(), want.to_numpy())
    nxt = O.next_value(df.select("id", "g"), ["g"], "id", "n", ranges=ranges).toPandas().sort_values("id")
    assert np.allclose(nxt["n"].to_numpy(dtype=float), d.groupby("g")["id"].shift(-1), equal_nan=True)
