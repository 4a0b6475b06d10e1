"""Growth columns: a logistic curve per group, by damped least squares in vectorised batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

CELLS = 1 << 20  # points of a batch of groups held dense


def _curve(p: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of K / (1 + exp(-r (t - m))) for rows of (ln K, r, m), and their slopes in the three."""
    k, r, m = np.exp(p[:, :1]), p[:, 1:2], p[:, 2:3]
    s = 1 / (1 + np.exp(-np.clip(r * (t - m), -500, 500)))
    bend = k * s * (1 - s)
    return k * s, np.stack([k * s, bend * (t - m), -bend * r], axis=2)


def _fit(t: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ln K, r, m), the weighted sum of squares and whether steps became small, for each row of points."""
    on = w > 0
    top = np.where(on, y, 0).max(axis=1) * 1.05
    z = np.clip(y / top[:, None], 0.01, 0.99)
    z = np.log(z / (1 - z))
    n = on.sum(axis=1)
    tm, zm = (np.where(on, v, 0).sum(axis=1) / n for v in (t, z))
    dt = np.where(on, t - tm[:, None], 0)
    r = (dt * z).sum(axis=1) / (dt * dt).sum(axis=1)
    r = np.where(np.abs(r) < 1e-6, 1e-6, r)
    p = np.stack([np.log(top), r, tm - zm / r], axis=1)
    f, j = _curve(p, t)
    sse = (w * (y - f) ** 2).sum(axis=1)
    damp, small = np.full(len(p), 1e-2), np.zeros(len(p), bool)
    for _ in range(rounds):
        h = np.einsum("gt,gta,gtb->gab", w, j, j)
        scale = np.maximum(np.einsum("gaa->ga", h), 1e-12)
        g = np.einsum("gt,gta->ga", w * (y - f), j)
        step = np.linalg.solve(h + (damp[:, None] * scale)[:, :, None] * np.eye(3), g[:, :, None])[:, :, 0]
        new = p + step
        f2, j2 = _curve(new, t)
        sse2 = (w * (y - f2) ** 2).sum(axis=1)
        better = sse2 <= sse
        size = np.abs(step).max(axis=1) <= 1e-10 * (1 + np.abs(p).max(axis=1))
        small |= size & (better | (damp < 1))
        p, f, j = (np.where(better.reshape(-1, *[1] * (a.ndim - 1)), a, b) for a, b in ((new, p), (f2, f), (j2, j)))
        sse = np.where(better, sse2, sse)
        damp = np.clip(np.where(better, damp / 3, damp * 4), 1e-12, 1e12)
        if small.all():
            break
    return p, sse, small


def logistic_growth(df: DataFrame, by: Sequence[str], t: str, y: str) -> DataFrame:
    """(by.., n, k, n0, r, sse, converged): the curve k / (1 + (k / n0 - 1) exp(-r t)) of each group.

    Readings of one time are replaced by their mean and number first, so a group is as long as its
    distinct times. Groups of fewer than four times, or without a reading above 0, have no curve:
    nulls, and ``converged`` false. Null readings and times are left out.
    """
    by = list(by)
    ok = df.filter(F.col(t).isNotNull() & F.col(y).isNotNull())
    x = F.col(y).cast("double")
    point = ok.groupBy(*by, F.col(t).cast("double").alias("_t")).agg(
        F.avg(x).alias("_y"), F.count(F.lit(1)).cast("double").alias("_w"), (F.count(F.lit(1)) * F.var_pop(x)).alias("_v"))
    groups = point.groupBy(*by).agg(
        F.sum("_w").cast("bigint").alias("n"), F.sum("_v").alias("_v"), F.max("_y").alias("_top"),
        F.sort_array(F.collect_list(F.struct("_t", "_y", "_w"))).alias("_p"))
    groups = groups.select(*by, "n", "_v", "_top", F.col("_p._t").alias("_t"), F.col("_p._y").alias("_y"), F.col("_p._w").alias("_w"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            widest = max(map(len, whole["_t"]), default=1)
            for lo in range(0, len(whole), step := max(1, CELLS // widest)):
                yield fit(whole.iloc[lo:lo + step])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[[*by, "n"]].reset_index(drop=True)
        for c in ("k", "n0", "r", "sse"):
            out[c] = np.nan
        out["converged"] = False
        able = np.flatnonzero([len(a) > 3 and top > 0 for a, top in zip(pdf["_t"], pdf["_top"])])
        if len(able):
            size = max(len(pdf["_t"].iat[i]) for i in able)
            t, y, w = np.zeros((3, len(able), size))
            for g, i in enumerate(able):
                for to, c in ((t, "_t"), (y, "_y"), (w, "_w")):
                    v = pdf[c].iat[i]
                    to[g, :len(v)] = v
            # times from 0 to 1 and readings up to 1 inside the fit
            first, last = t[:, :1], np.where(w > 0, t, -np.inf).max(axis=1, keepdims=True)
            span, top = last - first, np.where(w > 0, y, 0).max(axis=1, keepdims=True)
            p, sse, small = _fit(np.where(w > 0, (t - first) / span, 0), y / top, w)
            k, r = np.exp(p[:, 0]) * top[:, 0], p[:, 1] / span[:, 0]
            m = first[:, 0] + p[:, 2] * span[:, 0]
            out.loc[able, "k"], out.loc[able, "r"] = k, r
            out.loc[able, "n0"] = k / (1 + np.exp(np.clip(r * m, -500, 500)))
            out.loc[able, "sse"] = sse * top[:, 0] ** 2 + pdf["_v"].to_numpy()[able]
            out.loc[able, "converged"] = small
        return out

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    return groups.mapInPandas(solve, f"{fields}, n long, k double, n0 double, r double, sse double, converged boolean").select(
        *by, "n", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("k", "n0", "r", "sse")], "converged")
