"""Models with a random intercept per block (a plant sampled several times).

Normal models of many features: each feature is reduced to sums per block and group, which hold
all its likelihood needs, and features are then solved side by side in numpy. Poisson models of
one response with many blocks: each block is reduced to sums per design cell; a Newton step adds
up Schur complements in which the block's own effect is already eliminated, so that the driver
sees matrices of the design's size alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from fenloom.functions.tails import digamma, t_pvalue, trigamma, trigamma_inverse
from fenloom.operators.permutation import MAX_CELLS
from fenloom.session import cut_lineage

RATIOS = np.concatenate([[0.0], np.logspace(-4, 4, 33)])  # between blocks to within, at the mean weight of a block
CELLS = 1 << 22  # numbers of a feature batch held dense


# ---- normal response, many features -----------------------------------------------------------


class _Blocks:
    """Features side by side: S and T are sums of w and w y by (feature, block, group); Q is the sum of w y y."""

    def __init__(self, s: np.ndarray, t: np.ndarray, q: np.ndarray, free: np.ndarray):
        self.s, self.t, self.q, self.free = s, t, q, free
        self.w, self.ty = s.sum(axis=2), t.sum(axis=2)
        self.present = s.sum(axis=1) > 0

    def at(self, ratio: np.ndarray):
        """beta, the inverse of X'V^-1 X, what is left of y'V^-1 y, and the slope of the deviance in the ratio."""
        one = 1 + ratio[:, None] * self.w
        c, c1 = ratio[:, None] / one, 1 / one**2
        a = -np.einsum("fk,fkg,fkh->fgh", c, self.s, self.s)
        eye = np.arange(a.shape[1])
        a[:, eye, eye] += np.where(self.present, self.s.sum(axis=1), 1.0)
        inverse = np.linalg.inv(a)
        b = self.t.sum(axis=1) - np.einsum("fk,fkg,fk->fg", c, self.s, self.ty)
        beta = np.einsum("fgh,fh->fg", inverse, b)
        rest = np.maximum(self.q - (c * self.ty**2).sum(axis=1) - (b * beta).sum(axis=1), 1e-300)
        e = self.ty - np.einsum("fkg,fg->fk", self.s, beta)
        lean = np.einsum("fkg,fgh,fkh->fk", self.s, inverse, self.s)
        log_slope = (self.w / one - c1 * lean).sum(axis=1)
        rest_slope = -(c1 * e * e).sum(axis=1)
        deviance = np.log(one).sum(axis=1) + np.linalg.slogdet(a)[1] + self.free * np.log(rest)
        return beta, inverse, rest, deviance, log_slope, rest_slope, c1

    def slope(self, ratio: np.ndarray) -> np.ndarray:
        _, _, rest, _, log_slope, rest_slope, _ = self.at(ratio)
        return log_slope + self.free * rest_slope / rest

    def best(self) -> np.ndarray:
        """The ratio of least restricted deviance: best point of a grid, then the root of the slope around it."""
        unit = np.where(self.w > 0, 1, 0).sum(axis=1) / np.maximum(self.w.sum(axis=1), 1e-300)
        grid = RATIOS[:, None] * unit
        deviance = np.stack([self.at(r)[3] for r in grid])
        k = deviance.argmin(axis=0)
        f = np.arange(len(k))
        lo, hi = grid[np.maximum(k - 1, 0), f], grid[np.minimum(k + 1, len(grid) - 1), f]
        x = grid[k, f]
        for step in range(80):  # Newton on the slope inside a bracket that bisection keeps
            y = self.slope(x)
            lo, hi = np.where(y < 0, x, lo), np.where(y < 0, hi, x)
            h = 1e-5 * np.maximum(x, 1e-6 * unit)
            newton = x - y / np.where((d := (self.slope(x + h) - y) / h) > 0, d, np.inf)
            inside = (newton > lo) & (newton < hi) & (step % 3 < 2)
            new = np.where(inside, newton, (lo + hi) / 2)
            done = np.abs(new - x) <= 1e-13 * np.maximum(x, unit * 1e-12)
            x = new
            if done.all():
                break
        zero = np.zeros_like(x)
        return np.where((k == 0) & (self.slope(zero) >= 0), 0.0, x)


def block_contrasts(values: DataFrame, coefs: Mapping[str, Mapping[str, float]], block: str = "block") -> DataFrame:
    """(feature_id, contrast, log_fc, ave_expr, unscaled, s2, df, df_s2, ratio) with a random intercept per block.

    ``values`` has (feature_id, group, block, e, weight). Fitted by restricted maximum likelihood;
    ``ratio`` is the variance between blocks over that within at weight 1, ``df`` Satterthwaite's
    degrees of freedom of the contrast and ``df_s2`` those of ``s2``. One pass over the values:
    sums per (feature, block, group). A feature is left out of contrasts that use a group it lacks.
    """
    levels = sorted({g for c in coefs.values() for g in c})
    w, e = F.col("weight"), F.col("e")
    cell = values.groupBy("feature_id", F.col(block).alias("block"), "group").agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("s"), F.sum(w * e).alias("t"), F.sum(w * e * e).alias("q"), F.sum(e).alias("se"))
    per = cell.filter(F.col("group").isin(levels)).groupBy("feature_id").agg(  # an entry for each block and group of the design
        F.sum("n").alias("n"), F.sum("q").alias("q"), (F.sum("se") / F.sum("n")).alias("ave_expr"),
        F.collect_list(F.struct(F.coalesce(F.col("block").cast("string"), F.lit("")).alias("b"), "group", "s", "t")).alias("cells"))
    place = {g: i for i, g in enumerate(levels)}
    table = np.array([[c.get(g, 0.0) for g in levels] for c in coefs.values()])
    names = list(coefs)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            widest = max((len(c) for c in whole["cells"]), default=1)
            step = max(1, CELLS // (widest * len(levels)))
            for lo in range(0, len(whole), step):
                yield fit(whole.iloc[lo:lo + step])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = [sorted({c["b"] for c in cells}) for cells in pdf["cells"]]
        width = max(map(len, blocks))
        s, t = np.zeros((2, len(pdf), width, len(levels)))
        for f, (cells, known) in enumerate(zip(pdf["cells"], blocks)):
            at = {b: i for i, b in enumerate(known)}
            for c in cells:
                s[f, at[c["b"]], place[c["group"]]] = c["s"]
                t[f, at[c["b"]], place[c["group"]]] = c["t"]
        present = s.sum(axis=1) > 0
        free = pdf["n"].to_numpy(float) - present.sum(axis=1)
        m = _Blocks(s, t, pdf["q"].to_numpy(float), np.maximum(free, 0))
        ratio = m.best()
        beta, inverse, rest, _, _, rest_slope, c1 = m.at(ratio)
        s2 = rest / np.where(free > 0, free, np.nan)
        # observed information of (log s2, ratio)
        h = 1e-4 * np.maximum(ratio, 1e-300)
        up, down = m.at(ratio + h), m.at(ratio - h)
        log_curve, rest_curve = (up[4] - down[4]) / (2 * h), (up[5] - down[5]) / (2 * h)
        i11, i12, i22 = free / 2, -rest_slope / s2 / 2, (log_curve + rest_curve / s2) / 2
        det = i11 * i22 - i12 * i12
        inner = (ratio > 0) & (det > 0)
        df_s2 = np.where(inner, 2 * det / np.where(inner, i22, 1), free)
        out = []
        for name, c in zip(names, table):
            used = np.flatnonzero(c)
            u = np.einsum("g,fgh,h->f", c, inverse, c)
            slope = (c1 * np.einsum("fkg,fgh,h->fk", m.s, inverse, c) ** 2).sum(axis=1)  # of u in the ratio
            spread = (i22 * u * u - 2 * i12 * u * slope + i11 * slope * slope) / np.where(inner, det, 1)
            df = np.where(inner, 2 * u * u / np.where(inner, spread, 1), free)
            keep = present[:, used].all(axis=1) & (free > 0)
            out.append(pd.DataFrame({
                "feature_id": pdf["feature_id"], "contrast": name, "log_fc": beta @ c, "ave_expr": pdf["ave_expr"],
                "unscaled": np.sqrt(u), "s2": s2, "df": df, "df_s2": df_s2, "ratio": ratio})[keep])
        return pd.concat(out)

    kind = values.schema["feature_id"].dataType.simpleString()
    return per.mapInPandas(solve, f"feature_id {kind}, contrast string, log_fc double, ave_expr double, unscaled double, "
                                  "s2 double, df double, df_s2 double, ratio double")


def _at(df: pd.Series) -> pd.DataFrame:
    half = df.to_numpy(float) / 2
    return pd.DataFrame({"m": [digamma(x) - math.log(x) for x in half], "v": [trigamma(x) for x in half]})


def _exp(x: float) -> float:
    """Infinite where it is too large, as for variances with next to no degrees of freedom: t is 0 then."""
    return math.exp(x) if x < 709 else math.inf


def moderate(fit: DataFrame) -> DataFrame:
    """Moderated t of :func:`block_contrasts`: degrees of freedom may differ by feature and contrast.

    The prior is matched to the mean and variance of ln s2 over features, each corrected for its own
    degrees of freedom; two aggregates on the cluster and one scalar equation on the driver.
    """
    fit = cut_lineage(fit)
    one = fit.groupBy("feature_id").agg(F.first("s2").alias("s2"), F.first("df_s2").alias("d")).filter("s2 > 0")
    moments = F.pandas_udf(_at, "m double, v double")
    e = one.select("d", F.log("s2").alias("y"), moments("d").alias("k"))
    s = e.agg(F.avg(F.col("y") - F.col("k.m")).alias("m"), F.var_samp(F.col("y") - F.col("k.m")).alias("v"),
              F.avg("k.v").alias("noise"), F.sum("d").alias("pool")).first()
    left = (s["v"] or 0.0) - (s["noise"] or 0.0)
    if left > 0:
        d0 = 2 * trigamma_inverse(left)
        s02 = _exp(s["m"] + digamma(d0 / 2) - math.log(d0 / 2))
        post = (F.lit(d0 * s02) + F.col("df_s2") * F.col("s2")) / (F.lit(d0) + F.col("df_s2"))
    else:
        d0, s02 = math.inf, _exp(s["m"] or 0.0)
        post = F.lit(s02)
    total = F.least(F.lit(d0) + F.col("df"), F.lit(float(s["pool"] or 0.0)))
    out = fit.withColumn("s2_post", post).withColumn("t", F.col("log_fc") / (F.sqrt("s2_post") * F.col("unscaled")))
    return out.withColumn("df_total", total).withColumn("p", t_pvalue("t", "df_total"))


# ---- Poisson response, many blocks ------------------------------------------------------------------


def _design(cells: list[tuple], factors: Sequence[str]) -> tuple[list[str], np.ndarray]:
    """Treatment coding of two factors and their interaction over the cells that occur, first levels as reference."""
    la, lb = (sorted({c[k] for c in cells}) for k in (0, 1))
    names, columns = ["Intercept"], [np.ones(len(cells))]
    is_a = {v: np.array([float(c[0] == v) for c in cells]) for v in la}
    is_b = {v: np.array([float(c[1] == v) for c in cells]) for v in lb}
    for f, levels, on in ((factors[0], la[1:], is_a), (factors[1], lb[1:], is_b)):
        names += [f"{f}[{v}]" for v in levels]
        columns += [on[v] for v in levels]
    for a in la[1:]:
        for b in lb[1:]:
            trial = np.stack([*columns, is_a[a] * is_b[b]], axis=1)
            if np.linalg.matrix_rank(trial) == trial.shape[1]:  # cells that are missing leave no column of their own
                names.append(f"{factors[0]}[{a}]:{factors[1]}[{b}]")
                columns.append(trial[:, -1])
    return names, np.stack(columns, axis=1)


class PoissonIntercepts:
    """Poisson model of ``y`` on two crossed factors with a normal intercept per block.

    The log likelihood is Laplace's, maximised over the variance of the intercepts with the fixed
    part at the mode of the penalised likelihood. All variances of a grid are fitted in the same
    passes over the blocks, and the grid is narrowed ``narrow`` times around its best point.

    ``coefficients``: (parameter, estimate, se). ``intercepts``: (block, estimate, sd) as a table.
    """

    def __init__(self, df: DataFrame, y: str, factors: Sequence[str], block: str, narrow: int = 3, tol: float = 1e-9):
        a, b = factors
        ok = df.filter(F.col(y).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(block).isNotNull())
        sums = ok.groupBy(F.col(block).alias("block"), F.col(a).alias("a"), F.col(b).alias("b")).agg(
            F.count(F.lit(1)).cast("double").alias("n"), F.sum(y).cast("double").alias("y"))
        self.cells = cut_lineage(sums, "cells")
        keys = sorted((r["a"], r["b"]) for r in self.cells.select("a", "b").distinct().limit(MAX_CELLS + 1).collect())
        if not 0 < len(keys) <= MAX_CELLS:
            raise ValueError(f"1 to {MAX_CELLS} cells of the design are needed, not {len(keys)}")
        self.names, self.x = _design(keys, factors)
        number = self.cells.sparkSession.createDataFrame([(*k, i) for i, k in enumerate(keys)], self.cells.select("a", "b").schema.add("c", "integer"))
        rows = self.cells.join(F.broadcast(number), ["a", "b"]).groupBy("block").agg(
            F.collect_list("c").alias("c"), F.collect_list("n").alias("n"), F.collect_list("y").alias("y"))  # a cell each
        self.rows = cut_lineage(rows, "blocks")
        total = self.cells.agg(F.sum("y"), F.sum("n")).first()
        start = np.zeros(self.x.shape[1])
        start[0] = math.log(max(total[0], 0.5) / total[1])
        grid = np.concatenate([[0.0], np.logspace(-4, 1.5, 12)])
        betas = np.tile(start, (len(grid), 1))
        for _ in range(narrow):
            betas, deviance, inverse = self._fit(grid, betas, tol)
            k = int(deviance.argmin())
            self.variance, self.deviance, self.beta, self.cov = float(grid[k]), float(deviance[k]), betas[k], inverse[k]
            lo, hi = grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)]
            grid = np.linspace(lo, hi, 13)
            betas = np.tile(self.beta, (len(grid), 1))
        self.coefficients = df.sparkSession.createDataFrame(
            [(n, float(v), float(s)) for n, v, s in zip(self.names, self.beta, np.sqrt(np.diag(self.cov)))],
            "parameter string, estimate double, se double")
        self.intercepts = self._intercepts()

    def _dense(self, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        n, y = np.zeros((2, len(pdf), len(self.x)))
        row = np.repeat(np.arange(len(pdf)), [len(c) for c in pdf["c"]])
        at = np.concatenate(pdf["c"].to_numpy()).astype(int)
        n[row, at], y[row, at] = np.concatenate(pdf["n"].to_numpy()), np.concatenate(pdf["y"].to_numpy())
        return n, y

    @staticmethod
    def _modes(n: np.ndarray, y: np.ndarray, eta: np.ndarray, variance: float) -> tuple[np.ndarray, np.ndarray]:
        """The mode of each block's intercept given the fixed part, and the expected counts there."""
        mean, total = (n * np.exp(eta)).sum(axis=1), y.sum(axis=1)
        u = np.zeros(len(n))
        if variance > 0:
            for _ in range(100):  # concave in one number: Newton, steps of at most 1
                mu = mean * np.exp(u)
                step = np.clip((total - mu - u / variance) / (mu + 1 / variance), -1, 1)
                u = u + step
                if np.abs(step).max(initial=0) < 1e-13:
                    break
        return u, n * np.exp(eta + u[:, None])

    def _fit(self, grid: np.ndarray, betas: np.ndarray, tol: float) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Newton steps for all variances at once: a pass over the blocks a step, sums of the design's size back."""
        x, cells = self.x, len(self.x)
        for _ in range(60):
            sent = betas

            def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for whole in batches:
                    for lo in range(0, len(whole), step := max(1, CELLS // (8 * cells))):
                        n, y = self._dense(whole.iloc[lo:lo + step])
                        out = []
                        for j, variance in enumerate(grid):
                            eta = x @ sent[j]
                            u, mu = self._modes(n, y, eta, variance)
                            d = mu.sum(axis=1) + (1 / variance if variance else np.inf)
                            schur = np.diag(mu.sum(axis=0)) - (mu / d[:, None]).T @ mu
                            logs = (y * (eta + u[:, None]) - mu).sum()
                            dev = -2 * logs + ((u * u / variance + np.log1p(variance * mu.sum(axis=1))).sum() if variance else 0.0)
                            out.append((j, np.concatenate([schur.ravel(), (y - mu).sum(axis=0), [dev]])))
                        yield pd.DataFrame(out, columns=["j", "v"])

            sums = {j: np.zeros(cells * cells + cells + 1) for j in range(len(grid))}
            merged = self.rows.select("c", "n", "y").mapInPandas(add, "j int, v array<double>").select("j", F.posexplode("v")).groupBy(
                "j", "pos").agg(F.sum("col").alias("v"))
            for r in merged.collect():  # a matrix of the design's size for each variance
                sums[r["j"]][r["pos"]] = r["v"]
            new, deviance, inverse, moved = betas.copy(), np.zeros(len(grid)), [], 0.0
            for j, v in sums.items():
                h = x.T @ v[: cells * cells].reshape(cells, cells) @ x
                inverse.append(np.linalg.pinv(h, hermitian=True))
                step = inverse[-1] @ (x.T @ v[cells * cells:-1])
                step *= min(1.0, 2.0 / max(np.abs(x @ step).max(), 1e-300))
                new[j], deviance[j], moved = betas[j] + step, v[-1], max(moved, np.abs(step).max())
            if moved <= tol * max(1.0, np.abs(new).max()):
                return betas, deviance, inverse
            betas = new
        raise RuntimeError("no mode of the penalised likelihood within 60 steps")

    def _intercepts(self) -> DataFrame:
        beta, variance, x = self.beta, self.variance, self.x

        def modes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    u, mu = self._modes(*self._dense(pdf), x @ beta, variance)
                    sd = np.sqrt(1 / (mu.sum(axis=1) + 1 / variance)) if variance else np.zeros(len(u))
                    yield pd.DataFrame({"block": pdf["block"], "estimate": u, "sd": sd})

        kind = self.rows.schema["block"].dataType.simpleString()
        return self.rows.mapInPandas(modes, f"block {kind}, estimate double, sd double")

    def __getstate__(self) -> dict:
        return {"x": self.x}  # all that tasks need
