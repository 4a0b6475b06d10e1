"""Quality scores from a sparse rule ensemble.

Statistics of the whole text come from one pass over its bytes. On a bounded sample of labelled rows the driver
grows small trees, each on a random half of the rows and of the statistics, fitted to what the
trees before leave. Every path from a root is a rule, a conjunction of comparisons. A lasso
logistic regression (proximal gradient) keeps few of the rules, and the kept ones become one
Spark expression over the statistics.

Null and empty texts have statistics of 0 and are scored like any other text. Rows with a null
label are not learned from; a label repeated for one id counts once. If only one
label value is known, or too few rows to split, every score is the share of 1 (0.5 with none).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fenloom.llm.common import held_out, packed, small_batches, text_of, utf8_parts
from fenloom.llm.near import word_hashes

_B = np.arange(256)
_MARK = ((_B >= 0x21) & (_B <= 0x7E)) & ~((_B >= 0x30) & (_B <= 0x39)) & ~(((_B | 0x20) >= 0x61) & ((_B | 0x20) <= 0x7A))
BLANK = (_B == 0x20) | ((_B >= 0x09) & (_B <= 0x0D))
#: name -> share of a text's characters that are among these bytes.
SHARES = {
    "letters": (((_B | 0x20) >= 0x61) & ((_B | 0x20) <= 0x7A) & (_B < 0x80)) | (_B >= 0xC0),
    "capitals": (_B >= 0x41) & (_B <= 0x5A),
    "digits": (_B >= 0x30) & (_B <= 0x39),
    "marks": _MARK,
    "odd_marks": np.isin(_B, list(b"#$%&*+/<=>@\\^_`{|}~")),
    "bars": _B == ord("|"),
    "shouts": _B == ord("!"),
    "blanks": BLANK,
}
STATISTICS = ["log_chars", "log_words", *SHARES, "full_stops", "capital_starts", "commas", "repeats", "word_length",
              "distinct_words", "distinct_lines", "words_a_line"]


def measure(data: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of texts laid end to end in UTF-8 bytes; shares are of characters, ends and repeats of words."""

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return np.diff(total[starts]).astype(float)

    def distinct(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.diff(at)
        doc = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((hashes, doc))
        h, d = hashes[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        return n.astype(float), np.bincount(d[new], minlength=len(n)).astype(float)

    chars = count((data & 0xC0) != 0x80)
    words, at = word_hashes(data, starts, is_word=~BLANK)
    n_words, kinds = distinct(words, at)
    n_lines, line_kinds = distinct(*word_hashes(data, starts, is_word=_B != 0x0A))
    blank = BLANK[data]
    first, last = np.zeros(len(data), bool), np.zeros(len(data), bool)
    first[starts[:-1][np.diff(starts) > 0]] = True
    last[starts[1:][np.diff(starts) > 0] - 1] = True
    before, after = first.copy(), last.copy()
    before[1:] |= blank[:-1]
    after[:-1] |= blank[1:]
    same = np.zeros(len(words), bool)
    same[1:] = words[1:] == words[:-1]
    same[at[:-1][np.diff(at) > 0]] = False
    repeats = np.diff(np.concatenate([[0], np.cumsum(same)])[at]).astype(float)
    c, w, lines = np.maximum(chars, 1), np.maximum(n_words, 1), np.maximum(n_lines, 1)
    out = {"log_chars": np.log1p(chars), "log_words": np.log1p(n_words)}
    out |= {k: count(table[data]) / c for k, table in SHARES.items()}
    out["full_stops"] = count(np.isin(data, list(b".!?")) & after) / w
    out["capital_starts"] = count(SHARES["capitals"][data] & before) / w
    out["commas"] = count(data == ord(",")) / w
    out |= {"repeats": repeats / w, "word_length": chars / w, "distinct_words": kinds / w,
            "distinct_lines": line_kinds / lines, "words_a_line": n_words / lines}
    return out


def statistics(text: Column) -> Column:
    """A struct of all statistics of a whole text, worked out on its bytes."""

    @F.arrow_udf("struct<" + ", ".join(f"{k}: double" for k in STATISTICS) + ">")
    def of(texts: pa.Array) -> pa.Array:
        starts, data = utf8_parts(texts)
        parts, lo = [], 0
        while lo < len(texts):  # about a MB at a time
            hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + (1 << 20), "right")) - 1)
            parts.append(measure(data[starts[lo]: starts[hi]], starts[lo: hi + 1] - starts[lo]))
            lo = hi
        return pa.StructArray.from_arrays(
            [pa.array(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0)) for k in STATISTICS], STATISTICS)

    return of(text)


Rule = tuple[tuple[str, str, float], ...]


@dataclass
class Model:
    """score = 1 / (1 + exp(-(bias + the weights of the rules that hold)))."""

    bias: float
    rules: list[tuple[Rule, float]]

    def column(self, stat: dict[str, Column]) -> Column:
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            holds = None
            for name, side, cut in rule:
                test = stat[name] <= cut if side == "<=" else stat[name] > cut
                holds = test if holds is None else holds & test
            total = total + F.when(holds, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def score(self, x: pd.DataFrame) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + sum((w * holds(r, x) for r, w in self.rules), np.zeros(len(x))))))


def holds(rule: Rule, x: pd.DataFrame) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for name, side, cut in rule:
        v = x[name].to_numpy()
        ok &= v <= cut if side == "<=" else v > cut
    return ok


def _best_split(v: np.ndarray, g: np.ndarray, least: int) -> tuple[float, float]:
    """The gain and cut of the best split of residuals ``g`` along ``v``."""
    order = np.argsort(v, kind="stable")
    v, s = v[order], np.cumsum(g[order])
    n = np.arange(1, len(v))
    gain = s[:-1] ** 2 / n + (s[-1] - s[:-1]) ** 2 / (len(v) - n) - s[-1] ** 2 / len(v)
    gain[(v[1:] == v[:-1]) | (n < least) | (len(v) - n < least)] = -1
    at = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[at]), float((v[at] + v[at + 1]) / 2)) if len(gain) and gain[at] > 0 else (0.0, 0.0)


def grow(x: pd.DataFrame, g: np.ndarray, names: list[str], depth: int, least: int) -> tuple[list[Rule], np.ndarray]:
    """The paths of one tree, and its fitted values."""
    rules: list[Rule] = []
    fit = np.zeros(len(x))

    def node(rows: np.ndarray, path: Rule, left: int):
        fit[rows] = g[rows].mean()
        if path:
            rules.append(path)
        if not left or len(rows) < 2 * least:
            return
        gain, cut, name = max((*_best_split(x[k].to_numpy()[rows], g[rows], least), k) for k in names)
        if gain <= 1e-9:
            return
        low = x[name].to_numpy()[rows] <= cut
        node(rows[low], (*path, (name, "<=", cut)), left - 1)
        node(rows[~low], (*path, (name, ">", cut)), left - 1)

    node(np.arange(len(x)), (), depth)
    return rules, fit


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty, by accelerated proximal gradient."""
    step = 4 / (np.linalg.norm(z, 2) ** 2 / len(z) + 1)
    w, b = np.zeros(z.shape[1]), float(np.log(y.mean() / (1 - y.mean())))
    u, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        err = 1 / (1 + np.exp(-(z @ u + c))) - y
        new = u - step * (z.T @ err) / len(z)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b, new_t = c - step * err.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, c = new + (t - 1) / new_t * (new - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new, new_b, new_t
    return b, w


def train(x: pd.DataFrame, y: np.ndarray, trees: int = 60, depth: int = 3, penalty: float = 1e-3, seed: int = 13) -> Model:
    share = float(y.mean()) if len(y) else 0.5
    constant = Model(float(np.clip(np.log(max(share, 1e-6) / max(1 - share, 1e-6)), -6, 6)), [])
    if len(y) == 0 or y.min() == y.max():
        return constant
    rng = np.random.default_rng(seed)
    names, rules, f = list(x.columns), [], np.full(len(y), 0.0)
    for _ in range(trees):
        rows = np.sort(rng.choice(len(y), max(2, len(y) // 2), replace=False))
        some = [names[i] for i in rng.permutation(len(names))[: max(2, len(names) // 2)]]
        g = y - 1 / (1 + np.exp(-f))
        found, _ = grow(x.iloc[rows].reset_index(drop=True), g[rows], some, depth, max(3, len(y) // 200))
        rules += found
        leaf = np.zeros(len(y))
        for r in found:  # deeper paths come later and overwrite their parents
            at = holds(r, x)
            leaf[at] = g[at].mean() if at.any() else 0
        f += 0.5 * leaf * 4
    rules = list(dict.fromkeys(rules))
    if not rules:  # too few rows to split
        return constant
    z = np.stack([holds(r, x) for r in rules], axis=1).astype(float)
    bias, w = lasso(z, y.astype(float), penalty)
    return Model(bias, [(r, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-4])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        sample: int = 4000, mod: int = 4, remainder: int = 2) -> Model:
    """Learns from about ``sample`` labelled rows (by a hash of the id) that are not held out; all if there are fewer."""
    d = docs.select(F.col(id_col).alias("id"), text_of(F.col(text_col)).alias("text"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter(
        F.col("id").isNotNull() & F.col("y").isin(0, 1)).filter(~held_out(F.col("id"), mod, remainder)).distinct()
    n = max(1, known.count())
    draw = F.pmod(F.xxhash64(F.lit("quality"), "id"), F.lit(1 << 30)) / float(1 << 30)
    # a bounded number of rows, sent to where the documents are
    known = F.broadcast(known.filter(draw * n < sample))
    got = d.join(known, "id")
    small_batches(docs.sparkSession)
    got = got.select("id", "y", statistics(F.col("text")).alias("s")).select("id", "y", "s.*")
    got = got.toPandas().sort_values(["id", "y", *STATISTICS], kind="stable")
    return train(got[STATISTICS].reset_index(drop=True), got["y"].to_numpy())


def score(docs: DataFrame, model: Model, text_col: str = "text", cut: float = 0.7) -> DataFrame:
    """(row, score, predicted)."""
    small_batches(docs.sparkSession)
    rows = packed(docs).withColumn("s", statistics(text_of(F.col("row").getField(text_col))))
    rows = rows.withColumn("score", model.column({k: F.col("s").getField(k) for k in STATISTICS}))
    return rows.select("row", "score", (F.col("score") >= cut).cast("int").alias("predicted"))
