"""Language identification: averaged hashed subword embeddings under a linear softmax.

The subwords of a text are the 1- to 4-grams of its lower-cased letters inside words, with the
word's edges marked by a space. A text is the mean of its subwords' embeddings. Training runs on
the driver, in numpy, on a bounded sample of labelled rows (``per_label`` of each label, by a
hash of the id); Spark sends it the sample's sparse bucket counts, at most ``buckets`` a row.
As the model is linear in the mean, embeddings and output weights are multiplied into one table
of ``buckets x labels`` before it is sent to the executors.

A quarter of the sample is kept from training to calibrate: it gives the temperature (1 or more),
and, with the subwords of its rows exchanged for others at random, ``foreign`` rows of no known
language. A text is rejected when its calibrated score is below the limit that errs least, adding
the share of calibration rows below it and the share of foreign rows that reach it (0.5 at most);
single junk or mislabelled rows move it by no more than their share. A text of subwords that
training did not meet has a mean near zero, so its score is near the labels' shares.

Null text and text without a letter is ``und`` with score 0 and rejected; where no label can be
learned every text is. Rows with a null label or id are scored but not learned from. Repeated rows
and ties are scored one by one; of labels with equal scores the first by name is predicted. Very long
texts are read whole, a piece at a time, and counted as if they were one piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fenloom.llm.common import bounded_sample, held_out, once, packed, small_batches

ORDERS = (1, 2, 3, 4)
PIECE = 1 << 18
UND = "und"


def letters() -> np.ndarray:
    """Which code points are letters."""
    return once(("letters",), lambda: np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))


def subwords(text: str, buckets: int) -> Iterator[np.ndarray]:
    """Bucket numbers of all subwords of a whole text, a piece of about 260,000 characters at a time."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.concatenate([[np.uint32(0)], codes, [np.uint32(0)]])
    for at in range(0, len(codes), PIECE):
        # subwords that begin in a piece may end in the next one; each is counted where it begins
        yield from _grams(codes[at: at + PIECE + ORDERS[-1] - 1], PIECE, buckets)


def _grams(codes: np.ndarray, starts: int, buckets: int) -> Iterator[np.ndarray]:
    """Bucket numbers of the subwords that begin at the first ``starts`` places."""
    c = np.where(letters()[codes], codes, 0).astype(np.uint64)
    inner = c != 0
    h = c.copy()
    mask = np.uint64(buckets - 1)
    yield (_mixed(h[:starts][inner[:starts]], 1) & mask).astype(np.int32)
    for n in ORDERS[1:]:
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1:]
        # a gram may begin or end at a word's edge but not run over one
        ok = np.ones(len(h), bool)
        for j in range(1, n - 1):
            ok &= inner[j: j + len(h)]
        ok &= inner[: len(h)] | inner[n - 1:]
        yield (_mixed(h[:starts][ok[:starts]], n) & mask).astype(np.int32)


def _mixed(h: np.ndarray, n: int) -> np.ndarray:
    h = (h + np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def counts_of(text: str | None, buckets: int) -> np.ndarray:
    """How often each bucket is met in the whole text."""
    total = np.zeros(buckets)
    for grams in subwords(text or "", buckets):
        total += np.bincount(grams, minlength=buckets)
    return total


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # buckets x labels
    bias: np.ndarray
    temperature: float
    threshold: float

    def identify(self, text: str | None) -> tuple[str, float, bool]:
        """Label, calibrated score, accepted."""
        counts = counts_of(text, len(self.table))
        n = counts.sum()
        if n == 0 or not self.labels:
            return UND, 0.0, False
        p = _softmax((counts @ self.table / n + self.bias) / self.temperature)
        k = int(p.argmax())
        return self.labels[k], float(p[k]), bool(p[k] >= self.threshold)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, labels: list[str], buckets: int, dim: int = 16,
          epochs: int = 40, batch: int = 32, rate: float = 0.5, foreign: int = 4000, seed: int = 11) -> Model:
    """``rows``: buckets and counts of each text, in the order of their ids; ``y``: label numbers.

    Only a batch is ever laid out over all buckets.
    """
    rng = np.random.default_rng(seed)
    rows = [(at, (n / n.sum()).astype(np.float32)) for at, n in rows]
    order = rng.permutation(len(rows))
    cal, fit = order[: len(rows) // 4], order[len(rows) // 4:]
    emb = rng.normal(0, 0.01, (buckets, dim)).astype(np.float32)
    out = rng.normal(0, 1, (dim, len(labels))).astype(np.float32)
    bias = np.zeros(len(labels), np.float32)
    # every subword's mean is tiny, so its step is scaled up by how rarely it is met
    met = np.zeros(buckets)
    for i in fit:
        met[rows[i][0]] += rows[i][1]
    scale = np.minimum(1 / np.maximum(met / len(fit), 1e-4), 200)[:, None].astype(np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        rng.shuffle(fit)
        for at in range(0, len(fit), batch):
            some = fit[at: at + batch]
            x = np.zeros((len(some), buckets), np.float32)
            for k, i in enumerate(some):
                x[k, rows[i][0]] = rows[i][1]
            mean = x @ emb
            err = _softmax(mean @ out + bias)
            err[np.arange(len(some)), y[some]] -= 1
            err /= len(some)
            grad = x.T @ (err @ out.T)
            out -= step * (mean.T @ err)
            bias -= step * err.sum(axis=0)
            emb -= step * scale * grad
    table = (emb @ out).astype(np.float32)
    probe = cal if len(cal) else fit
    z = np.stack([rows[i][1] @ table[rows[i][0]] for i in probe]) + bias
    grid = np.geomspace(1, 20, 40)
    loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(probe)), y[probe]], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    known = np.sort(_softmax(z / temperature).max(axis=1))
    strange = []
    for k in range(max(foreign, len(probe))):
        at, n = rows[probe[k % len(probe)]]
        strange.append(n @ table[rng.permutation(buckets)[at]])
    strange = np.sort(_softmax((np.stack(strange) + bias) / temperature).max(axis=1))
    limits = np.unique(np.concatenate([known, strange]))
    errors = np.searchsorted(known, limits) / len(known) + 1 - np.searchsorted(strange, limits) / len(strange)
    threshold = min(0.5, float(limits[int(np.argmin(errors))]))
    return Model(labels, table, bias.astype(np.float64), temperature, threshold)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_label: int = 400,
        buckets: int = 1 << 13, mod: int = 5, remainder: int = 0) -> Model:
    """Learns from ``per_label`` rows of each label among those that are not held out."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"))
    known = known.filter("id IS NOT NULL AND label IS NOT NULL").filter(~held_out(F.col("id"), mod, remainder))
    sample = bounded_sample(known, F.col("id"), per_label, "label")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where, what = [], []
            for text in b.column(1):
                c = counts_of(text.as_py(), buckets)
                at = np.flatnonzero(c)
                where.append(at.astype(np.int32))
                what.append(c[at])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(where, pa.list_(pa.int32())), pa.array(what, pa.list_(pa.float32()))],
                names=["id", "label", "at", "n"])

    got = sample.select("id", "text", "label").mapInArrow(
        sparse, f"id {dict(known.dtypes)['id']}, label string, at array<int>, n array<float>").toArrow()
    got = got.sort_by([("id", "ascending"), ("label", "ascending")]).combine_chunks()
    rows, names = [], []
    for at, n, label in zip(got["at"].combine_chunks(), got["n"].combine_chunks(), got["label"].to_pylist()):
        if len(at):
            rows.append((at.values.to_numpy(), n.values.to_numpy()))
            names.append(label)
    labels = sorted(set(names))
    if not labels:
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros(0), 1.0, 1.0)
    return train(rows, np.array([labels.index(x) for x in names]), labels, buckets)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(row, lang_pred, score, accepted) from the whole text of each row; only the text goes to Python."""
    small_batches(docs.sparkSession)
    rows = packed(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred:string,score:double,accepted:boolean>")
    def identify(texts: pd.Series) -> pd.DataFrame:
        m = sent.value
        return pd.DataFrame([m.identify(t) for t in texts], columns=["lang_pred", "score", "accepted"])

    return rows.withColumn("_p", identify(F.col("row").getField(text_col))).select("row", "_p.*")
