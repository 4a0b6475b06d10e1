import numpy as np
import pytest
from pyspark.sql import functions as F

from fenloom.llm import langid
from fenloom.llm.common import held_out

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    got = langid.predict(docs, model).filter(held_out(F.col("row.doc_id"), 5, 0)).collect()
    right = [r["row"]["lang"] == r["lang_pred"] for r in got]
    assert len(right) > 10 and np.mean(right) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got) and np.mean([r["accepted"] for r in got]) > 0.95


def test_foreign_script_is_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    odd = spark.createDataFrame([(1, "съешь же ещё этих мягких булок " * 5), (2, "12 34 !!"), (3, None), (4, "")], "doc_id long, text string")
    got = {r["row"]["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert not any(r["accepted"] for r in got.values())
    assert got[1]["score"] < 0.9 and [got[i]["lang_pred"] for i in (2, 3, 4)] == ["und"] * 3


def test_a_junk_row_does_not_lower_the_limit():
    r = np.random.default_rng(3)
    y = np.arange(400) % 4
    rows = [(np.arange(50) + 50 * k, r.integers(1, 9, 50).astype(np.float32)) for k in y]
    junk = np.random.default_rng(11).permutation(400)[0]  # among the rows kept to calibrate
    rows[junk] = (np.arange(500, 550), np.ones(50, np.float32))
    model = langid.train(rows, y, list("abcd"), 1024)
    assert model.threshold == 0.5


def plain_counts(text, buckets):
    """Subwords of a text by one loop over its words."""
    out, low = np.zeros(buckets), 2 ** 64 - 1
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split(" ")
    for w in words:
        edged = [0, *map(ord, w), 0]
        for n in (1, 2, 3, 4):
            for i in range(len(edged) - n + 1):
                gram = edged[i: i + n]
                if not w or (gram[0] == 0 and gram[-1] == 0):
                    continue
                h = 0
                for c in gram:
                    h = (h * 0x9E3779B97F4A7C15 + c) & low
                h = (h + n) * 0xBF58476D1CE4E5B9 & low
                h = (h ^ h >> 29) * 0x94D049BB133111EB & low
                out[(h ^ h >> 32) & (buckets - 1)] += 1
    return out


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 126, 1 << 18])
def test_subwords_against_a_plain_loop_whatever_the_pieces(monkeypatch, piece):
    monkeypatch.setattr(langid, "PIECE", piece)
    for text in ("Alpha beta, gamma " * 20, "", "a", "ab c", "Straße \U0001F600 é́ İ\x00x", "12 34", None):
        assert (langid.counts_of(text, 1024) == plain_counts(text, 1024)).all(), text


def test_prediction_against_a_plain_softmax(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    for r in langid.predict(docs.limit(20), model).collect():
        counts = plain_counts(r["row"]["text"], len(model.table))
        z = [sum(counts[b] * model.table[b, k] for b in np.flatnonzero(counts)) / counts.sum() + model.bias[k] for k in range(len(model.labels))]
        e = [np.exp(x / model.temperature) for x in z]
        assert r["lang_pred"] == model.labels[int(np.argmax(e))] and abs(r["score"] - max(e) / sum(e)) < 1e-5


def test_odd_rows(odd_docs):
    got = langid.predict(odd_docs, langid.fit(odd_docs)).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        has = any(c.isalpha() for c in r["row"]["text"] or "")
        assert (r["lang_pred"] == "und") == (not has) and (has or (r["score"] == 0 and not r["accepted"]))


def test_nothing_to_learn(no_docs, odd_docs):
    model = langid.fit(no_docs)
    assert langid.predict(no_docs, model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd_docs, model).collect()} == {"und"}
