import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from fenloom.llm import quality
from fenloom.llm.common import utf8_parts

SF = "/root/testdata/sf0.01"


def test_held_out_labels_and_compiled_rules(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    assert 0 < len(model.rules) < 200
    got = quality.score(docs, model).select("row.doc_id", "score", "predicted").join(labels, "doc_id").filter(
        "crc32(cast(doc_id as string)) % 4 = 2").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.95
    x = docs.select("doc_id", quality.statistics(F.coalesce("text", F.lit(""))).alias("s")).select("doc_id", "s.*").toPandas().set_index("doc_id")
    mine = quality.score(docs, model).select("row.doc_id", "score").toPandas().set_index("doc_id")["score"]
    assert np.allclose(model.score(x.loc[mine.index]), mine)


def test_large_strings():
    texts = ["Ab é", "", "xyz"]
    for kind in (pa.string(), pa.large_string()):
        starts, data = utf8_parts(pa.array(["cut off", *texts], kind)[1:])
        assert [bytes(data[a:b]).decode() for a, b in zip(starts, starts[1:])] == texts


def test_statistics():
    texts = ["Ab, cd. AB, x\nAb, cd. AB, x", "", "é É!! | 12", " \n "]
    raw = [t.encode() for t in texts]
    got = quality.measure(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]))
    assert sorted(got) == sorted(quality.STATISTICS)
    assert np.allclose(np.expm1(got["log_chars"]), [27, 0, 10, 3]) and np.allclose(np.expm1(got["log_words"]), [8, 0, 4, 0])
    assert got["distinct_words"][0] == 3 / 8 and got["distinct_lines"][0] == 0.5 and got["full_stops"][0] == 2 / 8
    assert got["capital_starts"][0] == 4 / 8 and got["bars"][2] == 0.1 and got["digits"][2] == 0.2 and got["shouts"][2] == 0.2
    assert got["commas"][0] == 4 / 8 and got["repeats"][0] == 0 and got["words_a_line"][0] == 4


def test_tree_splits_where_the_residuals_do():
    x = pd.DataFrame({"a": [0.0, 1, 2, 3, 4, 5], "b": [1.0] * 6})
    rules, fit = quality.grow(x, np.array([0, 0, 0, 1.0, 1, 1]), ["a", "b"], 1, 1)
    assert rules == [(("a", "<=", 2.5),), (("a", ">", 2.5),)] and fit.tolist() == [0, 0, 0, 1, 1, 1]


def test_lasso_drops_what_does_not_help():
    rng = np.random.default_rng(0)
    z = (rng.random((500, 20)) < 0.5).astype(float)
    y = (rng.random(500) < np.where(z[:, 3] > 0, 0.95, 0.05)).astype(float)
    _, w = quality.lasso(z, y, 0.02)
    assert w[3] > 2 and (w != 0).sum() < 10


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in (1, 3, 4, 7, 9, 9, 13, 14)] + [(2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for model in (quality.fit(odd_docs, labels), quality.fit(no_docs, labels), quality.fit(odd_docs, labels.limit(0))):
        got = quality.score(odd_docs, model).collect()
        assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
        assert quality.score(no_docs, model).count() == 0
