import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fenloom.llm import tokenfiles, tokens
from fenloom.session import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["a<|endoftext|>b  c", "Σας ΟΔΟΣ ΟΔΟΣ. x", "é ́a", "a b　c\x1cd", "  ", "it's I'LL '", "\x00x\x85y",
         "<|endoftext|> <|startoftext|>x", None, "12 345", "the " * 50]


def test_words_encoded_alone_give_the_ids_of_the_text():
    e = tokenfiles.Encoder(PATH)
    for text, ids in zip(TEXTS, e.encode([(t or "").encode() for t in TEXTS], 2)):
        assert np.frombuffer(ids, "<u2").tolist() == e.whole(text or "") + [2]


def test_a_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 5)
    e = tokenfiles.Encoder(PATH)
    for _ in range(2):
        for text in TEXTS:
            assert np.frombuffer(e.encode([(text or "").encode()], 2)[0], "<u2").tolist() == e.whole(text or "") + [2]
    assert len(e.runs.known) <= 5


def _want(rows):
    t = Tokenizer.from_file(PATH)
    out, at = {}, 0
    for doc_id, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out[doc_id] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        at += len(ids)
    return out


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_files(spark, monkeypatch, block):
    monkeypatch.setattr(tokenfiles, "BLOCK_BYTES", block)
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(200)]
    folder = scratch_path(spark, "tokens")
    tokenfiles.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), folder, PATH)
    want = _want(rows)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenfiles.read(spark, folder).collect()}
    assert got == {k: v[:3] for k, v in want.items()}
    few = tokenfiles.fetch(spark, folder, [3, 150])
    assert {k: v.tolist() for k, v in few.items()} == {k: want[k][3] for k in (3, 150)}


def test_odd_rows(spark, odd_docs, no_docs):
    folder = scratch_path(spark, "tokens")
    tokenfiles.write(odd_docs, folder, PATH)
    got = sorted(tokenfiles.read(spark, folder).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i)) and len(ids) == odd_docs.count()
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    folder = scratch_path(spark, "tokens")
    tokenfiles.write(no_docs, folder, PATH)
    assert tokenfiles.read(spark, folder).count() == 0


def test_the_setting_of_the_session_stays(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    tokenfiles.write(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), scratch_path(spark, "tokens"), PATH)
    assert spark.conf.get(key, None) == before
