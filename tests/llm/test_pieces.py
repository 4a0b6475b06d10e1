import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from fenloom.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a   b", "x\n\n  y z 你好 \U0001F600", "abc" * 100 + " the", " " * 100 + "q", "a\x00b\t", None, "The end of the", "á é"]


@pytest.fixture(scope="module")
def p():
    return pieces.Pieces(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def _each(p, texts, keys, dropout):
    ids, n = p.encode(texts, keys, dropout)
    at = np.concatenate([[0], np.cumsum(n)])
    return [ids[a:b] for a, b in zip(at[:-1], at[1:])]


def _keys(n):
    return np.arange(n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def test_without_dropout_the_ids_are_the_librarys(p, library):
    for text, ids in zip(ODD, _each(p, ODD, _keys(len(ODD)), 0.0)):
        assert ids.tolist() == library.encode(text or "")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60), st.floats(0, 1))
def test_every_text_comes_back(text, dropout):
    p = pieces.pieces(PATH)
    ids = _each(p, [text], _keys(1), dropout)[0]
    assert p.decode(ids) == text
    if "▁" not in text and "\x00" not in text and dropout == 0:
        assert sentencepiece.SentencePieceProcessor(model_file=PATH).decode(ids.tolist()) == text


def test_heap_and_side_by_side_agree(p, monkeypatch):
    texts = ["the quick brown fox jumps over the lazy dog " * 20, "internationalisation" * 3]
    fast = _each(p, texts, _keys(2), 0.2)
    monkeypatch.setattr(pieces, "LONG", 1)
    assert all((a == b).all() for a, b in zip(fast, _each(p, texts, _keys(2), 0.2)))


def test_cutting_a_long_text_changes_nothing(p, monkeypatch):
    text = "some words, and  more words " * 100
    whole = _each(p, [text], _keys(1), 0.1)[0]
    monkeypatch.setattr(pieces, "CALL", 64)
    assert (whole == _each(p, [text], _keys(1), 0.1)[0]).all()


def test_dropout_varies_by_key_and_can_drop_everything(p):
    text = "several different segmentations of one sentence"
    many = {tuple(_each(p, [text], np.array([k], np.uint64), 0.3)[0]) for k in range(1, 30)}
    assert len(many) > 20
    alone = _each(p, [text], _keys(1), 1.0)[0]
    assert len(alone) == len(text) + 1


def test_columns(odd_docs, no_docs):
    coded = pieces.encode_documents(odd_docs, PATH)
    got = coded.select(F.coalesce("row.text", F.lit("")).alias("t"), pieces.text_from(F.col("ids"), PATH).alias("back"), F.size("ids").alias("n")).collect()
    assert len(got) == odd_docs.count() and all(r["t"] == r["back"] and (r["n"] > 0) == (r["t"] != "") for r in got)
    again = pieces.encode_documents(odd_docs.repartition(1), PATH)
    assert sorted(map(str, again.select("ids").collect())) == sorted(map(str, coded.select("ids").collect()))
    assert pieces.encode_documents(no_docs, PATH).count() == 0


def test_checked_in_the_worker_that_encodes(spark, odd_docs):
    """The pipeline's stage takes one Python worker a task; its ids and its check are those of the two steps."""
    out = corpus_pipeline.encoded(spark, odd_docs, "")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"MapInArrow|EvalPython", plan)) == 1
    back = pieces.text_from(F.col("ids"), PATH) == F.coalesce("row.text", F.lit(""))
    want = pieces.encode_documents(odd_docs, PATH).select("row.doc_id", "ids", back.alias("lossless")).collect()
    got = out.select("doc_id", "ids", "lossless").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and all(r.lossless for r in got)
