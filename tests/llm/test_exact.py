import re

import numpy as np
from hypothesis import given, settings, strategies as st

from fenloom.llm import exact
from tests.compare import moved_columns


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**62), unique=True, max_size=200))
def test_golomb_round_trip(values):
    v = np.sort(np.array(values, np.int64))
    assert (exact.golomb_decode(exact.golomb_encode(v), len(v)) == v).all()


def test_golomb_is_short():
    v = np.sort(np.random.default_rng(0).integers(0, 1 << 40, 10_000))
    assert len(exact.golomb_encode(np.unique(v))) < 10_000 * 4


def _want(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), []).append(r["doc_id"])
    out = []
    for norm, ids in groups.items():
        known = sorted(i for i in ids if i is not None)
        out += [(i, known[0] if known else None, len(ids)) for i in ids]
    return sorted(out, key=str), len(groups)


def test_odd_rows(odd_docs):
    run = exact.ExactDedup(odd_docs)
    got = run.report().collect()
    want, n_groups = _want(odd_docs.collect())
    assert sorted([(r["id"], r["keep_id"], r["group_size"]) for r in got], key=str) == want
    assert sum(r["kept"] for r in got) == n_groups
    kept = run.kept()
    assert kept.columns == odd_docs.columns and kept.count() == n_groups


def test_colliding_fingerprints_change_nothing(odd_docs):
    got = exact.ExactDedup(odd_docs, bits=2).report().collect()
    assert sorted([(r["id"], r["keep_id"], r["group_size"]) for r in got], key=str) == _want(odd_docs.collect())[0]


def test_empty(no_docs):
    run = exact.ExactDedup(no_docs)
    assert run.report().count() == 0 and run.kept().count() == 0


def test_rows_that_stay_do_not_move(spark, odd_docs):
    """Without a broadcast too: a join by row number was pushed below the bitmaps and shuffled every row."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        run = exact.ExactDedup(odd_docs)
        kept = run.kept()
        assert moved_columns(kept) and not [c for c in moved_columns(kept) if "row#" in c]
        assert kept.count() == _want(odd_docs.collect())[1]
    finally:
        spark.conf.set(key, before)
