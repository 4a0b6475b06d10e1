import heapq
import random

import pytest
from pyspark.sql import functions as F

from fenloom.llm import mixing
from fenloom.llm.common import chunked
from fenloom.session import cut_lineage
from tests.compare import moved_columns


def test_highest_quotients_against_the_plain_rule(spark):
    r = random.Random(4)
    parties = [(f"p{i:02}", r.choice([1.0, 3.0, 50.0, 1000.0 * r.random()])) for i in range(30)]
    for seats in (0, 1, 29, 500, 4321):
        got = mixing.highest_quotients(spark.createDataFrame(parties, "k string, votes double"), [], ["k"], "votes",
                                       F.lit(seats), F.lit(1 << 40)).collect()
        heap, won = [(-v, k, 1) for k, v in parties], {k: 0 for k, _ in parties}
        heapq.heapify(heap)
        votes = dict(parties)
        for _ in range(seats):
            _, k, s = heapq.heappop(heap)
            won[k] += 1
            heapq.heappush(heap, (-votes[k] / (2 * s + 1), k, s + 1))
        assert {x["k"]: x["quota"] for x in got} == won


def _targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {n: weights[i % 3] for i, n in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [n for n in names if n not in capped]
        left = total - sum(2 * sizes[n] for n in capped)
        level = left / sum(w[n] for n in free) if free else 0
        over = {n for n in free if level * w[n] > 2 * sizes[n]}
        if not over:
            return {n: 2 * sizes[n] if n in capped else level * w[n] for n in names}
        capped |= over


def test_mix_and_its_documents(spark, odd_docs):
    r = random.Random(2)
    rows = [(i, " ".join("w%d" % r.randint(0, 99) for _ in range(r.choice([0, 1, 30, 300, 2000]))), r.choice(["a", "a", "a", "b", "c", None]))
            for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    spool = cut_lineage(mixing.sized(docs, "doc_id", "source", "text"))
    m = mixing.Mix(spool.drop("row"), shard_words=20_000)
    got = {x["id"]: x for x in m.rows.collect()}
    sizes = {}
    for i, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
        assert got[i]["size"] == len(text.split()) and 0 <= got[i]["taken"] <= 2 * got[i]["size"]
    want = _targets(sizes)
    for s, size in sizes.items():
        mine = [x for x in got.values() if x["source"] == s]
        assert all(x["source_size"] == size and x["target"] == pytest.approx(want[s]) for x in mine)
        assert abs(sum(x["taken"] for x in mine) - want[s]) < max(200, 0.01 * want[s])
    taken = m.take(spool, "text", docs.columns).collect()
    words = {}
    for x in taken:
        words[x["doc_id"]] = words.get(x["doc_id"], 0) + len(x["text"].split())
        assert x["text"] in dict((i, t) for i, t, _ in rows)[x["doc_id"]] or len(x["text"].split()) < got[x["doc_id"]]["size"]
    assert words == {i: x["taken"] for i, x in got.items() if x["taken"]}
    again = mixing.Mix(spool.drop("row").repartition(2), shard_words=20_000).rows
    assert {x["id"]: x["taken"] for x in again.collect()} == {i: x["taken"] for i, x in got.items()}


def test_repeated_ids_are_spread(spark):
    rows = [(None if i % 2 else i % 7, f"text {i} " + "x " * (i % 5), "a") for i in range(6000)]
    spool = cut_lineage(mixing.sized(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5), "doc_id", "source", "text"))
    m = mixing.Mix(spool.drop("row"), shard_rows=200, block_words=4)
    assert m.rows.groupBy("shard").count().agg(F.max("count"), F.count("*")).first()[0] < 400

    def by_text(mix):
        return {x["text"]: x["taken"] for x in spool.select("rid", "row.text").join(mix.rows.select("rid", "taken"), "rid").collect()}

    assert by_text(m) == by_text(mixing.Mix(spool.drop("row").repartition(3), shard_rows=200, block_words=4))


def test_odd_rows(odd_docs):
    spool = cut_lineage(mixing.sized(odd_docs, "doc_id", "source", "text"))
    m = mixing.Mix(spool.drop("row"))
    got = m.rows.collect()
    assert len(got) == odd_docs.count() and all(0 <= x["taken"] <= 2 * x["size"] for x in got)
    assert m.take(spool, "text", odd_docs.columns).columns == odd_docs.columns


def test_empty(no_docs):
    spool = cut_lineage(mixing.sized(no_docs, "doc_id", "source", "text"))
    m = mixing.Mix(spool.drop("row"))
    assert m.rows.count() == 0 and m.take(spool, "text", no_docs.columns).count() == 0


def test_texts_of_the_mix_stay_in_place(spark, monkeypatch):
    """Rows are not shuffled, a cut text is split into words once, and long chunks come as several arrays."""
    text = [" ".join(f"w{i}_{k}" for k in range(40 + 37 * i % 900)) for i in range(300)]
    rows = [(i, t, "abc"[i % 3] if i % 7 else None) for i, t in enumerate(text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    spool = chunked(mixing.sized(docs, "doc_id", "source", "text"), docs.rdd.getNumPartitions(), "sizes")
    m = mixing.Mix(spool.drop("row", "chunk"))
    took = m.take(spool, "text", docs.columns)
    assert moved_columns(took) and not [c for c in moved_columns(took) if "row#" in c]
    assert "slice(regexp_extract_all" not in took._jdf.queryExecution().optimizedPlan().toString()
    want = sorted(map(tuple, took.collect()), key=str)
    words = {r.id: r.taken for r in m.rows.collect()}
    assert {i: sum(len(r[1].split()) for r in want if r[0] == i) for i in words} == words
    monkeypatch.setattr(mixing, "RUN", 7)
    assert sorted(map(tuple, m.take(spool, "text", docs.columns).collect()), key=str) == want
