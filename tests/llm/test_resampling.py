import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from fenloom.llm import resampling
from fenloom.llm.resampling import CLEAN, Joiner, dictionary, emitted, features

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def test_checksums_of_joined_strings():
    r, j = random.Random(1), Joiner()
    a = [bytes(r.randrange(256) for _ in range(r.choice([0, 1, 9, 300]))) for _ in range(200)]
    b = [bytes(r.randrange(256) for _ in range(r.choice([0, 1, 7, 1000]))) for _ in range(200)]
    got = j.join(np.array([zlib.crc32(x) for x in a]), np.array([zlib.crc32(x) for x in b]), np.array([len(x) for x in b]))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b)]


@pytest.mark.parametrize("lo,hi", [(1, 1), (1, 3), (2, 4)])
def test_features_against_the_plain_rule(lo, hi):
    r = random.Random(2)
    bits = ["a", "ab", "Ab", "b", "é", "日本", " ", "  ", "-", "\x00", "\n", "1", "x" * 300, ",", "\x7f", " "]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 60))) for _ in range(60)] + [""]
    clean, j = [t.encode().translate(CLEAN) for t in texts], Joiner()
    auto = dictionary(clean)
    for t, c in zip(texts, clean):
        w = words(t)
        payload = emitted(auto, c)
        assert [(p >> 32, p & 0xFFFFFFFF) for p in payload.tolist()] == [(len(x.encode()), zlib.crc32(x.encode())) for x in w]
        want = [zlib.crc32(" ".join(w[i:i + n]).encode()) for n in range(lo, hi + 1) for i in range(len(w) - n + 1)]
        assert features(payload, lo, hi, j).tolist() == want
    assert dictionary([b"  "]) is None


def brute(docs, target, lo, hi, buckets, seed, min_words, percent):
    def hashed(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(lo, hi + 1) for i in range(len(w) - n + 1)]

    s, t = [0] * buckets, [0] * buckets
    for _, text in docs:
        for x in hashed(text):
            s[x] += 1
    for text in target:
        for x in hashed(text):
            t[x] += 1
    gain = [math.floor(1000 * math.log(((b + 1) * (sum(s) + buckets)) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    rows = []
    for doc_id, text in docs:
        f = hashed(text)
        weight = sum(gain[x] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = i + 1
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("lo,hi", [(1, 1), (1, 2)])
def test_draw_against_brute_force(spark, odd_docs, lo, hi):
    r = random.Random(4)
    target = [" ".join(r.choice(["one", "two", "the", "license", "mit"]) for _ in range(30)) for _ in range(5)] + [None, ""]
    more = [(100 + i, " ".join(r.choice(["one", "two", "six", "x", "mit"]) for _ in range(r.randint(0, 40)))) for i in range(300)]
    rows = [(x["doc_id"], x["text"]) for x in odd_docs.collect()] + more + [(None, "one two " * 15)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    tables = spark.createDataFrame([(t,) for t in target], "text string")
    for percent in (0, 10, 55, 100):
        got = resampling.resample(docs, tables, lo=lo, hi=hi, buckets=97, seed=7, min_words=3, percent=percent)
        want = brute(rows, target, lo, hi, 97, 7, 3, percent)
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_sql_on_odd_rows(spark, odd_docs):
    rows = [(x["doc_id"], x["text"]) for x in odd_docs.collect() if "\x00" not in (x["text"] or "")]
    docs, target = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("one two the mit",)], "text string")
    con = duckdb.connect()
    for name, df in (("documents", docs), ("benchmark", target)):
        con.register(name, df.toArrow())
    want = con.execute(resampling.oracle(min_words=3, percent=50)).fetchall()
    got = resampling.resample(docs, target, hi=1, min_words=3, percent=50).select("id", "n_features", "weight", "score", "rank").collect()
    key = lambda r: tuple((v is not None, v or 0) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def test_empty(spark, no_docs):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(no_docs, none).count() == 0
    assert resampling.resample(spark.createDataFrame([(1, "one")], "doc_id long, text string"), none, min_words=1, percent=100).collect()[0]["rank"] == 1
