import random
import re
from collections import Counter

import numpy as np
import pytest

from fenloom.llm import near


def test_signatures_agree_as_often_as_weights_overlap():
    rng = np.random.default_rng(0)
    e = rng.integers(0, 2**63, 300).astype(np.uint64)
    a = rng.choice([0.25, 1.0, 2.0, 7.5, 40.0], 300)
    b = np.where(rng.random(300) < 0.3, rng.choice([0.5, 1.0, 3.0], 300), a)
    sig = near.dart_signatures(np.concatenate([e, e]), np.concatenate([a, b]), np.repeat([0, 1], 300), 2, 20_000, 3)
    assert (sig != 0).all()
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.015
    alone = near.dart_signatures(e, a, np.zeros(300, int), 1, 20_000, 3)
    assert (alone[0] == sig[0]).all()  # a signature does not depend on its batch


def test_word_hashes_do_not_depend_on_the_cut():
    texts = ["Ab c, d-É9 zz", "", "ab C d é9 ZZ!", "a" * 50, "b"]
    raw = [t.encode() for t in texts]
    data, starts = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])
    w, s = near.word_hashes(data, starts)
    w2, s2 = near.word_hashes(data, starts, piece=4)
    assert (w == w2).all() and (s == s2).all() and s.tolist() == [0, 5, 5, 10, 11, 12]
    assert len(set(w[:5])) == 5 and w[0] == w[5] and w[3] != w[8] or w[3] == w[8]


def _bag(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return Counter(tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def _groups(rows):
    """Smallest id of each row's group, by comparing all pairs."""
    bags, root = [_bag(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(bags):
        for j in range(i):
            if a is not None and bags[j] is not None:
                both, either = sum((a & bags[j]).values()), sum((a | bags[j]).values())
                if 5 * both >= 4 * either:
                    x, y = sorted((find(i), find(j)))
                    root[y] = x
    out, members = {}, {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(i)
    for part in members.values():
        ids = [rows[i][0] for i in part if rows[i][0] is not None]
        for i in part:
            out[i] = (rows[i][0], min(ids, default=None), len(part))
    return sorted(out.values(), key=str)


def test_families_against_all_pairs(spark):
    r = random.Random(5)
    words = ["w%d" % i for i in range(5000)]
    rows, n = [], 0
    for family in range(12):
        base = [r.choice(words) for _ in range(r.choice([6, 40, 200]))]
        for _ in range(r.choice([1, 3, 12])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):  # some stay above the threshold, some fall below
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((n, " ".join(copy) + r.choice(["", ".", "!"])))
            n += 1
    chain = [r.choice(words) for _ in range(120)]
    for i in range(30):  # each close to the next, the ends far apart
        chain = chain[2:] + [r.choice(words) for _ in range(2)]
        rows.append((n, " ".join(chain)))
        n += 1
    hub = [r.choice(words) for _ in range(100)]
    for i in range(40):  # all close to one, hardly to each other
        copy = list(hub)
        if i:
            copy[r.randrange(50)] = copy[50 + r.randrange(50)] = "x%d" % i
        rows.append((n, " ".join(copy)))
        n += 1
    r.shuffle(rows)
    got = near.NearDuplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).report().collect()
    assert sorted([(x["id"], x["group_id"], x["group_size"]) for x in got], key=str) == _groups(rows)
    assert sum(x["kept"] for x in got) == len({x["group_id"] for x in got})


def test_odd_rows(odd_docs, no_docs):
    run = near.NearDuplicates(odd_docs, keep_rows=True)
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = run.report().collect()
    assert sorted([(x["id"], x["group_id"], x["group_size"]) for x in got], key=str) == _groups(rows)
    assert run.kept().columns == odd_docs.columns and run.kept().count() == sum(x["kept"] for x in got)
    assert near.NearDuplicates(no_docs).report().count() == 0


@pytest.mark.parametrize("weight", [1e-3, 1.0, 1e5])
def test_any_weight_fills_the_signature(weight):
    sig = near.dart_signatures(np.array([12345678901234567], np.uint64), np.array([weight]), np.zeros(1, int), 1, 64, 1)
    assert (sig != 0).all()
