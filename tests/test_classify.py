"""Confidence along a lineage against plain arithmetic."""

import math
import random
from collections import Counter

import pytest

from fenloom.operators import reads as R

K = 4


def _plain(train, seq, cutoff):
    grams = lambda t: [t[i: i + K] for i in range(len(t) - K + 1)]
    words, docs = {}, Counter(label for label, _ in train)
    for label, t in train:
        words.setdefault(label, Counter()).update(grams(t))
    v = len({w for c in words.values() for w in c})
    score = {c: math.log(docs[c] / len(train)) + sum(math.log((words[c][w] + 1) / (sum(words[c].values()) + v)) for w in grams(seq)) for c in words}
    top = max(score.values())
    best = max((s, c) for c, s in score.items())[1].split(";")
    p = {c: math.exp(s - top) for c, s in score.items()}
    for n in range(len(best), -1, -1):
        conf = sum(x for c, x in p.items() if c.split(";")[:n] == best[:n]) / sum(p.values())
        if conf >= cutoff or n == 0:
            return n, ";".join(best[:n]), conf


def _family(seed):
    """Three ranks; sequences of one branch are changed copies of its own."""
    r = random.Random(seed)
    change = lambda t, share: "".join(r.choice("ACGT") if r.random() < share else c for c in t)
    train = []
    for a in "xyz":
        at_a = "".join(r.choice("ACGT") for _ in range(300))
        for b in "pq":
            at_b = change(at_a, 0.2)
            for c in range(3):
                at_c = change(at_b, 0.04)
                train += [(f"{a};{a}{b};{a}{b}{c}", change(at_c, 0.02)) for _ in range(r.randint(1, 4))]
    return train, r


@pytest.mark.parametrize("cutoff", [0.7, 0.95])
def test_confidence_at_each_rank(spark, cutoff):
    train, r = _family(3)
    seqs = []
    for i in range(60):
        t = r.choice(train)[1]
        at, n = r.randint(0, 200), r.choice([K, 8, 15, 40, 300])
        seqs.append((i, t[at: at + n] if i % 5 else "".join(r.choice("ACGTN") for _ in range(n))))
    seqs += [(60, "NNNNNNNN"), (61, "ACG"), (62, ""), (63, None)]  # without a hit, without a k-mer
    model = R.train_classifier(spark.createDataFrame(train, "label string, seq string"), "label", K)
    rows = R.classify_lineages(spark.createDataFrame(seqs, "seq_id int, seq string"), model, K, cutoff).collect()
    got = {x.seq_id: (x.rank, x.lineage, x.confidence) for x in rows}
    assert len(rows) == len(got) == 61
    for i, t in seqs[:61]:
        n, lineage, conf = _plain(train, t, cutoff)
        assert got[i][:2] == (n, lineage) and got[i][2] == pytest.approx(conf, rel=1e-9), (i, t)
    assert {got[i][0] for i in got} == {0, 1, 2, 3}
