import random
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fenloom.llm.packing import Packing, best_fit, bin_completion, lower_bound
from fenloom.llm.tokens import RunEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def fewest(items, size):
    """The least number of sequences, by trying every set that holds the longest piece left."""

    @lru_cache(None)
    def need(left):
        if not left:
            return 0
        best, rest = len(left), left[1:]
        for mask in range(1 << len(rest)):
            used = [x for i, x in enumerate(rest) if mask >> i & 1]
            if left[0] + sum(used) <= size:
                best = min(best, 1 + need(tuple(x for i, x in enumerate(rest) if not mask >> i & 1)))
        return best

    return need(tuple(sorted(items, reverse=True)))


def counted(items, size):
    return np.bincount(items, minlength=size + 1)


def used(plan, size):
    out = np.zeros(size + 1, int)
    for filling, times in plan:
        assert times > 0 and sum(x * k for x, k in filling) <= size
        for x, k in filling:
            out[x] += k * times
    return out


def test_small_packings_are_optimal():
    r, better = random.Random(5), 0
    for k in range(250):
        size = r.choice([10, 30, 100])
        items = [r.randint(1, size // r.choice([1, 2, 3])) for _ in range(r.randint(1, 10))]
        if k % 2:  # full sequences cut at random, which best fit often misses
            cuts = [sorted(r.sample(range(1, 100), 2)) for _ in range(4)]
            size, items = 100, [x for a, b in cuts for x in (a, b - a, 100 - b)]
        c = counted(items, size)
        plan = bin_completion(c, size, nodes=20_000, width=1000, steps=100_000)
        assert (used(plan, size) == c).all()
        n = sum(t for _, t in plan)
        assert lower_bound(c, size) <= n == fewest(items, size), (items, size)
        better += n < sum(t for _, t in best_fit(c, size))
    assert better > 0


def test_equal_sequences_are_planned_at_once():
    size, items = 12, np.array([0, 0, 0, 3, 0, 3, 3, 0, 0, 0, 0, 0, 0]) * 10**9
    plan = bin_completion(items, size)
    assert (used(plan, size) == items).all() and len(plan) < 20
    assert sum(t for _, t in plan) >= lower_bound(items, size)
    triples = counted([4, 4, 4, 3, 3, 3, 3, 6, 6, 5, 7] * 6, 12)
    assert sum(t for _, t in bin_completion(triples, 12)) == lower_bound(triples, 12)


def test_best_fit_against_the_plain_rule():
    r = random.Random(8)
    for _ in range(100):
        items, rooms = [r.randint(1, 20) for _ in range(60)], []
        for x in sorted(items, reverse=True):
            fit = [i for i, room in enumerate(rooms) if room >= x]
            if fit:
                rooms[min(fit, key=lambda i: rooms[i])] -= x
            else:
                rooms.append(20 - x)
        plan = best_fit(counted(items, 20), 20)
        assert sorted(20 - sum(x * k for x, k in f) for f, t in plan for _ in range(t)) == sorted(rooms)


def test_ids_are_those_of_whole_texts():
    e, r = RunEncoder(PATH), random.Random(3)
    bits = ["a", "B", "the", "'s", "'", "don't", "<|endoftext|>", "<", "9", "12", "é", "é", "ß", "İ", "×", "ñ,", "≠", "\xa0", "\x85",
            "\x1c", "\x00", "\x7f", "_", "...", "日本", "½", " ", "  ", "\n", "\t", "\r", "😀", "Ω", "ﬁ"]
    for _ in range(300):
        texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(r.randint(1, 4))]
        ids, at = e.encode([t.encode() for t in texts], 2)
        for i, t in enumerate(texts):
            assert ids[at[i]:at[i + 1]].tolist() == [*e.whole(t), 2], t


@pytest.mark.parametrize("size", [16, 2048])
def test_documents(spark, odd_docs, size):
    p = Packing(odd_docs, PATH, size=size)
    rows = p.placed("ids").collect()
    tok, docs = Tokenizer.from_file(PATH), {}
    for r in odd_docs.collect():
        docs.setdefault(r["doc_id"], []).append([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0])
    want = sorted((repr(d), k, k * size, len(ids[k * size:(k + 1) * size]),
                   zlib.crc32(np.array(ids[k * size:(k + 1) * size], "<u4").tobytes()))
                  for d, texts in docs.items() for ids in texts for k in range(-(-len(ids) // size)))
    assert sorted((repr(r["id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for parts in by.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    assert len(by) == p.sequences_used >= p.bound
    for r in p.sequences().collect():
        parts = sorted(by[r["sequence_id"]], key=lambda x: x["offset"])
        assert bytes(r["ids"]) == b"".join(bytes(x["ids"]) for x in parts) and r["n_tokens"] * 4 == len(r["ids"])


def test_empty(no_docs):
    p = Packing(no_docs, PATH)
    assert p.placed().count() == 0 and p.sequences().count() == 0 and p.sequences_used == 0
