import random
import re
from collections import Counter

import duckdb
import pytest

from fenloom.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, longest=4, most=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    cands = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in cands.items():
        if any(100 * b >= 80 * a and len(v) > len(w) and other == lang and any(v[i:i + len(w)] == w for i in range(len(v)))
               for (other, v), b in cands.items()):
            continue
        score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    seen = Counter()
    ranked = []
    for r in out:
        seen[r[0]] += 1
        if seen[r[0]] <= most:
            ranked.append((seen[r[0]], *r))
    return ranked


def texts(r, n):
    bits = ["a", "b", "c", "of", "The", "Ü", "日本", "x\xa0y", "z\x00", "\t", ",", ". ", "\n", "\x0b", "  ", "!"]
    rare = ["q%d" % i for i in range(60)]
    return [(r.choice(["en", "en", "en", "de", None]), " ".join(r.choice(bits + rare[: r.choice([0, 60])]) for _ in range(r.randint(0, 60))))
            for _ in range(n)]


def result(df, most=2000):
    got = C.top(df, most).select("rank", "lang", "phrase", "a", "l", "r", "n", "score").collect()
    return sorted((tuple(x) for x in got), key=lambda x: (x[1], x[0]))


@pytest.mark.parametrize("least,limit,bits", [(2, 40, 18), (5, 1 << 20, 20), (30, 500, 24)])
def test_against_brute_force(spark, least, limit, bits):
    rows = texts(random.Random(least), 300) + [("en", None), (None, ""), ("de", " of the " * 400), ("en", "a of b")] * 3
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    assert result(C.collocations(docs, least=least, limit=limit, bits=bits)) == brute(rows, least)
    assert result(C.collocations(docs, least=least, bits=bits), 3) == brute(rows, least, most=3)


def test_shorter_and_longer_windows(spark):
    rows = texts(random.Random(1), 120)
    docs = spark.createDataFrame(rows, "lang string, text string")
    for longest in (2, 3, 5):
        assert result(C.collocations(docs, least=4, longest=longest, bits=18)) == brute(rows, 4, longest)


def test_the_hash_of_runs_does_not_matter(spark):
    """With 2^18 hashes for far more runs than that, nearly none is ruled out."""
    r = random.Random(3)
    rows = [("en", " ".join("w%d" % r.randint(0, 3000) for _ in range(20_000)) + " one two three" * 40) for _ in range(12)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert result(C.collocations(docs, least=30, bits=18)) == result(C.collocations(docs, least=30, bits=24)) != []


def test_stretches_open_each_word_once():
    text = b"aa b\nccc  d e f g " + b"h" * 30 + b" i\n\nj "
    for limit in range(1, 60):
        opened = []
        for n, part in C.stretches(text, limit, 4):
            opened += [m.group() for m in re.finditer(rb"[^ \n]+", part) if m.start() < n]
        assert opened == text.split()


def test_sql(spark, odd_docs):
    rows = texts(random.Random(7), 200)
    docs = spark.createDataFrame(rows, "lang string, text string")
    con = duckdb.connect()
    con.register("documents", docs.filter("instr(text, chr(0)) = 0").toArrow())
    want = con.execute("SELECT rank, lang, phrase, a, l, r, n, score FROM (" + C.oracle(5, 10) + ") ORDER BY lang, rank").fetchall()
    assert result(C.collocations(docs.filter("instr(text, chr(0)) = 0"), least=5, bits=18), 10) == want


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["lang"], r["text"]) for r in odd_docs.collect()]
    assert result(C.collocations(odd_docs, least=2, bits=18)) == brute(rows, 2)
    assert result(C.collocations(no_docs, least=2, bits=18)) == []
