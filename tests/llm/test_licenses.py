import random
import re

import duckdb
import pandas as pd
import pytest

from fenloom.llm import licenses


def _places(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = []
    for phrase, label in licenses.BASE:
        p = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i: i + len(p)] == p]
    return len(w), found


def _same_as_sql(rows):
    """Labels and scores of the SQL against the scan word by word."""
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    got = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, labels, score FROM ({licenses.oracle()})").fetchall()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        want = _spans(text)
        assert got[doc_id] == (",".join(sorted({s[2] for s in want})), max((s[3] for s in want), default=0.0)), text


def _check(docs, rows):
    got = licenses.scan(docs).collect()
    assert len(got) == len(rows)
    key = lambda t: (t[0] is None, t)
    want = []
    for doc_id, text in rows:
        n, found = _places(text)
        at = [i for i, _ in found]
        want.append((doc_id, n, len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))))
    mine = [(r["id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got]
    assert sorted(mine, key=lambda t: repr(key(t))) == sorted(want, key=lambda t: repr(key(t)))
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    return got


def test_places(spark):
    rows = [
        (1, "MIT License, and the Apache-License; apache license! CC BY-NC 4.0"), (2, "mit mit license license mit\nlicense"),
        (3, "gnu general public license gnu general public license"), (4, "gnu general license"), (5, "mit"), (6, ""), (7, None),
        (8, "Σ mit license é"), (8, "apache license"), (None, "cc by")]
    _check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_wording_with_a_word_missing(spark):
    full = dict((label, text) for text, label in reversed(licenses.FURTHER))["mit"]
    words = full.split()
    rows = [(1, "x " * 50 + full), (2, " ".join(words[:6] + words[7:])), (3, " ".join(words[:6] + ["and"] + words[6:])),
            (4, " ".join(words[:5])), (5, " ".join(reversed(words)))]
    got = {r["id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["labels"] for i in range(1, 6)] == ["mit", "mit", "mit", "", ""]
    assert got[1]["score"] == 1 and 0.8 <= got[2]["score"] < 1 and (got[1]["spans"][0]["first"], got[1]["spans"][0]["last"]) == (50, 50 + len(words) - 1)


def test_odd_rows(odd_docs, no_docs):
    _check(odd_docs, [(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert licenses.scan(no_docs).count() == 0


def _spans(text):
    """Spans by the definition, word by word."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    out = []
    for n, (phrase, label) in enumerate(licenses.BASE + licenses.FURTHER):
        p = phrase.split()
        votes = {}
        for i in range(len(w) - 1):
            for j in range(len(p) - 1):
                if w[i: i + 2] == p[j: j + 2]:
                    votes.setdefault(i - j, []).append((i, j))
        exact = [d for d in votes if w[d: d + len(p)] == p and d >= 0]
        out += [(d, d + len(p) - 1, label, 1.0) for d in exact]
        left = sorted(set(votes) - set(exact)) if n >= len(licenses.BASE) else []
        runs = []
        for k, d in enumerate(left):
            run = [d]
            for e in left[k + 1:]:
                if e - run[-1] > licenses.GAP or e - d > (licenses.LONGER - 1) * len(p) + licenses.GAP:
                    break
                run.append(e)
            if not runs or not set(run) <= set(runs[-1]):
                runs.append(run)
        for run in runs:
            hits = sorted(h for d in run for h in votes[d])
            best = [1] * len(hits)
            for y, (i, j) in enumerate(hits):
                best[y] = 1 + max((best[x] for x in range(y) if hits[x][0] < i and hits[x][1] < j), default=0)
            cover = max(best) / (len(p) - 1)
            if cover >= licenses.COVER:
                out.append((hits[0][0], hits[-1][0] + 1, label, cover))
    return out


def test_repeated_phrases(spark):
    rows = [(1, "All rights reserved. " * 3), (2, "public license, a public license"), (3, "creative commons (creative commons)"),
            (4, "Mozilla Public License\n" * 40), (5, "public license mozilla public"), (6, "x all rights reserved, all rights")]
    got = {r["id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(got[i]["labels"], got[i]["score"]) for i in range(1, 7)] == [
        ("all-rights-reserved", 1.0), ("", 0.0), ("", 0.0), ("mpl", 1.0), ("", 0.0), ("all-rights-reserved", 1.0)]
    assert [(s["first"], s["last"]) for s in got[1]["spans"]] == [(0, 2), (3, 5), (6, 8)] and len(got[4]["spans"]) == 40
    _same_as_sql(rows)


def test_spans_by_definition(spark):
    r = random.Random(5)
    texts = [p for p, _ in licenses.BASE + licenses.FURTHER]
    rows = []
    for k in range(400):
        words = []
        for _ in range(r.randint(1, 6)):
            p = r.choice(texts).split()
            for _ in range(r.choice([1, 1, 2, 4])):
                q = list(p)
                for _ in range(r.choice([0, 0, 1, 2, 3])):
                    at = r.randrange(len(q))
                    q[at: at + 1] = r.choice([[], [q[at], "x"], [q[at], q[at]], q[max(0, at - 1): at + 1], [r.choice(q)]])
                    q = q or ["x"]
                words += q + ["x"] * r.choice([0, 0, 1, 3, 20])
        rows.append((k, " ".join(words)))
    some = 0
    for row in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        want = _spans(rows[row["id"]][1])
        assert sorted(map(tuple, row["spans"])) == sorted(s[:3] for s in want), rows[row["id"]][1]
        assert row["score"] == max((s[3] for s in want), default=0.0)
        assert row["labels"] == ",".join(sorted({s[2] for s in want}))
        some += any(s[3] < 1 for s in want)
    assert some > 50
    _same_as_sql(rows)


def test_templates_are_checked(spark, monkeypatch):
    for text in ("a b a b", "one", " ".join(f"w{i}" for i in range(66))):
        monkeypatch.setattr(licenses, "FURTHER", [(text, "x")])
        with pytest.raises(ValueError):
            licenses.templates(spark)
