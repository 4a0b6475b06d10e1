import random

import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long, rid long, row string, kept string, id string, size long, score string, label string"


def _row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, len(text or ""), 1, "r", "k", "i", 2, "s", "l")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, columns named like helpers."""
    r = random.Random(1)
    words = ["".join(r.choice("abcdefghij") for _ in range(4)) for _ in range(400)]
    long = " ".join(r.choice(words) for _ in range(60_000))
    base = " ".join(words[:60])
    near = " ".join(words[:59] + ["other"])
    rows = [
        _row(1, base), _row(2, base.replace(" ", "\n ")), _row(3, near, "de", "b"), _row(4, "", "fr"), _row(5, None, "fr"),
        _row(6, " \t\n "), _row(7, long, None, None), _row(8, base, None, None), _row(None, base), _row(None, None, None, None),
        _row(9, "x"), _row(9, "x"), _row(9, "x"), _row(10, "one two"), _row(11, "ONE, two!"), _row(12, "1 2 3 4 5 6"),
        _row(13, "Straße ▁ \U0001F600 é́ \x00 end", "es", "\U0001F600"), _row(14, "the MIT License. mit license", "en", "b"),
    ]
    return spark.createDataFrame(rows, KIND).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], KIND)
