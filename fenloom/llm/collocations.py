"""Phrases whose words stand together more often than apart, per language.

Counting starts from the longest windows alone. Each word opens a window of itself and the words
after it in its piece, padded where the piece ends; equal windows are counted, and a Spark ROLLUP
over (lang, word 1, word 2, ...) sums them to all shorter prefixes. As every phrase is a prefix of
the windows at its places, this gives the counts of all lengths, and of all words of a language.

Windows also end where a run of words cannot be frequent: passes before count runs of 2, 3, ... words
by a hash, and a run is at most as frequent as its hash. No phrase with ``least`` places holds such
a run, so the result does not depend on the hash or its size (2^``bits`` bytes a worker while it
counts, bits when it is shared); what is left to shuffle does.

Null text counts as empty and null languages as ``und``. Repeated rows count each time, whatever
their ids. Without words the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from fenloom.llm.words import UNIT, batches_of, coded, flags, units
from fenloom.session import cut_lineage

#: Lower case for A-Z; ends of pieces become line feeds and tabs spaces.
CLEAN = bytes(c + 32 if 65 <= c < 91 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
BREAKS = flags(b" \n")
PAGE = 1 << 18  # hashes whose counts travel together


# ---- words in order --------------------------------------------------------------------------


def stretches(text: bytes, limit: int, longest: int) -> Iterator[tuple[int, bytes]]:
    """A cleaned text in stretches of about ``limit`` bytes, each as (bytes its words open in, bytes to read).

    What is read goes on for ``longest - 1`` words, or to the end of the piece.
    """
    at = 0
    while len(text) - at > limit:
        cut = min((x for x in (text.find(b" ", at + limit), text.find(b"\n", at + limit)) if x >= 0), default=len(text))
        end = cut
        for _ in range(longest - 1):
            while end < len(text) and text[end] == 32:
                end += 1
            end = min((x for x in (text.find(b" ", end), text.find(b"\n", end)) if x >= 0), default=len(text))
        yield cut - at, text[at:end]
        at = cut
    if at < len(text):
        yield len(text) - at, text[at:]


class Words:
    """The words of a unit of texts in order: codes, languages, and whether the next word goes on in the same piece."""

    def __init__(self, texts: list[bytes], langs: np.ndarray, longest: int, limit: int = UNIT):
        held, opens, lang = [], [], []
        for t, k in zip(texts, langs.tolist()):
            for n, part in stretches(t.translate(CLEAN), limit, longest):
                held.append(part)
                opens.append(n)
                lang.append(k)
        at = np.zeros(len(held) + 1, np.int64)
        np.cumsum([len(h) + 1 for h in held], out=at[1:])
        data = b"\n".join([*held, b""])
        start, self.codes, self.vocabulary = coded(data, BREAKS)
        self.codes = self.codes.astype(np.int64)
        of = np.searchsorted(at, start, side="right") - 1
        self.lang = np.array(lang, np.int64)[of] if len(of) else of
        self.opens = start - at[of] < np.array(opens, np.int64)[of] if len(of) else np.zeros(0, bool)
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
        piece = np.searchsorted(ends, start)
        self.goes_on = np.append(piece[1:] == piece[:-1], False) if len(of) else np.zeros(0, bool)

    def values(self, names: list[str]) -> np.ndarray:
        """A number for each word: the same in every unit, whatever its codes."""
        runs = self.vocabulary.to_pylist()
        size = np.fromiter(map(len, runs), np.int64, len(runs))
        raw = np.frombuffer(b"".join(runs), np.uint8)
        first = np.cumsum(size) - size
        place = np.arange(len(raw)) - np.repeat(first, size)
        power = np.cumprod(np.full(int(size.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
        word = np.add.reduceat((raw.astype(np.uint64) + np.uint64(1)) * power[place], first) if len(size) else np.zeros(0, np.uint64)
        lang = np.array([int.from_bytes(n.encode()[-8:], "little") for n in names] or [0], np.uint64)
        return word[self.codes] + lang[self.lang] * np.uint64(0x165667B19E3779F9)

    def may_open(self, names: list[str], filters: list[np.ndarray], bits: int) -> tuple[list[np.ndarray], np.ndarray]:
        """For 2, 3, ... words: where a run that all ``filters`` let through opens; and the hashes of the next longer runs,
        -1 where a run is ruled out already."""
        value = run = self.values(names)
        able, out = self.goes_on, []
        for n, passed in enumerate([*filters, None], 2):
            run = run * np.uint64(0xC2B2AE3D27D4EB4F) + _ahead(value, n - 1)
            if n > 2:
                able = able & _ahead(able, 1)
            h = run ^ (run >> np.uint64(29))
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h = np.where(able, (h >> np.uint64(64 - bits)).astype(np.int64), -1)
            if passed is not None:
                able = able & ((passed[h >> 3] >> (7 - (h & 7)).astype(np.uint8)) & 1 == 1)
                out.append(able)
        return out, h


def _ahead(x: np.ndarray, n: int) -> np.ndarray:
    """``x`` as it is ``n`` places on, zero beyond the end."""
    out = np.zeros_like(x)
    out[:len(x) - n] = x[n:] if n < len(x) else 0
    return out


def _read(batch: pa.RecordBatch, longest: int, limit: int) -> Iterator[tuple[Words, list[str]]]:
    lang = batch.column(0).dictionary_encode()
    names, code = lang.dictionary.to_pylist(), lang.indices.to_numpy(zero_copy_only=False)
    for lo, hi, texts in units(batch, 1, limit):
        yield Words(texts, code[lo:hi], longest, limit), names


# ---- runs that cannot be frequent --------------------------------------------------------------


def frequent_runs(docs: DataFrame, filters: list[np.ndarray], least: int, bits: int, longest: int, limit: int) -> np.ndarray:
    """A bit for each hash of a run, a word longer than the last of ``filters`` is for: whether ``least`` places share it.

    Runs that hold one ruled out before are not counted.
    """
    sent = docs.sparkSession.sparkContext.broadcast(filters)  # 2^bits bits each

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, np.uint8)
        for b in batches:
            for w, names in _read(b, longest, limit):
                h = w.may_open(names, sent.value, bits)[1]
                at, n = np.unique(h[w.opens & (h >= 0)], return_counts=True)
                seen[at] = np.minimum(seen[at] + n, least)
        pack = zstandard.ZstdCompressor(level=1)
        for page in range(0, len(seen), PAGE):
            if (part := seen[page:page + PAGE]).any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([page], pa.int32()), pa.array([pack.compress(part.tobytes())], pa.binary())], names=["page", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, page, total = zstandard.ZstdDecompressor(), None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())],
                                              names=["page", "bits"])

        for b in batches:
            for p, c in zip(b.column(0).to_pylist(), b.column(1)):
                if p != page:
                    if page is not None:
                        yield done()
                    page, total = p, np.zeros(min(PAGE, 1 << bits), np.int64)
                total += np.frombuffer(unpack.decompress(c.as_py()), np.uint8)
        if page is not None:
            yield done()

    pages = docs.mapInArrow(count, "page int, counts binary")
    n = max(1, min((1 << bits) // PAGE, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    got = pages.repartition(n, "page").sortWithinPartitions("page").mapInArrow(add, "page int, bits binary")
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in got.collect():  # 2^bits bits in all
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[r["page"] // 8: r["page"] // 8 + len(part)] = part
    return out


# ---- windows and their prefixes -----------------------------------------------------------------


def windows(docs: DataFrame, filters: list[np.ndarray], bits: int, longest: int, limit: int) -> DataFrame:
    """(lang, w1 .. w_longest, n): the padded longest windows, counted inside each unit; '' is padding."""
    sent = docs.sparkSession.sparkContext.broadcast(filters)  # 2^bits bits each

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w, names in _read(b, longest, limit):
                if not len(w.codes):
                    continue
                pad, columns = len(w.vocabulary), [w.lang, w.codes]
                for k, able in enumerate(w.may_open(names, sent.value, bits)[0], 1):
                    columns.append(np.where(able, _ahead(w.codes, k), pad))
                columns = [c[w.opens] for c in columns]
                key = columns[0]
                for c in columns[1:]:
                    key = np.unique(key * (pad + 1) + c, return_inverse=True)[1].astype(np.int64)
                n = np.bincount(key)
                one = np.empty(len(n), np.int64)
                one[key] = np.arange(len(key))
                words = pa.concat_arrays([w.vocabulary, pa.array([b""], pa.large_binary())]).cast(pa.binary()).cast(pa.string())
                out = [pa.array(names, pa.string()).take(pa.array(columns[0][one]))]
                out += [words.take(pa.array(c[one])) for c in columns[1:]]
                for lo in range(0, len(n), 50_000):
                    yield pa.RecordBatch.from_arrays([*[c.slice(lo, 50_000) for c in out], pa.array(n[lo:lo + 50_000], pa.int64())],
                                                     names=["lang", *[f"w{k + 1}" for k in range(longest)], "n"])

    fields = ", ".join(f"w{k + 1} string" for k in range(longest))
    return docs.mapInArrow(lead, f"lang string, {fields}, n long")


def phrase_counts(counted: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, words, f) of all phrases with ``least`` places, and (lang, n) with all words of a language.

    The longest windows are final as they are; ROLLUP adds them up to shorter and shorter prefixes.
    """
    keys = [f"w{k + 1}" for k in range(longest)]
    full = cut_lineage(counted.groupBy("lang", *keys).agg(F.sum("n").alias("n")), "windows")
    level = F.grouping_id()
    sums = full.rollup("lang", *keys[:-1]).agg(F.sum("n").alias("n"), level.alias("level"))
    # level has a bit for each key summed over: 0 is all keys, 2^k - 1 all but the last k
    size = F.lit(longest - 1) - F.round(F.log2(F.col("level") + 1)).cast("int")
    part = sums.select("lang", "n", size.alias("size"), F.array(*keys[:-1]).alias("w"))
    part = cut_lineage(part.filter(
        (F.col("size") == 0) | ((F.col("n") >= least) & (F.col("size") > 0) & (F.get("w", F.col("size") - 1) != ""))), "prefixes")
    most = full.filter((F.col("n") >= least) & (F.col(keys[-1]) != "")).select("lang", F.array(*keys).alias("words"), F.col("n").alias("f"))
    shorter = part.filter("size > 0").select("lang", F.slice("w", F.lit(1), F.col("size")).alias("words"), F.col("n").alias("f"))
    return cut_lineage(most.unionByName(shorter), "phrases"), part.filter("size = 0").select("lang", "n")


# ---- scores --------------------------------------------------------------------------------------


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")  # words hold no spaces


def scored(phrases: DataFrame, totals: DataFrame, longest: int, share: tuple[int, int] = (80, 100), scale: int = 2_000_000) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of candidates that no longer candidate takes the place of."""
    table = phrases.select("lang", _joined(F.col("words")).alias("phrase"), "f")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    cands = phrases.filter(F.size("words") > 1).select("lang", "words", _joined(F.col("words")).alias("phrase"), F.col("f").alias("a"))
    cut = F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    cuts = cands.select("lang", "phrase", "words", "a", cut).select(
        "lang", "phrase", "a", "k", _joined(F.slice("words", F.lit(1), F.col("k"))).alias("head"),
        _joined(F.expr("slice(words, k + 1, size(words))")).alias("tail"))
    heads = table.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = table.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    value = (wide("a") * F.lit(scale).cast("decimal(10,0)")).cast("decimal(38,0)")
    valued = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumns({"value": value, "sum": wide("l") + wide("r")})
    best = valued.withColumn("score", F.expr("value div sum")).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "a", "l", "r")).alias("b")).select("lang", "phrase", "b.a", "b.l", "b.r", "b.score")
    # a candidate inside a longer one that has nearly all its places
    inside = F.expr("""explode(flatten(transform(sequence(2, size(words) - 1), m ->
        transform(sequence(1, size(words) - m + 1), i -> array_join(slice(words, i, m), ' ')))))""")
    longer = cands.filter(F.size("words") > 2).select("lang", inside.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = best.join(longer, ["lang", "phrase"], "left").filter(
        F.col("most").isNull() | (wide("most") * F.lit(share[1]) < wide("a") * F.lit(share[0])))
    return kept.join(totals, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 4, least: int = 30,
                 bits: int = 25, limit: int = UNIT) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all phrases kept, of 2 to ``longest`` words."""
    if longest < 2 or not 1 <= least <= 127 or not 18 <= bits <= 30:
        raise ValueError("longest >= 2, least from 1 to 127, bits from 18 to 30")
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    with batches_of(spark):
        filters: list[np.ndarray] = []
        for _ in range(longest - 1):
            filters.append(frequent_runs(rows, filters, least, bits, longest, limit))
        phrases, totals = phrase_counts(windows(rows, filters, bits, longest, limit), longest, least)
    return scored(phrases, totals, longest)


def top(kept: DataFrame, most: int = 2000) -> DataFrame:
    """The first ``most`` phrases of each language, with their rank."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= most)


def oracle(least: int = 30, most: int = 2000) -> str:
    """The definition in SQL: all n-grams of all pieces."""
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (
    SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
f AS (
  SELECT lang, len, phrase, count(*) AS f FROM (
    SELECT lang, len, unnest(list_transform(range(1, len(w) - len + 2), lambda i: array_to_string(w[i:i + len - 1], ' '))) AS phrase
    FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS len) WHERE len(w) >= len)
  GROUP BY ALL HAVING count(*) >= {least}),
candidates AS (SELECT lang, len, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE len > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r,
         ((2000000::HUGEINT * c.a) // (l.f::HUGEINT + r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, len)) AS k FROM candidates) AS c
  JOIN f AS l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
  JOIN f AS r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrases AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, len - m + 2)) AS i FROM (SELECT *, unnest(range(2, len)) AS m FROM candidates WHERE len > 2))
  GROUP BY ALL),
kept AS (
  SELECT b.* FROM best AS b LEFT JOIN inner_phrases AS i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN sizes USING (lang) QUALIFY rank <= {most}"""
