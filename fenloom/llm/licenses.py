"""License scan by diagonal voting, with DataFrame functions only.

Every pair of adjacent words of every document is hashed and joined to its positions in a fixed
table of templates; the words themselves are compared too. A hit votes for the diagonal ``word
position - template position``. Votes are kept per document, template and diagonal. A template
stands exactly where one diagonal has all its votes; base phrases count nowhere else. For other
templates the diagonals left over are joined into runs, so that words may be missing or added:
neighbours are up to ``GAP`` words apart, and a run is no wider than makes a span of ``LONGER`` times
the template and ``GAP`` words. A run counts if ``COVER`` of the template's pairs stand in it in
their order, each counted once. Runs that lie in another run are not looked at.

Null and empty texts have no words, count 0, null places, empty labels and score 0. Rows
repeated with one id are scanned one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from fenloom.llm.common import WORD, ascii_lower, packed

#: Phrases whose places are counted, and their labels.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
#: Further wordings, found also with words missing or added.
FURTHER = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("creative commons attribution", "cc-by"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("all rights reserved", "all-rights-reserved"),
    ("dedicated to the public domain", "public-domain"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
     "merchantability fitness for a particular purpose and noninfringement", "mit"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd"),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in "
     "the documentation and or other materials provided with the distribution", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
     "this software without specific prior written permission", "bsd"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
     "without warranties or conditions of any kind either express or implied", "apache"),
    ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
     "merchantability or fitness for a particular purpose", "gpl"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
]
GAP, COVER, LONGER = 3, 0.8, 1.25


def templates(spark: SparkSession) -> DataFrame:
    """(template, label, base, length, j, w1, w2, h): every pair of adjacent template words.

    A template has at most 64 pairs, as the votes of a diagonal are bits of a long, and no pair twice.
    """
    for text, _ in BASE + FURTHER:
        words = text.split(" ")
        pairs = list(zip(words, words[1:]))
        if not 1 <= len(pairs) <= 64 or len(set(pairs)) < len(pairs):
            raise ValueError(f"a template has one to 64 pairs of words, all different: {text!r}")
    rows = [F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(i < len(BASE)).alias("base"),
                     F.split(F.lit(text), " ").alias("t")) for i, (text, label) in enumerate(BASE + FURTHER)]
    t = spark.range(1).select(F.inline(F.array(*rows)))
    t = t.select("template", "label", "base", F.size("t").alias("length"), F.posexplode(_pairs("t")).alias("j", "pair"))
    return t.filter("pair.w2 IS NOT NULL").select(
        "template", "label", "base", "length", "j", "pair.w1", "pair.w2", F.xxhash64("pair.w1", "pair.w2").alias("h"))


def _pairs(words: str) -> Column:
    """Each word with the next one; the last word stands with null."""
    after = F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1)))
    return F.arrays_zip(F.col(words).alias("w1"), after.alias("w2"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    row = F.col("row")
    words = F.regexp_extract_all(ascii_lower(row.getField(text_col)), F.lit(f"({WORD})"), F.lit(1))
    rows = packed(docs).select(F.monotonically_increasing_id().alias("rid"), row.getField(id_col).alias("id"), words.alias("words"))
    grams = rows.select("rid", "id", F.size("words").cast("long").alias("n_words"), F.posexplode_outer(_pairs("words")).alias("i", "pair"))
    grams = grams.select("rid", "id", "n_words", "i", F.col("pair.w1").alias("a"), F.col("pair.w2").alias("b"),
                         F.xxhash64("pair.w1", "pair.w2").alias("g"))
    # the template table is fixed and small; all grams are looked up where they are
    t = F.broadcast(templates(docs.sparkSession))
    hits = grams.join(t, (F.col("g") == t["h"]) & (F.col("a") == t["w1"]) & (F.col("b") == t["w2"]), "left")
    # documents without a hit come through as their own group, merged map side
    votes = hits.groupBy("rid", "id", "n_words", "template", "label", "base", "length", (F.col("i") - F.col("j")).alias("diagonal")).agg(
        F.bit_or(F.expr("shiftleft(1L, j)")).alias("bits"))
    return _summed(_merged(votes))


def _merged(votes: DataFrame) -> DataFrame:
    """Verified spans (rows of documents without any keep a null template)."""
    along = Window.partitionBy("rid", "template").orderBy("diagonal")
    width = ((LONGER - 1) * F.col("length") + GAP).cast("int")
    widest = int((LONGER - 1) * max(len(text.split(" ")) for text, _ in FURTHER) + GAP)
    # a word and a diagonal give the template's place, so a bit for each place holds all the votes
    places = F.filter(F.sequence(F.lit(0), F.col("length") - 2), lambda j: F.getbit("bits", j) == 1)
    votes = votes.withColumn("js", places)
    full = F.size("js") == F.col("length") - 1
    rest = F.when(~F.col("base") & ~full, F.struct("diagonal", "js"))

    def neighbours(run: Column) -> Column:
        """Up to the first gap."""
        near = F.filter(run, lambda x: x["diagonal"] - F.col("diagonal") <= width)
        return F.aggregate(near, F.slice(near, 1, 1), lambda kept, x: F.when(
            x["diagonal"] - F.element_at(kept, -1)["diagonal"] <= GAP, F.array_union(kept, F.array(x))).otherwise(kept))

    rows = votes.withColumn("full", F.coalesce(full, F.lit(False))).withColumn(
        "run", F.when(rest.isNotNull(), F.collect_list(rest).over(along.rangeBetween(0, widest))))
    rows = rows.withColumn("run", F.when(F.col("run").isNotNull(), neighbours(F.col("run"))))
    rows = rows.withColumn("end", F.element_at("run", -1)["diagonal"])
    before = F.last("end", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("inside", F.coalesce(F.col("end") == before, F.lit(False)))
    hits = F.when(F.col("full"), F.array(F.struct("diagonal", "js"))).when(F.col("run").isNotNull() & ~F.col("inside"), F.col("run"))
    rows = rows.withColumn("hits", F.array_sort(F.flatten(F.transform(hits, lambda x: F.transform(
        x["js"], lambda j: F.struct((x["diagonal"] + j).alias("i"), j.alias("j")))))))
    pairs = F.col("length") - 1
    enough = F.size(F.array_distinct(F.col("hits")["j"])) >= COVER * pairs
    cover = F.when(F.col("full"), F.lit(1.0)).when(enough, _in_order(F.col("hits"), pairs) / pairs)
    return rows.select(
        "rid", "id", "n_words", "label", "base", F.array_min(F.col("hits")["i"]).alias("first"),
        (F.array_max(F.col("hits")["i"]) + 1).alias("last"), cover.alias("cover")).withColumn(
            "good", F.coalesce(F.col("cover") >= COVER, F.lit(False)))


def _in_order(hits: Column, pairs: Column) -> Column:
    """The largest number of hits, sorted by word, whose template positions rise too."""
    return F.aggregate(hits, F.array_repeat(F.lit(0), pairs), lambda best, hit: F.transform(best, lambda n, j: F.when(
        j == hit["j"], F.greatest(n, 1 + F.coalesce(F.array_max(F.slice(best, F.lit(1), hit["j"])), F.lit(0)))).otherwise(n)), F.array_max)


def _summed(spans: DataFrame) -> DataFrame:
    base = F.col("good") & F.col("base")

    def labels(of: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_set(F.when(of, F.col("label")))), ",")

    return spans.groupBy("rid", "id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("first").cast("long"))).alias("first_word"),
        F.max(F.when(base, F.col("first").cast("long"))).alias("last_word"), labels(base).alias("base_labels"),
        labels(F.col("good")).alias("labels"), F.coalesce(F.max(F.when(F.col("good"), F.col("cover"))), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(F.col("good"), F.struct("first", "last", "label")))).alias("spans"),
    ).drop("rid")


def oracle() -> str:
    """The same scan as SQL over the table ``documents``, written from the definition of spans."""
    values = ",\n".join(f"({i}, '{label}', {str(i < len(BASE)).lower()}, string_split('{text}', ' '))"
                        for i, (text, label) in enumerate(BASE + FURTHER))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE t0(template, label, base, t) AS (VALUES {values}),
t AS (SELECT template, label, base, len(t) AS length, unnest(range(len(t) - 1)) AS j, t FROM t0),
pair AS (SELECT template, label, base, length, j, t[j + 1] AS w1, t[j + 2] AS w2 FROM t),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{WORD}') AS w FROM documents),
g0 AS (SELECT rid, w, unnest(range(len(w) - 1)) AS i FROM d WHERE len(w) > 1),
g AS (SELECT rid, i, w[i + 1] AS w1, w[i + 2] AS w2 FROM g0),
v AS MATERIALIZED (SELECT rid, template, label, base, length, i - j AS diagonal, list(j) AS js,
             CAST(floor({LONGER - 1} * length + {GAP}) AS BIGINT) AS width FROM g JOIN pair USING (w1, w2) GROUP BY ALL),
-- diagonals without all votes, in chains of near neighbours
m AS (SELECT *, coalesce((diagonal - lag(diagonal) OVER w > {GAP})::INT, 1) AS apart FROM v
      WHERE NOT base AND len(js) < length - 1 WINDOW w AS (PARTITION BY rid, template ORDER BY diagonal)),
c AS MATERIALIZED (SELECT *, sum(apart) OVER (PARTITION BY rid, template ORDER BY diagonal) AS chain FROM m),
-- a run starts at each diagonal and is as wide as it may be; those inside the run before are left out
e AS (SELECT a.rid, a.template, a.label, a.length, a.diagonal, a.chain, max(b.diagonal) AS reach FROM c a JOIN c b
      ON a.rid = b.rid AND a.template = b.template AND a.chain = b.chain AND b.diagonal BETWEEN a.diagonal AND a.diagonal + a.width GROUP BY ALL),
run AS (SELECT * FROM e QUALIFY reach IS DISTINCT FROM lag(reach) OVER (PARTITION BY rid, template ORDER BY diagonal)),
h0 AS (SELECT run.*, c.diagonal AS place, unnest(c.js) AS j FROM run JOIN c
       ON run.rid = c.rid AND run.template = c.template AND run.chain = c.chain AND c.diagonal BETWEEN run.diagonal AND run.reach),
h1 AS (SELECT rid, template, label, length, diagonal, list_sort(list({{'i': place + j, 'j': j}})) AS hits FROM h0
       GROUP BY rid, template, label, length, diagonal HAVING count(DISTINCT j) >= {COVER} * (length - 1)),
-- the longest rising row of template places: the best that ends at each place, hit by hit
b AS (SELECT *, 0 AS k, list_transform(range(length - 1), lambda x: 0) AS best FROM h1
      UNION ALL
      SELECT rid, template, label, length, diagonal, hits, k + 1, list_transform(best, lambda x, n: CASE WHEN n = hits[k + 1].j + 1
             THEN greatest(x, 1 + coalesce(list_max(best[1:hits[k + 1].j]), 0)) ELSE x END) FROM b WHERE k < len(hits)),
ok AS (SELECT rid, label, base, diagonal AS first, 1.0::DOUBLE AS cover FROM v WHERE len(js) = length - 1
       UNION ALL
       SELECT rid, label, false, hits[1].i, list_max(best)::DOUBLE / (length - 1) FROM b
       WHERE k = len(hits) AND list_max(best)::DOUBLE / (length - 1) >= {COVER}),
r AS (SELECT rid, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
             coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ','), '') AS base_labels,
             array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, CAST(max(cover) AS DOUBLE) AS score FROM ok GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN r USING (rid)"""
