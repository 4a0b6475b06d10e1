"""Mixing sources to target weights by Sainte-Laguë apportionment, with DataFrame functions only.

A source's text is one stream of words, its documents in seeded order, cut into shards and these
into blocks of equal size. Seats, one block each, go to sources and then to a source's shards by
the highest quotients ``votes / (2 s - 1)``. A shard with q seats over n blocks takes each block
``q // n`` times and, in seeded order, the first ``q % n`` once more. Words of a document that
lie in a block are taken as often as the block is.

Ids and texts, not partitions, decide everything, so reruns agree. Null text has size 0 and takes
nothing, null sources are one source that sorts last, and rows repeated with one id, or without any, are
drawn one by one and spread over shards by their texts; only rows equal in both stay in one shard.
The table of sources passes through one window; shards through one window per source, a row for
every ``shard_words`` words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fenloom.llm.common import GAP, packed, text_of, unpacked
from fenloom.session import cut_lineage, spread

WORDS = r"[^\x20\x09-\x0D]+"
RUN = 1 << 14


def sized(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(rid, row, id, name, source, size): the name tells rows apart, the size is the number of words."""
    row = F.col("row")
    text = text_of(row.getField(text_col))
    return packed(docs).select(
        F.monotonically_increasing_id().alias("rid"), "row", row.getField(id_col).alias("id"),
        F.concat(F.coalesce(row.getField(id_col).cast("string"), F.lit("null")), F.lit("|"), F.md5(text)).alias("name"),
        row.getField(source_col).cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("size"))


def targets(docs: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """(source, source_size, rows, weight, target): weights repeat over the sorted sources.

    A target stops at ``most`` times the size of its source; what is above goes to the others by
    weight. With caps in the order of cap / weight, the level is the first one not above its cap.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    sources = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    sources = sources.withColumn("at", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int")))
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), "at")
    before, on = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    cap = most * F.col("source_size")
    sources = sources.withColumn(
        "level", (share * F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        / F.sum("weight").over(on)).withColumn("open", F.col("level") * F.col("weight") <= cap)
    first = F.min(F.when(F.col("open"), F.struct(F.col("source_size") / F.col("weight"), "at", "level"))).over(everything)
    return sources.withColumn("level", first["level"]).select(
        "source", "source_size", "n_rows", "weight",
        F.coalesce(F.least(cap, F.col("level") * F.col("weight")), cap).alias("target"))


def highest_quotients(parties: DataFrame, group: list[str], key: list[str], votes: str, seats: Column, most: Column) -> DataFrame:
    """Sainte-Laguë: adds ``quota``, each group's ``seats`` given to its parties by the highest quotients.

    With K parties the divisor lies within K/2 seats of the proportional one, so only the seats
    near the proportional share are listed: about 3 K quotients, not one for every seat.
    """
    whole = Window.partitionBy(*group)
    p = parties.withColumn("_seats", seats).withColumn("_total", F.sum(votes).over(whole)).withColumn(
        "_k", F.count("*").over(whole))
    fair = F.col("_seats") * F.col(votes) / F.col("_total")
    slack = F.col(votes) / F.col("_total") * (F.col("_k") / 2 + 1) + 2
    p = p.filter((F.col("_total") > 0) & (F.col(votes) > 0)).withColumn("_most", most).withColumn(
        "_low", F.least(F.greatest(F.lit(0), F.floor(fair - slack)), "_most")).withColumn(
        "_high", F.least(F.ceil(fair + slack).cast("long"), "_most"))
    left = F.col("_seats") - F.sum("_low").over(whole)
    p = p.withColumn("_left", left)
    asked = p.filter("_high > _low").select("*", F.explode(F.sequence(F.col("_low") + 1, "_high")).alias("_s"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(
        (F.col(votes) / (2 * F.col("_s") - 1)).desc(), *[F.col(k).asc_nulls_last() for k in key]))
    won = asked.withColumn("_rank", rank).filter("_rank <= _left").groupBy(*key).agg(F.count("*").alias("_won"))
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"w.{k}")) for k in key]
    return p.alias("p").join(won.alias("w"), same, "left").select(
        "p.*", (F.col("_low") + F.coalesce("_won", F.lit(0))).cast("long").alias("quota")).drop(
        "_seats", "_total", "_k", "_most", "_low", "_high", "_left")


class Mix:
    """The mix of rows of :func:`sized` (without their ``row``).

    ``rows`` adds ``source_size, target, taken, start, sk, shard, shard_size, n_blocks, passes``;
    ``blocks`` has the blocks taken once more than their shard's passes. ``block_words`` is the
    size of a block; sources whose target is below 64 blocks are cut into single words instead,
    so that their totals are met as closely.
    """

    def __init__(self, docs: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, most: int = 2, seed: int = 7,
                 block_words: int = 64, shard_words: int = 1_000_000, shard_rows: int = 20_000):
        self.seed = seed
        sources = cut_lineage(targets(docs, list(weights), share, most).withColumn(
            "unit", F.when(F.col("target") >= 64 * block_words, block_words).otherwise(1)), "sources")
        unit = Window.partitionBy("unit")
        sources = highest_quotients(
            sources, ["unit"], ["source"], "target", F.round(F.sum("target").over(unit) / F.col("unit")).cast("long"),
            F.lit(1 << 60)).withColumnRenamed("quota", "source_quota").unionByName(
            sources.filter("target <= 0").withColumn("source_quota", F.lit(0).cast("long")))
        sources = cut_lineage(sources.withColumn("n_shards", F.greatest(
            F.lit(1), F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("n_rows") / shard_rows))), "sources")
        s = sources.withColumnRenamed("source", "_source")
        docs = docs.join(s, docs["source"].eqNullSafe(s["_source"])).drop("_source")
        docs = docs.withColumn("shard", F.conv(F.substring(self._seeded("shard", F.col("name")), 1, 8), 16, 10).cast("long") % F.col("n_shards"))
        # null sources need a key that equals itself in joins and windows
        docs = docs.withColumn("sk", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
        shards = docs.groupBy("sk", "unit", "source_quota", "shard").agg(F.sum("size").alias("shard_size")).filter("shard_size > 0")
        shards = shards.withColumn("n_blocks", F.greatest(F.lit(1), F.round(F.col("shard_size") / F.col("unit"))).cast("long"))
        shards = cut_lineage(highest_quotients(
            shards, ["sk"], ["sk", "shard"], "shard_size", F.col("source_quota"), most * F.col("n_blocks")).select(
            "sk", "shard", "shard_size", "n_blocks", F.floor(F.col("quota") / F.col("n_blocks")).alias("passes"),
            (F.col("quota") % F.col("n_blocks")).alias("extra")), "shards")
        self.blocks = self._blocks(shards)
        self.rows = self._taken(docs, shards.drop("extra"))

    def _seeded(self, what: str, key: Column) -> Column:
        return F.md5(F.concat(F.lit(f"{self.seed}|{what}|"), key))

    def _blocks(self, shards: DataFrame) -> DataFrame:
        """All blocks: where each starts, whether it is chosen, and the chosen words before it in its shard."""
        edge = F.floor(F.col("block") * F.col("shard_size") / F.col("n_blocks"))
        by_draw = Window.partitionBy("sk", "shard").orderBy("draw", "block")
        # a number of tasks that follows the shards: a shard is a short row here and long after the explode
        blocks = spread(shards, "sk", "shard", at_least=shards.count() // 16).select(
            "*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"))
        blocks = blocks.withColumn("draw", self._seeded("block", F.concat_ws("|", "sk", "shard", "block"))).withColumn(
            "chosen", (F.row_number().over(by_draw) <= F.col("extra")).cast("long")).withColumn("block_start", edge.cast("long"))
        along = Window.partitionBy("sk", "shard").orderBy("block")
        blocks = blocks.withColumn("block_end", F.coalesce(F.lead("block_start", 1).over(along), F.col("shard_size")))
        chosen = F.col("chosen") * (F.col("block_end") - F.col("block_start"))
        blocks = blocks.withColumn("before", F.sum(chosen).over(along) - chosen)
        return cut_lineage(blocks.select("sk", "shard", "block", "block_start", "block_end", "chosen", "before"), "blocks")

    def _taken(self, docs: DataFrame, shards: DataFrame) -> DataFrame:
        """Places documents in the streams of their shards and counts the words the blocks take."""
        order = Window.partitionBy("sk", "shard").orderBy("place", "id", "rid")
        placed = docs.withColumn("place", self._seeded("order", F.col("name"))).withColumn(
            "start", F.sum("size").over(order) - F.col("size")).drop("place", "name")
        placed = placed.join(shards, ["sk", "shard"], "left")

        def chosen_before(rows: DataFrame, place: Column, out: str) -> DataFrame:
            b = self.blocks.select("sk", "shard", *[F.col(c).alias(f"_{c}") for c in ("block", "block_start", "chosen", "before")])
            rows = rows.withColumn("_block", F.least(_block_of(place), F.col("n_blocks") - 1))
            return rows.join(b, ["sk", "shard", "_block"], "left").withColumn(
                out, F.col("_before") + F.col("_chosen") * (place - F.col("_block_start"))).drop(
                "_block", "_block_start", "_chosen", "_before")

        placed = chosen_before(placed, F.col("start"), "a")
        placed = chosen_before(placed, F.col("start") + F.col("size"), "b")
        taken = F.col("passes") * F.col("size") + F.col("b") - F.col("a")
        return placed.withColumn("taken", F.when(F.col("size") > 0, taken).otherwise(0).cast("long")).drop("a", "b")

    def take(self, spool: DataFrame, text_col: str, names: list[str]) -> DataFrame:
        """The mixed documents themselves: as many whole copies as taken, and for a document cut
        by a block's edge one more row with the words inside the chosen blocks, spacing kept.

        ``spool`` is :func:`sized` as written by ``chunked``: what is taken comes to the chunks as arrays
        over ``RUN`` places of a chunk, so that texts are read once and do not move.
        Columns of the documents are ``names``.
        """
        got = cut_lineage(self.rows.select("rid", "sk", "shard", "start", "size", "taken", "n_blocks", "shard_size"), "taken")
        part = F.col("taken") % F.col("size")
        last = _block_of(F.col("start") + F.col("size") - 1)
        cut = got.filter((F.col("taken") > 0) & (part > 0)).select("*", F.explode(F.sequence(_block_of(F.col("start")), last)).alias("block"))
        cut = cut.join(self.blocks.filter("chosen = 1").select("sk", "shard", "block", "block_start", "block_end"), ["sk", "shard", "block"])
        cut = cut.select("rid", F.greatest(F.col("block_start") - F.col("start"), F.lit(0)).alias("a"),
                         F.least(F.col("block_end") - F.col("start"), F.col("size")).alias("b"))
        cut = cut.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))
        # every row has an entry, so that its place in the array is its place in the chunk
        copies = F.when(F.col("taken") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int").alias("copies")
        picks = got.select("rid", copies).join(cut, "rid", "left").groupBy(
            _chunk("rid").alias("_chunk"), F.floor(_place("rid") / RUN).alias("_run")).agg(
            F.sort_array(F.collect_list(F.struct("rid", "copies", "spans"))).alias("_picks"))
        rows = spool.select("row", "rid", F.col("chunk") if "chunk" in spool.columns else _chunk("rid").alias("chunk"))
        low = F.col("_run") * RUN  # a range, as a second key would have the rows shuffled
        rows = rows.join(picks.hint("shuffle_hash"), (F.col("chunk") == F.col("_chunk")) & (_place("rid") >= low) & (_place("rid") < low + RUN))
        pick = F.get("_picks", F.pmod(_place("rid"), F.lit(RUN)).cast("int"))
        rows = rows.select("row", pick["copies"].alias("copies"), pick["spans"].alias("spans")).filter("copies > 0 OR spans IS NOT NULL")
        some = F.when(F.col("spans").isNotNull(), F.array(F.col("row").withField(
            f"`{text_col}`", _inside(F.col("row").getField(text_col), F.col("spans"))))).otherwise(F.array())
        return unpacked(rows.select(F.explode(F.concat(F.array_repeat("row", F.col("copies")), some)).alias("row")), names)


def _chunk(rid: str) -> Column:
    return F.shiftright(rid, 33)


def _place(rid: str) -> Column:
    return F.col(rid).bitwiseAND((1 << 33) - 1)


def _inside(text: Column, spans: Column) -> Column:
    """The words of a text that lie in its spans, spacing kept."""
    words = F.regexp_extract_all(text, F.lit(f"({WORDS}{GAP[:-1]}*)"), F.lit(1))

    def joined(w: Column) -> Column:
        return F.array_join(F.flatten(F.transform(
            spans, lambda s: F.slice(w, (s["a"] + 1).cast("int"), (s["b"] - s["a"]).cast("int")))), "")

    # words as an argument: an expression inside the function of spans would be worked out for each of them
    return F.rtrim(F.transform(F.array(words), joined)[0])


def _block_of(place: Column) -> Column:
    return F.floor(((place + 1) * F.col("n_blocks") - 1) / F.col("shard_size")).cast("long")


def oracle() -> str:
    """The mix of the table ``documents`` under the defaults, as SQL."""

    def quotas(name: str, rows: str, group: str, key: str, votes: str, most: str) -> str:
        same = " AND ".join(f"p.{k} IS NOT DISTINCT FROM w.{k}" for k in key.split(", "))
        over = f"OVER (PARTITION BY {group})"
        return f"""
{name}0 AS (SELECT *, seats * {votes} / (sum({votes}) {over}) AS fair, {votes} / (sum({votes}) {over}) * ((count(*) {over}) / 2 + 1) + 2 AS slack,
  {most} AS most FROM {rows} WHERE {votes} > 0),
{name}1 AS (SELECT *, least(greatest(0, floor(fair - slack)), most)::BIGINT AS low, least(ceil(fair + slack), most)::BIGINT AS high FROM {name}0),
{name}2 AS (SELECT *, seats - sum(low) {over} AS remaining FROM {name}1),
{name}3 AS (SELECT *, unnest(range(low + 1, high + 1)) AS s FROM {name}2),
{name}4 AS (SELECT {key}, remaining, row_number() OVER (PARTITION BY {group} ORDER BY {votes} / (2 * s - 1)::DOUBLE DESC, {key}) AS rk FROM {name}3),
{name}5 AS (SELECT {key}, count(*) AS won FROM {name}4 WHERE rk <= remaining GROUP BY ALL),
{name} AS (SELECT p.*, (low + coalesce(won, 0))::BIGINT AS quota FROM {name}2 p LEFT JOIN {name}5 w ON {same})"""

    def seeded(what: str, key: str) -> str:
        return f"md5(concat('7|{what}|', {key}))"

    return f"""
WITH d0 AS (SELECT doc_id, source, concat(coalesce(doc_id::VARCHAR, 'null'), '|', md5(coalesce(text, ''))) AS name, len(regexp_extract_all(coalesce(text, ''), '{WORDS}'))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_rows FROM d0 GROUP BY 1),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s0),
s2 AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][place % 3 + 1] AS weight FROM s1),
s3 AS (SELECT *, row_number() OVER o AS rn, (1.5::DOUBLE * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM s2 WINDOW o AS (ORDER BY source_size / weight, place)),
s4 AS (SELECT *, (SELECT arg_min(level, rn) FROM s3 WHERE level * weight <= 2 * source_size) AS lv FROM s3),
s5 AS (SELECT source, source_size, n_rows, coalesce(least(2 * source_size, lv * weight), 2 * source_size)::DOUBLE AS target FROM s4),
s6 AS (SELECT *, CASE WHEN target >= 4096 THEN 64 ELSE 1 END AS unit FROM s5),
s7 AS (SELECT *, round(sum(target) OVER (PARTITION BY unit) / unit)::BIGINT AS seats FROM s6),
{quotas('sq', 's7', 'unit', 'source', 'target', '1::BIGINT << 60')},
src AS (SELECT s6.*, coalesce(quota, 0) AS seats, greatest(1, ceil(s6.source_size / 1000000), ceil(s6.n_rows / 20000))::BIGINT AS n_shards
  FROM s6 LEFT JOIN sq ON s6.source IS NOT DISTINCT FROM sq.source),
d AS (SELECT d0.*, source_size, target, unit, seats, coalesce(concat('s', d0.source), 'n') AS sk,
  ('0x' || substr({seeded('shard', 'd0.name')}, 1, 8))::BIGINT % n_shards AS shard FROM d0 JOIN src ON d0.source IS NOT DISTINCT FROM src.source),
h0 AS (SELECT sk, unit, seats, shard, sum(size)::BIGINT AS shard_size FROM d GROUP BY ALL),
h1 AS (SELECT *, greatest(1, round(shard_size / unit))::BIGINT AS n_blocks FROM h0 WHERE shard_size > 0),
{quotas('hq', 'h1', 'sk', 'sk, shard', 'shard_size', '2 * n_blocks')},
b0 AS (SELECT sk, shard, shard_size, n_blocks, quota // n_blocks AS passes, quota % n_blocks AS extra, unnest(range(n_blocks)) AS block FROM hq),
b1 AS (SELECT *, floor(block * shard_size / n_blocks)::BIGINT AS a, floor((block + 1) * shard_size / n_blocks)::BIGINT AS e,
  row_number() OVER (PARTITION BY sk, shard ORDER BY {seeded('block', "concat_ws('|', sk, shard, block)")}, block) <= extra AS chosen FROM b0),
p AS (SELECT *, sum(size) OVER (PARTITION BY sk, shard ORDER BY {seeded('order', 'name')}, doc_id ROWS UNBOUNDED PRECEDING) - size AS start FROM d),
x AS (SELECT doc_id, sk, shard, sum(least(e, start + size) - greatest(a, start)) AS more FROM p JOIN b1 USING (sk, shard)
  WHERE chosen AND a < start + size AND e > start GROUP BY ALL)
SELECT p.doc_id, p.size, p.source_size, p.target, p.source,
  CASE WHEN p.size > 0 THEN coalesce(passes, 0) * p.size + coalesce(more, 0) ELSE 0 END::BIGINT AS taken
FROM p LEFT JOIN (SELECT DISTINCT sk, shard, passes FROM b1) USING (sk, shard) LEFT JOIN x USING (doc_id, sk, shard)"""
