"""Read, contig, alignment and sketch jobs on the driver's texts and tables."""

from pyspark.sql import functions as F

from fenloom.operators import reads as R
from fenloom.operators import sketches as K
from fenloom.operators.community import renorm
from fenloom.operators.similarity import SimilarityJoin
from fenloom.plans import roles
from fenloom.plans.registry import query, rnd, with_
from fenloom.plans.roles import PART_COUNTS, r6, rounded, table
from fenloom.session import scratch_path

# reads: the printable characters of each document; their codes serve as qualities
READS = """reads AS (SELECT doc_id AS read_id, lang AS file, source, regexp_replace(text, '[^!-~]', '', 'g') AS seq,
  reverse(regexp_replace(text, '[^!-~]', '', 'g')) AS rev FROM documents)"""


def reads(spark, sf):
    seq = F.regexp_replace("text", "[^!-~]", "")
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("read_id"), F.col("lang").alias("file"), "source", seq.alias("seq"), seq.alias("qual"))


DEMUX = """bc AS (SELECT doc_id AS read_id, substr(md5(doc_id::VARCHAR), 1, 1) AS barcode FROM documents),
sheet AS (SELECT lower(to_hex(n_nationkey)) AS barcode, n_name AS sample_id FROM nation WHERE n_nationkey BETWEEN 2 AND 13),
dm AS (SELECT read_id, coalesce(sample_id, 'unmatched') AS sample_id FROM bc LEFT JOIN sheet USING (barcode))"""


def demuxed(spark, sf):
    bc = table(spark, sf, "documents").select(
        F.col("doc_id").alias("read_id"), F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1).alias("barcode"))
    sheet = table(spark, sf, "nation").filter("n_nationkey BETWEEN 2 AND 13").select(
        F.lower(F.hex("n_nationkey")).alias("barcode"), F.col("n_name").alias("sample_id"))
    return R.demux(reads(spark, sf), bc, sheet)


@query("z1_demultiplex", with_(DEMUX, body="SELECT read_id, sample_id FROM dm"))
def z1(spark, sf):
    return demuxed(spark, sf).select("read_id", "sample_id")


@query("z2_read_counts", with_(DEMUX, body="SELECT sample_id, count(*) AS n FROM dm GROUP BY 1"))
def z2(spark, sf):
    return R.demux_summary(demuxed(spark, sf))


PROFILE = """q AS (SELECT file, pos, ascii(ch) - 33 AS s FROM
  (SELECT file, unnest(string_split(seq, '')) AS ch, unnest(range(1, length(seq) + 1)) AS pos FROM reads WHERE length(seq) > 0))"""


@query("z3_quality_profile", with_(READS, PROFILE, body=f"""
SELECT file, pos::INTEGER AS pos, count(*) AS n, {rnd('avg(s)')} AS mean, {rnd('quantile_cont(s, 0.25)')} AS q1,
  {rnd('quantile_cont(s, 0.5)')} AS median, {rnd('quantile_cont(s, 0.75)')} AS q3 FROM q GROUP BY 1, 2"""))
def z3(spark, sf):
    return rounded(R.quality_profile(reads(spark, sf)), "mean", "q1", "median", "q3")


@query("z3_quality_cut", with_(READS, PROFILE, body="""
SELECT file, min(pos)::INTEGER AS cut FROM (SELECT file, pos, avg(s) AS m FROM q GROUP BY 1, 2) WHERE m < 60 GROUP BY 1"""))
def z3c(spark, sf):
    return R.quality_cut(R.quality_profile(reads(spark, sf)), threshold=60)


@query("z4_truncate", with_(READS, body="""
SELECT read_id, substr(seq, 1, 150) AS seq FROM reads WHERE length(seq) >= 150"""))
def z4(spark, sf):
    return R.truncate(reads(spark, sf), 150).select("read_id", "seq")


def _trim(col):
    return f"""(SELECT read_id, coalesce(min(pos) FILTER (WHERE w < 116 AND pos <= n - 3) - 1, any_value(n)) AS k FROM
  (SELECT read_id, pos, n, sum(s) OVER (PARTITION BY read_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS w FROM
    (SELECT read_id, pos, n, ascii(ch) - 33 AS s FROM (SELECT read_id, length({col}) AS n, unnest(string_split({col}, '')) AS ch,
      unnest(range(1, length({col}) + 1)) AS pos FROM reads WHERE length({col}) > 0))) GROUP BY 1)"""


@query("z5_sliding_trim", with_(READS, f"f AS (SELECT * FROM {_trim('seq')} WHERE k >= 25)",
    f"r AS (SELECT * FROM {_trim('rev')} WHERE k >= 25)", body="""
SELECT f.read_id, CASE WHEN r.read_id IS NULL THEN '1U' ELSE '1P' END AS output, f.k::INTEGER AS kept, md5(substr(seq, 1, f.k)) AS digest
FROM f LEFT JOIN r USING (read_id) JOIN reads ON reads.read_id = f.read_id
UNION ALL SELECT r.read_id, CASE WHEN f.read_id IS NULL THEN '2U' ELSE '2P' END, r.k::INTEGER, md5(substr(rev, 1, r.k))
FROM r LEFT JOIN f USING (read_id) JOIN reads ON reads.read_id = r.read_id"""))
def z5(spark, sf):
    fwd = reads(spark, sf)
    rev = fwd.withColumn("seq", F.reverse("seq")).withColumn("qual", F.reverse("qual"))
    out = R.sliding_trim_paired(fwd, rev, 4, 29, 25)
    return out.select("read_id", "output", F.length("seq").alias("kept"), F.md5("seq").alias("digest"))


@query("z6_dereplicate", """
SELECT source AS sample_id, md5(text) AS feature_id, count(*) AS abundance FROM documents GROUP BY 1, 2""")
def z6(spark, sf):
    return R.dereplicate(table(spark, sf, "documents").select(F.col("source").alias("sample_id"), F.col("text").alias("seq")))


def _kmer_sql(cols, tbl, k):
    """Every k-mer of the whole text, listed from overlapping pieces of 400."""
    return f"""(SELECT {cols}, substr(t, p, {k}) AS kmer FROM (SELECT {cols}, t, unnest(range(1, length(t) - {k - 2})) AS p FROM
  (SELECT {cols}, substr(text, b * 400 + 1, {400 + k - 1}) AS t FROM (SELECT *, unnest(range(0, (length(text) - {k}) // 400 + 1)) AS b
    FROM {tbl} WHERE length(text) >= {k}))))"""


@query("z7_classify", f"""
WITH km AS {_kmer_sql('lang', 'documents', 5)},
w AS (SELECT lang, kmer, count(*) AS c FROM km GROUP BY 1, 2),
sz AS (SELECT lang, sum(c) AS words, any_value(docs) AS docs FROM w JOIN (SELECT lang, count(*) AS docs FROM documents GROUP BY 1) USING (lang) GROUP BY 1),
v AS (SELECT count(DISTINCT kmer) AS v FROM w),
qk AS (SELECT item_id, kmer, count(*) AS n FROM {_kmer_sql('item_id', 'benchmark', 5)} GROUP BY 1, 2),
ln AS (SELECT item_id, sum(n) AS len FROM qk GROUP BY 1),
hit AS (SELECT item_id, lang, sum(n * ln(c + 1)) AS s FROM qk JOIN w USING (kmer) GROUP BY 1, 2),
sc AS (SELECT item_id, sz.lang, coalesce(s, 0) - len * ln(words + v) + ln(docs / (SELECT sum(docs) FROM sz)) AS score
  FROM ln CROSS JOIN sz CROSS JOIN v LEFT JOIN hit USING (item_id, lang)),
mx AS (SELECT *, max(score) OVER (PARTITION BY item_id) AS m FROM sc)
SELECT item_id AS seq_id, max(CASE WHEN score = m THEN lang END) AS label, round(1 / sum(exp(score - m)), 6) AS confidence FROM mx GROUP BY 1""")
def z7(spark, sf):
    model = R.train_classifier(table(spark, sf, "documents").select("lang", F.col("text").alias("seq")), "lang", 5)
    seqs = table(spark, sf, "benchmark").select(F.col("item_id").alias("seq_id"), F.col("text").alias("seq"))
    return rounded(R.classify(seqs, model, 5), "confidence")


@query("z7_classify_ranks", f"""
WITH d AS (SELECT lang || ';' || source AS lineage, text FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL),
km AS {_kmer_sql('lineage', 'd', 5)},
w AS (SELECT lineage, kmer, count(*) AS c FROM km GROUP BY 1, 2),
sz AS (SELECT lineage, sum(c) AS words, any_value(docs) AS docs FROM w JOIN (SELECT lineage, count(*) AS docs FROM d GROUP BY 1) USING (lineage) GROUP BY 1),
v AS (SELECT count(DISTINCT kmer) AS v FROM w),
qk AS (SELECT item_id, kmer, count(*) AS n FROM {_kmer_sql('item_id', 'benchmark', 5)} GROUP BY 1, 2),
ln AS (SELECT item_id, sum(n) AS len FROM qk GROUP BY 1),
hit AS (SELECT item_id, lineage, sum(n * ln(c + 1)) AS s FROM qk JOIN w USING (kmer) GROUP BY 1, 2),
sc AS (SELECT item_id, sz.lineage, coalesce(s, 0) - len * ln(words + v) + ln(docs / (SELECT sum(docs) FROM sz)) AS score
  FROM ln CROSS JOIN sz CROSS JOIN v LEFT JOIN hit USING (item_id, lineage)),
mx AS (SELECT *, exp(score - max(score) OVER o) AS p, first_value(lineage) OVER (o ORDER BY score DESC, lineage DESC) AS best FROM sc WINDOW o AS (PARTITION BY item_id)),
lv AS (SELECT item_id, lineage, p, unnest([0, 1, 2]) AS rank, [best, split_part(best, ';', 1)] AS b FROM mx),
ranks AS (SELECT item_id, rank, CASE rank WHEN 0 THEN '' WHEN 1 THEN any_value(b[2]) ELSE any_value(b[1]) END AS lineage,
  sum(CASE WHEN rank = 0 OR rank = 1 AND split_part(lineage, ';', 1) = b[2] OR rank = 2 AND lineage = b[1] THEN p ELSE 0 END) / sum(p) AS confidence
  FROM lv GROUP BY item_id, rank)
SELECT item_id AS seq_id, rank, lineage, round(confidence, 6) AS confidence FROM ranks WHERE confidence >= 0.7 OR rank = 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY rank DESC) = 1""")
def z7_ranks(spark, sf):
    docs = table(spark, sf, "documents").filter("lang IS NOT NULL AND source IS NOT NULL").select(
        F.concat_ws(";", "lang", "source").alias("lineage"), F.col("text").alias("seq"))
    seqs = table(spark, sf, "benchmark").select(F.col("item_id").alias("seq_id"), F.col("text").alias("seq"))
    return rounded(R.classify_lineages(seqs, R.train_classifier(docs, "lineage", 5), 5, 0.7), "confidence")


# ---- sketches ------------------------------------------------------------------------------------

SCALED = 20
K_LEN = 21
LIMIT = K.HASH_SPACE // SCALED


def _sketch_sql(name, id_, tbl):
    return f"""{name} AS MATERIALIZED (SELECT {id_} AS id, h, count(*) AS abund FROM (SELECT {id_}, ('0x' || substr(md5(kmer), 1, 15))::BIGINT AS h
  FROM {_kmer_sql(id_, tbl, K_LEN)}) WHERE h < {LIMIT} GROUP BY 1, 2)"""


def doc_sketches(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("sketch_id"), F.col("text").alias("seq"))
    return K.sketch(docs, K_LEN, SCALED, dna=False, method="md5")


def ref_sketches(spark, sf):
    refs = table(spark, sf, "benchmark").select(F.col("item_id").alias("sketch_id"), F.col("text").alias("seq"))
    return K.sketch(refs, K_LEN, SCALED, dna=False, method="md5")


@query("z8_sketch", with_(_sketch_sql("sk", "source", "documents"), body="SELECT id AS sketch_id, h AS hash, abund FROM sk"))
def z8(spark, sf):
    return doc_sketches(spark, sf)


# invented bases, some soft-masked, with an N for each full stop
DNA = "translate({}, 'abdefhijklmnopqrsuvwxyz ,.', 'acgtACGTacgtACGTacgtACGTaN')"


@query("z8_sketch_dna", f"""
WITH d AS (SELECT source, upper({DNA.format('text')}) AS text FROM documents),
km AS (SELECT source, least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS w FROM {_kmer_sql('source', 'd', K_LEN)} WHERE regexp_full_match(kmer, '[ACGT]+'))
SELECT source AS sketch_id, ('0x' || substr(md5(w), 1, 15))::BIGINT AS hash, count(*) AS abund FROM km
WHERE ('0x' || substr(md5(w), 1, 15))::BIGINT < {LIMIT} GROUP BY 1, 2""")
def z8d(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("sketch_id"), F.expr(DNA.format("text")).alias("seq"))
    return K.sketch(docs, K_LEN, SCALED, method="md5")


@query("z6_representatives", "SELECT md5(text) AS feature_id, any_value(text) AS seq FROM documents GROUP BY 1")
def z6r(spark, sf):
    return R.representative_sequences(table(spark, sf, "documents").select(F.col("text").alias("seq")))


GATHER_ROUNDS = 60
THRESHOLD = 2


def _gather_sql(rounds=GATHER_ROUNDS):
    parts = [_sketch_sql("sq", "source", "documents"), _sketch_sql("sr", "item_id", "benchmark"),
             "size AS (SELECT id, count(*) AS qs, sum(abund) AS qa FROM sq GROUP BY 1)",
             "h0 AS MATERIALIZED (SELECT q.id, q.h, q.abund, r.id AS ref FROM sq q JOIN sr r USING (h))"]
    for n in range(rounds):
        parts.append(f"""b{n} AS MATERIALIZED (SELECT id, ref, o, w FROM (SELECT id, ref, count(*) AS o, sum(abund) AS w FROM h{n} GROUP BY 1, 2)
  WHERE o >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY id ORDER BY o DESC, ref) = 1)""")
        parts.append(f"""h{n + 1} AS MATERIALIZED (SELECT * FROM h{n} x WHERE id IN (SELECT id FROM b{n}) AND NOT EXISTS
  (SELECT 1 FROM h{n} y JOIN b{n} b ON b.id = y.id AND b.ref = y.ref WHERE y.id = x.id AND y.h = x.h))""")
    union = " UNION ALL ".join(f"SELECT *, {n} AS rank FROM b{n}" for n in range(rounds))
    parts.append(f"g AS ({union})")
    return parts


GATHER_OUT = f"""go AS (SELECT g.id AS sketch_id, rank, ref AS ref_id, (o * {SCALED})::BIGINT AS unique_intersect_bp, w / o AS average_abund,
  w::BIGINT AS n_unique_weighted_found, o / qs AS f_unique, w / qa AS f_weighted FROM g JOIN size USING (id))"""
LINEAGE = """lin AS (SELECT item_id AS ref_id, concat('d__', length(text) % 2, ';p__', length(text) % 5, ';c__', item_id % 7) AS lineage FROM benchmark)"""


def gathered(spark, sf):
    return K.gather(doc_sketches(spark, sf), ref_sketches(spark, sf), THRESHOLD * SCALED, SCALED)


def lineages(spark, sf):
    n = F.length("text")
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("ref_id"), F.concat(
        F.lit("d__"), n % 2, F.lit(";p__"), n % 5, F.lit(";c__"), F.col("item_id") % 7).alias("lineage"))


@query("z9_gather", with_(*_gather_sql(), GATHER_OUT, body=f"""
SELECT sketch_id, rank, ref_id, unique_intersect_bp, {rnd('average_abund')} AS average_abund, n_unique_weighted_found,
  {rnd('f_unique')} AS f_unique, {rnd('f_weighted')} AS f_weighted FROM go"""))
def z9(spark, sf):
    return rounded(gathered(spark, sf).drop("round"), "average_abund", "f_unique", "f_weighted")


@query("z10_annotate_matches", with_(*_gather_sql(), GATHER_OUT, LINEAGE, body="""
SELECT sketch_id, rank, ref_id, lineage FROM go LEFT JOIN lin USING (ref_id)"""))
def z10(spark, sf):
    return K.tax_annotate(gathered(spark, sf), lineages(spark, sf)).select("sketch_id", "rank", "ref_id", "lineage")


@query("z11_summarise_ranks", with_(*_gather_sql(), GATHER_OUT, LINEAGE, """an AS (
  SELECT go.*, string_split(lineage, ';') AS p FROM go JOIN lin USING (ref_id))""", body=f"""
SELECT sketch_id, ['domain', 'phylum', 'class'][n] AS rank, array_to_string(p[1:n], ';') AS lineage, {rnd('sum(f_unique)')} AS fraction,
  {rnd('sum(f_weighted)')} AS f_weighted_at_rank, sum(unique_intersect_bp)::BIGINT AS bp_match_at_rank
FROM an, (SELECT unnest([1, 2, 3]) AS n) GROUP BY 1, 2, 3"""))
def z11(spark, sf):
    out = K.tax_summarise(K.tax_annotate(gathered(spark, sf), lineages(spark, sf)))
    return rounded(out, "fraction", "f_weighted_at_rank")


@query("z12_genome_lineage", with_(*_gather_sql(), GATHER_OUT, LINEAGE, f"""an AS (
  SELECT go.*, lineage, power(f_unique, 1.0::DOUBLE / {K_LEN}) AS ani FROM go JOIN lin USING (ref_id))""", body=f"""
SELECT sketch_id, ref_id, lineage, {rnd('ani')} AS ani FROM an WHERE ani >= 0.6
QUALIFY row_number() OVER (PARTITION BY sketch_id ORDER BY f_unique DESC, rank) = 1"""))
def z12(spark, sf):
    return rounded(K.tax_genome(K.tax_annotate(gathered(spark, sf), lineages(spark, sf)), K_LEN, 0.6), "ani")


@query("z13_sketch_compare", with_(_sketch_sql("sk", "source", "documents"), """n AS (SELECT id, count(*) AS n FROM sk GROUP BY 1)""",
    """x AS (SELECT a.id AS i, b.id AS j, count(*) AS s FROM sk a JOIN sk b ON a.h = b.h AND a.id < b.id GROUP BY 1, 2)""", body=f"""
SELECT a.id AS i, b.id AS j, coalesce(s, 0)::DOUBLE AS shared, {rnd('coalesce(s, 0) / (a.n + b.n - coalesce(s, 0))')} AS similarity
FROM n a JOIN n b ON a.id < b.id LEFT JOIN x ON x.i = a.id AND x.j = b.id"""))
def z13(spark, sf):
    return rounded(K.sketch_compare(doc_sketches(spark, sf)), "similarity")


def doc_links(spark, sf, threshold):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("sketch_id"), F.col("text").alias("seq"))
    return SimilarityJoin(K.sketch(docs, K_LEN, SCALED, dna=False, method="md5"), threshold).edges()


@query("z14_dereplicate_genomes", with_(_sketch_sql("sk", "doc_id", "documents"), """n AS (SELECT id, count(*) AS n FROM sk GROUP BY 1)""",
    """x AS (SELECT a.id AS i, b.id AS j, count(*) AS s FROM sk a JOIN sk b ON a.h = b.h AND a.id < b.id GROUP BY 1, 2)""",
    """ed AS MATERIALIZED (SELECT i, j FROM x JOIN n a ON a.id = i JOIN n b ON b.id = j WHERE s / (a.n + b.n - s) >= 0.5)""",
    """sym AS MATERIALIZED (SELECT i, j FROM ed UNION ALL SELECT j, i FROM ed)""", body="""
SELECT component, arg_max(doc_id, score) AS genome, max(score) AS score, count(*) AS members FROM (
  SELECT doc_id, min(root) AS component, any_value(n_chars - doc_id / 1e6::DOUBLE) AS score FROM (
    WITH RECURSIVE reach(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, sym.j
      FROM reach JOIN sym ON sym.i = reach.root) SELECT * FROM reach) JOIN documents USING (doc_id) GROUP BY 1) GROUP BY 1"""))
def z14(spark, sf):
    genomes = table(spark, sf, "documents").select(
        F.col("doc_id").alias("genome"), (F.col("n_chars") - F.col("doc_id") / F.lit(1e6)).alias("score"))
    return K.dereplicate_genomes(doc_links(spark, sf, 0.5), genomes, 0.5)


@query("z15_consensus_bins")
def z15(spark, sf):
    o = table(spark, sf, "orders").join(
        table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment"), "o_custkey")
    bins = o.select(F.explode(F.array(
        F.concat(F.lit("a."), "c_nationkey"), F.concat(F.lit("b."), "c_mktsegment", F.lit("."), "o_orderstatus"))).alias("bin"),
        F.col("o_orderkey").alias("contig"), F.col("o_totalprice").alias("size"))
    scores = bins.groupBy("bin").agg((F.sum("size") / F.count(F.lit(1)) / F.max("size")).alias("score"))
    return rounded(K.consensus_bins(bins, scores, 0.35), "score", "size", digits=4)


# ---- contigs ---------------------------------------------------------------------------------------


@query("z16_cut_contigs", """
SELECT doc_id AS seq_id, piece::INTEGER AS piece, substr(text, piece * 1000 + 1, CASE WHEN piece = n - 1 THEN length(text) ELSE 1000 END) AS seq
FROM (SELECT doc_id, text, greatest(length(text) // 1000, 1) AS n, unnest(range(0, greatest(length(text) // 1000, 1))) AS piece FROM documents)""")
def z16(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("seq_id"), F.col("text").alias("seq"))
    return R.cut_contigs(docs, 1000)


@query("z17_merge_pieces", """
WITH v AS (SELECT l_orderkey AS seq_id, l_returnflag AS cluster, count(*) AS n FROM lineitem GROUP BY 1, 2),
t AS (SELECT * FROM v QUALIFY rank() OVER (PARTITION BY seq_id ORDER BY n DESC) = 1)
SELECT seq_id, min(cluster) AS cluster, max(n) AS votes FROM t GROUP BY 1""")
def z17(spark, sf):
    return R.merge_pieces(table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("seq_id"), F.col("l_returnflag").alias("cluster")))


@query("z18_extract_bins", """
SELECT lang AS bin, count(*) AS n, sum(length(text))::BIGINT AS bases FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def z18(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("seq_id"), F.col("text").alias("seq"))
    members = table(spark, sf, "documents").select(F.col("doc_id"), F.col("lang").alias("bin")).join(
        table(spark, sf, "labels").select("doc_id"), "doc_id").withColumnRenamed("doc_id", "seq_id")
    path = scratch_path(spark, "bins")
    R.extract_bins(docs, members, path)
    return spark.read.parquet(path).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("seq")).alias("bases"))


ALN = """aln AS (SELECT l_suppkey AS ref, l_orderkey * 3 + l_linenumber AS pos, CAST(l_quantity AS BIGINT) AS length,
  CAST(floor(l_extendedprice) AS BIGINT) & 1279 AS flag FROM lineitem)"""


def alignments(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("ref"), (F.col("l_orderkey") * 3 + F.col("l_linenumber")).alias("pos"),
        F.col("l_quantity").cast("bigint").alias("length"), F.floor("l_extendedprice").bitwiseAND(1279).alias("flag"))


EV = """ev AS (SELECT ref, ap, sum(step) AS step FROM (SELECT ref, pos AS ap, 1 AS step FROM aln
  UNION ALL SELECT ref, pos + length, -1 FROM aln) GROUP BY 1, 2),
run AS (SELECT ref, ap, sum(step) OVER (PARTITION BY ref ORDER BY ap) AS depth, lead(ap) OVER (PARTITION BY ref ORDER BY ap) AS stop FROM ev)"""


@query("z19_depth_runs", with_(ALN, EV, body="""
SELECT ref, ap AS start, stop, depth::BIGINT AS depth FROM run WHERE depth > 0"""))
def z19(spark, sf):
    return R.depth(alignments(spark, sf))


@query("z19_coverage", with_(ALN, EV, body=f"""
SELECT ref, bases, covered, {rnd('bases / covered')} AS mean_depth FROM
  (SELECT ref, sum(length)::BIGINT AS bases FROM aln GROUP BY 1) JOIN
  (SELECT ref, sum(stop - ap)::BIGINT AS covered FROM run WHERE depth > 0 GROUP BY 1) USING (ref)"""))
def z19c(spark, sf):
    return rounded(R.coverage_table(alignments(spark, sf)), "mean_depth")


@query("z20_idxstats", with_(ALN, body="""
SELECT ref, count(*) FILTER (WHERE (flag & 4) = 0) AS mapped, count(*) FILTER (WHERE (flag & 4) <> 0) AS unmapped FROM aln GROUP BY 1"""))
def z20(spark, sf):
    return R.idxstats(alignments(spark, sf))


@query("z20_flagstat", with_(ALN, body="SELECT count(*) AS total, count(*) FILTER (WHERE (flag & 4) = 0) AS mapped, " + ", ".join(
    f"count(*) FILTER (WHERE (flag & {b}) <> 0) AS {n}" for b, n in
    ((1, "paired"), (2, "proper_pair"), (256, "secondary"), (1024, "duplicates"))) + " FROM aln"))
def z20f(spark, sf):
    return R.flagstat(alignments(spark, sf))


@query("z21_assembly_stats", f"""
WITH s AS (SELECT source, length(text) AS len, length(text) - length(translate(lower(text), 'gc', '')) AS gc FROM documents),
r AS (SELECT *, sum(len) OVER (PARTITION BY source ORDER BY len DESC) AS cum, sum(len) OVER (PARTITION BY source) AS tot FROM s)
SELECT source, count(*) AS contigs, sum(len)::BIGINT AS total, {rnd('sum(gc) / sum(len)')} AS gc, max(len) AS longest,
  max(len) FILTER (WHERE cum * 2 >= tot) AS n50 FROM r GROUP BY 1""")
def z21(spark, sf):
    return rounded(R.assembly_stats(table(spark, sf, "documents").select("source", F.col("text").alias("seq")), "source"), "gc")


@query("z22_tpm", with_(PART_COUNTS, body=f"""
SELECT sample_id, feature_id, abundance, {rnd('r / sum(r) OVER (PARTITION BY sample_id) * 1e6', 4)} AS tpm FROM
  (SELECT *, abundance / (100 + p_size) AS r FROM pcounts JOIN part ON p_partkey = feature_id)"""))
def z22(spark, sf):
    lengths = table(spark, sf, "part").select(F.col("p_partkey").alias("feature_id"), (100 + F.col("p_size")).alias("length"))
    return rounded(R.tpm(roles.part_counts(spark, sf), lengths), "tpm", digits=4)


@query("z24_renorm_cpm", with_(PART_COUNTS, body=f"""
SELECT sample_id, feature_id, {rnd('1e6 * abundance / sum(abundance) OVER (PARTITION BY sample_id)', 4)} AS abundance FROM pcounts"""))
def z24(spark, sf):
    return rounded(renorm(roles.part_counts(spark, sf), "cpm"), "abundance", digits=4)


HIT = """hit AS (SELECT l_orderkey AS query, l_partkey AS subject, l_quantity * 2 AS pident, l_extendedprice / 10 AS bitscore, l_tax AS evalue FROM lineitem),
ok AS (SELECT * FROM hit WHERE pident >= 60 AND bitscore >= 200 AND evalue <= 0.05)"""


@query("z25_hit_filter", with_(HIT, body=f"""
SELECT query, subject, pident, {rnd('bitscore')} AS bitscore FROM ok QUALIFY rank() OVER (PARTITION BY query ORDER BY pident DESC) = 1"""))
def z25(spark, sf):
    hits = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("subject"), (F.col("l_quantity") * 2).alias("pident"),
        r6(F.col("l_extendedprice") / 10).alias("bitscore"), F.col("l_tax").alias("evalue"))
    return R.best_identity(R.filter_hits(hits, 60, 200, 0.05)).drop("evalue")


@query("z26_genome_quality", """
SELECT s_suppkey AS genome, s_acctbal / 100 AS completeness, n_name AS species FROM supplier JOIN nation ON n_nationkey = s_nationkey
WHERE s_acctbal / 100 > 40 AND s_nationkey / 2 < 9""")
def z26(spark, sf):
    report = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("genome"), (F.col("s_acctbal") / 100).alias("completeness"),
        (F.col("s_nationkey") / 2).alias("contamination"), "s_nationkey")
    tax = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(
        F.col("s_suppkey").alias("genome"), F.col("n_name").alias("species"))
    return R.mag_quality(report, tax, 40, 9).select("genome", "completeness", "species")
