"""Permutation tests, factor models and intervals on the driver's tables."""

from pyspark.sql import Window, functions as F

from fenloom.operators import distance as D
from fenloom.operators import growth as G
from fenloom.operators import mixed as X
from fenloom.operators import models as M
from fenloom.operators import permutation as P
from fenloom.operators import summary
from fenloom.plans import roles
from fenloom.plans.registry import query, rnd, with_
from fenloom.plans.roles import PART_COUNTS, SAMPLES, r6, rounded, table

NPERM = 999

# treatment from the balance, a two-level second factor from the name, nation as block
SHEET = """sheet AS (SELECT s_suppkey AS sample_id,
  CASE WHEN s_acctbal < 3000 THEN 'CommA' WHEN s_acctbal < 6000 THEN 'CommB' ELSE 'CommC' END AS treatment,
  CASE WHEN substr(md5(s_name), 1, 1) < '8' THEN 'd1' ELSE 'd55' END AS day, n_name AS block, s_acctbal AS chit
  FROM supplier JOIN nation ON n_nationkey = s_nationkey)"""

BRAY = """ptot AS (SELECT sample_id, sum(abundance) AS t FROM pcounts GROUP BY 1),
pnum AS (SELECT a.sample_id AS i, b.sample_id AS j, sum(least(a.abundance, b.abundance)) AS s
  FROM pcounts a JOIN pcounts b ON a.feature_id = b.feature_id AND a.sample_id < b.sample_id GROUP BY 1, 2),
dist AS (SELECT a.sample_id AS i, b.sample_id AS j, 1 - 2 * coalesce(s, 0) / (a.t + b.t) AS d
  FROM ptot a JOIN ptot b ON a.sample_id < b.sample_id LEFT JOIN pnum ON i = a.sample_id AND j = b.sample_id)"""


def perms(labels: str, part: str = "", nperm: int = NPERM, seed: int = 1) -> str:
    """perm 0 is the observed labelling; the rest follow md5 order within ``part``."""
    over = f"PARTITION BY {part}" if part else ""
    over2 = f"PARTITION BY perm{', ' + part if part else ''}"
    cols = f", {part}" if part else ""
    on = f"USING (rn{cols})"
    return f"""own AS (SELECT row_number() OVER ({over} ORDER BY sample_id) AS rn, lab{cols} FROM {labels}),
drawn AS (SELECT perm, sample_id, row_number() OVER ({over2} ORDER BY md5(concat_ws('|', '{seed}', perm, sample_id))) AS rn{cols}
  FROM {labels}, (SELECT unnest(range(1, {nperm + 1})) AS perm)),
labs AS (SELECT 0 AS perm, sample_id, lab{cols} FROM {labels} UNION ALL
  SELECT perm, sample_id, lab{cols} FROM drawn JOIN own {on})"""


def sheet(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    bal = F.col("s_acctbal")
    return s.join(n, F.col("n_nationkey") == F.col("s_nationkey")).select(
        F.col("s_suppkey").alias("sample_id"),
        F.when(bal < 3000, "CommA").when(bal < 6000, "CommB").otherwise("CommC").alias("treatment"),
        F.when(F.substring(F.md5("s_name"), 1, 1) < "8", "d1").otherwise("d55").alias("day"),
        F.col("n_name").alias("block"), bal.alias("chit"))


def bray(spark, sf, tiled=False):
    return D.bray_curtis(roles.part_counts(spark, sf), tiled)


ONE_FACTOR = with_(PART_COUNTS, SHEET, BRAY, "lab0 AS (SELECT sample_id, treatment AS lab FROM sheet)", perms("lab0"),
    """sz AS (SELECT lab, count(*) AS n FROM lab0 GROUP BY 1)""",
    """ssw AS (SELECT a.perm, sum(d * d / n) AS ssw FROM dist JOIN labs a ON a.sample_id = i
  JOIN labs b ON b.sample_id = j AND b.perm = a.perm AND a.lab = b.lab JOIN sz ON sz.lab = a.lab GROUP BY 1)""",
    """c AS (SELECT count(*) AS n, count(DISTINCT lab) AS a FROM lab0)""",
    """st AS (SELECT perm, sst, ssw, ((sst - ssw) / (a - 1)) / (ssw / (n - a)) AS f, a, n
  FROM ssw, c, (SELECT sum(d * d) / any_value(n) AS sst FROM dist, c))""",
    """obs AS (SELECT * FROM st WHERE perm = 0)""",
    """p AS (SELECT (1 + count(*) FILTER (WHERE st.f >= obs.f - abs(obs.f) * 1e-9)) / (1.0::DOUBLE + 999) AS p
  FROM st, obs WHERE st.perm > 0)""", body=f"""
SELECT 'treatment' AS term, a - 1 AS df, {rnd('sst - ssw')} AS ss, {rnd('(sst - ssw) / sst')} AS r2, {rnd('f')} AS f, {rnd('p')} AS p FROM obs, p
UNION ALL SELECT 'Residual', n - a, {rnd('ssw')}, {rnd('ssw / sst')}, NULL, NULL FROM obs
UNION ALL SELECT 'Total', n - 1, {rnd('sst')}, 1.0::DOUBLE, NULL, NULL FROM obs""")


@query("e15_permanova", ONE_FACTOR)
def e15(spark, sf):
    return rounded(P.permanova(bray(spark, sf, tiled=True), sheet(spark, sf), "treatment", NPERM), "ss", "r2", "f", "p")


# treatment * day: the second factor has two levels, so its sequential sum of squares has
# the closed form b'Gb / b'b with b the day indicator less its treatment mean
FACTORIAL = with_(PART_COUNTS, SHEET, BRAY,
    "lab0 AS (SELECT sample_id, concat(treatment, '/', day) AS lab, block FROM sheet)", perms("lab0", "block"),
    """cells AS (SELECT lab, split_part(lab, '/', 1) AS t, split_part(lab, '/', 2) AS w, count(*) AS n FROM lab0 GROUP BY 1)""",
    """tr AS (SELECT t, sum(n) AS nt, sum(CASE WHEN w = 'd55' THEN n ELSE 0 END) / sum(n) AS pb FROM cells GROUP BY 1)""",
    """cw AS (SELECT lab, t, n, nt, CASE WHEN w = 'd55' THEN 1 ELSE 0 END - pb AS b FROM cells JOIN tr USING (t))""",
    """bb AS (SELECT sum(n * b * b) AS bb, sum(n) AS nn, count(*) AS c, count(DISTINCT t) AS a FROM cw)""",
    """q AS (SELECT a.perm, sum(d * d) AS s_all, sum(CASE WHEN ca.t = cb.t THEN d * d / ca.nt ELSE 0 END) AS s_t,
  sum(CASE WHEN ca.lab = cb.lab THEN d * d / ca.n ELSE 0 END) AS s_c, sum(ca.b * cb.b * d * d) AS s_b
  FROM dist JOIN labs a ON a.sample_id = i JOIN labs b ON b.sample_id = j AND b.perm = a.perm
  JOIN cw ca ON ca.lab = a.lab JOIN cw cb ON cb.lab = b.lab GROUP BY 1)""",
    """st AS (SELECT perm, s_all / nn AS sst, s_all / nn - s_t AS ss1, -s_b / bb AS ss2,
  s_t + s_b / bb - s_c AS ss3, s_c AS res, nn, c, a FROM q, bb)""",
    """long AS (SELECT perm, 'treatment' AS term, a - 1 AS df, ss1 AS ss, sst, (ss1 / (a - 1)) / (res / (nn - c)) AS f FROM st
  UNION ALL SELECT perm, 'day', 1, ss2, sst, ss2 / (res / (nn - c)) FROM st
  UNION ALL SELECT perm, 'treatment:day', c - a - 1, ss3, sst, (ss3 / (c - a - 1)) / (res / (nn - c)) FROM st
  UNION ALL SELECT perm, 'Residual', nn - c, res, sst, NULL FROM st
  UNION ALL SELECT perm, 'Total', nn - 1, sst, sst, NULL FROM st)""",
    """obs AS (SELECT * FROM long WHERE perm = 0)""", body=f"""
SELECT obs.term, obs.df::BIGINT AS df, {rnd('obs.ss')} AS ss, {rnd('obs.ss / obs.sst')} AS r2, {rnd('obs.f')} AS f,
  CASE WHEN obs.f IS NOT NULL THEN {rnd('''(1 + (SELECT count(*) FROM long l WHERE l.term = obs.term AND l.perm > 0
    AND l.f >= obs.f - abs(obs.f) * 1e-9)) / (1.0::DOUBLE + 999)''')} END AS p FROM obs""")


@query("e16_permanova_factorial_blocked", FACTORIAL)
def e16(spark, sf):
    out = P.permanova_terms(bray(spark, sf, tiled=True), sheet(spark, sf),
                            [("treatment",), ("day",), ("treatment", "day")], NPERM, strata="block")
    return rounded(out, "ss", "r2", "f", "p")


PAIRWISE = with_(PART_COUNTS, SHEET, BRAY,
    """lv AS (SELECT DISTINCT treatment AS l FROM sheet)""",
    """con AS (SELECT concat(x.l, '_vs_', y.l) AS contrast, x.l AS a, y.l AS b FROM lv x JOIN lv y ON x.l < y.l)""",
    """lab0 AS (SELECT sample_id, treatment AS lab, contrast FROM sheet JOIN con ON treatment IN (a, b))""",
    perms("lab0", "contrast"),
    """sz AS (SELECT treatment AS lab, count(*) AS n FROM sheet GROUP BY 1)""",
    """q AS (SELECT a.contrast, a.perm, sum(d * d) AS s_all, sum(CASE WHEN a.lab = b.lab THEN d * d / n ELSE 0 END) AS ssw
  FROM dist JOIN labs a ON a.sample_id = i JOIN labs b ON b.sample_id = j AND b.perm = a.perm AND a.contrast = b.contrast
  JOIN sz ON sz.lab = a.lab GROUP BY 1, 2)""",
    """nn AS (SELECT contrast, count(*) AS n FROM lab0 GROUP BY 1)""",
    """st AS (SELECT contrast, perm, s_all / n AS sst, ssw, (s_all / n - ssw) / (ssw / (n - 2)) AS f FROM q JOIN nn USING (contrast))""",
    """obs AS (SELECT * FROM st WHERE perm = 0)""", body=f"""
SELECT contrast, {rnd('sst')} AS sst, {rnd('ssw')} AS ssw, {rnd('1 - ssw / sst')} AS r2, {rnd('f')} AS f,
  {rnd('''(1 + (SELECT count(*) FROM st s WHERE s.contrast = obs.contrast AND s.perm > 0
    AND s.f >= obs.f - abs(obs.f) * 1e-9)) / (1.0::DOUBLE + 999)''')} AS p FROM obs""")


@query("e17_pairwise_permanova", PAIRWISE)
def e17(spark, sf):
    out = P.pairwise_permanova(bray(spark, sf, tiled=True), sheet(spark, sf), "treatment", NPERM)
    return rounded(out, "sst", "ssw", "r2", "f", "p")


NESTED = with_(PART_COUNTS, SHEET, BRAY,
    "lab0 AS (SELECT sample_id, concat(treatment, '/', day) AS lab FROM sheet)", perms("lab0"),
    """cells AS (SELECT lab, split_part(lab, '/', 1) AS t, count(*) AS n FROM lab0 GROUP BY 1)""",
    """cw AS (SELECT lab, t, n, sum(n) OVER (PARTITION BY t) AS nt FROM cells)""",
    """k AS (SELECT sum(n) AS nn, count(*) AS c, count(DISTINCT t) AS a FROM cw)""",
    """q AS (SELECT a.perm, sum(d * d) AS s_all, sum(CASE WHEN ca.t = cb.t THEN d * d / ca.nt ELSE 0 END) AS s_t,
  sum(CASE WHEN ca.lab = cb.lab THEN d * d / ca.n ELSE 0 END) AS s_c
  FROM dist JOIN labs a ON a.sample_id = i JOIN labs b ON b.sample_id = j AND b.perm = a.perm
  JOIN cw ca ON ca.lab = a.lab JOIN cw cb ON cb.lab = b.lab GROUP BY 1)""",
    """st AS (SELECT perm, s_all / nn AS sst, s_all / nn - s_t AS ss1, s_t - s_c AS ss2, s_c AS res, nn, c, a FROM q, k)""",
    """long AS (SELECT perm, 'treatment' AS term, a - 1 AS df, ss1 AS ss, sst, (ss1 / (a - 1)) / (res / (nn - c)) AS f FROM st
  UNION ALL SELECT perm, 'treatment:day', c - a, ss2, sst, (ss2 / (c - a)) / (res / (nn - c)) FROM st
  UNION ALL SELECT perm, 'Residual', nn - c, res, sst, NULL FROM st
  UNION ALL SELECT perm, 'Total', nn - 1, sst, sst, NULL FROM st)""",
    """obs AS (SELECT * FROM long WHERE perm = 0)""", body=f"""
SELECT obs.term, obs.df::BIGINT AS df, {rnd('obs.ss')} AS ss, {rnd('obs.ss / obs.sst')} AS r2, {rnd('obs.f')} AS f,
  CASE WHEN obs.f IS NOT NULL THEN {rnd('''(1 + (SELECT count(*) FROM long l WHERE l.term = obs.term AND l.perm > 0
    AND l.f >= obs.f - abs(obs.f) * 1e-9)) / (1.0::DOUBLE + 999)''')} END AS p FROM obs""")


@query("e17_permanova_nested", NESTED)
def e17n(spark, sf):
    out = P.permanova_terms(bray(spark, sf, tiled=True), sheet(spark, sf), [("treatment",), ("treatment", "day")], NPERM)
    return rounded(out, "ss", "r2", "f", "p")


MANTEL = with_(PART_COUNTS, SHEET, BRAY,
    """rk AS (SELECT i, j, rank() OVER (ORDER BY dist.d) + (count(*) OVER (PARTITION BY dist.d) - 1) / 2 AS r1,
  rank() OVER (ORDER BY e) + (count(*) OVER (PARTITION BY e) - 1) / 2 AS r2
  FROM (SELECT i, j, round(d, 12) AS d, abs(x.chit - y.chit) AS e FROM dist JOIN sheet x ON x.sample_id = i
    JOIN sheet y ON y.sample_id = j) dist)""",
    "lab0 AS (SELECT sample_id, sample_id AS lab FROM sheet)", perms("lab0"),
    """sym AS (SELECT i, j, r2 FROM rk UNION ALL SELECT j, i, r2 FROM rk)""",
    """x AS (SELECT a.perm, corr(rk.r1, sym.r2) AS r FROM rk JOIN labs a ON a.sample_id = rk.i
  JOIN labs b ON b.sample_id = rk.j AND b.perm = a.perm JOIN sym ON sym.i = a.lab AND sym.j = b.lab GROUP BY 1)""",
    """obs AS (SELECT r FROM x WHERE perm = 0)""", body=f"""
SELECT {rnd('obs.r')} AS r, {rnd('(1 + count(*) FILTER (WHERE x.r >= obs.r - abs(obs.r) * 1e-9)) / (1.0::DOUBLE + 999)')} AS p,
  (SELECT count(*) FROM rk) AS pairs FROM x, obs WHERE perm > 0 GROUP BY obs.r""")


@query("e18_mantel", MANTEL)
def e18(spark, sf):
    d1 = bray(spark, sf).withColumn("d", F.round("d", 12))
    d2 = D.euclidean(sheet(spark, sf), ["chit"])
    return rounded(P.mantel(d1, d2, NPERM), "r", "p")


CENTROID = """lab AS (SELECT sample_id, treatment AS g FROM sheet),
both_ways AS (SELECT i AS s, d * d AS d2, x.g FROM dist JOIN lab x ON x.sample_id = i JOIN lab y ON y.sample_id = j AND x.g = y.g
  UNION ALL SELECT j, d * d, x.g FROM dist JOIN lab x ON x.sample_id = i JOIN lab y ON y.sample_id = j AND x.g = y.g),
per AS (SELECT lab.sample_id, lab.g, coalesce(sum(d2), 0) AS s FROM lab LEFT JOIN both_ways ON s = sample_id GROUP BY 1, 2),
grp AS (SELECT g, count(*) AS n, sum(s) / 2 AS w FROM per GROUP BY 1),
zz AS (SELECT sample_id, g, sqrt(abs(s / n - w / (n * n))) AS z FROM per JOIN grp USING (g))"""


@query("e14_dispersion_distances", with_(PART_COUNTS, SHEET, BRAY, CENTROID, body=f"""
SELECT sample_id, g AS "group", {rnd('z')} AS z FROM zz"""))
def e14z(spark, sf):
    return rounded(P.centroid_distances(bray(spark, sf, tiled=True), sheet(spark, sf), "treatment"), "z")


@query("e14_dispersion_centroid", with_(PART_COUNTS, SHEET, BRAY, CENTROID,
    """m AS (SELECT g, count(*) AS n, avg(z) AS m, coalesce(var_samp(z), 0) AS v FROM zz GROUP BY 1)""",
    """t AS (SELECT count(*) AS a, sum(n) AS nn, sum(n * m * m) - power(sum(n * m), 2) / sum(n) AS ssb,
  sum((n - 1) * v) AS ssw FROM m)""", body=f"""
SELECT (a - 1)::BIGINT AS df1, (nn - a)::BIGINT AS df2, {rnd('ssb')} AS ss_between, {rnd('ssw')} AS ss_within,
  {rnd('(ssb / (a - 1)) / (ssw / (nn - a))', 4)} AS f FROM t"""))
def e14c(spark, sf):
    out = P.dispersion(bray(spark, sf, tiled=True), sheet(spark, sf), "treatment", center="centroid").drop("p")
    return rounded(rounded(out, "ss_between", "ss_within"), "f", digits=4)


@query("e13_spider", f"""
WITH s AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)
SELECT vec_id, label, x, y, {rnd('avg(x) OVER (PARTITION BY label)')} AS cx, {rnd('avg(y) OVER (PARTITION BY label)')} AS cy
FROM s""")
def e13(spark, sf):
    from fenloom.operators.ordination import spider

    scores = table(spark, sf, "embeddings").select(
        "vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("x"),
        F.get("embedding", F.lit(1)).cast("double").alias("y"))
    return rounded(spider(scores, "x", "y", ["label"]), "cx", "cy")


# ---- factor models -------------------------------------------------------------------------


def _factor_sql(est: str, scatter: str) -> str:
    return f"""WITH g AS (SELECT o_orderpriority AS level, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v
  FROM orders GROUP BY 1),
s AS (SELECT sum((n - 1) * {scatter}) / (sum(n) - count(*)) AS s2 FROM g),
b AS (SELECT {est} AS base, n AS bn FROM g WHERE level = '3-MEDIUM')
SELECT CASE WHEN level = '3-MEDIUM' THEN 'Intercept' ELSE level END AS parameter,
  {rnd(f"CASE WHEN level = '3-MEDIUM' THEN {est} ELSE {est} - base END", 4)} AS estimate,
  {rnd("sqrt(CASE WHEN level = '3-MEDIUM' THEN s2 / n ELSE s2 / n + s2 / bn END)", 4)} AS se, {rnd('sqrt(s2)', 4)} AS sigma
FROM g, s, b"""


@query("h1_factor_model", _factor_sql("m", "v"))
def h1(spark, sf):
    out = M.fit_factor(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority", "3-MEDIUM")
    return rounded(out, "estimate", "se", "sigma", digits=4)


@query("h2_gamma_factor_model", _factor_sql("ln(m)", "v / (m * m)"))
def h2(spark, sf):
    out = M.fit_factor(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority", "3-MEDIUM", "gamma")
    return rounded(out, "estimate", "se", "sigma", digits=4)


def _line_totals(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("price"))


@query("h3_gamma_covariates")
def h3(spark, sf):
    return rounded(M.fit_glm(_line_totals(spark, sf), "price ~ lines + qty", "gamma", "log"), "estimate", "se")


@query("h4_poisson_factor_time")
def h4(spark, sf):
    per = table(spark, sf, "events").groupBy(
        "event_type", F.weekofyear("ts").alias("week"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    coded, formula = M.interaction_columns(per, "n", "event_type", "week")
    return rounded(M.fit_glm(coded, formula, "poisson", "log"), "estimate", "se")


def weekly(spark, sf):
    per = table(spark, sf, "events").groupBy("event_type", F.weekofyear("ts").alias("week"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return X.PoissonIntercepts(per, "n", ("event_type", "week"), "user_id")


@query("h4_poisson_plant_intercepts")
def h4_fixed(spark, sf):
    m = weekly(spark, sf)
    return rounded(m.coefficients, "estimate", "se").withColumn("intercept_sd", F.lit(round(m.variance ** 0.5, 4)))


@query("h4_plant_effects")
def h4_random(spark, sf):
    return rounded(weekly(spark, sf).intercepts, "estimate", "sd")


@query("h5_variance_components", f"""
WITH m AS (SELECT event_type, avg(value) AS fm FROM events GROUP BY 1),
g AS (SELECT user_id, count(*)::DOUBLE AS n, avg(value - fm) AS m, coalesce(var_samp(value - fm), 0) AS v
  FROM events JOIN m USING (event_type) GROUP BY 1),
s AS (SELECT count(*) AS g, sum(n) AS nn, sum(n * n) AS n2, sum(n * m * m) AS a, sum(n * m) AS b, sum((n - 1) * v) AS ssw FROM g),
q AS (SELECT g, ssw / (nn - g) AS msw, (a - b * b / nn) / (g - 1) AS msb, (nn - n2 / nn) / (g - 1) AS n0 FROM s)
SELECT g AS groups, {rnd('msw')} AS var_within, {rnd('greatest((msb - msw) / n0, 0)')} AS var_between FROM q""")
def h5(spark, sf):
    return rounded(M.variance_components(table(spark, sf, "events"), "value", "event_type", "user_id"),
                   "var_within", "var_between")


DRAWS = 100
W = "(-ln((('0x' || substr(md5(concat_ws('|', '7', draw, event_id)), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE))"
DRAW_SQL = f"""dr AS (SELECT draw, event_type AS level, sum({W} * value) / sum({W}) AS mean
  FROM events, (SELECT unnest(range(1, {DRAWS + 1})) AS draw) GROUP BY 1, 2),
par AS (SELECT draw, CASE WHEN level = 'view' THEN 'Intercept' ELSE level END AS parameter,
  ln(mean) - CASE WHEN level = 'view' THEN 0 ELSE ln(base) END AS value
  FROM dr JOIN (SELECT draw, mean AS base FROM dr WHERE level = 'view') USING (draw))"""
LEVELS = ["click", "error", "purchase", "signup", "view"]


def event_draws(spark, sf):
    return M.draws(table(spark, sf, "events"), "value", "event_type", "view", LEVELS, "event_id", DRAWS, 7, "gamma")


@query("h6_bootstrap_draws", with_(DRAW_SQL, body=f"""
SELECT draw::INTEGER AS draw, parameter, {rnd('value')} AS value FROM par"""))
def h6(spark, sf):
    return rounded(event_draws(spark, sf), "value")


Q = {"ll": 0.025, "l": 0.25, "m": 0.5, "h": 0.75, "hh": 0.975}


@query("h7_h8_intervals_flagged", with_(DRAW_SQL, "iv AS (SELECT parameter, " + ", ".join(
    f"quantile_cont(value, {p}) AS {n}" for n, p in Q.items()) + " FROM par GROUP BY 1)", body="SELECT parameter, " + ", ".join(
    f"{rnd(n)} AS {n}" for n in Q) + """, CASE WHEN (ll > 0 AND hh > 0) OR (ll < 0 AND hh < 0) THEN 'nonzero' ELSE 'zero' END
  AS nonzero FROM iv"""))
def h7(spark, sf):
    return rounded(M.flag_nonzero(M.intervals(event_draws(spark, sf))), *Q)


@query("h9_credible_interval", with_(DRAW_SQL, body=f"""
SELECT parameter, {rnd('quantile_cont(value, 0.05)')} AS lower, {rnd('quantile_cont(value, 0.95)')} AS upper
FROM par GROUP BY 1"""))
def h9(spark, sf):
    return rounded(M.posterior_interval(event_draws(spark, sf), 0.9), "lower", "upper")


@query("h10_direction", with_(DRAW_SQL, body=f"""
SELECT parameter, {rnd('avg(CAST(value < 0 AS DOUBLE))')} AS pd FROM par GROUP BY 1"""))
def h10(spark, sf):
    return rounded(summary.prob_direction(event_draws(spark, sf), ["parameter"], positive=False), "pd")


@query("h11_marginal_levels", with_(DRAW_SQL, body=f"""
SELECT level, {rnd('quantile_cont(mean, 0.5)')} AS predicted, {rnd('quantile_cont(mean, 0.025)')} AS conf_low,
  {rnd('quantile_cont(mean, 0.975)')} AS conf_high FROM dr GROUP BY 1"""))
def h11(spark, sf):
    out = M.marginal_levels(table(spark, sf, "events"), "value", "event_type", "event_id", DRAWS, 7)
    return rounded(out, "predicted", "conf_low", "conf_high")


@query("h11_marginal_grid", f"""
WITH r AS (SELECT draw, {W} AS w, user_id::DOUBLE AS x, ln(value + 1) AS y
  FROM events, (SELECT unnest(range(1, {DRAWS + 1})) AS draw)),
s AS (SELECT draw, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy FROM r GROUP BY 1),
l AS (SELECT draw, sw, sx, sy, (sxy - sx * sy / sw) / (sxx - sx * sx / sw) AS slope FROM s),
p AS (SELECT x, exp((sy - slope * sx) / sw + slope * x) AS p FROM l, (SELECT unnest([0.0, 25.0, 50.0, 100.0])::DOUBLE AS x))
SELECT x, {rnd('quantile_cont(p, 0.5)')} AS predicted, {rnd('quantile_cont(p, 0.025)')} AS conf_low,
  {rnd('quantile_cont(p, 0.975)')} AS conf_high FROM p GROUP BY 1""")
def h11g(spark, sf):
    ev = table(spark, sf, "events").withColumn("y", F.col("value") + 1)
    lines = M.line_draws(ev, "y", "user_id", "event_id", DRAWS, 7, log_link=True)
    return rounded(M.marginal_grid(lines, [0, 25, 50, 100], log_link=True), "predicted", "conf_low", "conf_high")


def _u(tag):
    return (f"((('0x' || substr(md5(concat_ws('|', '7{tag}', draw, event_id)), 1, 8))::BIGINT + 0.5)"
            " / 4294967296.0::DOUBLE)")


@query("h12_predictive_check", f"""
WITH dr AS (SELECT draw, event_type, sum({W} * value) / sum({W}) AS mean
  FROM events, (SELECT unnest(range(1, 21)) AS draw) GROUP BY 1, 2),
s AS (SELECT sqrt(sum((n - 1) * v) / (sum(n) - count(*))) AS sigma
  FROM (SELECT count(*) AS n, coalesce(var_samp(value), 0) AS v FROM events GROUP BY event_type)),
rep AS (SELECT draw, mean + sigma * sqrt(-2 * ln({_u('u')})) * cos(2 * pi() * {_u('v')}) AS y
  FROM events JOIN dr USING (event_type), s),
al AS (SELECT 0 AS draw, value AS y FROM events UNION ALL SELECT draw, y FROM rep)
SELECT draw::INTEGER AS draw, {rnd('avg(y)')} AS mean, {rnd('stddev_samp(y)')} AS sd, {rnd('min(y)')} AS min,
  {rnd('max(y)')} AS max FROM al GROUP BY 1""")
def h12(spark, sf):
    out = M.pp_check(table(spark, sf, "events"), "value", "event_type", "event_id", 20, 7)
    return rounded(out, "mean", "sd", "min", "max")


@query("h13_anova_two_way", f"""
WITH b AS (SELECT l_returnflag AS a, CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0 END AS w, l_quantity AS y FROM lineitem),
m AS (SELECT *, w - avg(w) OVER (PARTITION BY a) AS bt, avg(y) OVER () AS gm, avg(y) OVER (PARTITION BY a) AS am,
  avg(y) OVER (PARTITION BY a, w) AS cm FROM b),
s AS (SELECT count(*) AS n, count(DISTINCT a) AS la, count(DISTINCT concat(a, w)) AS lc, sum(power(am - gm, 2)) AS ss1,
  power(sum(bt * y), 2) / sum(bt * bt) AS ss2, sum(power(cm - am, 2)) AS ssc, sum(power(y - cm, 2)) AS res FROM m)
SELECT 'l_returnflag' AS term, (la - 1)::BIGINT AS df, {rnd('ss1', 4)} AS ss, {rnd('(ss1 / (la - 1)) / (res / (n - lc))', 4)} AS f FROM s
UNION ALL SELECT 'l_linestatus', 1, {rnd('ss2', 4)}, {rnd('ss2 / (res / (n - lc))', 4)} FROM s
UNION ALL SELECT 'l_returnflag:l_linestatus', lc - la - 1, {rnd('ssc - ss2', 4)}, {rnd('((ssc - ss2) / (lc - la - 1)) / (res / (n - lc))', 4)} FROM s
UNION ALL SELECT 'Residual', n - lc, {rnd('res', 4)}, NULL FROM s""")
def h13(spark, sf):
    out = M.anova(table(spark, sf, "lineitem"), "l_quantity", ["l_returnflag", "l_linestatus"])
    return rounded(out.drop("p"), "ss", "f", digits=4)


@query("h14_pairwise_means", with_(SHEET, "lab0 AS (SELECT sample_id, treatment AS lab FROM sheet)", perms("lab0", nperm=199),
    """g AS (SELECT perm, lab, count(*) AS n, avg(length) AS m, coalesce(var_samp(length), 0) AS v FROM labs
  JOIN (SELECT l_suppkey AS sample_id, sum(l_quantity) AS length FROM lineitem GROUP BY 1) USING (sample_id) GROUP BY 1, 2)""",
    """s AS (SELECT perm, sum((n - 1) * v) / (sum(n) - count(*)) AS s2 FROM g GROUP BY 1)""",
    """q AS (SELECT x.perm, x.lab AS level_a, y.lab AS level_b, y.m - x.m AS diff,
  abs(y.m - x.m) / sqrt(s2 / 2 * (1 / x.n + 1 / y.n)) AS q FROM g x JOIN g y ON x.perm = y.perm AND x.lab < y.lab
  JOIN s ON s.perm = x.perm)""",
    """mx AS (SELECT perm, max(q) AS qm FROM q WHERE perm > 0 GROUP BY 1)""", body=f"""
SELECT level_a, level_b, {rnd('diff')} AS diff, {rnd('q')} AS q,
  {rnd('(1 + (SELECT count(*) FROM mx WHERE qm >= q.q * (1 - 1e-9))) / (1.0::DOUBLE + 199)')} AS p FROM q WHERE perm = 0"""))
def h14(spark, sf):
    y = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("sample_id")).agg(F.sum("l_quantity").alias("y"))
    out = M.pairwise_means(y.join(sheet(spark, sf), "sample_id"), "y", "treatment", "sample_id", 199)
    return rounded(out, "diff", "q", "p")


@query("h20_growth_columns")
def h20(spark, sf):
    """Running totals of events as growth curves of users, and the rate by the user's first event type."""
    e = table(spark, sf, "events").select("user_id", "event_type", "ts", F.to_date("ts").alias("day"))
    daily = e.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("user_id").orderBy("day")  # a row a day
    total = daily.select("user_id", F.unix_date("day").alias("t"), F.sum("n").over(along).alias("y"))
    start = e.groupBy("user_id").agg(F.min("day").alias("first"), F.min_by("event_type", F.struct("ts", "event_type")).alias("event_type"))
    since = total.join(start, "user_id").withColumn("t", F.col("t") - F.unix_date("first"))
    curves = G.logistic_growth(since, ["user_id", "event_type"], "t", "y")
    return rounded(M.fit_factor(curves.filter("converged"), "r", "event_type", "click"), "estimate", "se", "sigma", digits=4)


@query("h14_tukey_range")
def h14_range(spark, sf):
    return rounded(M.tukey_pairs(table(spark, sf, "events"), "value", "event_type"), "diff", "q", "p")
