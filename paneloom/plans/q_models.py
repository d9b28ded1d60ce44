"""Queries of the estimators over the panels of tables.py."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from paneloom.operators import spatial as S
from paneloom.operators.ranges import quantiles
from paneloom.sources.staging import staged
from paneloom.sources.tables import BALANCED_SQL, PANEL_SQL, PIXELS_SQL, TREATED_SQL, balanced, panel, pixels, treated

from . import models as M
from . import resample as R
from .fe import twfe
from .q_audits import r4, season_net
from .q_joins import FUND_SQL, fund
from .registry import query
from .stats import chi2_p, t_p
from .two_stage import two_stage


def _pb(spark, sf_dir):
    """The balanced panel with design columns, in groups named by ``segment`` where a query asks for them."""
    return treated(balanced(spark, sf_dir))


def _short(rows, *keys):
    return rows.select(*keys, "term", r4(F.col("estimate")).alias("estimate"), r4(F.col("se")).alias("se"), "n_obs", "n_units", "n_clusters")


def _closed(keys: str = "", x: str = "CAST(buff_km = 0 AND year >= 1998 AS INT)", where: str = "true", term: str = "did_term", cluster: str = "site_id", source: str = "pb", more: str = "") -> str:
    """SQL of a balanced two-way regression on one term, with CR1 errors."""
    k, kc, on = (f"{keys}, ", f"PARTITION BY {keys}, ", f"USING ({keys})") if keys else ("", "PARTITION BY ", "ON true")
    every = f"OVER (PARTITION BY {keys})" if keys else "OVER ()"
    return f"""WITH {BALANCED_SQL}{more}, d AS (SELECT *, {x} AS x FROM {source} WHERE {where}),
z AS (SELECT *, y - avg(y) OVER ({kc}unit) - avg(y) OVER ({kc}year) + avg(y) {every} AS yy, x - avg(x) OVER ({kc}unit) - avg(x) OVER ({kc}year) + avg(x) {every} AS xx FROM d),
b AS (SELECT {k}sum(xx * yy) / sum(xx * xx) AS beta, sum(xx * xx) AS m, count(*) AS n, count(DISTINCT unit) AS units, count(DISTINCT year) AS t, count(DISTINCT {cluster}) AS g FROM z {"GROUP BY " + keys if keys else ""}),
s AS (SELECT {k}{cluster} AS c, sum(xx * (yy - beta * xx)) AS s FROM z JOIN b {on} GROUP BY ALL),
v AS (SELECT {k}sum(s * s) AS meat FROM s {"GROUP BY " + keys if keys else ""})
SELECT {k}'{term}' AS term, round(beta + 1e-7, 4) AS estimate, round(sqrt(meat / (m * m) * g / (g - 1) * (n - 1) / (n - 1 - t)) + 1e-7, 4) AS se, n AS n_obs, units AS n_units, g AS n_clusters FROM b JOIN v {on}"""


def _closed_two(terms: tuple[str, str], x1: str, x2: str, part: str = "0") -> str:
    """SQL of a balanced regression on two terms with unit and period effects, periods by ``part`` of the units."""
    net = lambda c: f"{c} - avg({c}) OVER (PARTITION BY unit) - avg({c}) OVER (PARTITION BY part, year) + avg({c}) OVER (PARTITION BY part)"
    row = lambda i, t, v: f"SELECT '{t}' AS term, round(b{i} + 1e-7, 4) AS estimate, round(sqrt({v} / (det * det) * g / (g - 1) * (n - 1) / (n - 3 - t)) + 1e-7, 4) AS se, n AS n_obs, units AS n_units, g AS n_clusters FROM b CROSS JOIN v"
    return f"""WITH {BALANCED_SQL}, d AS (SELECT *, {part} AS part, {x1} AS x1, {x2} AS x2 FROM pb), z AS (SELECT unit, site_id, year, part, {net("y")} AS y, {net("x1")} AS x1, {net("x2")} AS x2 FROM d),
m AS (SELECT sum(x1 * x1) AS a, sum(x1 * x2) AS c, sum(x2 * x2) AS d, sum(x1 * y) AS y1, sum(x2 * y) AS y2, count(*) AS n, count(DISTINCT unit) AS units, count(DISTINCT (part, year)) - count(DISTINCT part) AS t, count(DISTINCT site_id) AS g FROM z),
b AS (SELECT *, a * d - c * c AS det, (d * y1 - c * y2) / det AS b1, (a * y2 - c * y1) / det AS b2 FROM m), s AS (SELECT site_id, sum(x1 * (y - b1 * x1 - b2 * x2)) AS u, sum(x2 * (y - b1 * x1 - b2 * x2)) AS w FROM z CROSS JOIN b GROUP BY 1),
v AS (SELECT sum(u * u) AS uu, sum(u * w) AS uw, sum(w * w) AS ww FROM s) {row(1, terms[0], "(d * d * uu - 2 * c * d * uw + c * c * ww)")} UNION ALL {row(2, terms[1], "(c * c * uu - 2 * a * c * uw + a * a * ww)")}"""


@query(_closed())
def m01_static_twfe(spark, sf_dir):
    return _short(M.static_twfe(_pb(spark, sf_dir)))


@query()
def m01_unbalanced(spark, sf_dir):
    p = treated(panel(spark, sf_dir)).withColumns({"unit": F.concat_ws("|", "pixel_id", "season"), "period": F.col("year") * 10 + F.col("season")})
    return _short(M.static_twfe(p, period="period"))


@query(_closed("segment"))
def b2_by_group(spark, sf_dir):
    """The regression of every segment in one grouped job."""
    return _short(M.static_twfe(_pb(spark, sf_dir), keys=("segment",), key_types="segment string"), "segment")


@query(f"""WITH {BALANCED_SQL}, d AS (SELECT *, CAST(buff_km = 0 AND year >= 1998 AS INT) AS x FROM pb), z AS (SELECT *, x - avg(x) OVER (PARTITION BY unit) - avg(x) OVER (PARTITION BY segment, year) + avg(x) OVER (PARTITION BY segment) AS xx FROM d)
SELECT segment, round(sum(xx * xx) / (SELECT sum(xx * xx) FROM z), 6) AS weight FROM z GROUP BY 1""")
def b2_group_weights(spark, sf_dir):
    z = _pb(spark, sf_dir)
    net = F.col("did_term") - F.avg("did_term").over(Window.partitionBy("unit")) - F.avg("did_term").over(Window.partitionBy("segment", "year")) + F.avg("did_term").over(Window.partitionBy("segment"))
    g = z.withColumn("xx", net).groupBy("segment").agg(F.sum(F.col("xx") * F.col("xx")).alias("s"))
    return g.join(F.broadcast(g.agg(F.sum("s").alias("t")))).select("segment", F.round(F.col("s") / F.col("t"), 6).alias("weight"))


_COVS = ", cov AS (UNPIVOT (SELECT unit, site_id, buff_km, year, CAST((site_id * 7 + year * 3 + buff_km) % 11 AS DOUBLE) AS c1, CAST((site_id * 5 + year * year + buff_km * 2) % 13 AS DOUBLE) AS c2 FROM pb) ON c1, c2 INTO NAME covariate VALUE y)"


@query(_closed("covariate", source="cov", more=_COVS))
def b3_bad_controls(spark, sf_dir):
    p = _pb(spark, sf_dir)
    c1 = ((F.col("site_id") * 7 + F.col("year") * 3 + F.col("buff_km")) % 11).cast("double")
    c2 = ((F.col("site_id") * 5 + F.col("year") * F.col("year") + F.col("buff_km") * 2) % 13).cast("double")
    long = p.withColumns({"c1": c1, "c2": c2}).unpivot(["unit", "site_id", "year", "did_term"], ["c1", "c2"], "covariate", "y")
    return _short(M.static_twfe(long, keys=("covariate",), key_types="covariate string"), "covariate")


@query(f"""WITH {BALANCED_SQL}, w AS (SELECT *, y - avg(y) OVER (PARTITION BY unit) AS e FROM pb), g AS (SELECT site_id, year, avg(e) FILTER (buff_km = 0) - avg(e) FILTER (buff_km > 0) AS gap FROM w GROUP BY ALL), s AS (SELECT site_id, avg(gap) FILTER (year >= 1998) - avg(gap) FILTER (year < 1998) AS did FROM g GROUP BY 1)
SELECT round(avg(did) + 1e-7, 4) AS estimate, round(stddev_samp(did) / sqrt(count(did)) + 1e-7, 4) AS se, count(did) - 1 AS df FROM s""")
def b4_design_se(spark, sf_dir):
    e = _pb(spark, sf_dir).withColumn("e", F.col("y") - F.avg("y").over(Window.partitionBy("unit")))
    core = F.col("treatment") == 1
    g = e.groupBy("site_id", "year").agg((F.avg(F.when(core, F.col("e"))) - F.avg(F.when(~core, F.col("e")))).alias("gap"))
    late = F.col("year") >= 1998
    s = g.groupBy("site_id").agg((F.avg(F.when(late, F.col("gap"))) - F.avg(F.when(~late, F.col("gap")))).alias("did"))
    return s.agg(r4(F.avg("did")).alias("estimate"), r4(F.stddev_samp("did") / F.sqrt(F.count("did"))).alias("se"), (F.count("did") - 1).alias("df"))


_EVENT_SQL = f"""WITH {BALANCED_SQL}, m AS (SELECT year, avg(y) FILTER (buff_km = 0) - avg(y) FILTER (buff_km > 0) AS gap FROM pb GROUP BY 1)"""


@query(_EVENT_SQL + " SELECT CAST(year - 1998 AS INT) AS event_time, round(gap - (SELECT gap FROM m WHERE year = 1997) + 1e-7, 4) AS estimate FROM m WHERE year <> 1997")
def m02_event_study(spark, sf_dir):
    """On a balanced panel with one start the coefficients are gaps less the gap of the reference year."""
    fit, times = M.event_study(_pb(spark, sf_dir), [-3, -2, 0, 1, 2])
    return spark.createDataFrame([(t, float(b)) for t, b in zip(times, fit.beta, strict=True)], "event_time int, estimate double").withColumn("estimate", r4(F.col("estimate")))


@query(_EVENT_SQL + " SELECT round(avg(gap) FILTER (year >= 1998) - (SELECT gap FROM m WHERE year = 1997) + 1e-7, 4) AS estimate FROM m")
def b5_event_headline(spark, sf_dir):
    fit, times = M.event_study(_pb(spark, sf_dir), [-3, -2, 0, 1, 2])
    return spark.createDataFrame([(M.headline(fit, times)[0],)], "estimate double").select(r4(F.col("estimate")).alias("estimate"))


@query()
def m02_event_errors(spark, sf_dir):
    fit, times = M.event_study(_pb(spark, sf_dir), [-3, -2, 0, 1, 2])
    est, se, p = M.headline(fit, times)
    rows = [(f"k={t}", float(b), float(s), t_p(float(b / s), fit.df)) for t, b, s in zip(times, fit.beta, fit.se, strict=True)] + [("mean post", est, se, p)]
    return spark.createDataFrame(rows, "term string, estimate double, se double, p_value double")


@query()
def m16_pretrend(spark, sf_dir):
    fit, times = M.event_study(_pb(spark, sf_dir), [-3, -2, 0, 1, 2])
    f, rank, p = M.wald(fit, [i for i, t in enumerate(times) if t < 0])
    return spark.createDataFrame([(f, rank, p)], "f double, rank int, p_value double")


@query()
def m34_sensitivity(spark, sf_dir):
    """Bounds of the mean post effect when trends may change by Mbar times the largest change before treatment."""
    fit, times = M.event_study(_pb(spark, sf_dir), [-3, -2, 0, 1, 2])
    est, se, _ = M.headline(fit, times)
    pre = [fit.beta[times.index(t)] for t in (-3, -2)] + [0.0]
    worst = max(abs(b - a) for a, b in zip(pre, pre[1:], strict=False))
    half = lambda m: 1.959963984540054 * se + m * worst * (sum(t >= 0 for t in times) + 1) / 2
    breakdown = float((abs(est) - 1.959963984540054 * se) / max(worst * (sum(t >= 0 for t in times) + 1) / 2, 1e-300))  # the bounds reach zero there
    rows = [(m / 4, float(est - half(m / 4)), float(est + half(m / 4)), max(breakdown, 0.0)) for m in range(9)]
    return spark.createDataFrame(rows, "mbar double, low double, high double, breakdown double")


@query(_EVENT_SQL.replace("m AS (SELECT year,", "m AS (SELECT site_id % 3 AS k, year,").replace("GROUP BY 1)", "GROUP BY ALL)") + ", t AS (SELECT regr_slope(gap, year) AS slope FROM (SELECT year, avg(gap) AS gap FROM m WHERE year < 1998 GROUP BY 1)) SELECT round(slope + 1e-7, 4) AS slope FROM t")
def d4_pretrend_slope(spark, sf_dir):
    core = F.col("treatment") == 1
    p = _pb(spark, sf_dir).where("year < 1998").groupBy((F.col("site_id") % 3).alias("k"), "year").agg((F.avg(F.when(core, F.col("y"))) - F.avg(F.when(~core, F.col("y")))).alias("gap"))
    return p.groupBy("year").agg(F.avg("gap").alias("gap")).agg(r4(F.regr_slope("gap", "year")).alias("slope"))


def _staggered(spark, sf_dir):
    """Units with their start year: treated where the ring is 0, never treated elsewhere."""
    return balanced(spark, sf_dir).withColumn("cohort", F.when(F.col("buff_km") == 0, 1998 + F.col("site_id") % 3).cast("int"))


_STAG = f"""WITH {BALANCED_SQL}, st AS (SELECT *, CASE WHEN buff_km = 0 THEN CAST(1998 + site_id % 3 AS INT) END AS cohort FROM pb)"""
_CS = _STAG + """, gs AS (SELECT DISTINCT cohort AS g FROM st WHERE cohort IS NOT NULL), r AS (SELECT g, unit, year, y, CAST(cohort IS NOT NULL AS INT) AS arm FROM st JOIN gs ON cohort = g OR cohort IS NULL),
d AS (SELECT a.g, a.year, a.arm, a.y - b.y AS d FROM r a JOIN r b ON a.g = b.g AND a.unit = b.unit AND a.arm = b.arm AND b.year = a.g - 1),
c AS (SELECT g, year, avg(d) FILTER (arm = 1) - avg(d) FILTER (arm = 0) AS att, sqrt(coalesce(var_samp(d) FILTER (arm = 1), 0) / count(*) FILTER (arm = 1) + coalesce(var_samp(d) FILTER (arm = 0), 0) / count(*) FILTER (arm = 0)) AS se, count(*) FILTER (arm = 1) AS n1, count(*) FILTER (arm = 0) AS n0 FROM d GROUP BY ALL)"""


@query(_CS + " SELECT CAST(g AS INT) AS cohort, year, round(att + 1e-7, 4) AS att, round(se + 1e-7, 4) AS se, n1 AS n_treated, n0 AS n_control FROM c")
def m05_group_time(spark, sf_dir):
    g = M.group_time_effects(_staggered(spark, sf_dir), 2000)
    return g.select("cohort", "year", r4(F.col("att")).alias("att"), r4(F.col("se")).alias("se"), "n_treated", "n_control")


@query(_CS + " SELECT 'simple' AS kind, 0 AS at, round(sum(att * n1) / sum(n1) + 1e-7, 4) AS estimate FROM c WHERE year >= g UNION ALL SELECT 'dynamic', CAST(year - g AS INT), round(sum(att * n1) / sum(n1) + 1e-7, 4) FROM c WHERE year >= g GROUP BY ALL UNION ALL SELECT 'group', CAST(g AS INT), round(avg(att) + 1e-7, 4) FROM c WHERE year >= g GROUP BY ALL")
def m30_aggregates(spark, sf_dir):
    g = M.group_time_effects(_staggered(spark, sf_dir), 2000).where("year >= cohort")
    mean = lambda d: d.agg(r4(F.sum(F.col("att") * F.col("n_treated")) / F.sum("n_treated")).alias("estimate"))
    simple = mean(g.groupBy(F.lit("simple").alias("kind"), F.lit(0).alias("at")))
    dynamic = mean(g.groupBy(F.lit("dynamic").alias("kind"), (F.col("year") - F.col("cohort")).cast("int").alias("at")))
    group = g.groupBy(F.lit("group").alias("kind"), F.col("cohort").cast("int").alias("at")).agg(r4(F.avg("att")).alias("estimate"))
    return simple.union(dynamic).union(group)


@query(f"""WITH {BALANCED_SQL}, d AS (SELECT site_id, unit, year, y - lag(y) OVER w AS dy, CAST(buff_km = 0 AND year >= 1998 AS INT) - lag(CAST(buff_km = 0 AND year >= 1998 AS INT)) OVER w AS dx FROM pb WINDOW w AS (PARTITION BY unit ORDER BY year)),
z AS (SELECT *, dy - avg(dy) OVER (PARTITION BY year) AS yy, dx - avg(dx) OVER (PARTITION BY year) AS xx FROM d WHERE dy IS NOT NULL) SELECT round(sum(xx * yy) / sum(xx * xx) + 1e-7, 4) AS estimate, count(*) AS n FROM z""")
def m12_chained(spark, sf_dir):
    w = Window.partitionBy("unit").orderBy("year")
    d = _pb(spark, sf_dir).select("year", (F.col("y") - F.lag("y").over(w)).alias("dy"), (F.col("did_term") - F.lag("did_term").over(w)).alias("dx")).where("dy IS NOT NULL")
    means = d.groupBy("year").agg(F.avg("dy").alias("my"), F.avg("dx").alias("mx"))
    z = d.join(F.broadcast(means), "year").select((F.col("dy") - F.col("my")).alias("yy"), (F.col("dx") - F.col("mx")).alias("xx"))
    return z.agg(r4(F.sum(F.col("xx") * F.col("yy")) / F.sum(F.col("xx") * F.col("xx"))).alias("estimate"), F.count("*").alias("n"))


@query(_STAG + """, gs AS (SELECT DISTINCT cohort AS g FROM st WHERE cohort IS NOT NULL), b AS (SELECT g, unit, cohort, year, y FROM st CROSS JOIN gs), d AS (SELECT a.g, a.year - a.g + 1 AS l, a.cohort IS NOT NULL AND a.cohort = a.g AS tr, a.y - b.y AS d FROM b a JOIN b b ON a.g = b.g AND a.unit = b.unit AND b.year = a.g - 1
WHERE a.year >= a.g AND (a.cohort IS NULL OR a.cohort = a.g OR a.cohort > a.year)), c AS (SELECT g, l, avg(d) FILTER (tr) - avg(d) FILTER (NOT tr) AS e, count(*) FILTER (tr) AS n FROM d GROUP BY ALL) SELECT CAST(l AS INT) AS effect, round(sum(e * n) / sum(n) + 1e-7, 4) AS estimate, CAST(sum(n) AS BIGINT) AS switchers FROM c GROUP BY 1""")
def m13_switchers(spark, sf_dir):
    st = _staggered(spark, sf_dir).select("unit", "year", "y", "cohort")
    gs = st.agg(F.collect_set("cohort").alias("all"))
    rows = st.join(F.broadcast(gs)).select("unit", "year", "y", "cohort", F.explode("all").alias("g"))
    base = rows.where("year = g - 1").select("unit", "g", F.col("y").alias("y0"))
    mine = F.coalesce(F.col("cohort") == F.col("g"), F.lit(False))
    d = rows.where("year >= g").where(mine | F.col("cohort").isNull() | (F.col("cohort") > F.col("year"))).join(base, ["unit", "g"])
    d = d.select("g", (F.col("year") - F.col("g") + 1).cast("int").alias("effect"), mine.alias("tr"), (F.col("y") - F.col("y0")).alias("d"))
    c = d.groupBy("g", "effect").agg((F.avg(F.when(F.col("tr"), F.col("d"))) - F.avg(F.when(~F.col("tr"), F.col("d")))).alias("e"), F.count_if("tr").alias("n"))
    return c.groupBy("effect").agg(r4(F.sum(F.col("e") * F.col("n")) / F.sum("n")).alias("estimate"), F.sum("n").alias("switchers"))


@query(_closed("fake", x="CAST(buff_km = 0 AND year >= fake AS INT)", source="fk", more=", fk AS (SELECT * FROM pb CROSS JOIN (SELECT unnest([1996, 1997]) AS fake) WHERE year < 1998)"))
def m15_placebo_years(spark, sf_dir):
    p = balanced(spark, sf_dir).where("year < 1998").withColumn("fake", F.explode(F.array(F.lit(1996), F.lit(1997))))
    p = p.withColumn("did_term", ((F.col("buff_km") == 0) & (F.col("year") >= F.col("fake"))).cast("int"))
    return _short(M.static_twfe(p, keys=("fake",), key_types="fake int"), "fake")


@query(f"""WITH {BALANCED_SQL}, m AS (SELECT site_id, year, avg(y) FILTER (buff_km = 0) - avg(y) FILTER (buff_km > 0) AS gap FROM pb GROUP BY ALL), s AS (SELECT site_id, avg(gap) FILTER (year >= 1998) - avg(gap) FILTER (year < 1998) AS b, sqrt(var_samp(gap) FILTER (year < 1998) / 3 + var_samp(gap) FILTER (year >= 1998) / 3) AS se FROM m GROUP BY 1),
w AS (SELECT count(*) AS k, sum(1 / (se * se)) AS sw, sum(1 / power(se, 4)) AS sw2, sum(b / (se * se)) AS swb, sum(b * b / (se * se)) AS swb2 FROM s WHERE se > 0)
SELECT k, round(swb2 - swb * swb / sw, 6) AS q, round(greatest(0, (swb2 - swb * swb / sw - (k - 1)) / (swb2 - swb * swb / sw)) * 100, 6) AS i2, round(greatest(0, (swb2 - swb * swb / sw - (k - 1)) / (sw - sw2 / sw)), 0) AS tau2, round(swb / sw, 4) AS pooled FROM w""")
def m20_heterogeneity(spark, sf_dir):
    core, late = F.col("treatment") == 1, F.col("year") >= 1998
    m = _pb(spark, sf_dir).groupBy("site_id", "year").agg((F.avg(F.when(core, F.col("y"))) - F.avg(F.when(~core, F.col("y")))).alias("gap"))
    s = m.groupBy("site_id").agg((F.avg(F.when(late, F.col("gap"))) - F.avg(F.when(~late, F.col("gap")))).alias("estimate"), F.sqrt(F.var_samp(F.when(~late, F.col("gap"))) / 3 + F.var_samp(F.when(late, F.col("gap"))) / 3).alias("se"))
    h = M.heterogeneity(s)
    return h.select("k", F.round("q", 6).alias("q"), F.round("i2", 6).alias("i2"), F.round("tau2", 0).alias("tau2"), F.round("pooled", 4).alias("pooled"))


@query()
def m20_q_test(spark, sf_dir):
    r = m20_heterogeneity(spark, sf_dir).first()
    return spark.createDataFrame([(r["q"], r["k"] - 1, chi2_p(r["q"], r["k"] - 1))], "q double, df long, p_value double")


@query(_closed_two(("ddd", "did_term"), "CAST(buff_km = 0 AND year >= 1998 AND segment = 'BUILDING' AS INT)", "CAST(buff_km = 0 AND year >= 1998 AS INT)", "CAST(segment = 'BUILDING' AS INT)"))
def m10_triple_difference(spark, sf_dir):
    """The difference of one segment's effect from the others', with periods by segment group."""
    g3 = (F.col("segment") == "BUILDING").cast("int")
    p = _pb(spark, sf_dir).withColumn("g3", g3).withColumns({"ddd": F.col("did_term") * F.col("g3"), "period": F.concat_ws("|", "year", "g3")})
    return _short(M.results(spark, twfe(p, "y", ["ddd", "did_term"], "unit", "period", "site_id")))


@query(f"""WITH {BALANCED_SQL}, m AS (SELECT buff_km, avg(y) FILTER (year >= 1998) - avg(y) FILTER (year < 1998) AS change FROM pb GROUP BY 1) SELECT 'ring_' || buff_km AS term, round(change - (SELECT change FROM m WHERE buff_km = 5) + 1e-7, 4) AS estimate FROM m WHERE buff_km < 5""")
def m24_spillover_rings(spark, sf_dir):
    p = _pb(spark, sf_dir)
    cols = [f"ring_{i}" for i in range(5)]
    p = p.withColumns({c: ((F.col("buff_km") == i) & (F.col("post") == 1)).cast("int") for i, c in enumerate(cols)})
    return M.results(spark, twfe(p, "y", cols, "unit", "year", "site_id")).select("term", r4(F.col("estimate")).alias("estimate"))


@query(_closed_two(("did_term", "inter"), "CAST(buff_km = 0 AND year >= 1998 AS INT)", "CAST(buff_km = 0 AND year >= 1998 AS INT) * (site_id % 7 - (SELECT avg(site_id % 7) FROM pb))"))
def m26_interaction(spark, sf_dir):
    """Treatment by a centred covariate: the effect at its mean and the slope of the effect."""
    p = _pb(spark, sf_dir).withColumn("cov", (F.col("site_id") % 7).cast("double"))
    mean = p.agg(F.avg("cov").alias("mean_cov"))
    p = p.join(F.broadcast(mean)).withColumn("inter", F.col("did_term") * (F.col("cov") - F.col("mean_cov")))
    return _short(M.results(spark, twfe(p, "y", ["did_term", "inter"], "unit", "year", "site_id")))


@query(_closed(x="CASE WHEN buff_km = 0 AND year >= 1998 THEN coalesce(amount, 0) / 1e6 ELSE 0 END", source="dosed", term="dose", more=", " + FUND_SQL + ", dosed AS (SELECT pb.*, amount FROM pb LEFT JOIN (SELECT site_id, month // 12 AS year, max(amount_reported) AS amount FROM fund GROUP BY ALL) f ON f.site_id = pb.site_id AND f.year = pb.year)"))
def m06_dose_response(spark, sf_dir):
    """Outcome on the site's cumulative amount where treated, in millions."""
    a = fund(spark, sf_dir).groupBy("site_id", F.floor(F.col("month") / 12).cast("int").alias("year")).agg(F.max("amount_reported").alias("amount"))
    p = _pb(spark, sf_dir).join(a, ["site_id", "year"], "left").withColumn("dose", F.when(F.col("did_term") == 1, F.coalesce("amount", F.lit(0.0)) / 1e6).otherwise(0.0))
    return _short(M.results(spark, twfe(p, "y", ["dose"], "unit", "year", "site_id")))


@query(f"""WITH {BALANCED_SQL}, d AS (SELECT *, CAST(buff_km = 0 AND year >= 1998 AS INT) AS x, CAST(buff_km = 0 AND year >= 1998 AS INT) * (1 + site_id % 3) AS i FROM pb),
z AS (SELECT *, y - avg(y) OVER (PARTITION BY unit) - avg(y) OVER (PARTITION BY year) + avg(y) OVER () AS yy, x - avg(x) OVER (PARTITION BY unit) - avg(x) OVER (PARTITION BY year) + avg(x) OVER () AS xx, i - avg(i) OVER (PARTITION BY unit) - avg(i) OVER (PARTITION BY year) + avg(i) OVER () AS zz FROM d),
b AS (SELECT sum(zz * yy) / sum(zz * xx) AS beta, sum(zz * xx) / sum(zz * zz) AS slope, sum(zz * xx) AS zx, sum(zz * zz) AS q, count(*) AS n, count(DISTINCT year) AS t, count(DISTINCT site_id) AS g FROM z),
s AS (SELECT site_id, sum(zz * (yy - beta * xx)) AS u, sum(zz * (xx - slope * zz)) AS f FROM z CROSS JOIN b GROUP BY 1), v AS (SELECT sum(u * u) AS u, sum(f * f) AS f FROM s)
SELECT round(beta + 1e-7, 4) AS estimate, round(sqrt(u / (zx * zx) * g / (g - 1) * (n - 1) / (n - 1 - t)) + 1e-7, 4) AS se, round(slope * slope / (f / (q * q) * g / (g - 1) * (n - 1) / (n - 1 - t)), 4) AS first_stage_f, n AS n_obs FROM b CROSS JOIN v""")
def m08_instrument(spark, sf_dir):
    """Two-stage slope: the reduced form's over the first stage's. Its scores are the instrument times what the slope leaves of
    the outcome, so the error is that of a regression of the rest on the instrument, over the first stage's slope."""
    p = _pb(spark, sf_dir).withColumn("z", F.col("did_term") * (1 + F.col("site_id") % 3))
    reduced, first = twfe(p, "y", ["z"], "unit", "year", "site_id")[()], twfe(p, "did_term", ["z"], "unit", "year", "site_id")[()]
    beta, f = float(reduced.beta[0] / first.beta[0]), float((first.beta[0] / first.se[0]) ** 2)
    rest = twfe(p.withColumn("rest", F.col("y") - beta * F.col("did_term")), "rest", ["z"], "unit", "year", "site_id")[()]
    row = spark.createDataFrame([(beta, float(rest.se[0] / abs(first.beta[0])), f, reduced.n_obs)], "estimate double, se double, first_stage_f double, n_obs long")
    return row.select(r4(F.col("estimate")).alias("estimate"), r4(F.col("se")).alias("se"), F.round("first_stage_f", 4).alias("first_stage_f"), "n_obs")


def _stages_sql(cells: str, centre: str) -> str:
    """SQL of a two-stage estimate on the staggered panel, whose units of one cohort share their untreated years: the normal
    equations of cohorts and years, for the outcome (key -99) and for every cell, are solved by alternation."""
    return _STAG.replace("WITH", "WITH RECURSIVE", 1) + f""", d AS (SELECT unit, site_id, year, y, coalesce(cohort, 9999) AS c, year < coalesce(cohort, 9999) AS free, CASE WHEN {cells} THEN year - cohort END AS k FROM st),
f AS (SELECT *, count(*) OVER (PARTITION BY c) AS years FROM (SELECT c, year, avg(y) AS m, count(*) AS units FROM d WHERE free GROUP BY ALL)),
rc AS (SELECT -99 AS key, c, sum(m) AS r FROM f GROUP BY 2 UNION ALL SELECT key, c, count(*) FILTER (k = key) FROM (SELECT DISTINCT c, year, k FROM d) CROSS JOIN (SELECT DISTINCT k AS key FROM d WHERE k IS NOT NULL) GROUP BY ALL),
qt AS (SELECT -99 AS key, year, sum(m * units) AS q FROM f GROUP BY 2 UNION ALL SELECT key, year, count(*) FILTER (k = key) FROM d CROSS JOIN (SELECT DISTINCT k AS key FROM d WHERE k IS NOT NULL) GROUP BY ALL),
b AS (SELECT 0 AS it, key, year, CAST(0 AS DOUBLE) AS b FROM qt UNION ALL
  SELECT it + 1, key, year, (any_value(q) - sum(units * (r - sb) / years)) / sum(units) FROM (SELECT b.it, b.key, b.year, q, r, units, years, sum(b.b) OVER (PARTITION BY b.key, f.c) AS sb FROM b JOIN f USING (year) JOIN rc USING (key, c) JOIN qt USING (key, year) WHERE it < 80) GROUP BY it, key, year),
v AS (SELECT key, c, year, (r - sum(b) OVER (PARTITION BY key, c)) / years + b AS v FROM b JOIN f USING (year) JOIN rc USING (key, c) WHERE it = 80),
l AS (SELECT year, b AS shift FROM b WHERE it = 80 AND key = -99),
e AS (SELECT *, y - shift - avg(y - shift) FILTER (free) OVER (PARTITION BY unit) AS e FROM d JOIN l USING (year)),
g AS (SELECT *, e - avg(e) OVER (PARTITION BY {centre}) AS w, count(*) OVER (PARTITION BY k) AS n FROM e WHERE k IS NOT NULL),
sc AS (SELECT key, site_id, sum(s) AS s FROM (SELECT k AS key, site_id, w / n AS s FROM g UNION ALL SELECT key, site_id, -v * e / n FROM e JOIN v USING (c, year) JOIN (SELECT DISTINCT k AS key, n FROM g) USING (key)) GROUP BY ALL),
o AS (SELECT k AS key, avg(e) AS est, count(*) AS n FROM g GROUP BY 1), se AS (SELECT key, sqrt(sum(s * s)) AS se FROM sc GROUP BY 1)"""


def _cohorts(st) -> tuple[dict, list]:
    """Units of each cohort and the years, from the panel."""
    sizes = {r["cohort"]: r["n"] for r in st.where("cohort IS NOT NULL").groupBy("cohort").agg(F.count_distinct("unit").alias("n")).collect()}
    return sizes, sorted(r["year"] for r in st.select("year").distinct().collect())


def _sun_abraham(spark, sf_dir):
    """(event time, estimate, se, p): cohort by relative period effects, averaged by the cohorts' shares."""
    st = _staggered(spark, sf_dir)
    sizes, years = _cohorts(st)
    name = {(g, t - g): f"c{i}" for i, (g, t) in enumerate((g, t) for g in sorted(sizes) for t in years if t - g != -1)}
    st = st.withColumns({n: F.coalesce((F.col("cohort") == g) & (F.col("year") == g + k), F.lit(False)).cast("int") for (g, k), n in name.items()})
    fit = twfe(st, "y", list(name.values()), "unit", "year", "site_id")[()]
    rows = []
    for k in sorted({k for _, k in name}):
        mine = [(g, fit.terms.index(name[g, k])) for g in sizes if (g, k) in name and name[g, k] in fit.terms]
        if mine:
            w = np.zeros(len(fit.terms))
            for g, i in mine:
                w[i] = sizes[g] / sum(sizes[h] for h, _ in mine)
            rows.append((k, *map(float, fit.linear(w))))
    return rows


@query()
def m09_sun_abraham(spark, sf_dir):
    return spark.createDataFrame(_sun_abraham(spark, sf_dir), "event_time int, estimate double, se double, p_value double")


@query(_CS + " SELECT CAST(year - g AS INT) AS event_time, round(sum(att * n1) / sum(n1) + 1e-7, 4) AS estimate FROM c WHERE year - g <> -1 GROUP BY 1")
def m09_estimates(spark, sf_dir):
    """With every relative period of every cohort in the model, they are differences from the never treated."""
    rows = [(k, b) for k, b, _, _ in _sun_abraham(spark, sf_dir)]
    return spark.createDataFrame(rows, "event_time int, estimate double").withColumn("estimate", r4(F.col("estimate")))


def _extended(spark, sf_dir):
    """(term, estimate, se, p): cohort by year cells after treatment and their mean by the cells' rows."""
    st = _staggered(spark, sf_dir)
    sizes, years = _cohorts(st)
    cells = [(g, t) for g in sorted(sizes) for t in years if t >= g]
    st = st.withColumns({f"e{g}_{t}": F.coalesce((F.col("cohort") == g) & (F.col("year") == t), F.lit(False)).cast("int") for g, t in cells})
    fit = twfe(st, "y", [f"e{g}_{t}" for g, t in cells], "unit", "year", "site_id")[()]
    w = np.array([sizes[int(t[1:].split("_")[0])] for t in fit.terms], float)
    return [("simple", *fit.linear(w / w.sum()))] + [(t, float(b), float(s), t_p(float(b / s), fit.df)) for t, b, s in zip(fit.terms, fit.beta, fit.se, strict=True)]


@query()
def m32_extended_twfe(spark, sf_dir):
    return spark.createDataFrame(_extended(spark, sf_dir), "term string, estimate double, se double, p_value double")


@query(_stages_sql("year >= cohort", "k, c, year") + " SELECT 'e' || c || '_' || year AS term, round(avg(e) + 1e-7, 4) AS estimate FROM e WHERE k IS NOT NULL GROUP BY c, year UNION ALL SELECT 'simple', round(avg(e) + 1e-7, 4) FROM e WHERE k IS NOT NULL")
def m32_estimates(spark, sf_dir):
    """With every treated cell in the model, effects are the gaps to what untreated rows predict."""
    return spark.createDataFrame([(t, b) for t, b, _, _ in _extended(spark, sf_dir)], "term string, estimate double").withColumn("estimate", r4(F.col("estimate")))


@query()
def m29_exposure(spark, sf_dir):
    """Effects by years of exposure and their mean."""
    st = _staggered(spark, sf_dir)
    cols = [f"x{k}" for k in range(3)]
    st = st.withColumns({c: F.coalesce(F.col("year") - F.col("cohort") == k, F.lit(False)).cast("int") for k, c in enumerate(cols)})
    return M.results(spark, twfe(st, "y", cols, "unit", "year", "site_id"))


@query(_STAG + """, gs AS (SELECT DISTINCT cohort AS g FROM st WHERE cohort IS NOT NULL), r AS (SELECT g, unit, site_id, year, y, CAST(cohort IS NOT NULL AND cohort = g AND year >= g AS INT) AS x FROM st JOIN gs ON cohort = g OR cohort IS NULL OR cohort > g + 3 WHERE year BETWEEN g - 3 AND g + 3),
z AS (SELECT *, y - avg(y) OVER (PARTITION BY g, unit) - avg(y) OVER (PARTITION BY g, year) + avg(y) OVER (PARTITION BY g) AS yy, x - avg(x) OVER (PARTITION BY g, unit) - avg(x) OVER (PARTITION BY g, year) + avg(x) OVER (PARTITION BY g) AS xx FROM r),
b AS (SELECT sum(xx * yy) / sum(xx * xx) AS beta, sum(xx * xx) AS m, count(*) AS n, count(DISTINCT (g, unit)) AS units, count(DISTINCT site_id) AS c, count(DISTINCT (g, year)) - count(DISTINCT g) AS t FROM z), s AS (SELECT site_id, sum(xx * (yy - beta * xx)) AS s FROM z CROSS JOIN b GROUP BY 1)
SELECT 'd' AS term, round(any_value(beta) + 1e-7, 4) AS estimate, round(sqrt(sum(s * s) / any_value(m * m) * any_value(c / (c - 1.0)) * any_value((n - 1.0) / (n - 2 - t))) + 1e-7, 4) AS se, any_value(n) AS n_obs, any_value(units) AS n_units, any_value(c) AS n_clusters FROM s CROSS JOIN b""")
def m31_stacked(spark, sf_dir):
    s = M.stacked(_staggered(spark, sf_dir))
    return _short(M.results(spark, twfe(s, "y", ["d"], "stack_unit", "stack_year", "site_id")))


@query(_STAG + """, c AS (SELECT cohort, year, avg(y) AS m, count(*) AS n FROM st GROUP BY ALL), k AS (SELECT cohort, max(n) AS n FROM c GROUP BY 1), p AS (SELECT a.cohort AS k, b.cohort AS u, a.n AS nk, b.n AS nu, CASE WHEN a.cohort > b.cohort THEN b.cohort ELSE 1995 END AS lo, CASE WHEN b.cohort IS NULL OR a.cohort > b.cohort THEN 2000 ELSE b.cohort - 1 END AS hi FROM k a JOIN k b ON a.cohort IS NOT NULL AND a.cohort IS DISTINCT FROM b.cohort),
g AS (SELECT p.k, p.u, p.nk, p.nu, x.year >= p.k AS post, x.m - z.m AS gap FROM p JOIN c x ON x.cohort = p.k AND x.year BETWEEN lo AND hi JOIN c z ON z.cohort IS NOT DISTINCT FROM p.u AND z.year = x.year),
e AS (SELECT k, u, nk, nu, avg(gap) FILTER (post) - avg(gap) FILTER (NOT post) AS est FROM g GROUP BY ALL),
w AS (SELECT *, (2001 - k) / 6.0 AS dk, (2001 - u) / 6.0 AS du FROM e WHERE est IS NOT NULL), v AS (SELECT *, CASE WHEN u IS NULL THEN nk * nu * dk * (1 - dk) WHEN k < u THEN nk * nu * (dk - du) * (1 - dk) ELSE nk * nu * dk * (du - dk) END AS w FROM w)
SELECT k AS treated, u AS control, CASE WHEN u IS NULL THEN 'never' WHEN k < u THEN 'later' ELSE 'earlier' END AS kind, round(est + 1e-7, 4) AS estimate, round(w / sum(w) OVER (), 6) AS weight FROM v""")
def m22_bacon(spark, sf_dir):
    b = M.bacon(_staggered(spark, sf_dir))
    return b.select("treated", "control", "kind", r4(F.col("estimate")).alias("estimate"), F.round("weight", 6).alias("weight"))


@query(_closed(x="share", source="an", more=", an AS (SELECT unit, site_id, year, y, CASE WHEN buff_km = 0 AND year > 1998 THEN 1.0 WHEN buff_km = 0 AND year = 1998 THEN 0.5 ELSE 0 END AS share FROM pb)", term="share"))
def m21_share_treated(spark, sf_dir):
    p = balanced(spark, sf_dir).withColumn("share", F.when((F.col("buff_km") == 0) & (F.col("year") > 1998), 1.0).when((F.col("buff_km") == 0) & (F.col("year") == 1998), 0.5).otherwise(0.0))
    return _short(M.static_twfe(p, treat="share"))


@query()
def m23_wild_bootstrap(spark, sf_dir):
    return M.wild_bootstrap(M.demeaned(_pb(spark, sf_dir), "y", "did_term", "unit", "year"), "site_id")


@query()
def m25_permutation(spark, sf_dir):
    return R.permutation(_pb(spark, sf_dir), "unit")


def _before_after(spark, sf_dir):
    p = treated(panel(spark, sf_dir))
    mean = lambda k: F.avg(F.when(F.col("post") == k, F.col("y")))
    return p.groupBy(F.col("pixel_id").alias("unit"), "treatment").agg(mean(0).alias("y0"), mean(1).alias("y1"))


_TAUS = ", ".join(f"({10 * i}, {i / 10})" for i in range(1, 10))


@query(f"""WITH {PANEL_SQL}, u AS (SELECT pixel_id, buff_km = 0 AS tr, avg(y) FILTER (year < 1998) AS y0, avg(y) FILTER (year >= 1998) AS y1 FROM panel GROUP BY ALL), w AS (SELECT * FROM u WHERE y0 IS NOT NULL AND y1 IS NOT NULL),
c AS (SELECT row_number() OVER (ORDER BY y1) AS place, y1 FROM w WHERE NOT tr), t AS (SELECT y0, y1, row_number() OVER (ORDER BY y0) AS i, row_number() OVER (ORDER BY y1) AS j, count(*) OVER () AS n, (SELECT count(*) FROM w x WHERE NOT x.tr AND x.y0 <= w.y0) AS r FROM w WHERE tr),
m AS (SELECT t.*, c.y1 AS m FROM t JOIN c ON c.place = greatest(1, r))
SELECT 'att' AS term, round(avg(y1) - avg(m) + 1e-7, 4) AS estimate FROM m UNION ALL SELECT 'q' || q, round(max(y1) FILTER (j = ceil(tau * n - 1e-9)) - max(m) FILTER (i = ceil(tau * n - 1e-9)) + 1e-7, 4) FROM m CROSS JOIN (VALUES {_TAUS}) v(q, tau) GROUP BY q""")
def m04_changes_in_changes(spark, sf_dir):
    return R.changes_in_changes(_before_after(spark, sf_dir)).select("term", r4(F.col("estimate")).alias("estimate"))


@query()
def m04_errors(spark, sf_dir):
    """The same with errors from 200 draws."""
    return R.bootstrapped(R.changes_in_changes_drawn(_before_after(spark, sf_dir), 200))


@query(f"""WITH {BALANCED_SQL}, w AS (SELECT buff_km = 0 AS tr, year, y - avg(y) FILTER (year < 1998) OVER (PARTITION BY unit) AS e FROM pb), q AS (SELECT t.tau, tr, year >= 1998 AS post, {", ".join(f"quantile_cont(e, {t}) AS q{round(100 * t)}" for t in (0.1, 0.25, 0.5, 0.75, 0.9))} FROM w CROSS JOIN (SELECT 0 AS tau) t GROUP BY ALL)
SELECT {", ".join(f"round(sum(CASE WHEN tr = post THEN q{q} ELSE -q{q} END) + 1e-7, 4) AS q{q}" for q in (10, 25, 50, 75, 90))} FROM q""")
def m35_quantile_did(spark, sf_dir):
    e = F.col("y") - F.avg(F.when(F.col("year") < 1998, F.col("y"))).over(Window.partitionBy("unit"))
    w = _pb(spark, sf_dir).withColumn("e", e)
    taus = {"q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9}
    q = quantiles(w, ["treatment", "post"], "e", taus)
    sign = F.when(F.col("treatment") == F.col("post"), 1).otherwise(-1)
    return q.agg(*(r4(F.sum(sign * F.col(k))).alias(k) for k in taus))


@query(_STAG + """, d AS (SELECT *, year >= coalesce(cohort, 9999) AS tr FROM st) SELECT count(*) FILTER (tr) AS treated_rows, count(*) FILTER (NOT tr) AS untreated_rows FROM d""")
def m27_sample(spark, sf_dir):
    tr = F.col("year") >= F.coalesce("cohort", F.lit(9999))
    return _staggered(spark, sf_dir).agg(F.count_if(tr).alias("treated_rows"), F.count_if(~tr).alias("untreated_rows"))


def _stage_rows(spark, fit, head=()):
    """A row for each cell and, with ``head`` (its weights by cell), one for their weighted sum."""
    rows = [(int(k), float(b), float(s), t_p(float(b / s), fit.df), fit.rows[k]) for k, b, s in zip(fit.terms, fit.beta, fit.se, strict=True)]
    if len(head):
        rows.append((None, *fit.linear(head), sum(n for (k, n), w in zip(fit.rows.items(), head, strict=True) if w)))
    return spark.createDataFrame(rows, "event_time int, estimate double, se double, p_value double, n long")


def _untreated(spark, sf_dir):
    return _staggered(spark, sf_dir).withColumns({"free": F.col("year") < F.coalesce("cohort", F.lit(9999)), "event": F.col("year") - F.col("cohort")})


@query(_stages_sql("year >= cohort", "k, c, year") + """ SELECT CAST(key AS INT) AS horizon, round(est + 1e-7, 4) AS estimate, round(se + 1e-7, 4) AS se, n FROM o JOIN se USING (key)
UNION ALL SELECT NULL, round((SELECT sum(est * n) / sum(n) FROM o) + 1e-7, 4), round(sqrt(sum(s * s)) + 1e-7, 4), (SELECT CAST(sum(n) AS BIGINT) FROM o) FROM (SELECT site_id, sum(s * n) / (SELECT sum(n) FROM o) AS s FROM sc JOIN o USING (key) GROUP BY 1)""")
def m27_imputation(spark, sf_dir):
    """Unit and year effects of untreated rows impute what treated rows would have been; the gaps' means by horizon and over
    all treated rows, residuals net of the mean of cohort and year."""
    st = _untreated(spark, sf_dir).withColumn("horizon", F.when(~F.col("free"), F.col("event")))
    fit = two_stage(st, "y", "free", "horizon", "unit", "year", "site_id", centre=("cohort", "year"))
    n = np.array([fit.rows[k] for k in fit.terms], float)
    return _stage_rows(spark, fit, n / n.sum()).select(F.col("event_time").alias("horizon"), r4(F.col("estimate")).alias("estimate"), r4(F.col("se")).alias("se"), "n")


@query(_stages_sql("cohort IS NOT NULL AND year - cohort <> -1", "k") + """ SELECT CAST(key AS INT) AS event_time, round(est + 1e-7, 4) AS estimate, round(se + 1e-7, 4) AS se, n FROM o JOIN se USING (key)
UNION ALL SELECT NULL, round((SELECT avg(est) FROM o WHERE key >= 0) + 1e-7, 4), round(sqrt(sum(s * s)) + 1e-7, 4), (SELECT CAST(sum(n) AS BIGINT) FROM o WHERE key >= 0) FROM (SELECT site_id, sum(s) / (SELECT count(*) FROM o WHERE key >= 0) AS s FROM sc WHERE key >= 0 GROUP BY 1)""")
def m28_two_stage(spark, sf_dir):
    """Unit and year effects of untreated rows first; what they leave on event times second, reference -1 and the never
    treated. The headline is the mean of the effects from the start on."""
    st = _untreated(spark, sf_dir).withColumn("at", F.when(F.col("event") != -1, F.col("event")))
    fit = two_stage(st, "y", "free", "at", "unit", "year", "site_id")
    post = np.array([float(int(k) >= 0) for k in fit.terms])
    return _stage_rows(spark, fit, post / post.sum()).select("event_time", r4(F.col("estimate")).alias("estimate"), r4(F.col("se")).alias("se"), "n")


@query()
def m33_entropy_balance(spark, sf_dir):
    """Controls weighted to the treated means of two covariates before treatment, then the weighted regression."""
    p = _pb(spark, sf_dir)
    x = p.where("post = 0").groupBy("unit", "treatment").agg(F.avg("y").alias("level"), F.regr_slope("y", "year").alias("trend"))
    w, _ = M.entropy_weights(x, ["level", "trend"])
    w = staged(w.select("unit", "weight"))
    fits = twfe(p.join(w, "unit"), "y", ["did_term"], "unit", "year", "site_id", weight="weight")
    return M.results(spark, fits)


_I = f"""WITH {PIXELS_SQL}, v AS (SELECT key, value AS z0, lat, lon FROM pixels WHERE copy = 0), d AS (SELECT a.key, b.key AS other, b.z0 AS zo, row_number() OVER (PARTITION BY a.key ORDER BY round(sqrt(power((a.lon - b.lon) * 111320.0 * cos(radians(a.lat)), 2) + power((a.lat - b.lat) * 110574.0, 2)), 6), b.key) AS rn FROM v a JOIN v b ON a.key <> b.key AND abs(a.lat - b.lat) < 1e-3 AND abs(a.lon - b.lon) < 1e-3),
mu AS (SELECT avg(z0) AS m FROM v), l AS (SELECT key, avg(zo - m) AS lag FROM d CROSS JOIN mu WHERE rn <= 4 GROUP BY key)
SELECT round(avg((z0 - m) * lag) / (SELECT avg((z0 - m) * (z0 - m)) FROM v CROSS JOIN mu), 6) AS i, count(*) AS n FROM v JOIN l USING (key) CROSS JOIN mu"""


def _moran(spark, sf_dir):
    p = pixels(spark, sf_dir).where("copy = 0")
    near = S.nearest_exact(p.select("key", "lat", "lon"), p.select(F.col("key").alias("other"), "lat", "lon"), 5, 15.0, staged).where("key != other")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.round("metres", 6), "other"))
    links = staged(near.withColumn("place", place).where("place <= 4").select("key", "other"))
    return M.moran(p.select("key", F.col("value").alias("z")), links, 4)


@query(_I)
def m17_moran(spark, sf_dir):
    g = _moran(spark, sf_dir)[1]
    return spark.createDataFrame([(round(g["i"], 6), g["n"])], "i double, n long")


@query()
def m18_local_moran(spark, sf_dir):
    return _moran(spark, sf_dir)[0].groupBy("quadrant").agg(F.count("*").alias("n"), F.round(F.avg("i"), 6).alias("mean_i"))


@query(f"""WITH {BALANCED_SQL}, g AS (SELECT avg(y) AS m FROM pb), s AS (SELECT site_id, avg(y) AS ms, count(*) AS n FROM pb GROUP BY 1), u AS (SELECT site_id, unit, avg(y) AS mu, count(*) AS n FROM pb GROUP BY ALL)
SELECT round((SELECT sum(n * power(ms - m, 2)) FROM s CROSS JOIN g) / (SELECT sum(power(y - m, 2)) FROM pb CROSS JOIN g), 6) AS site_share, round((SELECT sum(u.n * power(mu - ms, 2)) FROM u JOIN s USING (site_id)) / (SELECT sum(power(y - m, 2)) FROM pb CROSS JOIN g), 6) AS unit_share""")
def m19_variance_shares(spark, sf_dir):
    """Sums of squares among sites, units within sites and rows within units."""
    p = balanced(spark, sf_dir)
    u = p.groupBy("site_id", "unit").agg(F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("ss"), F.count("*").alias("n"))
    s = u.groupBy("site_id").agg(F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum("n").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("among_units"))
    t = s.agg(F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum("n").alias("n"), F.sum("among_units").alias("units"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("sites"))
    total = F.col("ss") - F.col("s") * F.col("s") / F.col("n")
    return t.select(F.round((F.col("sites") - F.col("s") * F.col("s") / F.col("n")) / total, 6).alias("site_share"), F.round((F.col("units") - F.col("sites")) / total, 6).alias("unit_share"))


@query(f"""WITH {BALANCED_SQL}, m AS (SELECT segment, avg(y) FILTER (buff_km = 0 AND year >= 1998) - avg(y) FILTER (buff_km = 0 AND year < 1998) - avg(y) FILTER (buff_km > 0 AND year >= 1998) + avg(y) FILTER (buff_km > 0 AND year < 1998) AS b, count(*) AS n FROM pb GROUP BY 1) SELECT round(sum(b * n) / sum(n) + 1e-7, 4) AS pooled FROM m""")
def d7_combined(spark, sf_dir):
    f = M.static_twfe(_pb(spark, sf_dir), keys=("segment",), key_types="segment string")
    return f.agg(r4(F.sum(F.col("estimate") * F.col("n_obs")) / F.sum("n_obs")).alias("pooled"))


@query()
def d5_pooled_sites(spark, sf_dir):
    p = treated(panel(spark, sf_dir)).withColumns({"unit": F.concat_ws("|", "pixel_id", "season"), "period": F.concat_ws("|", "site_id", "year", "season")})
    return _short(M.static_twfe(p, period="period"))


@query(f"WITH {PANEL_SQL}, d AS (SELECT *, {TREATED_SQL} FROM panel), net AS (SELECT *, y - avg(CASE WHEN buff_km > 0 THEN y END) OVER (PARTITION BY site_id, season, year) AS net FROM d) SELECT season, round(avg(net) FILTER (treatment = 1 AND post = 1) - avg(net) FILTER (treatment = 1 AND post = 0) + 1e-7, 4) AS effect FROM net GROUP BY 1")
def b6_season_effects(spark, sf_dir):
    n = treated(season_net(panel(spark, sf_dir)))
    core, late = F.col("treatment") == 1, F.col("post") == 1
    return n.groupBy("season").agg(r4(F.avg(F.when(core & late, F.col("net"))) - F.avg(F.when(core & ~late, F.col("net")))).alias("effect"))
