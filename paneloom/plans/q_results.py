"""Queries of collected results, location facts, checks before a run, dry runs and extracts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from paneloom.functions.pixels import name_key
from paneloom.operators import report as R
from paneloom.sources.exports import resolved_headers
from paneloom.sources.staging import shared_dir, staged
from paneloom.sources.tables import BALANCED_SQL, ORDERS_SQL, PANEL_SQL, PIXELS_SQL, TREATED_SQL, balanced, orders_by_customer, panel, pixels, table, treated

from . import models as M
from .q_audits import r4
from .q_models import _closed
from .q_sources import _STYLES
from .registry import query

_OUTCOMES = ["total", "log_total", "constant"]
_LONG = "lg AS (UNPIVOT (SELECT unit, site_id, buff_km, year, CAST(y AS DOUBLE) AS total, CAST(1000 * ln(1 + y) AS DOUBLE) AS log_total, CAST(1 AS DOUBLE) AS constant FROM pb) ON total, log_total, constant INTO NAME outcome VALUE y)"


def _long(spark, sf_dir):
    """The balanced panel with a row for each outcome: one grouped job fits them all."""
    p = treated(balanced(spark, sf_dir)).withColumns({"total": F.col("y"), "log_total": 1000 * F.log1p("y"), "constant": F.lit(1.0)}).drop("y")
    share = F.when((F.col("treatment") == 1) & (F.col("year") > 1998), 1.0).when((F.col("treatment") == 1) & (F.col("year") == 1998), 0.5).otherwise(0.0)
    return p.withColumn("share", share).unpivot(["unit", "site_id", "year", "treatment", "post", "did_term", "share"], _OUTCOMES, "outcome", "y")


def _headline(spark, sf_dir):
    p = staged(_long(spark, sf_dir).where("outcome <> 'constant'"))
    fits = {name: M.static_twfe(p, treat=x, keys=("outcome",), key_types="outcome string") for name, x in (("static", "did_term"), ("share treated", "share"))}
    return R.collected(fits, "canonical")


def _fit_sql(x: str) -> str:
    return _closed("outcome", x=x, source="lg", more=", " + _LONG).replace("'did_term' AS term, ", "")


_SHARE = "CASE WHEN buff_km = 0 AND year > 1998 THEN 1.0 WHEN buff_km = 0 AND year = 1998 THEN 0.5 ELSE 0 END"
# p of t with an even number of degrees of freedom, by its finite series
_P = """CASE WHEN (n_clusters - 1) % 2 = 0 THEN round(1 - abs(estimate / se) / sqrt(n_clusters - 1 + power(estimate / se, 2)) * list_sum(list_transform(range(CAST((n_clusters - 1) / 2 AS BIGINT)), lambda j: power((n_clusters - 1) / (n_clusters - 1 + power(estimate / se, 2)), j) * coalesce(list_product(list_transform(range(1, j + 1), lambda i: (2 * i - 1) / (2.0 * i))), 1))), 4) END"""
_HEAD_SQL = f"""SELECT model, outcome, 'canonical' AS scenario, estimate, se, {_P} AS p_value, n_obs, n_units, n_clusters FROM (SELECT 'static' AS model, * FROM ({_fit_sql("CAST(buff_km = 0 AND year >= 1998 AS INT)")}) UNION ALL SELECT 'share treated', * FROM ({_fit_sql(_SHARE)})) WHERE outcome <> 'constant'"""


def _shown(rows):
    p = F.when((F.col("n_clusters") - 1) % 2 == 0, F.round("p_value", 4))
    return rows.select("model", "outcome", "scenario", r4(F.col("estimate")).alias("estimate"), r4(F.col("se")).alias("se"), p.alias("p_value"), "n_obs", "n_units", "n_clusters")


@query(_HEAD_SQL)
def s19_headline(spark, sf_dir):
    """Every result row of two models over two outcomes, p beside estimate and error (also G10: one grouped job a model)."""
    return _shown(_headline(spark, sf_dir))


@query(_HEAD_SQL)
def s18_package(spark, sf_dir):
    """The same rows written as the package, a folder for each outcome, and read back."""
    path = f"{shared_dir(spark)}/paneloom/package-{uuid.uuid4().hex}"
    R.write_package(_headline(spark, sf_dir), path)
    return _shown(spark.read.parquet(path))


@query(_closed("outcome", source="lg", more=", " + _LONG).replace("WITH ", "WITH f AS (WITH ", 1) + f""" ), u AS (WITH {BALANCED_SQL}, {_LONG}, w AS (SELECT *, y - avg(y) OVER (PARTITION BY outcome, unit) AS e FROM lg), g AS (SELECT outcome, site_id, year, avg(e) FILTER (buff_km = 0) - avg(e) FILTER (buff_km > 0) AS gap FROM w GROUP BY ALL),
s AS (SELECT outcome, site_id, avg(gap) FILTER (year >= 1998) - avg(gap) FILTER (year < 1998) AS did FROM g GROUP BY ALL) SELECT outcome, stddev_samp(did) / sqrt(count(did)) AS se FROM s GROUP BY 1), o AS (SELECT unnest(['total', 'log_total', 'constant', 'absent']) AS outcome)
SELECT outcome, estimate, CASE WHEN estimate IS NULL OR isnan(estimate) THEN 'failed' WHEN f.se IS NULL THEN 'no se' WHEN f.se <= 1e-9 THEN 'se of zero' WHEN u.se > 3 * f.se THEN 'se far below the design''s' ELSE 'ok' END AS status FROM o LEFT JOIN (SELECT * FROM f WHERE outcome <> 'constant') f USING (outcome) LEFT JOIN u USING (outcome)""")
def a33_statuses(spark, sf_dir):
    """The status of each outcome's result by row; an outcome without variation and one without rows have failed."""
    p = staged(_long(spark, sf_dir))
    fits = M.static_twfe(p, keys=("outcome",), key_types="outcome string")
    asked = spark.createDataFrame([(o,) for o in (*_OUTCOMES, "absent")], "outcome string")
    e = p.join(p.groupBy("outcome", "unit").agg(F.avg("y").alias("m")), ["outcome", "unit"]).withColumn("e", F.col("y") - F.col("m"))
    core, late = F.col("treatment") == 1, F.col("year") >= 1998
    g = e.groupBy("outcome", "site_id", "year").agg((F.avg(F.when(core, F.col("e"))) - F.avg(F.when(~core, F.col("e")))).alias("gap"))
    s = g.groupBy("outcome", "site_id").agg((F.avg(F.when(late, F.col("gap"))) - F.avg(F.when(~late, F.col("gap")))).alias("did"))
    design = s.groupBy("outcome").agg((F.stddev_samp("did") / F.sqrt(F.count("did"))).alias("se"))
    varies = p.groupBy("outcome").agg(F.stddev_pop("y").alias("sd")).where("sd > 0").select("outcome")
    found = R.statuses(asked.join(fits.join(varies, "outcome", "left_semi"), "outcome", "left"), design, ["outcome"])
    return found.select("outcome", r4(F.col("estimate")).alias("estimate"), "status")


# exports' rows: some disagree on a pixel's ring, some lie outside the polygon, every seventh pixel has a shifted copy
_ROWS_SQL = f"""{PIXELS_SQL}, rw AS (SELECT p.key * 2 + p.copy AS pixel_id, p.site_id, CAST((p.key + CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END) % 6 AS INT) AS buff_km, o_orderkey % 8 <> 0 AS inside, year(o_orderdate) AS year, o_totalprice AS y FROM orders JOIN pixels p ON p.key = o_custkey WHERE p.copy = 0 OR o_orderkey % 3 = 0)"""


def _rows(spark, sf_dir):
    p = pixels(spark, sf_dir).select("key", "copy", "site_id")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("y"))
    met = p.join(o, F.col("key") == F.col("o_custkey")).where("copy = 0 OR o_orderkey % 3 = 0")
    ring = ((F.col("key") + (F.col("o_orderkey") % 97 == 0).cast("int")) % 6).cast("int")
    return met.select((F.col("key") * 2 + F.col("copy")).alias("pixel_id"), "site_id", ring.alias("buff_km"), (F.col("o_orderkey") % 8 != 0).alias("inside"), "year", "y")


@query(f"""WITH {_ROWS_SQL}, n AS (SELECT pixel_id, count(*) AS n FROM rw WHERE inside GROUP BY 1), pt AS (SELECT key * 2 + copy AS pixel_id, lat, lon, n FROM pixels JOIN n ON n.pixel_id = key * 2 + copy),
pr AS (SELECT a.pixel_id AS a, b.pixel_id AS b, a.n AS na, b.n AS nb FROM pt a JOIN pt b ON a.pixel_id < b.pixel_id AND abs(a.lat - b.lat) < 2e-4 AND abs(a.lon - b.lon) < 2e-4
 WHERE abs(a.lon - b.lon) * 111320.0 * cos(radians((a.lat + b.lat) / 2)) < 10 AND abs(a.lat - b.lat) * 110574.0 < 10 AND (1 - abs(a.lon - b.lon) * 111320.0 * cos(radians((a.lat + b.lat) / 2)) / 10) * (1 - abs(a.lat - b.lat) * 110574.0 / 10) >= 0.65),
l AS (SELECT CASE WHEN na > nb OR (na = nb AND a < b) THEN b ELSE a END AS pixel_id, min(CASE WHEN na > nb OR (na = nb AND a < b) THEN a ELSE b END) AS kept_pixel FROM pr GROUP BY 1)
SELECT site_id, rw.pixel_id, count(*) AS n_rows, count(*) FILTER (inside) AS n_own, coalesce(min(buff_km) FILTER (inside) <> max(buff_km) FILTER (inside), false) AS ring_conflict, any_value(kept_pixel) AS kept_pixel FROM rw LEFT JOIN l ON l.pixel_id = rw.pixel_id GROUP BY 1, 2""")
def g7_location_facts(spark, sf_dir):
    points = pixels(spark, sf_dir).select((F.col("key") * 2 + F.col("copy")).alias("pixel_id"), "lat", "lon")
    return R.location_facts(_rows(spark, sf_dir), points)


@query(f"""WITH {_ROWS_SQL}, b AS (SELECT pixel_id, count(DISTINCT buff_km = 0) AS arms, count(DISTINCT site_id) AS sites FROM rw GROUP BY 1), m AS (SELECT count(*) - 1 AS n FROM rw GROUP BY pixel_id, year)
SELECT 'both arms' AS "check", count(*) FILTER (arms > 1) AS n FROM b UNION ALL SELECT 'several sites', count(*) FILTER (sites > 1) FROM b UNION ALL SELECT 'repeated periods', CAST(sum(n) AS BIGINT) FROM m""")
def g6_leaks(spark, sf_dir):
    """Leaks of a raw sample: its rows repeat pixel-years, and some pixels' rings change."""
    return R.leaks(_rows(spark, sf_dir), ["year"])


@query(f"""WITH {PANEL_SQL}, d AS (SELECT *, {TREATED_SQL}, pixel_id || '|' || season AS unit FROM panel), b AS (SELECT unit, count(*) AS n, count(DISTINCT post) AS sides FROM d GROUP BY 1),
c AS (SELECT 'one side only' AS "check", count(*) FILTER (sides < 2) AS n FROM b UNION ALL SELECT 'singletons', count(*) FILTER (n = 1) FROM b UNION ALL SELECT 'out of bounds', count(*) FILTER (NOT y BETWEEN 1000 AND 400000) FROM d UNION ALL SELECT 'no-data codes', count(*) FILTER (y IN (-9999, -999)) FROM d UNION ALL SELECT 'empty cells', 4 - count(DISTINCT (treatment, post)) FROM d)
SELECT "check", n, n = 0 AS ok FROM c""")
def g8_preflight(spark, sf_dir):
    p = treated(panel(spark, sf_dir)).withColumn("unit", F.concat_ws("|", "pixel_id", "season"))
    return R.preflight(p, "y", 1000, 400000)


@query(f"""WITH h AS (SELECT l_orderkey AS src_file, l_linenumber - 1 AS position, {_STYLES} AS header, l_linenumber AS k, max(l_shipdate) OVER (PARTITION BY l_orderkey) AS mtime, count(*) OVER (PARTITION BY l_orderkey) AS width FROM lineitem),
w AS (SELECT width, max_by(src_file, (mtime, src_file)) AS src_file FROM h GROUP BY 1)
SELECT h.width, h.src_file, CAST(position AS INT) AS position, header, CASE k WHEN 1 THEN 'NDVI' WHEN 2 THEN 'NDVI' WHEN 3 THEN 'Rain' WHEN 5 THEN 'longitude' WHEN 6 THEN 'Tmax' END AS canonical, CASE k WHEN 1 THEN 'alias' WHEN 2 THEN 'ending' WHEN 3 THEN 'ending' WHEN 4 THEN 'statistic' WHEN 5 THEN 'typo' WHEN 6 THEN 'alias' ELSE 'unresolved' END AS rule FROM h JOIN w USING (src_file)""")
def s15_dry_run(spark, sf_dir):
    """Which headers of the newest file of each column width would be renamed."""
    h = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src_file"), (F.col("l_linenumber") - 1).cast("int").alias("position"), F.expr(_STYLES).alias("header"), F.col("l_shipdate").alias("mtime"))
    return R.dry_run(h, resolved_headers(h.select("header").distinct()))


@query("SELECT CAST(n_nationkey + 1 AS BIGINT) AS site_id, n_name AS site, r_name AS district, CAST(n_nationkey % 4 + 1 AS INT) AS phase, CAST(1998 + (n_nationkey + 1) % 3 AS INT) AS cohort, count(c_custkey) AS plots FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def s21_crosswalk(spark, sf_dir):
    """District to site, by normalised names, with phase, cohort and plots."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    walk = n.join(r.select("r_regionkey", F.col("r_name").alias("district"), name_key("r_name").alias("district_key")), F.col("n_regionkey") == F.col("r_regionkey"))
    named = walk.select((F.col("n_nationkey") + 1).cast("long").alias("site_id"), F.col("n_name").alias("site"), "district", "district_key")
    districts = r.select(name_key(F.initcap("r_name")).alias("district_key"))
    plots = table(spark, sf_dir, "customer").groupBy((F.col("c_nationkey") + 1).cast("long").alias("site_id")).agg(F.count("*").alias("plots"))
    out = named.join(F.broadcast(districts), "district_key", "left_semi").join(plots, "site_id", "left")
    return out.select("site_id", "site", "district", ((F.col("site_id") - 1) % 4 + 1).cast("int").alias("phase"), (1998 + F.col("site_id") % 3).cast("int").alias("cohort"), F.coalesce("plots", F.lit(0)).alias("plots"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20")
def s5_raw_peek(spark, sf_dir):
    """The first 20 rows as they are."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice")).orderBy("o_orderkey").limit(20)


@query("SELECT 'o_orderkey' AS item, count(o_orderkey) AS n, count(*) - count(o_orderkey) AS n_null, count(DISTINCT o_orderkey) AS n_distinct, CAST(min(o_orderkey) AS VARCHAR) AS low, CAST(max(o_orderkey) AS VARCHAR) AS high FROM orders UNION ALL SELECT 'o_orderpriority', count(o_orderpriority), count(*) - count(o_orderpriority), count(DISTINCT o_orderpriority), min(o_orderpriority), max(o_orderpriority) FROM orders UNION ALL SELECT 'o_custkey', count(o_custkey), count(*) - count(o_custkey), count(DISTINCT o_custkey), CAST(min(o_custkey) AS VARCHAR), CAST(max(o_custkey) AS VARCHAR) FROM orders")
def s22_preview(spark, sf_dir):
    return R.summary(table(spark, sf_dir, "orders"), ["o_orderkey", "o_orderpriority", "o_custkey"])


@query(f"WITH {ORDERS_SQL}, v AS (SELECT pixel_id, year, season, avg(price) AS price, CAST(CASE WHEN count(*) > 1 THEN count(*) END AS DOUBLE) AS repeats FROM orders_c GROUP BY ALL), u AS (UNPIVOT v ON price, repeats INTO NAME variable VALUE v) SELECT variable, count(*) AS n, count(DISTINCT pixel_id) AS pixels, round(avg(v) FILTER (year < 1998) + 1e-7, 4) AS baseline FROM u GROUP BY 1")
def s23_extracts(spark, sf_dir):
    """An extract for each variable of the rows that have it, written and read back: rows, pixels and the mean before the start."""
    o = orders_by_customer(spark, sf_dir).groupBy("pixel_id", "year", "season").agg(F.avg("price").alias("price"), F.count("*").alias("n"))
    o = o.withColumn("repeats", F.when(F.col("n") > 1, F.col("n").cast("double"))).unpivot(["pixel_id", "year", "season"], ["price", "repeats"], "variable", "v").where("v IS NOT NULL")
    path = f"{shared_dir(spark)}/paneloom/extracts-{uuid.uuid4().hex}"
    o.write.partitionBy("variable").parquet(path)
    return spark.read.parquet(path).groupBy("variable").agg(F.count("*").alias("n"), F.count_distinct("pixel_id").alias("pixels"), r4(F.avg(F.when(F.col("year") < 1998, F.col("v")))).alias("baseline"))


@query(f"""WITH {BALANCED_SQL}, st AS (SELECT *, CASE WHEN buff_km = 0 THEN CAST(1998 + site_id % 3 AS INT) END AS cohort FROM pb), gs AS (SELECT DISTINCT cohort AS g FROM st WHERE cohort IS NOT NULL),
d AS (SELECT g, g - 1 - a.year AS l, coalesce(a.cohort = g, false) AS tr, a.y - b.y AS d FROM gs JOIN st a ON a.year IN (g - 2, g - 3) JOIN st b ON b.unit = a.unit AND b.year = g - 1 WHERE a.cohort IS NULL OR a.cohort >= g),
c AS (SELECT g, l, avg(d) FILTER (tr) - avg(d) FILTER (NOT tr) AS e, count(*) FILTER (tr) AS n FROM d GROUP BY ALL) SELECT CAST(l AS INT) AS placebo, round(sum(e * n) / sum(n) + 1e-7, 4) AS estimate, CAST(sum(n) AS BIGINT) AS switchers FROM c GROUP BY 1""")
def m13_placebos(spark, sf_dir):
    """Two placebos of the switchers' effects, against units that have not switched by the start."""
    st = balanced(spark, sf_dir).withColumn("cohort", F.when(F.col("buff_km") == 0, 1998 + F.col("site_id") % 3).cast("int"))
    return R.placebo_gaps(st.select("unit", "year", "y", "cohort")).select("placebo", r4(F.col("estimate")).alias("estimate"), "switchers")
