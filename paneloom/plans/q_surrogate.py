"""Queries of surrogate outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneloom.sources.tables import BALANCED_SQL, PANEL_SQL, TREATED_SQL, balanced, panel, table, treated

from . import models as M
from . import surrogate as S
from .q_models import _closed, _short
from .registry import query

_D2 = f"""WITH {PANEL_SQL}, d AS (SELECT *, {TREATED_SQL} FROM panel),
dry AS (SELECT pixel_id, year, any_value(site_id) AS site, avg(y) AS y, max(treatment) AS tr, max(post) AS po FROM d WHERE season IN (2, 3) GROUP BY 1, 2),
m AS (SELECT dry.*, w.a, w.b FROM dry JOIN (SELECT pixel_id, year, avg(y) AS a, avg(n_obs) AS b FROM d WHERE season = 1 GROUP BY 1, 2) w USING (pixel_id, year)),
r AS (SELECT f, m.* FROM m JOIN (SELECT DISTINCT site AS f FROM m UNION ALL SELECT -1) ON f = -1 OR site <> f),
mu AS (SELECT f, count(*) AS n, avg(a) AS ma, stddev_pop(a) + 1e-12 AS sa, avg(b) AS mb, stddev_pop(b) + 1e-12 AS sb FROM r WHERE tr = 0 GROUP BY 1 HAVING count(*) >= 10),
z AS (SELECT f, year, tr, po, y, n, (a - ma) / sa AS u, (b - mb) / sb AS v FROM r JOIN mu USING (f)),
t AS (SELECT f, year, count(*) + 1e-8 * n AS c, sum(u) AS u, sum(v) AS v, sum(y) AS y FROM z WHERE tr = 0 GROUP BY f, year, n),
g AS (SELECT f, sum(u * u) + 1e-3 * any_value(n) AS uu, sum(u * v) AS uv, sum(v * v) + 1e-3 * any_value(n) AS vv, sum(u * y) AS uy, sum(v * y) AS vy FROM z WHERE tr = 0 GROUP BY 1),
h AS (SELECT f, uu - (SELECT sum(u * u / c) FROM t WHERE t.f = g.f) AS uu, uv - (SELECT sum(u * v / c) FROM t WHERE t.f = g.f) AS uv, vv - (SELECT sum(v * v / c) FROM t WHERE t.f = g.f) AS vv, uy - (SELECT sum(u * y / c) FROM t WHERE t.f = g.f) AS uy, vy - (SELECT sum(v * y / c) FROM t WHERE t.f = g.f) AS vy FROM g),
k AS (SELECT f, (vv * uy - uv * vy) / (uu * vv - uv * uv) AS b1, (uu * vy - uv * uy) / (uu * vv - uv * uv) AS b2 FROM h),
e AS (SELECT f, po, y - b1 * z.u - b2 * z.v - coalesce((t.y - b1 * t.u - b2 * t.v) / t.c, 0) AS e FROM (SELECT f, year, po, tr, u, v, y FROM z WHERE tr = 1) z JOIN k USING (f) LEFT JOIN (SELECT f, year, c, u, v, y AS y FROM t) t USING (f, year)),
o AS (SELECT f, avg(e) FILTER (po = 1) - avg(e) FILTER (po = 0) AS att, sqrt(avg(e * e) FILTER (po = 0)) AS pre FROM e GROUP BY 1)
SELECT round((SELECT att FROM o WHERE f = -1) + 1e-7, 2) AS estimate, round(sqrt((count(att) - 1) * var_pop(att)) + 1e-7, 2) AS se, round((SELECT pre FROM o WHERE f = -1) + 1e-7, 2) AS pre_rmspe, (SELECT count(*) FROM m) AS n, count(*) AS n_clusters FROM o WHERE f <> -1"""


@query(_D2.replace("JOIN (SELECT f, year, c, u, v, y AS y FROM t) t", "JOIN t").replace("y - b1 * z.u", "z.y - b1 * z.u"))
def d2_surrogate_index(spark, sf_dir):
    """The dry seasons' outcome from the wet season's, by pixel and year, and the effect on the rest."""
    p = treated(panel(spark, sf_dir))
    dry = p.where("season IN (2, 3)").groupBy("pixel_id", "year").agg(F.min("site_id").alias("cluster"), F.avg("y").alias("y"), F.max("treatment").alias("treated"), F.max("post").alias("post"))
    wet = p.where("season = 1").groupBy("pixel_id", "year").agg(F.avg("y").alias("wet_y"), F.avg("n_obs").alias("wet_n"))
    got = S.surrogate_index(dry.join(wet, ["pixel_id", "year"]), "y", ["wet_y", "wet_n"])
    return got.select(*(F.round(F.col(c) + 1e-7, 2).alias(c) for c in ("estimate", "se", "pre_rmspe")), "n", "n_clusters")


_GROUND = f"""{BALANCED_SQL}, gr AS (SELECT site_id, year(o_orderdate) AS year, avg(l_extendedprice * (1 - l_discount)) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN cust ON o_custkey = c_custkey WHERE buff_km = 0 GROUP BY ALL),
sat AS (SELECT site_id, year, avg(y) AS a, avg(ln(1 + y)) AS b FROM pb WHERE buff_km = 0 GROUP BY ALL), gm AS (SELECT value AS y, a, b FROM gr JOIN sat USING (site_id, year)),
c AS (SELECT count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb, var_pop(y) AS vy FROM gm),
zz AS (SELECT y, (a - ma) / sa AS u, (b - mb) / sb AS v, my, n FROM gm CROSS JOIN c),
sg AS (SELECT sum(u * u) AS uu, sum(u * v) AS uv, sum(v * v) AS vv, sum(u * (y - my)) AS uy, sum(v * (y - my)) AS vy FROM zz),
k AS (SELECT p, uu + p AS uu, uv, vv + p AS vv, (uu + p) * (vv + p) - uv * uv AS det, ((vv + p) * uy - uv * vy) / det AS b1, ((uu + p) * vy - uv * uy) / det AS b2 FROM sg CROSS JOIN (SELECT unnest([0.1, 1.0, 10.0, 100.0]) AS p)),
lo AS (SELECT p, b1, b2, avg(power((y - my - b1 * u - b2 * v) / (1 - 1.0 / n - (vv * u * u - 2 * uv * u * v + uu * v * v) / det), 2)) AS mse FROM k CROSS JOIN zz GROUP BY ALL),
fit AS (SELECT p AS penalty, b1 / sa AS s1, b2 / sb AS s2, my - b1 / sa * ma - b2 / sb * mb AS intercept, n, 1 - mse / vy AS r2 FROM lo CROSS JOIN c ORDER BY mse, p LIMIT 1)"""


def _ground(spark, sf_dir):
    """Annual panel with two indices, and the fit of ground means of site and year on the core's index means."""
    p = treated(balanced(spark, sf_dir)).withColumns({"a": F.col("y"), "b": F.log1p("y")})
    customers = table(spark, sf_dir, "customer").where("c_custkey % 6 = 0").select("c_custkey", (F.col("c_nationkey") + 1).alias("site_id"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    ground = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("site_id", "year").agg(F.avg("v").alias("value"))
    sat = p.where("treatment = 1").groupBy("site_id", "year").agg(F.avg("a").alias("a"), F.avg("b").alias("b"))
    return p, S.ground_fit(ground.join(sat, ["site_id", "year"]), "value", ["a", "b"])


@query(f"WITH {_GROUND} SELECT penalty, round(intercept + 1e-7, 4) AS intercept, round(s1 * 1e6, 4) AS per_million, round(s2 + 1e-7, 4) AS per_log, n, round(r2, 6) AS r2_left_out FROM fit")
def g12_ground_fit(spark, sf_dir):
    fit = _ground(spark, sf_dir)[1]
    row = (fit["penalty"], round(fit["intercept"] + 1e-7, 4), round(fit["slopes"][0] * 1e6, 4), round(fit["slopes"][1] + 1e-7, 4), fit["n"], round(fit["r2_left_out"], 6))
    return spark.createDataFrame([row], "penalty double, intercept double, per_million double, per_log double, n long, r2_left_out double")


@query(_closed(source="pr", more=_GROUND.removeprefix(BALANCED_SQL) + ", pr AS (SELECT unit, site_id, buff_km, year, intercept + s1 * y + s2 * ln(1 + y) AS y FROM pb CROSS JOIN fit)"))
def m07_surrogate_did(spark, sf_dir):
    """The regression on the ground outcome that the fit predicts for every row of the panel."""
    p, fit = _ground(spark, sf_dir)
    return _short(M.static_twfe(S.ground_outcome(p, fit, ["a", "b"], "ground"), y="ground"))
