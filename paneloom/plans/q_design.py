"""Queries of design operators: screens, windows, masks, control choice."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paneloom.sources.tables import BALANCED_SQL, PANEL_SQL, balanced, panel, table

from .q_audits import r4
from .registry import query


@query(f"""WITH {PANEL_SQL}, c AS (SELECT year, season, count(*) FILTER (buff_km = 0) AS nt, count(*) FILTER (buff_km > 0) AS nc, avg(y) AS m, coalesce(stddev_samp(y), 0) AS sd FROM panel GROUP BY ALL), q AS (SELECT median(nt) AS mt, median(nc) AS mc FROM c)
SELECT year, season, sd <= 1e-9 * greatest(1, abs(m)) AS constant, nt < 0.5 * mt OR nc < 0.5 * mc AS collapsed FROM c CROSS JOIN q""")
def f7_outcome_screen(spark, sf_dir):
    c = panel(spark, sf_dir).groupBy("year", "season").agg(F.count_if(F.col("buff_km") == 0).alias("nt"), F.count_if(F.col("buff_km") > 0).alias("nc"), F.avg("y").alias("m"), F.coalesce(F.stddev_samp("y"), F.lit(0.0)).alias("sd"))
    q = c.agg(F.percentile("nt", 0.5).alias("mt"), F.percentile("nc", 0.5).alias("mc"))
    return c.join(F.broadcast(q)).select("year", "season", (F.col("sd") <= 1e-9 * F.greatest(F.lit(1.0), F.abs("m"))).alias("constant"), ((F.col("nt") < 0.5 * F.col("mt")) | (F.col("nc") < 0.5 * F.col("mc"))).alias("collapsed"))


@query("SELECT o_orderpriority AS source, CASE WHEN count(DISTINCT o_orderstatus) <= 1 THEN true ELSE false END AS flat, count(*) FILTER (o_custkey % 6 NOT BETWEEN 0 AND 4) AS far_ring, count(*) FILTER (o_totalprice <= 0) AS bad FROM orders GROUP BY 1")
def f5_file_checks(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("source")).agg((F.count_distinct("o_orderstatus") <= 1).alias("flat"), F.count_if(~(F.col("o_custkey") % 6).between(0, 4)).alias("far_ring"), F.count_if(F.col("o_totalprice") <= 0).alias("bad"))


@query("SELECT count(*) AS n, count(*) FILTER (l_discount < 0 OR l_discount > 0.1) AS outside, count(*) FILTER (l_tax = 0) AS zeros, count(*) FILTER (l_quantity <= -100) AS codes FROM lineitem")
def f6_range_safety(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"), F.count_if(~F.col("l_discount").between(0, 0.1)).alias("outside"), F.count_if(F.col("l_tax") == 0).alias("zeros"), F.count_if(F.col("l_quantity") <= -100).alias("codes"))


@query("SELECT o_orderkey, CAST(o_orderstatus <> 'F' AS INT) AS by_flag, CAST(year(o_orderdate) >= 1998 AS INT) AS by_year, CASE WHEN (o_orderstatus <> 'F') = (year(o_orderdate) >= 1998) THEN CAST(year(o_orderdate) >= 1998 AS INT) END AS both FROM orders")
def f8_period_rules(spark, sf_dir):
    flag, late = F.col("o_orderstatus") != "F", F.year("o_orderdate") >= 1998
    return table(spark, sf_dir, "orders").select("o_orderkey", flag.cast("int").alias("by_flag"), late.cast("int").alias("by_year"), F.when(flag == late, late.cast("int")).alias("both"))


@query(f"""WITH {PANEL_SQL}, k AS (SELECT pixel_id, season, count(*) AS n FROM panel WHERE year < 1998 GROUP BY ALL), m AS (SELECT pixel_id FROM (SELECT *, row_number() OVER (PARTITION BY pixel_id ORDER BY n DESC, season) AS rn FROM k) WHERE rn = 1 AND season = 2)
SELECT p.year, count(*) AS n FROM panel p SEMI JOIN m ON m.pixel_id = p.pixel_id GROUP BY 1""")
def f15_mode_mask(spark, sf_dir):
    p = panel(spark, sf_dir)
    counts = p.where("year < 1998").groupBy("pixel_id", "season").agg(F.count("*").alias("n"))
    mode = counts.groupBy("pixel_id").agg(F.max_by("season", F.struct("n", -F.col("season"))).alias("mode")).where("mode = 2")
    return p.join(mode, "pixel_id", "left_semi").groupBy("year").agg(F.count("*").alias("n"))


@query(f"WITH {PANEL_SQL}, m AS (SELECT pixel_id FROM panel WHERE year < 1998 GROUP BY 1 HAVING avg(y) > 200000) SELECT p.year, count(*) AS n, count(DISTINCT p.pixel_id) AS pixels FROM panel p SEMI JOIN m ON m.pixel_id = p.pixel_id GROUP BY 1")
def f16_baseline_mask(spark, sf_dir):
    p = panel(spark, sf_dir)
    m = p.where("year < 1998").groupBy("pixel_id").agg(F.avg("y").alias("m")).where("m > 200000")
    return p.join(m, "pixel_id", "left_semi").groupBy("year").agg(F.count("*").alias("n"), F.count_distinct("pixel_id").alias("pixels"))


@query(f"WITH {PANEL_SQL}, k AS (SELECT pixel_id FROM panel GROUP BY 1 HAVING count(*) FILTER (year < 1998) > 0 AND count(*) FILTER (year >= 1998) > 0) SELECT p.pixel_id, count(*) AS n FROM panel p SEMI JOIN k ON k.pixel_id = p.pixel_id GROUP BY 1")
def f17_same_pixels(spark, sf_dir):
    return panel(spark, sf_dir).groupBy("pixel_id").agg(F.count("*").alias("n"), F.count_if(F.col("year") < 1998).alias("a"), F.count_if(F.col("year") >= 1998).alias("b")).where("a > 0 AND b > 0").select("pixel_id", "n")


@query(f"WITH {PANEL_SQL}, s AS (SELECT site_id, count(DISTINCT year) AS years FROM panel GROUP BY 1), k AS (SELECT pixel_id FROM panel JOIN s USING (site_id) GROUP BY pixel_id, years HAVING count(DISTINCT year) = years) SELECT site_id, count(*) AS n FROM panel p SEMI JOIN k ON k.pixel_id = p.pixel_id GROUP BY 1")
def f18_balanced_pixels(spark, sf_dir):
    p = panel(spark, sf_dir)
    s = p.groupBy("site_id").agg(F.count_distinct("year").alias("years"))
    k = p.groupBy("site_id", "pixel_id").agg(F.count_distinct("year").alias("n")).join(s, "site_id").where("n = years").select("pixel_id")
    return p.join(k, "pixel_id", "left_semi").groupBy("site_id").agg(F.count("*").alias("n"))


@query(f"WITH {PANEL_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY pixel_id, season) AS k FROM panel) SELECT season, count(*) FILTER (k > 1) AS kept, count(*) FILTER (k = 1) AS singletons FROM n GROUP BY 1")
def f19_singletons(spark, sf_dir):
    n = panel(spark, sf_dir).withColumn("k", F.count("*").over(Window.partitionBy("pixel_id", "season")))
    return n.groupBy("season").agg(F.count_if(F.col("k") > 1).alias("kept"), F.count_if(F.col("k") == 1).alias("singletons"))


@query(f"WITH {PANEL_SQL}, c AS (SELECT site_id, count(*) AS n FROM panel GROUP BY 1) SELECT site_id, n, n >= 0.05 * (SELECT max(n) FROM c) AS processed FROM c")
def f21_processing_set(spark, sf_dir):
    c = panel(spark, sf_dir).groupBy("site_id").agg(F.count("*").alias("n"))
    return c.join(F.broadcast(c.agg(F.max("n").alias("top")))).select("site_id", "n", (F.col("n") >= 0.05 * F.col("top")).alias("processed"))


@query("WITH c AS (SELECT o_orderpriority AS source, c_nationkey AS site, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, site) AS rn, n / sum(n) OVER (PARTITION BY source) AS share FROM c) SELECT source, site, round(share, 6) AS share, share > 0.5 AS sure FROM r WHERE rn = 1")
def f22_fragments(spark, sf_dir):
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    c = j.groupBy(F.col("o_orderpriority").alias("source"), F.col("c_nationkey").alias("site")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("source")
    r = c.withColumns({"rn": F.row_number().over(w.orderBy(F.desc("n"), "site")), "share": F.col("n") / F.sum("n").over(w)})
    return r.where("rn = 1").select("source", "site", F.round("share", 6).alias("share"), (F.col("share") > 0.5).alias("sure"))


@query("WITH v AS (SELECT DISTINCT l_tax * 1.0 AS v FROM lineitem), d AS (SELECT v - lag(v) OVER (ORDER BY v) AS gap, CAST(CAST(v AS FLOAT) AS DOUBLE) = v AS exact32 FROM v) SELECT round(min(gap), 9) AS smallest, count(*) AS n_values FROM d")
def f27_precision(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select(F.col("l_tax").alias("v")).distinct()
    # neighbours within a decade of values are found in its own partition, those across by the edges of each
    part = F.floor(F.col("v") * 100)
    gaps = v.withColumn("part", part).withColumn("gap", F.col("v") - F.lag("v").over(Window.partitionBy("part").orderBy("v")))
    edges = gaps.groupBy("part").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.min("gap").alias("gap"), F.count("*").alias("n"))
    across = edges.withColumn("cross", F.col("lo") - F.lag("hi").over(Window.orderBy("part")))
    return across.agg(F.round(F.least(F.min("gap"), F.min("cross")), 9).alias("smallest"), F.sum("n").alias("n_values"))


_CONTROL = f"""WITH {PANEL_SQL}, c AS (SELECT buff_km, year * 10 + season AS t, avg(y) AS m FROM panel WHERE year < 1998 GROUP BY ALL), g AS (SELECT a.buff_km, a.t, a.m - b.m AS d FROM c a JOIN c b ON b.t = a.t AND b.buff_km = 0 WHERE a.buff_km > 0)
SELECT buff_km, round(avg(d) + 1e-7, 4) AS level, round(regr_slope(d, t) + 1e-7, 4) AS slope, round(sqrt(avg(d * d)) + 1e-7, 4) AS rmse, CAST(row_number() OVER (ORDER BY abs(regr_slope(d, t)), buff_km) AS INT) AS place FROM g GROUP BY 1"""


@query(_CONTROL)
def g3_control_rings(spark, sf_dir):
    c = panel(spark, sf_dir).where("year < 1998").groupBy("buff_km", (F.col("year") * 10 + F.col("season")).alias("t")).agg(F.avg("y").alias("m"))
    core = c.where("buff_km = 0").select("t", F.col("m").alias("m0"))
    g = c.where("buff_km > 0").join(core, "t").withColumn("d", F.col("m") - F.col("m0"))
    s = g.groupBy("buff_km").agg(F.avg("d").alias("level"), F.regr_slope("d", "t").alias("slope"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"))
    return s.select("buff_km", r4(F.col("level")).alias("level"), r4(F.col("slope")).alias("slope"), r4(F.col("rmse")).alias("rmse"), F.row_number().over(Window.orderBy(F.abs("slope"), "buff_km")).alias("place"))  # five rings


@query(f"WITH {PANEL_SQL}, s AS (SELECT count(DISTINCT site_id) AS sites, count(DISTINCT year) AS years FROM panel) SELECT CASE WHEN sites >= 6 THEN 'site' ELSE 'year' END AS cluster, CASE WHEN sites >= 6 THEN sites ELSE years END AS n_clusters FROM s")
def g4_cluster_choice(spark, sf_dir):
    s = panel(spark, sf_dir).agg(F.count_distinct("site_id").alias("sites"), F.count_distinct("year").alias("years"))
    many = F.col("sites") >= 6
    return s.select(F.when(many, "site").otherwise("year").alias("cluster"), F.when(many, F.col("sites")).otherwise(F.col("years")).alias("n_clusters"))


@query(f"WITH {BALANCED_SQL} SELECT count(*) FILTER (buff_km = 0 AND unit LIKE '%|0' = false) AS leaks, count(DISTINCT unit) AS units, count(*) AS n, min(year) AS first, max(year) AS last FROM pb")
def g6_integrity(spark, sf_dir):
    return balanced(spark, sf_dir).agg(F.count_if((F.col("buff_km") == 0) & ~F.col("unit").endswith("|0")).alias("leaks"), F.count_distinct("unit").alias("units"), F.count("*").alias("n"), F.min("year").alias("first"), F.max("year").alias("last"))


@query(f"WITH {PANEL_SQL}, r AS (SELECT pixel_id, avg(y) AS m FROM panel WHERE year < 1998 AND buff_km > 0 GROUP BY 1), t AS (SELECT avg(y) AS m FROM panel WHERE year < 1998 AND buff_km = 0) SELECT pixel_id FROM (SELECT pixel_id, abs(r.m - t.m) AS s FROM r CROSS JOIN t ORDER BY s, pixel_id LIMIT 100)")
def o2_closest_controls(spark, sf_dir):
    pre = panel(spark, sf_dir).where("year < 1998")
    t = pre.where("buff_km = 0").agg(F.avg("y").alias("t"))
    r = pre.where("buff_km > 0").groupBy("pixel_id").agg(F.avg("y").alias("m")).join(F.broadcast(t))
    return r.orderBy(F.abs(F.col("m") - F.col("t")), "pixel_id").limit(100).select("pixel_id")
