"""Queries of aggregates and audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paneloom.operators.ranges import quantiles
from paneloom.sources.tables import BALANCED_SQL, ORDERS_SQL, PANEL_SQL, PIXELS_SQL, TREATED_SQL, balanced, orders_by_customer, panel, pixels, table, treated

from .registry import query

#: Added before rounding, so that values halfway between two roundings go one way whatever the order of a sum.
NUDGE = 1e-7


def r4(c):
    return F.round(c + NUDGE, 4)


@query(f"WITH {PANEL_SQL} SELECT year, season, count(y) AS n, round(avg(y) + 1e-7, 4) AS mean, round(stddev_samp(y) + 1e-7, 4) AS sd, round(min(y), 4) AS lo, round(max(y), 4) AS hi FROM panel GROUP BY ALL")
def a1_moments(spark, sf_dir):
    return panel(spark, sf_dir).groupBy("year", "season").agg(F.count("y").alias("n"), r4(F.avg("y")).alias("mean"), r4(F.stddev_samp("y")).alias("sd"), F.round(F.min("y"), 4).alias("lo"), F.round(F.max("y"), 4).alias("hi"))


@query(f"WITH {PANEL_SQL}, d AS (SELECT *, {TREATED_SQL} FROM panel) SELECT treatment, post, count(*) AS n, count(DISTINCT pixel_id) AS pixels, count(DISTINCT site_id) AS sites, round(min(y), 4) AS lo, round(max(y), 4) AS hi FROM d GROUP BY ALL")
def a2_cells(spark, sf_dir):
    return treated(panel(spark, sf_dir)).groupBy("treatment", "post").agg(F.count("*").alias("n"), F.count_distinct("pixel_id").alias("pixels"), F.count_distinct("site_id").alias("sites"), F.round(F.min("y"), 4).alias("lo"), F.round(F.max("y"), 4).alias("hi"))


@query(f"""WITH {PANEL_SQL}, d AS (SELECT *, {TREATED_SQL} FROM panel), f AS (SELECT count(DISTINCT treatment * 2 + post) AS cells, count(*) AS n, count(DISTINCT (pixel_id, year, season)) AS keys, count(DISTINCT site_id) AS sites FROM d)
SELECT * FROM (SELECT 'four_cells' AS rule, cells = 4 AS passed FROM f UNION ALL SELECT 'one_row_per_key', n = keys FROM f UNION ALL SELECT 'clusters', sites >= 6 FROM f)""")
def a3_verdict(spark, sf_dir):
    d = treated(panel(spark, sf_dir))
    f = d.agg(F.count_distinct(F.col("treatment") * 2 + F.col("post")).alias("cells"), F.count("*").alias("n"), F.count_distinct("pixel_id", "year", "season").alias("keys"), F.count_distinct("site_id").alias("sites"))
    rules = F.array(F.struct(F.lit("four_cells").alias("rule"), (F.col("cells") == 4).alias("passed")), F.struct(F.lit("one_row_per_key").alias("rule"), (F.col("n") == F.col("keys")).alias("passed")), F.struct(F.lit("clusters").alias("rule"), (F.col("sites") >= 6).alias("passed")))
    return f.select(F.inline(rules))


@query(f"WITH {ORDERS_SQL} SELECT pixel_id, count(*) AS n, count(DISTINCT (year, season)) AS cells, arg_max(order_id, struct_pack(d := date, o := order_id)) AS newest, round(avg(price) + 1e-7, 4) AS mean FROM orders_c GROUP BY 1")
def a4_registry(spark, sf_dir):
    return orders_by_customer(spark, sf_dir).groupBy("pixel_id").agg(F.count("*").alias("n"), F.count_distinct("year", "season").alias("cells"), F.max_by("order_id", F.struct("date", "order_id")).alias("newest"), r4(F.avg("price")).alias("mean"))


@query(f"WITH {PIXELS_SQL}, g AS (SELECT copy, lon - lag(lon) OVER (PARTITION BY copy, round(lat, 6) ORDER BY lon) AS step FROM pixels) SELECT copy, round(median(step), 6) AS spacing FROM g GROUP BY 1")
def a5_spacing(spark, sf_dir):
    step = F.col("lon") - F.lag("lon").over(Window.partitionBy("copy", "row").orderBy("lon"))
    return pixels(spark, sf_dir).withColumn("row", F.round("lat", 6)).withColumn("step", step).groupBy("copy").agg(F.round(F.percentile("step", 0.5), 6).alias("spacing"))


@query("SELECT o_orderpriority AS source, count(*) AS n, count(*) FILTER (year(o_orderdate) >= 1998) AS n_post, count(*) FILTER (year(o_orderdate) < 1998) AS n_pre, count(*) FILTER (o_custkey % 6 = 0) AS n_core, count(*) FILTER ((o_orderstatus = 'F') <> (year(o_orderdate) < 1998)) AS n_disagree FROM orders GROUP BY 1")
def a6_design_audit(spark, sf_dir):
    late = F.year("o_orderdate") >= 1998
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("source")).agg(F.count("*").alias("n"), F.count_if(late).alias("n_post"), F.count_if(~late).alias("n_pre"), F.count_if(F.col("o_custkey") % 6 == 0).alias("n_core"), F.count_if((F.col("o_orderstatus") == "F") != ~late).alias("n_disagree"))


@query("SELECT s_nationkey AS claimed, c_nationkey AS found, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def a7_tag_audit(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("s_nationkey").alias("claimed"), F.col("c_nationkey").alias("found")).agg(F.count("*").alias("n"))


@query(f"WITH {PANEL_SQL}, d AS (SELECT *, {TREATED_SQL} FROM panel) SELECT count(*) FILTER (did_term <> treatment * post) AS bad_did, count(*) FILTER (event_time <> year - 1998) AS bad_time, count(*) FILTER (buff_km NOT BETWEEN 0 AND 5) AS bad_ring, count(*) AS n FROM d")
def a8_identities(spark, sf_dir):
    return treated(panel(spark, sf_dir)).agg(F.count_if(F.col("did_term") != F.col("treatment") * F.col("post")).alias("bad_did"), F.count_if(F.col("event_time") != F.col("year") - 1998).alias("bad_time"), F.count_if(~F.col("buff_km").between(0, 5)).alias("bad_ring"), F.count("*").alias("n"))


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_priorities, count(DISTINCT o_orderstatus) AS n_status FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1 OR count(DISTINCT o_orderstatus) > 1")
def a9_consistency(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("n_priorities"), F.count_distinct("o_orderstatus").alias("n_status")).where("n_priorities > 1 OR n_status > 1")


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def a10_duplicates(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")).where("n > 1")


@query(f"WITH {PANEL_SQL}, c AS (SELECT site_id, pixel_id, count(*) AS n FROM panel GROUP BY ALL), s AS (SELECT site_id, count(DISTINCT (year, season)) AS cells FROM panel GROUP BY 1) SELECT site_id, count(*) FILTER (n = cells) AS complete, count(*) FILTER (n < cells) AS incomplete FROM c JOIN s USING (site_id) GROUP BY 1")
def a11_balance(spark, sf_dir):
    p = panel(spark, sf_dir)
    c, s = p.groupBy("site_id", "pixel_id").agg(F.count("*").alias("n")), p.groupBy("site_id").agg(F.count_distinct("year", "season").alias("cells"))
    return c.join(s, "site_id").groupBy("site_id").agg(F.count_if(F.col("n") == F.col("cells")).alias("complete"), F.count_if(F.col("n") < F.col("cells")).alias("incomplete"))


@query("""WITH u AS (UNPIVOT (SELECT l_returnflag, l_linestatus, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME variable VALUE v)
SELECT variable, l_returnflag, l_linestatus, count(v) AS n, round(stddev_samp(v), 6) AS sd, max(v) - min(v) = 0 AS constant FROM u GROUP BY ALL""")
def a12_variation(spark, sf_dir):
    u = table(spark, sf_dir, "lineitem").unpivot(["l_returnflag", "l_linestatus"], ["l_quantity", "l_discount", "l_tax"], "variable", "v")
    return u.groupBy("variable", "l_returnflag", "l_linestatus").agg(F.count("v").alias("n"), F.round(F.stddev_samp("v"), 6).alias("sd"), (F.max("v") == F.min("v")).alias("constant"))


@query("SELECT user_id % 6 = 0 AS core, count(*) AS n, count(*) FILTER (event_id % 11 = 0) AS v1_missing, count(*) FILTER (event_id % 5 = 0) AS v2_missing FROM events GROUP BY 1")
def a13_missingness(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 6 == 0).alias("core")).agg(F.count("*").alias("n"), F.count_if(F.col("event_id") % 11 == 0).alias("v1_missing"), F.count_if(F.col("event_id") % 5 == 0).alias("v2_missing"))


@query("""SELECT 'price_quantity' AS pair, round(corr(l_extendedprice, l_quantity), 6) AS r, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem
UNION ALL SELECT 'discount_twice', round(corr(2 * l_discount + 1, l_discount), 6), round(regr_slope(2 * l_discount + 1, l_discount), 4), round(regr_intercept(2 * l_discount + 1, l_discount), 4) FROM lineitem""")
def a14_outcome_identities(spark, sf_dir):
    pairs = {"price_quantity": ("l_extendedprice", "l_quantity"), "discount_twice": ("2 * l_discount + 1", "l_discount")}
    cells = [F.struct(F.lit(k).alias("pair"), F.round(F.expr(f"corr({a}, {b})"), 6).alias("r"), F.round(F.expr(f"regr_slope({a}, {b})"), 4).alias("slope"), F.round(F.expr(f"regr_intercept({a}, {b})"), 4).alias("intercept")) for k, (a, b) in pairs.items()]
    return table(spark, sf_dir, "lineitem").agg(F.array(*cells).alias("c")).select(F.inline("c"))


@query(f"WITH {PANEL_SQL} SELECT site_id, buff_km, season, year, round(avg(y) + 1e-7, 4) AS mean, count(*) AS n, count(DISTINCT pixel_id) AS pixels FROM panel GROUP BY ALL")
def a15_series(spark, sf_dir):
    return panel(spark, sf_dir).groupBy("site_id", "buff_km", "season", "year").agg(r4(F.avg("y")).alias("mean"), F.count("*").alias("n"), F.count_distinct("pixel_id").alias("pixels"))


_NET_SQL = PANEL_SQL + ", net AS (SELECT *, y - avg(CASE WHEN buff_km > 0 THEN y END) OVER (PARTITION BY site_id, season, year) AS net FROM panel)"


def season_net(p):
    """The outcome less the control mean of its site, season and year."""
    return p.withColumn("net", F.col("y") - F.avg(F.when(F.col("buff_km") > 0, F.col("y"))).over(Window.partitionBy("site_id", "season", "year")))


@query(f"WITH {_NET_SQL} SELECT pixel_id, year, round(avg(net) + 1e-7, 4) AS net, count(*) AS seasons FROM net GROUP BY ALL")
def a16_unit_years(spark, sf_dir):
    return season_net(panel(spark, sf_dir)).groupBy("pixel_id", "year").agg(r4(F.avg("net")).alias("net"), F.count("*").alias("seasons"))


@query(f"WITH {_NET_SQL} SELECT pixel_id, year, season, round(net + 1e-7, 4) AS net FROM net")
def a17_season_net(spark, sf_dir):
    return season_net(panel(spark, sf_dir)).select("pixel_id", "year", "season", r4(F.col("net")).alias("net"))


@query(f"WITH {BALANCED_SQL} SELECT unit, CAST(buff_km = 0 AS INT) AS treatment, round(avg(y) FILTER (year >= 1998) - avg(y) FILTER (year < 1998) + 1e-7, 4) AS change FROM pb GROUP BY ALL HAVING count(*) FILTER (year < 1998) >= 2 AND count(*) FILTER (year >= 1998) >= 1")
def a18_long_difference(spark, sf_dir):
    late = F.col("year") >= 1998
    g = balanced(spark, sf_dir).groupBy("unit", (F.col("buff_km") == 0).cast("int").alias("treatment"))
    g = g.agg(r4(F.avg(F.when(late, F.col("y"))) - F.avg(F.when(~late, F.col("y")))).alias("change"), F.count_if(late).alias("a"), F.count_if(~late).alias("b"))
    return g.where("b >= 2 AND a >= 1").drop("a", "b")


@query(f"WITH {PANEL_SQL}, d AS (SELECT *, {TREATED_SQL} FROM panel) SELECT pixel_id, year, round(avg(did_term), 6) AS share, max(did_term) AS any_did, round(avg(y) + 1e-7, 4) AS y FROM d GROUP BY ALL")
def a19_annual(spark, sf_dir):
    return treated(panel(spark, sf_dir)).groupBy("pixel_id", "year").agg(F.round(F.avg("did_term"), 6).alias("share"), F.max("did_term").alias("any_did"), r4(F.avg("y")).alias("y"))


@query(f"WITH {PANEL_SQL}, d AS (SELECT *, {TREATED_SQL} FROM panel) SELECT year, treatment, round(avg(y) + 1e-7, 4) AS mean, round(avg(y - 5000 * did_term) + 1e-7, 4) AS counterfactual FROM d GROUP BY ALL")
def a20_counterfactual_means(spark, sf_dir):
    return treated(panel(spark, sf_dir)).groupBy("year", "treatment").agg(r4(F.avg("y")).alias("mean"), r4(F.avg(F.col("y") - 5000 * F.col("did_term"))).alias("counterfactual"))


@query(f"""WITH {PANEL_SQL}, w AS (SELECT *, y - avg(y) OVER (PARTITION BY pixel_id, season) AS e FROM panel)
SELECT site_id, year, season, round(avg(e) FILTER (buff_km = 0) - avg(e) FILTER (buff_km > 0) + 1e-7, 4) AS gap FROM w GROUP BY ALL""")
def a21_design_gaps(spark, sf_dir):
    e = panel(spark, sf_dir).withColumn("e", F.col("y") - F.avg("y").over(Window.partitionBy("pixel_id", "season")))
    core = F.col("buff_km") == 0
    return e.groupBy("site_id", "year", "season").agg(r4(F.avg(F.when(core, F.col("e"))) - F.avg(F.when(~core, F.col("e")))).alias("gap"))


@query(f"""WITH {PANEL_SQL}, d AS (SELECT *, {TREATED_SQL} FROM panel), ref AS (SELECT DISTINCT pixel_id FROM d WHERE event_time = -1)
SELECT event_time, treatment, count(*) AS n, count(DISTINCT pixel_id) AS units, count(DISTINCT CASE WHEN pixel_id IN (SELECT pixel_id FROM ref) THEN pixel_id END) AS units_at_ref FROM d GROUP BY ALL""")
def a22_event_coverage(spark, sf_dir):
    d = treated(panel(spark, sf_dir))
    ref = d.where("event_time = -1").select("pixel_id").distinct().withColumn("ref", F.col("pixel_id"))
    return d.join(ref, "pixel_id", "left").groupBy("event_time", "treatment").agg(F.count("*").alias("n"), F.count_distinct("pixel_id").alias("units"), F.count_distinct("ref").alias("units_at_ref"))


@query(f"WITH {PANEL_SQL} SELECT buff_km, year, season, round(sum(y) + 1e-4, 2) AS total, count(*) AS n FROM panel WHERE year < 1998 AND buff_km > 0 GROUP BY ALL")
def a23_control_facts(spark, sf_dir):
    return panel(spark, sf_dir).where("year < 1998 AND buff_km > 0").groupBy("buff_km", "year", "season").agg(F.round(F.sum("y") + 1e-4, 2).alias("total"), F.count("*").alias("n"))


@query("SELECT p_brand AS village, count(*) AS parcels, round(sum(l_extendedprice), 2) AS actual, round(sum(l_extendedprice * (1 + l_tax)), 2) AS proposed, round(100 * sum(l_extendedprice) / sum(l_extendedprice * (1 + l_tax)), 4) AS completion, count(*) FILTER (l_discount = 0) AS imputed FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def a24_dose_table(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    actual, proposed = F.sum("l_extendedprice"), F.sum(F.col("l_extendedprice") * (1 + F.col("l_tax")))
    return j.groupBy(F.col("p_brand").alias("village")).agg(F.count("*").alias("parcels"), F.round(actual, 2).alias("actual"), F.round(proposed, 2).alias("proposed"), F.round(100 * actual / proposed, 4).alias("completion"), F.count_if(F.col("l_discount") == 0).alias("imputed"))


@query("SELECT o_orderpriority AS crop, year(o_orderdate) AS year, count(*) AS n, quantile_cont(dayofyear(o_orderdate), 0.5) AS sow_median, quantile_cont(dayofyear(o_orderdate), 0.1) AS sow_p10, quantile_cont(dayofyear(o_orderdate), 0.9) AS sow_p90 FROM orders GROUP BY ALL HAVING count(*) >= 3")
def a26_crop_calendar(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("crop"), F.year("o_orderdate").alias("year"), F.dayofyear("o_orderdate").alias("day"))
    return quantiles(o, ["crop", "year"], "day", {"sow_median": 0.5, "sow_p10": 0.1, "sow_p90": 0.9}).where("n >= 3")


@query(f"WITH {PIXELS_SQL}, m AS (SELECT site_id, median(lat) AS la, median(lon) AS lo FROM pixels GROUP BY 1) SELECT site_id, round(avg(CAST(sqrt(power((lon - lo) * 111320.0 * cos(radians(la)), 2) + power((lat - la) * 110574.0, 2)) <= 150 AS INT)), 6) AS near, count(*) AS visits FROM pixels JOIN m USING (site_id) GROUP BY 1")
def a27_site_medians(spark, sf_dir):
    p = pixels(spark, sf_dir)
    m = p.groupBy("site_id").agg(F.percentile("lat", 0.5).alias("la"), F.percentile("lon", 0.5).alias("lo"))
    d = F.sqrt(F.pow((F.col("lon") - F.col("lo")) * 111320.0 * F.cos(F.radians("la")), 2) + F.pow((F.col("lat") - F.col("la")) * 110574.0, 2))
    return p.join(m, "site_id").groupBy("site_id").agg(F.round(F.avg((d <= 150).cast("int")), 6).alias("near"), F.count("*").alias("visits"))


@query(f"WITH {PANEL_SQL} SELECT season, CASE WHEN buff_km = 0 THEN 'treated' ELSE 'control' END AS role, round(avg(y) + 1e-7, 4) AS mean, round(stddev_samp(y) + 1e-7, 4) AS sd, count(*) AS n FROM panel GROUP BY ALL")
def a29_ground_table(spark, sf_dir):
    role = F.when(F.col("buff_km") == 0, "treated").otherwise("control")
    return panel(spark, sf_dir).groupBy("season", role.alias("role")).agg(r4(F.avg("y")).alias("mean"), r4(F.stddev_samp("y")).alias("sd"), F.count("*").alias("n"))


@query("SELECT p_brand AS source, count(*) AS n, round(corr(l_extendedprice / l_quantity, p_retailprice), 6) AS r, round(avg(l_extendedprice / l_quantity - p_retailprice), 4) AS bias, round(sqrt(avg(power(l_extendedprice / l_quantity - p_retailprice, 2))), 4) AS rmse FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def a30_agreement(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("x", F.col("l_extendedprice") / F.col("l_quantity"))
    d = F.col("x") - F.col("p_retailprice")
    return j.groupBy(F.col("p_brand").alias("source")).agg(F.count("*").alias("n"), F.round(F.corr("x", "p_retailprice"), 6).alias("r"), F.round(F.avg(d), 4).alias("bias"), F.round(F.sqrt(F.avg(d * d)), 4).alias("rmse"))


@query(f"WITH {PANEL_SQL} SELECT buff_km, round(quantile_cont(y, 0.01) + 1e-7, 4) AS p01, round(quantile_cont(y, 0.99) + 1e-7, 4) AS p99, round(100.0 * count(DISTINCT y) / count(DISTINCT pixel_id), 4) AS distinct_per_100 FROM panel GROUP BY 1")
def a31_tails(spark, sf_dir):
    p = panel(spark, sf_dir)
    q = quantiles(p, ["buff_km"], "y", {"p01": 0.01, "p99": 0.99}).select("buff_km", r4(F.col("p01")).alias("p01"), r4(F.col("p99")).alias("p99"))
    return q.join(p.groupBy("buff_km").agg(F.round(100 * F.count_distinct("y") / F.count_distinct("pixel_id"), 4).alias("distinct_per_100")), "buff_km")


@query(f"WITH {PANEL_SQL}, d AS (SELECT *, {TREATED_SQL} FROM panel), m AS (SELECT site_id, avg(y) FILTER (treatment = 1 AND post = 1) AS a, avg(y) FILTER (treatment = 1 AND post = 0) AS b, avg(y) FILTER (treatment = 0 AND post = 1) AS c, avg(y) FILTER (treatment = 0 AND post = 0) AS e FROM d GROUP BY 1) SELECT site_id, round((a - b) - (c - e) + 1e-7, 4) AS did FROM m")
def a34_raw_did(spark, sf_dir):
    t, p, y = F.col("treatment") == 1, F.col("post") == 1, F.col("y")
    m = treated(panel(spark, sf_dir)).groupBy("site_id").agg(*(F.avg(F.when(c, y)).alias(k) for k, c in (("a", t & p), ("b", t & ~p), ("c", ~t & p), ("e", ~t & ~p))))
    return m.select("site_id", r4((F.col("a") - F.col("b")) - (F.col("c") - F.col("e"))).alias("did"))


@query("SELECT user_id % 20 AS district, count(*) AS n, CAST(mode(hour(ts)) IS NOT NULL AS INT) AS has_mode, round(avg(CAST(hour(ts) BETWEEN 6 AND 9 AS INT)), 6) AS core_share FROM events GROUP BY 1 HAVING count(*) >= 30")
def a40_core_months(spark, sf_dir):
    h = F.hour("ts")
    g = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("district"))
    return g.agg(F.count("*").alias("n"), F.mode(h).isNotNull().cast("int").alias("has_mode"), F.round(F.avg(h.between(6, 9).cast("int")), 6).alias("core_share")).where("n >= 30")


@query(f"""WITH {PANEL_SQL}, v AS (SELECT 'all' AS variant, * FROM panel UNION ALL SELECT 'no_donut', * FROM panel WHERE buff_km <> 1 UNION ALL SELECT 'kharif', * FROM panel WHERE season = 1)
SELECT variant, count(*) AS n, count(DISTINCT pixel_id) AS pixels, count(DISTINCT site_id) AS sites, count(DISTINCT year) AS years, count(*) FILTER (buff_km = 0) AS treated FROM v GROUP BY 1""")
def a42_variants(spark, sf_dir):
    rules = {"all": F.lit(True), "no_donut": F.col("buff_km") != 1, "kharif": F.col("season") == 1}
    v = panel(spark, sf_dir).withColumn("variant", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))))
    return v.groupBy("variant").agg(F.count("*").alias("n"), F.count_distinct("pixel_id").alias("pixels"), F.count_distinct("site_id").alias("sites"), F.count_distinct("year").alias("years"), F.count_if(F.col("buff_km") == 0).alias("treated"))
