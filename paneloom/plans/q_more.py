"""Further queries: composites and sources, ground tables, crosswalks, filters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paneloom.functions import spectral as S
from paneloom.functions.calendar import season_rank
from paneloom.operators import spatial as SP
from paneloom.sources.tables import BALANCED_SQL, ORDERS_SQL, PANEL_SQL, PIXELS_SQL, TREATED_SQL, balanced, orders_by_customer, panel, pixels, table, treated

from .q_audits import r4
from .registry import query


@query(f"WITH {ORDERS_SQL}, p AS (SELECT site_id, season, year, avg(price) AS v FROM orders_c GROUP BY ALL) SELECT site_id, season, round(min(v) + 1e-7, 4) AS lo, round(max(v) + 1e-7, 4) AS hi, round(quantile_cont(v, 0.05) + 1e-7, 4) AS p05, count(*) AS n FROM p WHERE year < 1999 GROUP BY ALL")
def x12_climatology(spark, sf_dir):
    p = orders_by_customer(spark, sf_dir).groupBy("site_id", "season", "year").agg(F.avg("price").alias("v")).where("year < 1999")
    return p.groupBy("site_id", "season").agg(r4(F.min("v")).alias("lo"), r4(F.max("v")).alias("hi"), r4(F.percentile("v", 0.05)).alias("p05"), F.count("*").alias("n"))


@query("""WITH w AS (SELECT user_id % 50 AS site, CAST(floor(epoch(ts) / 604800) AS BIGINT) AS week, avg(value) AS sw FROM events GROUP BY ALL), c AS (SELECT site, quantile_cont(sw, 0.95) AS fc, max(sw) AS hi, min(sw) AS lo FROM w GROUP BY 1),
d AS (SELECT w.site, week, CASE WHEN sw >= fc THEN (sw - fc) / nullif(hi - fc, 0) ELSE (sw - fc) / nullif(fc - lo, 0) END * 4 AS deficit FROM w JOIN c ON w.site = c.site) SELECT site, week, round(deficit + 0.5 * coalesce(lag(deficit) OVER (PARTITION BY site ORDER BY week), 0), 5) AS smdi FROM d""")
def x15_soil_moisture_deficit(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    week = F.floor(F.col("ts").cast("timestamp").cast("double") / 604800)
    w = e.groupBy((F.col("user_id") % 50).alias("site"), week.alias("week")).agg(F.avg("value").alias("sw"))
    c = w.groupBy("site").agg(F.percentile("sw", 0.95).alias("fc"), F.max("sw").alias("hi"), F.min("sw").alias("lo"))
    above = F.col("sw") >= F.col("fc")
    part = lambda d: (F.col("sw") - F.col("fc")) / F.nullif(d, F.lit(0.0))
    d = w.join(c, "site").withColumn("deficit", F.when(above, part(F.col("hi") - F.col("fc"))).otherwise(part(F.col("fc") - F.col("lo"))) * 4)
    before = F.coalesce(F.lag("deficit").over(Window.partitionBy("site").orderBy("week")), F.lit(0.0))
    return d.select("site", "week", F.round(F.col("deficit") + 0.5 * before, 5).alias("smdi"))


@query("""WITH t AS (SELECT vec_id, label % 3 AS class, 2 + 4 * (0.5 + CAST(embedding[1] AS DOUBLE)) AS lai, CASE WHEN label % 4 <> 0 THEN 60 + 100 * CAST(embedding[2] AS DOUBLE) END AS sar, 0.5 + CAST(embedding[3] AS DOUBLE) AS ndvi FROM embeddings),
u AS (SELECT *, 5 + 3 * class + (20 + 5 * class) * lai AS a, 120 * ndvi AS b FROM t) SELECT vec_id, round(greatest(0, least(500, CASE WHEN sar IS NULL THEN (a + b) / 2 ELSE (a + sar + b) / 3 END)), 5) AS agb FROM u""")
def x17_biomass(spark, sf_dir):
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    cls = F.col("label") % 3
    agb = S.biomass(2 + 4 * (0.5 + at(0)), F.when(F.col("label") % 4 != 0, 60 + 100 * at(1)), 0.5 + at(2), 20 + 5 * cls, (5 + 3 * cls).cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(agb, 5).alias("agb"))


@query("WITH t AS (SELECT event_id, value, coalesce(CASE WHEN event_id % 7 <> 0 AND floor(13500 + value) * 0.02 BETWEEN 200 AND 340 THEN floor(13500 + value) / 50.0 - 273.15 END, CASE WHEN event_id % 3 <> 0 THEN value / 10 END) AS v FROM events) SELECT event_id, CASE WHEN v IS NOT NULL THEN round(greatest(-60, least(60, v)), 6) END AS tmean, CASE WHEN event_id % 7 <> 0 AND floor(13500 + value) * 0.02 BETWEEN 200 AND 340 THEN 1 WHEN event_id % 3 <> 0 THEN 2 ELSE 0 END AS source FROM t")
def x19_weather_fallback(spark, sf_dir):
    """Temperature from stored counts of 0.02 kelvin where they give a plausible one, else from a second source in tenths of a
    degree, clamped."""
    counts = F.floor(13500 + F.col("value"))
    first, second = (F.col("event_id") % 7 != 0) & S.kelvin(counts).between(200, 340), F.col("event_id") % 3 != 0
    t = F.coalesce(F.when(first, S.kelvin(counts) - 273.15), F.when(second, F.col("value") / 10))
    return table(spark, sf_dir, "events").select("event_id", F.round(S.clamp(t, -60, 60), 6).alias("tmean"), F.when(first, 1).when(second, 2).otherwise(0).alias("source"))


_CASCADE = "count(*) FILTER (order_id % 3 = {k}) AS n{k}, median(price) FILTER (order_id % 3 = {k}) AS m{k}"


@query(f"WITH {ORDERS_SQL}, t AS (SELECT site_id, year, season, {', '.join(_CASCADE.format(k=k) for k in range(3))} FROM orders_c GROUP BY ALL) SELECT site_id, year, season, CASE WHEN n0 >= 5 THEN 1 WHEN n1 >= 5 THEN 2 WHEN n2 > 0 THEN 3 END AS source, round(CASE WHEN n0 >= 5 THEN m0 WHEN n1 >= 5 THEN m1 WHEN n2 > 0 THEN m2 END + 1e-7, 4) AS value FROM t")
def x21_source_cascade(spark, sf_dir):
    own = lambda k: F.col("order_id") % 3 == k
    t = orders_by_customer(spark, sf_dir).groupBy("site_id", "year", "season").agg(*(F.count_if(own(k)).alias(f"n{k}") for k in range(3)), *(F.percentile(F.when(own(k), F.col("price")), 0.5).alias(f"m{k}") for k in range(3)))
    pick = lambda a, b, c: F.when(F.col("n0") >= 5, a).when(F.col("n1") >= 5, b).when(F.col("n2") > 0, c)
    return t.select("site_id", "year", "season", pick(F.lit(1), F.lit(2), F.lit(3)).alias("source"), r4(pick(F.col("m0"), F.col("m1"), F.col("m2"))).alias("value"))


@query("""WITH s AS (SELECT o_orderpriority AS source, substr(o_orderpriority, 1, 1)::INT AS rank, year(o_orderdate) AS year, count(DISTINCT CAST(o_orderdate AS DATE)) AS days FROM orders GROUP BY ALL), c AS (SELECT *, days / (CASE WHEN year % 4 = 0 THEN 366.0 ELSE 365.0 END) AS cover FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY cover >= 0.99 DESC, CASE WHEN cover >= 0.99 THEN rank END, CASE WHEN cover >= 0.55 THEN 0 ELSE 1 END, cover DESC, rank) AS rn FROM c) SELECT year, source, round(cover, 6) AS cover, cover >= 0.55 AS enough FROM r WHERE rn = 1""")
def x22_source_choice(spark, sf_dir):
    s = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("source"), F.year("o_orderdate").alias("year")).agg(F.count_distinct(F.col("o_orderdate").cast("date")).alias("days"))
    c = s.withColumn("cover", F.col("days") / F.when(F.col("year") % 4 == 0, 366.0).otherwise(365.0)).withColumn("place", F.substring("source", 1, 1).cast("int"))
    whole = F.col("cover") >= 0.99
    order = Window.partitionBy("year").orderBy(F.desc(whole), F.when(whole, F.col("place")).asc_nulls_last(), F.when(F.col("cover") >= 0.55, 0).otherwise(1), F.desc("cover"), "place")
    return c.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("year", "source", F.round("cover", 6).alias("cover"), (F.col("cover") >= 0.55).alias("enough"))


@query("SELECT c_custkey AS pixel_id, year(o_orderdate) AS year, round(sum(o_totalprice), 2) AS annual FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def x26_annual_sum(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_custkey").alias("pixel_id"), F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("annual"))


@query("""WITH q AS (SELECT vec_id, vec_id & 3 AS quality, (vec_id >> 5) & 7 AS state, 0.5 + CAST(embedding[1] AS DOUBLE) AS v, label FROM embeddings) SELECT label, count(*) FILTER (quality <= 1 AND state IN (0, 1, 2)) AS n_clear, round(avg(CASE WHEN quality <= 1 AND state IN (0, 1, 2) THEN v END), 6) AS mean FROM q GROUP BY 1""")
def x24_product_masks(spark, sf_dir):
    q = F.col("vec_id")
    clear = (q.bitwiseAND(3) <= 1) & F.shiftright(q, 5).bitwiseAND(7).isin(0, 1, 2)
    v = 0.5 + F.get("embedding", F.lit(0)).cast("double")
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count_if(clear).alias("n_clear"), F.round(F.avg(F.when(clear, v)), 6).alias("mean"))


@query("SELECT n_regionkey AS region, n_name AS nation, round(median(c_acctbal), 4) AS mid, round(avg(c_acctbal), 4) AS mean, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def a35_ground_means(spark, sf_dir):
    j = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy(F.col("n_regionkey").alias("region"), F.col("n_name").alias("nation")).agg(F.round(F.percentile("c_acctbal", 0.5), 4).alias("mid"), F.round(F.avg("c_acctbal"), 4).alias("mean"), F.count("*").alias("n"))


@query("SELECT p_type AS class, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(avg(CASE WHEN p_size > 25 THEN p_retailprice END), 4) AS mean_large FROM part GROUP BY 1")
def a37_class_shares(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    total = p.agg(F.count("*").alias("all"))
    g = p.groupBy(F.col("p_type").alias("class")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("p_size") > 25, F.col("p_retailprice"))), 4).alias("mean_large"))
    return g.join(F.broadcast(total)).select("class", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"), "mean_large")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN 'measured' ELSE 'formula' END AS how, TRY_CAST(l_returnflag AS INT) AS code, round(l_extendedprice / l_quantity + 1e-7, 4) AS unit_price FROM lineitem")
def a38_parcels(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_discount") == 0, "measured").otherwise("formula").alias("how"), F.col("l_returnflag").try_cast("int").alias("code"), r4(F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"))


@query("SELECT c_custkey AS plot, round((1 + c_custkey % 7) * (2 + c_custkey % 5), 6) AS area, round(c_custkey % 11 + (1 + c_custkey % 7) / 2.0, 6) AS cx, round(c_custkey % 13 + (2 + c_custkey % 5) / 2.0, 6) AS cy FROM customer")
def a39_plot_areas(spark, sf_dir):
    """Rings as JSON text, parsed, measured by the shoelace formula."""
    k = F.col("c_custkey")
    x0, y0 = k % 11, k % 13
    x1, y1 = x0 + 1 + k % 7, y0 + 2 + k % 5
    text = F.format_string('[{"x":%d,"y":%d},{"x":%d,"y":%d},{"x":%d,"y":%d},{"x":%d,"y":%d}]', x0, y0, x1, y0, x1, y1, x0, y1)
    plots = table(spark, sf_dir, "customer").select(k.alias("plot"), F.from_json(text, "array<struct<x:double,y:double>>").alias("ring"))
    area, cx, cy = SP.shoelace("ring")
    return plots.select("plot", F.round(area, 6).alias("area"), F.round(cx, 6).alias("cx"), F.round(cy, 6).alias("cy"))


@query(f"WITH {PANEL_SQL}, d AS (SELECT *, {TREATED_SQL} FROM panel) SELECT count(*) AS n, count(DISTINCT pixel_id) AS pixels, count(DISTINCT (pixel_id, season)) AS units, count(DISTINCT site_id) AS sites, count(DISTINCT year) AS years, sum(treatment)::BIGINT AS treated_rows FROM d")
def a41_sample_facts(spark, sf_dir):
    return treated(panel(spark, sf_dir)).agg(F.count("*").alias("n"), F.count_distinct("pixel_id").alias("pixels"), F.count_distinct("pixel_id", "season").alias("units"), F.count_distinct("site_id").alias("sites"), F.count_distinct("year").alias("years"), F.sum("treatment").alias("treated_rows"))


@query("WITH u AS (UNPIVOT (SELECT p_partkey, p_size::DOUBLE AS size, p_retailprice AS price FROM part) ON size, price INTO NAME item VALUE v) SELECT p_partkey, item, round(v, 4) AS v FROM u")
def a25_long_form(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return p.unpivot("p_partkey", ["size", "price"], "item", "v").withColumn("v", F.round("v", 4))


@query(f"WITH {PIXELS_SQL}, m AS (SELECT site_id, median(lat) AS la, median(lon) AS lo FROM pixels GROUP BY 1) SELECT p.key * 2 + p.copy AS visit, round(la, 7) AS lat, round(lo, 7) AS lon FROM pixels p JOIN m ON m.site_id = p.site_id")
def j21_site_coordinates(spark, sf_dir):
    p = pixels(spark, sf_dir)
    m = p.groupBy("site_id").agg(F.percentile("lat", 0.5).alias("la"), F.percentile("lon", 0.5).alias("lo"))
    return p.join(m, "site_id").select((F.col("key") * 2 + F.col("copy")).alias("visit"), F.round("la", 7).alias("lat"), F.round("lo", 7).alias("lon"))


@query(f"WITH {PIXELS_SQL}, d AS (SELECT a.key, min(sqrt(power((a.lon - b.lon) * 111320.0 * cos(radians(a.lat)), 2) + power((a.lat - b.lat) * 110574.0, 2))) AS m FROM pixels a JOIN pixels b ON a.copy = 1 AND b.copy = 0 AND abs(a.lat - b.lat) < 2e-4 AND abs(a.lon - b.lon) < 2e-4 GROUP BY 1) SELECT count(*) AS n, round(median(m), 4) AS mid, round(max(m), 4) AS furthest, count(*) FILTER (m <= 3) AS same FROM d")
def j17_match_distances(spark, sf_dir):
    p = pixels(spark, sf_dir)
    near = SP.nearest(p.where("copy = 1"), p.where("copy = 0").select(F.col("key").alias("other"), "lat", "lon"), 1, 20.0)
    return near.agg(F.count("*").alias("n"), F.round(F.percentile("metres", 0.5), 4).alias("mid"), F.round(F.max("metres"), 4).alias("furthest"), F.count_if(F.col("metres") <= 3).alias("same"))


@query("SELECT o_orderkey, c_mktsegment AS segment, r_name AS region FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j19_attributes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "r_name")
    return o.join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", F.col("c_mktsegment").alias("segment"), F.col("r_name").alias("region"))


@query(f"WITH {PANEL_SQL} SELECT season, count(*) AS n, count(*) FILTER (year IN (1996, 1998, 1999)) AS listed, count(*) FILTER (buff_km <> 1) AS no_donut, count(*) FILTER (y IS NOT NULL AND n_obs > 1) AS observed FROM panel GROUP BY 1")
def f13_windows_and_donut(spark, sf_dir):
    return panel(spark, sf_dir).groupBy("season").agg(F.count("*").alias("n"), F.count_if(F.col("year").isin(1996, 1998, 1999)).alias("listed"), F.count_if(F.col("buff_km") != 1).alias("no_donut"), F.count_if(F.col("y").isNotNull() & (F.col("n_obs") > 1)).alias("observed"))


@query(f"WITH {PANEL_SQL} SELECT pixel_id, site_id || '-' || buff_km AS subwshed_id, year || '_' || season AS time_fe, CAST((season - 1) % 4 AS INT) AS season_rank, year * 10 + (season - 1) % 4 AS period_index FROM panel")
def f10_label_columns(spark, sf_dir):
    return panel(spark, sf_dir).select("pixel_id", F.concat_ws("-", "site_id", "buff_km").alias("subwshed_id"), F.concat_ws("_", "year", "season").alias("time_fe"), season_rank("season").cast("int").alias("season_rank"), (F.col("year") * 10 + season_rank("season")).alias("period_index"))


@query("SELECT p_partkey, CASE WHEN p_type LIKE '%STEEL%' THEN 'cereal' WHEN p_type LIKE '%COPPER%' THEN 'pulse' ELSE 'other' END AS crop FROM part")
def f26_crop_names(spark, sf_dir):
    # Words and the crop they stand for.
    words = {"STEEL": "cereal", "COPPER": "pulse"}
    crop = F.lit("other")
    for word, name in reversed(words.items()):
        crop = F.when(F.col("p_type").contains(word), name).otherwise(crop)
    return table(spark, sf_dir, "part").select("p_partkey", crop.alias("crop"))


@query(f"""WITH {BALANCED_SQL}, d AS (SELECT site_id, avg(y) FILTER (buff_km = 0 AND year < 1998) AS a, avg(y) FILTER (buff_km > 0 AND year < 1998) AS b FROM pb GROUP BY 1) SELECT count(*) FILTER (abs(a - b) > 0.5 * b) AS far, count(*) AS sites FROM d""")
def g5_site_screen(spark, sf_dir):
    pre, core = F.col("year") < 1998, F.col("buff_km") == 0
    d = balanced(spark, sf_dir).groupBy("site_id").agg(F.avg(F.when(pre & core, F.col("y"))).alias("a"), F.avg(F.when(pre & ~core, F.col("y"))).alias("b"))
    return d.agg(F.count_if(F.abs(F.col("a") - F.col("b")) > 0.5 * F.col("b")).alias("far"), F.count("*").alias("sites"))


@query(f"WITH {PANEL_SQL}, a AS (SELECT *, avg(n_obs) OVER (PARTITION BY pixel_id, year) AS filled FROM panel) SELECT pixel_id, year, season, round(coalesce(CASE WHEN season <> 3 THEN n_obs END, filled), 6) AS cov FROM a")
def g11_covariate_fill(spark, sf_dir):
    filled = F.avg("n_obs").over(Window.partitionBy("pixel_id", "year"))
    return panel(spark, sf_dir).select("pixel_id", "year", "season", F.round(F.coalesce(F.when(F.col("season") != 3, F.col("n_obs")).cast("double"), filled), 6).alias("cov"))


@query(f"WITH {PANEL_SQL}, f AS (SELECT count(*) FILTER (CAST(year >= 1998 AS INT) <> CAST(year >= 1998 + site_id % 3 AS INT)) AS differ, count(*) AS n FROM panel) SELECT * FROM f")
def g2_design_differences(spark, sf_dir):
    return panel(spark, sf_dir).agg(F.count_if((F.col("year") >= 1998) != (F.col("year") >= 1998 + F.col("site_id") % 3)).alias("differ"), F.count("*").alias("n"))


@query("SELECT DISTINCT l_partkey % 100 AS cell, l_suppkey % 10 AS ring FROM lineitem UNION ALL SELECT DISTINCT ps, 99 FROM (SELECT p_partkey % 100 AS ps FROM part)")
def o4_concat_distinct(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 100).alias("cell"), (F.col("l_suppkey") % 10).alias("ring")).dropDuplicates()
    b = table(spark, sf_dir, "part").select((F.col("p_partkey") % 100).alias("cell")).distinct().withColumn("ring", F.lit(99).cast("long"))
    return a.unionByName(b)
