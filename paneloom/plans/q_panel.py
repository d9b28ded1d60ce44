"""Queries of the rules of operators/panel.py, of treatment timing and of facts taken from finished panels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paneloom.functions import calendar as C
from paneloom.functions.pixels import name_key, pixel_id
from paneloom.operators import panel as P
from paneloom.operators import spatial as S
from paneloom.operators import timing as T
from paneloom.sources import exports as X
from paneloom.sources.tables import BALANCED_SQL, ORDERS_SQL, PANEL_SQL, PIXELS_SQL, balanced, orders_by_customer, panel, pixels, table, treated

from . import models as M
from .fe import twfe
from .q_audits import r4
from .q_joins import _BOXES_SQL, FUND_SQL, _boxes, fund
from .q_sources import _NAME, _STYLES
from .q_timing import _START
from .registry import query


@query(f"""WITH {ORDERS_SQL}, d AS (SELECT *, row_number() OVER (PARTITION BY pixel_id, year, season ORDER BY date DESC, order_id DESC) AS rn FROM orders_c), o AS (SELECT buff_km = 0 AS core, CASE WHEN order_id % 3 <> 0 THEN price END AS y1, CASE WHEN season <> 3 THEN price END AS y2 FROM d WHERE rn = 1)
SELECT core, count(*) FILTER (coalesce(y1, y2) IS NOT NULL) AS kept, count(*) FILTER (coalesce(y1, y2) IS NULL) AS dropped FROM o GROUP BY 1""")
def f4_usable_outcome(spark, sf_dir):
    newest = Window.partitionBy("pixel_id", "year", "season").orderBy(F.desc("date"), F.desc("order_id"))
    o = orders_by_customer(spark, sf_dir).withColumn("rn", F.row_number().over(newest)).where("rn = 1")
    o = o.withColumns({"y1": F.when(F.col("order_id") % 3 != 0, F.col("price")), "y2": F.when(F.col("season") != 3, F.col("price"))})
    ok = P.usable(o, ["y1", "y2"])
    return o.groupBy((F.col("buff_km") == 0).alias("core")).agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))


@query(f"WITH {ORDERS_SQL} SELECT year, count(*) FILTER (order_id % 4 = 0) AS filled, count(*) FILTER (order_id % 5 = 0) AS uncovered, count(*) FILTER (order_id % 4 <> 0 AND order_id % 5 > 0) AS kept FROM orders_c GROUP BY 1")
def f11_gap_filled(spark, sf_dir):
    filled, covered = F.col("order_id") % 4 == 0, F.col("order_id") % 5 > 0
    return orders_by_customer(spark, sf_dir).groupBy("year").agg(F.count_if(filled).alias("filled"), F.count_if(~covered).alias("uncovered"), F.count_if(~filled & covered).alias("kept"))


@query(f"""WITH {PANEL_SQL}, e AS (SELECT season, y FROM panel UNION ALL SELECT 0, avg(y) FROM panel GROUP BY pixel_id, year), m AS (SELECT unnest(['seasonal', 'yearly', 'all', '2']) AS mode)
SELECT mode, count(*) AS n, round(sum(y), 2) AS total FROM m JOIN e ON (mode = 'seasonal' AND season BETWEEN 1 AND 3) OR (mode = 'yearly' AND season = 0) OR mode = 'all' OR (mode = '2' AND season = 2) GROUP BY 1""")
def f12_season_modes(spark, sf_dir):
    p = panel(spark, sf_dir)
    every = p.select("season", "y").union(p.groupBy("pixel_id", "year").agg(F.lit(0).alias("season"), F.avg("y").alias("y")).select("season", "y"))
    modes = F.array_compact(F.array(*(F.when(P.season_mode(m), m) for m in ("seasonal", "yearly", "all", "2"))))
    return every.select(F.explode(modes).alias("mode"), "y").groupBy("mode").agg(F.count("*").alias("n"), F.round(F.sum("y"), 2).alias("total"))


@query(f"""WITH {PANEL_SQL}, a AS (SELECT *, pixel_id % 997 AS place FROM panel), b AS (SELECT *, CASE WHEN pixel_id % 13 = 0 THEN 2 WHEN site_id > 20 THEN 1 WHEN min(buff_km) OVER (PARTITION BY site_id, place) <> max(buff_km) OVER (PARTITION BY site_id, place) THEN 4 ELSE 0 END AS c0 FROM a),
c AS (SELECT *, CASE WHEN c0 = 0 AND buff_km > 0 AND EXISTS (SELECT 1 FROM b t WHERE t.c0 = 0 AND t.buff_km = 0 AND t.place = b.place AND t.site_id <> b.site_id) THEN 3 ELSE c0 END AS c1 FROM b),
d AS (SELECT *, CASE WHEN c1 = 0 AND row_number() OVER (PARTITION BY place, year, season ORDER BY c1 <> 0, buff_km, site_id, pixel_id) > 1 THEN 3 ELSE c1 END AS code FROM c)
SELECT CAST(code AS INT) AS code, code IN (0, 4) AS kept, count(*) AS n, count(DISTINCT pixel_id) AS pixels FROM d GROUP BY ALL""")
def f20_location_codes(spark, sf_dir):
    rows = panel(spark, sf_dir).withColumn("place", F.col("pixel_id") % 997)
    coded = P.location_codes(rows, F.col("site_id") <= 20, F.col("pixel_id") % 13 == 0)
    return coded.groupBy("code").agg(F.count("*").alias("n"), F.count_distinct("pixel_id").alias("pixels")).withColumn("kept", F.col("code").isin(0, 4))


_VISITS = "v AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS visit, o_orderdate AS d, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%m/%d/%Y') END AS t FROM orders)"


@query(f"""WITH {_VISITS}, p AS (SELECT *, CAST(t[1:2] AS INT) AS a, CAST(t[4:5] AS INT) AS b, CAST(t[7:10] AS INT) AS y FROM v), q AS (SELECT *, CASE WHEN b <= 12 THEN make_date(y, b, a) END AS df, CASE WHEN a <= 12 THEN make_date(y, a, b) END AS mf FROM p),
r AS (SELECT *, CASE WHEN df IS NULL OR mf IS NULL OR df = mf THEN coalesce(df, mf) END AS pl FROM q), s AS (SELECT *, last_value(pl IGNORE NULLS) OVER (PARTITION BY k ORDER BY visit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo, first_value(pl IGNORE NULLS) OVER (PARTITION BY k ORDER BY visit ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hi FROM r),
f AS (SELECT *, coalesce(df >= lo, true) AND coalesce(df <= hi, true) AS fd, coalesce(mf >= lo, true) AND coalesce(mf <= hi, true) AS fm FROM s), h AS (SELECT *, CASE WHEN pl IS NOT NULL THEN 'plain' WHEN fd AND NOT fm THEN 'day first' WHEN fm AND NOT fd THEN 'month first' ELSE 'open' END AS read FROM f)
SELECT read, count(*) AS n, count(*) FILTER (CASE read WHEN 'plain' THEN pl WHEN 'month first' THEN mf ELSE df END = d) AS n_right FROM h GROUP BY 1""")
def f25_dates_in_order(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("d", "dd/MM/yyyy")).otherwise(F.date_format("d", "MM/dd/yyyy"))
    v = o.withColumns({"visit": F.row_number().over(Window.partitionBy("k").orderBy("d", "o_orderkey")), "t": text})
    return P.dates_in_order(v, "k", "visit", "t").groupBy("read").agg(F.count("*").alias("n"), F.count_if(F.col("date") == F.col("d")).alias("n_right"))


_HEADED = f"h AS (SELECT DISTINCT l_returnflag || l_linestatus AS src_file, l_linenumber AS position, {_STYLES} AS header FROM lineitem WHERE NOT (l_linenumber = 5 AND l_returnflag = 'A')), c AS (SELECT *, CASE position WHEN 1 THEN 'NDVI' WHEN 2 THEN 'NDVI' WHEN 3 THEN 'Rain' WHEN 5 THEN 'longitude' WHEN 6 THEN 'Tmax' END AS canonical FROM h)"


def _resolved(spark, sf_dir):
    """Headers of one file for each flag and status, with their canonical names."""
    li = table(spark, sf_dir, "lineitem").where("NOT (l_linenumber = 5 AND l_returnflag = 'A')")
    h = li.select(F.concat("l_returnflag", "l_linestatus").alias("src_file"), F.col("l_linenumber").alias("position"), F.expr(_STYLES).alias("header")).distinct()
    return h.join(X.resolved_headers(h), "header")


@query(f"WITH {_HEADED} SELECT src_file, CAST(position AS INT) AS position, CASE WHEN row_number() OVER (PARTITION BY src_file, canonical ORDER BY position) = 1 THEN canonical ELSE canonical || '__dup_' || regexp_replace(lower(header), '[^a-z0-9]+', '', 'g') END AS name FROM c WHERE canonical IS NOT NULL")
def s9_guarded_names(spark, sf_dir):
    return P.guarded_names(_resolved(spark, sf_dir)).select("src_file", F.col("position").cast("int").alias("position"), "name")


@query(f"WITH {_HEADED}, w AS (SELECT DISTINCT src_file, w FROM c CROSS JOIN (SELECT unnest(['longitude', 'EVI', 'NDVI', 'Tmin']) AS w)), m AS (SELECT w.src_file, w.w, EXISTS (SELECT 1 FROM c WHERE c.src_file = w.src_file AND c.canonical = w.w) AS has FROM w), k AS (SELECT src_file, bool_or(header = 'comment') AS marked FROM c GROUP BY 1) SELECT m.src_file, bool_or(NOT has AND w = 'longitude') AS rejected, string_agg(w, ',' ORDER BY w) FILTER (NOT has) AS missing_source_cols, CASE WHEN any_value(marked) THEN 'v2' ELSE 'v1' END AS schema_vintage FROM m JOIN k USING (src_file) GROUP BY 1")
def s11_provenance(spark, sf_dir):
    """Files without an essential column are rejected; what each lacks is named (also S10)."""
    return P.provenance(_resolved(spark, sf_dir), ("longitude",), ("EVI", "NDVI", "Tmin"), "comment")


@query(f"WITH {_HEADED} SELECT header, count(DISTINCT src_file) AS n_files FROM c WHERE canonical IS NULL AND header <> 'NDVI_sd' GROUP BY 1")
def s12_unresolved_headers(spark, sf_dir):
    return _resolved(spark, sf_dir).where("rule = 'unresolved'").groupBy("header").agg(F.count_distinct("src_file").alias("n_files"))


@query(f"WITH {ORDERS_SQL}, k AS (SELECT *, CASE WHEN order_id % 5 IN (0, 1, 3) THEN year END AS ny, CASE order_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 0 END AS ns, CASE WHEN order_id % 11 <> 0 THEN year END AS cy, CASE WHEN order_id % 7 = 0 THEN NULL ELSE season END AS cs FROM orders_c), r AS (SELECT coalesce(ny, cy) AS y, coalesce(ns, cs) AS s FROM k) SELECT y IS NULL OR s IS NULL AS rejected, CAST(y AS INT) AS year, CAST(s AS INT) AS season, count(*) AS n FROM r GROUP BY ALL")
def s7_year_season(spark, sf_dir):
    """The name's year and season win over the columns; rows of files with neither are rejected."""
    o = orders_by_customer(spark, sf_dir).withColumn("k", X.file_keys(F.expr(_NAME)))
    words = F.create_map(*(F.lit(x) for kv in {"kharif": 1, "rabi": 2, "zaid": 3}.items() for x in kv))
    said = F.when(F.col("order_id") % 7 != 0, F.element_at(F.array(*map(F.lit, ("Kharif", "RABI", "zaid"))), F.col("season")))
    y = F.coalesce("k.year", F.when(F.col("order_id") % 11 != 0, F.col("year")))
    s = F.coalesce("k.season", F.try_element_at(words, F.lower(said)))
    return o.select(y.cast("int").alias("year"), s.cast("int").alias("season")).groupBy((F.col("year").isNull() | F.col("season").isNull()).alias("rejected"), "year", "season").agg(F.count("*").alias("n"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, sum(o_orderkey) AS keys FROM orders WHERE o_orderkey % 3 <> 0")
def s2_own_products(spark, sf_dir):
    """Orders written as two exports and one panel of this product; the panel's files are left when the folder is read."""
    import uuid

    from paneloom.sources.staging import shared_dir

    folder = f"{shared_dir(spark)}/paneloom/exports-{uuid.uuid4().hex}"
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    o.where("k % 3 = 0").selectExpr("k AS pixel_id", "1 AS did_term", "'v2' AS schema_vintage").write.option("header", True).csv(f"{folder}/panel")
    o.where("k % 3 = 1").selectExpr("k AS pixel_id", "1 AS NDVI").write.option("header", True).csv(f"{folder}/a")
    o.where("k % 3 = 2").selectExpr("k AS pixel_id", "2 AS did_term").write.option("header", True).csv(f"{folder}/b")
    own = P.own_products(X.header_rows(spark, folder))
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(folder).select("value", F.col("_metadata.file_path").alias("src_file"))
    rows = lines.join(own, "src_file", "left_anti").select(F.get(F.split("value", ","), F.lit(0)).try_cast("long").alias("k")).where("k IS NOT NULL")
    return rows.agg(F.count("*").alias("n"), F.sum("k").alias("keys"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN n_name END AS site FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def s13_site_of_path(spark, sf_dir):
    """The site's name in a file's path, met with the registry by its normalised key."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.when(F.col("o_orderkey") % 4 == 0, "unnamed").otherwise(F.initcap(F.replace("n_name", F.lit(" "), F.lit("_"))))
    path = F.concat(F.lit("/in/2019/CSV_"), name, F.lit("_"), F.year("o_orderdate"), F.lit("_Rabi.csv"))
    key = name_key(F.regexp_extract(path, r"/CSV_(\w+)_\d{4}_[^/]*$", 1)).alias("key")
    return o.select("o_orderkey", key).join(n.select(name_key("n_name").alias("key"), F.col("n_name").alias("site")), "key", "left").select("o_orderkey", "site")


@query("SELECT CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE 'k' || o_orderkey END AS key, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE CAST(floor(o_totalprice) AS DOUBLE) END AS value, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS status FROM orders")
def s16_type_conflicts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value"), F.col("o_orderstatus").alias("status"))
    b = o.where("o_orderkey % 2 <> 0").select(F.concat(F.lit("k"), F.col("o_orderkey")).alias("key"), F.floor("o_totalprice").alias("value"))
    return P.union_parts([a, b])


@query(f"WITH {FUND_SQL}, n AS (SELECT n_nationkey + 1 AS site_id, n_name FROM nation) SELECT site_id, month, round(amount_reported / target, 6) AS progress, target, CAST(site_id * 10 AS DOUBLE) AS area FROM fund JOIN n USING (site_id)")
def t1_fund_rows(spark, sf_dir):
    """Reports under a site's written name become rows of (site, month, progress, target, area)."""
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("site_id"), F.col("n_name").alias("name"))
    written = fund(spark, sf_dir).join(n, "site_id").select(F.concat(F.lit(" "), F.initcap("name"), F.lit(".")).alias("written"), "month", "amount_reported", "target")
    known = n.select(name_key("name").alias("key"), "site_id")
    return written.withColumn("key", name_key("written")).join(known, "key").select("site_id", "month", F.round(F.col("amount_reported") / F.col("target"), 6).alias("progress"), "target", (F.col("site_id") * 10.0).alias("area"))


_FIRST = _START + """, i AS (SELECT site_id, m0 - back + 1 AS m FROM b), j AS (SELECT site_id, CAST(m % 12 + 1 AS INT) AS mo, CAST(floor(m / 12) AS INT) AS cy FROM i), k AS (SELECT site_id, CASE WHEN mo BETWEEN 6 AND 9 THEN 1 WHEN mo BETWEEN 3 AND 5 THEN 3 ELSE 2 END AS s, CASE WHEN mo <= 2 THEN cy - 1 ELSE cy END AS y FROM j),
first AS (SELECT site_id, CAST(CASE WHEN s = 3 THEN y + 1 ELSE y END AS INT) AS year, CAST(CASE WHEN s = 3 THEN 1 ELSE s + 1 END AS INT) AS season FROM k)"""


def _first_treated(spark, sf_dir):
    start = T.start_month(fund(spark, sf_dir), amount="amount_reported")
    day = F.make_date(F.floor(F.col("start_month") / 12).cast("int"), (F.col("start_month") % 12 + 1).cast("int"), F.lit(1))
    return start.select("site_id", C.next_season(C.season_year(day), C.season_of(day)).alias("n")).select("site_id", F.col("n.year").alias("year"), F.col("n.season").alias("season"))


@query(_FIRST + " SELECT site_id, year, season, year + CAST(season = 2 AS INT) AS annual_cohort FROM first")
def t3_first_treated(spark, sf_dir):
    return _first_treated(spark, sf_dir).withColumn("annual_cohort", F.col("year") + (F.col("season") == 2).cast("int"))


@query(f"""{_FIRST}, {PANEL_SQL}, d AS (SELECT p.*, f.year AS fy, f.season AS fs FROM panel p JOIN first f USING (site_id)), t AS (SELECT unnest(['fund', 'registry', 'fixed']) AS timing)
SELECT timing, count(*) FILTER (buff_km = 0 AND CASE timing WHEN 'fund' THEN 3 * year + season >= 3 * fy + fs WHEN 'registry' THEN year >= 1998 + site_id % 3 ELSE year >= 1998 END) AS treated_rows, count(*) FILTER (CASE timing WHEN 'fund' THEN 3 * year + season >= 3 * fy + fs WHEN 'registry' THEN year >= 1998 + site_id % 3 ELSE year >= 1998 END) AS post_rows, count(*) AS n FROM d CROSS JOIN t GROUP BY 1""")
def g1_design_by_timing(spark, sf_dir):
    """Design columns of each timing: the fund's first treated season, the registry's year, or one fixed year."""
    first = _first_treated(spark, sf_dir).withColumnsRenamed({"year": "fy", "season": "fs"})
    p = panel(spark, sf_dir).join(first, "site_id")
    post = {"fund": 3 * F.col("year") + F.col("season") >= 3 * F.col("fy") + F.col("fs"), "registry": F.col("year") >= 1998 + F.col("site_id") % 3, "fixed": F.col("year") >= 1998}
    long = p.select("buff_km", F.explode(F.array(*(F.struct(F.lit(k).alias("timing"), v.alias("post")) for k, v in post.items()))).alias("d")).select("buff_km", "d.*")
    return long.groupBy("timing").agg(F.count_if(F.col("post") & (F.col("buff_km") == 0)).alias("treated_rows"), F.count_if("post").alias("post_rows"), F.count("*").alias("n"))


@query(f"WITH {_BOXES_SQL} SELECT CAST(polygon AS INT) AS polygon, count(*) AS n, round(avg(value) + 1e-7, 4) AS value FROM inside JOIN (SELECT key * 2 + copy AS key, value FROM pixels) USING (key) GROUP BY 1")
def j14_pixels_of_polygons(spark, sf_dir):
    p = pixels(spark, sf_dir).select((F.col("key") * 2 + F.col("copy")).alias("key"), "lat", "lon", "value")
    held = S.in_polygon(p, _boxes(spark, sf_dir)).join(p.select("key", "value"), "key")
    return held.groupBy(F.col("polygon").cast("int").alias("polygon")).agg(F.count("*").alias("n"), r4(F.avg("value")).alias("value"))


_LATER = """later AS (SELECT key, lat + CASE WHEN key % 5 = 0 THEN 5e-5 ELSE 1.2e-5 END AS lat, lon FROM pixels WHERE copy = 0), base AS (SELECT key AS other, lat, lon FROM pixels WHERE copy = 0),
dist AS (SELECT l.key, l.lat, l.lon, other, sqrt(power((l.lon - b.lon) * 111320.0 * cos(radians(l.lat)), 2) + power((l.lat - b.lat) * 110574.0, 2)) AS metres FROM later l JOIN base b ON abs(l.lat - b.lat) < 2e-4 AND abs(l.lon - b.lon) < 2e-4)"""


def _later(spark, sf_dir):
    p = pixels(spark, sf_dir).where("copy = 0")
    return p.select("key", (F.col("lat") + F.when(F.col("key") % 5 == 0, 5e-5).otherwise(1.2e-5)).alias("lat"), "lon"), p.select(F.col("key").alias("other"), "lat", "lon")


@query(f"WITH {PIXELS_SQL}, {_LATER}, n AS (SELECT key, arg_min(other, round(metres, 6) * 1e9 + other) AS other FROM dist WHERE metres <= 3 GROUP BY 1) SELECT l.key, coalesce(other, CAST(rint((lat + 90) * 1e5) AS BIGINT) * 1000000000 + CAST(rint((lon + 180) * 1e5) AS BIGINT)) AS pixel, other IS NOT NULL AS known FROM later l LEFT JOIN n USING (key)".replace("rint(", "round_even(").replace("* 1e5)", "* 1e5, 0)"))
def j18_registry_identity(spark, sf_dir):
    """A point within 3 m of a registered pixel is that pixel; others get the number of their coordinates."""
    later, base = _later(spark, sf_dir)
    near = S.nearest(later, base, 1, 3.0).select("key", "other")
    return later.join(near, "key", "left").select("key", F.coalesce("other", pixel_id("lat", "lon")).alias("pixel"), F.col("other").isNotNull().alias("known"))


@query(f"WITH {PIXELS_SQL}, {_LATER}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round(metres, 6), other) AS rn FROM dist) SELECT key, other, round(metres, 4) AS metres FROM r WHERE rn = 1")
def j20_shifted_grid(spark, sf_dir):
    from paneloom.sources.staging import staged

    later, base = _later(spark, sf_dir)
    near = S.nearest_exact(later, base, 1, 15.0, staged)
    return near.select("key", "other", F.round("metres", 4).alias("metres"))


@query(f"WITH {PANEL_SQL}, a AS (SELECT site_id, pixel_id, season, avg(y) AS y FROM panel WHERE y BETWEEN 1000 AND 400000 GROUP BY ALL) SELECT site_id, season, count(*) AS n, round(avg(y) + 1e-5, 2) AS mean FROM a GROUP BY ALL")
def a28_site_means(spark, sf_dir):
    """Points' means within bounds first (also S20), then the means of these by site and season."""
    a = panel(spark, sf_dir).where("y BETWEEN 1000 AND 400000").groupBy("site_id", "pixel_id", "season").agg(F.avg("y").alias("y"))
    return a.groupBy("site_id", "season").agg(F.count("*").alias("n"), F.round(F.avg("y") + 1e-5, 2).alias("mean"))


_READY = [("static", "cells = 4"), ("event", "pre_years >= 2 AND post_years >= 1"), ("staggered", "sites >= 3"), ("pretrend", "pre_years >= 3"), ("bootstrap", "sites >= 12"), ("iv", "false")]


@query(f"WITH {PANEL_SQL}, f AS (SELECT count(DISTINCT CAST(buff_km = 0 AS INT) * 2 + CAST(year >= 1998 AS INT)) AS cells, count(DISTINCT year) FILTER (year < 1998) AS pre_years, count(DISTINCT year) FILTER (year >= 1998) AS post_years, count(DISTINCT site_id) FILTER (buff_km = 0) AS sites FROM panel) " + " UNION ALL ".join(f"SELECT '{m}' AS model, '{r}' AS needs, {r} AS ready FROM f" for m, r in _READY))
def a32_readiness(spark, sf_dir):
    """Facts from one pass over the panel, and each model's verdict."""
    early = F.col("year") < 1998
    facts = panel(spark, sf_dir).agg(F.count_distinct((F.col("buff_km") == 0).cast("int") * 2 + (~early).cast("int")).alias("cells"), F.count_distinct(F.when(early, F.col("year"))).alias("pre_years"), F.count_distinct(F.when(~early, F.col("year"))).alias("post_years"), F.count_distinct(F.when(F.col("buff_km") == 0, F.col("site_id"))).alias("sites"))
    return facts.select(F.inline(F.array(*(F.struct(F.lit(m).alias("model"), F.lit(r).alias("needs"), F.expr(r).alias("ready")) for m, r in _READY))))


@query("WITH s AS (SELECT l_returnflag AS source, l_extendedprice AS a, l_extendedprice * (1 - l_discount) AS b FROM lineitem) SELECT source, count(*) AS n, round(corr(a, b), 6) AS r, round(avg(a - b), 4) AS bias, round(sqrt(avg((a - b) * (a - b))), 4) AS rmse FROM s GROUP BY 1")
def a36_paired_sources(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("source"), F.col("l_extendedprice").alias("a"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("b"))
    return P.agreement(pairs, ["source"], "a", "b").select("source", "n", F.round("r", 6).alias("r"), F.round("bias", 4).alias("bias"), F.round("rmse", 4).alias("rmse"))


@query(f"""WITH {PANEL_SQL}, s AS (SELECT pixel_id, year, -y / 1e5 - 5 AS vv, -y / 1e5 - 11 - season AS vh FROM panel), b AS (SELECT pixel_id, year, least(greatest(150 + 2 * vv + 1.5 * vh + 0.5 * (vv - vh), 0), 140) AS agb FROM s), g AS (SELECT pixel_id, unnest(range(1993, 2000)) AS year FROM (SELECT DISTINCT pixel_id FROM panel)),
own AS (SELECT pixel_id, year, sum(agb) AS t, count(*) AS n FROM b GROUP BY ALL), w AS (SELECT g.pixel_id, g.year, sum(t) FILTER (own.year = g.year) / sum(n) FILTER (own.year = g.year) AS exact, sum(t) / sum(n) AS wide FROM g LEFT JOIN own ON own.pixel_id = g.pixel_id AND own.year BETWEEN g.year - 1 AND g.year + 1 GROUP BY ALL)
SELECT pixel_id, CAST(year AS INT) AS year, round(coalesce(exact, wide), 4) AS agb, exact IS NULL AND wide IS NOT NULL AS widened FROM w""")
def x25_sar_biomass(spark, sf_dir):
    """Linear in VV, VH and their difference, clamped; a year without scenes takes those of the years beside it."""
    p = panel(spark, sf_dir)
    vv, vh = -F.col("y") / 1e5 - 5, -F.col("y") / 1e5 - 11 - F.col("season")
    b = p.select("pixel_id", "year", F.least(F.greatest(150 + 2 * vv + 1.5 * vh + 0.5 * (vv - vh), F.lit(0.0)), F.lit(140.0)).alias("agb"))
    own = b.groupBy("pixel_id", "year").agg(F.sum("agb").alias("t"), F.count("*").alias("n"))
    # each year's sum is sent to the three years that may use it: no range join
    sent = own.select("pixel_id", F.explode(F.array(*((F.col("year") + i) for i in (-1, 0, 1)))).alias("to"), "year", "t", "n")
    near = sent.groupBy("pixel_id", F.col("to").alias("year")).agg(*(F.sum(F.when(F.col("year") == F.col("to"), F.col(c))).alias(f"{c}0") for c in "tn"), F.sum("t").alias("t"), F.sum("n").alias("n"))
    grid = p.select("pixel_id").distinct().withColumn("year", F.explode(F.sequence(F.lit(1993), F.lit(1999))))
    exact, wide = F.col("t0") / F.col("n0"), F.col("t") / F.col("n")
    return grid.join(near, ["pixel_id", "year"], "left").select("pixel_id", "year", F.round(F.coalesce(exact, wide), 4).alias("agb"), (exact.isNull() & wide.isNotNull()).alias("widened"))


@query(f"""WITH {PANEL_SQL}, t AS (SELECT avg(y) AS m, count(*) AS n FROM panel WHERE buff_km = 0 AND year < 1998), c AS (SELECT buff_km, count(*) AS n, abs(avg(y) - any_value(m)) AS gap, any_value(t.n) AS nt FROM panel CROSS JOIN t WHERE buff_km > 0 AND year < 1998 GROUP BY 1),
r AS (SELECT *, row_number() OVER w AS place, sum(n) OVER w AS cumulative FROM c WINDOW w AS (ORDER BY gap, buff_km)) SELECT buff_km, CAST(place AS INT) AS place, CAST(cumulative AS BIGINT) AS cumulative, cumulative - n < 2 * nt AS picked FROM r""")
def w9_picked_rings(spark, sf_dir):
    """Control rings from the closest before treatment on, until they have twice the treated rows."""
    pre = panel(spark, sf_dir).where("year < 1998")
    t = pre.where("buff_km = 0").agg(F.avg("y").alias("m"), F.count("*").alias("nt"))
    c = pre.where("buff_km > 0").groupBy("buff_km").agg(F.count("*").alias("n"), F.avg("y").alias("own")).join(F.broadcast(t))  # one row
    out = P.picked_until(c.withColumn("gap", F.abs(F.col("own") - F.col("m"))), ["gap", "buff_km"], "n", 2 * F.col("nt"))
    return out.select("buff_km", "place", "cumulative", "picked")


_GROUPS = f"WITH {BALANCED_SQL}, m AS (SELECT segment, avg(y) FILTER (buff_km = 0 AND year >= 1998) - avg(y) FILTER (buff_km = 0 AND year < 1998) - avg(y) FILTER (buff_km > 0 AND year >= 1998) + avg(y) FILTER (buff_km > 0 AND year < 1998) AS did FROM pb GROUP BY 1)"


def _by_segment(spark, sf_dir):
    return M.static_twfe(treated(balanced(spark, sf_dir)), keys=("segment",), key_types="segment string")


@query(_GROUPS + " SELECT segment, round(did + 1e-7, 4) AS regression, round(did + 1e-7, 4) AS means, true AS agree FROM m")
def d6_two_engines(spark, sf_dir):
    """The regression's estimates beside those of cell means, which are equal on a balanced panel, within a tolerance."""
    one = _by_segment(spark, sf_dir).select("segment", F.col("estimate").alias("a"))
    core, late = F.col("buff_km") == 0, F.col("year") >= 1998
    mean = lambda c: F.avg(F.when(c, F.col("y")))
    two = balanced(spark, sf_dir).groupBy("segment").agg((mean(core & late) - mean(core & ~late) - mean(~core & late) + mean(~core & ~late)).alias("b"))
    return one.join(two, "segment").select("segment", r4(F.col("a")).alias("regression"), r4(F.col("b")).alias("means"), (F.abs(F.col("a") - F.col("b")) <= 1e-6 * F.greatest(F.lit(1.0), F.abs("b"))).alias("agree"))


@query(f"WITH {BALANCED_SQL}, w AS (SELECT *, CAST(1 + site_id % 3 AS DOUBLE) AS w, CAST(buff_km = 0 AND year >= 1998 AS INT) AS x FROM pb), u AS (SELECT *, y - avg(y) OVER (PARTITION BY unit) AS yu, x - avg(x) OVER (PARTITION BY unit) AS xu FROM w), z AS (SELECT w, yu - sum(w * yu) OVER (PARTITION BY year) / sum(w) OVER (PARTITION BY year) AS yy, xu - sum(w * xu) OVER (PARTITION BY year) / sum(w) OVER (PARTITION BY year) AS xx FROM u) SELECT round(sum(w * xx * yy) / sum(w * xx * xx) + 1e-7, 4) AS estimate FROM z")
def b1_weighted(spark, sf_dir):
    p = treated(balanced(spark, sf_dir)).withColumn("w", (1 + F.col("site_id") % 3).cast("double"))
    fit = twfe(p, "y", ["did_term"], "unit", "year", "site_id", weight="w")[()]
    return spark.createDataFrame([(float(fit.beta[0]),)], "estimate double").select(r4(F.col("estimate")).alias("estimate"))


@query(_GROUPS + " SELECT DISTINCT 'did_term' AS term, count(*) AS n, count(*) FILTER (did IS NULL) AS failed FROM m")
def a33_run_audit(spark, sf_dir):
    a = P.audited(_by_segment(spark, sf_dir))
    return a.groupBy("term").agg(F.count("*").alias("n"), F.count_if(F.col("status").isin("failed", "no se", "bad p")).alias("failed"))
