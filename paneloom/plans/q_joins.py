"""Queries of joins: names, keys, space and time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paneloom.operators import joins as J
from paneloom.operators import spatial as S
from paneloom.sources.staging import staged
from paneloom.sources.tables import ORDERS_SQL, PANEL_SQL, PIXELS_SQL, orders_by_customer, panel, pixels, table

from .registry import query


@query("SELECT n_name AS name, r_name AS region FROM nation LEFT JOIN region ON regexp_replace(lower(r_name), '[^a-z0-9]+', '', 'g') = regexp_replace(lower(CASE n_regionkey WHEN 0 THEN ' africa ' WHEN 1 THEN 'AMERICA.' WHEN 2 THEN 'A-S-I-A' ELSE n_name END), '[^a-z0-9]+', '', 'g')")
def j1_name_join(spark, sf_dir):
    loose = F.expr("CASE n_regionkey WHEN 0 THEN ' africa ' WHEN 1 THEN 'AMERICA.' WHEN 2 THEN 'A-S-I-A' ELSE n_name END")
    nations = table(spark, sf_dir, "nation").withColumn("written", loose)
    return J.by_name(nations, table(spark, sf_dir, "region"), "written", "r_name").select(F.col("n_name").alias("name"), F.col("r_name").alias("region"))


@query("SELECT c_mktsegment AS segment, o_orderpriority AS priority, round(avg(CASE WHEN year(o_orderdate) < 1998 THEN o_totalprice END), 4) AS pre, round(avg(CASE WHEN year(o_orderdate) >= 1998 THEN o_totalprice END), 4) AS post FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def j2_pre_post(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    early = F.year("o_orderdate") < 1998
    return o.groupBy(F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority")).agg(F.round(F.avg(F.when(early, F.col("o_totalprice"))), 4).alias("pre"), F.round(F.avg(F.when(~early, F.col("o_totalprice"))), 4).alias("post"))


@query("""WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE year(o_orderdate) = 1999 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS o_custkey, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right, CASE WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only' ELSE 'both' END AS side FROM a FULL JOIN b ON a.k = b.k""")
def j3_reconcile(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    return J.reconciled(o.where("year = 1996"), o.where("year = 1999"), ["o_custkey"])


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AS large FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def j4_semi_anti(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey")
    on = F.col("c_custkey") == F.col("o_custkey")
    kept = c.join(o, on, "left_semi").join(o.where("o_orderpriority = '1-URGENT'"), on, "left_anti")
    large = o.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("large", F.lit(True))
    return kept.join(large, "c_custkey", "left").select("c_custkey", F.coalesce("large", F.lit(False)).alias("large"))


def _boxes(spark, sf_dir):
    """A box of four edges for each nation, and a hole in its middle."""
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation").select((k + 1).alias("polygon"), (15 + k * 1.6e-4 - 2e-5).alias("y0"), (15 + (k + 1) * 1.6e-4 + 3e-5).alias("y1"), F.lit(75.0005).alias("x0"), F.lit(75.0035).alias("x1"))
    hole = n.select("polygon", (F.col("y0") + 6e-5).alias("y0"), (F.col("y1") - 6e-5).alias("y1"), (F.col("x0") + 1e-3).alias("x0"), (F.col("x1") - 1e-3).alias("x1"))
    corners = F.array(*(F.struct(F.col(a).alias("x1"), F.col(b).alias("y1"), F.col(c).alias("x2"), F.col(d).alias("y2")) for a, b, c, d in (("x0", "y0", "x1", "y0"), ("x1", "y0", "x1", "y1"), ("x1", "y1", "x0", "y1"), ("x0", "y1", "x0", "y0"))))
    return n.union(hole).select("polygon", F.inline(corners))


_BOXES_SQL = PIXELS_SQL + """, boxes AS (SELECT n_nationkey + 1 AS polygon, 15 + n_nationkey * 1.6e-4 - 2e-5 AS y0, 15 + (n_nationkey + 1) * 1.6e-4 + 3e-5 AS y1, 75.0005 AS x0, 75.0035 AS x1 FROM nation),
inside AS (SELECT key * 2 + copy AS key, site_id, polygon FROM pixels JOIN boxes ON lat >= y0 AND lat < y1 AND lon >= x0 AND lon < x1 AND NOT (lat >= y0 + 6e-5 AND lat < y1 - 6e-5 AND lon >= x0 + 1e-3 AND lon < x1 - 1e-3))"""


@query(f"WITH {_BOXES_SQL} SELECT key, CAST(polygon AS INT) AS polygon FROM inside")
def j5_point_in_polygon(spark, sf_dir):
    points = pixels(spark, sf_dir).select((F.col("key") * 2 + F.col("copy")).alias("key"), "lat", "lon")
    return S.in_polygon(points, _boxes(spark, sf_dir)).withColumn("polygon", F.col("polygon").cast("int"))


@query(f"""WITH {_BOXES_SQL}, held AS (SELECT key, min(polygon) AS lowest, bool_or(polygon = site_id) AS own FROM inside GROUP BY key)
SELECT p.key * 2 + p.copy AS key, p.site_id, CAST(CASE WHEN own THEN p.site_id ELSE lowest END AS INT) AS tagged, CASE WHEN lowest IS NULL THEN 'outside' WHEN own THEN 'confirmed' ELSE 'corrected' END AS site_check
FROM pixels p LEFT JOIN held h ON h.key = p.key * 2 + p.copy""")
def j5_site_tags(spark, sf_dir):
    p = pixels(spark, sf_dir).select((F.col("key") * 2 + F.col("copy")).alias("key"), "site_id", "lat", "lon")
    held = S.in_polygon(p, _boxes(spark, sf_dir)).join(p.select("key", "site_id"), "key")
    held = held.groupBy("key").agg(F.min("polygon").alias("lowest"), F.max(F.col("polygon") == F.col("site_id")).alias("own"))
    j = p.join(held, "key", "left")
    check = F.when(F.col("lowest").isNull(), "outside").when(F.col("own"), "confirmed").otherwise("corrected")
    return j.select("key", "site_id", F.when(F.col("own"), F.col("site_id")).otherwise(F.col("lowest")).cast("int").alias("tagged"), check.alias("site_check"))


@query(f"""WITH {PANEL_SQL}, t AS (SELECT pixel_id, site_id, year, season, y, CAST(pixel_id % 40 AS INT) AS cell, buff_km FROM panel), tr AS (SELECT DISTINCT cell, site_id FROM t WHERE buff_km = 0)
SELECT count(*) AS n, count(*) FILTER (buff_km > 0 AND EXISTS (SELECT 1 FROM tr WHERE tr.cell = t.cell AND tr.site_id <> t.site_id)) AS code3 FROM t""")
def j6_cross_site(spark, sf_dir):
    t = panel(spark, sf_dir).withColumn("cell", F.col("pixel_id") % 40)
    sites = t.where("buff_km = 0").groupBy("cell").agg(F.min("site_id").alias("lo"), F.max("site_id").alias("hi"))  # another site is there if one end differs
    j = t.join(sites, "cell", "left")
    code3 = (F.col("buff_km") > 0) & ((F.col("lo") != F.col("site_id")) | (F.col("hi") != F.col("site_id")))
    return j.agg(F.count("*").alias("n"), F.count_if(code3).alias("code3"))


@query(f"""WITH {PANEL_SQL} SELECT cell, year, season, pixel_id, site_id, buff_km FROM (SELECT *, pixel_id % 97 AS cell, row_number() OVER (PARTITION BY pixel_id % 97, year, season ORDER BY buff_km, site_id, pixel_id) AS rn FROM panel) WHERE rn = 1""")
def j7_nearest_ring(spark, sf_dir):
    w = Window.partitionBy("cell", "year", "season").orderBy("buff_km", "site_id", "pixel_id")
    return panel(spark, sf_dir).withColumn("cell", F.col("pixel_id") % 97).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("cell", "year", "season", "pixel_id", "site_id", "buff_km")


_NODES = PIXELS_SQL + ", nodes AS (SELECT key * 2 + copy AS node, lat, lon, priority FROM pixels)"
_OVERLAP = "(1 - abs(a.lon - b.lon) * 111320.0 * cos(radians((a.lat + b.lat) / 2)) / 10.0) * (1 - abs(a.lat - b.lat) * 110574.0 / 10.0)"
_PAIRS = _NODES + f""", pairs AS (SELECT a.node AS a, b.node AS b, {_OVERLAP} AS overlap FROM nodes a JOIN nodes b ON a.node < b.node
AND abs(a.lon - b.lon) * 111320.0 * cos(radians((a.lat + b.lat) / 2)) < 10 AND abs(a.lat - b.lat) * 110574.0 < 10 WHERE {_OVERLAP} >= 0.65)"""


def _nodes(spark, sf_dir):
    return pixels(spark, sf_dir).select((F.col("key") * 2 + F.col("copy")).alias("node"), "lat", "lon", "priority")


@query(f"WITH {_PAIRS} SELECT a, b, round(overlap, 6) AS overlap FROM pairs")
def j8_overlap_pairs(spark, sf_dir):
    return S.overlap_pairs(_nodes(spark, sf_dir), "node").select("a", "b", F.round("overlap", 6).alias("overlap"))


@query(f"""WITH {_PAIRS} SELECT n.node, n.canonical FROM (SELECT CASE WHEN pa.priority > pb.priority OR (pa.priority = pb.priority AND a < b) THEN b ELSE a END AS node,
CASE WHEN pa.priority > pb.priority OR (pa.priority = pb.priority AND a < b) THEN a ELSE b END AS canonical FROM pairs JOIN nodes pa ON pa.node = a JOIN nodes pb ON pb.node = b) n""")
def j9_canonical_map(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    rank = nodes.select("node", F.struct((-F.col("priority")).alias("p"), F.col("node").alias("n")).alias("place"))
    return S.canonical_map(S.overlap_pairs(nodes, "node"), rank, staged)


@query(f"""WITH {_PAIRS}, m AS (SELECT CASE WHEN pa.priority > pb.priority OR (pa.priority = pb.priority AND a < b) THEN b ELSE a END AS node,
CASE WHEN pa.priority > pb.priority OR (pa.priority = pb.priority AND a < b) THEN a ELSE b END AS canonical FROM pairs JOIN nodes pa ON pa.node = a JOIN nodes pb ON pb.node = b)
SELECT coalesce(canonical, n.node) AS pixel, count(*) AS rows FROM nodes n LEFT JOIN m USING (node) GROUP BY 1""")
def j10_apply_map(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    rank = nodes.select("node", F.struct((-F.col("priority")).alias("p"), F.col("node").alias("n")).alias("place"))
    found = S.canonical_map(S.overlap_pairs(nodes, "node"), rank, staged)
    return nodes.join(found, "node", "left").groupBy(F.coalesce("canonical", "node").alias("pixel")).agg(F.count("*").alias("rows"))


_FUND_SQL = """months AS (SELECT c_nationkey + 1 AS site_id, 12 * year(o_orderdate) + month(o_orderdate) - 1 AS month, sum(o_totalprice) AS paid FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
fund AS (SELECT site_id, month, sum(paid) OVER (PARTITION BY site_id ORDER BY month) - CASE WHEN month % 7 = 0 THEN 500000 ELSE 0 END AS amount_reported, 40000000.0 AS target FROM months)"""


def fund(spark, sf_dir):
    """A monthly series of cumulative amounts a site, with downward revisions every seventh month."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    month = 12 * F.year("o_orderdate") + F.month("o_orderdate") - 1
    paid = o.groupBy((F.col("c_nationkey") + 1).alias("site_id"), month.alias("month")).agg(F.sum("o_totalprice").alias("paid"))
    run = F.sum("paid").over(Window.partitionBy("site_id").orderBy("month"))
    return paid.select("site_id", "month", (run - F.when(F.col("month") % 7 == 0, 500000).otherwise(0)).alias("amount_reported"), F.lit(40000000.0).alias("target"))


FUND_SQL = _FUND_SQL


@query(f"""WITH {ORDERS_SQL}, {_FUND_SQL}, o AS (SELECT order_id, site_id, 12 * year(date) + month(date) - 2 AS at FROM orders_c)
SELECT o.order_id, o.site_id, o.at, round(f.amount_reported, 2) AS amount FROM o ASOF LEFT JOIN fund f ON o.site_id = f.site_id AND o.at >= f.month""")
def j11_as_of(spark, sf_dir):
    o = orders_by_customer(spark, sf_dir).select("order_id", "site_id", (12 * F.year("date") + F.month("date") - 2).alias("at"))
    return J.as_of(o, fund(spark, sf_dir), "site_id", "at", "month", "amount_reported").select("order_id", "site_id", "at", F.round("amount_reported", 2).alias("amount"))


_KNN = """WITH {p}, pts AS (SELECT key, lat, lon FROM pixels WHERE copy = 0), d AS (SELECT a.key, b.key AS other, sqrt(power((a.lon - b.lon) * 111320.0 * cos(radians(a.lat)), 2) + power((a.lat - b.lat) * 110574.0, 2)) AS metres FROM pts a JOIN pts b ON a.key <> b.key AND abs(a.lat - b.lat) < 1e-3 AND abs(a.lon - b.lon) < 1e-3)
SELECT key, other, round(metres, 4) AS metres, place FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round(metres, 6), other) AS place FROM d) WHERE place <= 4"""


@query(_KNN.format(p=PIXELS_SQL))
def j12_nearest_four(spark, sf_dir):
    p = pixels(spark, sf_dir).where("copy = 0").select("key", "lat", "lon")
    near = S.nearest_exact(p, p.withColumnRenamed("key", "other"), 5, 15.0, staged).where("key != other")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.round("metres", 6), "other"))
    return near.withColumn("place", place).where("place <= 4").select("key", "other", F.round("metres", 4).alias("metres"), "place")


@query(f"""WITH {PIXELS_SQL}, pts AS (SELECT key, lat, lon FROM pixels WHERE copy = 1), base AS (SELECT key AS other, lat, lon FROM pixels WHERE copy = 0),
d AS (SELECT pts.key, other, sqrt(power((pts.lon - base.lon) * 111320.0 * cos(radians(pts.lat)), 2) + power((pts.lat - base.lat) * 110574.0, 2)) AS metres FROM pts JOIN base ON abs(pts.lat - base.lat) < 2e-4 AND abs(pts.lon - base.lon) < 2e-4)
SELECT key, arg_min(other, metres) AS other, round(min(metres), 4) AS metres FROM d WHERE metres <= 12 GROUP BY key""")
def j13_nearest_within(spark, sf_dir):
    p = pixels(spark, sf_dir)
    near = S.nearest(p.where("copy = 1"), p.where("copy = 0").select(F.col("key").alias("other"), "lat", "lon"), 1, 12.0)
    return near.select("key", "other", F.round("metres", 4).alias("metres"))


@query("""WITH q AS (SELECT DISTINCT substr(n_name, 1, 2) || substr(n_name, 4) AS name FROM nation), n AS (SELECT q.name, n_name AS match, 1 - levenshtein(regexp_replace(lower(q.name), '[^a-z0-9]+', '', 'g'), regexp_replace(lower(n_name), '[^a-z0-9]+', '', 'g')) / greatest(length(regexp_replace(lower(q.name), '[^a-z0-9]+', '', 'g')), length(regexp_replace(lower(n_name), '[^a-z0-9]+', '', 'g')))::DOUBLE AS score FROM q CROSS JOIN nation),
r AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS second FROM n WINDOW w AS (PARTITION BY name ORDER BY score DESC, match))
SELECT name, CASE WHEN score = 1 OR (score >= 0.8 AND score - coalesce(second, 0) >= 0.05) THEN match END AS match, round(score, 6) AS score FROM r WHERE rn = 1""")
def j15_fuzzy_names(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    written = n.select(F.concat(F.substring("n_name", 1, 2), F.expr("substring(n_name, 4)")).alias("name"))
    return J.fuzzy_names(written, n.select(F.col("n_name").alias("name")))


@query("""WITH RECURSIVE p AS (SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_name <> b.n_name AND 1 - levenshtein(lower(a.n_name), lower(b.n_name)) / greatest(length(a.n_name), length(b.n_name))::DOUBLE >= 0.45),
r AS (SELECT n_name AS name, n_name AS seen FROM nation UNION SELECT r.name, p.b FROM r JOIN p ON p.a = r.seen) SELECT name, min(seen) AS cluster FROM r GROUP BY name""")
def j16_name_clusters(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    return J.name_clusters(J.similar_pairs(n, least=0.45), n, staged)
