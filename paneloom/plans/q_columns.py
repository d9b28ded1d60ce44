"""Queries of column expressions: identifiers, cleaning, calendar, indices."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneloom.functions import calendar as C
from paneloom.functions import pixels as P
from paneloom.functions import spectral as S
from paneloom.sources.tables import ORDERS_SQL, PIXELS_SQL, orders_by_customer, pixels, table

from .registry import query


@query(f"WITH {PIXELS_SQL} SELECT key, copy, CAST(round_even((lat + 90) * 1e5, 0) AS BIGINT) * 1000000000 + CAST(round_even((lon + 180) * 1e5, 0) AS BIGINT) AS pixel_id FROM pixels")
def f1_pixel_id(spark, sf_dir):
    return pixels(spark, sf_dir).select("key", "copy", P.pixel_id("lat", "lon").alias("pixel_id"))


_RING = "CASE c_custkey % 4 WHEN 0 THEN 'Buffer_' || (c_custkey % 8) WHEN 1 THEN CAST(c_custkey % 9 AS VARCHAR) WHEN 2 THEN '-' || (c_custkey % 3) || ' km' ELSE 'none' END"


@query(f"WITH t AS (SELECT c_custkey, {_RING} AS v FROM customer), n AS (SELECT c_custkey, TRY_CAST(regexp_extract(v, '-?\\d+(?:\\.\\d+)?') AS DOUBLE) AS x FROM t) SELECT c_custkey, CASE WHEN abs(x - round_even(x, 0)) <= 0.01 AND round_even(x, 0) BETWEEN 0 AND 5 THEN CAST(round_even(x, 0) AS INT) ELSE -1 END AS ring FROM n")
def f2_ring(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", P.ring_of(F.expr(_RING.replace("VARCHAR", "STRING"))).alias("ring"))


_FILLS = "CASE WHEN o_orderkey % 97 = 0 THEN 0 WHEN o_orderkey % 101 = 0 THEN -9999 WHEN o_orderkey % 89 = 0 THEN -10 WHEN o_orderkey % 83 = 0 THEN -5.5 ELSE o_totalprice END"


@query(f"WITH t AS (SELECT o_orderkey, CAST({_FILLS} AS DOUBLE) AS v FROM orders), m AS (SELECT o_orderkey, v, v <= -100 OR v = -10 OR v = 0 AS bad FROM t) SELECT o_orderkey, CASE WHEN NOT bad THEN v END AS kept, CASE WHEN NOT bad THEN greatest(v, 0) END AS floored, CASE WHEN NOT bad AND v >= 0 THEN v END AS missing FROM m")
def f3_no_data(spark, sf_dir):
    v = F.expr(_FILLS)
    return table(spark, sf_dir, "orders").select("o_orderkey", P.no_data(v).alias("kept"), P.no_data(v, negatives="floor").alias("floored"), P.no_data(v, negatives="missing").alias("missing"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN CAST(o_orderdate AS DATE) WHEN 2 THEN CAST(o_orderdate AS DATE) END AS d FROM orders")
def f24_date_formats(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    serial = F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string")
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "dd/MM/yyyy")).when(k == 2, serial).otherwise("unknown")
    return table(spark, sf_dir, "orders").select("o_orderkey", C.parsed_date(text).alias("d"))


@query("SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders")
def f23_clean_numbers(spark, sf_dir):
    written = F.concat(F.lit(" "), F.format_number("o_totalprice", 2), F.lit(" Rs"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(P.cleaned_number(written), 2).alias("price"))


@query(f"WITH {ORDERS_SQL} SELECT order_id, year, season FROM orders_c")
def x1_season(spark, sf_dir):
    return orders_by_customer(spark, sf_dir).select("order_id", "year", "season")


@query(f"WITH {ORDERS_SQL} SELECT order_id, CAST(CASE WHEN season = 3 THEN year + 1 ELSE year END AS INT) AS next_year, CAST(CASE WHEN season = 3 THEN 1 ELSE season + 1 END AS INT) AS next_season, 3 * year + season - 1 AS q FROM orders_c")
def x2_next_season(spark, sf_dir):
    o = orders_by_customer(spark, sf_dir).withColumn("n", C.next_season("year", "season"))
    return o.select("order_id", F.col("n.year").cast("int").alias("next_year"), F.col("n.season").cast("int").alias("next_season"), C.season_index("year", "season").alias("q"))


@query(f"""WITH {ORDERS_SQL}, b AS (SELECT DISTINCT year, season, CASE season WHEN 1 THEN make_date(year, 6, 1) WHEN 2 THEN make_date(year, 10, 1) ELSE make_date(year + 1, 3, 1) END AS b FROM orders_c)
SELECT year, season, b AS begin_day, CAST(b + CASE season WHEN 1 THEN INTERVAL 4 MONTH WHEN 2 THEN INTERVAL 5 MONTH ELSE INTERVAL 3 MONTH END AS DATE) AS end_day,
CASE season WHEN 1 THEN 12 * year + 8 WHEN 2 THEN 12 * (year + 1) + 1 ELSE 12 * (year + 1) + 4 END AS last_month FROM b""")
def x3_season_window(spark, sf_dir):
    s = orders_by_customer(spark, sf_dir).select("year", "season").distinct().withColumn("b", C.season_bounds("year", "season"))
    return s.select("year", "season", F.col("b.begin").alias("begin_day"), F.col("b.end").alias("end_day"), C.last_month("year", "season").alias("last_month"))


@query("SELECT 12 * year(o_orderdate) + month(o_orderdate) - 1 AS m, strftime(o_orderdate, '%Y-%m') AS label, count(*) AS n FROM orders GROUP BY ALL")
def x4_months(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(C.month_index("o_orderdate").alias("m"))
    return o.groupBy("m").agg(F.count("*").alias("n")).select("m", C.month_label("m").alias("label"), "n")


@query("SELECT p_partkey, regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '', 'g') AS name FROM part")
def x5_name_key(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", P.name_key("p_name").alias("name"))


@query(f"WITH {PIXELS_SQL} SELECT CAST(floor((lat + 90) / 0.01) AS BIGINT) * 100000 + CAST(floor((lon + 180) / 0.01) AS BIGINT) AS block, count(*) AS n FROM pixels GROUP BY 1")
def x6_blocks(spark, sf_dir):
    return pixels(spark, sf_dir).groupBy(P.block_id("lat", "lon").alias("block")).agg(F.count("*").alias("n"))


@query(f"WITH {PIXELS_SQL} SELECT key, copy, round((lon - 75) * 111320.0 * cos(radians(15.0)), 6) AS east, round((lat - 15) * 110574.0, 6) AS north FROM pixels")
def x7_local_metres(spark, sf_dir):
    east, north = P.local_metres("lat", "lon", 15.0, 75.0)
    return pixels(spark, sf_dir).select("key", "copy", F.round(east, 6).alias("east"), F.round(north, 6).alias("north"))


@query()
def x7_transverse_mercator(spark, sf_dir):
    east, north = P.transverse_mercator("lat", "lon", 75.0)
    return pixels(spark, sf_dir).select("key", "copy", F.round(east, 4).alias("east"), F.round(north, 4).alias("north"))


_BANDS = ", ".join(f"0.5 + CAST(embedding[{i}] AS DOUBLE) AS {b}" for i, b in enumerate(("blue", "green", "red", "edge", "nir", "swir"), 1))


def _bands(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *((0.5 + F.get("embedding", F.lit(i)).cast("double")).alias(b) for i, b in enumerate(("blue", "green", "red", "edge", "nir", "swir"))))


_ND = "greatest(-1, least(1, ({a} - {b}) / nullif({a} + {b}, 0)))"


@query(f"""WITH t AS (SELECT vec_id, {_BANDS} FROM embeddings), n AS (SELECT *, {_ND.format(a="nir", b="red")} AS ndvi FROM t)
SELECT vec_id, round(ndvi, 6) AS ndvi, round(greatest(-1, least(1, 1.5 * (nir - red) / (nir + red + 0.5))), 6) AS savi, round(greatest(-1, least(1, 2.5 * (nir - red) / (nir + 6 * red - 7.5 * blue + 1))), 6) AS evi,
round({_ND.format(a="nir", b="swir")}, 6) AS lswi, round({_ND.format(a="green", b="nir")}, 6) AS ndwi, round({_ND.format(a="nir", b="edge")}, 6) AS ndre, round(greatest(0, least(6, 3.618 * ndvi - 0.118)), 6) AS lai FROM n""")
def x8_indices(spark, sf_dir):
    return _bands(spark, sf_dir).select("vec_id", *(F.round(v, 6).alias(k) for k, v in S.indices("blue", "green", "red", "edge", "nir", "swir").items()))


@query("SELECT event_id % 13 IN (4, 5, 6, 7) AS scl, event_id & 1024 = 0 AND event_id & 2048 = 0 AS qa60, event_id & 63 = 0 AS pixel_qa, event_id & 3 = 0 AND (event_id >> 2) & 1 = 0 AS state, count(*) AS n FROM events GROUP BY ALL")
def x9_masks(spark, sf_dir):
    q = F.col("event_id")
    e = table(spark, sf_dir, "events").select(S.clear_scl(q % 13).alias("scl"), S.clear_qa60(q).alias("qa60"), S.clear_pixel_qa(q).alias("pixel_qa"), S.clear_state(q).alias("state"))
    return e.groupBy("scl", "qa60", "pixel_qa", "state").agg(F.count("*").alias("n"))


@query(f"WITH {ORDERS_SQL} SELECT site_id, year, season, round(median(price), 4) AS mid, round(avg(price) + 1e-9, 4) AS mean, round(sum(price), 2) AS total, count(*) AS n FROM orders_c GROUP BY ALL")
def x10_composite(spark, sf_dir):
    g = orders_by_customer(spark, sf_dir).groupBy("site_id", "year", "season")
    return g.agg(F.round(F.percentile("price", 0.5), 4).alias("mid"), F.round(F.avg("price") + 1e-9, 4).alias("mean"), F.round(F.sum("price"), 2).alias("total"), F.count("*").alias("n"))


@query(f"""WITH {ORDERS_SQL}, t AS (SELECT site_id, year, median(price) FILTER (season = 1 AND price > 100000) AS a, count(*) FILTER (season = 1 AND price > 100000) AS na,
median(price) FILTER (season = 1) AS b, count(*) FILTER (season = 1) AS nb, median(price) AS c FROM orders_c GROUP BY ALL)
SELECT site_id, year, round(CASE WHEN na >= 5 THEN a WHEN nb >= 5 THEN b ELSE c END, 4) AS value, CASE WHEN na >= 5 THEN 1 WHEN nb >= 5 THEN 2 ELSE 3 END AS tier FROM t""")
def x11_priority_composite(spark, sf_dir):
    strict, core = (F.col("season") == 1) & (F.col("price") > 100000), F.col("season") == 1
    mid = lambda c: F.percentile(F.when(c, F.col("price")), 0.5)
    t = orders_by_customer(spark, sf_dir).groupBy("site_id", "year").agg(mid(strict).alias("a"), F.count_if(strict).alias("na"), mid(core).alias("b"), F.count_if(core).alias("nb"), F.percentile("price", 0.5).alias("c"))
    pick = lambda a, b, c: F.when(F.col("na") >= 5, a).when(F.col("nb") >= 5, b).otherwise(c)
    return t.select("site_id", "year", F.round(pick(F.col("a"), F.col("b"), F.col("c")), 4).alias("value"), pick(F.lit(1), F.lit(2), F.lit(3)).alias("tier"))


@query(f"""WITH {ORDERS_SQL}, p AS (SELECT site_id, year, season, avg(price) AS v FROM orders_c GROUP BY ALL), e AS (SELECT site_id, season, min(v) AS lo, max(v) AS hi, count(*) AS n FROM p WHERE year < 1999 GROUP BY ALL),
s AS (SELECT site_id, year, season, CASE WHEN n >= 3 AND hi > lo THEN greatest(0, least(100, 100 * (v - lo) / (hi - lo))) END AS vci FROM p LEFT JOIN e USING (site_id, season))
SELECT site_id, year, season, round(vci, 4) AS vci, round(100 - vci, 4) AS tci, round(0.5 * vci + 0.5 * (100 - vci), 4) AS vhi FROM s""")
def x13_condition_index(spark, sf_dir):
    p = orders_by_customer(spark, sf_dir).groupBy("site_id", "year", "season").agg(F.avg("price").alias("v"))
    e = p.where("year < 1999").groupBy("site_id", "season").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    s = p.join(e, ["site_id", "season"], "left").withColumn("vci", S.condition(F.col("v"), F.col("lo"), F.col("hi"), F.col("n")))
    return s.select("site_id", "year", "season", F.round("vci", 4).alias("vci"), F.round(100 - F.col("vci"), 4).alias("tci"), F.round(0.5 * F.col("vci") + 0.5 * (100 - F.col("vci")), 4).alias("vhi"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity AS et, 30.0 + l_tax * 100 AS pet, l_extendedprice / 1000 AS rain FROM lineitem)
SELECT l_orderkey, l_linenumber, round(greatest(0, least(1.5, et / nullif(pet, 0))), 6) AS esi, round(1 - greatest(0, least(1.5, et / nullif(pet, 0))), 6) AS wssi, round(greatest(-1, least(1, (rain - et) / nullif(rain + et, 0))), 6) AS wsi FROM t""")
def x14_water_stress(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("et"), (30.0 + F.col("l_tax") * 100).alias("pet"), (F.col("l_extendedprice") / 1000).alias("rain"))
    esi = S.evaporative_stress("et", "pet")
    return t.select("l_orderkey", "l_linenumber", F.round(esi, 6).alias("esi"), F.round(1 - esi, 6).alias("wssi"), F.round(S.water_stress("rain", "et"), 6).alias("wsi"))


@query("SELECT vec_id, CAST(list_position(embedding[1:9], list_max(embedding[1:9])) - 1 AS INT) AS land_use FROM embeddings")
def x16_land_use(spark, sf_dir):
    first = F.slice("embedding", 1, 9)
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.array_position(first, F.array_max(first)) - 1).cast("int").alias("land_use"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_discount * 6 AS n FROM lineitem JOIN part ON l_partkey = p_partkey), u AS (SELECT l.l_orderkey, l.l_linenumber, l_quantity * 100 AS r, 0.02 + l_tax / 10 AS k, p_size / 10.0 AS ls, l_discount * 6 AS n, CASE WHEN p_size <= 10 THEN 0.6 WHEN p_size <= 30 THEN 0.8 ELSE 1.0 END AS p FROM lineitem l JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, l_linenumber, round(greatest(0, least(500, r * k * ls * CASE WHEN n < 1 THEN greatest(0, least(1, exp(-2 * n / (1 - n)))) ELSE 0 END * p)), 6) AS loss FROM u""")
def x18_soil_loss(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    p = F.when(F.col("p_size") <= 10, 0.6).when(F.col("p_size") <= 30, 0.8).otherwise(1.0)
    loss = S.soil_loss(F.col("l_quantity") * 100, 0.02 + F.col("l_tax") / 10, F.col("p_size") / 10, S.cover_factor(F.col("l_discount") * 6), p)
    return j.select("l_orderkey", "l_linenumber", F.round(loss, 6).alias("loss"))


@query(f"""WITH {ORDERS_SQL}, p AS (SELECT site_id, season, year, avg(price) AS v, count(*) AS n FROM orders_c GROUP BY ALL),
g AS (SELECT *, CASE WHEN n >= 10 THEN v END AS own, avg(CASE WHEN n >= 10 THEN v END) OVER (PARTITION BY site_id, season ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM p)
SELECT site_id, season, year, round(coalesce(own, prior), 4) AS value, own IS NULL AND prior IS NOT NULL AS filled FROM g""")
def x20_gap_fill(spark, sf_dir):
    from pyspark.sql import Window

    p = orders_by_customer(spark, sf_dir).groupBy("site_id", "season", "year").agg(F.avg("price").alias("v"), F.count("*").alias("n"))
    before = Window.partitionBy("site_id", "season").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    g = p.withColumn("own", F.when(F.col("n") >= 10, F.col("v"))).withColumn("prior", F.avg("own").over(before))
    return g.select("site_id", "season", "year", F.round(F.coalesce("own", "prior"), 4).alias("value"), (F.col("own").isNull() & F.col("prior").isNotNull()).alias("filled"))


@query(f"""WITH {ORDERS_SQL}, d AS (SELECT site_id, year, season, count(DISTINCT CAST(date AS DATE)) AS days FROM orders_c GROUP BY ALL)
SELECT site_id, year, season, round(days / CASE season WHEN 1 THEN 122.0 WHEN 2 THEN date_diff('day', make_date(year, 10, 1), make_date(year + 1, 3, 1)) ELSE 92.0 END, 6) AS share FROM d""")
def x23_completeness(spark, sf_dir):
    d = orders_by_customer(spark, sf_dir).groupBy("site_id", "year", "season").agg(F.count_distinct(F.col("date").cast("date")).alias("days")).withColumn("b", C.season_bounds("year", "season"))
    return d.select("site_id", "year", "season", F.round(F.col("days") / F.datediff("b.end", "b.begin"), 6).alias("share"))
