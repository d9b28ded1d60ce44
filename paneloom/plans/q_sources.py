"""Queries of sources and sinks over files that are written from the input tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from paneloom.sources import exports as X
from paneloom.sources.staging import shared_dir, staged
from paneloom.sources.tables import ORDERS_SQL, PANEL_SQL, orders_by_customer, panel, table

from .registry import query

_NAME = """CASE order_id % 5 WHEN 0 THEN 'CSV_Site' || site_id || '_' || year || '_Kharif_tile' || (order_id % 7) || '.csv' WHEN 1 THEN 'export ' || year || ' rabi.csv' WHEN 2 THEN 'zaid-' || year || '-vs-' || (year - 1) || '.csv' WHEN 3 THEN year || '_' || year || '_yearly.parquet' ELSE 'notes.csv' END"""


@query(f"WITH {ORDERS_SQL} SELECT order_id, CASE WHEN order_id % 5 = 0 THEN 'site' || site_id END AS site, CAST(CASE WHEN order_id % 5 IN (0, 1, 3) THEN year END AS INT) AS file_year, CAST(CASE order_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 0 END AS INT) AS file_season FROM orders_c")
def s6_file_keys(spark, sf_dir):
    o = orders_by_customer(spark, sf_dir).withColumn("k", X.file_keys(F.expr(_NAME)))
    return o.select("order_id", F.col("k.site").alias("site"), F.col("k.year").alias("file_year"), F.col("k.season").alias("file_season"))


_STYLES = """CASE l_linenumber WHEN 1 THEN 'NDVI' WHEN 2 THEN 'ndvi mean' WHEN 3 THEN 'Rainfall (mm)' WHEN 4 THEN 'NDVI_sd' WHEN 5 THEN 'Longitud' WHEN 6 THEN 'Tmax_C' ELSE 'comment' END"""


@query(f"SELECT {_STYLES} AS header, CASE l_linenumber WHEN 1 THEN 'NDVI' WHEN 2 THEN 'NDVI' WHEN 3 THEN 'Rain' WHEN 5 THEN 'longitude' WHEN 6 THEN 'Tmax' END AS canonical, CASE l_linenumber WHEN 1 THEN 'alias' WHEN 2 THEN 'ending' WHEN 3 THEN 'ending' WHEN 4 THEN 'statistic' WHEN 5 THEN 'typo' WHEN 6 THEN 'alias' ELSE 'unresolved' END AS rule, count(*) AS n FROM lineitem GROUP BY ALL")
def s8_headers(spark, sf_dir):
    h = table(spark, sf_dir, "lineitem").groupBy(F.expr(_STYLES).alias("header")).agg(F.count("*").alias("n"))
    h = staged(h)
    return h.join(X.resolved_headers(h), "header").select("header", "canonical", "rule", "n")


@query("SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(min(15 + floor(o_custkey / 40) * 1e-4), 4) AS south FROM orders GROUP BY 1")
def s3_export_round_trip(spark, sf_dir):
    """Orders written as one CSV export a year under two header styles, found again, harmonised and summed."""
    folder = f"{shared_dir(spark)}/paneloom/exports-{uuid.uuid4().hex}"
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("yr"), (15 + F.floor(F.col("o_custkey") / 40) * 1e-4).alias("lat"), (75 + (F.col("o_custkey") % 40) * 1e-4).alias("lon"), F.col("o_totalprice").alias("v"))
    even = F.col("yr") % 2 == 0
    o.where(even).select(F.col("lat").alias("Latitude"), F.col("lon").alias("LONG"), F.col("v").alias("NDVI mean"), F.col("yr").alias("Year")).write.option("header", True).csv(f"{folder}/even")
    o.where(~even).select(F.col("yr").alias("yr"), F.col("v").alias("ndvi"), F.col("lat").alias("lat"), F.col("lon").alias("x"), F.lit("a").alias("remark")).write.option("header", True).csv(f"{folder}/odd")
    h = X.harmonised(spark, folder)
    return h.groupBy(F.col("Year").cast("int").alias("year")).agg(F.count("*").alias("n"), F.round(F.sum("NDVI"), 2).alias("total"), F.round(F.min("latitude"), 4).alias("south"))


@query(f"WITH {PANEL_SQL} SELECT year, season, count(*) AS n, count(DISTINCT pixel_id) AS pixels, round(sum(y) + 1e-4, 2) AS total FROM panel GROUP BY ALL")
def s14_panel_sink(spark, sf_dir):
    """The panel written by year and season in its natural order, and read back."""
    path = f"{shared_dir(spark)}/paneloom/panel-{uuid.uuid4().hex}"
    X.write_panel(panel(spark, sf_dir).withColumnsRenamed({"year": "Year", "season": "Season"}), path)
    return spark.read.parquet(path).groupBy(F.col("Year").alias("year"), F.col("Season").alias("season")).agg(F.count("*").alias("n"), F.count_distinct("pixel_id").alias("pixels"), F.round(F.sum("y") + 1e-4, 2).alias("total"))


@query(f"WITH {PANEL_SQL}, p AS (SELECT pixel_id, count(DISTINCT season) AS s, count(DISTINCT year) AS t FROM panel GROUP BY 1) SELECT (SELECT count(*) FROM panel) AS n, count(*) AS pixels, round(100.0 * count(*) FILTER (s > 1) / count(*), 4) AS pct_seasons, round(100.0 * count(*) FILTER (t > 1) / count(*), 4) AS pct_years FROM p")
def s17_manifest(spark, sf_dir):
    p = panel(spark, sf_dir).groupBy("pixel_id").agg(F.count("*").alias("rows"), F.count_distinct("season").alias("s"), F.count_distinct("year").alias("t"))
    share = lambda c: F.round(100 * F.count_if(c) / F.count("*"), 4)
    return p.agg(F.sum("rows").alias("n"), F.count("*").alias("pixels"), share(F.col("s") > 1).alias("pct_seasons"), share(F.col("t") > 1).alias("pct_years"))


@query("SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS n, count(*) FILTER (year(o_orderdate) % 2 = 0) AS evi_known, round(sum(o_totalprice), 2) AS total FROM orders WHERE year(o_orderdate) % 3 <> 0 GROUP BY 1")
def s10_filled_columns(spark, sf_dir):
    """Exports by year of which some lack an outcome, which is filled with null, and some an essential column, which rejects them."""
    folder = f"{shared_dir(spark)}/paneloom/lenient-{uuid.uuid4().hex}"
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("Year"), F.lit(15.0).alias("lat"), F.lit(75.0).alias("lon"), F.col("o_totalprice").alias("NDVI"), F.lit(1.0).alias("EVI"))
    whole, even = F.col("Year") % 3 != 0, F.col("Year") % 2 == 0
    for name, rows in (("all", o.where(whole & even)), ("no-evi", o.where(whole & ~even).drop("EVI")), ("no-lat", o.where(~whole).drop("lat"))):
        rows.write.option("header", True).csv(f"{folder}/{name}")
    h = X.harmonised(spark, folder)
    return h.groupBy(F.col("Year").cast("int").alias("year")).agg(F.count("*").alias("n"), F.count("EVI").alias("evi_known"), F.round(F.sum("NDVI"), 2).alias("total"))


@query("SELECT o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice > 200000 GROUP BY 1")
def s4_projected_scan(spark, sf_dir):
    """Two columns of a Parquet scan, filtered at the scan."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice").where("o_totalprice > 200000")
    return o.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT 'year=' || year(o_orderdate) AS folder, 1 AS files, CAST(6 AS BIGINT) AS columns FROM orders WHERE year(o_orderdate) <> 1999 GROUP BY year(o_orderdate)")
def s1_discovered(spark, sf_dir):
    """Files by extension below a folder, those of an excluded subfolder left out, with their columns."""
    folder = f"{shared_dir(spark)}/paneloom/found-{uuid.uuid4().hex}"
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", F.lit("x").alias("remark"))
    for (year,) in o.select("year").distinct().collect():  # a file a year, streamed: partitionBy in one task would sort the whole table
        o.where(F.col("year").eqNullSafe(year)).drop("year").coalesce(1).write.option("header", True).csv(f"{folder}/year={'__HIVE_DEFAULT_PARTITION__' if year is None else year}")
    o.groupBy("o_orderstatus").count().coalesce(1).write.option("header", True).csv(f"{folder}/notes")
    h = X.header_rows(spark, folder, exclude="/(notes|year=1999)/")
    files = h.groupBy("src_file").agg(F.count("*").alias("columns"))
    return files.groupBy(F.regexp_extract("src_file", r"/(year=\d+)/", 1).alias("folder"), "columns").agg(F.count("*").cast("int").alias("files")).select("folder", "files", "columns")
