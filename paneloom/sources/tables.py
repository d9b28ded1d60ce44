"""The input tables and the panels built from them; each panel has its DataFrame form and its SQL form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paneloom.functions.calendar import season_of, season_year


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer's place: pixel, site, ring, segment, year and season."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_custkey").alias("pixel_id"), (F.col("c_nationkey") + 1).alias("site_id"), (F.col("c_custkey") % 6).cast("int").alias("buff_km"),
        F.col("c_mktsegment").alias("segment"), season_year("o_orderdate").alias("year"), season_of("o_orderdate").alias("season"),
        F.col("o_orderdate").alias("date"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("order_id"),
    )


ORDERS_SQL = """orders_c AS (SELECT c_custkey AS pixel_id, c_nationkey + 1 AS site_id, CAST(c_custkey % 6 AS INT) AS buff_km, c_mktsegment AS segment,
 CAST(CASE WHEN month(o_orderdate) <= 2 THEN year(o_orderdate) - 1 ELSE year(o_orderdate) END AS INT) AS year,
 CASE WHEN month(o_orderdate) BETWEEN 6 AND 9 THEN 1 WHEN month(o_orderdate) BETWEEN 3 AND 5 THEN 3 ELSE 2 END AS season,
 o_orderdate AS date, o_totalprice AS price, o_orderkey AS order_id FROM orders JOIN customer ON o_custkey = c_custkey)"""


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unbalanced panel: one row for each pixel, year and season with its mean outcome."""
    keys = ["pixel_id", "site_id", "buff_km", "segment", "year", "season"]
    return orders_by_customer(spark, sf_dir).groupBy(*keys).agg(F.avg("price").alias("y"), F.count("*").alias("n_obs"))


PANEL_SQL = ORDERS_SQL + """,
panel AS (SELECT pixel_id, site_id, buff_km, segment, year, season, avg(price) AS y, count(*) AS n_obs FROM orders_c GROUP BY ALL)"""


def balanced(spark: SparkSession, sf_dir: str, first: int = 1995, last: int = 2000) -> DataFrame:
    """Balanced panel: units (site, segment, ring) in every calendar year, the year's sum as outcome, zero where none."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    ring = (F.col("c_custkey") % 6).cast("int")
    keys = [(F.col("c_nationkey") + 1).alias("site_id"), F.col("c_mktsegment").alias("segment"), ring.alias("buff_km")]
    sums = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy(*keys, "year").agg(F.sum("o_totalprice").alias("total"))
    units = customers.select(*keys).distinct()
    grid = units.withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last))))
    out = grid.join(sums, ["site_id", "segment", "buff_km", "year"], "left").withColumn("y", F.coalesce("total", F.lit(0.0))).drop("total")
    return out.withColumn("unit", F.concat_ws("|", "site_id", "segment", "buff_km"))


BALANCED_SQL = """cust AS (SELECT c_custkey, c_nationkey + 1 AS site_id, c_mktsegment AS segment, CAST(c_custkey % 6 AS INT) AS buff_km FROM customer),
sums AS (SELECT site_id, segment, buff_km, year(o_orderdate) AS year, sum(o_totalprice) AS total FROM orders JOIN cust ON o_custkey = c_custkey GROUP BY ALL),
grid AS (SELECT * FROM (SELECT DISTINCT site_id, segment, buff_km FROM cust) CROSS JOIN range(1995, 2001) r(year)),
pb AS (SELECT g.site_id, g.segment, g.buff_km, CAST(g.year AS INT) AS year, coalesce(total, 0) AS y, concat_ws('|', g.site_id, g.segment, g.buff_km) AS unit
 FROM grid g LEFT JOIN sums s ON g.site_id = s.site_id AND g.segment = s.segment AND g.buff_km = s.buff_km AND g.year = s.year)"""


def treated(df: DataFrame, cutoff: int = 1998, year: str = "year") -> DataFrame:
    """Design columns: treatment, post, did_term, event_time (see design.py for the period rules)."""
    t: Column = (F.col("buff_km") == 0).cast("int")
    p: Column = (F.col(year) >= cutoff).cast("int")
    return df.withColumns({"treatment": t, "post": p, "did_term": t * p, "event_time": F.col(year) - cutoff})


TREATED_SQL = "CAST(buff_km = 0 AS INT) AS treatment, CAST(year >= 1998 AS INT) AS post, CAST(buff_km = 0 AND year >= 1998 AS INT) AS did_term, year - 1998 AS event_time"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry of points: coordinates by rule from the customer key, with a shifted copy of every seventh."""
    k = F.col("c_custkey")
    own = table(spark, sf_dir, "customer").select(
        k.alias("key"), (F.col("c_nationkey") + 1).alias("site_id"), F.lit(0).alias("copy"),
        (15 + F.floor(k / 40) * 1e-4).alias("lat"), (75 + (k % 40) * 1e-4).alias("lon"), F.col("c_acctbal").alias("value"), (k % 5).alias("priority"),
    )
    copy = own.where("key % 7 = 0").select("key", "site_id", F.lit(1).alias("copy"), (F.col("lat") + 1e-5).alias("lat"), (F.col("lon") + 1e-5).alias("lon"), "value", (F.col("priority") + 1).alias("priority"))
    return own.union(copy)


PIXELS_SQL = """own AS (SELECT c_custkey AS key, c_nationkey + 1 AS site_id, 0 AS copy, 15 + floor(c_custkey / 40) * 1e-4 AS lat, 75 + (c_custkey % 40) * 1e-4 AS lon, c_acctbal AS value, c_custkey % 5 AS priority FROM customer),
pixels AS (SELECT * FROM own UNION ALL SELECT key, site_id, 1, lat + 1e-5, lon + 1e-5, value, priority + 1 FROM own WHERE key % 7 = 0)"""
