"""Queries of treatment timing and dose."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paneloom.operators import timing as T
from paneloom.sources.tables import PANEL_SQL, panel, table

from .q_joins import FUND_SQL, fund
from .registry import query

_START = f"""WITH {FUND_SQL}, m AS (SELECT *, min(month) OVER (PARTITION BY site_id) AS m0 FROM fund), s AS (SELECT site_id, m0, arg_min(amount_reported, month) AS a0, arg_max(amount_reported, month) FILTER (month < m0 + 12) AS aj,
max(month) FILTER (month < m0 + 12) AS mj, min(month) FILTER (amount_reported >= 0.05 * target) AS share_month FROM m GROUP BY ALL), b AS (SELECT *, CASE WHEN a0 > 0 AND aj > a0 THEN CAST(ceil(a0 / ((aj - a0) / (mj - m0))) AS BIGINT) ELSE 1 END AS back FROM s)"""


@query(_START + " SELECT site_id, m0 - back + 1 AS start_month, back AS months_back, back > 1 AS censored, m0, round(a0, 2) AS a0 FROM b")
def t2_start_backcast(spark, sf_dir):
    return T.start_month(fund(spark, sf_dir), amount="amount_reported").withColumn("a0", F.round("a0", 2))


@query(_START + " SELECT site_id, CAST(share_month AS BIGINT) AS start_month FROM b")
def t2_start_share(spark, sf_dir):
    return T.start_month(fund(spark, sf_dir), rule="share", amount="amount_reported").select("site_id", "start_month")


@query(f"WITH {PANEL_SQL} SELECT pixel_id, year, season, CAST(1998 + site_id % 3 + CASE WHEN (season - 1) % 4 < 1 THEN 1 ELSE 0 END AS INT) AS cohort FROM panel WHERE buff_km = 0")
def t4_row_cohorts(spark, sf_dir):
    p = panel(spark, sf_dir).where("buff_km = 0").withColumns({"start_year": 1998 + F.col("site_id") % 3, "start_season": F.lit(2)})
    return p.select("pixel_id", "year", "season", T.row_cohort("year", "season", "start_year", "start_season").cast("int").alias("cohort"))


@query(f"WITH {FUND_SQL}, g AS (SELECT site_id, CAST(floor(month / 12) AS INT) AS year, avg(amount_reported) AS dose, count(*) AS months FROM fund GROUP BY ALL) SELECT site_id, year, round(dose + 1e-5, 2) AS dose, months < 12 AS estimated FROM g")
def t5_annual_dose(spark, sf_dir):
    return fund(spark, sf_dir).groupBy("site_id", F.floor(F.col("month") / 12).cast("int").alias("year")).agg(F.round(F.avg("amount_reported") + 1e-5, 2).alias("dose"), (F.count("*") < 12).alias("estimated"))


@query(f"""WITH {FUND_SQL}, r AS (SELECT *, max(amount_reported / target) OVER (PARTITION BY site_id ORDER BY month) AS share FROM fund), q AS (SELECT site_id, CAST(floor(month / 3) AS INT) AS quarter, max(share) AS share, count(*) AS months FROM r GROUP BY ALL)
SELECT site_id, quarter + 1 AS quarter, round(share, 6) AS share, months FROM q""")
def t6_shifted_dose(spark, sf_dir):
    r = T.completion(fund(spark, sf_dir).withColumn("share", F.col("amount_reported") / F.col("target")), "site_id", "month", "share")
    q = r.groupBy("site_id", F.floor(F.col("month") / 3).cast("int").alias("q")).agg(F.max("running").alias("share"), F.count("*").alias("months"))
    return q.select("site_id", (F.col("q") + 1).alias("quarter"), F.round("share", 6).alias("share"), "months")


@query("WITH d AS (SELECT n_regionkey AS region, sum(c_acctbal) AS amount FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), s AS (SELECT n_regionkey AS region, count(*) AS n FROM nation GROUP BY 1) SELECT n_name AS member, round(amount / n, 4) AS member_amount FROM nation JOIN d ON n_regionkey = d.region JOIN s ON n_regionkey = s.region")
def t7_equal_division(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("member"), "n_nationkey")
    d = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("region").agg(F.sum("c_acctbal").alias("amount"))
    return T.equal_division(d, n.select("region", "member"), "region", "amount").select("member", F.round("member_amount", 4).alias("member_amount"))


@query(f"""WITH {PANEL_SQL.replace("orders_c AS", "orders_c AS")}, {FUND_SQL}, a AS (SELECT site_id, CAST(floor(month / 12) AS INT) AS year, max(amount_reported) AS amount FROM fund GROUP BY ALL)
SELECT pixel_id, p.year, season, CASE WHEN buff_km > 0 OR p.year < 1998 THEN 0 ELSE round(amount, 2) END AS dose FROM panel p LEFT JOIN a ON a.site_id = p.site_id AND a.year = p.year""")
def t8_dose_attached(spark, sf_dir):
    a = fund(spark, sf_dir).groupBy("site_id", F.floor(F.col("month") / 12).cast("int").alias("year")).agg(F.max("amount_reported").alias("amount"))
    none = (F.col("buff_km") > 0) | (F.col("year") < 1998)
    return panel(spark, sf_dir).join(a, ["site_id", "year"], "left").select("pixel_id", "year", "season", F.when(none, 0.0).otherwise(F.round("amount", 2)).alias("dose"))
