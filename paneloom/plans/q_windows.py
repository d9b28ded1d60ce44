"""Queries of windows, de-duplication, sorts and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paneloom.functions.calendar import season_rank
from paneloom.operators import dedup as D
from paneloom.operators import timing as T
from paneloom.sources.tables import BALANCED_SQL, ORDERS_SQL, PANEL_SQL, balanced, orders_by_customer, panel, table

from .q_joins import FUND_SQL, fund
from .registry import query

_EVENTS_SQL = """ev AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, epoch(ts) AS mtime, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS v1, CASE WHEN event_id % 5 = 0 THEN NULL ELSE round(value * 2, 6) END AS v2,
CAST(json_extract(props, '$.k') AS INT) AS k, event_type || '-' || event_id AS src FROM events)"""


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ids = F.col("event_id")
    return e.select(
        "event_id", "user_id", F.col("ts").cast("date").alias("day"), F.col("ts").cast("timestamp").cast("double").alias("mtime"), F.when(ids % 11 != 0, F.col("value")).alias("v1"),
        F.when(ids % 5 != 0, F.round(F.col("value") * 2, 6)).alias("v2"), F.get_json_object("props", "$.k").cast("int").alias("k"), F.concat_ws("-", "event_type", ids.cast("string")).alias("src"),
    )


_RANK_SQL = _EVENTS_SQL + """, m AS (SELECT *, CAST(v1 IS NULL AS INT) + CAST(v2 IS NULL AS INT) AS missing, CAST(max(mtime) OVER (PARTITION BY user_id, day) - mtime <= 3600 AS INT) AS newest FROM ev),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY newest DESC, missing, coalesce(k, -1) DESC, src) AS rank FROM m)"""

_OPTIONS = {"keys": ["user_id", "day"], "outcomes": ["v1", "v2"], "mtime": "mtime", "observations": "k", "source": "src", "margin": 3600.0}


@query(f"WITH {_RANK_SQL} SELECT event_id, user_id, day, v1, v2, k FROM ranked WHERE rank = 1")
def w1_deduplicated(spark, sf_dir):
    return D.deduplicated(_events(spark, sf_dir), **_OPTIONS).select("event_id", "user_id", "day", "v1", "v2", "k")


@query(f"""WITH {_EVENTS_SQL}, g AS (SELECT user_id, day, count(*) AS n_rows, count(DISTINCT v1) AS d1, count(DISTINCT v2) AS d2, count(*) - count(v1) AS m1, count(*) - count(v2) AS m2 FROM ev GROUP BY ALL HAVING count(*) > 1)
SELECT user_id, day, n_rows, CASE WHEN d1 > 1 OR d2 > 1 THEN 'conflicting' WHEN (d1 >= 1 AND m1 > 0) OR (d2 >= 1 AND m2 > 0) THEN 'complementary' ELSE 'redundant' END AS kind FROM g""")
def w2_duplicate_kinds(spark, sf_dir):
    return D.classified(_events(spark, sf_dir), ["user_id", "day"], ["v1", "v2"])


@query(f"WITH {_RANK_SQL} SELECT user_id, day, arg_min(v1, rank) FILTER (v1 IS NOT NULL) AS v1, arg_min(v2, rank) FILTER (v2 IS NOT NULL) AS v2 FROM ranked GROUP BY ALL")
def w3_gap_filled(spark, sf_dir):
    return D.gap_filled(D.ranked(_events(spark, sf_dir), **_OPTIONS), ["user_id", "day"], ["v1", "v2"])


@query(f"""WITH {FUND_SQL}, s AS (SELECT site_id, month, amount_reported / target AS share FROM fund) SELECT site_id, month, round(max(share) OVER w, 6) AS running, coalesce(share < lag(share) OVER w, false) AS fell FROM s WINDOW w AS (PARTITION BY site_id ORDER BY month)""")
def w4_completion(spark, sf_dir):
    s = fund(spark, sf_dir).withColumn("share", F.col("amount_reported") / F.col("target"))
    return T.completion(s, "site_id", "month", "share").select("site_id", "month", F.round("running", 6).alias("running"), "fell")


@query(f"""WITH {FUND_SQL}, a AS (SELECT *, min(amount_reported) OVER (PARTITION BY site_id ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS amount FROM fund)
SELECT site_id, month, round(amount, 2) AS amount, round(amount - coalesce(lag(amount) OVER (PARTITION BY site_id ORDER BY month), 0), 2) AS release, round(amount_reported - amount, 2) AS revision FROM a""")
def w5_revised(spark, sf_dir):
    return T.revised(fund(spark, sf_dir)).select("site_id", "month", F.round("amount", 2).alias("amount"), F.round("release", 2).alias("release"), F.round("revision", 2).alias("revision"))


@query(f"WITH {BALANCED_SQL} SELECT unit, year, round(y - lag(y) OVER (PARTITION BY unit ORDER BY year), 2) AS dy, lag(year) OVER (PARTITION BY unit ORDER BY year) || '-' || year AS pair FROM pb")
def w6_first_differences(spark, sf_dir):
    w = Window.partitionBy("unit").orderBy("year")
    return balanced(spark, sf_dir).select("unit", "year", F.round(F.col("y") - F.lag("y").over(w), 2).alias("dy"), F.concat(F.lag("year").over(w).cast("string"), F.lit("-"), F.col("year").cast("string")).alias("pair"))


@query(f"WITH {BALANCED_SQL} SELECT unit, year, round(y - avg(y) OVER (PARTITION BY unit), 4) AS within FROM pb")
def w7_within(spark, sf_dir):
    return balanced(spark, sf_dir).select("unit", "year", F.round(F.col("y") - F.avg("y").over(Window.partitionBy("unit")), 4).alias("within"))


@query(f"""WITH {PANEL_SQL}, o AS (SELECT site_id, year, (season - 1) % 4 AS r, pixel_id FROM panel), g AS (SELECT site_id, r < lag(r) OVER (PARTITION BY site_id, year ORDER BY pixel_id, r) AS back FROM o) SELECT site_id, count(*) AS n, coalesce(sum(CAST(back AS INT)), 0) AS n_back FROM g GROUP BY 1""")
def w8_order_audit(spark, sf_dir):
    o = panel(spark, sf_dir).withColumn("r", season_rank("season"))
    back = F.col("r") < F.lag("r").over(Window.partitionBy("site_id", "year").orderBy("pixel_id", "r"))
    return o.withColumn("back", back).groupBy("site_id").agg(F.count("*").alias("n"), F.count_if("back").alias("n_back"))


@query("SELECT c_custkey, ntile(4) OVER (ORDER BY c_acctbal, c_custkey) AS quartile FROM customer")
def w10_quartiles(spark, sf_dir):
    # the bounds are exact quantiles of the ranks; a global ntile would put all rows into one task
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    sized = c.withColumn("part", F.floor(F.col("c_acctbal") / 500))
    counts = sized.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("total"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("c_acctbal", "c_custkey")) + F.col("before")
    ranked = sized.join(F.broadcast(before), "part").withColumn("place", place)
    base, extra = F.floor(F.col("total") / 4), F.col("total") % 4
    large = extra * (base + 1)  # the first ``extra`` quarters have one row more
    quartile = F.when(F.col("place") <= large, F.ceil(F.col("place") / (base + 1))).otherwise(extra + F.ceil((F.col("place") - large) / base))
    return ranked.select("c_custkey", quartile.cast("int").alias("quartile"))


@query(f"WITH {PANEL_SQL} SELECT pixel_id, round(avg(y) FILTER (year < 1998) + 1e-7, 4) AS pre_mean, count(*) FILTER (year < 1998) AS n_pre FROM panel GROUP BY 1")
def w11_baseline(spark, sf_dir):
    return panel(spark, sf_dir).groupBy("pixel_id").agg(F.round(F.avg(F.when(F.col("year") < 1998, F.col("y"))) + 1e-7, 4).alias("pre_mean"), F.count_if(F.col("year") < 1998).alias("n_pre"))


@query("SELECT n_regionkey AS region, n_name AS nation, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY n_regionkey), 6) AS share FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def w12_shares(spark, sf_dir):
    j = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    g = j.groupBy(F.col("n_regionkey").alias("region"), F.col("n_name").alias("nation")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("region")), 6))


@query(f"WITH {ORDERS_SQL}, s AS (SELECT site_id, year, season, sum(price) AS total FROM orders_c GROUP BY ALL) SELECT site_id, min(struct_pack(year := year, season := season)).year AS year, min(struct_pack(year := year, season := season)).season AS season FROM s WHERE total >= 2000000 GROUP BY site_id")
def o3_first_crossing(spark, sf_dir):
    s = orders_by_customer(spark, sf_dir).groupBy("site_id", "year", "season").agg(F.sum("price").alias("total"))
    return T.first_crossing(s, "site_id", ["year", "season"], "total", 2_000_000).select("site_id", "year", "season")


@query(f"WITH {PANEL_SQL} SELECT pixel_id FROM panel GROUP BY 1 HAVING count(DISTINCT year) = (SELECT count(DISTINCT year) FROM panel)")
def o5_stable_pixels(spark, sf_dir):
    p = panel(spark, sf_dir)
    years = p.agg(F.count_distinct("year").alias("years"))
    return p.groupBy("pixel_id").agg(F.count_distinct("year").alias("n")).join(F.broadcast(years)).where("n = years").select("pixel_id")


@query(f"WITH {PANEL_SQL} SELECT year, round(avg(y) FILTER (buff_km = 0), 4) AS treated, round(avg(y) FILTER (buff_km > 0), 4) AS control FROM panel GROUP BY 1")
def o7_pivot_arms(spark, sf_dir):
    arm = F.when(F.col("buff_km") == 0, "treated").otherwise("control")
    return panel(spark, sf_dir).withColumn("arm", arm).groupBy("year").pivot("arm", ["treated", "control"]).agg(F.round(F.avg("y"), 4))


@query("""WITH u AS (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME variable VALUE value) SELECT variable, count(*) AS n, round(avg(value), 6) AS mean FROM u GROUP BY 1""")
def o7_unpivot(spark, sf_dir):
    long = table(spark, sf_dir, "lineitem").unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "variable", "value")
    return long.groupBy("variable").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query()
def o8_hash_sample(spark, sf_dir):
    return panel(spark, sf_dir).where(F.pmod(F.xxhash64("pixel_id"), F.lit(10)) == 0).groupBy("year").agg(F.count("*").alias("n"), F.count_distinct("pixel_id").alias("pixels"))
