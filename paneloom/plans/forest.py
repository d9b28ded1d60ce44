"""An honest forest of effects: one part of the units decides the splits, another fills the leaves, a third is predicted.

Nuisances (expected change, propensity) are cross-fitted. The splits are those of a weighted forest of pyspark.ml on the
residual ratio. Leaves are filled with the residual slope of units that did not decide them: their leaf ids are exploded by tree
and summed, which gives a row for each tree and leaf, whatever the units; the others look their leaves up in that table.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.sources.staging import staged

from .cells import Forest
from .ml import by_forests
from .stats import normal_p, t_p

SLOTS = 1 << 16


def leaf_values(model: RandomForestRegressionModel, rows: DataFrame) -> DataFrame:
    """(tree, leaf, value, n): the slope of u on v over the rows of each leaf; leaves without rows have none."""
    leaves = model.setLeafCol("leaf").transform(rows).select("u", "v", F.posexplode(vector_to_array("leaf")).alias("tree", "at"))
    sums = leaves.groupBy("tree", F.col("at").cast("int").alias("leaf")).agg(F.sum(F.col("u") * F.col("v")).alias("uv"), F.sum(F.col("v") * F.col("v")).alias("vv"), F.count("*").alias("n"))
    return sums.where("vv > 0").select("tree", "leaf", (F.col("uv") / F.col("vv")).alias("value"), "n")


def with_effect(model: RandomForestRegressionModel, rows: DataFrame, values: DataFrame) -> DataFrame:
    """``rows`` with ``tau``: the mean of their leaves' values over the trees whose leaf has one."""
    # trees x leaves in an array: a map would be searched from its start for every tree of every row
    listed = values.agg(F.map_from_entries(F.collect_list(F.struct(F.col("tree") * SLOTS + F.col("leaf"), "value"))).alias("_map"), F.coalesce(F.max("tree"), F.lit(0)).alias("_last"), (F.coalesce(F.max("leaf"), F.lit(0)) + 1).alias("_wide"))
    slots = F.transform(F.sequence(F.lit(0), (F.col("_last") + 1) * F.col("_wide") - 1), lambda i: F.try_element_at("_map", (F.floor(i / F.col("_wide")) * SLOTS + i % F.col("_wide")).cast("int")))
    table = staged(listed.select(slots.alias("_table"), "_wide"))
    met = model.setLeafCol("leaf").transform(rows).drop(model.getPredictionCol()).join(F.broadcast(table))
    mine = F.filter(F.transform(vector_to_array("leaf"), lambda x, i: F.when(x < F.col("_wide"), F.get("_table", (i * F.col("_wide") + x.cast("int")).cast("int")))), lambda x: x.isNotNull())
    return met.withColumn("_mine", mine).withColumn("tau", F.aggregate("_mine", F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size("_mine"), F.lit(0))).drop("_mine", "_table", "_wide", "leaf")


def honest_effects(df: DataFrame, key: str = "unit", trees: int = 200, least: int = 5, depth: int = 5) -> tuple[DataFrame, np.ndarray]:
    """``df`` (x, d, w) with p_d, e and the honest effect tau of every unit, and the splits' importance of the columns of x."""
    s = by_forests(df, key, [Forest("p_d", "d")], trees, least, 3).withColumns({"u": F.col("d") - F.col("p_d"), "v": F.col("w") - F.col("e")})
    s = staged(s.withColumns({"ratio": F.col("u") / F.col("v"), "size": F.col("v") * F.col("v"), "part": F.pmod(F.xxhash64(F.lit(3), key), F.lit(3))}))
    out, importance = None, 0.0
    for p in range(3):
        made = RandomForestRegressor(featuresCol="x", labelCol="ratio", weightCol="size", numTrees=trees, minInstancesPerNode=least, maxDepth=depth, seed=1)
        model = made.fit(s.where(F.col("part") == (p + 1) % 3))
        done = with_effect(model, s.where(F.col("part") == p), leaf_values(model, s.where(F.col("part") == (p + 2) % 3)))
        importance = importance + model.featureImportances.toArray() / 3
        out = done if out is None else out.unionByName(done)
    return staged(out), importance


def treated_effect(s: DataFrame, cluster: str, least_clusters: int = 6) -> dict:
    """Doubly robust effect on the treated from p_d, e and tau: the mean tau of the treated and weighted residuals of both arms.
    Errors are by cluster where there are ``least_clusters`` of them, by unit below."""
    odds = F.col("e") / (1 - F.col("e"))
    a = s.agg(F.count("*").alias("n"), F.sum("w").alias("n1"), F.sum((1 - F.col("w")) * odds).alias("odds"), F.avg(F.when(F.col("w") == 1, F.col("tau"))).alias("tau"), F.count_distinct(cluster).alias("g")).first()
    n, n1 = float(a["n"]), float(a["n1"])
    treated = F.col("w") * (F.col("d") - F.col("p_d") - (1 - F.col("e")) * F.col("tau")) * (n / n1)
    control = (1 - F.col("w")) * (F.col("d") - F.col("p_d") + F.col("e") * F.col("tau")) * odds * (n / float(a["odds"]))
    rows = s.select(F.col(cluster).alias("c") if a["g"] >= least_clusters else F.monotonically_increasing_id().alias("c"), (treated - control).alias("r"), (F.col("w") * (F.col("tau") - float(a["tau"]))).alias("t"))
    by = rows.groupBy("c").agg(F.sum("r").alias("r"), F.sum("t").alias("t")).agg(F.sum("r").alias("sum"), F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("t") * F.col("t")).alias("tt")).first()
    estimate, se = float(a["tau"] + by["sum"] / n), float(np.sqrt(by["tt"] / n1**2 + by["rr"] / n**2))
    clustered = a["g"] >= least_clusters
    p = (t_p(estimate / se, a["g"] - 1) if clustered else normal_p(estimate / se)) if se > 0 else float("nan")
    return {"estimate": estimate, "se": se, "p_value": p, "n": int(n), "n_clusters": a["g"] if clustered else int(n)}


def honest_forest(df: DataFrame, covariates: list[str], cluster: str, key: str = "unit", trees: int = 200, least: int = 5) -> DataFrame:
    """(term, estimate, se, p_value, n): the effect on the treated, the spread of the units' effects, each covariate's importance."""
    s, importance = honest_effects(df, key, trees, least)
    s = s.where("tau IS NOT NULL")
    r = treated_effect(s, cluster)
    spread = s.agg(F.stddev_samp("tau")).first()[0]
    rows = [("att", r["estimate"], r["se"], r["p_value"], r["n"]), ("effect sd", float(spread), None, None, r["n"])] + [(f"importance {c}", float(x), None, None, r["n"]) for c, x in zip(covariates, importance, strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, se double, p_value double, n long")
