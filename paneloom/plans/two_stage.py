"""Two-stage effects: unit and period effects from untreated rows, then what they leave of the treated ones.

The first stage is two passes of additive sums, like the core's. With a unit's effect eliminated, its normal equations are one
system of periods and covariates, whose right sides are the outcome and, for each cell of the second stage, what the cell's rows
ask of the first stage. Solving all of them at once gives the effects and, for every untreated row, its weight in each cell's
estimate. So the influence of both stages is known by row: a cell's residuals less weighted first-stage residuals. It is summed
by cluster and squared in Spark; periods x (periods + cells) numbers reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paneloom.sources.staging import staged

from .fe import Fit


def _solve(m: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """A solution of a symmetric, maybe singular system; an error where there is none (effects that aren't comparable)."""
    scale = 1 / np.sqrt(np.maximum(np.diag(m), 1e-300))
    scaled, right = m * np.outer(scale, scale), rhs * scale[:, None]
    found = np.linalg.pinv(scaled, rcond=1e-10, hermitian=True) @ right
    if np.abs(scaled @ found - right).max(initial=0) > 1e-7 * max(1.0, np.abs(right).max(initial=0)):
        raise ValueError("some period's effect cannot be told from the untreated rows")
    return found * scale[:, None]


def two_stage(df: DataFrame, y: str, free: str, cell: str, unit: str, period: str, cluster: str, xs: tuple[str, ...] = (), centre: tuple[str, ...] = ()) -> Fit | None:
    """Mean of y less its untreated prediction in each ``cell`` (null: not in the second stage), with errors that carry the
    first stage's.

    ``free``: the row is untreated and teaches the first stage. Residuals of the second stage are net of the mean of the cell
    or, with ``centre``, of finer groups of it. Rows with a null in y or xs are left out, and so are rows of a unit or of a
    period without untreated rows, for which nothing is predicted. Without a row in a cell the result is None.
    """
    cols = [y, *xs]
    base = df.select(
        F.col(unit).alias("_u"), F.col(period).cast("string").alias("_p"), F.col(cluster).alias("_c"), F.coalesce(F.col(free), F.lit(False)).alias("_free"),
        F.col(cell).cast("string").alias("_k"), F.concat_ws("|", cell, *centre).alias("_g"), *(F.col(c).cast("double").alias(f"_z{i}") for i, c in enumerate(cols)),
    ).na.drop(subset=["_u", "_p", "_c", *(f"_z{i}" for i in range(len(cols)))])
    periods = base.where("_free").select("_p").distinct()
    base = base.join(F.broadcast(periods), "_p", "left_semi")  # a row a period
    by_unit = Window.partitionBy("_u")
    mine = lambda c: F.sum(F.when(F.col("_free"), c)).over(by_unit) / F.col("_n")  # noqa: E731  a unit's mean over untreated rows
    base = base.withColumn("_n", F.count_if("_free").over(by_unit)).where("_n > 0")
    base = staged(base.withColumns({f"_z{i}": F.col(f"_z{i}") - mine(F.col(f"_z{i}")) for i in range(len(cols))}))
    cells = sorted((r[0] for r in base.where("_k IS NOT NULL").select("_k").distinct().collect()), key=lambda k: (len(k), k))
    if not cells:
        return None
    inside = [F.coalesce(F.col("_k") == k, F.lit(False)).cast("double") for k in cells]
    rows = staged(base.withColumns({f"_r{j}": F.sum(inside[j]).over(by_unit) / F.col("_n") for j in range(len(cells))}))
    when = lambda c: F.sum(F.when(F.col("_free"), c).otherwise(0.0))
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    sums = rows.groupBy("_p").agg(
        F.count_if("_free").alias("n"), *(when(F.col(f"_z{i}")).alias(f"d{i}") for i in range(len(cols))), *(when(F.col(f"_z{i}") * F.col(f"_z{j}")).alias(f"q{i}_{j}") for i, j in pairs),
        *((F.sum(inside[k]) - when(F.col(f"_r{k}"))).alias(f"t{k}") for k in range(len(cells))), *(F.sum(inside[k] * F.col(f"_z{i}")).alias(f"x{k}_{i}") for k in range(len(cells)) for i in range(1, len(cols))),
    ).orderBy("_p").collect()
    seen = rows.where("_free").groupBy("_u", "_p").agg(F.count("*").alias("w"), F.first("_n").alias("_n"))
    together = seen.groupBy("_u").agg(F.collect_list(F.struct("_p", "w")).alias("s"), F.first("_n").alias("_n"))  # a unit's periods
    together = together.select("_n", "s", F.explode("s").alias("a")).select("_n", "a", F.explode("s").alias("b"))
    shared = together.groupBy(F.col("a._p").alias("p"), F.col("b._p").alias("q")).agg(F.sum(F.col("a.w") * F.col("b.w") / F.col("_n")).alias("c")).collect()

    names, p = [r["_p"] for r in sums], len(xs)
    at = {name: i for i, name in enumerate(names)}
    a = np.diag([float(r["n"]) for r in sums])
    for r in shared:
        a[at[r["p"]], at[r["q"]]] -= r["c"]
    d = np.array([[r[f"d{i}"] for i in range(p + 1)] for r in sums])
    q = np.zeros((p + 1, p + 1))
    for i, j in pairs:
        q[i, j] = q[j, i] = sum(r[f"q{i}_{j}"] for r in sums)
    asked = np.array([[r[f"t{k}"] for k in range(len(cells))] for r in sums])
    asked_x = np.array([[sum(r[f"x{k}_{i}"] for r in sums) for k in range(len(cells))] for i in range(1, p + 1)]).reshape(p, len(cells))
    found = _solve(np.block([[a, d[:, 1:]], [d[:, 1:].T, q[1:, 1:]]]), np.block([[d[:, :1], asked], [q[1:, :1], asked_x]]))
    shift, slopes = found[: len(names)], found[len(names) :]

    spark = df.sparkSession
    effects = F.broadcast(spark.createDataFrame([(n, [float(v) for v in shift[i]]) for i, n in enumerate(names)], "_p string, _s array<double>"))  # a row a period
    net = lambda i: F.get("_s", F.lit(i)) - mine(F.get("_s", F.lit(i)))
    fitted = lambda i: net(i) + sum((F.lit(float(slopes[j, i])) * F.col(f"_z{j + 1}") for j in range(p)), F.lit(0.0))
    weights = {f"_v{k}": F.col(f"_r{k}") + fitted(k + 1) for k in range(len(cells))}
    out = staged(rows.join(effects, "_p").withColumns(weights | {"_e": F.col("_z0") - fitted(0)}).select("_u", "_c", "_free", "_k", "_g", "_e", *weights))
    means = {r["_k"]: (r["b"], r["n"]) for r in out.where("_k IS NOT NULL").groupBy("_k").agg(F.avg("_e").alias("b"), F.count("*").alias("n")).collect()}
    middle = F.broadcast(out.where("_k IS NOT NULL").groupBy("_g").agg(F.avg("_e").alias("_m")))  # a row a cell, or a part of one
    out = out.join(middle, "_g", "left")
    own = lambda k: (inside[k] * (F.col("_e") - F.coalesce("_m", F.lit(0.0))) - F.when(F.col("_free"), F.col(f"_v{k}") * F.col("_e")).otherwise(0.0)) / means[cells[k]][1]
    scores = out.groupBy("_c").agg(*(F.sum(own(k)).alias(f"s{k}") for k in range(len(cells))), F.count("*").alias("n"))
    duo = [(i, j) for i in range(len(cells)) for j in range(i, len(cells))]
    meat = scores.agg(F.count("*").alias("g"), F.sum("n").alias("n"), *(F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i, j in duo)).first()
    var = np.zeros((len(cells), len(cells)))
    for i, j in duo:
        var[i, j] = var[j, i] = meat[f"m{i}_{j}"]
    units = out.agg(F.count_distinct("_u")).first()[0]
    return Fit(cells, np.array([means[k][0] for k in cells]), var, meat["n"], units, meat["g"], meat["g"] - 1, {n: float(shift[i, 0]) for i, n in enumerate(names)}, {k: means[k][1] for k in cells})
