"""Two-way fixed effects as two passes of additive sums.

Pass 1 takes unit means off and sums cross products, by period too, and how often two periods share a unit. What meets on
the driver is periods x periods, whatever the rows. The driver solves for period effects and slopes, dropping collinear
regressors. Pass 2 forms residuals and sums scores by cluster; the cluster sums are squared in Spark. ``keys`` make
one grouped job of many regressions (outcomes, seasons, sites, fake years, stacks).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paneloom.sources.staging import staged

from .stats import t_p

RESULT = "term string, estimate double, se double, p_value double, se_how string, n_obs long, n_units long, n_clusters long"


@dataclass
class Fit:
    """One regression: slopes of the regressors that stay, their variance, and the sizes behind them."""

    terms: list[str]
    beta: np.ndarray
    var: np.ndarray
    n_obs: int
    n_units: int
    n_clusters: int
    df: float
    period_effects: dict | None = None
    rows: dict | None = None

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.var), 0))

    def linear(self, weights: np.ndarray) -> tuple[float, float, float]:
        """Estimate, standard error and p of a weighted sum of slopes."""
        est, se = float(weights @ self.beta), float(np.sqrt(max(weights @ self.var @ weights, 0)))
        return est, se, t_p(est / se, self.df) if se > 0 else float("nan")


def _independent(m: np.ndarray, tolerance: float = 1e-9) -> list[int]:
    """Columns of a cross-product matrix that aren't combinations of those before them."""
    kept: list[int] = []
    for j in range(len(m)):
        if m[j, j] <= 0:
            continue
        if kept:
            rest = m[j, j] - m[j, kept] @ np.linalg.lstsq(m[np.ix_(kept, kept)], m[kept, j], rcond=None)[0]
            if rest <= tolerance * m[j, j]:
                continue
        kept.append(j)
    return kept


def twfe(df: DataFrame, y: str, xs: list[str], unit: str, period: str, cluster: str, keys: tuple[str, ...] = (), weight: str | None = None, nested: bool = True) -> dict[tuple, Fit]:
    """Slopes of ``xs`` on ``y`` with unit and period effects for each value of ``keys``; rows with a null are left out,
    units seen once too. Standard errors are CR1 by ``cluster``; ``nested``: units lie within clusters, and count once."""
    cols = [y, *xs]
    base = df.select(*keys, F.col(unit).alias("_u"), F.col(period).cast("string").alias("_p"), F.col(cluster).alias("_c"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"), *(F.col(c).cast("double").alias(f"_z{i}") for i, c in enumerate(cols))).na.drop()
    base = base.where("_w > 0")
    by_unit = Window.partitionBy(*keys, "_u")
    within = base.withColumn("_n", F.count("*").over(by_unit)).where("_n > 1").withColumn("_total", F.sum("_w").over(by_unit))
    z = [f"_z{i}" for i in range(len(cols))]
    within = within.withColumns({c: F.col(c) - F.sum(F.col("_w") * F.col(c)).over(by_unit) / F.col("_total") for c in z})
    within = staged(within)  # three passes read it
    pairs = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
    sums = within.groupBy(*keys, "_p").agg(
        F.sum("_w").alias("w"), F.count("*").alias("n"), F.sum(1 / F.col("_n")).alias("units"), *(F.sum(F.col("_w") * F.col(c)).alias(f"d{i}") for i, c in enumerate(z)), *(F.sum(F.col("_w") * F.col(z[i]) * F.col(z[j])).alias(f"q{i}_{j}") for i, j in pairs)
    ).collect()
    seen = within.groupBy(*keys, "_u", "_p").agg(F.sum("_w").alias("w"), F.first("_total").alias("_total"))
    together = seen.groupBy(*keys, "_u").agg(F.collect_list(F.struct("_p", "w")).alias("s"), F.first("_total").alias("_total"))  # a unit's periods
    together = together.select(*keys, "_total", "s", F.explode("s").alias("a")).select(*keys, "_total", "a", F.explode("s").alias("b"))
    shared = together.groupBy(*keys, F.col("a._p").alias("p"), F.col("b._p").alias("q")).agg(F.sum(F.col("a.w") * F.col("b.w") / F.col("_total")).alias("c")).collect()

    groups: dict[tuple, dict] = {}
    for r in sums:
        groups.setdefault(tuple(r[k] for k in keys), {"rows": [], "c": {}})["rows"].append(r)
    for r in shared:
        groups[tuple(r[k] for k in keys)]["c"][r["p"], r["q"]] = r["c"]
    solved, effects = {}, []
    for key, g in groups.items():
        rows = sorted(g["rows"], key=lambda r: r["_p"])
        names = [r["_p"] for r in rows]
        d = np.array([[r[f"d{i}"] for i in range(len(z))] for r in rows])
        q = np.zeros((len(z), len(z)))
        for i, j in pairs:
            q[i, j] = q[j, i] = sum(r[f"q{i}_{j}"] for r in rows)
        a = np.diag([r["w"] for r in rows]) - np.array([[g["c"].get((p, s), 0.0) for s in names] for p in names])
        w = np.linalg.pinv(a, rcond=1e-10, hermitian=True) @ d
        m = q - d.T @ w
        kept = [1 + j for j in _independent(m[1:, 1:])]
        inner = m[np.ix_(kept, kept)]
        beta = np.linalg.solve(inner, m[kept, 0]) if kept else np.zeros(0)
        shift = w[:, 0] - w[:, kept] @ beta
        rank = int(np.linalg.matrix_rank(a, tol=1e-8 * max(1.0, np.trace(a))))
        solved[key] = (kept, beta, inner, names, w, shift, sum(r["n"] for r in rows), round(sum(r["units"] for r in rows)), rank)
        effects += [(*key, p, [float(x) for x in w[i, kept]], float(shift[i]), kept, [float(b) for b in beta]) for i, p in enumerate(names)]
    if not solved:
        return {}
    spark = df.sparkSession
    types = ", ".join([f"{k} {within.schema[k].dataType.simpleString()}" for k in keys] + ["_p string, wx array<double>, shift double, kept array<int>, beta array<double>"])
    table_ = F.broadcast(spark.createDataFrame(effects, types))  # a row for each key and period
    x_all = F.array(*(F.col(c) for c in z))
    joined = within.join(table_, [*keys, "_p"])
    wide = max(len(x[0]) for x in solved.values())
    # period effects enter net of their unit's mean, like every other column; the rows are still dealt by unit
    off = lambda c: c - F.sum(F.col("_w") * c).over(by_unit) / F.col("_total")
    mine = F.transform("kept", lambda i: F.get(x_all, i))
    nets = {"_shift": off(F.col("shift"))} | {f"_x{j}": F.coalesce(F.get(mine, F.lit(j)) - off(F.get("wx", F.lit(j))), F.lit(0.0)) for j in range(wide)}
    resid = F.col("_z0") - F.col("_shift") - F.aggregate(F.zip_with("beta", mine, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    scored = joined.withColumns(nets).withColumn("_e", F.col("_w") * resid)
    scores = scored.groupBy(*keys, "_c").agg(F.count("*").alias("_rows"), *(F.sum(F.col(f"_x{j}") * F.col("_e")).alias(f"s{j}") for j in range(wide)))
    duo = [(i, j) for i in range(wide) for j in range(i, wide)]
    meat = {tuple(r[k] for k in keys): r for r in scores.groupBy(*keys).agg(F.count("*").alias("g"), *(F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i, j in duo)).collect()}
    out = {}
    for key, (kept, beta, inner, names, w, shift, n, units, rank) in solved.items():
        r, k = meat[key], len(kept)
        s = np.zeros((k, k))
        for i, j in duo:
            if j < k:
                s[i, j] = s[j, i] = r[f"m{i}_{j}"]
        inv, g = np.linalg.inv(inner) if k else np.zeros((0, 0)), r["g"]
        effects_counted = (1 if nested else units) + rank
        scale = (g / (g - 1) if g > 1 else float("nan")) * (n - 1) / max(n - k - effects_counted, 1)
        out[key] = Fit([xs[i - 1] for i in kept], beta, inv @ s @ inv * scale, n, units, g, g - 1, dict(zip(names, shift, strict=True)))
    return out


def results(spark: SparkSession, fits: dict[tuple, Fit], keys: tuple[str, ...] = (), key_types: str = "") -> DataFrame:
    """The fits as rows, a term each."""
    rows = []
    for key, f in fits.items():
        for i, term in enumerate(f.terms):
            se = float(f.se[i])
            rows.append((*key, term, float(f.beta[i]), se, t_p(f.beta[i] / se, f.df) if se > 0 else None, "CR1", f.n_obs, f.n_units, f.n_clusters))
    return spark.createDataFrame(rows, f"{key_types}, {RESULT}" if keys else RESULT)
