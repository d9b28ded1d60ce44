"""Outcomes predicted from other columns by ridge regressions whose inputs are sums.

A ridge fit needs cross products only. They are summed by cluster in Spark, so leaving a cluster out is a subtraction and a small
solve in a task: no row is read again. Ground outcomes are fitted on a few site means in the same way, with the penalty of the
least left-out error, which is each mean's residual over one less its leverage.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.sources.staging import staged

from .stats import t_p


def _cross(xs: list[str], y: str) -> list:
    """Sums of the surrogates, the outcome and their products."""
    cols = [*xs, y]
    return [F.count("*").alias("n"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)), *(F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"q{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols)))]


def _effect(m: pd.DataFrame, p: int, ridge: float) -> dict | None:
    """Effect, error before the start and fit from sums by arm, post and year; None below ten control rows or if a treated part
    is empty."""
    q = lambda i, j: f"q{min(i, j)}_{max(i, j)}"
    control, treated = m[m.treated == 0].groupby("year").sum(), m[m.treated == 1]
    n = control.n.sum()
    if n < 10 or not (treated.post == 0).any() or not (treated.post == 1).any():
        return None
    years = sorted(m.year.unique())
    by_year = control.reindex(years, fill_value=0)
    mean = np.array([control[f"s{i}"].sum() / n for i in range(p)])
    raw = np.array([[control[q(i, j)].sum() for j in range(p)] for i in range(p)])
    scale = np.sqrt(np.maximum(np.diag(raw) / n - mean**2, 0)) + 1e-12
    k = p + len(years)
    gram, right = np.zeros((k, k)), np.zeros(k)
    gram[:p, :p] = (raw - n * np.outer(mean, mean)) / np.outer(scale, scale)
    for t in range(len(years)):
        row = by_year.iloc[t]
        gram[:p, p + t] = gram[p + t, :p] = [(row[f"s{i}"] - row.n * mean[i]) / scale[i] for i in range(p)]
        gram[p + t, p + t], right[p + t] = row.n, row[f"s{p}"]
    total = control[f"s{p}"].sum()
    right[:p] = [(control[q(i, p)].sum() - mean[i] * total) / scale[i] for i in range(p)]
    b = np.linalg.solve(gram + np.diag(np.r_[np.full(p, ridge * n), np.full(len(years), 1e-8 * n)]), right)
    slopes, levels = b[:p] / scale, dict(zip(years, b[p:], strict=True))

    def residual(part: pd.DataFrame) -> float:
        fitted = sum(((part[f"s{i}"] - part.n * mean[i]) * slopes[i]).sum() for i in range(p)) + (part.n * part.year.map(levels)).sum()
        return float((part[f"s{p}"].sum() - fitted) / part.n.sum())

    def squares(part: pd.DataFrame) -> float:
        """Sum of squared residuals, from the cross products."""
        out = 0.0
        for r in part.itertuples():
            c = -levels[r.year] + float(mean @ slopes)  # residual = y - slopes x + c
            w = np.r_[-slopes, 1.0]
            s = np.array([getattr(r, f"s{i}") for i in range(p + 1)])
            full = np.array([[getattr(r, q(i, j)) for j in range(p + 1)] for i in range(p + 1)])
            out += w @ full @ w + 2 * c * (w @ s) + c * c * r.n
        return float(out)

    pre, post = treated[treated.post == 0], treated[treated.post == 1]
    spread = control[q(p, p)].sum() - total**2 / n
    return {"estimate": residual(post) - residual(pre), "pre_rmspe": float(np.sqrt(max(squares(pre), 0) / pre.n.sum())), "r2_control": float(1 - squares(m[m.treated == 0]) / max(spread, 1e-300)), "slopes": slopes}


def surrogate_index(rows: DataFrame, y: str, surrogates: list[str], ridge: float = 1e-3) -> DataFrame:
    """Effect on what the surrogates and year effects of the controls do not predict of the treated.

    ``rows``: year, cluster, treated and post (0 or 1), y and the surrogates, one row a unit and year; rows with a null are left
    out. The error is the jackknife that leaves out a cluster's rows from the fit and from the treated means.
    """
    p = len(surrogates)
    clean = rows.select(F.col("year").cast("int").alias("year"), F.col("cluster").cast("string").alias("cluster"), F.col("treated").cast("int").alias("treated"), F.col("post").cast("int").alias("post"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate([*surrogates, y]))).na.drop()
    sums = staged(clean.groupBy("cluster", "treated", "post", "year").agg(*_cross([f"x{i}" for i in range(p)], f"x{p}")))
    names = [c for c in sums.columns if c not in ("cluster", "treated", "post", "year")]
    whole = sums.groupBy("treated", "post", "year").agg(*(F.sum(c).alias(c) for c in names)).toPandas()  # a row an arm and year
    found = _effect(whole, p, ridge) if len(whole) else None
    types = "estimate double, se double, p_value double, pre_rmspe double, r2_control double, n long, n_clusters long, slopes array<double>"
    if found is None:
        return rows.sparkSession.createDataFrame([], types)
    keys = ["treated", "post", "year"]

    def without(own: pd.DataFrame) -> pd.DataFrame:
        rest = whole.set_index(keys)[names].sub(own.set_index(keys)[names], fill_value=0).reset_index()
        part = _effect(rest[rest.n > 0], p, ridge)
        return pd.DataFrame({"estimate": [part["estimate"]] if part else []}, dtype=float)

    left = sums.groupBy("cluster").applyInPandas(without, "estimate double")  # a cluster's years
    j = left.agg(F.count("*").alias("k"), F.var_pop("estimate").alias("v")).first()
    se = float(np.sqrt((j["k"] - 1) * j["v"])) if j["k"] >= 2 else float("nan")
    clusters = sums.agg(F.count_distinct("cluster")).first()[0]
    row = (found["estimate"], se, t_p(found["estimate"] / se, max(j["k"] - 1, 1)) if se > 0 else float("nan"), found["pre_rmspe"], found["r2_control"], int(whole.n.sum()), clusters, [float(b) for b in found["slopes"]])
    return rows.sparkSession.createDataFrame([row], types)


#: The penalties that the left-out error chooses from.
PENALTIES = (0.1, 1.0, 10.0, 100.0)


def ground_fit(means: DataFrame, y: str, xs: list[str], least: int = 6) -> dict | None:
    """Ridge of ``y`` on standardised ``xs`` over ``means`` (rows with a null are left out): intercept, slopes, penalty, rows and
    left-out r2. None below ``least`` rows."""
    p = len(xs)
    clean = staged(means.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate([*xs, y]))).na.drop())
    s = clean.agg(*_cross([f"x{i}" for i in range(p)], f"x{p}")).first()
    n = s["n"]
    if n < least:
        return None
    mean = np.array([s[f"s{i}"] / n for i in range(p + 1)])
    cross = np.array([[s[f"q{min(i, j)}_{max(i, j)}"] for j in range(p + 1)] for i in range(p + 1)]) - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cross)[:p] / n, 0))
    scale[scale == 0] = 1.0
    gram, right = cross[:p, :p] / np.outer(scale, scale), cross[:p, p] / scale
    z = [(F.col(f"x{i}") - float(mean[i])) / float(scale[i]) for i in range(p)]
    errors, inverse = [], [np.linalg.inv(gram + a * np.eye(p)) for a in PENALTIES]
    for inv in inverse:
        b = inv @ right
        fitted = float(mean[p]) + sum((float(b[i]) * z[i] for i in range(p)), F.lit(0.0))
        leverage = 1 / n + sum((float(inv[i, j]) * z[i] * z[j] for i in range(p) for j in range(p)), F.lit(0.0))
        errors.append(F.avg(F.pow((F.col(f"x{p}") - fitted) / (1 - leverage), 2)))
    mse = list(clean.agg(*errors).first())
    best = int(np.argmin(mse))
    slopes = inverse[best] @ right / scale
    spread = cross[p, p] / n
    return {"intercept": float(mean[p] - slopes @ mean[:p]), "slopes": [float(b) for b in slopes], "penalty": PENALTIES[best], "n": n, "r2_left_out": float(1 - mse[best] / spread) if spread > 0 else float("nan")}


def ground_outcome(panel: DataFrame, fit: dict, xs: list[str], name: str) -> DataFrame:
    """``panel`` with the fitted ground outcome of every row as column ``name``."""
    return panel.withColumn(name, F.lit(fit["intercept"]) + sum((F.lit(b) * F.col(c) for b, c in zip(fit["slopes"], xs, strict=True)), F.lit(0.0)))
