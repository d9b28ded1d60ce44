"""Forests grown from sums by cell: against pyspark.ml's forests, a split by hand, folds, crowded cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import RandomForestRegressor

from paneloom.plans import cells, ml


@pytest.fixture(scope="module")
def units(spark):
    rng = np.random.default_rng(1)
    n = 3000
    d = pd.DataFrame({"unit": range(n), "a": rng.normal(size=n), "b": rng.normal(size=n), "c": rng.integers(0, 5, n).astype(float)})
    d["w"] = (rng.random(n) < 1 / (1 + np.exp(-d.b))).astype(float)
    d["d"] = 1e4 + 2 * d.a + d.c + rng.normal(size=n)
    return ml.assembled(spark.createDataFrame(d), ["a", "b", "c"]).cache()


def test_poisson_counts():
    k = cells.draws(np.random.default_rng(0).integers(0, 1 << 63, 50_000).astype(np.uint64), 3)
    assert abs(k.mean() - 1) < 0.01 and abs(k.var() - 1) < 0.02 and k.max() < 12
    assert np.abs(np.corrcoef(k.T) - np.eye(cells.BLOCK)).max() < 0.02


def test_one_split_by_hand():
    rng = np.random.default_rng(2)
    bins, n = rng.integers(0, 6, (200, 2)), rng.integers(1, 4, 200).astype(float)
    s = n * (bins[:, 1] > 3) + rng.normal(size=200)
    got = cells.grown(bins, (n, n, s), 2, 5, 1, rng)
    best = min(((j, at) for j in range(2) for at in range(5)), key=lambda x: -sum(s[m].sum() ** 2 / n[m].sum() for m in (bins[:, x[0]] <= x[1], bins[:, x[0]] > x[1])))
    right = bins[:, best[0]] > best[1]
    assert np.allclose(got, np.where(right, s[right].sum() / n[right].sum(), s[~right].sum() / n[~right].sum()))


def test_leaves_of_one_majority_are_one():
    bins, n = np.arange(4)[:, None], np.full(4, 20.0)
    shares = lambda s: cells.grown(bins, (n, n, np.array(s, float)), 1, 5, 2, np.random.default_rng(0), share=True).tolist()
    assert shares([1, 4, 12, 18]) == [0.125, 0.125, 0.75, 0.75] and shares([1, 2, 3, 8]) == [0.175] * 4


def test_forest_is_like_that_of_pyspark(units):
    mine = cells.predicted(units, "unit", [cells.Forest("p", "d"), cells.Forest("e", "w", share=True)], 100, 10).toPandas().sort_values("unit")
    model = RandomForestRegressor(featuresCol="x", labelCol="d", numTrees=100, minInstancesPerNode=10, maxDepth=5, seed=1).fit(units)
    theirs = model.transform(units).toPandas().sort_values("unit")
    gap = mine.p.to_numpy() - theirs.prediction.to_numpy()
    assert np.sqrt((gap**2).mean()) < 0.2 < theirs.prediction.std() and len(mine) == 3000
    assert mine.e.between(0, 1).all() and np.corrcoef(mine.e, 1 / (1 + np.exp(-mine.b)))[0, 1] > 0.9


def test_rows_are_predicted_by_other_folds_and_repeat(units):
    """A label that is the fold itself can't be known from the other folds."""
    dealt = units.selectExpr("unit", "x", "pmod(xxhash64(unit), 3) AS own")
    one = cells.predicted(dealt, "unit", [cells.Forest("p", "IF(own = 1, 5D, 0D)")], 20, 10, folds=3).toPandas().sort_values("unit")
    assert (one.p[one.own == 1].abs() < 1e-5).all() and abs(one.p[one.own != 1].mean() - 2.5) < 0.2
    again = cells.predicted(dealt, "unit", [cells.Forest("p", "IF(own = 1, 5D, 0D)")], 20, 10, folds=3).toPandas().sort_values("unit")
    assert np.allclose(one.p, again.p, atol=1e-5)


def test_one_pass_and_crowded_cells(spark, units):
    """Rows of one cell are dealt to several tasks; trees cost no further passes over the rows."""
    same = ml.assembled(spark.range(4000).selectExpr("id AS unit", "1D AS a", "id % 2 + 0D AS w", "CAST(id % 10 AS DOUBLE) AS d"), ["a"])
    got = cells.predicted(same, "unit", [cells.Forest("p", "d", among="w")], 40, 10)
    assert all(abs(r.p - 5) < 0.1 for r in got.select("p").distinct().collect())
    jobs = []
    for trees in (8, 64):
        spark.sparkContext.setJobGroup(f"trees {trees}", "")
        ml.dml(units, trees=trees)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"trees {trees}")))
    assert abs(jobs[0] - jobs[1]) <= 2 and max(jobs) < 20
