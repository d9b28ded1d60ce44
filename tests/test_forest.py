"""The honest forest: leaves filled by other units, a known effect covered, importance."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from paneloom.plans import forest, ml


@pytest.fixture(scope="module")
def units():
    rng = np.random.default_rng(0)
    n = 1500
    d = pd.DataFrame({"unit": range(n), "site": np.arange(n) % 20, "a": rng.normal(size=n), "b": rng.normal(size=n), "c": rng.normal(size=n)})
    d["w"] = (rng.random(n) < 1 / (1 + np.exp(-0.5 * d.b))).astype(float)
    d["effect"] = 1 + 2 * (d.a > 0)
    d["d"] = d.b + d.effect * d.w + 0.5 * rng.normal(size=n)
    return d


def test_leaves_are_filled_by_other_rows(spark, units):
    """Leaf slopes and looked-up effects by hand from the leaf ids."""
    rows = ml.assembled(spark.createDataFrame(units.assign(u=units.d - units.b, v=units.w - 0.5, ratio=units.a)), ["a", "b", "c"])
    model = RandomForestRegressor(featuresCol="x", labelCol="ratio", numTrees=7, maxDepth=3, seed=1).fit(rows.where("unit % 2 = 0"))
    other, third = rows.where("unit % 2 = 1 AND unit < 200"), rows.where("unit >= 1400")
    values = forest.leaf_values(model, other)
    ids = lambda d: {r.unit: [int(x) for x in r.leaf] for r in model.setLeafCol("leaf").transform(d).select("unit", "leaf").collect()}
    u = {r.unit: (r.u, r.v) for r in other.collect()}
    uv, vv = {}, {}
    for unit, leaves in ids(other).items():
        for t, leaf in enumerate(leaves):
            uv[t, leaf] = uv.get((t, leaf), 0) + u[unit][0] * u[unit][1]
            vv[t, leaf] = vv.get((t, leaf), 0) + u[unit][1] ** 2
    got = {(r.tree, r.leaf): r.value for r in values.collect()}
    assert set(got) == set(uv) and all(abs(got[k] - uv[k] / vv[k]) < 1e-9 for k in got)
    few = values.where("tree < 2")
    assert "try_element_at" not in forest.with_effect(model, third, values)._jdf.queryExecution().optimizedPlan().toString()  # rows look leaves up by place
    for unit, tau in {r.unit: r.tau for r in forest.with_effect(model, third, few).collect()}.items():
        mine = [got[t, leaf] for t, leaf in enumerate(ids(third.where(F.col("unit") == unit))[unit][:2]) if (t, leaf) in got]
        assert (tau is None and not mine) or abs(tau - np.mean(mine)) < 1e-9
        if unit > 1405:
            break


def test_known_effect_is_covered(spark, units):
    rows = {r.term: r for r in forest.honest_forest(ml.assembled(spark.createDataFrame(units), ["a", "b", "c"]), ["a", "b", "c"], "site", trees=40).collect()}
    true = units[units.w == 1].effect.mean()
    assert abs(rows["att"].estimate - true) < 3 * rows["att"].se < 0.5
    assert rows["importance a"].estimate > max(rows["importance b"].estimate, rows["importance c"].estimate)
    assert abs(sum(rows[f"importance {c}"].estimate for c in "abc") - 1) < 1e-9 and 0.5 < rows["effect sd"].estimate < 1.5


def test_learners_find_the_effect(spark, units):
    got = {r.learner: r for r in ml.meta_learners(ml.assembled(spark.createDataFrame(units), ["a", "b", "c"]), trees=30).collect()}
    assert set(got) == {"S", "T", "X"} and all(abs(r.att - units[units.w == 1].effect.mean()) < 0.35 for r in got.values())
