"""Known answers and identities of the estimators."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paneloom.plans import models as M
from paneloom.plans.fe import twfe
from paneloom.plans.stats import chi2_p, f_p, normal_p, t_p
from paneloom.plans.synth import elastic_net_control, elastic_net_cv, elastic_path, penalties, pixel_weights, simplex_ridge, synthetic_did, synthetic_weights
from paneloom.plans.two_stage import two_stage


@pytest.fixture(scope="module")
def panel():
    rng = np.random.default_rng(0)
    rows = [(u, p, u % 9, float(u % 3 == 0 and p >= 4), rng.normal(), rng.normal() + 0.1 * u + p) for u in range(60) for p in range(8) if rng.random() < 0.8]
    d = pd.DataFrame(rows, columns=["unit", "year", "site_id", "did_term", "x", "y"])
    d["x2"] = 2 * d.x
    d["y"] += 0.5 * d.did_term + 0.3 * d.x
    return d


def test_twfe_is_least_squares_with_dummies(spark, panel):
    fit = twfe(spark.createDataFrame(panel), "y", ["did_term", "x", "x2"], "unit", "year", "site_id")[()]
    d = panel[panel.groupby("unit").y.transform("size") > 1]
    x = np.c_[d.did_term, d.x, pd.get_dummies(d.unit), pd.get_dummies(d.year).iloc[:, 1:]].astype(float)
    b = np.linalg.lstsq(x, d.y, rcond=None)[0]
    e, inv, g = (d.y - x @ b).to_numpy(), np.linalg.inv(x.T @ x), d.site_id.nunique()
    s = np.array([x[d.site_id == c].T @ e[d.site_id == c] for c in d.site_id.unique()])
    v = inv @ s.T @ s @ inv * g / (g - 1) * (len(d) - 1) / (len(d) - 2 - 8)
    assert fit.terms == ["did_term", "x"]  # the collinear one is dropped
    assert np.allclose(fit.beta, b[:2], atol=1e-9)
    assert np.allclose(fit.se, np.sqrt(np.diag(v))[:2], atol=1e-9)


def test_twfe_weights_are_repeated_rows(spark, panel):
    d = panel.assign(w=1 + panel.unit % 2)
    twice = pd.concat([d, d[d.w == 2]])
    one = twfe(spark.createDataFrame(d), "y", ["did_term"], "unit", "year", "site_id", weight="w")[()]
    two = twfe(spark.createDataFrame(twice), "y", ["did_term"], "unit", "year", "site_id")[()]
    assert np.allclose(one.beta, two.beta)


def test_known_answer_and_repartition(spark):
    rows = [(u, t, u % 6, int(u % 6 == 0), int(u % 6 == 0 and t >= 2022), 0.3 + 0.01 * u + 0.02 * (t - 2016) + 0.05 * (u % 6 == 0 and t >= 2022)) for u in range(36) for t in range(2016, 2026)]
    df = spark.createDataFrame(rows, "unit int, year int, site_id int, treatment int, did_term int, y double")
    a = twfe(df, "y", ["did_term"], "unit", "year", "site_id")[()]
    b = twfe(df.repartition(7), "y", ["did_term"], "unit", "year", "site_id")[()]
    assert abs(a.beta[0] - 0.05) < 1e-9 and abs(a.beta[0] - b.beta[0]) < 1e-12


def test_poison_rows_of_missing_outcome_do_not_count(spark, panel):
    bad = panel.assign(y=None, x=1e9)
    both = pd.concat([panel.astype({"y": object}), bad])
    a = twfe(spark.createDataFrame(panel), "y", ["did_term"], "unit", "year", "site_id")[()]
    b = twfe(spark.createDataFrame(both[["unit", "year", "site_id", "did_term", "y"]], "unit long, year long, site_id long, did_term double, y double"), "y", ["did_term"], "unit", "year", "site_id")[()]
    assert np.allclose(a.beta, b.beta)


def test_empty(spark):
    assert twfe(spark.createDataFrame([], "unit int, year int, site_id int, did_term int, y double"), "y", ["did_term"], "unit", "year", "site_id") == {}


def test_tails():
    assert abs(t_p(2.0, 10) - 0.07338803) < 1e-7
    assert abs(f_p(3.0, 2, 10) - 0.09536743) < 1e-7
    assert abs(normal_p(1.959963984540054) - 0.05) < 1e-12
    assert abs(chi2_p(3.841458820694124, 1) - 0.05) < 1e-9


@pytest.mark.parametrize("n, k, zeta", [(6, 4, 0.1), (5, 40, 1e-6), (12, 12, 0.5), (4, 3, 1e-6), (30, 8, 0.0)])
def test_simplex_weights_are_the_least(n, k, zeta):
    """The conditions that only the least fulfils: equal pull on weights in use, no less pull elsewhere."""
    rng = np.random.default_rng(n * k)
    a, b = rng.normal(size=(n, k)), rng.normal(size=n)
    w = simplex_ridge(a, b, zeta)
    ac, bc = a - a.mean(axis=0), b - b.mean()
    pull = ac.T @ (ac @ w - bc) + zeta**2 * n * w
    assert abs(w.sum() - 1) < 1e-9 and (w >= 0).all()
    assert np.ptp(pull[w > 0]) < 1e-7 and (pull >= pull[w > 0].min() - 1e-7).all()


def test_synthetic_did():
    rng = np.random.default_rng(1)
    y = rng.normal(size=(12, 1)) + np.arange(10) * 0.1 + rng.normal(size=(12, 10)) * 1e-4
    arm, pre = np.arange(12) < 2, np.arange(10) < 7
    y[:2, 7:] += 1.5
    assert abs(synthetic_did(y, arm, pre)[0] - 1.5) < 0.01


@pytest.mark.parametrize("n, p, l1", [(40, 5, 0.5), (6, 30, 1.0), (12, 12, 0.3)])
def test_elastic_path_fulfils_its_conditions(n, p, l1):
    rng = np.random.default_rng(p)
    x = rng.normal(size=(n, p)) @ np.diag(rng.uniform(0.5, 2, p)) + rng.normal(size=(n, 1))
    x -= x.mean(axis=0)
    y = x[:, 0] - 2 * x[:, 1] + rng.normal(size=n)
    y -= y.mean()
    c = x.T @ y / n
    alphas = penalties(c, l1)
    path = elastic_path(x.T @ x / n, c, y @ y / n, l1, alphas, tolerance=1e-13)
    assert not path[0].any() and path[-1].any()
    for a, w in zip(alphas, path, strict=True):
        pull = x.T @ (y - x @ w) / n - a * (1 - l1) * w
        assert (np.abs(pull) <= a * l1 + 1e-5).all() and np.allclose(pull[w != 0], a * l1 * np.sign(w[w != 0]), atol=1e-5)


def test_elastic_net_cv_is_each_fold_by_itself():
    """The choice by brute force: coordinate descent from zero for each fold, share and penalty."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(11, 4))
    y = x @ [1.0, 0.0, -0.5, 0.0] + 0.3 * rng.normal(size=11)

    def descend(x, y, a, l1):
        w = np.zeros(4)
        for _ in range(3000):
            for j in range(4):
                r = x[:, j] @ (y - x @ w + x[:, j] * w[j]) / len(y)
                w[j] = np.sign(r) * max(abs(r) - a * l1, 0) / (x[:, j] @ x[:, j] / len(y) + a * (1 - l1))
        return w

    w, level, alpha, l1 = elastic_net_cv(x, y)
    xc, yc = x - x.mean(axis=0), y - y.mean()
    assert np.allclose(w, descend(xc, yc, alpha, l1), atol=1e-6) and abs(level - (y.mean() - x.mean(axis=0) @ w)) < 1e-12
    folds = [[0, 1, 2], [3, 4], [5, 6], [7, 8], [9, 10]]
    error = lambda a, s: np.mean([((y[f] - y[r].mean() - (x[f] - x[r].mean(axis=0)) @ descend(x[r] - x[r].mean(axis=0), y[r] - y[r].mean(), a, s)) ** 2).mean() for f in folds for r in [[i for i in range(11) if i not in f]]])
    chosen = error(alpha, l1)
    assert all(chosen <= error(a, s) + 1e-7 for s in (0.3, 1.0) for a in penalties(xc.T @ yc / 11, s)[::20])


def test_elastic_net_control_finds_its_donors(spark):
    rng = np.random.default_rng(9)
    d = rng.normal(size=(8, 16)).cumsum(axis=1)
    rows = [("g", f"d{i}", 2000 + t, float(d[i, t])) for i in range(8) for t in range(16)]
    own = [("g", "own", 2000 + t, float(0.6 * d[0, t] + 0.4 * d[3, t] + (5 if t >= 12 else 0))) for t in range(16)]
    types = "k string, series string, year int, y double"
    got = elastic_net_control(spark.createDataFrame(own, types), spark.createDataFrame(rows, types), 2012, "k").collect()
    assert len(got) == 1 and abs(got[0].estimate - 5) < 0.3 and got[0].post_years == 4


def test_a_group_without_enough_cells_has_no_weights(spark):
    cells = spark.createDataFrame([(1, "a", 2000, 1.0, True), (1, "b", 2000, 2.0, False), (2, "c", 2001, 1.0, False)], "season int, series string, year int, y double, treated boolean")
    assert synthetic_weights(cells, 2001, ["season"]).count() == 0


def test_pixel_weights_are_a_weighted_regression_with_dummies(spark):
    """Weights spread by hand, then least squares with dummies on the rows that have weight."""
    rng = np.random.default_rng(12)
    rows = [(1, f"c{u % 6}", u, t, u % 6 == 0, float(0.1 * u + t * (1 + u % 6) + rng.normal() + (3 if u % 6 == 0 and t >= 5 else 0)), u % 7) for u in range(60) for t in range(8) if rng.random() < 0.9]
    d = pd.DataFrame(rows, columns=["season", "series", "pixel", "year", "treated", "y", "site"])
    df = spark.createDataFrame(d)
    weights = synthetic_weights(df.groupBy("season", "series", "year").agg(F.avg("y").alias("y"), F.max("treated").alias("treated")), 5, ["season"])
    w = weights.toPandas()
    unit, time = w[w.kind == "unit"].set_index("name").weight, w[w.kind == "time"].set_index("name").weight
    assert abs(unit.sum() - 1) < 1e-9 and abs(time.sum() - 1) < 1e-9
    n_pix = d.groupby(["series", "year"]).pixel.nunique().groupby("series").max()
    wu = np.where(d.treated, 1 / d[d.treated].pixel.nunique(), d.series.map(unit / n_pix).fillna(0))
    wt = np.where(d.year >= 5, 1 / 3, d.year.astype(str).map(time).fillna(0))
    d["weight"] = wu * wt
    k = d[d.weight > 0].copy()
    got = pixel_weights(df, weights, 5, "season")
    assert got.count() == len(k) < len(d)
    k["did"] = (k.treated & (k.year >= 5)).astype(float)
    k = k[k.groupby("pixel").y.transform("size") > 1]
    x = np.c_[k.did, pd.get_dummies(k.pixel), pd.get_dummies(k.year)].astype(float)
    root = np.sqrt(k.weight.to_numpy())
    b = np.linalg.lstsq(x * root[:, None], k.y * root, rcond=None)[0]
    fit = twfe(got.withColumn("did", F.expr("CAST(treated AND year >= 5 AS INT)")), "y", ["did"], "pixel", "year", "site", weight="weight")[()]
    assert abs(fit.beta[0] - b[0]) < 1e-8


def test_entropy_weights_balance(spark):
    rng = np.random.default_rng(3)
    d = pd.DataFrame({"unit": range(400), "treatment": (np.arange(400) % 4 == 0).astype(int)})
    d["a"] = rng.normal(size=400) + 0.3 * d.treatment
    w, _ = M.entropy_weights(spark.createDataFrame(d), ["a"])
    got = w.toPandas()
    c, t = got[got.treatment == 0], got[got.treatment == 1]
    assert abs(np.average(c.a, weights=c.weight) - t.a.mean()) < 1e-8


@pytest.mark.parametrize("digits", [0, 1, 12])
def test_matching_takes_every_pair_that_greedy_matching_takes(spark, digits):
    from paneloom.plans.ml import pairs_within

    rng = np.random.default_rng(digits)
    units = [(i, int(i < 120), float(np.round(rng.normal(0.3 * (i < 120)), digits))) for i in range(270)]
    got = pairs_within(spark.createDataFrame(units, "unit long, w int, logit double"), 0.2).collect()
    score = {u: x for u, _, x in units}
    treated, controls, want = [u for u, w, _ in units if w], [u for u, w, _ in units if not w], []
    for gap, _, t, c in sorted((abs(score[t] - score[c]), min(score[t], score[c]), t, c) for t in treated for c in controls if abs(score[t] - score[c]) <= 0.2):
        if t in treated and c in controls:
            treated.remove(t), controls.remove(c), want.append(gap)
    assert len({r.t for r in got}) == len({r.c for r in got}) == len(got) == len(want) > 60
    assert all(abs(abs(score[r.t] - score[r.c]) - r.gap) < 1e-12 and r.gap <= 0.2 for r in got)
    assert np.allclose(sorted(r.gap for r in got), sorted(want))


@pytest.fixture(scope="module")
def starts():
    """An unbalanced panel of staggered starts with a covariate; one unit has no untreated row."""
    rng = np.random.default_rng(5)
    rows = []
    for u in range(48):
        g = [None, 3, 5, 6][u % 4] if u != 7 else 0
        for t in range(8):
            if rng.random() < 0.85:
                x = rng.normal()
                rows.append((u, t, u % 7, g, x, 0.2 * u + 0.5 * t + 0.7 * x + (1.0 + 0.3 * (t - g) if g is not None and t >= g else 0) + rng.normal()))
    d = pd.DataFrame(rows, columns=["unit", "year", "site_id", "cohort", "x", "y"])
    d["free"] = d.cohort.isna() | (d.year < d.cohort)
    d["k"] = [None if pd.isna(g) or t - g == -1 else int(t - g) for g, t in zip(d.cohort, d.year, strict=True)]
    return d


@pytest.mark.parametrize("parts, xs, centre", [(4, (), ()), (7, ("x",), ()), (4, ("x",), ("cohort", "year"))])
def test_two_stage_is_dummies_and_the_stacked_sandwich(spark, starts, parts, xs, centre):
    """By hand: first stage by dummies, second by cell means, influence of both stages summed by cluster."""
    types = "unit long, year long, site_id long, cohort double, x double, y double, free boolean, k double"
    df = spark.createDataFrame(starts.astype(object).where(starts.notna(), None), types).withColumn("k", F.col("k").cast("int"))
    fit = two_stage(df.repartition(parts), "y", "free", "k", "unit", "year", "site_id", xs=xs, centre=centre)
    d = starts[starts.unit != 7]
    x1 = np.c_[pd.get_dummies(d.unit), pd.get_dummies(d.year), d[list(xs)]].astype(float)
    x10 = x1 * d.free.to_numpy()[:, None]
    g = np.linalg.lstsq(x10, d.y * d.free, rcond=None)[0]
    e1, e = (d.y - x10 @ g) * d.free, d.y - x1 @ g
    cells = [int(k) for k in fit.terms]
    x2 = np.array([(d.k == k).to_numpy(float) for k in cells]).T
    beta = x2.T @ e / x2.sum(axis=0)
    middle = x2 @ beta if not centre else e.groupby([d.k.fillna(99), d.cohort.fillna(99), d.year]).transform("mean")
    w = np.linalg.lstsq(x10.T @ x10, x1.T @ x2, rcond=None)[0]
    influence = (x2 * (e - middle).to_numpy()[:, None] - (x10 @ w) * e1.to_numpy()[:, None]) / x2.sum(axis=0)
    s = pd.DataFrame(influence).groupby(d.site_id.to_numpy()).sum().to_numpy()
    assert np.allclose(fit.beta, beta, atol=1e-9) and np.allclose(fit.var, s.T @ s, atol=1e-9)
    assert fit.n_units == 47 and fit.n_clusters == 7 and [fit.rows[k] for k in fit.terms] == x2.sum(axis=0).astype(int).tolist()


def test_two_stage_known_answer_and_empty(spark):
    rows = [(u, t, u % 6, 4 if u % 3 == 0 else None, 0.3 * u + t * t + (2.0 if u % 3 == 0 and t >= 4 else 0)) for u in range(30) for t in range(8)]
    df = spark.createDataFrame(rows, "unit int, year int, site_id int, cohort int, y double").selectExpr("*", "cohort IS NULL OR year < cohort AS free", "CASE WHEN year >= cohort THEN year - cohort END AS k")
    fit = two_stage(df, "y", "free", "k", "unit", "year", "site_id")
    assert np.allclose(fit.beta, 2.0) and np.allclose(fit.var, 0, atol=1e-18)
    assert two_stage(df.where("false"), "y", "free", "k", "unit", "year", "site_id") is None
    with pytest.raises(ValueError):  # the years after 3 are known from no unit that is also seen before
        two_stage(df.where("cohort IS NOT NULL OR year > 3"), "y", "free", "k", "unit", "year", "site_id")


def test_core_without_regressors(spark, panel):
    fit = twfe(spark.createDataFrame(panel), "y", [], "unit", "year", "site_id")[()]
    assert fit.terms == [] and len(fit.period_effects) == 8
