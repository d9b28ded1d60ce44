"""Planted effects and plain formulas for the models that SQL does not express."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paneloom.plans import ml, synth
from paneloom.plans import models as M
from paneloom.plans.fe import twfe
from paneloom.plans.stats import f_p


@pytest.fixture(scope="module")
def units(spark):
    """Units whose treatment follows a covariate; the effect is 2 for all."""
    rng = np.random.default_rng(0)
    n = 1200
    d = pd.DataFrame({"unit": range(n), "a": rng.normal(size=n), "b": rng.normal(size=n)})
    d["w"] = (rng.random(n) < 1 / (1 + np.exp(-0.8 * d.a))).astype(float)
    d["d"] = 1.5 * d.a + 2 * d.w + 0.3 * rng.normal(size=n)
    return ml.assembled(spark.createDataFrame(d), ["a", "b"]).cache()


@pytest.mark.parametrize("model, bound", [("aipw_att", 0.1), ("dml", 0.25), ("dr_learner", 0.3), ("boosted", 0.3)])
def test_effect_models_take_the_confounder_out(units, model, bound):
    run = {"aipw_att": ml.aipw_att, "dml": lambda u: ml.dml(u, trees=40), "dr_learner": lambda u: ml.dr_learner(u, trees=40), "boosted": lambda u: ml.dr_learner(u, boosted=True)}[model]
    r = run(units).first()
    naive = units.groupBy("w").agg(F.avg("d").alias("d")).orderBy("w").collect()
    assert abs(r.estimate - 2) < bound < naive[1].d - naive[0].d - 2 and 0 < r.se < bound and r.n_obs == 1200


def test_quartiles_of_one_effect_are_alike(units):
    rows = ml.cate_quartiles(units, "a", trees=30).orderBy("quartile").collect()
    assert [r.quartile for r in rows] == [1, 2, 3, 4] and sum(r.n for r in rows) == 1200
    assert all(abs(r.r_effect - 2) < 0.5 for r in rows)


def test_matches_take_the_confounder_out(units):
    pairs = ml.matched_pairs(units)
    d = units.select("unit", "d")
    gap = pairs.join(d.select(F.col("unit").alias("t"), F.col("d").alias("dt")), "t").join(d.select(F.col("unit").alias("c"), F.col("d").alias("dc")), "c")
    r = gap.agg(F.avg(F.col("dt") - F.col("dc")).alias("e"), F.count_distinct("t").alias("t"), F.count_distinct("c").alias("c"), F.count("*").alias("n")).first()
    assert abs(r.e - 2) < 0.15 and r.t == r.c == r.n > 250


def test_completed_matrix_finds_the_effect(spark):
    rng = np.random.default_rng(3)
    f, load = rng.normal(size=12), rng.normal(size=90)
    rows = [(f"u{i}", 2000 + t, i % 3 == 0, float(0.2 * i + 0.5 * t + 0.5 * load[i] * f[t] + 0.05 * rng.normal() + (4 if i % 3 == 0 and t >= 9 else 0))) for i in range(90) for t in range(12)]
    r = synth.completed_matrix(spark.createDataFrame(rows, "unit string, year int, treated boolean, y double"), 2009).first()
    assert abs(r.estimate - 4) < 0.35 and r.n == 90


def test_morans_i_is_its_formula(spark):
    rng = np.random.default_rng(4)
    z, k = rng.normal(size=40), 3
    near = [[(i + s) % 40 for s in (1, 2, 5)] for i in range(40)]
    local, g = M.moran(spark.createDataFrame([(i, float(x)) for i, x in enumerate(z)], "key int, z double"), spark.createDataFrame([(i, j) for i in range(40) for j in near[i]], "key int, other int"), k)
    c = z - z.mean()
    lag = np.array([c[n].mean() for n in near])
    own = c * lag / (c**2).mean()
    got = {r.key: r for r in local.collect()}
    assert abs(g["i"] - own.mean()) < 1e-12 and abs(g["expected"] + 1 / 39) < 1e-15
    assert np.allclose([got[i].i for i in range(40)], own)
    sign = {(True, True): "high-high", (False, False): "low-low", (True, False): "high-low", (False, True): "low-high"}
    assert all(got[i].quadrant in ("not significant", sign[bool(c[i] > 0), bool(lag[i] > 0)]) for i in range(40))
    w = np.zeros((40, 40))
    for i, n in enumerate(near):
        w[i, n] = 1 / k
    s1, s2 = ((w + w.T) ** 2).sum() / 2, ((w.sum(axis=0) + w.sum(axis=1)) ** 2).sum()
    kurt = (c**4).mean() / (c**2).mean() ** 2
    var = (40 * ((1600 - 120 + 3) * s1 - 40 * s2 + 3 * 1600) - kurt * ((1600 - 40) * s1 - 80 * s2 + 6 * 1600)) / (39 * 38 * 37 * 1600) - 1 / 39**2
    assert abs(g["variance"] - var) < 1e-12


def test_event_study_and_its_joint_test(spark):
    rng = np.random.default_rng(5)
    rows = [(u, t, u % 8, int(u % 3 == 0), t - 4, float(0.1 * u + 0.3 * t + rng.normal() + (1.0 if u % 3 == 0 and t >= 4 else 0))) for u in range(48) for t in range(7)]
    d = pd.DataFrame(rows, columns=["unit", "year", "site_id", "treatment", "event_time", "y"])
    fit, times = M.event_study(spark.createDataFrame(d), [-4, -3, -2, 0, 1, 2])
    x = np.c_[[((d.treatment == 1) & (d.event_time == k)).astype(float) for k in times]].T
    x = np.c_[x, pd.get_dummies(d.unit), pd.get_dummies(d.year).iloc[:, 1:]].astype(float)
    b = np.linalg.lstsq(x, d.y, rcond=None)[0]
    assert times == [-4, -3, -2, 0, 1, 2] and np.allclose(fit.beta, b[:6])
    est, se, _ = M.headline(fit, times)
    assert abs(est - b[3:6].mean()) < 1e-9 and abs(se - np.sqrt(fit.var[3:, 3:].mean())) < 1e-12
    f, rank, p = M.wald(fit, [0, 1, 2])
    v = fit.var[:3, :3]
    assert rank == 3 and abs(f - fit.beta[:3] @ np.linalg.solve(v, fit.beta[:3]) / 3) < 1e-8 and abs(p - f_p(f, 3, 7)) < 1e-12


def test_wild_bootstrap(spark):
    rng = np.random.default_rng(6)
    for effect, bounds in ((0.0, (0.05, 1)), (2.0, (0, 0.02))):
        rows = [(u, t, u % 14, int(u % 14 < 5 and t >= 3), float(rng.normal() + (effect if u % 14 < 5 and t >= 3 else 0))) for u in range(84) for t in range(6)]
        df = spark.createDataFrame(rows, "unit int, year int, site_id int, did_term int, y double")
        r = M.wild_bootstrap(M.demeaned(df, "y", "did_term", "unit", "year"), "site_id", reps=999).first()
        fit = twfe(df, "y", ["did_term"], "unit", "year", "site_id")[()]
        assert abs(r.estimate - fit.beta[0]) < 1e-9 and bounds[0] <= r.p_value <= bounds[1] and r.n_clusters == 14


def test_heterogeneity_is_its_formula(spark):
    b, se = np.array([1.0, 2.0, 4.0, 1.5]), np.array([0.5, 0.4, 0.6, 0.3])
    r = M.heterogeneity(spark.createDataFrame([*zip(b.tolist(), se.tolist(), strict=True), (9.0, 0.0)], "estimate double, se double")).first()
    w = 1 / se**2
    pooled = (w * b).sum() / w.sum()
    q = (w * (b - pooled) ** 2).sum()
    assert r.k == 4 and np.allclose([r.q, r.i2, r.tau2, r.pooled], [q, (q - 3) / q * 100, (q - 3) / (w.sum() - (w**2).sum() / w.sum()), pooled])


def test_entropy_weights_that_cannot_balance_are_an_error(spark):
    """The treated mean lies beyond every control."""
    rows = [(i, int(i < 5), float(i < 5) * 10 + i % 3) for i in range(40)]
    with pytest.raises(ValueError):
        M.entropy_weights(spark.createDataFrame(rows, "unit int, treatment int, a double"), ["a"], steps=40)
