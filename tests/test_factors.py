"""Factor models: planted factors, equality with numpy, the choice of their number."""

from __future__ import annotations

import numpy as np
import pytest

from paneloom.plans import factors as FM

YEARS = list(range(2000, 2012))


def planted(rng, n=80, r=2, noise=0.0, missing=0.0, effect=2.0):
    t = len(YEARS)
    f, l = rng.normal(size=(t, r)), rng.normal(size=(n, r)) + 1
    y = rng.normal(size=(n, 1)) + rng.normal(size=t) + l @ f.T + noise * rng.normal(size=(n, t))
    start = np.array([[None, None, 2007, 2009][i % 4] for i in range(n)], object)
    rows = []
    for i in range(n):
        for j, year in enumerate(YEARS):
            if start[i] is None or rng.random() >= missing:
                rows.append((i, i % 9, year, float(y[i, j] + (effect if start[i] and year >= start[i] else 0)), start[i]))
    return rows


SCHEMA = "unit long, cluster long, year int, y double, cohort int"


@pytest.mark.parametrize("method, missing, parts", [("controls", 0.0, 1), ("interactive", 0.0, 5), ("interactive", 0.1, 3)])
def test_planted_factors_and_effect_are_recovered(spark, method, missing, parts):
    data = planted(np.random.default_rng(0), missing=missing)
    rows = FM.in_rows(spark.createDataFrame(data, SCHEMA).repartition(parts), YEARS)
    model = FM.factor_model(rows, YEARS, method, n_factors=2)
    found = {r.event_time: r for r in FM.mean_gaps(FM.gaps(rows, model)).collect()}
    assert set(found) == {None, 0, 1, 2, 3, 4} and found[None].n == sum(1 for r in data if r[4] and r[2] >= r[4])
    assert all(abs(r.estimate - 2.0) < 1e-6 and r.se < 1e-6 for r in found.values())


def test_number_of_factors_is_chosen_by_left_out_years(spark):
    for r in (0, 1, 3):
        rows = FM.in_rows(spark.createDataFrame(planted(np.random.default_rng(r), r=r, noise=0.05), SCHEMA), YEARS)
        assert FM.factor_model(rows, YEARS).n_factors == r


def test_left_out_error_is_refitting():
    rng = np.random.default_rng(4)
    x, design, seen = rng.normal(size=(30, 8)), np.c_[np.ones(8), rng.normal(size=(8, 2))], np.arange(8) < 6
    want = []
    for h in range(6):
        rest = [j for j in range(6) if j != h]
        c = np.linalg.lstsq(design[rest], x[:, rest].T, rcond=None)[0]
        want.append(((x[:, h] - design[h] @ c) ** 2).sum())
    assert abs(FM.left_out_error(x.T @ x, seen, design) - np.mean(want)) < 1e-9


def test_turns_are_those_of_numpy(spark):
    """The same alternation on one matrix in memory."""
    data = planted(np.random.default_rng(6), noise=0.3, missing=0.1)
    rows = FM.in_rows(spark.createDataFrame(data, SCHEMA), YEARS)
    model = FM.factor_model(rows, YEARS, "interactive", n_factors=1)
    v, start = np.full((80, 12), np.nan), np.full(80, np.inf)
    for i, _, year, y, g in data:
        v[i, year - 2000], start[i] = y, g or np.inf
    free = ~np.isnan(v) & (np.array(YEARS) < start[:, None])
    whole = v[free.all(axis=1)]
    mu, net = whole.mean(axis=0), np.eye(12) - 1 / 12
    last = 1e300
    design = np.c_[np.ones(12), np.linalg.eigh(net @ np.cov(whole.T, bias=True) @ net)[1][:, -1]]
    while True:
        fit = np.array([mu + design @ np.linalg.lstsq(design[m], (x - mu)[m], rcond=None)[0] for x, m in zip(v, free, strict=True)])
        error = ((v - fit)[free] ** 2).sum()
        if last - error <= 1e-12 * last:
            break
        last, full = error, np.where(free, v, fit)
        mu = full.mean(axis=0)
        design = np.c_[np.ones(12), np.linalg.eigh(net @ np.cov(full.T, bias=True) @ net)[1][:, -1]]
    assert abs(model.error - error) < 1e-6 * error
    got = {(r.unit, r.year): r.gap for r in FM.gaps(rows, model).collect()}
    assert len(got) == sum(1 for r in data if r[4])
    assert max(abs(got[i, t] - (v - fit)[i, t - 2000]) for i, t in got) < 1e-4


def test_no_controls(spark):
    rows = FM.in_rows(spark.createDataFrame([(1, 1, 2000, 1.0, 2001)], SCHEMA), [2000, 2001])
    with pytest.raises(ValueError):
        FM.factor_model(rows, [2000, 2001])
