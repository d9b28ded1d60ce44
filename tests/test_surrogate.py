"""Surrogate regressions equal refitting on the rows."""

from __future__ import annotations

import numpy as np
import pandas as pd

from paneloom.plans import surrogate as S


def rows(n_clusters=9):
    rng = np.random.default_rng(3)
    d = pd.DataFrame([(u, t, f"c{u % n_clusters}", int(u % 4 == 0), int(t >= 2004)) for u in range(72) for t in range(2000, 2008) if rng.random() < 0.9], columns=["unit", "year", "cluster", "treated", "post"])
    d["a"], d["b"] = rng.normal(5, 2, len(d)), rng.normal(-1, 0.5, len(d))
    d["y"] = 1.5 * d.a - 2 * d.b + 0.3 * (d.year - 2000) + 0.8 * d.treated * d.post + rng.normal(0, 0.2, len(d))
    return d


def by_hand(d, ridge=1e-3):
    c, t = d[d.treated == 0], d[d.treated == 1]
    years = sorted(d.year.unique())
    mu, sd = c[["a", "b"]].mean(), c[["a", "b"]].std(ddof=0) + 1e-12
    x = lambda f: np.c_[(f[["a", "b"]] - mu) / sd, np.array([f.year == y for y in years]).T]
    pen = np.diag([ridge * len(c)] * 2 + [1e-8 * len(c)] * len(years))
    b = np.linalg.solve(x(c).T @ x(c) + pen, x(c).T @ c.y)
    res, own = t.y - x(t) @ b, c.y - x(c) @ b
    return res[t.post == 1].mean() - res[t.post == 0].mean(), np.sqrt((res[t.post == 0] ** 2).mean()), 1 - (own**2).sum() / ((c.y - c.y.mean()) ** 2).sum()


def test_surrogate_index_is_refitting_by_cluster(spark):
    d = rows()
    got = S.surrogate_index(spark.createDataFrame(d).repartition(5), "y", ["a", "b"]).first()
    att, rmspe, r2 = by_hand(d)
    jack = np.array([by_hand(d[d.cluster != c])[0] for c in sorted(d.cluster.unique())])
    assert np.allclose([got.estimate, got.pre_rmspe, got.r2_control], [att, rmspe, r2], atol=1e-8)
    assert abs(got.se - np.sqrt(8 / 9 * ((jack - jack.mean()) ** 2).sum())) < 1e-8
    assert abs(got.estimate - 0.8) < 0.1 and got.n == len(d) and got.n_clusters == 9


def test_surrogate_index_with_a_year_in_one_cluster_and_nulls(spark):
    d = rows()
    d = d[(d.year != 2000) | (d.cluster == "c1")]
    bad = d.head(5).assign(a=np.nan, y=1e9)
    df = spark.createDataFrame(pd.concat([d, bad])).replace(float("nan"), None)
    got = S.surrogate_index(df, "y", ["a", "b"]).first()
    jack = np.array([by_hand(d[d.cluster != c])[0] for c in sorted(d.cluster.unique())])
    assert abs(got.estimate - by_hand(d)[0]) < 1e-8 and abs(got.se - np.sqrt(8 / 9 * ((jack - jack.mean()) ** 2).sum())) < 1e-7
    assert S.surrogate_index(df.where("treated = 0"), "y", ["a"]).count() == 0


def test_ground_fit_is_ridge_with_left_out_rows(spark):
    rng = np.random.default_rng(1)
    d = pd.DataFrame(rng.normal(size=(25, 3)) * [3, 0.1, 1], columns=["a", "b", "y"])
    d["y"] += 0.5 * d.a - 4 * d.b + 2
    got = S.ground_fit(spark.createDataFrame(d), "y", ["a", "b"])
    x = ((d[["a", "b"]] - d[["a", "b"]].mean()) / d[["a", "b"]].std(ddof=0)).to_numpy()

    def ridge(x, y, a):
        m = x.mean(axis=0)
        b = np.linalg.solve((x - m).T @ (x - m) + a * np.eye(2), (x - m).T @ (y - y.mean()))
        return b, y.mean() - m @ b

    y, mse = d.y.to_numpy(), {}
    for a in S.PENALTIES:
        left = []
        for i in range(25):
            keep = np.arange(25) != i
            b, c = ridge(x[keep], y[keep], a)
            left.append((y[i] - c - x[i] @ b) ** 2)
        mse[a] = np.mean(left)
    best = min(mse, key=mse.get)
    b, _ = ridge(x, y, best)
    assert got["penalty"] == best and abs(got["r2_left_out"] - (1 - mse[best] / y.var())) < 1e-9
    assert np.allclose(got["slopes"], b / d[["a", "b"]].std(ddof=0))
    assert S.ground_fit(spark.createDataFrame(d.head(5)), "y", ["a"]) is None
