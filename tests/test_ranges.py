"""Order statistics by ranges and draws against plain ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from paneloom.operators.ranges import numbered, quantiles, running
from paneloom.plans import resample as R


def test_quantiles_are_percentiles(spark):
    rng = np.random.default_rng(0)
    rows = [(None if i % 11 == 0 else i % 3, float(rng.integers(0, 9)) if i % 2 else float(rng.normal())) for i in range(3000)] + [(7, 1.5), (8, None), (9, 2.0), (9, 4.0)]
    df = spark.createDataFrame(rows, "k int, v double")
    taus = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.99, "e": 1.0}
    want = df.where("v IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"), *(F.percentile("v", t).alias(c) for c, t in taus.items()))
    got = {r.k: r for r in quantiles(df, ["k"], "v", taus).collect()}
    assert len(got) == want.count()
    for r in want.collect():
        assert got[r.k].n == r.n and np.allclose([got[r.k][c] for c in taus], [r[c] for c in taus])
    assert quantiles(df.where("false"), ["k"], "v", taus).count() == 0


def test_running_sums_and_numbers(spark):
    d = pd.DataFrame({"k": np.arange(2000) % 3, "v": np.random.default_rng(1).permutation(2000).astype(float), "c": np.arange(2000) % 7})
    got = running(spark.createDataFrame(d), "v", ["c"], ("k",)).toPandas().sort_values(["k", "v"])
    assert (got.upto_c.to_numpy() == got.groupby("k").c.cumsum().to_numpy()).all() and len(got) == 2000
    names = spark.createDataFrame([(f"u{i % 700}",) for i in range(1500)], "unit string").repartition(6)
    got = {r.unit: r.number for r in numbered(names, "unit").collect()}
    assert got == {u: i for i, u in enumerate(sorted(f"u{i}" for i in range(700)))}


@pytest.mark.parametrize("most, n", [(1000, 130), (5, 130), (1, 1), (3, 400), (1000, 399)])
def test_least_sums_are_sorted_sums(spark, most, n):
    """The radix way gives the sum of the n units of least unsigned hash, at any size of the last cell."""
    units = spark.createDataFrame([(i, float(i * i % 97)) for i in range(400)], "unit long, d double")
    h = F.xxhash64("rep", "unit", F.lit(5))
    rows = units.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(20))))
    place = F.row_number().over(Window.partitionBy("rep").orderBy(F.shiftrightunsigned(h, 1), h, "unit"))
    want = {r.rep: r.s for r in rows.withColumn("i", place).where(F.col("i") <= n).groupBy("rep").agg(F.sum("d").alias("s")).collect()}
    assert {r.rep: r.s for r in R.least_sums(units, "unit", "d", n, 20, most=most).collect()} == want


def test_permutation_tells_an_effect(spark):
    rng = np.random.default_rng(2)
    rows = [(u, t, int(u % 4 == 0), int(t > 1), float(rng.normal() + (3 if u % 4 == 0 and t > 1 else 0))) for u in range(80) for t in range(4)]
    r = R.permutation(spark.createDataFrame(rows, "unit int, year int, treatment int, post int, y double"), "unit").first()
    assert r.reps == 500 and abs(r.p_value - 1 / 501) < 1e-12 and 2 < r.estimate < 4


def cic(y0, y1, tr, w=None):
    """By hand with integer weights as repeated units."""
    w = np.ones(len(tr), int) if w is None else w
    y0, y1, tr = np.repeat(y0, w), np.repeat(y1, w), np.repeat(tr, w)
    c0, c1, t0, t1 = np.sort(y0[~tr]), np.sort(y1[~tr]), np.sort(y0[tr]), np.sort(y1[tr])
    mapped = c1[np.maximum(np.searchsorted(c0, t0, side="right"), 1) - 1]
    at = lambda x, t: x[int(np.ceil(t * len(x) - 1e-9)) - 1]
    return {"att": t1.mean() - mapped.mean()} | {k: at(t1, t) - at(mapped, t) for k, t in R.TAUS.items()}


def test_changes_in_changes_of_every_draw(spark):
    rng = np.random.default_rng(3)
    d = pd.DataFrame({"unit": range(300), "treatment": (np.arange(300) % 3 == 0).astype(int), "y0": np.round(rng.normal(size=300), 1), "y1": np.round(rng.normal(1, 2, 300), 1)})
    df = spark.createDataFrame(d)
    got = {(r.draw, r.term): r.estimate for r in R.changes_in_changes(df, draws=6).collect()}
    weights = R.drawn(df, "unit", 6).toPandas()
    for draw in range(7):
        w = weights[weights.draw == draw].set_index("unit").weight.reindex(d.unit, fill_value=0).to_numpy()
        want = cic(d.y0.to_numpy(), d.y1.to_numpy(), d.treatment.to_numpy(bool), w)
        assert all(abs(got[draw, k] - x) < 1e-9 for k, x in want.items())
    assert len(got) == 7 * 10


def test_poisson_counts(spark):
    w = R.drawn(spark.range(20_000).withColumnRenamed("id", "unit"), "unit", 3).where("draw > 0").groupBy("weight").count().toPandas().set_index("weight")["count"]
    assert abs((w * w.index).sum() / 60_000 - 1) < 0.02 and abs(w[1] / 60_000 - 0.3679) < 0.01 and abs(w[3] / 60_000 - 0.0613) < 0.005


def test_drawn_changes_in_changes(spark):
    """Weights drawn where they are used give the rows of the exploded draws, ties and both key types included."""
    rng = np.random.default_rng(3)
    n = 700
    d = pd.DataFrame({"unit": range(n), "treatment": (rng.random(n) < 0.3).astype(int), "y0": rng.normal(size=n).round(1), "y1": rng.normal(size=n).round(2)})
    for kind in ("int", "long"):
        units = spark.createDataFrame(d).withColumn("unit", F.col("unit").cast(kind))
        table = lambda x: {(r.draw, r.term): r.estimate for r in x.collect()}
        want, got = table(R.changes_in_changes(units, 12)), table(R.changes_in_changes_drawn(units, 12, at_once=5))
        assert set(got) == set(want) and len(want) == 130
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
