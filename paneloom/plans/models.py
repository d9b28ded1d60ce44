"""Difference-in-differences estimators over the two-way fixed-effects core and plain aggregates.

Every estimator takes DataFrames and returns a small DataFrame of result rows. What reaches the driver is counted in
periods, leads, cohorts or clusters.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fe import Fit, results, twfe
from .stats import f_p, normal_p


def static_twfe(df: DataFrame, y: str = "y", treat: str = "did_term", covariates: tuple[str, ...] = (), unit: str = "unit", period: str = "year", cluster: str = "site_id", keys: tuple[str, ...] = (), key_types: str = "") -> DataFrame:
    """y on the treatment term and covariates with unit and period effects, for each value of ``keys``."""
    fits = twfe(df, y, [treat, *covariates], unit, period, cluster, keys)
    return results(df.sparkSession, fits, keys, key_types)


def with_event_dummies(df: DataFrame, times: list[int], arm: str = "treatment", time: str = "event_time") -> tuple[DataFrame, list[str]]:
    """A column for each event time of the treated arm; the time left out of ``times`` is the reference."""
    name = lambda k: f"k_{'m' if k < 0 else 'p'}{abs(k)}"
    cols = {name(k): ((F.col(arm) == 1) & (F.col(time) == k)).cast("int") for k in times}
    return df.withColumns(cols), list(cols)


def event_study(df: DataFrame, times: list[int], **options) -> tuple[Fit, list[int]]:
    """Coefficients by event time; the headline is the mean of those after treatment (see headline)."""
    wide, cols = with_event_dummies(df, times)
    fit = twfe(wide, options.pop("y", "y"), cols, options.pop("unit", "unit"), options.pop("period", "year"), options.pop("cluster", "site_id"))[()]
    return fit, [times[cols.index(t)] for t in fit.terms]


def headline(fit: Fit, times: list[int]) -> tuple[float, float, float]:
    """The mean of the post coefficients with its delta-method standard error."""
    post = np.array([float(t >= 0) for t in times])
    return fit.linear(post / post.sum())


def wald(fit: Fit, at: list[int]) -> tuple[float, int, float]:
    """Joint F of some coefficients over the eigenvalues that carry them, with its p at G - 1 degrees of freedom."""
    b, v = fit.beta[at], fit.var[np.ix_(at, at)]
    values, vectors = np.linalg.eigh(v)
    good = values > 1e-7 * max(values.max(), 1e-300)
    rank = int(good.sum())
    f = float(((vectors[:, good].T @ b) ** 2 / values[good]).sum() / max(rank, 1))
    return f, rank, f_p(f, rank, fit.df)


def demeaned(df: DataFrame, y: str, x: str, unit: str, period: str) -> DataFrame:
    """``df`` of a balanced panel with yy and xx net of unit and period means."""
    u = Window.partitionBy(unit)
    means = df.agg(F.avg(y).alias("_my"), F.avg(x).alias("_mx"))
    net = lambda c, m: F.col(c) - F.avg(c).over(u) - F.col(f"_p_{c}") + F.col(m)
    by_period = df.groupBy(period).agg(F.avg(y).alias(f"_p_{y}"), F.avg(x).alias(f"_p_{x}"))  # a row a period
    out = df.join(F.broadcast(by_period), period).join(F.broadcast(means))
    return out.withColumns({"yy": net(y, "_my"), "xx": net(x, "_mx")}).drop(f"_p_{y}", f"_p_{x}", "_my", "_mx")


#: The six points of the Webb distribution and the two of the Rademacher.
WEBB = (-np.sqrt(1.5), -1.0, -np.sqrt(0.5), np.sqrt(0.5), 1.0, np.sqrt(1.5))
RADEMACHER = (-1.0, 1.0)


def wild_bootstrap(df: DataFrame, cluster: str, reps: int = 9999, seed: int = 7) -> DataFrame:
    """Wild cluster bootstrap-t with the null imposed, from each cluster's sums on demeaned columns yy and xx.

    Replicates are Spark rows; each one draws a weight for every cluster, whose sums are a short array in the plan.
    """
    sums = df.groupBy(cluster).agg(F.sum(F.col("xx") * F.col("yy")).alias("s"), F.sum(F.col("xx") * F.col("xx")).alias("q")).orderBy(cluster).collect()
    s, q = np.array([r["s"] for r in sums]), np.array([r["q"] for r in sums])
    g = len(s)
    scale = float(np.sqrt(g / (g - 1)))
    beta = s.sum() / q.sum()
    t = abs(beta) / (np.sqrt(((s - beta * q) ** 2).sum()) / q.sum() * scale)
    points = WEBB if g < 12 else RADEMACHER
    spark = df.sparkSession
    draw = lambda i: F.get(F.array(*(F.lit(float(p)) for p in points)), F.pmod(F.xxhash64("id", F.lit(seed), i), F.lit(len(points))).cast("int"))
    sa, qa = F.lit([float(x) for x in s]), F.lit([float(x) for x in q])
    boot = spark.range(reps).withColumn("w", F.transform(sa, lambda x, i: x * draw(i)))
    add = lambda a, x: a + x
    boot = boot.withColumn("b", F.aggregate("w", F.lit(0.0), add) / float(q.sum()))
    rss = F.aggregate(F.zip_with("w", qa, lambda x, y: (x - F.col("b") * y) * (x - F.col("b") * y)), F.lit(0.0), add)
    boot = boot.withColumn("t", F.abs("b") / (F.sqrt(rss) / float(q.sum()) * scale))
    return boot.agg(F.count_if(F.col("t") >= float(t)).alias("hits")).select(F.lit(float(beta)).alias("estimate"), F.lit(float(t)).alias("t"), ((F.col("hits") + 1) / F.lit(reps + 1)).alias("p_value"), F.lit(g).alias("n_clusters"))


def group_time_effects(units: DataFrame, last: int) -> DataFrame:
    """ATT(g, t) against never-treated units with the year before g as base: units has unit, year, y, cohort (null: never).

    One row for each cohort and year with the effect, its standard error and the cohort's units.
    """
    cohorts = units.where("cohort IS NOT NULL").select("cohort").distinct()
    treated = units.where("cohort IS NOT NULL").select("unit", "year", "y", F.col("cohort").alias("g"), F.lit(1).alias("arm"))
    never = units.where("cohort IS NULL").select("unit", "year", "y")
    listed = cohorts.agg(F.collect_set("cohort").alias("all"))  # cohorts: years of start
    control = never.join(F.broadcast(listed)).select("unit", "year", "y", F.explode("all").alias("g"), F.lit(0).alias("arm"))
    both = treated.union(control)
    base = both.where("year = g - 1").select("unit", "g", "arm", F.col("y").alias("y0"))
    change = both.where(F.col("year") <= last).join(base, ["unit", "g", "arm"]).withColumn("d", F.col("y") - F.col("y0"))
    cells = change.groupBy("g", "year").agg(*(f(F.when(F.col("arm") == a, F.col("d"))).alias(f"{n}{a}") for a in (0, 1) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))))
    se = F.sqrt(F.coalesce(F.col("v1"), F.lit(0.0)) / F.col("n1") + F.coalesce(F.col("v0"), F.lit(0.0)) / F.col("n0"))
    return cells.where("n1 > 0 AND n0 > 0").select(F.col("g").alias("cohort"), "year", (F.col("m1") - F.col("m0")).alias("att"), se.alias("se"), F.col("n1").alias("n_treated"), F.col("n0").alias("n_control"))


def bacon(series: DataFrame) -> DataFrame:
    """Goodman-Bacon: every 2 x 2 of treated cohort against never treated, later and earlier ones, with its weight.

    ``series``: balanced unit, year, y, cohort (null: never). Cohort means by year are all that the pairs need.
    """
    years = series.agg(F.min("year").alias("a"), F.max("year").alias("b")).first()
    t0, t1 = years["a"], years["b"]
    span = t1 - t0 + 1
    m = series.groupBy("cohort", "year").agg(F.avg("y").alias("m"), F.count("*").alias("n"))
    cohort = m.groupBy("cohort").agg(F.max("n").alias("n"))
    total = series.select("unit").distinct().count()
    k, u = cohort.alias("k"), cohort.alias("u")
    pair = k.join(u, F.col("k.cohort").isNotNull() & ~F.col("k.cohort").eqNullSafe(F.col("u.cohort")))  # cohorts are few
    pair = pair.select(F.col("k.cohort").alias("k"), F.col("u.cohort").alias("u"), F.col("k.n").alias("nk"), F.col("u.n").alias("nu"))
    late = F.col("k") > F.col("u")  # the earlier one is already treated
    lo = F.when(late, F.col("u")).otherwise(F.lit(t0))
    hi = F.when(F.col("u").isNull() | late, F.lit(t1)).otherwise(F.col("u") - 1)
    pair = pair.withColumns({"lo": lo, "hi": hi})
    mk, mu = m.select(F.col("cohort").alias("k"), "year", F.col("m").alias("yk")), m.select(F.col("cohort").alias("u"), "year", F.col("m").alias("yu"))
    both = pair.join(mk, "k").join(mu.withColumnRenamed("year", "year_u").withColumnRenamed("u", "u_"), F.col("u").eqNullSafe(F.col("u_")) & (F.col("year") == F.col("year_u")))
    both = both.where(F.col("year").between(F.col("lo"), F.col("hi")))
    post = F.col("year") >= F.col("k")
    gap = F.col("yk") - F.col("yu")
    est = both.groupBy("k", "u", "nk", "nu").agg((F.avg(F.when(post, gap)) - F.avg(F.when(~post, gap))).alias("estimate")).where("estimate IS NOT NULL")
    share = lambda c: (F.lit(t1) - F.col(c) + 1) / span
    dk, du, n, nu_ = share("k"), share("u"), F.col("nk") / total, F.col("nu") / total
    never = n * nu_ * dk * (1 - dk)
    early = n * nu_ * (dk - du) * (1 - dk)  # k before u: control not yet treated
    after = n * nu_ * dk * (du - dk)  # u before k: control already treated
    weight = F.when(F.col("u").isNull(), never).when(F.col("k") < F.col("u"), early).otherwise(after)
    kind = F.when(F.col("u").isNull(), "never").when(F.col("k") < F.col("u"), "later").otherwise("earlier")
    out = est.select(F.col("k").alias("treated"), F.col("u").alias("control"), kind.alias("kind"), "estimate", weight.alias("w"))
    whole = out.agg(F.sum("w").alias("total_w"))
    return out.join(F.broadcast(whole)).select("treated", "control", "kind", "estimate", (F.col("w") / F.col("total_w")).alias("weight"))


def stacked(units: DataFrame, before: int = 3, after: int = 3) -> DataFrame:
    """Each cohort's window with clean controls, one under the other: stack keys, own treatment and effects' keys."""
    cohorts = units.where("cohort IS NOT NULL").agg(F.collect_set("cohort").alias("all"))
    rows = units.join(F.broadcast(cohorts)).withColumn("g", F.explode("all")).drop("all")
    clean = (F.col("cohort") == F.col("g")) | F.col("cohort").isNull() | (F.col("cohort") > F.col("g") + after)
    rows = rows.where(clean & F.col("year").between(F.col("g") - before, F.col("g") + after))
    d = (F.coalesce(F.col("cohort") == F.col("g"), F.lit(False)) & (F.col("year") >= F.col("g"))).cast("int")
    return rows.withColumns({"d": d, "stack_unit": F.concat_ws("@", "unit", "g"), "stack_year": F.concat_ws("@", "year", "g")})


def heterogeneity(rows: DataFrame) -> DataFrame:
    """Cochran's Q, I2 and the DerSimonian-Laird tau2 over rows of estimate and se."""
    w = 1 / (F.col("se") * F.col("se"))
    good = rows.where("se > 0")
    s = good.agg(F.count("*").alias("k"), F.sum(w).alias("sw"), F.sum(w * w).alias("sw2"), F.sum(w * F.col("estimate")).alias("swb"), F.sum(w * F.col("estimate") * F.col("estimate")).alias("swb2"))
    q = F.col("swb2") - F.col("swb") * F.col("swb") / F.col("sw")
    df = F.col("k") - 1
    tau = F.greatest(F.lit(0.0), (q - df) / (F.col("sw") - F.col("sw2") / F.col("sw")))
    return s.select("k", q.alias("q"), (F.greatest(F.lit(0.0), (q - df) / q) * 100).alias("i2"), tau.alias("tau2"), (F.col("swb") / F.col("sw")).alias("pooled"))


def moran(values: DataFrame, links: DataFrame, k: int) -> tuple[DataFrame, dict]:
    """Global and local Moran's I with row-standardised weights of k neighbours: values (key, z), links (key, other).

    Returns the local rows (key, i, expected, variance, quadrant) and the global figures.
    """
    mean = values.agg(F.avg("z").alias("m"), F.count("*").alias("n")).first()
    n, z = mean["n"], values.withColumn("z", F.col("z") - mean["m"])
    powers = z.agg(F.avg(F.col("z") ** 2).alias("m2"), F.avg(F.col("z") ** 4).alias("m4")).first()
    m2, kurt = powers["m2"], powers["m4"] / powers["m2"] ** 2
    lag = links.hint("merge").join(z.withColumnRenamed("key", "other").withColumnRenamed("z", "zo"), "other").groupBy("key").agg((F.sum("zo") / k).alias("lag"))
    local = z.join(lag, "key").withColumn("i", F.col("z") * F.col("lag") / m2)
    mutual = links.hint("merge").join(links.select(F.col("other").alias("key"), F.col("key").alias("other")), ["key", "other"], "left_semi").count()
    s2 = links.groupBy("other").count().agg(F.sum((1 + F.col("count") / k) ** 2).alias("s"), F.count("*").alias("c")).first()
    s0, s1 = float(n), (n * k + mutual) / k**2
    s2 = s2["s"] + (n - s2["c"])
    whole = local.agg(F.avg("i").alias("i")).first()["i"]
    e = -1 / (n - 1)
    top = n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0) - kurt * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0)
    var = top / ((n - 1) * (n - 2) * (n - 3) * s0 * s0) - e * e
    zscore = (whole - e) / np.sqrt(var)
    wi2 = 1 / k
    evar = (wi2 * (n - kurt) / (n - 1)) + ((1 - wi2) * (2 * kurt - n) / ((n - 1) * (n - 2))) - 1 / (n - 1) ** 2
    sd = float(np.sqrt(evar))
    quad = F.when((F.col("z") > 0) & (F.col("lag") > 0), "high-high").when((F.col("z") < 0) & (F.col("lag") < 0), "low-low").when(F.col("z") > 0, "high-low").otherwise("low-high")
    sure = F.abs((F.col("i") - e) / sd) > 1.959963984540054
    local = local.select("key", "i", F.when(sure, quad).otherwise("not significant").alias("quadrant"))
    return local, {"i": float(whole), "expected": e, "variance": float(var), "z": float(zscore), "p_value": normal_p(float(zscore)), "n": int(n)}


def entropy_weights(units: DataFrame, covariates: list[str], steps: int = 500) -> tuple[DataFrame, np.ndarray]:
    """Weights of controls (treatment 0) that give them the treated means of ``covariates``: Newton steps on the dual,
    each one aggregate of weighted moments; only p x p sums reach the driver."""
    z = units.agg(*(F.avg(F.when(F.col("treatment") == 1, F.col(c))).alias(f"m{i}") for i, c in enumerate(covariates)), *(F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(covariates))).first()
    p = len(covariates)
    x = [(F.col(c) - z[f"m{i}"]) / (z[f"s{i}"] or 1.0) for i, c in enumerate(covariates)]
    control = units.where("treatment = 0")
    lam = np.zeros(p)
    for _ in range(steps):
        w = F.exp(sum((float(a) * b for a, b in zip(lam, x, strict=True)), F.lit(0.0)))
        s = control.agg(F.sum(w).alias("w"), *(F.sum(w * x[i]).alias(f"g{i}") for i in range(p)), *(F.sum(w * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(p) for j in range(i, p))).first()
        g = np.array([s[f"g{i}"] for i in range(p)]) / s["w"]
        h = np.array([[s[f"h{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) / s["w"] - np.outer(g, g)
        if np.abs(g).max() < 1e-10:
            break
        step = np.linalg.lstsq(h, g, rcond=None)[0]
        lam = lam - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
    else:
        raise ValueError("no weights of the controls reach the treated means")
    w = F.exp(sum((float(a) * b for a, b in zip(lam, x, strict=True)), F.lit(0.0)))
    return units.withColumn("weight", F.when(F.col("treatment") == 1, F.lit(1.0)).otherwise(w)), lam

