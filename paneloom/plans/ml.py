"""Effect models with pyspark.ml on the long difference: one row for each unit with change d, treatment w, covariates.

Nuisance models are cross-fitted: rows get a fold by a stable hash, each fold is predicted by models of the others. Scores
are columns, and estimates are aggregates of them. Nuisance forests are grown from sums by cell (cells.py).
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paneloom.sources.staging import staged

from .cells import Forest, predicted
from .stats import normal_p

CLIP = 0.02


def assembled(df: DataFrame, covariates: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=covariates, outputCol="x", handleInvalid="skip").transform(df)


def _forest(label: str, trees: int, least: int):
    return RandomForestRegressor(featuresCol="x", labelCol=label, predictionCol=f"p_{label}", numTrees=trees, minInstancesPerNode=least, maxDepth=5, seed=1)


def _clipped(e):
    return F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), e))


def _with_e(df: DataFrame) -> DataFrame:
    """``df`` with the propensity e of a logistic regression."""
    model = LogisticRegression(featuresCol="x", labelCol="w", probabilityCol="prob", rawPredictionCol="raw", predictionCol="cls").fit(df)
    return model.transform(df).withColumn("e", _clipped(vector_to_array("prob")[1])).drop("prob", "raw", "cls")


def by_forests(df: DataFrame, key: str, forests: list[Forest], trees: int, least: int, folds: int = 1) -> DataFrame:
    """``df`` with the forests' predictions and the propensity e, written so that what follows doesn't predict again."""
    return staged(predicted(df, key, [*forests, Forest("e", "w", share=True)], trees, least, folds).withColumn("e", _clipped(F.col("e"))))


def cross_fitted(df: DataFrame, key: str, folds: int, fit) -> DataFrame:
    """fit(train) gives a function that adds predictions; each fold gets those of models that never saw it."""
    dealt = df.withColumn("fold", F.pmod(F.xxhash64(key), F.lit(folds)))
    out = None
    for k in range(folds):
        done = fit(dealt.where(F.col("fold") != k))(dealt.where(F.col("fold") == k))
        out = done if out is None else out.unionByName(done)
    return out


def mean_and_se(scores: DataFrame, score: str, model: str) -> DataFrame:
    """One result row: the mean of a score column and its standard error."""
    s = scores.agg(F.avg(score).alias("estimate"), (F.stddev_samp(score) / F.sqrt(F.count(score))).alias("se"), F.count(score).alias("n")).first()
    z = s["estimate"] / s["se"] if s["se"] else float("nan")
    return scores.sparkSession.createDataFrame([(model, float(s["estimate"]), float(s["se"]), normal_p(z), s["n"])], "model string, estimate double, se double, p_value double, n_obs long")


def aipw_att(df: DataFrame) -> DataFrame:
    """Doubly robust effect on the treated: logistic propensity, outcome regression of the controls, influence function."""
    fitted = _with_e(df)
    m0 = LinearRegression(featuresCol="x", labelCol="d", predictionCol="m0").fit(df.where("w = 0"))
    s = m0.transform(fitted).withColumn("odds", F.col("e") / (1 - F.col("e")))
    means = s.agg(F.avg("w").alias("pw"), F.avg(F.col("odds") * (1 - F.col("w"))).alias("po"))
    s = s.join(F.broadcast(means))
    r = F.col("d") - F.col("m0")
    s = s.withColumn("score", F.col("w") / F.col("pw") * r - F.col("odds") * (1 - F.col("w")) / F.col("po") * r)
    return mean_and_se(s, "score", "aipw")


def dml(df: DataFrame, key: str = "unit", folds: int = 3, trees: int = 30, least: int = 20) -> DataFrame:
    """Partially linear double machine learning: residual on residual over cross-fitted forests, HC0 errors."""
    s = by_forests(df, key, [Forest("p_d", "d")], trees, least, folds).select((F.col("d") - F.col("p_d")).alias("u"), (F.col("w") - F.col("e")).alias("v"))
    t = s.agg(F.sum(F.col("u") * F.col("v")).alias("uv"), F.sum(F.col("v") * F.col("v")).alias("vv"))
    t = s.join(F.broadcast(t)).withColumn("theta", F.col("uv") / F.col("vv"))
    psi = F.col("v") * (F.col("u") - F.col("theta") * F.col("v"))
    r = t.agg(F.max("theta").alias("theta"), (F.sqrt(F.sum(psi * psi)) / F.max("vv")).alias("se"), F.count("*").alias("n")).first()
    return df.sparkSession.createDataFrame([("dml", float(r["theta"]), float(r["se"]), normal_p(r["theta"] / r["se"]), r["n"])], "model string, estimate double, se double, p_value double, n_obs long")


def _two_arms(df: DataFrame, key: str, folds: int, trees: int, least: int, boosted: bool = False) -> DataFrame:
    """Cross-fitted outcome models of both arms (mu1, mu0) and the propensity e."""
    if not boosted:
        return by_forests(df, key, [Forest("mu1", "d", among="w"), Forest("mu0", "d", among="1 - w")], trees, least, folds)

    def fit(train):
        model = lambda w, name: GBTRegressor(featuresCol="x", labelCol="d", predictionCol=name, maxIter=15, maxDepth=3, seed=1).fit(train.where(F.col("w") == w))
        one, none = model(1, "mu1"), model(0, "mu0")
        return lambda rest: none.transform(one.transform(rest))

    return cross_fitted(by_forests(df, key, [], trees, least, folds), key, folds, fit)


def _aipw_score(s: DataFrame) -> DataFrame:
    w, d = F.col("w"), F.col("d")
    return s.withColumn("score", F.col("mu1") - F.col("mu0") + w * (d - F.col("mu1")) / F.col("e") - (1 - w) * (d - F.col("mu0")) / (1 - F.col("e")))


def dr_learner(df: DataFrame, key: str = "unit", folds: int = 3, trees: int = 20, least: int = 10, boosted: bool = False) -> DataFrame:
    """The mean of cross-fitted doubly robust scores."""
    return mean_and_se(_aipw_score(_two_arms(df, key, folds, trees, least, boosted)), "score", "boosted response surface" if boosted else "dr_learner")


def meta_learners(df: DataFrame, key: str = "unit", trees: int = 20, least: int = 10) -> DataFrame:
    """S, T and X learners: mean effect, effect on the treated, spread and tails of the unit effects."""
    both = VectorAssembler(inputCols=["x", "arm"], outputCol="xw")
    at = lambda rows, a: both.transform(rows.withColumn("arm", a))
    single = _forest("d", trees, least).setFeaturesCol("xw").fit(at(df, F.col("w")))
    under = lambda rows, a, name: single.setPredictionCol(name).transform(at(rows, F.lit(a))).drop("xw", "arm")
    s = by_forests(df, key, [Forest("mu1", "d", among="w"), Forest("mu0", "d", among="1 - w")], trees, least)
    s = s.withColumn("t_cate", F.col("mu1") - F.col("mu0")).withColumn("imputed", F.when(F.col("w") == 1, F.col("d") - F.col("mu0")).otherwise(F.col("mu1") - F.col("d")))
    s = staged(predicted(s, key, [Forest("g1", "imputed", among="w"), Forest("g0", "imputed", among="1 - w")], trees, least))
    s = under(under(s, 1.0, "s1"), 0.0, "s0").withColumn("s_cate", F.col("s1") - F.col("s0"))
    s = s.withColumn("x_cate", F.col("e") * F.col("g0") + (1 - F.col("e")) * F.col("g1"))
    rows = s.select("w", F.explode(F.array(*(F.struct(F.lit(n).alias("learner"), F.col(c).alias("cate")) for n, c in (("S", "s_cate"), ("T", "t_cate"), ("X", "x_cate"))))).alias("r")).select("w", "r.*")
    return rows.groupBy("learner").agg(F.avg("cate").alias("mean_cate"), F.avg(F.when(F.col("w") == 1, F.col("cate"))).alias("att"), F.percentile_approx("cate", 0.1).alias("p10"), F.percentile_approx("cate", 0.9).alias("p90"), F.stddev_samp("cate").alias("sd"))


def cate_quartiles(df: DataFrame, covariate: str, key: str = "unit", folds: int = 3, trees: int = 20, least: int = 10) -> DataFrame:
    """An R-learner's effects by quartile of a covariate, with the doubly robust mean beside them."""
    s = by_forests(df, key, [Forest("p_d", "d")], trees, least, folds).withColumn("v", F.col("w") - F.col("e")).withColumn("pseudo", (F.col("d") - F.col("p_d")) / F.col("v")).withColumn("v2", F.col("v") * F.col("v"))
    s = staged(predicted(s, key, [Forest("cate", "pseudo", weight="v2")], trees, least))
    cuts = s.stat.approxQuantile(covariate, [0.25, 0.5, 0.75], 0.001)
    q = F.lit(1)
    for c in cuts:
        q = q + (F.col(covariate) > c).cast("int")
    return s.groupBy(q.alias("quartile")).agg(F.avg("cate").alias("mean_cate"), (F.sum(F.col("v2") * F.col("pseudo")) / F.sum("v2")).alias("r_effect"), F.count("*").alias("n"))


def matched_pairs(df: DataFrame, key: str = "unit", caliper: float = 0.2, rounds: int = 1000) -> DataFrame:
    """One-to-one matches on the logit of the propensity within a caliper of its spread, without replacement."""
    s = _with_e(df).withColumn("logit", F.log(F.col("e") / (1 - F.col("e"))))
    return pairs_within(s, caliper * (s.agg(F.stddev_samp("logit")).first()[0] or 1.0), key, rounds)


def pairs_within(s: DataFrame, width: float, key: str = "unit", rounds: int = 1000) -> DataFrame:
    """(t, c, gap): one-to-one pairs of treated and controls (key, w, logit) that are ``width`` apart at most.

    Units of one score and treatment are one entry with a count. Entries that are each other's nearest of the other kind
    are neighbours in the order of scores; in each round all such neighbours give as many pairs as the lesser of them holds,
    by rank of the key, until none is left. Equal gaps go to the lower score.
    """
    ranked = staged(s.select(F.col(key).alias("key"), F.col("w").cast("int").alias("w"), "logit").withColumn("place", F.row_number().over(Window.partitionBy("logit", "w").orderBy("key")).cast("long")))
    left, taken = staged(ranked.groupBy("logit", "w").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("used"))), []
    order = Window.partitionBy("at").orderBy("logit", "w")
    down = Window.partitionBy("at").orderBy(F.desc("logit"), F.desc("w")).rowsBetween(Window.unboundedPreceding, -1)
    up = order.rowsBetween(Window.unboundedPreceding, -1)
    of = lambda w: F.last(F.when(F.col("w") == w, F.col("logit")), ignorenulls=True)
    home = F.floor(F.col("logit") / (1.01 * width))  # whatever is within ``width`` is in the next bin at most
    for _ in range(rounds):
        seen = left.withColumn("home", home).withColumn("at", F.explode(F.array(*(F.col("home") + k for k in (-2, -1, 0, 1)))))
        seen = seen.withColumn("next", F.lead(F.struct("logit", "w", "n", "used")).over(order))
        seen = seen.withColumn("gap", F.when((F.col("next.w") != F.col("w")) & (F.col("next.logit") - F.col("logit") <= width), F.col("next.logit") - F.col("logit")))
        seen = seen.withColumns({f"low{w}": of(w).over(up) for w in (0, 1)} | {f"high{w}": of(w).over(down) for w in (0, 1)})
        seen = seen.withColumns({"before": F.expr("logit - if(w = 1, low0, low1)"), "after": F.expr("if(w = 1, high0, high1) - logit")})
        seen = seen.withColumn("after", F.lead("after").over(order))
        met = seen.where("at = home AND gap IS NOT NULL AND (before IS NULL OR gap < before) AND (after IS NULL OR gap <= after)")
        met = staged(met.select("logit", "w", "used", "gap", F.least("n", "next.n").alias("m"), F.col("next.logit").alias("logit2"), F.col("next.w").alias("w2"), F.col("next.used").alias("used2")))
        if met.isEmpty():
            break
        taken.append(met)
        if len(taken) == 20:  # few tables in one plan
            whole = taken[0]
            for x in taken[1:]:
                whole = whole.union(x)
            taken = [staged(whole)]
        spent = met.select("logit", "w", "m").union(met.select("logit2", "w2", "m"))
        left = left.join(spent, ["logit", "w"], "left").withColumn("m", F.coalesce("m", F.lit(0)))
        left = staged(left.select("logit", "w", (F.col("n") - F.col("m")).alias("n"), (F.col("used") + F.col("m")).alias("used")).where("n > 0"))
    else:
        raise RuntimeError(f"matching did not settle in {rounds} rounds")
    if not taken:
        return ranked.select(F.col("key").alias("t"), F.col("key").alias("c"), F.col("logit").alias("gap")).limit(0)
    whole = taken[0]
    for x in taken[1:]:
        whole = whole.union(x)
    each = whole.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "m")))
    one = lambda mine, other: F.when(F.col("w") == 1, F.col(mine)).otherwise(F.col(other))
    each = each.select("gap", one("logit", "logit2").alias("lt"), (one("used", "used2") + F.col("k")).alias("pt"), one("logit2", "logit").alias("lc"), (one("used2", "used") + F.col("k")).alias("pc"))
    treated = ranked.where("w = 1").select(F.col("key").alias("t"), F.col("logit").alias("lt"), F.col("place").alias("pt"))
    controls = ranked.where("w = 0").select(F.col("key").alias("c"), F.col("logit").alias("lc"), F.col("place").alias("pc"))
    return each.join(treated, ["lt", "pt"]).join(controls, ["lc", "pc"]).select("t", "c", "gap")
