"""Queries of effect models and synthetic controls."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneloom.sources.staging import staged
from paneloom.sources.tables import balanced, panel, table, treated

from . import factors, forest, ml, synth
from .fe import twfe
from .models import results
from .registry import query


def long_difference(spark, sf_dir):
    """A row for each pixel seen on both sides of the start: change d, treatment w, covariates from before."""
    p = treated(panel(spark, sf_dir))
    pre = F.col("post") == 0
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pixel_id"), F.col("c_acctbal").alias("balance"))
    g = p.groupBy("pixel_id").agg(F.max("treatment").cast("double").alias("w"), (F.avg(F.when(~pre, F.col("y"))) - F.avg(F.when(pre, F.col("y")))).alias("d"), F.avg(F.when(pre, F.col("y"))).alias("level"), F.count_if(pre).cast("double").alias("n_pre"))
    u = g.join(c, "pixel_id").where("d IS NOT NULL").withColumnRenamed("pixel_id", "unit")
    return staged(u), ["level", "n_pre", "balance"]


def _x(spark, sf_dir):
    u, covariates = long_difference(spark, sf_dir)
    return ml.assembled(u, covariates)


@query()
def m03_doubly_robust(spark, sf_dir):
    return ml.aipw_att(_x(spark, sf_dir))


@query()
def m14_matched(spark, sf_dir):
    x = _x(spark, sf_dir)
    pairs = ml.matched_pairs(x)
    kept = pairs.select(F.col("t").alias("pixel_id")).union(pairs.select(F.col("c").alias("pixel_id")))
    p = treated(panel(spark, sf_dir)).join(kept, "pixel_id", "left_semi").withColumns({"unit": F.concat_ws("|", "pixel_id", "season"), "period": F.col("year") * 10 + F.col("season")})
    return results(spark, twfe(p, "y", ["did_term"], "unit", "period", "site_id"))


@query()
def m39_cate_quartiles(spark, sf_dir):
    return ml.cate_quartiles(_x(spark, sf_dir), "level", trees=100)


@query()
def m40_double_ml(spark, sf_dir):
    return ml.dml(_x(spark, sf_dir), trees=300)


@query()
def m41_meta_learners(spark, sf_dir):
    return ml.meta_learners(_x(spark, sf_dir), trees=100)


@query()
def m42_dr_learner(spark, sf_dir):
    return ml.dr_learner(_x(spark, sf_dir), trees=100)


@query()
def m43_honest_forest(spark, sf_dir):
    u, covariates = long_difference(spark, sf_dir)
    site = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit"), (F.col("c_nationkey") + 1).alias("site_id"))
    return forest.honest_forest(ml.assembled(u.join(site, "unit"), covariates), covariates, "site_id", trees=100)


@query()
def m44_response_surface(spark, sf_dir):
    return ml.dr_learner(_x(spark, sf_dir), trees=100, boosted=True)


def _series(spark, sf_dir):
    b = balanced(spark, sf_dir)
    return b.groupBy("segment", F.concat_ws("|", "site_id", "buff_km").alias("series"), "year").agg(F.avg("y").alias("y"), F.max((F.col("buff_km") == 0)).alias("treated"))


@query()
def m11_synthetic_did(spark, sf_dir):
    return synth.synthetic_did_by_group(_series(spark, sf_dir), 1998, ["segment"])


@query()
def m45_elastic_net_control(spark, sf_dir):
    s = _series(spark, sf_dir)
    return synth.elastic_net_control(s.where("treated"), s.where("NOT treated"), 1998, "segment")


def _factor_rows(spark, sf_dir):
    """Units of the balanced panel as rows of years; ring 0 starts in 1998, 1999 or 2000 by site."""
    u = balanced(spark, sf_dir).withColumn("cohort", F.when(F.col("buff_km") == 0, 1998 + F.col("site_id") % 3).cast("int"))
    years = [r[0] for r in u.select("year").distinct().orderBy("year").collect()]
    return factors.in_rows(u.withColumnRenamed("site_id", "cluster"), years), years


@query()
def d1_pixel_synthetic(spark, sf_dir):
    """Two levels: synthetic weights of cells (block, ring) and years by season, spread over the pixels' rows for one weighted
    regression with pixel-season and period effects."""
    p = panel(spark, sf_dir).withColumns({"series": F.concat_ws("|", F.col("site_id") % 5, "buff_km"), "treated": F.col("buff_km") == 0})
    cells = p.groupBy("season", "series", "year").agg(F.avg("y").alias("y"), F.max("treated").alias("treated"))
    weights = staged(synth.synthetic_weights(cells, 1998, ["season"]))
    rows = synth.pixel_weights(p.withColumnRenamed("pixel_id", "pixel"), weights, 1998, "season")
    rows = rows.withColumns({"did_term": (F.col("treated") & (F.col("year") >= 1998)).cast("int"), "unit": F.concat_ws("|", "pixel", "season"), "period": F.col("year") * 10 + F.col("season")})
    return results(spark, twfe(rows, "y", ["did_term"], "unit", "period", "site_id", weight="weight"))


@query()
def m36_interactive_effects(spark, sf_dir):
    """Interactive fixed effects of untreated cells by turns; the treated cells' gaps by event time and over all."""
    rows, years = _factor_rows(spark, sf_dir)
    model = factors.factor_model(rows, years, "interactive")
    return factors.mean_gaps(factors.gaps(rows, model)).withColumn("factors", F.lit(model.n_factors))


@query()
def m38_generalized_control(spark, sf_dir):
    """Factors of the never treated, as many as the treated units' left-out years before the start ask for."""
    rows, years = _factor_rows(spark, sf_dir)
    model = factors.factor_model(rows, years)
    return factors.mean_gaps(factors.gaps(rows, model)).withColumn("factors", F.lit(model.n_factors))


@query()
def m37_matrix_completion(spark, sf_dir):
    return synth.completed_matrix(balanced(spark, sf_dir).withColumn("treated", F.col("buff_km") == 0), 1998)
