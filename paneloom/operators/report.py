"""What every run ends with: results collected, audited and written, and what is checked before it begins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spatial import overlap_pairs

COLUMNS = ("model", "outcome", "scenario", "estimate", "se", "p_value", "n_obs", "n_units", "n_clusters")


def collected(results: dict[str, DataFrame], scenario: str) -> DataFrame:
    """One row for each result of every model, under the same columns; those that a model lacks are null."""
    rows = [df.withColumns({"model": F.lit(name), "scenario": F.lit(scenario)}) for name, df in results.items()]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    for c in COLUMNS:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string" if c == "outcome" else "double"))
    return out.select(*COLUMNS)


def statuses(results: DataFrame, design: DataFrame, keys: list[str], factor: float = 3.0) -> DataFrame:
    """``results`` (keys, estimate, se) with se_design of ``design`` (keys, se) and a status: failed (no estimate), no se, se of
    zero, model se far below the design's (by ``factor``), or ok."""
    met = results.join(design.select(*keys, F.col("se").alias("se_design")), keys, "left")
    status = (
        F.when(F.col("estimate").isNull() | F.isnan("estimate"), "failed").when(F.col("se").isNull() | F.isnan("se"), "no se").when(F.col("se") <= 1e-9, "se of zero")
        .when(F.col("se_design") > factor * F.col("se"), "se far below the design's").otherwise("ok")
    )
    return met.withColumn("status", status)


def write_package(results: DataFrame, path: str) -> None:
    """The flat table of estimates, a folder for each outcome."""
    results.write.mode("overwrite").partitionBy("outcome").parquet(path)


def location_facts(rows: DataFrame, points: DataFrame, least: float = 0.65) -> DataFrame:
    """Facts of every (site_id, pixel_id) of ``rows`` (site_id, pixel_id, buff_km, inside): rows, rows inside the site's polygon,
    whether its rings differ there, and, where its square still overlaps another's by ``least`` (``points``: pixel_id, lat, lon),
    the pixel that is kept instead: the one with more rows inside, then the lower id."""
    facts = rows.groupBy("site_id", "pixel_id").agg(F.count("*").alias("n_rows"), F.count_if("inside").alias("n_own"), F.min(F.when(F.col("inside"), F.col("buff_km"))).alias("_lo"), F.max(F.when(F.col("inside"), F.col("buff_km"))).alias("_hi"))
    n = rows.where("inside").groupBy("pixel_id").agg(F.count("*").alias("n"))
    pairs = overlap_pairs(points.join(n, "pixel_id", "left_semi"), "pixel_id", least=least)
    pairs = pairs.join(n.select(F.col("pixel_id").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("pixel_id").alias("b"), F.col("n").alias("nb")), "b")
    first = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    lost = pairs.select(F.when(first, F.col("b")).otherwise(F.col("a")).alias("pixel_id"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("keep"))
    lost = lost.groupBy("pixel_id").agg(F.min("keep").alias("kept_pixel"))
    conflict = F.coalesce(F.col("_lo") != F.col("_hi"), F.lit(False)).alias("ring_conflict")
    return facts.join(lost, "pixel_id", "left").select("site_id", "pixel_id", "n_rows", "n_own", conflict, "kept_pixel")


def leaks(rows: DataFrame, period: list[str]) -> DataFrame:
    """(check, n): pixels in both arms, pixels in several sites, and rows beyond the first of a pixel and period."""
    by = rows.groupBy("pixel_id").agg(F.count_distinct(F.col("buff_km") == 0).alias("arms"), F.count_distinct("site_id").alias("sites"))
    two = by.agg(F.count_if(F.col("arms") > 1).alias("both arms"), F.count_if(F.col("sites") > 1).alias("several sites"))
    more = rows.groupBy("pixel_id", *period).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated periods"))
    return two.join(F.broadcast(more)).unpivot([], ["both arms", "several sites", "repeated periods"], "check", "n")


def preflight(df: DataFrame, outcome: str, low: float, high: float) -> DataFrame:
    """(check, n, ok) of a sample (unit, treatment, post, outcome): units on one side of the start only, units seen once, outcomes
    out of bounds, codes for no data, and empty cells of arm and period."""
    by = df.groupBy("unit").agg(F.count("*").alias("n"), F.count_distinct("post").alias("sides"))
    units = by.agg(F.count_if(F.col("sides") < 2).alias("one side only"), F.count_if(F.col("n") == 1).alias("singletons"))
    y = F.col(outcome)
    rows = df.agg(F.count_if(~y.between(low, high)).alias("out of bounds"), F.count_if(y.isin(-9999.0, -999.0) | F.isnan(y)).alias("no-data codes"), (F.lit(4) - F.count_distinct(F.struct("treatment", "post"))).alias("empty cells"))
    long = units.join(F.broadcast(rows)).unpivot([], ["one side only", "singletons", "out of bounds", "no-data codes", "empty cells"], "check", "n")
    return long.withColumn("ok", F.col("n") == 0)


def require(checks: DataFrame, strict: list[str]) -> None:
    """Raises with the strict checks that fail."""
    bad = {r["check"]: r["n"] for r in checks.where(~F.col("ok") & F.col("check").isin(strict)).collect()}
    if bad:
        raise ValueError(f"the sample fails: {bad}")


def dry_run(headers: DataFrame, resolved: DataFrame) -> DataFrame:
    """What would be renamed in the newest file of each column width (``headers``: src_file, mtime, position, header):
    (width, src_file, position, header, canonical, rule)."""
    files = headers.groupBy("src_file").agg(F.max("mtime").alias("mtime"), F.count("*").alias("width"))
    newest = files.groupBy("width").agg(F.max_by("src_file", F.struct("mtime", "src_file")).alias("src_file"))  # a row a width
    return headers.join(F.broadcast(newest), "src_file").join(resolved, "header").select("width", "src_file", "position", "header", "canonical", "rule")


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(item, n, n_null, n_distinct, low, high) of some columns, as text; one pass."""
    parts = [F.struct(F.lit(c).alias("item"), F.count(c).alias("n"), F.count_if(F.col(c).isNull()).alias("n_null"), F.count_distinct(c).alias("n_distinct"), F.min(c).cast("string").alias("low"), F.max(c).cast("string").alias("high")) for c in columns]
    return df.agg(F.array(*parts).alias("a")).select(F.inline("a"))


def placebo_gaps(units: DataFrame, last: int = 2) -> DataFrame:
    """(placebo, estimate, switchers): for l = 1 to ``last``, the change of switchers from the year before their start back to l
    years earlier, less that of units that have not switched by the start; weighted by switchers. ``units``: unit, year, y, cohort."""
    cohorts = units.agg(F.collect_set("cohort").alias("all"))
    rows = units.join(F.broadcast(cohorts)).select("unit", "year", "y", "cohort", F.explode("all").alias("g"))
    mine: Column = F.coalesce(F.col("cohort") == F.col("g"), F.lit(False))
    base = rows.where("year = g - 1").select("unit", "g", F.col("y").alias("y0"))
    d = rows.where(F.col("year").between(F.col("g") - 1 - last, F.col("g") - 2)).where(mine | F.col("cohort").isNull() | (F.col("cohort") > F.col("g"))).join(base, ["unit", "g"])
    d = d.select("g", (F.col("g") - 1 - F.col("year")).cast("int").alias("placebo"), mine.alias("tr"), (F.col("y") - F.col("y0")).alias("d"))
    c = d.groupBy("g", "placebo").agg((F.avg(F.when(F.col("tr"), F.col("d"))) - F.avg(F.when(~F.col("tr"), F.col("d")))).alias("e"), F.count_if("tr").alias("n")).where("e IS NOT NULL")
    return c.groupBy("placebo").agg((F.sum(F.col("e") * F.col("n")) / F.sum("n")).alias("estimate"), F.sum("n").alias("switchers"))


def newest_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
