"""Joins on names, time and overlapping keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneloom.functions.pixels import name_key


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(1.0)


def by_name(left: DataFrame, right: DataFrame, left_name: str, right_name: str, how: str = "left") -> DataFrame:
    """Equi-join on normalised names; right columns of a name that left has should be renamed before."""
    a, b = left.withColumn("_name", name_key(left_name)), right.withColumn("_name", name_key(right_name))
    return a.join(b, "_name", how).drop("_name")


def fuzzy_names(names: DataFrame, candidates: DataFrame, least: float = 0.80, margin: float = 0.05, most: int = 5_000) -> DataFrame:
    """(name, match, score): exact normalised spelling first, else the candidate of the greatest similarity if it is
    ``least`` or more and ``margin`` ahead of the next.

    ``candidates`` is a short list (counted: ``most`` at most) that stands beside every distinct name.
    """
    keyed = candidates.select(F.col("name").alias("match"), name_key("name").alias("mk")).distinct()
    if keyed.count() > most:
        raise ValueError(f"more than {most} candidate names")
    listed = keyed.agg(F.collect_list(F.struct("match", "mk")).alias("all"))
    asked = names.select("name", name_key("name").alias("nk")).distinct()
    scored = asked.join(F.broadcast(listed)).select("name", "nk", F.explode("all").alias("c"))
    scored = scored.select("name", F.col("c.match").alias("match"), similarity(F.col("nk"), F.col("c.mk")).alias("score"))
    order = Window.partitionBy("name").orderBy(F.desc("score"), "match")
    top = scored.withColumns({"place": F.row_number().over(order), "second": F.lead("score").over(order)}).where("place = 1")
    sure = (F.col("score") == 1) | ((F.col("score") >= least) & (F.col("score") - F.coalesce("second", F.lit(0.0)) >= margin))
    return top.select("name", F.when(sure, F.col("match")).alias("match"), F.round("score", 6).alias("score"))


def as_of(left: DataFrame, series: DataFrame, key: str, at: str, time: str, value: str) -> DataFrame:
    """``left`` with ``value`` of the series' latest row of the key at or before ``at``.

    Both sides are put in one order by key and time, and a running last value carries the series over the rows of left;
    one shuffle on the key, no row meets more than its neighbours. A key with very many rows is split by neither, as its
    order is what decides.
    """
    marks = series.select(F.col(key), F.col(time).alias("_t"), F.lit(0).alias("_left"), F.col(value).alias("_v"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_row"))
    asks = left.select(F.col(key), F.col(at).alias("_t"), F.lit(1).alias("_left"), F.lit(None).cast(series.schema[value].dataType).alias("_v"), F.struct("*").alias("_row"))
    run = Window.partitionBy(key).orderBy("_t", "_left").rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(asks).withColumn("_last", F.last("_v", ignorenulls=True).over(run))
    return both.where("_left = 1").select("_row.*", F.col("_last").alias(value))


def reconciled(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of two tables by key with what side has them."""
    a, b = left.groupBy(*keys).agg(F.count("*").alias("n_left")), right.groupBy(*keys).agg(F.count("*").alias("n_right"))
    side = F.when(F.col("n_left").isNull(), "right_only").when(F.col("n_right").isNull(), "left_only").otherwise("both")
    return a.join(b, keys, "full_outer").select(*keys, F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"), side.alias("side"))


def similar_pairs(names: DataFrame, name: str = "name", least: float = 0.8) -> DataFrame:
    """Pairs (a, b), a < b, of distinct names whose similarity without case is ``least`` or more; nulls are left out.

    Such names share ``least`` of the longer one's letters at least, each counted as often as it stands. So they meet in an
    equi-join on one of the first letters of both, as many as similarity needs, in one order that puts repeats and late letters
    first, which are rarer.
    """
    low = F.lower(name)
    letters = F.transform(F.sequence(F.lit(1), F.length(low)), lambda i: F.substring(low, i, F.lit(1)))
    marked = F.transform("letters", lambda c, i: F.struct((-F.size(F.filter(F.slice("letters", F.lit(1), i + 1), lambda x: x == c))).alias("nth"), (-F.ascii(c)).alias("code"), c.alias("letter")))
    one = names.where(F.col(name).isNotNull()).select(F.col(name).alias("n")).distinct().withColumn(name, F.col("n")).withColumn("letters", F.when(F.length(low) > 0, letters).otherwise(F.array(F.lit(""))))
    take = F.size("letters") - F.ceil(least * F.size("letters") - 1e-9) + 1
    first = one.select("n", F.explode(F.slice(F.array_sort(marked), F.lit(1), take.cast("int"))).alias("mark"))
    met = first.withColumnRenamed("n", "a").join(first.withColumnRenamed("n", "b"), "mark").where("a < b").select("a", "b").distinct()
    return met.where(similarity(F.lower("a"), F.lower("b")) >= least)


def name_clusters(pairs: DataFrame, names: DataFrame, staged) -> DataFrame:
    """(name, cluster): names joined by pairs (a, b), named by their least member.

    Each round hangs a name's larger neighbours on its least one, then its smaller neighbours on the least of these, until
    only stars are left; long chains shrink by a factor a round.
    """
    arcs = staged(pairs.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = arcs.union(arcs.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        hung = large.join(low, "u").where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        after = staged(hung.union(low.select("u", "low")).distinct())
        if after.exceptAll(arcs).isEmpty() and arcs.exceptAll(after).isEmpty():
            break
        arcs = after
    return names.join(arcs.select(F.col("u").alias("name"), F.col("v").alias("cluster")), "name", "left").select("name", F.coalesce("cluster", "name").alias("cluster"))
