"""De-duplication of repeated rows by an explicit priority, their classification, and gap filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: list[str], outcomes: list[str], mtime: str, observations: str, source: str, vintage: str | None = None, margin: float = 1.0, priority: str = "newest") -> DataFrame:
    """``df`` with ``rank``: 1 for the row of each key that is kept.

    Order: newest (within ``margin`` seconds of the key's latest), fewest missing outcomes, most observations (null as
    -1), vintage, source name. ``priority="complete"`` puts completeness first.
    """
    key = Window.partitionBy(*keys)
    missing = sum((F.col(c).isNull().cast("int") for c in outcomes), F.lit(0))
    newest = (F.max(mtime).over(key) - F.col(mtime) <= margin).cast("int")
    marked = df.withColumns({"missing": missing, "newest": newest})
    order = [F.desc("newest"), F.asc("missing")] if priority == "newest" else [F.asc("missing"), F.desc("newest")]
    order += [F.desc(F.coalesce(F.col(observations), F.lit(-1)))]
    order += [F.desc(vintage)] if vintage else []
    return marked.withColumn("rank", F.row_number().over(key.orderBy(*order, F.asc(source))))


def deduplicated(df: DataFrame, keys: list[str], outcomes: list[str], mtime: str, observations: str, source: str, **options) -> DataFrame:
    """The kept row of each key, as it is."""
    return ranked(df, keys, outcomes, mtime, observations, source, **options).where("rank = 1").drop("rank", "missing", "newest")


def classified(df: DataFrame, keys: list[str], outcomes: list[str]) -> DataFrame:
    """Keys with several rows: conflicting (an outcome has two values), complementary (one fills another's gap), or
    redundant."""
    aggs = [F.count_distinct(c).alias(f"d_{c}") for c in outcomes] + [(F.count("*") - F.count(c)).alias(f"m_{c}") for c in outcomes]
    found = df.groupBy(*keys).agg(F.count("*").alias("n_rows"), *aggs).where("n_rows > 1")
    conflict = [F.col(f"d_{c}") > 1 for c in outcomes]
    gap = [(F.col(f"d_{c}") >= 1) & (F.col(f"m_{c}") > 0) for c in outcomes]
    either = lambda xs: __import__("functools").reduce(lambda a, b: a | b, xs)
    return found.select(*keys, "n_rows", F.when(either(conflict), "conflicting").when(either(gap), "complementary").otherwise("redundant").alias("kind"))


def gap_filled(ranks: DataFrame, keys: list[str], outcomes: list[str]) -> DataFrame:
    """The kept row of each key, its missing outcomes filled from the dropped rows in order of rank."""
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("rank"))).alias(c) for c in outcomes]
    return ranks.groupBy(*keys).agg(*firsts)
