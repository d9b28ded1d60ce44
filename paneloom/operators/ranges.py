"""Order statistics by ranges that are counted first, so that no task holds a whole group or the whole table."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paneloom.sources.staging import staged


def parted(df: DataFrame, value: str, parts: int = 256) -> DataFrame:
    """``df`` with ``_part``: the range that ``value`` falls in, of about equally filled ones."""
    bounds = sorted(set(df.stat.approxQuantile(value, [i / parts for i in range(1, parts)], 1 / (4 * parts)))) or [0.0]
    return Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol=value, outputCol="_part", handleInvalid="keep").transform(df)


def running(df: DataFrame, order: str, counts: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """``df``, which has a row for each ``keys`` and ``order`` (a double), with ``upto_<count>``: running sums in that order."""
    cut = staged(parted(df, order))
    sums = cut.groupBy(*keys, "_part").agg(*(F.sum(c).alias(f"_s_{c}") for c in counts))
    w = Window.partitionBy(*keys).orderBy("_part")  # the ranges of a key
    before = sums.select(*keys, "_part", *((F.sum(f"_s_{c}").over(w) - F.col(f"_s_{c}")).alias(f"_b_{c}") for c in counts))
    inside = Window.partitionBy(*keys, "_part").orderBy(order)
    met = cut.join(before, [*keys, "_part"])
    return met.withColumns({f"upto_{c}": F.col(f"_b_{c}") + F.sum(c).over(inside) for c in counts}).drop("_part", *(f"_b_{c}" for c in counts))


def quantiles(df: DataFrame, keys: list[str], value: str, taus: dict[str, float]) -> DataFrame:
    """Exact quantiles of each group by linear interpolation, a column for each name of ``taus``, and ``n``. Nulls are left out,
    a group of nulls alone has no row. Equal values are counted before they are ranged, so a common value is one row."""
    values = df.where(F.col(value).isNotNull()).groupBy(F.struct(*keys).alias("_key"), F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("n"))
    ran = staged(running(values, "_v", ["n"], ("_key",)))
    totals = ran.groupBy("_key").agg(F.max("upto_n").alias("_n"))
    place = lambda t: (F.col("_n") - 1) * F.lit(float(t))
    at = lambda rank: F.max(F.when((rank > F.col("upto_n") - F.col("n")) & (rank <= F.col("upto_n")), F.col("_v")))
    found = ran.join(totals, "_key").groupBy("_key", "_n").agg(*(at(f(place(t)) + 1).alias(f"_{s}{i}") for i, t in enumerate(taus.values()) for s, f in (("lo", F.floor), ("hi", F.ceil))))
    between = lambda i, t: F.col(f"_lo{i}") + (place(t) - F.floor(place(t))) * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))
    return found.select(*(F.col("_key").getField(k).alias(k) for k in keys), F.col("_n").alias("n"), *(between(i, t).alias(name) for i, (name, t) in enumerate(taus.items())))


def numbered(df: DataFrame, column: str) -> DataFrame:
    """(column, number): the distinct values in order, numbered from 0 without gaps."""
    sorted_ = staged(df.select(column).distinct().repartitionByRange(column).withColumn("_part", F.spark_partition_id()))
    sizes = sorted_.groupBy("_part").count()
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))  # a row a partition
    place = F.row_number().over(Window.partitionBy("_part").orderBy(column)) - 1
    return sorted_.join(F.broadcast(before), "_part").select(column, (F.col("_before") + place).alias("number"))
