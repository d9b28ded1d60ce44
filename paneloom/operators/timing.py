"""Treatment timing and dose from a monthly series of cumulative amounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def revised(fund: DataFrame, site: str = "site_id", month: str = "month", reported: str = "amount_reported") -> DataFrame:
    """Later downward revisions correct earlier reports: the running minimum from the end; release and revision sizes."""
    ahead = Window.partitionBy(site).orderBy(month).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    order = Window.partitionBy(site).orderBy(month)
    fixed = fund.withColumn("amount", F.min(reported).over(ahead))
    return fixed.withColumns({"release": F.col("amount") - F.coalesce(F.lag("amount").over(order), F.lit(0.0)), "revision": F.col(reported) - F.col("amount")})


def completion(fund: DataFrame, site: str, month: str, share: str) -> DataFrame:
    """Running maximum of a completion share, and whether the report fell."""
    order = Window.partitionBy(site).orderBy(month)
    return fund.withColumns({"running": F.max(share).over(order.rowsBetween(Window.unboundedPreceding, 0)), "fell": F.coalesce(F.col(share) < F.lag(share).over(order), F.lit(False))})


def start_month(fund: DataFrame, rule: str = "backcast", share: float = 0.05, first: int = 12, site: str = "site_id", month: str = "month", amount: str = "amount", target: str = "target") -> DataFrame:
    """One row a site: its start month by ``rule``, the months cast back, and whether the start lies before the file.

    backcast: the mean monthly rate of the first ``first`` months says how long the first amount took to build up;
    share: the first month with ``share`` of the target; file_start: the first month.
    """
    m0 = F.min(month).over(Window.partitionBy(site))
    early = fund.withColumn("m0", m0)
    sums = early.groupBy(site).agg(
        F.min("m0").alias("m0"), F.min_by(amount, month).alias("a0"), F.max_by(amount, F.when(F.col(month) < F.col("m0") + first, F.col(month))).alias("aj"),
        F.max(F.when(F.col(month) < F.col("m0") + first, F.col(month))).alias("mj"), F.min(F.when(F.col(amount) >= share * F.col(target), F.col(month))).alias("share_month"),
    )
    rate = (F.col("aj") - F.col("a0")) / F.nullif(F.col("mj") - F.col("m0"), F.lit(0))
    back = F.when((F.col("a0") > 0) & (rate > 0), F.ceil(F.col("a0") / rate)).otherwise(1)
    start = {"backcast": F.col("m0") - back + 1, "share": F.col("share_month"), "file_start": F.col("m0")}[rule]
    return sums.select(site, start.cast("long").alias("start_month"), (back if rule == "backcast" else F.lit(1)).cast("long").alias("months_back"), (F.lit(rule == "backcast") & (back > 1)).alias("censored"), "m0", "a0")


def row_cohort(year: str, season: str, start_year: str, start_season: str):
    """The cohort year of a row: one later if its season comes before the start season in the year."""
    rank = lambda s: F.pmod(F.col(s) - 1, F.lit(4))
    return F.when(rank(season) < rank(start_season), F.col(start_year) + 1).otherwise(F.col(start_year))


def first_crossing(df: DataFrame, group: str, order: list[str], value: str, threshold: float) -> DataFrame:
    """The first row of each group whose value reaches the threshold."""
    return df.where(F.col(value) >= threshold).groupBy(group).agg(F.min(F.struct(*order, value)).alias("x")).select(group, "x.*")


def equal_division(dose: DataFrame, members: DataFrame, group: str, amount: str) -> DataFrame:
    """A group's amount divided equally over its members."""
    sizes = members.groupBy(group).agg(F.count("*").alias("n_members"))
    return dose.join(sizes, group).join(members, group).withColumn("member_amount", F.col(amount) / F.col("n_members"))
