"""Rules that every panel build passes: usable outcomes, seasons, location codes, date readings, headers and parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that mark a file as one of the product's own panels.
OWN_COLUMNS = ("pixel_id", "did_term", "schema_vintage")


def usable(df: DataFrame, outcomes: list[str]) -> Column:
    """A row has at least one outcome."""
    return F.coalesce(*(F.col(c) for c in outcomes)).isNotNull()


def season_mode(mode: str, season: str = "season") -> Column:
    """Rows of a mode: seasonal (1 to 3), yearly (0), all, or one season by its code."""
    s = F.col(season)
    return {"seasonal": s.between(1, 3), "yearly": s == 0, "all": F.lit(True)}.get(mode) if mode in ("seasonal", "yearly", "all") else s == int(mode)


def location_codes(df: DataFrame, sites: Column, outside: Column, keys: tuple[str, str] = ("year", "season"), place: str = "place") -> DataFrame:
    """``df`` (site_id, place, pixel_id, buff_km, keys) with ``code``: 2 outside all polygons, 1 site not processed, 4 a place
    with two rings in one site, 3 a control row of a place that is treated in another processed site, or a later row of a place
    and period (nearest ring, then lowest site first); 0 otherwise. The first rule that fits decides."""
    by = Window.partitionBy("site_id", place)
    two_rings = F.min("buff_km").over(by) != F.max("buff_km").over(by)
    coded = df.withColumn("code", F.when(outside, 2).when(~sites, 1).when(two_rings, 4).otherwise(0))
    free = F.col("code") == 0
    core = coded.where(free & (F.col("buff_km") == 0)).groupBy(place).agg(F.min("site_id").alias("lo"), F.max("site_id").alias("hi"))
    met = coded.join(core, place, "left")
    elsewhere = free & (F.col("buff_km") > 0) & F.coalesce((F.col("lo") != F.col("site_id")) | (F.col("hi") != F.col("site_id")), F.lit(False))
    met = met.withColumn("code", F.when(elsewhere, 3).otherwise(F.col("code"))).drop("lo", "hi")
    order = Window.partitionBy(place, *keys).orderBy(F.col("code") != 0, "buff_km", "site_id", "pixel_id")
    return met.withColumn("_n", F.row_number().over(order)).withColumn("code", F.when((F.col("code") == 0) & (F.col("_n") > 1), 3).otherwise(F.col("code"))).drop("_n")


def dates_in_order(df: DataFrame, group: str, visit: str, text: str) -> DataFrame:
    """``df`` with ``date`` and ``read``: a text d/m/y whose parts can both be months is read as the one of day-first and
    month-first that lies between the visits whose dates are plain; day-first where both or neither do."""
    part = lambda i: F.get(F.split(text, "/"), F.lit(i)).cast("int")
    a, b, y = part(0), part(1), part(2)
    day_first, month_first = F.when(b <= 12, F.make_date(y, b, a)), F.when(a <= 12, F.make_date(y, a, b))
    read = df.withColumns({"_d": day_first, "_m": month_first})
    plain = F.when(F.col("_d").isNull() | F.col("_m").isNull() | (F.col("_d") == F.col("_m")), F.coalesce("_d", "_m"))
    order = Window.partitionBy(group).orderBy(visit)
    read = read.withColumn("_p", plain)
    read = read.withColumns({"_lo": F.last("_p", True).over(order.rowsBetween(Window.unboundedPreceding, -1)), "_hi": F.first("_p", True).over(order.rowsBetween(1, Window.unboundedFollowing))})
    fits = lambda c: F.coalesce(F.col(c) >= F.col("_lo"), F.lit(True)) & F.coalesce(F.col(c) <= F.col("_hi"), F.lit(True))
    how = F.when(F.col("_p").isNotNull(), "plain").when(fits("_d") & ~fits("_m"), "day first").when(fits("_m") & ~fits("_d"), "month first").otherwise("open")
    read = read.withColumn("read", how)
    return read.withColumn("date", F.when(F.col("read") == "plain", F.col("_p")).when(F.col("read") == "month first", F.col("_m")).otherwise(F.col("_d"))).drop("_d", "_m", "_p", "_lo", "_hi")


def own_products(headers: DataFrame) -> DataFrame:
    """src_file of the files (src_file, header) that are panels of this product, and must not be read as exports."""
    have = headers.where(F.lower("header").isin(*OWN_COLUMNS)).groupBy("src_file").agg(F.count_distinct(F.lower("header")).alias("n"))
    return have.where(F.col("n") == len(OWN_COLUMNS)).select("src_file")


def guarded_names(resolved: DataFrame) -> DataFrame:
    """(src_file, position, header, canonical, name): the first header of a canonical name takes it, later ones are kept as
    <name>__dup_<own header>."""
    nth = F.row_number().over(Window.partitionBy("src_file", "canonical").orderBy("position"))
    plain = F.regexp_replace(F.lower("header"), "[^a-z0-9]+", "")
    return resolved.where("canonical IS NOT NULL").withColumn("name", F.when(nth == 1, F.col("canonical")).otherwise(F.concat("canonical", F.lit("__dup_"), plain)))


def provenance(resolved: DataFrame, essential: tuple[str, ...], wanted: tuple[str, ...], marker: str) -> DataFrame:
    """A row a file: rejected (an essential column is missing), missing_source_cols, schema_vintage (by a marker column)."""
    has = resolved.groupBy("src_file").agg(F.collect_set("canonical").alias("has"), F.max(F.col("header") == marker).alias("marked"))  # few headers a file
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, (*essential, *wanted))), "has"))
    rejected = F.size(F.array_intersect(missing, F.array(*map(F.lit, essential)))) > 0
    return has.select("src_file", rejected.alias("rejected"), F.array_join(missing, ",").alias("missing_source_cols"), F.when(F.col("marked"), "v2").otherwise("v1").alias("schema_vintage"))


def union_parts(parts: list[DataFrame]) -> DataFrame:
    """Parts under one schema: columns that all read as numbers become doubles where they differ, others text; columns that a
    part lacks are null."""
    kinds: dict[str, set] = {}
    for p in parts:
        for f in p.schema.fields:
            kinds.setdefault(f.name, set()).add(f.dataType.simpleString())
    numbers = {"int", "bigint", "smallint", "tinyint", "float", "double"}
    to = {c: next(iter(k)) if len(k) == 1 else "double" if k <= numbers else "string" for c, k in kinds.items()}
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.select(*(F.col(c).cast(to[c]) for c in p.columns)) for p in parts])


def picked_until(ranked: DataFrame, order: list, rows: str, enough: Column) -> DataFrame:
    """``ranked`` with place, cumulative rows and picked: candidates in order until the rows before them are enough."""
    w = Window.orderBy(*order)  # candidates are rings or blocks of a design: few
    out = ranked.withColumns({"place": F.row_number().over(w), "cumulative": F.sum(rows).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return out.withColumn("picked", F.col("cumulative") - F.col(rows) < enough)


def agreement(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """n, r, bias (a - b) and root mean square of paired sources."""
    d = F.col(a) - F.col(b)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.corr(a, b).alias("r"), F.avg(d).alias("bias"), F.sqrt(F.avg(d * d)).alias("rmse"))


def audited(results: DataFrame) -> DataFrame:
    """Result rows (estimate, se, p_value) with a status: failed, no se, bad p, weak, or ok."""
    status = F.when(F.col("estimate").isNull(), "failed").when(F.col("se").isNull() | (F.col("se") <= 0), "no se").when(~F.coalesce(F.col("p_value").between(0, 1), F.lit(False)), "bad p").when(F.abs("estimate") < 2 * F.col("se"), "weak").otherwise("ok")
    return results.withColumn("status", status)
