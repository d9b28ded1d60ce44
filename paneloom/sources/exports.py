"""Heterogeneous tabular exports: discovery, keys in file names, header resolution, one harmonised table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paneloom.functions.pixels import _col

#: Season words and their codes.
SEASONS = {"yearly": 0, "annual": 0, "kharif": 1, "rabi": 2, "zaid": 3}

#: Canonical columns and the other names that exports give them.
ALIASES = {
    "latitude": ("lat", "y", "ycoord"), "longitude": ("lon", "long", "lng", "x", "xcoord"), "NDVI": ("ndvi_index",), "EVI": (), "SAVI": (), "LAI": ("leaf_area_index",),
    "Rain": ("rainfall", "precipitation", "precip"), "Tmax": ("tmax_c", "max_temperature"), "Tmin": ("tmin_c", "min_temperature"), "Tmean": ("tavg", "mean_temperature"),
    "Year": ("yr",), "Season": ("cropping_season",), "buff_km": ("buffer", "ring"), "SWSiD_All": ("site_id", "swsid"), "Treat": ("treatment_flag",), "LandUse": ("lulc",),
}
#: Endings that name a unit or the plain mean, and those of statistics that stay apart.
UNITS = ("mm", "c", "degc", "m", "km", "ha", "mean")
STATISTICS = ("sd", "std", "min", "max", "median", "count", "p10", "p90")


def file_keys(name: str | Column) -> Column:
    """(site, year, season) of a file name: the strict form first, else one year and one season word; two different
    years give no year."""
    n = F.lower(_col(name))
    words = "|".join(SEASONS)
    strict = rf"csv_(?:([a-z0-9]+)_)?((?:19|20)\d\d)_({words})_tile\d+(?:_sub\d+)?"
    years = F.array_distinct(F.regexp_extract_all(n, F.lit(r"(?<!\d)((?:19|20)\d\d)(?!\d)"), 1))
    found = F.array_distinct(F.regexp_extract_all(n, F.lit(rf"({words})"), 1))
    code = F.create_map(*(F.lit(x) for kv in SEASONS.items() for x in kv))
    is_strict = n.rlike(strict)
    year = F.when(is_strict, F.regexp_extract(n, strict, 2)).when(F.size(years) == 1, F.get(years, F.lit(0)))
    word = F.when(is_strict, F.regexp_extract(n, strict, 3)).when(F.size(found) == 1, F.get(found, F.lit(0)))
    site = F.when(is_strict, F.nullif(F.regexp_extract(n, strict, 1), F.lit("")))
    return F.struct(site.alias("site"), year.try_cast("int").alias("year"), F.try_element_at(code, word).alias("season"))


def alias_table(spark: SparkSession) -> DataFrame:
    rows = [(key, name, False) for name, others in ALIASES.items() for key in {_plain(name), *map(_plain, others)}]
    return spark.createDataFrame(rows, "header_key string, canonical string, statistic boolean")


def _plain(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum())


def resolved_headers(headers: DataFrame, header: str = "header") -> DataFrame:
    """Each distinct header with its canonical name and the rule that found it: exact or alias, a unit or number ending,
    a statistic (kept apart), one letter off, or none. Headers are few however many files have them."""
    spark = headers.sparkSession
    low = F.lower(F.regexp_replace(F.col(header), "^﻿", ""))
    words = F.filter(F.split(low, r"[^a-z0-9]+"), lambda x: x != "")
    last = F.element_at(words, -1)
    drop = F.when((F.size(words) > 1) & (last.isin(*UNITS) | last.rlike(r"^\d+$")), F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), "")).otherwise(F.array_join(words, ""))
    h = headers.select(header).distinct().withColumns({"whole": F.array_join(words, ""), "stem": drop, "statistic": (F.size(words) > 1) & last.isin(*STATISTICS)})
    known = alias_table(spark).select("header_key", "canonical")
    exact = h.join(F.broadcast(known.select(F.col("header_key").alias("whole"), F.col("canonical").alias("c1"))), "whole", "left")
    stem = exact.join(F.broadcast(known.select(F.col("header_key").alias("stem"), F.col("canonical").alias("c2"))), "stem", "left")
    listed = known.agg(F.collect_list(F.struct("header_key", "canonical")).alias("all"))
    near = F.filter("all", lambda k: (F.length(k["header_key"]) >= 4) & (F.levenshtein(k["header_key"], F.col("stem")) == 1))
    typo = stem.join(F.broadcast(listed)).withColumn("c3", F.when(F.size(F.array_distinct(F.transform(near, lambda k: k["canonical"]))) == 1, F.get(near, F.lit(0))["canonical"])).drop("all")
    rule = F.when(F.col("c1").isNotNull(), "alias").when(F.col("statistic"), "statistic").when(F.col("c2").isNotNull(), "ending").when(F.col("c3").isNotNull(), "typo").otherwise("unresolved")
    name = F.when(rule.isin("alias", "ending", "typo"), F.coalesce("c1", "c2", "c3"))
    return typo.select(header, name.alias("canonical"), rule.alias("rule"))


def header_rows(spark: SparkSession, folder: str, pattern: str = "*.csv", exclude: str | None = None) -> DataFrame:
    """(src_file, position, header) of every file below a folder, from the first line of each; paths that match ``exclude`` are
    left out."""
    lines = spark.read.option("wholetext", False).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder).select(F.col("_metadata.file_path").alias("src_file"), F.col("_metadata.file_block_start").alias("at"), "value")
    if exclude:
        lines = lines.where(~F.col("src_file").rlike(exclude))
    first = lines.where("at = 0").groupBy("src_file").agg(F.first("value").alias("value"))
    return first.select("src_file", F.posexplode(F.split("value", ",")).alias("position", "header"))


def harmonised(spark: SparkSession, folder: str, essential: tuple[str, ...] = ("latitude", "longitude"), pattern: str = "*.csv") -> DataFrame:
    """All exports of a folder under canonical names, with their file, time and keys; files without an essential column
    are left out, columns that a file lacks are null. Files of one header are read in one scan."""
    rows = header_rows(spark, folder, pattern)
    names = {r["header"]: r["canonical"] for r in resolved_headers(rows).collect()}
    groups = rows.groupBy("src_file").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "header"))), lambda s: s["header"]).alias("headers")).groupBy("headers").agg(F.collect_list("src_file").alias("files")).collect()
    out = None
    for g in groups:
        if not set(essential) <= {names.get(h) for h in g["headers"]}:
            continue
        read = spark.read.option("header", True).csv(g["files"])
        taken: set[str] = set()
        cols = []
        for i, h in enumerate(g["headers"]):
            to = names.get(h)
            if to is None:
                continue
            to, own = (to, False) if to not in taken else (f"{to}__dup_{_plain(h)}", True)
            taken.add(to)
            raw = F.col(f"`{read.columns[i]}`")
            cols.append(raw.try_cast("double").alias(to) if not own and to not in ("Season",) else raw.alias(to))
        part = read.select(*cols, F.col("_metadata.file_path").alias("src_file"), F.col("_metadata.file_modification_time").alias("mtime"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no file has the essential columns")
    keyed = out.withColumn("key", file_keys(F.element_at(F.split("src_file", "/"), -1)))
    for c in ALIASES:
        if c not in keyed.columns:
            keyed = keyed.withColumn(c, F.lit(None).cast("double"))
    code = F.create_map(*(F.lit(x) for kv in SEASONS.items() for x in kv))
    season = F.coalesce("key.season", F.col("Season").try_cast("int"), F.try_element_at(code, F.lower(F.col("Season").cast("string"))))
    return keyed.withColumns({"Year": F.coalesce("key.year", F.col("Year").cast("int")), "Season": season}).drop("key")


def write_panel(panel: DataFrame, path: str, keys: tuple[str, ...] = ("Year", "Season")) -> None:
    """A panel in its natural order, by year and season; Spark's commit protocol publishes it whole or not at all."""
    order = [F.col("Year"), F.pmod(F.col("Season") - 1, F.lit(4)), *(F.col(c) for c in panel.columns if c not in ("Year", "Season"))][:4]
    panel.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy(*keys).parquet(path)
