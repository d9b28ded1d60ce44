"""URL rules by expressions of host suffix and path prefix.

Each distinct URL gives one expression for every suffix of its host and every prefix of its path that some rule could
have. Expressions meet the rules in an equi-join on a short prefix of their digest; the full digest confirms, and of a
URL's rules the longest one decides.

Defined results: a null URL or one without "://" has an empty host and path and meets no rule; a URL without a path has
the path ""; rules of equal length are ordered by the longer host, then block before allow; a repeated rule counts
once; repeated rows each keep a row; empty tables give no rows, no rules give the default verdict. Columns of the same
name as the result's are dropped from the input first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The fixed rules: host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

PREFIX_BYTES = 4


def parsed(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host and path."""
    after = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)"))
    host = F.translate(F.coalesce(F.regexp_extract(after, "^[^/?#]*", 0), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.coalesce(F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1), F.lit(""))
    return pages.withColumns({"host": host, "path": path})


def _digest(host, path):
    return F.sha2(F.concat_ws("\x00", host, path), 256)


def hashed_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with their digest, its short prefix and their rank; a rule in both ways blocks."""
    one = rules.groupBy("host", "path").agg(F.max(F.col("verdict") == "block").alias("blocks"))
    digest = _digest(F.col("host"), F.col("path"))
    return one.select(
        F.substring(digest, 1, 2 * PREFIX_BYTES).alias("short"), digest.alias("digest"),
        F.struct((F.length("host") + F.length("path")).alias("length"), F.length("host").alias("host_length"), "blocks", F.concat("host", "path").alias("rule")).alias("ranked"),
    )


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Distinct ``urls`` (url, host, path) with rule and verdict.

    A URL's suffixes and prefixes are taken at the counts of labels and the lengths that rules have: one row of two sets, which
    are no longer than the longest rule.
    """
    labels = lambda host: F.size(F.split(host, r"\."))
    shapes = rules.agg(F.collect_set(labels("host")).alias("counts"), F.collect_set(F.length("path")).alias("lengths"))
    met = urls.where("host != ''").join(F.broadcast(shapes))  # one row
    counts = F.filter("counts", lambda k: k <= labels("host"))
    spread = met.select("url", "host", "path", "lengths", F.explode(counts).alias("k")).select("url", F.expr("substring_index(host, '.', -k)").alias("h"), "path", "lengths")
    spread = spread.select("url", "h", "path", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n")).select("url", "h", F.expr("substring(path, 1, n)").alias("p"))
    digest = _digest(F.col("h"), F.col("p"))
    asked = spread.select("url", F.substring(digest, 1, 2 * PREFIX_BYTES).alias("short"), digest.alias("asked"))
    met = asked.join(hashed_rules(rules), "short").where(F.col("asked") == F.col("digest"))  # Spark broadcasts short rule lists, and shuffles long ones
    best = met.groupBy("url").agg(F.max("ranked").alias("best"))
    found = urls.join(best, "url", "left")
    return found.select("url", "host", "path", F.col("best.rule").alias("rule"), F.when(F.col("best.blocks"), "block").when(~F.col("best.blocks"), "allow").otherwise(default).alias("verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Every row of ``pages`` with host, path, rule and verdict of its url."""
    rest = pages.drop("host", "path", "rule", "verdict")
    urls = parsed(rest.select("url").where("url IS NOT NULL").distinct())
    joined = rest.where("url IS NOT NULL").join(judge(urls, rules, default), "url").select(*rest.columns, "host", "path", "rule", "verdict")
    none = rest.where("url IS NULL").select(*rest.columns, F.lit("").alias("host"), F.lit("").alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return joined.union(none)  # rows without a url need no join


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, deciding rule and verdict of every page's url."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


OP10_SQL = """
WITH cut AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                 coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
one AS (SELECT page_id, host, path, (SELECT arg_max(struct_pack(rule := h || p, v := v), length(h) + length(p)) FROM rules
        WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best FROM parts)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.v, 'allow') AS verdict FROM one
"""
