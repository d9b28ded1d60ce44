"""Lines that many documents share are dropped from all of them but one.

Lines are exploded with their position, normalised and hashed to 128 bits; distinct documents are counted for each hash,
first by hash and document, then by hash alone, so that a very common line is summed from many tasks. Lines of hashes
over the threshold meet them again in a join: hashes with a thousandth of all lines or more are at most a thousand and
are broadcast, the others have too few lines each to make a task long. The positions that each text loses are gathered by
document and text, and texts are put together again from the positions that stay.

Defined results: a null text is one empty line; a null doc_id is one document, smaller than all others; rows that repeat
doc_id and text lose the same lines, rows that share a doc_id count as one document; a line that a document repeats goes or
stays at each of its places; a text that loses all its lines is empty; an empty table gives no rows. Columns named n_lines
or n_dropped are dropped from the input first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table
from .quality_rules import bound

EDGES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    plain = lambda x: F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER))  # noqa: E731  in ASCII both are the same, lower is faster
    return bound(F.btrim(line, F.lit(EDGES)), plain)


def digest(x: Column) -> Column:
    return F.unhex(F.md5(x))


def lines_of(text: Column | str) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def long_lines(rows: DataFrame, least_chars: int) -> DataFrame:
    """doc_id, twin, place and key of each line whose normal form has ``least_chars`` code points or more."""
    key = lambda line: bound(normalised(line), lambda k: F.when(F.length(k) >= least_chars, digest(k)))
    keyed = F.transform(lines_of("text"), lambda line, i: F.struct(i.alias("place"), F.when(F.length(line) >= least_chars, key(line)).alias("key")))
    return rows.select("doc_id", "twin", F.inline(F.filter(keyed, lambda x: x["key"].isNotNull())))


def common_keys(lines: DataFrame, least_docs: int) -> DataFrame:
    """Keys found in ``least_docs`` documents or more: key, the document that keeps it, and its lines."""
    documents = F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))
    return lines.groupBy("key").agg(documents.alias("n_docs"), F.max("doc_id").alias("keeper"), F.count("*").alias("n")).where(F.col("n_docs") >= least_docs)


def drop_common_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """Every row of ``docs`` with the lines of its text that stay, n_lines (before) and n_dropped."""
    rest = docs.drop("n_lines", "n_dropped")
    rows = rest.select(F.struct(*rest.columns).alias("row"), "doc_id", "text", digest(F.coalesce("text", F.lit(""))).alias("twin"))
    lines = staged(long_lines(rows, least_chars), "lines")
    common = staged(common_keys(lines, least_docs), "common")
    heavy = F.col("n") >= lines.count() / 1000
    by_key = lambda part: lines.join(part, "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    hits = by_key(F.broadcast(common.where(heavy))).union(by_key(common.where(~heavy)))  # at most 1000 keys are heavy
    gone = hits.groupBy("doc_id", "twin").agg(F.collect_set("place").alias("gone"))  # places of one text
    gone = staged(gone.select(F.col("doc_id").alias("d"), F.col("twin").alias("t"), "gone"), "gone")
    met = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("twin") == F.col("t")), "left")

    def rebuilt(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone")
        text = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
        return F.struct(text.alias("text"), F.size(lines).cast("long").alias("n_lines"))

    made = met.withColumn("made", bound(lines_of("text"), rebuilt))
    kept = [F.col("made.text").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in rest.columns]
    return made.select(*kept, F.col("made.n_lines").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before, lines dropped and digest of what stays of every document."""
    found = drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) + max(CAST(doc_id IS NULL AS INT)) >= 5),
m AS (SELECT k.r, k.doc_id, line, place, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.keeper AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY r
"""
