"""Fill-in-middle: a text is cut twice between its units and its parts are put in another order.

One full match of ``(unit)*`` keeps the end of every repetition of its group, so the match itself gives the number of units
and both cut offsets. The draws are hexadecimal groups of a digest of seed and doc_id; a row's result depends on nothing
but the row. Sentinels occur once in a rearranged text, since texts that hold one stay plain and no sentinel can arise
where parts and sentinels meet; splitting at them gives the parts back.

Defined results: a null text is an empty text, which stays plain with no units; a null doc_id is hashed as no digits;
repeated rows each keep a row; an empty table gives no rows. Columns of the same name as the result's are dropped from the
input first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, pieces, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Units take no character back, so the full match is the sequence of matches from left to right.
UNITS = regex.compile(f"([{SPACES}]*+[^{SPACES}]++|[{SPACES}]++)*+")


def rearranged(doc_id: int | None, text: str, seed: int = 42, percent: int = 50, spm_percent: int = 80) -> tuple:
    """n, form, code points of prefix and of middle, and the output of one text."""
    ends = UNITS.fullmatch(text).ends(1)
    n = len(ends)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or h3 % 100 >= percent or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    a, b = (ends[k - 1] if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_percent:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


RESULT = T.StructType([T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """Every row of ``docs`` with n, form, prefix_chars, middle_chars and output. ``percent`` of the texts are rearranged,
    ``spm_percent`` of these with the suffix first."""
    rest = docs.drop(*RESULT.names)

    def of(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in pieces(batch):
                rows = [rearranged(i.as_py(), t.as_py() or "", seed, percent, spm_percent) for i, t in zip(part.column("doc_id"), part.column("text"), strict=True)]
                found = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *found], [*part.schema.names, *RESULT.names])

    return rest.mapInArrow(of, T.StructType([*rest.schema.fields, *RESULT.fields]))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of."""
    part = lambda i: F.get(F.split(output, "<[PSM]>"), F.lit(i))  # noqa: E731  the parts in the output's order, after an empty one
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(1), part(3), part(2))).otherwise(F.concat(part(2), part(3), part(1)))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units, form, sizes of the parts and digests of output and restored text of every document."""
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents),
u AS (SELECT doc_id, text, units, len(units) AS n, CAST('0x' || h[1:8] AS UBIGINT) % (len(units) + 1) AS a, CAST('0x' || h[9:16] AS UBIGINT) % (len(units) + 1) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS UBIGINT) % 100 >= 50 THEN 'plain'
       WHEN CAST('0x' || h[25:32] AS UBIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT doc_id, text, n, form, array_to_string(units[1:least(a, b)], '') AS p, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(units[greatest(a, b) + 1:], '') AS s FROM u)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM c
"""
