"""Helpers that several operators share: tables staged in the shared folder, and the input tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that ends a word in every contract of this package.
SPACES = r"\x20\x09-\x0D"
WORD = f"[^{SPACES}]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only where a session of one machine has none a temporary folder is made and set; a cluster without one is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[[^,]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, used by one writer."""
    return f"{shared_dir(spark)}/paneloom/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: the lineage ends there, so a lost
    executor costs its own tasks and not the work before the table."""
    spark, path = df.sparkSession, stage_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batch: pa.RecordBatch, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of about ``most`` bytes, one row at least."""
    each = max(1, int(most * len(batch) // max(1, batch.nbytes)))
    queue = [batch.slice(i, each) for i in range(0, len(batch), each)][::-1]
    while queue:
        part = queue.pop()
        if len(part) > 1 and part.nbytes > 2 * most:  # long texts stand together
            half = len(part) // 2
            queue += [part.slice(half), part.slice(0, half)]
        else:
            yield part


SLOTS = 1 << 23


def unused(name: str, columns: list[str]) -> str:
    """``name``, made longer until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def maybe(rows: DataFrame, wanted: DataFrame, *key: str, others: bool = False) -> DataFrame:
    """The rows whose key may be in ``wanted`` (or the ``others``), by a bitmap of SLOTS bits, whatever the sizes: at most
    SLOTS / 64 rows are broadcast. Rows that it lets go need no shuffle."""
    word, bit, bits = (unused(x, rows.columns + wanted.columns) for x in ("__word", "__bit", "__bits"))
    slot = F.pmod(F.xxhash64(F.lit(5), *key), F.lit(SLOTS))  # the word and the bit of a key in the bitmap
    of_key = {word: F.shiftright(slot, 6), bit: F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))}
    bitmap = wanted.select(*(c.alias(x) for x, c in of_key.items())).groupBy(word).agg(F.bit_or(bit).alias(bits))
    met = rows.withColumns(of_key).join(F.broadcast(bitmap), word, "left")
    hit = F.coalesce(F.col(bits).bitwiseAND(F.col(bit)) != 0, F.lit(False))
    return met.where(~hit if others else hit).select(*rows.columns)
