"""Importance resampling of documents toward a target by hashed n-grams.

Features are words and pairs of neighbours, hashed by CRC-32. The checksum is affine in the bytes: a span's is the XOR of
what each byte adds at its distance from the span's end, and of a constant of the span's length. So all the features of a
batch are one gather from a table of distances and bytes and one ``bitwise_xor.reduceat`` over their spans; spans longer
than the table are taken in blocks whose registers are folded.

Buckets are counted over all documents and over all target texts; a bucket's gain is its log ratio. A document's weight is
the floored mean of its features' gains, its score the weight and a Gumbel draw from a digest of doc_id, and the highest
scores are drawn: a sample without replacement in proportion to the importance. Ranks come from ranges of score and doc_id
that are counted first, so no task sorts all documents.

Defined results: a null text has no words, weight 0 and no rank; a null doc_id is hashed as no digits and comes last among
equal scores; repeated rows each have a row and a rank; with an empty target all its counts are 0; an empty table gives no
rows. Further columns of the input are left out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces, staged, table

BUCKETS, WIDTH, SLICE = 10_000, 64, 1 << 14


def _distances(width: int) -> np.ndarray:
    """[k, b]: what byte b adds to the register when k bytes follow it."""
    step = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    rows = [step]
    for _ in range(width - 1):
        rows.append((rows[-1] >> np.uint32(8)) ^ step[rows[-1] & np.uint32(255)])
    return np.stack(rows)


AT = _distances(WIDTH)
FLAT = AT.ravel()
CONSTANT = np.array([zlib.crc32(bytes(n)) for n in range(WIDTH + 1)], np.uint32)


def registers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """What the bytes of each span add, for spans of 1 to WIDTH bytes, SLICE spans at a time."""
    out = np.empty(len(starts), np.uint32)
    for lo in range(0, len(starts), SLICE):
        s, e = starts[lo : lo + SLICE], ends[lo : lo + SLICE]
        sizes = e - s
        first = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) + np.repeat(s - first, sizes)
        away = np.repeat(e - 1, sizes) - place
        out[lo : lo + SLICE] = np.bitwise_xor.reduceat(FLAT[away * 256 + data[place]], first)
    return out


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of the spans of ``data``, all of one byte or more."""
    sizes = ends - starts
    long = sizes > WIDTH
    out = np.empty(len(starts), np.uint32)
    out[~long] = registers(data, starts[~long], ends[~long]) ^ CONSTANT[sizes[~long]]
    if long.any():
        s, e = starts[long], ends[long]
        blocks = -(-(e - s) // WIDTH)  # all of WIDTH bytes but the first
        first = np.cumsum(blocks) - blocks
        stop = np.repeat(e, blocks) - WIDTH * (np.repeat(first + blocks - 1, blocks) - np.arange(int(blocks.sum())))
        each = registers(data, np.maximum(stop - WIDTH, np.repeat(s, blocks)), stop)
        folded = each[first].copy()
        for j in range(1, int(blocks.max())):
            live = np.flatnonzero(blocks > j)
            r = folded[live]  # WIDTH further bytes: the register's own bytes stand at the far end
            moved = AT[WIDTH - 1, r & 255] ^ AT[WIDTH - 2, (r >> 8) & 255] ^ AT[WIDTH - 3, (r >> 16) & 255] ^ AT[WIDTH - 4, r >> 24]
            folded[live] = moved ^ each[first[live] + j]
        known, which = np.unique(e - s, return_inverse=True)
        out[long] = folded ^ np.array([zlib.crc32(bytes(int(n))) for n in known], np.uint32)[which]
    return out


_CODES = np.arange(256)
_UPPER = (_CODES >= 65) & (_CODES <= 90)
LOWERED = np.where(_UPPER, _CODES + 32, _CODES).astype(np.uint8)
IN_WORD = ((_CODES >= 48) & (_CODES <= 57)) | _UPPER | ((_CODES >= 97) & (_CODES <= 122)) | (_CODES >= 128)


def features(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of each text, and the text and the bucket of every feature."""
    raw = np.frombuffer(b"\0".join(texts), np.uint8)
    word = IN_WORD[raw]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], word, [False]))))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    text = np.searchsorted(begins, starts, side="right") - 1
    n_words = np.bincount(text, minlength=len(texts))
    s = np.cumsum(sizes + 1) - sizes - 1  # words joined by one space each
    e = s + sizes
    joined = np.full(len(sizes) + int(sizes.sum()), 32, np.uint8)
    filled = np.ones(len(joined), bool)
    filled[e] = False
    joined[filled] = LOWERED[raw[word]]
    pair = np.flatnonzero(text[1:] == text[:-1])
    found = checksums(joined, np.concatenate((s, s[pair])), np.concatenate((e, e[pair + 1])))
    return n_words, np.concatenate((text, text[pair])), (found % np.uint32(buckets)).astype(np.int64)


def _bytes(part: pa.RecordBatch) -> list[bytes]:
    return [x.as_py() or b"" for x in part.column("text").cast(pa.binary())]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all ``texts`` fall in each bucket; a task gives a row a bucket."""

    def of(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in pieces(batch):
                total += np.bincount(features(_bytes(part), buckets)[2], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(of, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the source."""
    k, all_s, all_t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_s + k) / ((s + 1.0) * (all_t + k)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of each row."""

    def of(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in pieces(batch):
                n_words, text, bucket = features(_bytes(part), len(gain))
                n = np.bincount(text, minlength=len(part))
                total = np.bincount(text, weights=gain[bucket], minlength=len(part)).astype(np.int64)  # whole numbers far below 2**53
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words), pa.array(n), pa.array(total // np.maximum(n, 1))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, n_words long, n_features long, weight long")


def with_score(rows: DataFrame, seed: int = 7) -> DataFrame:
    """``rows`` with their score: weight and a Gumbel draw."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))))


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with their rank by score, highest first, then doc_id. Equal rows are counted before they are ranged."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    ranged = staged(rows.groupBy(*rows.columns).count().repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")
    parts = ranged.groupBy("part").agg(F.sum("count").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row a partition
    upto = F.sum("count").over(Window.partitionBy("part").orderBy(*order, *(c for c in rows.columns if c not in ("score", "doc_id"))).rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.join(F.broadcast(before), "part").withColumn("last", F.col("before") + upto)
    return placed.select(*rows.columns, F.explode(F.sequence(F.col("last") - F.col("count") + 1, F.col("last"))).alias("rank"))


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = BUCKETS, seed: int = 7) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs``: of those with ``least_words`` words,
    ``percent`` of a hundred (rounded down) are drawn toward ``target`` and have a rank."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    rows = staged(with_score(weighed(docs, gain), seed), "weighed")
    able = rows.where(F.col("n_words") >= least_words)
    most = percent * able.count() // 100
    drawn = F.when(F.col("rank") <= most, F.col("rank"))
    return ranked(able).withColumn("rank", drawn).union(rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def drawn_documents(docs: DataFrame, resampled: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id was drawn."""
    return docs.join(resampled.where("rank IS NOT NULL").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, weight, score and rank of every document against the benchmark's texts."""
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")
