"""Bounded-space online best-fit packing of token sequences.

A packer holds a fixed number of open bins. A bitset has a bit for each free space that some open bin has, so the
tightest bin that takes a piece is the lowest set bit at or above the piece's length. When no bin takes the piece and
all are open, the fullest one closes for good. Only lengths move between tasks: pieces are dealt to packers by a hash of
their key, about ``per_packer`` to each (some 4,000 sequences, so that bins do close), so the number of packers grows with the input and
each one's rows stay bounded.

Defined results: a null or empty text gives its end id alone; a document longer than a sequence is cut into full pieces
and a last one; equal doc_ids and repeated rows each keep their pieces; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, table
from .tokenize import encoder, slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PACKED = f"{PIECES}, sequence_id long, offset long"


def pieces_of(docs: DataFrame, encode, end_id: int, longest: int) -> DataFrame:
    """One row for each piece of at most ``longest`` ids; encode as in binary_ids.write_ids."""

    def cut(batches: Iterator[pa.RecordBatch]):
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), [x or "" for x in batch.column("text").to_pylist()]
            for a, b in slices(texts):
                rows = []
                for key, got in zip(keys[a:b], encode(texts[a:b]), strict=True):
                    whole = got + end
                    for i, at in enumerate(range(0, len(whole), 4 * longest)):
                        part = whole[at : at + 4 * longest]
                        rows.append((key, i, at // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


class BestFit:
    """The open bins of one packer."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most = capacity, open_bins
        self.free = 0  # bit s: some open bin has s free places
        self.bins: dict[int, list[int]] = {}  # free places: bins
        self.count = self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of 1 to ``capacity`` ids."""
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(space)
        else:
            if self.count >= self.most:  # the fullest closes: the lowest set bit of all
                self._take((self.free & -self.free).bit_length() - 1)
                self.count -= 1
            bin_, space = self.made, self.capacity
            self.made += 1
            self.count += 1
        left = space - length
        if left:
            self.bins.setdefault(left, []).append(bin_)
            self.free |= 1 << left
        else:
            self.count -= 1
        return bin_, self.capacity - space

    def _take(self, space: int) -> int:
        held = self.bins[space]
        bin_ = held.pop()
        if not held:
            self.free &= ~(1 << space)
        return bin_


def pack(pieces: DataFrame, capacity: int = 4096, open_bins: int = 1024, per_packer: int = 20_000) -> DataFrame:
    """Adds sequence_id and offset. Full pieces are sequences of their own and meet no packer.

    pieces: rows with a positive ``length`` of at most ``capacity``; other columns are carried along. The order in which
    a packer sees its pieces is that of a hash, so a retried task packs alike.
    """
    spark = pieces.sparkSession
    n = pieces.where(F.col("length") < capacity).count()
    packers = max(1, -(-n // per_packer))
    keys = [c for c in pieces.columns if c in ("doc_id", "piece", "start", "length", "ids_crc32")]
    keyed = pieces.withColumn("packer", F.when(F.col("length") == capacity, F.lit(None).cast("long")).otherwise(F.pmod(F.xxhash64(*keys), F.lit(packers))))
    spread = max(1, min(packers, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    order = F.xxhash64(F.lit(1), *keys)
    full = keyed.where(F.col("packer").isNull()).drop("packer")
    # a full piece's number: its own key's hash, below zero, apart from the packers' numbers; ties stay apart by a counter of the task
    full = full.select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    dealt = keyed.where(F.col("packer").isNotNull()).withColumn("order", order).repartition(spread, "packer").sortWithinPartitions("packer", "order", *keys).drop("order")
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def fill(batches: Iterator[pa.RecordBatch]):
        now, bins = None, None
        for batch in batches:
            numbers, places = [], []
            for packer, length in zip(batch.column("packer").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if packer != now:
                    now, bins = packer, BestFit(capacity, open_bins)
                bin_, place = bins.place(length)
                numbers.append(bin_ * packers + packer)
                places.append(place)
            kept = [x for x in batch.schema.names if x != "packer"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), pa.array(numbers, pa.int64()), pa.array(places, pa.int64())], [*kept, "sequence_id", "offset"])

    return dealt.mapInArrow(fill, schema).unionByName(full)


class WordLevel:
    """encode() for the lower-casing word vocabulary."""

    def __init__(self, vocabulary: str):
        self.vocabulary = vocabulary

    def __call__(self, texts: list[str]) -> list[bytes]:
        return encoder(self.vocabulary, spaced=False).ids(texts)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = 4096, open_bins: int = 1024, per_packer: int = 20_000) -> DataFrame:
    """Tokenizes whole documents, stages the pieces (lengths and checksums, no text) and packs them."""
    pieces = staged(pieces_of(docs, WordLevel(vocabulary), end_id, capacity), "pieces")
    return pack(pieces, capacity, open_bins, per_packer)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """All documents in sequences of at most 4096 ids of the word-level vocabulary, end id 1."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return pack_documents(docs, vocabulary or public_tokenizers.path("word_bpe_49k.json"))
