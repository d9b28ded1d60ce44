"""Token-id files: id arrays compressed one document at a time with a shared zstandard dictionary.

A table of blocks is the file format. Each block holds the frames of some documents in ascending doc_id order, one
after the other, and an index of their ids, offsets and token counts, so that one document is read by its block's
min/max doc_id, one offset and the dictionary whose hash the block names. Ids are stored as little-endian unsigned
16-bit integers (32-bit ones for vocabularies beyond 65,536 ids).

Defined results: a null text is an empty text and gives the end id alone; equal or null doc_ids keep their own rows
(nulls first, ties by the text's checksum); an empty table gives an empty file and no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage_path, table
from .tokenize import encoder, slices

BLOCKS = (
    "part int, block int, part_start long, first_id long, last_id long, n_docs int, n_tokens long, dictionary string, width int, "
    "doc_ids array<long>, offsets array<long>, counts array<int>, frames binary"
)


def train_dictionary(docs: DataFrame, encode, size: int = 64_000, sample: int = 600, width: int = 2) -> bytes:
    """A dictionary from about ``sample`` documents, those whose key hashes lowest: a fitted index on a bounded sample.
    Every document is written whatever the sample; with fewer than 16 non-empty documents it stays empty."""
    import zstandard

    n = docs.count()
    buckets = max(1, n // sample)
    picked = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(buckets)) == 0)
    arrays = picked.mapInArrow(lambda batches: _sampled(batches, encode, width), "ids binary").limit(2 * sample).collect()
    samples = [bytes(x.ids) for x in arrays if len(x.ids) >= 16]
    if len(samples) < 16:
        return b""
    size = max(1024, min(size, sum(map(len, samples)) // 8))
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too uniform to have anything worth keeping
        return b""


def _sampled(batches: Iterator[pa.RecordBatch], encode, width: int):
    for batch in batches:
        texts = [x or "" for x in batch.column("text").to_pylist()]
        for a, b in slices(texts):
            yield pa.RecordBatch.from_pydict({"ids": [np.frombuffer(x, "<u4")[:50_000].astype(f"<u{width}").tobytes() for x in encode(texts[a:b])]}, pa.schema({"ids": pa.binary()}))


def write_ids(docs: DataFrame, path: str, encode, dictionary: bytes, end_id: int, width: int = 2, level: int = 1, block_docs: int = 512, block_bytes: int = 4_000_000) -> str:
    """Encodes all documents and writes the table of blocks to ``path`` in ascending doc_id order.

    encode: a picklable function from a list of texts to their ids as little-endian unsigned 32-bit bytes.
    Texts are put in order before they are encoded: the frames have some 0.8 of their bytes, and would have to be staged
    first, as the range exchange samples its input in a job of its own.
    """
    spark = docs.sparkSession
    name = hashlib.sha256(dictionary).hexdigest()
    shared = spark.sparkContext.broadcast(dictionary)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = (
        docs.select("doc_id", "text", F.crc32(F.coalesce("text", F.lit(""))).alias("tie"))
        .repartitionByRange(parts, "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )

    def blocks(batches):
        import zstandard
        from pyspark import TaskContext

        end, kind, part = np.array([end_id], "<u4").tobytes(), f"<u{width}", TaskContext.get().partitionId()
        trained = zstandard.ZstdCompressionDict(shared.value) if shared.value else None
        pack = zstandard.ZstdCompressor(level=level, dict_data=trained, write_content_size=True, write_checksum=False)
        ids, offsets, counts, frames, at, number, done = [], [], [], [], 0, 0, 0

        def block():
            row = {
                "part": [part], "block": [number], "part_start": [done], "first_id": [ids[0]], "last_id": [ids[-1]], "n_docs": [len(ids)], "n_tokens": [sum(counts)], "dictionary": [name], "width": [width],
                "doc_ids": [ids], "offsets": [offsets], "counts": [counts], "frames": [b"".join(frames)],
            }
            return pa.RecordBatch.from_pydict(row, _ARROW)

        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), [x or "" for x in batch.column("text").to_pylist()]
            for a, b in slices(texts):
                for key, got in zip(keys[a:b], encode(texts[a:b]), strict=True):
                    whole = np.frombuffer(got + end, "<u4")
                    frame = pack.compress(whole.astype(kind).tobytes())
                    ids.append(key), offsets.append(at), counts.append(len(whole)), frames.append(frame)
                    at += len(frame)
                    if len(ids) >= block_docs or at >= block_bytes:
                        yield block()
                        done += sum(counts)
                        ids, offsets, counts, frames, at, number = [], [], [], [], 0, number + 1
        if ids:
            yield block()

    ordered.mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(path)
    head = spark.createDataFrame([(name, dictionary, end_id)], "hash string, bytes binary, end_id int")
    head.coalesce(1).write.parquet(f"{path}.dictionary")
    return path


_ARROW = pa.schema(
    [("part", pa.int32()), ("block", pa.int32()), ("part_start", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("dictionary", pa.string()), ("width", pa.int32()),
     ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("frames", pa.binary())]
)


def dictionary_of(spark: SparkSession, path: str) -> tuple[str, bytes]:
    """The file's one dictionary; its size is bounded by train_dictionary's ``size``."""
    row = spark.read.parquet(f"{path}.dictionary").first()
    return row.hash, bytes(row.bytes)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a file: doc_id, start (ids of all documents before it), n_tokens, ids (array<int>)."""
    return _decoded(spark, path, "doc_id long, start long, n_tokens long, ids array<int>", lambda ids: {"ids": [ids.astype("<i4")]})


def read_document(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """The ids of one document: its block is found by min/max doc_id, and only its own frame is decompressed."""
    near = spark.read.parquet(path).where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    one = near.select("dictionary", "width", F.explode(F.arrays_zip("doc_ids", "offsets", "counts", F.expr("slice(offsets, 2, greatest(n_docs - 1, 0))").alias("ends"))).alias("at"), "frames").where(F.col("at.doc_ids") == doc_id)
    one = one.select("dictionary", "width", F.col("at.doc_ids").alias("doc_id"), F.expr("substring(frames, cast(at.offsets + 1 as int), cast(coalesce(at.ends, octet_length(frames)) - at.offsets as int))").alias("frame"))
    name, trained = dictionary_of(spark, path)

    def decode(batches):
        for batch in batches:
            ids = []
            for hashed, width, frame in zip(*(batch.column(x).to_pylist() for x in ("dictionary", "width", "frame")), strict=True):
                if hashed != name:
                    raise ValueError(f"the file names dictionary {hashed}; {name} is given")
                ids.append(np.frombuffer(_opener(trained).decompress(frame), f"<u{width}").astype("<i4"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return one.mapInArrow(decode, "doc_id long, ids array<int>")


def _opener(trained: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """As read_ids, with the CRC-32 of the ids (little-endian unsigned 32-bit) in place of the ids."""
    return _decoded(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long, frame_bytes long", lambda ids: {"ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}, sized=True)


def _decoded(spark: SparkSession, path: str, schema: str, of, sized: bool = False) -> DataFrame:
    """Decodes every block in its own place. A block knows the tokens before it in its part; those of the parts before
    are a running sum over one row for each of the writer's tasks, so that this side of the join stays small."""
    name, trained = dictionary_of(spark, path)
    shared = spark.sparkContext.broadcast((name, trained))
    blocks = spark.read.schema(BLOCKS).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))

    def decode(batches):
        hashed, trained = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary"] != hashed:
                    raise ValueError(f"the file names dictionary {row['dictionary']}; {hashed} is given")
                opened, ends, out = _opener(trained), [*row["offsets"][1:], len(row["frames"])], {}
                for a, b in zip(row["offsets"], ends, strict=True):
                    ids = np.frombuffer(opened.decompress(row["frames"][a:b]), f"<u{row['width']}")
                    for k, v in of(ids).items():
                        out.setdefault(k, []).extend(v if isinstance(v, list) else [v])
                    out.setdefault("n_tokens", []).append(len(ids))
                counts = np.array(out["n_tokens"], np.int64)
                if counts.tolist() != row["counts"]:
                    raise ValueError("a frame does not have the number of ids that the index states")
                begins = row["start"] + np.cumsum(counts) - counts
                columns = {"doc_id": row["doc_ids"], "start": begins.tolist()} | out | ({"frame_bytes": [b - a for a, b in zip(row["offsets"], ends, strict=True)]} if sized else {})
                yield pa.RecordBatch.from_pydict({k: columns[k] for k in want.names}, want)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    want = to_arrow_schema(_parse_datatype_string(schema))
    read = blocks.join(F.broadcast(before), "part").select((F.col("before") + F.col("part_start")).alias("start"), "dictionary", "width", "doc_ids", "offsets", "counts", "frames")
    return read.mapInArrow(decode, schema)


def op4_binary_ids(spark: SparkSession, sf_dir: str, vocabulary: str | None = None, path: str | None = None) -> DataFrame:
    """Ids of every whole document with the byte-level vocabulary and end id 2, written to token files and read back."""
    import public_tokenizers

    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encode = _ByteLevel(vocabulary)
    path = path or stage_path(spark, "ids")
    width = 2 if len(json.load(open(vocabulary))["model"]["vocab"]) <= 65_536 else 4
    write_ids(docs, path, encode, train_dictionary(docs, encode, width=width), end_id=2, width=width)
    return read_checksums(spark, path)


class _ByteLevel:
    def __init__(self, vocabulary: str):
        self.vocabulary = vocabulary

    def __call__(self, texts: list[str]) -> list[bytes]:
        return encoder(self.vocabulary, spaced=True).ids(texts)
