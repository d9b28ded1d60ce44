"""Media payloads stored as content-defined chunks, each distinct chunk once.

A payload is cut where a rolling gear hash of the last 32 bytes has its mask bits zero, between a least and a greatest
chunk length, so an inserted passage moves the cuts near it alone. The stored form of a chunk is one zstandard frame of
its 8-bit samples; the stored form of a payload is its chunks' frames in order, which a zstandard reader opens as one
stream. Frames share a dictionary that is kept beside the store, fitted on a bounded sample of chunks. The store is made
by joins on digests:

1. Each row gives its payload's digest and the ordered list of its chunks' digests (no bytes move).
2. Each chunk digest has one owner: the payload that has it with the least (digest, row key). Each payload is kept by
   one row.
3. The keeping rows are framed, meet the list of chunks that they own and write those frames alone, with the whole chunk
   list.
4. Reading back, a payload that owns all its chunks is complete in its own row; the others fetch frames from their
   owners by a join on digests. Each payload is reassembled in list order, opened and checked against its digest before
   anything is computed from it.

Defined results: a null text is an empty text, whose payload is all padding; equal texts share one stored payload; equal
doc_ids with different texts and null doc_ids each keep their rows; an empty table gives an empty store and no rows. A
row that repeats both doc_id and text may store its frames again (it can't be told apart from its twin); results don't
change.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import maybe, stage_path, staged, table

WINDOW = 32


def gear_table(seed: int = 1) -> np.ndarray:
    """256 pseudo-random 32-bit numbers, made by a rule from the seed."""
    return np.array([int.from_bytes(hashlib.blake2b(bytes([i, seed]), digest_size=4).digest(), "little") for i in range(256)], np.uint32)


def rolling(data: np.ndarray, gears: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of the 32 bytes that end there: sum of gear[b[i - k]] << k, doubling the window."""
    h = gears[data]
    for k in range(5):
        w = 1 << k
        h[w:] += h[:-w] << np.uint32(w)
    return h


def cuts(data: np.ndarray, hashes: np.ndarray, bits: int, least: int, most: int) -> list[int]:
    """The ends of a payload's chunks; ``hashes`` are its rolling hashes, of which the first WINDOW - 1 are never used."""
    where = np.flatnonzero((hashes >> np.uint32(32 - bits)) == 0) + 1
    ends, at, n = [], 0, len(data)
    while n - at > least:
        i = np.searchsorted(where, at + least)
        end = min(int(where[i]) if i < len(where) else n, at + most, n)
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


class Cutter:
    """chunks(payload) gives its (start, end) pairs."""

    def __init__(self, bits: int = 12, least: int = 1024, most: int = 32_768, seed: int = 1):
        if least < WINDOW:
            raise ValueError("the least chunk holds a whole window")
        self.bits, self.least, self.most, self.gears = bits, least, most, gear_table(seed)

    def chunks(self, payload: bytes) -> list[tuple[int, int]]:
        if len(payload) <= self.least:
            return [(0, len(payload))]
        data = np.frombuffer(payload, np.uint8)
        ends = cuts(data, rolling(data, self.gears), self.bits, self.least, self.most)
        return list(zip([0, *ends[:-1]], ends, strict=True))


def padded(text: str | None, unit: int = 576) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (max(1, -(-len(raw) // unit)) * unit - len(raw))


def _digest(data) -> bytes:
    return hashlib.sha256(data).digest()[:20]


RECIPE = "doc_id long, name long, n_bytes long, payload binary, chunks array<binary>"


def _name():
    """A short name of a row's text."""
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("name")


def recipes(docs: DataFrame, cutter: Cutter, unit: int = 576) -> DataFrame:
    """For each row (doc_id, name) its payload's digest and its chunks' digests."""

    def of(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            sizes, payloads, lists = [], [], []
            for x in batch.column("text"):
                n, payload = padded(x.as_py(), unit)
                sizes.append(n), payloads.append(hashlib.sha256(payload).digest())
                lists.append([_digest(payload[a:b]) for a, b in cutter.chunks(payload)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("name"), pa.array(sizes, pa.int64()), pa.array(payloads, pa.binary()), pa.array(lists, pa.list_(pa.binary()))], ["doc_id", "name", "n_bytes", "payload", "chunks"])

    return docs.select("doc_id", _name(), "text").mapInArrow(of, RECIPE)


def train_dictionary(docs: DataFrame, cutter: Cutter, unit: int = 576, size: int = 64_000, sample: int = 800) -> bytes:
    """A dictionary from the first chunks of about ``sample`` documents, those whose key hashes lowest; empty for a few."""
    import zstandard

    buckets = max(1, docs.count() // sample)

    def of(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for x in batch.column("text"):
                _, payload = padded(x.as_py(), unit)
                yield pa.RecordBatch.from_pydict({"chunk": [payload[a:b] for a, b in cutter.chunks(payload)[:4]]}, pa.schema({"chunk": pa.binary()}))

    picked = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(buckets)) == 0).select("text")
    chunks = [bytes(r.chunk) for r in picked.mapInArrow(of, "chunk binary").limit(4 * sample).collect()]
    if len(chunks) < 16:
        return b""
    try:
        return zstandard.train_dictionary(max(1024, min(size, sum(map(len, chunks)) // 8)), chunks).as_bytes()
    except zstandard.ZstdError:  # too uniform to have anything worth keeping
        return b""


STORE = "payload binary, chunks array<binary>, lengths array<int>, own array<int>, lent array<int>, frames array<binary>"


def store(docs: DataFrame, recipe: DataFrame, path: str, cutter: Cutter, trained: bytes = b"", unit: int = 576, level: int = 13) -> str:
    """Writes each distinct payload once: its ordered chunk list, and the frames of the chunks that it owns."""
    keepers = recipe.groupBy("payload").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), "doc_id", "name")).alias("k"), F.min("chunks").alias("chunks")).select("payload", "k.*", "chunks")
    keepers = staged(keepers.withColumn("pid", F.xxhash64("payload")), "keepers")  # pid and key name a kept payload in short
    parts = keepers.select("pid", "key", F.posexplode("chunks").alias("i", "digest"))
    owners = parts.groupBy("digest").agg(F.min(F.struct("pid", "key", "i")).alias("o"), F.count("*").alias("uses"))
    owned = owners.groupBy("o.pid", "o.key").agg(F.sort_array(F.collect_list("o.i")).alias("own"), F.sort_array(F.collect_list(F.when(F.col("uses") > 1, F.col("o.i")))).alias("lent"))
    none = F.array().cast("array<int>")
    wanted = keepers.join(owned, ["pid", "key"], "left").select("payload", "key", F.coalesce("own", none).alias("own"), F.coalesce("lent", none).alias("lent"))

    def framed(batches: Iterator[pa.RecordBatch]):
        import zstandard

        shared = zstandard.ZstdCompressionDict(trained) if trained else None
        if shared:
            shared.precompute_compress(level=level)
        pack = zstandard.ZstdCompressor(level=level, dict_data=shared, write_content_size=True, write_checksum=False)
        for batch in batches:
            digests, keys, lists, lengths, frames = [], [], [], [], []
            for key, x in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                _, payload = padded(x.as_py(), unit)
                spans = cutter.chunks(payload)
                digests.append(hashlib.sha256(payload).digest()), keys.append(-(1 << 63) if key is None else key)
                lists.append([_digest(payload[a:b]) for a, b in spans]), lengths.append([b - a for a, b in spans])
                frames.append([pack.compress(payload[a:b]) for a, b in spans])
            columns = [pa.array(digests, pa.binary()), pa.array(keys, pa.int64()), pa.array(lists, pa.list_(pa.binary())), pa.array(lengths, pa.list_(pa.int32())), pa.array(frames, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["payload", "key", "chunks", "lengths", "frames"])

    # rows that keep no payload are let go before they are framed, but for a few that the bitmap can't tell
    rows = maybe(docs.select("doc_id", _name(), "text"), keepers, "doc_id", "name").select("doc_id", "text").mapInArrow(framed, "payload binary, key long, chunks array<binary>, lengths array<int>, frames array<binary>")
    own = F.transform("own", lambda i: F.get("frames", i))
    kept = rows.join(wanted, ["payload", "key"]).select("payload", "chunks", "lengths", "own", "lent", own.alias("frames"))
    kept.write.option("compression", "none").parquet(path)  # frames are compressed already
    docs.sparkSession.createDataFrame([(trained,)], "bytes binary").coalesce(1).write.parquet(f"{path}.dictionary")
    return path


def feature(payload: np.ndarray) -> str:
    """Mean, spread and 16 histogram shares of the samples, and the mean step between neighbours, in hexadecimal."""
    n = len(payload)
    shares = np.bincount(payload >> 4, minlength=16) * 255 // n
    mean, spread = int(payload.sum(dtype=np.int64)) // n, int(payload.std())
    step = int(np.abs(np.diff(payload.astype(np.int16))).sum()) // n
    return bytes([mean, min(spread, 255), min(step, 255), *shares.tolist()]).hex()


READ = "payload binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def opened(spark: SparkSession, path: str):
    """A task that opens rebuilt payloads of a store, checks and describes them."""
    trained = bytes(spark.read.parquet(f"{path}.dictionary").first().bytes)

    def of(batches: Iterator[pa.RecordBatch]):
        import zstandard

        open_ = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
        for batch in batches:
            out = []
            for digest, frames in zip(batch.column("payload").to_pylist(), batch.column("frames").to_pylist(), strict=True):
                media = b"".join(frames)
                payload = b"".join(map(open_.decompress, frames))
                if hashlib.sha256(payload).digest() != digest:
                    raise ValueError(f"the chunks of payload {digest.hex()} don't give its digest")
                out.append((digest, len(payload), digest.hex(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(np.frombuffer(payload, np.uint8))))
            types = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["payload", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [()] * 7, types, strict=True)], names)

    return of


def rebuilt(spark: SparkSession, path: str) -> DataFrame:
    """(payload, frames): every stored payload with the frames of all its chunks in order."""
    kept = spark.read.schema(STORE).parquet(path)
    whole = kept.where(F.size("own") == F.size("chunks")).select("payload", "frames")
    part = kept.where(F.size("own") < F.size("chunks"))
    lent = kept.where(F.size("lent") > 0).select(F.explode(F.filter(F.arrays_zip("own", "frames"), lambda x: F.array_contains("lent", x["own"]))).alias("f"), "chunks")
    lent = lent.select(F.get("chunks", F.col("f.own")).alias("digest"), F.col("f.frames").alias("frame"))
    asked = part.select("payload", F.posexplode("chunks").alias("i", "digest"), "own").where(~F.array_contains("own", F.col("i"))).drop("own")
    fetched = asked.join(lent, "digest").select("payload", "i", "frame")
    held = part.select("payload", F.explode(F.arrays_zip("own", "frames")).alias("f")).select("payload", F.col("f.own").alias("i"), F.col("f.frames").alias("frame"))
    met = fetched.union(held).groupBy("payload").agg(F.array_sort(F.collect_set(F.struct("i", "frame"))).alias("s")).select("payload", F.transform("s", lambda x: x["frame"]).alias("frames"))
    return whole.union(met)


def op1_chunked_media(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every document's payload stored in chunks, read back, verified and described."""
    docs, cutter = table(spark, sf_dir, "documents").select("doc_id", "text"), Cutter()
    recipe = staged(recipes(docs, cutter), "recipes")
    path = store(docs, recipe, path or stage_path(spark, "chunks"), cutter, train_dictionary(docs, cutter))
    read = staged(rebuilt(spark, path).mapInArrow(opened(spark, path), READ).dropDuplicates(["payload"]), "media")
    found = recipe.select("doc_id", "n_bytes", "payload", F.size("chunks").alias("n_chunks")).join(read, "payload")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks")
