"""SimHash near-duplicates by the generalised pigeonhole principle.

1. A 64-bit fingerprint of each whole text; equal fingerprints become one node.
2. Bits that vary together are grouped into partitions. The co-occurrence counts of all fingerprints' bits are summed
   in Spark; only the 64 x 64 sums reach the driver.
3. Each partition gets its own threshold. If partition i has threshold t_i and the t_i sum to distance - m + 1, any two
   fingerprints within the distance agree to t_i bits or fewer on at least one partition (-1: the partition is not
   used). The allocation with the least estimated candidates and probes is found by dynamic programming for each m; the
   estimates are counts over all fingerprints: the number of equal pairs on each partition, scaled by the neighbours
   within the threshold.
4. Fingerprints are probed under every value within t_i of their partition's value, met with those stored under it, and
   each candidate is verified on all bits.
5. Buckets with more than ``crowd`` fingerprints don't make pairs. Their members meet instead at every fingerprint one
   bit away: two fingerprints within two bits share such a middle, at most 65 different ones meet there, and any two
   that meet are within two bits. The members of a middle are linked in a star, so no group makes all its pairs.
6. Components by repeated minimum labels with shortcuts, over links between different fingerprints alone.

Defined results: a null text is an empty text; a text without words has fingerprint zero and is linked like any other;
null doc_ids get fingerprints and links, and never are a component's name unless no other id is there (then null);
repeated rows stay, each with the same component; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

BITS = 64


def _votes(hashes: np.ndarray) -> int:
    """The 64-bit majority of unsigned hashes."""
    n, counts = len(hashes), np.zeros(BITS, np.int64)
    for at in range(0, n, 65_536):
        bits = np.unpackbits(hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The fingerprint of a whole text, unsigned."""
    import xxhash

    hash_ = xxhash.xxh64_intdigest
    found = (text or "").encode().lower().split()  # bytes: A-Z alone are lowered, and ASCII white space alone splits
    if not found:
        return 0
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    return _votes(np.fromiter((hash_(x, seed) for x in shingles), np.uint64))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and the fingerprint as a signed long (fp)."""

    def of(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), words) for x in batch.column("text")], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, fp long")


def bit_sums(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and for each pair of bits how many have both."""

    def of(batches: Iterator[pa.RecordBatch]):
        n, sums = 0, np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            whole = np.ascontiguousarray(batch.column("fp").to_numpy(zero_copy_only=False).astype("<i8"))
            bits = np.unpackbits(whole.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            sums += (bits.T @ bits).astype(np.int64)
            n += len(whole)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sums.ravel().tolist()], pa.list_(pa.int64()))], ["n", "sums"])

    parts = nodes.select("fp").mapInArrow(of, "n long, sums array<long>")
    total = parts.select("n", F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    sums = np.zeros(BITS * BITS, np.int64)
    for row in total:
        sums[row["at"]] = row["s"]
    return (total[0]["n"] if total else 0), sums.reshape(BITS, BITS)


def group_bits(n: int, sums: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of about equal width: each is grown from the bit with the most correlation left, by the bit most
    correlated with those it has."""
    p = np.diag(sums) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((sums / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, parts = set(range(BITS)), []
    for k in range(m):
        size = len(left) // (m - k)
        rest = sorted(left)
        part = [max(rest, key=lambda b: (corr[b, rest].sum(), -b))]
        while len(part) < size:
            rest = sorted(left - set(part))
            part.append(max(rest, key=lambda b: (corr[b, part].sum(), -b)))
        left -= set(part)
        parts.append(sorted(part))
    return parts


def key_of(bits: list[int], fp: str = "fp"):
    """The values of some bits of a fingerprint, in place."""
    mask = sum(1 << b for b in bits)
    return F.col(fp).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def _around(width: int, t: int) -> int:
    """How many values are within t bits of one of ``width`` bits."""
    out, term = 0, 1
    for d in range(t + 1):
        out += term
        term = term * (width - d) // (d + 1)
    return out


def equal_pairs(nodes: DataFrame, parts: list[list[int]]) -> list[float]:
    """For each partition the number of ordered pairs of fingerprints that agree on it, over all fingerprints."""
    each = [nodes.groupBy(key_of(bits).alias("key")).count().agg(F.sum(F.col("count").cast("double") * F.col("count"))).select(F.lit(i).alias("i"), F.col("sum((CAST(count AS DOUBLE) * count))").alias("pairs")) for i, bits in enumerate(parts)]
    whole = each[0]
    for x in each[1:]:
        whole = whole.unionByName(x)
    found = {r["i"]: r["pairs"] or 0.0 for r in whole.collect()}
    return [found[i] for i in range(len(parts))]


def allocate(n: int, parts: list[list[int]], pairs: list[float], distance: int, probe_cost: float = 2.0) -> tuple[float, list[int]]:
    """Thresholds that sum to distance - m + 1 with the least cost, by dynamic programming over the partitions.

    A partition of threshold t costs its probes (n times the values within t) and its candidates (the equal pairs times
    the values within t); a threshold of -1 costs nothing.
    """
    m, best = len(parts), {0: (0.0, [])}
    for bits, same in zip(parts, pairs, strict=True):
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, distance + 1):
                more = 0.0 if t < 0 else _around(len(bits), t) * (probe_cost * n + same)
                if used + t not in step or cost + more < step[used + t][0]:
                    step[used + t] = (cost + more, [*chosen, t])
        best = step
    return best[distance - m + 1]


def plan(nodes: DataFrame, distance: int, sizes: tuple[int, ...] = (2, 3, 4)) -> tuple[list[list[int]], list[int]]:
    """The partitions and thresholds of the number of partitions that costs least."""
    n, sums = bit_sums(nodes)
    options = []
    for m in sizes:
        parts = group_bits(n, sums, m)
        options.append((*allocate(n, parts, equal_pairs(nodes, parts), distance), parts))
    _, thresholds, parts = min(options, key=lambda x: (x[0], len(x[2])))
    return parts, thresholds


def links(nodes: DataFrame, distance: int = 2, crowd: int = 50, sizes: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """Links (a, b) with which the fingerprints of ``nodes`` (fp, distinct) have the components of all pairs within
    ``distance`` (at most 2, for which crowded buckets have an exact way)."""
    if not 0 <= distance <= 2:
        raise ValueError("crowded buckets are handled for distances of 0 to 2")
    parts, thresholds = plan(nodes, distance, sizes)
    probes, stored = [], []
    for i, (bits, t) in enumerate(zip(parts, thresholds, strict=True)):
        if t < 0:
            continue
        flips = [sum(1 << b for b in chosen) for d in range(t + 1) for chosen in combinations(bits, d)]
        flips = [x - (1 << 64) if x >> 63 else x for x in flips]
        one = nodes.select("fp", F.lit(i).alias("part"), key_of(bits).alias("key"))
        stored.append(one)
        probes.append(one if flips == [0] else one.select("fp", "part", F.explode(F.array(*(F.col("key").bitwiseXOR(F.lit(x).cast("long")) for x in flips))).alias("key")))
    index, asked = _union(stored), _union(probes)
    # a bucket's probes and entries; both sides are bounded by ``crowd`` where pairs are made
    entries = index.groupBy("part", "key").agg(F.count("*").alias("n"))
    visits = asked.groupBy("part", "key").agg(F.count("*").alias("n"))
    busy = entries.join(visits.withColumnRenamed("n", "v"), ["part", "key"]).where((F.col("n") > 1) | (F.col("v") > 1))
    sized = staged(busy.select("part", "key", (F.greatest("n", "v") > crowd).alias("crowded")), "buckets")
    calm, crowded = sized.where(~F.col("crowded")).select("part", "key"), sized.where("crowded").select("part", "key")
    left = asked.join(calm, ["part", "key"]).withColumnRenamed("fp", "a")
    right = index.join(calm, ["part", "key"]).withColumnRenamed("fp", "b")
    near = F.expr("bit_count(a ^ b)") <= distance
    found = left.join(right, ["part", "key"]).where((F.col("a") != F.col("b")) & near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    members = asked.join(crowded, ["part", "key"]).select("fp").union(index.join(crowded, ["part", "key"]).select("fp")).distinct()
    return found.union(_at_middles(members, distance)).distinct()


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.union(x)
    return out


def _at_middles(members: DataFrame, distance: int) -> DataFrame:
    """Stars over the fingerprints that meet one bit away (distance 2), or links of one bit (distance 1)."""
    if distance == 0:
        return members.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    flips = [0, *(1 << b if b < 63 else -(1 << 63) for b in range(BITS))]
    spots = members.select("fp", F.explode(F.array(*(F.col("fp").bitwiseXOR(F.lit(x).cast("long")) for x in flips))).alias("spot"))
    if distance == 1:
        hit = spots.where("fp != spot").join(members.select(F.col("fp").alias("spot")), "spot")
        return hit.select(F.least("fp", "spot").alias("a"), F.greatest("fp", "spot").alias("b"))
    stars = spots.groupBy("spot").agg(F.collect_set("fp").alias("met")).where(F.size("met") > 1)  # 65 at most
    return stars.select(F.array_min("met").alias("a"), F.explode("met").alias("b")).where("a != b")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node that links reach, for every node of ``edges`` (a, b).

    Each round links every node's larger neighbours to its smallest one, then every node's smaller neighbours to the
    smallest; stars are what stays. The links are written in the shared folder after each round, and a round that leaves
    their number and the digest of the set as they were was the last.
    """
    pairs = staged(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = _digest(pairs)
    for _ in range(rounds):
        both = pairs.union(pairs.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))  # no more rows than pairs
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        hung = large.join(low, "u")
        small = hung.where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v")).union(low.select("u", F.col("low").alias("v"))).distinct()
        pairs = staged(small, "links")
        after = _digest(pairs)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).union(pairs.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _digest(pairs: DataFrame):
    """The number of distinct rows (u, v) and two 64-bit digests of the set."""
    return pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", F.lit(1), "u"))).first()


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2, crowd: int = 50) -> DataFrame:
    """doc_id, fp (signed long) and component_id of every row of ``docs``."""
    marked = staged(fingerprints(docs, words), "fingerprints")
    nodes = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    label = components(links(nodes.select("fp"), distance, crowd))
    named = nodes.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    firsts = named.groupBy("label").agg(F.min("first").alias("component_id"))
    node_of = staged(named.join(firsts, "label").select("fp", "component_id"), "components")
    return marked.join(node_of, "fp").select("doc_id", "fp", "component_id")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document at 2 or fewer differing bits."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
