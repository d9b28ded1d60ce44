"""Near-duplicates by SimHash with the generalised pigeonhole, verified and completed to exact Jaccard similarity.

1. Each text has a fingerprint of its word shingles. Operator 5's search (correlated bits in partitions, thresholds by dynamic
   programming, probe and verify on all bits) finds the fingerprints within two bits of each other; what it links is verified by
   the exact Jaccard similarity of the shingle sets.
2. No distance of fingerprints holds for every pair of similarity 0.8 (at 64 bits such pairs differ in 10 bits on average and in
   up to 20), and a distance that held would make buckets that grow with the corpus. So the pairs that step 1 leaves in different
   components are found by a prefix join. All shingles have one order; two sets of similarity t or more share a shingle among
   the first |x| - ceil(t |x|) + 1 of each, so texts that share none of these are never compared, and no pair is missed
   whatever the number of texts. Any order does; frequent shingles, which would make large buckets, come last in it. A pair
   that shares a shingle must pass three bounds that hold for every pair of similarity t: the sizes, the places of the shared
   shingle in both orders, and the parities (every shingle flips one of 1024 bits, so the bits of two sets differ in no more
   places than the sets do). What is left is verified on the sets themselves. Shingles and sets are named by 64-bit hash.

Buckets of more than ``crowd`` members are first compared with a few of their members; only members that are in different
components after that make pairs. So as far as connectivity needs all links are found, and the components are those of all
pairs.

Defined results: a null text is an empty text, and texts without words are copies of each other; rows with a null doc_id
take no part and stay; rows alike in doc_id and text are one document; of rows alike in doc_id alone each is judged by its
own text; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe, staged, unused
from .simhash import _votes, components, links
from .tokenize import release

BITS = 1024
QUARTER = 1 << 62  # hashes below are counted in all texts
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The hashes of a text's shingles in order, repeats included; a text of fewer words is one shingle."""
    import xxhash

    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), 1)], np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    n = len(each) - words + 1
    mixed = np.zeros(n, np.uint64)
    for i in range(words):  # a chain, so that the order of words counts
        mixed = (mixed ^ each[i : i + n]) * _MIX[0]
        mixed ^= mixed >> np.uint64(29)
        mixed *= _MIX[1]
        mixed ^= mixed >> np.uint64(32)
    return mixed


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct shingles' hashes in ascending order."""
    return np.unique(shingles(text, words))


def parities(shingles: np.ndarray) -> bytes:
    return np.packbits(np.bincount((shingles * _MIX[2] >> np.uint64(54)).astype(np.int64), minlength=BITS).astype(np.uint8) & 1).tobytes()


def _needed(similarity: float, total):
    """The shared shingles that sets of ``total`` shingles together need (a lower bound safe to rounding)."""
    return np.ceil(similarity / (1 + similarity) * total - 1e-6)


def prefix(shingles: np.ndarray, similarity: float, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles in the common order, as many as similarity needs: ascending hashes, then ``common`` by ``rank``."""
    n = len(shingles)
    if not n:
        return shingles
    take = n - int(np.ceil(similarity * n - 1e-6)) + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        frequent = common[at] == shingles
        if frequent.any():
            last = np.flatnonzero(frequent)
            shingles = np.concatenate([shingles[~frequent], shingles[last[np.argsort(rank[at[last]], kind="stable")]]])
    return shingles[:take]


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    if not len(x) and not len(y):
        return 1.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


SUMMARY = "doc_id long, own long, name long, size int, bits binary, fp long"


def summaries(docs: DataFrame, words: int = 5) -> DataFrame:
    """For each row (doc_id, own, text): the name of its shingle set, its size, parities and fingerprint (fp)."""

    def of(batches: Iterator[pa.RecordBatch]):
        import xxhash

        release()
        for batch in batches:
            lists = [shingles(x.as_py(), words) for x in batch.column("text")]
            sets = [np.unique(x) for x in lists]
            names = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            prints = np.array([_votes(x) if len(x) else 0 for x in lists], np.uint64).view(np.int64)
            columns = [pa.array(names), pa.array([len(x) for x in sets], pa.int32()), pa.array([parities(x) for x in sets], pa.binary()), pa.array(prints)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("own"), *columns], ["doc_id", "own", "name", "size", "bits", "fp"])

    return docs.select("doc_id", "own", "text").mapInArrow(of, SUMMARY)


def frequent_shingles(texts: DataFrame, words: int, crowd: int, most: int = 1_000_000) -> tuple[tuple[np.ndarray, np.ndarray], DataFrame]:
    """Shingles of more than ``crowd`` texts, of the quarter of least hashes, with their ranks; the most frequent come last.
    Also (shingle, n) of all in that quarter that several texts hold.

    Prefixes are mostly from that quarter. What is left out costs pairs, never links: any common order is right.
    """

    def of(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if len(batch):
                sets = [shingle_set(x.as_py(), words) for x in batch.column("text")]
                values, counts = np.unique(np.concatenate([x[: np.searchsorted(x, np.uint64(QUARTER))] for x in sets]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], ["shingle", "n"])

    counted = texts.select("text").mapInArrow(of, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    repeated = staged(counted.where("n > 1"), "repeated")
    found = repeated.where(F.col("n") > crowd)
    sizes = sorted(found.groupBy(F.floor(F.log2("n")).cast("int").alias("size")).count().collect(), reverse=True)
    least, room = crowd + 1, most
    for size, n in sizes:  # the driver and each worker hold ``most`` at most
        room -= n
        if room < 0:
            least = 2 ** (size + 1)
            break
    rows = found.where(F.col("n") >= least).toArrow()
    values = rows.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(values)
    return (values[order], rows.column("n").to_numpy()[order]), repeated


def without(rows: DataFrame, gone: DataFrame, *key: str) -> DataFrame:
    """The rows whose key isn't in ``gone``. Keys alone tell which rows that the bitmap can't clear stay; only rows that may be
    one of these are moved to an anti-join."""
    unclear = maybe(rows, gone, *key)
    stay = unclear.select(*key).join(gone, list(key), "left_anti")
    return maybe(rows, gone, *key, others=True).union(maybe(unclear, stay, *key).join(gone, list(key), "left_anti").select(*rows.columns))


def near_links(texts: DataFrame, sizes: DataFrame, common: tuple[np.ndarray, np.ndarray], similarity: float = 0.8, words: int = 5, crowd: int = 24, block: int = 1000, hubs: int = 4, suspected: DataFrame | None = None, stored_texts: DataFrame | None = None, repeated: DataFrame | None = None) -> DataFrame:
    """Stars (a, b): each text (node long, text) that has links at ``similarity`` or more, and the least node they reach.

    ``sizes`` has node, size and bits of each. Pairs of ``suspected`` (a, b) are verified first, and pairs of one component
    are not asked again. ``stored_texts`` (node, text) may hold more nodes than ``texts`` and be cheaper to read again;
    ``repeated`` (shingle, n) has the shingles below QUARTER that several texts hold, so that buckets of these aren't counted.
    """
    asked_of = texts if stored_texts is None else stored_texts
    ordered = texts.sparkSession.sparkContext.broadcast(common)
    ratio = similarity / (1 + similarity)

    def probe(batches: Iterator[pa.RecordBatch]):
        values, rank = ordered.value
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                sets = [shingle_set(x.as_py(), words) for x in part.column("text")]
                first = [prefix(x, similarity, values, rank) for x in sets]
                many = [len(x) for x in first]
                columns = [np.concatenate(first).view(np.int64), np.repeat(part.column("node").to_numpy(), many), np.repeat(np.array([len(x) for x in sets], np.int32), many), np.concatenate([np.arange(x, dtype=np.int32) for x in many])]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["bucket", "node", "size", "place"])

    stored = staged(texts.mapInArrow(probe, "bucket long, node long, size int, place int"), "probes")
    others = stored if repeated is None else stored.where((F.col("bucket") < 0) | (F.col("bucket") >= QUARTER))
    counts = others.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    if repeated is not None:  # a text holds a shingle of its prefix, so n is the bucket's size or more
        counts = counts.union(repeated.select("shingle", "n"))
    met = staged(stored.join(counts, "bucket"), "met")

    def bounds():
        """Sizes and places that a pair of ``similarity`` or more can have where it shares its first shingle."""
        need = F.ceil(F.lit(ratio) * (F.col("sa") + F.col("sb")) - 1e-6)
        return F.expr("least(sa - pa, sb - pb)") >= need

    def side(rows: DataFrame, x: str, *also: str) -> DataFrame:
        return rows.select("bucket", F.col("node").alias(x), F.col("size").alias(f"s{x}"), F.col("place").alias(f"p{x}"), *also)

    def possible_of(pairs: DataFrame, label: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) between different components that pass the parities."""
        known = sizes.join(label, "node", "left").select("node", "size", "bits", F.coalesce("label", "node").alias("label"))
        of = lambda x: known.select(F.col("node").alias(x), F.col("size").alias(f"s{x}"), F.col("bits").alias(f"w{x}"), F.col("label").alias(f"l{x}"))

        def possible(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                if len(batch):
                    x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, BITS // 64) for c in ("wa", "wb"))
                    total = batch.column("sa").to_numpy().astype(np.int64) + batch.column("sb").to_numpy()
                    near = pa.array(np.bitwise_count(x ^ y).sum(axis=1) <= total - 2 * _needed(similarity, total))
                    yield pa.RecordBatch.from_arrays([batch.column(c).filter(near) for c in ("a", "b")], ["a", "b"])

        return staged(pairs, "pairs").hint("merge").join(of("a"), "a").hint("merge").join(of("b"), "b").where("la != lb").select("a", "b", "sa", "sb", "wa", "wb").mapInArrow(possible, "a long, b long")

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) whose sets have the similarity."""
        left = staged(pairs.distinct(), "possible")
        asked = left.select(F.col("a").alias("node")).union(left.select(F.col("b").alias("node"))).distinct()
        # one plan at every size: neither pairs nor texts are bounded, so neither is broadcast
        wanted = maybe(asked_of, asked, "node").join(asked.hint("merge"), "node", "left_semi")

        def exact(batches: Iterator[pa.RecordBatch]):
            held: tuple = (None, None)
            for batch in batches:
                near = np.zeros(len(batch), bool)
                for i, (a, x, y) in enumerate(zip(*(batch.column(c) for c in ("a", "ta", "tb")), strict=True)):
                    of_a = (a.as_py(), x.as_py())
                    if held[0] != of_a:
                        held = (of_a, shingle_set(of_a[1], words))
                    near[i] = jaccard(held[1], shingle_set(y.as_py(), words)) >= similarity - 1e-12
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(near)) for c in ("a", "b")], ["a", "b"])

        sets = left.hint("merge").join(wanted.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").hint("merge").join(wanted.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
        return staged(sets.select("a", "b", "ta", "tb").mapInArrow(exact, "a long, b long"), "verified")

    calm, busy = met.where(F.col("n") <= crowd), met.where(F.col("n") > crowd)
    pairs = side(calm, "a").join(side(calm, "b"), "bucket").where((F.col("a") < F.col("b")) & bounds()).select("a", "b").distinct()
    label = components(verified(suspected) if suspected is not None else pairs.where("false"))

    def joined(more: DataFrame) -> DataFrame:
        """The components of ``label`` with links ``more``: its stars stand for the links known before."""
        return label if more.isEmpty() else components(stars(label).union(more))

    label = joined(verified(possible_of(pairs, label)))
    if busy.isEmpty():
        return stars(label)
    least = busy.groupBy("bucket").agg(*(F.min(F.struct(F.xxhash64("node", F.lit(i)), "node", "size", "place")).alias(f"h{i}") for i in range(hubs)))
    heads = least.select("bucket", F.explode(F.array(*(F.struct(F.col(f"h{i}.node").alias("a"), F.col(f"h{i}.size").alias("sa"), F.col(f"h{i}.place").alias("pa")) for i in range(hubs)))).alias("h")).select("bucket", "h.*").distinct()
    pairs = heads.join(side(busy, "b"), "bucket").where((F.col("a") != F.col("b")) & bounds()).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    label = joined(verified(possible_of(pairs, label)))
    blocks = F.ceil(F.col("n") / block).cast("int")

    def apart(closest: bool) -> DataFrame:
        """Verified links between members of a crowded bucket that ``label`` leaves in different components: of each two
        components in a block of pairs the closest pair, each member in its least bucket alone; or all pairs."""
        named = staged(busy.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")), "named")
        divided = named.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("bucket")
        here = named.join(divided, "bucket")
        if closest:  # members of one group share many buckets; one is enough to find what they have in common
            here = here.groupBy("node").agg(F.min(F.struct("bucket", "n", "label", "size", "place")).alias("h")).select("node", "h.*")
        dealt = here.withColumns({"mine": F.pmod(F.xxhash64("node"), blocks).cast("int"), "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
        dealt = dealt.select("bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "label", "size", "place").join(sizes.select("node", "size", "bits"), ["node", "size"])
        pairs = dealt.groupBy("bucket", "i", "j").applyInArrow(lambda rows: dense(rows, closest), "a long, b long")
        return verified(pairs)

    def dense(rows: pa.Table, closest: bool) -> pa.Table:
        mine, i, j, node, label, size, rest = (rows.column(c).to_numpy() for c in ("mine", "i", "j", "node", "label", "size", "place"))
        size, bits = size.astype(np.int64), np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint64).reshape(-1, BITS // 64)
        rest, right, out = size - rest, np.flatnonzero(mine == j[0]), [np.zeros((2, 0), np.int64)]
        left = np.flatnonzero(mine == i[0])
        for at in range(0, len(left), 64):
            x = left[at : at + 64, None]
            able = (label[x] != label[right]) & (np.minimum(rest[x], rest[right]) >= _needed(similarity, size[x] + size[right]))
            if i[0] == j[0]:
                able &= node[x] < node[right]
            x, y = np.nonzero(able)
            x, y = left[at + x], right[y]
            total = size[x] + size[y]
            apart_by = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1)
            near = np.flatnonzero(apart_by <= total - 2 * _needed(similarity, total))
            x, y = x[near], y[near]
            if closest and len(x):
                lx, ly = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
                order = np.lexsort((apart_by[near], ly, lx))
                first = np.r_[True, (np.diff(lx[order]) != 0) | (np.diff(ly[order]) != 0)]
                x, y = x[order[first]], y[order[first]]
            out.append(np.sort(np.stack([node[x], node[y]]), axis=0))
        a, b = np.concatenate(out, axis=1)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    # rounds over the closest pairs join what a group has in common; each merges components, so they end
    while not (more := apart(True)).isEmpty():
        label = joined(more)
    label = joined(apart(False))
    return stars(label)


def stars(label: DataFrame) -> DataFrame:
    """The links (a, b) of nodes with their components' least ones."""
    return label.where("node != label").select(F.col("node").alias("a"), F.col("label").alias("b"))


def suspected_links(nodes: DataFrame, distance: int = 2) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, fp) by operator 5's search: a star for each fingerprint, and a link between the hubs of
    fingerprints within ``distance``."""
    hubs = staged(nodes.groupBy("fp").agg(F.min("node").alias("hub")), "hubs")
    stars = nodes.join(hubs, "fp").where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    near = links(hubs.select("fp"), distance).withColumnsRenamed({"a": "fa", "b": "fb"})
    ends = [hubs.select(F.col("fp").alias(f"f{x}"), F.col("hub").alias(x)) for x in "ab"]
    return stars.union(near.join(ends[0], "fa").join(ends[1], "fb").select("a", "b"))


def keep_one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` but for copies and near copies of a row with a lesser doc_id."""
    own = unused("__own", docs.columns)  # tells rows of one doc_id apart
    keyed = docs.withColumn(own, F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = keyed.where("doc_id IS NOT NULL").select("doc_id", F.col(own).alias("own"), "text")
    marked = staged(summaries(rows, words), "summaries")
    node = F.xxhash64("doc_id", "own").alias("node")  # a shingle set is named by its first row, so that texts need no join
    firsts = marked.groupBy("name").agg(F.min(F.struct("doc_id", "own")).alias("first"), *(F.first(c).alias(c) for c in ("size", "bits", "fp")))
    nodes = staged(firsts.select("name", "first", F.xxhash64("first.doc_id", "first.own").alias("node"), "size", "bits", "fp"), "nodes")
    named = staged(marked.select("doc_id", "own", "name").join(nodes.select("name", "first", "node"), "name").drop("name"), "named")
    copies = named.where("struct(doc_id, own) != first").select("doc_id", "own")
    texts = without(rows, copies, "doc_id", "own").select(node, "text")
    common, repeated = frequent_shingles(texts, words, 24)
    linked = near_links(texts, nodes.select("node", "size", "bits"), common, similarity, words, suspected=suspected_links(nodes.select("node", "fp")), stored_texts=rows.select(node, "text"), repeated=repeated)
    label = nodes.join(linked.select(F.col("a").alias("node"), F.col("b").alias("label")), "node", "left").select("node", "first", F.coalesce("label", "node").alias("label"))
    label = staged(label, "labels")
    stays = label.groupBy("label").agg(F.min("first").alias("stays"))
    of_node = label.select("node", "label").join(stays, "label").select("node", "stays")
    gone = staged(named.join(of_node, "node").where("struct(doc_id, own) != stays").select("doc_id", F.col("own").alias(own)).distinct(), "gone")
    return without(keyed, gone, "doc_id", own).select(*docs.columns)
