"""A uniform shuffle into shards of exact size, by a hypergeometric communication matrix, in DataFrame functions alone.

Rows belong to blocks by a hash of their key, so that a retried task finds the same blocks. How many of each block's
rows go to each shard is drawn before any row moves, down a tree of groups of blocks: the counts of a group are multivariate
hypergeometric given the places left in the shards, so every row of the matrix sums to its block's rows and every column to its
shard's size, exactly as in a uniform shuffle of all rows. Each block then permutes its rows by a random key and deals them out
by its row of the matrix; after the exchange every shard permutes its rows again. Both permutations sort by a hash of a
seed and the row, and the second is done in buckets of the hash, whose sizes give each bucket its first slot, so that no
task ever holds a whole shard.

The matrix has blocks x shards cells; it and the buckets' first slots are the only sides broadcast, if their counted rows are few.

Rows are staged with a number each before anything is drawn, and the number goes into every hash, so that rows alike in all
columns are dealt as freely as others; the staged table also makes a retried task see the same numbers.

Defined results: a null text has size 1 and the checksum of an empty text; null doc_ids take part; repeated rows have a slot
each, anywhere; shard sizes differ by one at most whatever the rows; an empty table gives no rows. Extra columns are not
carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hypergeometric(draws: Column, good: Column, total: Column, u: Column) -> Column:
    """A count of good ones among ``draws`` of ``total`` of which ``good`` are good, by inverting its distribution at u.

    The terms come from the ratio of neighbours, so no factorial is needed; the sum is divided by the sum of all terms.
    Terms further than 12 standard deviations from the mean have less weight than a double can show, and are left out.
    """

    def drawn(x: Column) -> Column:
        n, k, t = x["n"].cast("double"), x["k"].cast("double"), x["t"].cast("double")
        mean = n * k / t
        reach = 12 * F.sqrt(mean * (1 - k / t) * (t - n) / F.greatest(t - 1, F.lit(1.0))) + 12
        low = F.greatest(F.lit(0).cast("long"), x["n"] - (x["t"] - x["k"]), F.floor(mean - reach).cast("long"))
        high = F.least(x["n"], x["k"], F.ceil(mean + reach).cast("long"))
        return _let(F.struct(x["n"].alias("n"), x["k"].alias("k"), x["t"].alias("t"), x["u"].alias("u"), low.alias("low"), high.alias("high")), searched)

    def ratio(x: Column, i: Column) -> Column:
        """ln of the term of i + 1 over that of i."""
        d = i.cast("double")
        return F.log((x["k"] - d) * (x["n"] - d) / ((d + 1) * (x["t"] - x["k"] - x["n"] + d + 1)))

    def searched(x: Column) -> Column:
        steps = F.when(x["high"] > x["low"], F.sequence(x["low"], x["high"] - 1)).otherwise(F.array().cast("array<bigint>"))
        zero = F.lit(0.0)
        # the largest term's logarithm and all terms' sum against it
        start = F.struct(zero.alias("term"), zero.alias("top"), F.lit(1.0).alias("sum"))

        def add(a: Column, i: Column) -> Column:
            def put(term: Column) -> Column:
                higher = F.greatest(a["top"], term)
                return F.struct(term.alias("term"), higher.alias("top"), (a["sum"] * F.exp(a["top"] - higher) + F.exp(term - higher)).alias("sum"))

            return _let(a["term"] + ratio(x, i), put)

        def pick(all_: Column) -> Column:
            first = F.struct(zero.alias("term"), F.exp(-all_["top"]).alias("sum"), x["low"].alias("at"))

            def walk(a: Column, i: Column) -> Column:
                return F.when(a["sum"] >= x["u"] * all_["sum"], a).otherwise(_let(a["term"] + ratio(x, i), lambda term: F.struct(term.alias("term"), (a["sum"] + F.exp(term - all_["top"])).alias("sum"), (i + 1).alias("at"))))

            return F.aggregate(steps, first, walk, lambda a: a["at"])

        return _let(F.aggregate(steps, start, add), pick)

    whole = F.struct(draws.cast("long").alias("n"), good.cast("long").alias("k"), total.cast("long").alias("t"), u.alias("u"))
    return F.when(draws * good * total == 0, F.lit(0).cast("long")).otherwise(_let(whole, drawn))


def _uniform(*parts: Column) -> Column:
    """A uniform number above 0 and at most 1, from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 1) / float(1 << 53)


FAN = 64


def _split(nodes: DataFrame, shards: int, seed: int) -> DataFrame:
    """(node, got): the counts by shard of each child of ``nodes`` (left: places by shard, children: at most FAN of node and n)."""

    def draw(left: Column, child: Column) -> Column:
        """The counts of one child given the places left in each shard."""
        everything = F.aggregate(left, F.lit(0).cast("long"), lambda a, x: a + x)
        begin = F.struct(F.array().cast("array<bigint>").alias("got"), child["n"].cast("long").alias("n"), everything.alias("total"))

        def one_shard(a: Column, j: Column) -> Column:
            places = F.get(left, j)
            take = hypergeometric(a["n"], places, a["total"], _uniform(F.lit(seed), F.col("level"), child["node"], j))
            return _let(take, lambda k: F.struct(F.concat(a["got"], F.array(k)).alias("got"), (a["n"] - k).alias("n"), (a["total"] - places).alias("total")))

        return F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), begin, one_shard, lambda a: a["got"])

    first = F.struct(F.col("left").alias("left"), F.array().cast("array<struct<node:bigint,got:array<bigint>>>").alias("done"))

    def step(a: Column, child: Column) -> Column:
        def put(got: Column) -> Column:
            left = F.zip_with(a["left"], got, lambda x, y: x - y)
            return F.struct(left.alias("left"), F.concat(a["done"], F.array(F.struct(child["node"].alias("node"), got.alias("got")))).alias("done"))

        return _let(draw(a["left"], child), put)

    return nodes.select(F.inline(F.aggregate("children", first, step, lambda a: a["done"])))


def matrix(counts: DataFrame, shards: int, seed: int, blocks: int) -> DataFrame:
    """(block, upto): for each block of ``counts`` (block, n), numbered below ``blocks``, the running sum of its rows dealt to
    shards 0, 1, ...

    The counts are drawn down a tree: all places go to FAN groups of blocks at most, each group's to its own groups, and so on,
    a Spark step a level. A node splits by itself, so no task has more than FAN children of a node to draw.
    """
    levels = 1
    while FAN**levels < blocks:
        levels += 1
    rows = F.coalesce(F.sum("n"), F.lit(0))
    even = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda j: (F.floor(F.col("rows") / shards) + F.when(j < F.col("rows") % shards, 1).otherwise(0)).cast("long"))
    nodes = counts.agg(rows.alias("rows")).select(F.lit(0).cast("long").alias("node"), even.alias("got"))
    for level in range(levels - 1, -1, -1):
        below = counts.groupBy(F.floor(F.col("block") / FAN**level).cast("long").alias("node")).agg(F.sum("n").alias("n"))
        below = below.groupBy(F.floor(F.col("node") / FAN).cast("long").alias("up")).agg(F.array_sort(F.collect_list(F.struct("node", "n"))).alias("children"))  # FAN at most
        nodes = staged(_split(nodes.join(below, F.col("node") == F.col("up")).select(F.col("got").alias("left"), "children", F.lit(level).alias("level")), shards, seed), f"level-{level}")
    running = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda j: F.aggregate(F.slice("got", 1, j), F.lit(0).cast("long"), lambda a, x: a + x))
    return nodes.select(F.col("node").alias("block"), running.alias("upto"))


def shuffled(rows: DataFrame, keys: list[str], shards: int = 16, per_block: int = 1_000_000, per_bucket: int = 250_000, seed: int = 11) -> DataFrame:
    """``rows`` with shard and slot. Blocks and buckets are as many as ``per_block`` and ``per_bucket`` ask for, and at least
    512 and 64; so a task's rows stay bounded. ``keys`` and a row's number tell rows apart."""
    numbered = staged(rows.withColumn("nth", F.monotonically_increasing_id()), "numbered")
    n = numbered.count()
    keys, blocks, buckets = [*keys, "nth"], max(512, n // per_block), max(64, n // (shards * per_bucket))
    hashed = numbered.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(blocks)))
    counts = staged(hashed.groupBy("block").agg(F.count("*").alias("n")), "blocks")
    dealt = staged(matrix(counts, shards, seed, blocks), "matrix")  # a row for each block, whose number is checked
    side = F.broadcast(dealt) if blocks <= 100_000 else dealt
    within = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed + 1), *keys), *keys)
    placed = hashed.withColumn("place", F.row_number().over(within)).join(side, "block")
    shard = F.size(F.filter("upto", lambda x: x < F.col("place"))).cast("int")
    sent = placed.select(*rows.columns, "nth", shard.alias("shard"), F.xxhash64(F.lit(seed + 2), *keys).alias("order"))
    sent = staged(sent.withColumn("bucket", F.floor(F.shiftrightunsigned("order", 11) / float(1 << 53) * buckets).cast("int")), "sent")
    sizes = sent.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    begins = sizes.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("begin"))
    begins = F.broadcast(begins) if shards * buckets <= 1_000_000 else begins  # shards x buckets rows
    again = Window.partitionBy("shard", "bucket").orderBy(F.shiftrightunsigned("order", 11), "order", *keys)
    slot = F.row_number().over(again) - 1 + F.col("begin")
    return sent.join(begins, ["shard", "bucket"]).select(*rows.columns, "shard", slot.cast("long").alias("slot"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 whose counts differ by one at most."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    found = shuffled(rows, ["doc_id", "size", "text_crc32"])
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
