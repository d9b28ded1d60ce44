"""Random forests of few covariates, grown from sums by cell.

A tree sees binned covariates alone (32 bins each, as in pyspark.ml), so all that it needs of the units is their sums in each
cell of the bins' grid, and there are CELLS cells at most, whatever the number of units.

1. Cut points are quantiles over all rows. Each row has its cell and its fold.
2. Rows are shuffled by ranges of cells. Tasks draw each row's Poisson count for each tree from a hash of its key, and sum counts, weights
   and labels by cell, fold and tree: one pass over the rows for all folds and all forests, which share the draws.
3. The sums of a block of trees meet in one group, whose size the cells bound. A fold's trees grow from the sums of the other
   folds, level by level, by variance reduction (for shares the same as Gini's) over a random subset of covariates at each node.
4. The mean over the trees is a row for each cell and fold, which the rows look up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS, BINS, BLOCK = 1 << 16, 32, 8


@dataclass(frozen=True)
class Forest:
    """What one forest predicts: the mean of ``label``, or the share of ones, among rows where ``among`` is 1 (SQL)."""

    name: str
    label: str
    share: bool = False
    among: str = "1"
    weight: str = "1"

    def sums(self) -> tuple[str, str, str]:
        """What is summed: rows, weights, weighted labels."""
        return f"({self.among})", f"({self.among}) * ({self.weight})", f"({self.among}) * ({self.weight}) * ({self.label})"

    def tried(self, p: int) -> int:
        return int(np.ceil(np.sqrt(p) if self.share else p / 3))


def cut_points(rows: DataFrame, columns: list[str]) -> list[list[float]]:
    """Inner borders of at most BINS bins of each column, CELLS cells together at most."""
    found = rows.approxQuantile(columns, [i / BINS for i in range(BINS + 1)], 0.001)
    cuts = [sorted(set(x[1:-1]) - {x[0]}) if x else [] for x in found]
    while np.prod([len(x) + 1 for x in cuts], dtype=float) > CELLS:
        widest = max(cuts, key=len)
        widest[:] = widest[1::2]
    return cuts


_TABLE = np.zeros(1 << 16, np.uint8)  # Poisson(1) by 16 random bits
_p, _sum = np.exp(-1.0), 0.0
for _k in range(12):
    _sum += _p
    _p /= _k + 1
    _TABLE[int(round(_sum * (1 << 16))) :] = _k + 1


def draws(hashes: np.ndarray, block: int) -> np.ndarray:
    """Poisson counts (rows x BLOCK) of the trees of a block, from 64-bit hashes of the rows' keys."""
    out = []
    for i in range(BLOCK // 4):
        x = hashes + np.uint64(0x9E3779B97F4A7C15 * (block * (BLOCK // 4) + i + 1) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(_TABLE[(x ^ (x >> np.uint64(31))).view(np.uint16).reshape(-1, 4)])
    return np.concatenate(out, axis=1)


def grown(bins: np.ndarray, sums: tuple[np.ndarray, np.ndarray, np.ndarray], tried: int, least: int, depth: int, rng, share: bool = False) -> np.ndarray:
    """A tree's prediction of every cell; bins (cells x covariates), and the cells' rows, weights and weighted labels. In a tree
    of shares, as in pyspark.ml, leaves of one parent that have the same majority are one leaf."""
    (cells, p), wide = bins.shape, int(bins.max(initial=0)) + 1
    node, nodes, open_, levels = np.zeros(cells, np.int64), 1, np.ones(1, bool), []
    for _ in range(depth):
        use = np.argsort(rng.random((nodes, p)), axis=1).argsort(axis=1) < tried
        best, feature, at = np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes, np.int64)
        whole = [np.bincount(node, x, nodes)[:, None] for x in sums]
        for j in range(p):
            n, w, s = (np.bincount(node * wide + bins[:, j], x, nodes * wide).reshape(nodes, wide).cumsum(axis=1)[:, :-1] for x in sums)
            able = (n >= least) & (whole[0] - n >= least) & (w > 0) & (whole[1] - w > 0) & (use[:, j] & open_)[:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(able, s * s / w + (whole[2] - s) ** 2 / (whole[1] - w) - whole[2] ** 2 / whole[1], 0)
            if not gain.size:
                continue
            top = gain.argmax(axis=1)
            value = gain[np.arange(nodes), top]
            better = value > np.maximum(best, 1e-9 * whole[2][:, 0] ** 2 / np.where(whole[1][:, 0] > 0, whole[1][:, 0], 1) + 1e-12)
            best, feature, at = np.where(better, value, best), np.where(better, j, feature), np.where(better, top, at)
        open_ = feature >= 0
        if not open_.any():
            break
        levels.append((node, open_))
        right = open_[node] & (bins[np.arange(cells), feature[node]] > at[node])
        node, nodes, open_ = 2 * node + right, 2 * nodes, np.repeat(open_, 2)

    def of(node: np.ndarray, nodes: int):
        w, s = (np.bincount(node, x, nodes) for x in sums[1:])
        return s / np.where(w > 0, w, 1), s > w - s

    value, ones = of(node, nodes)
    leaf, out = np.ones(nodes, bool), value[node]
    for above, divided in levels[::-1] if share else ():
        leaf = ~divided | (leaf[::2] & leaf[1::2] & (ones[::2] == ones[1::2]))
        value, ones = of(above, len(divided))
        out = np.where(leaf[above], value[above], out)
    return out


def predicted(df: DataFrame, key: str, forests: list[Forest], trees: int, least: int, folds: int = 1, depth: int = 5, features: str = "x", seed: int = 1) -> DataFrame:
    """``df`` with a fold and each forest's prediction; with more folds than one by trees that never saw the row's fold."""
    p = len(df.select(vector_to_array(features)).first()[0])
    columns = [f"__x{j}" for j in range(p)]
    rows = df.withColumn("fold", F.pmod(F.xxhash64(key), F.lit(folds)).cast("int"))
    met = rows.withColumn("__x", vector_to_array(features)).withColumns({c: F.get("__x", F.lit(j)) for j, c in enumerate(columns)}).drop("__x")
    cuts = cut_points(met, columns)
    cell, widths = F.lit(0), [len(x) + 1 for x in cuts]
    for j, c in enumerate(columns):
        if cuts[j]:
            met = Bucketizer(splits=[-np.inf, *cuts[j], np.inf], inputCol=c, outputCol=f"__b{j}").transform(met)
        cell = cell * widths[j] + (F.col(f"__b{j}") if cuts[j] else F.lit(0))
    met = met.withColumn("__cell", cell.cast("int")).drop(*columns, *(f"__b{j}" for j in range(p)))

    centres = met.agg(*(F.avg(F.expr(f.label)).alias(f.name) for f in forests)).first()  # sums of small numbers
    centred = [Forest(f.name, f.label if f.share else f"{f.label} - {centres[f.name]!r}D", f.share, f.among, f.weight) for f in forests]
    measures = list(dict.fromkeys(x for f in centred for x in f.sums()))
    blocks = -(-trees // BLOCK)
    dealt = met.select((F.col("__cell").cast("long") * folds + F.col("fold")).alias("spot"), F.xxhash64(F.lit(seed), key).alias("h"), F.array(*(F.expr(x).cast("double") for x in measures)).alias("m"))
    # partial sums add up, so that a crowded cell may be in several tasks
    dealt = dealt.repartitionByRange(2 * df.sparkSession.sparkContext.defaultParallelism, "spot", "h").sortWithinPartitions("spot", "h")

    def summed(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if not len(batch):
                continue
            spots, h = batch.column("spot").to_numpy(), batch.column("h").to_numpy().view(np.uint64)
            m = batch.column("m").flatten().to_numpy().reshape(len(batch), -1).astype(np.float32)
            starts = np.flatnonzero(np.r_[True, np.diff(spots) != 0])
            for b in range(blocks):
                k = draws(h, b).astype(np.float32)
                sums = np.stack([np.add.reduceat(k * m[:, j, None], starts, axis=0) for j in range(m.shape[1])])
                yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "spots": [spots[starts].tobytes()], "sums": [sums.tobytes()]})

    def grow(rows: pa.Table) -> pa.Table:
        block = rows.column("block")[0].as_py()
        spots = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in rows.column("spots")])
        parts = np.concatenate([np.frombuffer(x.as_py(), np.float32).reshape(len(measures), -1, BLOCK) for x in rows.column("sums")], axis=1)
        cells, place = np.unique(spots // folds, return_inverse=True)
        by = np.zeros((len(measures), folds, len(cells), BLOCK))
        np.add.at(by, (slice(None), spots % folds, place), parts)
        total, rest, bins = by.sum(axis=1), cells, []
        for width in widths[::-1]:
            bins.append(rest % width)
            rest = rest // width
        bins = np.stack(bins[::-1], axis=1)
        out = np.zeros((len(forests), folds, len(cells)))
        for i, f in enumerate(centred):
            of = [measures.index(x) for x in f.sums()]
            for t in range(min(BLOCK, trees - block * BLOCK)):
                for fold in range(folds):
                    seen = tuple(total[j, :, t] - (by[j, fold, :, t] if folds > 1 else 0) for j in of)
                    out[i, fold] += grown(bins, seen, f.tried(p), least, depth, np.random.default_rng((seed, i, block * BLOCK + t)), f.share)
        held = np.zeros((len(cells), folds), bool)
        held[place, spots % folds] = True
        at, fold = np.nonzero(held)
        return pa.table({"__cell": pa.array(cells[at].astype(np.int32)), "fold": pa.array(fold.astype(np.int32))} | {f.name: out[i, fold, at] for i, f in enumerate(forests)})

    sums = dealt.mapInArrow(summed, "block int, spots binary, sums binary")
    schema = "`__cell` int, fold int, " + ", ".join(f"`{f.name}` double" for f in forests)
    found = sums.repartition(blocks, "block").groupBy("block").applyInArrow(grow, schema).groupBy("__cell", "fold")
    found = found.agg(*((F.sum(f.name) / trees + (0.0 if f.share else centres[f.name])).alias(f.name) for f in forests))
    return met.join(F.broadcast(found), ["__cell", "fold"]).drop("__cell")
