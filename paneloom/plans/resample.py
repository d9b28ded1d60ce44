"""Estimates by drawing anew: randomisation inference and changes-in-changes with its bootstrap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paneloom.operators.ranges import parted, running
from paneloom.sources.staging import staged

BITS = 10


def least_sums(units: DataFrame, unit: str, value: str, n: int, reps: int, seed: int = 5, most: int = 1000) -> DataFrame:
    """(rep, s): for each replicate the sum of ``value`` over the ``n`` units of least hash, exactly.

    By radix: the first bits of the hash are counted, whole cells below the n-th unit are summed, and only units in the cell of
    the n-th one go on to the next bits, until such cells hold ``most`` units at most; those are put in order.
    """
    hashed = units.select(F.col(unit).alias("_u"), F.col(value).alias("_x"), F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep")).withColumn("_h", F.xxhash64("rep", "_u", F.lit(seed)))
    prefix = lambda bits: F.shiftrightunsigned("_h", 64 - bits)
    parts, open_, bits = [], None, 0
    while True:
        rows = hashed if open_ is None else hashed.join(F.broadcast(open_), "rep").where(prefix(bits) == F.col("_cell")).drop("_cell")  # a row a replicate
        if open_ is None:
            rows = rows.withColumn("_need", F.lit(n).cast("long"))
        elif largest <= most or bits + BITS > 60:
            place = F.row_number().over(Window.partitionBy("rep").orderBy(F.shiftrightunsigned("_h", 1), "_h", "_u"))
            parts.append(rows.withColumn("_place", place).where("_place <= _need").select("rep", "_x"))
            break
        bits += BITS
        cells = rows.groupBy("rep", "_need", prefix(bits).alias("_cell")).agg(F.count("*").alias("_n"), F.sum("_x").alias("_s"))
        cells = staged(cells.withColumn("_upto", F.sum("_n").over(Window.partitionBy("rep").orderBy("_cell"))))  # 2**BITS rows a replicate
        parts.append(cells.where("_upto <= _need").select("rep", F.col("_s").alias("_x")))
        open_ = staged(cells.where("_upto > _need AND _upto - _n < _need").select("rep", "_cell", (F.col("_need") - F.col("_upto") + F.col("_n")).alias("_need"), "_n"))
        largest = open_.agg(F.max("_n")).first()[0]
        open_ = open_.drop("_n")
        if largest is None:
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("rep").agg(F.sum("_x").alias("s"))


def permutation(df: DataFrame, unit: str, reps: int = 500, seed: int = 5) -> DataFrame:
    """Randomisation inference on a balanced panel: the treated units are drawn anew ``reps`` times.

    By Frisch-Waugh the slope of a replicate needs each unit's change alone (post mean less pre mean), so rows are summed
    to units once. The treated of a replicate are the units of the least hash, as many as were treated.
    """
    change = df.groupBy(unit).agg(F.max("treatment").alias("treatment"), (F.avg(F.when(F.col("post") == 1, F.col("y"))) - F.avg(F.when(F.col("post") == 0, F.col("y")))).alias("d"))
    change = staged(change.where("d IS NOT NULL"))
    total = change.agg(F.sum("treatment").alias("n1"), F.count("*").alias("n"), F.sum("d").alias("sum"), F.avg(F.when(F.col("treatment") == 1, F.col("d"))).alias("m1"), F.avg(F.when(F.col("treatment") == 0, F.col("d"))).alias("m0")).first()
    n1, n0 = total["n1"], total["n"] - total["n1"]
    beta = total["m1"] - total["m0"]
    picked = least_sums(change, unit, "d", n1, reps, seed)
    b = F.col("s") / n1 - (total["sum"] - F.col("s")) / n0
    return picked.select(b.alias("b")).agg(F.lit(float(beta)).alias("estimate"), F.stddev_samp("b").alias("se"), ((F.count_if(F.abs("b") >= abs(beta) * (1 - 1e-12)) + 1) / F.lit(reps + 1)).alias("p_value"), F.lit(reps).alias("reps"))


#: Cumulative probabilities of a Poisson count of mean 1, from 0 to 12.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.9999988747974020, 0.9999998885745217, 0.9999999899522336, 0.9999999991683892, 0.9999999999363887)


def drawn(units: DataFrame, unit: str, draws: int, seed: int = 11) -> DataFrame:
    """``units`` with ``draw`` and ``weight``: draw 0 has every unit once, the others Poisson counts of mean 1; rows of count 0
    are left out."""
    u = F.shiftrightunsigned(F.xxhash64("draw", unit, F.lit(seed)), 11) / F.lit(float(1 << 53))
    count = sum(((F.col("_u") > p).cast("int") for p in POISSON), F.lit(0))
    out = units.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws)))).withColumn("_u", u)
    return out.withColumn("weight", F.when(F.col("draw") == 0, 1).otherwise(count)).where("weight > 0").drop("_u")


TAUS = {f"q{10 * i}": i / 10 for i in range(1, 10)}


def changes_in_changes(units: DataFrame, draws: int = 0, taus: dict[str, float] | None = None, seed: int = 11) -> DataFrame:
    """(draw, term, estimate): mean effect ('att') and effects at quantiles of the treated after treatment against the map of
    their values before: a value takes its rank among the controls before, and the control value after of that rank.

    ``units``: unit, treatment, y0 and y1 (before and after). Every draw is a key of the same grouped jobs: its running counts
    are integer weights by ranges of the value, and ranks meet values in an equi-join on draw and place.
    """
    taus = TAUS if taus is None else taus
    w = staged(drawn(units.where("y0 IS NOT NULL AND y1 IS NOT NULL"), "unit", draws, seed))
    arm = lambda a: F.sum(F.when(F.col("treatment") == a, F.col("weight")).otherwise(0))
    before = running(w.groupBy("draw", F.col("y0").cast("double").alias("v")).agg(arm(0).alias("c"), arm(1).alias("t")), "v", ["c", "t"], ("draw",))
    after = running(w.groupBy("draw", F.col("y1").cast("double").alias("v")).agg(arm(0).alias("c"), arm(1).alias("t")), "v", ["c", "t"], ("draw",))
    after = staged(after)
    sizes = F.broadcast(w.groupBy("draw").agg(arm(0).alias("n0"), arm(1).alias("n1")).where("n0 > 0 AND n1 > 0"))  # a row a draw
    inside = lambda t: (F.ceil(F.lit(float(t)) * F.col("n1") - 1e-9) > F.col("upto_t") - F.col("t")) & (F.ceil(F.lit(float(t)) * F.col("n1") - 1e-9) <= F.col("upto_t"))
    summed = lambda rows, v: rows.groupBy("draw").agg((F.sum(F.col(v) * F.col("t")) / F.sum("t")).alias("att"), *(F.max(F.when(inside(t), F.col(v))).alias(k) for k, t in taus.items()))
    asked = before.join(sizes, "draw").where("t > 0").withColumn("place", F.greatest(F.lit(1), F.col("upto_c")).cast("long"))
    places = after.where("c > 0").select("draw", F.col("v").alias("mapped"), F.explode(F.sequence(F.col("upto_c") - F.col("c") + 1, F.col("upto_c"))).alias("place"))
    unreal = summed(asked.join(places, ["draw", "place"]), "mapped")
    real = summed(after.join(sizes, "draw").where("t > 0"), "v")
    long = lambda d: d.unpivot("draw", ["att", *taus], "term", "x")
    return long(real).join(long(unreal).withColumnRenamed("x", "x0"), ["draw", "term"]).select("draw", "term", (F.col("x") - F.col("x0")).alias("estimate"))


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _hashed(x: np.ndarray, seed: np.ndarray, long: bool) -> np.ndarray:
    """XXH64 of integers of 4 or 8 bytes, as ``xxhash64`` chains it over columns."""
    turn = lambda h, n: (h << np.uint64(n)) | (h >> np.uint64(64 - n))
    if long:
        h = seed + _P5 + np.uint64(8) ^ turn(x.astype(np.int64).view(np.uint64) * _P2, 31) * _P1
        h = turn(h, 27) * _P1 + _P4
    else:
        h = seed + _P5 + np.uint64(4) ^ x.astype(np.int32).view(np.uint32).astype(np.uint64) * _P1
        h = turn(h, 23) * _P2 + _P3
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    return h ^ h >> np.uint64(32)


def weights_of(units: np.ndarray, draws: np.ndarray, seed: int, long: bool) -> np.ndarray:
    """Units x draws: the weights that ``drawn`` gives."""
    first = _hashed(draws, np.full(len(draws), 42, np.uint64), False)
    h = _hashed(np.array([seed]), _hashed(units[:, None], first[None, :], long), False)
    u = (h >> np.uint64(11)) / float(1 << 53)
    w = np.zeros(u.shape, np.int64)
    for p in POISSON:
        more = u > p
        if not more.any():
            break
        w += more
    w[:, draws == 0] = 1
    return w


def changes_in_changes_drawn(units: DataFrame, draws: int, taus: dict[str, float] | None = None, seed: int = 11, at_once: int = 25) -> DataFrame:
    """As ``changes_in_changes``, with a unit's weights drawn where they are used and never written as rows.

    Units are ranged by y0 and by y1. A range's weights are summed by draw first: ranges x draws numbers, which do not grow with
    the units. They tell each range of y0 the few ranges of y1 that hold its places in any draw; the two meet in one group, which
    takes ``at_once`` draws at a time. ``unit`` is an int or a long.
    """
    taus = TAUS if taus is None else taus
    long, n = dict(units.dtypes)["unit"] == "bigint", draws + 1
    numbers = np.arange(n)
    chunks = [numbers[i : i + at_once] for i in range(0, n, at_once)]
    u = staged(units.where("y0 IS NOT NULL AND y1 IS NOT NULL").select("unit", F.col("treatment").cast("int").alias("arm"), F.col("y0").cast("double").alias("y0"), F.col("y1").cast("double").alias("y1")).where("arm IN (0, 1)"))
    ranged = staged(parted(parted(u, "y0").withColumnRenamed("_part", "j"), "y1").withColumnRenamed("_part", "k").select("unit", "arm", "y0", "y1", F.col("j").cast("int"), F.col("k").cast("int")))

    def partial(frames):
        sums: dict[tuple, np.ndarray] = {}
        for f in frames:
            for a in range(0, len(f), 2000):
                g = f.iloc[a : a + 2000]
                w = weights_of(g.unit.to_numpy(), numbers, seed, long)
                for side in ("j", "k"):
                    for (part, arm), at in g.reset_index().groupby([side, "arm"]).indices.items():
                        key = (side, part, arm)
                        sums[key] = sums.get(key, 0) + w[at].sum(0)
        if sums:
            yield pd.DataFrame([(*key, d, x) for key, row in sums.items() for d, x in enumerate(row.tolist())], columns=["side", "part", "arm", "draw", "n"])

    found = ranged.mapInPandas(partial, "side string, part int, arm int, draw int, n long").groupBy("side", "part", "arm", "draw").agg(F.sum("n").alias("n"))
    most = 1 + max(ranged.agg(F.greatest(F.max("j"), F.max("k"))).first()[0] or 0, 0)
    filled = {(side, arm): np.zeros((most + 1, n), np.int64) for side in "jk" for arm in (0, 1)}
    for r in found.toLocalIterator():  # ranges x draws
        filled[r.side, r.arm][r.part + 1, r.draw] = r.n
    upto = {key: x.cumsum(0) for key, x in filled.items()}  # row p: before part p
    n0, n1 = upto["j", 0][-1], upto["j", 1][-1]
    real_draw = (n0 > 0) & (n1 > 0)
    asked = {name: np.ceil(t * n1 - 1e-9).astype(np.int64) for name, t in taus.items()}
    low, high = np.maximum(1, upto["j", 0][:-1]), np.maximum(1, upto["j", 0][1:])
    meets = {}  # the ranges of y1 of each range of y0
    for j in range(most):
        seen = ((upto["k", 0][:-1] < high[j]) & (upto["k", 0][1:] >= low[j]) & real_draw).any(1).nonzero()[0]
        if len(seen):
            meets[j] = (int(seen[0]), int(seen[-1]))

    def summed(out, ds, w, values, cum, before):
        """Adds the sums and quantiles of a range's treated rows, whose values are columns by draw."""
        total = (w * values).sum(0)
        for i, d in enumerate(ds):
            if real_draw[d] and w[:, i].any():
                row = {"draw": int(d), "att": float(total[i]) / float(n1[d])}
                for name in taus:
                    q = asked[name][d]
                    row[name] = float(values[np.searchsorted(cum[:, i], q), i]) if before[i] < q <= cum[-1, i] else None
                out.append(row)

    schema = "draw int, att double, " + ", ".join(f"{k} double" for k in taus)
    frame = lambda out: pd.DataFrame(out, columns=["draw", "att", *taus])

    def after(key, f):
        f, out = f.sort_values("y1"), []
        for ds in chunks:
            w, before = weights_of(f.unit.to_numpy(), ds, seed, long), upto["k", 1][key[0], ds]
            summed(out, ds, w, np.repeat(f.y1.to_numpy()[:, None], len(ds), 1), before + w.cumsum(0), before)
        return frame(out)

    def mapped(key, mine, theirs):
        out = []
        if not len(mine) or not len(theirs):
            return frame(out)
        mine, theirs, j = mine.sort_values("y0"), theirs.sort_values("v"), key[0]
        y0, y1, arm = mine.y0.to_numpy(), theirs.v.to_numpy(), mine.arm.to_numpy()
        last = np.searchsorted(y0, y0, "right") - 1  # ties have their last one's place
        treated = arm == 1
        for ds in chunks:
            w = weights_of(mine.unit.to_numpy(), ds, seed, long)
            places = np.maximum(1, upto["j", 0][j, ds] + (w * (arm == 0)[:, None]).cumsum(0))[last][treated]
            other = upto["k", 0][meets[j][0], ds] + weights_of(theirs.other.to_numpy(), ds, seed, long).cumsum(0)
            # a draw without controls or treated rows is left out later, its places may be off the end
            values = np.stack([y1[np.minimum(np.searchsorted(other[:, i], places[:, i]), len(y1) - 1)] for i in range(len(ds))], 1)
            wt, before = w[treated], upto["j", 1][j, ds]
            if len(wt):
                summed(out, ds, wt, values, before + wt.cumsum(0), before)
        return frame(out)

    pairs = [(j, k) for j, (a, b) in meets.items() for k in range(a, b + 1)]
    if not pairs:
        pairs = [(-1, -1)]
    spark = units.sparkSession
    right = ranged.where("arm = 0").select(F.col("unit").alias("other"), F.col("y1").alias("v"), "k").join(F.broadcast(spark.createDataFrame(pairs, "at int, k int")), "k").drop("k")
    unreal = ranged.select("unit", "arm", "y0", "j").groupBy("j").cogroup(right.groupBy("at")).applyInPandas(mapped, schema)
    real = ranged.where("arm = 1").select("unit", "y1", "k").groupBy("k").applyInPandas(after, schema)
    whole = lambda d: d.groupBy("draw").agg(F.sum("att").alias("att"), *(F.max(k).alias(k) for k in taus)).unpivot("draw", ["att", *taus], "term", "x")
    return whole(real).join(whole(unreal).withColumnRenamed("x", "x0"), ["draw", "term"]).select("draw", "term", (F.col("x") - F.col("x0")).alias("estimate"))


def bootstrapped(estimates: DataFrame) -> DataFrame:
    """(term, estimate, se, draws) of (draw, term, estimate): draw 0 is the estimate, the others give its error."""
    first = F.max(F.when(F.col("draw") == 0, F.col("estimate")))
    rest = F.when(F.col("draw") > 0, F.col("estimate"))
    return estimates.groupBy("term").agg(first.alias("estimate"), F.stddev_samp(rest).alias("se"), F.count(rest).alias("draws"))
