"""Synthetic controls on short series: one small matrix for each group, fitted inside tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.operators.ranges import numbered
from paneloom.sources.staging import staged


def simplex_ridge(a: np.ndarray, b: np.ndarray, zeta: float, begin: np.ndarray | None = None) -> np.ndarray:
    """min |a w + c - b|^2 + zeta^2 n |w|^2 over non-negative weights that sum to one, with a free level c.

    By sets of free weights: the least on a set is one linear system; a weight that would turn negative leaves the set, the one
    that helps most joins it, until none does. That is the exact solution; sets that never end are an error. ``begin``: weights to start from.
    """
    a, b = a - a.mean(axis=0), b - b.mean()
    n, k = a.shape
    h = a.T @ a + zeta**2 * n * np.eye(k)
    g = a.T @ b
    w = np.full(k, 1 / k) if begin is None or begin.sum() <= 0 else begin / begin.sum()
    free = w > 0
    small = 1e-12 * max(float(np.abs(h).max()), float(np.abs(g).max()), 1e-300)
    for _ in range(100 * k + 1000):
        at = np.flatnonzero(free)
        m = len(at)
        system = np.block([[h[np.ix_(at, at)], np.ones((m, 1))], [np.ones((1, m)), np.zeros((1, 1))]])
        try:
            best = np.linalg.solve(system, np.r_[g[at], 1.0])[:m]
        except np.linalg.LinAlgError:
            best = np.linalg.lstsq(system, np.r_[g[at], 1.0], rcond=None)[0][:m]
        if (best < 0).any():
            down = best < 0
            step = float((w[at][down] / (w[at][down] - best[down])).min())
            w[at] += step * (best - w[at])
            free[at[down & (w[at] <= 1e-15)]] = False
            w[~free] = 0.0
            continue
        w[at] = best
        pull = h @ w - g  # equal on the free weights at the least
        gain = pull[at].mean() - np.where(free, np.inf, pull)
        if gain.max() <= small * max(1.0, k):
            return w
        free[int(gain.argmax())] = True
    raise ValueError("the weights did not settle")


def synthetic_did(y: np.ndarray, treated: np.ndarray, pre: np.ndarray, begin: tuple | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Effect and weights of units and times; y is units x years. ``begin``: weights to start from."""
    donors, target = y[~treated], y[treated].mean(axis=0)
    n1, t1 = treated.sum(), (~pre).sum()
    steps = np.diff(donors[:, pre], axis=1)
    zeta = (n1 * t1) ** 0.25 * (steps.std(ddof=1) if steps.size > 1 else 1.0)
    scale = max(np.abs(y).max(), 1e-12)
    omega = simplex_ridge(donors[:, pre].T / scale, target[pre] / scale, zeta / scale, begin and begin[0])
    lam = simplex_ridge(donors[:, pre] / scale, donors[:, ~pre].mean(axis=1) / scale, 1e-6, begin and begin[1])
    gap = target - omega @ donors
    return float(gap[~pre].mean() - lam @ gap[pre]), omega, lam


def _matrix(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    wide = pdf.pivot_table(index="series", columns="year", values="y").dropna()
    arm = pdf.groupby("series")["treated"].max().reindex(wide.index).to_numpy(bool)
    return wide.to_numpy(float), arm, wide.columns.to_numpy()


def synthetic_did_by_group(series: DataFrame, start: int, keys: list[str]) -> DataFrame:
    """One fit for each value of ``keys``: series, year, y, treated; standard errors by leaving one series out."""
    kinds = ", ".join(f"{k} {series.schema[k].dataType.simpleString()}" for k in keys)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y, arm, years = _matrix(pdf)
        pre = years < start
        ok = arm.sum() >= 1 and (~arm).sum() >= 2 and pre.sum() >= 2 and (~pre).sum() >= 1
        tau = se = np.nan
        if ok:
            tau, omega, lam = synthetic_did(y, arm, pre)
            place = np.cumsum(~arm) - 1  # a donor's place among the weights
            rest = lambda i: omega if arm[i] else np.delete(omega, place[i])
            left = [synthetic_did(np.delete(y, i, 0), np.delete(arm, i), pre, (rest(i), lam))[0] for i in range(len(y)) if (np.delete(arm, i).any() and (~np.delete(arm, i)).sum() >= 2)]
            n = len(left)
            se = float(np.sqrt((n - 1) / n * ((np.array(left) - np.mean(left)) ** 2).sum())) if n > 1 and arm.sum() > 1 else np.nan
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "estimate": [tau], "se": [se], "n_treated": [int(arm.sum())], "n_donors": [int((~arm).sum())]})

    return series.groupBy(*keys).applyInPandas(fit, f"{kinds}, estimate double, se double, n_treated int, n_donors int")


#: Shares of the absolute penalty that are tried, penalties of a path and the last over the first.
L1_SHARES, PENALTIES, LAST = (0.3, 0.5, 0.7, 0.9, 1.0), 100, 1e-3


def penalties(c: np.ndarray, l1: float) -> np.ndarray:
    """The path's penalties, from the least at which every weight is zero."""
    top = max(float(np.abs(c).max()) / l1, 1e-15)
    return np.geomspace(top, top * LAST, PENALTIES)


def elastic_path(q: np.ndarray, c: np.ndarray, yy: float, l1: float, alphas: np.ndarray, tolerance: float = 1e-10, steps: int = 10_000) -> np.ndarray:
    """Weights of min |y - x w|^2 / 2n + alpha (l1 |w|_1 + (1 - l1) |w|^2 / 2) for falling ``alphas``, from the covariances
    q = x'x/n, c = x'y/n and yy = y'y/n. Each penalty starts from the last one's weights and ends when the duality gap is
    below ``tolerance`` of yy. With given signs the least is one linear system; on the way to it the best point at which a
    weight reaches zero counts, and of the weights at zero the one with the strongest pull joins."""
    w, out = np.zeros(len(c)), np.zeros((len(alphas), len(c)))
    for i, alpha in enumerate(alphas):
        lam, mu = alpha * l1, alpha * (1 - l1)
        cost = lambda v, at: (v @ q[np.ix_(at, at)] @ v + mu * v @ v) / 2 - c[at] @ v + lam * np.abs(v).sum()  # noqa: B023, E731
        for _ in range(steps):
            on = np.flatnonzero(w)
            qw = q[:, on] @ w[on]
            pull = c - qw - mu * w
            most = float(np.abs(pull).max())
            fit, size = c @ w, w @ w
            scale = lam / most if most > lam else 1.0
            gap = (yy - 2 * fit + w @ qw + mu * size) * (1 + scale**2) / 2 + lam * np.abs(w).sum() - scale * (yy - fit)
            if gap <= tolerance * yy:
                break
            signs = np.sign(w)
            still = np.abs(pull[on] - lam * signs[on]).max(initial=0) <= 1e-9 * max(lam, most)
            if still:  # the least of these signs: another weight must join
                away = np.where(w == 0, np.abs(pull), 0.0)
                signs[int(away.argmax())] = np.sign(pull[int(away.argmax())])
            at = np.flatnonzero(signs)
            block, right = q[np.ix_(at, at)], c[at] - lam * signs[at]
            best = np.linalg.solve(block + mu * np.eye(len(at)), right) if mu > 0 else np.linalg.lstsq(block, right, rcond=1e-13)[0]
            old = w[at]
            cross = (best * old <= 0) & (old != 0)
            if cross.any():
                zero = 1e-14 * np.abs(old).max()
                points = [old + t * (best - old) for t in {*(old[cross] / (old[cross] - best[cross])), 1.0}]
                best = min((np.where(cross & (np.abs(v) <= zero), 0.0, v) for v in points), key=lambda v: cost(v, at))
            w = np.zeros(len(c))
            w[at] = best
        else:
            raise ValueError("the path did not reach its tolerance")
        out[i] = w
    return out


def _covariances(x: np.ndarray, y: np.ndarray) -> tuple:
    x, y = x - x.mean(axis=0), y - y.mean()
    return x.T @ x / len(y), x.T @ y / len(y), float(y @ y) / len(y)


def elastic_net_cv(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, float, float]:
    """Weights, level, penalty and share of the absolute penalty that contiguous folds (five, or one a row) choose."""
    folds, best = np.array_split(np.arange(len(y)), min(5, len(y))), (np.inf, 0.0, 0.0)
    whole = _covariances(x, y)
    if not whole[2] > 0:
        return np.zeros(x.shape[1]), float(y.mean()), 0.0, 0.0
    cut = [(f, np.setdiff1d(np.arange(len(y)), f)) for f in folds]
    parts = [_covariances(x[rest], y[rest]) for _, rest in cut]
    for l1 in L1_SHARES:
        alphas, mse = penalties(whole[1], l1), 0.0
        for (f, rest), (q, c, yy) in zip(cut, parts, strict=True):
            w = elastic_path(q, c, yy, l1, alphas) if yy > 0 else np.zeros((len(alphas), x.shape[1]))
            mse = mse + ((y[f] - y[rest].mean() - w @ (x[f] - x[rest].mean(axis=0)).T) ** 2).mean(axis=1) / len(folds)
        i = int(np.argmin(mse))
        if mse[i] < best[0]:
            best = (float(mse[i]), float(alphas[i]), l1)
    path = penalties(whole[1], best[2])
    w = elastic_path(*whole, best[2], path[path >= best[1] * (1 - 1e-12)])[-1]
    return w, float(y.mean() - x.mean(axis=0) @ w), best[1], best[2]


def elastic_net_control(series: DataFrame, donors: DataFrame, start: int, key: str) -> DataFrame:
    """A control of donors for each treated series of a group, treated and donors net of the donors' yearly mean; a cross-validated
    elastic net on the years before the start, the effect is the mean gap after it. A task has one treated series and the
    donors of its group."""
    shared = donors.groupBy(key).agg(F.collect_list(F.struct("series", "year", "y")).alias("donors"))  # a group's series of few years
    tasks = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fit takes a second: small partitions aren't joined up
    mine = series.groupBy(key, "series").agg(F.collect_list(F.struct("year", "y")).alias("own")).join(shared, key).repartition(tasks, key, "series")

    def fit(frames):
        for pdf in frames:
            out = []
            for k, name, own, others in zip(pdf[key], pdf["series"], pdf["own"], pdf["donors"], strict=True):
                d = pd.DataFrame(list(others)).pivot_table(index="year", columns="series", values="y").dropna(axis=1)
                target = pd.DataFrame(list(own)).set_index("year")["y"].reindex(d.index)
                seen = target.notna().to_numpy()
                pre, post = (d.index < start) & seen, (d.index >= start) & seen
                if d.shape[1] < 2 or pre.sum() < 3 or not post.any():
                    continue
                common = d.mean(axis=1)
                x, y = d.sub(common, axis=0).to_numpy(), (target - common).to_numpy()
                w, level, alpha, l1 = elastic_net_cv(x[pre], y[pre])
                out.append((k, name, float((y[post] - level - x[post] @ w).mean()), int((w != 0).sum()), alpha, l1, int(post.sum())))
            yield pd.DataFrame(out, columns=[key, "series", "estimate", "n_donors", "penalty", "l1_share", "post_years"])

    return mine.mapInPandas(fit, f"{key} {series.schema[key].dataType.simpleString()}, series string, estimate double, n_donors int, penalty double, l1_share double, post_years int")


def synthetic_weights(cells: DataFrame, start: int, keys: list[str]) -> DataFrame:
    """Weights of donor cells and of the years before the start for each value of ``keys``: kind ('unit' or 'time'), name, weight.
    ``cells``: series, year, y, treated; series that lack a year are left out."""
    kinds = ", ".join(f"{k} {cells.schema[k].dataType.simpleString()}" for k in keys)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y, arm, years = _matrix(pdf)
        names = np.array(pdf.pivot_table(index="series", columns="year", values="y").dropna().index)
        pre = years < start
        if arm.sum() < 1 or (~arm).sum() < 2 or pre.sum() < 2 or not (~pre).any():
            rows = []
        else:
            _, omega, lam = synthetic_did(y, arm, pre)
            rows = [("unit", str(s), float(w)) for s, w in zip(names[~arm], omega, strict=True)] + [("time", str(t), float(w)) for t, w in zip(years[pre], lam, strict=True)]
        text = lambda i: pd.Series([r[i] for r in rows], dtype=object)
        return pd.DataFrame({**{k: pd.Series([pdf[k].iloc[0]] * len(rows), dtype=pdf[k].dtype) for k in keys}, "kind": text(0), "name": text(1), "weight": np.array([r[2] for r in rows], float)})

    return cells.groupBy(*keys).applyInPandas(fit, f"{kinds}, kind string, name string, weight double")


def pixel_weights(rows: DataFrame, weights: DataFrame, start: int, key: str) -> DataFrame:
    """``rows`` (key, series, pixel, year, treated) with ``weight``: a donor cell's weight spread over its pixels (those of its
    largest year), one over the treated pixels, times the year's weight before the start and one over the years after it.
    Rows of weight zero are left out, and so are groups without weights."""
    largest = rows.groupBy(key, "series", "year").agg(F.count_distinct("pixel").alias("n")).groupBy(key, "series").agg(F.max("n").alias("n_pix"))
    unit = weights.where("kind = 'unit'").select(key, F.col("name").alias("series"), F.col("weight").alias("wu")).join(largest, [key, "series"]).select(key, "series", (F.col("wu") / F.col("n_pix")).alias("wu"))
    time = weights.where("kind = 'time'").select(key, F.col("name").cast("int").alias("year"), F.col("weight").alias("wt"))
    totals = rows.groupBy(key).agg(F.count_distinct(F.when(F.col("treated"), F.col("pixel"))).alias("n_treated"), F.count_distinct(F.when(F.col("year") >= start, F.col("year"))).alias("n_post"))
    totals = totals.join(weights.select(key).distinct(), key)
    met = rows.join(F.broadcast(totals), key).join(F.broadcast(time), [key, "year"], "left").join(unit, [key, "series"], "left")  # a row a group, a row a group and year
    wu = F.when(F.col("treated"), 1 / F.col("n_treated")).otherwise(F.coalesce("wu", F.lit(0.0)))
    wt = F.when(F.col("year") >= start, 1 / F.col("n_post")).otherwise(F.coalesce("wt", F.lit(0.0)))
    return met.withColumn("weight", wu * wt).where("weight > 0").select(*rows.columns, "weight")


def completed_matrix(units: DataFrame, start: int, rank: int = 3) -> DataFrame:
    """Untreated outcomes of treated cells by alternating least squares on two-way residuals; the mean gap."""
    from pyspark.ml.recommendation import ALS

    numbers = staged(numbered(units, "unit"))
    if (numbers.agg(F.max("number")).first()[0] or 0) >= 1 << 31:
        raise ValueError("more units than the factorisation can number")
    u = units.join(numbers.select("unit", F.col("number").cast("int").alias("uid")), "unit")
    free = u.where(~(F.col("treated") & (F.col("year") >= start)))
    my, mu = free.groupBy("year").agg(F.avg("y").alias("my")), free.groupBy("uid").agg(F.avg("y").alias("mu"))
    g = free.agg(F.avg("y").alias("g"), F.stddev_samp("y").alias("s"))
    z = u.join(F.broadcast(my), "year").join(mu, "uid").join(F.broadcast(g)).withColumn("base", F.col("my") + F.col("mu") - F.col("g")).withColumn("r", (F.col("y") - F.col("base")) / F.col("s"))
    cell = F.col("treated") & (F.col("year") >= start)
    model = ALS(rank=rank, maxIter=8, regParam=0.1, userCol="uid", itemCol="year", ratingCol="r", seed=1, coldStartStrategy="nan").fit(z.where(~cell))
    hit = model.transform(z.where(cell)).withColumn("gap", F.col("y") - F.col("base") - F.col("s") * F.coalesce(F.nanvl("prediction", F.lit(0.0)), F.lit(0.0)))
    return hit.agg(F.avg("gap").alias("estimate"), F.count("*").alias("n"))
