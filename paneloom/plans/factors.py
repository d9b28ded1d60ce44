"""Factor models of unit x year outcomes.

A unit is one row, an array of its years. Tasks sum second moments of years (years x years numbers), the driver takes their
eigenvectors, and tasks fit each unit's level and loadings on its untreated years. ``controls`` takes the factors from units
that are never treated; ``interactive`` goes on in turns: untreated fits fill the treated and missing cells, the filled rows
give new moments and factors, until the squared error of the untreated cells settles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.sources.staging import staged


@dataclass
class Factors:
    """Years, their common course, the design (a column of ones and the factors), and how the fit went."""

    years: list[int]
    course: np.ndarray
    design: np.ndarray
    error: float
    rounds: int
    cv: list[float]

    @property
    def n_factors(self) -> int:
        return self.design.shape[1] - 1


def in_rows(units: DataFrame, years: list[int]) -> DataFrame:
    """unit, cluster, start and v (null where a year is missing) of (unit, cluster, year, y, cohort); one row of a unit and
    year at most, null outcomes are missing, units without any outcome are left out."""
    cells = units.where("y IS NOT NULL").groupBy("unit").agg(F.max("cohort").cast("double").alias("start"), F.min("cluster").alias("cluster"), F.map_from_entries(F.collect_list(F.struct("year", "y"))).alias("m"))
    return staged(cells.select("unit", "cluster", "start", F.transform(F.lit(years), lambda t: F.try_element_at("m", t)).alias("v")))


def _matrix(batch: pa.RecordBatch, years: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Outcomes (nan where missing), starts (inf: never) and which cells are seen and untreated."""
    column = batch.column("v")
    v = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(batch), len(years))
    start = np.nan_to_num(batch.column("start").to_numpy(zero_copy_only=False).astype(float), nan=np.inf)
    return v, start, ~np.isnan(v) & (years[None, :] < start[:, None])


def summed(rows: DataFrame, years: list[int], shapes: dict[str, tuple], of: Callable) -> dict[str, np.ndarray]:
    """Sums over all units of the arrays that ``of(v, start, free)`` gives by name; a task sends its own sums alone."""
    at = np.array(years)

    def tasks(batches: Iterator[pa.RecordBatch]):
        total = {k: np.zeros(s) for k, s in shapes.items()}
        for batch in batches:
            if len(batch):
                for k, x in of(*_matrix(batch, at)).items():
                    total[k] += x
        for k, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * x.size), pa.array(np.arange(x.size)), pa.array(x.ravel())], ["name", "at", "x"])

    out = {k: np.zeros(s) for k, s in shapes.items()}
    for r in rows.select("start", "v").mapInArrow(tasks, "name string, at long, x double").groupBy("name", "at").agg(F.sum("x").alias("x")).collect():
        out[r["name"]].ravel()[r["at"]] = r["x"]
    return out


def loadings(x: np.ndarray, free: np.ndarray, design: np.ndarray) -> np.ndarray:
    """Least squares of each row's free cells on the design."""
    k = design.shape[1]
    gram = (free.astype(float) @ (design[:, :, None] * design[:, None, :]).reshape(len(design), k * k)).reshape(-1, k, k)
    return (np.linalg.pinv(gram, rcond=1e-12, hermitian=True) @ (np.where(free, x, 0.0) @ design)[:, :, None])[:, :, 0]


def _design(second: np.ndarray, n_factors: int) -> np.ndarray:
    t = len(second)
    net = np.eye(t) - 1 / t
    return np.c_[np.ones(t), np.linalg.eigh(net @ second @ net)[1][:, ::-1][:, :n_factors]]


def left_out_error(second: np.ndarray, seen: np.ndarray, design: np.ndarray) -> float:
    """Mean squared error of predicting each seen year of rows with these second moments from their other seen years: the
    residual of a year over one less its leverage, so no fit is repeated."""
    d = design[seen]
    hat = d @ np.linalg.pinv(d)
    off, room = np.eye(len(d)) - hat, 1 - np.diag(hat)
    if (room < 1e-9).any():
        return float("inf")
    return float((np.diag(off @ second[np.ix_(seen, seen)] @ off) / room**2).mean())


def factor_model(rows: DataFrame, years: list[int], method: str = "controls", n_factors: int | None = None, most: int = 4, tolerance: float = 1e-12, rounds: int = 2000) -> Factors:
    """Factors of ``rows`` (see in_rows). Their number, if not given, is the one whose left-out error of the treated units' years
    before the start is least: at most ``most``, those years less two, the controls less one, and none below three years."""
    t, at = len(years), np.array(years)

    def controls(v, start, free):
        whole = free.all(axis=1)
        c = v[whole]
        return {"n": np.array([len(c)]), "s": c.sum(axis=0), "q": c.T @ c}

    first = summed(rows, years, {"n": (1,), "s": (t,), "q": (t, t)}, controls)
    n = int(first["n"][0])
    if n < 2:
        raise ValueError("factors need two units that are never treated and seen in every year")
    course = first["s"] / n
    second = first["q"] / n - np.outer(course, course)
    starts = sorted(r[0] for r in rows.where("start IS NOT NULL").select("start").distinct().collect())  # cohorts

    def treated(v, start, free):
        out = np.zeros((len(starts), t, t))
        for i, g in enumerate(starts):
            x = v[(start == g) & ~np.isnan(v).any(axis=1)] - course
            out[i] = x.T @ x
        return {"q": out}

    cv: list[float] = []
    if n_factors is None:
        before = summed(rows, years, {"q": (len(starts), t, t)}, treated)["q"]
        pre = [int((at < g).sum()) for g in starts]
        cap = max(0, min(most, min(pre, default=0) - 2, n - 1)) if min(pre, default=0) >= 3 else 0
        cv = [sum(left_out_error(q, at < g, _design(second, r)) for g, q in zip(starts, before, strict=True) if (at < g).sum() >= 2) for r in range(cap + 1)]
        n_factors = int(np.argmin(cv))
    design, error, turn = _design(second, n_factors), float("nan"), 0
    if method == "interactive":
        last = float("inf")
        for turn in range(1, rounds + 1):

            def fill(v, start, free, course=course, design=design):
                usable = free.any(axis=1)
                v, free = v[usable], free[usable]
                fitted = course + loadings(v - course, free, design) @ design.T
                full = np.where(free, v, fitted)
                return {"n": np.array([len(v)]), "e": np.array([np.where(free, v - fitted, 0.0).ravel() @ np.where(free, v - fitted, 0.0).ravel()]), "s": full.sum(axis=0), "q": full.T @ full}

            got = summed(rows, years, {"n": (1,), "e": (1,), "s": (t,), "q": (t, t)}, fill)
            error = float(got["e"][0])
            if last - error <= tolerance * max(last, 1e-300) and np.isfinite(last):
                break
            last, m = error, int(got["n"][0])
            course = got["s"] / m
            design = _design(got["q"] / m - np.outer(course, course), n_factors)
        else:
            raise ValueError(f"the factors did not settle in {rounds} rounds")
    return Factors(years, course, design, error, turn, cv)


def gaps(rows: DataFrame, model: Factors) -> DataFrame:
    """unit, cluster, start, year, treated and gap (outcome less fit) of the seen cells of units that are treated at some time
    and seen before."""
    at, course, design = np.array(model.years), model.course, model.design

    def of(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if not len(batch):
                continue
            v, start, free = _matrix(batch, at)
            gap = v - course - loadings(v - course, free, design) @ design.T
            i, j = np.nonzero(~np.isnan(v) & free.any(axis=1)[:, None])
            rows_ = pa.array(i)
            yield pa.RecordBatch.from_arrays([batch.column("unit").take(rows_), batch.column("cluster").take(rows_), pa.array(start[i]), pa.array(at[j].astype(np.int32)), pa.array(~free[i, j]), pa.array(gap[i, j])], ["unit", "cluster", "start", "year", "treated", "gap"])

    kind = lambda c: rows.schema[c].dataType.simpleString()
    return rows.where("start IS NOT NULL").mapInArrow(of, f"unit {kind('unit')}, cluster {kind('cluster')}, start double, year int, treated boolean, gap double")


def mean_gaps(found: DataFrame) -> DataFrame:
    """Mean gap of treated cells by event time and over all, with the error of a mean by cluster that holds the factors."""
    t = found.where("treated").withColumn("event_time", (F.col("year") - F.col("start")).cast("int"))
    t = staged(t.select("event_time", "cluster", "gap").union(t.select(F.lit(None).cast("int"), "cluster", "gap")))
    mean = t.groupBy("event_time").agg(F.avg("gap").alias("estimate"), F.count("*").alias("n"))
    own = t.groupBy("event_time", "cluster").agg(F.sum("gap").alias("s"), F.count("*").alias("k"))
    met = own.alias("o").join(F.broadcast(mean).alias("m"), F.col("o.event_time").eqNullSafe(F.col("m.event_time")))  # a row an event time
    off = F.col("s") - F.col("k") * F.col("estimate")
    return met.groupBy("m.event_time", "estimate", "n").agg((F.sqrt(F.sum(off * off)) / F.first("n")).alias("se"), F.count("*").alias("n_clusters"))
