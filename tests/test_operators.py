"""Operators on small cases with nulls, ties, repeated rows and empty tables."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneloom.functions.calendar import parsed_date
from paneloom.functions.pixels import no_data, pixel_id, ring_of
from paneloom.operators import dedup, joins, report, spatial, timing
from paneloom.sources.exports import file_keys, resolved_headers
from paneloom.sources.staging import staged


def test_rings_and_missing_values(spark):
    cases = [("Buffer_2", 2), ("0", 0), ("4.995", 5), ("-1 km", -1), ("6", -1), ("none", -1), (None, -1), ("3.5", -1)]
    got = spark.createDataFrame([(a,) for a, _ in cases], "v string").select(ring_of("v").alias("r")).collect()
    assert [r.r for r in got] == [b for _, b in cases]
    values = [0.0, -9999.0, -10.0, -3.0, float("nan"), float("inf"), None, 5.0]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(no_data("v").alias("k"), no_data("v", negatives="floor").alias("f"), no_data("v", negatives="missing").alias("m")).collect()
    assert [r.k for r in got] == [None, None, None, -3.0, None, None, None, 5.0]
    assert [r.f for r in got][3] == 0.0 and [r.m for r in got][3] is None


def test_pixel_ids_round_to_even(spark):
    r = spark.sql("SELECT 15.000005D AS a, 75.0D AS b").select(pixel_id("a", "b").alias("p")).first().p
    assert len(str(r)) == 17 or len(str(r)) == 18
    assert r == int(round((15.000005 + 90) * 1e5)) * 10**9 + 25_500_000


def test_dates(spark):
    got = spark.createDataFrame([("2020-02-29",), ("29/02/2020",), ("43890",), ("x",), (None,), ("31/02/2020",)], "t string").select(parsed_date("t").cast("string").alias("d")).collect()
    assert [r.d for r in got] == ["2020-02-29", "2020-02-29", "2020-02-29", None, None, None]


def test_deduplication_order(spark):
    rows = [(1, 100.0, None, 5, "a"), (1, 100.5, 1.0, 3, "b"), (1, 100.2, 2.0, 9, "c"), (1, 10.0, 3.0, 99, "d"), (2, 1.0, None, None, "x"), (2, 1.0, None, None, "x")]
    df = spark.createDataFrame(rows, "key int, mtime double, y double, n int, src string")
    kept = {r.key: r.src for r in dedup.deduplicated(df, ["key"], ["y"], "mtime", "n", "src").collect()}
    assert kept == {1: "c", 2: "x"}
    whole = {r.key: r.src for r in dedup.deduplicated(df, ["key"], ["y"], "mtime", "n", "src", priority="complete").collect()}
    assert whole[1] == "c"
    assert {r.key: r.kind for r in dedup.classified(df, ["key"], ["y"]).collect()} == {1: "conflicting", 2: "redundant"}
    assert dedup.deduplicated(df.limit(0), ["key"], ["y"], "mtime", "n", "src").count() == 0


def test_canonical_map_is_the_greedy_one(spark):
    rng = random.Random(1)
    for _ in range(4):
        n = 14
        edges = [(a, b) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.18]
        if not edges:
            continue
        place = list(range(n))
        rng.shuffle(place)
        near = {i: {b for a, b in edges if a == i} | {a for a, b in edges if b == i} for i in range(n)}
        chosen, want = [], {}
        for i in sorted(range(n), key=lambda i: place[i]):
            if not near[i] & set(chosen):
                chosen.append(i)
        for i in range(n):
            if i not in chosen:
                want[i] = min(near[i] & set(chosen), key=lambda j: place[j])
        got = spatial.canonical_map(spark.createDataFrame(edges, "a int, b int"), spark.createDataFrame(list(enumerate(place)), "node int, place int"), staged)
        assert {r.node: r.canonical for r in got.collect()} == want


def test_as_of_and_fuzzy(spark):
    left = spark.createDataFrame([(1, "k", 5), (2, "k", 2), (3, "k", 1), (4, "z", 9)], "id int, k string, at int")
    series = spark.createDataFrame([("k", 2, 20.0), ("k", 5, 50.0), ("k", 7, 70.0)], "k string, t int, v double")
    got = {r.id: r.v for r in joins.as_of(left, series, "k", "at", "t", "v").collect()}
    assert got == {1: 50.0, 2: 20.0, 3: None, 4: None}
    names = spark.createDataFrame([("Koppal!",), ("Kopal",), ("zzz",)], "name string")
    found = {r.name: r.match for r in joins.fuzzy_names(names, spark.createDataFrame([("koppal",), ("Raichur",)], "name string")).collect()}
    assert found == {"Koppal!": "koppal", "Kopal": "koppal", "zzz": None}


def test_polygon_with_a_hole(spark):
    ring = lambda p, x0, y0, x1, y1: [(p, x0, y0, x1, y0), (p, x1, y0, x1, y1), (p, x1, y1, x0, y1), (p, x0, y1, x0, y0)]
    edges = spark.createDataFrame(ring(1, 0.0, 0.0, 1.0, 1.0) + ring(1, 0.4, 0.4, 0.6, 0.6), "polygon int, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(1, 0.2, 0.2), (2, 0.5, 0.5), (3, 1.5, 0.5), (4, 0.9, 0.95)], "key int, lat double, lon double")
    assert {r.key for r in spatial.in_polygon(points, edges, 0.1).collect()} == {1, 4}


def test_start_month_backcast(spark):
    fund = spark.createDataFrame([(1, 100 + m, 30.0 + 10 * m, 1000.0) for m in range(12)], "site_id int, month int, amount double, target double")
    r = timing.start_month(fund).first()
    assert (r.start_month, r.months_back, r.censored) == (98, 3, True)


def test_file_keys_and_headers(spark):
    names = ["CSV_Site1_2019_Kharif_tile3_sub1.csv", "export rabi 2020.csv", "2019_vs_2020 zaid.csv", "notes.csv", None]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(file_keys("n").alias("k")).collect()
    assert [(r.k.site, r.k.year, r.k.season) for r in got] == [("site1", 2019, 1), (None, 2020, 2), (None, None, 3), (None, None, None), (None, None, None)]
    h = spark.createDataFrame([(x,) for x in ("LAT", "NDVI_mean", "NDVI_sd", "Latitud", "remark", "Rain (mm)")], "header string")
    found = {r.header: (r.canonical, r.rule) for r in resolved_headers(h).collect()}
    assert found["LAT"] == ("latitude", "alias") and found["NDVI_sd"] == (None, "statistic") and found["Latitud"][0] == "latitude" and found["remark"] == (None, "unresolved")
    assert found["NDVI_mean"] == ("NDVI", "ending") and found["Rain (mm)"] == ("Rain", "ending")


def test_nearest_without_a_bound(spark):
    pts = spark.createDataFrame([(i, 10 + i * 1e-4, 20.0) for i in range(20)], "key int, lat double, lon double")
    far = pts.withColumnRenamed("key", "other").where(F.col("other") % 9 == 0)
    got = {r.key: r.other for r in spatial.nearest_exact(pts, far, 1, 5.0, staged).collect()}
    assert got == {i: min((0, 9, 18), key=lambda j: (abs(i - j), j)) for i in range(20)}


def test_nearest_at_any_latitude(spark):
    """As by hand up to the poles, where bins of equal degrees lost neighbours; no side is broadcast."""
    rows = [(i, lat, lon) for i, (lat, lon) in enumerate((lat + dy * 3e-5, 20 + dx * 3e-5) for lat in (0.0, 15.0, 62.0, 75.0, 89.5, -80.0, 90.0) for dy in range(3) for dx in range(6))]
    pts = spark.createDataFrame(rows, "key int, lat double, lon double")
    near = spatial.nearest(pts, pts.withColumnRenamed("key", "other"), 1000, 10.0)
    apart = lambda a, b: np.hypot((a[2] - b[2]) * spatial.METRES_LON * np.cos(np.radians(a[1])), (a[1] - b[1]) * spatial.METRES_LAT)
    assert {(r.key, r.other) for r in near.collect()} == {(a[0], b[0]) for a in rows for b in rows if apart(a, b) <= 10.0}
    pairs = spatial.overlap_pairs(pts, "key", least=0.05)
    share = lambda a, b: (1 - abs(a[2] - b[2]) * spatial.METRES_LON * np.cos(np.radians((a[1] + b[1]) / 2)) / 10) * (1 - abs(a[1] - b[1]) * spatial.METRES_LAT / 10)
    sure = lambda a, b: a[0] < b[0] and abs(a[1] - b[1]) * spatial.METRES_LAT < 10 and abs(a[2] - b[2]) * spatial.METRES_LON * np.cos(np.radians((a[1] + b[1]) / 2)) < 10 and share(a, b) >= 0.05
    assert {(r.a, r.b) for r in pairs.collect()} == {(a[0], b[0]) for a in rows for b in rows if sure(a, b)}
    for df in (near, pairs):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_long_chains_settle(spark):
    """A strip of 120 squares in order of rank, and a chain of 100 names."""
    strip = spark.createDataFrame([(i, i + 1) for i in range(119)], "a int, b int")
    got = {r.node: r.canonical for r in spatial.canonical_map(strip, spark.range(120).selectExpr("int(id) AS node", "struct(id) AS place"), staged).collect()}
    assert got == {i: i - 1 for i in range(1, 120, 2)}
    chain = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(99)], "a string, b string")
    names = spark.createDataFrame([(f"n{i:03}",) for i in range(100)] + [("other",)], "name string")
    from paneloom.operators import joins

    got = {r.name: r.cluster for r in joins.name_clusters(chain, names, staged).collect()}
    assert got == {f"n{i:03}": "n000" for i in range(100)} | {"other": "other"}


def test_dates_between_their_neighbours(spark):
    from paneloom.operators import panel

    rows = [("a", 1, "13/01/2019"), ("a", 2, "02/03/2019"), ("a", 3, "20/02/2019"), ("b", 1, "05/06/2019"), ("c", 1, "31/12/2018"), ("c", 2, "04/05/2019"), ("c", 3, "25/05/2019")]
    got = {(r.g, r.v): (str(r.date), r.read) for r in panel.dates_in_order(spark.createDataFrame(rows, "g string, v int, t string"), "g", "v", "t").collect()}
    assert got["a", 2] == ("2019-02-03", "month first") and got["b", 1] == ("2019-06-05", "open") and got["c", 2] == ("2019-05-04", "open")


def test_statuses_and_strict_checks(spark):
    rows = spark.createDataFrame([("a", 1.0, 0.5), ("b", None, 1.0), ("c", 1.0, None), ("d", 1.0, 0.0), ("e", 1.0, 0.1), ("f", float("nan"), 1.0)], "m string, estimate double, se double")
    design = spark.createDataFrame([("a", 0.6), ("e", 0.9)], "m string, se double")
    got = {r.m: r.status for r in report.statuses(rows, design, ["m"]).collect()}
    assert got == {"a": "ok", "b": "failed", "c": "no se", "d": "se of zero", "e": "se far below the design's", "f": "failed"}
    sample = spark.createDataFrame([("u", 1, 0, 1.0), ("u", 1, 1, 5.0), ("v", 0, 0, -999.0)], "unit string, treatment int, post int, y double")
    checks = report.preflight(sample, "y", 0, 10)
    assert {r.check: r.n for r in checks.collect()} == {"one side only": 1, "singletons": 1, "out of bounds": 1, "no-data codes": 1, "empty cells": 1}
    report.require(checks, [])
    with pytest.raises(ValueError):
        report.require(checks, ["singletons"])


def test_location_facts_keep_the_pixel_with_more_rows(spark):
    rows = spark.createDataFrame([(1, 10, 0, True)] * 2 + [(1, 11, 0, True)] * 3 + [(1, 12, 1, True), (1, 12, 2, True), (2, 12, 1, False)], "site_id int, pixel_id int, buff_km int, inside boolean")
    points = spark.createDataFrame([(10, 15.0, 75.0), (11, 15.00001, 75.0), (12, 15.1, 75.0)], "pixel_id int, lat double, lon double")
    got = {(r.site_id, r.pixel_id): (r.n_rows, r.n_own, r.ring_conflict, r.kept_pixel) for r in report.location_facts(rows, points).collect()}
    assert got == {(1, 10): (2, 2, False, 11), (1, 11): (3, 3, False, None), (1, 12): (2, 2, True, None), (2, 12): (1, 0, False, None)}


def test_results_lacking_columns_are_collected(spark):
    got = report.collected({"a": spark.createDataFrame([("y", 1.0)], "outcome string, estimate double"), "b": spark.createDataFrame([(2.0, 0.5)], "estimate double, se double")}, "s").orderBy("model").collect()
    assert [(r.model, r.outcome, r.scenario, r.estimate, r.se, r.n_obs) for r in got] == [("a", "y", "s", 1.0, None, None), ("b", None, "s", 2.0, 0.5, None)]


@pytest.mark.parametrize("least", [0.3, 0.45, 0.8, 1.0])
def test_similar_pairs_are_all_pairs(spark, least):
    rng = random.Random(7)
    names = sorted({"".join(rng.choice("abcABeé ") for _ in range(rng.randrange(0, 9))) for _ in range(90)} | {"Nation_1", "NATION_12", "nation"})
    df = spark.createDataFrame([(n,) for n in [*names, None, names[3]]], "name string").repartition(3)
    near = spark.createDataFrame(list(itertools.combinations(names, 2)), "a string, b string").where(joins.similarity(F.lower("a"), F.lower("b")) >= least)
    got = {tuple(r) for r in joins.similar_pairs(df, least=least).collect()}
    assert got == {(min(r), max(r)) for r in near.collect()} and (got or least == 1.0)
