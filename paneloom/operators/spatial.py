"""Joins over coordinates: grid bins make them equi-joins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paneloom.functions.pixels import METRES_LAT, METRES_LON


def binned(df: DataFrame, lat: str, lon: str, degrees: float) -> DataFrame:
    return df.withColumns({"bin_y": F.floor(F.col(lat) / degrees), "bin_x": F.floor(F.col(lon) / degrees)})


def met_within(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """Pairs of ``left`` (.., lat_a, lon_a) and ``right`` (.., lat_b, lon_b), among them all that are ``metres`` apart or less in
    both directions: a row of ``right`` has one bin, one of ``left`` goes to each bin in reach.

    Bands are ``metres`` high; a band's bins are as wide in metres at its middle, so a row of ``left`` has some nine at any
    latitude. Both sides are shuffled: the planner doesn't see that one grows ninefold and would broadcast it whole.
    """
    high = metres / METRES_LAT
    wide = high / F.greatest(F.abs(F.cos(F.radians((F.col("bin_y") + 0.5) * high))), F.lit(high / 360))
    level = F.greatest(F.abs(F.cos(F.radians("lat_a"))) - math.radians(high), F.lit(1e-9))  # of any latitude in reach
    reach = F.least(F.lit(360.0), metres / METRES_LON / level) * (1 + 1e-9)
    up = high * (1 + 1e-9)
    cells = left.withColumn("bin_y", F.explode(F.sequence(F.floor((F.col("lat_a") - up) / high), F.floor((F.col("lat_a") + up) / high))))
    cells = cells.withColumn("bin_x", F.explode(F.sequence(F.floor((F.col("lon_a") - reach) / wide), F.floor((F.col("lon_a") + reach) / wide))))
    own = right.withColumn("bin_y", F.floor(F.col("lat_b") / high)).withColumn("bin_x", F.floor(F.col("lon_b") / wide))
    return cells.hint("merge").join(own, ["bin_y", "bin_x"])


def overlap_pairs(points: DataFrame, key: str, lat: str = "lat", lon: str = "lon", side: float = 10.0, least: float = 0.65) -> DataFrame:
    """Pairs (a, b), a < b, of squares of ``side`` metres that overlap by ``least`` of their area or more."""
    left = points.select(F.col(key).alias("a"), F.col(lat).alias("lat_a"), F.col(lon).alias("lon_a"))
    right = points.select(F.col(key).alias("b"), F.col(lat).alias("lat_b"), F.col(lon).alias("lon_b"))
    met = met_within(left, right, side).where("a < b")
    dx = F.abs(F.col("lon_a") - F.col("lon_b")) * METRES_LON * F.cos(F.radians((F.col("lat_a") + F.col("lat_b")) / 2))
    dy = F.abs(F.col("lat_a") - F.col("lat_b")) * METRES_LAT
    share = (1 - dx / side) * (1 - dy / side)
    return met.where((dx < side) & (dy < side)).withColumn("overlap", share).where(F.col("overlap") >= least).select("a", "b", "overlap")


def canonical_map(pairs: DataFrame, rank: DataFrame, staged) -> DataFrame:
    """(node, canonical): the lexicographically first independent set in order of ``rank`` (node, place; lower first).

    Each round takes the nodes that come before all their unassigned neighbours, and hands their neighbours over; every
    other node joins its first canonical neighbour. ``staged`` writes a small table and reads it again.
    """
    both = pairs.select("a", "b").union(pairs.select("b", "a")).toDF("u", "v")
    edges = staged(both.join(rank.toDF("u", "pu"), "u").join(rank.toDF("v", "pv"), "v"))
    left, taken = edges, None
    while not left.isEmpty():  # the first of all that are left always goes, so this ends
        first = staged(left.groupBy("u", "pu").agg(F.min("pv").alias("best")).where("pu < best").select("u"))
        beside = staged(left.join(first, "u", "left_semi").select(F.col("v").alias("u")).distinct())
        taken = beside if taken is None else taken.union(beside)
        gone = first.union(beside)
        left = staged(left.join(gone, "u", "left_anti").join(gone.withColumnRenamed("u", "v"), "v", "left_anti").select("u", "v", "pu", "pv"))
    if taken is None:
        return both.select(F.col("u").alias("node"), F.col("v").alias("canonical"))
    # who is beside no canonical node is one: also those whose neighbours have all left before their turn
    theirs = edges.join(taken, "u", "left_semi").join(taken.withColumnRenamed("u", "v"), "v", "left_anti")
    return theirs.groupBy("u").agg(F.min_by("v", "pv").alias("canonical")).select(F.col("u").alias("node"), "canonical")


def nearest(points: DataFrame, others: DataFrame, k: int, metres: float, key: str = "key", other_key: str = "other") -> DataFrame:
    """The ``k`` nearest of ``others`` (other_key, lat, lon) within ``metres`` of each point, ties by key."""
    left = points.select(key, F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"))
    right = others.select(other_key, F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    dx = (F.col("lon_a") - F.col("lon_b")) * METRES_LON * F.cos(F.radians("lat_a"))
    dy = (F.col("lat_a") - F.col("lat_b")) * METRES_LAT
    met = met_within(left, right, metres).withColumn("metres", F.sqrt(dx * dx + dy * dy)).where(F.col("metres") <= metres)
    order = Window.partitionBy(key).orderBy(F.round("metres", 6), other_key)
    return met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select(key, other_key, "metres", "place")


def nearest_exact(points: DataFrame, others: DataFrame, k: int, metres: float, staged, key: str = "key", other_key: str = "other") -> DataFrame:
    """As ``nearest`` without a bound: rows with fewer than k found (or than there are) are asked again with twice the radius,
    until it spans the earth."""
    out, left, k = None, points, min(k, others.count())
    while k and metres < 8e7:
        found = staged(nearest(left, others, k, metres, key, other_key))
        full = found.groupBy(key).count().where(F.col("count") >= k).select(key)
        done = found.join(full, key, "left_semi")
        out = done if out is None else out.union(done)
        left = staged(left.join(full, key, "left_anti"))
        metres *= 2
        if left.isEmpty():
            break
    return out if out is not None else nearest(points, others, 1, metres, key, other_key)


def in_polygon(points: DataFrame, edges: DataFrame, degrees: float = 0.01) -> DataFrame:
    """(key, polygon): points inside polygons given by their edges (polygon, x1, y1, x2, y2), holes included.

    A point meets the polygons whose bounding box lies over its bin; it is inside if a ray to the right crosses an odd
    number of edges.
    """
    boxes = edges.groupBy("polygon").agg(F.min("x1").alias("x_min"), F.max("x1").alias("x_max"), F.min("y1").alias("y_min"), F.max("y1").alias("y_max"))
    cells = boxes.select(
        "polygon", "x_min", "x_max", "y_min", "y_max", F.explode(F.sequence(F.floor(F.col("y_min") / degrees), F.floor(F.col("y_max") / degrees))).alias("bin_y")
    ).select("*", F.explode(F.sequence(F.floor(F.col("x_min") / degrees), F.floor(F.col("x_max") / degrees))).alias("bin_x"))
    near = binned(points.select("key", "lat", "lon"), "lat", "lon", degrees).join(cells, ["bin_y", "bin_x"])
    near = near.where(F.col("lat").between(F.col("y_min"), F.col("y_max")) & F.col("lon").between(F.col("x_min"), F.col("x_max"))).select("key", "lat", "lon", "polygon")
    crosses = ((F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))) & (F.col("lon") < (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) + F.col("x1"))
    hits = near.join(edges, "polygon").groupBy("key", "polygon").agg(F.sum(crosses.cast("int")).alias("n"))
    return hits.where("n % 2 = 1").select("key", "polygon")


def shoelace(ring: str):
    """Area and centroid of a ring, an array of structs (x, y)."""
    pairs = f"transform(sequence(0, size({ring}) - 1), i -> struct({ring}[i].x as x1, {ring}[i].y as y1, {ring}[(i + 1) % size({ring})].x as x2, {ring}[(i + 1) % size({ring})].y as y2))"
    total = lambda what: f"aggregate({pairs}, cast(0 as double), (a, p) -> a + {what})"
    twice = total("(p.x1 * p.y2 - p.x2 * p.y1)")
    return (
        F.expr(f"abs({twice}) / 2"),
        F.expr(f"{total('(p.x1 + p.x2) * (p.x1 * p.y2 - p.x2 * p.y1)')} / (3 * {twice})"),
        F.expr(f"{total('(p.y1 + p.y2) * (p.x1 * p.y2 - p.x2 * p.y1)')} / (3 * {twice})"),
    )


EQUATOR_METRES = 2 * math.pi * 6_371_000
