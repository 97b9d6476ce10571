"""Marker clusters by radius, zoom by zoom: each zoom clusters the markers of the one below it.

The markers of a zoom are taken largest first (ties by id): one that is within
the radius of an earlier centre joins the first such, any other is a centre. As
markers of the zoom below are apart, each has few neighbours, and the order is
kept in rounds: a marker is a centre once no earlier one nearby is undecided.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlake.operators.graph import written

TILE = 256
#: Beyond it the map's projection ends.
MOST_LAT = 85.0511287798


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Place on the map of the whole world, from 0 to 1 east and south."""
    s = F.sin(F.radians(F.greatest(F.least(lat, F.lit(MOST_LAT)), F.lit(-MOST_LAT))))
    return (lon + 180) / 360, 0.5 - F.log((1 + s) / (1 - s)) / (4 * math.pi)


def _neighbours(m: DataFrame, radius: float) -> DataFrame:
    """id and earlier: pairs of markers within the radius, by cells of its size and a ring around them."""
    m = m.select("id", "x", "y", "rank", F.floor(F.col("x") / radius).alias("cx"), F.floor(F.col("y") / radius).alias("cy"))
    step = lambda: F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)]))
    ring = m.withColumn("dx", step()).withColumn("dy", step()).withColumns({"cx": F.col("cx") + F.col("dx"), "cy": F.col("cy") + F.col("dy")}).alias("a")
    met = ring.join(m.alias("b"), [F.col("a.cx") == F.col("b.cx"), F.col("a.cy") == F.col("b.cy")])
    near = F.pow(F.col("a.x") - F.col("b.x"), 2) + F.pow(F.col("a.y") - F.col("b.y"), 2) <= radius * radius
    return met.where(near & (F.col("a.rank") > F.col("b.rank"))).select(F.col("a.id").alias("id"), F.col("b.id").alias("earlier"), F.col("b.rank").alias("earlier_rank"))


def _centres(m: DataFrame, radius: float) -> DataFrame:
    """id and centre of every marker."""
    pairs = written(_neighbours(m, radius))
    state = written(m.select("id", F.lit(None).cast("string").alias("centre")))
    while True:
        undecided = state.where("centre is null").select("id")
        waits = pairs.join(undecided, "id", "left_semi").join(undecided.withColumnRenamed("id", "earlier"), "earlier", "left_semi").select("id").distinct()
        centres = state.where("id = centre").select(F.col("id").alias("earlier"))
        joins = pairs.join(centres, "earlier", "left_semi").groupBy("id").agg(F.min_by("earlier", "earlier_rank").alias("first"))
        # A marker is told when nothing earlier nearby is open: it joins the first centre among these, or is one.
        told = undecided.join(waits, "id", "left_anti").join(joins, "id", "left").select("id", F.coalesce("first", "id").alias("now"))
        if told.isEmpty():
            return state
        state = written(state.join(told, "id", "left").select("id", F.coalesce("centre", "now").alias("centre")))


def pyramid(points: DataFrame, ident: str, zooms: range, radius_px: float = 60.0) -> DataFrame:
    """zoom, id (of the centre), lon, lat, n (points in it) and parent (its centre on the next coarser zoom) of all markers.

    ``points`` has a string ``ident``, lon and lat; those without a place are left
    out. Below the finest zoom points are put together by cells of half its
    radius, so that no place, however many points it has, is more than one marker.
    Markers do not join over the date line, as the map does not.
    """
    x, y = mercator(F.col("lon"), F.col("lat"))
    finest = max(zooms)
    unit = radius_px / (TILE * 2**finest) / 2
    d = points.where("lon is not null and lat is not null").select(F.col(ident).cast("string").alias("id"), "lon", "lat", x.alias("x"), y.alias("y"))
    cell = d.withColumns({"cx": F.floor(F.col("x") / unit), "cy": F.floor(F.col("y") / unit)})
    markers = cell.groupBy("cx", "cy").agg(F.min(F.struct("id", "lon", "lat", "x", "y")).alias("m"), F.count(F.lit(1)).alias("n")).select("m.*", "n")
    out, below = None, None
    for zoom in sorted(zooms, reverse=True):
        m = written(markers.withColumn("rank", F.struct((-F.col("n")).alias("a"), F.col("id").cast("string").alias("b"))))
        found = _centres(m, radius_px / (TILE * 2**zoom))
        held = m.join(found, "id")
        sums = held.groupBy("centre").agg(F.sum("n").alias("n"))
        markers = written(m.drop("n", "rank").join(sums.withColumnRenamed("centre", "id"), "id"))
        if below is not None:
            done = below.join(found.withColumnRenamed("centre", "parent"), "id").select("zoom", "id", "lon", "lat", "n", "parent")
            out = done if out is None else out.union(done)
        below = markers.select(F.lit(zoom).alias("zoom"), "id", "lon", "lat", "n")
    top = below.withColumn("parent", F.lit(None).cast("string"))
    return top if out is None else out.union(top)
