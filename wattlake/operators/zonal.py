"""Sums of raster cells in polygons by scanlines: rows of cell centres cut polygons into runs of columns.

An edge is met only by the rows that it spans. A row's crossings in order give
runs of columns; runs meet the raster by row and tile of columns: tiles that lie
wholly in a run give their totals, only the tiles at its ends their cells. No
cell is held against an edge.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattlake.operators.relational import money

TOUCH = 1e-9
TILE = 64


class Grid(NamedTuple):
    """Centres of a raster: column c is at lon + c * dlon, row r at lat + r * dlat."""

    lon: float = 0.0
    lat: float = 0.0
    dlon: float = 1.0
    dlat: float = 1.0

    def column(self, lon: Column) -> Column:
        return (lon - self.lon) / self.dlon

    def row(self, lat: Column) -> Column:
        return (lat - self.lat) / self.dlat


def edges_of(polygons: DataFrame, geo: str, shape: str = "polygons") -> DataFrame:
    """geo, part and the ends of every ring's edges; rings need not be closed."""
    parts = polygons.select(geo, F.posexplode(shape).alias("part", "rings"))
    rings = parts.select(geo, "part", F.explode("rings").alias("ring"))
    ends = rings.select(geo, "part", F.explode(F.arrays_zip(F.col("ring").alias("a"), F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1)).alias("b"))).alias("e"))
    at = lambda side, i: F.col(f"e.{side}")[i]
    return ends.select(geo, "part", at("a", 0).alias("x1"), at("a", 1).alias("y1"), at("b", 0).alias("x2"), at("b", 1).alias("y2")).where("x1 <> x2 or y1 <> y2")


def runs(polygons: DataFrame, geo: str, grid: Grid, shape: str = "polygons") -> DataFrame:
    """geo, row, first, last: the columns whose centres lie in a polygon or on its outline, each once however many parts hold it."""
    a, b = grid.row(F.col("y1")), grid.row(F.col("y2"))
    low, high = F.ceil(F.least(a, b) - TOUCH), F.floor(F.greatest(a, b) + TOUCH)
    met = edges_of(polygons, geo, shape).withColumns({"low": low, "high": high}).where("low <= high").withColumn("row", F.explode(F.sequence("low", "high")))
    met = met.withColumn("y", F.lit(grid.lat) + F.col("row") * grid.dlat)
    over = (F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))
    at = F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
    crossed = met.where(over).groupBy(geo, "part", "row").agg(F.sort_array(F.collect_list(at)).alias("xs"))  # the crossings of one row
    inner = crossed.select(geo, "row", F.explode(F.transform(F.sequence(F.lit(0), (F.size("xs") / 2).cast("int") - 1), lambda k: F.struct(F.col("xs")[2 * k].alias("west"), F.col("xs")[2 * k + 1].alias("east")))).alias("r")).select(geo, "row", "r.*")
    # What lies on the outline: edges along the row, and corners.
    on = lambda y: F.abs(F.col(y) - F.col("y")) < TOUCH
    along = met.where(on("y1") & on("y2")).select(geo, "row", F.least("x1", "x2").alias("west"), F.greatest("x1", "x2").alias("east"))
    corner = met.where(on("y1")).select(geo, "row", F.col("x1").alias("west"), F.col("x1").alias("east"))
    spans = inner.union(along).union(corner).select(geo, "row", F.ceil(grid.column(F.col("west")) - TOUCH).alias("first"), F.floor(grid.column(F.col("east")) + TOUCH).alias("last")).where("first <= last")
    # Spans of a row that overlap or follow on each other are one run.
    order = Window.partitionBy(geo, "row").orderBy("first", "last")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("new", (F.coalesce(before, F.lit(-(1 << 62))) + 1 < F.col("first")).cast("int")).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return opened.groupBy(geo, "row", "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")


def zonal_totals(cells: DataFrame, polygons: DataFrame, geo: str, grid: Grid, value: str, valid: str, by: Sequence[str] = ()) -> DataFrame:
    """geo, ``by``, total, selected, known: exact sum of the valid cells whose centre lies in a polygon, and counts of all and of valid ones.

    ``cells`` has lon and lat of centres of ``grid``, a value and whether it is valid. A polygon without a cell has no row.
    """
    ok = F.coalesce(F.col(valid), F.lit(False)) & F.col(value).isNotNull()
    column, row = F.round(grid.column(F.col("lon"))).cast("long"), F.round(grid.row(F.col("lat"))).cast("long")
    placed = cells.where("lon is not null and lat is not null").select(row.alias("row"), column.alias("col"), *by, F.when(ok, money(F.col(value))).alias("v"), ok.cast("long").alias("ok")).withColumn("tile", F.floor(F.col("col") / TILE))
    held = runs(polygons, geo, grid).withColumn("tile", F.explode(F.sequence(F.floor(F.col("first") / TILE), F.floor(F.col("last") / TILE))))
    full = (F.col("first") <= F.col("tile") * TILE) & (F.col("last") >= F.col("tile") * TILE + TILE - 1)
    sums = placed.groupBy("row", "tile", *by).agg(F.sum("v").cast("decimal(38,6)").alias("v"), F.count("*").alias("n"), F.sum("ok").alias("ok"))
    whole = held.where(full).join(sums, ["row", "tile"]).select(geo, *by, "v", "n", "ok")
    ends = held.where(~full).join(placed, ["row", "tile"]).where("col between first and last").select(geo, *by, F.col("v").cast("decimal(38,6)").alias("v"), F.lit(1).cast("long").alias("n"), "ok")
    return whole.union(ends).groupBy(geo, *by).agg(F.sum("v").cast("double").alias("total"), F.sum("n").alias("selected"), F.sum("ok").alias("known"))


def zonal_sum(cells: DataFrame, polygons: DataFrame, geo: str, grid: Grid, value: str, valid: str) -> DataFrame:
    """Per polygon: the sum of valid cells whose centre lies in it, how many are selected and what share of them is valid."""
    found = zonal_totals(cells, polygons, geo, grid, value, valid)
    return found.select(geo, "total", "selected", F.round(100.0 * F.col("known") / F.col("selected"), 4).alias("coverage"))


def regional_population(cells: DataFrame, regions: DataFrame, geo: str, grid: Grid, years: Sequence[int], value: str = "value", valid: str = "valid") -> DataFrame:
    """Population of every region and year from that year's raster (``year`` on cells; one year's cells stand for all if only it has any).

    A region without a selected or without a valid cell is unavailable, and says why.
    """
    only = cells.agg(F.count_distinct("year").alias("n"), F.min("year").alias("y")).first()
    source = F.lit(only["y"]) if only["n"] == 1 else F.col("year")
    wanted = regions.select(geo, F.explode(F.array(*[F.lit(y) for y in years])).alias("year")).withColumn("source_year", source.cast("int"))
    sums = zonal_totals(cells.withColumn("source_year", F.col("year").cast("int")), regions, geo, grid, value, valid, ["source_year"])
    joined = wanted.join(sums, [geo, "source_year"], "left")
    reason = F.when(F.col("selected").isNull(), "no_cell_centre_inside").when(F.col("known") == 0, "no_valid_cell")
    return joined.select(geo, "year", "source_year", F.col("total").alias("population"), F.round(100.0 * F.col("known") / F.col("selected"), 4).alias("coverage"), reason.alias("unavailable"))
