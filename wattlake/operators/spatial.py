"""What is built on containment: assignment to regions and countries, views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlake.operators.cover import contains
from wattlake.operators.relational import best_match


def assign_region(assets: DataFrame, ident: str, regions: DataFrame, geo: str = "region_id", equal: Sequence[str] = ()) -> DataFrame:
    """``assets`` with ``geography_id``: the finest region that holds an exactly located asset, else what it had.

    ``regions`` has geo, level, parent_id and polygons; of several the highest
    level, then parent and id, counts. Assets with a rough location keep theirs.
    """
    exact = assets.where((F.col("location_precision") == "exact") & F.col("lon").isNotNull())
    found = contains(exact, ident, regions, geo, equal=equal).join(regions.select(geo, "level", "parent_id"), geo)
    best = best_match(found, [ident], [F.desc("level"), F.asc_nulls_first("parent_id"), F.col(geo)])
    joined = assets.drop("_found").join(best.select(ident, F.col(geo).alias("_found")), ident, "left")
    return joined.withColumn("geography_id", F.coalesce("_found", "geography_id")).drop("_found")


def assign_country(assets: DataFrame, ident: str, countries: DataFrame, geo: str = "iso2") -> DataFrame:
    """``assets`` with ``country``: by the polygon around the coordinates; without coordinates as declared, with ones in no polygon none."""
    found = contains(assets, ident, countries, geo).groupBy(ident).agg(F.min(geo).alias("_country"))
    joined = assets.join(found, ident, "left")
    return joined.withColumn("country", F.when(F.col("lon").isNull() | F.col("lat").isNull(), F.col("country")).otherwise(F.col("_country"))).drop("_country")


def merge_geometries(features: DataFrame, key: str, polygons: str = "polygons") -> DataFrame:
    """One row per key with all its features' polygons."""
    return features.groupBy(key).agg(F.flatten(F.collect_list(polygons)).alias("polygons"))


def in_view(index: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Rows of a country index (west, south, east, north) whose box meets the view; both may cross the 180th meridian."""

    def pieces(a: Column, b: Column) -> Column:
        turn = lambda x: F.pmod(x + 180, F.lit(360.0)) - 180
        span = F.when(b - a < 0, F.pmod(b - a, F.lit(360.0))).otherwise(b - a)
        start, end = turn(a), turn(a) + span
        piece = lambda x, y: F.struct(x.alias("a"), y.alias("z"))
        whole = F.array(piece(F.lit(-180.0), F.lit(180.0)))
        return F.when(F.abs(b - a) >= 360, whole).when(end <= 180, F.array(piece(start, end))).otherwise(F.array(piece(start, F.lit(180.0)), piece(F.lit(-180.0), end - 360)))

    view = pieces(F.lit(float(west)), F.lit(float(east)))
    meets = F.exists(pieces(F.col("west").cast("double"), F.col("east").cast("double")), lambda c: F.exists(view, lambda v: (c["z"] >= v["a"]) & (c["a"] <= v["z"])))
    return index.where((F.col("north") >= south) & (F.col("south") <= north) & meets)
