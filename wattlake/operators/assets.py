"""Duplicate demand assets: shared ids and near matches, their groups, and one asset per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlake.functions import vocabulary as V
from wattlake.functions.scalars import expand_aliases, external_ids, haversine_km, log_band, name_signature
from wattlake.operators.graph import connected_components, written
from wattlake.operators.plants import key_normalize_text, union_of
from wattlake.operators.relational import blocked_pairs

DISTANCE_KM, LEAST_RATIO, MOST_RATIO = 50.0, 0.8, 1.25


def asset_edges(assets: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """src and dst of assets that share an external id, or match in all but small things.

    ``aliases`` (spelling to name) are applied to whole words of operators and names.

    ``assets``: id, name, operator, country, category, target_year, mw, lon, lat,
    external_ids. A match has the same country, category, operator and name, lies
    within 50 km, a year apart at most, with 0.8 to 1.25 of the capacity. Year,
    capacity and place are needed; without them only ids tell. Assets alike in
    all of this are joined to the first of them, and only the first ones meet,
    in neighbouring cells, years and bands: copies cost no pairs.
    """
    ids = assets.select("id", F.explode(external_ids(F.col("external_ids"))).alias("namespace", "value"))
    first = ids.groupBy("namespace", "value").agg(F.min("id").alias("first"))
    exact = ids.join(first, ["namespace", "value"]).where("id <> first").select(F.col("id").alias("src"), F.col("first").alias("dst"))
    blank = lambda c: F.nullif(c, F.lit(""))
    known = {key_normalize_text(k): key_normalize_text(v) for k, v in (aliases or {}).items()}
    keyed = assets.select("id", "country", "category", blank(expand_aliases(F.col("operator"), known)).alias("operator"), blank(name_signature(expand_aliases(F.col("name"), known), distinct=False)).alias("signature"), "target_year", "mw", "lon", "lat").dropna()
    same = written(keyed.groupBy("country", "category", "operator", "signature", "target_year", "mw", "lon", "lat").agg(F.min("id").alias("first"), F.count("*").alias("rows")))
    copies = keyed.join(same.where("rows > 1").drop("rows"), [c for c in keyed.columns if c != "id"]).where("id <> first").select(F.col("id").alias("src"), F.col("first").alias("dst"))
    cells = same.drop("rows").withColumnRenamed("first", "id").withColumns({"cx": F.floor("lon").cast("long"), "cy": F.floor("lat").cast("long"), "band": log_band(F.col("mw"), 1.25)})
    a, b = lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}")
    ratio = F.when((a("mw") == 0) | (b("mw") == 0), F.lit(True)).otherwise((F.try_divide(a("mw"), b("mw"))).between(LEAST_RATIO, MOST_RATIO))
    close = haversine_km(a("lon"), a("lat"), b("lon"), b("lat")) <= DISTANCE_KM
    met = blocked_pairs(cells, "id", ["country", "category", "operator", "signature"], {"cx": 1, "cy": 1, "target_year": 1, "band": 1}, close & ratio)
    return exact.union(copies).union(met.select(a("id").alias("src"), b("id").alias("dst")))


def dedupe_assets(assets: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """One asset per group of duplicates: its smallest id, by field the value of the best source, then precision, aliases and sources united.

    Besides what ``asset_edges`` needs: source_type, location_precision, source_ids.
    """
    numbered = written(assets.withColumn("node", F.xxhash64("id")))
    edges = asset_edges(numbered.drop("node"), aliases).select(F.xxhash64("src").alias("src"), F.xxhash64("dst").alias("dst"))
    placed = numbered.join(connected_components(edges), "node", "left").withColumn("component", F.coalesce("component", "node"))
    order = lambda c: F.when(F.col(c).isNotNull(), F.struct(V.rank(F.col("source_type"), V.SOURCE_RANK), V.rank(F.col("location_precision"), V.PRECISION_RANK, -1), F.col("id")))
    plain = [F.max_by(c, order(c)).alias(c) for c in ("name", "operator", "country", "category", "target_year", "mw", "source_type")]
    place = F.max_by(F.struct("lon", "lat", "location_precision"), F.when(F.col("lon").isNotNull(), F.struct(V.rank(F.col("location_precision"), V.PRECISION_RANK, -1), V.rank(F.col("source_type"), V.SOURCE_RANK), F.col("id")))).alias("place")
    out = placed.groupBy("component").agg(F.min("id").alias("_id"), F.array_sort(F.collect_set("id")).alias("_ids"), *plain, place, union_of(F.col("source_ids")).alias("source_ids"))
    return out.select(F.col("_id").alias("id"), "name", "operator", "country", "category", "target_year", "mw", "place.lon", "place.lat", "place.location_precision", "source_type", "source_ids", F.array_remove("_ids", F.col("_id")).alias("aliases"))
