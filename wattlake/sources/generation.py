"""The public database of power plants: its records from a list, a wrapped list or features, typed or refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattlake.functions import scalars as S
from wattlake.functions import vocabulary as V
from wattlake.sources.feeds import floor

SOURCE_ID, LICENCE = "wri-global-power-plant-database", "CC-BY-4.0"
#: Fixed value: a release with fewer records is broken.
LEAST_RECORDS = 30_000
MOST_MW = 100_000

# Fuels of the database, and the first of these words that a fuel contains.
FUELS = {
    "photovoltaic": "solar",
    "solar": "solar",
    "onshore wind": "wind",
    "offshore wind": "wind",
    "wind": "wind",
    "hydro": "hydro",
    "hydroelectric": "hydro",
    "nuclear": "nuclear",
    "ccgt": "gas",
    "ocgt": "gas",
    "gas": "gas",
    "natural gas": "gas",
    "coal": "coal",
    "oil": "oil",
    "petroleum": "oil",
    "biomass": "biomass",
    "geothermal": "geothermal",
}
# Statuses of the database.
STATUSES = {
    "operating": "operational",
    "operational": "operational",
    "construction": "under_construction",
    "under construction": "under_construction",
    "pre construction": "announced",
    "planned": "announced",
    "retired": "retired",
    "cancelled": "cancelled",
    "canceled": "cancelled",
    "shelved": "shelved",
}


def database_rows(spark: SparkSession, path: str) -> DataFrame:
    """``row`` (name to text) and ``geometry`` (JSON, of features) of a release: a list, ``data``, or ``features``; anything else raises."""
    raw = spark.read.text(path, wholetext=True)
    at = lambda p: F.get_json_object("value", p)
    plain = lambda text: F.transform(F.from_json(text, "array<map<string,string>>"), lambda r: F.struct(r.alias("row"), F.lit(None).cast("string").alias("geometry")))
    features = F.transform(F.from_json(at("$.features"), "array<struct<properties:map<string,string>,geometry:string>>"), lambda f: F.struct(F.coalesce(f["properties"], F.raise_error(F.lit("a feature lacks properties")).cast("map<string,string>")).alias("row"), f["geometry"].alias("geometry")))
    is_list = F.ltrim("value").startswith("[")
    refused = F.raise_error(F.lit("unexpected payload of the plant database")).cast("array<struct<row:map<string,string>,geometry:string>>")
    rows = F.when(is_list, plain(F.col("value"))).when(at("$.data").startswith("["), plain(at("$.data"))).when(at("$.features").startswith("["), features).otherwise(refused)
    return raw.select(F.explode(F.coalesce(rows, refused)).alias("r")).select("r.*")


def _raise(text: str, kind: str) -> Column:
    return F.raise_error(F.lit(text)).cast(kind)


def _number(c: Column, label: str) -> Column:
    """A number with or without thousands' commas, null where blank; anything else raises."""
    text = F.nullif(F.trim(F.regexp_replace(c, ",", "")), F.lit(""))
    value = text.try_cast("double")
    fine = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(text.isNull(), F.lit(None).cast("double")).when(fine, value).otherwise(_raise(f"invalid {label}", "double"))


def _point(geometry: Column) -> Column:
    """The place of a feature's geometry: a point within bounds, or null without one; anything else raises."""
    g = F.from_json(geometry, "type string, coordinates array<double>")
    c = g["coordinates"]
    fine = (g["type"] == "Point") & (F.size(c) >= 2) & c[0].between(-180, 180) & c[1].between(-90, 90)
    place = F.struct(F.round(c[0], 6).alias("lon"), F.round(c[1], 6).alias("lat"))
    return F.when(geometry.isNull() | (geometry == "null"), F.lit(None)).when(fine, place).otherwise(_raise("a feature's geometry is no point on the globe", "struct<lon:double,lat:double>"))


def database_records(rows: DataFrame) -> DataFrame:
    """Typed plants of ``database_rows``.

    A row without an id or name, numbers that are none, a capacity below zero or over 100 GW, a
    negative generation, a lone coordinate and an unknown status raise. A row
    without coordinates has its feature's; a blank status is operational. The
    latest year of generation is the reported one.
    """
    of = lambda *names: F.coalesce(*[F.nullif(F.trim(F.try_element_at("row", F.lit(n))), F.lit("")) for n in names])
    need = lambda label, *names: F.coalesce(of(*names), _raise(f"a row lacks its {label}", "string"))
    capacity = _number(F.try_element_at("row", F.lit("capacity_mw")), "capacity")
    mw = F.when(capacity.isNull() | capacity.between(0, MOST_MW), capacity).otherwise(_raise("impossible capacity", "double"))
    place = F.coalesce(S.coordinates(_number(of("longitude"), "coordinates"), _number(of("latitude"), "coordinates")), _point(F.col("geometry")))
    yearly = F.filter(F.map_entries("row"), lambda e: e["key"].rlike(r"^generation_gwh_\d{4}$"))
    gwh = F.transform(yearly, lambda e: F.struct(F.regexp_extract(e["key"], r"(\d{4})$", 1).cast("int").alias("key"), _number(e["value"], "generation").alias("value")))
    known = F.array_sort(F.filter(gwh, lambda e: e["value"].isNotNull()))
    history = F.transform(known, lambda e: F.struct(e["key"].alias("key"), F.when(e["value"] >= 0, e["value"]).otherwise(_raise("impossible generation", "double")).alias("value")))
    full = lambda v: F.when(v.isNotNull(), F.struct(v.alias("low"), v.alias("central"), v.alias("high")))
    ident, year = need("plant id", "gppd_idnr", "id"), of("commissioning_year")
    d = rows.select("*", ident.alias("_id"), need("name", "name", "plant_name").alias("_name"), mw.alias("_mw"), place.alias("_place"), history.alias("_history"))
    latest = F.try_element_at("_history", F.lit(-1))["value"]
    return d.select(
        F.concat(F.lit("wri-plant-"), F.col("_id")).alias("id"), F.lit("plant").alias("entity"), F.col("_name").alias("name"), F.concat(F.lit("wri-plant-"), F.col("_id")).alias("plant_id"), F.create_map(F.lit("wri"), F.col("_id")).alias("external_ids"),
        V.technology(of("primary_fuel"), vocabulary=FUELS).alias("technology"), of("primary_fuel").alias("fuel"), F.array_compact(F.array(*[of(f"other_fuel{k}") for k in (1, 2, 3)])).alias("other_fuels"),
        V.lifecycle(F.coalesce(of("status"), F.lit("operational")), STATUSES, "raise").alias("lifecycle"), of("status").alias("raw_status"), full(F.col("_mw")).alias("capacity"), F.when(F.col("_mw").isNull(), "unavailable").otherwise("reported").alias("capacity_kind"),
        full(latest).alias("reported_generation_gwh"), F.map_from_entries("_history").alias("generation_history_gwh"), of("country").alias("iso3"), of("country_long").alias("country"), F.col("_place.lon").alias("lon"), F.col("_place.lat").alias("lat"),
        of("owner").alias("owner"), of("operator").alias("operator"), F.when(year.isNotNull(), F.coalesce(S.year_of(F.regexp_replace(year, r"\.0+$", "")), _raise("invalid commissioning year", "int"))).alias("commissioning_year"),
        F.array(F.lit(SOURCE_ID)).alias("source_ids"), F.lit("research_verified").alias("source_type"), of("url", "source_url").alias("url"), F.lit(LICENCE).alias("licence"),
    )


def database(spark: SparkSession, path: str, least: int = LEAST_RECORDS) -> DataFrame:
    """Typed plants of a release, which must have ``least`` records."""
    return floor(database_records(database_rows(spark, path)), least, SOURCE_ID)
