"""Power plants from source rows: records of one unit or plant, plants of records, their capacity and durable ids.

A source row has: id, entity (unit or plant), country, name, plant_name,
operator, lon, lat, capacity (range), capacity_kind, technology, lifecycle,
commissioning_year, external_ids (map), plant_id, unit_id, source_type,
source_ids, location_precision, evidence (array of source ids).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlake.functions import vocabulary as V
from wattlake.functions.scalars import PARTS, expand_aliases, haversine_km, key_normalize
from wattlake.operators.clusters import clusters_of
from wattlake.operators.graph import connected_components, written
from wattlake.operators.relational import money

RANGE = "struct<low:double,central:double,high:double>"


def signature(c: Column, aliases: dict[str, str]) -> Column:
    """Distinct sorted words of a name without generic ones; null if none is left."""
    words = F.filter(F.split(expand_aliases(c, aliases), " "), lambda w: (w != "") & ~w.isin(*V.GENERIC_PLANT_WORDS))
    return F.nullif(F.array_join(F.array_sort(F.array_distinct(words)), " "), F.lit(""))


def plant_reference(plant_id: Column, source_ids: Column, source_type: Column) -> Column:
    """The namespace of a row's own plant id: by its feed's prefix, else by its first source."""
    low = F.lower(plant_id)
    feed = F.when(low.startswith("gem-"), "gem").when(low.startswith("wri-"), "wri").when(low.startswith("osm-"), "osm")
    first = F.regexp_replace(F.lower(F.coalesce(F.try_element_at(source_ids, F.lit(1)), source_type, F.lit("unknown"))), "[^a-z0-9]+", "")
    return F.concat(F.lit("plantref_"), F.coalesce(feed, first))


def identities(entity: bool) -> Column:
    """Ids by which rows are told, as namespace and id.

    For records (``entity``) a unit row counts its unit namespaces only, a plant
    row all of its own; for plants unit namespaces do not count, plant ids do.
    """
    entries, in_unit = F.map_entries(F.coalesce("external_ids", F.create_map().cast("map<string,string>"))), lambda e: e["key"].isin(*V.UNIT_NAMESPACES)
    if entity:
        return F.filter(entries, lambda e: (F.col("entity") != "unit") | in_unit(e))
    own = F.array(F.struct(plant_reference(F.col("plant_id"), F.col("source_ids"), F.col("source_type")).alias("key"), F.col("plant_id").alias("value")))
    return F.concat(F.filter(entries, lambda e: ~in_unit(e)), F.when(F.col("plant_id").isNotNull(), own).otherwise(F.expr("array()").cast("array<struct<key:string,value:string>>")))


def _keyed(rows: DataFrame, plant_group: bool, aliases: dict[str, str]) -> DataFrame:
    unit = F.col("entity") == "unit"
    plant = F.coalesce("plant_name", "name")
    name = plant if plant_group else F.when(unit, F.col("name")).otherwise(plant)
    return rows.select(
        "id", "entity", F.nullif(key_normalize(F.coalesce("country", F.lit(""))), F.lit("")).alias("country"),
        F.nullif(expand_aliases(F.col("operator"), aliases), F.lit("")).alias("operator"), signature(name, aliases).alias("signature"),
        F.nullif(expand_aliases(F.col("name"), aliases), F.lit("")).alias("unit_name"), "lon", "lat",
        F.col("capacity.central").alias("mw"), "commissioning_year", identities(not plant_group).alias("ids"), identities(False).alias("plant_ids"),
    )


def constrained_clusters(rows: DataFrame, plant_group: bool, aliases: dict[str, str] | None = None) -> DataFrame:
    """id and cluster (smallest id of it) of every row: records of rows, or with ``plant_group`` plants of records.

    Links are taken in the order of the rows' ids and join only where kinds,
    countries and ids do not conflict; see ``clusters``.
    """
    return clusters_of(written(_keyed(rows, plant_group, {key_normalize_text(k): key_normalize_text(v) for k, v in (aliases or {}).items()})), plant_group)


def key_normalize_text(s: str) -> str:
    import re

    return re.sub(r"[^a-z0-9]+", " ", s.lower()).strip()


# --- merging -----------------------------------------------------------------


def preference(field: str) -> Column:
    """How far a row is to be believed about a field: value kind (of metrics), source, public source, precision, then the row itself."""
    kind = V.rank(F.col("capacity_kind"), V.VALUE_KIND_RANK) if field == "capacity" else F.lit(0)
    return F.struct(kind.alias("kind"), V.rank(F.col("source_type"), V.SOURCE_RANK).alias("source"), V.public_source_rank(F.col("source_ids")).alias("public"), V.rank(F.col("location_precision"), V.PRECISION_RANK, -1).alias("precision"), F.col("id").alias("id"))


def best(field: str) -> Column:
    return F.max_by(F.col(field), F.when(F.col(field).isNotNull(), preference(field))).alias(field)


def union_of(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))


LINEAGE = "struct<source_record_id:string,source_type:string,source_ids:array<string>,value_kind:string,method:string>"
#: How a field's value was chosen.
BY_FIELD, BY_METRIC, AS_WHOLE, UNITED = "most_believed_value", "most_believed_metric", "best_location_as_whole", "united_ids"


def lineage(field: str, weight: Column, method: str) -> Column:
    """The source row of a field's value, by the same choice as the value itself."""
    kind = F.col("capacity_kind") if field == "capacity" else F.lit(None).cast("string")
    told = F.struct(F.col("id").alias("source_record_id"), "source_type", F.array_sort("source_ids").alias("source_ids"), kind.alias("value_kind"), F.lit(method).alias("method"))
    return F.max_by(told, weight).cast(LINEAGE)


def merge_records(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """One record per cluster: field by field the most believed value, metric and kind together, a location as one whole, ids united.

    ``field_provenance`` says of every field that has a value from which source
    row it is and how it was chosen; ``id_aliases`` has all ids of the namespaces
    of which a cluster has several.
    """
    place = F.when(F.col("lon").isNotNull(), V.rank(F.col("location_precision"), V.PRECISION_RANK, -1)).otherwise(-1)
    where = F.struct(place.alias("precision"), V.rank(F.col("source_type"), V.SOURCE_RANK).alias("source"), V.public_source_rank(F.col("source_ids")).alias("public"), F.col("id").alias("id"))
    location = F.max_by(F.struct("lon", "lat", "location_precision", "country"), where).alias("location")
    metric = F.max_by(F.struct("capacity", "capacity_kind", "source_type", "source_ids"), F.when(F.col("capacity").isNotNull(), preference("capacity"))).alias("metric")
    plain = [best(c) for c in ("entity", "name", "plant_name", "operator", "technology", "lifecycle", "commissioning_year", "plant_id", "unit_id")]
    source = F.max_by(F.struct("source_type"), preference("")).alias("source")
    ids = F.collect_list(F.struct(preference("external_ids").alias("p"), F.map_entries(F.coalesce("external_ids", F.create_map().cast("map<string,string>"))).alias("e"))).alias("maps")
    filled = lambda c: F.when(F.col(c).isNotNull(), preference(c))
    placed = F.when(F.col("lon").isNotNull(), where)
    told = {c: lineage(c, filled(c), BY_FIELD) for c in ("entity", "name", "plant_name", "operator", "technology", "lifecycle", "commissioning_year", "plant_id", "unit_id")}
    told |= {"capacity": lineage("capacity", filled("capacity"), BY_METRIC), "location": lineage("location", placed, AS_WHOLE), "external_ids": lineage("external_ids", F.when(F.size(F.coalesce("external_ids", F.create_map().cast("map<string,string>"))) > 0, preference("external_ids")), UNITED)}
    fields = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in told.items()]).alias("told")
    out = rows.join(clusters.select("id", "cluster"), "id").groupBy("cluster").agg(fields, *plain, location, metric, source, union_of(F.col("source_ids")).alias("source_ids"), union_of(F.col("evidence")).alias("evidence"), F.array_sort(F.collect_set("id")).alias("source_record_ids"), ids)
    # Of several ids in one namespace the most believed row's stands; the others are aliases.
    entries = F.flatten(F.transform(F.array_sort("maps"), lambda x: x["e"]))
    chosen = F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.create_map(e["key"], e["value"])))
    names = F.array_sort(F.array_distinct(F.transform(entries, lambda e: e["key"])))
    several = F.filter(F.transform(names, lambda n: F.struct(n.alias("key"), F.array_sort(F.array_distinct(F.transform(F.filter(entries, lambda e: e["key"] == n), lambda e: e["value"]))).alias("value"))), lambda e: F.size(e["value"]) > 1)
    provenance = F.map_from_entries(F.filter("told", lambda e: e["value"].isNotNull()))
    return out.select(
        F.col("cluster").alias("id"), "entity", "location.country", "name", "plant_name", "operator", "location.lon", "location.lat", "metric.capacity",
        F.col("metric.capacity_kind").alias("capacity_kind"), F.col("metric.source_type").alias("capacity_source"), F.coalesce("metric.source_ids", F.expr("array()").cast("array<string>")).alias("capacity_source_ids"), "technology", "lifecycle", "commissioning_year",
        chosen.alias("external_ids"), "plant_id", "unit_id", "source.source_type", "source_ids", "location.location_precision", "evidence", "source_record_ids",
        provenance.alias("field_provenance"), F.map_from_entries(several).alias("id_aliases"),
    )


# --- capacity ----------------------------------------------------------------


CAPACITY_LINEAGE = "struct<value_kind:string,source_type:string,source_ids:array<string>>"


def capacity_account(records: DataFrame, group: str, lifecycles: Sequence[str]) -> DataFrame:
    """Per group: capacity (range), method, coverage, known and all units, the partial sum, capacity by technology, and
    the lineage (value kind, source and source ids) of what was counted.

    All units known: their sum, unless a plant row is believed more; some
    unknown: the best plant row, or nothing; no units: the best plant row.
    """
    alive = records.where(F.col("lifecycle").isin(*lifecycles))
    unit, known = F.col("entity") == "unit", F.col("capacity").isNotNull()
    weight = F.struct(V.rank(F.col("capacity_kind"), V.VALUE_KIND_RANK).alias("kind"), V.rank(F.coalesce("capacity_source", "source_type"), V.SOURCE_RANK).alias("source"))
    told = F.struct(F.coalesce("capacity_kind", F.lit("unavailable")).alias("value_kind"), F.coalesce("capacity_source", "source_type").alias("source_type"), F.array_sort("capacity_source_ids").alias("source_ids"))
    claims = F.size(F.filter("evidence", lambda e: F.array_contains("capacity_source_ids", e)))
    total = F.struct(*[F.sum(F.when(unit & known, money(F.col(f"capacity.{p}")))).cast("double").alias(p) for p in PARTS])
    aggregate = F.max_by(F.struct("capacity", "technology", weight.alias("weight"), claims.alias("claims")), F.when(~unit & known, preference("capacity"))).alias("best")
    g = alive.groupBy(group).agg(
        F.count_if(unit).alias("units"), F.count_if(unit & known).alias("known"), total.alias("unit_sum"), aggregate,
        F.min(F.when(unit & known, weight["kind"])).alias("unit_kind"), F.min(F.when(unit & known, weight["source"])).alias("unit_source"), F.sum(F.when(unit & known, claims)).alias("unit_claims"),
        F.array_sort(F.collect_set(F.when(unit & known, told))).alias("unit_lineage"), F.max_by(told, F.when(~unit & known, preference("capacity"))).alias("plant_lineage"),
    )
    mine, theirs = F.struct(F.col("best.weight.kind").alias("a"), F.col("best.weight.source").alias("b"), F.col("best.claims").cast("long").alias("c")), F.struct(F.col("unit_kind").alias("a"), F.col("unit_source").alias("b"), F.col("unit_claims").alias("c"))
    complete, has = (F.col("units") > 0) & (F.col("known") == F.col("units")), F.col("best").isNotNull()
    method = F.when(complete & has & (mine > theirs), "aggregate_preferred").when(complete, "complete_unit_sum").when((F.col("units") > 0) & has, "aggregate_fallback").when(F.col("units") > 0, "incomplete_units").when(has, "plant_aggregate").otherwise("unavailable")
    account = g.withColumn("method", method)
    from_units = F.col("method") == "complete_unit_sum"
    from_plant = F.col("method").isin("aggregate_preferred", "aggregate_fallback", "plant_aggregate")
    by_unit = alive.where(unit & known).groupBy(group, F.coalesce("technology", F.lit("other")).alias("t")).agg(F.sum(money(F.col("capacity.central"))).cast("double").alias("mw"))
    mix = by_unit.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("t", "mw")))).alias("unit_mix"))
    account = account.join(mix, group, "left")
    return account.select(
        group, "method", F.when(from_units, F.col("unit_sum")).when(from_plant, F.col("best.capacity")).alias("capacity"),
        F.round(F.when(F.col("units") > 0, F.when(F.col("method") == "aggregate_preferred", 100.0).otherwise(100.0 * F.col("known") / F.col("units"))).otherwise(F.when(has, 100.0).otherwise(0.0)), 2).alias("coverage"),
        F.col("known").alias("known_units"), F.col("units").alias("all_units"), F.when((F.col("known") > 0) & ~from_units, F.col("unit_sum")).alias("partial"),
        F.when(from_units, F.col("unit_mix")).when(from_plant, F.create_map(F.coalesce("best.technology", F.lit("other")), F.col("best.capacity.central"))).otherwise(F.create_map().cast("map<string,double>")).alias("mix"),
        F.when(from_units, F.col("unit_lineage")).when(from_plant, F.array("plant_lineage")).otherwise(F.expr("array()").cast(f"array<{CAPACITY_LINEAGE}>")).alias("lineage"),
    )


# --- durable ids ---------------------------------------------------------------

# Which namespace names a plant or a record first.
PLANT_ANCHORS = {"wikidata": 0, "gemplant": 1, "wri": 2, "osm": 3, "official": 4, "wikipedia": 5}
RECORD_ANCHORS = {"gemunit": 0, "gemplant": 1, "wri": 2, "osm": 3, "wikidata": 4, "officialunit": 5, "official": 6, "unit": 7, "unitid": 7, "wikipedia": 8, "unitref": 20, "plantref": 21}


def anchor_slug(namespace: Column, identifier: Column, limit: int) -> Column:
    """A hyphenated id; a longer one is cut and closed by ten hex digits of namespace and id."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(identifier), "[^a-z0-9]+", "-"), "^-|-$", "")
    digest = F.substring(F.sha2(F.concat_ws(":", namespace, identifier).cast("binary"), 256), 1, 10)
    return F.when(F.length(slug) <= limit, slug).otherwise(F.concat(F.regexp_replace(F.substring(slug, 1, limit), "-+$", ""), F.lit("-"), digest))


def anchors(entries: Column, priority: dict[str, int], prefix: str, limit: int) -> Column:
    """All names that a group's ids give it, the first one first: structs of priority, namespace, id, name."""
    known = F.filter(entries, lambda e: e["key"].isin(*priority) & (F.regexp_replace(F.lower(e["value"]), "[^a-z0-9]+", "") != ""))
    made = F.transform(known, lambda e: F.struct(V.rank(e["key"], priority).alias("priority"), e["key"].alias("namespace"), e["value"].alias("identifier"), F.concat(F.lit(prefix), e["key"], F.lit("-"), anchor_slug(e["key"], e["value"], limit)).alias("name")))
    return F.array_sort(F.array_distinct(made))


def unique_names(named: DataFrame, name: str, fingerprint: Column) -> DataFrame:
    """Repeated names get ten hex digits of their fingerprint; the smallest fingerprint keeps the bare name as an alias."""
    digest = F.sha2(fingerprint.cast("binary"), 256)
    d = named.withColumn("_print", digest)
    shared = d.groupBy(name).agg(F.count("*").alias("_n"), F.min("_print").alias("_first"))
    d = d.join(shared, name)
    alone = F.col("_n") == 1
    return d.withColumn("alias", F.when(~alone & (F.col("_print") == F.col("_first")), F.col(name))).withColumn("unique_id", F.when(alone, F.col(name)).otherwise(F.concat_ws("-", F.col(name), F.substring("_print", 1, 10)))).drop("_print", "_n", "_first")


def summarize_plants(records: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row per plant: name, place, counts, technologies, lifecycles, operating and planned capacity, durable id, aliases."""
    r = written(records.join(clusters.select("id", F.col("cluster").alias("plant")), "id"))
    unit = F.col("entity") == "unit"
    place = F.struct(F.when(F.col("lon").isNotNull(), V.rank(F.col("location_precision"), V.PRECISION_RANK, -1)).otherwise(-1).alias("precision"), V.rank(F.col("source_type"), V.SOURCE_RANK).alias("source"), V.public_source_rank(F.col("source_ids")).alias("public"), F.col("id").alias("id"))
    name = F.max_by(F.coalesce("plant_name", "name"), F.when(F.coalesce("plant_name", "name").isNotNull(), F.struct(F.col("plant_name").isNotNull().cast("int").alias("own"), preference("name").alias("p"))))
    base = r.groupBy("plant").agg(
        name.alias("name"), F.max_by(F.struct("country", "lon", "lat", "location_precision"), place).alias("at"), F.count_if(unit).alias("units"), F.count("*").alias("records"),
        union_of(F.col("source_ids")).alias("source_ids"), F.array_sort(F.collect_set("id")).alias("record_ids"), F.array_sort(F.collect_set(F.when(unit, F.col("unit_id")))).alias("unit_ids"),
        F.array_distinct(F.flatten(F.collect_list(identities(False)))).alias("ids"),
    )
    # Units are what is counted where a plant has any.
    counted = r.join(base.select("plant", "units"), "plant").where((F.col("units") == 0) | unit)
    kinds = counted.groupBy("plant", F.coalesce("lifecycle", F.lit("unknown")).alias("lifecycle")).agg(F.count("*").alias("n"), F.collect_set(F.coalesce("technology", F.lit("other"))).alias("t"))
    kinds = kinds.groupBy("plant").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lifecycle", "n")))).alias("lifecycle_counts"), union_of(F.col("t")).alias("technologies"))
    built = capacity_account(r, "plant", V.OPERATING).select("plant", F.col("capacity").alias("operating"), F.col("mix").alias("operating_mix"), F.col("method").alias("operating_method"))
    planned = capacity_account(r, "plant", V.PLANNED).select("plant", F.col("capacity").alias("planned"), F.col("mix").alias("planned_mix"), F.col("method").alias("planned_method"))
    out = base.join(kinds, "plant").join(built, "plant", "left").join(planned, "plant", "left")
    names = anchors(F.col("ids"), PLANT_ANCHORS, "plant-", 48)
    derived = F.concat(F.lit("plant-derived-"), F.substring(F.sha2(F.concat_ws("\x1f", F.coalesce("at.country", F.lit("")), key_normalize(F.col("name")), F.concat_ws(",", "record_ids")).cast("binary"), 256), 1, 16))
    out = out.withColumn("_anchors", names).withColumn("base_id", F.coalesce(F.try_element_at("_anchors", F.lit(1))["name"], derived))
    fingerprint = F.concat_ws("\x1f", F.coalesce("at.country", F.lit("")), F.to_json(F.array_sort("ids")), F.concat_ws(",", "record_ids"))
    out = unique_names(out, "base_id", fingerprint)
    aliases = F.array_sort(F.array_distinct(F.concat(F.transform(F.filter("_anchors", lambda a: a["name"] != F.col("base_id")), lambda a: a["name"]), F.array_compact(F.array("alias")))))
    return out.select(F.col("unique_id").alias("plant_id"), F.col("plant").alias("first_record"), "name", "at.country", "at.lon", "at.lat", "units", "records", "technologies", "lifecycle_counts", "operating", "planned", "operating_mix", "planned_mix", "operating_method", "planned_method", "source_ids", "record_ids", "unit_ids", aliases.alias("aliases"))


def record_ids(records: DataFrame) -> DataFrame:
    """id, durable record id and aliases: the first anchor among external ids and the row's own unit or plant id, else the smallest source row."""
    own = F.when(F.col("entity") == "unit", F.struct(F.lit("unitref").alias("key"), F.col("unit_id").alias("value"))).otherwise(F.struct(F.lit("plantref").alias("key"), F.col("plant_id").alias("value")))
    entries = F.concat(identities(True), F.filter(F.array(own), lambda e: e["value"].isNotNull()))
    d = records.withColumn("_anchors", anchors(entries, RECORD_ANCHORS, "record-", 64)).withColumn("base_id", F.coalesce(F.try_element_at("_anchors", F.lit(1))["name"], F.array_min("source_record_ids")))
    d = unique_names(d, "base_id", F.concat_ws("\x1f", "base_id", "entity", F.coalesce("country", F.lit("")), F.coalesce("unit_id", "plant_id", F.lit("")), F.concat_ws(",", "source_record_ids")))
    return d.select("id", F.col("unique_id").alias("record_id"), F.array_sort(F.array_distinct(F.concat(F.transform("_anchors", lambda a: a["name"]), F.col("source_record_ids"), F.array_compact(F.array("alias"))))).alias("aliases"))


def canonicalize(rows: DataFrame, aliases: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Records of source rows, and plants of records."""
    records = written(merge_records(rows, constrained_clusters(rows, False, aliases)))
    return records, summarize_plants(records, constrained_clusters(records, True, aliases))


def country_keys(names: DataFrame) -> DataFrame:
    """name and country: spellings and codes linked by rows (a, b) fall together under their ISO3 code, else ISO2, else the smallest."""
    k = lambda c: F.nullif(key_normalize(F.col(c)), F.lit(""))
    links = names.select(k("a").alias("a"), k("b").alias("b")).where("a is not null")
    nodes = links.select("a").union(links.select("b")).where("a is not null").distinct().select(F.col("a").alias("name"), F.xxhash64("a").alias("node"))
    edges = links.where("b is not null").select(F.xxhash64("a").alias("src"), F.xxhash64("b").alias("dst"))
    placed = nodes.join(connected_components(edges), "node", "left").withColumn("component", F.coalesce("component", "node"))
    rank = F.struct(F.when(F.col("name").rlike("^[a-z]{3}$"), 0).when(F.col("name").rlike("^[a-z]{2}$"), 1).otherwise(2).alias("r"), F.col("name").alias("name"))
    return placed.join(placed.groupBy("component").agg(F.min(rank).alias("m")), "component").select("name", F.col("m.name").alias("country"))


__all__ = ["anchors", "canonicalize", "capacity_account", "constrained_clusters", "country_keys", "haversine_km", "identities", "merge_records", "record_ids", "signature", "summarize_plants", "unique_names"]
