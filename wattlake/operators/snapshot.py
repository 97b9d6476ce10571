"""What a snapshot publishes: active demand and lenses by year and category, generator roll-ups, client projections, validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlake.functions import vocabulary as V
from wattlake.functions.scalars import PARTS
from wattlake.operators import models as M
from wattlake.operators.relational import circular_bounds, circular_centre, money, violations

YEARS = tuple(range(2026, 2032))
LIVE = ("operational", "announced", "planning_filed", "permitted", "under_construction")
PLANNED = ("announced", "planning_filed", "permitted", "under_construction")


# --- assets and lenses ---------------------------------------------------------


def active(year: Column) -> Column:
    """Whether an asset's demand counts in a year: alive, with a demand, its target year come or unknown."""
    return F.col("lifecycle").isin(*LIVE) & F.col("demand_mw").isNotNull() & (F.col("target_year").isNull() | (F.col("target_year") <= year))


def active_demand(assets: DataFrame, years: Sequence[int] = YEARS) -> DataFrame:
    """Per geography, year and category, and per geography and year in total (``combined``): demand, timing, confidence, sources.

    ``assets``: geography_id, category, lifecycle, target_year, demand_mw
    (range), timing, confidence, source_ids. Timing is weighted by central MW,
    one at least. Rows are first aggregated by category, the total rolls up those.
    """
    d = assets.select("*", F.explode(F.array(*[F.lit(y) for y in years])).alias("year")).where(active(F.col("year")))
    w = F.greatest(F.lit(1.0), F.col("demand_mw.central"))
    parts = [F.sum(money(F.col(f"demand_mw.{p}"))).alias(p) for p in PARTS]
    fine = d.groupBy("geography_id", "year", "category").agg(*parts, F.sum(money(F.col("timing") * w)).alias("tw"), F.sum(money(w)).alias("w"), F.sum("confidence").alias("c"), F.count("*").alias("assets"), F.array_distinct(F.flatten(F.collect_set("source_ids"))).alias("s"))
    rolled = fine.groupBy("geography_id", "year").agg(*[F.sum(c).alias(c) for c in (*PARTS, "tw", "w", "c", "assets")], F.array_distinct(F.flatten(F.collect_list("s"))).alias("s")).withColumn("category", F.lit("combined"))
    both = fine.unionByName(rolled)
    two = lambda c: F.bround(F.col(c), 2).cast("double").alias(c)
    return both.select("geography_id", "year", "category", F.struct(*[two(p) for p in PARTS]).alias("demand"), (F.col("tw") / F.col("w")).cast("double").alias("timing"), F.bround((F.col("c") / F.col("assets")).cast("decimal(18,6)"), 0).cast("int").alias("confidence"), "assets", F.array_sort("s").alias("source_ids"))


def lenses(demand: DataFrame) -> DataFrame:
    """The demand lens and its two supporting lenses from active demand; groups without active assets have no row, hence no score."""
    one = lambda c: F.bround(c.cast("decimal(18,9)"), 1).cast("double")
    d = demand.withColumn("load", F.least(F.lit(100.0), one(100 * F.log1p("demand.central") / F.log1p(F.lit(5000.0)))))
    d = d.withColumn("scarcity", F.least(F.lit(100.0), one(0.72 * F.col("load") + 8)))
    attractive, risk = M.supporting_lenses(F.col("load"), F.col("timing"), F.col("scarcity"))
    return d.withColumn("infrastructure_demand", M.demand_score(F.col("load"), F.col("timing"), F.col("scarcity"))).withColumn("site_attractiveness", attractive).withColumn("system_risk", risk)


def asset_summary(assets: DataFrame, key: str = "geography_id") -> DataFrame:
    """Seven counters per geography; an asset without a source type counts as official."""
    kind = F.coalesce("source_type", F.lit("official_verified"))
    return assets.groupBy(key).agg(
        F.count("*").alias("total"), F.count_if(F.col("lifecycle") == "operational").alias("operational"), F.count_if(F.col("lifecycle").isin(*PLANNED)).alias("planned"), F.count_if(F.col("category") == "data_centre").alias("data_centres"),
        F.count_if(F.col("category") == "water_infrastructure").alias("water_infrastructure"), F.count_if(kind == "official_verified").alias("official_verified"), F.count_if(kind == "community_mapped").alias("community_mapped"),
    )


def inherit(regions: DataFrame, evidence: DataFrame, upstream: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Regions with their own evidence scores, else those of the geography above them; ``origin`` tells which."""
    own = evidence.select("geography_id", *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_own"))
    up = upstream.select(F.col("geography_id").alias("parent_id"), *[F.col(c).alias(f"_up_{c}") for c in columns], F.lit(True).alias("_up"))
    d = regions.join(own, "geography_id", "left").join(up, "parent_id", "left")
    got = [F.when(F.col("_own"), F.col(f"_{c}")).otherwise(F.col(f"_up_{c}")).alias(c) for c in columns]
    return d.select(*regions.columns, *got, F.when(F.col("_own"), "evidence").when(F.col("_up"), "inherited").otherwise("none").alias("origin"))


def coverage_counts(**tables: DataFrame) -> DataFrame:
    """One row: rows of each table, and distinct countries and sources of those that have them."""
    out = None
    for name, df in tables.items():
        some = [F.count("*").alias(name)] + [F.count_distinct(c).alias(f"{name}_{c}") for c in ("country", "source_id") if c in df.columns]
        one = df.agg(*some).withColumn("_k", F.lit(1))
        out = one if out is None else out.join(one, "_k")
    return out.drop("_k")


# --- generators ------------------------------------------------------------------


def publishable(plants: DataFrame, regions: DataFrame) -> DataFrame:
    """Plants with coordinates in an active region of their own country."""
    return plants.where("lon is not null and lat is not null").join(regions.select("geography_id", "country").distinct(), ["geography_id", "country"], "left_semi")


def regional_mix(plants: DataFrame, key: str = "geography_id") -> DataFrame:
    """Per geography: plants, capacity, capacity by technology (sorted by falling capacity, then name), the dominant one and its share."""
    rows = plants.select(key, F.explode("mix").alias("technology", "mw"))
    m = rows.groupBy(key, "technology").agg(F.sum(money(F.col("mw"))).cast("double").alias("mw"))
    tops = m.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("mw")).alias("order"), "technology", "mw"))).alias("t"), F.sum(money(F.col("mw"))).cast("double").alias("capacity_mw"))
    mix = F.transform("t", lambda x: F.struct(x["technology"].alias("technology"), x["mw"].alias("mw")))
    plain = tops.select(key, "capacity_mw", mix.alias("mix"), F.col("t")[0]["technology"].alias("dominant"), F.round(F.col("t")[0]["mw"] / F.nullif("capacity_mw", F.lit(0.0)), 6).alias("dominant_share"))
    return plants.groupBy(key).agg(F.count("*").alias("plants")).join(plain, key, "left")


def country_index(plants: DataFrame, key: str = "country") -> DataFrame:
    """Per country: features, capacity, box (longitudes on the circle) and centre; a missing capacity counts as none here."""
    base = plants.groupBy(key).agg(F.count("*").alias("features"), F.sum(money(F.coalesce("capacity_mw", F.lit(0.0)))).cast("double").alias("capacity_mw"), F.min("lat").alias("south"), F.max("lat").alias("north"), (F.sum(money(F.col("lat"))).cast("double") / F.count("lat")).alias("centre_lat"))
    return base.join(circular_bounds(plants, key, "lon"), key).join(circular_centre(plants, key, "lon").withColumnRenamed("centre", "centre_lon"), key)


def overview_filter(overview: DataFrame, technologies: Sequence[str], lifecycles: Sequence[str]) -> DataFrame:
    """An overview (mix map, lifecycle_counts map, count) by chosen technologies and lifecycles: mix, dominant one, shares, whether the filter is exact.

    Nothing chosen, nothing shown. Plants without a lifecycle count as unknown.
    """
    mix = F.array_sort(F.transform(F.filter(F.map_entries("mix"), lambda e: e["key"].isin(*technologies) & (e["value"] > 0)), lambda e: F.struct((-e["value"]).alias("order"), e["key"].alias("technology"), e["value"].alias("mw"))))
    d = overview.withColumn("_mix", mix).where(F.size("_mix") > 0)
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    known = add(F.map_values("lifecycle_counts"))
    chosen = add(F.map_values(F.map_filter("lifecycle_counts", lambda k, _: k.isin(*lifecycles)))) + (F.greatest(F.lit(0), F.col("count") - known) if "unknown" in lifecycles else F.lit(0))
    selected = F.when(F.col("lifecycle_counts").isNotNull(), chosen)
    d = d.withColumn("selected", selected).where(F.lit(bool(lifecycles)) & (F.col("selected").isNull() | (F.col("selected") != 0)))
    total = F.aggregate("_mix", F.lit(0.0), lambda a, x: a + x["mw"])
    label = F.array_join(F.transform("_mix", lambda x: F.concat(F.initcap(x["technology"]), F.lit(" "), F.floor(x["mw"] / total * 100 + 0.5).cast("string"), F.lit("%"))), " · ")
    exact = F.col("lifecycle_counts").isNotNull() & (F.col("selected") == F.col("count"))
    return d.select("geography_id", F.col("_mix")[0]["technology"].alias("dominant"), (F.size("_mix") > 1).alias("is_mixed"), total.alias("filtered_mw"), label.alias("composition"), F.coalesce(exact, F.lit(False)).alias("exact"))


def generator_filter(plants: DataFrame, technologies: Sequence[str], lifecycles: Sequence[str]) -> DataFrame:
    """Plants with any chosen technology and a chosen lifecycle (none counts as unknown); an empty choice gives none."""
    if not technologies or not lifecycles:
        return plants.limit(0)
    return plants.where(F.arrays_overlap("technologies", F.array(*[F.lit(x) for x in technologies])) & F.coalesce("lifecycle", F.lit("unknown")).isin(*lifecycles))


def visible(assets: DataFrame, data_centres: bool, water: bool) -> DataFrame:
    return assets.where(F.when(F.col("category") == "data_centre", F.lit(data_centres)).otherwise(F.lit(water)))


def active_score(regions: DataFrame, lens: str, year: int) -> DataFrame:
    """``active_score``: the combined score of the lens and year, else the plain one, else null.

    ``category_scores`` maps years to categories to lenses, ``scores`` years to lenses.
    """
    y = F.lit(str(year))
    deep = F.try_element_at(F.try_element_at(F.try_element_at("category_scores", y), F.lit("combined")), F.lit(lens))
    return regions.withColumn("active_score", F.coalesce(deep, F.try_element_at(F.try_element_at("scores", y), F.lit(lens))))


# Colours of the lenses from a score up.
RAMPS = {
    "infrastructureDemand": ((0, "#1B3430"), (45, "#3D7467"), (65, "#A4864E"), (80, "#E2B45C")),
    "siteAttractiveness": ((0, "#1A2C2A"), (45, "#32685E"), (65, "#55A28E"), (80, "#72D9BD")),
    "systemRisk": ((0, "#26312F"), (45, "#72564D"), (65, "#A85E51"), (80, "#D66F5F")),
    "powerBalance": ((0, "#4D8879"), (35, "#71817D"), (55, "#A4864E"), (75, "#D66F5F")),
}
NO_SCORE = "#142321"


def score_colour(score: Column, lens: str) -> Column:
    ramp = RAMPS[lens]
    out = F.lit(ramp[0][1])
    for least, colour in ramp:
        out = F.when(score >= least, colour).otherwise(out)
    return F.when(score.isNull(), NO_SCORE).otherwise(out)


def comparison(regions: DataFrame, energy: DataFrame, chosen: Sequence[str], lens: str, year: int) -> DataFrame:
    """Chosen regions side by side; under the balance lens confidence comes from the energy rows. Fewer than two give none."""
    if len(set(chosen)) < 2:
        return active_score(regions, lens, year).select("geography_id", "active_score", "confidence").withColumn("demand", F.lit(None).cast("double")).limit(0)
    picked = active_score(regions.where(F.col("geography_id").isin(*chosen)), lens, year)
    e = energy.where(F.col("year") == year).select("geography_id", F.col("demand").alias("_demand"), F.col("confidence").alias("_confidence"))
    mine = F.lit(lens == "powerBalance") & F.col("_confidence").isNotNull()
    return picked.join(e, "geography_id", "left").select("geography_id", "active_score", F.when(mine, F.col("_confidence")).otherwise(F.col("confidence")).alias("confidence"), F.when(F.lit(lens == "powerBalance"), F.col("_demand")).alias("demand"))


def evidence_of(regions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence rows of each region's source ids."""
    return regions.select("geography_id", F.explode(F.array_distinct("source_ids")).alias("source_id")).join(evidence, "source_id")


def marker_clusters(plants: DataFrame, zoom: int, radius: int = 50, tile: int = 512) -> DataFrame:
    """Markers by cells of ``radius`` pixels on the Mercator plane: count, capacity, plants by technology."""
    world = tile * 2**zoom
    x = (F.col("lon") + 180) / 360 * world
    s = F.sin(F.radians(F.greatest(F.lit(-85.0511), F.least(F.lit(85.0511), F.col("lat")))))
    y = (0.5 - F.log((1 + s) / (1 - s)) / (4 * 3.141592653589793)) * world
    d = plants.where("lon is not null and lat is not null").withColumn("cx", F.floor(x / radius).cast("long")).withColumn("cy", F.floor(y / radius).cast("long"))
    t = d.groupBy("cx", "cy", "technology").agg(F.count("*").alias("n"), F.sum(money(F.coalesce("capacity_mw", F.lit(0.0)))).alias("mw"))
    return t.groupBy("cx", "cy").agg(F.sum("n").alias("plants"), F.sum("mw").cast("double").alias("capacity_mw"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("technology", "n")))).alias("by_technology"))


# --- validation ------------------------------------------------------------------


def snapshot_violations(countries: DataFrame, regions: DataFrame, assets: DataFrame, plants: DataFrame, index: DataFrame, energy: DataFrame, years: Sequence[int] = YEARS) -> DataFrame:
    """Broken rules of a snapshot as rows of artifact, id, rule; an empty result is a valid one."""

    def named(name: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(name).alias("artifact"), F.col("id").cast("string").alias("id"), "rule")

    def repeated(df: DataFrame, key: str) -> DataFrame:
        return df.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n")).where("n > 1 or id is null").select("id", F.lit("id_unique").alias("rule"))

    def missing(df: DataFrame, key: str, fk: str, to: DataFrame, on: str, rule: str) -> DataFrame:
        return df.where(F.col(fk).isNotNull()).join(to.select(F.col(on).alias(fk)).distinct(), fk, "left_anti").select(F.col(key).alias("id"), F.lit(rule).alias("rule"))

    bounds = {"longitude": F.col("lon").isNull() | F.col("lon").between(-180, 180), "latitude": F.col("lat").isNull() | F.col("lat").between(-90, 90), "both_coordinates": F.col("lon").isNull() == F.col("lat").isNull()}
    score = {f"{c}_range": F.col(c).isNull() | F.col(c).between(0, 100) for c in regions.columns if c.startswith("score")}
    ranges = {"demand_range": F.col("demand").isNull() | ((F.col("demand.low") <= F.col("demand.central")) & (F.col("demand.central") <= F.col("demand.high")))}
    rolled = country_index(plants)
    near = lambda c, tol: F.abs(F.col(c) - F.col(f"_{c}")) <= tol
    both = index.join(rolled.select("country", *[F.col(c).alias(f"_{c}") for c in rolled.columns if c != "country"]), "country", "full_outer").withColumn("id", F.col("country"))
    shard = violations(both, "id", {"feature_count": F.col("features") == F.col("_features"), "capacity": near("capacity_mw", 1e-6), "box": near("west", 1e-9) & near("east", 1e-9) & near("south", 1e-9) & near("north", 1e-9)})
    complete = energy.groupBy(F.col("geography_id").alias("id")).agg(F.array_sort(F.collect_list("year")).alias("y")).where(F.col("y") != F.array(*[F.lit(y) for y in years])).select("id", F.lit("years_complete").alias("rule"))
    parts = [
        named("countries", repeated(countries, "country")), named("regions", repeated(regions, "geography_id")), named("assets", repeated(assets, "id")), named("plants", repeated(plants, "plant_id")),
        named("regions", missing(regions, "geography_id", "country", countries, "country", "country_known")), named("plants", missing(plants, "plant_id", "geography_id", regions, "geography_id", "geography_known")),
        named("assets", violations(assets, "id", bounds)), named("plants", violations(plants, "plant_id", bounds)), named("generators", shard), named("energy", complete), named("energy", violations(energy.withColumn("id", F.col("geography_id")), "id", ranges)),
    ]
    if score:
        parts.append(named("regions", violations(regions, "geography_id", score)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def publication_violations(plants: DataFrame, index: DataFrame, sums: DataFrame, overview: DataFrame, regions: DataFrame, sources: DataFrame, evidence: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """What stands against publishing a snapshot's shards, as rows of artifact, id, rule; none is a valid snapshot.

    ``plants``: plant_id, country, geography_id, lon, lat, capacity_mw, operating_mw,
    planned_mw, mix (map), source_ids. ``index`` and ``sums`` (of the shards as
    read): country, bytes, checksum. ``overview``: geography_id, country, lon, lat,
    capacity_mw, operating_mw, planned_mw, mix, dominant. ``regions``: geography_id,
    country, source_ids. ``sources``: source_id. ``evidence``: evidence_id,
    source_id, subject_id. Sums are exact; ids are joined, never gathered.
    """
    off = lambda a, b: F.coalesce(F.abs(a - b) > tolerance, F.lit(True))
    broken = lambda df, ident, name, bad, rule: df.where(bad).select(F.lit(name).alias("artifact"), F.col(ident).cast("string").alias("id"), F.lit(rule).alias("rule"))
    col = F.col
    # Shards: their place, their region and what their numbers add up to.
    mixed = F.aggregate(F.map_values("mix"), F.lit(0.0), lambda s, v: s + v)
    placed = plants.join(regions.select("geography_id", col("country").alias("_home")), "geography_id", "left")
    parts = [
        broken(placed, "plant_id", "plants", col("_home").isNull(), "region_known"),
        broken(placed, "plant_id", "plants", col("_home").isNotNull() & ~col("_home").eqNullSafe(col("country")), "region_in_country"),
        broken(plants, "plant_id", "plants", off(col("capacity_mw"), col("operating_mw") + col("planned_mw")), "capacity_by_lifecycle"),
        broken(plants, "plant_id", "plants", off(col("capacity_mw"), mixed), "capacity_by_technology"),
        broken(plants, "plant_id", "plants", F.exists(F.map_values("mix"), lambda v: v < 0) | (F.least("operating_mw", "planned_mw") < 0), "capacity_not_negative"),
        broken(plants, "plant_id", "plants", F.coalesce(~(col("lon").between(-180, 180) & col("lat").between(-90, 90)), F.lit(True)), "point"),
    ]
    held = index.select("country", "bytes", "checksum").join(sums.select("country", col("bytes").alias("_bytes"), col("checksum").alias("_checksum")), "country", "full")
    parts += [broken(held, "country", "shards", ~col("bytes").eqNullSafe(col("_bytes")), "bytes"), broken(held, "country", "shards", ~col("checksum").eqNullSafe(col("_checksum")), "checksum")]
    # Regions of the overview are their plants rolled up.
    total = lambda c: F.sum(money(col(c))).cast("double").alias(f"_{c}")
    names = ("capacity_mw", "operating_mw", "planned_mw")
    rolled = plants.groupBy("geography_id").agg(*[total(c) for c in names], F.min("country").alias("_country"))
    by_kind = plants.select("geography_id", F.explode("mix").alias("technology", "mw")).groupBy("geography_id", "technology").agg(F.sum(money(col("mw"))).cast("double").alias("mw"))
    kinds = by_kind.groupBy("geography_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("technology", "mw")))).alias("_mix"), F.min(F.struct((-col("mw")).alias("a"), "technology")).alias("_top"))
    both = overview.join(rolled.join(kinds, "geography_id", "left"), "geography_id", "full")
    known = col("capacity_mw").isNotNull() & col("_capacity_mw").isNotNull()
    other = F.exists(F.map_keys("_mix"), lambda k: off(F.try_element_at("mix", k), F.try_element_at("_mix", k))) | (F.size("mix") != F.size("_mix"))
    parts.append(broken(both, "geography_id", "overview", ~known, "regions_of_shards"))
    parts += [broken(both.where(known), "geography_id", "overview", off(col(c), col(f"_{c}")), f"rolled_{c}") for c in names]
    parts += [broken(both.where(known), "geography_id", "overview", F.coalesce(other, F.lit(True)), "rolled_mix"), broken(both.where(known), "geography_id", "overview", ~col("dominant").eqNullSafe(col("_top.technology")), "dominant")]
    box = plants.groupBy("geography_id").agg(F.min("lat").alias("_south"), F.max("lat").alias("_north")).join(circular_bounds(plants, "geography_id", "lon"), "geography_id")
    centred = overview.join(box, "geography_id")
    within = F.when(col("west") <= col("east"), col("lon").between(col("west") - 1e-9, col("east") + 1e-9)).otherwise((col("lon") >= col("west") - 1e-9) | (col("lon") <= col("east") + 1e-9)) & col("lat").between(col("_south") - 1e-9, col("_north") + 1e-9)
    parts.append(broken(centred, "geography_id", "overview", F.coalesce(~within, F.lit(True)), "centroid"))
    # Every source that is named is known; evidence is of a known source and about something.
    named = plants.select(F.lit("plants").alias("a"), col("plant_id").cast("string").alias("i"), F.explode("source_ids").alias("source_id")).union(regions.select(F.lit("regions"), "geography_id", F.explode("source_ids"))).union(evidence.select(F.lit("evidence"), "evidence_id", "source_id"))
    parts.append(named.join(sources.select("source_id").distinct(), "source_id", "left_anti").select(col("a").alias("artifact"), col("i").alias("id"), F.lit("source_known").alias("rule")).distinct())
    subjects = plants.select(col("plant_id").cast("string").alias("subject_id")).union(regions.select("geography_id"))
    parts.append(broken(evidence.join(subjects.distinct(), "subject_id", "left_anti"), "evidence_id", "evidence", F.lit(True), "subject_known"))
    bare = lambda df, ident, name: broken(df, ident, name, F.coalesce(F.size("source_ids"), F.lit(0)) == 0, "has_source")
    parts += [bare(plants, "plant_id", "plants"), bare(regions, "geography_id", "regions")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def reconciles(shards: DataFrame, overview: DataFrame) -> DataFrame:
    """Geographies whose plants in the shards and in the overview differ; no row means that they reconcile."""
    a = shards.groupBy("geography_id").agg(F.count("*").alias("in_shards"))
    j = a.join(overview.select("geography_id", F.col("plants").alias("in_overview")), "geography_id", "full_outer")
    return j.where(~F.col("in_shards").eqNullSafe(F.col("in_overview")))


def asset_violations(assets: DataFrame) -> DataFrame:
    """Contract of assets: ordered ranges, fields by category, retirement not before commissioning; where assets have a ``value_kind``, a known one beside a demand."""
    r = F.col("demand_mw")
    kinds = {"value_kind": r.isNull() | F.coalesce(F.col("value_kind").isin(*V.VALUE_KIND_RANK), F.lit(False))} if "value_kind" in assets.columns else {}
    return violations(assets, "id", {
        **kinds,
        "range_order": r.isNull() | ((r["low"] <= r["central"]) & (r["central"] <= r["high"]) & (r["low"] >= 0)), "category": F.col("category").isin("data_centre", "water_infrastructure", "power_generation"),
        "lifecycle": F.col("lifecycle").isin(*LIVE, "paused", "cancelled"), "retirement": F.col("retirement_year").isNull() | F.col("commissioning_year").isNull() | (F.col("retirement_year") >= F.col("commissioning_year")),
        "demand_only_for_loads": (F.col("category") != "power_generation") | r.isNull(),
    })
