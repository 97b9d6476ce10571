"""Regional energy: controls, forward increments, supply of plants, balances, forecasts and their scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattlake.functions.scalars import PARTS, parts_of, range_gap, range_times
from wattlake.operators import models as M
from wattlake.operators.graph import written
from wattlake.operators.relational import money, observed_factor

YEARS = tuple(range(2026, 2032))
FORWARD = ("announced", "planning_filed", "permitted", "under_construction")
RANGE = "struct<low:double,central:double,high:double>"
#: Rows of demand in a task of the forecast's joins.
TASK_ROWS = 1 << 17
NONE = F.lit  # typed nulls are made with .cast


def range_sum(c: Column | str) -> Column:
    """Sum of ranges, part by part and exactly; null where no row has one."""
    r = F.col(c) if isinstance(c, str) else c
    return F.when(F.count(r) > 0, parts_of(r, lambda p: F.sum(money(r[p])).cast("double")))


# --- demand ----------------------------------------------------------------


def latest_control(controls: DataFrame, country: str, year: str, order: str) -> DataFrame:
    """Each country's control of the latest year; of several in that year the first by ``order``."""
    rank = F.row_number().over(Window.partitionBy(country).orderBy(F.desc(year), order))
    return controls.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def carried(controls: DataFrame, year: str = "year", years: Sequence[int] = YEARS) -> DataFrame:
    """Controls carried flat to all forecast years; those of another year are inherited."""
    d = controls.withColumn("source_year", F.col(year)).drop(year)
    d = d.select("*", F.explode(F.array(*[F.lit(y) for y in years])).alias(year))
    return d.withColumn("value_kind", F.when(F.col("source_year") == F.col(year), F.col("value_kind")).otherwise("inherited")) if "value_kind" in d.columns else d


def forward_increments(assets: DataFrame, regions: DataFrame) -> DataFrame:
    """Annual demand (GWh, six decimals) of sourced data centres and water works to come in an active region.

    ``assets`` has id, geography_id, category, lifecycle, target_year, demand_mw
    (range), source_ids. An asset without an id raises.
    """
    ok = F.col("category").isin("data_centre", "water_infrastructure") & F.col("lifecycle").isin(*FORWARD) & F.col("target_year").between(YEARS[0], YEARS[-1]) & F.col("demand_mw").isNotNull()
    sources = F.array_sort(F.array_distinct(F.filter(F.transform("source_ids", lambda x: F.trim(x)), lambda x: x != "")))
    d = assets.where(ok).withColumn("source_ids", sources).where(F.size("source_ids") > 0).join(regions.select("geography_id").distinct(), "geography_id", "left_semi")
    ident = F.when(F.trim("id") != "", F.trim("id")).otherwise(F.raise_error(F.lit("forward demand asset requires an id")).cast("string"))
    return d.select(F.concat_ws(":", ident, "target_year").alias("increment_id"), "geography_id", "target_year", parts_of(F.col("demand_mw"), lambda p: F.bround((F.col(f"demand_mw.{p}") * 8.76).cast("decimal(28,9)"), 6).cast("double")).alias("demand_gwh"), "source_ids")


def apply_increments(demand: DataFrame, increments: DataFrame) -> DataFrame:
    """Demand ranges plus the increments of exactly that region and year; an increment counts once, however often it stands."""
    once = increments.dropDuplicates(["increment_id"])
    sums = once.groupBy("geography_id", F.col("target_year").alias("year")).agg(range_sum("demand_gwh").alias("_more"), F.array_sort(F.collect_set("increment_id")).alias("applied"))
    d = demand.join(sums, ["geography_id", "year"], "left")
    more = parts_of(F.col("demand"), lambda p: F.col(f"demand.{p}") + F.coalesce(F.col(f"_more.{p}"), F.lit(0.0)))
    return d.withColumn("demand", F.when(F.col("demand").isNotNull(), more)).withColumn("applied", F.coalesce("applied", F.expr("array()").cast("array<string>"))).drop("_more")


def demand_weights(population: DataFrame, unavailable: DataFrame, activity: DataFrame, industrial: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shares and scores per region and year, and the countries that stay whole.

    ``population`` has geography_id, country, year, population; the components
    geography_id, year, value. All or nothing: a country with any unavailable
    region is left at country level. A component counts for a country and year
    where its sum is above zero; one that repeats a region and year raises.
    """
    whole = unavailable.select("country").distinct()
    rows = population.join(whole, "country", "left_anti")
    at = ["geography_id", "year"]

    def once(values: DataFrame, name: str) -> DataFrame:
        twice = F.raise_error(F.concat(F.lit(f"{name} repeats "), F.concat_ws(" ", *at))).cast("double")
        return values.groupBy(*at).agg(F.when(F.count(F.lit(1)) == 1, F.max("value")).otherwise(twice).cast("double").alias(name))

    parts = {"population": F.col("population").cast("double"), "activity": F.col("activity"), "industrial": F.col("industrial")}
    own = rows.join(once(activity, "activity"), at, "left").join(once(industrial, "industrial"), at, "left")
    own = written(own.select("*", *[v.alias(f"_{k}") for k, v in parts.items()]).drop("activity", "industrial"))
    sums = own.groupBy("country", "year").agg(*[F.sum(money(F.col(f"_{k}"))).cast("double").alias(f"_all_{k}") for k in parts])
    share = lambda k: F.when(F.col(f"_all_{k}") > 0, F.col(f"_{k}") / F.col(f"_all_{k}")).alias(f"{k}_share")
    d = own.join(sums, ["country", "year"]).select(*population.columns, *[share(k) for k in parts])
    scored = d.withColumn("score", M.allocation_score(F.col("population_share"), F.col("activity_share"), F.col("industrial_share"))).withColumn("grade", M.allocation_grade(F.col("activity_share"), F.col("industrial_share")))
    missing = unavailable.groupBy("country").agg(F.array_sort(F.collect_set("geography_id")).alias("unavailable"), F.array_sort(F.collect_set("year")).alias("years"))
    return scored, missing


def country_level_rows(regions: DataFrame, whole: DataFrame, controls: DataFrame, years: Sequence[int] = YEARS) -> DataFrame:
    """Rows without metrics, one per forecast year, of the regions whose country stays whole, with the national control."""
    d = regions.select("geography_id", "country").join(whole.select("country").distinct(), "country", "left_semi")
    d = d.select("*", F.explode(F.array(*[F.lit(y) for y in years])).alias("year"))
    none = F.lit(None).cast("double")
    return d.join(controls.select("country", F.col("control").alias("national_control")), "country", "left").select("geography_id", "country", "year", "national_control", *[none.alias(c) for c in ("demand", "peak", "generation", "dependable")], F.lit("country_level_only").alias("availability"), F.lit(0.0).alias("confidence"))


# --- supply ----------------------------------------------------------------


def factor_inputs(mixes: DataFrame, plants: DataFrame) -> DataFrame:
    """Generation and operating capacity per country, technology, region and year, from official mixes (map, GWh) and plants.

    What the capacity could not have produced within a year is left out.
    """
    g = mixes.select("country", "geography_id", "year", F.explode("mix").alias("technology", "generation"))
    c = plants.where(F.col("lifecycle") == "operational").groupBy("geography_id", "technology").agg(F.sum(money(F.col("capacity.central"))).cast("double").alias("capacity"))
    d = g.join(c, ["geography_id", "technology"])
    return d.where((F.col("generation") >= 0) & (F.col("capacity") > 0) & (F.col("generation") <= F.col("capacity") * 8.76))


def observed_factors(inputs: DataFrame) -> DataFrame:
    return observed_factor(inputs, ["country", "technology"], "year", "generation", "capacity")


def plant_supply(plants: DataFrame, factors: DataFrame, assumptions: DataFrame, years: Sequence[int] = YEARS) -> DataFrame:
    """Every plant in every year: delivery factor, installed MW, generation and dependable capacity (ranges), confidences.

    ``plants``: plant_id, geography_id, country, technology, lifecycle, raw_status,
    capacity (range), capacity_kind, reported_gwh, reported_dependable (ranges),
    commissioning_year, retirement_year, target_year. ``factors``: observed ones
    by country and technology (central, low, high). ``assumptions``: technology
    with capacity_factor and capacity_credit (ranges).
    """
    known = factors.select("country", "technology", F.struct("low", "central", "high").alias("observed"))
    d = plants.join(known, ["country", "technology"], "left").join(assumptions, "technology", "left")
    d = d.select("*", F.explode(F.array(*[F.lit(y) for y in years])).alias("year"))
    factor = M.delivery_factor(F.col("lifecycle"), F.col("year"), F.col("commissioning_year"), F.col("retirement_year"), F.col("target_year"), F.col("raw_status"))
    d = d.withColumn("delivery", factor).withColumn("reported_gwh", F.col("reported_gwh").cast(RANGE)).withColumn("reported_dependable", F.col("reported_dependable").cast(RANGE))
    times = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), parts_of(a, lambda p: a[p] * b[p]))
    capacity, of = F.col("capacity"), F.coalesce("observed", "capacity_factor")
    generation = F.coalesce(F.col("reported_gwh"), range_times(times(capacity, of), F.lit(8.76)))
    dependable = F.coalesce(F.col("reported_dependable"), times(capacity, F.col("capacity_credit")))
    coming = F.col("lifecycle").isin(*FORWARD)
    sure = lambda c: F.when(coming, F.least(c, F.lit(55))).otherwise(c)
    return d.select(
        "plant_id", "geography_id", "year", "delivery", (F.col("delivery") > 0).alias("eligible"),
        (F.col("capacity.central") * F.col("delivery")).alias("installed"), range_times(generation, F.col("delivery")).alias("generation"), range_times(dependable, F.col("delivery")).alias("dependable"),
        sure(F.when(F.col("reported_gwh").isNotNull(), 92).when(F.col("observed").isNotNull(), 82).otherwise(55)).alias("generation_confidence"),
        sure(F.when(F.col("capacity_kind").isin("observed", "reported"), 90).otherwise(60)).alias("installed_confidence"),
        sure(F.when(F.col("reported_dependable").isNotNull(), 92).otherwise(55)).alias("dependable_confidence"),
    )


def regional_supply(supply: DataFrame) -> DataFrame:
    """Per region and year the sums over plants that deliver; per metric its coverage and least confidence, and the least of all."""
    d = supply.where("eligible")
    out, metrics = [], ("generation", "dependable", "installed")
    for m in metrics:
        there = F.col(m).isNotNull()
        total = range_sum(m) if m != "installed" else F.when(F.count(m) > 0, F.sum(money(F.col(m))).cast("double"))
        out += [total.alias(m), F.round(100.0 * F.count_if(there) / F.count("*"), 4).alias(f"{m}_coverage"), F.coalesce(F.min(F.when(there, F.col(f"{m}_confidence"))), F.lit(0)).alias(f"{m}_confidence")]
    g = d.groupBy("geography_id", "year").agg(F.count("*").alias("plants"), *out)
    return g.withColumn("coverage", F.least(*[f"{m}_coverage" for m in metrics])).withColumn("confidence", F.least(*[f"{m}_confidence" for m in metrics]))


# --- balance and forecast ------------------------------------------------------


def power_balance(d: DataFrame) -> DataFrame:
    """Gap (demand less generation) and net balance of rows with demand, generation, interchange (ranges) and unmet, unmet_kind.

    The net balance needs a reported interchange; unmet demand counts only as an
    observed or reported one. Nothing absent becomes zero.
    """
    net = F.struct(*[(F.col(f"generation.{p}") + F.col(f"interchange.{p}") - F.col(f"demand.{q}")).alias(p) for p, q in zip(PARTS, reversed(PARTS), strict=True)])
    whole = F.col("generation").isNotNull() & F.col("interchange").isNotNull() & F.col("demand").isNotNull()
    return d.withColumn("gap", range_gap(F.col("demand"), F.col("generation"))).withColumn("net_balance", F.when(whole, net)).withColumn("unmet", F.when(F.col("unmet_kind").isin("observed", "reported"), F.col("unmet")))


def forecast(demand: DataFrame, supply: DataFrame, official: DataFrame) -> DataFrame:
    """Forecast rows per region and year: official observations field by field, else demand and supply; peaks, balances, scores.

    ``demand``: geography_id, year, demand, peak (ranges), demand_confidence,
    demand_coverage. ``official``: geography_id, year, demand, generation, peak,
    dependable, interchange (ranges, null where not reported), unmet, unmet_kind.
    A peak that nobody reports is flat load, demand by 8.76. Joins take about
    ``TASK_ROWS`` rows of demand a task: by their compressed bytes, which are few
    for constants, a task would be given millions.
    """
    keys = ["geography_id", "year"]
    tasks = max(1, -(-demand.count() // TASK_ROWS))
    dealt = lambda x: x.repartition(tasks, *keys)
    o = official.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("demand", "generation", "peak", "dependable")], "interchange", "unmet", "unmet_kind")
    own = supply.select(*keys, "generation", "dependable", "installed", F.col("confidence").alias("supply_confidence"), F.col("coverage").alias("supply_coverage"))
    d = dealt(demand).join(dealt(own), keys, "left").join(dealt(o), keys, "left")
    for c in ("demand", "generation", "peak", "dependable"):
        d = d.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    d = d.withColumn("peak", F.coalesce("peak", F.when(F.col("demand").isNotNull(), parts_of(F.col("demand"), lambda p: F.col(f"demand.{p}") / 8.76))))
    d = power_balance(d)
    d = d.withColumn("confidence", F.least("demand_confidence", F.coalesce("supply_confidence", F.lit(0)))).withColumn("coverage", F.least("demand_coverage", F.coalesce("supply_coverage", F.lit(0.0))))
    return scored(d, tasks)


def scored(d: DataFrame, tasks: int) -> DataFrame:
    """Balance index and its coverage; growth is against the region's first year, found by aggregation. Joined in ``tasks`` tasks."""
    first = d.groupBy("geography_id").agg(F.min_by("demand.central", "year").alias("_first"))
    d = d.repartition(tasks, "geography_id").join(first.repartition(tasks, "geography_id"), "geography_id")
    parts = M.balance_inputs(F.col("peak.central"), F.col("dependable.central"), F.col("demand.central"), F.col("gap.central"), F.col("unmet"), F.col("_first"))
    return d.withColumn("balance_score", M.balance_score(parts)).withColumn("balance_coverage", M.balance_coverage(parts)).drop("_first")


def energy_model(regions: DataFrame, controls: DataFrame, weights: DataFrame, increments: DataFrame, plants: DataFrame, mixes: DataFrame, assumptions: DataFrame, official: DataFrame, as_of: int) -> DataFrame:
    """From national controls to scored regional forecasts.

    ``controls``: country, year, control, confidence, coverage. ``weights``:
    geography_id, country, score, grade, covariate_year, coverage. ``official``
    as in ``forecast``; its demand fixes a region's share of the control.
    """
    national = carried(latest_control(controls, "country", "year", "control")).withColumnsRenamed({"confidence": "control_confidence", "coverage": "control_coverage"})
    fixed = official.where(F.col("demand").isNotNull()).select("geography_id", "year", F.col("demand.central").alias("official"))
    spots = weights.select("*", F.explode(F.array(*[F.lit(y) for y in YEARS])).alias("year")).join(fixed, ["geography_id", "year"], "left")
    d = M.allocate(spots, national, ["country", "year"], "geography_id", "score", "official", "control")
    fraction, confidence = M.graded(F.col("grade"), F.lit(as_of) - F.col("covariate_year"))
    d = d.select("geography_id", "country", "year", F.when(F.col("official").isNotNull(), M.spread(F.col("demand"), F.lit(0.0))).otherwise(M.spread(F.col("demand"), fraction)).alias("demand"), F.lit(None).cast(RANGE).alias("peak"), F.least("control_confidence", confidence).alias("demand_confidence"), F.least("control_coverage", "coverage").alias("demand_coverage"))
    d = apply_increments(d, increments)
    supply = regional_supply(plant_supply(plants, observed_factors(factor_inputs(mixes, plants)), assumptions))
    return forecast(d, supply, official).join(regions.select("geography_id").distinct(), "geography_id", "left_semi")
