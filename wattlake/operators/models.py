"""Domain models: allocation, supply, balance and scores, null-aware throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlake.operators.graph import written
from wattlake.operators.relational import money

# Weights of the demand score and of the balance index.
DEMAND_WEIGHTS = {"load": 60.0, "timing": 15.0, "scarcity": 25.0}
BALANCE_WEIGHTS = {"capacity": 35.0, "local": 30.0, "unmet": 15.0, "growth": 10.0, "delivery": 10.0}
# covariates' weights in the allocation score.
SHARE_WEIGHTS = {"activity": 0.55, "population": 0.30, "industrial": 0.15}
# Confidence by where a generation estimate comes from.
ESTIMATE_CONFIDENCE = {"reported": 92, "observed": 82, "fallback": 55}


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def demand_score(load: Column, timing: Column, scarcity: Column) -> Column:
    """Rounded weighted sum; null unless all three are there."""
    parts = [F.bround(clamp(c) * w / 100, 1) for c, w in zip((load, timing, scarcity), DEMAND_WEIGHTS.values(), strict=True)]
    return F.bround(parts[0] + parts[1] + parts[2], 0)


def balance_score(parts: dict[str, Column], least: float = 60.0, unmet_kind: Column | None = None) -> Column:
    """Mean of the parts that are there, by weight, unrounded; null below ``least`` of 100 weights.

    A part out of 0 to 100 raises. ``unmet_kind`` is the value kind of the unmet
    part, which counts only as an observed or reported one.
    """
    parts = dict(parts)
    if unmet_kind is not None and "unmet" in parts:
        parts["unmet"] = F.when(unmet_kind.isin("observed", "reported"), parts["unmet"])
    bad = F.raise_error(F.lit("index out of 0 to 100")).cast("double")
    parts = {k: F.when(c.isNull() | c.between(0, 100), c).otherwise(bad) for k, c in parts.items()}
    return F.when(balance_coverage(parts) >= least, sum((F.coalesce(c * BALANCE_WEIGHTS[k], F.lit(0.0)) for k, c in parts.items()), F.lit(0.0)) / balance_coverage(parts))


def balance_coverage(parts: dict[str, Column]) -> Column:
    """The weights of the parts that are there."""
    return sum((F.when(c.isNotNull(), F.lit(BALANCE_WEIGHTS[k])).otherwise(0.0) for k, c in parts.items()), F.lit(0.0))


def balance_inputs(peak: Column, dependable: Column, demand: Column, gap: Column, unmet: Column, first_demand: Column) -> dict[str, Column]:
    """The balance index's parts, 0 to 100 or null; supply delivery has no source."""
    share = lambda x, whole: F.when(whole > 0, clamp(100 * x / whole))
    return {
        "capacity": F.when(peak > 0, clamp(100 - 100 * dependable / peak)), "local": share(F.greatest(gap, F.when(gap.isNotNull(), 0.0)), demand), "unmet": share(unmet, demand),
        "growth": share(F.greatest(demand - first_demand, F.when((demand - first_demand).isNotNull(), 0.0)), first_demand), "delivery": F.lit(None).cast("double"),
    }


def supporting_lenses(load: Column, timing: Column, scarcity: Column) -> tuple[Column, Column]:
    """Site attractiveness and system risk, whole numbers from 0 to 100."""
    # The lenses' weights.
    attractive = F.lit(54.0) + 0.28 * load + 0.18 * timing - 0.24 * scarcity
    risk = 0.72 * scarcity + 0.18 * load + 0.10 * (100 - timing)
    whole = lambda c: clamp(F.bround(c.cast("decimal(18,6)"), 0).cast("double"))
    return whole(attractive), whole(risk)


# A cluster's drivers by year, as shares of those of 2030.
CLUSTER_YEARS = {2026: 0.72, 2027: 0.80, 2028: 0.88, 2029: 0.95, 2030: 1.00, 2031: 1.04}


def cluster_years(clusters: DataFrame, drivers: list[str]) -> DataFrame:
    """Clusters in every year, each driver scaled by the year's factor, one decimal, 100 at most."""
    years = F.explode(F.map_from_arrays(F.array(*[F.lit(y) for y in CLUSTER_YEARS]), F.array(*[F.lit(f) for f in CLUSTER_YEARS.values()]))).alias("year", "factor")
    d = clusters.select("*", years)
    return d.select(*[F.least(F.lit(100.0), F.bround((F.col(c) * F.col("factor")).cast("decimal(18,6)"), 1).cast("double")).alias(c) if c in drivers else F.col(c) for c in d.columns if c != "factor"])


def allocation_score(population: Column, activity: Column, industrial: Column) -> Column:
    """Mean of the shares that are there, by weight; null without population, which every region needs."""
    cols = {"activity": activity, "population": population, "industrial": industrial}
    weight = sum((F.when(c.isNotNull(), F.lit(SHARE_WEIGHTS[k])).otherwise(0.0) for k, c in cols.items()), F.lit(0.0))
    total = sum((F.coalesce(c * SHARE_WEIGHTS[k], F.lit(0.0)) for k, c in cols.items()), F.lit(0.0))
    return F.when(population.isNotNull(), total / weight)


def allocation_grade(activity: Column, industrial: Column) -> Column:
    return F.when(activity.isNull() & industrial.isNull(), "population_only").otherwise("multi_covariate")


# Fixed values by grade: uncertainty at no age, per year, at most; confidence at no age, lost per year.
GRADES = {"multi_covariate": (0.12, 0.01, 0.30, 82.0, 1.5), "population_only": (0.25, 0.02, 0.50, 68.0, 2.5)}


def graded(grade: Column, age: Column) -> tuple[Column, Column]:
    """Uncertainty fraction and confidence of an allocation by its grade and its covariates' age in years."""
    pick = lambda i: F.when(grade == "multi_covariate", GRADES["multi_covariate"][i]).when(grade == "population_only", GRADES["population_only"][i])
    years = F.greatest(F.lit(0), age)
    return uncertainty(years, pick(0), pick(1), pick(2)), F.greatest(F.lit(0.0), pick(3) - years * pick(4))


def spread(central: Column, fraction: Column) -> Column:
    """A range around a value; its low part is not below zero."""
    return F.when(central.isNotNull(), F.struct(F.greatest(F.lit(0.0), central * (1 - fraction)).alias("low"), central.alias("central"), (central * (1 + fraction)).alias("high")))


def wide(c: Column) -> Column:
    """Exact sums of small numbers: eighteen places."""
    return c.cast("decimal(38,18)")


def allocate(regions: DataFrame, controls: DataFrame, key: str | list[str], region: str, score: str, official: str, control: str, places: int | None = None) -> DataFrame:
    """National controls to regions: official rows stand, the rest follows the scores, sums are the controls.

    ``controls`` has one row per ``key`` (a country, or country and year). Adds
    ``demand``: in full precision, summed exactly to eighteen places, or in
    ``places`` decimals; the top score (smallest id) takes what rounding leaves.
    Officials beyond the control, or a rest that no open region with a score
    above zero can take, by more than 1e-12 of the control, raise. Open regions
    of score zero get zero, those without a score null. Regions and their
    controls are written once; sums per key are joined back: no window, so a
    large country is no single task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    exact = lambda c: (wide(c) if places is None else F.bround(c, places).cast(f"decimal(24,{places})"))
    kept = "decimal(38,18)" if places is None else f"decimal(24,{places})"
    is_open = F.col(official).isNull()
    open_score = F.when(is_open & (F.col(score) > 0), F.col(score))
    joined = written(regions.join(controls, keys))
    top = F.min_by(region, F.when(open_score.isNotNull(), F.struct((-open_score).alias("s"), F.col(region).alias("r"))))
    whole = joined.groupBy(*keys).agg(F.max(control).alias("_control"), F.coalesce(F.sum(money(F.col(official))), F.lit(0)).cast("double").alias("_fixed"), F.sum(wide(open_score)).cast("double").alias("_open"), top.alias("_top"))
    slack = 1e-12 * F.greatest(F.abs("_control"), F.lit(1.0))
    rest = F.greatest(F.lit(0.0), F.col("_control") - F.col("_fixed"))
    raised = lambda text: F.raise_error(F.concat(F.lit(f"{text}: "), F.concat_ws(" ", *keys))).cast("double")
    checked = F.when(F.col("_fixed") > F.col("_control") + slack, raised("official demand exceeds its control")).when(F.col("_open").isNull() & (rest > slack), raised("no region can take the rest of its control")).otherwise(rest)
    whole = written(whole.withColumn("_rest", checked).drop("_control"))
    share = F.when(open_score.isNotNull(), F.col("_rest") * open_score / F.col("_open")).when(is_open & (F.col(score) == 0), 0.0)
    d = written(joined.join(whole.drop("_fixed"), keys).withColumn("demand", F.coalesce(exact(F.col(official)), exact(share))).drop("_open", "_rest"))
    given = d.groupBy(*keys).agg(F.sum("demand").alias("_given"))
    lack = (exact(F.col(control)) - F.col("_given")).cast(kept)
    takes = (F.col(region) == F.col("_top")) & open_score.isNotNull()
    return d.join(given, keys).withColumn("demand", (F.col("demand") + F.when(takes, lack).otherwise(F.lit(0).cast(kept))).cast("double")).drop("_top", "_given")


# Share of a coming plant's capacity that is counted on, by lifecycle.
DELIVERY = {"announced": 0.35, "planning_filed": 0.55, "permitted": 0.75, "under_construction": 0.90}
NO_DELIVERY = ("cancelled", "paused", "retired", "decommissioned", "shelved")


def delivery_factor(lifecycle: Column, year: Column, commissioning: Column, retirement: Column, target: Column | None = None, raw: Column | None = None, factors: dict[str, float] | None = None) -> Column:
    """Share of a plant's capacity that counts in a year.

    None for lifecycles or raw statuses that deliver nothing, after the year of
    retirement, and before the commissioning (operational) or target year; a
    coming plant without a year delivers nothing. Unknown lifecycles raise.
    """
    factors = DELIVERY if factors is None else factors
    start = F.coalesce(*([target] if target is not None else []), commissioning)
    gone = lifecycle.isin(*NO_DELIVERY)
    if raw is not None:
        gone |= F.coalesce(F.lower(raw).isin(*NO_DELIVERY), F.lit(False))
    future = F.raise_error(F.concat(F.lit("unsupported lifecycle: "), F.coalesce(lifecycle, F.lit("null")))).cast("double")
    for k, v in factors.items():
        future = F.when(lifecycle == k, F.when(start.isNull() | (start > year), 0.0).otherwise(F.lit(v))).otherwise(future)
    return F.when(gone, 0.0).when(retirement.isNotNull() & (year > retirement), 0.0).when(lifecycle == "operational", F.when(commissioning.isNull() | (commissioning <= year), 1.0).otherwise(0.0)).otherwise(future)


def estimate(reported: Column, observed_factor: Column, fallback_factor: Column, capacity: Column) -> tuple[Column, Column]:
    """Annual generation (GWh) and its confidence: reported, else the observed factor, else the fallback."""
    value = F.coalesce(reported, capacity * observed_factor * 8.76, capacity * fallback_factor * 8.76)
    kind = F.when(reported.isNotNull(), ESTIMATE_CONFIDENCE["reported"]).when(observed_factor.isNotNull(), ESTIMATE_CONFIDENCE["observed"]).otherwise(ESTIMATE_CONFIDENCE["fallback"])
    return value, F.when(value.isNotNull(), kind)


def uncertainty(age: Column, base: Column, step: Column, most: Column) -> Column:
    return F.least(most, base + age * step)
