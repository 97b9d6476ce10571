"""Regional population: overrides, fallbacks, reconciliation with national controls, and the rules of a release."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlake.operators.relational import largest_remainder, violations

KEY = ["geography_id", "year"]


def official_overrides(rows: DataFrame, unavailable: DataFrame, overrides: DataFrame, years: Sequence[int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with official values in place of modelled or unavailable ones, what stays unavailable, and rejected overrides with the reason.

    ``overrides``: geography_id, country, year, population, source_id,
    source_url, release. One for each region and year; a country must agree.
    """
    known = rows.select(*KEY, "country").union(unavailable.select(*KEY, "country")).dropDuplicates(KEY).withColumnRenamed("country", "_country")
    o = overrides.join(known, KEY, "left").join(overrides.groupBy(*KEY).agg(F.count("*").alias("_n")), KEY, "left")
    reason = (
        F.when(F.trim(F.coalesce("geography_id", F.lit(""))) == "", "geography id missing").when(~F.coalesce(F.col("year").isin(*years), F.lit(False)), "year out of range")
        .when(F.col("_n") > 1, "duplicate").when(~F.coalesce(F.col("country").rlike("^[A-Z]{2}$"), F.lit(False)), "country is no ISO2 code")
        .when(F.col("population").isNull() | (F.col("population") < 0), "population invalid")
        .when(~F.coalesce(F.col("source_url").rlike("^https?://") & (F.trim("source_id") != "") & (F.trim("release") != ""), F.lit(False)), "provenance missing")
        .when(F.col("_country").isNull(), "unknown geography").when(F.col("_country") != F.col("country"), "country disagrees")
    )
    judged = o.withColumn("reason", reason).drop("_n", "_country")
    good = judged.where("reason is null").select(*KEY, F.col("country"), F.col("population").cast("long").alias("population"), F.lit("reported").alias("value_kind"))
    kept = rows.select(*KEY, "country", F.col("population").cast("long").alias("population"), "value_kind").join(good, KEY, "left_anti")
    return kept.unionByName(good), unavailable.join(good, KEY, "left_anti"), judged.where("reason is not null").select(*KEY, "reason")


def fill_unavailable(rows: DataFrame, unavailable: DataFrame, fallback: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a fallback's values where the primary has none, and what stays unavailable."""
    found = fallback.where(F.col("population").isNotNull()).join(unavailable.select(*KEY), KEY, "left_semi")
    return rows.unionByName(found.select(*rows.columns)), unavailable.join(found, KEY, "left_anti")


def reconcile(rows: DataFrame, controls: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Whole people that add up to each country's and year's control.

    Within ``tolerance`` rows stay; else observed and reported rows stand and the
    modelled ones are scaled to the rest, leftovers by largest remainder.
    Duplicate controls, officials beyond the control, and a rest without
    modelled people raise.
    """
    keys = ["country", "year"]
    raised = lambda text: F.raise_error(F.lit(text)).cast("long")
    once = controls.groupBy(*keys).agg(F.when(F.count("*") == 1, F.min("population")).otherwise(raised("duplicate control")).cast("long").alias("control"))
    official = F.col("value_kind").isin("observed", "reported")
    sums = rows.groupBy(*keys).agg(F.sum("population").alias("_sum"), F.coalesce(F.sum(F.when(official, F.col("population"))), F.lit(0)).alias("_fixed"))
    d = rows.join(sums.join(once, keys, "left"), keys)
    off = F.coalesce(F.abs(F.col("_sum") - F.col("control")) / F.greatest("control", F.lit(1)) > tolerance, F.lit(False))
    beyond, bare = F.col("control") < F.col("_fixed"), F.col("_sum") == F.col("_fixed")
    guarded = F.when(off & beyond, raised("official population exceeds its control")).when(off & bare, raised("no modelled population to scale")).otherwise(F.col("population"))
    d = d.withColumn("population", guarded)
    scale = largest_remainder(d.where(off & ~official).withColumn("_rest", F.col("control") - F.col("_fixed")), keys, "geography_id", "population", "_rest")
    scaled = scale.withColumn("population", F.col("units")).withColumn("value_kind", F.lit("estimated")).drop("units", "_rest")
    stays = d.where(~(off & ~official))
    return stays.unionByName(scaled.select(*stays.columns)).drop("_sum", "_fixed", "control")


def release_violations(rows: DataFrame, unavailable: DataFrame, active: DataFrame, years: Sequence[int]) -> DataFrame:
    """Broken rules of a population release: id (region:year) and rule."""
    wanted = active.select("geography_id", F.explode(F.array(*[F.lit(y) for y in years])).alias("year"))
    ident = F.concat_ws(":", "geography_id", "year").alias("id")
    seen = rows.select(*KEY).withColumn("where", F.lit("row")).union(unavailable.select(*KEY).withColumn("where", F.lit("unavailable")))
    count = seen.groupBy(*KEY).agg(F.count_if(F.col("where") == "row").alias("r"), F.count_if(F.col("where") == "unavailable").alias("u"))
    both = wanted.withColumn("wanted", F.lit(True)).join(count, KEY, "full_outer")
    sets = violations(both.withColumn("id", F.concat_ws(":", "geography_id", "year")), "id", {
        "active_geography_and_year": F.col("wanted"), "row_or_unavailable": F.coalesce(F.col("r") + F.col("u") > 0, F.lit(False)), "one_row": F.coalesce("r", F.lit(0)) <= 1, "not_both": ~((F.coalesce("r", F.lit(0)) > 0) & (F.coalesce("u", F.lit(0)) > 0)),
    })
    ok = {"population_whole": F.col("population") >= 0, "country_iso2": F.col("country").rlike("^[A-Z]{2}$"), "value_kind": F.col("value_kind").isin("reported", "observed", "estimated", "inherited"), "confidence": F.col("confidence").between(0, 100), "coverage": F.col("coverage").between(0, 100), "fingerprint": F.col("fingerprint").rlike("^[0-9a-f]{64}$")}
    own = violations(rows.select(ident, *[c for c in rows.columns if c not in KEY]), "id", {k: v for k, v in ok.items() if k in ("population_whole", "country_iso2", "value_kind") or k in rows.columns})
    return sets.union(own)


def release_metadata(rasters: DataFrame) -> DataFrame:
    """One row: years with their raster's checksum in order, and a fingerprint of both; a year or raster that repeats raises."""
    bad = F.raise_error(F.lit("a year has two rasters, or a raster two years")).cast("string")
    pairs = F.array_sort(F.collect_list(F.struct(F.col("year"), F.col("sha256"))))
    d = rasters.agg(pairs.alias("rasters"), F.count_distinct("year").alias("y"), F.count_distinct("sha256").alias("s"), F.count("*").alias("n"))
    return d.select("rasters", F.when((F.col("y") == F.col("n")) & (F.col("s") == F.col("n")), F.sha2(F.to_json("rasters"), 256)).otherwise(bad).alias("fingerprint"))


def is_stale(stored: DataFrame, current: DataFrame) -> DataFrame:
    """input and stale: which inputs' fingerprints differ, are new or are gone."""
    j = stored.withColumnRenamed("fingerprint", "_a").join(current.withColumnRenamed("fingerprint", "_b"), "input", "full_outer")
    return j.select("input", (~F.col("_a").eqNullSafe(F.col("_b"))).alias("stale"))


def raster_year(path, tag=None):
    """A raster's year: its tag, else the only year in its file's name; several different ones raise."""
    years = F.array_distinct(F.regexp_extract_all(F.regexp_extract(path, r"([^/]*)$", 1), F.lit(r"(?<!\d)(20\d{2})(?!\d)"), F.lit(1)))
    found = F.when(F.size(years) == 1, years[0].cast("int")).when(F.size(years) > 1, F.raise_error(F.concat(F.lit("several years in "), path)).cast("int"))
    return F.coalesce(tag, found) if tag is not None else found
