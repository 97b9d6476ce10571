"""Fixed vocabularies of the feeds and the Column expressions that apply them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattlake.functions.scalars import key_normalize

# Technology names of the unit tracker. The first one contained in a text counts where none is equal.
TRACKER_TECHNOLOGIES = {
    "photovoltaic": "solar",
    "solar photovoltaic": "solar",
    "solar pv": "solar",
    "solar": "solar",
    "onshore wind": "wind",
    "offshore wind": "wind",
    "onshore_wind": "wind",
    "offshore_wind": "wind",
    "wind": "wind",
    "hydroelectric": "hydro",
    "hydropower": "hydro",
    "hydro": "hydro",
    "nuclear": "nuclear",
    "ccgt": "gas",
    "ocgt": "gas",
    "combined cycle": "gas",
    "gas": "gas",
    "natural gas": "gas",
    "coal": "coal",
    "oil": "oil",
    "petroleum": "oil",
    "biomass": "biomass",
    "bioenergy": "biomass",
    "geothermal": "geothermal",
}

# Lifecycle words of the unit tracker.
TRACKER_LIFECYCLES = {
    "operating": "operational",
    "operational": "operational",
    "construction": "under_construction",
    "under construction": "under_construction",
    "pre construction": "announced",
    "planned": "announced",
    "announced": "announced",
    "mothballed": "paused",
    "mothball": "paused",
    "paused": "paused",
    "inactive": "paused",
    "retired": "retired",
    "decommissioned": "retired",
    "cancelled": "cancelled",
    "canceled": "cancelled",
    "shelved": "shelved",
}

# Lifecycle words of any source in the canonical vocabulary.
CANONICAL_LIFECYCLES = {
    "operating": "operational",
    "operational": "operational",
    "construction": "under_construction",
    "under construction": "under_construction",
    "planned": "announced",
    "proposed": "announced",
    "pre construction": "announced",
    "announced": "announced",
    "planning filed": "planning_filed",
    "permitted": "permitted",
    "mothballed": "paused",
    "mothball": "paused",
    "paused": "paused",
    "shelved": "paused",
    "inactive": "paused",
    "retired": "cancelled",
    "decommissioned": "cancelled",
    "cancelled": "cancelled",
    "canceled": "cancelled",
}

# Units of energy in GWh, units of power in MW.
ENERGY_UNITS = {
    "mwh": 0.001,
    "megawatt hour": 0.001,
    "megawatt hours": 0.001,
    "megawatthour": 0.001,
    "megawatthours": 0.001,
    "gwh": 1.0,
    "gigawatt hour": 1.0,
    "gigawatt hours": 1.0,
    "twh": 1000.0,
    "terawatt hour": 1000.0,
    "terawatt hours": 1000.0,
    "million kilowatt hour": 1.0,
    "million kilowatt hours": 1.0,
    "million kilowatthour": 1.0,
    "million kilowatthours": 1.0,
    "thousand megawatt hour": 1.0,
    "thousand megawatt hours": 1.0,
    "thousand megawatthour": 1.0,
    "thousand megawatthours": 1.0,
}
POWER_UNITS = {"mw": 1.0, "megawatt": 1.0, "megawatts": 1.0}

# Licences whose data may be passed on, and the beginnings of others.
OPEN_LICENCES = ("ccby40", "cc010", "odbl10", "uspublicdomain", "publicdomain", "ogl", "ogl10", "ogl20", "ogl30")
OPEN_LICENCE_STARTS = ("ogl", "opengovernmentlicence", "opengovernmentlicense")

# Ranks of sources, of value kinds, of location precisions, of public sources.
SOURCE_RANK = {"official_verified": 4, "curated_official": 4, "research_verified": 3, "community_mapped": 2, "modelled": 1}
VALUE_KIND_RANK = {"unavailable": 0, "inherited": 1, "estimated": 2, "observed": 3, "reported": 3}
PRECISION_RANK = {"region_centroid": 0, "city_centroid": 1, "exact": 2}
PUBLIC_SOURCE_RANK = {"official_power": 4, "gem_power": 3, "gem-global-integrated-power-tracker": 3, "wri_power": 2, "wri-global-power-plant-database": 2, "osm_power": 1, "openstreetmap-power": 1}

# Words that say nothing about which plant is meant.
GENERIC_PLANT_WORDS = ("electric", "electricity", "generating", "generation", "plant", "power", "project", "station")
# Namespaces of units' ids.
UNIT_NAMESPACES = ("gemunit", "unit", "unitid", "officialunit")
# What counts as built and as planned.
OPERATING = ("operational",)
PLANNED = ("announced", "planning_filed", "permitted", "under_construction")


def lookup(c: Column, values: dict) -> Column:
    """The value of a small fixed map, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c)


def rank(c: Column, values: dict[str, int], otherwise: int = 0) -> Column:
    return F.coalesce(lookup(c, values), F.lit(otherwise))


def public_source_rank(ids: Column) -> Column:
    """The best rank among source ids."""
    return F.coalesce(F.array_max(F.transform(ids, lambda x: rank(x, PUBLIC_SOURCE_RANK))), F.lit(0))


def technology(*names: Column, vocabulary: dict[str, str] | None = None) -> Column:
    """Of the names in order: the technology a name equals, else the first whose word it contains; ``other`` if none."""
    words = vocabulary or TRACKER_TECHNOLOGIES
    out = []
    for name in names:
        key = key_normalize(F.coalesce(name, F.lit("")))
        within = F.lit(None).cast("string")
        for word, kind in reversed(words.items()):
            within = F.when(key.contains(word), kind).otherwise(within)
        out.append(F.coalesce(lookup(key, words), within))
    return F.coalesce(*out, F.lit("other"))


def lifecycle(c: Column, vocabulary: dict[str, str] | None = None, unknown: str = "null") -> Column:
    """The lifecycle a word stands for; unknown words are null, or raise."""
    found = lookup(key_normalize(c), vocabulary or CANONICAL_LIFECYCLES)
    return found if unknown == "null" else F.coalesce(found, F.raise_error(F.concat(F.lit("unsupported lifecycle: "), F.coalesce(c, F.lit("null")))).cast("string"))


def raw_status(status: Column, word: Column) -> Column:
    """The source's own status, kept where the canonical lifecycle says less."""
    key = key_normalize(word)
    return F.coalesce(F.nullif(F.trim(status), F.lit("")), F.when(key.isin("shelved", "retired", "decommissioned", "mothballed", "mothball"), key))


def licence_token(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "")


def is_open_licence(c: Column) -> Column:
    t = licence_token(c)
    ok = t.isin(*OPEN_LICENCES)
    for start in OPEN_LICENCE_STARTS:
        ok |= t.startswith(start)
    return F.coalesce(ok, F.lit(False))


def require_open_licence(c: Column, label: str) -> Column:
    """The licence, or an error."""
    return F.when(is_open_licence(c), c).otherwise(F.raise_error(F.lit(f"{label} licence is not redistributable")).cast("string"))


def metric(value: Column, unit: Column, dimension: str) -> Column:
    """A value in GWh (energy) or MW (power); blank with a blank unit is null, a unit of the other dimension or none known raises."""
    own, other = (ENERGY_UNITS, POWER_UNITS) if dimension == "energy" else (POWER_UNITS, ENERGY_UNITS)
    u, v = key_normalize(F.coalesce(unit, F.lit(""))), F.trim(F.coalesce(value, F.lit("")))
    number = F.regexp_replace(v, ",", "").try_cast("double")
    bad = lambda text: F.raise_error(F.concat(F.lit(text), F.coalesce(unit, F.lit("")), F.lit(" "), v)).cast("double")
    good = F.when(v == "", F.lit(None).cast("double")).when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), bad(f"invalid {dimension} value: "))
    return F.when((v == "") & (u == ""), F.lit(None).cast("double")).when(u.isin(*other), bad(f"{dimension} metric is incompatible with unit ")).when(~u.isin(*own), bad(f"unsupported {dimension} unit: ")).otherwise(good.otherwise(number * lookup(u, own)))
