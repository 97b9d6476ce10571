"""Scalar functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_WORDS = ("", "none", "null", "nan", "inf", "-inf", "infinity", "-infinity", "n/a", "na")


def key_normalize(c: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def compact_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def canonical_identifier(c: Column, kind: str = "string") -> Column:
    """Trimmed text without null words; whole decimals lose their zero fraction; booleans are no identifiers."""
    if kind == "boolean":
        return F.lit(None).cast("string")
    t = F.trim(c.cast("string"))
    t = F.regexp_replace(t, r"^(-?\d+)\.0+$", "$1")
    return F.when(~F.lower(t).isin(*NULL_WORDS), t)


def expand_aliases(c: Column, aliases: dict[str, str]) -> Column:
    """The key with each word replaced by its alias, which may have several words."""
    words = F.split(key_normalize(F.coalesce(c, F.lit(""))), " ")
    if aliases:
        table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
        words = F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w))
    return F.trim(F.array_join(words, " "))


def name_signature(c: Column, generic: tuple[str, ...] = (), distinct: bool = True) -> Column:
    """Sorted words of a name without generic ones."""
    words = F.filter(F.split(key_normalize(c), " "), lambda w: (w != "") & ~w.isin(*generic) if generic else w != "")
    return F.array_join(F.array_sort(F.array_distinct(words) if distinct else words), " ")


def slug(c: Column, limit: int = 48) -> Column:
    """Hyphenated key; one over the limit is cut and closed by ten hex digits of its SHA-256."""
    s = F.regexp_replace(key_normalize(c), " ", "-")
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.substring(s, 1, limit - 11), F.lit("-"), F.substring(F.sha2(s.cast("binary"), 256), 1, 10)))


def parse_number(c: Column, blanks: tuple[str, ...] = ("", "n/a", "na", "unknown", "not found", "-")) -> Column:
    """A decimal number with optional thousands commas; blank words are null, anything else that is no finite number raises."""
    t = F.trim(F.regexp_replace(c, ",", ""))
    number = t.try_cast("double")
    return F.when(c.isNull() | F.lower(t).isin(*blanks), F.lit(None).cast("double")).when(finite(number), number).otherwise(F.raise_error(F.concat(F.lit("invalid number: "), c)).cast("double"))


def half_up(c: Column, places: int = 0) -> Column:
    """Rounded to ``places`` decimals, halves away from zero, by the decimal that is written and not the binary one."""
    return F.round(c.cast("string").cast("decimal(38,18)"), places).cast("double")


def capacity_mw(c: Column) -> Column:
    """Capacity text such as ``1,234.5 MW``, ``500 kW`` or ``2 GW`` in megawatts; null if it is none."""
    pattern = r"^\s*(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*([kKmMgG])[wW]\s*$"
    value = F.regexp_replace(F.regexp_extract(c, pattern, 1), ",", "").try_cast("double")
    unit = F.lower(F.regexp_extract(c, pattern, 2))
    return F.when(unit == "k", value / 1000).when(unit == "m", value).when(unit == "g", value * 1000)


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def log_band(c: Column, base: float) -> Column:
    """floor(log(x) / log(base)); zero for values that are not positive."""
    return F.when(c > 0, F.floor(F.log(c) / F.log(F.lit(base)))).otherwise(0).cast("long")


def log_index(mw: Column, top: float = 5000.0) -> Column:
    return F.least(F.lit(100.0), F.bround(100 * F.log1p(mw) / F.log1p(F.lit(top)), 1))


def mw_to_gwh(mw: Column) -> Column:
    return F.bround(mw * 8.76, 6)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


PARTS = ("low", "central", "high")


def parts_of(r: Column, f) -> Column:
    """A range whose parts are f(part's name)."""
    return F.struct(*[f(p).alias(p) for p in PARTS])


def value_range(low: Column, central: Column, high: Column) -> Column:
    """A range, or null unless low <= central <= high and all are finite."""
    ok = finite(low) & finite(central) & finite(high) & (low <= central) & (central <= high)
    return F.when(ok, F.struct(low.cast("double").alias("low"), central.cast("double").alias("central"), high.cast("double").alias("high")))


def strict_range(low: Column, central: Column, high: Column) -> Column:
    """A range; out of order or not finite raises, all null is null, a central value alone is all three."""
    alone = low.isNull() & high.isNull()
    got = value_range(F.when(alone, central).otherwise(low), central, F.when(alone, central).otherwise(high))
    return F.when(central.isNull() & alone, F.lit(None)).otherwise(F.coalesce(got, F.raise_error(F.lit("range out of order")).cast("struct<low:double,central:double,high:double>")))


def range_times(r: Column, factor: Column) -> Column:
    return F.when(r.isNotNull() & factor.isNotNull(), parts_of(r, lambda p: r[p] * factor))


def range_product(a: Column, b: Column) -> Column:
    """Part by part."""
    return F.when(a.isNotNull() & b.isNotNull(), parts_of(a, lambda p: a[p] * b[p]))


def range_plus(*ranges: Column) -> Column:
    """The sum of the ranges that are there, part by part; null if none is."""
    there = F.coalesce(*ranges).isNotNull()
    return F.when(there, parts_of(ranges[0], lambda p: sum((F.coalesce(r[p], F.lit(0.0)) for r in ranges), F.lit(0.0))))


def range_gap(demand: Column, supply: Column) -> Column:
    """Interval subtraction: the low gap is low demand less high supply."""
    gap = F.struct((demand["low"] - supply["high"]).alias("low"), (demand["central"] - supply["central"]).alias("central"), (demand["high"] - supply["low"]).alias("high"))
    return F.when(demand.isNotNull() & supply.isNotNull(), gap)


def checked(c: Column, label: str) -> Column:
    """A finite number or null; anything else raises."""
    return F.when(c.isNull() | finite(c), c).otherwise(F.raise_error(F.lit(f"{label} is not finite")).cast("double"))


def divide(a: Column, b: Column) -> Column:
    """a / b; zero divisors and results beyond the finite raise, nulls stay."""
    return F.when(b == 0, F.raise_error(F.lit("division by zero")).cast("double")).otherwise(checked(F.try_divide(a, b), "quotient"))


def public_url(c: Column) -> Column:
    """An http or https address with a host; ``www.`` without a scheme gets https; others are null."""
    t = F.trim(c)
    t = F.when(F.lower(t).startswith("www."), F.concat(F.lit("https://"), t)).otherwise(t)
    return F.when(t.rlike(r"^(?i)https?://[^\s/?#]+"), t)


def osm_element(c: Column) -> Column:
    """type/id of an element's address, or null."""
    pattern = r"^https://www\.openstreetmap\.org/(node|way|relation)/(\d+)$"
    return F.when(c.rlike(pattern), F.concat_ws("/", F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)))


def year_of(c: Column) -> Column:
    """The first year from 1900 to 2099 in a text."""
    return F.nullif(F.regexp_extract(c, r"\b((?:19|20)\d{2})\b", 1), F.lit("")).cast("int")


def wkt_point(c: Column) -> Column:
    """A point itself, else the middle of the geometry's box, six decimals; null if a coordinate is out of bounds or none is there."""
    pair = r"(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\s+(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"
    lon = F.transform(F.regexp_extract_all(c, F.lit(pair), F.lit(1)), lambda x: x.cast("double"))
    lat = F.transform(F.regexp_extract_all(c, F.lit(pair), F.lit(2)), lambda x: x.cast("double"))
    point = F.upper(F.ltrim(c)).startswith("POINT")
    at = lambda x: F.bround(F.when(point, F.try_element_at(x, F.lit(1))).otherwise((F.array_min(x) + F.array_max(x)) / 2), 6)
    x, y = at(lon), at(lat)
    return F.when(x.between(-180, 180) & y.between(-90, 90), F.struct(x.alias("lon"), y.alias("lat")))


def coordinates(lon: Column, lat: Column) -> Column:
    """Both coordinates, six decimals, or null; one alone or out of bounds raises."""
    bad = F.raise_error(F.lit("malformed coordinates")).cast("struct<lon:double,lat:double>")
    return F.when(lon.isNull() & lat.isNull(), F.lit(None)).when(lon.between(-180, 180) & lat.between(-90, 90), F.struct(F.bround(lon, 6).alias("lon"), F.bround(lat, 6).alias("lat"))).otherwise(bad)


def freshness_days(updated: Column, observed: Column) -> Column:
    """Days from the observation to the update; a negative number raises."""
    days = F.date_diff(updated.cast("string").substr(1, 10).try_cast("date"), observed.cast("string").substr(1, 10).try_cast("date"))
    return F.when(days < 0, F.raise_error(F.lit("observed after its update")).cast("int")).otherwise(days)


def observation_date(body: Column, updates: bool = True) -> Column:
    """The latest observationDate anywhere in a JSON text, else the latest updatedAt or updated_at; null if none parses."""
    latest = lambda names: F.array_max(F.transform(F.regexp_extract_all(body, F.lit(rf'"(?:{names})"\s*:\s*"\s*(\d{{4}}-\d{{2}}-\d{{2}})[^"]*"'), F.lit(1)), lambda x: x.try_cast("date")))
    found = latest("observationDate")
    found = F.coalesce(found, latest("updatedAt|updated_at")) if updates else found
    return F.when(F.try_parse_json(body).isNotNull(), found)


def external_ids(c: Column, spelling: dict[str, str] | None = None) -> Column:
    """A map with compact namespaces and canonical identifiers, sorted by namespace; null identifiers go."""
    names = spelling or {}
    entries = F.transform(F.map_entries(c), lambda e: F.struct(compact_key(e["key"]).alias("key"), canonical_identifier(e["value"]).alias("value")))
    if names:
        table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
        entries = F.transform(entries, lambda e: F.struct(F.coalesce(F.try_element_at(table, e["key"]), e["key"]).alias("key"), e["value"].alias("value")))
    return F.map_from_entries(F.array_sort(F.filter(entries, lambda e: e["value"].isNotNull() & (e["key"] != ""))))


def facility_mw(it_mw: Column, reported: Column) -> Column:
    """A data centre's load: reported, else its IT capacity times 1.2, 1.3 and 1.5."""
    # Power usage effectiveness, low, central and high.
    pue = {"low": 1.2, "central": 1.3, "high": 1.5}
    return F.coalesce(reported, F.when(it_mw.isNotNull(), parts_of(it_mw, lambda p: F.bround(it_mw * pue[p], 6))))


def water_mw(flow_m3_day: Column, kwh_per_m3: Column) -> Column:
    """A water work's average load: daily volume times the energy of a cubic metre."""
    return F.bround(flow_m3_day * kwh_per_m3 / 24_000, 6)


# Weights of lifecycles and of target years in the timing index.
LIFECYCLE_TIMING = {"operational": 100, "under_construction": 92, "permitted": 78, "planning_filed": 62, "announced": 48, "paused": 20}
YEAR_TIMING = {2026: 100, 2027: 92, 2028: 82, 2029: 70, 2030: 58, 2031: 46}


def timing_index(lifecycle: Column, year: Column) -> Column:
    """0.65 of the lifecycle's weight and 0.35 of the year's, half-even; a lifecycle without weight or no year leaves the first alone."""
    pick = lambda c, values: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c), F.lit(0))
    life = pick(lifecycle, LIFECYCLE_TIMING)
    both = F.bround((life * 65 + pick(year, YEAR_TIMING) * 35).cast("decimal(12,2)") / 100, 0).cast("int")
    return F.when((life == 0) | year.isNull(), life).otherwise(both)


def asset_confidence(precision: Column, value_kind: Column, sources: Column) -> Column:
    """By location precision, more for reported values and for several sources, 100 at most."""
    # Base by precision, and what is added.
    base = F.when(precision == "exact", 78).when(precision == "city_centroid", 68).when(precision == "region_centroid", 56).otherwise(50)
    return F.least(F.lit(100), base + F.when(value_kind == "reported", 8).otherwise(0) + F.when(sources > 1, 6).otherwise(0))


def legacy_contribution(version: Column, model_version: str) -> Column:
    """The method version of a contribution; old rows without one are named after the model's version."""
    return F.coalesce(version, F.lit(f"legacy-{model_version}")) if model_version in ("2.1.0",) else version


def merged_mix(supplied: Column, operating: Column, planned: Column, technologies: Column, capacity: Column) -> Column:
    """Capacity by technology: supplied, else operating and planned together, else equal parts; null if it misses the capacity by over 1e-6."""
    none = F.lit(None).cast("map<string,double>")
    empty = F.create_map().cast("map<string,double>")
    both = F.map_zip_with(F.coalesce(operating, empty), F.coalesce(planned, empty), lambda k, a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))
    equal = F.map_from_entries(F.transform(technologies, lambda t: F.struct(t, capacity / F.size(technologies))))
    mix = F.coalesce(F.when(F.size(supplied) > 0, supplied).otherwise(none), F.when(F.size(both) > 0, both).otherwise(none), equal)
    total = F.aggregate(F.map_values(mix), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.abs(total - capacity) <= 1e-6, mix)


def short_number(c: Column) -> Column:
    """12,345 as 12.3K and so on, for labels; null says that there is none."""
    cut = lambda x, unit: F.concat(F.regexp_replace(F.format_number(x, 1), r"\.0$", ""), F.lit(unit))
    return F.when(c.isNull(), "unavailable").when(c >= 1e9, cut(c / 1e9, "B")).when(c >= 1e6, cut(c / 1e6, "M")).when(c >= 1e3, cut(c / 1e3, "K")).otherwise(cut(c, ""))


def snapshot_time(c: Column) -> Column:
    return F.date_format(c, "dd MMM, HH:mm 'UTC'")


def canonical_ids(c: Column) -> Column:
    """Trimmed, distinct, sorted ids without blanks."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "")))


def fingerprint(*cols: str) -> Column:
    """SHA-256 of a row's columns as JSON with sorted keys, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256)
