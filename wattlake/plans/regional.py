"""Registered queries of the regional model's operators over whole tables, with the same results in SQL.

Suppliers stand in for plants, customers for regions and assets, nations for
countries, parts for raster cells and feed rows, orders for yearly figures.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wattlake.functions import scalars as S
from wattlake.functions import vocabulary as V
from wattlake.operators import cover as C
from wattlake.operators import energy as E
from wattlake.operators import models as M
from wattlake.operators import plants as P
from wattlake.operators import population as N
from wattlake.operators import relational as R
from wattlake.operators import snapshot as W
from wattlake.operators import spatial as G
from wattlake.operators import zonal as Z
from wattlake.plans.queries import query, t
from wattlake.sources import feeds


def pick(c, *values):
    """The value at c modulo their number."""
    out = F.lit(values[-1])
    for i, v in enumerate(values[:-1]):
        out = F.when(c % len(values) == i, F.lit(v)).otherwise(out)
    return out


def sql_pick(c, *values):
    text = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return "CASE " + " ".join(f"WHEN ({c}) % {len(values)} = {i} THEN {text(v)}" for i, v in enumerate(values)) + " END"


def rng(x, low=1.0, high=1.0):
    return F.struct((x * low).cast("double").alias("low"), x.cast("double").alias("central"), (x * high).cast("double").alias("high"))


# --- scalars -------------------------------------------------------------------

STATUS = ("Operating", "construction", "Pre-construction", "Mothballed", "SHELVED", "cancelled", "strange")
TECH = ("Solar PV farm", "offshore wind", "Hydroelectric dam", "CCGT", "anthracite coal", "tidal", "crude oil/gas")
LICENCE = ("CC-BY-4.0", "ODbL 1.0", "OGL-UK-3.0", "Open Government Licence v2", "proprietary", "CC0 1.0", "")
URL = ("https://a.org/x", "www.b.com", "ftp://c", "HTTP://d.e/f?g", "no address", "https://", None)
IDENT = (" 12.0 ", "nan", "A-7", "None", "3.50", "", "-4.000")


@query(f"""
WITH p AS (SELECT p_partkey AS k, {sql_pick('p_partkey', *IDENT)} AS i, {sql_pick('p_partkey', *STATUS)} AS s, {sql_pick('p_partkey', *TECH)} AS te, {sql_pick('p_partkey', *LICENCE)} AS l, {sql_pick('p_partkey', *URL)} AS u FROM part)
SELECT k, CASE WHEN lower(regexp_replace(trim(i), '^(-?\\d+)\\.0+$', '\\1')) IN ('', 'none', 'nan') THEN NULL ELSE regexp_replace(trim(i), '^(-?\\d+)\\.0+$', '\\1') END AS ident,
  {sql_pick('k', 'operational', 'under_construction', 'announced', 'paused', 'paused', 'cancelled', None)} AS lifecycle,
  {sql_pick('k', None, None, None, 'mothballed', 'shelved', None, None)} AS raw,
  {sql_pick('k', 'solar', 'wind', 'hydro', 'gas', 'coal', 'other', 'gas')} AS technology,
  {sql_pick('k', True, True, True, True, False, True, False)} AS open,
  {sql_pick('k', 'https://a.org/x', 'https://www.b.com', None, 'HTTP://d.e/f?g', None, None, None)} AS url,
  CASE WHEN k % 2 = 0 THEN 'st louis power ' || k ELSE 'north ' || k END AS expanded,
  CASE WHEN length('region-of-the-' || k) <= 16 THEN 'region-of-the-' || k ELSE substr('region-of-the-' || k, 1, 5) || '-' || substr(sha256('region-of-the-' || k), 1, 10) END AS slug,
  CASE WHEN k % 3 = 0 THEN 'way/' || k END AS element, CASE WHEN k % 5 = 0 THEN NULL ELSE 1990 + k % 40 END::INTEGER AS year
FROM p""")
def scalar_text(spark, sf_dir):
    """Identifiers, aliases, slugs, licences, technologies, lifecycles, addresses and years of texts."""
    k = F.col("p_partkey")
    name = F.when(k % 2 == 0, F.concat(F.lit("Saint Louis, PWR "), k.cast("string"))).otherwise(F.concat(F.lit("N "), k.cast("string")))
    element = F.when(k % 3 == 0, F.concat(F.lit("https://www.openstreetmap.org/way/"), k.cast("string"))).otherwise("https://example.org/way/1")
    when = F.when(k % 5 == 0, F.lit("no year 12345")).otherwise(F.concat(F.lit("since "), (1990 + k % 40).cast("string"), F.lit("-01")))
    status = pick(k, *STATUS)
    return t(spark, sf_dir, "part").select(
        k.alias("k"), S.canonical_identifier(pick(k, *IDENT)).alias("ident"), V.lifecycle(status).alias("lifecycle"), V.raw_status(F.lit(None).cast("string"), status).alias("raw"), V.technology(pick(k, *TECH)).alias("technology"), V.is_open_licence(pick(k, *LICENCE)).alias("open"), S.public_url(pick(k, *URL)).alias("url"),
        S.expand_aliases(name, {"saint": "st", "pwr": "power", "n": "north"}).alias("expanded"), S.slug(F.concat(F.lit("Region of the "), k.cast("string")), 16).alias("slug"), S.osm_element(element).alias("element"), S.year_of(when).alias("year"),
    )


@query("""
WITH p AS (SELECT p_partkey AS k, p_size AS s, p_retailprice AS r FROM part)
SELECT k, CASE WHEN k % 4 = 0 THEN NULL ELSE s * 1000.5 END::DOUBLE AS number, CASE k % 4 WHEN 0 THEN s * 0.001 WHEN 1 THEN s * 1.0 WHEN 2 THEN s * 1000.0 ELSE NULL END::DOUBLE AS gwh,
  (s * 0.5 - s * 1.0)::DOUBLE AS gap_low, 0.0::DOUBLE AS gap_central, (s * 2.0 - s * 0.25)::DOUBLE AS gap_high, CASE WHEN k % 3 = 0 THEN s * 1.5 ELSE NULL END::DOUBLE AS total_high,
  CASE WHEN k % 2 = 0 THEN s * 1.0 ELSE round(s * 1.3::DOUBLE, 6) END::DOUBLE AS facility, round_even(s * 3.5::DOUBLE / 24000, 6) AS water, round(s * 8.76::DOUBLE, 6) AS gwh_year, s / 4.0::DOUBLE AS quotient,
  CASE WHEN k % 7 = 5 OR k % 3 = 2 THEN life ELSE CAST(round_even(CAST(life * 65 + CASE k % 6 WHEN 0 THEN 100 WHEN 1 THEN 92 WHEN 2 THEN 82 WHEN 3 THEN 70 WHEN 4 THEN 58 ELSE 46 END * 35 AS DECIMAL(12,2)) / 100, 0) AS INTEGER) END AS timing,
  least(100, CASE k % 4 WHEN 0 THEN 78 WHEN 1 THEN 68 WHEN 2 THEN 56 ELSE 50 END + CASE WHEN k % 2 = 0 THEN 8 ELSE 0 END + CASE WHEN k % 3 > 1 THEN 6 ELSE 0 END)::INTEGER AS confidence
FROM (SELECT *, CASE k % 7 WHEN 0 THEN 100 WHEN 1 THEN 92 WHEN 2 THEN 78 WHEN 3 THEN 62 WHEN 4 THEN 48 WHEN 5 THEN 0 ELSE 20 END AS life FROM p)""")
def scalar_numbers(spark, sf_dir):
    """Numbers with commas, units, ranges and their differences and sums, loads of facilities and water works, timing, confidence."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("double")
    text = F.when(k % 4 == 0, "n/a").otherwise(F.format_number(s * 1000.5, 1))
    energy = V.metric(F.when(k % 4 == 3, "").otherwise(F.col("p_size").cast("string")), pick(k, "MWh", "Million kilowatt-hours", "TWh", ""), "energy")
    gap = S.range_gap(S.value_range(s * 0.5, s, s * 2), S.value_range(s * 0.25, s, s))
    total = S.range_plus(F.when(k % 3 == 0, rng(s, 0.5, 1.0)), F.when(k % 3 == 0, rng(s, 0.25, 0.5)))
    life = pick(k, "operational", "under_construction", "permitted", "planning_filed", "announced", "cancelled", "paused")
    return t(spark, sf_dir, "part").select(
        k.alias("k"), S.parse_number(text).alias("number"), energy.alias("gwh"), gap["low"].alias("gap_low"), gap["central"].alias("gap_central"), gap["high"].alias("gap_high"), total["high"].alias("total_high"),
        S.facility_mw(s, F.when(k % 2 == 0, S.strict_range(F.lit(None).cast("double"), s, F.lit(None).cast("double"))))["central"].alias("facility"), S.water_mw(s, F.lit(3.5)).alias("water"), S.mw_to_gwh(s).alias("gwh_year"), S.divide(s, F.lit(4.0)).alias("quotient"),
        S.timing_index(life, F.when(k % 3 != 2, (2026 + k % 6).cast("int"))).alias("timing"), S.asset_confidence(pick(k, "exact", "city_centroid", "region_centroid", "none"), pick(k, "reported", "estimated"), (k % 3).cast("int")).alias("confidence"),
    )


@query("""
WITH p AS (SELECT p_partkey AS k, p_size AS s FROM part)
SELECT k, 'gemunit=U' || k || CASE WHEN k % 2 = 0 THEN ';wikidata=Q' || k ELSE '' END AS ids, list_sort(list_distinct(['a', 'b' || (k % 3), 'b1']))::VARCHAR AS united,
  CASE k % 3 WHEN 0 THEN s * 1.0 WHEN 1 THEN s * 3.0 ELSE s * 2.0 END::DOUBLE AS first_mw, CASE k % 3 WHEN 2 THEN 2 ELSE 1 END::INTEGER AS parts,
  CASE WHEN k % 2 = 0 THEN 'v9' ELSE 'legacy-2.1.0' END AS version, strftime(DATE '2024-01-31' + CAST(k % 20 AS INTEGER), '%Y-%m-%d') AS observed, 31 AS fresh
FROM p""")
def scalar_maps(spark, sf_dir):
    """External ids, united lists, capacity mixes, versions of old rows, observation dates within JSON."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("double")
    raw = F.create_map(F.lit("GEM unit"), F.concat(F.lit(" U"), k.cast("string")), F.lit("Wiki-Data"), F.when(k % 2 == 0, F.concat(F.lit("Q"), k.cast("string"))).otherwise("null"))
    ids = F.map_entries(S.external_ids(raw))
    nothing = F.create_map().cast("map<string,double>")
    mix = S.merged_mix(F.when(k % 3 == 0, F.create_map(F.lit("solar"), s)).otherwise(nothing), F.when(k % 3 == 1, F.create_map(F.lit("wind"), s)).otherwise(nothing), F.when(k % 3 == 1, F.create_map(F.lit("wind"), s * 2)).otherwise(nothing), F.array(F.lit("gas"), F.lit("oil")), F.when(k % 3 == 0, s).when(k % 3 == 1, s * 3).otherwise(s * 4))
    day = F.date_add(F.lit("2024-01-31").cast("date"), (k % 20).cast("int"))
    body = F.concat(F.lit('{"rows":[{"observationDate":"2020-01-01"},{"x":{"observationDate":"'), day.cast("string"), F.lit('T00:00:00Z"}}],"updatedAt":"2030-01-01"}'))
    return t(spark, sf_dir, "part").select(
        k.alias("k"), F.array_join(F.transform(ids, lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("ids"), F.concat(F.lit("["), F.array_join(S.canonical_ids(F.array_union(F.array(F.lit(" a"), F.lit("b1")), F.array(F.concat(F.lit("b"), (k % 3).cast("string"))))), ", "), F.lit("]")).alias("united"),
        F.map_values(mix)[0].alias("first_mw"), F.size(mix).alias("parts"), S.legacy_contribution(F.when(k % 2 == 0, "v9"), "2.1.0").alias("version"), S.observation_date(body).cast("string").alias("observed"), S.freshness_days(F.date_add(day, 31), day).alias("fresh"),
    )


@query("""
SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN CAST(s_suppkey % 170 AS DOUBLE) WHEN 1 THEN s_suppkey % 170 + 1.5 END AS lon, CASE s_suppkey % 3 WHEN 0 THEN CAST(s_suppkey % 80 AS DOUBLE) WHEN 1 THEN s_suppkey % 80 + 2.0 END AS lat FROM supplier""")
def wkt_points(spark, sf_dir):
    """Points and box middles of geometry texts; out of bounds is null."""
    k = F.col("s_suppkey")
    x, y = (k % 170).cast("string"), (k % 80).cast("string")
    line = F.concat(F.lit("LINESTRING ("), x, F.lit(" "), y, F.lit(", "), (k % 170 + 3).cast("string"), F.lit(" "), (k % 80 + 4).cast("string"), F.lit(")"))
    point = S.wkt_point(F.when(k % 3 == 0, F.concat(F.lit(" point("), x, F.lit(" "), y, F.lit(")"))).when(k % 3 == 1, line).otherwise("POINT (500 10)"))
    return t(spark, sf_dir, "supplier").select(k.alias("k"), point["lon"].alias("lon"), point["lat"].alias("lat"))


# --- filters and feeds -----------------------------------------------------------


@query("""
WITH d AS (SELECT p_partkey AS k, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size / 20.0 END AS mw, CASE p_partkey % 3 WHEN 0 THEN 'operational' WHEN 1 THEN 'announced' ELSE 'paused' END AS life, p_partkey % 2 AS kind, p_partkey % 11 AS roof, p_partkey % 4 AS own FROM part)
SELECT k, CASE WHEN mw IS NOT NULL THEN 'reported_capacity_at_least_1mw' WHEN life = 'announced' THEN 'planned_or_construction_lifecycle' WHEN kind = 1 THEN 'named_plant_geometry_with_source' ELSE 'ownership_or_external_identity' END AS basis
FROM d WHERE roof > 0 AND ((mw IS NOT NULL AND mw >= 1) OR (mw IS NULL AND (life = 'announced' OR kind = 1 OR own = 0)))""")
def utility_scale(spark, sf_dir):
    """Mapped features that are plants, and why."""
    k = F.col("p_partkey")
    d = t(spark, sf_dir, "part").select(
        k.alias("k"), F.when(F.col("p_size") % 5 != 0, F.col("p_size") / 20).alias("capacity_mw"), pick(k, "operational", "announced", "paused").alias("lifecycle"), pick(k, "node", "way").alias("kind"), F.col("p_name").alias("name"), F.lit("solar").alias("source"),
        F.when(k % 4 == 0, "owner").alias("owner"), F.lit(None).cast("string").alias("operator"), F.lit(" ").alias("wikidata"), F.when(k % 11 == 0, "Roof").alias("location"), F.lit(None).cast("string").alias("scale"),
    )
    return feeds.utility_scale(d).select("k", "basis")


@query("""
WITH d AS (SELECT o_custkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 100 + 1.0 END AS mw, CASE o_orderstatus WHEN 'F' THEN 'operational' WHEN 'O' THEN 'announced' ELSE 'cancelled' END AS lifecycle, CASE o_orderstatus WHEN 'F' THEN 4 WHEN 'O' THEN 5 ELSE 0 END AS r FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r DESC, mw IS NOT NULL DESC) AS rn FROM d)
SELECT id, lifecycle, mw::DOUBLE AS capacity_mw FROM n WHERE rn = 1""")
def preferred_bindings(spark, sf_dir):
    """One row per element of bindings that repeat."""
    k = F.col("o_orderkey")
    d = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "operational").when(F.col("o_orderstatus") == "O", "announced").otherwise("cancelled").alias("lifecycle"), F.when(k % 2 == 0, (F.col("o_custkey") % 100 + 1).cast("double")).alias("capacity_mw"))
    return feeds.preferred_bindings(d).select("id", "lifecycle", "capacity_mw")


@query("""
SELECT c_custkey || ':' || (2024 + c_custkey % 10) AS increment_id, c_nationkey::VARCHAR AS geography_id, round(CAST(c_custkey AS DOUBLE) * 8.76, 6) AS gwh, (2024 + c_custkey % 10)::INTEGER AS year FROM customer
WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey % 4 < 3 AND 2024 + c_custkey % 10 BETWEEN 2026 AND 2031 AND c_nationkey <> 7""")
def forward_increments(spark, sf_dir):
    """Annual demand of sourced loads to come in active regions."""
    k = F.col("c_custkey")
    a = t(spark, sf_dir, "customer").select(
        k.cast("string").alias("id"), F.col("c_nationkey").cast("string").alias("geography_id"), F.when(F.col("c_mktsegment") == "BUILDING", "data_centre").when(F.col("c_mktsegment") == "MACHINERY", "water_infrastructure").otherwise("other").alias("category"),
        pick(k, "announced", "permitted", "under_construction", "operational").alias("lifecycle"), (2024 + k % 10).cast("int").alias("target_year"), rng(k.cast("double"), 0.9, 1.1).alias("demand_mw"), F.array(F.lit(" s"), F.lit("")).alias("source_ids"),
    )
    active = t(spark, sf_dir, "nation").where("n_nationkey <> 7").select(F.col("n_nationkey").cast("string").alias("geography_id"))
    return E.forward_increments(a, active).select("increment_id", "geography_id", F.col("demand_gwh.central").alias("gwh"), F.col("target_year").alias("year"))


# --- space ---------------------------------------------------------------------------


def _shapes(spark, sf_dir):
    """A nation's shape: a square with a square hole, and a second square beyond."""
    n = F.col("n_nationkey")
    x, y = (n * 7).cast("double"), (n % 5 * 5).cast("double")
    ring = lambda a, b, w: F.array(*[F.array(p, q) for p, q in ((a, b), (a + w, b), (a + w, b + w), (a, b + w))])
    return t(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("region"), F.array(F.array(ring(x, y, 4.5), ring(x + 1, y + 1, 2.0)), F.array(ring(x + 5, y + 0.25, 1.5))).alias("polygons"))


HELD = "(lon BETWEEN x AND x + 4.5 AND lat BETWEEN y AND y + 4.5 AND NOT (lon > x + 1 AND lon < x + 3 AND lat > y + 1 AND lat < y + 3) OR lon BETWEEN x + 5 AND x + 6.5 AND lat BETWEEN y + 0.25 AND y + 1.75)"
SHAPES = "(SELECT n_nationkey, n_regionkey, CAST(n_nationkey * 7 AS DOUBLE) AS x, CAST(n_nationkey % 5 * 5 AS DOUBLE) AS y FROM nation)"
SPOTS = "(SELECT c_custkey, c_nationkey, CAST(c_custkey * 13 % 720 AS DOUBLE) / 4 AS lon, CAST(c_custkey * 7 % 100 AS DOUBLE) / 4 AS lat FROM customer)"


def _spots(spark, sf_dir):
    k = F.col("c_custkey")
    return t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", ((k * 13 % 720).cast("double") / 4).alias("lon"), ((k * 7 % 100).cast("double") / 4).alias("lat"))


@query(f"SELECT c_custkey, n_nationkey FROM {SPOTS} p JOIN {SHAPES} q ON {HELD}")
def polygons_with_holes(spark, sf_dir):
    """Points in shapes of several parts with holes, edges included."""
    return C.contains(_spots(spark, sf_dir), "c_custkey", _shapes(spark, sf_dir), "n_nationkey")


@query(f"""
SELECT c_custkey, n_nationkey FROM {SPOTS} p JOIN {SHAPES} q ON p.c_nationkey % 5 = q.n_regionkey AND {HELD}""")
def bucketed_containment(spark, sf_dir):
    """The same, only among shapes of the point's own group."""
    return C.contains(_spots(spark, sf_dir).withColumn("region", F.col("c_nationkey") % 5), "c_custkey", _shapes(spark, sf_dir), "n_nationkey", equal=["region"])


@query(f"""
WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE lon END AS lon, lat, c_custkey % 2 AS exact, c_nationkey FROM {SPOTS}),
f AS (SELECT c_custkey, min(n_nationkey) AS n FROM a JOIN {SHAPES} q ON {HELD} GROUP BY 1)
SELECT a.c_custkey, CASE WHEN exact = 1 AND n IS NOT NULL THEN 'R' || n ELSE 'old' END AS geography_id, CASE WHEN lon IS NULL THEN 'N' || c_nationkey WHEN n IS NOT NULL THEN 'R' || n END AS country FROM a LEFT JOIN f USING (c_custkey)""")
def region_assignment(spark, sf_dir):
    """Exactly located assets to the finest region around them, countries by coordinates or as declared."""
    k = F.col("c_custkey")
    a = _spots(spark, sf_dir).withColumn("lon", F.when(k % 3 != 0, F.col("lon"))).withColumn("location_precision", pick(k, "city_centroid", "exact")).withColumn("geography_id", F.lit("old")).withColumn("country", F.concat(F.lit("N"), F.col("c_nationkey").cast("string")))
    name = F.concat(F.lit("R"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    shapes = _shapes(spark, sf_dir).select(name.alias("region_id"), F.lit(1).alias("level"), F.lit("p").alias("parent_id"), "polygons")
    d = G.assign_country(G.assign_region(a, "c_custkey", shapes), "c_custkey", shapes.withColumnRenamed("region_id", "iso2"))
    short = lambda c: F.regexp_replace(c, "^R0", "R")
    return d.select("c_custkey", short("geography_id").alias("geography_id"), short("country").alias("country"))


CELLS = "(SELECT p_partkey, CAST(p_partkey % 180 AS DOUBLE) + 0.5 AS lon, CAST(p_partkey * 3 % 25 AS DOUBLE) + 0.5 AS lat, p_retailprice AS v, p_partkey % 9 > 0 AS ok FROM part)"


@query(f"""
SELECT n_nationkey, CAST(sum(CAST(v AS DECIMAL(28,6))) FILTER (ok) AS DOUBLE) AS total, count(*) AS selected, round(100.0 * count(*) FILTER (ok) / count(*), 4) AS coverage FROM {CELLS} c JOIN {SHAPES} q ON {HELD} GROUP BY 1""")
def zonal_coverage(spark, sf_dir):
    """Valid raster cells in shapes with holes: sums, selected cells, share of valid ones."""
    k = F.col("p_partkey")
    cells = t(spark, sf_dir, "part").select("p_partkey", ((k % 180).cast("double") + 0.5).alias("lon"), ((k * 3 % 25).cast("double") + 0.5).alias("lat"), F.col("p_retailprice").alias("v"), (k % 9 > 0).alias("ok"))
    return Z.zonal_sum(cells, _shapes(spark, sf_dir), "n_nationkey", Z.Grid(0.5, 0.5), "v", "ok")


@query(f"""
WITH s AS (SELECT n_nationkey, CAST(sum(CAST(v AS DECIMAL(28,6))) FILTER (ok) AS DOUBLE) AS population, count(*) AS n FROM {CELLS} c JOIN {SHAPES} q ON {HELD} GROUP BY 1)
SELECT n_nationkey, y::INTEGER AS year, 2025 AS source_year, population, CASE WHEN n IS NULL THEN 'no_cell_centre_inside' END AS unavailable FROM nation LEFT JOIN s USING (n_nationkey), range(2026, 2029) r(y)""")
def regional_population(spark, sf_dir):
    """Population of every region and year from the one raster there is."""
    k = F.col("p_partkey")
    cells = t(spark, sf_dir, "part").select("p_partkey", F.lit(2025).alias("year"), ((k % 180).cast("double") + 0.5).alias("lon"), ((k * 3 % 25).cast("double") + 0.5).alias("lat"), F.col("p_retailprice").alias("value"), (k % 9 > 0).alias("valid"))
    return Z.regional_population(cells, _shapes(spark, sf_dir), "n_nationkey", Z.Grid(0.5, 0.5), (2026, 2027, 2028)).drop("coverage")


@query("""
WITH i AS (SELECT n_nationkey AS c, n_nationkey * 15 - 180.0 AS west, CASE WHEN n_nationkey * 15 - 180.0 + 40 > 180 THEN n_nationkey * 15 - 500.0 ELSE n_nationkey * 15 - 140.0 END AS east, n_nationkey * 3 - 40.0 AS south, n_nationkey * 3 - 20.0 AS north FROM nation)
SELECT c FROM i WHERE north >= -10 AND south <= 30 AND ((west <= east AND (east >= 150 OR west <= -150)) OR west > east)""")
def viewport(spark, sf_dir):
    """Countries whose box meets a view across the 180th meridian."""
    n = F.col("n_nationkey")
    west = (n * 15 - 180).cast("double")
    i = t(spark, sf_dir, "nation").select(n.alias("c"), west.alias("west"), F.when(west + 40 > 180, west - 320).otherwise(west + 40).alias("east"), (n * 3 - 40).cast("double").alias("south"), (n * 3 - 20).cast("double").alias("north"))
    return G.in_view(i, 150.0, -10.0, -150.0, 30.0).select("c")


# --- plants ------------------------------------------------------------------------------


def _plants(spark, sf_dir):
    """Each supplier as a community row and a tracker unit that share an id, and every third once more without one, nearby under the same name."""
    k = F.col("s_suppkey")
    s = t(spark, sf_dir, "supplier")
    base = lambda d, tag, source, kind, entity: d.select(
        F.concat(F.lit(tag), F.lpad(k.cast("string"), 9, "0")).alias("id"), F.lit(entity).alias("entity"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("country"), F.concat(F.lit("Plant "), k.cast("string")).alias("name"), F.concat(F.col("s_name"), F.lit(" Power Station")).alias("plant_name"), F.lit("Operator Ltd").alias("operator"),
        (k % 300 - 150 + F.lit(0.001)).cast("double").alias("lon"), (k % 120 - 60).cast("double").alias("lat"), F.when(k % 5 != 0, rng(k.cast("double"))).alias("capacity"), F.lit(kind).alias("capacity_kind"), pick(k, "solar", "wind", "gas").alias("technology"), pick(k, "operational", "announced").alias("lifecycle"), F.lit(None).cast("int").alias("commissioning_year"),
        F.create_map(F.lit("wikidata"), F.concat(F.lit("Q"), k.cast("string"))).alias("external_ids"), F.lit(None).cast("string").alias("plant_id"), F.lit(None).cast("string").alias("unit_id"), F.lit(source).alias("source_type"), F.array(F.lit(f"{tag}-source")).alias("source_ids"), F.lit("exact").alias("location_precision"), F.array(F.lit(f"{tag}-source")).alias("evidence"),
    )
    none = F.create_map().cast("map<string,string>")
    third = base(s.where("s_suppkey % 3 = 0"), "c", "research_verified", "estimated", "plant").withColumn("external_ids", none).withColumn("lat", F.col("lat") + 0.01)
    return base(s, "a", "community_mapped", "reported", "plant").unionByName(base(s, "b", "official_verified", "estimated", "plant")).unionByName(third)


@query("""
SELECT p || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS id, 'a' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS cluster FROM supplier, (VALUES ('a'), ('b'), ('c')) v(p) WHERE p <> 'c' OR (s_suppkey % 3 = 0 AND s_suppkey % 5 <> 0)
UNION ALL SELECT 'c' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0'), 'c' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') FROM supplier WHERE s_suppkey % 15 = 0""")
def plant_clusters(spark, sf_dir):
    """Source rows of one record: by shared ids, or by country, operator, name, place and capacity."""
    return P.constrained_clusters(_plants(spark, sf_dir), False).select("id", "cluster")


@query("""
SELECT 'a' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS id, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_suppkey END::DOUBLE AS mw, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'reported' END AS kind, 'official_verified' AS source_type,
  CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 5 <> 0 THEN 3 ELSE 2 END::INTEGER AS rows, 'Q' || s_suppkey AS wikidata, CAST(s_suppkey % 120 - 60 AS DOUBLE) AS lat FROM supplier
UNION ALL SELECT 'c' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0'), NULL, NULL, 'research_verified', 1, NULL, s_suppkey % 120 - 60 + 0.01 FROM supplier WHERE s_suppkey % 15 = 0""")
def merged_records(spark, sf_dir):
    """Records of clusters: the most believed value by field, metrics with their kind, places as a whole."""
    rows = _plants(spark, sf_dir)
    m = P.merge_records(rows, P.constrained_clusters(rows, False))
    return m.select("id", F.col("capacity.central").alias("mw"), F.col("capacity_kind").alias("kind"), "source_type", F.size("source_record_ids").alias("rows"), F.try_element_at("external_ids", F.lit("wikidata")).alias("wikidata"), "lat")


def _units(spark, sf_dir):
    """Line items as units of their supplier, a plant row beside each supplier with an even key."""
    l = t(spark, sf_dir, "lineitem").select(  # noqa: E741
        F.concat_ws("-", F.lit("u"), "l_orderkey", "l_linenumber").alias("id"), F.lit("unit").alias("entity"), F.col("l_suppkey").alias("plant"), F.when((F.col("l_suppkey") % 3 > 0) | (F.col("l_linenumber") > 1), rng(F.col("l_quantity"), 0.9, 1.1)).alias("capacity"),
        F.lit("estimated").alias("capacity_kind"), F.lit("community_mapped").alias("source_type"), pick(F.col("l_linenumber"), "gas", "coal").alias("technology"),
    )
    s = t(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("p-"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("plant").alias("entity"), F.col("s_suppkey").alias("plant"), rng(F.col("s_suppkey").cast("double"), 0.5, 2.0).alias("capacity"), pick(F.col("s_suppkey") / 2, "reported", "inherited").alias("capacity_kind"), F.lit("official_verified").alias("source_type"), F.lit("hydro").alias("technology"))
    none = F.expr("array()").cast("array<string>")
    return l.unionByName(s).select("*", F.lit("operational").alias("lifecycle"), none.alias("source_ids"), none.alias("capacity_source_ids"), none.alias("evidence"), F.col("source_type").alias("capacity_source"), F.lit("exact").alias("location_precision"))


@query("""
WITH u AS (SELECT l_suppkey AS plant, count(*) AS n, count(*) FILTER (l_suppkey % 3 > 0 OR l_linenumber > 1) AS known, CAST(sum(CAST(l_quantity AS DECIMAL(28,6))) FILTER (l_suppkey % 3 > 0 OR l_linenumber > 1) AS DOUBLE) AS total,
  CAST(sum(CAST(l_quantity AS DECIMAL(28,6))) FILTER ((l_suppkey % 3 > 0 OR l_linenumber > 1) AND l_linenumber % 2 = 0) AS DOUBLE) AS gas FROM lineitem GROUP BY 1),
p AS (SELECT s_suppkey AS plant, s_suppkey AS mw, (s_suppkey // 2) % 2 = 0 AS better FROM supplier WHERE s_suppkey % 2 = 0),
m AS (SELECT coalesce(u.plant, p.plant) AS plant, coalesce(n, 0) AS n, coalesce(known, 0) AS known, total, gas, mw,
  CASE WHEN n > 0 AND known = n AND mw IS NOT NULL AND better THEN 'aggregate_preferred' WHEN n > 0 AND known = n THEN 'complete_unit_sum' WHEN n > 0 AND mw IS NOT NULL THEN 'aggregate_fallback' WHEN n > 0 THEN 'incomplete_units' ELSE 'plant_aggregate' END AS method
  FROM u FULL OUTER JOIN p ON u.plant = p.plant)
SELECT plant, method, CASE WHEN method = 'complete_unit_sum' THEN total WHEN method = 'incomplete_units' THEN NULL ELSE mw END::DOUBLE AS mw, round(CASE WHEN n = 0 THEN 100.0 WHEN method = 'aggregate_preferred' THEN 100.0 ELSE 100.0 * known / n END, 2)::DOUBLE AS coverage, known AS known_units, n AS all_units,
  CASE WHEN method = 'complete_unit_sum' THEN gas END AS gas FROM m""")
def capacity_account(spark, sf_dir):
    """A plant's capacity from its units or its own row, by five methods."""
    a = P.capacity_account(_units(spark, sf_dir), "plant", V.OPERATING)
    return a.select("plant", "method", F.col("capacity.central").alias("mw"), "coverage", "known_units", "all_units", F.try_element_at("mix", F.lit("gas")).alias("gas"))


@query("""
SELECT 'plant-wikidata-q' || s_suppkey AS plant_id, 1::BIGINT AS records, 0::BIGINT AS units, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 5 > 0 THEN s_suppkey END::DOUBLE AS operating, CASE WHEN s_suppkey % 2 = 1 AND s_suppkey % 5 > 0 THEN s_suppkey END::DOUBLE AS planned FROM supplier WHERE NOT s_suppkey % 15 = 0
UNION ALL SELECT 'plant-wikidata-q' || s_suppkey, 2, 0, NULL, NULL FROM supplier WHERE s_suppkey % 15 = 0""")
def canonical_plants(spark, sf_dir):
    """Source rows to records to plants with durable ids, counts and capacities."""
    _, plants = P.canonicalize(_plants(spark, sf_dir))
    return plants.select("plant_id", "records", "units", F.col("operating.central").alias("operating"), F.col("planned.central").alias("planned"))


@query("""
SELECT 'a' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS id, 'record-wikidata-q' || s_suppkey AS record_id FROM supplier
UNION ALL SELECT 'c' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0'), 'c' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') FROM supplier WHERE s_suppkey % 15 = 0""")
def durable_record_ids(spark, sf_dir):
    """Ids of records by their first anchor, else by their smallest source row."""
    rows = _plants(spark, sf_dir)
    return P.record_ids(P.merge_records(rows, P.constrained_clusters(rows, False))).select("id", "record_id")


@query("""
SELECT lower(n_name) AS name, CASE WHEN n_nationkey % 2 = 0 THEN chr(97 + n_nationkey) || 'xx' ELSE chr(97 + n_nationkey) || 'y' END AS country FROM (SELECT n_nationkey, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) AS n_name FROM nation)
UNION ALL SELECT chr(97 + n_nationkey) || 'xx', chr(97 + n_nationkey) || 'xx' FROM nation WHERE n_nationkey % 2 = 0
UNION ALL SELECT chr(97 + n_nationkey) || 'y', CASE WHEN n_nationkey % 2 = 0 THEN chr(97 + n_nationkey) || 'xx' ELSE chr(97 + n_nationkey) || 'y' END FROM nation""")
def country_keys(spark, sf_dir):
    """Country names and codes under one key: ISO3, else ISO2."""
    n = t(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").alias("k"), F.char((F.col("n_nationkey") + 97).cast("long")).alias("c"))
    links = n.select(F.col("n_name").alias("a"), F.concat("c", F.lit("Y")).alias("b")).union(n.where("k % 2 = 0").select(F.concat("c", F.lit("Y")), F.concat("c", F.lit("XX"))))
    return P.country_keys(links)


@query("""
WITH b AS (SELECT c_custkey AS k, c_nationkey, c_mktsegment, 2026 + c_custkey % 5 AS y, greatest(c_acctbal, 1) AS mw, CAST(floor(ln(greatest(c_acctbal, 1)) / ln(1.25)) AS BIGINT) AS band FROM customer)
SELECT a.k AS a, b.k AS b FROM b a JOIN b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.k < b.k AND abs(a.y - b.y) <= 1 AND abs(a.band - b.band) <= 1 WHERE a.mw / b.mw BETWEEN 0.8 AND 1.25""")
def fuzzy_assets(spark, sf_dir):
    """Assets of one country and category within a year and a quarter of capacity, by neighbouring bands and years."""
    k = F.col("c_custkey")
    mw = F.greatest("c_acctbal", F.lit(1.0))
    d = t(spark, sf_dir, "customer").select(k.alias("k"), "c_nationkey", "c_mktsegment", (2026 + k % 5).alias("y"), mw.alias("mw"), S.log_band(mw, 1.25).alias("band"))
    return R.blocked_pairs(d, "k", ["c_nationkey", "c_mktsegment"], {"y": 1, "band": 1}, (F.col("a.mw") / F.col("b.mw")).between(0.8, 1.25)).select(F.col("a.k").alias("a"), F.col("b.k").alias("b"))


# --- lenses and client -------------------------------------------------------------------


def _assets(spark, sf_dir):
    k = F.col("c_custkey")
    return t(spark, sf_dir, "customer").select(
        k.alias("id"), F.col("c_nationkey").alias("geography_id"), F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "data_centre").otherwise("water_infrastructure").alias("category"), pick(k, "operational", "announced", "permitted", "cancelled").alias("lifecycle"),
        F.when(k % 5 > 0, (2026 + k % 6).cast("int")).alias("target_year"), F.when(k % 7 > 0, rng((k % 50).cast("double"), 0.5, 2.0)).alias("demand_mw"), (k % 101).cast("double").alias("timing"), (k % 90).cast("long").alias("confidence"), F.array(F.concat(F.lit("s"), (k % 3).cast("string"))).alias("source_ids"), F.when(k % 4 > 0, pick(k, "official_verified", "community_mapped")).alias("source_type"),
    )


@query("""
WITH a AS (SELECT c_nationkey AS g, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'data_centre' ELSE 'water_infrastructure' END AS cat, c_custkey % 50 AS mw, c_custkey % 101 AS ti, c_custkey % 90 AS cf, c_custkey AS k, y FROM customer, range(2026, 2032) r(y)
           WHERE c_custkey % 4 < 3 AND c_custkey % 7 > 0 AND (c_custkey % 5 = 0 OR 2026 + c_custkey % 6 <= y)),
s AS (SELECT g, y, coalesce(cat, 'combined') AS cat, sum(mw)::DOUBLE AS mw, sum(mw * 0.5)::DOUBLE AS low, CAST(sum(ti * greatest(1, mw)) AS DECIMAL(38,6)) / sum(greatest(1, mw)) AS ti, round_even(CAST(sum(cf) AS DECIMAL(28,6)) / count(*), 0) AS cf, count(*) AS n, list_sort(list_distinct(list('s' || (k % 3))))::VARCHAR AS src FROM a GROUP BY GROUPING SETS ((g, y, cat), (g, y))),
l AS (SELECT *, least(100, CAST(round_even(CAST(100 * ln(1 + mw) / ln(5001) AS DECIMAL(18,9)), 1) AS DOUBLE)) AS load FROM s)
SELECT g AS geography_id, y::INTEGER AS year, cat AS category, mw, low, round(CAST(ti AS DOUBLE), 6) AS timing, CAST(cf AS INTEGER) AS confidence, n AS assets, src AS sources, load FROM l""")
def demand_lenses(spark, sf_dir):
    """Active demand of every geography, year and category and in total, with its load index."""
    d = W.lenses(W.active_demand(_assets(spark, sf_dir)))
    return d.select("geography_id", "year", "category", F.col("demand.central").alias("mw"), F.col("demand.low").alias("low"), F.round("timing", 6).alias("timing"), "confidence", "assets", F.concat(F.lit("["), F.array_join("source_ids", ", "), F.lit("]")).alias("sources"), "load")


@query("""
WITH p AS (SELECT c_custkey AS k, CAST(c_custkey % 101 AS DOUBLE) AS l, CAST(c_custkey % 97 AS DOUBLE) AS t, CAST(c_custkey % 89 AS DOUBLE) AS s FROM customer),
v AS (SELECT k, CAST(round_even(CAST(54.0 + 0.28 * l + 0.18 * t - 0.24 * s AS DECIMAL(18,6)), 0) AS DOUBLE) AS a, CAST(round_even(CAST(0.72 * s + 0.18 * l + 0.10 * (100 - t) AS DECIMAL(18,6)), 0) AS DOUBLE) AS r, l FROM p)
SELECT k, y::INTEGER AS year, greatest(0, least(100, a)) AS attractive, greatest(0, least(100, r)) AS risk, least(100.0, CAST(round_even(CAST(l * f AS DECIMAL(18,6)), 1) AS DOUBLE)) AS load,
  CASE WHEN l >= 80 THEN '#E2B45C' WHEN l >= 65 THEN '#A4864E' WHEN l >= 45 THEN '#3D7467' ELSE '#1B3430' END AS colour
FROM v, (VALUES (2026, 0.72::DOUBLE), (2027, 0.8), (2028, 0.88), (2029, 0.95), (2030, 1.0), (2031, 1.04)) w(y, f)""")
def supporting_lenses(spark, sf_dir):
    """Attractiveness and risk, drivers by year, colours by score."""
    k = F.col("c_custkey")
    load, timing, scarcity = ((k % m).cast("double") for m in (101, 97, 89))
    a, r = M.supporting_lenses(load, timing, scarcity)
    d = t(spark, sf_dir, "customer").select(k.alias("k"), a.alias("attractive"), r.alias("risk"), load.alias("load"), W.score_colour(load, "infrastructureDemand").alias("colour"))
    return M.cluster_years(d, ["load"])


@query("""
SELECT c_nationkey AS geography_id, count(*) AS total, count(*) FILTER (c_custkey % 4 = 0) AS operational, count(*) FILTER (c_custkey % 4 IN (1, 2)) AS planned, count(*) FILTER (c_mktsegment IN ('BUILDING', 'MACHINERY')) AS data_centres, count(*) FILTER (c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) AS water_infrastructure,
  count(*) FILTER (c_custkey % 4 = 0 OR c_custkey % 2 = 0) AS official_verified, count(*) FILTER (c_custkey % 4 > 0 AND c_custkey % 2 = 1) AS community_mapped FROM customer GROUP BY 1""")
def asset_summary(spark, sf_dir):
    """Seven counters per geography."""
    return W.asset_summary(_assets(spark, sf_dir))


def _generators(spark, sf_dir):
    k = F.col("s_suppkey")
    return t(spark, sf_dir, "supplier").select(
        k.alias("plant_id"), F.col("s_nationkey").alias("country"), (k % 40).alias("geography_id"), F.when(k % 9 > 0, (k * 7 % 360 - 180).cast("double")).alias("lon"), F.when(k % 9 > 0, (k % 120 - 60).cast("double")).alias("lat"), (k % 500).cast("double").alias("capacity_mw"),
        F.create_map(pick(k, "solar", "wind", "gas"), (k % 50).cast("double"), F.lit("oil"), (k % 20).cast("double")).alias("mix"), F.array(pick(k, "solar", "wind", "gas"), F.lit("oil")).alias("technologies"), F.when(k % 6 > 0, pick(k, "operational", "announced")).alias("lifecycle"), pick(k, "solar", "wind", "gas").alias("technology"),
    )


@query("""
WITH m AS (SELECT s_suppkey % 40 AS g, CASE s_suppkey % 3 WHEN 0 THEN 'solar' WHEN 1 THEN 'wind' ELSE 'gas' END AS t, s_suppkey % 50 AS mw FROM supplier UNION ALL SELECT s_suppkey % 40, 'oil', s_suppkey % 20 FROM supplier),
s AS (SELECT g, t, sum(mw)::DOUBLE AS mw FROM m GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY mw DESC, t) AS rn, sum(mw) OVER (PARTITION BY g) AS total, count(*) OVER (PARTITION BY g) AS n FROM s)
SELECT g AS geography_id, (SELECT count(*) FROM supplier WHERE s_suppkey % 40 = g) AS plants, total AS capacity_mw, t AS dominant, round(mw / nullif(total, 0), 6) AS dominant_share, n::INTEGER AS technologies FROM r WHERE rn = 1""")
def regional_mix(spark, sf_dir):
    """Plants, capacity and mix of each geography, the largest technology first."""
    return W.regional_mix(_generators(spark, sf_dir)).select("geography_id", "plants", "capacity_mw", "dominant", "dominant_share", F.size("mix").alias("technologies"))


@query("""
SELECT s_suppkey AS plant_id FROM supplier WHERE s_suppkey % 9 > 0 AND s_suppkey % 40 < 30 AND s_nationkey = s_suppkey % 40 % 25""")
def publishable_plants(spark, sf_dir):
    """Plants with coordinates in active regions of their own country."""
    regions = t(spark, sf_dir, "nation").select(F.explode(F.sequence(F.lit(0), F.lit(39))).alias("geography_id")).distinct().where("geography_id < 30").select(F.col("geography_id").cast("long").alias("geography_id"), (F.col("geography_id") % 25).alias("country"))
    return W.publishable(_generators(spark, sf_dir), regions).select("plant_id")


@query("""
SELECT s_suppkey AS plant_id FROM supplier WHERE s_suppkey % 3 < 2 AND (s_suppkey % 6 = 0 OR s_suppkey % 2 = 0)""")
def generator_filter(spark, sf_dir):
    """Plants by technologies and lifecycles, unknown ones by that name."""
    return W.generator_filter(_generators(spark, sf_dir), ["solar", "wind"], ["operational", "unknown"]).select("plant_id")


@query("""
WITH o AS (SELECT n_nationkey AS g, n_nationkey % 4 * 10.0 AS solar, n_nationkey % 3 * 10.0 AS wind, n_nationkey % 5 AS op, n_nationkey % 5 + n_nationkey % 2 + 1 AS n FROM nation)
SELECT g AS geography_id, CASE WHEN wind > solar THEN 'wind' ELSE 'solar' END AS dominant, (solar > 0 AND wind > 0) AS is_mixed, (solar + wind)::DOUBLE AS filtered_mw, op + n % 1 = n AS exact FROM o WHERE solar + wind > 0 AND op > 0""")
def overview_filter(spark, sf_dir):
    """Overview mixes by chosen technologies and lifecycles."""
    n = F.col("n_nationkey")
    d = t(spark, sf_dir, "nation").select(n.alias("geography_id"), F.create_map(F.lit("solar"), (n % 4 * 10).cast("double"), F.lit("wind"), (n % 3 * 10).cast("double"), F.lit("oil"), F.lit(5.0)).alias("mix"), F.create_map(F.lit("operational"), (n % 5).cast("long"), F.lit("announced"), F.lit(1).cast("long")).alias("lifecycle_counts"), (n % 5 + n % 2 + 1).cast("long").alias("count"))
    return W.overview_filter(d, ["solar", "wind"], ["operational"]).select("geography_id", "dominant", "is_mixed", "filtered_mw", "exact")


@query("""
WITH p AS (SELECT n_nationkey AS g, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey * 3 WHEN n_nationkey % 2 = 0 THEN n_nationkey END AS s FROM nation)
SELECT g AS geography_id, s::INTEGER AS active_score, CASE WHEN g % 4 = 0 THEN 10 ELSE 50 END::INTEGER AS confidence, CASE WHEN g % 4 = 0 THEN g * 1.5 END::DOUBLE AS demand FROM p WHERE g IN (0, 3, 4, 8, 9, 11)""")
def compared_regions(spark, sf_dir):
    """Chosen regions side by side under the balance lens."""
    n = F.col("n_nationkey")
    lens = lambda c: F.create_map(F.lit("2030"), F.create_map(F.lit("powerBalance"), c))
    deep = F.when(n % 3 > 0, F.create_map(F.lit("2030"), F.create_map(F.lit("combined"), F.create_map(F.lit("powerBalance"), n * 3))))
    r = t(spark, sf_dir, "nation").select(n.alias("geography_id"), deep.alias("category_scores"), F.when(n % 2 == 0, lens(n)).alias("scores"), F.lit(50).alias("confidence"))
    e = t(spark, sf_dir, "nation").where("n_nationkey % 4 = 0").select(n.alias("geography_id"), F.lit(2030).alias("year"), (n * 1.5).cast("double").alias("demand"), F.lit(10).alias("confidence"))
    return W.comparison(r, e, [0, 3, 4, 8, 9, 11], "powerBalance", 2030)


@query("""
SELECT c_custkey AS geography_id, n_nationkey AS source_id FROM customer JOIN nation ON n_nationkey IN (c_nationkey, (c_nationkey + 5) % 25)""")
def evidence_of_regions(spark, sf_dir):
    """Evidence rows of regions' source ids."""
    r = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("geography_id"), F.array(F.col("c_nationkey"), (F.col("c_nationkey") + 5) % 25, F.col("c_nationkey")).alias("source_ids"))
    return W.evidence_of(r, t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("source_id"))).select("geography_id", "source_id")


@query("""
WITH d AS (SELECT s_suppkey AS k, CAST(s_suppkey * 7 % 360 - 180 AS DOUBLE) AS lon, CAST(s_suppkey % 120 - 60 AS DOUBLE) AS lat, s_suppkey % 500 AS mw FROM supplier WHERE s_suppkey % 9 > 0),
c AS (SELECT *, CAST(floor((lon + 180) / 360 * 2048 / 50) AS BIGINT) AS cx, CAST(floor((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * 3.141592653589793)) * 2048 / 50) AS BIGINT) AS cy FROM d)
SELECT cx, cy, count(*) AS plants, sum(mw)::DOUBLE AS capacity_mw, count(*) FILTER (k % 3 = 0) AS solar FROM c GROUP BY 1, 2""")
def marker_clusters(spark, sf_dir):
    """Markers of a zoom level by pixel cells."""
    return W.marker_clusters(_generators(spark, sf_dir), 2).select("cx", "cy", "plants", "capacity_mw", F.coalesce(F.try_element_at("by_technology", F.lit("solar")), F.lit(0)).alias("solar"))


@query("""
SELECT c_custkey AS id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def visible_assets(spark, sf_dir):
    """Assets whose layer is shown."""
    return W.visible(_assets(spark, sf_dir), True, False).select("id")


# --- state series and observations ---------------------------------------------------------


@query("""
WITH r AS (SELECT c_nationkey AS state, year(o_orderdate)::INTEGER AS year, o_orderkey % 6 AS f, CAST(sum(CAST(o_totalprice AS DECIMAL(28,6))) AS DOUBLE) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
k AS (SELECT * FROM r a WHERE NOT (f = 0 AND EXISTS (SELECT 1 FROM r b WHERE b.state = a.state AND b.year = a.year AND b.f IN (1, 2, 3, 4))) AND NOT (f = 1 AND EXISTS (SELECT 1 FROM r b WHERE b.state = a.state AND b.year = a.year AND b.f = 2))),
g AS (SELECT state, year, CASE f WHEN 0 THEN 'other' WHEN 1 THEN 'coal' WHEN 2 THEN 'coal' WHEN 3 THEN 'gas' WHEN 4 THEN 'oil' ELSE 'solar' END AS t, sum(CAST(v AS DECIMAL(28,6))) AS v FROM k GROUP BY 1, 2, 3)
SELECT state, year, CAST(sum(v) AS DOUBLE) AS mix_gwh, count(*)::INTEGER AS technologies, CAST(max(v) FILTER (t = 'coal') AS DOUBLE) AS coal FROM g GROUP BY 1, 2""")
def state_generation(spark, sf_dir):
    """States' generation by technology; fuel aggregates go where their parts are reported."""
    d = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("state"), F.year("o_orderdate").alias("year"), (F.col("o_orderkey") % 6).alias("f")).agg(F.sum(R.money(F.col("o_totalprice"))).cast("double").alias("v"))
    rows = d.select("state", "year", F.lit("99").alias("sector"), pick(F.col("f"), "FOS", "COW", "BIT", "NG", "DFO", "SUN").alias("fuel"), F.lit(None).cast("string").alias("description"), F.col("v").cast("decimal(28,6)").cast("string").alias("value"), F.lit("thousand megawatthours").alias("unit"))
    g = feeds.state_generation(rows)
    total = F.aggregate(F.map_values("mix"), F.lit(0).cast("decimal(38,6)"), lambda a, x: (a + x.cast("decimal(28,6)")).cast("decimal(38,6)")).cast("double")
    return g.select("state", "year", total.alias("mix_gwh"), F.size("mix").alias("technologies"), F.try_element_at("mix", F.lit("coal")).alias("coal"))


@query("""
WITH d AS (SELECT l_suppkey AS state, year(l_shipdate)::INTEGER AS year, l_linenumber AS p, CAST(sum(CAST(l_quantity AS DECIMAL(28,6))) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2, 3)
SELECT state, year, coalesce(max(v) FILTER (p = 7), CAST(sum(CAST(v AS DECIMAL(28,6))) FILTER (p < 6) AS DOUBLE)) AS dependable_mw FROM d GROUP BY 1, 2 HAVING coalesce(max(v) FILTER (p = 7), CAST(sum(CAST(v AS DECIMAL(28,6))) FILTER (p < 6) AS DOUBLE)) IS NOT NULL""")
def state_capability(spark, sf_dir):
    """Explicit totals, else sums of distinct cells; partial totals never count."""
    n = F.col("l_linenumber")
    d = t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("state"), F.year("l_shipdate").alias("year"), n).agg(F.sum(R.money(F.col("l_quantity"))).cast("decimal(28,6)").cast("string").alias("value"))
    rows = d.select("state", "year", F.when(n == 7, "00").otherwise(n.cast("string")).alias("producer"), F.when(n == 7, "ALL").when(n == 6, "TSN").otherwise("NG").alias("fuel"), "value", F.lit("MW").alias("unit"))
    return feeds.state_capability(rows)


@query("""
WITH d AS (SELECT c_nationkey AS iso3, year(o_orderdate)::INTEGER AS year, o_orderkey % 4 AS f, CAST(sum(CAST(o_totalprice AS DECIMAL(28,6))) AS DOUBLE) AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey < 20 GROUP BY 1, 2, 3)
SELECT iso3, year, max(v) FILTER (f = 0) AS demand_gwh, CAST(sum(CAST(v AS DECIMAL(28,6))) FILTER (f IN (1, 2)) AS DOUBLE) AS other, max(v) FILTER (f = 3) AS hydro FROM d GROUP BY 1, 2""")
def electricity_mix(spark, sf_dir):
    """Countries' yearly demand and mix; fuels of one bucket are summed, other areas left out."""
    d = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("iso3"), F.year("o_orderdate").alias("year"), (F.col("o_orderkey") % 4).alias("f")).agg(F.sum(R.money(F.col("o_totalprice"))).cast("double").alias("gwh"))
    rows = d.select("iso3", "year", F.when(F.col("f") == 0, "demand").otherwise("fuel").alias("kind"), pick(F.col("f"), "-", "Peat", "Other renewables", "Hydro").alias("fuel"), "gwh")
    m = feeds.electricity_mix(rows, t(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("iso3")))
    return m.select("iso3", "year", "demand_gwh", F.try_element_at("mix", F.lit("other")).alias("other"), F.try_element_at("mix", F.lit("hydro")).alias("hydro"))


@query("""
SELECT c_custkey AS geography_id, 2026 + c_custkey % 3 AS year, CAST(c_custkey AS DOUBLE) * CASE c_custkey % 3 WHEN 0 THEN 0.001 WHEN 1 THEN 1 ELSE 1000 END AS demand_gwh, CASE WHEN c_custkey % 4 > 0 THEN c_custkey * 2 END::DOUBLE AS peak_mw, -c_custkey::DOUBLE AS net_interchange_gwh, (c_custkey / 2.0)::DOUBLE AS solar, 10 AS freshness_days FROM customer""")
def curated_observations(spark, sf_dir):
    """Curated rows typed and converted, under licence, country and freshness rules."""
    k = F.col("c_custkey")
    raw = t(spark, sf_dir, "customer").select(
        F.concat(F.lit("code"), k.cast("string")).alias("source_region_code"), F.lit("AAA").alias("country_iso3"), (2026 + k % 3).alias("year"), k.cast("string").alias("demand_value"), pick(k, "MWh", "GWh", "TWh").alias("demand_unit"), F.lit("").alias("generation_value"), F.lit("").alias("generation_unit"),
        F.when(k % 4 > 0, (k * 2).cast("string")).otherwise("").alias("peak_value"), F.lit("MW").alias("peak_unit"), (-k).cast("string").alias("net_interchange_value"), F.lit("GWh").alias("net_interchange_unit"), F.lit(None).cast("string").alias("observed_unmet_demand_value"), F.lit(None).cast("string").alias("observed_unmet_demand_unit"),
        F.concat(F.lit('{"solar":{"value":"'), (k * 500).cast("string"), F.lit('","unit":"MWh"}}')).alias("generation_mix_json"), F.lit("s").alias("source_id"), k.cast("string").alias("source_record_id"), F.lit("https://x.org").alias("source_url"), F.lit("CC-BY-4.0").alias("licence"), F.lit("2026-01-11").alias("updated_at"), F.lit("2026-01-01").alias("observation_date"), F.lit("reported").alias("value_kind"), F.lit("m").alias("method_id"),
    )
    mapping = feeds.region_mapping(t(spark, sf_dir, "customer").select(F.concat(F.lit(" code"), k.cast("string")).alias("code"), k.cast("string").alias("geography_id")), t(spark, sf_dir, "customer").select(k.cast("string").alias("geography_id")))
    regions = t(spark, sf_dir, "customer").select(k.cast("string").alias("geography_id"), F.lit("AAA").alias("iso3"))
    return feeds.observations(raw, mapping, regions).select(F.col("geography_id").cast("long").alias("geography_id"), "year", "demand_gwh", "peak_mw", "net_interchange_gwh", F.try_element_at("mix", F.lit("solar")).alias("solar"), "freshness_days")


@query("""
WITH d AS (SELECT o_custkey AS geography_id, o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS r, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS demand, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice * 2 END AS peak FROM orders)
SELECT geography_id, 2026 AS year, min_by(demand, (-r, k)) FILTER (demand IS NOT NULL) AS demand, min_by(peak, (-r, k)) FILTER (peak IS NOT NULL) AS peak FROM d GROUP BY 1 HAVING count(demand) + count(peak) > 0""")
def best_observations(spark, sf_dir):
    """Field by field the observation of the best source."""
    k = F.col("o_orderkey")
    d = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("geography_id"), F.lit(2026).alias("year"), F.lit("s").alias("source_id"), F.lpad(k.cast("string"), 12, "0").alias("source_record_id"), pick(k, "research_verified", "community_mapped", "modelled").alias("source_type"), F.when(k % 5 > 0, F.col("o_totalprice")).alias("demand"), F.when(k % 2 == 0, F.col("o_totalprice") * 2).alias("peak"))
    return feeds.best_observations(d, ["demand", "peak"])


# --- population ----------------------------------------------------------------------------


def _people(spark, sf_dir):
    k = F.col("c_custkey")
    return t(spark, sf_dir, "customer").select(F.lpad(k.cast("string"), 9, "0").alias("geography_id"), F.col("c_nationkey").alias("country"), F.lit(2026).alias("year"), (k * 37 % 1000 + 1).cast("long").alias("population"), pick(k, "reported", "estimated", "estimated").alias("value_kind"))


@query("""
WITH p AS (SELECT c_custkey AS k, c_nationkey AS c, c_custkey * 37 % 1000 + 1 AS n, c_custkey % 3 = 0 AS fixed FROM customer), s AS (SELECT c, sum(n) AS total, sum(CASE WHEN fixed THEN n ELSE 0 END) AS f FROM p GROUP BY 1),
j AS (SELECT p.*, f, total, CASE WHEN c % 2 = 0 THEN total + total // 5 + 7 ELSE total END AS control FROM p JOIN s USING (c)),
e AS (SELECT *, round_even(CAST(control - f AS DOUBLE) * n / CAST(sum(n) OVER (PARTITION BY c) AS DOUBLE), 9) AS exact FROM j WHERE NOT fixed AND c % 2 = 0),
g AS (SELECT *, floor(exact) AS fl, control - f - sum(floor(exact)) OVER (PARTITION BY c) AS rest, row_number() OVER (PARTITION BY c ORDER BY exact - floor(exact) DESC, k) AS rn FROM e)
SELECT k, CAST(fl + CASE WHEN rn <= rest THEN 1 ELSE 0 END AS BIGINT) AS population, 'estimated' AS value_kind FROM g
UNION ALL SELECT k, n, CASE WHEN fixed THEN 'reported' ELSE 'estimated' END FROM j WHERE fixed OR c % 2 = 1""")
def population_reconcile(spark, sf_dir):
    """Modelled people scaled to national controls beyond one per cent, officials fixed, whole people."""
    p = _people(spark, sf_dir)
    total = p.groupBy("country", "year").agg(F.sum("population").alias("n"))
    controls = total.select("country", "year", F.when(F.col("country") % 2 == 0, F.col("n") + F.floor(F.col("n") / 5) + 7).otherwise(F.col("n")).alias("population"))
    return N.reconcile(p, controls).select(F.col("geography_id").cast("long").alias("k"), "population", "value_kind")


@query("""
WITH r AS (SELECT c_custkey AS k, c_custkey * 37 % 1000 + 1 AS n, CASE WHEN c_custkey % 3 = 0 THEN 'reported' ELSE 'estimated' END AS kind FROM customer WHERE c_custkey % 10 < 8),
o AS (SELECT c_custkey AS k, c_custkey * 2 AS n FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 5 > 0)
SELECT k, CAST(CASE WHEN o.n IS NULL THEN r.n ELSE o.n END AS BIGINT) AS population, CASE WHEN o.n IS NULL THEN r.kind ELSE 'reported' END AS value_kind FROM r FULL OUTER JOIN o USING (k)
UNION ALL SELECT c_custkey, 1, 'inherited' FROM customer WHERE c_custkey % 10 = 8 AND NOT (c_custkey % 7 = 0 AND c_custkey % 5 > 0)""")
def population_overrides(spark, sf_dir):
    """Official values over modelled and unavailable ones where they pass the rules, fallbacks where nothing else is there."""
    k = F.col("geography_id").cast("long")
    p = _people(spark, sf_dir).withColumn("country", F.lit("AA"))
    rows, unavailable = p.where(k % 10 < 8), p.where(k % 10 >= 8).select("geography_id", "year", "country")
    o = p.where(k % 7 == 0).select("geography_id", F.when(k % 5 > 0, "AA").otherwise("BB").alias("country"), "year", (k * 2).alias("population"), F.lit("s").alias("source_id"), F.lit("https://s.org").alias("source_url"), F.lit("r").alias("release"))
    done, left, _ = N.official_overrides(rows, unavailable, o, (2026,))
    fallback = p.where(k % 10 == 8).withColumn("population", F.lit(1).cast("long")).withColumn("value_kind", F.lit("inherited"))
    done, _ = N.fill_unavailable(done, left, fallback)
    return done.select(k.alias("k"), "population", "value_kind")


@query("""
SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') || ':2026' AS id, CASE WHEN c_custkey % 10 = 9 THEN 'row_or_unavailable' ELSE 'not_both' END AS rule FROM customer WHERE c_custkey % 10 = 9 OR c_custkey % 20 = 0
UNION ALL SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') || ':2026', 'population_whole' FROM customer WHERE c_custkey % 11 = 0 AND c_custkey % 10 < 9""")
def population_rules(spark, sf_dir):
    """Broken rules of a population release."""
    k = F.col("geography_id").cast("long")
    p = _people(spark, sf_dir).withColumn("country", F.lit("AA"))
    rows = p.where(k % 10 < 9).withColumn("population", F.when(k % 11 == 0, -1).otherwise(F.col("population")))
    return N.release_violations(rows, p.where(k % 20 == 0), p.select("geography_id"), (2026,)).select("id", "rule")


@query("""
SELECT coalesce(a.k, b.k)::VARCHAR AS input, a.v IS DISTINCT FROM b.v AS stale FROM (SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey < 20) a FULL OUTER JOIN (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN 'new' ELSE n_name END AS v FROM nation WHERE n_nationkey > 4) b ON a.k = b.k""")
def stale_inputs(spark, sf_dir):
    """Inputs whose fingerprint differs from the stored one."""
    n = F.col("n_nationkey")
    d = t(spark, sf_dir, "nation").select(n.cast("string").alias("input"), F.col("n_name").alias("fingerprint"), n.alias("n"))
    return N.is_stale(d.where("n < 20").drop("n"), d.where("n > 4").withColumn("fingerprint", F.when(F.col("n") % 3 == 0, "new").otherwise(F.col("fingerprint"))).drop("n"))


# --- energy model ------------------------------------------------------------------------------


@query("""
WITH r AS (SELECT c_custkey AS g, c_nationkey AS c, c_custkey % 100 + 1 AS p, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 50 + 1 END AS a FROM customer WHERE c_nationkey % 6 > 0),
s AS (SELECT *, p / CAST(sum(p) OVER (PARTITION BY c) AS DOUBLE) AS ps, a / CAST(sum(a) OVER (PARTITION BY c) AS DOUBLE) AS act FROM r)
SELECT g AS geography_id, round(CASE WHEN a IS NULL THEN ps ELSE (0.55 * act + 0.30 * ps) / (0.55 + 0.30) END, 12) AS score, CASE WHEN a IS NULL THEN 'population_only' ELSE 'multi_covariate' END AS grade FROM s""")
def demand_weights(spark, sf_dir):
    """Scores of regions from shares of population and activity; countries with an unavailable region stay whole."""
    k = F.col("c_custkey")
    c = t(spark, sf_dir, "customer")
    p = c.select(k.alias("geography_id"), F.col("c_nationkey").alias("country"), F.lit(2026).alias("year"), (k % 100 + 1).alias("population"))
    gone = p.where(F.col("country") % 6 == 0).select("geography_id", "country", "year")
    a = c.where("c_custkey % 4 > 0").select(k.alias("geography_id"), F.lit(2026).alias("year"), (k % 50 + 1).cast("double").alias("value"))
    scored, _ = E.demand_weights(p, gone, a, a.limit(0))
    return scored.select("geography_id", F.round("score", 12).alias("score"), "grade")


@query("""
SELECT c_custkey AS geography_id, y::INTEGER AS year, (c_nationkey * 100)::DOUBLE AS national_control, NULL::DOUBLE AS demand, 'country_level_only' AS availability FROM customer, range(2026, 2032) r(y) WHERE c_nationkey % 6 = 0""")
def country_level_only(spark, sf_dir):
    """Rows without metrics of regions whose country stays whole."""
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("geography_id"), F.col("c_nationkey").alias("country"))
    controls = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("country"), (F.col("n_nationkey") * 100).cast("double").alias("control"))
    return E.country_level_rows(c, c.where("country % 6 = 0"), controls).select("geography_id", "year", "national_control", "demand", "availability")


def _supply_plants(spark, sf_dir):
    k = F.col("s_suppkey")
    none = F.lit(None)
    return t(spark, sf_dir, "supplier").select(
        k.alias("plant_id"), F.col("s_nationkey").alias("geography_id"), F.col("s_nationkey").alias("country"), pick(k, "solar", "gas").alias("technology"), pick(k, "operational", "announced", "retired", "under_construction").alias("lifecycle"), F.lit(None).cast("string").alias("raw_status"),
        F.when(k % 7 > 0, rng((k % 100).cast("double"))).alias("capacity"), pick(k, "reported", "estimated").alias("capacity_kind"), F.when(k % 5 == 0, rng((k % 10).cast("double"))).alias("reported_gwh"), none.cast(E.RANGE).alias("reported_dependable"),
        F.when(k % 3 == 0, (2020 + k % 12).cast("int")).alias("commissioning_year"), F.when(k % 11 == 0, F.lit(2028)).alias("retirement_year"), F.when(k % 4 == 1, (2025 + k % 5).cast("int")).alias("target_year"),
    )


def _assumptions(spark):
    row = lambda tech, cf, cr: (tech, tuple(cf), tuple(cr))
    return spark.createDataFrame([row("solar", (0.12, 0.2, 0.3), (0.05, 0.18, 0.35)), row("gas", (0.25, 0.5, 0.75), (0.8, 0.9, 0.95))], f"technology string, capacity_factor {E.RANGE}, capacity_credit {E.RANGE}")


DELIVERED = """
WITH p AS (SELECT s_suppkey AS k, s_nationkey AS g, s_suppkey % 2 AS tech, s_suppkey % 4 AS life, CASE WHEN s_suppkey % 7 > 0 THEN s_suppkey % 100 END AS mw, CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey % 10 END AS rep, CASE WHEN s_suppkey % 3 = 0 THEN 2020 + s_suppkey % 12 END AS com, CASE WHEN s_suppkey % 11 = 0 THEN 2028 END AS ret, CASE WHEN s_suppkey % 4 = 1 THEN 2025 + s_suppkey % 5 END AS tgt, y FROM supplier, range(2026, 2032) r(y)),
d AS (SELECT *, CASE WHEN life = 2 THEN 0.0 WHEN ret IS NOT NULL AND y > ret THEN 0.0 WHEN life = 0 THEN CASE WHEN com IS NULL OR com <= y THEN 1.0 ELSE 0.0 END WHEN coalesce(tgt, com) IS NULL OR coalesce(tgt, com) > y THEN 0.0 WHEN life = 1 THEN 0.35 ELSE 0.9 END::DOUBLE AS f FROM p),
v AS (SELECT *, mw * f AS inst, CASE WHEN rep IS NOT NULL THEN rep * 1.0 ELSE mw * CASE tech WHEN 0 THEN 0.2::DOUBLE ELSE 0.5 END * 8.76::DOUBLE END * f AS gen, mw * CASE tech WHEN 0 THEN 0.18::DOUBLE ELSE 0.9 END * f AS dep, CASE WHEN life IN (1, 3) THEN 55 WHEN rep IS NOT NULL THEN 92 ELSE 55 END AS gc FROM d)"""


@query(DELIVERED + " SELECT k AS plant_id, y::INTEGER AS year, f AS delivery, round(inst, 6) AS installed, round(gen, 6) AS generation, round(dep, 6) AS dependable, gc::INTEGER AS generation_confidence FROM v")
def plant_supply(spark, sf_dir):
    """Delivery, installed, generated and dependable figures of every plant in every year."""
    none = spark.createDataFrame([], "country int, technology string, low double, central double, high double")
    d = E.plant_supply(_supply_plants(spark, sf_dir), none, _assumptions(spark))
    return d.select("plant_id", "year", "delivery", F.round("installed", 6).alias("installed"), F.round("generation.central", 6).alias("generation"), F.round("dependable.central", 6).alias("dependable"), "generation_confidence")


@query(DELIVERED + """ SELECT g AS geography_id, y::INTEGER AS year, count(*) AS plants, round(CAST(sum(CAST(gen AS DECIMAL(28,6))) AS DOUBLE), 3) AS generation, round(CAST(sum(CAST(dep AS DECIMAL(28,6))) AS DOUBLE), 3) AS dependable, round(100.0 * count(gen) / count(*), 4)::DOUBLE AS generation_coverage, coalesce(min(gc) FILTER (gen IS NOT NULL), 0)::INTEGER AS generation_confidence FROM v WHERE f > 0 GROUP BY 1, 2""")
def regional_supply(spark, sf_dir):
    """Supply of regions: sums, coverage of what is known, the least confidence."""
    none = spark.createDataFrame([], "country int, technology string, low double, central double, high double")
    d = E.regional_supply(E.plant_supply(_supply_plants(spark, sf_dir), none, _assumptions(spark)))
    return d.select("geography_id", "year", "plants", F.round("generation.central", 3).alias("generation"), F.round("dependable.central", 3).alias("dependable"), "generation_coverage", "generation_confidence")


@query("""
WITH m AS (SELECT s_suppkey AS g, s_nationkey AS c, 2020 + y AS year, CAST(s_suppkey % 100 * (4 + y) AS DOUBLE) AS gen, CAST(s_suppkey % 100 AS DOUBLE) AS mw FROM supplier, range(0, 4) r(y) WHERE s_suppkey % 100 > 0 AND s_suppkey % 4 < 2),
k AS (SELECT c, year, sum(gen) AS g, sum(mw) * 8.76::DOUBLE AS cap FROM m WHERE gen <= mw * 8.76::DOUBLE GROUP BY 1, 2)
SELECT c AS country, 'gas' AS technology, round(sum(g) / sum(cap), 9) AS central, round(min(g / cap), 9) AS low, round(max(g / cap), 9) AS high, count(*) AS years FROM k GROUP BY 1 HAVING count(*) >= 2 AND sum(cap) / 8.76::DOUBLE / count(*) >= 100""")
def factors_from_mixes(spark, sf_dir):
    """Observed capacity factors from official mixes and operating plants; impossible rows are left out."""
    k = F.col("s_suppkey")
    s = t(spark, sf_dir, "supplier")
    mixes = s.select(k.alias("geography_id"), F.col("s_nationkey").alias("country"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"), k).select("geography_id", "country", (2020 + F.col("i")).alias("year"), F.create_map(F.lit("gas"), (k % 100 * (4 + F.col("i"))).cast("double")).alias("mix"))
    plants = s.select(k.alias("geography_id"), F.lit("gas").alias("technology"), F.when(k % 4 < 2, "operational").otherwise("announced").alias("lifecycle"), rng((k % 100).cast("double")).alias("capacity"))
    f = E.observed_factors(E.factor_inputs(mixes, plants))
    return f.select("country", "technology", *[F.round(c, 9).alias(c) for c in ("central", "low", "high")], "years")


@query("""
WITH r AS (SELECT c_custkey AS g, y, CAST(c_custkey % 90 + 10 + (y - 2026) * 5 AS DOUBLE) AS d, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey % 70 AS DOUBLE) END AS gen, CASE WHEN c_custkey % 4 > 0 THEN CAST(c_custkey % 9 AS DOUBLE) END AS dep, CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 5 + 3.0 END AS unmet FROM customer, range(2026, 2032) q(y)),
i AS (SELECT *, d / 8.76::DOUBLE AS peak, d - gen AS gap, 10.0 + c_c AS f FROM (SELECT *, g % 90 AS c_c FROM r)),
x AS (SELECT g, y, d, gap, peak, greatest(0, least(100, 100 - 100 * dep / peak)) AS a, greatest(0, least(100, 100 * greatest(0, gap) / d)) AS b, CASE WHEN gap IS NULL THEN NULL ELSE 1 END AS hb, greatest(0, least(100, 100 * unmet / d)) AS u, greatest(0, least(100, 100 * (d - f) / f)) AS gr, dep, unmet FROM i),
w AS (SELECT *, CASE WHEN dep IS NULL THEN 0 ELSE 35 END + CASE WHEN hb IS NULL THEN 0 ELSE 30 END + CASE WHEN unmet IS NULL THEN 0 ELSE 15 END + 10 AS cov FROM x)
SELECT g AS geography_id, y::INTEGER AS year, round(peak, 6) AS peak, gap, cov::DOUBLE AS coverage, CASE WHEN cov >= 60 THEN round((coalesce(CASE WHEN dep IS NOT NULL THEN a END * 35, 0) + coalesce(CASE WHEN hb IS NOT NULL THEN b END * 30, 0) + coalesce(CASE WHEN unmet IS NOT NULL THEN u END * 15, 0) + gr * 10) / cov, 6) END AS score FROM w""")
def balance_forecast(spark, sf_dir):
    """Forecasts with peaks, gaps, balance scores and what they rest on."""
    k = F.col("c_custkey")
    c = t(spark, sf_dir, "customer").select("c_custkey", F.explode(F.sequence(F.lit(2026), F.lit(2031))).alias("year"))
    none = F.lit(None).cast(E.RANGE)
    demand = c.select(k.alias("geography_id"), "year", rng((k % 90 + 10 + (F.col("year") - 2026) * 5).cast("double")).alias("demand"), none.alias("peak"), F.lit(80.0).alias("demand_confidence"), F.lit(100.0).alias("demand_coverage"))
    supply = c.select(k.alias("geography_id"), "year", F.when(k % 3 > 0, rng((k % 70).cast("double"))).alias("generation"), F.when(k % 4 > 0, rng((k % 9).cast("double"))).alias("dependable"), F.lit(1.0).alias("installed"), F.lit(55).alias("confidence"), F.lit(50.0).alias("coverage"))
    official = c.where("c_custkey % 5 = 0").select(k.alias("geography_id"), "year", *[none.alias(x) for x in ("demand", "generation", "peak", "dependable", "interchange")], (k % 5 + 3).cast("double").alias("unmet"), F.lit("reported").alias("unmet_kind"))
    f = E.forecast(demand, supply, official)
    return f.select("geography_id", "year", F.round("peak.central", 6).alias("peak"), F.col("gap.central").alias("gap"), F.col("balance_coverage").alias("coverage"), F.round("balance_score", 6).alias("score"))


@query("""
WITH a AS (SELECT c_custkey AS i, c_nationkey AS g, 2026 + c_custkey % 6 AS y FROM customer), s AS (SELECT g, y, CAST(sum(i) AS DOUBLE) AS more, count(*) AS n FROM a GROUP BY 1, 2)
SELECT n_nationkey AS geography_id, q.y::INTEGER AS year, 100.0 + coalesce(more, 0) AS demand, coalesce(n, 0)::INTEGER AS applied FROM nation CROSS JOIN range(2026, 2032) q(y) LEFT JOIN s ON s.g = n_nationkey AND s.y = q.y""")
def applied_increments(spark, sf_dir):
    """Increments on exactly their region and year, each once though it stands twice."""
    k = F.col("c_custkey")
    i = t(spark, sf_dir, "customer").select(k.cast("string").alias("increment_id"), F.col("c_nationkey").alias("geography_id"), (2026 + k % 6).cast("int").alias("target_year"), rng(k.cast("double")).alias("demand_gwh"))
    d = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("geography_id"), F.explode(F.sequence(F.lit(2026), F.lit(2031))).alias("year"), rng(F.lit(100.0)).alias("demand"))
    return E.apply_increments(d, i.union(i)).select("geography_id", "year", F.col("demand.central").alias("demand"), F.size("applied").alias("applied"))


@query("""
WITH d AS (SELECT o_custkey AS c, year(o_orderdate) AS y, o_orderkey AS k, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate) DESC, o_orderkey) AS rn FROM orders)
SELECT c AS country, q.y::INTEGER AS year, k AS control, d.y::INTEGER AS source_year, CASE WHEN d.y = q.y THEN 'reported' ELSE 'inherited' END AS value_kind FROM d, range(1998, 2000) q(y) WHERE rn = 1""")
def carried_controls(spark, sf_dir):
    """The latest control of each country carried to later years."""
    d = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("country"), F.year("o_orderdate").alias("year"), F.col("o_orderkey").alias("control"), F.lit("reported").alias("value_kind"))
    return E.carried(E.latest_control(d, "country", "year", "control"), years=(1998, 1999)).select("country", "year", "control", "source_year", "value_kind")


# --- validation and sets -------------------------------------------------------------------------


@query("""
SELECT 'plants' AS artifact, CAST(s_suppkey AS VARCHAR) AS id, 'geography_known' AS rule FROM supplier WHERE s_suppkey % 40 >= 25
UNION ALL SELECT 'energy', CAST(n_nationkey AS VARCHAR), 'years_complete' FROM nation WHERE n_nationkey % 4 = 0
UNION ALL SELECT 'regions', CAST(n_nationkey AS VARCHAR), 'score_total_range' FROM nation WHERE n_nationkey > 20
UNION ALL SELECT 'generators', CAST(s_nationkey AS VARCHAR), 'feature_count' FROM supplier GROUP BY s_nationkey HAVING s_nationkey % 5 = 0""")
def snapshot_rules(spark, sf_dir):
    """Broken rules of a snapshot across its artifacts."""
    n = F.col("n_nationkey")
    nation = t(spark, sf_dir, "nation")
    countries = nation.select(n.alias("country"))
    regions = nation.select(n.cast("long").alias("geography_id"), n.alias("country"), (n * 5 - 0).cast("double").alias("score_total"))
    plants = _generators(spark, sf_dir).withColumn("lon", F.coalesce("lon", F.lit(0.0))).withColumn("lat", F.coalesce("lat", F.lit(0.0)))
    index = W.country_index(plants).withColumn("features", F.col("features") + F.when(F.col("country") % 5 == 0, 1).otherwise(0))
    assets = _assets(spark, sf_dir).select("id", F.lit(1.0).alias("lon"), F.lit(1.0).alias("lat"))
    energy = nation.select(n.alias("geography_id"), F.explode(F.sequence(F.lit(2026), F.when(n % 4 == 0, 2030).otherwise(2031))).alias("year"), rng(F.lit(1.0), 0.5, 2.0).alias("demand"))
    return W.snapshot_violations(countries, regions, assets, plants, index, energy)


@query("""
SELECT s_suppkey % 40 AS geography_id, count(*) AS in_shards, CASE WHEN s_suppkey % 40 % 2 = 0 THEN count(*) + 1 END AS in_overview FROM supplier GROUP BY s_suppkey % 40 HAVING s_suppkey % 40 % 2 = 0 OR s_suppkey % 40 % 3 = 0""")
def generator_reconciliation(spark, sf_dir):
    """Geographies whose plants in shards and overview differ."""
    g = _generators(spark, sf_dir)
    o = W.regional_mix(g).where("geography_id % 2 = 0 or geography_id % 3 > 0").withColumn("plants", F.col("plants") + F.when(F.col("geography_id") % 2 == 0, 1).otherwise(0))
    return W.reconciles(g, o)


@query("""
SELECT c_custkey AS id, 'retirement' AS rule FROM customer WHERE c_custkey % 8 = 3 UNION ALL SELECT c_custkey, 'range_order' FROM customer WHERE c_custkey % 9 = 4 UNION ALL SELECT c_custkey, 'lifecycle' FROM customer WHERE c_custkey % 10 = 6""")
def asset_contract(spark, sf_dir):
    """Assets that break their contract."""
    k = F.col("c_custkey")
    d = t(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 9 == 4, rng(k.cast("double"), 2.0, 1.0)).otherwise(rng(k.cast("double"))).alias("demand_mw"), F.lit("data_centre").alias("category"), F.when(k % 10 == 6, "gone").otherwise("paused").alias("lifecycle"), F.lit(2020).alias("commissioning_year"), F.when(k % 8 == 3, 2019).otherwise(2020).alias("retirement_year"))
    return W.asset_violations(d)


@query("""
SELECT c_custkey AS geography_id, CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE CASE WHEN c_nationkey < 20 THEN c_nationkey END END::BIGINT AS score, CASE WHEN c_custkey % 2 = 0 THEN 'evidence' WHEN c_nationkey < 20 THEN 'inherited' ELSE 'none' END AS origin FROM customer""")
def inherited_scores(spark, sf_dir):
    """Regions' own scores, else those of their country."""
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("geography_id"), F.col("c_nationkey").alias("parent_id"))
    own = c.where("geography_id % 2 = 0").select("geography_id", F.col("geography_id").alias("score"))
    up = t(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("geography_id"), F.col("n_nationkey").cast("long").alias("score"))
    return W.inherit(c, own, up, ["score"]).drop("parent_id")


@query("""
SELECT (SELECT count(*) FROM customer) AS regions, (SELECT count(DISTINCT c_nationkey) FROM customer) AS regions_country, (SELECT count(*) FROM supplier) AS plants, (SELECT count(DISTINCT s_nationkey) FROM supplier) AS plants_source_id""")
def coverage_counts(spark, sf_dir):
    """Rows, countries and sources of what is published."""
    return W.coverage_counts(regions=t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("country")), plants=t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("source_id")))


@query("""
SELECT k, source, source_rank, extra FROM (SELECT s_suppkey AS k, 'official' AS source, 0 AS source_rank, NULL::DOUBLE AS extra FROM supplier UNION ALL SELECT c_custkey, 'tracker', 1, c_acctbal FROM customer)""")
def feed_union(spark, sf_dir):
    """Feeds as one table by precedence."""
    rows, _ = feeds.union_with_counts([("official", t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))), ("tracker", t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("extra")))])
    return rows


@query("""
SELECT k, origin FROM (SELECT s_suppkey AS k, 'first' AS origin FROM supplier UNION ALL SELECT c_custkey, 'second' FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier))""")
def evidence_merge(spark, sf_dir):
    """Evidence of known ids first, then of new ones."""
    a = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("first").alias("origin"))
    return R.append_new(a, t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit("second").alias("origin")), "k")


@query("""
SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'primary' ELSE 'fallback' END AS origin, round(c_custkey / CAST(sum(c_custkey) OVER (PARTITION BY c_nationkey) AS DOUBLE), 12) AS share, least(0.5, 0.25 + (c_custkey % 30) * 0.02::DOUBLE)::DOUBLE AS fraction, greatest(0, 68 - (c_custkey % 30) * 2.5)::DOUBLE AS confidence FROM customer""")
def fills_shares_grades(spark, sf_dir):
    """Fallback rows where the primary has none, shares of a country, uncertainty by grade and age."""
    k = F.col("k")
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    d = R.fill_only(c.where("k % 2 = 0").withColumn("origin", F.lit("primary")), c.withColumn("origin", F.lit("fallback")), ["k"])
    fraction, confidence = M.graded(F.lit("population_only"), (k % 30).cast("int"))
    return R.with_shares(d, ["n"], "k").select("k", "origin", F.round("share", 12).alias("share"), fraction.alias("fraction"), confidence.alias("confidence"))


@query("""
WITH c AS (SELECT c_nationkey AS n, CAST(c_custkey * 37 % 97 + c_nationkey * 11 AS DOUBLE) - 180 AS lon FROM customer), p AS (SELECT DISTINCT n, lon FROM c),
g AS (SELECT *, lead(lon) OVER w AS nx, min(lon) OVER (PARTITION BY n) AS lo FROM p WINDOW w AS (PARTITION BY n ORDER BY lon)),
b AS (SELECT n, arg_max(coalesce(nx, lo), (coalesce(nx, lo + 360) - lon, -lon)) AS west FROM g GROUP BY 1),
m AS (SELECT n, CAST(sum(CAST(CASE WHEN lon < west THEN lon + 360 ELSE lon END AS DECIMAL(28,6))) AS DOUBLE) / count(*) AS v FROM c JOIN b USING (n) GROUP BY 1)
SELECT n, round(CASE WHEN v > 180 THEN v - 360 ELSE v END, 6) AS centre FROM m""")
def circular_centre(spark, sf_dir):
    """Mean longitudes on the circle."""
    d = t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n"), ((F.col("c_custkey") * 37 % 97 + F.col("c_nationkey") * 11).cast("double") - 180).alias("lon"))
    return R.circular_centre(d, "n", "lon").select("n", F.round("centre", 6).alias("centre"))


@query("""
SELECT 'a' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS id, (CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END)::INTEGER AS aliases, c_custkey * 1.1::DOUBLE AS mw, 'official_verified' AS source_type FROM customer""")
def duplicate_assets(spark, sf_dir):
    """Assets that two feeds report nearby, and a third under a shared id."""
    from wattlake.operators.assets import dedupe_assets

    k = F.col("c_custkey")
    ids = lambda c: F.create_map(F.lit("osm"), c)
    base = lambda d, tag, source, x, mw, own: d.select(
        F.concat(F.lit(tag), F.lpad(k.cast("string"), 9, "0")).alias("id"), F.concat(F.lit("Site "), k.cast("string")).alias("name"), F.lit("Op").alias("operator"), F.col("c_nationkey").cast("string").alias("country"), F.lit("data_centre").alias("category"), (2026 + k % 5).cast("int").alias("target_year"),
        (k * mw).cast("double").alias("mw"), (k % 300 - 150 + F.lit(x)).cast("double").alias("lon"), (k % 100 - 50).cast("double").alias("lat"), own.alias("external_ids"), F.lit(source).alias("source_type"), F.lit("exact").alias("location_precision"), F.array(F.lit(tag)).alias("source_ids"),
    )
    c = t(spark, sf_dir, "customer")
    rows = base(c, "a", "community_mapped", 0.95, 1.0, ids(F.concat(F.lit("w"), k.cast("string")))).unionByName(base(c, "b", "official_verified", 1.15, 1.1, ids(F.lit(None).cast("string"))))
    rows = rows.unionByName(base(c.where("c_custkey % 3 = 0"), "c", "modelled", 20.0, 3.0, ids(F.concat(F.lit("w"), k.cast("string")))))
    return dedupe_assets(rows).select("id", F.size("aliases").alias("aliases"), "mw", "source_type")
