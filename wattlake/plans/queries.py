"""Registered queries: each operator over whole tables, with the same result in SQL.

The star schema stands in for the domain: nations are countries, customers are
regions, suppliers are plants, orders are yearly observations, line items are
deliveries of a technology.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattlake.functions import scalars as S
from wattlake.operators import models as M
from wattlake.operators import cover as C
from wattlake.operators import relational as R
from wattlake.operators import zonal as Z

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dec(c: str) -> str:
    return f"CAST({c} AS DECIMAL(28,6))"


@query(f"""
WITH ctl AS (SELECT c_nationkey, CAST(sum({dec('o_totalprice')}) AS DOUBLE) AS control FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
r AS (SELECT c_nationkey, c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS score,
             CASE WHEN c_custkey % 50 = 0 AND c_acctbal > 0 THEN c_acctbal END AS official FROM customer),
j AS (SELECT r.*, control, CAST(coalesce(sum({dec('official')}) OVER w, 0) AS DOUBLE) AS fixed,
             CASE WHEN official IS NULL THEN score END AS open_score,
             CAST(sum({dec('CASE WHEN official IS NULL THEN score END')}) OVER w AS DOUBLE) AS open_total
      FROM r JOIN ctl USING (c_nationkey) WINDOW w AS (PARTITION BY c_nationkey)),
d AS (SELECT *, coalesce(CAST(round_even(official, 2) AS DECIMAL(24,2)), CAST(round_even((control - fixed) * open_score / open_total, 2) AS DECIMAL(24,2))) AS part FROM j),
k AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY open_score DESC NULLS LAST, c_custkey) AS rn,
             CAST(round_even(control, 2) AS DECIMAL(24,2)) - sum(part) OVER (PARTITION BY c_nationkey) AS lack FROM d)
SELECT c_nationkey, c_custkey, CAST(part + CASE WHEN rn = 1 AND open_score IS NOT NULL THEN lack ELSE 0 END AS DOUBLE) AS demand FROM k""")
def regional_demand_allocation(spark, sf_dir):
    """National demand to regions: official rows stand, the rest by score, exact to the cent."""
    cust = t(spark, sf_dir, "customer")
    controls = t(spark, sf_dir, "orders").join(cust, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum(R.money(F.col("o_totalprice"))).cast("double").alias("control"))
    score = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    regions = cust.select("c_nationkey", "c_custkey", score.alias("score"), F.when((F.col("c_custkey") % 50 == 0) & (F.col("c_acctbal") > 0), F.col("c_acctbal")).alias("official"))
    return M.allocate(regions, controls, "c_nationkey", "c_custkey", "score", "official", "control", places=2).select("c_nationkey", "c_custkey", "demand")


@query("""
WITH w AS (SELECT c_nationkey, c_custkey, CAST(greatest(c_acctbal, 0) AS DECIMAL(18,2)) AS weight FROM customer),
e AS (SELECT *, round_even(CAST(100000 AS DOUBLE) * CAST(weight AS DOUBLE) / CAST(sum(weight) OVER (PARTITION BY c_nationkey) AS DOUBLE), 9) AS exact FROM w),
f AS (SELECT *, floor(exact) AS fl FROM e),
r AS (SELECT *, 100000 - sum(fl) OVER (PARTITION BY c_nationkey) AS rest, row_number() OVER (PARTITION BY c_nationkey ORDER BY exact - fl DESC, c_custkey) AS rn FROM f)
SELECT c_nationkey, c_custkey, CAST(fl + CASE WHEN rn <= rest THEN 1 ELSE 0 END AS BIGINT) AS units FROM r""")
def population_largest_remainder(spark, sf_dir):
    """100000 whole people per country to its regions."""
    d = t(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.greatest(F.col("c_acctbal"), F.lit(0.0)).alias("w"), F.lit(100000).cast("long").alias("people"))
    return R.largest_remainder(d, ["c_nationkey"], "c_custkey", "w", "people").select("c_nationkey", "c_custkey", "units")


@query("""
WITH y AS (SELECT c_nationkey, year(o_orderdate) AS y, sum(CAST(o_totalprice AS DECIMAL(28,6))) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
g AS (SELECT *, first_value(v) OVER (PARTITION BY c_nationkey ORDER BY y) AS f FROM y)
SELECT c_nationkey, CAST(y AS INTEGER) AS y, round(CAST(v AS DOUBLE), 2) AS demand, round(CASE WHEN f > 0 THEN (CAST(v AS DOUBLE) - CAST(f AS DOUBLE)) / CAST(f AS DOUBLE) END, 6) AS growth FROM g""")
def baseline_growth(spark, sf_dir):
    """Yearly demand of a country and its growth since the first year."""
    y = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", F.year("o_orderdate").alias("y")).agg(F.sum(R.money(F.col("o_totalprice"))).cast("double").alias("v"))
    return R.baseline_growth(y, ["c_nationkey"], "y", "v").select("c_nationkey", "y", F.round("v", 2).alias("demand"), F.round("growth", 6).alias("growth"))


@query("""
SELECT c_nationkey, c_mktsegment, round(CAST(sum(CAST(o_totalprice AS DECIMAL(28,6))) AS DOUBLE), 2) AS demand,
       round(CAST(sum(CAST(year(o_orderdate) * greatest(o_totalprice, 1) AS DECIMAL(28,6))) AS DOUBLE) / CAST(sum(CAST(greatest(o_totalprice, 1) AS DECIMAL(28,6))) AS DOUBLE), 4) AS timing,
       count(*) AS n, count(DISTINCT o_custkey) AS regions
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F' GROUP BY GROUPING SETS ((c_nationkey), (c_nationkey, c_mktsegment))""")
def active_demand(spark, sf_dir):
    """Demand per country in total and per category: sums, weighted mean timing, distinct regions."""
    d = t(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    w = F.greatest(F.col("o_totalprice"), F.lit(1.0))
    # By region first: the grouping sets then expand one row per region, not per order, and need no distinct.
    fine = d.groupBy("c_nationkey", "c_mktsegment", "o_custkey").agg(F.sum(R.money(F.col("o_totalprice"))).alias("v"), F.sum(R.money(F.year("o_orderdate") * w)).alias("tw"), F.sum(R.money(w)).alias("w"), F.count("*").alias("n"))
    return fine.groupingSets([["c_nationkey"], ["c_nationkey", "c_mktsegment"]], "c_nationkey", "c_mktsegment").agg(
        F.round(F.sum("v").cast("double"), 2).alias("demand"), F.round(F.sum("tw").cast("double") / F.sum("w").cast("double"), 4).alias("timing"), F.sum("n").alias("n"), F.count("*").alias("regions")
    )


@query("""
SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS purchases,
       count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (value IS NULL) AS missing FROM events GROUP BY 1""")
def conditional_counts(spark, sf_dir):
    kind = lambda k: F.count_if(F.col("event_type") == k)
    return t(spark, sf_dir, "events").groupBy("user_id").agg(kind("view").alias("views"), kind("click").alias("clicks"), kind("purchase").alias("purchases"), kind("error").alias("errors"), F.count_if(F.col("value").isNull()).alias("missing"))


@query("""
WITH m AS (SELECT l_suppkey, p_brand, sum(CAST(l_quantity AS DECIMAL(28,6))) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY q DESC, p_brand) AS rn, count(*) OVER (PARTITION BY l_suppkey) AS n, sum(q) OVER (PARTITION BY l_suppkey) AS total FROM m)
SELECT l_suppkey, p_brand AS dominant, CAST(q AS DOUBLE) AS dominant_mw, n AS technologies, CAST(total AS DOUBLE) AS total_mw FROM r WHERE rn = 1""")
def technology_rollup(spark, sf_dir):
    """Capacity by technology per plant, and the dominant one (ties to the smaller name)."""
    m = t(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity").join(t(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    m = m.groupBy("l_suppkey", "p_brand").agg(F.sum(R.money(F.col("l_quantity"))).alias("q"))
    top = F.min(F.struct((-F.col("q")).alias("v"), F.col("p_brand").alias("n")))
    g = m.groupBy("l_suppkey").agg(top.alias("m"), F.count("*").alias("technologies"), F.sum("q").cast("double").alias("total_mw"))
    return g.select("l_suppkey", F.col("m.n").alias("dominant"), (-F.col("m.v")).cast("double").alias("dominant_mw"), "technologies", "total_mw")


@query("""
WITH p AS (SELECT DISTINCT c_nationkey, CAST((c_custkey * 37) % 97 + c_nationkey * 11 AS DOUBLE) - 180 AS lon FROM customer),
g AS (SELECT *, min(lon) OVER (PARTITION BY c_nationkey) AS lo, coalesce(lead(lon) OVER (PARTITION BY c_nationkey ORDER BY lon), min(lon) OVER (PARTITION BY c_nationkey) + 360) AS nx FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY nx - lon DESC, lon) AS rn FROM g)
SELECT c_nationkey, CASE WHEN nx >= lo + 360 THEN lo ELSE nx END AS west, lon AS east FROM r WHERE rn = 1""")
def circular_bounds(spark, sf_dir):
    d = t(spark, sf_dir, "customer").select("c_nationkey", ((F.col("c_custkey") * 37 % 97 + F.col("c_nationkey") * 11).cast("double") - 180).alias("lon"))
    return R.circular_bounds(d, "c_nationkey", "lon")


@query("""
WITH y AS (SELECT l_suppkey, year(l_shipdate) AS y, CAST(sum(CAST(l_quantity * (1 - l_discount) AS DECIMAL(28,6))) AS DOUBLE) AS g, CAST(sum(CAST(l_quantity AS DECIMAL(28,6))) AS DOUBLE) * 8.76::DOUBLE AS c FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, round(CAST(sum(CAST(g AS DECIMAL(28,6))) AS DOUBLE) / CAST(sum(CAST(c AS DECIMAL(28,6))) AS DOUBLE), 6) AS central, round(min(g / c), 6) AS low, round(max(g / c), 6) AS high, count(*) AS years
FROM y WHERE c > 0 AND g >= 0 AND g <= c GROUP BY 1 HAVING count(*) >= 2 AND CAST(sum(CAST(c AS DECIMAL(28,6))) AS DOUBLE) / 8.76::DOUBLE / count(*) >= 100""")
def observed_capacity_factor(spark, sf_dir):
    d = t(spark, sf_dir, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("y"), (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("g"), F.col("l_quantity").alias("c0"))
    r = R.observed_factor(d.withColumnsRenamed({"g": "gen"}), ["l_suppkey"], "y", "gen", "c0")
    return r.select("l_suppkey", F.round("central", 6).alias("central"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "years")


def _boxes(spark, sf_dir):
    """A nation's shape: a box."""
    x, y = (F.col("n_nationkey") * 7).cast("double"), (F.col("n_nationkey") % 5 * 5).cast("double")
    ring = F.array(*[F.array(a, b) for a, b in ((x, y), (x + 6.5, y), (x + 6.5, y + 4.5), (x, y + 4.5))])
    return t(spark, sf_dir, "nation").select("n_nationkey", F.array(F.array(ring)).alias("polygons"))


@query("""
SELECT c_custkey, n_nationkey FROM (SELECT c_custkey, CAST(c_custkey % 360 AS DOUBLE) / 2 AS lon, CAST(c_custkey * 7 % 100 AS DOUBLE) / 4 AS lat FROM customer) p
JOIN (SELECT n_nationkey, CAST(n_nationkey * 7 AS DOUBLE) AS x, CAST(n_nationkey % 5 * 5 AS DOUBLE) AS y FROM nation) q
ON lon BETWEEN x AND x + 6.5 AND lat BETWEEN y AND y + 4.5""")
def point_in_polygon(spark, sf_dir):
    """Regions' points in countries' polygons, bounds included, by a cover of cells."""
    points = t(spark, sf_dir, "customer").select("c_custkey", ((F.col("c_custkey") % 360).cast("double") / 2).alias("lon"), ((F.col("c_custkey") * 7 % 100).cast("double") / 4).alias("lat"))
    return C.contains(points, "c_custkey", _boxes(spark, sf_dir), "n_nationkey")


@query("""
WITH b AS (SELECT s_suppkey, s_nationkey, s_acctbal, CASE WHEN s_acctbal > 0 THEN CAST(floor(ln(s_acctbal) / ln(1.25)) AS BIGINT) ELSE 0 END AS band FROM supplier)
SELECT x.s_suppkey AS a, y.s_suppkey AS b FROM b x JOIN b y ON x.s_nationkey = y.s_nationkey AND abs(x.band - y.band) <= 1 AND x.s_suppkey < y.s_suppkey
WHERE least(x.s_acctbal, y.s_acctbal) >= 0.9 * greatest(x.s_acctbal, y.s_acctbal)""")
def blocked_fuzzy_pairs(spark, sf_dir):
    """Pairs of plants of one country whose capacities are within a tenth, by neighbouring log bands."""
    d = t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal", S.log_band(F.col("s_acctbal"), 1.25).alias("band"))
    test = F.least("a.s_acctbal", "b.s_acctbal") >= 0.9 * F.greatest("a.s_acctbal", "b.s_acctbal")
    return R.blocked_pairs(d, "s_suppkey", ["s_nationkey"], {"band": 1}, test).select(F.col("a.s_suppkey").alias("a"), F.col("b.s_suppkey").alias("b"))


@query("""
WITH RECURSIVE e AS (SELECT s_suppkey AS u, (s_suppkey * 7 + 3) % 1000 AS v FROM supplier WHERE (s_suppkey * 7 + 3) % 1000 IN (SELECT s_suppkey FROM supplier)),
s AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r AS (SELECT u AS node, u AS root FROM s UNION SELECT s.v, r.root FROM r JOIN s ON s.u = r.node)
SELECT node, min(root) AS component FROM r GROUP BY 1""")
def asset_components(spark, sf_dir):
    """Duplicate plants: components of the pairs that share an identifier."""
    from wattlake.operators.graph import connected_components

    s = t(spark, sf_dir, "supplier").select("s_suppkey")
    e = s.select(F.col("s_suppkey").alias("src"), ((F.col("s_suppkey") * 7 + 3) % 1000).alias("dst"))
    return connected_components(e.join(s.select(F.col("s_suppkey").alias("dst")), "dst", "left_semi"))


@query(r"""
SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS key, regexp_replace(lower(p_type), '[^a-z0-9]+', '', 'g') AS compact,
       array_to_string(list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ('part', 'the')))), ' ') AS signature,
       substr(sha256(p_name), 1, 10) AS digest FROM part""")
def name_keys(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", S.key_normalize(F.col("p_name")).alias("key"), S.compact_key(F.col("p_type")).alias("compact"), S.name_signature(F.col("p_name"), ("part", "the")).alias("signature"), F.substring(F.sha2(F.col("p_name").cast("binary"), 256), 1, 10).alias("digest"))


@query(r"""
WITH x AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '1,' || lpad(CAST(p_size * 7 AS VARCHAR), 3, '0') || '.5 MW' WHEN 1 THEN CAST(p_size AS VARCHAR) || ' kW' WHEN 2 THEN CAST(p_size AS VARCHAR) || '.25 GW' ELSE 'n/a' END AS s, p_size FROM part)
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 1000 + p_size * 7 + 0.5 WHEN 1 THEN p_size / 1000.0 WHEN 2 THEN (p_size + 0.25) * 1000 END::DOUBLE AS mw FROM x""")
def capacity_text(spark, sf_dir):
    s = F.col("p_size")
    text = F.when(s % 4 == 0, F.concat(F.lit("1,"), F.lpad((s * 7).cast("string"), 3, "0"), F.lit(".5 MW"))).when(s % 4 == 1, F.concat(s.cast("string"), F.lit(" kW"))).when(s % 4 == 2, F.concat(s.cast("string"), F.lit(".25 GW"))).otherwise("n/a")
    return t(spark, sf_dir, "part").select("p_partkey", S.capacity_mw(text).alias("mw"))


@query("""
SELECT s_suppkey, round(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)))), 4) AS km
FROM (SELECT s_suppkey, CAST(s_suppkey % 360 - 180 AS DOUBLE) AS lon1, CAST(s_suppkey % 170 - 85 AS DOUBLE) AS lat1, CAST(s_nationkey * 10 - 100 AS DOUBLE) AS lon2, CAST(s_nationkey * 3 - 40 AS DOUBLE) AS lat2 FROM supplier)""")
def haversine_distance(spark, sf_dir):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    return t(spark, sf_dir, "supplier").select("s_suppkey", F.round(S.haversine_km((k % 360 - 180).cast("double"), (k % 170 - 85).cast("double"), (n * 10 - 100).cast("double"), (n * 3 - 40).cast("double")), 4).alias("km"))


@query("""
WITH s AS (SELECT s_suppkey, s_nationkey, greatest(s_acctbal, 0) AS cap, CASE s_suppkey % 5 WHEN 1 THEN 'under_construction' WHEN 2 THEN 'permitted' WHEN 3 THEN 'retired' ELSE 'operational' END AS life,
                  CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 2020 + s_suppkey % 12 END AS start_year FROM supplier),
f AS (SELECT *, CASE WHEN life = 'retired' THEN 0.0 WHEN life = 'operational' THEN CASE WHEN start_year IS NULL OR start_year <= 2028 THEN 1.0 ELSE 0.0 END
                     WHEN start_year IS NULL OR start_year > 2028 THEN 0.0 WHEN life = 'under_construction' THEN 0.9 ELSE 0.75 END::DOUBLE AS factor FROM s)
SELECT s_nationkey, round(CAST(sum(CAST(cap * factor AS DECIMAL(28,6))) AS DOUBLE), 4) AS delivered_mw, count(*) FILTER (factor > 0) AS plants, round(100.0 * count(start_year) / count(*), 4) AS coverage,
       min(CASE WHEN start_year IS NULL THEN 55 ELSE 92 END) AS confidence FROM f GROUP BY 1""")
def supply_by_region(spark, sf_dir):
    """Delivered capacity in 2028 per country; coverage is known over all, confidence the least."""
    k = F.col("s_suppkey")
    life = F.when(k % 5 == 1, "under_construction").when(k % 5 == 2, "permitted").when(k % 5 == 3, "retired").otherwise("operational")
    d = t(spark, sf_dir, "supplier").select("s_nationkey", F.greatest(F.col("s_acctbal"), F.lit(0.0)).alias("cap"), life.alias("life"), F.when(k % 7 != 0, 2020 + k % 12).alias("start"))
    d = d.withColumn("factor", M.delivery_factor(F.col("life"), F.lit(2028), F.col("start"), F.lit(None).cast("long")))
    return d.groupBy("s_nationkey").agg(F.round(F.sum(R.money(F.col("cap") * F.col("factor"))).cast("double"), 4).alias("delivered_mw"), F.count_if(F.col("factor") > 0).alias("plants"), F.round(100.0 * F.count("start") / F.count("*"), 4).alias("coverage"), F.min(F.when(F.col("start").isNull(), 55).otherwise(92)).alias("confidence"))


@query("""
WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 101 END AS a, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 97 END AS b, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 89 END AS u, CASE WHEN c_custkey % 2 > 0 THEN c_custkey % 83 END AS g FROM customer),
w AS (SELECT *, CASE WHEN a IS NULL THEN 0 ELSE 35 END + CASE WHEN b IS NULL THEN 0 ELSE 30 END + CASE WHEN u IS NULL THEN 0 ELSE 15 END + CASE WHEN g IS NULL THEN 0 ELSE 10 END AS weight,
             coalesce(a * 35, 0) + coalesce(b * 30, 0) + coalesce(u * 15, 0) + coalesce(g * 10, 0) AS total FROM p)
SELECT c_custkey, CASE WHEN weight >= 60 THEN round(CAST(total AS DOUBLE) / weight, 9) END AS score,
       CASE WHEN a IS NOT NULL AND b IS NOT NULL AND u IS NOT NULL THEN round_even(round_even(a * 60.0::DOUBLE / 100, 1) + round_even(b * 15.0::DOUBLE / 100, 1) + round_even(u * 25.0::DOUBLE / 100, 1), 0) END AS demand_score FROM w""")
def balance_and_demand_scores(spark, sf_dir):
    """Null-aware scores: the balance index needs 60 of 100 weights, the demand score all parts."""
    k = F.col("c_custkey")
    part = lambda m, n: F.when(k % m > 0, k % n).cast("double")
    a, b, u, g = part(3, 101), part(4, 97), part(5, 89), part(2, 83)
    return t(spark, sf_dir, "customer").select("c_custkey", F.round(M.balance_score({"capacity": a, "local": b, "unmet": u, "growth": g}), 9).alias("score"), M.demand_score(a, b, u).alias("demand_score"))


@query("""
WITH f AS (SELECT l_suppkey, CASE WHEN l_linenumber % 3 = 0 THEN 'ALL' WHEN l_linenumber % 3 = 1 THEN 'FOS' ELSE 'COL' END AS fuel FROM lineitem WHERE l_suppkey % 2 = 0 UNION ALL
           SELECT l_suppkey, 'ALL' FROM lineitem WHERE l_suppkey % 2 = 1),
d AS (SELECT DISTINCT l_suppkey, fuel FROM f), c AS (SELECT * FROM (VALUES ('ALL', 'FOS'), ('ALL', 'COL'), ('FOS', 'COL')) v(ancestor, descendant))
SELECT l_suppkey, fuel FROM d WHERE NOT EXISTS (SELECT 1 FROM d x JOIN c ON x.fuel = c.descendant WHERE x.l_suppkey = d.l_suppkey AND c.ancestor = d.fuel)""")
def hierarchy_de_overlap(spark, sf_dir):
    """Fuel aggregates go where their group reports a descendant."""
    n, s = F.col("l_linenumber"), F.col("l_suppkey")
    fuel = F.when((s % 2 == 1) | (n % 3 == 0), "ALL").when(n % 3 == 1, "FOS").otherwise("COL")
    facts = t(spark, sf_dir, "lineitem").select("l_suppkey", fuel.alias("fuel")).distinct()
    closure = spark.createDataFrame([("ALL", "FOS"), ("ALL", "COL"), ("FOS", "COL")], "ancestor string, descendant string")
    return R.de_overlap(facts, closure, ["l_suppkey"], "fuel")


@query("""
SELECT coalesce(b.k, o.k) AS k, coalesce(o.v, b.v) AS v, CASE WHEN o.k IS NULL THEN 'modelled' ELSE 'official' END AS origin
FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 <> 1 THEN c_acctbal END AS v FROM customer) b FULL OUTER JOIN (SELECT c_custkey + 7 AS k, CASE WHEN c_custkey % 4 > 0 THEN c_acctbal * 2 END AS v FROM customer) o ON b.k = o.k""")
def official_override(spark, sf_dir):
    """Official values over modelled ones, rows of either side kept."""
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    base, better = c.withColumn("v", F.when(F.col("k") % 3 != 1, F.col("v"))), c.select((F.col("k") + 7).alias("k"), F.when(F.col("k") % 4 > 0, F.col("v") * 2).alias("v"))
    return R.override_join(base, better, ["k"], ["v"])


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS pri, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS rank FROM orders)
SELECT o_custkey, min_by(price, (rank, o_orderkey)) FILTER (price IS NOT NULL) AS price, min_by(pri, (rank, o_orderkey)) FILTER (pri IS NOT NULL) AS pri FROM r GROUP BY 1""")
def best_field_merge(spark, sf_dir):
    """Field by field, the value of the best source that has one."""
    k = F.col("o_orderkey")
    d = t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(k % 3 != 0, F.col("o_totalprice")).alias("price"), F.when(k % 4 != 0, F.col("o_orderpriority")).alias("pri"), F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("rank"))
    return R.best_fields(d, ["o_custkey"], ["price", "pri"], [F.col("rank"), F.col("o_orderkey")])


@query("""
SELECT c_mktsegment || '-' || c_nationkey AS base, c_custkey, CASE WHEN row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) = 1 THEN c_mktsegment || '-' || c_nationkey
       ELSE c_mktsegment || '-' || c_nationkey || '-' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 10) END AS name FROM customer""")
def collision_names(spark, sf_dir):
    d = t(spark, sf_dir, "customer").select(F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("base"), "c_custkey")
    return R.collision_names(d, "base", "c_custkey")


@query("""
SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest_order, max(o_orderdate)::DATE AS latest FROM orders GROUP BY 1""")
def latest_control(spark, sf_dir):
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest_order"), F.max("o_orderdate").cast("date").alias("latest"))


@query("""
SELECT year(o_orderdate)::INTEGER AS y, c_nationkey, round(CAST(sum(CAST(o_totalprice AS DECIMAL(28,6))) FILTER (o_orderstatus = 'F') AS DOUBLE), 2) AS f, round(CAST(sum(CAST(o_totalprice AS DECIMAL(28,6))) FILTER (o_orderstatus = 'O') AS DOUBLE), 2) AS o,
       round(CAST(sum(CAST(o_totalprice AS DECIMAL(28,6))) FILTER (o_orderstatus = 'P') AS DOUBLE), 2) AS p FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def country_year_pivot(spark, sf_dir):
    d = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    p = d.groupBy(F.year("o_orderdate").alias("y"), "c_nationkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.sum(R.money(F.col("o_totalprice"))))
    return p.select("y", "c_nationkey", *[F.round(F.col(k).cast("double"), 2).alias(k.lower()) for k in "FOP"])


@query("""
SELECT l_orderkey * 10 + l_linenumber AS id, rule FROM lineitem, (VALUES ('positive_quantity'), ('discount_range'), ('has_part')) v(rule)
WHERE (rule = 'positive_quantity' AND NOT coalesce(l_quantity > 2, false)) OR (rule = 'discount_range' AND NOT coalesce(l_discount BETWEEN 0 AND 0.09, false)) OR (rule = 'has_part' AND NOT coalesce(l_partkey > 20, false))""")
def contract_violations(spark, sf_dir):
    """One row per broken rule."""
    d = t(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return R.violations(d, "id", {"positive_quantity": F.col("l_quantity") > 2, "discount_range": F.col("l_discount").between(0, 0.09), "has_part": F.col("l_partkey") > 20})


@query("""
SELECT k, side FROM (SELECT DISTINCT c_custkey AS k, 'left' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'right' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))""")
def id_set_difference(spark, sf_dir):
    return R.difference_both_ways(t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("""
SELECT c_nationkey, y::INTEGER AS y FROM (SELECT DISTINCT c_nationkey FROM customer), range(2026, 2032) r(y)""")
def forecast_years(spark, sf_dir):
    """Country-level rows carried to each forecast year."""
    return t(spark, sf_dir, "customer").select("c_nationkey").distinct().select("c_nationkey", F.explode(F.sequence(F.lit(2026), F.lit(2031))).alias("y"))


@query("""
SELECT c_custkey FROM (SELECT c_custkey, list_sort(list(y)) AS ys FROM (SELECT DISTINCT o_custkey AS c_custkey, year(o_orderdate)::INTEGER AS y FROM orders) GROUP BY 1) WHERE ys <> [1995, 1996, 1997, 1998]""")
def incomplete_years(spark, sf_dir):
    d = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("y")).distinct()
    return R.year_gaps(d, ["c_custkey"], "y", 1995, 1998)


@query("""
SELECT n_nationkey, sum(CAST(v AS DECIMAL(28,6)))::DOUBLE AS zone_sum, count(*) AS cells FROM (SELECT CAST(p_partkey % 180 AS DOUBLE) + 0.5 AS lon, CAST(p_partkey * 3 % 25 AS DOUBLE) + 0.5 AS lat, p_retailprice AS v FROM part) c
JOIN (SELECT n_nationkey, CAST(n_nationkey * 7 AS DOUBLE) AS x, CAST(n_nationkey % 5 * 5 AS DOUBLE) AS y FROM nation) q ON lon BETWEEN x AND x + 6.5 AND lat BETWEEN y AND y + 4.5 GROUP BY 1""")
def zonal_sum(spark, sf_dir):
    """Raster cells whose centre lies in a polygon, summed per polygon."""
    k = F.col("p_partkey")
    cells = t(spark, sf_dir, "part").select("p_partkey", ((k % 180).cast("double") + 0.5).alias("lon"), ((k * 3 % 25).cast("double") + 0.5).alias("lat"), "p_retailprice")
    found = Z.zonal_totals(cells.withColumn("ok", F.lit(True)), _boxes(spark, sf_dir), "n_nationkey", Z.Grid(0.5, 0.5), "p_retailprice", "ok")
    return found.select("n_nationkey", F.col("total").alias("zone_sum"), F.col("selected").alias("cells"))


@query("""
SELECT c_custkey, least(0.5, 0.05 + age * 0.02)::DOUBLE AS fraction, greatest(0, 95 - age * 4)::INTEGER AS confidence FROM (SELECT c_custkey, c_custkey % 30 AS age FROM customer)""")
def control_uncertainty(spark, sf_dir):
    age = F.col("c_custkey") % 30
    return t(spark, sf_dir, "customer").select("c_custkey", M.uncertainty(age, F.lit(0.05), F.lit(0.02), F.lit(0.5)).alias("fraction"), F.greatest(F.lit(0), 95 - age * 4).cast("int").alias("confidence"))


@query("""
SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, sum(CAST(value AS DECIMAL(28,6)))::DOUBLE AS total FROM events GROUP BY 1, 2""")
def event_windows(spark, sf_dir):
    """Hourly windows of events, as the stream computes them."""
    from wattlake.streaming.windows import windowed

    return windowed(t(spark, sf_dir, "events"))
