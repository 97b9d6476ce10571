"""Registered queries of clustering across cells, ranks, allocation, lineage, rebuilds, sketches, covers and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wattlake.operators import coverage as K
from wattlake.operators import cover as C
from wattlake.operators import incremental as I
from wattlake.operators import models as M
from wattlake.operators import plants as P
from wattlake.operators import relational as R
from wattlake.operators import zonal as Z
from wattlake.operators.graph import shared_root
from wattlake.plans.queries import query, t
from wattlake.plans.regional import _plants
from wattlake.streaming import state as T


@query("""
SELECT p || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS id, CASE WHEN p = 'd' THEN 'd' ELSE 'a' END || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS cluster
FROM supplier, (VALUES ('a'), ('b'), ('c'), ('d')) v(p) WHERE p <> 'd' OR s_suppkey % 2 = 0""")
def clusters_across_cells(spark, sf_dir):
    """Records of which two share an id half a degree apart, a third stands beside the second, and a fourth there has another id."""
    base = _plants(spark, sf_dir).where(F.col("id").startswith("a")).withColumn("k", F.substring("id", 2, 9).cast("long"))
    none = F.create_map().cast("map<string,string>")
    same, other = F.col("external_ids"), F.create_map(F.lit("wikidata"), F.concat(F.lit("Z"), F.col("k").cast("string")))
    mw = F.struct(*[(F.col("k") + 1).cast("double").alias(p) for p in ("low", "central", "high")])
    row = lambda tag, east, ids: base.withColumns({"id": F.concat(F.lit(tag), F.lpad(F.col("k").cast("string"), 9, "0")), "lon": F.col("lon") + east, "external_ids": ids, "capacity": mw, "country": F.concat(F.lit("n"), F.col("k").cast("string"))})
    rows = row("a", 0.48, same).union(row("b", 1.0, same)).union(row("c", 1.01, none)).union(row("d", 1.01, other).where("k % 2 = 0"))
    return P.constrained_clusters(rows.drop("k"), False)


@query("""
SELECT 'a' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS id, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'a' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') END AS capacity_row, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'reported' END AS capacity_kind,
  'b' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS name_row, 'official_verified' AS name_source, 'b-source' AS name_ids, 'best_location_as_whole' AS location_method FROM supplier
UNION ALL SELECT 'c' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0'), NULL, NULL, 'c' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0'), 'research_verified', 'c-source', 'best_location_as_whole' FROM supplier WHERE s_suppkey % 15 = 0""")
def field_provenance(spark, sf_dir):
    """From which source row each field of a record is, and how it was chosen."""
    rows = _plants(spark, sf_dir)
    m = P.merge_records(rows, P.constrained_clusters(rows, False))
    told = lambda f, c: F.try_element_at("field_provenance", F.lit(f))[c]
    return m.select("id", told("capacity", "source_record_id").alias("capacity_row"), told("capacity", "value_kind").alias("capacity_kind"), told("name", "source_record_id").alias("name_row"), told("name", "source_type").alias("name_source"), F.array_join(told("name", "source_ids"), ",").alias("name_ids"), told("location", "method").alias("location_method"))


@query("""
WITH w AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN c_nationkey ELSE -1 END AS g, c_custkey, CAST(c_custkey % 97 + 1 AS DOUBLE) AS weight FROM customer),
e AS (SELECT *, round_even(123456::DOUBLE * weight / CAST(sum(CAST(weight AS DECIMAL(28,6))) OVER (PARTITION BY g) AS DOUBLE), 9) AS exact FROM w),
f AS (SELECT *, floor(exact) AS fl FROM e),
r AS (SELECT *, 123456 - sum(fl) OVER (PARTITION BY g) AS rest, row_number() OVER (PARTITION BY g ORDER BY round((exact - fl) * 1000000000) DESC, c_custkey) AS rn FROM f)
SELECT c_custkey, CAST(fl + CASE WHEN rn <= rest THEN 1 ELSE 0 END AS BIGINT) AS units FROM r""")
def remainders_of_a_large_group(spark, sf_dir):
    """Whole units by largest remainder where one group holds nine tenths of the rows and many remainders are equal."""
    k = F.col("c_custkey")
    d = t(spark, sf_dir, "customer").select(F.when(k % 10 == 0, F.col("c_nationkey")).otherwise(-1).alias("g"), k, (k % 97 + 1).cast("double").alias("weight"), F.lit(123_456).cast("long").alias("people"))
    return R.largest_remainder(d, ["g"], "c_custkey", "weight", "people").select("c_custkey", "units")


@query("""
WITH ctl AS (SELECT c_nationkey, CAST(sum(CAST(o_totalprice AS DECIMAL(28,6))) AS DOUBLE) / 7 AS control FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
r AS (SELECT c_nationkey, c_custkey, c_custkey % 7 AS score FROM customer),
s AS (SELECT r.*, control, sum(score) OVER (PARTITION BY c_nationkey) AS total FROM r JOIN ctl USING (c_nationkey))
SELECT c_custkey, round(control * score / total, 6) AS demand, count(*) OVER (PARTITION BY c_nationkey) AS regions FROM s""")
def allocation_in_full_precision(spark, sf_dir):
    """National demand to regions by score without rounding; regions of score zero get none."""
    c = t(spark, sf_dir, "customer")
    total = F.sum(R.money(F.col("o_totalprice"))).cast("double") / 7
    controls = t(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(total.alias("control"))
    regions = c.select("c_nationkey", "c_custkey", (F.col("c_custkey") % 7).cast("double").alias("score"), F.lit(None).cast("double").alias("official"))
    d = M.allocate(regions, controls, "c_nationkey", "c_custkey", "score", "official", "control")
    return d.join(d.groupBy("c_nationkey").agg(F.count("*").alias("regions")), "c_nationkey").select("c_custkey", F.round("demand", 6).alias("demand"), "regions")


@query("""
WITH o AS (SELECT o_custkey, year(o_orderdate) AS y, o_orderkey, o_totalprice FROM orders),
n AS (SELECT o_custkey, y, o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM o WHERE o_orderkey % 77 <> 0),
d AS (SELECT o_custkey, y FROM o JOIN n USING (o_custkey, y, o_orderkey) WHERE o.o_totalprice <> n.o_totalprice UNION SELECT o_custkey, y FROM o WHERE o_orderkey % 77 = 0)
SELECT CAST(o_custkey AS VARCHAR) AS region, y::INTEGER AS year, NOT EXISTS (SELECT 1 FROM n WHERE n.o_custkey = d.o_custkey AND n.y = d.y) AS gone FROM d""")
def changed_regions(spark, sf_dir):
    """Regions and years of which an input has changed since the last snapshot, by two trees of fingerprints."""
    o = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("geography_id"), F.year("o_orderdate").alias("year"), "o_orderkey", "o_totalprice")
    new = o.where("o_orderkey % 77 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 50 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("geography_id"), F.lit(None).cast("int").alias("year"), "c_acctbal")
    return I.changed(I.tree(I.leaves({"orders": new, "customers": c})), I.tree(I.leaves({"orders": o, "customers": c})))


@query("""
WITH o AS (SELECT o_custkey, year(o_orderdate) AS y, CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS p FROM orders WHERE o_orderkey % 77 <> 0)
SELECT o_custkey, y::INTEGER AS year, CAST(sum(CAST(p AS DECIMAL(28,6))) AS DOUBLE) AS total, count(*) AS n FROM o GROUP BY 1, 2""")
def rebuilt_totals(spark, sf_dir):
    """Yearly totals of regions, of which only those whose orders have changed are computed anew."""
    total = lambda d: d["orders"].groupBy("geography_id", "year").agg(F.sum(R.money(F.col("o_totalprice"))).cast("double").alias("total"), F.count("*").alias("n"))
    o = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("geography_id"), F.year("o_orderdate").alias("year"), "o_orderkey", "o_totalprice")
    new = o.where("o_orderkey % 77 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 50 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    moved = I.changed(I.tree(I.leaves({"orders": new})), I.tree(I.leaves({"orders": o})))
    return I.rebuild_changed(total({"orders": o}), moved, {"orders": new}, total).select(F.col("geography_id").alias("o_custkey"), "year", "total", "n")


@query("""
SELECT 'c_mktsegment' AS column, count(*) AS rows, count(c_mktsegment) AS filled, count(DISTINCT c_mktsegment) AS distinct FROM customer
UNION ALL SELECT 'city', count(*), count(CASE WHEN c_custkey % 3 > 0 THEN 1 END), count(DISTINCT CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 321 END) FROM customer""")
def united_coverage(spark, sf_dir):
    """Distinct values over all shards from what each shard keeps; exact here, as no shard has many."""
    k = F.col("c_custkey")
    c = t(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", F.when(k % 3 > 0, k % 321).alias("city"))
    return K.united(K.sketches(c, "c_nationkey", ["c_mktsegment", "city"])).drop("exact")


@query("""
WITH p AS (SELECT c_custkey, CAST(c_custkey * 7919 % 36000 AS DOUBLE) / 100 - 180 AS lon, CAST(c_custkey * 104729 % 16000 AS DOUBLE) / 100 - 80 AS lat FROM customer),
q AS (SELECT n_nationkey, n_nationkey * 13 - 159.997 AS x, n_nationkey % 7 * 20 - 60.0 AS y, 5.0 + n_nationkey % 4 * 2 AS r FROM nation)
SELECT c_custkey, n_nationkey FROM p JOIN q ON abs(lon - x) + abs(lat - y) <= r""")
def points_in_long_outlines(spark, sf_dir):
    """Points in diamonds of 1,200 edges each, by inner and boundary cells."""
    k, n = F.col("c_custkey"), F.col("n_nationkey")
    points = t(spark, sf_dir, "customer").select(k, ((k * 7919 % 36000).cast("double") / 100 - 180).alias("lon"), ((k * 104729 % 16000).cast("double") / 100 - 80).alias("lat"))
    x, y, r = n * 13 - F.lit(159.997), n % 7 * 20 - F.lit(60.0), F.lit(5.0) + n % 4 * 2
    turn = lambda i: (i % 1200) / 300.0
    tooth = lambda u: F.when(u < 1, u).when(u < 3, 2 - u).otherwise(u - 4)
    corner = lambda i: F.array(x + r * tooth(F.pmod(turn(i) + 1, F.lit(4.0))), y + r * tooth(turn(i)))
    ring = F.transform(F.sequence(F.lit(0), F.lit(1199)), corner)
    shapes = t(spark, sf_dir, "nation").select(n, F.array(F.array(ring)).alias("polygons"))
    return C.contains(points, "c_custkey", shapes, "n_nationkey")


@query("""
WITH c AS (SELECT p_partkey * 13 % 720 AS col, p_partkey * 7 % 360 AS r, CAST(p_retailprice AS DECIMAL(28,6)) AS v FROM part),
q AS (SELECT n_nationkey, n_nationkey * 13 - 160.0 AS x, n_nationkey % 7 * 20 - 60.0 AS y, 12.0 + n_nationkey % 4 * 9 AS r0 FROM nation)
SELECT n_nationkey, CAST(sum(v) AS DOUBLE) AS total, count(*) AS selected FROM c JOIN q ON abs(col * 0.5 - 179.75 - x) <= r0 AND abs(r * 0.5 - 89.75 - y) <= r0 / 2 GROUP BY 1""")
def scanline_sums(spark, sf_dir):
    """Raster cells of half a degree in wide boxes, most of them by the totals of whole tiles."""
    k, n = F.col("p_partkey"), F.col("n_nationkey")
    cells = t(spark, sf_dir, "part").select(((k * 13 % 720) * 0.5 - 179.75).alias("lon"), ((k * 7 % 360) * 0.5 - 89.75).alias("lat"), F.col("p_retailprice").alias("v"), F.lit(True).alias("ok"))
    x, y, r = n * 13 - F.lit(160.0), n % 7 * 20 - F.lit(60.0), F.lit(12.0) + n % 4 * 9
    ring = F.array(*[F.array(x + a * r, y + b * r / 2) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))])
    shapes = t(spark, sf_dir, "nation").select(n, F.array(F.array(ring)).alias("polygons"))
    return Z.zonal_totals(cells, shapes, "n_nationkey", Z.Grid(-179.75, -89.75, 0.5, 0.5), "v", "ok").drop("known")


@query("""
SELECT event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE) AS total FROM (SELECT DISTINCT event_id, event_type, value FROM events) GROUP BY 1""")
def events_counted_once(spark, sf_dir):
    """Totals of a stream of events, every one counted once, kept by key as batches come; read when the stream has caught up."""
    schema = t(spark, sf_dir, "events").schema
    root = f"{shared_root(spark)}/wattlake/{spark.sparkContext.applicationId}/events-{uuid.uuid4().hex}"
    # A stream reads folders or patterns: the table may be a single file.
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    told = T.once(events, ["event_id"]).select("event_type", F.lit(1).cast("long").alias("n"), F.col("value").cast("decimal(28,6)").alias("total"))
    kept = T.Upserts(spark, f"{root}/table", ["event_type"], T.added(n="long", total="decimal(28,6)"))
    told.writeStream.foreachBatch(kept).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return kept.table("event_type string, n long, total decimal(28,6)").select("event_type", "n", F.col("total").cast("double").alias("total"))
