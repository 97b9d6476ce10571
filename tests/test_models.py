"""Worked values of the regional model, its rules, and clustering against its ceilings."""

import collections
import math
import random

import pytest
from pyspark.errors import PySparkException
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

RANGE = "struct<low:double,central:double,high:double>"


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def d(x):
    return F.lit(x).cast("double")


def test_scores(spark):
    parts = lambda a, b, u, g, s: {"capacity": d(a), "local": d(b), "unmet": d(u), "growth": d(g), "delivery": d(s)}
    r = one(spark, M.demand_score(d(80), d(60), d(40)), M.balance_score(parts(80, 60, None, 70, 50)), M.balance_coverage(parts(80, 60, None, 70, 50)), M.balance_score(parts(90, None, None, 70, 50)), M.balance_coverage(parts(90, None, None, 70, 50)), M.demand_score(d(80), d(None), d(40)))
    assert r[0] == 67 and r[1] == pytest.approx((2800 + 1800 + 700 + 500) / 85) and r[2] == 85 and r[3] is None and r[4] == 55 and r[5] is None
    r = one(spark, M.balance_score(parts(80, 60, 50, 70, 50), unmet_kind=F.lit("estimated")), M.balance_score(parts(80, 60, 50, 70, 50), unmet_kind=F.lit("reported")))
    assert r[0] == pytest.approx(5800 / 85) and r[1] == pytest.approx(65.5)
    with pytest.raises(PySparkException, match="0 to 100"):
        one(spark, M.balance_score(parts(150, 60, None, 70, 50)))


def test_allocation_by_score_and_official_rows(spark):
    control = lambda v: spark.createDataFrame([("X", v)], "country string, control double")
    rows = lambda *r: spark.createDataFrame([("X", *x) for x in r], "country string, region string, score double, official double")
    got = lambda r, v=1000.0, places=2: {x["region"]: x["demand"] for x in M.allocate(r, control(v), "country", "region", "score", "official", "control", places).collect()}
    assert got(rows(("A", 0.5, 700.0), ("B", 0.5, None))) == {"A": 700.0, "B": 300.0}
    assert got(rows(("A", 6e-7, None), ("B", 7e-7, None), ("C", 1.4e-6, None)), 100.0) == {"A": 22.22, "B": 25.93, "C": 51.85}
    assert got(rows(("A", 4e-7, None), ("B", 2e-7, None)), 1.0) == {"A": 0.67, "B": 0.33}
    # A rest that no region can take is an error, not a gap; without a rest zeros stand.
    for bare in ((("A", 0.0, None), ("B", None, None)), (("A", 0.5, 400.0),), (("A", 0.5, 400.0), ("B", 0.0, None))):
        with pytest.raises(PySparkException, match="no region can take the rest of its control: X"):
            got(rows(*bare))
    assert got(rows(("A", 0.5, 1000.0), ("B", 0.0, None), ("C", None, None))) == {"A": 1000.0, "B": 0.0, "C": None}
    # Full precision: the control is kept to the last place.
    assert got(rows(("A", 1.0, None)), 10.005, None) == {"A": 10.005}
    thirds = got(rows(("A", 1.0, None), ("B", 1.0, None), ("C", 1.0, None)), 10.005, None)
    assert sum(thirds.values()) == pytest.approx(10.005, abs=1e-12) and thirds["B"] == pytest.approx(3.335, abs=1e-12)
    with pytest.raises(PySparkException, match="exceeds"):
        got(rows(("A", 0.5, 1700.0), ("B", 0.5, None)))
    r = one(spark, M.allocation_score(d(0.4), d(0.2), d(None)), M.allocation_score(d(None), d(0.2), d(0.1)), M.allocation_score(d(0.4), d(0.2), d(0.6)))
    assert r[0] == pytest.approx((0.3 * 0.4 + 0.55 * 0.2) / 0.85) and r[1] is None and r[2] == pytest.approx(0.3 * 0.4 + 0.55 * 0.2 + 0.15 * 0.6)


def test_delivery_keeps_the_year_of_retirement(spark):
    f = lambda life, year, com=None, ret=None, tgt=None, raw=None: M.delivery_factor(F.lit(life), F.lit(year), F.lit(com).cast("int"), F.lit(ret).cast("int"), F.lit(tgt).cast("int"), F.lit(raw).cast("string"))
    r = one(spark, f("operational", 2028, ret=2028), f("operational", 2029, ret=2028), f("operational", 2028, com=2029), f("announced", 2030, tgt=2029), f("announced", 2028, tgt=2029), f("permitted", 2030), f("under_construction", 2030, com=2030), f("paused", 2030), f("operational", 2030, raw="Retired"))
    assert list(r) == [1.0, 0.0, 0.0, 0.35, 0.0, 0.0, 0.9, 0.0, 0.0]
    with pytest.raises(PySparkException, match="unsupported lifecycle"):
        one(spark, f("operating", 2030))


def test_capacity_factor_and_supply(spark):
    rows = spark.createDataFrame([("X", 2020, 175.2, 100.0), ("X", 2021, 219.0, 100.0), ("Y", 2020, 175.2, 100.0), ("Z", 2020, 900.0, 100.0), ("Z", 2021, 100.0, 100.0)], "k string, y int, g double, c double")
    r = R.observed_factor(rows, ["k"], "y", "g", "c").collect()
    assert [(x["k"], round(x["low"], 9), round(x["central"], 9), round(x["high"], 9), x["years"], x["mean_capacity"]) for x in r] == [("X", 0.2, 0.225, 0.25, 2, pytest.approx(100.0))]
    plant = spark.createDataFrame([("p", "g", "X", "solar", "operational", None, (100.0, 100.0, 100.0), "reported", None, None, None, None, None)], f"plant_id string, geography_id string, country string, technology string, lifecycle string, raw_status string, capacity {RANGE}, capacity_kind string, reported_gwh {RANGE}, reported_dependable {RANGE}, commissioning_year int, retirement_year int, target_year int")
    assumed = spark.createDataFrame([("solar", (0.12, 0.2, 0.3), (0.05, 0.18, 0.35))], f"technology string, capacity_factor {RANGE}, capacity_credit {RANGE}")
    none = spark.createDataFrame([], "country string, technology string, low double, central double, high double")
    s = E.plant_supply(plant, none, assumed, (2026,)).first()
    assert [round(x, 6) for x in s["generation"]] == [round(876 * f, 6) for f in (0.12, 0.2, 0.3)] and [round(x, 6) for x in s["dependable"]] == [5, 18, 35] and (s["generation_confidence"], s["installed_confidence"]) == (55, 90)
    seen = E.plant_supply(plant, spark.createDataFrame([("X", "solar", 0.1, 0.2, 0.25)], none.schema), assumed, (2026,)).first()
    assert seen["generation_confidence"] == 82 and round(seen["generation"]["high"], 6) == 219.0


def test_circular_bounds_and_centre(spark):
    rows = spark.createDataFrame([("a", -180.0), ("b", 170.0), ("b", -170.0), ("b", 175.0), ("c", 10.0), ("c", 20.0)], "k string, lon double")
    assert {r["k"]: (r["west"], r["east"]) for r in R.circular_bounds(rows, "k", "lon").collect()} == {"a": (-180.0, -180.0), "b": (170.0, -170.0), "c": (10.0, 20.0)}
    assert {r["k"]: round(r["centre"], 6) for r in R.circular_centre(rows, "k", "lon").collect()} == {"a": -180.0, "b": 178.333333, "c": 15.0}


def test_ranges_units_and_numbers_that_raise(spark):
    r = one(spark, S.range_gap(S.value_range(d(90), d(100), d(120)), S.value_range(d(10), d(20), d(30))), V.metric(F.lit(" 1,500 "), F.lit("MWh"), "energy"), V.metric(F.lit(""), F.lit(""), "energy"), V.metric(F.lit("-3"), F.lit("Terawatt hours"), "energy"), S.parse_number(F.lit("not found")))
    assert tuple(r[0]) == (60.0, 80.0, 110.0) and list(r[1:]) == [1.5, None, -3000.0, None]
    for bad in (V.metric(F.lit("1"), F.lit("MW"), "energy"), V.metric(F.lit("1"), F.lit("barrels"), "energy"), V.metric(F.lit("x"), F.lit("GWh"), "energy"), S.parse_number(F.lit("Infinity")), S.strict_range(d(3), d(2), d(4)), S.divide(d(1), d(0)), S.coordinates(d(1), d(None)), V.require_open_licence(F.lit("secret"), "x"), V.lifecycle(F.lit("strange"), unknown="raise"), S.freshness_days(F.lit("2020-01-01"), F.lit("2020-02-01"))):
        with pytest.raises(PySparkException):
            one(spark, bad)


def test_shares_and_remainders_of_zero(spark):
    rows = spark.createDataFrame([("a", "x", 0.0), ("a", "y", 0.0), ("b", "x", 1.0), ("b", "y", 2.0)], "g string, i string, w double").withColumn("t", F.lit(10).cast("long"))
    assert {(r["g"], r["i"]): r["units"] for r in R.largest_remainder(rows, ["g"], "i", "w", "t").collect()} == {("a", "x"): None, ("a", "y"): None, ("b", "x"): 3, ("b", "y"): 7}
    with pytest.raises(PySparkException, match="zero total"):
        R.with_shares(rows, ["g"], "w", "s").collect()
    p = spark.createDataFrame([("A", "X", 2026, 5, "reported"), ("B", "X", 2026, 5, "reported")], "geography_id string, country string, year int, population long, value_kind string")
    for v in (3, 100):
        with pytest.raises(PySparkException):
            N.reconcile(p, spark.createDataFrame([("X", 2026, v)], "country string, year int, population long")).collect()
    close = N.reconcile(p, spark.createDataFrame([("X", 2026, 10)], "country string, year int, population long")).collect()
    assert sorted(r["population"] for r in close) == [5, 5]


def test_release_metadata_and_raster_years(spark):
    r = spark.createDataFrame([(2026, "a"), (2027, "b")], "year int, sha256 string")
    assert len(N.release_metadata(r).first()["fingerprint"]) == 64
    with pytest.raises(PySparkException):
        N.release_metadata(r.withColumn("sha256", F.lit("a"))).collect()
    got = one(spark, N.raster_year(F.lit("/x2020/pop_2026.tif")), N.raster_year(F.lit("/x/pop.tif")), N.raster_year(F.lit("/x/pop.tif"), F.lit(2031)))
    assert list(got) == [2026, None, 2031]
    with pytest.raises(PySparkException):
        one(spark, N.raster_year(F.lit("pop_2026_2027.tif")))


def test_polygon_across_the_dateline_and_overlapping_parts(spark):
    ring = lambda x, y, w, h: [[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]
    shapes = spark.createDataFrame([("date", [[ring(178.0, 0.0, 2.0, 2.0)], [ring(-180.0, 0.0, 2.0, 2.0)]]), ("twice", [[ring(0.0, 0.0, 4.0, 4.0)], [ring(1.0, 1.0, 4.0, 4.0)]]), ("hole", [[ring(10.0, 0.0, 6.0, 6.0), ring(12.0, 2.0, 2.0, 2.0)]])], "geo string, polygons array<array<array<array<double>>>>")
    pts = spark.createDataFrame([(1, 179.0, 1.0), (2, -179.5, 1.0), (3, 2.0, 2.0), (4, 13.0, 3.0), (5, 11.0, 3.0), (6, 12.0, 3.0), (7, None, 1.0), (8, 10.0, 0.0)], "id int, lon double, lat double")
    got = {(r["id"], r["geo"]) for r in C.contains(pts, "id", shapes, "geo").collect()}
    assert got == {(1, "date"), (2, "date"), (3, "twice"), (5, "hole"), (6, "hole"), (8, "hole")}
    assert C.contains(pts, "id", shapes.limit(0), "geo").collect() == [] and C.contains(pts.limit(0), "id", shapes, "geo").collect() == []


def row(i, **k):
    base = {"id": i, "entity": "plant", "country": "X", "name": "North Power Plant", "plant_name": None, "operator": "Op", "lon": 1.0, "lat": 1.0, "capacity": (100.0, 100.0, 100.0), "capacity_kind": "reported", "technology": "solar", "lifecycle": "operational", "commissioning_year": None, "external_ids": {}, "plant_id": None, "unit_id": None, "source_type": "community_mapped", "source_ids": ["s"], "location_precision": "exact", "evidence": ["s"]}
    return {**base, **k}


SCHEMA = f"id string, entity string, country string, name string, plant_name string, operator string, lon double, lat double, capacity {RANGE}, capacity_kind string, technology string, lifecycle string, commissioning_year int, external_ids map<string,string>, plant_id string, unit_id string, source_type string, source_ids array<string>, location_precision string, evidence array<string>"


def clusters(spark, rows, plant_group=False):
    return {r["id"]: r["cluster"] for r in P.constrained_clusters(spark.createDataFrame(rows, SCHEMA), plant_group).collect()}


def test_constrained_clusters(spark):
    near = [row("a"), row("b", lat=1.01, capacity=(105.0, 105.0, 105.0)), row("c", capacity=(150.0, 150.0, 150.0)), row("d", lat=2.5), row("e", operator=None), row("f", entity="unit", unit_id="u")]
    assert clusters(spark, near) == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e", "f": "f"}
    # One namespace with two ids keeps rows apart, even through a third row that fits both.
    ids = [row("a", external_ids={"wikidata": "Q1"}, name="A"), row("b", external_ids={"wikidata": "Q1", "osm": "1"}, name="B"), row("c", external_ids={"wikidata": "Q2", "osm": "1"}, name="C"), row("d", external_ids={"wikidata": "Q2"}, country="Y", name="D")]
    assert clusters(spark, ids) == {"a": "a", "b": "a", "c": "c", "d": "d"}
    units = [row("u1", entity="unit", unit_id="1", external_ids={"gemunit": "1", "wikidata": "Q"}, plant_id="gem-9", name="Unit 1"), row("u2", entity="unit", unit_id="2", external_ids={"gemunit": "2", "wikidata": "Q"}, plant_id="gem-9", name="Unit 2"), row("u3", entity="unit", unit_id="x", plant_id="gem-9", name="Unit 1")]
    assert clusters(spark, units) == {"u1": "u1", "u2": "u2", "u3": "u1"}
    assert len(set(clusters(spark, [{**u, "external_ids": {}} for u in units], plant_group=True).values())) == 1


def test_merge_capacity_and_ids(spark):
    rows = spark.createDataFrame([row("a", source_type="official_verified", capacity=None, capacity_kind="unavailable", external_ids={"wikidata": "Q1"}, lon=None, lat=None), row("b", external_ids={"wikidata": "Q1", "osm": "way/1"}, capacity_kind="estimated"), row("c", external_ids={"wikidata": "Q1"}, capacity=(90.0, 95.0, 99.0), capacity_kind="reported", location_precision="city_centroid", name="Other")], SCHEMA)
    records, plants = P.canonicalize(rows)
    r = records.collect()
    assert len(r) == 1 and r[0]["capacity"]["central"] == 95.0 and r[0]["capacity_kind"] == "reported" and r[0]["location_precision"] == "exact" and r[0]["name"] == "North Power Plant" and r[0]["external_ids"] == {"wikidata": "Q1", "osm": "way/1"} and r[0]["source_record_ids"] == ["a", "b", "c"]
    p = plants.collect()
    assert len(p) == 1 and p[0]["plant_id"] == "plant-wikidata-q1" and p[0]["aliases"] == ["plant-osm-way-1"] and p[0]["operating"]["central"] == 95.0 and p[0]["operating_method"] == "plant_aggregate" and p[0]["lifecycle_counts"] == {"operational": 1}


def test_names_that_collide_and_long_anchors(spark):
    named = spark.createDataFrame([("n", "x"), ("n", "y"), ("m", "z")], "name string, print string")
    got = {r["print"]: (r["unique_id"], r["alias"]) for r in P.unique_names(named, "name", F.col("print")).collect()}
    assert got["z"] == ("m", None) and len({got["x"][0], got["y"][0]}) == 2 and [got["x"][1], got["y"][1]].count("n") == 1 and all(len(got[k][0]) == 12 for k in "xy")
    slug = one(spark, P.anchor_slug(F.lit("osm"), F.lit("A" * 60 + "/1"), 48), P.anchor_slug(F.lit("osm"), F.lit("Way/1!"), 48))
    assert len(slug[0]) == 59 and slug[1] == "way-1"


def test_energy_model_from_controls_to_scores(spark):
    cols = lambda rows, schema: spark.createDataFrame(rows, schema)
    regions = cols([("A",), ("B",)], "geography_id string")
    controls = cols([("X", 2023, 900.0, 95.0, 100.0), ("X", 2024, 1000.0, 95.0, 100.0)], "country string, year int, control double, confidence double, coverage double")
    weights = cols([("A", "X", 0.75, "multi_covariate", 2024, 92.0), ("B", "X", 0.25, "population_only", 2024, 92.0)], "geography_id string, country string, score double, grade string, covariate_year int, coverage double")
    increments = cols([("i:2027", "B", 2027, (8.0, 10.0, 12.0)), ("i:2027", "B", 2027, (8.0, 10.0, 12.0))], f"increment_id string, geography_id string, target_year int, demand_gwh {RANGE}")
    plants = cols([("p", "A", "X", "solar", "operational", None, (100.0, 100.0, 100.0), "reported", None, None, None, None, None)], f"plant_id string, geography_id string, country string, technology string, lifecycle string, raw_status string, capacity {RANGE}, capacity_kind string, reported_gwh {RANGE}, reported_dependable {RANGE}, commissioning_year int, retirement_year int, target_year int")
    mixes = cols([("X", "A", 2020, {"solar": 175.2}), ("X", "A", 2021, {"solar": 219.0})], "country string, geography_id string, year int, mix map<string,double>")
    assumptions = cols([("solar", (0.12, 0.2, 0.3), (0.05, 0.18, 0.35))], f"technology string, capacity_factor {RANGE}, capacity_credit {RANGE}")
    official = cols([("A", 2026, (700.0, 700.0, 700.0), None, None, None, None, None, None)], f"geography_id string, year int, demand {RANGE}, generation {RANGE}, peak {RANGE}, dependable {RANGE}, interchange {RANGE}, unmet double, unmet_kind string")
    got = {(r["geography_id"], r["year"]): r for r in E.energy_model(regions, controls, weights, increments, plants, mixes, assumptions, official, 2026).collect()}
    assert len(got) == 12 and got["A", 2026]["demand"]["central"] == 700.0 and got["B", 2026]["demand"]["central"] == 300.0
    b27, a27 = got["B", 2027], got["A", 2027]
    assert a27["demand"]["central"] == 750.0 and b27["demand"]["central"] == 260.0 and got["B", 2028]["demand"]["central"] == 250.0
    assert a27["generation"]["central"] == pytest.approx(197.1) and a27["peak"]["central"] == pytest.approx(750 / 8.76) and a27["demand"]["high"] == pytest.approx(750 * 1.14)
    assert a27["gap"]["central"] == pytest.approx(750 - 197.1) and a27["balance_coverage"] == 75 and b27["balance_score"] is None and b27["balance_coverage"] == 10
    local, capacity, growth = 100 * (750 - 197.1) / 750, 100 - 100 * 18 / (750 / 8.76), 100 * 50 / 700
    assert a27["balance_score"] == pytest.approx((35 * capacity + 30 * local + 10 * growth) / 75) and b27["confidence"] == 0


def test_power_balance_needs_what_it_names(spark):
    rows = spark.createDataFrame([((9.0, 10.0, 12.0), (5.0, 6.0, 7.0), (1.0, 2.0, 3.0), 4.0, "reported"), ((9.0, 10.0, 12.0), (5.0, 6.0, 7.0), None, 4.0, "estimated"), ((9.0, 10.0, 12.0), None, (1.0, 2.0, 3.0), None, None)], f"demand {RANGE}, generation {RANGE}, interchange {RANGE}, unmet double, unmet_kind string")
    a, b, c = E.power_balance(rows).collect()
    assert tuple(a["gap"]) == (2.0, 4.0, 7.0) and tuple(a["net_balance"]) == (-6.0, -2.0, 1.0) and a["unmet"] == 4.0
    assert b["net_balance"] is None and b["unmet"] is None and tuple(b["gap"]) == (2.0, 4.0, 7.0) and c["gap"] is None and c["net_balance"] is None


def test_small_scalars(spark):
    r = one(spark, S.canonical_identifier(F.lit(True), "boolean"), S.short_number(d(1234567)), S.short_number(d(None)), S.timing_index(F.lit("permitted"), F.lit(2027)), S.log_index(d(5000)), S.finite(d(math.nan)), V.public_source_rank(F.array(F.lit("x"), F.lit("wri_power"))), W.score_colour(d(None), "systemRisk"), S.fingerprint_of(F.lit("x")) if hasattr(S, "fingerprint_of") else F.lit(0))
    assert list(r[:8]) == [None, "1.2M", "unavailable", round(0.65 * 78 + 0.35 * 92), 100.0, False, 2, "#142321"]
    rows = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "id int, v string, n int")
    prints = rows.select(S.fingerprint("v", "n", "id").alias("p")).collect()
    assert prints[0]["p"] != prints[1]["p"] and rows.select(S.fingerprint("id", "n", "v").alias("p")).collect() == prints
    top = R.residual_to_top(spark.createDataFrame([("g", "a", 1.0, 3, 10), ("g", "b", 2.0, 3, 10)], "g string, i string, s double, v int, t int").withColumn("v", F.col("v").cast("decimal(18,2)")).withColumn("t", F.col("t").cast("decimal(18,2)")), ["g"], "i", "s", "v", "t")
    assert {r["i"]: float(r["v"]) for r in top.collect()} == {"a": 3.0, "b": 7.0}
    v, c = M.estimate(d(None), d(0.225), d(0.2), d(100))
    assert tuple(one(spark, v, c)) == (pytest.approx(197.1), 82)


def test_pairs_of_small_blocks_are_not_expanded(spark):
    """Two rows of a block meet though each has more neighbour keys than an array holds; large blocks meet by their neighbour keys."""
    d = spark.createDataFrame([("a", 1, 5, 0), ("a", 2, 4_000_000_000, 0), ("a", 3, 3_000_000_000, 1), ("b", 4, 5, 0), (None, 5, 5, 0), (None, 6, 5, 0), ("c", 7, None, 0), ("c", 8, 5, 0)], "g string, id long, x long, y long")
    pairs = lambda d, block, far: {tuple(r) for r in R.blocked_pairs(d, "id", block, far, F.lit(True)).select(F.col("a.id"), F.col("b.id")).collect()}
    assert pairs(d, ["g"], {"x": 2_000_000_000, "y": 1}) == {(2, 3)}
    rng = random.Random(3)
    rows = [(g, i * 10 + k, rng.randrange(6), rng.randrange(6)) for k, (g, n) in enumerate((("many", 60), ("nine", 9), ("ten", 10), ("two", 2), ("one", 1))) for i in range(n)]
    want = {(p[1], q[1]) for p in rows for q in rows if p[0] == q[0] and p[1] < q[1] and abs(p[2] - q[2]) <= 1 and abs(p[3] - q[3]) <= 1}
    assert pairs(spark.createDataFrame(rows, "g string, id long, x long, y long"), ["g"], {"x": 1, "y": 1}) == want


def test_forecast_joins_are_dealt_by_rows(spark, monkeypatch):
    """Constants compress to few bytes; a task takes so many rows all the same."""
    monkeypatch.setattr(E, "TASK_ROWS", 50)
    k, one = F.col("id"), F.struct(*[F.lit(1.0).alias(p) for p in ("low", "central", "high")])
    none = F.lit(None).cast(E.RANGE)
    base = spark.range(200).select(k.alias("geography_id"), F.explode(F.array(F.lit(2026), F.lit(2027))).alias("year"))
    demand = base.select("*", one.alias("demand"), none.alias("peak"), F.lit(80.0).alias("demand_confidence"), F.lit(100.0).alias("demand_coverage"))
    supply = base.select("*", one.alias("generation"), one.alias("dependable"), F.lit(1.0).alias("installed"), F.lit(55).alias("confidence"), F.lit(50.0).alias("coverage"))
    official = base.limit(0).select("*", *[none.alias(c) for c in ("demand", "generation", "peak", "dependable", "interchange")], F.lit(1.0).alias("unmet"), F.lit("reported").alias("unmet_kind"))
    rows = E.forecast(demand, supply, official).select("geography_id", F.spark_partition_id().alias("task")).collect()
    held = collections.Counter(r["task"] for r in rows)
    assert len(rows) == 400 and len(held) == 8 and max(held.values()) <= 150
