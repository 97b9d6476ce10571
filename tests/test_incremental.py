"""Trees of fingerprints and rebuilt parts, sketches of shards, marker pyramids, lineage."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from wattlake.operators import coverage as K
from wattlake.operators import incremental as I
from wattlake.operators import markers as MK
from wattlake.operators import plants as P

ROWS = "geography_id string, year int, value double"


def test_a_tree_reads_its_inputs_once(spark, tmp_path):
    """Levels are read from what was written, not from the inputs, and fingerprints are those of trees kept before."""
    path = str(tmp_path / "rows")
    spark.createDataFrame([("a", 2026, 1.0), ("a", 2026, 2.0), ("b", None, 3.0)], ROWS).write.parquet(path)
    t = I.tree(I.leaves({"x": spark.read.parquet(path)}))
    assert t.inputFiles() and not [f for f in t.inputFiles() if path in f]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    digest = lambda texts: sha(":".join([str(len(texts)), *[str(sum(int(sha(x)[i : i + 12], 16) for x in texts)) for i in (0, 12, 24, 36)]]))
    leaf = digest(['{"geography_id":"a","value":1.0,"year":2026}', '{"geography_id":"a","value":2.0,"year":2026}'])
    got = {(r["level"], r["region"], r["year"]): r["fingerprint"] for r in t.collect()}
    assert got["leaf", "a", 2026] == leaf and got["year", "a", 2026] == digest([f"x\x1f{leaf}"])
    assert len(got) == 7 and got["region", "a", None] == digest([f"2026\x1f{got['year', 'a', 2026]}"])
    moved = spark.read.parquet(path).select(F.col("geography_id").alias("region"), "year").where("region = 'a'")
    total = lambda d: d["x"].groupBy("geography_id", "year").agg(F.sum("value").alias("total"))
    last = spark.createDataFrame([("a", 2026, 9.0), ("b", None, 9.0)], "geography_id string, year int, total double")
    again = I.rebuild_changed(last, moved, {"x": spark.createDataFrame([("a", 2026, 4.0)], ROWS)}, total)
    assert not [f for f in again.inputFiles() if path in f]
    assert {tuple(r) for r in again.collect()} == {("a", 2026, 4.0), ("b", None, 9.0)}


def test_only_changed_regions_are_computed_anew(spark):
    rng = random.Random(1)
    rows = [(f"r{i:03}", y, float(rng.randrange(100))) for i in range(60) for y in range(2026, 2030) for _ in range(3)]
    base = [(f"r{i:03}", None, float(i)) for i in range(60)]
    make = lambda r: spark.createDataFrame(r, ROWS)
    seen = []

    def compute(d):
        seen.append(d["demand"].select("geography_id", "year").distinct().count())
        return d["demand"].groupBy("geography_id", "year").agg(F.sum("value").alias("total"))

    old = {"demand": make(rows), "base": make(base)}
    last = compute(old)
    kept = I.tree(I.leaves(old))
    shuffled = rows[::-1]
    assert I.changed(I.tree(I.leaves({"demand": make(shuffled), "base": make(base)})), kept).collect() == []
    after = [r for r in shuffled if r[0] != "r007" or r[1] != 2027]  # one region's year goes
    after = [(g, y, v + 1) if (g, y) == ("r011", 2028) else (g, y, v) for g, y, v in after] + [("new", 2026, 5.0)]
    moved_base = [(g, y, v + (g == "r020")) for g, y, v in base]
    new = {"demand": make(after), "base": make(moved_base)}
    moved = I.changed(I.tree(I.leaves(new)), kept)
    assert {tuple(r) for r in moved.collect()} == {("r007", 2027, True), ("r011", 2028, False), ("new", 2026, False), ("r020", None, False)}
    seen.clear()
    got = I.rebuild_changed(last, moved, new, compute)
    assert seen == [2]  # of 241
    key = lambda d: sorted((r["geography_id"], r["year"], r["total"]) for r in d.collect())
    assert key(got) == key(compute(new))
    groups = spark.createDataFrame([(f"r{i:03}", "X" if i < 15 else f"g{i}") for i in range(60)], "region string, group string")
    spread = {tuple(r) for r in I.spread_to(groups, moved).collect()}
    assert {r for r, y in spread if y == 2028} == {f"r{i:03}" for i in range(15)} and ("new", 2026) in spread
    with pytest.raises(ValueError):
        I.leaves({})


def test_sketches_of_shards_unite(spark):
    rows = [(f"s{i % 7}", str(i), "x" if i % 2 else None) for i in range(20_000)] + [(None, "0", "y")]
    d = spark.createDataFrame(rows, "shard string, id string, kind string")
    kept = K.sketches(d, "shard", ["id", "kind"], exact=100)
    assert kept.count() == 16 and kept.where("column = 'id' and values is not null").count() == 1
    got = {r["column"]: r for r in K.united(kept).collect()}
    assert (got["kind"]["distinct"], got["kind"]["exact"], got["kind"]["rows"], got["kind"]["filled"]) == (2, True, 20_001, 10_001)
    assert not got["id"]["exact"] and abs(got["id"]["distinct"] - 20_000) < 20_000 * 0.05
    assert K.united(K.sketches(d, "shard", ["id"], exact=10_000)).first()["distinct"] == 20_000
    # A shard that is made anew replaces its old sketch; the gate sees what is lost.
    less = K.replaced(kept, K.sketches(d.where("shard = 's0' and id < '2'"), "shard", ["id", "kind"], exact=100))
    assert K.shrunk(K.united(less), K.united(kept), slack=0.01).select("column").collect()[0]["column"] == "id"
    assert K.shrunk(K.united(kept), K.united(kept)).collect() == []
    assert K.shrunk(K.united(kept.where("column = 'id'")), K.united(kept)).collect()[0]["reason"] == "is empty"


def greedy(points, zooms, radius_px):
    """Centres and counts by zoom, marker by marker."""
    def place(lon, lat):
        s = math.sin(math.radians(max(-MK.MOST_LAT, min(MK.MOST_LAT, lat))))
        return (lon + 180) / 360, 0.5 - math.log((1 + s) / (1 - s)) / (4 * math.pi)

    unit, cells = radius_px / (256 * 2 ** max(zooms)) / 2, {}
    for i, lon, lat in points:
        if lon is not None and lat is not None:
            x, y = place(lon, lat)
            cells.setdefault((math.floor(x / unit), math.floor(y / unit)), []).append((i, x, y))
    markers = {min(c)[0]: (*min(c)[1:], len(c)) for c in cells.values()}
    out, below = {}, None
    for zoom in sorted(zooms, reverse=True):
        r, centres, of = radius_px / (256 * 2**zoom), [], {}
        for i in sorted(markers, key=lambda i: (-markers[i][2], i)):
            x, y, _ = markers[i]
            of[i] = next((c for c in centres if (markers[c][0] - x) ** 2 + (markers[c][1] - y) ** 2 <= r * r), i)
            if of[i] == i:
                centres.append(i)
        if below is not None:
            out.update({(z, i): (n, of[i]) for (z, i), (n, _) in below.items()})
        markers = {c: (*markers[c][:2], sum(markers[i][2] for i in of if of[i] == c)) for c in centres}
        below = {(zoom, c): (markers[c][2], None) for c in centres}
    return out | below


def test_marker_pyramid_is_the_greedy_one(spark):
    rng = random.Random(3)
    towns = [(rng.uniform(-170, 170), rng.uniform(-80, 80)) for _ in range(12)]
    points = [(f"p{i:04}", *((a + rng.gauss(0, 1.5), b + rng.gauss(0, 1.5)) if i % 3 else (rng.uniform(-180, 180), rng.uniform(-89, 89)))) for i, (a, b) in ((i, rng.choice(towns)) for i in range(900))]
    points += [(f"q{i:04}", 10.0, 50.0) for i in range(500)] + [("none", None, 1.0)]
    got = MK.pyramid(spark.createDataFrame(points, "id string, lon double, lat double"), "id", range(2, 5))
    want = greedy(points, range(2, 5), 60.0)
    rows = {(r["zoom"], r["id"]): (r["n"], r["parent"]) for r in got.collect()}
    assert rows == want
    assert all(sum(n for (z, _), (n, _) in rows.items() if z == zoom) == 1400 for zoom in (2, 3, 4))
    assert MK.pyramid(spark.createDataFrame([], "id string, lon double, lat double"), "id", range(2, 4)).collect() == []


def test_provenance_and_aliases_of_records(spark):
    from test_models import SCHEMA, row

    rows = spark.createDataFrame([row("a", external_ids={"osm": "1", "wikidata": "Q1"}, capacity=(9.0, 9.0, 9.0), capacity_kind="reported", source_ids=["z", "y"]), row("b", source_type="official_verified", external_ids={"osm": "2"}, capacity=(8.0, 8.0, 8.0), capacity_kind="estimated", name="Told", lon=None, lat=None, operator=None)], SCHEMA)
    r = P.merge_records(rows, spark.createDataFrame([("a", "a"), ("b", "a")], "id string, cluster string")).first()
    told = r["field_provenance"]
    assert r["capacity"]["central"] == 9.0 and told["capacity"].asDict() == {"source_record_id": "a", "source_type": "community_mapped", "source_ids": ["y", "z"], "value_kind": "reported", "method": P.BY_METRIC}
    assert r["name"] == "Told" and told["name"]["source_record_id"] == "b" and told["operator"]["source_record_id"] == "a" and told["location"]["source_record_id"] == "a"
    assert "commissioning_year" not in told and r["external_ids"] == {"osm": "2", "wikidata": "Q1"} and r["id_aliases"] == {"osm": ["1", "2"]}
    account = P.capacity_account(P.merge_records(rows, spark.createDataFrame([("a", "a"), ("b", "b")], "id string, cluster string")).withColumn("plant", F.lit("p")), "plant", ("operational",)).first()
    assert [x.asDict() for x in account["lineage"]] == [{"value_kind": "reported", "source_type": "community_mapped", "source_ids": ["y", "z"]}]
