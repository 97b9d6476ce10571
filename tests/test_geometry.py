"""Covers and scanlines against ray casting of every point."""

import math
import random

import pytest

from wattlake.operators import cover as C
from wattlake.operators import zonal as Z

SHAPE = "geo string, polygons array<array<array<array<double>>>>"


def star(rng, x, y, radius, corners):
    """A ring around a point, in turns of angle, with corners near and far."""
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(corners))
    return [[x + (d := radius * rng.uniform(0.4, 1)) * math.cos(a), y + d * math.sin(a)] for a in turns]


def holds(parts, x, y):
    for rings in parts:
        odd = False
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
                if abs((x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)) < 1e-9 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                    return True
                odd ^= (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
        if odd:
            return True
    return False


@pytest.fixture(scope="module")
def shapes():
    rng = random.Random(3)
    box = lambda x, y, w, h: [[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]
    out = [(f"star{k}", [[star(rng, rng.uniform(-150, 150), rng.uniform(-70, 70), rng.uniform(1, 40), n)]]) for k, n in enumerate((3, 40, 1500, 3000))]
    out += [("holes", [[box(0.0, 0.0, 20.0, 16.0), box(4.0, 4.0, 4.0, 4.0), box(8.0, 8.0, 2.5, 1.0)], [box(4.0, 4.0, 1.0, 1.0)]])]
    out += [("twice", [[box(-10.0, -10.0, 6.0, 6.0)], [box(-8.0, -8.0, 6.0, 6.0)]])]
    out += [("notch", [[[[30.0, 0.0], [40.0, 0.0], [40.0, 10.0], [37.0, 10.0], [37.0, 5.0], [33.0, 5.0], [33.0, 10.0], [30.0, 10.0]]]])]
    return [*out, ("date", [[box(178.0, 0.0, 2.0, 2.0)], [box(-180.0, 0.0, 2.0, 2.0)]]), ("empty", []), ("line", [[[[1.0, 1.0], [2.0, 2.0]]]])]


def test_cover_holds_what_ray_casting_holds(spark, shapes):
    rng = random.Random(4)
    points = [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(1500)] + [(rng.uniform(-12, 42), rng.uniform(-12, 20)) for _ in range(1500)]
    points += [(x / 2, y / 2) for x in range(-24, 84) for y in range(-24, 36, 3)] + [tuple(p) for _, parts in shapes[:4] for p in parts[0][0][:50]]
    rows = [(i, x, y) for i, (x, y) in enumerate(points)] + [(-1, None, 1.0), (-2, float("nan"), 1.0)]
    at, polygons = spark.createDataFrame(rows, "id int, lon double, lat double"), spark.createDataFrame(shapes, SHAPE)
    want = {(i, g) for i, x, y in rows[:-2] for g, parts in shapes if g not in ("line",) and holds(parts, x, y)}
    got = C.contains(at, "id", polygons, "geo").collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == want
    coarse = C.contains(at, "id", polygons, "geo", most_edges=3, levels=2).collect()
    assert set(map(tuple, coarse)) == want
    assert set(map(tuple, C.contains(at, "id", polygons, "geo", boundary=False).collect())) <= want


def test_points_inside_meet_no_edge(spark):
    rng = random.Random(5)
    ring = [[20 + (d := 15 + rng.random()) * math.cos(k * math.pi / 1500), 10 + d * math.sin(k * math.pi / 1500)] for k in range(3000)]
    cells = C.cover(spark.createDataFrame([("c", [[ring]])], SHAPE), ["geo"])
    inner = cells.where("inner").count()
    assert 0 < inner < 1500 and cells.count() < 3000 and cells.agg({"level": "min"}).first()[0] < 3
    near = spark.createDataFrame([(i, 20 + rng.uniform(-8, 8), 10 + rng.uniform(-8, 8)) for i in range(500)], "id int, lon double, lat double")
    met = C.candidates(near, "id", cells).collect()
    assert len(met) == 500 and sum(len(r["edges"]) // 4 for r in met) == 0  # ray casting would take 1,500,000
    all_over = spark.createDataFrame([(i, 20 + rng.uniform(-20, 20), 10 + rng.uniform(-20, 20)) for i in range(500)], "id int, lon double, lat double")
    assert sum(len(r["edges"]) // 4 for r in C.candidates(all_over, "id", cells).collect()) < 500 * 12


@pytest.mark.parametrize("grid", [Z.Grid(0.5, 0.5, 1.0, 1.0), Z.Grid(-179.75, 89.75, 0.5, -0.5), Z.Grid(0.0, 0.0, 1.0, 1.0)])
def test_runs_hold_the_centres_that_ray_casting_holds(spark, shapes, grid):
    got = {(r["geo"], r["row"], c) for r in Z.runs(spark.createDataFrame(shapes, SHAPE), "geo", grid).collect() for c in range(r["first"], r["last"] + 1)}
    want = set()
    for g, parts in shapes[:-1]:
        flat = [p for rings in parts for ring in rings for p in ring]
        if flat:
            cols = [int((min(p[0] for p in flat) - grid.lon) / grid.dlon) - 2, int((max(p[0] for p in flat) - grid.lon) / grid.dlon) + 2]
            rows = sorted(int((f(p[1] for p in flat) - grid.lat) / grid.dlat) for f in (min, max))
            want |= {(g, r, c) for r in range(rows[0] - 2, rows[1] + 3) for c in range(cols[0], cols[1] + 1) if holds(parts, grid.lon + c * grid.dlon, grid.lat + r * grid.dlat)}
    assert {x for x in got if x[0] != "line"} == want
    rows = Z.runs(spark.createDataFrame(shapes, SHAPE), "geo", grid).collect()
    assert len(rows) < len(got) / 3


def test_zonal_totals(spark, shapes):
    rng, grid = random.Random(6), Z.Grid(0.5, 0.5)
    cells = [(x + 0.5, y + 0.5, rng.choice([None, 1.25, 2.5, rng.randrange(100) / 4]), rng.choice([True, True, False, None]), 2025 + k) for x in range(-180, 180) for y in range(-20, 20) for k in range(2)]
    df = spark.createDataFrame(cells, "lon double, lat double, v double, ok boolean, year int")
    polygons = spark.createDataFrame(shapes, SHAPE)
    got = {(r["geo"], r["year"]): (r["total"], r["selected"], r["known"]) for r in Z.zonal_totals(df, polygons, "geo", grid, "v", "ok", ["year"]).collect()}
    want = {}
    for g, parts in shapes[:-1]:
        for year in (2025, 2026):
            held = [c for c in cells if c[4] == year and holds(parts, c[0], c[1])]
            known = [c[2] for c in held if c[3] and c[2] is not None]
            if held:
                want[g, year] = (sum(known) if known else None, len(held), len(known))
    assert {k: v for k, v in got.items() if k[0] != "line"} == want
    plan = Z.zonal_totals(df, polygons, "geo", grid, "v", "ok")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
