"""Constrained clustering in rounds against the one-by-one order, and what it compares."""

import math
import random

import pytest

from wattlake.operators import clusters as C

KEYED = "id string, entity string, country string, operator string, signature string, unit_name string, lon double, lat double, mw double, commissioning_year int, ids array<struct<key:string,value:string>>, plant_ids array<struct<key:string,value:string>>"


def row(i, **k):
    return {"id": i, "entity": "plant", "country": "x", "operator": "op", "signature": "north", "unit_name": None, "lon": 1.0, "lat": 1.0, "mw": 100.0, "commissioning_year": None, "ids": [], "plant_ids": [], **k}


def clusters(spark, rows, plant_group=False):
    return {r["id"]: r["cluster"] for r in C.clusters_of(spark.createDataFrame(rows, KEYED), plant_group).collect()}


def km(a, b):
    x, y = math.radians(a["lat"]), math.radians(b["lat"])
    h = math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin(math.radians(b["lon"] - a["lon"]) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(h)))


def linked(r, o, plant_group):
    """Whether a row may join an earlier one by a shared id (0) or by place (1), leaving conflicts aside."""
    if set(r["ids"]) & set(o["ids"]):
        return 0
    named = [r[k] is not None and r[k] == o[k] for k in ("country", "operator", "signature")]
    if not all(named) or None in (r["lon"], r["lat"], o["lon"], o["lat"]) or km(r, o) > 5:
        return None
    if plant_group:
        return 1
    a, b = r["mw"], o["mw"]
    if r["entity"] != o["entity"] or a is None or b is None or (a != b if 0 in (a, b) else not 0.9 <= a / b <= 1.1):
        return None
    if r["entity"] == "unit":
        years = {y for y in (r["commissioning_year"], o["commissioning_year"]) if y}
        if not set(r["plant_ids"]) & set(o["plant_ids"]) or not r["unit_name"] or r["unit_name"] != o["unit_name"] or len(years) > 1:
            return None
    return 1


def one_by_one(rows, plant_group):
    """The rows' clusters if they come one after another, each tried with every earlier row that it is linked with."""
    rows = sorted(rows, key=lambda r: r["id"])
    held = {r["id"]: dict(r["ids"]) | ({"#c": r["country"]} if r["country"] else {}) | ({} if plant_group else {"#k": r["entity"]}) for r in rows}
    root = {r["id"]: r["id"] for r in rows}
    for i, r in enumerate(rows):
        met = [(linked(r, o, plant_group), o["id"]) for o in rows[:i]]
        exact = sorted({root[o] for k, o in met if k == 0})
        for o in exact + sorted(o for k, o in met if k == 1):
            a, b = sorted((root[r["id"]], root[o]))
            if a != b and all(held[a][k] == held[b][k] for k in held[a].keys() & held[b].keys()):
                held[a] |= held[b]
                root = {k: a if v == b else v for k, v in root.items()}
    return root


@pytest.mark.parametrize("plant_group", [False, True])
def test_equals_the_order_of_ids(spark, plant_group):
    rng = random.Random(5 + plant_group)
    rows = []
    for g in range(40):  # groups of their own place and ids, with conflicts inside
        at, names = (rng.uniform(-180, 180), rng.uniform(-88, 88)), ["north", "south"]
        for k in range(rng.randrange(1, 9)):
            ids = [(n, f"{g}-{rng.randrange(2)}") for n in ("wikidata", "osm", "gemplant") if rng.random() < 0.35]
            spread = rng.choice([0, 0, 0.02, 0.04])
            lat = max(-89.9, min(89.9, at[1] + spread * rng.random()))
            rows.append(row(f"{rng.randrange(10**6):06}-{g}-{k}", entity=rng.choice(["plant", "plant", "unit"]), country=rng.choice(["x", "x", "x", "y", None]), signature=rng.choice(names), unit_name=rng.choice(["one", "two", None]), lon=at[0] + spread * rng.random(), lat=lat, mw=rng.choice([100.0, 100.0, 105.0, 111.0, 0.0, None]), commissioning_year=rng.choice([None, 0, 2000, 2001]), ids=ids, plant_ids=rng.choice([[], [("gemplant", f"{g}")], [("wri", f"{g}"), ("gemplant", f"{g}")]])))
    assert clusters(spark, rows, plant_group) == one_by_one(rows, plant_group)


def test_a_group_that_spans_cells_is_met_at_each_of_its_places(spark):
    rows = [row("a", lon=0.5, ids=[("wikidata", "Q")]), row("b", lon=1.02, ids=[("wikidata", "Q")]), row("c", lon=1.03)]
    assert clusters(spark, rows) == {"a": "a", "b": "a", "c": "a"}
    # Beyond the date line and over the pole.
    assert len(set(clusters(spark, [row("a", lon=179.99), row("b", lon=-179.99)]).values())) == 1
    assert len(set(clusters(spark, [row("a", lon=0.0, lat=89.99), row("b", lon=180.0, lat=89.99)]).values())) == 1


def test_rounds_of_conflicts(spark):
    # Every row has an id of its own, so nothing joins by place; those without one join the first.
    rows = [row(f"{i:03}", ids=[("wikidata", f"Q{i}")] if i % 10 == 0 else []) for i in range(100)]
    got = clusters(spark, rows)
    assert got == one_by_one(rows, False) and len(set(got.values())) == 10
    # A chain of places of rising ids, with a conflict at its ends.
    chain = [row(f"{i:02}", lat=1 + 0.04 * i, ids=[("osm", str(i // 5))] if i in (0, 5) else []) for i in range(6)]
    assert clusters(spark, chain) == one_by_one(chain, False)


def compared(spark, rows, plant_group=False):
    return C.near_spots(C.with_spots(spark.createDataFrame(rows, KEYED), plant_group), plant_group).count()


def test_few_pairs_are_compared(spark):
    spread = [row(f"{i:05}", signature=f"plant {i}", operator=f"op {i}", lon=-170.0 + i % 340, lat=-70.0 + i % 140) for i in range(3000)]
    assert compared(spark, spread) + compared(spark, spread, True) < 30_000
    dense = [row(f"{i:05}", signature=f"ridge {i}", lon=10.001 + i % 10 * 0.0001, lat=20.001) for i in range(2000)]
    assert compared(spark, dense) + compared(spark, dense, True) < 20_000
    units = [row(f"{i:05}", entity="unit", signature=f"alpha unit {i}", unit_name=f"alpha unit {i}", ids=[("gemunit", f"U{i}")], plant_ids=[("gemplant", "M")]) for i in range(3000)]
    assert compared(spark, units) < 30_000
    copies = [row(f"{i:05}") for i in range(3000)]
    assert compared(spark, copies) == 0 and set(clusters(spark, copies).values()) == {"00000"}
    # Plants in one cube need no comparison, however many places they have.
    assert compared(spark, [row(f"{i:05}", lon=1 + i * 1e-6) for i in range(3000)], True) < 3000


def test_nothing_to_cluster(spark):
    assert clusters(spark, []) == {}
    assert clusters(spark, [row("a", country=None), row("b", country=None), row("c", lat=None)]) == {"a": "a", "b": "b", "c": "c"}
