"""Largest remainders and circular bounds against plain loops, groups of any size."""

import math
import random
from decimal import Decimal

import pytest

from wattlake.operators import relational as R


def whole_units(weights, total):
    """Units of (id, weight) by largest remainder."""
    all_ = float(sum(Decimal(str(round(w, 6))) for _, w in weights))
    if all_ <= 0:
        return {i: None for i, _ in weights}
    exact = {i: round(total * w / all_, 9) for i, w in weights}
    out = {i: math.floor(x) for i, x in exact.items()}
    for i in sorted(exact, key=lambda i: (-round(exact[i] - out[i], 9), i))[: total - sum(out.values())]:
        out[i] += 1
    return out


def test_largest_remainder_of_groups_of_any_size(spark):
    rng = random.Random(1)
    groups = {"one": [("a", 5.0)], "zero": [("a", 0.0), ("b", 0.0)], "equal": [(f"{i:04}", 1.0) for i in range(1500)], "mixed": [(f"{i:04}", rng.choice([1.0, 2.0, 3.5, 0.0])) for i in range(400)], None: [("x", 1.0), ("y", 2.0)], "fine": [(f"{i:04}", rng.randrange(1, 10**6) / 1000) for i in range(700)]}
    totals = {"one": 7, "zero": 5, "equal": 1000, "mixed": 999, None: 2, "fine": 123_456}
    rows = [(g, i, w, totals[g]) for g, r in groups.items() for i, w in r]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i string, w double, t long")
    out = R.largest_remainder(df, ["g"], "i", "w", "t")
    assert out.columns == ["g", "i", "w", "t", "units"]
    got = {(r["g"], r["i"]): r["units"] for r in out.collect()}
    assert got == {(g, i): u for g, r in groups.items() for i, u in whole_units(r, totals[g]).items()}
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert R.largest_remainder(df.where("false"), ["g"], "i", "w", "t").collect() == []


def bounds(lons):
    lons = sorted(set(lons))
    gaps = [((lons[(k + 1) % len(lons)] + (360 if k + 1 == len(lons) else 0)) - x, -x, lons[(k + 1) % len(lons)], x) for k, x in enumerate(lons)]
    return max(gaps)[2:]


@pytest.mark.parametrize("dense", [0, 40_000])
def test_circular_bounds(spark, dense):
    rng = random.Random(2)
    keys = {f"k{k}": [round(rng.uniform(-180, 180), 3) for _ in range(rng.randrange(1, 60))] for k in range(30)}
    keys |= {"date": [179.5, -179.25, 178.0], "one": [12.5] * 3, "ends": [-180.0, 180.0], "tie": [-90.0, 0.0, 90.0, 180.0]}
    if dense:  # no gap of a tenth of a degree: told in finer cells
        keys["dense"] = [-180 + 0.009 * k + (0.008 if k == 777 else 0) for k in range(dense)]
        keys["denser"] = [-180 + 0.009 * k + rng.random() * 1e-5 for k in range(dense)]
    rows = [(k, x) for k, lons in keys.items() for x in lons] + [("date", None), ("none", None)]
    out = R.circular_bounds(spark.createDataFrame(rows, "k string, lon double"), "k", "lon")
    assert {r["k"]: (r["west"], r["east"]) for r in out.collect()} == {k: bounds(v) for k, v in keys.items()}
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
