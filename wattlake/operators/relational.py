"""Joins, aggregations, windows and set operations of the regional engine, as DataFrame functions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattlake.operators.graph import written


def money(c: Column) -> Column:
    """Exact sums: doubles as decimals with six places, so that a sum does not depend on its order."""
    return c.cast("decimal(28,6)")


# --- joins ---------------------------------------------------------------


def crosses(e):
        return ((e["ys"] > F.col("lat")) != (e["yn"] > F.col("lat"))) & (F.col("lon") < (e["xn"] - e["xs"]) * (F.col("lat") - e["ys"]) / (e["yn"] - e["ys"]) + e["xs"])


def best_match(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rank = 1").drop("_rank")


def blocked_pairs(df: DataFrame, ident: str, block: Sequence[str], neighbours: dict[str, int], test: Column) -> DataFrame:
    """Pairs (a.id < b.id) with equal ``block`` columns and ``neighbours`` columns at most so far apart that pass ``test``.

    One side is expanded to its neighbour keys, so the join is an equi-join; the
    other side's rows meet each pair once. A block of no more rows than a row has
    neighbour keys is compared as it is, which takes no more than its expansion;
    rows alone in their block go. ``test`` uses aliases a and b.
    """
    most = math.prod(2 * d + 1 for d in neighbours.values())
    size = df.groupBy(*block).agg(F.count("*").alias("_rows")).where("_rows > 1")
    met = written(df.join(size, list(block)))
    whole = F.col("_rows") <= most
    left, right = met, met
    for c, d in neighbours.items():
        left = left.withColumn(f"_{c}", F.when(whole, F.lit(0).cast("long")).otherwise(F.col(c).cast("long")))
        keys = F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.col(c).cast("long") - d, F.col(c).cast("long") + d))
        right = right.withColumn(f"_{c}", F.explode(keys))
    a, b = left.alias("a"), right.alias("b")
    cond = F.col(f"a.{ident}") < F.col(f"b.{ident}")
    for c in (*block, *[f"_{c}" for c in neighbours]):
        cond &= F.col(f"a.{c}") == F.col(f"b.{c}")
    for c, d in neighbours.items():
        cond &= F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= d
    return a.join(b, cond).where(test)


def override_join(base: DataFrame, better: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Full outer join: each column from ``better`` where it has one, else from ``base``; ``origin`` tells."""
    b = better.select(*key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_better"))
    out = base.join(b, list(key), "full_outer")
    return out.select(*key, *[F.coalesce(f"_{c}", c).alias(c) for c in columns], F.when(F.col("_better"), "official").otherwise("modelled").alias("origin"))


def fill_only(primary: DataFrame, fallback: DataFrame, key: Sequence[str]) -> DataFrame:
    """``fallback`` rows only where ``primary`` has none."""
    return primary.unionByName(fallback.join(primary.select(*key), list(key), "left_anti"))


def de_overlap(facts: DataFrame, closure: DataFrame, group: Sequence[str], node: str) -> DataFrame:
    """Drop a fact on an aggregate node where its group also has a fact on a descendant (closure: ancestor, descendant)."""
    below = facts.select(*group, F.col(node).alias("descendant")).join(closure, "descendant").select(*group, F.col("ancestor").alias(node)).distinct()
    return facts.join(below, [*group, node], "left_anti")


# --- aggregation ---------------------------------------------------------


def weighted_mean(value: Column, weight: Column) -> Column:
    return (F.sum(money(value * weight)).cast("double") / F.sum(money(weight)).cast("double"))


#: Widths of the cells of longitudes, each a part of the one before; by the last, 360 degrees take more cells than any key has longitudes.
LON_CELLS = (0.1, 0.1 / 3600, 0.1 / 3600**2)


def _largest_gap(d: DataFrame, keys: Sequence[str], lon: str, width: float, around: bool) -> DataFrame:
    """keys and ``gap`` (gap, tie, west, east): the largest one between a key's cells of longitudes; ``around`` counts the one over the end.

    Only each cell's least and greatest longitude are gathered, by partial aggregation.
    """
    cells = d.groupBy(*keys, F.floor((F.col(lon) + 180) / width).alias("_cell")).agg(F.min(lon).alias("low"), F.max(lon).alias("high"))
    whole = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("c"))
    c, n = F.col("c"), F.size("c")
    after = lambda i: F.when(i < n, F.try_element_at(c, i + 1)["low"]).otherwise(c[0]["low"])
    gap = lambda i: F.struct((after(i) + F.when(i == n, 360.0).otherwise(0.0) - c[i - 1]["high"]).alias("gap"), (-c[i - 1]["high"]).alias("tie"), after(i).alias("west"), c[i - 1]["high"].alias("east"))
    gaps = F.transform(F.sequence(F.lit(1), n), gap)
    return whole.select(*keys, F.array_max(gaps if around else F.slice(gaps, 1, n - 1)).alias("gap")).where("gap is not null")


def circular_bounds(df: DataFrame, key: str, lon: str) -> DataFrame:
    """West and east bound of each key's longitudes: the complement of the largest gap on the circle.

    A gap as wide as a cell lies between cells, so a tenth of a degree tells
    nearly every key; keys whose longitudes leave no such gap are looked at once
    more in finer cells. Of equal gaps the first from the west counts; null longitudes do not.
    """
    d = df.select(key, lon).where(F.col(lon).isNotNull())
    first = _largest_gap(d, [key], lon, LON_CELLS[0], True)
    narrow = first.where(F.col("gap.gap") < LON_CELLS[0]).select(key)
    found = first
    if not narrow.isEmpty():
        cell = lambda w: F.floor((F.col(lon) + 180) / w)
        dense = d.join(narrow, key, "left_semi").withColumn("_a", cell(LON_CELLS[0])).withColumn("_b", cell(LON_CELLS[1]))
        second, third = _largest_gap(dense, [key, "_a"], lon, LON_CELLS[1], False), _largest_gap(dense, [key, "_a", "_b"], lon, LON_CELLS[2], False)
        found = first.union(second.select(key, "gap")).union(third.select(key, "gap")).groupBy(key).agg(F.max("gap").alias("gap"))
    return found.select(key, "gap.west", "gap.east")


def circular_centre(df: DataFrame, key: str, lon: str) -> DataFrame:
    """Each key's mean longitude: values west of the western bound count a turn more, the mean is brought back to -180 to 180."""
    d = df.join(circular_bounds(df, key, lon), key)
    turned = F.when(F.col(lon) < F.col("west"), F.col(lon) + 360).otherwise(F.col(lon))
    mean = F.sum(money(turned)).cast("double") / F.count(lon)
    return d.groupBy(key).agg(mean.alias("m")).select(key, F.when(F.col("m") > 180, F.col("m") - 360).otherwise(F.col("m")).alias("centre"))


def observed_factor(df: DataFrame, key: Sequence[str], year: str, generation: str, capacity: str, least_years: int = 2, least_capacity: float = 100.0) -> DataFrame:
    """Observed capacity factor of each key: generation (GWh) by capacity (MW) times 8.76 GWh a year.

    Central is the ratio of sums, low and high the extreme years, with the years
    and the mean capacity; adequate ones only. A year without capacity, or with
    more generation than its capacity can give, is left out.
    """
    yearly = df.groupBy(*key, year).agg(F.sum(money(F.col(generation))).cast("double").alias("g"), (F.sum(money(F.col(capacity))).cast("double") * 8.76).alias("c")).where("c > 0 and g >= 0 and g <= c")
    f, total = F.col("g") / F.col("c"), lambda c: F.sum(money(F.col(c))).cast("double")
    agg = yearly.groupBy(*key).agg((total("g") / total("c")).alias("central"), F.min(f).alias("low"), F.max(f).alias("high"), F.count("*").alias("years"), (total("c") / 8.76 / F.count("*")).alias("mean_capacity"))
    return agg.where((F.col("years") >= least_years) & (F.col("mean_capacity") >= least_capacity))


def dominant(df: DataFrame, key: Sequence[str], name: str, value: str) -> DataFrame:
    """Each key's name of the largest value; ties go to the smaller name."""
    return df.groupBy(*key).agg(F.min(F.struct((-F.col(value)).alias("v"), F.col(name).alias("n"))).alias("m")).select(*key, F.col("m.n").alias("dominant"), (-F.col("m.v")).alias("dominant_value"))


def best_fields(df: DataFrame, key: Sequence[str], fields: Sequence[str], rank: Sequence[Column]) -> DataFrame:
    """Field by field, the value of the best-ranked row that has one."""
    return df.groupBy(*key).agg(*[F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)]))).alias(f) for f in fields])


# --- windows -------------------------------------------------------------


def _beside(df: DataFrame, group: Sequence[str], *sums: Column) -> DataFrame:
    """``df`` with aggregates of each row's group beside it: summed up first and joined back, so that no group is in one task."""
    whole = df.groupBy(*group).agg(*sums).withColumnsRenamed({c: f"_all_{c}" for c in group})
    return df.join(whole, [F.col(c).eqNullSafe(F.col(f"_all_{c}")) for c in group]).drop(*[f"_all_{c}" for c in group])


def with_shares(df: DataFrame, group: Sequence[str], value: str, name: str = "share") -> DataFrame:
    """``df`` with each row's share of its group's exact sum; a sum of zero raises."""
    d = _beside(df, group, F.sum(money(F.col(value))).cast("double").alias("_total"))
    share = F.when(F.col("_total") == 0, F.raise_error(F.lit("shares of a zero total")).cast("double")).otherwise(F.col(value) / F.col("_total"))
    return d.withColumn(name, share).drop("_total")


#: Fractions are whole numbers of nine digits; each pass tells ten bits of the least one that still gets a unit.
FRACTION, PASSES = 10**9, (20, 10, 0)


def _cut(rows: DataFrame, need: DataFrame, shift: int) -> DataFrame:
    """_g, _cut and _need: the part of ``_frac`` above ``shift`` in which a group's last units fall, and how many are left for it.

    Counts by group and part come first, at most about a thousand a group.
    """
    counts = rows.groupBy("_g", F.shiftright("_frac", shift).alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    falling = counts.groupBy("_g").agg(F.sort_array(F.collect_list(F.struct("_part", "n")), False).alias("p"))
    start = F.struct(F.lit(None).cast("long").alias("cut"), F.col("_need").alias("left"))
    step = lambda acc, p: F.when(acc["cut"].isNotNull(), acc).when(acc["left"] <= p["n"], F.struct(p["_part"].cast("long").alias("cut"), acc["left"].alias("left"))).otherwise(F.struct(acc["cut"].alias("cut"), (acc["left"] - p["n"]).alias("left")))
    told = falling.join(need, "_g").select("_g", F.aggregate("p", start, step).alias("c"))
    return told.select("_g", F.col("c.cut").alias("_cut"), F.col("c.left").alias("_need"))


def _first_by_id(ties: DataFrame, need: DataFrame, ident: str) -> DataFrame:
    """Rows of equal fractions that get a group's last units: the first by id.

    Rows are dealt by ranges of group and id; a row's place is its place in its range, after the rows of its group in
    the ranges before.
    """
    at = written(ties.select("_g", ident).repartitionByRange("_g", ident).sortWithinPartitions("_g", ident).withColumn("_at", F.monotonically_increasing_id()))
    at = at.withColumns({"_range": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND((1 << 33) - 1)})
    ranges = at.groupBy("_g", "_range").agg(F.min("_row").alias("_start"), F.count(F.lit(1)).alias("n"))
    listed = ranges.groupBy("_g").agg(F.collect_list(F.struct("_range", "n")).alias("all"))
    before = F.aggregate(F.filter("all", lambda r: r["_range"] < F.col("_range")), F.lit(0).cast("long"), lambda s, r: s + r["n"])
    placed = at.join(ranges.join(listed, "_g").select("_g", "_range", "_start", before.alias("_before")), ["_g", "_range"]).join(need, "_g")
    return placed.where(F.col("_before") + F.col("_row") - F.col("_start") < F.col("_need")).select("_g", ident)


def largest_remainder(df: DataFrame, group: Sequence[str], ident: str, weight: str, total: str) -> DataFrame:
    """Whole units of ``total`` by weight: floors, then one each by falling fraction (ids break ties); null where all weights are zero.

    Weights are summed exactly, so the order of rows does not matter. The least fraction that still gets a unit is
    found by counts, ten bits a pass, and only rows of that very fraction are put in order: no group is in one task.
    ``ident`` is unique in a group. A null group is a group; a null total gives nulls.
    """
    keys = [F.col(c).eqNullSafe(F.col(f"_all_{c}")) for c in group]
    whole = df.groupBy(*group).agg(F.sum(money(F.col(weight))).cast("double").alias("_all")).withColumnsRenamed({c: f"_all_{c}" for c in group})
    exact = F.when(F.col("_all") > 0, F.bround(F.col(total).cast("double") * money(F.col(weight)).cast("double") / F.col("_all"), 9))
    d = df.join(whole, keys).drop(*[f"_all_{c}" for c in group]).withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    d = written(d.withColumns({"_frac": F.round((F.col("_exact") - F.col("_floor")) * FRACTION).cast("long"), "_g": F.to_json(F.struct(*group), {"ignoreNullFields": "false"})}).drop("_exact", "_all"))
    open_rows = d.where("_floor is not null").select("_g", ident, "_frac", "_floor", F.col(total).alias("_total"))
    need = written(open_rows.groupBy("_g").agg((F.max("_total") - F.sum("_floor")).cast("long").alias("_need")).where("_need > 0"))
    rows, left, cut = open_rows.join(need.select("_g"), "_g", "left_semi"), need, None
    for shift in PASSES:
        if cut is not None:
            rows = open_rows.join(cut, "_g").where(F.shiftright("_frac", cut_shift) == F.col("_cut")).drop("_cut", "_need")
            left = cut.select("_g", "_need")
        cut, cut_shift = written(_cut(rows, left, shift)), shift
    # A group with more units left than rows gives each of them one: it has no cut.
    ties = open_rows.join(cut.where("_cut is not null"), "_g").where(F.col("_frac") == F.col("_cut"))
    first = _first_by_id(ties, cut.select("_g", "_need"), ident).withColumn("_tied", F.lit(1))
    out = d.join(cut.select("_g", "_cut", F.lit(True).alias("_open")), "_g", "left").join(first, ["_g", ident], "left")
    more = F.when(F.col("_open") & (F.col("_cut").isNull() | (F.col("_frac") > F.col("_cut"))), 1).otherwise(F.coalesce("_tied", F.lit(0)))
    return out.withColumn("units", (F.col("_floor") + more).cast("long")).select(*df.columns, "units")


def residual_to_top(df: DataFrame, group: Sequence[str], ident: str, score: str, value: str, total: str) -> DataFrame:
    """Give what ``value`` lacks to ``total`` to the row of the top score (smallest id, which is unique in its group; rows without a score come last)."""
    top = F.min(F.struct(F.col(score).isNull().alias("a"), (-F.col(score)).alias("b"), F.col(ident).alias("i"))).alias("_top")
    d = _beside(df, group, top, F.sum(F.col(value)).alias("_given"))
    lack = F.col(total) - F.col("_given")
    return d.withColumn(value, F.col(value) + F.when(F.col(ident) == F.col("_top.i"), lack).otherwise(F.lit(0).cast("decimal(18,2)"))).drop("_top", "_given")


def baseline_growth(df: DataFrame, key: Sequence[str], year: str, value: str) -> DataFrame:
    first = F.first(value).over(Window.partitionBy(*key).orderBy(year).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("growth", F.when(first > 0, (F.col(value) - first) / first))


def collision_names(df: DataFrame, base: str, ident: str) -> DataFrame:
    """Repeated base names: the smallest id keeps it, others get ten hex digits of their id's SHA-256."""
    w = Window.partitionBy(base)
    rank = F.row_number().over(w.orderBy(ident))
    digest = F.substring(F.sha2(F.col(ident).cast("string").cast("binary"), 256), 1, 10)
    return df.withColumn("name", F.when(rank == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), digest)))


def year_gaps(df: DataFrame, key: Sequence[str], year: str, first: int, last: int) -> DataFrame:
    """Keys whose years are not exactly first..last, once each."""
    agg = df.groupBy(*key).agg(F.array_sort(F.collect_list(year)).alias("years"))
    return agg.where(F.col("years") != F.sequence(F.lit(first), F.lit(last))).select(*key)


# --- sets ----------------------------------------------------------------


def difference_both_ways(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids on one side only."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("left")).union(y.join(x, key, "left_anti").withColumn("side", F.lit("right")))


def append_new(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All of ``first``, and of ``second`` what has a new key."""
    return first.unionByName(second.join(first.select(key), key, "left_anti"))


def violations(df: DataFrame, ident: str, rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule and row; a null outcome counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(F.col(ident).alias("id"), F.explode(broken).alias("rule"))
