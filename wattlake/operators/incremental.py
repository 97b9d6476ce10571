"""Rebuilding only what has changed: a tree of fingerprints over region, year and input.

A leaf is the fingerprint of an input's rows of a region and year, in any order;
a node sums up its children: inputs to years, years to regions, regions to the
root. Two trees are held against each other from the top, so that unchanged
regions are told by one row each, and only changed ones are computed anew and
put into the last result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlake.operators.graph import written

LEVELS = ("root", "region", "year", "leaf")


def _digest(d: DataFrame, keys: Sequence[Column], texts: Column) -> DataFrame:
    """``keys`` and ``fingerprint``, one digest of each group's texts in any order: their SHA-256 in four parts, added up, beside their number.

    A part of 48 bits is added up in halves, which longs hold for 2^39 rows.
    """
    starts, sha = (1, 13, 25, 37), F.sha2(texts.cast("binary"), 256)
    cut = d.select(*keys, *[F.conv(F.substring(sha, i, 12), 16, 10).cast("long").alias(f"_{i}") for i in starts])
    names = [c for c in cut.columns if c not in {f"_{i}" for i in starts}]
    part = lambda c: (F.sum(F.shiftright(c, 24)).cast("decimal(20,0)") * (1 << 24) + F.sum(F.col(c).bitwiseAND(F.lit((1 << 24) - 1)))).cast("string")
    return cut.groupBy(*names).agg(F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *[part(f"_{i}") for i in starts]).cast("binary"), 256).alias("fingerprint"))


def leaves(inputs: dict[str, DataFrame], region: str = "geography_id", year: str = "year") -> DataFrame:
    """region, year, input and fingerprint of every input's rows of a region and year. A null year stands for all years."""
    out = None
    for name, df in sorted(inputs.items()):
        text = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
        d = _digest(df, [F.col(region).cast("string").alias("region"), F.col(year).cast("int").alias("year")], text).withColumn("input", F.lit(name))
        out = d if out is None else out.unionByName(d)
    if out is None:
        raise ValueError("no inputs")
    return out.select("region", "year", "input", "fingerprint")


def tree(own: DataFrame) -> DataFrame:
    """level, region, year, input and fingerprint of all nodes over ``leaves``.

    Leaves, years and regions are written once, so that inputs are read once, however often levels are looked at.
    """
    child = lambda *c: F.concat_ws("\x1f", *[F.coalesce(F.col(x).cast("string"), F.lit("\x00")) for x in c], "fingerprint")
    none = lambda kind: F.lit(None).cast(kind)
    region, year = F.col("region"), F.col("year")
    own = written(own)
    years = written(_digest(own, [region, year], child("input")))
    regions = written(_digest(years, [region], child("year")))
    root = _digest(regions, [], child("region"))
    parts = (("leaf", own), ("year", years.withColumn("input", none("string"))), ("region", regions.withColumns({"year": none("int"), "input": none("string")})), ("root", root.withColumns({"region": none("string"), "year": none("int"), "input": none("string")})))
    out = None
    for level, d in parts:
        d = d.select(F.lit(level).alias("level"), "region", "year", "input", "fingerprint")
        out = d if out is None else out.union(d)
    return out


def _differing(new: DataFrame, old: DataFrame, level: str, keys: Sequence[str]) -> DataFrame:
    """Keys of a level whose fingerprint differs or stands on one side only."""
    a, b = new.where(F.col("level") == level).alias("a"), old.where(F.col("level") == level).alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    met = a.join(b, same, "full").where(~F.col("a.fingerprint").eqNullSafe(F.col("b.fingerprint")))
    side = lambda k: F.when(F.col("a.level").isNotNull(), F.col(f"a.{k}")).otherwise(F.col(f"b.{k}")).alias(k)
    return met.select(*[side(k) for k in keys], F.col("a.level").isNull().alias("gone"))


def changed(new: DataFrame, old: DataFrame) -> DataFrame:
    """region and year of what differs between two trees, and whether it is ``gone``; nothing below an equal node is compared."""
    roots = [r["fingerprint"] for t in (new, old) for r in t.where("level = 'root'").collect()]
    if len(roots) == 2 and roots[0] == roots[1]:
        return new.limit(0).select("region", "year", F.lit(False).alias("gone"))
    regions = _differing(new, old, "region", ["region"]).select("region")
    below = lambda t: t.join(regions, "region", "left_semi")
    return _differing(below(new.where("level = 'year'")), below(old.where("level = 'year'")), "year", ["region", "year"])


def spread_to(groups: DataFrame, moved: DataFrame) -> DataFrame:
    """All regions and years of the groups (region, group) in which any has changed: shares of a country move with one of its regions."""
    touched = moved.join(groups, "region", "left").select(F.coalesce("group", F.concat(F.lit("="), F.col("region"))).alias("group"), "year").distinct()
    own = moved.select("region", "year")
    return groups.join(touched, "group").select("region", "year").union(own).distinct()


def rebuild_changed(last: DataFrame, moved: DataFrame, inputs: dict[str, DataFrame], compute: Callable[[dict[str, DataFrame]], DataFrame], region: str = "geography_id", year: str = "year") -> DataFrame:
    """The last result with the rows of ``moved`` regions and years computed anew from their inputs' rows alone.

    ``compute`` gives rows with region and year; rows of what has gone are dropped.
    The moved keys are written once, as every input and the last result meet them.
    """
    keys = written(moved.select(F.col("region").alias("_r"), F.col("year").alias("_y")).distinct())
    on = [F.col(region).cast("string").eqNullSafe(F.col("_r")), F.col(year).cast("int").eqNullSafe(F.col("_y"))]
    fresh = compute({name: df.join(keys, on, "left_semi") for name, df in inputs.items()})
    return last.join(keys, on, "left_anti").unionByName(fresh.select(*last.columns))
