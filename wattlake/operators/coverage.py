"""Distinct counts that add up: a sketch a shard, kept with the snapshot and united, exact values beside small ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sketches(rows: DataFrame, shard: str, columns: Sequence[str], exact: int = 1000, bits: int = 12) -> DataFrame:
    """shard, column, rows, filled, sketch, and ``values`` (the distinct ones) where the sketch tells of at most ``exact``.

    One pass makes the sketches by partial aggregation; values are gathered only of small shards' columns.
    """
    long = rows.select(F.col(shard).cast("string").alias("shard"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("v")).select("shard", "v.*")
    made = long.groupBy("shard", "column").agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("filled"), F.hll_sketch_agg("value", bits).alias("sketch"))
    small = made.where(F.hll_sketch_estimate("sketch") <= exact).select("shard", "column")
    same = lambda a, b: [F.col(f"{a}.shard").eqNullSafe(F.col(f"{b}.shard")), F.col(f"{a}.column") == F.col(f"{b}.column")]
    few = long.alias("l").join(small.alias("s"), same("l", "s"), "left_semi").groupBy("shard", "column").agg(F.array_sort(F.collect_set("value")).alias("values"))
    return made.alias("m").join(few.alias("f"), same("m", "f"), "left").select("m.*", "f.values")


def united(kept: DataFrame) -> DataFrame:
    """column, rows, filled, distinct and whether it is ``exact``: of all shards together, from their sketches.

    Exact where every shard of the column has its values, else the union's estimate (about 1.6 % at 12 bits).
    """
    whole = kept.groupBy("column").agg(F.sum("rows").alias("rows"), F.sum("filled").alias("filled"), F.hll_sketch_estimate(F.hll_union_agg("sketch", F.lit(False))).alias("estimate"), F.bool_and(F.col("values").isNotNull()).alias("exact"))
    told = kept.join(whole.where("exact").select("column"), "column", "left_semi").select("column", F.explode("values").alias("value")).groupBy("column").agg(F.count_distinct("value").alias("n"))
    return whole.join(told, "column", "left").select("column", "rows", "filled", F.when(F.col("exact"), F.coalesce("n", F.lit(0))).otherwise(F.col("estimate")).cast("long").alias("distinct"), "exact")


def replaced(kept: DataFrame, fresh: DataFrame) -> DataFrame:
    """Sketches with those of renewed shards in place of the old ones."""
    return kept.join(fresh.select("shard").distinct(), "shard", "left_anti").unionByName(fresh)


def shrunk(now: DataFrame, before: DataFrame, slack: float = 0.05) -> DataFrame:
    """column and reason of what stands against publishing: nothing filled, or fewer distinct values than before, estimates with ``slack``."""
    d = now.alias("n").join(before.alias("b"), "column", "full")
    n, b = F.coalesce("n.distinct", F.lit(0)), F.coalesce("b.distinct", F.lit(0))
    least = F.when(F.col("n.exact") & F.col("b.exact"), b.cast("double")).otherwise(b * (1 - slack))
    why = F.when(n == 0, "is empty").when(n < least, F.concat(F.lit("dropped from "), b.cast("string"), F.lit(" to "), n.cast("string")))
    return d.select("column", why.alias("reason")).where("reason is not null")
