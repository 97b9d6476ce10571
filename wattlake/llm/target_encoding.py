"""Target encoding by what was known at the time: counts of earlier rows of other folds, and rates smoothed level by level.

Time is cut into slices by percentiles, and rows are dealt to shards of a key's
bucket and a slice. What a key had before a slice is its opening balance there,
a running total of the slices' sums. Within a shard each task builds tables of
cumulative sums by key and by key and fold, and an ASOF join in DuckDB finds for
each row the last entries before it. No key, however frequent, is in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattlake.llm.shared import Scratch

#: Rows that a shard's task joins at once; a larger shard goes through in turns, its balances carried on.
TURN_ROWS = 1 << 16
NEVER = -(1 << 62)
#: Stands for a key without a value.
NULL = -(1 << 63)


def _slices(times: DataFrame, column: str, slices: int) -> list[float]:
    """Bounds of slices of about equal rows: at most ``slices`` - 1 numbers, however many rows there are."""
    if slices < 2:
        return []
    found = times.agg(F.percentile_approx(column, [k / slices for k in range(1, slices)], 20 * slices).alias("q")).first()["q"]
    return sorted({float(x) for x in found or []})


def _sliced(df: DataFrame, column: str, bounds: list[float]) -> DataFrame:
    """Adds ``_slice``: the number of bounds at or below the time."""
    if not bounds:
        return df.withColumn("_slice", F.lit(0))
    cut = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol="_time_double", outputCol="_bucket")
    return cut.transform(df.withColumn("_time_double", F.col(column).cast("double"))).withColumn("_slice", F.col("_bucket").cast("int")).drop("_time_double", "_bucket")


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Parts of one shard each, of about TURN_ROWS rows, in the order of the rows."""
    held: list[pa.RecordBatch] = []
    shard, n = None, 0
    for batch in batches:
        own = batch.column("_shard").to_numpy()
        at = 0
        while at < len(own):
            end = at + int((own[at:] == own[at]).argmin()) if own[-1] != own[at] else len(own)
            if held and (own[at] != shard or n >= TURN_ROWS):
                yield shard, pa.Table.from_batches(held)
                held, n = [], 0
            shard = int(own[at])
            held.append(batch.slice(at, end - at))
            n, at = n + end - at, end
    if held:
        yield shard, pa.Table.from_batches(held)


def _joined(keys: int, carried: list[str], folds: int, told_apart: bool):
    """mapInArrow over shards: rows by time, opening balances first; gives each asking row its history's n and s by key."""
    rows = lambda role: f"(FROM part WHERE _level IS NULL{f' AND {role}' if told_apart else ''})"
    sums = ", ".join(f"coalesce(k{i}.{x}, 0) - coalesce(f{i}.{x}, 0) AS _k{i}_{x}" for i in range(keys) for x in ("n", "s"))
    both = ", ".join(f"(sum(sum({x})) OVER w)::BIGINT AS {x}" for x in "ns")
    cums = "".join(f"""
        CREATE OR REPLACE TEMP TABLE k{i} AS SELECT key, t, {both} FROM told SEMI JOIN {rows("_asks")} p ON told.key = p._k{i} WHERE level = {i} GROUP BY key, t WINDOW w AS (PARTITION BY key ORDER BY t);
        CREATE OR REPLACE TEMP TABLE f{i} AS SELECT key, fold, t, {both} FROM told SEMI JOIN {rows("_asks")} p ON told.key = p._k{i} AND told.fold = p._fold WHERE level = {i}
            GROUP BY key, fold, t WINDOW w AS (PARTITION BY key, fold ORDER BY t);""" for i in range(keys))  # fmt: skip
    asof = " ".join(f"ASOF LEFT JOIN k{i} ON p._k{i} = k{i}.key AND p._time > k{i}.t ASOF LEFT JOIN f{i} ON p._k{i} = f{i}.key AND p._fold = f{i}.fold AND p._time > f{i}.t" for i in range(keys))
    events = " UNION ALL ".join(f"SELECT {i} AS level, _k{i} AS key, _fold AS fold, _time AS t, _n AS n, _s AS s FROM {rows('_tells')}" for i in range(keys))
    opened = " UNION ALL ".join(f"SELECT _level, _k0, {f}, {NEVER}, _n{f}, _s{f} FROM part WHERE _level IS NOT NULL AND _n{f} <> 0" for f in range(folds))

    def fn(batches):
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        shard = last = None
        for now, part in _turns(batches):
            con.register("part", part)
            if now != shard:
                con.execute("CREATE OR REPLACE TEMP TABLE told (level INT, key BIGINT, fold INT, t BIGINT, n BIGINT, s BIGINT)")
            elif last is not None:
                # This turn's rows may have the last one's last time: only what is earlier is summed up.
                con.execute(f"CREATE OR REPLACE TEMP TABLE told AS SELECT level, key, fold, CASE WHEN t < {last} THEN {NEVER} ELSE t END AS t, sum(n)::BIGINT AS n, sum(s)::BIGINT AS s FROM told GROUP BY ALL")
            shard, last = now, pc.max(part.column("_time")).as_py()
            con.execute(f"INSERT INTO told {events} UNION ALL {opened}")
            con.execute(cums)
            out = con.sql(f"SELECT {', '.join(f'p.{c}' for c in carried)}, {sums} FROM {rows('_asks')} p {asof}").to_arrow_table()
            yield from out.cast(pa.schema([(c, part.schema.field(c).type) for c in carried] + [(f"_k{i}_{x}", pa.int64()) for i in range(keys) for x in ("n", "s")])).to_batches()
            con.unregister("part")
        con.close()

    return fn


def history(rows: DataFrame, keys: Sequence[str], time: str, fold: str, n: str, s: str, folds: int, gap: int = 0, slice_rows: int = 1 << 18, most_slices: int = 4096, buckets: int = 4) -> DataFrame:
    """``rows`` with <key>_n and <key>_s for each of ``keys``: sums of ``n`` and ``s`` over rows of the key's value,
    of other folds, more than ``gap`` earlier (0: any time earlier; rows of the same time never count).

    ``time`` is a long column; ``fold`` an int from 0 to ``folds`` - 1. Keys are whole numbers, others go by
    their 64-bit hash; null is a value of its own (the least long stands for it). Each key's values must lie
    within one value of the last key, which with the slice of time makes a shard (of ``buckets`` a slice).
    Rows without a time have no history and are in none: they are left out. Equal rows stay apart. No rows
    give none. At most ``most_slices`` bounds come to the driver.
    """
    spark, names = rows.sparkSession, [f"_k{i}" for i in range(len(keys))]
    kinds, columns, whole = dict(rows.dtypes), rows.columns, ("tinyint", "smallint", "int", "bigint")
    code = lambda k: F.coalesce(F.col(k).cast("long") if kinds[k] in whole else F.when(F.col(k).isNotNull(), F.xxhash64(k)), F.lit(NULL))
    # Each value goes to Python once: what is also a key, time, fold or sum is read back from there.
    coded = {k: c for k, c in zip(keys, names, strict=True) if kinds[k] in whole}
    roles = {time: "_time", fold: "_fold", n: "_n", s: "_s"} | coded
    plain = [c for c in columns if c not in roles]
    rows = rows.where(F.col(time).isNotNull()).select(*plain, *[code(k).alias(c) for k, c in zip(keys, names, strict=True)], F.col(time).cast("long").alias("_time"), F.col(fold).cast("int").alias("_fold"), F.col(n).cast("long").alias("_n"), F.col(s).cast("long").alias("_s"))
    slices = min(most_slices, -(-rows.count() // slice_rows))
    bounds = _slices(rows, "_time", slices)
    if gap:
        asks, tells = rows.withColumns({"_asks": F.lit(True), "_tells": F.lit(False)}), rows.withColumns({"_asks": F.lit(False), "_tells": F.lit(True), "_time": F.col("_time") + gap})
        rows = asks.union(tells)
    cut = _sliced(rows, "_time", bounds)
    shard = F.col("_slice") * buckets + F.pmod(F.xxhash64(names[-1]), F.lit(buckets))
    cut = cut.withColumn("_shard", shard.cast("long"))
    # Sums by key, slice and fold; their running totals over earlier slices are the opening balances.
    levels = F.explode(F.array(*[F.struct(F.lit(i).alias("_level"), F.col(c).alias("_key")) for i, c in enumerate(names)]))
    # A slice in which a key only asks has a balance too.
    of = lambda c: (F.when(F.col("_tells"), F.col(c)).otherwise(0) if gap else F.col(c)).alias(c)
    each = cut.select(levels.alias("l"), "_shard", "_slice", "_fold", of("_n"), of("_s")).select("l.*", "_shard", "_slice", "_fold", "_n", "_s")
    amount = lambda c, f: F.sum(F.when(F.col("_fold") == f, F.col(c)).otherwise(0))
    totals = each.groupBy("_level", "_key", "_slice", "_shard").agg(*[amount(f"_{x}", f).alias(f"_{x}{f}") for x in "ns" for f in range(folds)])
    before = Window.partitionBy("_level", "_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # Flat columns: a list's size would be measured anew for every row on its way to Python.
    opening = totals.select("_shard", "_level", F.col("_key").alias("_k0"), *[F.sum(f"_{x}{f}").over(before).alias(f"_{x}{f}") for x in "ns" for f in range(folds)])
    opening = opening.where(sum((F.col(f"_n{f}") for f in range(folds)), F.lit(0)) > 0)
    both = cut.drop("_slice").unionByName(opening, allowMissingColumns=True)
    shards = max(1, slices * buckets)
    dealt = both.repartition(min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shards // 4))), "_shard").sortWithinPartitions(F.col("_shard"), F.col("_time").asc_nulls_first())
    carried = [*plain, *names, "_time", "_fold", "_n", "_s"]
    made = ", ".join([f"`{c}` {kinds[c]}" for c in plain] + [f"{c} {'int' if c == '_fold' else 'long'}" for c in carried if c not in plain] + [f"{c}_{x} long" for c in names for x in ("n", "s")])
    out = dealt.mapInArrow(_joined(len(names), carried, folds, bool(gap)), made)
    back = lambda c: (F.when(F.col(roles[c]) != NULL, F.col(roles[c])) if c in coded else F.col(roles[c])).cast(kinds[c]).alias(c) if c in roles else F.col(c)
    return out.select(*[back(c) for c in columns], *[F.col(f"{c}_{x}").alias(f"{k}_{x}") for k, c in zip(keys, names, strict=True) for x in ("n", "s")])


def rate(n: Column, s: Column, prior: Column, weight: int = 50, scale: int = 1_000_000) -> Column:
    """Smoothed share of s in n, in parts of ``scale``: the prior where n is 0, else rounded down, in longs."""
    n, s, prior = (x.cast("long") for x in (n, s, prior))
    return F.when(n < 1, prior).otherwise(F.call_function("div", scale * s + weight * prior, n + weight))


def local_micros(c: Column) -> Column:
    """Microseconds of a time without a zone since 1970 began, whatever the session's zone."""
    span = c.cast("timestamp_ntz") - F.lit("1970-01-01").cast("timestamp_ntz")
    part = lambda unit: F.extract(F.lit(unit), span)
    return ((part("DAY").cast("long") * 24 + part("HOUR")) * 60 + part("MINUTE")) * 60_000_000 + (part("SECOND") * 1_000_000).cast("long")


def encode_sales(lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame, folds: int = 5, gap: int = 0, **sizes: int) -> DataFrame:
    """Return rates of items, vendors and clients, each line's from lines of other folds sold earlier.

    One row per sale_id, item_id and vendor_id: n_lines and n_returned (its own
    lines), item_n, item_rate, vendor_n, vendor_rate, client_n, client_rate. An
    item's rate is smoothed by that of its kind, a vendor's by its nation's, a
    client's by its segment's, these by the rate of all. ``gap`` is in
    microseconds. Lines without a sale or sold_at go; null item_id and client_id
    are -1; a null vendor_id is an id of its own. Unknown ids and null kinds,
    nations and segments are one value. Repeated lines count as often as they
    stand; where a sale_id stands several times, each of its rows gives its own. An id that
    stands several times among items, vendors or clients has the least value. No
    rows give none. Other columns do not matter.
    """
    scratch = Scratch(lines.sparkSession)
    counts = [F.count(F.lit(1)).alias("n_lines"), F.count(F.when(F.col("flag") == "returned", 1)).alias("n_returned")]
    # Written first: with a plain exchange on either side of a join, a hot id's rows can be split.
    least = lambda t, k, v: scratch.write(t.groupBy(k).agg(F.min(v).alias(v)).where(F.col(k).isNotNull()), k)
    brief = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(c)).alias(c)
    rated = lambda k, prior: rate(F.col(f"{k}_n"), F.col(f"{k}_s"), prior)
    # A sale has one time and client: its lines are told of them once.
    crc = F.crc32(F.col("sale_id").cast("string").cast("binary"))
    sold = sales.where("sold_at is not null").select("sale_id", F.coalesce("client_id", F.lit(-1)).alias("client_id"), local_micros(F.col("sold_at")).alias("time"), (crc % folds).cast("int").alias("fold"))
    sold = sold.join(least(clients, "client_id", "segment").hint("merge"), "client_id", "left")
    sold = sold.join(scratch.write(lines.groupBy("sale_id").agg(*counts), "counts").hint("merge"), "sale_id")
    sold = scratch.write(sold.select("sale_id", "client_id", "time", "fold", "n_lines", "n_returned", brief("segment"), F.lit(0).alias("everything")), "sold")
    found = history(sold, ["client_id", "segment", "everything"], "time", "fold", "n_lines", "n_returned", folds, gap, **sizes)
    every = rated("everything", F.lit(500_000))
    sold = scratch.write(found.select("sale_id", "time", "fold", F.col("client_id_n").alias("client_n"), rated("client_id", rated("segment", every)).alias("client_rate"), every.alias("every")), "client")
    own = lines.groupBy("sale_id", F.coalesce("item_id", F.lit(-1)).alias("item_id"), "vendor_id").agg(*counts)
    rows = own.join(sold.hint("merge"), "sale_id")
    rows = rows.join(least(items, "item_id", "kind").hint("merge"), "item_id", "left")
    rows = rows.join(least(vendors, "vendor_id", "nation_id").hint("merge"), "vendor_id", "left")
    rows = scratch.write(rows.select("sale_id", "item_id", "vendor_id", "n_lines", "n_returned", "time", "fold", brief("kind"), "nation_id", "client_n", "client_rate", "every"), "rows")
    for name, key, group in (("item", "item_id", "kind"), ("vendor", "vendor_id", "nation_id")):
        found = history(rows, [key, group], "time", "fold", "n_lines", "n_returned", folds, gap, **sizes)
        kept = [c for c in rows.columns if c != group]
        rows = scratch.write(found.select(*kept, F.col(f"{key}_n").alias(f"{name}_n"), rated(key, rated(group, F.col("every"))).alias(f"{name}_rate")), name)
        scratch.keep(name)
    return rows.select("sale_id", "item_id", "vendor_id", "n_lines", "n_returned", "item_n", "item_rate", "vendor_n", "vendor_rate", "client_n", "client_rate")
