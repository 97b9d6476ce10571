"""Constrained clustering of rows in rounds: links that join only where nothing that they hold conflicts.

A row's profile is what it is known by: one id a namespace, its country, for
records its kind. Rows are linked by a shared id, or by country, operator, name
and place (for records capacity too). Links are taken in the order of the later
of their rows; a link joins two clusters if their profiles agree wherever both
have an entry. What conflicts once conflicts for good, so every cluster may take
its first link that does not, as soon as that is the first of the other cluster
too. All such pairs join at once, round by round, with the outcome of the
one-by-one order, and no component is one task's work. Components in which
nothing conflicts are clusters as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlake.functions.scalars import haversine_km
from wattlake.operators.graph import connected_components, written

NEAR_KM = 5.0
EARTH_KM = 6371.0
#: Edge of a cube of which any two points lie within NEAR_KM of each other.
CUBE_KM = 2.88
ENTRY = "array<struct<key:string,value:string>>"


def _profile(plant_group: bool) -> Column:
    """Sorted entries of namespace and id, and of country and kind where they count; of an id that is told twice the last stands."""
    ids = F.filter("ids", lambda e, i: ~F.exists(F.slice("ids", i + 2, F.size("ids")), lambda o: o["key"] == e["key"]))
    entry = lambda name, value: F.filter(F.array(F.struct(F.lit(name).alias("key"), value.alias("value"))), lambda e: e["value"].isNotNull())
    more = [entry("#country", F.col("country"))] + ([] if plant_group else [entry("#kind", F.col("entity"))])
    return F.array_sort(F.concat(ids, *more)).cast(ENTRY)


def _told(entries: Column) -> Column:
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("\x1e"), e["value"])), "\x1f")


def _cube(km: float) -> list[Column]:
    """Cell of a point of the globe in space: no seam at the date line or the poles."""
    lon, lat = F.radians("lon"), F.radians("lat")
    at = (F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))
    return [F.floor(EARTH_KM * x / km).cast("int") for x in at]


def with_spots(keyed: DataFrame, plant_group: bool) -> DataFrame:
    """``keyed`` with ``spot`` and ``block``: rows of one spot are alike; only rows of one block can be. Null where a row has not all it takes."""
    unit = F.col("entity") == "unit"
    usable = F.col("country").isNotNull() & F.col("operator").isNotNull() & F.col("signature").isNotNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull()
    block, own = [F.col("country"), F.col("operator"), F.col("signature")], [F.col("lon"), F.col("lat")]
    if not plant_group:
        usable &= F.col("mw").isNotNull() & (~unit | F.col("unit_name").isNotNull() & (F.size("plant_ids") > 0))
        block += [F.col("entity"), F.when(unit, F.col("unit_name")).otherwise("")]
        own += [F.col("mw"), F.when(unit, F.coalesce("commissioning_year", F.lit(0))).otherwise(0), F.when(unit, _told(F.array_sort("plant_ids"))).otherwise("")]
    text = lambda columns: F.concat_ws("\x1d", *[c.cast("string") for c in columns])
    return keyed.withColumns({"block": F.when(usable, F.md5(text(block))), "spot": F.when(usable, F.md5(text(block + own)))})


def near_spots(spotted: DataFrame, plant_group: bool) -> DataFrame:
    """Pairs of different spots of a block in neighbouring cells, and whether they are ``alike``: what is compared at all.

    Rows of one spot, and of plants those of one cube, need no comparison.
    """
    spots = spotted.where("spot is not null").groupBy("spot", "block", "lon", "lat").agg(F.min("id").alias("first"), *[F.any_value(c).alias(c) for c in ("entity", "mw", "commissioning_year", "plant_ids")])
    cell = _cube(NEAR_KM)
    spots = spots.select("*", *[c.alias(f"c{i}") for i, c in enumerate(cell)], F.concat_ws("\x1d", *[c.cast("string") for c in _cube(CUBE_KM)]).alias("cube"))
    around = [F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)])).alias(f"d{i}") for i in range(3)]
    a = spots.select("*", around[0]).select("*", around[1]).select("*", around[2]).withColumns({f"c{i}": F.col(f"c{i}") + F.col(f"d{i}") for i in range(3)}).drop("d0", "d1", "d2").alias("a")
    b = spots.alias("b")
    met = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("block", "c0", "c1", "c2")]).where("a.first > b.first")
    alike = haversine_km(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat")) <= NEAR_KM
    if plant_group:
        met = met.where("a.cube <> b.cube")
    else:
        mw, mw2, year, year2 = F.col("a.mw"), F.col("b.mw"), F.coalesce("a.commissioning_year", F.lit(0)), F.coalesce("b.commissioning_year", F.lit(0))
        size = F.when((mw == 0) | (mw2 == 0), mw == mw2).otherwise((mw / mw2).between(0.9, 1.1))
        same_unit = F.arrays_overlap("a.plant_ids", "b.plant_ids") & ((year == 0) | (year2 == 0) | (year == year2))
        alike &= size & ((F.col("a.entity") != "unit") | same_unit)
    return met.select(F.col("a.spot").alias("spot"), F.col("b.spot").alias("other"), alike.alias("alike"))


def _nodes_and_links(keyed: DataFrame, plant_group: bool) -> tuple[DataFrame, DataFrame]:
    """Rows with their node (first of the rows of one profile and id, or one profile and spot), and links: key, rank
    (0 a shared id, 1 a place), node, and row, the node's first row that has the key. All nodes of a key are linked with each other.
    """
    spotted = with_spots(keyed, plant_group).withColumn("profile", _profile(plant_group))
    told = _told(F.col("profile"))
    same = F.when(F.size("ids") > 0, F.md5(F.concat(F.lit("x"), told))).when(F.col("spot").isNotNull(), F.md5(F.concat_ws("\x1d", F.lit("s"), told, F.col("spot")))).otherwise(F.concat(F.lit("="), F.col("id")))
    spotted = spotted.withColumn("same", same)
    rows = written(spotted.join(spotted.groupBy("same").agg(F.min("id").alias("node")), "same").drop("same"))
    exact = rows.select(F.explode("ids").alias("e"), "node", "id").select(F.concat_ws("\x1d", F.lit("x"), "e.key", "e.value").alias("key"), F.lit(0).alias("rank"), "node", "id")
    at = rows.where("spot is not null").groupBy("spot", "block", "lon", "lat", "node").agg(F.min("id").alias("id"))
    spot = at.select(F.concat(F.lit("s"), F.col("spot")).alias("key"), F.lit(1).alias("rank"), "node", "id")
    pairs = near_spots(rows, plant_group).where("alike").select(F.concat_ws("\x1d", F.lit("p"), "spot", "other").alias("key"), F.explode(F.array("spot", "other")).alias("spot"))
    links = exact.union(spot).union(pairs.join(at.select("spot", "node", "id"), "spot").select("key", F.lit(1).alias("rank"), "node", "id"))
    if plant_group:
        links = links.union(at.select(F.concat_ws("\x1d", F.lit("c"), "block", *_cube(CUBE_KM)).alias("key"), F.lit(1).alias("rank"), "node", "id"))
    links = written(links.groupBy("key", "rank", "node").agg(F.min("id").alias("row")))
    shared = links.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last")
    return rows, links.join(shared.select("key", "first"), "key")


def first_links(links: DataFrame, clusters: DataFrame) -> DataFrame:
    """Each pair of clusters that may join by their first compatible link: a, b, rank and order of it.

    ``links`` has key, rank, row, cluster; ``clusters`` cluster and profile. Clusters of
    one key are compared by equality of what their namespaces share, one set of namespaces with
    another, so that none is held against each other one. Enough pairs come out for every
    cluster's first: its link with the key's first compatible cluster, in either direction.
    """
    own = links.groupBy("key", "rank", "cluster").agg(F.min("row").alias("rep")).join(clusters, "cluster")
    own = own.withColumn("names", F.transform("profile", lambda e: e["key"]))
    sets = own.groupBy("key").agg(F.collect_set("names").alias("sets"))  # sets of namespaces, not of ids: few
    facing = own.join(sets, "key").select("key", "rank", "cluster", "rep", "names", "profile", F.explode("sets").alias("other"))
    facing = facing.withColumn("common", _told(F.filter("profile", lambda e: F.array_contains("other", e["key"]))))
    facing = facing.select("key", "rank", "cluster", "rep", F.least("names", "other").alias("low"), F.greatest("names", "other").alias("high"), "common", (F.col("names") <= F.col("other")).alias("is_low"))
    group = ["key", "rank", "low", "high", "common"]
    head = lambda side: F.min(F.when(side, F.struct("rep", "cluster")))
    heads = facing.groupBy(*group).agg(head(F.col("is_low")).alias("first_low"), head(~F.col("is_low")).alias("first_high"))
    met = facing.join(heads, group).withColumn("to", F.when(F.col("low") == F.col("high"), F.col("first_low")).when(F.col("is_low"), F.col("first_high")).otherwise(F.col("first_low")))
    met = met.where(F.col("to").isNotNull() & (F.col("to.cluster") != F.col("cluster")))
    earlier = F.when(F.col("rank") == 0, F.least("cluster", "to.cluster")).otherwise(F.least("rep", "to.rep"))
    order = F.struct(F.greatest("rep", "to.rep").alias("later"), "rank", earlier.alias("earlier"))
    return met.groupBy(F.least("cluster", "to.cluster").alias("a"), F.greatest("cluster", "to.cluster").alias("b")).agg(F.min(order).alias("order"))


def joined_pairs(pairs: DataFrame) -> DataFrame:
    """Of ``first_links`` those that are the first of both their clusters: b joins a. No cluster is in two."""
    best = pairs.select(F.explode(F.array("a", "b")).alias("c"), "order", "a", "b").groupBy("c").agg(F.min(F.struct("order", "a", "b")).alias("best"))
    return best.groupBy("best.a", "best.b").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("a", "b")


def clusters_of(keyed: DataFrame, plant_group: bool, rounds: int = 10_000) -> DataFrame:
    """id and cluster (the smallest id of it) of every row of ``keyed``.

    ``keyed`` has id, entity, country, operator, signature, unit_name, lon, lat,
    mw, commissioning_year, ids and plant_ids (entries of namespace and id).
    Rows that nothing links are clusters of their own; no rows give none.
    The number of rounds grows with the longest run of links of rising ids
    within a component that holds a conflict.
    """
    rows, links = _nodes_and_links(keyed, plant_group)
    links = written(links)
    profiles = rows.groupBy("node").agg(F.any_value("profile").alias("profile"))
    edges = links.where("node <> first").select(F.xxhash64("node").alias("src"), F.xxhash64("first").alias("dst"))
    placed = rows.select("node").distinct().withColumn("hash", F.xxhash64("node")).join(connected_components(edges).withColumnRenamed("node", "hash"), "hash").select("node", "component")
    entries = placed.join(profiles, "node").select("component", F.explode("profile").alias("e"))
    torn = entries.groupBy("component", "e.key").agg((F.min("e.value") != F.max("e.value")).alias("torn")).groupBy("component").agg(F.max("torn").alias("torn"))
    state = written(placed.join(torn, "component", "left").withColumn("torn", F.coalesce("torn", F.lit(False))))
    whole = state.where("not torn")
    whole = whole.join(whole.groupBy("component").agg(F.min("node").alias("cluster")), "component").select("node", "cluster")
    torn_nodes = state.where("torn").select("node")
    if not torn_nodes.isEmpty():
        links = written(links.join(torn_nodes, "node", "left_semi").select("key", "rank", "node", "row"))
        own = written(profiles.join(torn_nodes, "node", "left_semi"))
        clustered = written(torn_nodes.withColumn("cluster", F.col("node")))
        for _ in range(rounds):
            held = clustered.join(own, "node").select("cluster", F.explode("profile").alias("e")).groupBy("cluster").agg(F.array_sort(F.collect_set("e")).alias("profile"))
            # A cluster whose rows have no entry at all stands with an empty profile.
            held = clustered.select("cluster").distinct().join(held, "cluster", "left").withColumn("profile", F.coalesce("profile", F.array().cast(ENTRY)))
            found = written(joined_pairs(first_links(links.join(clustered, "node"), held)))
            if found.isEmpty():
                break
            clustered = written(clustered.join(found.withColumnRenamed("b", "cluster"), "cluster", "left").select("node", F.coalesce("a", "cluster").alias("cluster")))
        else:
            raise RuntimeError("clusters did not settle")
        whole = whole.union(clustered.select("node", "cluster"))
    return written(rows.select("id", "node").join(whole, "node", "left").select("id", F.coalesce("cluster", "node").alias("cluster")))
