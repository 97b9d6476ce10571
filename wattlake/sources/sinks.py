"""Captures, shards and snapshots: immutable content, a pointer that moves last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def captures(files: DataFrame) -> DataFrame:
    """source_id, checksum, content, retrieved_at of (source_id, content, retrieved_at): a body once, its latest retrieval."""
    d = files.withColumn("checksum", F.sha2("content", 256))
    return d.groupBy("source_id", "checksum").agg(F.first("content").alias("content"), F.max("retrieved_at").alias("retrieved_at"))


def latest_valid(catalog: DataFrame) -> DataFrame:
    """The newest capture of each source whose content still has its checksum."""
    good = catalog.where(F.sha2("content", 256) == F.col("checksum"))
    return good.withColumn("_r", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("retrieved_at"), "checksum"))).where("_r = 1").drop("_r")


def upsert(catalog: DataFrame, new: DataFrame) -> DataFrame:
    """A catalogue of captures with new ones: a known body stays as it is, only its retrieval moves on."""
    return captures(catalog.select("source_id", "content", "retrieved_at").unionByName(new.select("source_id", "content", "retrieved_at")))


def upsert_rows(store: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows by key as JSON payloads; new ones replace old ones. ``load_rows`` reads them back."""
    new = rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("payload"))
    return store.join(new, "key", "left_anti").unionByName(new)


def load_rows(store: DataFrame, schema: str) -> DataFrame:
    """The stored rows in the order of their keys."""
    return store.orderBy("key").select(F.from_json("payload", schema).alias("r")).select("r.*")


def country_shards(plants: DataFrame, path: str, key: str = "country", rows_per_file: int = 500_000) -> DataFrame:
    """Write plants by country and return the index: count, capacity, box on the circle, bytes and checksum per country.

    A large country is dealt to several files, so no task writes more than
    ``rows_per_file``; the checksum does not depend on rows' order.
    """
    from wattlake.operators.snapshot import country_index

    sized = plants.groupBy(key).agg(F.ceil(F.count("*") / rows_per_file).cast("int").alias("_files"))
    dealt = plants.join(sized, key).withColumn("_file", F.pmod(F.xxhash64(*[c for c in plants.columns if c != key]), F.col("_files")))
    dealt.repartition(key, "_file").drop("_files", "_file").write.mode("errorifexists").partitionBy(key).parquet(path)
    return country_index(plants, key).join(shard_sums(plants, key), key)


def shard_sums(plants: DataFrame, key: str = "country") -> DataFrame:
    """Bytes and checksum of every shard's rows, in any order."""
    text = F.to_json(F.struct(*sorted(plants.columns)), {"ignoreNullFields": "false"})
    part = lambda i: F.sum(F.conv(F.substring(F.sha2(text, 256), i, 12), 16, 10).cast("decimal(20,0)"))
    return plants.groupBy(key).agg(F.sum(F.octet_length(text)).alias("bytes"), F.sha2(F.concat_ws(":", part(1).cast("string"), part(13).cast("string"), part(25).cast("string")), 256).alias("checksum"))


def compact(facts: DataFrame, ident: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Definitions (one row per id) and facts without the columns that the id decides; conflicting definitions raise."""
    defs = facts.select(ident, *columns).distinct()
    bad = defs.groupBy(ident).count().where("count > 1")
    if not bad.isEmpty():
        raise ValueError(f"conflicting definitions of {bad.first()[ident]}")
    return defs, facts.drop(*columns)


def expand(defs: DataFrame, facts: DataFrame, ident: str) -> DataFrame:
    """The strict inverse of ``compact``: unknown and unused definitions raise."""
    if not facts.join(defs, ident, "left_anti").isEmpty() or not defs.join(facts, ident, "left_anti").isEmpty():
        raise ValueError("definitions and facts do not match")
    return facts.join(defs, ident)


def publish(spark: SparkSession, root: str, snapshot: str, tables: dict[str, DataFrame]) -> str:
    """Write all tables under a temporary name, rename, then move the pointer. Ids are safe names, snapshots are immutable."""
    if not snapshot or not all(c.isalnum() or c in "-_." for c in snapshot) or snapshot.startswith("."):
        raise ValueError("unsafe snapshot id")
    final, work = f"{root}/snapshots/{snapshot}", f"{root}/snapshots/.{snapshot}.tmp"
    fs, target = _fs(spark, final)
    if fs.exists(target):
        raise FileExistsError(final)
    _, temp = _fs(spark, work)
    try:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{work}/{name}")
        if not fs.rename(temp, target):
            raise OSError("rename failed")
    except BaseException:
        fs.delete(temp, True)
        raise
    checksums = [(name, *_checksum(spark.read.parquet(f"{final}/{name}"))) for name in tables]
    spark.createDataFrame(checksums, "name string, rows long, checksum string").coalesce(1).write.parquet(f"{final}/_checksums.parquet")
    # A pointer is a new numbered folder, written aside and renamed: the highest number counts, so there is always one.
    number = max(_pointers(spark, root), default=0) + 1
    aside, pointer = f"{root}/latest/.{number}.tmp", f"{root}/latest/{number}"
    spark.createDataFrame([(snapshot,)], "snapshot string").coalesce(1).write.mode("overwrite").json(aside)
    if not fs.rename(_fs(spark, aside)[1], _fs(spark, pointer)[1]):
        fs.delete(target, True)
        raise OSError("pointer not moved")
    return final


def _checksum(df: DataFrame) -> tuple[int, str]:
    """Rows, and a checksum that does not depend on their order."""
    text = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.coalesce(F.sum(F.conv(F.substring(text, i, 12), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string")
    r = df.agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", part(1), part(13), part(25)), 256).alias("c")).first()
    return r["n"], r["c"]


def _pointers(spark: SparkSession, root: str) -> list[int]:
    fs, folder = _fs(spark, f"{root}/latest")
    return [int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()] if fs.exists(folder) else []


def latest(spark: SparkSession, root: str) -> str:
    """The published snapshot's id."""
    numbers = _pointers(spark, root)
    if not numbers:
        raise FileNotFoundError(f"{root}/latest")
    return spark.read.schema("snapshot string").json(f"{root}/latest/{max(numbers)}").first()["snapshot"]


def read_latest(spark: SparkSession, root: str, table: str, verify: bool = False) -> DataFrame:
    """A table of the published snapshot; ``verify`` compares rows and checksum with those of its publication."""
    if not table or "/" in table or table.startswith("."):
        raise ValueError("unsafe table name")
    base = f"{root}/snapshots/{latest(spark, root)}"
    df = spark.read.parquet(f"{base}/{table}")
    if verify:
        want = spark.read.parquet(f"{base}/_checksums.parquet").where(F.col("name") == table).first()
        if want is None or (want["rows"], want["checksum"]) != _checksum(df):
            raise ValueError(f"{table} was tampered with")
    return df


def lazy_layer(spark: SparkSession, path: str, index: DataFrame, country: str, key: str = "country", most_bytes: int = 64_000_000) -> DataFrame:
    """One country's shard, read by partition and held against its index: rows, bytes and checksum, or an error.

    A shard that its index says is over ``most_bytes`` is not read.
    """
    want = index.where(F.col(key) == country).first()
    if want is None:
        raise ValueError(f"no shard of {country} in the index")
    if want["bytes"] > most_bytes:
        raise ValueError(f"shard of {country} has {want['bytes']} bytes of {most_bytes}")
    kinds = {f.name: f.dataType for f in index.schema.fields}
    d = spark.read.parquet(path).withColumn(key, F.col(key).cast(kinds[key])).where(F.col(key) == country)
    have = shard_sums(d, key).first()
    if have is None or d.count() != want["features"] or (have["bytes"], have["checksum"]) != (want["bytes"], want["checksum"]):
        raise ValueError(f"shard of {country} does not match its index")
    return d


def model_artifacts(population: DataFrame, weights: DataFrame, fingerprints: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Population and weights that belong together: hashes are hashes, the weights name the population's, and their regions are among its."""
    for name, value in fingerprints.items():
        if len(value) != 64 or any(c not in "0123456789abcdef" for c in value):
            raise ValueError(f"{name} is no fingerprint")
    if fingerprints.get("population") != fingerprints.get("weights_population", fingerprints.get("population")):
        raise ValueError("weights were built from another population")
    bad = weights.select("geography_id").distinct().join(population, "geography_id", "left_anti").first()
    if bad is not None:
        raise ValueError(f"weights of an unknown region {bad['geography_id']}")
    return population, weights


def write_artifact(df: DataFrame, path: str, violations: DataFrame, meta: dict[str, str]) -> None:
    """Write rows and a meta row if no rule is broken."""
    bad = violations.first()
    if bad is not None:
        raise ValueError(f"{bad['rule']} broken by {bad['id']}")
    df.write.mode("errorifexists").parquet(f"{path}/records")
    spark = df.sparkSession
    spark.createDataFrame([(k, str(v)) for k, v in sorted(meta.items())], "key string, value string").coalesce(1).write.mode("errorifexists").parquet(f"{path}/meta")
