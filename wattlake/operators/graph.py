"""Connected components for entity resolution, and tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a local session gets a folder of its own and any other fails."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/wattlake-shared"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table of the shared folder: computed once, however often it is read, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/wattlake/{spark.sparkContext.applicationId}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Components of an undirected graph by alternating large and small stars.

    ``edges`` has ``src`` and ``dst`` (long). Returns ``node`` and ``component``
    (the smallest node id of it) for every node that has an edge; no edges give
    no rows. Each round keeps at most one row per edge and is written to the
    shared folder, so neither rows nor lineage grow; what a later round has
    replaced is deleted. Self loops, repeated edges and either direction are
    allowed; null ends are ignored.
    """
    spark = edges.sparkSession
    root, written = f"{shared_root(spark)}/wattlake/{spark.sparkContext.applicationId}/components-{uuid.uuid4().hex}", []

    def write(df: DataFrame) -> DataFrame:
        written.append(f"{root}/{len(written)}")
        df.write.parquet(written[-1])
        return spark.read.schema(df.schema).parquet(written[-1])

    e = write(edges.select(F.col("src").cast("long").alias("u"), F.col("dst").cast("long").alias("v")).where("u is not null and v is not null"))
    nodes = write(e.select(F.col("u").alias("node")).union(e.select(F.col("v").alias("node"))).distinct())
    e = write(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(rounds):
        # Large star: larger neighbours move to the smallest of the neighbourhood. The minima are
        # written first: with a plain exchange on either side, a hot centre's edges can be split.
        before = [p for p in written if p != written[1]]
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = write(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # Small star: a node and its smaller neighbours move to the smallest of these.
        low = write(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        e = write(small)
        drop_tables(spark, before)
        # Stars only: no node has two parents, no parent is a child.
        if e.groupBy("u").count().where("count > 1").isEmpty() and e.select("v").distinct().join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
