"""Written intermediate tables in the cluster's shared folder.

Lineage is cut with Parquet tables under ``spark.checkpoint.dir``; a lost
executor then costs a re-read, not a recomputation. The folder is read from the
session; without that setting only a local session has one of its own (tests).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from wattlake.operators.graph import connected_components, drop_tables, shared_root


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this application: ``<spark.checkpoint.dir>/wattlake/<app id>``."""
    return f"{shared_root(spark)}/wattlake/{spark.sparkContext.applicationId}"


class Scratch:
    """Intermediate tables of one call; those that no later plan reads are dropped, so that disk holds what is in use."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.tables = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}", {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the table as read back."""
        path = f"{self.root}/{name}-{len(self.tables)}"
        df.write.parquet(path)
        self.tables[path] = name
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete the tables of these names; what reads them must have been written."""
        self._delete([p for p, n in self.tables.items() if n and n in names])

    def keep(self, *names: str) -> None:
        """Delete all tables but those of these names."""
        self._delete([p for p, n in self.tables.items() if n and n not in names])

    def _delete(self, paths: list[str]) -> None:
        drop_tables(self.spark, paths)
        for p in paths:
            self.tables[p] = ""


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table as read back; it stays."""
    return Scratch(df.sparkSession).write(df, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


__all__ = ["Scratch", "connected_components", "materialize", "shared_dir", "table"]
