"""Keyed state of streams: rows that count once, the last good capture of a source, tables kept by key.

Each function serves a batch too, with the same rows; a stream gives the batch's
result once it has read all of its input, however it was cut and restarted.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def once(rows: DataFrame, key: Sequence[str], time: str | None = None, late: str | None = None) -> DataFrame:
    """Each key's first row: repeats never count again.

    A stream keeps the keys as state: for good, or with ``time`` and ``late`` as
    long as a repeat may still come within the watermark. Rows of one key are
    taken to be equal; a null key is a key.
    """
    if rows.isStreaming and time:
        return rows.withWatermark(time, late or "0 seconds").dropDuplicatesWithinWatermark(list(key))
    return rows.dropDuplicates(list(key))


CAPTURES = "source_id string, checksum string, retrieved_at timestamp, accepted long, rejected long"
_STATE = "checksum string, retrieved_at timestamp, accepted long, rejected long"


def _last(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    checksum, at, accepted, rejected = state.get if state.exists else (None, None, 0, 0)
    for chunk in chunks:
        good = chunk[chunk["valid"]]
        accepted, rejected = accepted + len(good), rejected + len(chunk) - len(good)
        if len(good):
            newest = good["retrieved_at"].max()
            least = good.loc[good["retrieved_at"] == newest, "checksum"].min()
            at = None if at is None else pd.Timestamp(at)
            if at is None or newest > at or newest == at and least < checksum:
                checksum, at = least, newest
    state.update((checksum, None if at is None else pd.Timestamp(at).to_pydatetime(), accepted, rejected))
    yield pd.DataFrame({"source_id": [key[0]], "checksum": [checksum], "retrieved_at": [at], "accepted": [accepted], "rejected": [rejected]})


def last_good(captures: DataFrame) -> DataFrame:
    """source_id, checksum and retrieved_at of each source's newest capture that is whole; how many were and were not.

    ``captures`` has source_id, content, checksum, retrieved_at. A later broken
    capture does not replace a good one; captures of one time go by their
    checksum, the least first. A stream gives a source's row anew whenever it has
    captures (update mode); late ones are held against the state, so their order
    does not matter. A source without a whole capture has nulls.
    """
    told = captures.select("source_id", "checksum", "retrieved_at", F.coalesce((F.sha2("content", 256) == F.col("checksum")) & F.col("retrieved_at").isNotNull(), F.lit(False)).alias("valid"))
    if told.isStreaming:
        return told.groupBy("source_id").applyInPandasWithState(_last, CAPTURES, _STATE, "update", GroupStateTimeout.NoTimeout)
    good = F.when(F.col("valid"), F.col("retrieved_at"))
    newest = told.groupBy("source_id").agg(F.max(good).alias("retrieved_at"), F.count_if("valid").alias("accepted"), F.count_if(~F.col("valid")).alias("rejected"))
    first = told.where("valid").groupBy("source_id", "retrieved_at").agg(F.min("checksum").alias("checksum"))
    joined = newest.alias("n").join(first.alias("f"), (F.col("n.source_id").eqNullSafe(F.col("f.source_id"))) & (F.col("n.retrieved_at") == F.col("f.retrieved_at")), "left")
    return joined.select("n.source_id", "f.checksum", "n.retrieved_at", "accepted", "rejected")


def newest(order: Sequence[str]) -> Callable[[DataFrame, Sequence[str]], DataFrame]:
    """Rule of ``Upserts``: of a key's rows the one last in ``order`` stands."""

    def rule(rows: DataFrame, key: Sequence[str]) -> DataFrame:
        rest = [c for c in rows.columns if c not in key]
        return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order])).alias("r")).select(*key, "r.*")

    return rule


def added(**sums: str) -> Callable[[DataFrame, Sequence[str]], DataFrame]:
    """Rule of ``Upserts``: the columns of ``sums`` are added up, each in the type named."""
    return lambda rows, key: rows.groupBy(*key).agg(*[F.sum(c).cast(kind).alias(c) for c, kind in sums.items()])


class Upserts:
    """A table kept by key, written batch by batch from a stream (``foreachBatch``), each batch exactly once.

    Rows lie in ``buckets`` folders by a hash of the key. A batch reads and
    writes only the buckets that it has keys of, in a folder of its own, and
    counts from the moment its manifest is there: a batch that is run again
    after a failure writes the same folder, one whose manifest is there is left.
    Manifests name a folder a bucket; the last two stay, and what they name.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], rule: Callable[[DataFrame, Sequence[str]], DataFrame], buckets: int = 16):
        self.spark, self.path, self.key, self.rule, self.buckets = spark, path.rstrip("/"), list(key), rule, buckets

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _manifests(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/manifests")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit()) if fs.exists(p) else []

    def _read(self, batch: int) -> dict[str, str]:
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{batch}", wholetext=True).first()[0])

    def _commit(self, batch: int, folders: dict[str, str]) -> None:
        fs, p = self._fs(f"{self.path}/manifests/_{batch}")
        out = fs.create(p, True)
        out.write(json.dumps(folders).encode())
        out.close()
        if not fs.rename(p, self._fs(f"{self.path}/manifests/{batch}")[1]):
            raise RuntimeError(f"manifest of batch {batch} can't be put in place")

    def _clean(self) -> None:
        """Drops all manifests but the last two, and folders that these do not name."""
        known = self._manifests()
        if len(known) > 2:
            named = {f.split("/")[1] for b in known[-2:] for f in self._read(b).values()}
            for b in known[:-2]:
                fs, p = self._fs(f"{self.path}/manifests/{b}")
                fs.delete(p, False)
                if str(b) not in named:
                    fs.delete(self._fs(f"{self.path}/data/{b}")[1], True)

    def __call__(self, batch: DataFrame, number: int) -> None:
        known = self._manifests()
        if number in known:
            return
        folders = self._read(max(known)) if known else {}
        batch = batch.withColumn("bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")).persist()
        try:
            touched = sorted(r["bucket"] for r in batch.select("bucket").distinct().collect())
            rows = batch
            old = [f"{self.path}/{folders[str(b)]}" for b in touched if str(b) in folders]
            if old:
                schema = batch.drop("bucket").schema
                rows = rows.unionByName(self.spark.read.schema(schema).parquet(*old).withColumn("bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")))
            if touched:
                merged = self.rule(rows, [*self.key, "bucket"]).select(*batch.columns)
                merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{number}")
            self._commit(number, folders | {str(b): f"data/{number}/bucket={b}" for b in touched})
        finally:
            batch.unpersist()
        self._clean()

    def table(self, schema: str) -> DataFrame:
        """The table as of the last batch."""
        known = self._manifests()
        folders = list(self._read(max(known)).values()) if known else []
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])
