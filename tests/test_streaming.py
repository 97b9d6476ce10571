"""Streams against their batch queries: late and repeated rows, restarts from the checkpoint, a failure between write and commit."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from wattlake.streaming import state as T
from wattlake.streaming import windows as W

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def events(rng, start, n):
    return [(start + i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(200_000)), rng.randrange(9), rng.choice("abc"), rng.randrange(1000) / 8) for i in range(n)]


def land(spark, path, rows, schema=EVENTS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def drain(df, sink, checkpoint, mode="append"):
    writer = df.writeStream.foreachBatch(sink).option("checkpointLocation", str(checkpoint)).outputMode(mode).trigger(availableNow=True)
    writer.start().awaitTermination()


def totals(df):
    return sorted(map(tuple, df.select("event_type", F.col("n").cast("long"), F.col("total").cast("double")).collect()))


KEPT = "event_type string, n long, total decimal(28,6)"
RULE = T.added(n="long", total="decimal(28,6)")


def counted(df):
    return T.once(df, ["event_id"]).select("event_type", F.lit(1).cast("long").alias("n"), F.col("value").cast("decimal(28,6)").alias("total"))


def test_increments_count_once_over_restarts(spark, tmp_path):
    rng = random.Random(1)
    first, second = events(rng, 0, 300), events(rng, 300, 200)
    src, kept = tmp_path / "src", T.Upserts(spark, str(tmp_path / "kept"), ["event_type"], RULE, 4)
    land(spark, src, first + first[:50])
    read = lambda: counted(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(src)))
    drain(read(), kept, tmp_path / "cp")
    land(spark, src, first[20:80] + second)  # repeats of what the first run has counted
    land(spark, src, second[:10])
    drain(read(), kept, tmp_path / "cp")
    drain(read(), kept, tmp_path / "cp")  # nothing new
    batch = counted(spark.read.schema(EVENTS).parquet(str(src))).groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    assert totals(kept.table(KEPT)) == totals(batch)
    assert sum(r[1] for r in totals(batch)) == 500


class Failing(T.Upserts):
    """Writes its first batch, then fails before the manifest is there."""

    failed = False

    def _commit(self, batch, folders):
        if not self.failed:
            self.failed = True
            raise RuntimeError("lost the driver")
        super()._commit(batch, folders)


def test_a_batch_that_fails_before_its_manifest_counts_once(spark, tmp_path):
    rows = events(random.Random(2), 0, 100)
    src, kept = tmp_path / "src", Failing(spark, str(tmp_path / "kept"), ["event_type"], RULE, 4)
    land(spark, src, rows)
    read = lambda: counted(spark.readStream.schema(EVENTS).parquet(str(src)))
    with pytest.raises(Exception, match="lost the driver"):
        drain(read(), kept, tmp_path / "cp")
    assert kept.table(KEPT).count() == 0
    drain(read(), kept, tmp_path / "cp")
    assert sum(r[1] for r in totals(kept.table(KEPT))) == 100
    kept(spark.createDataFrame([("a", 1, None)], KEPT), 0)  # a batch that is given once more
    assert sum(r[1] for r in totals(kept.table(KEPT))) == 100


def test_newest_rows_stand_and_old_folders_go(spark, tmp_path):
    kept, schema = T.Upserts(spark, str(tmp_path), ["id"], T.newest(["at"]), 3), "id long, at long, v string"
    make = lambda rows: spark.createDataFrame(rows, schema)
    kept(make([(1, 1, "a"), (2, 1, "b"), (None, 1, "n")]), 0)
    kept(make([(1, 3, "c"), (1, 2, "d"), (3, 1, "e")]), 1)
    kept(make([(1, 1, "late")]), 2)
    kept(make([]), 3)
    assert sorted(map(tuple, kept.table(schema).collect()), key=str) == sorted([(1, 3, "c"), (2, 1, "b"), (3, 1, "e"), (None, 1, "n")], key=str)
    assert sorted(p.name for p in (tmp_path / "manifests").iterdir() if p.name.isdigit()) == ["2", "3"]
    assert T.Upserts(spark, str(tmp_path / "none"), ["id"], T.newest(["at"])).table(schema).count() == 0


def test_last_good_capture_of_a_source(spark, tmp_path):
    day = lambda k: dt.datetime(2024, 1, k)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    capture = lambda s, body, k, ok=True: (s, bytearray(body), digest(body) if ok else "0" * 64, day(k))
    files = [[capture("x", b"one", 1), capture("y", b"y", 5, False), capture("x", b"two", 3)], [capture("x", b"bad", 9, False), capture("x", b"late", 2)], [capture("y", b"ok", 4), capture("x", b"same time", 3)]]
    schema = "source_id string, content binary, checksum string, retrieved_at timestamp"
    kept, kind = T.Upserts(spark, str(tmp_path / "kept"), ["source_id"], T.newest(["accepted", "rejected"]), 2), T.CAPTURES
    for rows in files:
        land(spark, tmp_path / "src", rows, schema)
        drain(T.last_good(spark.readStream.schema(schema).parquet(str(tmp_path / "src"))), kept, tmp_path / "cp", "update")
    got = {r["source_id"]: (r["checksum"], r["retrieved_at"], r["accepted"], r["rejected"]) for r in kept.table(kind).collect()}
    batch = {r["source_id"]: (r["checksum"], r["retrieved_at"], r["accepted"], r["rejected"]) for r in T.last_good(spark.read.schema(schema).parquet(str(tmp_path / "src"))).collect()}
    assert got == batch == {"x": (min(digest(b"two"), digest(b"same time")), day(3), 4, 1), "y": (digest(b"ok"), day(4), 1, 1)}


def test_windows_and_sessions_of_a_stream_with_late_rows(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    early = [(1, at(0), 1, "a", 1.0), (2, at(10), 1, "a", 2.0), (3, at(200), 1, "b", 4.0)]
    rest = [(4, at(196), 1, "a", 8.0), (6, at(500), 1, "a", 32.0)]
    for rows in (early, rest, [(5, at(5), 1, "a", 16.0)], [(7, at(5000), 2, "z", 0.0)]):  # the fifth is beyond the watermark
        land(spark, tmp_path / "src", rows)
    stream = lambda: spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "src"))
    out = {}
    for name, f in (("windows", W.windowed), ("sessions", W.sessions)):
        rows = []
        drain(f(stream()), lambda d, _, rows=rows: rows.extend(map(tuple, d.collect())), tmp_path / f"cp-{name}")
        out[name] = sorted(rows, key=str)
    timely = spark.createDataFrame(early + rest, EVENTS)
    assert out["windows"] == sorted(map(tuple, W.windowed(timely).collect()), key=str)
    assert out["sessions"] == sorted(map(tuple, W.sessions(timely).collect()), key=str) == [(1, at(0), at(10), 2, 3.0), (1, at(196), at(200), 2, 12.0), (1, at(500), at(500), 1, 32.0)]
