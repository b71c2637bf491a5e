"""Streams with late events and timers give the rows of their batch versions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodespark.streaming import jobs, timed

LATE = 60.0


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    timed.use_rocksdb(spark)
    yield
    spark.conf.set(key, before)


def streamed(spark, tmp_path, rows, schema, made):
    """Rows (key, ts, ...) in the order given, in five files, and one of the far future that moves the watermark past all; the rows of other keys."""
    size = -(-len(rows) // 5)
    end = (("end", rows[0][1] + 1e7, *rows[0][2:]),)
    for i, part in enumerate([rows[k * size : (k + 1) * size] for k in range(5)] + [end, end]):
        spark.createDataFrame(list(part), schema).withColumn("at", F.timestamp_millis((F.col("ts") * 1000).cast("long"))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(f"{schema}, at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    name = f"t{abs(hash(str(tmp_path))) % 10**9}"
    q = made(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return sorted(tuple(r) for r in spark.table(name).collect() if r[0] != "end")


def events(n, keys, seed, jitter):
    """Events that come up to `jitter` seconds out of order."""
    rng = random.Random(seed)
    rows = [(f"k{rng.randrange(keys)}", round(1000 + i * 7 + rng.random(), 3), rng.random() < 0.4) for i in range(n)]
    return sorted(rows, key=lambda r: r[1] + rng.random() * jitter)


@pytest.mark.parametrize("machine", [jobs.TokenBucket(rate=0.02, burst=3), jobs.CircuitBreaker(limit=2, wait=60), jobs.KeyCooldown()], ids=["bucket", "circuit", "cooldown"])
def test_machines_over_late_streams(spark, rocksdb, tmp_path, machine):
    rows = events(150, 4, 5, LATE - 5)
    assert rows != sorted(rows, key=lambda r: r[1])
    want = sorted(map(tuple, jobs.run_batch(spark.createDataFrame(rows, "key string, ts double, ok boolean"), machine).collect()))
    got = streamed(spark, tmp_path, rows, "key string, ts double, ok boolean", lambda s: timed.run_ordered(s, machine, f"{int(LATE)} seconds"))
    assert got == want and len(got) == 150


def test_entries_expire_without_an_event(spark, rocksdb, tmp_path):
    rows = [(k, ts, round(ts / 7, 3)) for k, ts, _ in events(120, 9, 8, LATE - 5)]
    want = sorted(map(tuple, timed.expiries_of_table(spark.createDataFrame(rows, "key string, ts double, value double"), 90.0).collect()))
    got = streamed(spark, tmp_path, rows, "key string, ts double, value double", lambda s: timed.expiries(s, 90.0, f"{int(LATE)} seconds"))
    assert got == want and 9 < len(got) < 120


def test_keys_may_be_null_and_tables_empty(spark):
    machine = jobs.TokenBucket(rate=1.0, burst=1)
    frame = spark.createDataFrame([(None, 2.0, True), (None, 1.0, True), ("a", 1.5, False)], "key string, ts double, ok boolean")
    assert [tuple(r) for r in jobs.run_batch(frame, machine).orderBy("ts").collect()] == [(None, 1.0, True, 0.0), ("a", 1.5, True, 0.0), (None, 2.0, True, 0.0)]
    assert jobs.run_batch(frame.limit(0), machine).count() == 0
