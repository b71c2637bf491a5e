"""Structured Streaming jobs: change feeds, windows with late data, and keyed state machines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keyed import KeyedTable


def change_stream(spark: SparkSession, path: str, schema: str | T.StructType, files_per_batch: int = 1) -> DataFrame:
    """Change jobs dropped as Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def json_jobs(lines: DataFrame) -> DataFrame:
    """file_path, change_type, commit_sha of JSON lines (value); malformed lines are left out."""
    own = F.from_json("value", "file_path string, change_type string, commit_sha string", {"mode": "PERMISSIVE"})
    return lines.select(own.alias("j")).where("j.file_path is not null and j.change_type in ('A', 'M', 'D')").select("j.*")


def apply_stream(changes: DataFrame, target: str, checkpoint: str, key: str, order: str, once: bool = True, **options):
    """Keeps the KeyedTable at `target` up to date with a stream of rows with `key`, `change` and `order`. Starts the query.

    A batch rewrites only the buckets of its keys, and one that runs twice gives the same table (see keyed.py, also for `options`)."""
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in changes.schema])

    def step(batch: DataFrame, number: int) -> None:
        KeyedTable(batch.sparkSession, target, schema, key, order, **options).apply(batch, number)

    writer = changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums per window and type; events later than `late` are dropped."""
    win = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(win.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


# ---- state machines: one step function each, folded over a key's events in order -----------------------


class TokenBucket:
    """Refills at `rate` a second up to `burst`; an event passes if a token is left. State: tokens, last time."""

    schema = "key string, ts double, allowed boolean, tokens double"
    state_schema = "tokens double, last double"

    def __init__(self, rate: float = 2.0, burst: float = 200.0):
        self.rate, self.burst = float(rate), float(burst)
        self.idle = burst / rate  # a bucket is full again

    def last(self, held: tuple) -> float | None:
        return held[1]

    def start(self) -> tuple:
        return (self.burst, None)

    def step(self, held: tuple, ts: float, ok: bool) -> tuple[tuple, tuple]:
        tokens, last = held
        tokens = min(self.burst, tokens + (0.0 if last is None else max(0.0, ts - last)) * self.rate)
        allowed = tokens >= 1.0
        tokens -= allowed
        return (tokens, ts), (allowed, tokens)


class CircuitBreaker:
    """Opens after `limit` failures, for `wait` seconds, then lets one probe through. A success while closed does not reset the count."""

    schema = "key string, ts double, called boolean, phase string"
    state_schema = "phase string, failures int, opened double"
    idle = None  # failures are not forgotten

    def __init__(self, limit: int = 5, wait: float = 30.0):
        self.limit, self.wait = limit, wait

    def start(self) -> tuple:
        return ("closed", 0, 0.0)

    def step(self, held: tuple, ts: float, ok: bool) -> tuple[tuple, tuple]:
        phase, failures, opened = held
        if phase == "open":
            if ts - opened < self.wait:
                return held, (False, phase)
            phase = "half_open"
        if ok:
            return (("closed", 0, 0.0) if phase == "half_open" else (phase, failures, opened)), (True, "closed")
        failures += 1
        if phase == "half_open" or failures >= self.limit:
            return ("open", failures, ts), (True, "open")
        return (phase, failures, opened), (True, phase)


class KeyCooldown:
    """A key's cooldown after failures: 2^n seconds up to 60; a success ends it. State: failures, until."""

    schema = "key string, ts double, usable boolean, until double"
    state_schema = "failures int, until double"
    idle = None

    def start(self) -> tuple:
        return (0, 0.0)

    def step(self, held: tuple, ts: float, ok: bool) -> tuple[tuple, tuple]:
        failures, until = held
        if ts < until:
            return held, (False, until)
        if ok:
            return (0, 0.0), (True, 0.0)
        failures += 1
        until = ts + min(60.0, 2.0 ** min(failures, 6))
        return (failures, until), (True, until)


def fold(machine, held: tuple, rows: pd.DataFrame) -> tuple[tuple, list[tuple]]:
    out = []
    for key, ts, ok in rows.sort_values(["ts", "ok"], kind="stable")[["key", "ts", "ok"]].itertuples(index=False):
        held, result = machine.step(held, ts, ok)
        out.append((key, ts, *result))
    return held, out


def run_batch(events: DataFrame, machine) -> DataFrame:
    """The machine over key, ts (seconds), ok, each key's events in order. Rows are sorted by Spark and pass by in batches; a task holds one key's state."""
    names = [c.split()[0] for c in machine.schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, held = None, None
        for rows in batches:
            out = []
            for key, ts, ok in rows.itertuples(index=False):
                if held is None or key != own:
                    own, held = key, machine.start()
                held, result = machine.step(held, ts, ok)
                out.append((key, ts, *result))
            yield pd.DataFrame(out, columns=names)

    return events.select("key", "ts", "ok").repartition("key").sortWithinPartitions("key", "ts", "ok").mapInPandas(run, machine.schema)


def run_stream(events: DataFrame, machine) -> DataFrame:
    """The same machine over a stream, with its state kept between batches."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    names = [c.split()[0] for c in machine.schema.split(", ")]

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(parts)
        now, out = fold(machine, held.get if held.exists else machine.start(), rows)
        held.update(now)
        yield pd.DataFrame(out, columns=names)

    return events.select("key", "ts", "ok").groupBy("key").applyInPandasWithState(run, machine.schema, machine.state_schema, "append", GroupStateTimeout.NoTimeout)
