"""Keyed state with event-time timers: machines over streams whose events come late and out of order, and entries that expire by themselves.

State lives in the RocksDB store (use_rocksdb), so a key's waiting events and a task's keys need not fit in memory."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """transformWithState needs this store; call it before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Ordered(StatefulProcessor):
    """Holds a key's events until the watermark has passed them, then steps the machine over them in order of time.

    A machine with `idle` seconds is as at its start when nothing has come for so long: its state goes then."""

    def __init__(self, machine):
        self.machine = machine
        self.names = [c.split()[0] for c in machine.schema.split(", ")]

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts double, ok boolean")
        self.held = handle.getValueState("held", self.machine.state_schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for ts, ok in part[["ts", "ok"]].itertuples(index=False):
                self.waiting.appendValue((float(ts), bool(ok)))
            self._wake(float(part["ts"].min()))
        return iter(())

    def _wake(self, ts: float) -> None:
        self.handle.registerTimer(int(ts * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() / 1000
        events = [(float(ts), bool(ok)) for ts, ok in self.waiting.get()]
        due, rest = sorted(e for e in events if e[0] <= now), [e for e in events if e[0] > now]
        held = tuple(self.held.get()) if self.held.exists() else self.machine.start()
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
            out = []
            for ts, ok in due:
                held, said = self.machine.step(held, ts, ok)
                out.append((key[0], ts, *said))
            self.held.update(held)
            if self.machine.idle is not None:
                self._wake(due[-1][0] + self.machine.idle)
            yield pd.DataFrame(out, columns=self.names)
        elif not rest and self.machine.idle is not None and self.machine.last(held) is not None and self.machine.last(held) + self.machine.idle <= now:
            self.held.clear()
        if rest:
            self._wake(min(e[0] for e in rest))

    def close(self) -> None:
        pass


def run_ordered(events: DataFrame, machine, late: str = "10 minutes") -> DataFrame:
    """The machine over a stream of key, ts (seconds), ok, at (the time as a timestamp): the rows of run_batch, each once the watermark has passed its event.

    Events that come more than `late` behind are dropped."""
    rows = events.select("key", "ts", "ok", "at").withWatermark("at", late)
    return rows.groupBy("key").transformWithStateInPandas(_Ordered(machine), machine.schema, "append", "eventTime")


class _Expiring(StatefulProcessor):
    """A key's last entry. It expires `ttl` seconds after it was put, without a further event."""

    def __init__(self, ttl: float):
        self.ttl = ttl

    def init(self, handle) -> None:
        self.handle = handle
        self.puts = handle.getListState("puts", "ts double, value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for ts, value in part[["ts", "value"]].itertuples(index=False):
                self.puts.appendValue((float(ts), float(value)))
                self.handle.registerTimer(int((float(ts) + self.ttl) * 1000) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Of the puts whose time is up, those that no later put within the time to live has replaced."""
        now = timerValues.getCurrentWatermarkInMs() / 1000
        puts = sorted((float(ts), float(v)) for ts, v in self.puts.get())
        gone = [i for i, (ts, _) in enumerate(puts) if ts + self.ttl <= now]
        out = [(key[0], *puts[i], puts[i][0] + self.ttl) for i in gone if i + 1 == len(puts) or puts[i + 1][0] >= puts[i][0] + self.ttl]
        rest = puts[len(gone) :]
        self.puts.put(rest) if rest else self.puts.clear()
        if out:
            yield pd.DataFrame(out, columns=["key", "ts", "value", "expired"])

    def close(self) -> None:
        pass


def expiries(puts: DataFrame, ttl: float, late: str = "10 minutes") -> DataFrame:
    """key, ts, value, expired of the entries of a cache that expire, from a stream of key, ts (seconds), value, at: a put replaces the entry before it."""
    rows = puts.select("key", "ts", "value", "at").withWatermark("at", late)
    return rows.groupBy("key").transformWithStateInPandas(_Expiring(ttl), "key string, ts double, value double, expired double", "append", "eventTime")


def expiries_of_table(puts: DataFrame, ttl: float) -> DataFrame:
    """The same of a whole table."""
    from pyspark.sql import Window

    after = F.lead("ts").over(Window.partitionBy("key").orderBy("ts", "value"))
    rows = puts.select("key", "ts", "value", after.alias("_next"), (F.col("ts") + ttl).alias("expired"))
    return rows.where(F.col("_next").isNull() | (F.col("_next") >= F.col("expired"))).select("key", "ts", "value", "expired")
