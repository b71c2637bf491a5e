"""Keyed tables and change feeds: upserts, deletes, caches, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last version of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows win over old ones with their key: an anti join and a union, no sort of the old rows."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def delete(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(gone.select(*key).distinct(), key, "left_anti")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change (A, M, D) between two snapshots (path, hash)."""
    both = before.select("path", F.col("hash").alias("h0")).join(after.select("path", F.col("hash").alias("h1")), "path", "full_outer")
    change = F.when(F.col("h0").isNull(), "A").when(F.col("h1").isNull(), "D").when(F.col("h0") != F.col("h1"), "M")
    return both.select("path", change.alias("change")).where("change is not null")


def apply_changes(table: DataFrame, changes: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last change of each key counts: D removes, A and M replace. changes: key, change and the table's columns."""
    last = latest(changes, [key], order)
    kept = table.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where("change <> 'D'").select(*table.columns))


def overlay(rows: DataFrame, key: list[str], props: list[str], order: str) -> DataFrame:
    """One row for each key; each property is its last value that is not null."""
    return rows.groupBy(*key).agg(*(F.max_by(p, F.when(F.col(p).isNotNull(), F.col(order))).alias(p) for p in props))


def alive(rows: DataFrame, now: Column, seconds: int, at: str = "ts") -> DataFrame:
    return rows.where(F.col(at) > now - F.make_dt_interval(secs=F.lit(seconds)))


def cache_join(wanted: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(hits with their values, misses once each)."""
    hits = wanted.join(cache, key)
    misses = wanted.select(key).distinct().join(cache.select(key), key, "left_anti")
    return hits, misses
