"""A keyed table in buckets of which a micro-batch rewrites only those it touches.

    <target>/data/batch=<n>/_bucket=<b>/  the rows of bucket b as batch n left them
    <target>/manifests/<n>.json           for each bucket, the batch that wrote it last; the watermark after batch n

A manifest is the commit: it is written when its batch's rows are, under another name first. A batch reads the manifest before its own number and
writes under its own number, so one that runs again, after a crash at any point, gives the same table. A table keeps its last two versions: a batch
deletes what neither it nor the one before names, so a reader has until the end of the second next batch.

Defined results: of a key's changes the one with the greatest `order` counts, ties by the hash of the row; null keys are one key. Deletes stay as
marks, so that an earlier change that arrives later does not bring a row back. With `at` and `keep`, a mark goes once it is `keep` seconds behind the
latest `at` of the batches before, and changes that are as far behind are dropped as late. An empty batch commits its number and writes no rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _manifests(spark: SparkSession, target: str) -> list[int]:
    at, files = _store(spark, f"{target}/manifests")
    names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _read(spark: SparkSession, target: str, number: int) -> dict:
    lines = spark.read.text(f"{target}/manifests/{number}.json", wholetext=True)
    return json.loads(lines.first()[0])


def _write(spark: SparkSession, target: str, number: int, manifest: dict) -> None:
    at, files = _store(spark, f"{target}/manifests/{number}.json")
    draft, _ = _store(spark, f"{target}/manifests/.{number}.draft")
    out = files.create(draft, True)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    files.delete(at, False)
    if not files.rename(draft, at):
        raise OSError(f"{at} could not be committed")


def _newest(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The row of the greatest `order` for each key, combined before the shuffle."""
    row = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    return rows.groupBy(*by).agg(F.max_by(row, F.struct(F.col(order), F.xxhash64(row))).alias("_r")).select("_r.*")


class KeyedTable:
    """rows(key, change, order, ...) under `target`; change is A, M or D."""

    def __init__(self, spark: SparkSession, target: str, schema: T.StructType, key: str, order: str, buckets: int = 64, at: str | None = None, keep: float | None = None):
        if (at is None) != (keep is None):
            raise ValueError("at and keep go together")
        self.spark, self.target, self.schema, self.key, self.order, self.buckets, self.at, self.keep = spark, target.rstrip("/"), schema, key, order, buckets, at, keep

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _folder(self, bucket: int | str, number: int) -> str:
        return f"{self.target}/data/batch={number}/_bucket={bucket}"

    def _rows(self, manifest: dict, only: list[int] | None = None) -> DataFrame:
        """The rows of the buckets, each from the batch that wrote it last."""
        wanted = None if only is None else set(map(str, only))
        paths = [self._folder(b, n) for b, n in sorted(manifest["buckets"].items()) if wanted is None or b in wanted]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def apply(self, batch: DataFrame, number: int) -> dict:
        """Merges a batch; gives the manifest. The work grows with the batch and the buckets that it touches."""
        before = max((n for n in _manifests(self.spark, self.target) if n < number), default=None)
        old = _read(self.spark, self.target, before) if before is not None else {"count": self.buckets, "buckets": {}, "mark": None}
        if old["count"] != self.buckets:
            raise ValueError(f"the table has {old['count']} buckets, not {self.buckets}")
        rows, seconds = batch.select(*self.schema.names), F.unix_micros(F.col(self.at).cast("timestamp")) / 1e6 if self.at else None
        if self.at and old["mark"] is not None:
            rows = rows.where(seconds.isNull() | (seconds >= old["mark"] - self.keep))
        seen = rows.groupBy(self._bucket().alias("b")).agg(F.max(seconds if self.at else F.lit(None).cast("double")).alias("top")).collect()  # a row for each bucket at most
        touched, tops = sorted(r.b for r in seen), [r.top for r in seen if r.top is not None]
        new = {"count": self.buckets, "buckets": dict(old["buckets"]), "mark": max([*tops, *([old["mark"]] if old["mark"] is not None else [])], default=None)}
        if touched:
            both = self._rows(old, touched).unionByName(_newest(rows, [self.key], self.order)).withColumn("_bucket", self._bucket())
            merged = _newest(both.repartition("_bucket"), ["_bucket", self.key], self.order)
            if self.at and old["mark"] is not None:
                merged = merged.where((F.col("change") != "D") | seconds.isNull() | (seconds >= old["mark"] - self.keep))
            out = f"{self.target}/data/batch={number}"
            merged.write.mode("overwrite").partitionBy("_bucket").parquet(out)
            _, files = _store(self.spark, out)
            for b in touched:  # a bucket of which nothing is left has no folder
                if files.exists(_store(self.spark, self._folder(b, number))[0]):
                    new["buckets"][str(b)] = number
                else:
                    new["buckets"].pop(str(b), None)
        _write(self.spark, self.target, number, new)
        self._clean(number, before, [old, new])
        return new

    def _clean(self, number: int, before: int | None, held: list[dict]) -> None:
        """Deletes the versions before the last two, and the folders that only they name."""
        named = {self._folder(b, n) for m in held for b, n in m["buckets"].items()}
        for n in _manifests(self.spark, self.target):
            if n < (before if before is not None else number):
                for b, m in _read(self.spark, self.target, n)["buckets"].items():
                    if self._folder(b, m) not in named:
                        at, files = _store(self.spark, self._folder(b, m))
                        files.delete(at, True)
                at, files = _store(self.spark, f"{self.target}/manifests/{n}.json")
                files.delete(at, False)

    def current(self) -> DataFrame:
        """The table after the last committed batch, without deleted rows."""
        done = _manifests(self.spark, self.target)
        rows = self._rows(_read(self.spark, self.target, done[-1])) if done else self.spark.createDataFrame([], self.schema)
        return rows.where("change <> 'D'")
