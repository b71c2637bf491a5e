"""Histograms, rates and quantiles over event tables (name, value, ts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(rows: DataFrame, by: str, value: Column, edges: list[float]) -> DataFrame:
    """by, le, n: cumulative counts up to each edge; the last edge is infinite (written as 1e308)."""
    kinds = [*edges, 1e308]
    counts = rows.groupBy(by).agg(*(F.count(F.when(value <= e, 1)).alias(f"c{i}") for i, e in enumerate(kinds)))
    pairs = F.array(*(F.struct(F.lit(e).alias("le"), F.col(f"c{i}").alias("n")) for i, e in enumerate(kinds)))
    return counts.select(by, F.explode(pairs).alias("b")).select(by, "b.le", "b.n")


def quantile(hist: DataFrame, by: str, q: float) -> DataFrame:
    """Linear interpolation inside the bucket that holds the q-th observation; the last finite edge for the infinite one."""
    w = Window.partitionBy(by).orderBy("le")
    rows = hist.select(by, "le", "n", F.coalesce(F.lag("n").over(w), F.lit(0)).alias("n0"), F.coalesce(F.lag("le").over(w), F.lit(0.0)).alias("le0"), F.max("n").over(Window.partitionBy(by)).alias("total"))
    at = F.lit(q) * F.col("total")
    hit = rows.where((F.col("n") >= at) & (F.col("n0") < at))
    inside = F.col("le0") + (F.col("le") - F.col("le0")) * (at - F.col("n0")) / (F.col("n") - F.col("n0"))
    return hit.select(by, F.when(F.col("le") >= 1e308, F.col("le0")).otherwise(inside).alias("value"))


def rate(rows: DataFrame, by: str, ts: str = "ts", width: str = "5 minutes", seconds: int = 300, slide: str | None = None) -> DataFrame:
    """by, start, n, rate per second of each window."""
    win = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = rows.groupBy(by, win.alias("w")).agg(F.count("*").alias("n"))
    return out.select(by, F.col("w.start").alias("start"), "n", (F.col("n") / float(seconds)).alias("rate"))


def hit_rate(rows: DataFrame, by: str, hit: Column, miss: Column) -> DataFrame:
    h, m = F.count_if(hit), F.count_if(miss)
    return rows.groupBy(by).agg(F.when(h + m > 0, 100.0 * h / (h + m)).otherwise(0.0).alias("percent"))


def calls_before(rows: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Calls of the same key in the last `seconds`, this one included."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return rows.withColumn("recent", F.count("*").over(w))
