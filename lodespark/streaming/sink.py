"""Metrics of streams as a table: what Dataset.observe counts in each batch, appended by a listener."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

SCHEMA = "query string, batch long, at string, metric string, label string, value double"


def counted(rows: DataFrame, label: str, labels: list[str], value: Column, bounds: list[float]) -> DataFrame:
    """rows, observed: for each of the declared labels the count, the sum and a cumulative histogram of `value`."""
    made = []
    for name in labels:
        own = F.when(F.col(label) == name, value)
        made += [F.count(own).alias(f"count|{name}"), F.coalesce(F.sum(own), F.lit(0.0)).cast("double").alias(f"sum|{name}")]
        made += [F.count_if(own <= b).alias(f"le_{b:g}|{name}") for b in bounds]
    return rows.observe("metrics", *made)


class MetricsSink(StreamingQueryListener):
    """Appends the observed metrics of each batch of the named queries to root/metrics, one row each. A batch has a few rows, whatever it reads.

    A batch that runs twice reports twice: readers take the last report of a (query, batch)."""

    def __init__(self, spark: SparkSession, root: str, queries: set[str]):
        self.spark, self.root, self.queries = spark, root, queries

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        found = p.observedMetrics.get("metrics")
        if p.name not in self.queries or found is None:
            return
        rows = [(p.name, p.batchId, p.timestamp, *k.split("|", 1), float(v)) for k, v in found.asDict().items()]
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.root}/metrics")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def totals(spark: SparkSession, root: str) -> DataFrame:
    """metric, label, value: sums over the batches, each by its last report."""
    rows = spark.read.schema(SCHEMA).parquet(f"{root}/metrics")
    last = rows.groupBy("query", "batch", "metric", "label").agg(F.max_by("value", "at").alias("value"))
    return last.groupBy("metric", "label").agg(F.sum("value").alias("value"))
