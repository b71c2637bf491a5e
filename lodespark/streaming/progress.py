"""Progress of streaming queries as rows: what was read and written, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery


def progress(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """batch, rows, rows_per_second of the query's recent batches (Spark keeps a bounded number)."""
    rows = [(int(p["batchId"]), int(p["numInputRows"]), float(p.get("processedRowsPerSecond") or 0.0)) for p in query.recentProgress]
    return spark.createDataFrame(rows, "batch long, rows long, rows_per_second double")


def log_lines(query: StreamingQuery, seen: int = -1) -> tuple[list[str], int]:
    """Lines about batches after number `seen`, and the last number: a tail that is asked again until the query ends."""
    new = [p for p in query.recentProgress if p["batchId"] > seen]
    return [f"batch {p['batchId']}: {p['numInputRows']} rows" for p in new], max([seen, *(p["batchId"] for p in new)])
