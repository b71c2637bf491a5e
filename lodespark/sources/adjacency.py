"""A stored graph: every edge twice, by its source and by its target, in a folder for each bucket of that node, sorted by it.

    <root>/out/bucket=<b>/    edges whose src falls in b, sorted by (src, dst)
    <root>/into/bucket=<b>/   edges whose dst falls in b, sorted by (dst, src)

A hop from a front reads only the buckets of its nodes, and of them only the row groups that may hold one: a front of up to LOCAL_ROWS nodes meets
the edges as local rows, so no edge is shuffled; a larger one is joined by key. Spark rebalances what it writes: a bucket beyond the session's
advisory size is dealt to several tasks, so the edges of a node with a third of all edges are no single task's.

Defined results: repeated edges stay as they are; an end that is null is reached by no hop; a graph without edges has empty tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retrieval import NAMED, bounded


def _bucket(c: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Adjacency:
    """The two tables: src, dst and what else an edge has, and bucket."""

    sides: dict[str, DataFrame]
    buckets: int

    def touched(self, side: str, front: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(edges in the buckets that a front(id) touches, the front)."""
        end = "src" if side == "out" else "dst"
        front, rows = bounded(front.select("id").where("id is not null").distinct())
        edges = self.sides[side]
        hit = [r[0] for r in front.select(_bucket("id", self.buckets)).distinct().collect()]  # as many rows as there are buckets at most
        if len(hit) < self.buckets:
            edges = edges.where(F.col("bucket").isin(hit))
        if rows is not None and rows.num_rows <= NAMED:
            edges = edges.where(F.col(end).isin(rows.column("id").to_pylist()))
        return edges.drop("bucket"), front

    def hop(self, front: DataFrame, side: str = "out") -> DataFrame:
        """The edges that leave (out) or enter (into) the nodes of front(id)."""
        edges, front = self.touched(side, front)
        end = "src" if side == "out" else "dst"
        return edges.join(front.withColumnRenamed("id", end), end, "left_semi")

    def neighbors(self, start: DataFrame) -> DataFrame:
        """id, neighbor of one hop either way, once each."""
        out = self.hop(start, "out").select(F.col("src").alias("id"), F.col("dst").alias("neighbor"))
        return out.unionByName(self.hop(start, "into").select(F.col("dst").alias("id"), F.col("src").alias("neighbor"))).distinct()

    def reach(self, start: DataFrame, depth: int) -> DataFrame:
        """id, level (least) of the nodes up to `depth` hops out of start(id), the start included unless nothing leaves it."""
        front, seen = start, None
        for level in range(1, depth + 1):
            edges = self.hop(front, "out")
            if level == 1:
                seen = edges.select(F.col("src").alias("id"), F.lit(0).alias("level"))
            found, _ = bounded(edges.select(F.col("dst").alias("id")).where("id is not null").distinct())
            seen, front = seen.unionByName(found.withColumn("level", F.lit(level))), found
        return seen.groupBy("id").agg(F.min("level").alias("level"))

    def touching(self, nodes: DataFrame) -> DataFrame:
        """Edges with an end among nodes(id), each once."""
        return self.hop(nodes, "out").unionByName(self.hop(nodes, "into")).distinct()

    def degrees(self) -> DataFrame:
        """id, callees, callers of every node with an edge."""
        count = lambda side, end, name: self.sides[side].groupBy(F.col(end).alias("id")).agg(F.count("*").alias(name))
        both = count("out", "src", "callees").join(count("into", "dst", "callers"), "id", "full_outer")
        return both.select("id", F.coalesce("callees", F.lit(0)).alias("callees"), F.coalesce("callers", F.lit(0)).alias("callers")).where("id is not null")


def persist_graph(edges: DataFrame, root: str, buckets: int = 64) -> None:
    """Writes both sides of edges(src, dst, ...). The edges are computed once: the second side comes from the first."""
    spark = edges.sparkSession
    for side, own, other in (("out", "src", "dst"), ("into", "dst", "src")):
        rows = edges.withColumn("bucket", _bucket(own, buckets)).hint("rebalance", "bucket")
        rows.sortWithinPartitions("bucket", own, other).write.partitionBy("bucket").parquet(f"{root}/{side}")
        edges = _read(spark, root, "out", edges).drop("bucket")


def _read(spark: SparkSession, root: str, side: str, edges: DataFrame) -> DataFrame:
    return spark.read.schema(edges.drop("bucket").withColumn("bucket", F.lit(0)).schema).parquet(f"{root}/{side}")


def load_graph(edges: DataFrame, root: str, buckets: int = 64) -> Adjacency:
    """The stored graph of edges of this schema (the rows of `edges` are not read)."""
    return Adjacency({side: _read(edges.sparkSession, root, side, edges) for side in ("out", "into")}, buckets)
