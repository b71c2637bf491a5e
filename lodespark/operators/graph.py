"""Property-graph operators: nodes(id, label, ...), edges(src, dst, type, ...)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import text
from ..sources.tables import shared_dir
from .retrieval import bounded


def build(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of chunks with calls, imports, extends, implements. Ids carry repo and label; compat_id is the shared form."""
    c = chunks
    file_id = F.concat("repo", F.lit("::"), "file_path")
    own = lambda name: F.concat(F.col("file_path"), F.lit("::"), name)
    is_fn, is_class = F.col("kind").isin("function", "method"), F.col("kind").isin("class", "struct")
    node = lambda df, i, label, name: df.select(i.alias("id"), F.lit(label).alias("label"), name.alias("name"), "repo", "file_path")
    imports = c.select("repo", "file_path", F.explode("imports").alias("imp")).withColumn("imp", text.import_clean(F.col("imp"))).where("imp <> ''")
    import_id = F.concat("repo", F.lit("::import::"), "imp")
    nodes = (
        node(c, file_id, "File", text.basename(F.col("file_path")))
        .unionByName(node(c.where(is_fn), own(F.col("name")), "Function", F.col("name")))
        .unionByName(node(c.where(is_class), own(F.col("name")), "Class", F.col("name")))
        .unionByName(imports.select(import_id.alias("id"), F.lit("Import").alias("label"), F.col("imp").alias("name"), "repo", F.lit("").alias("file_path")))
    )
    edge = lambda df, a, b, kind, line=None: df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("type"), (line if line is not None else F.lit(None).cast("int")).alias("line"))
    calls = c.where(is_fn).select("file_path", "name", F.explode("calls").alias("call"))
    edges = (
        edge(c.where(is_fn | is_class), file_id, own(F.col("name")), "DEFINES")
        .unionByName(edge(c.where(is_fn & (text.empty(F.col("parent_class")) != "")), own(F.col("parent_class")), own(F.col("name")), "CONTAINS"))
        .unionByName(edge(calls, own(F.col("name")), own(F.col("call.name")), "CALLS", F.col("call.line")))
        .unionByName(edge(c.where(is_class & (text.empty(F.col("extends")) != "")), own(F.col("name")), own(F.col("extends")), "EXTENDS"))
        .unionByName(edge(c.where(is_class).select("file_path", "name", F.explode("implements").alias("i")), own(F.col("name")), own(F.col("i")), "IMPLEMENTS"))
        .unionByName(edge(imports, file_id, import_id, "IMPORTS"))
    )
    return nodes.dropDuplicates(["label", "id"]), dedup_edges(edges)


def dedup_edges(edges: DataFrame) -> DataFrame:
    """One edge of each (src, type, dst), with the first line."""
    return edges.groupBy("src", "dst", "type").agg(F.min("line").alias("line"))


def with_both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def neighbors(edges: DataFrame, start: DataFrame) -> DataFrame:
    """id, neighbor, type of one undirected hop from start(id): two equi joins, never an OR. Few start ids are local rows, many are joined by key."""
    start, _ = bounded(start)
    out = edges.join(start.withColumnRenamed("id", "src"), "src").select(F.col("src").alias("id"), F.col("dst").alias("neighbor"), "type")
    into = edges.join(start.withColumnRenamed("id", "dst"), "dst").select(F.col("dst").alias("id"), F.col("src").alias("neighbor"), "type")
    return out.unionByName(into).distinct()


def reach(calls: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """id, level of the nodes on call paths of up to `depth` edges from start(id), the start included unless it calls nothing."""
    front = start.select("id").distinct()
    seen: DataFrame | None = None
    for level in range(1, depth + 1):
        front = calls.join(front.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id")).distinct()
        found = front.withColumn("level", F.lit(level))
        seen = found if seen is None else seen.unionByName(found)
    first = calls.join(start.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("src").alias("id")).distinct().withColumn("level", F.lit(0))
    return seen.unionByName(first).groupBy("id").agg(F.min("level").alias("level"))


def touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end among nodes(id)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)).distinct()


def bfs_layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, layer: hops from the roots (no edge in), level by level until nothing is new; others follow one by one.

    Levels are tables in spark.checkpoint.dir, so the plan of a level does not grow with its depth."""
    spark = nodes.sparkSession
    base = f"{shared_dir(spark)}/lodespark/layers-{uuid.uuid4().hex}"
    nodes = _written(nodes.select("id"), f"{base}/nodes")
    own = _written(edges.where("src <> dst").select("src", "dst").distinct(), f"{base}/edges")
    front = _written(nodes.join(own.select(F.col("dst").alias("id")), "id", "left_anti"), f"{base}/levels/layer=0")
    level = 0
    while True:
        layers = spark.read.schema(StructType([nodes.schema["id"], StructField("layer", IntegerType())])).parquet(f"{base}/levels")
        if front.isEmpty():
            break
        level += 1
        near = own.join(front.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        front = _written(near.join(layers.select("id"), "id", "left_anti"), f"{base}/levels/layer={level}")
    rest = _written(nodes.join(layers.select("id"), "id", "left_anti"), f"{base}/rest")
    if rest.isEmpty():
        return layers
    last = layers.agg(F.coalesce(F.max("layer"), F.lit(-1)).alias("last"))
    return layers.unionByName(numbered(rest, "id").crossJoin(F.broadcast(last)).select("id", (F.col("last") + F.col("nth")).cast("int").alias("layer")))


def numbered(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with nth, from 1 in the order of the keys: sorted ranges count their own rows, and only the counts of the ranges before are summed up."""
    base = f"{shared_dir(rows.sparkSession)}/lodespark/numbered-{uuid.uuid4().hex}"
    own = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    own = _written(own.select(*rows.columns, F.shiftright("_at", 33).alias("_part"), (F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("_nth")), base)
    counts = own.groupBy("_part").agg(F.count("*").alias("n"))
    before = counts.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each range
    return own.join(before, "_part").select(*rows.columns, (F.col("_before") + F.col("_nth")).alias("nth"))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def layout(layers: DataFrame, dx: int = 220, dy: int = 80) -> DataFrame:
    """id, x, y: a column for each layer, its nodes below each other by id. A layer may hold most nodes, so all are numbered in ranges and a layer's first number is taken off."""
    own = numbered(layers.select("layer", "id"), "layer", "id")
    first = own.groupBy("layer").agg(F.min("nth").alias("first"))
    return own.join(first, "layer").select("id", (F.col("layer") * dx).alias("x"), ((F.col("nth") - F.col("first")) * dy).alias("y"))


def directory_tree(paths: DataFrame) -> DataFrame:
    """dir, files below it, for each directory prefix of path."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return paths.select("path", F.explode(above).alias("dir")).groupBy("dir").agg(F.count("*").alias("files"))
