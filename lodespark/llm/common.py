"""Shared pieces of the corpus operators: text buffers, vectorised word hashing, shared-folder tables."""

from __future__ import annotations

import contextlib
import ctypes
import math
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.tables import shared_dir, spread

U64 = np.uint64
#: Odd multipliers of the polynomial and of the finaliser.
_R = 0x9E3779B97F4A7C15
_M1, _M2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most `rows` rows in this session: texts are long, and a batch is held by the JVM and by Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages") else rows


_recorders: list[list[str]] = []


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths that scratch() gives out inside the block."""
    paths: list[str] = []
    _recorders.append(paths)
    try:
        yield paths
    finally:
        _recorders[:] = [r for r in _recorders if r is not paths]


def scratch(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/lodespark/{name}-{uuid.uuid4().hex}"
    for r in _recorders:
        r.append(path)
    return path


def reads(df: DataFrame, path: str) -> bool:
    """Whether the plan of df reads files below a path that scratch() gave."""
    leaves, name = df._jdf.queryExecution().analyzed().collectLeaves(), path.rsplit("/", 1)[1]
    for leaf in (leaves.apply(i) for i in range(leaves.size())):
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            roots = leaf.relation().location().rootPaths()
            if any(name in roots.apply(i).toString() for i in range(roots.size())):
                return True
    return False


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: cuts lineage and survives lost executors."""
    return Scratch(df.sparkSession).keep(df, name)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables in the shared folder that an operator writes on its way. At the end of a `with` block all go but those that it returns."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for _, path in self.tables:
            delete(self.spark, path)
        self.tables = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table that lasts until it is dropped or the block ends."""
        path = scratch(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        self.tables.append((self.spark.read.schema(df.schema).parquet(path), path))
        return self.tables[-1][0]

    def _forget(self, df: DataFrame) -> str | None:
        """The path of a table that is kept, no longer known here."""
        path = next((p for d, p in self.tables if d is df), None)
        self.tables = [(d, p) for d, p in self.tables if d is not df]
        return path

    def drop(self, df: DataFrame) -> None:
        """Deletes the table of a DataFrame that keep() gave."""
        if path := self._forget(df):
            delete(self.spark, path)

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table that outlives the block."""
        out = self.keep(df, name)
        self._forget(out)
        return out


def extended(df: DataFrame, more: str, names: list[str] | None = None) -> StructType:
    """The schema of df's columns (those named, if any are), whatever their names hold, and of the columns that `more` declares."""
    own = [StructField(f.name, f.dataType) for f in df.schema if names is None or f.name in names]
    return StructType(own + StructType.fromDDL(more).fields)


#: Stands for a dot in names on the way through mapInArrow, which would read it as a path.
_DOT = "\ue000"


def undotted(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.replace(".", _DOT) for c in df.columns))


def dotted(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.replace(_DOT, ".") for c in df.columns))


def partitions_for(df: DataFrame, target_bytes: int) -> int:
    """At least the session's shuffle partitions, more if Catalyst's size estimate asks for it."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, min(400_000, math.ceil(size / target_bytes)))


def fold(doc_id, modulus: int):
    """crc32 of doc_id as text, modulo `modulus`; null ids fall in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(0))


def sample_ids(rows: DataFrame, per_label: int, label: str) -> DataFrame:
    """(doc_id, label): at most `per_label` ids of each label, those of the least hashes.

    A first pass counts the labels, so that only about four times as many rows as are wanted meet in a label's task."""
    from pyspark.sql import Window

    spark, kind = rows.sparkSession, rows.schema[label]
    counts = [(r[0], r[1]) for r in rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*")).collect()]
    most = [(k, (1 << 63) - 1 if n <= 4 * per_label + 100 else int((4 * per_label + 100) / n * 2**64) - 2**63) for k, n in counts]
    bounds = spark.createDataFrame(most, StructType([StructField("_label", kind.dataType), StructField("_most", LongType())]))
    near = rows.select("doc_id", label, F.xxhash64("doc_id").alias("_h")).join(F.broadcast(bounds), (F.col(label) == F.col("_label")) & (F.col("_h") <= F.col("_most"))).select("doc_id", label, "_h").distinct()
    w = Window.partitionBy(label).orderBy("_h", "doc_id")
    return near.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_label).select("doc_id", label)


def sample_texts(docs: DataFrame, ids: DataFrame, label: str, keys: list[str], label_bytes: int = 8 << 20, longest: int = 65536) -> DataFrame:
    """(doc_id, label, text) of sampled ids: one text of each, and at most `label_bytes` bytes of a label (one text at least); longer texts than `longest` come last."""
    from pyspark.sql import Window

    found = docs.join(F.broadcast(ids), keys).groupBy("doc_id", label).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    w = Window.partitionBy(label).orderBy((size > longest).cast("int"), F.xxhash64("doc_id"), "doc_id")
    found = found.withColumn("_rn", F.row_number().over(w)).withColumn("_sum", F.sum(size.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return found.where((F.col("_rn") == 1) | (F.col("_sum") <= label_bytes)).select("doc_id", label, "text")


# ---- text buffers -------------------------------------------------------------------------------


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column, nulls as empty, without copying rows one by one."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.string())
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def chunks(col: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) in groups of rows of about `most` bytes; a longer row stands alone."""
    raw, off = buffers(col)
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, b, raw[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(33))
    x = x * _M1
    x ^= x >> U64(33)
    x *= _M2
    x ^= x >> U64(33)
    return x


def _byte_table(seed: int) -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=U64) * U64(_R) + U64(seed))


_BYTE = _byte_table(0x51ED270B)
_POW: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r^i and r^-i modulo 2^64 for i < n."""
    if len(_POW[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, r in enumerate((_R, pow(_R, -1, 1 << 64))):
            out = np.full(size, r, U64)
            out[0] = 1
            _POW[k] = np.multiply.accumulate(out)
    return _POW[0][:n], _POW[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of table[byte] * r^i (length n + 1): a substring's hash is (P[e] - P[s]) * r^-s."""
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the substrings [start, end), the same wherever they stand."""
    _, down = _powers(len(prefix))
    return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


#: ASCII white space \x09-\x0D and \x20 ends a word.
SPACED = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
#: Only 0-9, a-z and bytes from 0x80 make a word.
ALNUM = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
LOWER = lower_table()


def words(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash of each word, words before each document) of lower-cased documents laid end to end."""
    low = LOWER[data]
    m = is_word[low]
    n = len(low)
    edge = np.zeros(n + 1, bool)
    edge[0] = True
    edge[off] = True
    first = m.copy()
    first[1:] &= ~m[:-1] | edge[1:n]
    last = m.copy()
    last[:-1] &= ~m[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, span_hash(prefix_hash(low), start, end), np.searchsorted(start, off)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive word hashes (len(h) - k + 1 of them)."""
    out = h[: max(0, len(h) - k + 1)].copy()
    for i in range(1, k):
        out = mix64(out * U64(0x2545F4914F6CDD1D) + h[i : len(h) - k + 1 + i])
    return out


def release(tokens: bool = True) -> None:
    """Gives freed memory back to the system: Python workers live on after a task, beside a JVM that needs the room.

    What tokenising tasks have remembered goes too, unless the task is one of them."""
    if tokens and (module := sys.modules.get(f"{__package__}.tokens")):
        module.encoder.cache_clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
