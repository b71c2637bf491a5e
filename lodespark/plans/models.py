"""Pluggable models with deterministic stand-ins: a hashing encoder and a lexical reranker, in Arrow batches."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 64
Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(texts: list[str]) -> np.ndarray:
    """Unit vectors of signed token hashes."""
    out = np.zeros((len(texts), DIM), np.float32)
    for i, t in enumerate(texts):
        for w in t.lower().split():
            h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
            out[i, h % DIM] += 1 if h >> 16 & 1 else -1
    n = np.linalg.norm(out, axis=1, keepdims=True)
    out[:, 0] += (n[:, 0] == 0).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def embed(texts: DataFrame, encoder: Encoder = hashing_encoder, batch: int = 256) -> DataFrame:
    """id, vec of (id, text)."""

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, batch):
                part = b.slice(a, batch)
                v = encoder([t or "" for t in part.column(1).to_pylist()])
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.ravel(), pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column(0), flat], names=["id", "vec"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text").mapInArrow(run, f"id {kind}, vec array<float>")


def embed_pairs(chunks: DataFrame, encoder: Encoder = hashing_encoder) -> DataFrame:
    """Code and doc texts of all chunks in one pass of the encoder, brought back together by id."""
    kind = chunks.schema["id"].dataType.simpleString()
    texts = chunks.select(F.struct("id", F.lit(0).alias("k")).alias("id"), F.col("content").alias("text")).unionByName(chunks.select(F.struct("id", F.lit(1).alias("k")).alias("id"), F.col("signature").alias("text")))
    v = embed(texts, encoder).select("id.id", "id.k", "vec")
    return v.groupBy("id").agg(F.first(F.when(F.col("k") == 0, F.col("vec")), ignorenulls=True).alias("code_vec"), F.first(F.when(F.col("k") == 1, F.col("vec")), ignorenulls=True).alias("doc_vec"))


def embed_cached(texts: DataFrame, cache: DataFrame, encoder: Encoder = hashing_encoder) -> DataFrame:
    """key, vec of (key, text): from the cache (key, vec), and each missing text encoded once."""
    known = texts.join(cache, "key").select("key", "vec")
    missing = texts.dropDuplicates(["key"]).join(cache, "key", "left_anti").select(F.col("key").alias("id"), "text")
    fresh = embed(missing, encoder).select(F.col("id").alias("key"), "vec")
    return known.unionByName(texts.select("key").join(fresh, "key"))


def rerank(chunks: DataFrame, question: str, scorer: Callable[[str, list[str]], np.ndarray] | None = None) -> DataFrame:
    """id, score of (id, content) by a batch scorer; the stand-in is token overlap."""

    def overlap(q: str, texts: list[str]) -> np.ndarray:
        want = set(q.lower().split())
        return np.array([len(want & set(t.lower().split())) / max(1, len(want)) for t in texts])

    own = scorer or overlap

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 32):
                part = b.slice(a, 32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own(question, [t or "" for t in part.column(1).to_pylist()]), pa.float64())], names=["id", "score"])

    kind = chunks.schema["id"].dataType.simpleString()
    return chunks.select("id", "content").mapInArrow(run, f"id {kind}, score double")
