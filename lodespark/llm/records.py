"""Length-delimited binary records of token ids, with an offset index for shuffled reads.

Format (fixed values; little-endian throughout):

  shard file   records, one after the other:
               length     u64   bytes of the payload
               check      u32   masked CRC-32 of the eight length bytes
               payload          the sequence: width u8 (2 or 4), doc_id present u8, doc_id i64, then the ids, `width` bytes each
               check      u32   masked CRC-32 of the payload
  index file   one entry of 24 bytes for each record: offset u64, payload length u64, ids in the shard before it u64
  masked(c) = rotate_right(c, 15) + 0xA282EAD8, modulo 2^32, so that a checksum of stored checksums stays useful.

Documents are range-partitioned by doc_id (nulls first; equal ids by text), so shard n's ids come before shard n + 1's. A task
writes its own file pair under a name of its own; the manifest, committed by Spark's Parquet writer, names only files of
tasks that ended well, so a retried task leaves an unnamed file behind and nothing else. Files go through
pyarrow.fs, into the shared folder.

Defined results: a null or empty text is a record of the end id alone. Rows without a doc_id come first and say so in their record; rows that repeat a doc_id are
records of their own, ordered by text. A text of any length is one record. An empty table writes no shard and reads back as no rows. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, partitions_for, scratch
from .tokens import encoder, groups

_DELTA = 0xA282EAD8
_MANIFEST = "shard int, path string, n_docs long, n_ids long, n_bytes long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + _DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    n = struct.pack("<Q", len(payload))
    return b"".join((n, struct.pack("<I", masked(n)), payload, struct.pack("<I", masked(payload))))


def unframe(buf, at: int = 0) -> tuple[memoryview, int]:
    """The payload of the record at `at`, and where the next one begins; ValueError if a checksum is wrong."""
    view = memoryview(buf)
    head = view[at : at + 12]
    if len(head) < 12:
        raise ValueError(f"record at {at}: cut off")
    n, check = struct.unpack("<QI", head)
    if masked(bytes(head[:8])) != check:
        raise ValueError(f"record at {at}: length checksum")
    body = view[at + 12 : at + 12 + n]
    tail = view[at + 12 + n : at + 16 + n]
    if len(tail) < 4 or masked(body) != struct.unpack("<I", tail)[0]:
        raise ValueError(f"record at {at}: payload checksum")
    return body, at + 16 + n


def pack_sequence(doc_id: int | None, ids: np.ndarray) -> bytes:
    return struct.pack("<BBq", ids.dtype.itemsize, doc_id is not None, doc_id or 0) + ids.astype(ids.dtype.newbyteorder("<"), copy=False).tobytes()


def unpack_sequence(payload) -> tuple[int | None, np.ndarray]:
    wide, known, doc_id = struct.unpack_from("<BBq", payload)
    return doc_id if known else None, np.frombuffer(payload, "<u2" if wide == 2 else "<u4", offset=10)


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_records(docs: DataFrame, tokenizer: str, end_id: int, out: str, shard_bytes: int = 256 << 20) -> DataFrame:
    """Writes doc_id, text as records in ascending doc_id order; the manifest, one row for each shard."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = partitions_for(docs, shard_bytes)

    def run(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        store, base = _open(out)
        store.create_dir(base, recursive=True)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
        enc = encoder(tokenizer)
        docs_n = ids_n = at = 0
        f = index = None
        for b in batches:
            keys = b.column(0).to_pylist()
            for first, texts in groups(b.column(1).to_pylist()):
                if f is None:
                    f, index = store.open_output_stream(f"{base}/{name}.rec"), store.open_output_stream(f"{base}/{name}.idx")
                data, entries = [], []
                for key, ids in zip(keys[first : first + len(texts)], enc.encode(texts), strict=True):
                    payload = pack_sequence(key, np.append(ids, np.array([end_id], ids.dtype)))
                    entries.append(struct.pack("<QQQ", at, len(payload), ids_n))
                    data.append(frame(payload))
                    at += len(data[-1])
                    ids_n += len(ids) + 1
                docs_n += len(texts)
                f.write(b"".join(data))
                index.write(b"".join(entries))
        if f is not None:
            f.close()
            index.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{out}/{name}.rec"], "n_docs": [docs_n], "n_ids": [ids_n], "n_bytes": [at]})

    placed = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(placed.mapInArrow(run, _MANIFEST), "manifest")


def read_records(spark: SparkSession, manifest: DataFrame, task_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (little-endian u32 bytes), read through the index.

    The manifest has one row for each shard, which is the number of write tasks; it alone comes to the driver."""
    shards, base = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r.shard):
        parts = max(1, -(-r.n_bytes // task_bytes))
        shards += [(r.path, base, r.n_docs * k // parts, r.n_docs * (k + 1) // parts) for k in range(parts)]
        base += r.n_ids
    tasks = spark.createDataFrame(shards or [], "path string, base long, first long, past long")

    def run(batches):
        for b in batches:
            for path, base, first, past in zip(*(c.to_pylist() for c in b.columns), strict=True):
                store, p = _open(path)
                with store.open_input_file(p[:-4] + ".idx") as f:
                    f.seek(first * 24)
                    index = np.frombuffer(f.read((past - first) * 24), "<u8").reshape(-1, 3)
                with store.open_input_file(p) as f:
                    a = 0
                    while a < len(index):
                        e = max(a + 1, int(np.searchsorted(index[:, 0], index[a, 0] + (4 << 20))))
                        e = min(e, len(index))
                        f.seek(int(index[a, 0]))
                        buf = f.read(int(index[e - 1, 0] + index[e - 1, 1] + 16 - index[a, 0]))
                        keys, ids = [], []
                        for k in range(a, e):
                            key, own = unpack_sequence(unframe(buf, int(index[k, 0] - index[a, 0]))[0])
                            keys.append(key)
                            ids.append(own.astype("<u4").tobytes())
                        start = index[a:e, 2].astype(np.int64) + base
                        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(start), pa.array(ids, pa.binary())], names=["doc_id", "start", "ids"])
                        a = e

    n = max(1, min(len(shards), 10_000))
    return tasks.repartition(n).mapInArrow(run, "doc_id long, start long, ids binary")


def token_records(docs: DataFrame, tokenizer: str, end_id: int = 2, out: str | None = None) -> DataFrame:
    """Writes the records and reads them back: doc_id, start, ids."""
    spark = docs.sparkSession
    return read_records(spark, write_records(docs, tokenizer, end_id, out or scratch(spark, "records")))
