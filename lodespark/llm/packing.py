"""Packing documents into fixed-length sequences: shortest-pack-first over the length histogram.

Documents are tokenised, an end id is added, and each is cut into pieces of `size` ids and a remainder. The histogram of the
pieces' lengths (at most `size` rows, whatever the corpus) goes to the driver. Lengths are placed longest first; all
pieces of a length go, as many at a time as there are, into the shortest of the packs with room for them, else into new packs.
Only counts of packing patterns are kept, so the work depends on `size`, not on the number of documents. A pattern's
slots own a range of ranks among the pieces of their length; ranks come from counts per (length, task), so that no
task sees all the pieces of a length, and a piece finds its slot by binary search.

Defined results: null text is an empty text, which is one piece with the end id alone. Repeated rows are packed each by
itself. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release
from .tokens import encoder, groups

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"


def cut(docs: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """Pieces of at most `size` ids. part, nth: the task that cut the piece, and its number there among pieces of its length."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = encoder(tokenizer)
        nth = np.zeros(size + 1, np.int64)
        for b in batches:
            keys = b.column(0).to_pylist()
            for first, texts in groups(b.column(1).to_pylist()):
                out: list[tuple] = []
                for key, ids in zip(keys[first : first + len(texts)], enc.encode(texts), strict=True):
                    raw = ids.astype("<u4").tobytes() + int(end_id).to_bytes(4, "little")
                    n = len(ids) + 1
                    for at in range(0, n, size):
                        m = min(size, n - at)
                        out.append((key, at, m, zlib.crc32(raw[4 * at : 4 * (at + m)]), n, part, int(nth[m])))
                        nth[m] += 1
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 5 else pa.int64()) for k, c in enumerate(cols)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"])
        release(tokens=False)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECES)


def patterns(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of the packs. Pieces of a length fill the shortest packs with room first."""
    packs: dict[int, list[list]] = {}  # by room left: [count, lengths]
    rooms: list[int] = []

    def put(room: int, pack: list) -> None:
        if not packs.get(room):
            packs[room] = []
            insort(rooms, room)
        for other in packs[room]:
            if other[1] == pack[1]:
                other[0] += pack[0]
                return
        packs[room].append(pack)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if rooms and rooms[-1] >= length:
                room = rooms[-1]
                count, lengths = packs[room].pop()
                if not packs[room]:
                    rooms.pop()
                n = min(count, left)
                if count > n:
                    put(room, [count - n, lengths])
                put(room - length, [n, (*lengths, length)])
            else:
                n = left
                put(size - length, [n, (length,)])
            left -= n
    return [(n, lengths) for room in sorted(packs) for n, lengths in sorted(packs[room], key=lambda p: p[1]) if n]


def slots(found: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows (length, first rank, pieces of the length in each pack, first sequence, offset), sorted by the first two."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for count, lengths in found:
        at = 0
        for length in dict.fromkeys(lengths):
            m = lengths.count(length)
            rows.append((length, used.get(length, 0), m, sequence, at))
            used[length] = used.get(length, 0) + m * count
            at += m * length
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = 2048) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = materialize(cut(docs, tokenizer, end_id, size), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "bases")
    histogram = {r.length: r.n for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = pieces.sparkSession.sparkContext.broadcast(slots(patterns(histogram, size)))

    def run(batches):
        rows = table.value
        keys = rows[:, 0] << 44 | rows[:, 1]
        for b in batches:
            length, rank = (b.column(k).to_numpy() for k in ("length", "rank"))
            at = np.searchsorted(keys, length << 44 | rank, "right") - 1
            _, first, m, sequence, offset = rows[at].T
            k = rank - first
            cols = [*b.columns[:5], pa.array(sequence + k // m), pa.array(offset + k % m * length)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    # the bases grow with tasks x lengths, so they are joined by key whatever their size
    ranked = pieces.join(bases.select("length", "part", "base").hint("merge"), ["length", "part"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
