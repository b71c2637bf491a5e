"""N-gram Jaccard self-join by parity sketches.

A document's set is its distinct shingles of `k` words. A parity sketch is a bit vector in which every shingle flips one
bit, so the Hamming distance of two sketches is at most the symmetric difference of the sets. Two sets that link differ
in at most (s + t)(1 - J) / (1 + J) shingles, so sizes go in bands (a link joins the same or neighbouring bands), and for each
band the sketch is cut into more blocks than that difference can reach: in a linked pair some block has equal
bits. Blocks are wide and sparse and are kept as the XOR of 64-bit codes of their set bits. Documents meet on
(band, block, bits); sizes, a narrow sketch of 256 bits and a second sketch of two bits or more a shingle then drop pairs
that cannot link, and whole shingle sets decide.

An empty block says nothing. Some spare blocks make up for the usual number of empty ones; documents with more of them
also meet on the blocks of a second division under the empty block's name, and there of a third; in the last an empty block is a
key by itself.

Similar documents meet on many keys; buckets of the same members count once. Buckets are not expanded into all pairs. Each is
first joined to one member, then to another one where its members are not connected yet; a last join gives only pairs
of different components that the sketches cannot tell apart, so no link between components is lost and links inside a component
are not needed again. It compares by narrow sketches and then by wide ones inside the join, with a large bucket in parts of PART members, each a task's:
texts of a family that is alike but not linked meet on many keys, so pairs that narrow sketches of long texts let pass would leave it as the square of the family.

Equal sets are one node, named by a 64-bit hash of the set (two different sets of n documents fall together with a
chance of about n^2 / 2^65); one row stands for each node, found again by its doc_id and a hash of its text, so rows without an id
and rows that share one take part by their own sets. Defined results: null or empty text, or one without words, has an empty
set, links with nothing and is its own component. Rows with a null doc_id have the smallest id of those they are linked with, null if there is
none. Rows are kept one for one; extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACED, U64, Scratch, chunks, mix64, partitions_for, release, shingles, words

#: A set of candidate documents up to this many is broadcast to the scan that fetches their texts; more are joined.
BROADCAST_ROWS = 500_000
LEVELS = 3
#: Members of a bucket that a task compares with all of it, and links of a node that are followed in one task.
PART, MANY = 2000, 20_000
#: Keys that a task sorts at a time.
FLUSH = 1_000_000


def bound(a: int, b: int, percent: int) -> int:
    """The largest symmetric difference of linked sets of these sizes."""
    return (a + b) * (100 - percent) // (100 + percent)


@lru_cache
def bands(percent: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least size of each band; the number of blocks of its sketches; and how many empty blocks a document may ignore.

    With k = difference + 1 + spare blocks, linked documents have spare + 1 equal blocks, so one with at most `spare` empty
    blocks is met on a full one. Long documents have about k exp(-size / k) empty blocks: `spare` covers nearly all of them."""
    low, blocks, spare = [1], [], []
    while low[-1] <= most:
        low.append(low[-1] * 100 // percent + 1)
    for first, past in zip(low, low[1:], strict=False):
        least = bound(past - 1, (past - 1) * 100 // percent, percent) + 1
        x = 0
        for _ in range(50):
            empty = (least + x) * np.exp(-first / (least + x))
            more = 0 if empty < 0.3 and not x else int(np.ceil(empty + 3 * np.sqrt(empty)))
            if more <= x:
                break
            x = more
        blocks.append(least + x)
        spare.append(x)
    return np.array(low), np.array(blocks), np.array(spare)


def sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents, and where each document's begin."""
    _, _, h, before = words(data, off, SPACED)
    n = np.diff(before)
    t = shingles(h, k)
    doc = np.repeat(np.arange(len(n)), n)[: len(t)]
    inside = np.arange(len(t)) + k <= before[1:][doc] if len(t) else np.zeros(0, bool)
    t, doc = t[inside], doc[inside]
    for d in np.flatnonzero((n > 0) & (n < k)):  # the whole sequence is the one shingle
        t = np.append(t, shingles(h[before[d] : before[d + 1]], int(n[d])) ^ U64(0x5BF03635))
        doc = np.append(doc, d)
    order = np.lexsort((t, doc))
    t, doc = t[order], doc[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (doc[1:] != doc[:-1])
    t, doc = t[new], doc[new]
    return t, np.searchsorted(doc, np.arange(len(n) + 1))


def _block_keys(t: np.ndarray, doc: np.ndarray, k: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, block, key) of the non-empty blocks; t sorted within each doc, k and salt for each entry."""
    block = ((t >> U64(32)) * k.astype(U64)) >> U64(32)
    new = np.ones(len(t), bool)
    new[1:] = (block[1:] != block[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    if not len(at):
        return at, at, np.zeros(0, U64)
    bits = np.bitwise_xor.reduceat(mix64(t + U64(0x1234567)), at)
    return doc[at], block[at].astype(np.int64), mix64(bits ^ mix64(salt[at] + block[at]))


def _telling(empty: np.ndarray, spare: int) -> np.ndarray:
    """The empty blocks that must be looked into: if all of spare + 1 equal blocks are empty, the first of them is not among the last `spare`."""
    return empty[: max(0, len(empty) - spare)]


def _nested(t: np.ndarray, k: int, spare: int, groups: list[int], level: int) -> list[np.ndarray]:
    """Keys of one document under each group key (an empty block's): the blocks of a further division."""
    t = np.sort(mix64(t + U64(level * 0x9E37)))
    zero = np.zeros(len(t), np.int64)
    _, block, _ = _block_keys(t, zero, np.full(len(t), k), np.zeros(len(t), U64))
    empty = _telling(np.setdiff1d(np.arange(k), block), spare)
    out = []
    for g in groups:
        g64 = U64(g)
        _, _, keys = _block_keys(t, zero, np.full(len(t), k), np.full(len(t), g64, U64))
        out.append(keys)
        if len(empty):
            inner = mix64(np.full(len(empty), g64, U64) ^ mix64(empty.astype(U64) + U64(0xE0 + level)))
            if level + 1 < LEVELS:
                out += _nested(t, k, spare, [int(x) for x in inner], level + 1)
            else:
                out.append(inner)
    return out


def named(t: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document: a hash of its set (0 for the empty one) and four 64-bit words of the narrow sketch."""
    n = np.diff(first)
    full = np.flatnonzero(n)
    node = np.zeros(len(n), U64)
    narrow = np.zeros((4, len(n)), U64)
    if len(full):
        node[full] = mix64(np.add.reduceat(mix64(t ^ U64(0x6A09E667F3BCC908)), first[full]) + n[full].astype(U64))
        at = mix64(t + U64(0xA54FF53A)) >> U64(56)
        bit = U64(1) << (at & U64(63))
        for w in range(4):
            narrow[w, full] = np.bitwise_xor.reduceat(np.where(at >> U64(6) == U64(w), bit, U64(0)), first[full])
    return node, narrow


def wide(t: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit words of the second sketches end to end, and where each document's begin.

    A set of n has the least power of two of 2 n bits or more, 256 at least. A bit is named by the low bits of its hash, so halves
    laid over each other make the sketch of half the length."""
    n = np.diff(first)
    bits = np.where(n > 0, 1 << np.maximum(8, np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64)), 0)
    begin = np.append(0, np.cumsum(bits))
    own = np.repeat(np.arange(len(n)), n)
    at = begin[own] + (mix64(t + U64(0x3C6EF372)) & (bits[own] - 1).astype(U64)).astype(np.int64)
    flips = np.bincount(at, minlength=int(begin[-1])) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(U64), begin // 64


def sketch(data: np.ndarray, off: np.ndarray, k: int, percent: int):
    """Per document: set size, set hash, four 64-bit words of the narrow sketch; and all keys (none for percent 0), where each one's begin."""
    t, first = sets(data, off, k)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    full = np.flatnonzero(n)
    node, narrow = named(t, first)
    keys, owners = [], []
    if len(full) and percent:
        low, blocks, spare = bands(percent, int(n.max()))
        band = np.searchsorted(low, n, "right") - 1
        for lower in (0, 1):
            own = np.flatnonzero((n > 0) & (band - lower >= 0))
            scheme = np.where(n > 0, band - lower, 0).clip(0)
            use = (band - lower >= 0)[doc]
            d, b, key = _block_keys(t[use], doc[use], blocks[scheme[doc[use]]], mix64(scheme[doc[use]].astype(U64) + U64(0xB10C)))
            keys.append(key)
            owners.append(d)
            got = np.bincount(d, minlength=len(n))
            for x in own[got[own] < (blocks - spare)[scheme[own]]]:  # documents with more empty blocks than they may ignore
                kk, s = int(blocks[scheme[x]]), int(scheme[x])
                lo, hi = np.searchsorted(d, [x, x + 1])
                empty = _telling(np.setdiff1d(np.arange(kk), b[lo:hi]), int(spare[s])).astype(U64)
                group = mix64(mix64(empty + U64(s << 32)) + U64(0xE0))
                for more in _nested(t[first[x] : first[x + 1]], kk, int(spare[s]), [int(g) for g in group], 1):
                    keys.append(more)
                    owners.append(np.full(len(more), x))
    keys = np.concatenate(keys) if keys else np.zeros(0, U64)
    owners = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    order = np.argsort(owners, kind="stable")
    return n, node, narrow, keys[order], np.searchsorted(owners[order], np.arange(len(n) + 1))


_SIG = "doc_id long, told long, n long, node long, s0 long, s1 long, s2 long, s3 long, wide array<long>"


def _told(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, and the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("told"), "text")


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """Per row: its id and text's hash, size and hash of its set, and both sketches."""

    def run(batches):
        for batch in batches:
            for a, e, data, off in chunks(batch.column(2)):
                t, first = sets(data, off, k)
                node, narrow = named(t, first)
                words_, begin = wide(t, first)
                own = [batch.column(i).slice(a, e - a) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(first)), pa.array(node.view(np.int64)), *(pa.array(w.view(np.int64)) for w in narrow), pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(words_.view(np.int64)))], names=[x.split()[0] for x in _SIG.split(", ")])
        release()

    return _told(docs).mapInArrow(run, _SIG)


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    """The part of each 48-bit key, in the keys' order: from their top 32 bits, so the product stays below 2^64 for any number of parts below 2^32."""
    return ((key >> U64(16)) * U64(parts) >> U64(32)).astype(np.int64)


def block_members(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(key, short): the low 48 bits of the nodes of each block key that more than one node has; a few keys may have only one.

    Each task sorts its keys, keeps those that it sees twice itself as members, and sends one node for each key on, so a hot
    key costs each task one entry. Entries travel packed, six bytes for the key and six for the node."""
    parts = partitions_for(docs, 32 << 20)

    def pack(key: np.ndarray, node: np.ndarray) -> bytes:
        return b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes() for x in (key, node))

    def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        a = np.zeros((len(raw) // 6, 8), np.uint8)
        a[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
        key, node = np.split(a.view(U64).ravel(), 2)
        return key, node

    def sorted_pairs(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (key, node) in order, and which are first of their key."""
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[new], node[new]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        return key, node, first

    def shared(first: np.ndarray) -> np.ndarray:
        """Which entries have a neighbour of the same key."""
        return ~first | np.append(~first[1:], False)

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = turn = 0

        def flush():
            key, node, first = sorted_pairs(*(np.concatenate(x) for x in zip(*held, strict=True)))
            own = shared(first)
            out = [(parts + (task + turn) % parts, pack(key[own], node[own]))] if own.any() else []
            key, node = key[first], node[first]
            part = part_of(key, parts)
            edge = np.searchsorted(part, np.arange(parts + 1))
            out += [(p, pack(key[a:e], node[a:e])) for p, (a, e) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if a < e]
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["part", "entries"])

        for batch in batches:
            for _, _, data, off in chunks(batch.column(0)):
                _, node, _, keys, first = sketch(data, off, k, percent)
                held.append((keys >> U64(16), np.repeat(node, np.diff(first)) & U64(0xFFFFFFFFFFFF)))
                size += len(keys)
                if size >= FLUSH:
                    yield flush()
                    held, size, turn = [], 0, turn + 1
        if size:
            yield flush()
        held = []
        release()

    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        raw = [unpack(x) for x in table.column("entries").to_pylist()]
        keys, nodes = (np.concatenate(x) for x in zip(*raw, strict=True))
        if key[0].as_py() < parts:
            keys, nodes, first = sorted_pairs(keys, nodes)
            own = shared(first)
            keys, nodes = keys[own], nodes[own]
        del raw
        release()
        return pa.table([pa.array(keys.view(np.int64)), pa.array(nodes.view(np.int64))], names=["key", "short"])

    return docs.select("text").mapInArrow(run, "part int, entries binary").groupBy("part").applyInArrow(meet, "key long, short long")


def _shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for a, e, data, off in chunks(batch.column(1)):
                t, first = sets(data, off, k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, e - a), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(t.view(np.int64)))], names=["node", "shingles"])
        release()

    return docs.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def _possible(a: str, b: str, percent: int) -> Column:
    """Sizes and both sketches allow a link."""

    def apart(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda v, w: F.bit_count(v.bitwiseXOR(w))), F.lit(0), lambda total, v: total + v)

    def folded(x: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda v, w: v.bitwiseXOR(w))

    n, m, v, w = (F.col(f"{x}.{c}") for c in ("n", "wide") for x in (a, b))
    second = F.when(F.size(v) == F.size(w), apart(v, w)).when(F.size(v) > F.size(w), apart(folded(v), w)).otherwise(apart(v, folded(w)))
    return _near(a, b, percent) & ((100 + percent) * second <= (100 - percent) * (n + m))


def _near(a: str, b: str, percent: int) -> Column:
    """Sizes and narrow sketches allow a link."""
    narrow = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{a}.s{w}").bitwiseXOR(F.col(f"{b}.s{w}"))) for w in range(4)))
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * narrow <= (100 - percent) * (n + m))


def _pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a bucket's members (key, comp, m, with the wide sketch or without) in different components that may link; a pair may come from several buckets.

    A bucket of more than PART members is dealt to as many tasks as it has parts of that size: each meets one part with all members."""
    may_link = _possible if "wide" in members.schema["m"].dataType.names else _near
    size = members.groupBy("key").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    own = members.join(size, "key")
    x = own.select("key", F.pmod(F.xxhash64("m.node"), F.col("parts")).cast("int").alias("part"), F.col("m").alias("x"), F.col("comp").alias("x_comp"))
    y = own.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("m").alias("y"), F.col("comp").alias("y_comp"))
    on = (x["key"] == y["key"]) & (x["part"] == y["part"]) & (F.col("x.node") < F.col("y.node")) & (F.col("x_comp") != F.col("y_comp")) & may_link("x", "y", percent)
    return x.join(y, on).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def components(links: DataFrame, own: Scratch) -> DataFrame:
    """(node, comp) for all ends of links (a, b): comp is the smallest node that is connected. Labels move along links and then jump."""
    both = own.keep(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "ends")
    label = own.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "components")
    # nodes of many links, if there are any, are followed in parts
    hubs = own.keep(both.groupBy("b").agg(F.ceil(F.count("*") / MANY).cast("int").alias("parts")).where("parts > 1"), "hubs")
    if hubs.isEmpty():
        hubs, both_parts = None, both
    else:
        both_parts = own.keep(both.join(hubs, "b", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"), F.lit(0)).alias("part")), "ends-in-parts")
    while True:
        of = label.select(F.col("node").alias("b"), "comp")
        if hubs is not None:
            of = of.join(hubs, "b", "left").select("b", "comp", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        near = both_parts.join(of, ["b"] if hubs is None else ["b", "part"]).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        moved = label.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        to = label.select(F.col("node").alias("comp"), F.col("comp").alias("jump"))
        before, label = label, own.keep(moved.join(to, "comp", "left").select("node", "old", F.least("comp", F.coalesce("jump", "comp")).alias("comp")), "components")
        own.drop(before)
        if label.where("comp <> old").isEmpty():
            for table in {both, both_parts, hubs} - {None}:
                own.drop(table)
            return label.select("node", "comp")


def distinct_buckets(met: DataFrame) -> DataFrame:
    """(key, node) of `met` without buckets whose members are those of another bucket. Members are compared by two 64-bit hashes of the set."""
    made = met.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    first = made.where("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")
    return met.join(first, "key", "left_semi")


def link_components(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; links have a Jaccard similarity of percent / 100 or more.

    Also text_hash (xxhash64 of the text, which with doc_id finds the row again) and component, which names the row's group by
    itself (component_id may be shared by groups if rows share a doc_id); it is null for an empty set. The result is a table in the shared folder; all others that were written on the way are deleted."""
    with Scratch(docs.sparkSession) as own:
        return own.result(_link(docs, k, percent, own), "components-of-rows")


def _link(docs: DataFrame, k: int, percent: int, own: Scratch) -> DataFrame:
    sig = own.keep(signatures(docs, k), "signatures")
    rows = sig.where("n > 0")
    copies = rows.groupBy("node", "doc_id", "told").agg(F.count("*").alias("copies"), F.first(F.struct("n", "s0", "s1", "s2", "s3", "wide")).alias("m"))
    nodes = copies.groupBy("node").agg(F.min("doc_id").alias("least"), F.min_by(F.struct("doc_id", "told", "copies", "m"), F.struct("doc_id", "told")).alias("r"))
    nodes = own.keep(nodes.select("node", "least", "r.doc_id", "r.told", "r.copies", F.col("r.m").withField("node", F.col("node")).alias("m")), "nodes")
    short = F.col("node").bitwiseAND(F.lit(0xFFFFFFFFFFFF))
    met = own.keep(block_members(docs, k, percent).distinct().join(nodes.select("node", short.alias("short")), "short").select("key", "node"), "met")
    buckets = table = own.keep(distinct_buckets(met), "buckets")
    own.drop(met)

    def possible(edges: DataFrame) -> DataFrame:
        """Edges (a, b) that sizes and sketches allow."""
        x, y = (nodes.select(F.col("node").alias(c), F.col("m").alias(f"m{c}")) for c in "ab")
        return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(x, "a").join(y, "b").where(_possible("ma", "mb", percent)).select("a", "b")

    links: DataFrame | None = None
    comp: DataFrame | None = None
    sets_of: DataFrame | None = None
    for step in ("first", "again", "all"):
        if step == "first":
            hub = buckets.groupBy("key").agg(F.min("node").alias("a"))
            edges = possible(buckets.join(hub, "key").where("a <> node").select("a", F.col("node").alias("b")))
        else:
            members = buckets.withColumn("comp", F.col("node")) if comp is None else buckets.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            open_ = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
            members = own.keep(members.join(open_, "key", "left_semi").select("key", "node", "comp"), "open")
            own.drop(table)
            table, buckets = members, members.select("key", "node")
            if step == "again":  # another member of each bucket that is not one component yet
                hub = members.groupBy("key").agg(F.min_by(F.struct("node", "comp"), F.xxhash64("node", "key")).alias("h"))
                edges = possible(members.join(hub, "key").where("h.comp <> comp").select(F.col("h.node").alias("a"), F.col("node").alias("b")))
            else:
                edges = _pairs(members.join(nodes.select("node", "m"), "node"), percent).distinct()
        edges = own.keep(edges, "edges")
        if edges.isEmpty():
            continue
        wanted = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
        if sets_of is not None:
            wanted = wanted.join(sets_of.select("node"), "node", "left_anti")
        found = own.keep(_sets_of(nodes.join(wanted, "node"), docs, k, own), "sets")
        sets_of = found if sets_of is None else sets_of.unionByName(found)
        verified = own.keep(_verify(edges, sets_of, percent), "links")
        links = verified if links is None else links.unionByName(verified)
        if not links.isEmpty():
            comp = components(links, own)
    of = nodes.select("node", "least", F.col("node").alias("comp"))
    if comp is not None:
        of = nodes.select("node", "least").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        of = of.join(of.groupBy("comp").agg(F.min("least").alias("smallest")), "comp").select("node", F.col("smallest").alias("least"), "comp")
    rows = sig.select("doc_id", "told", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(of, "node", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), F.col("told").alias("text_hash"), F.col("comp").alias("component"))


def _sets_of(nodes: DataFrame, docs: DataFrame, k: int, own: Scratch) -> DataFrame:
    """(node, shingles): the sets of these nodes, each from the one row that stands for it."""
    ids = own.keep(nodes.select(F.col("doc_id").alias("_id"), F.col("told").alias("_told"), "node", "copies"), "wanted")
    few = ids.count() <= BROADCAST_ROWS
    hit = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("told") == F.col("_told"))
    texts = _told(docs).join(F.broadcast(ids) if few else ids, hit).select("node", "copies", "text")
    once, many = texts.where("copies = 1"), texts.where("copies > 1").dropDuplicates(["node"])
    return _shingle_sets(once if ids.where("copies > 1").isEmpty() else once.unionByName(many), k)


def _verify(edges: DataFrame, sets_of: DataFrame, percent: int) -> DataFrame:
    a, b = (sets_of.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")
    both = F.size(F.array_intersect("set_a", "set_b"))
    total = F.size("set_a") + F.size("set_b")
    return edges.join(a, "a").join(b, "b").where((100 + percent) * both >= percent * total).select("a", "b")
