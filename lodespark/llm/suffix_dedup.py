"""Removal of repeated substrings by a distributed, common-prefix-aware merge sort of sampled suffixes.

Goal: every byte that a string of `length` bytes covers which also starts earlier (smaller doc_id, or the same document and
an earlier start) goes; strings are judged on the input, and matches never cross documents.

1. Anchors. Each string of `length` bytes names one place in itself: the start of its leftmost k-gram with the least
   hash (k = 20). Equal strings name the same place, so only suffixes that start at anchors (about one byte in 40) can
   matter. Documents are written in blocks to the shared folder; each block reports its distinct anchor hashes.
2. Prefix doubling's first step: anchors whose k-gram occurs once in the whole corpus go no further.
3. Each block makes a record for each remaining anchor: the suffix as far as the strings that name this anchor reach, then the
   text before it, backwards. Records are sorted; equal ones collapse to the earliest (the later ones are covered
   whole); the runs are cut at range splitters, front-coded and exchanged.
4. Each range merges its runs with a loser tree whose nodes know the common prefix with the last winner, so characters
   known to be equal are never compared again. Neighbours that share k bytes form a group.
5. In a group, strings at each distance before the anchor are told apart by hash; all but the earliest are covered.
6. Covered spans go back to their blocks, which cut them out.

A hot passage costs each block one record per distinct context, not one per occurrence. Nothing is collected but splitters
(at most SAMPLE prefixes).

Defined results: null text is empty text; texts shorter than `length` lose nothing. Rows with the same doc_id are
separate documents, ordered by where they were read; null ids come first. Other columns pass through.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, U64, _powers, buffers, chunks, dotted, extended, materialize, mix64, partitions_for, prefix_hash, release, scratch, undotted

K = 20
#: Text of a block, in bytes; a longer document is a block by itself. What a task holds grows with it; the number of runs falls.
BLOCK_BYTES = 4 << 20
#: Prefixes that come to the driver to choose the ranges, at most.
SAMPLE = 100_000


def anchors(data: np.ndarray, off: np.ndarray, length: int, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For documents end to end: the place of each anchor, its k-gram's hash, and the first and last start of the strings that name it."""
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.int64),) * 2
    p = prefix_hash(data)
    _, down = _powers(n + 1)
    h = mix64((p[k:] - p[: n - k + 1]) * down[: n - k + 1])
    m = (h & U64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U64)
    w, span = length - k + 1, 1
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if w > span:
        m = np.minimum(m[: len(m) - (w - span)], m[w - span :])
    place = (m & U64(0xFFFFFFFF)).astype(np.int64)
    ok = np.zeros(len(place), np.int8)  # starts whose string stays in its document
    size = np.diff(off)
    long = np.flatnonzero(size >= length)
    step = np.zeros(len(place) + 1, np.int64)
    np.add.at(step, off[:-1][long], 1)
    np.add.at(step, off[1:][long] - length + 1, -1)
    ok = np.cumsum(step[:-1]) > 0
    start = np.flatnonzero(ok)
    place = place[start]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1
    return place[first], h[place[first]].view(np.int64), start[first], start[last]


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _path(base: str, block: int) -> str:
    return f"{base}/block-{block:x}.parquet"


def _read_block(path: str) -> pa.Table:
    import pyarrow.parquet as pq

    store, p = _fs(path)
    with store.open_input_file(p) as f:
        return pq.read_table(f)


def write_blocks(docs: DataFrame, length: int, out: str) -> DataFrame:
    """Writes the rows of `docs` in block files; one row for each block: its number, distinct anchor hashes, sampled prefixes.

    A retried task writes files of other numbers; the rows that Spark commits have the numbers of the attempt they came from."""

    def run(batches):
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        task = TaskContext.get().taskAttemptId()  # no other attempt has it
        store, base = _fs(out)
        store.create_dir(base, recursive=True)
        held, size, nth = [], 0, 0

        def flush():
            nonlocal held, size, nth
            block = task << 16 | nth
            tab = pa.Table.from_batches(held)
            with store.open_output_stream(_path(base, block)) as f:
                pq.write_table(tab, f, compression="zstd", use_dictionary=[c for c in tab.column_names if c != "text"], row_group_size=1 << 30)
            found, sample = [], []
            for b in held:
                for _, _, data, off in chunks(b.column("text"), 1 << 19):
                    place, h, _, _ = anchors(data, off, length)
                    found.append(h)
                    for x in place[:: max(1, len(place) // 4)][:4]:
                        sample.append(data[x : x + 16].tobytes())
            h, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
            row = pa.RecordBatch.from_arrays([pa.array([block]), pa.array([h], pa.list_(pa.int64())), pa.array([n > 1], pa.list_(pa.bool_())), pa.array([sample[:64]], pa.list_(pa.binary()))], names=["block", "h", "many", "sample"])
            held, size, nth = [], 0, nth + 1
            del tab, found, sample
            release()
            return row

        for b in batches:
            _, off = buffers(b.column("text"))
            a = 0
            while a < b.num_rows:
                e = max(a + 1, int(np.searchsorted(off, off[a] + BLOCK_BYTES - size, "right")) - 1)
                held.append(b.slice(a, e - a))
                size += int(off[e] - off[a])
                a = e
                if size >= BLOCK_BYTES or a < b.num_rows:
                    yield flush()
        if held:
            yield flush()

    return materialize(docs.mapInArrow(run, "block long, h array<long>, many array<boolean>, sample array<binary>"), "blocks")


# ---- runs ----------------------------------------------------------------------------------------


def _records(tab: pa.Table, wanted: np.ndarray, length: int):
    """Sorted records of a block's remaining anchors as lists, and spans (row, start, end) that are covered already."""
    keys, rls, rows, xs, lo, hi = [], [], [], [], [], []
    base = 0
    for col in tab.column("text").chunks:
        for a, _, data, off in chunks(col, 1 << 19):
            place, h, first, last = anchors(data, off, length)
            at = np.searchsorted(wanted, h)
            at[at == len(wanted)] = 0
            use = np.flatnonzero(wanted[at] == h) if len(wanted) else np.zeros(0, np.int64)
            if not len(use):
                continue
            place, first, last = place[use], first[use], last[use]
            doc = np.searchsorted(off, place, "right") - 1
            raw = data.tobytes()
            for x, s, e, o in zip(place.tolist(), first.tolist(), last.tolist(), off[doc].tolist(), strict=True):
                keys.append(raw[x : e + length] + raw[s:x][::-1])
                rls.append(e + length - x)
                xs.append(x - o)
                lo.append(x - e)
                hi.append(x - s)
            rows.append(doc + a + base)
        base += len(col)
    if not keys:
        return [], np.zeros((0, 5), np.int64), np.zeros((0, 3), np.int64)
    row, rl, x = np.concatenate(rows), np.array(rls), np.array(xs)
    lo, hi = np.array(lo), np.array(hi)
    ids = tab.column("doc_id").cast(pa.int64()).combine_chunks()
    ids = ids.fill_null(np.iinfo(np.int64).min).to_numpy()
    order = sorted(range(len(keys)), key=lambda i: (keys[i], rls[i]))
    order = np.array(order)
    same = np.zeros(len(order), bool)
    ks = [keys[i] for i in order]
    same[1:] = [a == b for a, b in zip(ks[1:], ks[:-1], strict=True)]
    same[1:] &= rl[order][1:] == rl[order][:-1]
    group = np.cumsum(~same) - 1
    rank = np.lexsort((x[order], row[order], ids[row[order]]))  # earliest first
    first = np.full(group[-1] + 1, -1)
    first[group[rank[::-1]]] = rank[::-1]
    later = np.ones(len(order), bool)
    later[first] = False
    covered = order[later]
    spans = np.stack([row[covered], x[covered] - hi[covered], x[covered] - lo[covered] + length], 1)
    head = order[first]
    meta = np.stack([rl[head], ids[row[head]], row[head], x[head], lo[head]], 1)
    return [keys[i] for i in head], meta, spans


def _front_code(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Common prefix with the key before, rest's length, and the rests."""
    lcp = np.zeros(len(keys), np.uint16)
    before = b""
    rests = []
    for i, s in enumerate(keys):
        n = _common(before, s, 0)
        lcp[i] = n
        rests.append(s[n:])
        before = s
    return lcp, np.fromiter(map(len, rests), np.uint16, len(rests)), b"".join(rests)


def _common(a: bytes, b: bytes, n: int) -> int:
    """Length of the common prefix, which is known to be n at least."""
    end = min(len(a), len(b))
    while n < end:
        x, y = a[n : n + 32], b[n : n + 32]
        if x != y:
            m = min(len(x), len(y))
            d = int.from_bytes(x[:m], "big") ^ int.from_bytes(y[:m], "big")
            return n + (m - (d.bit_length() + 7) // 8 if d else m)
        n += len(x)
    return end


_RUN = "part int, block long, lcp binary, rest_len binary, rests binary, meta binary, spans binary"


def make_runs(hits: DataFrame, base: str, splitters: list[bytes], length: int) -> DataFrame:
    own = hits.sparkSession.sparkContext.broadcast(splitters)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        from bisect import bisect_right

        cuts = own.value
        block = key[0].as_py()
        wanted = np.unique(table.column("h").to_numpy())
        keys, meta, spans = _records(_read_block(_path(base, block)), wanted, length)
        out = {c: [] for c in ("part", "block", "lcp", "rest_len", "rests", "meta", "spans")}

        def put(*values):
            for c, v in zip(out, values, strict=True):
                out[c].append(v)

        if len(spans):
            put(-1, block, None, None, None, None, spans.astype("<i8").tobytes())
        part = np.fromiter((bisect_right(cuts, s[:16]) for s in keys), np.int64, len(keys))
        for p in np.unique(part):
            a, e = np.searchsorted(part, [p, p + 1])
            lcp, rest, raw = _front_code(keys[a:e])
            put(int(p), block, lcp.tobytes(), rest.tobytes(), raw, meta[a:e].astype("<i8").tobytes(), None)
        types = (pa.int32(), pa.int64(), *[pa.binary()] * 5)
        del keys, meta, spans
        release()
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    return hits.groupBy("block").applyInArrow(run, _RUN)


# ---- merge ---------------------------------------------------------------------------------------


class Run:
    """A front-coded run, decoded as it is read."""

    def __init__(self, number: int, lcp: bytes, rest_len: bytes, rests: bytes):
        self.number, self.rests = number, rests
        self.lcp, self.rest = np.frombuffer(lcp, np.uint16).tolist(), np.frombuffer(rest_len, np.uint16).tolist()
        self.at, self.pos, self.key = -1, 0, b""
        self.known = 0  # common prefix of key with the last winner
        self.step()

    def step(self) -> None:
        """The next key. The last winner is the key before, so the stored common prefix is the known one."""
        self.at += 1
        if self.at == len(self.lcp):
            self.key = None
            return
        n, m = self.lcp[self.at], self.rest[self.at]
        self.key = self.key[:n] + self.rests[self.pos : self.pos + m]
        self.pos += m
        self.known = n


def merge(runs: list[Run]):
    """(common prefix with the one before, key, run, place in the run) of all keys in order, by a loser tree."""
    size = 1 << max(0, (len(runs) - 1).bit_length())
    leaves: list[Run | None] = [*runs, *[None] * (size - len(runs))]
    losers: list[Run | None] = [None] * size

    def play(a: Run | None, b: Run | None) -> tuple[Run | None, Run | None]:
        """(winner, loser). Both know their common prefix with the last winner; the longer one is the smaller key."""
        if a is None or a.key is None:
            return b, a
        if b is None or b.key is None:
            return a, b
        if a.known != b.known:
            return (a, b) if a.known > b.known else (b, a)
        n = _common(a.key, b.key, a.known)
        if a.key[n : n + 1] <= b.key[n : n + 1]:
            b.known = n
            return a, b
        a.known = n
        return b, a

    def build(node: int) -> Run | None:
        if node >= size:
            return leaves[node - size]
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    leaf = {r.number: size + i for i, r in enumerate(runs)}
    winner = build(1) if size > 1 else leaves[0]
    first = True
    while winner is not None and winner.key is not None:
        yield 0 if first else winner.known, winner.key, winner.number, winner.at
        first = False
        node = leaf[winner.number]
        winner.step()
        node >>= 1
        while node:
            winner, losers[node] = play(winner, losers[node])
            node >>= 1


def _pair(ka: bytes, kb: bytes, a: list[int], b: list[int], length: int) -> tuple[int, int]:
    """Distances before the anchor, low to high, at which both records have the same string (none: low > high)."""
    right = min(a[0], b[0], _common(ka, kb, 0))
    left = _common(ka[a[0] :], kb[b[0] :], 0)
    return max(length - right, a[4], b[4]), min(left, len(ka) - a[0], len(kb) - b[0])


def covered(keys: list[bytes], meta: np.ndarray, blocks: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(member, start, end) of the spans of a group's records that earlier members cover. meta: rl, doc_id, row, x, lo."""
    rows = meta.tolist()
    order = sorted(range(len(keys)), key=lambda i: (rows[i][1], blocks[i], rows[i][2], rows[i][3]))
    out = []
    if len(keys) <= 3:
        for k, m in enumerate(order):
            for e in order[:k]:
                low, high = _pair(keys[e], keys[m], rows[e], rows[m], length)
                if low <= high:
                    out.append((m, rows[m][3] - high, rows[m][3] - low + length))
        return out
    at = np.array(order)
    rl, lo, x = meta[at, 0], meta[at, 4], meta[at, 3]
    hi = np.array([len(keys[i]) for i in order]) - rl
    wide, far = int(rl.max()), int(hi.max())
    right = np.frombuffer(b"".join([keys[i][: rows[i][0]].ljust(wide, b"\0") for i in order]), np.uint8).reshape(len(order), wide)
    left = np.frombuffer(b"".join([keys[i][rows[i][0] :].ljust(far, b"\0") for i in order]), np.uint8).reshape(len(order), far)
    up, _ = _powers(max(wide, far) + 1)
    sums = [np.zeros((len(order), n + 1), U64) for n in (wide, far)]
    for s, m in zip(sums, (right, left), strict=True):
        np.cumsum(_BYTE[m] * up[: m.shape[1]], axis=1, out=s[:, 1:])
    o = np.arange(int(lo.min()), far + 1)
    h = mix64(sums[0][:, np.minimum(length - o, wide)]) + sums[1][:, o]
    ok = (lo[:, None] <= o) & (o <= hi[:, None])
    h = np.where(ok, h, mix64(np.arange(h.size, dtype=U64).reshape(h.shape)))  # strings that are not there equal nothing
    by = np.argsort(h, axis=0, kind="stable")
    h = np.take_along_axis(h, by, 0)
    again = np.zeros(h.shape, bool)
    again[1:] = h[1:] == h[:-1]
    mask = np.zeros((len(order), len(o) + 2), np.int8)
    np.put_along_axis(mask[:, 1:-1], by, (again & np.take_along_axis(ok, by, 0)).astype(np.int8), 0)
    edge = np.diff(mask, axis=1)
    i, o1 = np.nonzero(edge == 1)
    _, o2 = np.nonzero(edge == -1)
    return list(zip(at[i].tolist(), (x[i] - o[o2 - 1]).tolist(), (x[i] - o[o1] + length).tolist(), strict=True))


_SPAN = "block long, row long, start long, end long"


def merge_ranges(runs: DataFrame, length: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        cols = {c: table.column(c).to_pylist() for c in ("block", "lcp", "rest_len", "rests", "meta")}
        metas = [np.frombuffer(m, "<i8").reshape(-1, 5) for m in cols["meta"]]
        opened = [Run(i, *x) for i, x in enumerate(zip(cols["lcp"], cols["rest_len"], cols["rests"], strict=True))]
        found: list[tuple[int, int, int, int]] = []
        keys: list[bytes] = []
        refs: list[tuple[int, int]] = []

        def close() -> None:
            if len(keys) > 1:
                meta = np.array([metas[r][a] for r, a in refs])
                blocks = np.array([cols["block"][r] for r, _ in refs])
                found.extend((int(blocks[m]), int(meta[m, 2]), s, e) for m, s, e in covered(keys, meta, blocks, length))

        for known, key, number, at in merge(opened):
            if known < K:
                close()
                keys, refs = [], []
            keys.append(key)
            refs.append((number, at))
        close()
        a = np.array(found, np.int64).reshape(-1, 4)
        del found, keys, refs, opened, metas, cols
        release()
        return pa.table([pa.array(a[:, k]) for k in range(4)], names=["block", "row", "start", "end"])

    return runs.groupBy("part").applyInArrow(run, _SPAN)


# ---- cut ------------------------------------------------------------------------------------------

_CUT = "n_bytes long, removed array<struct<start:long,end:long>>, kept "


def cut_blocks(spans: DataFrame, base: str, docs: DataFrame, as_text: bool = False) -> DataFrame:
    """The rows of all blocks (each has a row in `spans`, of row -1 at least) with n_bytes, removed and kept.

    as_text: kept is text; a character of which a cut has left only a part goes whole."""
    names = [c for c in docs.columns if c not in ("n_bytes", "removed", "kept")]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tab = _read_block(_path(base, key[0].as_py())).combine_chunks()
        row, start, end = (table.column(c).to_numpy() for c in ("row", "start", "end"))
        order = np.lexsort((start, row))
        row, start, end = row[order], start[order], end[order]
        n_bytes, removed, kept = [], [], []
        done = 0
        for col in tab.column("text").chunks:
            raw, off = buffers(col)
            for i in range(len(col)):
                text = raw[off[i] : off[i + 1]]
                lo, hi = np.searchsorted(row, [done + i, done + i + 1])
                n_bytes.append(len(text))
                if lo == hi:
                    removed.append([])
                    kept.append(text.tobytes())
                    continue
                s, reach = start[lo:hi], np.maximum.accumulate(end[lo:hi])
                new = np.ones(len(s), bool)
                new[1:] = s[1:] > reach[:-1]
                at = np.flatnonzero(new)
                s, e = s[at], reach[np.append(at[1:], len(reach)) - 1]
                removed.append([{"start": int(a), "end": int(b)} for a, b in zip(s, e, strict=True)])
                keep = np.ones(len(text), bool)
                for a, b in zip(s.tolist(), e.tolist(), strict=True):
                    keep[a:b] = False
                kept.append(text[keep].tobytes())
            done += len(col)
        release()
        last = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
        return pa.table([*(tab.column(c) for c in names), pa.array(n_bytes, pa.int64()), pa.array(removed, span), last], names=[*names, "n_bytes", "removed", "kept"])

    return spans.groupBy("block").applyInArrow(run, extended(docs, _CUT + ("string" if as_text else "binary"), names))


def remove_repeats(docs: DataFrame, length: int = 100, as_text: bool = False) -> DataFrame:
    """All columns of `docs` with n_bytes, removed (spans in bytes) and kept (the bytes that remain, or their text)."""
    spark = docs.sparkSession
    docs = undotted(docs.withColumn("doc_id", F.col("doc_id").cast("long")).drop("n_bytes", "removed", "kept"))
    base = scratch(spark, "text")
    blocks = write_blocks(docs, length, base)
    entries = blocks.select("block", F.explode(F.arrays_zip("h", "many")).alias("e")).select("block", "e.h", "e.many")
    repeated = entries.groupBy("h").agg(F.count("*").alias("n"), F.max("many").alias("many")).where("n > 1 or many").select("h")
    hits = entries.select("block", "h").join(repeated, "h", "left_semi")
    n = partitions_for(docs, 24 << 20)
    sample = blocks.select(F.explode("sample").alias("s")).orderBy(F.xxhash64("s")).limit(SAMPLE)
    prefixes = sorted({bytes(r.s) for r in sample.collect()})
    splitters = [prefixes[len(prefixes) * k // n] for k in range(1, n)] if len(prefixes) > n else prefixes
    runs = materialize(make_runs(hits, base, splitters, length), "runs")
    far = merge_ranges(runs.where("part >= 0"), length)
    none = blocks.select("block", F.lit(-1).cast("long").alias("row"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))
    return dotted(cut_blocks(_unpack(runs.where("part < 0").select("block", "spans")).unionByName(far).unionByName(none), base, docs, as_text))


def _unpack(rows: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            for block, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a = np.frombuffer(raw, "<i8").reshape(-1, 3).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), block)), *(pa.array(a[:, k]) for k in range(3))], names=["block", "row", "start", "end"])

    return rows.mapInArrow(run, _SPAN)
