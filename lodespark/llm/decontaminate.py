"""Benchmark decontamination by a prefix-filtered set join.

Items are cut into windows of `window` consecutive words (an item with fewer words is one window). A window's tokens are
its shingles of three words (fewer in shorter windows), ordered by rarity over all documents. Containment must be
whole, so the necessary prefix is the rarest token alone: a document that holds the window holds that token. Documents
are joined to windows on it; the token's place in the window gives the one start that is possible (positional bound),
which must leave room for the whole window (length bound), and then all words are compared.

The items' side is held as arrays of words, windows and prefix tokens, about eight bytes for each byte of its text, and cut into blocks of at most `block_bytes` of text, item
by item and long items into runs that overlap by a window less one word; each block is broadcast by itself, so what the driver holds and sends
out has a fixed bound, however large the benchmark or an item is.

Defined results: null or empty text has no words and no hits; null, empty and wordless items have no windows; items
without an id are left out; repeated items count once. Rows are kept one for one with all their columns; n_words, spans, items and n_hit replace
columns of these names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, U64, chunks, extended, release, shingles, words

TOKEN = 3
#: Words of a run that a long item is cut into.
RUN_WORDS = 50_000


@dataclass
class Windows:
    """Windows of one length in the items of a block: where each begins in `text`, its item, and its rarest token."""

    length: int
    text: np.ndarray  # words of the items end to end
    start: np.ndarray
    items: np.ndarray  # an index into Block.ids for each window
    k: int
    tokens: np.ndarray | None = None  # sorted distinct prefix tokens
    first: np.ndarray | None = None  # of each token, its first entry below
    window: np.ndarray | None = None
    place: np.ndarray | None = None

    def tokens_at(self, shingled: np.ndarray, place: int) -> np.ndarray:
        return shingled[self.start + place]


@dataclass
class Block:
    ids: list[str]
    windows: list[Windows]

    def vocabulary(self) -> dict[int, np.ndarray]:
        """Distinct tokens by their number of words."""
        out: dict[int, list[np.ndarray]] = {}
        for w in self.windows:
            t = shingles(w.text, w.k)
            out.setdefault(w.k, []).extend(np.unique(w.tokens_at(t, p)) for p in range(w.length - w.k + 1))
        return {k: np.unique(np.concatenate(v)) for k, v in out.items()}

    def rank(self, count: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """Chooses the rarest token of each window; count: by words of a token, sorted tokens that documents hold, and how often."""
        for w in self.windows:
            keys, n = count.get(w.k, (np.zeros(0, U64), np.zeros(0, np.int64)))
            t = shingles(w.text, w.k)
            at = np.searchsorted(keys, t)
            at[at == len(keys)] = 0
            held = np.where(keys[at] == t, n[at], 0) if len(keys) else np.zeros(len(t), np.int64)
            least, place = held[w.start], np.zeros(len(w.start), np.int64)
            for p in range(1, w.length - w.k + 1):
                less = held[w.start + p] < least
                least, place = np.where(less, held[w.start + p], least), np.where(less, p, place)
            own = t[w.start + place]
            order = np.argsort(own, kind="stable")
            w.tokens, first = np.unique(own[order], return_index=True)
            w.first, w.window, w.place = np.append(first, len(order)), order, place[order]


def build(rows: list[tuple[str, str]], window: int) -> Block:
    """The windows of (item_id, text) rows; those that an item repeats count once."""
    rows = sorted({(str(i), t) for i, t in rows if i is not None and t})
    ids = sorted({i for i, _ in rows})
    at = {i: n for n, i in enumerate(ids)}
    found: dict[int, list[tuple[np.ndarray, int]]] = {}
    for i, t in rows:
        raw = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
        h = words(raw, np.array([0, len(raw)]), ALNUM)[2]
        if len(h):
            found.setdefault(min(window, len(h)), []).append((h, at[i]))
    out = []
    for n, own in sorted(found.items()):
        size = np.array([len(h) for h, _ in own])
        begin = np.cumsum(size) - size
        text = np.concatenate([h for h, _ in own])
        many = size - n + 1
        start = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
        items = np.repeat([i for _, i in own], many)
        _, once = np.unique(np.stack([shingles(text, n)[start].view(np.int64), items]), axis=1, return_index=True)
        out.append(Windows(n, text, start[np.sort(once)], items[np.sort(once)], min(TOKEN, n)))
    return Block(ids, out)


_WORD = re.compile("[0-9A-Za-z\x80-\U0010FFFF]+")


def _runs(items: DataFrame, window: int) -> DataFrame:
    """item_id, text of the items with an id and a text, long ones in runs of RUN_WORDS words that hold each window once."""

    def run(batches):
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = [m.span() for m in _WORD.finditer(text)] if len(text) > RUN_WORDS else []
                cuts = [(at[i][0], at[min(i + RUN_WORDS + window - 2, len(at) - 1)][1]) for i in range(0, max(1, len(at) - window + 1), RUN_WORDS)] if at else [(0, len(text))]
                for a, e in cuts:
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([text[a:e]], pa.string())], names=["item_id", "text"])

    own = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    return own.mapInArrow(run, "item_id string, text string")


def blocks(items: DataFrame, block_bytes: int) -> list[DataFrame]:
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    if n == 1:
        return [items]
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) for b in range(n)]


def _count(docs: DataFrame, vocab: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """How often all documents hold each token of the block, sorted by token; at most one row for each token comes back, as arrays."""
    own = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches):
        v = own.value
        n = {k: np.zeros(len(x), np.int64) for k, x in v.items()}
        for b in batches:
            for _, _, data, off in chunks(b.column(0)):
                _, _, h, before = words(data, off, ALNUM)
                for k, x in v.items():
                    t = shingles(h, k)
                    if not len(t):
                        continue
                    at = np.searchsorted(x, t)
                    at[at == len(x)] = 0
                    n[k] += np.bincount(at[(x[at] == t) & _inside(before, len(t), k)], minlength=len(x))
        release()
        for k, x in v.items():
            hit = n[k] > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.full(int(hit.sum()), k), pa.int32()), pa.array(x[hit].view(np.int64)), pa.array(n[k][hit])], names=["k", "h", "n"])

    out = docs.select("text").mapInArrow(run, "k int, h long, n long").groupBy("k", "h").agg(F.sum("n").alias("n"))
    got = out.toArrow()
    kinds, h, n = (got.column(c).to_numpy() for c in ("k", "h", "n"))
    found = {}
    for k in vocab:
        own = kinds == k
        key = h[own].astype(np.int64).view(U64)
        order = np.argsort(key)
        found[k] = key[order], n[own][order].astype(np.int64)
    return found


def _inside(before: np.ndarray, n: int, k: int) -> np.ndarray:
    """Which of n shingles of k words stay within one document."""
    ok = np.ones(n, bool)
    for i in range(1, k):
        bad = before[1:-1] - i
        ok[bad[(bad >= 0) & (bad < n)]] = False
    return ok


def match(block: Block, h: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, item index) of every occurrence of a window in the documents whose words are h."""
    starts, lengths, items = [], [], []
    shingled: dict[int, np.ndarray] = {}
    for w in block.windows:
        if w.k not in shingled:
            shingled[w.k] = shingles(h, w.k)
        t = shingled[w.k]
        if not len(t) or not len(w.tokens):
            continue
        at = np.searchsorted(w.tokens, t)
        at[at == len(w.tokens)] = 0
        pos = np.flatnonzero(w.tokens[at] == t)
        at = at[pos]
        many = w.first[at + 1] - w.first[at]
        pos, entry = np.repeat(pos, many), np.repeat(w.first[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
        start, win = pos - w.place[entry], w.window[entry]
        doc = np.searchsorted(before, pos, "right") - 1
        ok = (start >= before[doc]) & (start + w.length <= before[doc + 1])  # positional and length bounds
        start, win = start[ok], win[ok]
        for i in range(w.length):
            ok = h[start + i] == w.text[w.start[win] + i]
            start, win = start[ok], win[ok]
        starts.append(start)
        lengths.append(np.full(len(start), w.length))
        items.append(w.items[win])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(lengths), np.concatenate(items)


_OUT = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def _hits(docs: DataFrame, block: Block) -> DataFrame:
    """(row, text, n_words, spans, items) of docs (row, text): the hits of one block."""
    own = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        blk = own.value
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            for a, e, data, off in chunks(b.column("text")):
                _, _, h, before = words(data, off, ALNUM)
                start, length, item = match(blk, h, before)
                order = np.argsort(start, kind="stable")
                start, length, item = start[order], length[order], item[order]
                doc = np.searchsorted(before, start, "right") - 1
                spans: list[list] = [[] for _ in range(e - a)]
                items: list[list] = [[] for _ in range(e - a)]
                for d in np.unique(doc):
                    lo, hi = np.searchsorted(doc, [d, d + 1])
                    out, base = spans[d], int(before[d])
                    for s, n in zip((start[lo:hi] - base).tolist(), length[lo:hi].tolist(), strict=True):
                        if out and s <= out[-1]["end"]:
                            out[-1]["end"] = max(out[-1]["end"], s + n)
                        else:
                            out.append({"start": s, "end": s + n})
                    items[d] = sorted({blk.ids[i] for i in np.unique(item[lo:hi])})
                cols = [*b.slice(a, e - a).columns, pa.array(np.diff(before)), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "n_words", "spans", "items"])
        release()

    return docs.mapInArrow(run, extended(docs, _OUT))


def hit_words(spans):
    """Words covered by sorted, possibly overlapping spans."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("at"))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["at"]))).alias("n"), F.greatest(acc["at"], s["end"]).alias("at"))
    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["n"])


def find_contamination(docs: DataFrame, items: DataFrame, window: int = 13, block_bytes: int = 8 << 20) -> DataFrame:
    """All columns of `docs` (text among them) with n_words, spans (in words), items (ids as sorted strings) and n_hit."""
    kept = [c for c in docs.columns if c not in ("text", "n_words", "spans", "items", "n_hit")]
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept or ["text"])).alias("row"), "text")
    for n, part in enumerate(blocks(_runs(items, window), block_bytes)):
        rows = part.toArrow()
        block = build(list(zip(rows.column("item_id").to_pylist(), rows.column("text").to_pylist(), strict=True)), window)
        del rows
        block.rank(_count(docs, block.vocabulary()))
        if n:
            out = out.withColumnsRenamed({"n_words": "_n_words", "spans": "_spans", "items": "_items"})
        out = _hits(out, block)
        if n:
            out = out.withColumn("spans", F.concat("_spans", "spans")).withColumn("items", F.array_sort(F.array_union("_items", "items"))).drop("_spans", "_items", "_n_words")
    own = lambda c: F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c)
    return out.select(*(own(c) for c in docs.columns if c in kept or c == "text"), "n_words", "spans", "items", hit_words(F.col("spans")).alias("n_hit"))


def contaminated(n_words, n_hit, parts: int = 20):
    return (n_hit > 0) & (parts * n_hit >= n_words)
