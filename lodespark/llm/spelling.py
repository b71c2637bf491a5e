"""Spelling variants: pairs of words one edit apart, found by merging errata tries along heavy paths.

The words are the paths of a trie. At each of its nodes the child with most words below it is the heavy one; the others are light, and
a word leaves heavy children for a light one at most log2(words) times. Wherever it does, its own branch is merged into the node's again with an error:

  skipped    its character at the node is left out: does the rest coincide with a word below the node?
  extended   the heavy character is put before the rest: does that coincide with a word below the heavy child?
  replaced   its character becomes the heavy one (a word below the heavy child), or any (words of two light children)

Terminals that coincide are words one edit apart. Two such words part at one node, where one of them is light, so every pair is met, and met once:
of equal neighbouring characters only the last counts as skipped.

As Spark jobs: nodes and terminals are 64-bit hashes that follow from prefix sums, so a word costs its length and not the square of it. Children
are counted by (node, character); nodes with 1/SHARE of all words or more, of which there are few, are broadcast and their steps
never shuffled; words step through the rest by a join. A word's light nodes (a few) give its erroneous terminals, which join the
vocabulary by hash. One terminal coincides with no more words than there are characters, so no group is large, whatever the data. The words of a pair are
compared, so that hashes decide nothing.

Roots follow forms by pointer doubling; a form has at least `ratio` times its word's occurrences, so that chains are short and never circular.

Defined results: a null or empty text has no words; a null doc_id counts as an empty one in the error model; repeated rows count again. Words are exact code points:
no normal forms, and only A-Z are lowered. A run of any length is one word. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, bounded_batches, mix64
from .common import _R as R
from .common import _powers as powers
from .resample import lowered

LETTERS = "A-Za-zÀ-ÿ"
#: Nodes that hold this share of all words, or more, are broadcast up to WIDE of them.
SHARE, WIDE = 4096, 200_000
#: The character that stands for any.
ANY = np.array([0x110000], np.uint32)


def runs(docs: DataFrame, least: int, every: int) -> DataFrame:
    """One row for each run of letters that may give a word: the word after the error model, which deletes a code point of one run in `every`."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"[{LETTERS}]{{{least},}}"), 0)  # a shorter run gives no word
    low = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run")).select("id", lowered(F.col("run")).alias("run"))
    if not every:
        return low.select(F.col("run").alias("word"))
    h = low.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.char_length("run").cast("long")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return h.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, least: int = 6, occurs: int = 5, every: int = 0) -> DataFrame:
    """(word, n): the distinct words of at least `least` code points and `occurs` occurrences."""
    counted = runs(docs, least, every).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.col("n") >= occurs) & (F.char_length("word") >= least))


class Words:
    """A batch of words as code points laid end to end, with the hash of any part of them."""

    def __init__(self, col: pa.Array):
        texts = col.to_pylist()
        self.size = np.array([len(t) for t in texts], np.int64)
        self.code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.start = np.cumsum(self.size) - self.size
        self.end = self.start + self.size
        self.up, self.down = powers(len(self.code) + 2)
        self.sums = np.zeros(len(self.code) + 1, U64)
        np.cumsum(symbol(self.code) * self.up[: len(self.code)], out=self.sums[1:])

    def part(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.down[a]

    def next(self, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The code point at a place; 0 at the end of a word."""
        return np.where(at < end, self.code[np.minimum(at, len(self.code) - 1)], 0)


def symbol(code: np.ndarray) -> np.ndarray:
    return mix64((code.astype(U64) + U64(1)) * U64(R))


def sealed(part: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix64(part + size.astype(U64) * U64(0xD6E8FEB86659FD93)).view(np.int64)


def keyed(words: DataFrame) -> DataFrame:
    """(key, word, n)."""

    def run(batches):
        for b in batches:
            w = Words(b.column("word"))
            yield pa.RecordBatch.from_arrays([pa.array(sealed(w.part(w.start, w.end), w.size)), *b.columns], names=["key", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "key long, word string, n long")


def steps(words: DataFrame) -> DataFrame:
    """(key, depth, node, next) for each node on a word's path, its terminal included."""

    def run(batches):
        for b in batches:
            w = Words(b.column("word"))
            many = w.size + 1
            depth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            start = np.repeat(w.start, many)
            node = sealed(w.part(start, start + depth), depth)
            cols = [np.repeat(b.column("key").to_numpy(), many), depth, node, w.next(start + depth, np.repeat(w.end, many)).astype(np.int32)]
            for a in range(0, len(depth), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + (1 << 16)]) for c in cols], names=["key", "depth", "node", "next"])

    return words.select("key", "word").mapInArrow(run, "key long, depth long, node long, next int")


def heavy_children(words: DataFrame) -> DataFrame:
    """(node, heavy, words) of the nodes with two children or more; the end of a word is the child 0."""
    counts = steps(words).groupBy("node", "next").agg(F.count("*").alias("c"))
    most = F.max(F.struct("c", "next"))["next"].alias("heavy")
    return counts.groupBy("node").agg(most, F.sum("c").alias("words"), F.count("*").alias("children")).where("children > 1").select("node", "heavy", "words")


def light_nodes(words: DataFrame, own: Scratch) -> DataFrame:
    """(key, word, n, lights): the depths at which a word's path leaves the heavy child, with that child."""
    nodes = own.keep(heavy_children(words), "nodes")
    share = max(1000, words.count() // SHARE)
    wide = nodes.where(F.col("words") >= share).select("node", F.col("heavy").alias("_wide"))
    path = steps(words)
    if wide.count() <= WIDE:
        path = path.join(F.broadcast(wide), "node", "left")
        off = path.where("next <> _wide").select("key", "depth", F.col("_wide").alias("heavy"))
        rest = path.where("_wide is null").join(nodes.where(F.col("words") < share), "node")
        off = off.unionByName(rest.where("next <> heavy").select("key", "depth", "heavy"))
    else:
        off = path.join(nodes, "node").where("next <> heavy").select("key", "depth", "heavy")
    lights = off.distinct().groupBy("key").agg(F.collect_list(F.struct("depth", "heavy")).alias("lights"))
    return own.keep(words.join(lights, "key"), "lights")


def _errata(b: pa.RecordBatch):
    """(row of the word, hash with the error, its depth) of the batch's terminals to be found in the vocabulary, and of those with any character in place of one."""
    w = Words(b.column("word"))
    lights = b.column("lights")
    row = pc.list_parent_indices(lights).to_numpy()
    depth, heavy = (pc.struct_field(lights.flatten(), i).to_numpy() for i in (0, 1))
    start, end, size = w.start[row], w.end[row], w.size[row]
    at = start + depth
    own = w.next(at, end)
    ended = at >= end
    after = np.minimum(at + 1, end)
    head, tail, rest = w.part(start, at), w.part(at, end), w.part(after, end)
    here, further = w.up[depth], w.up[depth + 1]
    skipped = ~ended & (own != w.next(after, end))
    extended = heavy != 0
    swapped = ~ended & extended
    put = head + symbol(heavy.astype(np.uint32)) * here
    found = [(row[m], sealed(p[m], n[m]), depth[m]) for m, p, n in ((skipped, head + rest * here, size - 1), (extended, put + tail * further, size + 1), (swapped, put + rest * further, size))]
    any_of = sealed((head + symbol(ANY) * here + rest * further)[~ended], size[~ended])
    return tuple(map(np.concatenate, zip(*found, strict=True))), (row[~ended], any_of, depth[~ended])


def errata(lights: DataFrame, of_any: bool) -> DataFrame:
    """(probe, depth, word, n): the words' terminals with one error at a depth; with of_any those that have any character in place of one."""

    def run(batches):
        for b in batches:
            row, probe, depth = _errata(b)[of_any]
            yield pa.RecordBatch.from_arrays([pa.array(probe), pa.array(depth), b.column("word").take(pa.array(row)), b.column("n").take(pa.array(row))], names=["probe", "depth", "word", "n"])

    return lights.select("word", "n", "lights").mapInArrow(run, "probe long, depth long, word string, n long")


def _apart(a: Column, b: Column, depth: Column) -> Column:
    """Whether the words differ by just the character at that depth, of the longer one, or of both."""
    d, long = depth.cast("int"), F.lit(1 << 30)
    more = F.char_length(a) - F.char_length(b)
    rest = lambda x, cut: F.substring(x, d + 1 + cut.cast("int"), long)
    return (a != b) & more.between(-1, 1) & (F.substring(a, F.lit(1), d) == F.substring(b, F.lit(1), d)) & (rest(a, more >= 0) == rest(b, more <= 0))


def near_pairs(words: DataFrame, own: Scratch) -> DataFrame:
    """(a, a_n, b, b_n): each pair of words one inserted, deleted or replaced code point apart, once. `words` are (key, word, n)."""
    lights = light_nodes(words, own)
    side = lambda t, x, key, *more: t.select(F.col(key).alias("_k"), *more, F.col("word").alias(x), F.col("n").alias(f"{x}_n"))
    found = side(errata(lights, False), "a", "probe", "depth").join(side(words, "b", "key"), "_k")
    some = errata(lights, True)
    swaps = side(some, "a", "probe", "depth").join(side(some, "b", "probe", "depth"), ["_k", "depth"]).where("a < b")
    return found.unionByName(swaps).where(_apart(F.col("a"), F.col("b"), F.col("depth"))).drop("_k", "depth")


def spelling_variants(docs: DataFrame, least: int = 6, occurs: int = 5, ratio: int = 5, every: int = 0) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of docs(doc_id, text).

    form is the near word of largest n (then the first in code-point order) if that n is `ratio` times the word's or more; root is where forms lead to. `every`
    deletes a code point of one run in so many first, by its crc32; 0 deletes none."""
    spark = docs.sparkSession
    bounded_batches(spark)
    with Scratch(spark) as own:
        words = own.keep(keyed(vocabulary(docs, least, occurs, every)), "words")
        pairs = near_pairs(words, own)
        both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))))
        rows = pairs.select(both.alias("p")).select("p.word", F.lit(None).cast("long").alias("n"), "p.near", "p.near_n")
        rows = rows.unionByName(words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n")))
        best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))).alias("best")
        rows = rows.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best)
        ok = -F.col("best.less") >= ratio * F.col("n")
        near = own.result(rows.select("word", "n", "n_near", F.when(ok, F.col("best.near")).alias("form"), F.when(ok, -F.col("best.less")).alias("form_n")), "near")
        most = near.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
        longest = int(math.log(max(most / occurs, 1), ratio)) + 2  # no chain of forms has more
        roots = own.keep(near.where("form is not null").select("word", F.col("form").alias("root")), "roots")
        for _ in range(max(1, math.ceil(math.log2(longest)))):
            on = roots.select(F.col("word").alias("root"), F.col("root").alias("_further"))
            roots, before = own.keep(roots.join(on, "root", "left").select("word", F.coalesce("_further", "root").alias("root")), "roots"), roots
            own.drop(before)
        roots = own.result(roots, "roots")
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
