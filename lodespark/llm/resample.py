"""Importance resampling towards a target collection, with hashed n-gram features.

Features are all runs of 1 to `longest` consecutive words; a feature's bucket is its crc32 modulo BUCKETS. Two counts, of all documents and
of all target texts, give each bucket an integer gain, and a document's weight is the sum of its features' gains, looked up in one array
(Column expressions only). A Gumbel noise from the document's id makes the weights scores whose largest are a sample without replacement.

The draw is exact: documents are counted by integer score, suffix sums of those counts say how many documents score more, so a score's ranks
begin at a known offset, and the cutoff is the least score that begins inside the draw. Only documents at or above it are numbered, by
doc_id within their score. Suffix sums run over groups of 2^BITS neighbouring scores, whose own counts are summed up the same way, level by
level, until a level has at most TOP rows; only that one comes to the driver.

What the driver holds: BUCKETS counts of either side, and TOP counts of scores. All else grows with the input and stays distributed.

Defined results: a null or empty text, or one without words, has no features and weight 0; it counts as a document of few words. A null doc_id has
noise of its own (of the empty id) and comes last among ties; repeated rows are documents of their own. Without target texts, or
without documents, all gains follow from zero counts. Other columns but the text stay; one that has the name of a result is replaced by it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

BUCKETS = 10_000
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Scores of a group differ in their lowest BITS bits.
BITS, TOP = 10, 65_536
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULTS = ("n_features", "weight", "score", "rank")


def lowered(word: Column) -> Column:
    return F.when(word.rlike("[A-Z]"), F.translate(word, UPPER, LOWER)).otherwise(word)


def words(texts: DataFrame, *others: Column) -> DataFrame:
    """others and _w, the words as they stand (letters A-Z are lowered with the features)."""
    return texts.select(*others, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), 0).alias("_w"))


def features(longest: int) -> Column:
    """An array of all runs of 1 to `longest` words of _w: each length's runs are the shorter ones with a word more."""
    word, runs = F.col("_w"), [F.col("_w")]
    for k in range(2, longest + 1):
        n = F.greatest(F.size(word) - k + 1, F.lit(0))
        runs.append(F.zip_with(F.slice(runs[-1], F.lit(1), n), F.slice(word, F.lit(k), n), lambda run, w: F.concat(run, F.lit(" "), w)))
    return F.flatten(F.array(*runs)) if longest > 1 else word


def bucket(feature: Column, buckets: int) -> Column:
    return F.crc32(lowered(feature).cast("binary")) % buckets


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, np.int64)
    for r in words(texts).select(F.explode(features(longest)).alias("f")).groupBy(bucket(F.col("f"), buckets).alias("b")).agg(F.count("*").alias("n")).collect():
        out[r.b] = r.n
    return out


def gains(of_docs: np.ndarray, of_target: np.ndarray) -> list[int]:
    """floor(1000 ln) of each bucket's share in the target over its share in the documents, both smoothed by one."""
    s_all, t_all, k = float(of_docs.sum()), float(of_target.sum()), len(of_docs)
    return [math.floor(1000 * math.log((float(t) + 1) * (s_all + k) / ((float(s) + 1) * (t_all + k)))) for s, t in zip(of_docs, of_target, strict=True)]


def noise(doc_id: Column, seed: int) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, gain: list[int], longest: int, seed: int) -> DataFrame:
    """The columns of docs but the text, with n_features, weight, score and the number of words."""
    held = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded to one literal
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", *RESULTS, "_w", "_f", "_words")]
    rows = words(docs, *others).select(*others, features(longest).alias("_f"), F.size("_w").alias("_words"))
    weight = F.aggregate("_f", F.lit(0).cast("long"), lambda sum_, f: sum_ + F.element_at(held, (bucket(f, len(gain)) + 1).cast("int")))
    rows = rows.select(*others, F.size("_f").cast("long").alias("n_features"), weight.alias("weight"), "_words")
    return rows.select(*others, "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), "_words")


def ranks_before(counts: DataFrame, own: Scratch, top: int = TOP, bits: int = BITS) -> DataFrame:
    """(score, n) with `before`: the sum of n over all greater scores."""
    levels = [counts]
    while levels[-1].count() > max(top, 2):  # shifts end at -1 and 0
        levels.append(own.keep(levels[-1].groupBy(F.shiftright("score", bits).alias("score")).agg(F.sum("n").alias("n")), "levels"))
    head = levels[-1].select("score", "n").toArrow()
    score, n = (head.column(k).to_numpy() for k in ("score", "n"))
    order = np.argsort(-score)
    before = np.cumsum(n[order]) - n[order]
    found = counts.sparkSession.createDataFrame(pa.table({"score": score[order].astype(np.int64), "n": n[order].astype(np.int64), "before": before.astype(np.int64)}))
    for level in reversed(levels[:-1]):
        above = found.select(F.col("score").alias("_group"), F.col("before").alias("_before"))
        w = Window.partitionBy("_group").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
        inside = level.withColumn("_group", F.shiftright("score", bits)).withColumn("_inside", F.coalesce(F.sum("n").over(w), F.lit(0)))
        found = own.keep(inside.join(above, "_group").select("score", "n", (F.col("_before") + F.col("_inside")).alias("before")), "ranks")
    return found


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, least_words: int = 20, seed: int = 2024, buckets: int = BUCKETS, top: int = TOP) -> DataFrame:
    """The columns of `docs` but the text, with n_features, weight, score and rank, which is null for what is not drawn.

    `percent` of the documents that have `least_words` words or more are drawn, those of the highest scores."""
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    with Scratch(docs.sparkSession) as own:
        rows = own.result(scored(docs, gain, longest, seed), "scored")
        fit = F.col("_words") >= least_words
        counts = own.keep(rows.where(fit).groupBy("score").agg(F.count("*").alias("n")), "scores")
        all_fit = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        drawn = percent * all_fit // 100
        inside = own.result(ranks_before(counts, own, top).where(F.col("before") < drawn).select("score", "before"), "drawn")
        cutoff = inside.agg(F.min("score")).first()[0]
    out = [F.col(f"`{c}`") for c in rows.columns if c != "_words"]
    if cutoff is None:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    high = fit & (F.col("score") >= cutoff)
    w = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features")
    ranked = rows.where(high).join(inside, "score").withColumn("rank", F.col("before") + F.row_number().over(w))
    ranked = ranked.select(*out, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return ranked.unionByName(rows.where(~high).select(*out, F.lit(None).cast("long").alias("rank")))
