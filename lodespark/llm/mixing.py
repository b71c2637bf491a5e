"""Mixing sources to target weights by entropy balancing.

Every source gets a target of words. Among all rates r (expected copies of a document) that meet a source's target, those nearest to one copy
each in relative entropy are exp(lambda x size), one multiplier lambda for each source: the dual is convex in lambda, and Newton steps on
the logarithm of its gradient find the root, kept inside a bracket. A rate stops at `most` copies. Documents of a source and size have one
rate, so each step sums over (source, size, n) cells, all sources at once, and its state is a small table in the shared folder.

Targets: sources in code-point order, null last, weigh `weights` in turn and share the budget; a target stops at `most` times its source's
size and the excess is shared again by weight until none is above.

Rounding: a source's cells, longest documents first, get whole numbers of copies that carry the words still owed to the next, shorter cell, between
the lower and the upper whole rate of their documents; what is then still owed may go beyond these, up to `most`. So the words taken differ from the
target by less than half a short document where any rounding can do that. A cell's copies are dealt to its documents evenly in the
order of a hash of the id.

Bounds: a source of W words has at most sqrt(2 W) cells, the only rows that one task takes for a source. The documents of a cell of n are numbered in about
sqrt(n) slices, and the slices in one window, so that neither a hot source nor a hot cell is one group. Sums are of decimals and integers, so that
reruns agree whatever the order in which rows arrive. Nothing but totals comes to the driver.

Defined results: a null or empty text has size 0, its target is its source's, and it takes 0 words; a source without words has target 0. Null sources are one
source. Null and repeated doc_ids are documents of their own (which of several equal rows takes a spare copy makes no difference to the rows). An
empty table stays empty. Other columns but the text stay; one that has the name of a result is replaced by it.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: The logarithm of taken over target at which a source's iteration ends, the most steps, and the steps from one table to the next.
NEAR, STEPS, CHAINED = 1e-7, 60, 4
RESULTS = ("size", "source_size", "target", "taken")
_EXACT = "decimal(38,12)"


def sized(docs: DataFrame) -> DataFrame:
    """The columns of docs but the text, with size, and the source as a key that is never null and sorts null last."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", *RESULTS, "_key")]
    source = F.col("source").cast("string")
    key = F.struct(source.isNull().alias("none"), F.coalesce(source, F.lit("")).alias("name"))
    return docs.select(*others, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("_key"))


def weighed(cells: DataFrame, weights: tuple[int, ...], own: Scratch) -> DataFrame:
    """_key, source_size, docs and the weight: sources are numbered in sorted ranges, of which only the counts of the ranges before are summed up."""
    rows = cells.groupBy("_key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    rows = rows.repartitionByRange("_key").sortWithinPartitions("_key").withColumn("_at", F.monotonically_increasing_id())
    rows = own.keep(rows.select("_key", "source_size", "docs", F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_nth")), "sources")
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each range
    turn = F.pmod(F.col("_before") + F.col("_nth"), F.lit(len(weights))).cast("int") + 1
    return own.keep(rows.join(before, "_part").select("_key", "source_size", "docs", F.element_at(F.array(*map(F.lit, weights)), turn).cast("long").alias("weight")), "weights")


def targets(sources: DataFrame, percent: int, most: int) -> Column:
    """The target of each of `sources`: its weight's share at the level at which the shares, none above its cap, make up the budget."""
    cap, weight = F.col("source_size") * most, F.col("weight")
    words, level_weight = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    budget, fixed, full = words * percent / 100, 0, -1
    while level_weight:
        level = (budget - fixed) / level_weight
        above = cap <= weight * F.lit(level)
        sums = sources.agg(F.coalesce(F.sum(F.when(above, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~above, weight)), F.lit(0)), F.count(F.when(above, 1))).first()
        if sums[2] == full:
            break
        fixed, level_weight, full = sums
    return F.least(cap.cast("double"), weight * F.lit(level)) if level_weight else cap.cast("double")


def rate(most: int) -> Column:
    """The tilted rate of a cell from its source's target and lambda."""
    cap = F.col("source_size") * most
    tilted = F.least(F.lit(float(most)), F.exp(F.col("lam") * F.col("size") / F.col("unit")))
    return F.when(F.col("size") == 0, 1.0).when(F.col("target") >= cap, float(most)).when(F.col("target") <= 0, 0.0).otherwise(tilted)


def balance(cells: DataFrame, sources: DataFrame, most: int, own: Scratch) -> DataFrame:
    """sources with lam and unit (the mean size): Newton steps for all sources at once."""
    state = own.keep(
        sources.select(
            "_key", "source_size", "target", F.greatest(F.col("source_size") / F.col("docs"), F.lit(1.0)).alias("unit"), F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("low"),
            F.lit(None).cast("double").alias("high"), ((F.col("target") > 0) & (F.col("target") < F.col("source_size") * most)).alias("open"),
        ),
        "dual",
    )
    for _ in range(STEPS // CHAINED):
        if state.where("open").isEmpty():
            break
        new = state
        for _ in range(CHAINED):
            new = _newton(cells, new, most)
        new = own.keep(new, "dual")
        own.drop(state)
        state = new
    return state


def _newton(cells: DataFrame, state: DataFrame, most: int) -> DataFrame:
    """The state after one step: for sources that are not there yet, along the slope if that stays inside the bracket."""
    words = F.col("size") * F.col("n") * F.col("r")
    slope = F.when(F.col("r") < most, words * F.col("size") / F.col("unit")).otherwise(0.0)
    sums = cells.join(state.where("open"), "_key").withColumn("r", rate(most))
    sums = sums.groupBy("_key").agg(F.sum(words.cast(_EXACT)).cast("double").alias("a"), F.sum(slope.cast(_EXACT)).cast("double").alias("b"))
    at = state.join(sums, "_key", "left").withColumn("off", F.when(F.col("a") > 0, F.log(F.col("target") / F.col("a"))).otherwise(math.inf))
    low = F.when(F.col("open") & (F.col("off") > 0), F.col("lam")).otherwise(F.col("low"))
    high = F.when(F.col("open") & (F.col("off") <= 0), F.col("lam")).otherwise(F.col("high"))
    at = at.select("_key", "source_size", "target", "unit", "lam", low.alias("low"), high.alias("high"), "open", "off", F.when(F.col("b") > 0, F.col("lam") + F.col("off") * F.col("a") / F.col("b")).alias("step"))
    within = F.col("step").isNotNull() & (F.coalesce(F.col("low"), F.lit(-math.inf)) < F.col("step")) & (F.col("step") < F.coalesce(F.col("high"), F.lit(math.inf)))
    beyond = F.when(F.col("high").isNull(), F.greatest(F.col("lam") * 2, F.lit(1.0))).when(F.col("low").isNull(), F.least(F.col("lam") * 2, F.lit(-1.0))).otherwise((F.col("low") + F.col("high")) / 2)
    more = F.col("open") & (F.abs("off") > NEAR)
    return at.select("_key", "source_size", "target", "unit", F.when(more, F.when(within, F.col("step")).otherwise(beyond)).otherwise(F.col("lam")).alias("lam"), "low", "high", more.alias("open"))


def whole_copies(cells: pd.DataFrame, most: int) -> pd.DataFrame:
    """copies of a source's cells (size, n, r), longest first, so that their words come to those of the rates."""
    cells = cells.sort_values("size", ascending=False, kind="stable")
    sizes, counts, rates = (cells[c].tolist() for c in ("size", "n", "r"))
    copies, owed = [], 0.0
    for s, n, r in zip(sizes, counts, rates, strict=True):
        want = n * r if s else n
        c = min(max(math.floor(want + (owed / s if s else 0) + 0.5), n * math.floor(r)), n * math.ceil(r))
        owed += (want - c) * s
        copies.append(c)
    for i, (s, n) in enumerate(zip(sizes, counts, strict=True)):
        if s and abs(owed) > s / 2:
            c = min(max(copies[i] + math.floor(owed / s + 0.5), 0), n * most)
            owed -= (c - copies[i]) * s
            copies[i] = c
    return cells.assign(copies=copies)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), percent: int = 100, most: int = 3) -> DataFrame:
    """The columns of `docs` but the text, with size, source_size, target (of the source) and taken: the document's words in the mix, all copies counted."""
    with Scratch(docs.sparkSession) as own:
        rows = own.result(sized(docs), "sizes")
        cells = own.keep(rows.groupBy("_key", "size").agg(F.count("*").alias("n")), "cells")
        sources = weighed(cells, weights, own)
        sources = own.keep(sources.withColumn("target", targets(sources, percent, most)), "targets")
        state = balance(cells, sources, most, own)
        rated = cells.join(state, "_key").select("_key.none", "_key.name", "size", "n", rate(most).alias("r"), "source_size", "target")
        dealt = rated.groupBy("none", "name").applyInPandas(lambda part: whole_copies(part, most), "none boolean, name string, size long, n long, r double, source_size long, target double, copies long")
        dealt = dealt.select(F.struct(F.coalesce("none", F.lit(False)).alias("none"), F.coalesce("name", F.lit("")).alias("name")).alias("_key"), "size", "n", "source_size", "target", "copies")
        dealt = own.result(dealt.withColumn("slices", F.greatest(F.ceil(F.sqrt("n")) / 8, F.lit(1)).cast("long")), "copies")
        # documents of a cell, numbered in slices
        at = rows.select("*", F.xxhash64("doc_id", F.lit("mix")).alias("_h")).join(dealt, ["_key", "size"]).withColumn("_slice", F.pmod("_h", "slices"))
        each = at.where("slices > 1").groupBy("_key", "size", "_slice").agg(F.count("*").alias("_n"))
        before = Window.partitionBy("_key", "size").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        each = own.result(each.select("_key", "size", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "slices")
    nth = F.row_number().over(Window.partitionBy("_key", "size", "_slice").orderBy("_h", F.col("doc_id")))
    at = at.join(each, ["_key", "size", "_slice"], "left").withColumn("_at", F.coalesce("_before", F.lit(0)) + nth)
    upto = lambda k: F.expr(f"({k}) * copies div n")
    out = [F.col(f"`{c}`") for c in rows.columns if c not in ("size", "_key")]
    return at.select(*out, "size", "source_size", "target", ((upto("_at") - upto("_at - 1")) * F.col("size")).alias("taken"))
