"""Scores, boosts and confidence as column expressions. All constants are doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed, text


def rrf(rank: Column) -> Column:
    """Reciprocal rank, ranks from 0."""
    return F.lit(1.0) / (F.lit(float(fixed.RRF_K)) + rank + 1)


def bm25_idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_tf(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (fixed.K1 + 1) / (tf + fixed.K1 * (1 - fixed.B + fixed.B * length / mean))


def _slashes(c: Column) -> Column:
    return F.replace(F.lower(text.empty(c)), F.lit("\\"), F.lit("/"))


def path_boost(query: Column, path: Column) -> Column:
    """How far a query names a chunk's file."""
    b = fixed.EXACT_BOOST
    q, p = F.trim(_slashes(query)), F.trim(_slashes(path))
    name = text.basename(p)
    same = (q != "") & ((q == p) | F.endswith(q, p) | F.endswith(p, q))
    toks = text.exact_tokens(q)
    shared = F.size(F.array_intersect(toks, text.found(p, fixed.PATH_TOKEN)))
    weight = F.when(query.rlike("[/.]"), 0.65).otherwise(0.35)
    return (
        F.when(text.empty(path) == "", 0.0)
        .when(same, min(b * 1.2, 0.55))
        .when((name != "") & F.contains(q, name), min(b * 0.65, 0.45))
        .when((F.size(toks) == 0) | (shared == 0), 0.0)
        .otherwise(F.lit(b) * weight * (shared / F.size(toks)))
    )


def exact_boost(query: Column, repo: Column, path: Column, name: Column, parent: Column, signature: Column, content: Column) -> Column:
    """The share of a query's entity tokens that a chunk holds anywhere; its path or name in the query counts more."""
    b = fixed.EXACT_BOOST
    q = F.lower(query)
    toks = text.entity_tokens(query)
    hay = F.lower(F.concat_ws(" ", *(text.empty(c) for c in (repo, path, name, parent, signature, content))))
    hits = F.size(F.filter(toks, lambda t: F.contains(hay, t)))
    share = F.lit(b) * (hits / F.size(toks))
    low = F.lower(text.empty(name))
    named = (low != "") & F.contains(q, low)
    lp = F.lower(text.empty(path))
    return (
        F.when(F.size(toks) == 0, 0.0)
        .when((lp != "") & F.contains(q, lp), b * 0.95)
        .when(hits == 0, 0.0)
        .otherwise(F.when(named, F.greatest(share, F.lit(b * 0.7))).otherwise(share))
    )


def type_penalty(path: Column) -> Column:
    p = F.lower(path)
    return (
        F.when(text.any_in(p, ["_test.", "test_", "/test/", ".test.", "spec."]), -0.15)
        .when(text.any_in(p, ["mock", "stub", "fake"]), -0.20)
        .when(text.any_in(p, ["fixture"]), -0.15)
        .otherwise(0.0)
    )


def usage_boost(path: Column, name: Column) -> Column:
    p, n = F.lower(path), F.lower(text.empty(name))
    out = F.lit(0.0)
    for words in fixed.USAGE_PATHS:
        out = out + F.when(text.any_in(p, words), 0.05).otherwise(0.0)
    return F.least(F.lit(0.15), out + F.when(text.any_in(n, fixed.USAGE_NAMES), 0.03).otherwise(0.0))


def confidence(top: Column, gap: Column, hits: Column, distinct: Column) -> Column:
    return F.least(F.lit(1.0), 0.45 * top + 0.25 * gap + 0.15 * F.least(F.lit(1.0), hits / 2.0) + 0.15 * F.least(F.lit(1.0), distinct / 3.0))


def reasons(top: Column, gap: Column, hits: Column, distinct: Column) -> Column:
    parts = [(top < 0.35, "low_top_score"), (gap < 0.05, "weak_top_gap"), (hits == 0, "no_exact_identifier_hits"), (distinct < fixed.MIN_EVIDENCE, "insufficient_distinct_evidence")]
    got = F.filter(F.array(*(F.when(c, name) for c, name in parts)), lambda x: x.isNotNull())
    return F.when(F.size(got) == 0, F.array(F.lit("high_confidence_retrieval"))).otherwise(got)


def metadata_boost(query: Column, *meta: Column) -> Column:
    toks = text.exact_tokens(query)
    hay = F.lower(F.concat_ws(" ", *(text.empty(c) for c in meta)))
    return F.least(F.lit(0.40), F.size(F.filter(toks, lambda t: F.contains(hay, t))) * F.lit(0.10))


def rerank_path_boost(query: Column, path: Column) -> Column:
    q, p = _slashes(query), _slashes(path)
    name = text.basename(p)
    toks = text.exact_tokens(query)
    inside = text.found(p, fixed.PATH_TOKEN)
    hits = F.size(F.filter(toks, lambda t: F.array_contains(inside, t) | F.contains(name, t)))
    return (
        F.when(text.empty(path) == "", 0.0)
        .when(((name != "") & F.contains(q, name)) | F.contains(q, p) | F.contains(p, q), 0.45)
        .when(query.rlike("[/.]"), F.least(F.lit(0.45), hits * F.lit(0.06)))
        .otherwise(F.least(F.lit(0.25), hits * F.lit(0.06)))
    )


def lexical_score(query: Column, content: Column) -> Column:
    """The stand-in reranking model: the share of a query's tokens that the content holds."""
    toks = F.array_distinct(text.tokenize(query))
    own = text.tokenize(content)
    return F.when(F.size(toks) == 0, 0.0).otherwise(F.size(F.array_intersect(toks, own)) / F.size(toks))


def metadata_context(repo, language, path, name, parent, signature) -> Column:
    parts = (("REPO", repo), ("LANG", language), ("PATH", path), ("FUNC", name), ("CLASS", parent), ("SIGNATURE", signature))
    return F.concat_ws("\n", *(F.when(text.empty(c) != "", F.concat(F.lit(f"{k}: "), c)) for k, c in parts))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
