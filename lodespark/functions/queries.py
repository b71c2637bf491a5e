"""Understanding of search queries as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed, text


def matches_any(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (c.rlike(p) for p in patterns))


def intent(query: Column) -> Column:
    q = F.trim(F.lower(query))
    return (
        F.when(matches_any(q, fixed.ARCHITECTURAL), "architectural")
        .when(matches_any(q, fixed.IMPLEMENTATION), "implementation")
        .when(text.any_in(q, fixed.FLOW_WORDS), "flow")
        .when(text.any_in(q, fixed.USAGE_WORDS), "usage")
        .otherwise("unknown")
    )


def is_architectural(query: Column) -> Column:
    return intent(query).isin("architectural", "usage")


def symbols(query: Column) -> Column:
    """Technical symbols of three kinds, the first of each spelling, at most ten."""
    got = F.concat(*(F.regexp_extract_all(query, F.lit(p), F.lit(1)) for p in fixed.SYMBOLS))
    got = F.filter(got, lambda s: F.length(s) >= 2)
    low = F.transform(got, lambda s: F.lower(s))
    first = F.filter(got, lambda s, i: F.array_position(low, F.lower(s)) == i + 1)
    return F.slice(first, 1, 10)


def arch_expansions(syms: Column) -> Column:
    own = F.flatten(F.transform(F.slice(syms, 1, 2), lambda s: F.array(F.concat(s, F.lit(" callers callees dependencies")), F.concat(s, F.lit(" integration usage pattern")))))
    return F.slice(F.concat(F.array(*map(F.lit, fixed.ARCH_EXPANSIONS)), own), 1, 5)


def is_vague(query: Column) -> Column:
    q = F.trim(F.lower(query))
    return (F.size(F.filter(F.split(q, r"\s+"), lambda x: x != "")) < 3) | text.any_in(q, fixed.VAGUE_PHRASES)


def skips_hyde(query: Column) -> Column:
    return text.any_in(F.lower(text.ws_norm(query)), fixed.HYDE_SKIP)


def fallback(query: Column, repo: Column) -> Column:
    """The query and two templates; one of those that differ only in case."""
    base = F.trim(query)
    hint = F.when(text.empty(repo) != "", F.concat(F.lit(" repo:"), repo)).otherwise("")
    all_ = F.array(base, F.trim(F.concat(base, F.lit(" implementation file path function"), hint)), F.trim(F.concat(base, F.lit(" call flow error handling signature"), hint)))
    return F.when(base == "", F.array().cast("array<string>")).otherwise(all_)


def clean_variants(base: Column, variants: Column) -> Column:
    """The base and up to two new variants that share a technical term and have eight characters."""
    b = text.ws_norm(base)
    tech = text.tech_terms(b)
    norm = F.transform(variants, text.ws_norm)
    ok = F.filter(norm, lambda v: (F.length(v) >= 8) & (F.lower(v) != F.lower(b)) & ((F.size(tech) == 0) | F.exists(tech, lambda t: F.contains(F.lower(v), t))))
    low = F.transform(ok, lambda v: F.lower(v))
    first = F.filter(ok, lambda v, i: F.array_position(low, F.lower(v)) == i + 1)
    return F.slice(F.concat(F.array(b), first), 1, 3)


def shaped(query: Column) -> Column:
    low = F.lower(query)
    found = F.filter(F.array(*map(F.lit, fixed.SHAPE_ANCHORS)), lambda a: F.contains(low, a))
    asks = F.contains(low, F.lit("explain")) & text.any_in(low, ["service", "module"]) & (F.size(found) > 0)
    return F.when(asks, F.concat(query, F.lit(" "), F.array_join(found, " "))).otherwise(query)


def adaptive_k(expansions: Column) -> tuple[Column, Column]:
    return F.least(F.lit(fixed.MAX_K), fixed.BASE_K + expansions * 5), F.lit(min(fixed.MAX_K, fixed.BASE_K))


def is_rate_limited(error: Column) -> Column:
    return text.any_in(F.lower(error), fixed.RATE_LIMIT_MARKS)


def is_transient(error: Column) -> Column:
    return text.any_in(F.lower(error), fixed.TRANSIENT_MARKS)
