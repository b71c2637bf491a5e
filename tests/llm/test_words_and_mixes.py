"""Spelling variants, importance resampling and source mixing against brute-force versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import edge
import pytest


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def plain(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r))


# ---- spelling variants ----------------------------------------------------------------------------


def one_edit(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def brute_variants(docs, least, occurs, ratio, every):
    n = Counter()
    for d, t in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= occurs}
    near = {w: [v for v in n if one_edit(v, w)] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v)) if near[w] else None for w in n}
    form = {w: f if f and n[f] >= ratio * n[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return plain((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def variants(spark, docs, least, occurs, ratio, every):
    from lodespark.llm.spelling import spelling_variants

    frame = docs if hasattr(docs, "columns") else spark.createDataFrame(docs, "doc_id long, text string")
    return plain(spelling_variants(frame, least, occurs, ratio, every).select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("letters,size,every", [("ab", 5, 0), ("abc", 4, 3), ("aàbÿ", 4, 7), ("a", 9, 0)])
def test_variants_of_dense_tries(spark, letters, size, every):
    rng = random.Random(len(letters) * size)
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, size)))
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(40)]
    got = variants(spark, docs, 2, 1, 2, every)
    assert got == brute_variants(docs, 2, 1, 2, every) and len(got) > 7


def test_each_pair_is_met_once(spark):
    from lodespark.llm.common import Scratch
    from lodespark.llm.spelling import keyed, near_pairs

    words = sorted({"".join(p) for n in range(1, 6) for p in __import__("itertools").product("ab", repeat=n)} | {"aab" * 5, "aab" * 5 + "a", "x"})
    with Scratch(spark) as own:
        table = own.keep(keyed(spark.createDataFrame([(w, 1) for w in words], "word string, n long")), "words")
        got = [tuple(sorted((r.a, r.b))) for r in near_pairs(table, own).collect()]
    want = [(v, w) for v in words for w in words if v < w and one_edit(v, w)]
    assert len(got) == len(set(got)) and set(got) == set(want)


@pytest.mark.parametrize("wide", [True, False])
def test_nodes_with_most_words_are_broadcast_or_joined(spark, monkeypatch, wide):
    from lodespark.llm import spelling

    monkeypatch.setattr(spelling, "WIDE", 10**6 if wide else -1)
    rng = random.Random(3)
    docs = [(i, " ".join("".join(rng.choice("abcde") for _ in range(5)) for _ in range(150))) for i in range(8)]
    assert variants(spark, docs, 3, 1, 3, 11) == brute_variants(docs, 3, 1, 3, 11)


def test_variants_of_the_awkward_table(spark):
    rows = [r[:2] for r in edge.rows()]
    for least, occurs, every in ((6, 5, 199), (2, 1, 2)):
        assert variants(spark, edge.documents(spark), least, occurs, 5, every) == brute_variants(rows, least, occurs, 5, every)
    assert variants(spark, edge.documents(spark, empty=True), 6, 5, 5, 199) == []


def test_a_very_long_word_and_a_chain_of_forms(spark):
    long = "ab" * 60_000
    docs = [(1, f"{long} {long}c {long[:-1]}"), (2, " ".join(["chainedx"] * 125 + ["chainedxy"] * 25 + ["chainedxyz"] * 5 + ["chainedxyzz"]))]
    got = {r[0]: r for r in variants(spark, docs, 6, 1, 5, 0)}
    assert got[long][4] == 2 and got[long + "c"][4] == 1
    assert [got[w][2] for w in ("chainedx", "chainedxy", "chainedxyz", "chainedxyzz")] == ["chainedx"] * 4
    assert got["chainedxyzz"][1] == "chainedxyz"


# ---- importance resampling ------------------------------------------------------------------------


def brute_draw(docs, target, percent, longest, least, seed, buckets):
    def found(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(b for _, x in docs for b in found(x)[1]), Counter(b for x in target for b in found(x)[1])
    sa, ta = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (sa + buckets) / ((s[b] + 1.0) * (ta + buckets)))) for b in range(buckets)]
    rows = []
    for d, x in docs:
        words, f = found(x)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = i + 1
    return plain(r[:5] for r in rows)


def drawn(spark, docs, target, **how):
    from lodespark.llm.resample import resample

    return plain(resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), **how).select("doc_id", "n_features", "weight", "score", "rank").collect())


@pytest.mark.parametrize("percent,longest,least,top", [(10, 1, 20, 65_536), (50, 1, 1, 3), (100, 2, 0, 1), (37, 3, 2, 5), (0, 1, 20, 9)])
def test_draw_matches_brute_force(spark, percent, longest, least, top):
    target = [edge.prose(3, 40), None, "", "ALPHA beta 7 été"]
    got = drawn(spark, edge.documents(spark), target, percent=percent, longest=longest, least_words=least, top=top, buckets=50)
    assert got == brute_draw([r[:2] for r in edge.rows()], target, percent, longest, least, 2024, 50)


def test_draw_with_ties_and_many_scores(spark):
    rows = [(i // 2, edge.prose(i % 7, 25 + i % 3)) for i in range(400)]  # every id twice
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for top in (4, 65_536):
        assert drawn(spark, frame, [edge.prose(2, 60)], percent=30, top=top) == brute_draw(rows, [edge.prose(2, 60)], 30, 1, 20, 2024, 10_000)


def test_draw_of_empty_tables(spark):
    assert drawn(spark, edge.documents(spark, empty=True), ["x"]) == []
    rows = [r[:2] for r in edge.rows()]
    assert drawn(spark, edge.documents(spark), []) == brute_draw(rows, [], 10, 1, 20, 2024, 10_000)


def test_suffix_sums_over_levels(spark):
    from lodespark.llm.common import Scratch
    from lodespark.llm.resample import ranks_before

    rng = random.Random(1)
    rows = {rng.randint(-(10**12), 10**12) if i % 2 else rng.randint(-500, 500): rng.randint(1, 9) for i in range(300)}
    with Scratch(spark) as own:
        found = ranks_before(spark.createDataFrame(list(rows.items()), "score long, n long"), own, top=2, bits=4).collect()
    assert {r.score: r.before for r in found} == {s: sum(n for x, n in rows.items() if x > s) for s in rows}


# ---- mixing ---------------------------------------------------------------------------------------


def water(sizes, weights, percent, most):
    """Targets by sharing the excess again and again, in fractions."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, open_ = Fraction(sum(sizes.values()) * percent, 100), {}, set(names)
    while open_:
        total = sum(w[s] for s in open_)
        above = {s for s in open_ if left * w[s] / total >= most * sizes[s]}
        if not above:
            return {**out, **{s: left * w[s] / total for s in open_}}
        for s in above:
            out[s] = Fraction(most * sizes[s])
        left, open_ = left - sum(out[s] for s in above), open_ - above
    return out


def mixed(spark, docs, **how):
    from lodespark.llm.mixing import mix

    return mix(docs, **how).collect()


def held(rows, given, weights=(1, 2, 3), percent=100, most=3):
    """Checks a mix of (doc_id, source, text) rows; the words by which each source misses its target."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(((r.doc_id is None, r.doc_id or 0), r["size"]) for r in rows) == sorted(((d is None, d or 0), size(t)) for d, _, t in given)
    total = Counter()
    for _, s, t in given:
        total[s] += size(t)
    want, off = water(total, weights, percent, most), {}
    for s in total:
        own = [r for r in rows if r.source == s]
        assert all(r.source_size == total[s] and abs(r.target - float(want[s])) <= 1e-6 * max(1, want[s]) for r in own)
        assert all(0 <= r.taken <= most * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0) for r in own)
        off[s] = sum(r.taken for r in own) - float(want[s])
    return off


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


@pytest.mark.parametrize("weights,percent,most", [((1, 2, 3), 100, 3), ((5, 40, 1, 1), 60, 2), ((1, 2), 300, 3)])
def test_mix_meets_its_targets(spark, weights, percent, most):
    rng = random.Random(7)
    rows = [(i, rng.choice(["a", "b", "B", "é", None, "\U0001f600"]), " ".join(["w"] * min(4000, int(rng.paretovariate(0.9) * 10)))) for i in range(600)]
    got = mixed(spark, table(spark, rows), weights=weights, percent=percent, most=most)
    off = held(got, rows, weights, percent, most)
    assert max(map(abs, off.values())) <= 10
    if percent == 100:
        again = mixed(spark, table(spark, rows[::-1]).repartition(3), weights=weights, percent=percent, most=most)
        assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_rates_are_tilted_exponentially(spark):
    """Expected copies of a source's documents are exp(lambda size): a constant ratio of logarithms."""
    from lodespark.llm.common import Scratch
    from lodespark.llm.mixing import balance, rate

    cells = spark.createDataFrame([("a", s, n) for s, n in ((1, 50), (10, 30), (100, 9), (1000, 1))] + [("b", s, 4) for s in (5, 7, 11)], "_key string, size long, n long")
    sources = spark.createDataFrame([("a", 2250, 90, 1500.0), ("b", 92, 12, 230.0)], "_key string, source_size long, docs long, target double")
    with Scratch(spark) as own:
        rows = cells.join(balance(cells, sources, 3, own), "_key").withColumn("r", rate(3)).collect()
    for key, target in (("a", 1500.0), ("b", 230.0)):
        part = [r for r in rows if r._key == key]
        assert abs(sum(r["size"] * r.n * r.r for r in part) - target) < 1e-5 * target
        free = [r for r in part if r.r < 3]
        lam = [math.log(r.r) / r["size"] for r in free]
        assert len(free) >= 2 and max(lam) - min(lam) < 1e-9


def test_a_hot_cell_is_numbered_in_slices(spark):
    rows = [(i, "hot", "one two three") for i in range(20_000)] + [(50_000 + i, "rare", "x " * (1 + i)) for i in range(20)]
    got = mixed(spark, table(spark, rows))
    assert max(map(abs, held(got, rows).values())) <= 3
    per = Counter(r.taken // r["size"] for r in got if r.source == "hot")
    assert len(per) <= 2 and max(per) - min(per) <= 1


def test_whole_copies_stay_by_the_rates():
    import pandas as pd
    from lodespark.llm.mixing import whole_copies

    rng = random.Random(2)
    cells = pd.DataFrame([(s, rng.randint(1, 5), rng.random() * 3) for s in range(1, 400)], columns=["size", "n", "r"])
    out = whole_copies(cells, 3)
    assert (out["copies"] >= out["n"] * out["r"].map(math.floor)).all() and (out["copies"] <= out["n"] * out["r"].map(math.ceil)).all()
    assert abs((out["copies"] * out["size"]).sum() - (out["n"] * out["r"] * out["size"]).sum()) <= 1


def test_mix_of_the_awkward_table_and_the_empty_one(spark):
    given = [(r[0], r[3], r[1]) for r in edge.rows()]
    docs = edge.documents(spark).withColumn("taken", edge_lit("own")).withColumn("n-chars", edge_lit(1)).withColumn("a.b c", edge_lit(2))
    got = mixed(spark, docs)
    assert {"n-chars", "a.b c", "lang", "score"} <= set(got[0].asDict())
    off = held(got, given)
    assert max(map(abs, off.values())) <= 60  # few documents, of up to 20,000 words
    assert mixed(spark, edge.documents(spark, empty=True)) == []
    none = table(spark, [(1, "a", None), (2, "a", ""), (None, None, "one"), (None, None, "one")])
    assert sorted((r["size"], r.target, r.taken) for r in mixed(spark, none)) == [(0, 0.0, 0), (0, 0.0, 0), (1, 2.0, 1), (1, 2.0, 1)]


def edge_lit(v):
    from pyspark.sql import functions as F

    return F.lit(v)
