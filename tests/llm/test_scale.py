"""Sizes and cases that the given tables do not reach."""

from __future__ import annotations

import edge
import numpy as np
import pytest


@pytest.mark.parametrize("parts", [1, 7, 65_536, 65_537, 400_000])
def test_parts_follow_the_keys(parts):
    from lodespark.llm.ngram_join import part_of

    key = np.sort(np.append(np.random.default_rng(5).integers(0, 1 << 48, 50_000), [0, (1 << 48) - 1]).astype(np.uint64))
    part = part_of(key, parts)
    assert [int(p) for p in part] == [(int(k) >> 16) * parts >> 32 for k in key]
    assert (part[1:] >= part[:-1]).all() and part[0] == 0 and part[-1] == parts - 1


def kept(page):
    from lodespark.llm.html_tree import parse

    return [t for _, t, off, _ in parse(page)[0] if not off]


@pytest.mark.parametrize("start", ["<html><head><title>t</title><meta charset=utf-8><style>p{}</style>", "<head><script>x</script>", "<head><noscript><img>"])
def test_head_may_stay_open(start):
    assert kept(f"{start}<body><article><p>one<p>two</article>") == ["one", "two"]


def test_head_ends_at_the_first_block_or_text():
    assert kept("<head><title>t</title><link rel=x><p>one</p><p>two</p>") == ["one", "two"]
    assert kept("<head><title>t</title> \n text <b>bold</b>") == ["text bold"]


@pytest.mark.parametrize("tag", "iframe object noscript select svg video audio canvas template math".split())
def test_unclosed_elements_end_with_their_parent(tag):
    assert kept(f"<p>one</p><div><{tag} x=1><a>gone</a></div><p>two</p>") == ["one", "two"]
    assert kept(f"<p>one <{tag}><b>gone</b></{tag}> more</p><p>two</p>") == ["one more", "two"]
    assert kept(f"<ul><li>one<li><{tag}>gone</ul><p>two</p>") == ["one", "two"]


def test_blocks_in_what_is_gone_split_nothing():
    assert kept("<p>one <noscript><div>gone</div></noscript> more</p>") == ["one more"]
    assert kept("<article>one <svg><path d='x'><p>two</p></article>") == ["one", "two"]
    assert kept("<p>one</p><script>var a = '<p>gone</p>'") == ["one"]


def texts(spark, htmls):
    from lodespark.llm.html_tree import extract

    rows = [(i, f"http://h.example/{i}", h) for i, h in enumerate(htmls)]
    return [r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


@pytest.mark.parametrize("n", [4, 12])
@pytest.mark.parametrize("main", ["article", "div"])
def test_near_copies_keep_their_text(spark, n, main):
    says = [edge.prose(k, 40) for k in range(3)]
    body = "".join(f"<p>{t}</p>" for t in says)
    ads, dates = (texts(spark, [x(i) for i in range(n)]) for x in (
        lambda i: f"<div class=ad>buy {i}</div><{main}>{body}</{main}><section class=comments>{edge.prose(i + 50, 30)}</section>",
        lambda i: f"<{main}><time>day {'abcdefghijkl'[i]}</time>{body}</{main}>",
    ))
    assert ads == ["\n\n".join(says)] * n
    assert dates == ["\n\n".join([f"day {'abcdefghijkl'[i]}", *says]) for i in range(n)]


def test_an_article_is_not_noise_as_a_whole(spark):
    pages = [f"<div class=top>{edge.prose(i + 20, 30)}</div><article><p>the same few words</p></article>" for i in range(6)]
    pages += [f"<div class=top>{edge.prose(i + 40, 30)}</div><article><p>the same few words</p><h2>{edge.prose(i, 3)}</h2></article>" for i in range(6)]
    got = texts(spark, pages)
    top = [edge.prose(i + k, 30) for k in (20, 40) for i in range(6)]  # beside the article, but another on each page
    assert got[:6] == [f"{t}\n\nthe same few words" for t in top[:6]]
    assert got[6:] == [f"{t}\n\n{edge.prose(i, 3)}" for i, t in enumerate(top[6:])]


SAID = "the first of many words about it"
WRAPPED = [
    f"<div class='content-with-sidebar'><article><p>{SAID}</p></article><div class=sidebar>side</div></div>",
    f"<div class='layout has-sidebar'><article><p>{SAID}</p></article><aside>side</aside></div>",
    f"<form id='aspnetForm'><nav>menu</nav><article><p>{SAID}</p></article><div class=footer>foot</div></form>",
    f"<article class='category-discussion'><p>{SAID}</p></article>",
    f"<div class=ad>buy</div><article class='post with-sidebar'><p>{SAID}</p></article>",
    f"<form id='aspnetForm'><nav>menu</nav><div id=content><p>{SAID}</p></div><div class=footer>foot</div></form>",
    f"<div class=sidebar-layout><main><article><p>{SAID}</p></article></main></div><section class=comments><article class=comment><p>{SAID} is wrong</p></article></section>",
]


@pytest.mark.parametrize("page", WRAPPED)
def test_marks_of_a_wrapper_do_not_hide_the_article(page):
    assert kept(page) == [SAID]


@pytest.mark.parametrize("page", [
    f"<article><p>{SAID}</p></article><section class=comments><article><p>{SAID} {SAID}</p></article></section>",
    f"<div id=content><p>{SAID}</p></div><aside><article><p>{SAID} {SAID}</p></article></aside>",
    f"<main><p>{SAID}</p></main><div hidden><article><p>{SAID} {SAID}</p></article></div>",
    f"<div id=content><p>{SAID}</p></div><div class=comments><article>reply</article></div>",
])
def test_marks_of_other_articles_stand(page):
    assert kept(page) == [SAID]


def test_wrapped_articles_of_a_host_are_whole(spark):
    says = [edge.prose(i, 40) for i in range(12)]
    for wrap in ("<div class='content-with-sidebar'><article><p>{}</p></article></div>", "<form id=aspnetForm><article><p>{}</p></article></form>", "<article class='category-discussion'><p>{}</p></article>"):
        assert texts(spark, [wrap.format(t) for t in says]) == says


def test_words_of_a_sentence_are_no_adverts():
    assert kept("<p>Buy <span class=share>a share</span> <a class='social ad'>now</a></p>") == ["Buy a share now"]


@pytest.mark.parametrize("tag", ["div", "div class=ad", "span", "b", "ul><li", "section class=x"])
def test_deep_pages_cost_their_length(tag):
    from time import monotonic

    began = monotonic()
    assert kept("<p>one</p>" + f"<{tag}>" * 20_000 + "<p>two") == (["one"] if "ad" in tag else ["one", "two"])
    found = kept("".join(f"<{tag}> text {i}" for i in range(20_000)) + "</div>" * 20_000)
    assert len(" ".join(found).split()) == 40_000 if "ad" not in tag else True
    assert monotonic() - began < 20


def test_deep_pages_in_a_site(spark):
    deep = "".join(f"<div>text {i}" for i in range(20_000))
    got = texts(spark, [deep, f"<article>{deep}</article>", *(f"<div><p>{edge.prose(i, 30)}</p></div>" for i in range(5))])
    assert [len(t.split()) for t in got] == [40_000, 40_000, *(len(edge.prose(i, 30).split()) for i in range(5))]


def test_pairs_of_a_bucket_in_parts(spark, monkeypatch):
    """All pairs of different components that sizes and narrow sketches allow, whatever the parts."""
    from lodespark.llm import ngram_join

    rng = np.random.default_rng(4)
    base = rng.integers(-(2**63), 2**63 - 1, 4)
    rows = [(k % 3, int(i % 5), (int(i), int(90 + i % 7), *(int(x) for x in base ^ (1 << rng.integers(0, 60, 4))))) for k in range(3) for i in range(40 * k + 5)]
    members = spark.createDataFrame(rows, "key int, comp int, m struct<node:long,n:int,s0:long,s1:long,s2:long,s3:long>")
    near = lambda x, y: 100 * min(x[1], y[1]) >= 85 * max(x[1], y[1]) and 185 * sum(bin((a ^ b) & (2**64 - 1)).count("1") for a, b in zip(x[2:], y[2:], strict=True)) <= 15 * (x[1] + y[1])
    want = sorted((x[0], y[0]) for k, c, x in rows for j, d, y in rows if k == j and c != d and x[0] < y[0] and near(x, y))
    for part in (2000, 7, 1):
        monkeypatch.setattr(ngram_join, "PART", part)
        assert sorted(tuple(r) for r in ngram_join._pairs(members, 85).collect()) == want
    assert len(want) > 100


def test_pairs_of_long_texts_need_equal_wide_sketches(spark, monkeypatch):
    """A family of long sets, alike but not linked, gives the pairs that link and no others: narrow sketches of long sets tell nothing."""
    from lodespark.llm import ngram_join

    rng = np.random.default_rng(7)
    common = rng.integers(0, 2**63, 1200).astype(np.uint64)
    all_sets = [np.unique(np.concatenate([common, rng.integers(0, 2**63, 400).astype(np.uint64)])) for _ in range(24)]
    all_sets += [np.unique(np.append(s[:-40], rng.integers(0, 2**63, 40).astype(np.uint64))) for s in all_sets[:3]]
    first = np.append(0, np.cumsum([len(s) for s in all_sets]))
    node, narrow = ngram_join.named(np.concatenate(all_sets), first)
    bits, begin = ngram_join.wide(np.concatenate(all_sets), first)
    node, narrow, bits = node.view(np.int64), narrow.view(np.int64), bits.view(np.int64)
    rows = [(1, int(node[i]), (int(node[i]), len(all_sets[i]), *(int(w[i]) for w in narrow), bits[begin[i] : begin[i + 1]].tolist())) for i in range(len(all_sets))]
    members = spark.createDataFrame(rows, "key int, comp long, m struct<node:long,n:int,s0:long,s1:long,s2:long,s3:long,wide:array<long>>")
    want = sorted(tuple(sorted((int(node[i]), int(node[24 + i])))) for i in range(3))
    for part in (2000, 5):
        monkeypatch.setattr(ngram_join, "PART", part)
        assert sorted(tuple(r) for r in ngram_join._pairs(members, 85).collect()) == want


def test_stages_give_the_drivers_memory_back(monkeypatch):
    import corpus_pipeline

    given = []
    monkeypatch.setattr(corpus_pipeline, "_left", [])
    monkeypatch.setattr(corpus_pipeline, "release", lambda: given.append(1), raising=False)
    assert corpus_pipeline._stage(lambda spark, docs, sf_dir: docs)(None, None, "") is None
    assert given == [1]


def test_columns_of_any_name(spark):
    """Names that are no identifiers, at the top and inside a struct, come out as they went in."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    from lodespark.llm import decontaminate, html_tree, langid, mixing, resample, suffix_dedup, tiff

    text = edge.prose(1, 150)
    docs = spark.createDataFrame([(1, text, "en", "s", 5), (2, text, "en", "s", 5), (3, edge.prose(2, 80), None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    odd = F.struct(F.lit(1).alias("n-chars"), F.struct(F.lit("x").alias("a.b c")).alias("in side")).alias("o")
    docs = docs.select("*", F.lit(1).alias("n-chars"), F.lit(2).alias("my col"), F.lit(3).alias("x.y"), odd)
    items = spark.createDataFrame([(7, edge.prose(5, 30))], "item_id long, text string")
    models = langid.fit(docs.select("doc_id", "text", "lang"))
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://h/").alias("url"), F.col("text").alias("html"), *(F.col(f"`{c}`") for c in docs.columns[5:]))
    for out in (
        decontaminate.find_contamination(docs, items), langid.identify(docs, models), suffix_dedup.remove_repeats(docs), tiff.store_texts(docs), tiff.read_pages(tiff.store_texts(docs)), html_tree.extract(pages),
        mixing.mix(docs), resample.resample(docs, items), *(stage for _, stage in corpus_pipeline.STAGES[:3]),
    ):
        out = out(spark, docs, "") if callable(out) else out
        got = {tuple(r) for r in out.select("`n-chars`", "`my col`", "`x.y`", F.to_json("o")).collect()}
        assert got == {(1, 2, 3, '{"n-chars":1,"in side":{"a.b c":"x"}}')}
