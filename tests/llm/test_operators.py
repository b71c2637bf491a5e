"""Each operator against a brute-force version on the awkward table, and on the empty one."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import edge
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodespark.llm.queries import tokenizer

TOKENIZER = tokenizer("byte_bpe_50k.json")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def key(v):
    return (v is not None, v or 0)


# ---- n-gram Jaccard join --------------------------------------------------------------------------


def shingle_set(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(rows, k, percent):
    """By rows: the smallest doc_id reachable, equal sets and links joined."""
    sets = [shingle_set(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(sets[i]), least.get(find(i), d)) for i, (d, _) in enumerate(rows)), key=lambda r: (key(r[0]), r[1], key(r[2])))


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_join_matches_brute_force(spark, k, percent):
    from lodespark.llm.ngram_join import link_components

    rows = [r[:2] for r in edge.rows()]
    got = sorted((tuple(r) for r in link_components(edge.documents(spark), k, percent).select("doc_id", "n_shingles", "component_id").collect()), key=lambda r: (key(r[0]), r[1], key(r[2])))
    assert got == brute_components(rows, k, percent)


def test_join_of_a_chain_of_near_copies(spark):
    """A group whose members mostly do not link with each other, but are connected, and many copies of one text."""
    from lodespark.llm.ngram_join import link_components

    words = edge.prose(9, 150).split()
    rows = []
    for i in range(60):
        w = list(words)
        for j in range(i // 4):
            w[(j * 11) % 150] = f"x{j}"
        w[(i * 7) % 150] = f"own{i}"
        rows.append((i + 1, " ".join(w)))
    rows += [(100 + i, rows[5][1]) for i in range(40)] + [(200 + i, edge.prose(50 + i, 90)) for i in range(20)]
    got = sorted(tuple(r) for r in link_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_components(rows, 4, 85)


def test_buckets_and_hubs_in_parts(spark, monkeypatch):
    """The same groups when the last join and the walk over links deal out every bucket and node."""
    from lodespark.llm import ngram_join

    words = edge.prose(9, 150).split()
    rows = [(i + 1, " ".join([f"own{i}" if j == (i * 7) % 150 else f"x{j}" if j % 11 == 0 and j // 11 < i // 4 else w for j, w in enumerate(words)])) for i in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "PART", 3)
    monkeypatch.setattr(ngram_join, "MANY", 2)
    got = sorted(tuple(r) for r in ngram_join.link_components(frame, 4, 85).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_components(rows, 4, 85)


@pytest.mark.parametrize("middle", [None, 3, 1])
def test_rows_without_an_id_or_with_a_shared_one_link_by_their_own_sets(spark, middle):
    """A chain whose middle row alone has its set."""
    from lodespark.llm.ngram_join import link_components

    w = edge.prose(21, 100).split()
    texts = [" ".join([f"x{j}" if j in changed else t for j, t in enumerate(w)]) for changed in ((), range(6), (*range(6), 50))]
    rows = [(1, texts[0]), (middle, texts[1]), (2, texts[2]), (2, "a text of its own"), (middle, edge.prose(30, 40))]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in link_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()), key=lambda r: (key(r[0]), r[1], key(r[2])))
    assert got == brute_components(rows, 4, 85)
    assert [r[2] for r in got if r[1] == 97] == [1, 1, 1]


def test_wide_sketches_bound_the_difference_and_fold():
    from lodespark.llm.ngram_join import wide

    rng = np.random.default_rng(8)
    for n in (1, 3, 100, 128, 129, 1000, 5000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.append(a[: int(n * 0.9)], rng.integers(0, 2**63, int(n * 0.3) + 1).astype(np.uint64)))
        out, begin = wide(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        x, y = out[: begin[1]], out[begin[1] :]
        assert 64 * len(x) >= 2 * len(a) and 64 * len(y) >= 2 * len(b)
        while len(x) != len(y):
            x, y = (z if len(z) == min(len(x), len(y)) else z[: len(z) // 2] ^ z[len(z) // 2 :] for z in (x, y))
        apart, true = int(np.bitwise_count(x ^ y).sum()), len(np.setxor1d(a, b))
        assert apart <= true and (true - apart) % 2 == 0


def test_parity_sketch_bounds_the_difference():
    from lodespark.llm.ngram_join import sketch

    rng = np.random.default_rng(1)
    for _ in range(30):
        w = [f"w{x}" for x in rng.integers(0, 500, rng.integers(3, 200))]
        v = [x if rng.random() > 0.1 else "new" + x for x in w]
        t = [" ".join(w).encode(), " ".join(v).encode()]
        data = np.frombuffer(b"".join(t), np.uint8)
        _, _, narrow, _, _ = sketch(data, np.array([0, len(t[0]), len(data)]), 4, 85)
        apart = sum(bin(int(a ^ b)).count("1") for a, b in narrow)
        assert apart <= len(shingle_set(" ".join(w), 4) ^ shingle_set(" ".join(v), 4))


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_sets_share_a_key(percent):
    """The pigeonhole holds at the bound, for all sizes, empty blocks included."""
    from lodespark.llm import ngram_join as J

    rng = np.random.default_rng(2)
    for size in [*range(1, 40), 60, 90, 150, 400, 900]:
        for _ in range(4):
            a = rng.integers(0, 2**63, size).astype(np.uint64)
            other = int(rng.integers(int(np.ceil(size * percent / 100)), size + 1))
            b = a[:other].copy()
            spare = J.bound(size, other, percent) - (size - other)
            for i in range(spare // 2):
                b[i] = rng.integers(0, 2**63)
            keys = []
            for s in (np.unique(a), np.unique(b)):
                n = len(s)
                J_sets = J.sets
                J.sets = lambda data, off, k, s=s, n=n: (s, np.array([0, n]))
                try:
                    keys.append(set(J.sketch(np.zeros(1, np.uint8), np.array([0, 1]), 4, percent)[3].tolist()))
                finally:
                    J.sets = J_sets
            both = len(set(a.tolist()) & set(b.tolist()))
            if 100 * both >= percent * (len(set(a.tolist()) | set(b.tolist()))):
                assert keys[0] & keys[1], (size, other)


# ---- suffix-array dedup -----------------------------------------------------------------------------


def brute_removed(rows, length):
    """(spans, kept) by row; rows in the order (doc_id, nulls first)."""
    seen, out = set(), {}
    for i in sorted(range(len(rows)), key=lambda i: (key(rows[i][0]), i)):
        raw = (rows[i][1] or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        out[i] = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
    return out


def test_repeats_match_brute_force(spark):
    from lodespark.llm.suffix_dedup import remove_repeats

    docs = edge.documents(spark).coalesce(1)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted((key(r.doc_id), r.n_bytes, bytes(r.kept)) for r in remove_repeats(docs).select("doc_id", "n_bytes", "kept").collect())
    want = brute_removed(rows, 100)
    assert got == sorted((key(d), len((t or "").encode()), want[i]) for i, (d, t) in enumerate(rows))


def test_repeats_in_many_blocks(spark, monkeypatch):
    from lodespark.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 4000)
    passage = edge.prose(77, 30)
    rows = [(i, f"{edge.prose(i, 60)} {passage if i % 3 else passage[:120]} {edge.prose(i % 4, 30)}") for i in range(80)]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    got = {r.doc_id: bytes(r.kept) for r in out.collect()}
    assert got == brute_removed(rows, 100)


def test_loser_tree_merges_and_knows_prefixes():
    from lodespark.llm.suffix_dedup import Run, _common, _front_code, merge

    rng = np.random.default_rng(3)
    runs, all_keys = [], []
    for n in (5, 0, 40, 1, 17):
        keys = sorted({bytes(rng.integers(97, 99, rng.integers(1, 12)).astype(np.uint8)) for _ in range(n)})
        all_keys += keys
        lcp, rest, raw = _front_code(keys)
        runs.append(Run(len(runs), lcp.tobytes(), rest.tobytes(), raw))
    got = list(merge(runs))
    assert [k for _, k, _, _ in got] == sorted(all_keys)
    assert [n for n, *_ in got[1:]] == [_common(a[1], b[1], 0) for a, b in zip(got, got[1:], strict=False)]


# ---- decontamination ----------------------------------------------------------------------------------


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def brute_hits(text, items, window):
    w = alnum(text)
    hit, ids = set(), set()
    for i, t in items:
        iw = alnum(t)
        if i is None or not iw:
            continue
        n = min(window, len(iw))
        wins = {tuple(iw[s : s + n]) for s in range(len(iw) - n + 1)}
        for p in range(len(w) - n + 1):
            if tuple(w[p : p + n]) in wins:
                hit |= set(range(p, p + n))
                ids.add(str(i))
    return len(w), len(hit), sorted(ids)


ITEMS = [(1, edge.prose(1, 60)), (2, "one"), (3, "two words"), (4, None), (5, ""), (None, "one"), (6, edge.prose(2, 30)), (7, "Two, WORDS!"), (10, edge.prose(4, 13)), (10, edge.prose(4, 13))]


@pytest.mark.parametrize("block", [1 << 24, 300])
def test_hits_match_brute_force(spark, block):
    from lodespark.llm.decontaminate import find_contamination

    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = find_contamination(edge.documents(spark), items, block_bytes=block)
    got = sorted((key(r.doc_id), r.text or "", r.n_words, r.n_hit, list(r["items"])) for r in out.collect())
    assert got == sorted((key(r[0]), r[1] or "", *brute_hits(r[1], ITEMS, 13)) for r in edge.rows())


def test_long_items_in_runs_and_clashing_columns(spark, monkeypatch):
    from lodespark.llm import decontaminate

    items = [*ITEMS, (20, edge.prose(40, 400)), (21, edge.prose(41, 100) + " " + edge.prose(40, 60))]
    texts = [edge.prose(40, 400), edge.prose(50, 30) + " " + " ".join(edge.prose(40, 400).split()[90:140]), edge.prose(41, 120), "", None]
    docs = spark.createDataFrame([(i, t, "a", "b", "c", "d", "e", 7) for i, t in enumerate(texts)], "doc_id long, text string, n_words string, spans string, items string, _items string, row string, n_hit long")
    for run_words, block in ((decontaminate.RUN_WORDS, 8 << 20), (30, 8 << 20), (30, 700)):
        # a long item is one of more characters than RUN_WORDS
        monkeypatch.setattr(decontaminate, "RUN_WORDS", run_words)
        out = decontaminate.find_contamination(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
        assert out.columns == ["doc_id", "text", "_items", "row", "n_words", "spans", "items", "n_hit"]
        got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in out.collect()}
        assert got == {i: brute_hits(t, items, 13) for i, t in enumerate(texts)}


def test_no_items(spark):
    from lodespark.llm.decontaminate import find_contamination

    out = find_contamination(edge.documents(spark), spark.createDataFrame([], "item_id long, text string"))
    assert out.where("n_hit <> 0").count() == 0 and out.count() == len(edge.rows())


# ---- tokens: records and packing -------------------------------------------------------------------------


def all_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_encoder_equals_the_library():
    import random

    from lodespark.llm.tokens import Encoder

    rng = random.Random(5)
    parts = ["a", "É", "ß", " ", "  ", "\n", "\t", "1", "'s", "don't", ".", "!!", "<|endoftext|>", "中", "　", "​", "\x1c", "\U0001f600", "\x00", "İ", "\xa0", " x", "word"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [t or "" for t in edge.texts()]
    assert [x.tolist() for x in Encoder(TOKENIZER).encode(texts)] == all_ids(texts)


def test_records_round_trip(spark):
    from lodespark.llm.records import token_records

    rows = sorted(((r[0], r[1] or "") for r in edge.rows()), key=lambda r: (key(r[0]), r[1]))
    at, want = 0, []
    for (d, _), ids in zip(rows, all_ids([t for _, t in rows]), strict=True):
        want.append((key(d), at, [*ids, 2]))
        at += len(ids) + 1
    got = [(key(r.doc_id), r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in token_records(edge.documents(spark), TOKENIZER).collect()]
    assert sorted(got, key=lambda r: r[1]) == want


def test_record_checksums():
    from lodespark.llm.records import frame, unframe

    raw = frame(b"payload")
    assert bytes(unframe(raw)[0]) == b"payload" and unframe(raw)[1] == len(raw)
    for k in range(len(raw)):
        bad = bytearray(raw)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            unframe(bytes(bad))
    with pytest.raises(ValueError):
        unframe(raw[:-2])


def check_packing(pieces, want_ids, size):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    for d, ps in by_doc.items():
        raw = want_ids[d]
        assert sum(p.length for p in ps) == sum(len(x) for x in raw)
        for p in ps:
            assert any(zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 and p.doc_tokens == len(x) for x in raw)
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
    assert sorted(by_seq) == list(range(len(by_seq)))
    return len(by_seq)


def test_packing_places_each_id_once(spark):
    from lodespark.llm.packing import pack

    rows = edge.rows()
    want = defaultdict(list)
    for r, ids in zip(rows, all_ids([r[1] for r in rows]), strict=True):
        want[r[0]].append([*ids, 1])
    check_packing(pack(edge.documents(spark), TOKENIZER, size=64).collect(), want, 64)


def test_patterns_use_up_the_histogram():
    from lodespark.llm.packing import patterns, slots

    rng = np.random.default_rng(4)
    hist = {int(n): int(c) for n, c in zip(*np.unique(rng.integers(1, 129, 5000), return_counts=True), strict=True)}
    found = patterns(hist, 128)
    used = defaultdict(int)
    for n, lengths in found:
        assert sum(lengths) <= 128
        for x in lengths:
            used[x] += n
    assert dict(used) == hist
    padded = sum(n for n, _ in found) * 128
    assert padded <= 1.02 * sum(k * v for k, v in hist.items())
    rows = slots(found)
    assert (np.lexsort((rows[:, 1], rows[:, 0])) == np.arange(len(rows))).all()


# ---- TIFF -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("compression", [1, 5, 8, 32773])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_tiff_round_trip(compression, predictor, tile):
    from lodespark.llm import tiff

    rng = np.random.default_rng(6)
    images = [rng.integers(0, high, shape).astype(np.uint8) for high in (3, 256) for shape in ((10, 64, 3), (1, 1, 1), (130, 70, 1))]
    out = list(tiff.pages(tiff.write(images, compression, predictor, tile=tile)))
    assert [p.error for p in out] == [None] * len(images)
    assert [p.pixels for p in out] == [i.tobytes() for i in images]


def test_tiff_by_hand():
    """A big-endian file of one 16-bit page with the horizontal predictor, and a bilevel one, written out byte by byte."""
    import struct

    from lodespark.llm import tiff

    def build(tags, data):
        head = struct.pack(">2sHI", b"MM", 42, 8 + len(data))
        body = b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in sorted(tags))
        return head + data + struct.pack(">H", len(tags)) + body + b"\0\0\0\0"

    data = struct.pack(">4H", 10, 5, 65535, 1)  # 10, 15 / 65535, 0
    page = next(tiff.pages(build([(256, 3, 2), (257, 3, 2), (258, 3, 16), (259, 3, 1), (273, 4, 8), (277, 3, 1), (278, 3, 2), (279, 4, 8), (317, 3, 2)], data)))
    assert page.error is None and np.frombuffer(page.pixels, "<u2").tolist() == [10, 15, 65535, 0]
    page = next(tiff.pages(build([(256, 3, 10), (257, 3, 1), (258, 3, 1), (259, 3, 1), (273, 4, 8), (279, 4, 2)], b"\xa5\x40")))
    assert page.error is None and list(page.pixels) == [1, 0, 1, 0, 0, 1, 0, 1, 0, 1]


def test_tiff_columns(spark):
    from lodespark.llm import tiff
    from lodespark.llm.queries import op5_tiff  # noqa: F401

    out = tiff.digest_texts(edge.documents(spark)).collect()
    want = sorted(((key(r[0]), (r[1] or "").encode()) for r in edge.rows()))
    assert sorted((key(r.doc_id), bytes(r.payload)) for r in out) == [(d, t + b" " * (-len(t) % 192 or (0 if t else 192))) for d, t in want]
    by = defaultdict(set)
    for r in out:
        by[bytes(r.payload)].add((bytes(r.media), r.feature))
    assert all(len(v) == 1 for v in by.values())
    files = tiff.store_texts(edge.documents(spark)).select("doc_id", "media").unionByName(spark.createDataFrame([(900, None), (901, bytearray(b"junk")), (902, bytearray(b"II*\0\x08\0\0\0"))], "doc_id long, media binary"))
    rows = tiff.read_pages(files).collect()
    assert {r.doc_id for r in rows if r.error} == {900, 901, 902} and len(rows) == len(want) + 3


# ---- language ID ------------------------------------------------------------------------------------------


def test_kneser_ney_shares_out_at_most_one():
    """What is missing to one is kept for characters that were never seen."""
    from lodespark.llm.langid import BOS, EOS, CharModel, _flatten, _grams

    model = CharModel.fit(["abc", "abd", "bca", "cab", "aab"], np.array([5.0, 3, 2, 1, 1]), 3)
    codes, _, _ = _flatten(["abc", "abd", "bca", "cab", "aab"])
    symbols = sorted(set(codes.tolist()) - {BOS})
    assert EOS in symbols
    for context in ("", "a", "ab", "ca", "zz"):
        total = 0.0
        for s in symbols:
            own = np.array([BOS, *map(ord, context), s], np.uint64)
            keys, at = zip(*(np.unique(g, return_inverse=True) for g in _grams(own, 3)), strict=True)
            total += np.exp(model.log_probs(keys, at, np.arange(len(own)))[-1])
        assert 0.9 < total < 1 + 1e-6, context


def test_languages_are_told_apart(spark, sf):
    from lodespark.llm.langid import language_id

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.where("lang = lang_pred").count() >= 0.95 * out.count()


def test_language_edges(spark):
    from lodespark.llm.langid import language_id

    for docs in (edge.documents(spark), edge.documents(spark).withColumn("lang", F.lit(None).cast("string"))):
        out = language_id(docs).collect()
        assert len(out) == len(edge.rows())
        for r in out:
            assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or "")) or r.lang_pred == "und" and docs.where("lang is not null").isEmpty()
            assert 0 <= r.lang_score <= 1


# ---- quality and toxicity -----------------------------------------------------------------------------------


def _auc(rows):
    rows = sorted(rows)
    ones = [i for i, (_, y) in enumerate(rows) if y]
    n1, n0 = len(ones), len(rows) - len(ones)
    return (sum(ones) - n1 * (n1 - 1) / 2) / (n1 * n0)


@pytest.mark.parametrize("name,label,least", [("quality", "quality", 0.95), ("toxicity", "toxic", 0.8)])
def test_classifiers_on_held_out_rows(spark, name, label, least):
    import importlib

    module = importlib.import_module(f"lodespark.llm.{name}")
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    out = getattr(module, f"score_{name}")(docs, labels).where("held_out").join(labels, "doc_id").select("score", label).collect()
    assert _auc([tuple(r) for r in out]) >= least


@pytest.mark.parametrize("name", ["quality", "toxicity"])
@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)], [(i, i % 2, i % 2) for i in range(1, 19)] + [(1, None, None), (None, 1, 1), (1, 1, 1)]])
def test_classifier_edges(spark, name, labels):
    import importlib

    module = importlib.import_module(f"lodespark.llm.{name}")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = getattr(module, f"score_{name}")(edge.documents(spark), table).collect()
    assert len(out) == len(edge.rows())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out is not None for r in out)


def test_gapped_words_keep_most_of_their_weight():
    from lodespark.llm import toxicity

    texts = [f"{edge.prose(i, 30)} {'moron' if i % 2 else 'table'} {edge.prose(i + 500, 30)}" for i in range(200)]
    machine = toxicity.fit(texts, np.array([i % 2 for i in range(200)]))
    words = ["moron", "m.o.r.o.n", "mor*on", "moxron", "m0ron", "table", "alpha"]
    w = dict(zip(words, machine.word_weights([toxicity.clean(x) for x in words]), strict=True))
    assert w["moron"] > 0 and all(w[x] > 0.4 * w["moron"] for x in words[:5]) and max(w["table"], w["alpha"]) < 0.4 * w["moron"]
    assert toxicity.tokens("you m o r o n there") == ["you", "moron", "there"]


def test_sentence_decisions_follow_from_the_kernel():
    """Scores from the definition: subsequences counted one by one, landmarks weighted, documents pooled."""
    from itertools import combinations

    from lodespark.llm import toxicity as T

    def subsequences(w, known):
        w = [c if c in known else (i, c) for i, c in enumerate(w)]  # a character of no landmark is like no other
        out = defaultdict(float)
        for i, j, k in combinations(range(len(w)), 3):
            if k - i < T.SPAN:
                out[w[i], w[j], w[k]] += T.DECAY ** (k - i + 1)
        size = sum(v * v for v in out.values())
        return {t: v / np.sqrt(size + 1e-9) for t, v in out.items()}

    def kernel(u, v, known):
        a, b = subsequences(u, known), subsequences(v, known)
        return sum(a[t] * b.get(t, 0) for t in a) ** T.POWER

    bad = ["moron", "trash", "idiot"]
    texts = [f"{edge.prose(i, 25)}. {edge.prose(i + 900, 5)} {bad[i % 3] if i % 2 else 'table'} {edge.prose(i + 500, 30)}" for i in range(160)]
    machine = T.fit(texts, np.array([i % 2 for i in range(160)]))
    assert set(bad) <= set(machine.landmarks)
    known = set("".join(machine.landmarks))
    for t in ["you mor-on.", "what an id1ot you are. fine day", "alpha beta gamma", "", None, "x" * 60 + " trash", "t r a s h talk " * 30]:
        lines = []
        for s in T.sentences(t):
            pieces = [p for w in set(s) for p in T.pieces(T.clean(w))]
            lines.append(sum(a * kernel(p, m, known) for p in pieces for m, a in zip(machine.landmarks, machine.alpha, strict=True)) + machine.bias)
        capped = np.minimum(lines, 8)
        got = machine.scorer()([t])
        assert got[0] == pytest.approx([capped.max(), np.log(np.exp(capped).mean())], rel=1e-6, abs=1e-6)
    assert (machine.scale[:2] >= 0).all()
    p = machine.scores(machine.scorer()(["you moron", "you mo.ron", "a fine alpha"]))
    assert p[0] > 0.7 and p[1] > 0.7 and p[2] < 0.5


def test_no_letter_is_left_out():
    """Insults of a second script, and what stands late in a long word, count like others."""
    from lodespark.llm import toxicity as T

    letters = "абвгдежзийклмнопрстуфхцчшщъыьэюяαβγδεζηθικλμνξοπρστυφχψω"
    bad = ["дурак", "".join(letters[i] for i in range(30, 36)), "moron"]
    clean = lambda i: " ".join("".join(letters[(i * 7 + j * 5 + k * k) % len(letters)] for k in range(6)) for j in range(20))
    texts = [f"{clean(i)} {'a' * 40 + bad[i % 3] if i % 4 == 1 else bad[i % 3] if i % 2 else 'table'}" for i in range(240)]
    machine = T.fit(texts, np.array([i % 2 for i in range(240)]))
    p = machine.scores(machine.scorer()([f"{clean(999)} {b}" for b in bad] + [clean(1001), f"{clean(999)} {'a' * 40}{bad[0]}"]))
    assert (p[:3] > 0.5).all() and p[3] < p[:3].min() and p[4] > p[3]


def test_rules_compile_to_the_same_scores(spark):
    from lodespark.llm.quality import STATS, Rules, fit_rules, statistics, with_statistics

    rng = np.random.default_rng(7)
    x = np.array([statistics(edge.prose(i, 5 + i % 50) + (" !!" * (i % 3 * 10))) for i in range(300)])
    rules = fit_rules(x, (np.arange(300) % 3 == 0).astype(int) ^ (rng.random(300) < 0.02))
    assert isinstance(rules, Rules) and rules.rules
    got = {r.doc_id: r.score for r in with_statistics(edge.documents(spark)).select("doc_id", rules.expression().alias("score")).collect() if r.doc_id and r.doc_id > 3}
    for d, t in ((r[0], r[1]) for r in edge.rows() if r[0] and r[0] > 3):
        s = dict(zip(STATS, statistics(t), strict=True))
        z = rules.intercept + sum(w for w, parts in rules.rules if all((s[f] <= v) == below for f, below, v in parts))
        assert got[d] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-9)


# ---- HTML ---------------------------------------------------------------------------------------------------


def test_parser_keeps_the_article_only():
    from lodespark.llm.html_tree import parse

    page = """<html><head><title>t</title><style>p{}</style></head><body><nav><a>menu</a></nav><div class="cookie-notice">cookies</div>
    <div id=sidebar><p>side</p></div><article><h1>Title &amp; more</h1><p>First <b>bold</b>&nbsp;text<p>Second<br>line<script>var a="</p>";</script>
    <form><input value=1>form</form><ul><li>item one<li>item two</ul><div class="ad">buy</div></article><section class="comments"><p>reply</p></section><footer>foot</footer>"""
    blocks, _ = parse(page)
    assert [t for _, t, off, main in blocks if main and not off] == ["Title & more", "First bold text", "Second line", "item one", "item two"]
    assert {t for _, t, off, _ in blocks if off} == {"menu", "cookies", "side", "form", "buy", "reply", "foot"}


def test_style_tree_drops_what_a_site_repeats(spark):
    from lodespark.llm.html_tree import extract

    page = lambda i: f"<div class=top><p>Welcome to our site</p></div><div class=body><p>{edge.prose(i, 20)}</p><p>{edge.prose(i + 90, 20)}</p></div><div class=bottom><p>All rights</p></div>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(20)] + [(100, None, None), (101, "http://x/", ""), (102, "http://x/", "plain <b>text"), (103, None, "<p>unclosed"), (0, "http://h.example/0", page(0))]
    got = sorted((r.page_id, r.text) for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    want = [(i, f"{edge.prose(i, 20)}\n\n{edge.prose(i + 90, 20)}") for i in range(20)] + [(0, f"{edge.prose(0, 20)}\n\n{edge.prose(90, 20)}"), (100, ""), (101, ""), (102, "plain text"), (103, "unclosed")]
    assert got == sorted(want)


def _site(n, article=False):
    """Pages of one host: a repeated head and foot, an article of its own with a repeated line in it, and text beside it that differs from page to page."""
    tag = "article" if article else "div"
    return [f"<div class=top><p>Welcome to our site</p></div><{tag} class=body><p>{edge.prose(i, 20)}</p><p class=line>This text was first seen elsewhere</p></{tag}><div class=extra><p>{edge.prose(i + 300, 25)}</p></div><div class=bottom><p>All rights</p></div>" for i in range(n)]


def _brute_floors(htmls):
    """Least importance on the way to each path, from the definition: distinct pages only."""
    from math import log

    from lodespark.llm.html_tree import GAMMA, MIN_PAGES, parse

    pages = [parse(h) for h in sorted(set(htmls))]
    shown, held, styles = defaultdict(int), defaultdict(int), defaultdict(list)
    for blocks, taken in pages:
        for x in {b[:2] for b in blocks}:
            shown[x] += 1
        for p in {b[0] for b in blocks}:
            held[p] += 1
        for p, s in taken.items():
            styles[p].append(s)
    value = {x: 1 - log(c) / log(held[x[0]]) if held[x[0]] > 1 else 1.0 for x, c in shown.items()}
    importance, many = {}, {}
    for path in {p[:k] for p, _ in value for k in [*(i for i, ch in enumerate(p) if ch == "/" and i), len(p)]}:
        below = [v for (p, _), v in value.items() if p == path or p.startswith(path + "/")]
        below = sum(below) / len(below)
        own, m = styles.get(path, []), len(styles.get(path, []))
        node = -sum(own.count(s) / m * log(own.count(s) / m) for s in set(own)) / log(m) if m > 1 else 1.0 if m else below
        importance[path], many[path] = (1 - GAMMA) * node + GAMMA * below, max(m, held[path])
    out = {}
    for path in importance:
        way = [q for q in importance if (path == q or path.startswith(q + "/")) and many[q] >= MIN_PAGES]
        if way:
            out[path] = min(importance[q] for q in way)
    return out


@pytest.mark.parametrize("article", [False, True])
def test_tree_equals_brute_force_and_decides(spark, monkeypatch, article):
    from lodespark.llm import html_tree

    htmls = [*_site(7, article), _site(3, article)[2]]
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    tree, _ = html_tree.style_tree(html_tree.parse_pages(pages))
    got = {r.path: r.floor for r in html_tree.branches(tree).collect()}
    assert got == pytest.approx(_brute_floors(htmls))
    want = [f"{edge.prose(i, 20)}\n\n{edge.prose(i + 300, 25)}" for i in (*range(7), 2)]
    texts = lambda: [r.text for r in html_tree.extract(pages).orderBy("page_id").collect()]
    assert texts() == want
    monkeypatch.setattr(html_tree, "BROADCAST_ENTRIES", 0)
    assert texts() == want
    monkeypatch.setattr(html_tree, "MIN_PAGES", 100)  # without the tree
    plain = f"{edge.prose(0, 20)}\n\nThis text was first seen elsewhere"
    assert texts()[0] == (plain if article else f"Welcome to our site\n\n{plain}\n\n{edge.prose(300, 25)}\n\nAll rights")


def test_pages_with_clashing_columns_and_very_long_html(spark):
    from lodespark.llm.html_tree import extract

    names = ["page_id", "url", "html", "text", "noisy", "common", "host", "row", "page", "blocks", "styles", "copy", "floors", "page_hash", "_"]
    long = "<article>" + "".join(f"<p>{edge.prose(i, 200)}</p>" for i in range(1500)) + "</article>"
    rows = [(1, "http://h/", "<p>a &lt; b</p>", *"tncorpbsyfh_"), (2, None, long, *[None] * 12), (2, None, long, *[None] * 12)]
    out = extract(spark.createDataFrame(rows, "page_id long, url string, html string, " + ", ".join(f"`{n}` string" for n in names[3:])))
    assert sorted(out.columns) == sorted(n for n in names if n != "html")
    got = {r.page_id: r.asDict() for r in out.collect()}
    assert out.count() == 3 and got[1] == dict(zip(names[4:], "ncorpbsyfh_", strict=True)) | {"page_id": 1, "url": "http://h/", "text": "a < b"}
    assert got[2]["text"] == "\n\n".join(edge.prose(i, 200) for i in range(1500))


# ---- empty tables and the pipeline -----------------------------------------------------------------------------


def test_empty_tables(spark):
    from lodespark.llm import decontaminate, html_tree, langid, ngram_join, packing, quality, records, suffix_dedup, tiff, toxicity

    none = edge.documents(spark, empty=True)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (
        quality.score_quality(none, labels), ngram_join.link_components(none), html_tree.extract(pages), records.token_records(none, TOKENIZER), tiff.digest_texts(none),
        decontaminate.find_contamination(none, spark.createDataFrame([], "item_id long, text string")), toxicity.score_toxicity(none, labels), packing.pack(none, TOKENIZER), langid.language_id(none), suffix_dedup.remove_repeats(none),
    ):
        assert df.count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf = str(tmp_path)
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = edge.documents(spark)
    out = dict.fromkeys(n for n, _ in corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf)
        docs.write.parquet(f"{sf}/{name.replace(' ', '_')}")
        docs = spark.read.parquet(f"{sf}/{name.replace(' ', '_')}")
        out[name] = docs.collect()
        if name != "packing":
            assert docs.columns == before.columns
    # language ID: only texts without letters go
    assert sorted(key(r.doc_id) for r in out["language ID"]) == sorted(key(r[0]) for r in edge.rows() if re.search(r"[^\W\d_]", r[1] or ""))
    # near duplicates: one row of each component, rows without an id stay
    rows = [(r.doc_id, r.text) for r in out["language ID"]]
    heads = {d for d, _, c in brute_components(rows, 5, 80) if d is not None and d == c}
    assert sorted(key(r.doc_id) for r in out["n-gram Jaccard join"]) == sorted([key(d) for d in heads] + [key(None) for d, _ in rows if d is None])
    # repeats: what brute force keeps, whole characters only
    rows = [(r.doc_id, r.text) for r in out["n-gram Jaccard join"]]
    kept = brute_removed(rows, 100)
    want = sorted((key(d), kept[i].decode("utf-8", "ignore")) for i, (d, t) in enumerate(rows) if kept[i].strip() or kept[i] == t.encode())
    assert sorted((key(r.doc_id), r.text) for r in out["suffix-array dedup"]) == want
    given = {(r[0], r[1]): r[4] for r in edge.rows()}  # a row of another text under a known id has that text's n_chars
    assert all(r.n_chars == given.get((r.doc_id, r.text), len(r.text)) for r in out["suffix-array dedup"])
    # benchmark: the contract's rule
    clean = [r for r in out["suffix-array dedup"] if not (lambda n, h, _: h > 0 and 20 * h >= n)(*brute_hits(r.text, ITEMS, 13))]
    assert sorted((key(r.doc_id), r.text) for r in out["benchmark decontamination"]) == sorted((key(r.doc_id), r.text) for r in clean)
    want_ids = defaultdict(list)
    for r, ids in zip(clean, all_ids([r.text for r in clean]), strict=True):
        want_ids[r.doc_id].append([*ids, 1])
    check_packing(out["packing"], want_ids, 2048)


def test_queries_give_the_contract_columns(spark, sf):
    from lodespark.llm.queries import QUERIES

    want = {
        "op1": "doc_id held_out score predicted", "op2": "doc_id n_shingles component_id", "op3": "page_id url text n_chars", "op4": "doc_id start n_tokens ids_crc32", "op5": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
        "op6": "doc_id n_words n_hit n_items items_sha256 contaminated", "op7": "doc_id held_out score predicted", "op8": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op9": "doc_id held_out lang_pred score", "op10": "doc_id n_bytes n_removed n_spans kept_sha256",
    }
    assert sorted(n.split("_")[0] for n in QUERIES) == sorted(want)
    for name, f in QUERIES.items():
        assert set(want[name.split("_")[0]].split()) <= set(f(spark, sf).columns), name


def test_sha_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
