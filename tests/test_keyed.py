"""The keyed table of change streams against a plain dict."""

from __future__ import annotations

import os
import random

import pytest

from lodespark.streaming.keyed import KeyedTable

SCHEMA = "k string, change string, n long, at timestamp, v double"


def frame(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "k string, change string, n long, at double, v double").withColumn("at", F.timestamp_seconds("at"))


def made(spark, path, **options):
    from pyspark.sql.types import StructType

    return KeyedTable(spark, f"file://{path}", StructType.fromDDL(SCHEMA), "k", "n", **{"buckets": 16} | options)


def held(t):
    return sorted(((r.k, r.n, r.v) for r in t.current().select("k", "n", "v").collect()), key=repr)


def folders(path):
    return {(b, k) for b in os.listdir(f"{path}/data") for k in os.listdir(f"{path}/data/{b}") if k.startswith("_bucket=")}


def test_batches_in_any_order_and_again(spark, tmp_path):
    rng = random.Random(3)
    changes = [(f"k{rng.randrange(60)}", rng.choice("AMMD"), i, 1000.0 + i, i / 4) for i in range(400)] + [(None, "A", 500, None, 1.0)]
    rng.shuffle(changes)
    t = made(spark, tmp_path)
    for number in range(4):
        part = frame(spark, changes[number::4])
        t.apply(part, number)
        if number == 2:  # a batch that runs twice
            before = held(t)
            t.apply(part, number)
            assert held(t) == before
    last = {}
    for k, change, n, _, v in changes:
        if k not in last or n > last[k][1]:
            last[k] = (change, n, v)
    want = [(k, n, v) for k, (change, n, v) in last.items() if change != "D"]
    assert sorted(held(t), key=repr) == sorted(want, key=repr)


def test_a_batch_writes_only_its_buckets(spark, tmp_path):
    t = made(spark, tmp_path)
    first = t.apply(frame(spark, [(f"k{i}", "A", i, 1000.0, 0.0) for i in range(300)]), 0)
    assert len(first["buckets"]) == 16
    second = t.apply(frame(spark, [("k7", "M", 900, 1000.0, 1.0), ("k7", "D", 901, 1000.0, 1.0)]), 1)
    assert list(second["buckets"].values()).count(1) == 1 and sum(b == "batch=1" for b, _ in folders(tmp_path)) == 1
    assert len(held(t)) == 299
    t.apply(frame(spark, []), 2)
    t.apply(frame(spark, [("new", "A", 1000, 1000.0, 2.0)]), 5)  # numbers may leave gaps
    assert len(held(t)) == 300
    with pytest.raises(ValueError, match="16 buckets"):
        made(spark, tmp_path, buckets=8).apply(frame(spark, []), 6)


def test_old_versions_go_and_the_last_two_stay(spark, tmp_path):
    t = made(spark, tmp_path, buckets=1)
    for number in range(5):
        t.apply(frame(spark, [("a", "M", number, 1000.0, float(number))]), number)
    assert {b for b, _ in folders(tmp_path)} == {"batch=3", "batch=4"}
    assert held(t) == [("a", 4, 4.0)]


def test_marks_expire_behind_the_watermark(spark, tmp_path):
    t = made(spark, tmp_path, buckets=1, at="at", keep=100.0)
    t.apply(frame(spark, [("a", "A", 1, 1000.0, 1.0), ("b", "D", 2, 1000.0, 0.0)]), 0)
    t.apply(frame(spark, [("b", "A", 1, 990.0, 1.0), ("c", "A", 3, 1500.0, 1.0)]), 1)  # earlier change, the mark holds
    assert [k for k, *_ in held(t)] == ["a", "c"]
    t.apply(frame(spark, [("c", "M", 4, 1501.0, 2.0)]), 2)
    assert sorted(r.k for r in t._rows({"buckets": {"0": 2}}).collect()) == ["a", "c"]  # the mark is gone
    t.apply(frame(spark, [("b", "A", 1, 990.0, 1.0), ("d", "A", 5, 1450.0, 1.0)]), 3)  # late: dropped
    assert [k for k, *_ in held(t)] == ["a", "c", "d"]


def test_an_empty_table(spark, tmp_path):
    t = made(spark, tmp_path)
    assert held(t) == []
    t.apply(frame(spark, []), 0)
    assert held(t) == []
    t.apply(frame(spark, [("a", "D", 1, 1000.0, 0.0)]), 1)
    assert held(t) == []
