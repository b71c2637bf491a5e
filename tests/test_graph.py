"""Graph operators against plain Python on small graphs."""

from __future__ import annotations

from lodespark.operators import graph


def test_layers_go_as_deep_as_the_graph(spark):
    deep = 160  # hops against the order of ids
    edges = [(deep - i, deep - i - 1) for i in range(deep)] + [(deep, 50), (7, 7), (500, 501), (501, 500)]
    nodes = sorted({x for e in edges for x in e} | {900})
    got = dict(map(tuple, graph.bfs_layers(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "src long, dst long").coalesce(1)).collect()))
    want = {n: deep - n if n > 50 else 51 - n for n in range(deep + 1)} | {900: 0}
    assert got == want | {500: max(want.values()) + 1, 501: max(want.values()) + 2}


def test_a_stored_graph_reads_the_buckets_it_needs(spark, tmp_path):
    import random

    from lodespark.sources import adjacency

    rng = random.Random(2)
    pairs = sorted({(0 if rng.random() < 0.3 else rng.randrange(400), rng.randrange(400)) for _ in range(1500)})
    edges = spark.createDataFrame([*pairs, (None, 5), (5, None)], "src long, dst long")
    root = f"file://{tmp_path}/g"
    adjacency.persist_graph(edges, root, 16)
    own = adjacency.load_graph(edges, root, 16)
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "id long")
    rows = lambda df: sorted(map(tuple, df.collect()))
    start = {0, 17, 399, 1000}
    got = own.neighbors(ids(*start, None, 17)).where("neighbor is not null")
    assert rows(got) == sorted({(a, b) for a, b in pairs if a in start} | {(b, a) for a, b in pairs if b in start})
    level, front = {a: 0 for a, _ in pairs if a in {3, 17}}, {3, 17}
    for n in (1, 2):
        front = {b for a, b in pairs if a in front}
        for b in front:
            level.setdefault(b, n)
    level = {k: min(v, level[k]) for k, v in level.items()}
    assert dict(rows(own.reach(ids(3, 17), 2))) == level
    assert rows(own.touching(ids(17)).na.drop()) == sorted((a, b) for a, b in pairs if 17 in (a, b))
    assert rows(own.degrees()) == sorted((k, sum(a == k for a, _ in pairs) + (k == 5), sum(b == k for _, b in pairs) + (k == 5)) for k in {x for p in pairs for x in p} | {5})
    plan = own.hop(ids(17))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "In(src" in plan or "EqualTo(src,17)" in plan
    assert "Exchange hashpartitioning" not in plan
    many = ids(*range(400))  # more nodes than buckets
    assert rows(own.hop(many).na.drop()) == pairs


def test_a_stored_graph_without_edges(spark, tmp_path):
    from lodespark.sources import adjacency

    edges = spark.createDataFrame([], "src long, dst long")
    adjacency.persist_graph(edges, f"file://{tmp_path}/g")
    own = adjacency.load_graph(edges, f"file://{tmp_path}/g")
    start = spark.createDataFrame([(1,)], "id long")
    assert own.neighbors(start).count() == own.reach(start, 2).count() == own.degrees().count() == 0
    assert own.neighbors(start.limit(0)).count() == 0
