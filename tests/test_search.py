"""What searches ask for, and what they shuffle."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodespark.operators import retrieval
from lodespark.plans import catalog
from lodespark.plans import retrieval_queries as rq


def test_lists_search_for_the_queries_that_they_take(spark, sf, monkeypatch):
    own, seen = (retrieval.knn, retrieval.bm25), []

    def noted(search):
        def run(corpus, queries, *rest):
            seen.append(sorted(r.qid for r in queries.select("qid").collect()))
            return search(corpus, queries, *rest)

        return run

    monkeypatch.setattr(rq.ops, "knn", noted(own[0]))
    monkeypatch.setattr(rq.ops, "bm25", noted(own[1]))
    got = sorted(map(tuple, rq._lists(spark, sf).select("side", "id", "rank", "weight").collect()))
    assert sorted(seen) == [[1, 4], [50, 100]]
    sparse, dense = rq._sparse(spark, sf).collect(), rq._dense(spark, sf).collect()
    weights = {("sparse", 1): 1.0, ("sparse", 4): 0.75, ("dense", 50): 1.0, ("dense", 100): 0.8}
    assert got == sorted((s, r.id, r.rank, weights[s, r.qid]) for s, rows in (("sparse", sparse), ("dense", dense)) for r in rows if (s, r.qid) in weights)
    seen.clear()
    rq.jn_subquery_anti(spark, sf)
    assert [2] in seen


def test_documents_stay_where_they_are_when_items_are_looked_for(spark, monkeypatch):
    bodies = [(1, "a longword in here, twice longword"), (2, "nothing"), (3, None), (4, "x longword y"), (5, "")]
    texts = [(1, "a longword in"), (2, "x longword y"), (3, "thing"), (4, "longword  in"), (5, "y longword x")]
    docs, items = spark.createDataFrame(bodies, "id long, body string"), spark.createDataFrame(texts, "qid int, text string")
    want = sorted((q, i) for q, t in texts for i, b in bodies if b is not None and t in b)
    found = retrieval.holding(docs, items)
    assert sorted(map(tuple, found.collect())) == want == [(1, 1), (2, 4), (3, 2)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    monkeypatch.setattr(retrieval, "ITEM_BYTES", 0)
    assert sorted(map(tuple, retrieval.holding(docs, items).collect())) == want


def test_a_task_sums_no_more_than_half_a_million_scores(spark, sf):
    index = {**catalog.index(spark, sf)}
    index["stats"] = index["stats"].withColumn("n", F.lit(3_000_000).cast("long"))
    assert retrieval._hits(index, catalog.asked(spark).where("qid < 3")).rdd.getNumPartitions() >= 12
