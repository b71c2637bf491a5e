"""The facade: one method for each thing users ask of the engine, each giving a DataFrame.

Tables are DataFrames: chunks (id, content, repo, language, file_path, function_name, parent_class, signature, start_line,
end_line), vectors (id, v), nodes, edges, sessions, messages. `index` is a stored sparse index (sources.tables); without one, each search tokenises the
chunks. A search runs small jobs as it is planned, to bring its few query rows and hits to the driver; other results are lazy.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, scoring, text
from ..functions import queries as qf
from ..operators import graph, retrieval, state


@dataclass
class Engine:
    spark: SparkSession
    chunks: DataFrame
    vectors: DataFrame | None = None
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    messages: DataFrame | None = None
    index: dict | None = None

    @cached_property
    def tokens(self) -> DataFrame:
        return retrieval.token_table(self.chunks)

    @property
    def corpus(self) -> DataFrame | dict:
        return self.tokens if self.index is None else self.index

    # ---- search

    def sparse_search(self, queries: DataFrame, k: int = fixed.BASE_K) -> DataFrame:
        return retrieval.sparse_search(self.chunks, self.corpus, queries, k)

    def dense_search(self, query_vectors: DataFrame, k: int = fixed.BASE_K) -> DataFrame:
        return retrieval.knn(self.vectors, query_vectors, k)

    def hybrid_search(self, question: str, query_vectors: DataFrame | None = None, k: int = fixed.BASE_K, repo: str | None = None, prefilter: bool = False) -> DataFrame:
        """Ranked chunks with scores for one question: sparse and dense lists, rank fusion, boosts, first of each location.

        The repository filter comes after the sparse top k, as the reference has it; prefilter=True puts it before."""
        q = self.spark.createDataFrame([(0, question)], "qid int, q string")
        chunks = self.chunks.where(F.col("repo") == repo) if repo and prefilter else self.chunks
        corpus = retrieval.token_table(chunks) if repo and prefilter else self.corpus
        lists = retrieval.sparse_search(chunks, corpus, q, k).select("qid", "id", F.lit("sparse").alias("side"), "rank", F.lit(1.0).alias("weight"))
        if query_vectors is not None and self.vectors is not None:
            near = retrieval.knn(self.vectors, query_vectors.select(F.lit(0).alias("qid"), "qv"), k)
            lists = lists.unionByName(near.select("qid", "id", F.lit("dense").alias("side"), "rank", F.lit(1.0).alias("weight")))
        if repo and not prefilter:
            lists = lists.join(self.chunks.where(F.col("repo") == repo).select("id"), "id", "left_semi").select("qid", "id", "side", "rank", "weight")
        fused, few = retrieval.bounded(retrieval.fuse(lists))
        rows = retrieval.narrowed(chunks, "id", few).join(fused, "id")
        asked = F.lit(question)
        boost = scoring.exact_boost(asked, *(F.col(c) for c in ("repo", "file_path", "function_name", "parent_class", "signature", "content")))
        if_arch = F.when(qf.is_architectural(asked), scoring.type_penalty(F.col("file_path")) + scoring.usage_boost(F.col("file_path"), F.col("function_name"))).otherwise(0.0)
        score = F.col("dense") + F.col("sparse") + boost + if_arch + scoring.path_boost(asked, F.col("file_path"))
        rows = rows.withColumn("score", F.round(score, 9))
        key = text.chunk_key(*map(F.col, ("repo", "file_path", "start_line", "end_line")))
        return retrieval.ranked(retrieval.first_wins(rows, key, [F.desc("score"), F.col("id")]), k)

    def diagnostics(self, hits: DataFrame) -> DataFrame:
        """Confidence and its reasons from ranked hits (score, rank)."""
        one = hits.groupBy("qid").agg(
            F.max("score").alias("top"), F.greatest(F.lit(0.0), F.max("score") - F.avg(F.when(F.col("rank") < 3, F.col("score")))).alias("gap"),
            F.count_if(F.col("score") > 1).alias("hits"), F.count_distinct(F.when(F.col("rank") < 5, F.struct("file_path", "function_name"))).alias("distinct_n"),
        )
        parts = [F.col(c) for c in ("top", "gap", "hits", "distinct_n")]
        return one.select("qid", scoring.confidence(*parts).alias("confidence"), scoring.reasons(*parts).alias("reasons"))

    def rerank(self, hits: DataFrame, question: str, k: int = 10) -> DataFrame:
        """By the stand-in model's score with metadata and path boosts."""
        q = F.lit(question)
        meta = [F.col(c) for c in ("repo", "language", "file_path", "function_name", "parent_class", "signature")]
        score = scoring.lexical_score(q, text.middle_cut(F.col("content"))) + scoring.metadata_boost(q, *meta) + scoring.rerank_path_boost(q, F.col("file_path"))
        return retrieval.ranked(hits.withColumn("score", score).drop("rank"), k)

    def pack(self, hits: DataFrame, k: int, architectural: bool = False) -> DataFrame:
        if architectural:
            return retrieval.round_robin(hits.withColumn("component", text.component(F.col("file_path"))), "component", k, largest_first=True)
        return retrieval.round_robin(hits, "file_path", k)

    # ---- graph and wiki

    def neighbors(self, ids: DataFrame) -> DataFrame:
        return graph.neighbors(self.edges, ids)

    def call_graph(self, ids: DataFrame, depth: int = 2) -> DataFrame:
        return graph.reach(self.edges.where("type = 'CALLS'"), ids, min(max(depth, 1), 4))

    def file_dependencies(self, ids: DataFrame) -> DataFrame:
        return graph.touching(self.edges, ids)

    def repo_graph(self, repo: str) -> DataFrame:
        return graph.touching(self.edges, self.nodes.where(F.col("repo") == repo).select("id"))

    def wiki_tree(self, repo: str) -> DataFrame:
        sym = F.struct(F.col("function_name").alias("name"), "file_path")
        return self.chunks.where(F.col("repo") == repo).groupBy("file_path").agg(F.array_sort(F.collect_set(sym)).alias("symbols")).orderBy("file_path")

    def wiki_search(self, part: str, repo: str | None = None) -> DataFrame:
        own = self.chunks.where(F.contains("function_name", F.lit(part)) | F.contains("file_path", F.lit(part)))
        return (own.where(F.col("repo") == repo) if repo else own).orderBy("id").limit(20)

    # ---- tables

    def repos(self) -> DataFrame:
        return self.chunks.select("repo").distinct().orderBy("repo")

    def session(self, session_id) -> DataFrame:
        return self.messages.where(F.col("session_id") == session_id).orderBy("created_at")

    def delete_file(self, path: str, repo: str | None = None) -> Engine:
        gone = (F.col("file_path") == path) & ((F.col("repo") == repo) if repo else F.lit(True))
        return replace(self, chunks=self.chunks.where(~gone), index=None)  # a stored index is of the chunks it was made of

    def upsert_chunks(self, new: DataFrame) -> Engine:
        """New chunks replace all chunks of their files."""
        kept = self.chunks.join(new.select("repo", "file_path").distinct(), ["repo", "file_path"], "left_anti")
        return replace(self, chunks=state.upsert(kept, new, ["id"]), index=None)
