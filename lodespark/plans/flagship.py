"""The flagship query: hybrid search with fusion and boosts over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from .catalog import ASKED, CH, lit, query, s_exact, stored, table
from .engine import Engine
from .retrieval_queries import BM25, KNN, vectors
from .scalar_queries import _PATH_TOKENS, _SHARE

_Q = ASKED[0][1]


@query(
    f"""with {BM25}, {KNN}, {CH}, lists as (select id, 'sparse' side, rank from sparse where qid = 1 and rank < 20 union all select id, 'dense', rank from dense where qid = 50 and rank < 20),
raw as (select id, coalesce(sum(1.0::double / (10 + rank + 1)) filter (side = 'dense'), 0) ds, coalesce(sum(1.0::double / (10 + rank + 1)) filter (side = 'sparse'), 0) ss from lists group by id),
fused as (select id, ds / max(ds) over () + ss / max(ss) over () base from raw), p as (select f.base, c.*, {lit(_Q)} q, {s_exact(lit(_Q))} et from fused f join chunks c using (id)),
s as (select id, repo, file_path, start_line, end_line, round(base + {_SHARE} + {fixed.EXACT_BOOST}::double * 0.35 * {_PATH_TOKENS} / len(et), 9) score from p)
select id, round(score, 6) score, rank, repo, file_path, start_line, end_line from (select *, row_number() over (order by score desc, id) - 1 rank from s) where rank < 20"""
)
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    index, rows = stored(spark, d)
    engine = Engine(spark, rows, vectors(spark, d), index=index)
    near = table(spark, d, "embeddings").where("vec_id = 50").select(F.col("embedding").alias("qv"))
    hits = engine.hybrid_search(_Q, near)
    return hits.select("id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), "repo", "file_path", "start_line", F.col("end_line").cast("long").alias("end_line"))
