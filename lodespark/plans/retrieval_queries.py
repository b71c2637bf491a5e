"""Sparse and dense search, fusion, packing, citations and evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed, scoring, text
from ..operators import retrieval as ops
from ..sources.tables import ensure_vectors, shared_dir
from .catalog import ASKED, BQ, CH, S_ASKED, TOKS, asked, benchmark_queries, chunks, index, joined, query, rounded, s_any, s_tok, s_vectors, stored, table, tokens

# ---- sparse ---------------------------------------------------------------------------------------

POST = f"{TOKS}, post as (select id, term, count(*) tf from (select id, unnest(t) term from toks) group by id, term)"
STATS = "stats as (select count(*) n, coalesce(avg(len(t)), 0) mean from toks)"
BM25 = f"""{POST}, {STATS}, df as (select term, count(*) df from post group by term),
qt as (select distinct qid, unnest({s_tok("q")}) term from {S_ASKED}),
bm as (select qid, id, sum(ln(1 + (n - df + 0.5::double) / (df + 0.5)) * (tf * 2.5::double) / (tf + 1.5::double * (0.25::double + 0.75::double * len(t) / mean))) score
 from post join qt using (term) join df using (term) join toks using (id), stats group by qid, id),
sparse as (select qid, id, row_number() over (partition by qid order by round(score, 9) desc, id) - 1 rank from bm where score > 0)"""


def _some(queries, qids):
    """All queries, or those that the SQL takes the lists of: a search gives each query its own list, so a filter on qid may come before it."""
    return queries.where(F.col("qid").isin(*qids)) if qids else queries


def _sparse(spark, d, k=20, qids=()):
    return ops.ranked(ops.bm25(index(spark, d), _some(asked(spark), qids)), k)


@query(f"with {POST} select id, term, tf from post")
def ag_tf(spark, d):
    return ops.postings(tokens(spark, d)).select("id", "term", "tf")


@query(f"with {TOKS} select id, cast(len(t) as bigint) len, round((select avg(len(t)) from toks), 6) mean, (select cast(sum(len(t)) as bigint) from toks) total from toks")
def ag_doclen(spark, d):
    t = tokens(spark, d)
    s = ops.corpus_stats(t)
    return t.crossJoin(F.broadcast(s)).select("id", F.size("t").cast("long").alias("len"), rounded("mean").alias("mean"), "total")


@query(f"with {POST} select term, count(*) df from post group by term")
def ag_df(spark, d):
    return ops.postings(tokens(spark, d)).groupBy("term").agg(F.count("*").alias("df"))


@query(f"with {BM25} select qid, id, round(score, 6) score from bm where score > 0")
def ag_bm25_go(spark, d):
    return ops.bm25(index(spark, d), asked(spark)).select("qid", "id", rounded("score").alias("score"))


@query(
    f"""with {POST}, {STATS}, df as (select term, count(*) df from post group by term), raw as (select term, ln(n - df + 0.5::double) - ln(df + 0.5::double) raw from df, stats),
idf as (select term, case when raw < 0 then 0.25::double * (select avg(raw) from raw) else raw end idf from raw),
qt as (select qid, term, count(*) times from (select qid, unnest({s_tok("q")}) term from {S_ASKED}) group by qid, term),
bm as (select qid, id, sum(times * idf * (tf * 2.5::double) / (tf + 1.5::double * (0.25::double + 0.75::double * len(t) / mean))) score from post join qt using (term) join idf using (term) join toks using (id), stats group by qid, id)
select qid, id, round(score, 6) score from bm where score > 0"""
)
def ag_bm25_api(spark, d):
    return ops.bm25_okapi(index(spark, d), asked(spark)).select("qid", "id", rounded("score").alias("score"))


@query(f"with {BM25} select qid, id, rank from sparse where rank < 20")
def tk_bm25_go(spark, d):
    return _sparse(spark, d).select("qid", "id", F.col("rank").cast("long").alias("rank"))


@query(
    f"""with {BM25}, {CH}, pm as (select qid, id, row_number() over (partition by qid order by id) - 1 r from chunks, {S_ASKED} where regexp_matches(q, '[/.]') and contains(replace(lower(file_path), chr(92), '/'), replace(lower(q), chr(92), '/'))),
a as (select qid, id, 0 p, r::double o from pm where r < 20 union all select qid, id, 1, rank::double from sparse where rank < 20),
b as (select qid, id, min(p * 1000 + o) s from a group by qid, id), c as (select qid, id, row_number() over (partition by qid order by s, id) - 1 rank from b) select qid, id, rank from c where rank < 20"""
)
def tk_sparse(spark, d):
    return ops.sparse_search(chunks(spark, d), index(spark, d), asked(spark), 20).select("qid", "id", F.col("rank").cast("long").alias("rank"))


@query(f"with {POST}, qt as (select distinct qid, unnest({s_tok('q')}) term from {S_ASKED}) select qid, id, term, tf from post join qt using (term)")
def jn_postings(spark, d):
    asks, rows = ops.bounded(ops.query_terms(asked(spark)).select("qid", "term"))
    return ops.narrowed(index(spark, d)["postings"], "term", rows).join(asks, "term").select("qid", "id", "term", "tf")


@query(f"with {BM25} select qid, count(*) n from bm where score > 0 group by qid")
def flt_positive(spark, d):
    return ops.bm25(index(spark, d), asked(spark)).groupBy("qid").agg(F.count("*").alias("n"))


@query(f"with {BM25}, {CH} select qid, id, rank from sparse join chunks using (id) where rank < 20 and repo in ('src1', 'src3', 'src5')")
def flt_repo_post(spark, d):
    return _sparse(spark, d).join(chunks(spark, d).select("id", "repo"), "id").where(F.col("repo").isin("src1", "src3", "src5")).select("qid", "id", F.col("rank").cast("long").alias("rank"))


# ---- dense ----------------------------------------------------------------------------------------

_DOT = "list_sum(list_transform(list_zip(v.embedding, w.embedding), lambda z: z[1]::double * z[2]::double))"
KNN = f"""sims as (select w.vec_id qid, v.vec_id id, round({_DOT}, 6) score from embeddings v, (select * from embeddings where vec_id % 50 = 0) w),
dense as (select qid, id, score, row_number() over (partition by qid order by score desc, id) - 1 rank from sims)"""


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def _wanted(spark, d):
    """The query set: every vector whose id is divisible by 50."""
    return table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))


def _dense(spark, d, k=20, qids=()):
    return ops.knn(vectors(spark, d), _some(_wanted(spark, d), qids), k)


_dense_sql = lambda k: f"with {KNN} select qid, id, score, rank from dense where rank < {k}"
_out = lambda df: df.select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(_dense_sql(20))
def jn_knn(spark, d):
    return _out(_dense(spark, d))


@query(_dense_sql(10))
def src_vec_ensure(spark, d):
    """The stored vectors with their bytes: bounds by bytes, scores by vectors."""
    stored = ensure_vectors(vectors(spark, d), f"{shared_dir(spark)}/lodespark/vectors-{uuid.uuid4().hex}")
    return _out(ops.knn_bytes(stored, _wanted(spark, d), 10))


@query(_dense_sql(25))
def tk_dense(spark, d):
    return _out(_dense(spark, d, 25))


@query(_dense_sql(15))
def tk_docstring(spark, d):
    return _out(_dense(spark, d, 15))


@query(f"with {KNN} select qid, id, round(score * 0.85, 6) score, rank from dense where rank < 10")
def tk_hyde(spark, d):
    return _out(_dense(spark, d, 10)).withColumn("score", F.round(F.col("score") * 0.85, 6))


@query(f"with {KNN} select qid, count(*) n, cast(max(rank) as bigint) last from dense where rank < 7 group by qid")
def wn_topk_per_query(spark, d):
    return _dense(spark, d, 7).groupBy("qid").agg(F.count("*").alias("n"), F.max("rank").cast("long").alias("last"))


@query(f"with {KNN}, {CH} select qid, id, repo, file_path from dense join chunks using (id) where rank < 20")
def jn_chunk_payload(spark, d):
    return chunks(spark, d).select("id", "repo", "file_path").join(_dense(spark, d), "id").select("qid", "id", "repo", "file_path")


# ---- fusion ---------------------------------------------------------------------------------------

LISTS = f"""{BM25}, {KNN}, lists as (select 1 qid, id, 'sparse' side, rank, 1.0::double weight from sparse where qid = 1 and rank < 20 union all select 1, id, 'dense', rank, 1.0 from dense where qid = 50 and rank < 20
 union all select 1, id, 'dense', rank, 0.8 from dense where qid = 100 and rank < 20 union all select 1, id, 'sparse', rank, 0.75 from sparse where qid = 4 and rank < 20),
raw as (select qid, id, coalesce(sum(weight / (10 + rank + 1)) filter (side = 'dense'), 0) ds, coalesce(sum(weight / (10 + rank + 1)) filter (side = 'sparse'), 0) ss from lists group by qid, id),
fused as (select qid, id, ds / max(ds) over () dense, ss / max(ss) over () sparse from raw)"""


def _lists(spark, d):
    s, v = _sparse(spark, d, qids=(1, 4)), _dense(spark, d, qids=(50, 100))
    part = lambda df, side, one, other, w: df.where(F.col("qid").isin(one, other)).select(F.lit(1).alias("qid"), "id", F.lit(side).alias("side"), "rank", F.when(F.col("qid") == one, 1.0).otherwise(w).alias("weight"))
    return part(s, "sparse", 1, 4, 0.75).unionByName(part(v, "dense", 50, 100, 0.8))


@query(f"with {LISTS} select side, id, rank from lists where weight = 1")
def wn_rank(spark, d):
    return _lists(spark, d).where("weight = 1").select("side", "id", F.col("rank").cast("long").alias("rank"))


@query(f"with {LISTS} select id, round(ds, 6) dense, round(ss, 6) sparse from raw")
def ag_rrf(spark, d):
    part = F.col("weight") * scoring.rrf(F.col("rank"))
    both = _lists(spark, d).groupBy("id").agg(*(F.coalesce(F.sum(F.when(F.col("side") == s, part)), F.lit(0.0)).alias(s) for s in ("dense", "sparse")))
    return both.select("id", rounded("dense").alias("dense"), rounded("sparse").alias("sparse"))


@query(f"with {LISTS} select id, round(dense, 6) dense, round(sparse, 6) sparse from fused")
def jn_dense_sparse(spark, d):
    return ops.fuse(_lists(spark, d)).select("id", rounded("dense").alias("dense"), rounded("sparse").alias("sparse"))


@query(f"with {LISTS} select side, count(*) hits, count(distinct id) ids from lists group by side")
def ag_source_breakdown(spark, d):
    return _lists(spark, d).groupBy("side").agg(F.count("*").alias("hits"), F.countDistinct("id").alias("ids"))


_BOOST = "case when contains(lower(file_path), 'src1') then 0.2::double else 0 end"
FUSED = f"{LISTS}, {CH}, scored as (select id, repo, file_path, function_name, start_line, end_line, dense + sparse + {_BOOST} score, {_BOOST} boost from fused join chunks using (id)), ordered as (select *, row_number() over (order by round(score, 9) desc, id) - 1 rank from scored)"


def _scored(spark, d):
    boost = F.when(F.contains(F.lower("file_path"), F.lit("src1")), 0.2).otherwise(0.0)
    fused, rows = ops.bounded(ops.fuse(_lists(spark, d)))
    return ops.narrowed(stored(spark, d)[1], "id", rows).join(fused, "id").withColumn("boost", boost).withColumn("score", F.col("dense") + F.col("sparse") + F.col("boost"))


def ordered(spark, d, k=1000):
    return ops.ranked(_scored(spark, d), k)


@query(f"with {FUSED} select id, round(score, 6) score from scored")
def fn_fused(spark, d):
    return _scored(spark, d).select("id", rounded("score").alias("score"))


@query(f"with {FUSED} select id, rank from ordered")
def tk_fused(spark, d):
    return ordered(spark, d).select("id", F.col("rank").cast("long").alias("rank"))


@query(f"with {FUSED} select id, rank from ordered where rank < 20")
def tk_final(spark, d):
    return ordered(spark, d, 20).select("id", F.col("rank").cast("long").alias("rank"))


@query(f"with {FUSED} select repo, \"any_value\"(0) z, count(*) n from (select *, row_number() over (partition by repo || '|' || file_path || '|' || start_line || '|' || end_line order by rank) r from ordered) where r = 1 group by repo")
def wn_first_wins(spark, d):
    key = text.chunk_key(*map(F.col, ("repo", "file_path", "start_line", "end_line")))
    return ops.first_wins(ordered(spark, d), key, [F.col("rank")]).groupBy("repo").agg(F.lit(0).alias("z"), F.count("*").alias("n"))


@query(f"with {FUSED} select round(count(distinct repo || '|' || function_name)::double / count(*), 6) ratio from ordered")
def ag_dedupe_ratio(spark, d):
    return ordered(spark, d).agg(rounded(F.countDistinct("repo", "function_name") / F.count("*")).alias("ratio"))


@query(f"with {FUSED} select count(*) filter (boost > 0) hits from scored")
def ag_exact_hits(spark, d):
    return _scored(spark, d).agg(F.count_if(F.col("boost") > 0).alias("hits"))


@query(f"with {FUSED} select count(distinct file_path || '|' || function_name) distinct_n from ordered where rank < 5")
def ag_distinct_evidence(spark, d):
    return ordered(spark, d, 5).agg(F.countDistinct("file_path", "function_name").alias("distinct_n"))


@query(f"with {FUSED} select round(max(score), 6) top, round(avg(score), 6) mean3, round(greatest(0, max(score) - avg(score)), 6) gap from ordered where rank < 3")
def ag_top3(spark, d):
    return ordered(spark, d, 3).agg(rounded(F.max("score")).alias("top"), rounded(F.avg("score")).alias("mean3"), rounded(F.greatest(F.lit(0.0), F.max("score") - F.avg("score"))).alias("gap"))


_RR = lambda bucket, order: f"""with {FUSED}, b as (select id, rank, {bucket} bucket from ordered), t as (select id, rank, bucket, row_number() over (partition by bucket order by rank) turn, min(rank) over (partition by bucket) fst, count(*) over (partition by bucket) n from b),
p as (select id, row_number() over (order by turn, {order}) - 1 pos from t) select id, pos from p where pos < 12"""  # noqa: E731


@query(_RR("repo", "fst"))
def wn_pack_file(spark, d):
    return ops.round_robin(ordered(spark, d), "repo", 12).select("id", F.col("pos").cast("long").alias("pos"))


@query(_RR("array_to_string(list_slice(string_split(file_path, '/'), 1, 2), '/')", "-n, fst"))
def wn_pack_component(spark, d):
    rows = ordered(spark, d).withColumn("component", text.component(F.col("file_path")))
    return ops.round_robin(rows, "component", 12, largest_first=True).select("id", F.col("pos").cast("long").alias("pos"))


@query(f"with {FUSED} select case when boost > 0 then 20 else 40 end k, count(*) n from ordered group by 1")
def tk_rerank_input(spark, d):
    return ordered(spark, d).groupBy(F.when(F.col("boost") > 0, 20).otherwise(40).alias("k")).agg(F.count("*").alias("n"))


_QTOK = "(select list_distinct(" + s_tok("q") + f") qt from {S_ASKED} where qid = 1)"


@query(f"with {FUSED}, r as (select id, len(list_intersect({s_tok('content')}, qt))::double / len(qt) score from ordered join (select id, \"content\" from chunks) using (id), {_QTOK}), o as (select id, round(score, 6) score, row_number() over (order by round(score, 9) desc, id) - 1 rank from r) select id, score, rank from o where rank < 10")
def tk_rerank(spark, d):
    rows = ordered(spark, d).select("id", "qid", F.round(scoring.lexical_score(F.lit(ASKED[0][1]), F.col("content")), 9).alias("score"))
    return ops.ranked(rows, 10).select("id", rounded("score").alias("score"), F.col("rank").cast("long").alias("rank"))


_WANTED = "(select list_distinct(string_split_regex(lower(q), '\\s+')) qt from " + S_ASKED + " where qid = 1)"


@query(f"with {FUSED} select id, round(len(list_intersect(list_distinct(string_split_regex(lower(\"content\"), '\\s+')), qt))::double / len(qt), 6) score from ordered join (select id, \"content\" from chunks) using (id), {_WANTED} where rank < 20")
def ml_rerank(spark, d):
    from .models import rerank

    return rerank(ordered(spark, d, 20).select("id", "content"), ASKED[0][1]).select("id", rounded("score").alias("score"))


@query(f"with {FUSED} select id, 0 src from ordered where rank < 10 union all select id, 1 src from (select distinct id from sparse where qid = 2 and rank < 10) where id not in (select id from ordered where rank < 10)")
def jn_subquery_anti(spark, d):
    first = ordered(spark, d, 10).select("id", F.lit(0).alias("src"))
    more = _sparse(spark, d, 10, (2,)).select("id").distinct().join(first, "id", "left_anti").withColumn("src", F.lit(1))
    return first.unionByName(more)


@query(f"with {FUSED} select id, 0 part, rank o from ordered where rank < 5 union all select id, 1, rank from sparse where qid = 2 and rank < 5")
def st_union_ordered(spark, d):
    a = ordered(spark, d, 5).select("id", F.lit(0).alias("part"), F.col("rank").cast("long").alias("o"))
    return a.unionByName(_sparse(spark, d, 5, (2,)).select("id", F.lit(1).alias("part"), F.col("rank").cast("long").alias("o")))


# ---- prompts and citations --------------------------------------------------------------------------

_PART = "'### Source ' || (rank + 1) || ': ' || file_path || ' (lines ' || start_line || '-' || end_line || ')' || chr(10) || 'Function: ' || function_name || chr(10) || '```' || chr(10) || (case when length(c) > 2000 then left(c, 2000) || chr(10) || '... (truncated)' else c end) || chr(10) || '```'"
PROMPT = f"{FUSED}, parts as (select rank, {_PART} part from (select o.*, k.\"content\" c from ordered o join chunks k using (id))), run as (select rank, part, sum(length(part)) over (order by rank) total from parts)"


def _parts(spark, d):
    body = text.tail_cut(F.col("content"))
    part = F.concat(F.lit("### Source "), (F.col("rank") + 1).cast("string"), F.lit(": "), "file_path", F.lit(" (lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit(")\nFunction: "), "function_name", F.lit("\n```\n"), body, F.lit("\n```"))
    return ordered(spark, d).select("qid", "rank", part.alias("part")).withColumn("total", F.sum(F.length("part")).over(Window.partitionBy("qid").orderBy("rank")))


@query(f"with {PROMPT} select rank, cast(total as bigint) total from run where total <= 30000")
def wn_budget(spark, d):
    return _parts(spark, d).where(F.col("total") <= fixed.MAX_PROMPT_CHARS).select(F.col("rank").cast("long").alias("rank"), "total")


@query(f"with {PROMPT} select '## Code Context' || chr(10) || string_agg(part, chr(10) || chr(10) order by rank) || chr(10) || chr(10) || '## Question' || chr(10) || 'why' prompt from run where total <= 30000")
def fn_prompt(spark, d):
    kept = _parts(spark, d).where(F.col("total") <= fixed.MAX_PROMPT_CHARS)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda x: x["part"])
    return kept.agg(F.concat(F.lit("## Code Context\n"), F.array_join(parts, "\n\n"), F.lit("\n\n## Question\nwhy")).alias("prompt"))


_LOC = "'- ' || file_path || ':' || start_line || '-' || end_line || ' (' || function_name || ')'"


@query(f"with {FUSED} select 'confidence=0.42' || chr(10) || string_agg({_LOC}, chr(10) order by rank) answer from ordered where rank < 5")
def fn_low_conf(spark, d):
    line = F.concat(F.lit("- "), "file_path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit(" ("), "function_name", F.lit(")"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"])
    return ordered(spark, d, 5).agg(F.concat(F.format_string("confidence=%.2f\n", F.lit(0.42)), F.array_join(lines, "\n")).alias("answer"))


@query(f"with {FUSED} select svc, id from (select regexp_extract(file_path, 'src([0-9]+)/', 1) svc, id, row_number() over (partition by regexp_extract(file_path, 'src([0-9]+)/', 1) order by rank) r from ordered) where r = 1")
def fn_inventory(spark, d):
    svc = F.regexp_extract("file_path", "src([0-9]+)/", 1)
    return ops.first_wins(ordered(spark, d).withColumn("svc", svc), F.col("svc"), [F.col("rank")]).select("svc", "id")


_ANSWERS = [(1, "see [src1/en/doc_1.txt:1-5] and [missing.py:3]"), (2, "plain text"), (3, "in [doc_2.txt:10] [x]"), (4, "[src3/en/doc_30.txt]")]
_CITE = r"\[([^\]:]+?)(?::([0-9]+)(?:-([0-9]+))?)?\]"
_S_ANS = "(values " + ", ".join(f"({n}, '{a}')" for n, a in _ANSWERS) + ") a(n, answer)"


def _cited(spark):
    a = spark.createDataFrame(_ANSWERS, "n int, answer string")
    return a.select("n", F.explode(F.regexp_extract_all("answer", F.lit(_CITE), F.lit(1))).alias("ref"))


@query(f"select n, trim(unnest(regexp_extract_all(answer, '{_CITE}', 1))) ref from {_S_ANS}")
def fn_cite_extract(spark, d):
    return _cited(spark).select("n", F.trim("ref").alias("ref"))


_UNSUP = f"c as (select n, trim(unnest(regexp_extract_all(answer, '{_CITE}', 1))) ref from {_S_ANS}), bad as (select n, ref from c where not exists (select 1 from chunks where contains(file_path, ref) or ends_with(file_path, ref)))"


@query(f"with {CH}, {_UNSUP} select a.n, exists (select 1 from bad where bad.n = a.n) unsupported from {_S_ANS}")
def fn_cite_verify(spark, d):
    bad = _unsupported(spark, d).select("n").distinct().withColumn("bad", F.lit(True))
    return spark.createDataFrame(_ANSWERS, "n int, answer string").join(bad, "n", "left").select("n", F.coalesce("bad", F.lit(False)).alias("unsupported"))


def _unsupported(spark, d):
    """Citations that no path holds: the few citations go to the paths, and an anti join on what matched follows."""
    cites = _cited(spark).select("n", F.trim("ref").alias("ref")).distinct()
    hit = chunks(spark, d).select("file_path").join(F.broadcast(cites), F.contains("file_path", "ref") | F.endswith("file_path", "ref")).select("n", "ref").distinct()
    return cites.join(hit, ["n", "ref"], "left_anti")


@query(f"with {CH}, {_UNSUP} select distinct n, ref from bad")
def jn_cite_theta(spark, d):
    return _unsupported(spark, d)


_PREFIX = "vscode://file"


@query(f"with {CH} select id, '{_PREFIX}/' || repo || '/' || ltrim(file_path, '/') cite from chunks")
def fn_cite_path(spark, d):
    return chunks(spark, d).select("id", F.concat_ws("/", F.lit(_PREFIX), "repo", F.regexp_replace("file_path", "^/+", "")).alias("cite"))


@query(f"with {CH} select c.id, coalesce(k.file_path, case when contains(c.repo, '://') then c.repo end, c.repo) file from chunks c left join (select id, file_path from chunks where id % 2 = 0) k using (id)")
def fn_cite_file(spark, d):
    c = chunks(spark, d)
    there = c.where("id % 2 = 0").select("id", F.col("file_path").alias("there"))
    return c.join(there, "id", "left").select("id", F.coalesce("there", F.when(F.contains("repo", F.lit("://")), F.col("repo")), "repo").alias("file"))


@query(f"select n, pos, ref from (select n, regexp_extract_all(answer, '{_CITE}', 1) l from {_S_ANS}), lateral (select unnest(range(0, len(l))) pos, trim(unnest(l)) ref)")
def jn_answer_cite(spark, d):
    a = spark.createDataFrame(_ANSWERS, "n int, answer string")
    return a.select("n", F.posexplode(F.regexp_extract_all("answer", F.lit(_CITE), F.lit(1))).alias("pos", "ref")).select("n", F.col("pos").cast("long").alias("pos"), F.trim("ref").alias("ref"))


_KIND = "case when regexp_matches(line, '^```') then 'fence' when regexp_matches(line, '^#+ ') then 'heading' when regexp_matches(line, '^\\s*[-*] ') then 'bullet' when regexp_matches(line, '^Source [0-9]+') then 'source' else 'text' end"


@query(f"with l as (select conv_id, turn, string_split(text, chr(10)) l from conversations where role = 'assistant'), x as (select conv_id, turn, cast(unnest(range(0, len(l))) as integer) pos, unnest(l) line from l) select *, {_KIND} kind from x")
def fn_ans_lines(spark, d):
    a = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    kind = F.when(F.col("line").rlike("^```"), "fence").when(F.col("line").rlike("^#+ "), "heading").when(F.col("line").rlike(r"^\s*[-*] "), "bullet").when(F.col("line").rlike("^Source [0-9]+"), "source").otherwise("text")
    return a.withColumn("kind", kind)


# ---- evaluation -------------------------------------------------------------------------------------

_EV = f"""{BQ}, gold as (select distinct b.qid, d.doc_id id from bq b join documents d on contains(d.text, b.text)), {TOKS},
post as (select id, term, count(*) tf from (select id, unnest(t) term from toks) group by id, term), {STATS}, df as (select term, count(*) df from post group by term), qt as (select distinct qid, unnest({s_tok("q")}) term from bq),
bm as (select qid, id, sum(ln(1 + (n - df + 0.5::double) / (df + 0.5)) * (tf * 2.5::double) / (tf + 1.5::double * (0.25::double + 0.75::double * len(t) / mean))) score from post join qt using (term) join df using (term) join toks using (id), stats group by qid, id),
got as (select qid, id, rank from (select qid, id, row_number() over (partition by qid order by round(score, 9) desc, id) - 1 rank from bm) where rank < 10),
ev as (select g.qid, count(*) n, count(*) filter (rank < 1) h1, count(*) filter (rank < 3) h3, count(*) filter (rank < 5) h5, count(*) filter (rank < 10) h10, min(rank) fst from gold g left join got using (qid, id) group by g.qid)"""


def _gold(spark, d):
    """Items whose text a document holds."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    return ops.holding(docs, benchmark_queries(spark, d).select("qid", "text"))


def _eval(spark, d):
    got = ops.ranked(ops.bm25(index(spark, d), benchmark_queries(spark, d).select("qid", "q")), 10)
    return ops.recall_mrr(got, _gold(spark, d))


@query(f"with {_EV} select qid, id from gold")
def jn_suffix(spark, d):
    return _gold(spark, d)


@query(f"with {_EV} select qid, round(h1::double / n, 6) recall_1, round(h3::double / n, 6) recall_3, round(h5::double / n, 6) recall_5, round(h10::double / n, 6) recall_10 from ev")
def ag_recall(spark, d):
    return _eval(spark, d).select("qid", *(rounded(f"recall_{k}").alias(f"recall_{k}") for k in (1, 3, 5, 10)))


@query(f"with {_EV} select qid, round(coalesce(1.0::double / (fst + 1), 0), 6) mrr from ev")
def ag_mrr(spark, d):
    return _eval(spark, d).select("qid", rounded("mrr").alias("mrr"))


_MEANS = "round(avg(h5::double / n), 6) recall_5, round(avg(coalesce(1.0::double / (fst + 1), 0)), 6) mrr"


@query(f"with {_EV} select {_MEANS} from ev")
def ag_eval_mean(spark, d):
    return _eval(spark, d).agg(rounded(F.avg("recall_5")).alias("recall_5"), rounded(F.avg("mrr")).alias("mrr"))


@query(f"with {_EV}, m as (select {_MEANS} from ev) select recall_5, mrr, concat_ws(',', case when mrr < 0.15 then 'mrr' end, case when recall_5 < 0.20 then 'recall_5' end) failed from m")
def ag_quality_gate(spark, d):
    return ops.quality_gate(_eval(spark, d).agg(rounded(F.avg("recall_5")).alias("recall_5"), rounded(F.avg("mrr")).alias("mrr")))


@query("select a.item_id qid, cast(len(list_intersect(list_distinct(string_split(a.text, ' ')), list_distinct(string_split(b.text, ' ')))) as integer) shared from benchmark a join benchmark b on b.item_id = a.item_id + 1")
def st_intersect(spark, d):
    """Words that an item shares with the next one."""
    items = table(spark, d, "benchmark")
    after = items.select((F.col("item_id") - 1).alias("item_id"), F.split("text", " ").alias("next"))
    return items.join(after, "item_id").select(F.col("item_id").alias("qid"), F.size(F.array_intersect(F.split("text", " "), "next")).alias("shared"))


@query("select doc_id from documents except select doc_id from labels")
def st_except(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti").distinct()


# ---- models: deterministic stand-ins behind ports -----------------------------------------------------


@query(f"with {s_vectors('select item_id id, text from benchmark', 'id')} select id, pos, round(x, 4) x from vec")
def emb_model(spark, d):
    from .models import embed

    vectors = embed(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"))
    return vectors.select("id", F.posexplode("vec").alias("pos", "x")).where("x <> 0").withColumn("x", rounded(F.col("x").cast("double"), 4))


_BOTH = "select doc_id id, 0 k, coalesce(text, '') text from documents union all select doc_id, 1, list_extract(string_split(coalesce(text, ''), chr(10)), 1) from documents"


@query(f"with {s_vectors(_BOTH, 'id, k')}, dots as (select a.id, sum(a.x * b.x) sim from vec a join vec b on a.id = b.id and a.pos = b.pos and a.k = 0 and b.k = 1 group by a.id) select doc_id id, cast(64 as integer) n, round(coalesce(sim, 0), 4) sim from documents left join dots on id = doc_id")
def chk_batch_embed(spark, d):
    from .models import embed_pairs

    return embed_pairs(chunks(spark, d).select("id", "content", "signature")).select("id", F.size("code_vec").alias("n"), rounded(scoring.cosine(F.col("code_vec"), F.col("doc_vec")), 4).alias("sim"))


@query(f"select qid, cast(pos as integer) pos, v from {S_ASKED}, lateral (select unnest([0, 1, 2]) pos, unnest([q, q || ' implementation file path function', q || ' call flow error handling signature']) v)")
def ml_expand(spark, d):
    from ..functions import queries as qf

    return asked(spark).select("qid", F.posexplode(qf.clean_variants(F.col("q"), qf.fallback(F.col("q"), F.lit("")))).alias("pos", "v"))


@query(f"select qid, 'A function that answers: ' || q || '|A function that answers: ' || q || ' and its callers' docs from {S_ASKED} where not {s_any('lower(q)', fixed.HYDE_SKIP)}")
def ml_hyde(spark, d):
    from ..functions import queries as qf

    doc = F.concat(F.lit("A function that answers: "), text.ws_norm(F.col("q")))
    return asked(spark).where(~qf.skips_hyde(F.col("q"))).select("qid", F.array(doc, F.concat(doc, F.lit(" and its callers"))).alias("docs")).select("qid", joined("docs", "|").alias("docs"))


@query("select * from (values (5, 'explain the handler service flow client_api'), (6, 'where is anon implemented')) t(qid, parts)")
def ml_decompose(spark, d):
    from ..functions import queries as qf

    parts = F.slice(F.filter(F.split("q", r"\s+(?:and|then|with)\s+|[?,;]"), lambda x: F.length(F.trim(x)) > 3), 1, 3)
    return asked(spark).where(qf.intent(F.col("q")) != "unknown").select("qid", joined(parts, "|").alias("parts"))
