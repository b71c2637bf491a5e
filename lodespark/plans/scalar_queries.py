"""Scalar functions, filters and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, scoring, text
from ..functions import queries as qf
from .catalog import ASKED, BQ, CH, ERRORS, PATHS, QUESTIONS, S_ASKED, TOKS, asked, benchmark_queries, chunks, joined, lit, numbered, query, rounded, s_any, s_base, s_exact, s_first, s_found, s_in, s_numbered, s_tok, table, tokens

# ---- tokens and identifiers -----------------------------------------------------------------------


@query(f"with {TOKS} select id, cast(len(t) as integer) n, array_to_string(t, ' ') toks from toks")
def fn_tokenize(spark, d):
    return tokens(spark, d).select("id", F.size("t").alias("n"), joined("t").alias("toks"))


@query(f"select doc_id id, array_to_string({s_tok('text', fixed.PUNCTUATION_REBUILD)}, ' ') toks from documents")
def fn_tokenize_rebuild(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), joined(text.tokenize(F.col("text"), fixed.PUNCTUATION_REBUILD)).alias("toks"))


@query(f"with {BQ} select qid, array_to_string({s_exact('text')}, ' ') toks from bq")
def fn_exact_tokens(spark, d):
    return benchmark_queries(spark, d).select("qid", joined(text.exact_tokens(F.col("text"))).alias("toks"))


_ENT = f"list_filter(e, lambda t: {s_in('t', fixed.ENTITY_ANCHORS)} or contains(t, '_') or contains(t, '/') or regexp_matches(t, '[0-9]'))"


@query(f"with x as (select n, {s_exact('q')} e from {s_numbered(QUESTIONS, 'q')}) select n, array_to_string(case when len({_ENT}) > 0 then {_ENT} else list_slice(e, 1, 5) end, ' ') toks from x")
def fn_entity_tokens(spark, d):
    return numbered(spark, QUESTIONS, "q").select("n", joined(text.entity_tokens(F.col("q"))).alias("toks"))


_TECH = f"list_filter({s_found('lower(q)', fixed.IDENTIFIER)}, lambda t: {s_in('t', fixed.TECH_ANCHORS)} or regexp_matches(t, '[_/.]') or length(t) >= 8)"


@query(f"with x as (select n, {_TECH} e from {s_numbered(QUESTIONS, 'q')}) select n, array_to_string(list_slice({s_first('e')}, 1, 6), ' ') terms from x")
def fn_tech_terms(spark, d):
    return numbered(spark, QUESTIONS, "q").select("n", joined(text.tech_terms(F.col("q"))).alias("terms"))


@query(f"with {BQ} select qid, array_to_string({s_first(s_found('lower(text)', fixed.IDENTIFIER))}, ' ') toks from bq")
def wn_ordered_distinct(spark, d):
    return benchmark_queries(spark, d).select("qid", joined(F.array_distinct(text.found(F.lower("text"), fixed.IDENTIFIER))).alias("toks"))


_GOT = "list_filter(" + " || ".join(s_found("q", p, 1) for p in fixed.SYMBOLS) + ", lambda t: length(t) >= 2)"
_SYMS = "list_slice(list_filter(g, lambda t, i: list_position(list_transform(g, lambda u: lower(u)), lower(t)) = i), 1, 10)"


@query(f"with x as (select n, {_GOT} g from {s_numbered(QUESTIONS, 'q')}) select n, array_to_string({_SYMS}, ' ') syms from x")
def fn_symbols(spark, d):
    return numbered(spark, QUESTIONS, "q").select("n", joined(qf.symbols(F.col("q"))).alias("syms"))


def _s_match(patterns):
    return "(" + " or ".join(f"regexp_matches(q, {lit(p)})" for p in patterns) + ")"


_INTENT = f"case when {_s_match(fixed.ARCHITECTURAL)} then 'architectural' when {_s_match(fixed.IMPLEMENTATION)} then 'implementation' when {s_any('q', fixed.FLOW_WORDS)} then 'flow' when {s_any('q', fixed.USAGE_WORDS)} then 'usage' else 'unknown' end"


@query(f"with x as (select n, trim(lower(q)) q from {s_numbered(QUESTIONS, 'q')}), y as (select n, {_INTENT} intent from x) select n, intent, intent in ('architectural', 'usage') is_architectural from y")
def fn_classify(spark, d):
    return numbered(spark, QUESTIONS, "q").select("n", qf.intent(F.col("q")).alias("intent"), qf.is_architectural(F.col("q")).alias("is_architectural"))


# ---- scores ---------------------------------------------------------------------------------------


@query("select r rank, round(1.0::double / (10 + r + 1), 9) score from range(0, 50) t(r)")
def fn_rrf(spark, d):
    return spark.range(50).select(F.col("id").alias("rank"), rounded(scoring.rrf(F.col("id")), 9).alias("score"))


@query("select lang, source, round(n / max(n) over (partition by lang), 6) score from (select lang, source, count(*)::double n from documents group by lang, source)")
def fn_normalize(spark, d):
    from pyspark.sql import Window

    n = table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").cast("double").alias("n"))
    return n.select("lang", "source", rounded(F.col("n") / F.max("n").over(Window.partitionBy("lang"))).alias("score"))


_ENT2 = _ENT.replace("(e,", "(et,")
_S_EXACT = f"""with {CH}, asked as (select qid, q, lower(q) ql, {s_exact('q')} et from {S_ASKED}),
e as (select qid, q, ql, case when len({_ENT2}) > 0 then {_ENT2} else list_slice(et, 1, 5) end e from asked),
p as (select c.id, e.qid, e.ql, e.e, lower(file_path) lp, lower(function_name) fn, lower(repo || ' ' || file_path || ' ' || function_name || ' ' || parent_class || ' ' || signature || ' ' || "content") hay from chunks c, e),
h as (select *, len(list_filter(e, lambda t: contains(hay, t))) hits from p)
"""


@query(
    _S_EXACT
    + """select * from (select id, qid, round(case when len(e) = 0 then 0 when lp <> '' and contains(ql, lp) then 0.35::double * 0.95 when hits = 0 then 0
 when fn <> '' and contains(ql, fn) then greatest(0.35::double * hits / len(e), 0.35::double * 0.7) else 0.35::double * hits / len(e) end, 6) boost from h) where boost <> 0"""
)
def fn_exact_boost(spark, d):
    return _exact(spark, d).select("id", "qid", rounded("boost").alias("boost")).where("boost <> 0")


def _exact(spark, d):
    b = scoring.exact_boost(F.col("q"), *(F.col(c) for c in ("repo", "file_path", "function_name", "parent_class", "signature", "content")))
    return chunks(spark, d).crossJoin(F.broadcast(asked(spark))).withColumn("boost", b)


_S_PATH = f"""with {CH}, p as (select id, qid, q, trim(replace(lower(q), chr(92), '/')) qn, trim(replace(lower(file_path), chr(92), '/')) pn, {s_exact('q')} et from chunks, {S_ASKED}),
o as (select *, {s_base('pn')} bn, len(list_intersect(et, {s_found('pn', fixed.PATH_TOKEN)})) ov from p)
"""


@query(
    _S_PATH
    + """select * from (select id, qid, round(case when pn = '' then 0 when qn <> '' and (qn = pn or ends_with(qn, pn) or ends_with(pn, qn)) then least(0.35::double * 1.2, 0.55) when bn <> '' and contains(qn, bn) then least(0.35::double * 0.65, 0.45)
 when len(et) = 0 or ov = 0 then 0 else 0.35::double * (case when regexp_matches(q, '[/.]') then 0.65 else 0.35 end) * ov / len(et) end, 6) boost from o) where boost <> 0"""
)
def fn_path_boost(spark, d):
    return chunks(spark, d).crossJoin(F.broadcast(asked(spark))).select("id", "qid", rounded(scoring.path_boost(F.col("q"), F.col("file_path"))).alias("boost")).where("boost <> 0")


_PEN = f"case when {s_any('p', ['_test.', 'test_', '/test/', '.test.', 'spec.'])} then -0.15 when {s_any('p', ['mock', 'stub', 'fake'])} then -0.20 when {s_any('p', ['fixture'])} then -0.15 else 0 end"
_USE = " + ".join(f"case when {s_any('p', w)} then 0.05 else 0 end" for w in fixed.USAGE_PATHS)


@query(f"select n, round(({_PEN})::double, 6) penalty from (select n, lower(path) p from {s_numbered(PATHS, 'path')})")
def fn_type_penalty(spark, d):
    return numbered(spark, PATHS, "path").select("n", rounded(scoring.type_penalty(F.col("path"))).alias("penalty"))


@query(f"select n, round(least(0.15, {_USE} + case when {s_any('f', fixed.USAGE_NAMES)} then 0.03 else 0 end)::double, 6) boost from (select n, lower(path) p, lower({s_base('path')}) f from {s_numbered(PATHS, 'path')})")
def fn_usage_boost(spark, d):
    return numbered(spark, PATHS, "path").select("n", rounded(scoring.usage_boost(F.col("path"), text.basename(F.col("path")))).alias("boost"))


@query("select cast(n as bigint) n, cast(least(50, 20 + 5 * n) as bigint) k, cast(20 as integer) final_k from range(0, 12) t(n)")
def fn_adaptive_k(spark, d):
    k, final = qf.adaptive_k(F.col("id"))
    return spark.range(12).select(F.col("id").alias("n"), k.cast("long").alias("k"), final.alias("final_k"))


@query(f"select qid, case when qid = 1 then 1.0::double else 0.75::double end weight from {S_ASKED}")
def fn_query_weights(spark, d):
    return asked(spark).select("qid", F.when(F.col("qid") == ASKED[0][0], 1.0).otherwise(0.75).alias("weight"))


_DIAG = "(select user_id % 97 / 100.0::double as top, user_id % 13 / 100.0::double gap, event_id % 4 hits, event_id % 6 distinct_n, event_id from events)"


def _diag(spark, d):
    return table(spark, d, "events").select("event_id", ((F.col("user_id") % 97) / 100.0).alias("top"), ((F.col("user_id") % 13) / 100.0).alias("gap"), (F.col("event_id") % 4).alias("hits"), (F.col("event_id") % 6).alias("distinct_n"))


_CONF = "least(1.0, 0.45 * top + 0.25 * gap + 0.15 * least(1.0, hits / 2.0) + 0.15 * least(1.0, distinct_n / 3.0))::double"


@query(f"select event_id, round({_CONF}, 6) confidence from {_DIAG}")
def fn_confidence(spark, d):
    return _diag(spark, d).select("event_id", rounded(scoring.confidence(*map(F.col, ("top", "gap", "hits", "distinct_n")))).alias("confidence"))


@query(
    f"""select event_id, case when top >= 0.35 and gap >= 0.05 and hits <> 0 and distinct_n >= 2 then 'high_confidence_retrieval'
 else concat_ws(',', case when top < 0.35 then 'low_top_score' end, case when gap < 0.05 then 'weak_top_gap' end, case when hits = 0 then 'no_exact_identifier_hits' end, case when distinct_n < 2 then 'insufficient_distinct_evidence' end) end reasons from {_DIAG}"""
)
def fn_reasons(spark, d):
    return _diag(spark, d).select("event_id", joined(scoring.reasons(*map(F.col, ("top", "gap", "hits", "distinct_n"))), ",").alias("reasons"))


@query(f"select event_id, case when round({_CONF}, 9) < 0.58 then 'low_confidence' else 'normal' end answer_mode from {_DIAG}")
def fn_answer_mode(spark, d):
    c = rounded(scoring.confidence(*map(F.col, ("top", "gap", "hits", "distinct_n"))), 9)
    return _diag(spark, d).select("event_id", F.when(c < fixed.CONFIDENCE_LIMIT, "low_confidence").otherwise("normal").alias("answer_mode"))


_META = "lower(repo || ' ' || \"language\" || ' ' || file_path || ' ' || function_name || ' ' || parent_class || ' ' || signature)"


@query(f"with {CH}, p as (select id, qid, {s_exact('q')} et, {_META} hay from chunks, {S_ASKED}) select * from (select id, qid, round(least(0.40::double, 0.10::double * len(list_filter(et, lambda t: contains(hay, t)))), 6) boost from p) where boost <> 0")
def fn_meta_boost(spark, d):
    m = scoring.metadata_boost(F.col("q"), *(F.col(c) for c in ("repo", "language", "file_path", "function_name", "parent_class", "signature")))
    return chunks(spark, d).crossJoin(F.broadcast(asked(spark))).select("id", "qid", rounded(m).alias("boost")).where("boost <> 0")


@query(
    f"""with {CH}, p as (select id, qid, q, replace(lower(q), chr(92), '/') qn, replace(lower(file_path), chr(92), '/') pn, {s_exact('q')} et from chunks, {S_ASKED}),
o as (select *, {s_base('pn')} bn, {s_found('pn', fixed.PATH_TOKEN)} pt from p), h as (select *, len(list_filter(et, lambda t: list_contains(pt, t) or contains(bn, t))) hits from o)
select * from (select id, qid, round(case when pn = '' then 0 when (bn <> '' and contains(qn, bn)) or contains(qn, pn) or contains(pn, qn) then 0.45::double when regexp_matches(q, '[/.]') then least(0.45::double, hits * 0.06::double) else least(0.25::double, hits * 0.06::double) end, 6) boost from h) where boost <> 0"""
)
def fn_rerank_path(spark, d):
    return chunks(spark, d).crossJoin(F.broadcast(asked(spark))).select("id", "qid", rounded(scoring.rerank_path_boost(F.col("q"), F.col("file_path"))).alias("boost")).where("boost <> 0")


@query(f"""with {CH} select id, 'REPO: ' || repo || chr(10) || 'LANG: ' || "language" || chr(10) || 'PATH: ' || file_path || case when function_name <> '' then chr(10) || 'FUNC: ' || function_name else '' end || case when signature <> '' then chr(10) || 'SIGNATURE: ' || signature else '' end context from chunks""")
def fn_meta_context(spark, d):
    return chunks(spark, d).select("id", scoring.metadata_context(*map(F.col, ("repo", "language", "file_path", "function_name", "parent_class", "signature"))).alias("context"))


@query("select doc_id id, case when length(text) > 4096 then left(text, 3072) || chr(10) || '...TRUNCATED...' || chr(10) || right(text, 1024) else text end body from documents")
def fn_trunc_mid(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), text.middle_cut(F.col("text")).alias("body"))


@query("select doc_id id, case when length(text) > 2000 then left(text, 2000) || chr(10) || '... (truncated)' else text end body from documents")
def fn_trunc_tail(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), text.tail_cut(F.col("text")).alias("body"))


# ---- paths, keys, names ---------------------------------------------------------------------------


@query(f"select n, array_to_string(list_slice(string_split(regexp_replace(replace(path, chr(92), '/'), '^/+|/+$', '', 'g'), '/'), 1, 2), '/') component from {s_numbered(PATHS, 'path')}")
def fn_component(spark, d):
    return numbered(spark, PATHS, "path").select("n", text.component(F.col("path")).alias("component"))


@query(f"with {CH} select id, repo || '|' || file_path || '|' || start_line || '|' || end_line \"key\" from chunks")
def fn_chunk_key(spark, d):
    return chunks(spark, d).select("id", text.chunk_key(*map(F.col, ("repo", "file_path", "start_line", "end_line"))).alias("key"))


_SH = f"list_filter([{', '.join(map(lit, fixed.SHAPE_ANCHORS))}], lambda a: contains(lower(q), a))"


@query(f"select n, case when contains(lower(q), 'explain') and {s_any('lower(q)', ['service', 'module'])} and len({_SH}) > 0 then q || ' ' || array_to_string({_SH}, ' ') else q end shaped from {s_numbered(QUESTIONS, 'q')}")
def fn_shape_query(spark, d):
    return numbered(spark, QUESTIONS, "q").select("n", qf.shaped(F.col("q")).alias("shaped"))


@query(f"select n, pos, v from (select n, trim(q) b from {s_numbered(QUESTIONS, 'q')}), lateral (select unnest([0, 1, 2]) pos, unnest([b, b || ' implementation file path function repo:src1', b || ' call flow error handling signature repo:src1']) v)")
def fn_fallback_queries(spark, d):
    return numbered(spark, QUESTIONS, "q").select("n", F.posexplode(qf.fallback(F.col("q"), F.lit("src1"))).alias("pos", "v"))


_EXPANDED = f"list_slice([{', '.join(map(lit, fixed.ARCH_EXPANSIONS))}] || flatten(list_transform(list_slice({_SYMS}, 1, 2), lambda s: [s || ' callers callees dependencies', s || ' integration usage pattern'])), 1, 5)"


@query(f"with x as (select n, {_GOT} g from {s_numbered(QUESTIONS, 'q')}), y as (select n, {_EXPANDED} l from x) select n, cast(unnest(range(0, len(l))) as integer) pos, unnest(l) v from y")
def fn_arch_expand(spark, d):
    return numbered(spark, QUESTIONS, "q").select("n", F.posexplode(qf.arch_expansions(qf.symbols(F.col("q")))).alias("pos", "v"))


@query("select doc_id id, trim(regexp_replace(text, '\\s+', ' ', 'g')) t from documents")
def fn_ws_norm(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), text.ws_norm(F.col("text")).alias("t"))


_DESC = '{"src0": "first source", "src1": "second source"}'


@query(f"select distinct source repo, coalesce(json_extract_string({lit(_DESC)}, source), 'Project: ' || source) descr from documents")
def fn_repo_desc(spark, d):
    known = F.element_at(F.from_json(F.lit(_DESC), "map<string,string>"), F.col("source"))
    return table(spark, d, "documents").select(F.col("source").alias("repo"), F.coalesce(known, F.concat(F.lit("Project: "), "source")).alias("descr")).distinct()


_JSON = ['["a", "b c"]', 'Sure: ["x"] done', "1. alpha\n\"beta\"\n```\n'gamma'\ndelta", "", "[broken"]


@query("select * from (values (0, 'a|b c'), (1, 'x'), (2, '1. alpha|beta|gamma'), (3, ''), (4, '[broken')) t(n, items)")
def fn_json_array(spark, d):
    return numbered(spark, _JSON, "s").select("n", joined(text.json_array(F.col("s")), "|").alias("items"))


@query(f"select qid, md5(q || ':answer:src1') k from {S_ASKED}")
def fn_md5_key(spark, d):
    return asked(spark).select("qid", text.cache_key(F.col("q"), F.lit("answer"), F.lit("src1")).alias("k"))


@query(f"select n, regexp_replace(path, '[^A-Za-z0-9._-]', '_', 'g') safe from {s_numbered(PATHS, 'path')}")
def fn_sanitize(spark, d):
    return numbered(spark, PATHS, "path").select("n", text.sanitize(F.col("path")).alias("safe"))


@query("select page_id, replace(list_extract(string_split(regexp_replace(url, '/+$', ''), '/'), -1), '.git', '') repo from pages")
def fn_repo_name(spark, d):
    return table(spark, d, "pages").select("page_id", text.repo_name(F.col("url")).alias("repo"))


@query(f"select n, {s_base('path')} base from {s_numbered(PATHS, 'path')}")
def fn_basename(spark, d):
    return numbered(spark, PATHS, "path").select("n", text.basename(F.col("path")).alias("base"))


_IMPORTS = ['"fmt"', '"github.com/a/b"', "os", "'x'", '"', ""]


@query(f"select n, regexp_replace(regexp_replace(s, '^\"', ''), '\"$', '') imp from {s_numbered(_IMPORTS, 's')}")
def fn_import_clean(spark, d):
    return numbered(spark, _IMPORTS, "s").select("n", text.import_clean(F.col("s")).alias("imp"))


@query(f"with {CH} select id, repo || '::' || file_path file_node, file_path || '::' || function_name fn_node, repo || '::import::' || function_name import_node from chunks")
def fn_node_ids(spark, d):
    return chunks(spark, d).select("id", F.concat("repo", F.lit("::"), "file_path").alias("file_node"), F.concat("file_path", F.lit("::"), "function_name").alias("fn_node"), F.concat("repo", F.lit("::import::"), "function_name").alias("import_node"))


_TIMES = "case when m < 1 then 'just now' when m < 60 then m || 'm ago' when m < 1440 then (m // 60) || 'h ago' else (m // 1440) || 'd ago' end"


@query(f"select event_id, {_TIMES} label from (select event_id, cast(date_diff('second', ts, (select max(ts) from events)) as bigint) // 60 m from events)")
def fn_rel_time(spark, d):
    e = table(spark, d, "events")
    last = e.agg(F.max("ts").alias("last"))
    m = F.expr("(unix_seconds(cast(last as timestamp)) - unix_seconds(cast(ts as timestamp))) div 60")
    label = F.expr("case when m < 1 then 'just now' when m < 60 then concat(m, 'm ago') when m < 1440 then concat(m div 60, 'h ago') else concat(m div 1440, 'd ago') end")
    return e.crossJoin(F.broadcast(last)).withColumn("m", m).select("event_id", label.alias("label"))


@query("select conv_id, turn, regexp_extract(text, '([A-Za-z]+)\\.', 1) file from conversations")
def fn_searched_files(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.regexp_extract("text", r"([A-Za-z]+)\.", 1).alias("file"))


# ---- filters --------------------------------------------------------------------------------------


@query(f"with {CH} select id, repo, \"language\" from chunks where repo = 'src3' and \"language\" = 'en'")
def flt_payload(spark, d):
    return chunks(spark, d).where((F.col("repo") == "src3") & (F.col("language") == "en")).select("id", "repo", "language")


@query(f"with {CH} select id, qid from chunks, {S_ASKED} where regexp_matches(q, '[/.]') and contains(replace(lower(file_path), chr(92), '/'), replace(lower(list_extract(string_split(q, ' '), 1)), chr(92), '/'))")
def flt_path_contains(spark, d):
    q = asked(spark).where(F.col("q").rlike("[/.]")).select("qid", F.replace(F.lower(F.substring_index("q", " ", 1)), F.lit("\\"), F.lit("/")).alias("p"))
    return chunks(spark, d).join(F.broadcast(q), F.contains(F.replace(F.lower("file_path"), F.lit("\\"), F.lit("/")), F.col("p"))).select("id", "qid")


@query(f"with {CH} select id, file_path from chunks where ends_with(file_path, 'doc_12.txt') or ends_with(file_path, '/doc_7.txt')")
def flt_suffix(spark, d):
    return chunks(spark, d).where(F.endswith("file_path", F.lit("doc_12.txt")) | F.endswith("file_path", F.lit("/doc_7.txt"))).select("id", "file_path")


@query(f"with {CH} select id, function_name, file_path from chunks where contains(function_name, 'th') or contains(file_path, 'th') order by id limit 20")
def flt_name_search(spark, d):
    return chunks(spark, d).where(F.contains("function_name", F.lit("th")) | F.contains("file_path", F.lit("th"))).select("id", "function_name", "file_path").orderBy("id").limit(20)


@query(f"with x as (select n, {s_exact('q')} e from {s_numbered(QUESTIONS, 'q')}) select a.n, b.n m from x a, x b where a.n < b.n and len(list_intersect(a.e, b.e)) > 0")
def flt_tech_overlap(spark, d):
    x = numbered(spark, QUESTIONS, "q").select("n", text.exact_tokens(F.col("q")).alias("e"))
    y = x.select(F.col("n").alias("m"), F.col("e").alias("f"))
    return x.join(F.broadcast(y), (F.col("n") < F.col("m")) & F.arrays_overlap("e", "f")).select("n", "m")


@query(f"select n, len(list_filter(string_split_regex(trim(lower(q)), '\\s+'), lambda t: t <> '')) < 3 or {s_any('lower(q)', fixed.VAGUE_PHRASES)} vague from {s_numbered(QUESTIONS, 'q')}")
def flt_vague(spark, d):
    return numbered(spark, QUESTIONS, "q").select("n", qf.is_vague(F.col("q")).alias("vague"))


_VARS = ["How does the token bucket work", "redis_queue internals", "short", "REDIS_QUEUE INTERNALS", "bucket of tokens in redis_queue", "unrelated words here"]


_OWN_TECH = f"list_slice({s_first('e')}, 1, 6)"
_KEPT = f"list_filter([{', '.join(map(lit, _VARS))}], lambda v: length(v) >= 8 and lower(v) <> lower(b) and (len(tech) = 0 or len(list_filter(tech, lambda t: contains(lower(v), t))) > 0))"


@query(
    f"""with x as (select n, trim(regexp_replace(q, '\\s+', ' ', 'g')) b, {_TECH} e from {s_numbered(QUESTIONS, 'q')}), y as (select n, b, {_OWN_TECH} tech from x), z as (select n, b, {_KEPT} g from y)
select n, array_to_string(list_slice([b] || list_filter(g, lambda t, i: list_position(list_transform(g, lambda u: lower(u)), lower(t)) = i), 1, 3), '|') variants from z"""
)
def flt_variant_clean(spark, d):
    v = F.array(*map(F.lit, _VARS))
    return numbered(spark, QUESTIONS, "q").select("n", joined(qf.clean_variants(F.col("q"), v), "|").alias("variants"))


@query("select item_id, length(trim(text)) >= 10 searched, length(trim(text)) > 20 kept from benchmark")
def flt_hyde_min(spark, d):
    n = F.length(F.trim("text"))
    return table(spark, d, "benchmark").select("item_id", (n >= 10).alias("searched"), (n > 20).alias("kept"))


@query(f"select n, {s_any('lower(q)', fixed.HYDE_SKIP)} skip from {s_numbered(QUESTIONS, 'q')}")
def flt_hyde_skip(spark, d):
    return numbered(spark, QUESTIONS, "q").select("n", qf.skips_hyde(F.col("q")).alias("skip"))


@query("select source, count(*) n from documents where lower(lang) = 'en' group by source")
def flt_sym_kind(spark, d):
    syms = table(spark, d, "documents").groupBy("source").agg(F.collect_list(F.struct("lang", "doc_id")).alias("symbols"))
    return syms.select("source", F.size(F.filter("symbols", lambda s: F.lower(s["lang"]) == "en")).cast("long").alias("n")).where("n > 0")


@query(f"with {CH} select id, file_path from chunks where contains(lower(file_path), 'src1/e')")
def flt_tree(spark, d):
    return chunks(spark, d).where(F.contains(F.lower("file_path"), F.lit("src1/e"))).select("id", "file_path")


@query(f"with {CH} select repo, count(*) n from chunks where function_name <> '' group by repo")
def flt_not_blank(spark, d):
    pages = chunks(spark, d).groupBy("repo").agg(F.collect_list(F.struct(F.col("function_name").alias("name"))).alias("s"))
    return pages.select("repo", F.size(F.filter("s", lambda x: text.empty(x["name"]) != "")).cast("long").alias("n")).where("n > 0")


_HIST = "select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn desc, role, text) r from conversations where role in ('user', 'assistant') and trim(text) <> ''"


def _history(spark, d):
    from pyspark.sql import Window

    c = table(spark, d, "conversations").where(F.col("role").isin("user", "assistant") & (F.trim("text") != ""))
    return c.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text"))).where("r <= 8")


@query(f"select conv_id, turn, role, text from ({_HIST}) where r <= 8")
def flt_history(spark, d):
    return _history(spark, d).select("conv_id", "turn", "role", "text")


@query(f"select conv_id, turn, text from ({_HIST}) where r <= 8", name="wn_last_n")
def wn_last_n(spark, d):
    return _history(spark, d).select("conv_id", "turn", "text")


@query("select page_id, regexp_matches(url, '^(https?|git|ssh)://') and length(url) <= 500 valid from pages")
def flt_valid_url(spark, d):
    return table(spark, d, "pages").select("page_id", (F.col("url").rlike("^(https?|git|ssh)://") & (F.length("url") <= 500)).alias("valid"))


@query(f"select n, regexp_matches(path, '^[A-Za-z0-9._-]+$') and length(path) <= 100 valid from {s_numbered(PATHS, 'path')}")
def flt_valid_name(spark, d):
    return numbered(spark, PATHS, "path").select("n", (F.col("path").rlike("^[A-Za-z0-9._-]+$") & (F.length("path") <= 100)).alias("valid"))


@query("select conv_id, turn, length(trim(text)) between 1 and 500 valid from conversations")
def flt_query_valid(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.length(F.trim("text")).between(1, 500).alias("valid"))


@query("select n_nationkey, n_name from nation where n_regionkey = 1 or n_regionkey is null")
def flt_repo_null(spark, d):
    return table(spark, d, "nation").where((F.col("n_regionkey") == 1) | F.col("n_regionkey").isNull()).select("n_nationkey", "n_name")


# ---- parsing and chunking ---------------------------------------------------------------------------

_EXT = f"lower(regexp_extract({s_base('path')}, '(\\.[^.]*)$', 1))"
_LANG = "case " + " ".join(f"when ext = {lit(k)} then {lit(v)}" for k, v in fixed.LANGUAGES.items()) + " else regexp_replace(ext, '^\\.', '') end"


@query(f"select n, {_LANG} lang from (select n, {_EXT} ext from {s_numbered(PATHS, 'path')})")
def prs_lang(spark, d):
    return numbered(spark, PATHS, "path").select("n", text.language_of(text.extension(F.col("path"))).alias("lang"))


_OWN = "case " + " ".join(f"when ext = {lit(k)} then {lit(v)}" for k, v in fixed.EXTRACTORS.items()) + f" when {s_in('ext', list(fixed.LANGUAGES))} then 'generic' else 'fallback' end"


@query(f"select n, {_OWN} extractor from (select n, case when {s_base('path')} = 'Dockerfile' then '.dockerfile' else {_EXT} end ext from {s_numbered(PATHS, 'path')})")
def prs_dispatch(spark, d):
    return numbered(spark, PATHS, "path").select("n", text.extractor_of(F.col("path")).alias("extractor"))


_LINES = "string_split(text, chr(10))"


@query(
    f"""with f as (select doc_id, 'doc_' || doc_id || '.txt' name, {_LINES} l from documents where trim(text) <> ''),
c as (select doc_id, name, k, list_slice(l, k * 20 + 1, least(len(l), k * 20 + 20)) own, k * 20 + 1 start_line, least(len(l), k * 20 + 20) end_line from f, lateral (select unnest(range(0, (len(l) - 1) // 20 + 1)) k))
select doc_id, cast(start_line as integer) start_line, cast(end_line as integer) end_line, name, array_to_string(own, chr(10)) body, 'file: ' || name || chr(10) || 'body: ' || array_to_string(list_slice(own, 1, 3), ' ') embed from c"""
)
def prs_fallback(spark, d):
    from ..sources.files import line_chunks

    files = table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    return line_chunks(files, lines=20).select("doc_id", "start_line", "end_line", "name", F.col("content").alias("body"), F.col("embed_text").alias("embed"))


@query("select doc_id, cast(k as integer) k, count(*) over (partition by doc_id) parts from documents, lateral (select unnest(range(0, (len(string_split(text, chr(10))) - 1) // 20 + 1)) k)")
def wn_line_chunks(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.expr("(size(split(text, '\\n')) - 1) div 20").cast("int"))).alias("k"))
    return rows.withColumn("parts", F.count("*").over(Window.partitionBy("doc_id")))


@query("select page_id, html is null or html = '' or contains(hex(encode(html)), 'NONE') is_binary from pages")
def prs_binary(spark, d):
    return table(spark, d, "pages").select("page_id", text.is_binary(F.encode("html", "UTF-8")).alias("is_binary"))


@query(f"select doc_id, array_to_string(list_slice({_LINES}, 1, 3), ' ') head from documents")
def prs_headlines(spark, d):
    return table(spark, d, "documents").select("doc_id", text.head_lines(F.col("text"), 3).alias("head"))


_CODE = [
    'import "fmt"\nfunc (s *Store) Get(key string) (string, error) {\n  return s.load(key)\n}',
    "def run(a, b: int) -> str:\n    return os.path.join(a, b)",
    "export const f = async (x) => { return api.get(x) }",
    "class A extends B { m() { this.go(1) } }",
    "SELECT count(x) FROM t",
    "fn add(a: i32) -> i32 { a.pow(2) }",
]


@query(f"select n, array_to_string({s_found('s', 'import +[^ ;]+')}, '|') imports from (select n, replace(s, chr(10), ' ') s from {s_numbered(_CODE, 's')})")
def prs_imports(spark, d):
    return numbered(spark, _CODE, "s").select("n", joined(text.found(F.replace("s", F.lit("\n"), F.lit(" ")), "import +[^ ;]+"), "|").alias("imports"))


@query(f"select n, array_to_string({s_found('s', '([A-Za-z_][A-Za-z0-9_]*)[(]', 1)}, '|') calls from {s_numbered(_CODE, 's')}")
def prs_calls(spark, d):
    return numbered(spark, _CODE, "s").select("n", joined(F.regexp_extract_all("s", F.lit("([A-Za-z_][A-Za-z0-9_]*)[(]"), F.lit(1)), "|").alias("calls"))


_B = "trim(string_split(s, '{')[1])"


@query(
    f"""select n, {_B} go, case when contains(s, ':') then trim(string_split(s, ':')[1]) || ':' else trim(s) end py,
 case when instr(s, '=>') > 0 and (instr(s, '{{') = 0 or instr(s, '=>') < instr(s, '{{')) then trim(string_split(s, '=>')[1]) else {_B} end ts,
 case when contains(s, '{{') then {_B} when contains(s, '->') then trim(string_split(s, '->')[1]) when contains(s, '=>') then trim(string_split(s, '=>')[1]) else trim(left(s, 200)) end generic from {s_numbered(_CODE, 's')}"""
)
def prs_signature(spark, d):
    return numbered(spark, _CODE, "s").select("n", *(text.signature(F.col("s"), f).alias(a) for f, a in (("go", "go"), ("python", "py"), ("typescript", "ts"), ("generic", "generic"))))


@query(f"select n, regexp_extract(s, 'func +[(][A-Za-z_]* *[*]?([A-Za-z_][A-Za-z0-9_]*)[)]', 1) receiver from {s_numbered(_CODE, 's')}")
def prs_receiver(spark, d):
    return numbered(spark, _CODE, "s").select("n", F.regexp_extract("s", "func +[(][A-Za-z_]* *[*]?([A-Za-z_][A-Za-z0-9_]*)[)]", 1).alias("receiver"))


@query(f"with {CH}, h as (select id, sha1(file_path || '::' || function_name || '::' || start_line || ':' || end_line || '::' || parent_class) h from chunks) select id, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] chunk_id from h")
def chk_id(spark, d):
    return chunks(spark, d).select("id", text.chunk_id(*map(F.col, ("file_path", "function_name", "start_line", "end_line", "parent_class"))).alias("chunk_id"))


@query(f"with {CH} select id, case when function_name = '' then signature else function_name end child, case when \"content\" = '' then signature else \"content\" end parent from chunks")
def chk_pairs(spark, d):
    return chunks(spark, d).select("id", F.coalesce(F.nullif("function_name", F.lit("")), "signature").alias("child"), F.coalesce(F.nullif("content", F.lit("")), "signature").alias("parent"))


_S_PREVIEW = "array_to_string(list_slice(list_filter(list_transform(string_split(\"content\", chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), 1, 8), ' ')"


@query(f"with {CH}, p as (select *, {_S_PREVIEW} pv from chunks) select id, 'func: ' || function_name || chr(10) || 'signature: ' || signature || chr(10) || 'file: ' || file_path || chr(10) || 'imports: a b' || case when pv <> '' then chr(10) || 'body: ' || pv else '' end embed from p")
def chk_embed_text(spark, d):
    e = text.embed_text(F.lit("function"), F.col("function_name"), F.col("signature"), F.col("file_path"), F.col("parent_class"), F.array(F.lit("a"), F.lit("b")), F.lit(""), F.col("content"))
    return chunks(spark, d).select("id", e.alias("embed"))


@query(f"with {CH} select id, {_S_PREVIEW} preview from chunks")
def chk_preview(spark, d):
    return chunks(spark, d).select("id", text.preview(F.col("content")).alias("preview"))


_DOCS = ['"""Doc text."""', "/* block */", "// line", "# hash", "'''single'''", "  plain ", '"""/*both*/"""']
_STRIP = "regexp_replace(s, '^\\s+|\\s+$', '', 'g')"
for _m in ('^"""', "^'''", '"""$', "'''$", "^/\\*", "\\*/$", "^//", "^#"):
    _STRIP = f"regexp_replace({_STRIP}, {lit(_m)}, '')"


@query(f"select n, regexp_replace({_STRIP}, '^\\s+|\\s+$', '', 'g') doc from {s_numbered(_DOCS, 's')}")
def chk_strip_doc(spark, d):
    return numbered(spark, _DOCS, "s").select("n", text.strip_doc(F.col("s")).alias("doc"))


@query(f"with {CH} select id, file_path, \"language\", '' imports from chunks")
def chk_metadata(spark, d):
    return chunks(spark, d).select("id", F.struct("file_path", "language", F.lit("").alias("imports")).alias("m")).select("id", "m.*")


@query(f"with {CH} select id, case when parent_class <> '' then parent_class else signature end doc_text from chunks")
def chk_doc_text(spark, d):
    return chunks(spark, d).select("id", F.coalesce(F.nullif("parent_class", F.lit("")), "signature").alias("doc_text"))


@query(f"select n, {s_any('lower(e)', fixed.RATE_LIMIT_MARKS)} rate_limited, {s_any('lower(e)', fixed.TRANSIENT_MARKS)} transient from {s_numbered(ERRORS, 'e')}")
def ml_errors(spark, d):
    return numbered(spark, ERRORS, "e").select("n", qf.is_rate_limited(F.col("e")).alias("rate_limited"), qf.is_transient(F.col("e")).alias("transient"))


@query("select cast(r as bigint) n, least(10.0::double, 0.5 * pow(2, r)) delay from range(0, 8) t(r)")
def sm_retry(spark, d):
    return spark.range(8).select(F.col("id").alias("n"), F.least(F.lit(10.0), 0.5 * F.pow(F.lit(2.0), F.col("id"))).alias("delay"))


_MODELS = " m1, m2 ,, m1"


@query("select * from (values (0, 'main'), (1, 'm1'), (2, 'm2')) t(pos, model)")
def ml_model_chain(spark, d):
    own = F.filter(F.transform(F.split(F.lit(_MODELS), ","), lambda m: F.trim(m)), lambda m: m != "")
    return spark.range(1).select(F.posexplode(F.array_distinct(F.concat(F.array(F.lit("main")), own))).alias("pos", "model"))


#: DuckDB pieces for the flagship: the share of the first five tokens in a chunk (raised where its name is asked for), and tokens shared with the path.
_HAY = "lower(repo || ' ' || file_path || ' ' || function_name || ' ' || parent_class || ' ' || signature || ' ' || \"content\")"
_HITS = f"len(list_filter(list_slice(et, 1, 5), lambda t: contains({_HAY}, t)))"
_RAW = f"0.35::double * {_HITS} / least(len(et), 5)"
_SHARE = f"(case when {_HITS} = 0 then 0 when function_name <> '' and contains(lower(q), lower(function_name)) then greatest({_RAW}, 0.35::double * 0.7) else {_RAW} end)"
_PATH_TOKENS = f"len(list_intersect(et, {s_found('lower(file_path)', fixed.PATH_TOKEN)}))"
