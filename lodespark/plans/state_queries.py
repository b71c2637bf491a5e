"""Sources, keyed state, chat, metrics, windows and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import metrics, state
from ..sources.tables import shared_dir
from ..streaming import jobs, keyed, sink, timed
from .catalog import CH, TOKS, chunks, joined, query, rounded, s_vectors, table, tokens, values

# ---- snapshots and change feeds ------------------------------------------------------------------------

_SNAP = "b as (select doc_id path, md5(text) h from documents where doc_id % 5 <> 0), a as (select doc_id path, case when doc_id % 7 = 0 then 'x' else md5(text) end h from documents where doc_id % 11 <> 0)"


def _snapshots(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.md5("text").alias("hash"))
    return docs.where("path % 5 <> 0"), docs.where("path % 11 <> 0").withColumn("hash", F.when(F.col("path") % 7 == 0, "x").otherwise(F.col("hash")))


@query(f"with {_SNAP} select coalesce(a.path, b.path) path, case when b.path is null then 'A' when a.path is null then 'D' else 'M' end change from b full join a on a.path = b.path where b.path is null or a.path is null or a.h <> b.h")
def src_diff(spark, d):
    return state.snapshot_diff(*_snapshots(spark, d))


FEED = "feed as (select event_id, ts, user_id file, case when event_type in ('signup', 'purchase') then 'A' when event_type = 'error' then 'D' else 'M' end change, value from events), last as (select * from (select *, row_number() over (partition by file order by ts desc, event_id desc) r from feed) where r = 1)"


def feed(spark, d):
    kind = F.when(F.col("event_type").isin("signup", "purchase"), "A").when(F.col("event_type") == "error", "D").otherwise("M")
    return table(spark, d, "events").select("event_id", "ts", F.col("user_id").alias("file"), kind.alias("change"), "value")


@query(f"with {FEED} select file, change, event_id from last")
def src_vec_upsert(spark, d):
    return state.latest(feed(spark, d), ["file"], [F.desc("ts"), F.desc("event_id")]).select("file", "change", "event_id")


@query(f"with {FEED} select file, event_id, round(value, 6) value from last where change <> 'D' union all select c_custkey, -1, round(c_acctbal, 6) from customer where c_custkey not in (select file from last)")
def sm_apply(spark, d):
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("file"), F.lit(-1).cast("long").alias("event_id"), F.col("c_acctbal").alias("value"))
    out = state.apply_changes(base, feed(spark, d), "file", [F.desc("ts"), F.desc("event_id")])
    return out.select("file", "event_id", rounded("value").alias("value"))


@query("select doc_id id from documents where source || '/' || lang not in ('src1/en', 'src2/fr')")
def src_vec_delete(spark, d):
    gone = spark.createDataFrame([("src1/en",), ("src2/fr",)], "dir string")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", "lang").alias("dir"))
    return state.delete(docs, F.broadcast(gone), ["dir"]).select("id")


@query("select doc_id id, lang, source from documents where doc_id > 100 order by doc_id limit 50")
def src_vec_scroll(spark, d):
    return table(spark, d, "documents").where("doc_id > 100").select(F.col("doc_id").alias("id"), "lang", "source").orderBy("id").limit(50)


@query("select count(*) n from documents where source = 'src4'")
def src_vec_count(spark, d):
    return table(spark, d, "documents").where("source = 'src4'").agg(F.count("*").alias("n"))


@query("select doc_id id from documents where source <> 'src4' or source is null")
def src_vec_purge(spark, d):
    return table(spark, d, "documents").where("source <> 'src4' or source is null").select(F.col("doc_id").alias("id"))


@query("select distinct source repo from documents where lang = 'es' and source <> ''")
def src_vec_affected(spark, d):
    return table(spark, d, "documents").where("lang = 'es' and source <> ''").select(F.col("source").alias("repo")).distinct().orderBy("repo")


@query(f"with {TOKS} select source repo, count(*) chunks, cast(sum(len(t)) as bigint) toks from toks join documents on doc_id = id group by source")
def src_bm25_rebuild(spark, d):
    t = table(spark, d, "documents").select(F.col("source").alias("repo"), F.size(text.tokenize(F.col("text"))).alias("n"))
    return t.groupBy("repo").agg(F.count("*").alias("chunks"), F.sum("n").alias("toks")).orderBy(F.desc("chunks"), "repo")


@query(f"with {TOKS} select id, cast(len(t) as integer) n from toks")
def src_bm25_load_api(spark, d):
    """A sparse corpus as JSON lines; a malformed line gives no tokens."""
    rows = tokens(spark, d).select(F.to_json(F.struct("id", F.col("t").alias("corpus"))).alias("value"))
    own = rows.union(spark.createDataFrame([("{bad",)], "value string")).select(F.from_json("value", "id long, corpus array<string>").alias("j"))
    return own.where("j.id is not null").select("j.id", F.size("j.corpus").alias("n"))


@query("select doc_id, row_number() over (partition by md5(text) order by doc_id) = 1 miss from documents")
def jn_cache_miss(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("k"))
    first = docs.groupBy("k").agg(F.min("doc_id").alias("first"))
    return docs.join(first, "k").select("doc_id", (F.col("doc_id") == F.col("first")).alias("miss"))


_EMB = "cache as (select md5(text) k, doc_id v from documents where doc_id % 3 = 0)"


@query(f"with {_EMB}, c as (select k, min(v) v from cache group by k) select doc_id, coalesce(v, -1) v from documents left join c on k = md5(text)")
def src_emb_cache(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("k"))
    cache = docs.where("doc_id % 3 = 0").groupBy("k").agg(F.min("doc_id").alias("v"))
    hits, _ = state.cache_join(docs, cache, "k")
    return docs.select("doc_id").join(hits.select("doc_id", "v"), "doc_id", "left").select("doc_id", F.coalesce("v", F.lit(-1)).alias("v"))


@query(f"with {_EMB}, c as (select distinct k from cache) select count(distinct md5(text)) misses from documents where md5(text) not in (select k from c)")
def emb_cached(spark, d):
    docs = table(spark, d, "documents").select(F.md5("text").alias("k"))
    cache = table(spark, d, "documents").where("doc_id % 3 = 0").select(F.md5("text").alias("k")).distinct()
    return state.cache_join(docs, cache, "k")[1].agg(F.count("*").alias("misses"))


_NOW = "(select max(ts) from events)"


@query(f"select event_id, md5(event_type || ':' || user_id) k from events where ts > {_NOW} - interval 3600 second")
def src_query_cache(spark, d):
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    rows = e.crossJoin(F.broadcast(now))
    return state.alive(rows, F.col("now"), 3600).select("event_id", text.cache_key(F.col("event_type"), F.col("user_id").cast("string")).alias("k"))


@query(f"select event_type, count(*) alive from events where ts > {_NOW} - interval 604800 second group by event_type")
def sm_ttl_cache(spark, d):
    e = table(spark, d, "events")
    rows = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now"))))
    return state.alive(rows, F.col("now"), 604800).groupBy("event_type").agg(F.count("*").alias("alive"))


@query("select conv_id, turn, md5(text || ':answer:') k from conversations")
def src_llm_memo(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    memo = c.select("text").distinct().withColumn("k", text.cache_key(F.col("text"), F.lit("answer"), F.lit("")))
    return c.join(memo, "text").select("conv_id", "turn", "k")


@query("select user_id id, max_by(event_type, event_id) last_type, round(max_by(value, event_id) filter (event_type <> 'error'), 6) last_value from events group by user_id")
def src_node_upsert(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), "event_id", F.col("event_type").alias("last_type"), F.when(F.col("event_type") != "error", F.col("value")).alias("last_value"))
    return state.overlay(e, ["id"], ["last_type", "last_value"], "event_id").select("id", "last_type", rounded("last_value").alias("last_value"))


_G = "e as (select distinct o_custkey src, 1000000 + o_orderkey % 300 dst from orders)"


@query(f"with {_G}, gone as (select 13 id union select dst from e where src = 13) select src, dst from e where src not in (select id from gone) and dst not in (select id from gone)")
def src_graph_delete(spark, d):
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.lit(1000000) + F.col("o_orderkey") % 300).cast("long").alias("dst")).distinct()
    gone = e.where("src = 13").select(F.col("dst").alias("id")).union(spark.createDataFrame([(13,)], "id long")).distinct()
    return e.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst")


@query("select doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) lines from documents")
def src_line_slice(spark, d):
    return table(spark, d, "documents").select("doc_id", text.line_slice(F.col("text"), F.lit(2), F.lit(4)).alias("lines"))


@query(f"with {CH} select file_path, \"content\" from chunks where file_path like '%/doc_1_.txt'")
def src_file_full(spark, d):
    return chunks(spark, d).where("file_path like '%/doc_1_.txt'").select("file_path", "content")


_SSE = ['data: {"type": "token", "data": "a"}', "data: {bad", ": ping", 'data: {"type": "answer", "data": "b"}']


@query("select * from (values (0, 'token', 'a'), (3, 'answer', 'b')) t(n, type, data)")
def src_sse_parse(spark, d):
    lines = spark.createDataFrame([("\n".join(_SSE),)], "body string").select(F.posexplode(F.split("body", "\n")).alias("n", "line"))
    own = F.from_json(F.regexp_replace("line", "^data: ", ""), "type string, data string")
    return lines.where("line like 'data: %'").select("n", own.alias("j")).where("j.type is not null").select("n", "j.type", "j.data")


@query("select * from (values ('a', 1, 'easy'), ('b', 2, null)) t(query, n, difficulty)")
def src_fixture_json(spark, d):
    rows = ['[{"query": "a", "expected_files": ["x.py"], "difficulty": "easy"}, {"query": "b", "expected_files": ["y", "z"]}]']
    j = spark.createDataFrame([(r,) for r in rows], "s string").select(F.explode(F.from_json("s", "array<struct<query:string,expected_files:array<string>,difficulty:string>>")).alias("q"))
    return j.select("q.query", F.size("q.expected_files").alias("n"), "q.difficulty")


@query(f"with {FEED} select change change_type, count(*) n from feed group by change")
def src_queue_consume(spark, d):
    lines = feed(spark, d).select(F.to_json(F.struct(F.col("file").cast("string").alias("file_path"), F.col("change").alias("change_type"), F.lit("0").alias("commit_sha"))).alias("value"))
    return jobs.json_jobs(lines.union(spark.createDataFrame([("{oops",)], "value string"))).groupBy("change_type").agg(F.count("*").alias("n"))


# ---- chat -------------------------------------------------------------------------------------------------


@query("select conv_id, count(*) n, string_agg(role, ',' order by turn) roles from conversations group by conv_id")
def jn_session_msgs(spark, d):
    c = table(spark, d, "conversations")
    msgs = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("m"))
    return msgs.select("conv_id", F.size("m").cast("long").alias("n"), joined(F.transform("m", lambda x: x["role"]), ",").alias("roles"))


@query("select conv_id, turn from conversations where conv_id % 3 <> 0")
def jn_cascade_delete(spark, d):
    c = table(spark, d, "conversations")
    return state.delete(c, c.where("conv_id % 3 = 0"), ["conv_id"]).select("conv_id", "turn")


@query("select conv_id, turn, role from conversations where conv_id = 3 order by turn")
def src_session_get(spark, d):
    return table(spark, d, "conversations").where("conv_id = 3").select("conv_id", "turn", "role").orderBy("turn")


@query("select conv_id id, 'New chat' title from (select distinct conv_id from conversations) union all select -1, 'Fresh'")
def src_session_insert(spark, d):
    s = table(spark, d, "conversations").select(F.col("conv_id").alias("id")).distinct().withColumn("title", F.lit("New chat"))
    return s.unionByName(spark.createDataFrame([(-1, "Fresh")], "id long, title string"))


@query("select conv_id id, case when conv_id % 2 = 0 then 'Renamed' else 'New chat' end title from (select distinct conv_id from conversations)")
def src_session_update(spark, d):
    s = table(spark, d, "conversations").select(F.col("conv_id").alias("id")).distinct().withColumn("title", F.lit("New chat"))
    new = s.where("id % 2 = 0").withColumn("title", F.lit("Renamed"))
    return state.upsert(s, new, ["id"])


@query("select conv_id, turn, text from conversations where conv_id <> 5 union all select 5, 0, 'only'")
def src_messages_replace(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return state.upsert(c, spark.createDataFrame([(5, 0, "only")], "conv_id long, turn long, text string"), ["conv_id"])


_FIRST = "select conv_id, min_by(text, turn) t from conversations where role = 'user' group by conv_id"


@query(f"select conv_id, case when length(t) > 50 then left(t, 50) || '...' else t end title from ({_FIRST})")
def fn_title(spark, d):
    first = table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("t"))
    return first.select("conv_id", text.title(F.col("t")).alias("title"))


@query("select conv_id, string_agg(upper(role[1]) || role[2:] || ': ' || trim(text), chr(10) order by turn) hist from (select *, row_number() over (partition by conv_id order by turn desc) r from conversations where role in ('user', 'assistant')) where r <= 8 group by conv_id")
def fn_history_fmt(spark, d):
    c = table(spark, d, "conversations").where(F.col("role").isin("user", "assistant"))
    c = c.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("r <= 8")
    line = F.concat(F.initcap("role"), F.lit(": "), F.trim("text"))
    own = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))).alias("m"))
    return own.select("conv_id", joined(F.transform("m", lambda x: x["l"]), "\n").alias("hist"))


@query("select conv_id, max(turn) last from conversations group by conv_id order by last desc, conv_id")
def so_sessions(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last")).orderBy(F.desc("last"), "conv_id")


@query("select conv_id, turn, role from conversations order by conv_id, turn")
def so_messages(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role").orderBy("conv_id", "turn")


@query("select distinct source repo from documents order by repo")
def so_repos(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("repo")).distinct().orderBy("repo")


@query(f"with {CH} select distinct file_path from chunks order by file_path")
def so_tree(spark, d):
    return chunks(spark, d).select("file_path").distinct().orderBy("file_path")


@query("select distinct source repo from documents")
def ag_repo_distinct(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("repo")).distinct()


@query("select source repo, count(*) n from documents group by source")
def ag_repo_counts(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("repo")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "repo")


@query("select user_id, event_type, event_id from (select user_id, event_type, max(event_id) event_id, row_number() over (partition by user_id order by max(event_id) desc) r from events group by user_id, event_type) where r <= 20")
def wn_recent_unique(spark, d):
    last = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"))
    return last.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))).where("r <= 20").drop("r")


@query("select conv_id, string_agg(text, '' order by turn) body from conversations where role = 'assistant' group by conv_id")
def sm_token_concat(spark, d):
    c = table(spark, d, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("m"))
    return c.select("conv_id", F.array_join(F.transform("m", lambda x: x["text"]), "").alias("body"))


@query("select conv_id, role, max_by(text, turn) body from conversations group by conv_id, role")
def sm_event_fold(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.max_by("text", "turn").alias("body"))


# ---- metrics ------------------------------------------------------------------------------------------------

_EDGES = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0]
_HIST = "h as (select event_type, le, count(*) filter (value <= le) n from events, (values " + ", ".join(f"({e}::double)" for e in [*_EDGES, "1e308"]) + ") b(le) group by event_type, le)"


def _hist(spark, d):
    return metrics.histogram(table(spark, d, "events"), "event_type", F.col("value"), _EDGES)


@query(f"with {_HIST} select event_type, le, n from h")
def ag_hist(spark, d):
    return _hist(spark, d)


@query(
    f"""with {_HIST}, w as (select *, coalesce(lag(n) over (partition by event_type order by le), 0) n0, coalesce(lag(le) over (partition by event_type order by le), 0) le0, 0.95::double * max(n) over (partition by event_type) at_ from h)
select event_type, round(case when le >= 1e308 then le0 else le0 + (le - le0) * (at_ - n0) / (n - n0) end, 6) p95 from w where n >= at_ and n0 < at_"""
)
def ag_hist_quantile(spark, d):
    return metrics.quantile(_hist(spark, d), "event_type", 0.95).select("event_type", rounded("value").alias("p95"))


_W5 = "time_bucket(interval 5 minute, ts)"


@query(f"select event_type, epoch_ms({_W5}) start, count(*) n, round(count(*) / 300.0::double, 9) rate from events group by event_type, {_W5}")
def ag_rate(spark, d):
    return metrics.rate(table(spark, d, "events"), "event_type").select("event_type", F.unix_millis(F.col("start").cast("timestamp")).alias("start"), "n", rounded("rate", 9).alias("rate"))


@query("select user_id % 10 key, round(100.0::double * count(*) filter (event_type = 'view') / nullif(count(*) filter (event_type in ('view', 'click')), 0), 6) percent from events group by 1")
def ag_hit_rate(spark, d):
    e = table(spark, d, "events").withColumn("key", F.col("user_id") % 10)
    return metrics.hit_rate(e, "key", F.col("event_type") == "view", F.col("event_type") == "click").select("key", rounded("percent").alias("percent"))


@query("select count(*) filter (contains(event_type, 'purchase')) done, count(*) total from events")
def ag_progress(spark, d):
    return table(spark, d, "events").agg(F.count_if(F.contains("event_type", F.lit("purchase"))).alias("done"), F.count("*").alias("total"))


@query("select user_id key, count(*) attempts, count(*) filter (event_type = 'error') errors, count(*) filter (event_type <> 'error') successes from events group by user_id")
def ag_llm_stats(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("attempts"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") != "error").alias("successes"))


@query("select event_id, count(*) over (partition by user_id order by epoch_us(ts) range between 3599999999 preceding and current row) recent from events")
def wn_key_60s(spark, d):
    return metrics.calls_before(table(spark, d, "events"), "user_id", "ts", 3600).select("event_id", "recent")


@query(f"select event_type, epoch_ms({_W5}) start, count(*) n from events group by event_type, {_W5}")
def sm_tumbling(spark, d):
    return jobs.windowed(table(spark, d, "events")).select("event_type", F.unix_millis(F.col("start").cast("timestamp")).alias("start"), "n")


@query("select event_type, epoch_ms(s) start, count(*) n from (select event_type, ts, unnest(generate_series(time_bucket(interval 5 minute, ts - interval 10 minute), ts, interval 5 minute)) s from events) where s <= ts and ts < s + interval 10 minute group by event_type, s")
def sm_rate_window(spark, d):
    return metrics.rate(table(spark, d, "events"), "event_type", width="10 minutes", seconds=600, slide="5 minutes").select("event_type", F.unix_millis(F.col("start").cast("timestamp")).alias("start"), "n")


_SESS = "g as (select user_id, ts, case when lag(ts) over (partition by user_id order by ts) is null or ts - lag(ts) over (partition by user_id order by ts) >= interval 30 minute then 1 else 0 end f from events), s as (select user_id, ts, sum(f) over (partition by user_id order by ts) k from g)"


@query(f"with {_SESS} select user_id, cast(floor(epoch(min(ts))) as bigint) start, count(*) n from s group by user_id, k")
def sm_session(spark, d):
    return jobs.sessions(table(spark, d, "events")).select("user_id", F.unix_seconds(F.col("start").cast("timestamp")).alias("start"), "n")


@query("with m as (select *, max(ts) over (order by event_id rows between unbounded preceding and current row) w from events) select event_type, count(*) filter (ts < w - interval 10 minute) late, count(*) n from m group by event_type")
def sm_late(spark, d):
    """Events more than ten minutes behind the latest of those before them, in order of arrival (a batch view of the late-data rule)."""
    e = table(spark, d, "events")
    day = e.withColumn("bucket", F.expr("event_id div 1000"))
    top = day.groupBy("bucket").agg(F.max("ts").alias("top")).withColumn("many", F.expr("bucket div 1000"))
    earlier = lambda w: F.max("top").over(w.rowsBetween(Window.unboundedPreceding, -1))
    outer = top.groupBy("many").agg(F.max("top").alias("top")).select("many", earlier(Window.orderBy("many")).alias("outer"))  # a row for a million events
    before = top.withColumn("inner", earlier(Window.partitionBy("many").orderBy("bucket"))).join(outer, "many").select("bucket", F.greatest("inner", "outer").alias("before"))
    inside = F.max("ts").over(Window.partitionBy("bucket").orderBy("event_id"))
    rows = day.withColumn("own", inside).join(before, "bucket").withColumn("w", F.greatest("own", F.coalesce("before", "own")))
    return rows.groupBy("event_type").agg(F.count_if(F.col("ts") < F.col("w") - F.expr("interval 10 minutes")).alias("late"), F.count("*").alias("n"))


# ---- state machines and streams ---------------------------------------------------------------------------------


def machine_events(spark, d):
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), (F.col("event_type") != "error").alias("ok"))


def _folded(state: str, start: str, step: str, out: str) -> str:
    """A machine as SQL: its step joins a key's next event, in order of time, to the state before."""
    return (
        "with recursive e as (select cast(user_id as varchar) k, epoch_us(ts) / 1e6 ts, event_type <> 'error' ok, row_number() over (partition by user_id order by epoch_us(ts) / 1e6, event_type <> 'error') n from events), "
        f"r(k, n, ts, {state}, {out}) as (select distinct k, 0::bigint, 0::double, {start} from e union all select e.k, e.n, e.ts, {step} from r join e on e.k = r.k and e.n = r.n + 1) "
    )


_TOKENS = "least(5.0::double, r.tokens + case when r.n = 0 then 0.0::double else greatest(0.0::double, e.ts - r.ts) * 0.0005::double end)"
_TOKEN_SQL = _folded("tokens", "5.0::double, true", f"{_TOKENS} - case when {_TOKENS} >= 1 then 1 else 0 end, {_TOKENS} >= 1", "allowed") + 'select k "key", ts, allowed, tokens from r where n > 0'
_SHUT = "(r.phase = 'open' and e.ts - r.opened < 3600)"
_HALF = "r.phase = 'open'"  # where it is not shut
_CIRCUIT_SQL = _folded(
    "phase, failures, opened", "'closed', 0, 0.0::double, false, ''",
    f"case when {_SHUT} then 'open' when e.ok then case when {_HALF} then 'closed' else r.phase end when {_HALF} or r.failures + 1 >= 5 then 'open' else r.phase end, "
    f"case when {_SHUT} then r.failures when e.ok then case when {_HALF} then 0 else r.failures end else r.failures + 1 end, "
    f"case when {_SHUT} then r.opened when e.ok then case when {_HALF} then 0.0::double else r.opened end when {_HALF} or r.failures + 1 >= 5 then e.ts else r.opened end, "
    f"not {_SHUT}, case when {_SHUT} then 'open' when e.ok then 'closed' when {_HALF} or r.failures + 1 >= 5 then 'open' else r.phase end", "called, said",
) + 'select k "key", ts, called, said phase from r where n > 0'
_COOL = "e.ts + least(60.0::double, power(2.0::double, least(r.failures + 1, 6)))"
_KEY_SQL = _folded(
    "failures, until_", "0, 0.0::double, true",
    f"case when e.ts < r.until_ then r.failures when e.ok then 0 else r.failures + 1 end, case when e.ts < r.until_ then r.until_ when e.ok then 0.0::double else {_COOL} end, not e.ts < r.until_", "usable",
) + 'select k "key", ts, usable, until_ "until" from r where n > 0'


@query(_TOKEN_SQL)
def sm_token_bucket(spark, d):
    return jobs.run_batch(machine_events(spark, d), jobs.TokenBucket(rate=0.0005, burst=5))


@query(_CIRCUIT_SQL)
def sm_circuit(spark, d):
    return jobs.run_batch(machine_events(spark, d), jobs.CircuitBreaker(limit=5, wait=3600))


@query(_KEY_SQL)
def sm_key_sched(spark, d):
    return jobs.run_batch(machine_events(spark, d), jobs.KeyCooldown())


@query('select k "key", ts, "value", ts + 3600 expired from (select cast(user_id as varchar) k, epoch_us(ts) / 1e6 ts, "value", lead(epoch_us(ts) / 1e6) over (partition by user_id order by epoch_us(ts) / 1e6, "value") after from events) where after is null or after >= ts + 3600')
def sm_ttl_expiries(spark, d):
    """The entries of a cache with a time to live of an hour that expire, as the stream of timed.expiries gives them."""
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), "value")
    return timed.expiries_of_table(rows, 3600.0)


@query("select file, event_id, round(value, 6) value from (select user_id file, event_id, value, event_type, row_number() over (partition by user_id order by event_id desc) r from events) where r = 1 and event_type <> 'error'")
def sm_oneshot(spark, d):
    """The change feed as files, applied by a stream that ends when all is read."""
    base = f"{shared_dir(spark)}/lodespark/feed-{uuid.uuid4().hex}"
    rows = feed(spark, d).select("event_id", "ts", "file", "change", "value")
    rows.repartition(3, "event_id").write.parquet(f"{base}/in")
    stream = jobs.change_stream(spark, f"{base}/in", rows.schema)
    q = jobs.apply_stream(stream, f"{base}/out", f"{base}/checkpoint", "file", "event_id")
    q.awaitTermination()  # raises if the stream fails
    return keyed.KeyedTable(spark, f"{base}/out", rows.schema, "file", "event_id").current().select("file", "event_id", rounded("value").alias("value"))


# ---- files and parsers ------------------------------------------------------------------------------------------

SOURCES = [
    ("a/run.py", 'import os\nfrom sys import path\n\nclass Job(Base):\n    """A job."""\n\n    @staticmethod\n    def start(x):\n        """Starts."""\n        return os.path.join(x, helper(1))\n\ndef helper(n):\n    return n\n'),
    ("b/store.go", 'package b\n\nimport (\n\t"fmt"\n\t"os"\n)\n\n// Store keeps things.\ntype Store struct {\n\tBase\n\tn int\n}\n\n// Get reads.\nfunc (s *Store) Get(k string) string {\n\tfmt.Println(k)\n\treturn s.load(k)\n}\n\nfunc load(k string) string { return os.Getenv(k) }\n'),
    ("c/app.ts", "import { x } from './x'\n\nexport class App extends Core implements Runs, Stops {\n  start(a: number) {\n    this.go(a)\n    return x.call(a)\n  }\n}\n\nexport const f = async (a) => {\n  return g(a)\n}\n\nfunction g(a) { return a }\n"),
    ("d/Main.java", "import java.util.List;\n\npublic class Main extends Thing {\n  public static void main(String[] args) {\n    run(args);\n  }\n}\n"),
    ("e/lib.rs", "use std::io;\n\npub struct P { x: i32 }\n\npub fn add(a: i32) -> i32 {\n    a.pow(2)\n}\n"),
    ("f/notes.txt", "line one\nline two\n"),
    ("g/logo.png", "binary"),
    ("h/bad.py", "def broken(:\n"),
]


def _parsed(spark):
    from ..sources.files import parse_files

    return parse_files(spark.createDataFrame([(p, c, "demo") for p, c in SOURCES], "path string, content string, repo string"))


def _family(prefix):
    def run(spark, d):
        return _parsed(spark).where(F.startswith("file_path", F.lit(prefix))).select("file_path", "name", "kind", "parent_class", "start_line", "end_line", "signature", "is_exported")

    return run


# What the sources above say, read by hand: name, kind, parent_class, start_line, end_line, signature, is_exported.
_SAID = {
    "a/run.py": [("Job", "class", "", 4, 10, "class Job(Base):", True), ("start", "method", "Job", 8, 10, "def start(x):", True), ("helper", "function", "", 12, 13, "def helper(n):", True)],
    "b/store.go": [("Store", "struct", "", 9, 12, "type Store struct", True), ("Get", "method", "Store", 15, 18, "func (s *Store) Get(k string) string", True), ("load", "function", "", 20, 20, "func load(k string) string", False)],
    "c/app.ts": [
        ("App", "class", "", 3, 8, "export class App extends Core implements Runs, Stops", True), ("start", "method", "App", 4, 7, "start(a: number)", False),
        ("f", "function", "", 10, 12, "export const f = async (a)", True), ("g", "function", "", 14, 14, "function g(a)", False),
    ],
    "d/Main.java": [("Main", "class", "", 3, 7, "public class Main extends Thing", True), ("main", "method", "Main", 4, 6, "public static void main(String[] args)", True)],
}
for _id, _file in zip(("prs_py", "prs_go", "prs_ts", "prs_generic"), _SAID, strict=True):
    _rows = values([(_file, *r) for r in _SAID[_file]], "t(file_path, name, kind, parent_class, start_line, end_line, signature, is_exported)")
    query(f"select * from {_rows}", name=_id)(_family(_file[:2]))


@query("select * from (values ('Store', 'Base'), ('P', '')) t(name, extends)")
def prs_go_embed(spark, d):
    return _parsed(spark).where("kind = 'struct'").select("name", "extends")


@query("select * from (values ('Store', '// Store keeps things.'), ('Get', '// Get reads.'), ('load', '')) t(name, docstring)")
def prs_comment(spark, d):
    return _parsed(spark).where("language = 'go'").select("name", "docstring")


@query("select * from (values ('Job', 'A job.'), ('start', 'Starts.'), ('helper', ''), ('bad.py', '')) t(name, docstring)")
def prs_docstring(spark, d):
    return _parsed(spark).where("language = 'python'").select("name", "docstring")


@query("select * from (values ('Job', 'Base', ''), ('App', 'Core', 'Runs,Stops'), ('Main', 'Thing', '')) t(name, extends, implements)")
def prs_bases(spark, d):
    return _parsed(spark).where("kind = 'class'").select("name", "extends", joined("implements", ",").alias("implements"))


@query("select * from (values ('Job', ''), ('start', 'staticmethod'), ('helper', ''), ('bad.py', '')) t(name, decorators)")
def prs_decorators(spark, d):
    return _parsed(spark).where("language = 'python'").select("name", joined(F.col("decorators"), ",").alias("decorators"))


@query()
def src_file_scan(spark, d):
    from ..sources.files import scan

    return scan(spark, f"{d}/region.parquet").select(text.basename(F.col("path")).alias("name"), F.length("content").alias("bytes"), F.length("hash").alias("hash_len"))


@query()
def src_read_file(spark, d):
    from ..sources.files import scan

    return scan(spark, f"{d}/nation.parquet").select(text.basename(F.col("path")).alias("name"), text.is_binary(F.col("content")).alias("is_binary"))


def _tree(spark):
    """Runs the tree source over a small folder twice, with changes in between."""
    import os
    import tempfile

    from ..sources.git import TreeSource

    spark.dataSource.register(TreeSource)
    base = tempfile.mkdtemp()
    root = os.path.join(base, "tree")
    os.makedirs(root)

    def put(path: str, body: str) -> None:
        with open(os.path.join(root, path), "w") as f:
            f.write(body)

    def drain() -> list:
        rows: list = []

        def take(batch, number):
            rows.extend(batch.collect())  # a handful of test rows

        q = spark.readStream.format("tree").option("root", root).option("state", f"{base}/state").load().writeStream.foreachBatch(take).option("checkpointLocation", f"{shared_dir(spark)}/lodespark/tree-{os.path.basename(base)}").trigger(processingTime="0 seconds").start()
        q.processAllAvailable()
        q.stop()
        return rows

    for p, body in (("a.py", "x"), ("b.go", "y"), ("c.txt", "z")):
        put(p, body)
    first = drain()
    put("a.py", "changed")
    put("d.rs", "new")
    os.remove(os.path.join(root, "c.txt"))
    out = [(1, r.file_path, r.change_type) for r in first] + [(2, r.file_path, r.change_type) for r in drain()]
    return spark.createDataFrame(out, "poll int, file_path string, change_type string")


@query("select * from (values (1, 'a.py', 'A'), (1, 'b.go', 'A'), (1, 'c.txt', 'A'), (2, 'a.py', 'M'), (2, 'd.rs', 'A'), (2, 'c.txt', 'D')) t(poll, file_path, change_type)")
def sm_watch(spark, d):
    return _tree(spark)


@query("select poll, count(*) n from (values (1), (1), (1), (2), (2), (2)) t(poll) group by poll")
def src_head_poll(spark, d):
    return _tree(spark).groupBy("poll").agg(F.count("*").alias("n"))


@query(f"with {s_vectors('select conv_id, turn, text from conversations', 'conv_id, turn')} select conv_id, turn, pos, round(x, 4) x from vec")
def ml_embed(spark, d):
    from .models import embed

    vectors = embed(table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("id"), "text"))
    return vectors.select("id.*", F.posexplode("vec").alias("pos", "x")).where("x <> 0").withColumn("x", rounded(F.col("x").cast("double"), 4))


_BOUNDS = [1, 5, 20, 100]


@query(
    "with e as (select event_type label, \"value\" v from events where event_type in ('click', 'error', 'purchase', 'signup', 'view')), "
    "m as (select 'count' metric, label, count(*)::double x from e group by label union all select 'sum', label, sum(v) from e group by label "
    + " ".join(f"union all select 'le_{b}', label, count(*) filter (v <= {b})::double from e group by label" for b in _BOUNDS)
    + ') select metric, label, round(x, 4) "value" from m'
)
def snk_metrics(spark, d):
    """Events as a stream whose metrics a listener writes to a table, and the totals of that table."""
    base, name = f"{shared_dir(spark)}/lodespark/metrics-{uuid.uuid4().hex}", f"metrics_{uuid.uuid4().hex}"
    rows = table(spark, d, "events").select("event_id", "event_type", "value")
    rows.repartition(3, "event_id").write.parquet(f"{base}/in")
    listener = sink.MetricsSink(spark, base, {name})
    spark.streams.addListener(listener)
    try:
        events = sink.counted(jobs.change_stream(spark, f"{base}/in", rows.schema), "event_type", ["click", "error", "purchase", "signup", "view"], F.col("value"), _BOUNDS)
        q = events.writeStream.queryName(name).format("noop").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    return sink.totals(spark, base).select("metric", "label", rounded("value", 4).alias("value"))
