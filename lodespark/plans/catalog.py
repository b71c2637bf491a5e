"""The registry of queries over the test tables, the stand-in views, and helpers that write the DuckDB side."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import retrieval
from ..sources.tables import load_index, persist_index, portions, shared_dir, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, with its DuckDB SQL where there is one."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


#: Literal search queries that both sides share.
ASKED = [
    (1, "the and that from with"),
    (2, "los ciónmente que para"),
    (3, "src3/en/doc_12.txt thing"),
    (4, "der die und einung"),
    (5, "explain the handler service flow client_api"),
    (6, "where is anon implemented"),
    (7, "trash the trash loser"),
]
#: Literal questions for query understanding.
QUESTIONS = [
    "How does the Token Bucket work with redis_queue?",
    "where is parse_config implemented",
    "what is the flow of WAL Append",
    "Show me the code of retry.backoff",
    "explain the service handler and client api",
    "overview",
    "How it works in general terms",
    "using kafka for the pipeline sequence",
    "signature of MAX_SIZE in module k8s",
    "  integrate   with grpc/proto  ",
    "Explain the module task",
    "which components call HTTPServer",
    "find_user in src/api/users.py line 20",
    "connect the WORKER to Db and db",
]
ERRORS = ["Error 429: slow down", "rate_limit exceeded", "Connection timeout", "service temporarily unavailable", "bad request", "HTTP 503", "Too Many Requests", "value error"]
PATHS = ["src/api/user_service_test.go", "lib/mock/handler.py", "pkg/adapter/pipeline/run.ts", "Dockerfile", "a/b.min.js", "docs/readme", "spec.rb", "x/fixtures/data.json", "cmd/main.go", "/lead/trail/", "web\\app\\start.TSX", "img/logo.PNG", "tests/test_init.py", "a.lock", "archive.tar.gz", ".DS_Store"]


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows: list, names: str) -> str:
    """A DuckDB VALUES table."""
    cell = lambda v: lit(v) if isinstance(v, str) else str(v)
    return "(values " + ", ".join("(" + ", ".join(cell(v) for v in (r if isinstance(r, tuple) else (r,))) + ")" for r in rows) + f") {names}"


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASKED, "qid int, q string")


def numbered(spark: SparkSession, rows: list[str], name: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(rows)), f"n int, {name} string")


def s_numbered(rows: list[str], name: str) -> str:
    return values(list(enumerate(rows)), f"x(n, {name})")


def s_tok(x: str, p: str = fixed.PUNCTUATION) -> str:
    return f"list_filter(list_transform(string_split_regex(lower(coalesce({x}, '')), '\\s+'), lambda t: trim(t, {lit(p)})), lambda t: t <> '')"


def s_first(lst: str) -> str:
    """Distinct in order of first place."""
    return f"list_filter({lst}, lambda t, i: list_position({lst}, t) = i)"


def s_found(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({x}, {lit(pattern)}, {group})"


def s_exact(x: str) -> str:
    return s_first(f"list_filter({s_found(f'lower({x})', fixed.IDENTIFIER)}, lambda t: length(t) >= 3)")


def s_any(x: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


def s_in(x: str, words: list[str]) -> str:
    return f"{x} in ({', '.join(map(lit, words))})"


def s_base(x: str) -> str:
    return f"list_extract(string_split({x}, '/'), -1)"


#: The table crc_of of the bytes 0 to 255: eight steps of the polynomial each.
_STEP = "list_reduce(list_prepend(b, range(8)), lambda c, _: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)"
S_CRC_TABLE = f"select list({_STEP} order by b) crc_of from range(256) t(b)"


def s_crc32(x: str) -> str:
    """crc32 of a string column, with crc_of in scope."""
    byte = f"cast('0x' || substr(hex(encode({x})), 2 * i + 1, 2) as bigint)"
    taken = f"list_prepend(4294967295, list_transform(range(octet_length(encode({x}))), lambda i: {byte}))"
    return f"xor(list_reduce({taken}, lambda c, x: xor(c >> 8, list_extract(crc_of, (xor(c, x) & 255) + 1))), 4294967295)"


def s_vectors(rows: str, keys: str, dim: int = 64) -> str:
    """CTEs up to vec(keys, pos, x): the non-zero parts of the hashing encoder's vectors of (keys, text) rows."""
    on = " and ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return (
        f"crc as ({S_CRC_TABLE}), vin as ({rows}), vword as (select {keys}, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda t: t <> '')) vw from vin), "
        f"vhash as (select vw, {s_crc32('vw')} h from (select distinct vw from vword), crc), "
        f"vsum as (select {keys}, cast(h % {dim} as integer) pos, sum(case when (h >> 16) & 1 = 1 then 1 else -1 end) s from vword join vhash using (vw) group by {keys}, h % {dim}), "
        f"vnorm as (select {keys}, sqrt(sum(s * s)) n from vsum group by {keys} having sum(s * s) > 0), "
        f"vec as (select {keys}, pos, s / n x from vsum join vnorm using ({keys}) where s <> 0 union all select {keys}, 0, 1.0 from vin a where not exists (select 1 from vnorm b where {on}))"
    )


S_ASKED = values(ASKED, "a(qid, q)")
CH = f"""chunks as (select doc_id id, coalesce(text, '') "content", source repo, lang "language", source || '/' || lang || '/doc_' || doc_id || '.txt' file_path,
 coalesce(list_extract({s_tok("text")}, 1), '') function_name, '' parent_class, list_extract(string_split(coalesce(text, ''), chr(10)), 1) signature,
 1 start_line, len(string_split(coalesce(text, ''), chr(10))) end_line from documents)"""
TOKS = f"toks as (select doc_id id, {s_tok('text')} t from documents)"
BQ = "bq as (select item_id qid, text q, text from benchmark)"


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks: the source is the repository, the first token the function's name."""
    body = text.empty(F.col("text"))
    first = F.coalesce(F.get(text.tokenize(F.col("text")), F.lit(0)), F.lit(""))
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    lines = F.split(body, "\n")
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), body.alias("content"), F.col("source").alias("repo"), F.col("lang").alias("language"), path.alias("file_path"), first.alias("function_name"),
        F.lit("").alias("parent_class"), F.element_at(lines, 1).alias("signature"), F.lit(1).alias("start_line"), F.size(lines).alias("end_line"),
    )


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(table(spark, d, "documents"))


def _tokens(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").alias("id"), text.tokenize(F.col("text")).alias("t"))


#: Stored indexes and chunk tables, and stored graphs, that this session has opened.
_stored: dict[tuple, object] = {}
#: Buckets of an index, and the version of its layout.
BUCKETS, LAYOUT = 64, 3


def kept(spark: SparkSession, d: str, name: str, kind: str, write: Callable[[str], None], load: Callable[[str], object]):
    """What `write` makes of a whole table, in the shared folder under the name of the table's state, as `load` reads it.

    The first use of a state writes it, in a folder of its own that gets the name when it is whole; later ones, of later sessions too, read it."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    at = path(f"{d}/{name}.parquet")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    state = (LAYOUT, BUCKETS, at.toString(), files.getContentSummary(at).getLength(), files.getFileStatus(at).getModificationTime())
    root = f"{shared_dir(spark)}/lodespark/{kind}-{hashlib.sha256(repr(state).encode()).hexdigest()[:24]}"
    key = (spark.sparkContext.applicationId, root)
    if key not in _stored:
        shared = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        if not shared.exists(path(root)):
            own = f"{root}-{uuid.uuid4().hex}"
            write(own)
            if shared.exists(path(root)) or not shared.rename(path(own), path(root)):  # another session was first
                shared.delete(path(own), True)
        _stored[key] = load(root)
    return _stored[key]


def stored(spark: SparkSession, d: str) -> tuple[dict, DataFrame]:
    """The sparse index and the chunk table of the whole of `documents`."""
    rows = chunks(spark, d)

    def write(root: str) -> None:
        persist_index(_tokens(portions(table(spark, d, "documents").select("doc_id", "text"), "doc_id")), root, BUCKETS)
        rows.sortWithinPartitions("id").write.parquet(f"{root}/chunks")

    return kept(spark, d, "documents", "index", write, lambda root: ({**load_index(spark, root), "buckets": BUCKETS}, spark.read.schema(rows.schema).parquet(f"{root}/chunks")))


def index(spark: SparkSession, d: str) -> dict:
    return stored(spark, d)[0]


def benchmark_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("q"), "text")


def joined(c: Column, sep: str = " ") -> Column:
    return F.array_join(c, sep)


def rounded(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits)
