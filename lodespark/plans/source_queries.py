"""Parsers over sources that Spark writes from `documents`: each line of a text becomes a declaration that holds the line in its comments and strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import parse_files
from .catalog import query, table

#: By extension: what stands before all declarations, and one declaration of line {L} and number {K}. {C}, {T} and {S} are the line made fit for a block comment, a template or raw string, and a string.
_SHAPES = {
    ".go": ("package p\n", "// {L}\nfunc F{K}(\n\ta int,\n) (string, error) {\n\ts := `{T}} {` + \"}\"\n\t/* { {C} */\n\treturn x.call{K}(s, '{'), nil\n}\n"),
    ".ts": ("", "/** {C} */\nexport class C{K} extends Base<string> {\n  run = (a: string): string => { return `${a.trim()}} {T}` + call{K}(/[}`]/g) }\n}\n"),
    ".java": ("", "/* {C} */\nclass C{K} extends Base {\n  int run(String s) { if (s == \"{S}\") { return call{K}('}'); } return 0; }\n}\n"),
}


def written(docs: DataFrame, ext: str) -> DataFrame:
    """path, content, repo: a source file for each document."""
    top, shape = _SHAPES[ext]
    fit = {"{C}": lambda s: F.replace(s, F.lit("*/"), F.lit("* /")), "{T}": lambda s: F.translate(s, "`$\\", "'S/"), "{S}": lambda s: F.translate(s, '"\\', "'/"), "{L}": lambda s: s}

    def one(line, k):
        out = F.replace(F.lit(shape), F.lit("{K}"), k.cast("string"))
        for mark, made in fit.items():
            out = F.replace(out, F.lit(mark), made(F.translate(line, "{}", "()"))) if mark in shape else out
        return out

    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    body = F.array_join(F.transform(lines, one), "")
    return docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(ext)).alias("path"), F.concat(F.lit(top), body).alias("content"), F.lit("docs").alias("repo"))


_LINES = "select doc_id, k, translate(list_extract(l, k + 1), '{}', '()') s from (select doc_id, string_split(coalesce(text, ''), chr(10)) l from documents), unnest(range(len(l))) t(k)"
_COMMENT = "replace(s, '*/', '* /')"


def _rows(spark, d, ext):
    calls = F.array_join(F.transform("calls", lambda c: F.concat_ws(".", F.nullif(c["qualifier"], F.lit("")), c["name"])), ",")
    return parse_files(written(table(spark, d, "documents"), ext)).select("file_path", "name", "kind", "parent_class", "start_line", "end_line", "docstring", "extends", calls.alias("calls"), "is_exported")


@query(f"select doc_id || '.go' file_path, 'F' || k as \"name\", 'function' kind, '' parent_class, cast(8 * k + 3 as int) start_line, cast(8 * k + 9 as int) end_line, '// ' || s docstring, '' \"extends\", 'x.call' || k calls, true is_exported from ({_LINES})")
def prs_go_tables(spark, d):
    return _rows(spark, d, ".go")


@query(
    f"select doc_id || '.ts' file_path, 'C' || k as \"name\", 'class' kind, '' parent_class, cast(4 * k + 2 as int) start_line, cast(4 * k + 4 as int) end_line, '/** ' || {_COMMENT} || ' */' docstring, 'Base' \"extends\", '' calls, true is_exported from ({_LINES}) "
    f"union all select doc_id || '.ts', 'run', 'method', 'C' || k, cast(4 * k + 3 as int), cast(4 * k + 3 as int), '', '', 'a.trim,call' || k, false from ({_LINES})"
)
def prs_ts_tables(spark, d):
    return _rows(spark, d, ".ts")


@query(
    f"select doc_id || '.java' file_path, 'C' || k as \"name\", 'class' kind, '' parent_class, cast(4 * k + 2 as int) start_line, cast(4 * k + 4 as int) end_line, '/* ' || {_COMMENT} || ' */' docstring, 'Base' \"extends\", '' calls, true is_exported from ({_LINES}) "
    f"union all select doc_id || '.java', 'run', 'method', 'C' || k, cast(4 * k + 3 as int), cast(4 * k + 3 as int), '', '', 'call' || k, true from ({_LINES})"
)
def prs_generic_tables(spark, d):
    return _rows(spark, d, ".java")
