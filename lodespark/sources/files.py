"""File sources: listing, line chunks, and language parsers as table-generating functions."""

from __future__ import annotations

import ast
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import fixed, text
from . import syntax

CHUNK = (
    "content string, signature string, docstring string, embed_text string, name string, kind string, parent_class string, file_path string, language string, repo string, extends string, "
    "start_line int, end_line int, imports array<string>, implements array<string>, calls array<struct<name:string,qualifier:string,line:int>>, decorators array<string>, is_exported boolean"
)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path, content bytes, hash of every file below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "content", F.sha1("content").alias("hash"))


def line_chunks(files: DataFrame, lines: int = fixed.CHUNK_LINES) -> DataFrame:
    """Files (path, content and other columns) as blocks of `lines` lines; skipped, binary and blank files give none."""
    name = text.basename(F.col("path"))
    rows = files.where(~text.is_skipped(F.col("path")) & ~F.contains("content", F.lit("\x00")) & (F.trim(F.regexp_replace("content", r"\s", " ")) != ""))
    parts = rows.withColumn("_l", F.split("content", "\n")).withColumn("_k", F.explode(F.sequence(F.lit(0), F.expr(f"cast((size(_l) - 1) div {lines} as int)"))))
    own = F.slice("_l", F.col("_k") * lines + 1, F.lit(lines))
    parts = parts.withColumn("content", F.array_join(own, "\n")).withColumn("name", name).withColumn("signature", name).withColumn("kind", F.lit("file"))
    parts = parts.withColumn("start_line", F.col("_k") * lines + 1).withColumn("end_line", F.least(F.size("_l"), (F.col("_k") + 1) * lines))
    return parts.withColumn("embed_text", F.concat(F.lit("file: "), "name", F.lit("\nbody: "), text.head_lines(F.col("content"), 3))).drop("_l", "_k")


# ---- parsers --------------------------------------------------------------------------------------


def _row(path: str, **own) -> dict:
    base = {"content": "", "signature": "", "docstring": "", "embed_text": "", "name": "", "kind": "file", "parent_class": "", "file_path": path, "language": "", "repo": "", "extends": "", "start_line": 1, "end_line": 1, "imports": [], "implements": [], "calls": [], "decorators": [], "is_exported": False}
    return base | own


def _dotted(node: ast.AST) -> str:
    try:
        return ast.unparse(node)
    except ValueError:
        return ""


def parse_python(path: str, code: str) -> list[dict]:
    """Functions, classes and methods (nested functions of classes), with calls, decorators, doc strings and bases."""
    tree = ast.parse(code)
    lines = code.split("\n")
    imports = [i for n in ast.walk(tree) for i in ([a.name for a in n.names] if isinstance(n, ast.Import) else [n.module or "."] if isinstance(n, ast.ImportFrom) else [])]
    out: list[dict] = []

    def visit(node: ast.AST, parent: str) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(n, ast.ClassDef)
                body = "\n".join(lines[n.lineno - 1 : n.end_lineno])
                calls = []
                if not is_class:
                    found = sorted((c for c in ast.walk(n) if isinstance(c, ast.Call)), key=lambda c: (c.lineno, c.col_offset))
                    for c in found:
                        if isinstance(c.func, ast.Attribute):
                            calls.append({"name": c.func.attr, "qualifier": _dotted(c.func.value), "line": c.lineno})
                        elif isinstance(c.func, ast.Name):
                            calls.append({"name": c.func.id, "qualifier": "", "line": c.lineno})
                head = body.split(":")[0] + ":"
                out.append(
                    _row(path, content=body, signature=head.strip(), docstring=ast.get_docstring(n) or "", name=n.name, kind="class" if is_class else "method" if parent else "function", parent_class="" if is_class else parent, language="python", extends=_dotted(n.bases[0]) if is_class and n.bases else "", start_line=n.lineno, end_line=n.end_lineno or n.lineno, imports=imports, calls=calls, decorators=[_dotted(x) for x in n.decorator_list], is_exported=not n.name.startswith("_"))
                )
                visit(n, n.name if is_class else parent)
            else:
                visit(n, parent)

    visit(tree, "")
    return out


#: Languages that share a grammar.
FAMILIES = {"javascript": "typescript", "jsx": "typescript", "tsx": "typescript", "c++": "cpp", "cc": "cpp", "h": "c", "hpp": "cpp", "cs": "csharp", "rs": "rust", "kt": "kotlin", "rb": "ruby", "ex": "elixir"}
_IMPORT = re.compile(r"from\s+['\"]([^'\"]+)['\"]|^\s*import\s+['\"]?([\w./:*-]+)|^\s*(?:use|require|#include)\s+[<\"']?([\w./:]+)", re.M)


def parse_braces(path: str, code: str, language: str) -> list[dict]:
    """Go, TypeScript and the other languages by their declarations; one chunk of the whole file where there are none."""
    family = FAMILIES.get(language, language)
    found = syntax.Grammar(code, family, jsx=path.rsplit(".", 1)[-1].lower() in ("tsx", "jsx", "js"))
    imports = found.imports() if family in ("go", "typescript") else [a or b or c for a, b, c in _IMPORT.findall(code)]
    out = []
    for f in found.found:
        first, last = found.tokens[f.first], found.tokens[f.last]
        head = code[first.start : found.tokens[f.head].start] if f.first < f.head < len(found.tokens) and f.head <= f.last else code[first.start : last.end]
        calls = [] if f.kind in ("class", "struct") else found.calls(f)
        out.append(_row(path, content=code[first.start : last.end], signature=head.strip()[:200], docstring=found.comment(f), name=f.name, kind=f.kind, parent_class=f.parent, language=language, extends=f.extends, start_line=first.line, end_line=found.last_line(f.last), imports=imports, implements=f.implements, calls=calls, is_exported=f.exported))
    if not out and code.strip():
        base = path.rsplit("/", 1)[-1]
        out.append(_row(path, content=code, signature=base, name=base, language=language, end_line=code.count("\n") + 1, imports=imports))
    return out


def parse(path: str, code: str) -> list[dict]:
    """Chunks of one file; a file that its parser rejects becomes one chunk."""
    base = path.rsplit("/", 1)[-1]
    ext = ".dockerfile" if base == "Dockerfile" else "." + base.rsplit(".", 1)[-1].lower() if "." in base else ""
    language = fixed.LANGUAGES.get(ext, ext.lstrip("."))
    try:
        rows = parse_python(path, code) if ext == ".py" else parse_braces(path, code, language)
    except (SyntaxError, ValueError, RecursionError):
        rows = []
    return rows or [_row(path, content=code, signature=base, name=base, language=language, end_line=code.count("\n") + 1)]


def parse_files(files: DataFrame) -> DataFrame:
    """Chunks of files (path, content, repo): parsed where there is a grammar, line blocks elsewhere."""
    known = text.extractor_of(F.col("path")) != "fallback"

    declared = T.StructType.fromDDL(CHUNK)
    schema = to_arrow_schema(declared)

    def run(batches):
        for b in batches:
            rows = [r | {"repo": repo or ""} for p, c, repo in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True) for r in parse(p, c or "")]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    parsed = files.where(known).select("path", "content", "repo").mapInArrow(run, CHUNK)
    rest = line_chunks(files.where(~known).select("path", "content", "repo"))
    none = {"docstring": "''", "parent_class": "''", "language": "''", "extends": "''", "imports": "array()", "implements": "array()", "calls": "array()", "decorators": "array()", "is_exported": "false", "file_path": "path"}
    kinds = {f.name: f.dataType for f in declared}
    rest = rest.select(*[F.expr(none.get(c, f"`{c}`")).cast(k).alias(c) for c, k in kinds.items()])
    return parsed.unionByName(rest)
