"""Column builders over text, paths and identifiers. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def empty(c: Column) -> Column:
    """Missing text is the empty text."""
    return F.coalesce(c, F.lit(""))


def tokenize(text: Column, punctuation: str = fixed.PUNCTUATION) -> Column:
    """Lower-case white-space tokens without punctuation at their ends."""
    cut = F.transform(F.split(F.lower(empty(text)), r"\s+"), lambda t: F.btrim(t, F.lit(punctuation)))
    return F.filter(cut, lambda t: t != "")


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def exact_tokens(text: Column) -> Column:
    """Distinct identifiers of three characters or more, in order."""
    return F.array_distinct(F.filter(found(F.lower(empty(text)), fixed.IDENTIFIER), lambda t: F.length(t) >= 3))


def any_in(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def entity_tokens(text: Column) -> Column:
    """Identifiers that look like entities, else the first five."""
    own = exact_tokens(text)
    kept = F.filter(own, lambda t: t.isin(fixed.ENTITY_ANCHORS) | F.contains(t, F.lit("_")) | F.contains(t, F.lit("/")) | t.rlike("[0-9]"))
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(own, 1, 5))


def tech_terms(text: Column) -> Column:
    terms = found(F.lower(empty(text)), fixed.IDENTIFIER)
    kept = F.filter(terms, lambda t: t.isin(fixed.TECH_ANCHORS) | t.rlike("[_/.]") | (F.length(t) >= 8))
    return F.slice(F.array_distinct(kept), 1, 6)


def ws_norm(text: Column) -> Column:
    return F.trim(F.regexp_replace(empty(text), r"\s+", " "))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Last suffix of the base name, lower case, with its dot."""
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]*)$", 1))


def language_of(ext: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in fixed.LANGUAGES.items() for x in pair])
    return F.coalesce(F.element_at(table, ext), F.regexp_replace(ext, r"^\.", ""))


def extractor_of(path: Column) -> Column:
    """Which extractor parses a file: its own, the generic one, or the line fallback."""
    ext = F.when(basename(path) == "Dockerfile", ".dockerfile").otherwise(extension(path))
    own = F.create_map(*[F.lit(x) for pair in fixed.EXTRACTORS.items() for x in pair])
    return F.coalesce(F.element_at(own, ext), F.when(ext.isin(list(fixed.LANGUAGES)), "generic").otherwise("fallback"))


def component(path: Column) -> Column:
    """The first two directory segments."""
    clean = F.regexp_replace(F.replace(empty(path), F.lit("\\"), F.lit("/")), "^/+|/+$", "")
    return F.array_join(F.slice(F.split(clean, "/"), 1, 2), "/")


def sanitize(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9._-]", "_")


def repo_name(url: Column) -> Column:
    return F.replace(F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1), F.lit(".git"), F.lit(""))


def chunk_id(path: Column, name: Column, start: Column, end: Column, parent: Column) -> Column:
    h = F.sha1(F.concat(path, F.lit("::"), name, F.lit("::"), start.cast("string"), F.lit(":"), end.cast("string"), F.lit("::"), parent))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def chunk_key(repo: Column, path: Column, start: Column, end: Column) -> Column:
    return F.concat_ws("|", empty(repo), empty(path), start.cast("string"), end.cast("string"))


def preview(content: Column) -> Column:
    """The first eight lines that are not blank, trimmed, joined by a space."""
    lines = F.filter(F.transform(F.split(empty(content), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.array_join(F.slice(lines, 1, 8), " ")


def head_lines(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), 1, n), " ")


def line_slice(text: Column, start: Column, end: Column) -> Column:
    lines = F.split(empty(text), "\n")
    first = F.greatest(start, F.lit(1))
    return F.array_join(F.slice(lines, first, F.greatest(F.least(end, F.size(lines)) - first + 1, F.lit(0))), "\n")


def strip_doc(doc: Column) -> Column:
    """Doc-string and comment marks off both ends, each kind once, in a fixed order."""
    out = F.regexp_replace(empty(doc), r"^\s+|\s+$", "")
    for mark in ('^"""', "^'''", '"""$', "'''$", r"^/\*", r"\*/$", "^//", "^#"):
        out = F.regexp_replace(out, mark, "")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def embed_text(kind: Column, name: Column, signature: Column, path: Column, parent: Column, imports: Column, doc: Column, content: Column) -> Column:
    """Labelled lines by kind of chunk; absent parts are left out."""
    has = lambda label, c: F.when(c != "", F.concat(F.lit(f"{label}: "), c))
    head = F.when(kind.isin("function", "method"), F.concat(F.lit("func: "), name)).otherwise(F.concat(kind, F.lit(": "), name))
    sig = F.when(~kind.isin("class", "struct"), F.concat(F.lit("signature: "), signature))
    docs = F.when(doc != "", F.concat(F.lit("docs: "), strip_doc(doc)))
    return F.concat_ws("\n", head, sig, has("file", path), has("class", parent), has("imports", F.array_join(imports, " ")), docs, has("body", preview(content)))


def signature(code: Column, family: str) -> Column:
    """Text before the body: `{` (go), the first `:` (python), `=>` or `{` (typescript), or the first of three marks, else 200 characters."""
    before = lambda mark: F.trim(F.substring_index(code, mark, 1))
    if family == "go":
        return before("{")
    if family == "python":
        return F.when(F.contains(code, F.lit(":")), F.concat(before(":"), F.lit(":"))).otherwise(F.trim(code))
    brace, arrow = F.instr(code, "{"), F.instr(code, "=>")
    if family == "typescript":
        return F.when((arrow > 0) & ((brace == 0) | (arrow < brace)), before("=>")).otherwise(before("{"))
    thin = F.instr(code, "->")
    return F.when(brace > 0, before("{")).when(thin > 0, before("->")).when(arrow > 0, before("=>")).otherwise(F.trim(F.substring(code, 1, 200)))


def import_clean(text: Column) -> Column:
    """Without one quote at each end."""
    return F.regexp_replace(F.regexp_replace(empty(text), '^"', ""), '"$', "")


def middle_cut(text: Column, most: int = 4096, head: int = 3072, tail: int = 1024) -> Column:
    mark = F.lit("\n...TRUNCATED...\n")
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, head), mark, F.right(text, F.lit(tail)))).otherwise(text)


def tail_cut(text: Column, most: int = fixed.MAX_CHUNK_CHARS) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n... (truncated)"))).otherwise(text)


def is_binary(content: Column) -> Column:
    """Empty, or a zero byte among the first 8192."""
    head = F.hex(F.substring(content, 1, 8192))
    return (F.octet_length(content) == 0) | head.rlike("^(..)*00")


def is_skipped(path: Column) -> Column:
    return extension(path).isin(fixed.SKIPPED) | basename(path).isin(fixed.SKIPPED)


def title(first_user_text: Column, most: int = 50, cut: int = 50) -> Column:
    return F.when(F.length(first_user_text) > most, F.concat(F.substring(first_user_text, 1, cut), F.lit("..."))).otherwise(first_user_text)


def cache_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *parts))


def json_array(text: Column) -> Column:
    """A JSON array of strings; else the first bracketed part as one; else the first three cleaned lines."""
    kind = "array<string>"
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: (F.trim(x) != "") & ~F.startswith(F.trim(x), F.lit("```"))), lambda x: F.btrim(F.btrim(F.trim(x), F.lit('"')), F.lit("'")))
    whole = F.from_json(F.when(F.trim(text).startswith("["), text), kind)
    return F.coalesce(whole, F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\[.*?\]", 0), F.lit("")), kind), F.slice(F.filter(lines, lambda x: x != ""), 1, 3))
