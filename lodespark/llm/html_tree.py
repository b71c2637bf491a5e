"""Main-text extraction with a site style tree.

Pages are parsed into blocks (runs of text of one block-level element) with their paths of tags and classes. The DOMs of all
distinct pages of a host (near copies count once) are merged by path: an element node of the tree is a (host, path), with the pages that have it,
the child sequences (presentation styles) it takes and the contents of its blocks. A node's importance is high where styles
or contents differ between pages and low where they repeat:

  node importance     entropy of its styles, in base m, over its m pages (1 where m = 1)
  content importance  mean over its distinct contents of 1 - log(c) / log(m), c the pages that show the content there
  branch importance   (1 - GAMMA) x node importance + GAMMA x mean content importance of the blocks below it

A block weighs as much as its branch is important (the least importance of the nodes on its path), times a prior: 1 inside an article or main
element and on pages without one, OUTSIDE elsewhere, 0 where the page's own markup says menu, header, footer, sidebar, notice, advert,
form or reader comment. Blocks of weight LEAST or more are the main text, but for contents that stand on nearly all pages of their host.
So on a host that its tree knows, a template inside an article goes, and text beside the article stays if it differs from page to page. Branches
on fewer than MIN_PAGES pages have the importance UNKNOWN, so that there the article element decides. An article or main of which nothing would be left stays as
it is.

What the markup says of a part can be said of a wrapper: `content-with-sidebar`, or a form around the whole page. So inline elements have no marks by class,
a mark after `with` or `has` is none, and where all articles of a page (or main elements, or blocks, if it has none) lie in marked
elements and say more than what is unmarked, the marks on the way to the largest of those that are marked least do not count. Hidden elements and aside, nav or
footer elements stay marked. Elements nested deeper than DEPTH share their ancestor's path at that depth, so that a page costs its length.

Counts run per (host, path, content), pre-aggregated, so a host with a third of all pages is no single group. What the trees say of a path or
content, where it differs from UNKNOWN's outcome, goes to all tasks up to BROADCAST_ENTRIES entries; more is joined by (host, path) and (host, content).

Defined results: null or empty html gives an empty text; a null url is a host of its own name (""). Other columns, whatever their names, travel
as one struct. Rows are kept one for one.
"""

from __future__ import annotations

import hashlib
import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, extended

GAMMA, LEAST, MIN_PAGES = 0.9, 0.3, 4
#: The prior of text beside a page's article or main, and the importance of a branch that too few pages show.
OUTSIDE, UNKNOWN = 0.4, 0.5
#: A content on this share of a host's pages (of 10 at least) is part of the template wherever it stands.
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.9, 10
#: Pages of a host are near copies if their blocks of this many words are equal and hold this share of their text.
COPY_WORDS, COPY_SHARE = 10, 0.9
#: Elements nested deeper than this count as their ancestor at this depth.
DEPTH = 64
#: What the trees of all hosts say of up to this many paths and contents is broadcast; more is joined.
BROADCAST_ENTRIES = 200_000

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Text up to the end tag, whatever tags it seems to hold; the rest of the page where there is none.
RAW = frozenset("script style textarea title".split())
#: Elements without text of the page. One that is not closed ends with its parent; head also ends where what it cannot hold begins.
GONE = frozenset("noscript template iframe object svg math canvas audio video head select".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: A block ends these, unless one of FOREIGN is nearer.
NO_BLOCKS, FOREIGN = frozenset("svg math select".split()), frozenset("foreignobject annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIMITS = {"li": {"ul", "ol", "menu", "dir"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
#: What stands in these ends nothing outside.
SCOPES = frozenset("noscript template object".split())
#: Elements, roles and words of class or id that mark what is not the article.
ASIDE = frozenset("nav footer aside form menu dialog button label fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner banners sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert disclaimer "
    "menu menus nav navbar navigation breadcrumb breadcrumbs toc pagination pager sidebar sidebars side aside rail widget widgets footer foot masthead topbar toolbar "
    "comment comments commentlist respond reply replies disqus discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login search searchbox popup modal overlay skip".split()
)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^\"'>]|\"[^\"]*+\"|'[^']*+')*+)>|(?P<text>[^<]++|<)", re.S)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


#: Words before a mark that say the element has such a part, not that it is one.
HAVING = frozenset("with has have no without".split())
#: Marks of this order cannot be taken back: what is hidden, and parts that HTML itself names.
FIRM = 1 << 20


def _named(names: str) -> bool:
    """Whether a word of a class or id is a mark."""
    for name in names.split():
        found = _PART.findall(re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name).lower())
        if any(w in MARKS and not (i and found[i - 1] in HAVING) for i, w in enumerate(found)):
            return True
    return False


def _marked(tag: str, attrs: dict[str, str], inside_main: bool) -> int:
    """0, 1 for a mark that may turn out to be a wrapper's, FIRM. Inline elements have no marks by class: they are words of a sentence."""
    if attrs and ("hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in ROLES or _HIDDEN.search(attrs.get("style", ""))):
        return FIRM
    if tag in ASIDE:
        return 1 if tag in ("form", "fieldset") else FIRM
    if tag == "header" and not inside_main:
        return 1
    if not attrs or tag in ("body", "html", "main") or tag not in BLOCK:
        return 0
    return int(_named(f"{attrs.get('class', '')} {attrs.get('id', '')}"))


class _Marks:
    """Marked elements on the way to a block, as numbers: ways that go through the same marked paths have one number. 0 has none."""

    def __init__(self):
        self.up, self.order, self.known = [0], [0], {}

    def below(self, way: int, path: str, order: int) -> int:
        if (way, path, order) not in self.known:
            self.known[way, path, order] = len(self.up)
            self.up.append(way)
            self.order.append(self.order[way] + order)
        return self.known[way, path, order]

    def wrappers(self, blocks: list[tuple[str, str, int, bool, bool]]) -> set[int]:
        """The ways whose marks are a wrapper's: those to a page's articles, if none is free of marks and they say more than all that is.

        Without an article, the main element, and without that all blocks count. Of several ways those with fewest marks count, then that to most text."""
        said: dict[int, int] = {}
        own = [b for b in blocks if b[4]] or [b for b in blocks if b[3]] or blocks
        for b in own:
            said[b[2]] = said.get(b[2], 0) + len(b[1])
        if not said or 0 in said:
            return set()
        way = min(said, key=lambda k: (self.order[k], -said[k]))
        if self.order[way] >= FIRM or said[way] <= sum(len(b[1]) for b in blocks if not b[2]):
            return set()
        out = set()
        while way:
            out.add(way)
            way = self.up[way]
        return out


class _Open:
    """The open elements: (tag, path, way of marks, in main, in article, gone, depth), and how many there are of each tag."""

    def __init__(self):
        self.stack: list[tuple[str, str, int, bool, bool, bool, int]] = []
        self.many: dict[str, int] = {}

    def top(self) -> tuple[str, str, int, bool, bool, bool, int]:
        return self.stack[-1] if self.stack else ("", "", 0, False, False, False, 0)

    def push(self, *element) -> None:
        self.stack.append(element)
        self.many[element[0]] = self.many.get(element[0], 0) + 1

    def pop(self) -> str:
        tag = self.stack.pop()[0]
        self.many[tag] -= 1
        return tag

    def has(self, tags) -> bool:
        return any(self.many.get(t) for t in tags)


def parse(page: str | None):
    """Blocks (path, text, marked, in article or main), and the child tags of each path. Elements deeper than DEPTH have the path of the one at that depth."""
    blocks: list[tuple[str, str, int, bool, bool]] = []
    styles: dict[str, dict[str, None]] = {}
    marks, tree = _Marks(), _Open()
    held: dict[int, list[str]] = {}
    page = page or ""
    at, end = 0, len(page)

    def flush() -> None:
        _, path, _, main, article, _, _ = tree.top()
        for way in sorted(held, key=lambda k: marks.order[k]):
            text = " ".join("".join(held[way]).split())
            if text:
                blocks.append((path, text, way, main, article))
        held.clear()

    def close(tags, limits) -> None:
        """Ends the innermost of `tags` unless one of `limits` is nearer."""
        if not tree.has(tags):
            return
        for k in range(len(tree.stack) - 1, -1, -1):
            if tree.stack[k][0] in tags:
                leave(k)
                return
            if tree.stack[k][0] in limits:
                return

    def leave(k: int) -> None:
        while len(tree.stack) > k:
            if tree.stack[-1][0] in BLOCK and not tree.stack[-1][5]:
                flush()
            tree.pop()

    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end() if m else at + 1
        if not m:
            continue
        if m["text"] is not None or m["cdata"] is not None:
            said = _html.unescape(m["text"] or m["cdata"] or "")
            if tree.top()[0] == "head" and said.strip():
                tree.pop()
            if not tree.top()[5]:
                held.setdefault(tree.top()[2], []).append(said)
            continue
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            if tree.many.get(tag):
                leave(next(k for k in range(len(tree.stack) - 1, -1, -1) if tree.stack[k][0] == tag))
            continue
        whole = m["attrs"].rstrip().endswith("/")
        if tag in RAW and not whole:
            stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if tag == "body":
            close({"head"}, ())
        elif tree.top()[0] == "head" and tag not in IN_HEAD:
            tree.pop()
        if tag in BLOCK and tag != "hr":
            close(NO_BLOCKS, FOREIGN)
        if tree.top()[5] and tag in CLOSES:
            close(CLOSES[tag], LIMITS[tag] | SCOPES)
        if tag in GONE or tree.top()[5]:
            if not whole and tag not in VOID:
                tree.push(tag, *tree.top()[1:5], True, tree.top()[6])
            continue
        if tag == "br":
            held.setdefault(tree.top()[2], []).append(" ")
            continue
        if tag in ENDS_P:
            close({"p"}, {"td", "th", "li", "div", "section", "article", "body"})
        if tag in CLOSES:
            close(CLOSES[tag], LIMITS[tag])
        if tag in BLOCK:
            flush()
        if tag in VOID:
            continue
        attrs = {a[1].lower(): _html.unescape(a[2] or a[3] or a[4] or "") for a in _ATTR.finditer(m["attrs"])} if m["attrs"].strip() else {}
        _, path, way, main, article, _, depth = tree.top()
        body = tag == "article" or attrs.get("itemprop", "").lower() == "articlebody"
        main = main or body or tag == "main" or attrs.get("role", "").lower() == "main"
        order = _marked(tag, attrs, main)
        if tag in BLOCK:
            name = ".".join([tag, *sorted(set(re.sub(r"\d+", "", attrs.get("class", "")).split()))])
            styles.setdefault(path, {})[name] = None
            depth += 1
            if depth <= DEPTH:
                path = f"{path}/{name}"
        if order:
            way = marks.below(way, path, order)
        tree.push(tag, path, way, main, article or body, False, depth)
    flush()
    wrapper = marks.wrappers(blocks)
    return [(p, t, bool(way) and way not in wrapper, main) for p, t, way, main, _ in blocks], {p: "|".join(c) for p, c in styles.items()}


def copy_key(blocks) -> int | None:
    """The same for near copies: a hash of what a page's article or main (or else all it does not mark) says in long blocks, or in all if those do not make up nearly all of it."""
    own = [b for b in blocks if not b[2]]
    said = [b[1] for b in own if b[3]] or [b[1] for b in own]
    long = [t for t in said if t.count(" ") + 1 >= COPY_WORDS]
    if sum(map(len, long)) >= COPY_SHARE * sum(map(len, said)):
        said = long
    return _hash("\n".join(said)) if said else None


_BLOCK = [("path", pa.string()), ("text", pa.string()), ("marked", pa.bool_()), ("main", pa.bool_())]
_PARSED = "row long, host string, page_hash long, copy long, blocks array<struct<path:string,text:string,marked:boolean,main:boolean>>, styles array<struct<path:string,style:string>>"


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def parse_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns of `pages` but html as the struct `page`, with row (a number of the page), host, page_hash, copy, blocks and styles."""
    others = [F.col(f"`{c}`") for c in pages.columns if c != html]
    host = F.lower(F.coalesce(F.expr("regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)', 1)"), F.lit("")))
    rows = pages.select(F.struct(*others).alias("page"), F.col(f"`{html}`").alias("html"), host.alias("host"), F.xxhash64(html).alias("page_hash"))
    style = pa.list_(pa.struct([("path", pa.string()), ("style", pa.string())]))

    def run(batches):
        from pyspark import TaskContext

        nth = TaskContext.get().partitionId() << 40
        for b in batches:
            for a in range(0, b.num_rows, 128):
                part = b.slice(a, 128)
                found = [parse(t) for t in part.column("html").to_pylist()]
                blocks = [[dict(zip(("path", "text", "marked", "main"), x, strict=True)) for x in f[0]] for f in found]
                cols = [part.column("page"), pa.array(range(nth, nth + part.num_rows), pa.int64()), part.column("host"), part.column("page_hash"), pa.array([copy_key(f[0]) for f in found], pa.int64())]
                cols += [pa.array(blocks, pa.list_(pa.struct(_BLOCK))), pa.array([[{"path": p, "style": s} for p, s in f[1].items()] for f in found], style)]
                nth += part.num_rows
                yield pa.RecordBatch.from_arrays(cols, names=["page", "row", "host", "page_hash", "copy", "blocks", "styles"])

    return rows.mapInArrow(run, extended(rows, _PARSED, ["page"]))


def distinct_pages(parsed: DataFrame) -> DataFrame:
    """host, copy, p: the distinct (path, content) and the styles of one page of each group of near copies."""
    if "p" in parsed.columns:
        return parsed
    hashed = F.array_distinct(F.transform("blocks", lambda b: F.struct(b["path"].alias("path"), F.xxhash64(b["text"]).alias("content"))))
    one = parsed.select("host", "page_hash", F.coalesce("copy", "page_hash").alias("copy"), F.struct(hashed.alias("blocks"), "styles").alias("p"))
    return one.groupBy("host", "copy").agg(F.min_by("p", "page_hash").alias("p"))


def style_tree(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, path, importance, m) of the merged trees' nodes, and (host, content) that stands on nearly all pages of a host; of parsed or distinct pages."""
    one = distinct_pages(parsed)
    content = one.select("host", F.explode("p.blocks").alias("b")).select("host", "b.path", "b.content")
    shown = content.groupBy("host", "path", "content").agg(F.count("*").alias("c"))
    held = one.select("host", F.explode(F.array_distinct("p.blocks.path")).alias("path")).groupBy("host", "path").agg(F.count("*").alias("m"))
    # the mean of 1 - log(c) / log(m) over a path's contents, from sums, so that a frequent path is one row before the join
    sums = shown.groupBy("host", "path").agg(F.sum(F.log("c")).alias("logs"), F.count("*").alias("n"))
    spread = F.when(F.col("m") > 1, 1 - F.col("logs") / (F.col("n") * F.log("m"))).otherwise(1.0)
    leaf = sums.join(held, ["host", "path"]).select("host", "path", spread.alias("content"), "n")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    below = leaf.where("path <> ''").select("host", F.explode(above).alias("path"), (F.col("content") * F.col("n")).alias("s"), "n")
    below = below.groupBy("host", "path").agg((F.sum("s") / F.sum("n")).alias("below"))
    styles = one.select("host", F.explode("p.styles").alias("s")).select("host", "s.path", "s.style").groupBy("host", "path", "style").agg(F.count("*").alias("k"))
    total = styles.groupBy("host", "path").agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.log("k")).alias("klogk"))
    node = total.select("host", "path", "m", F.when(F.col("m") > 1, (F.log("m") - F.col("klogk") / F.col("m")) / F.log("m")).otherwise(1.0).alias("node"))
    pages = held.select("host", "path", F.col("m").alias("held"))
    tree = below.join(node, ["host", "path"], "left").join(pages, ["host", "path"], "left")
    tree = tree.select("host", "path", ((1 - GAMMA) * F.coalesce("node", "below") + GAMMA * F.col("below")).alias("importance"), F.greatest(F.coalesce("m", F.lit(0)), F.coalesce("held", F.lit(0))).alias("m"))
    size = one.groupBy("host").agg(F.count("*").alias("pages"))
    everywhere = shown.groupBy("host", "content").agg(F.max("c").alias("c")).join(size.where(F.col("pages") >= TEMPLATE_PAGES), "host").where(F.col("c") >= TEMPLATE_SHARE * F.col("pages")).select("host", "content")
    return tree, everywhere


def branches(tree: DataFrame) -> DataFrame:
    """(host, path, floor): the least importance of the nodes on the way to each path, of those that MIN_PAGES pages or more show."""
    known = tree.where(F.col("m") >= MIN_PAGES).select("host", F.col("path").alias("node"), "importance")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    ways = tree.where("path <> ''").select("host", "path", F.explode(above).alias("node"))
    return ways.join(known, ["host", "node"]).groupBy("host", "path").agg(F.min("importance").alias("floor"))


def main_text(blocks: list[dict], contents: list[int], floors: dict[str, float], common) -> str:
    """The text of a page: floors has its paths' importance where that is known, `common` the contents that are the host's template."""
    own = [{**b, "content": c} for b, c in zip(blocks, contents, strict=True) if not b["marked"]]
    declared = any(b["main"] for b in own)
    kept = [floors.get(b["path"], UNKNOWN) * (1.0 if b["main"] or not declared else OUTSIDE) >= LEAST and b["content"] not in common for b in own]
    whole = declared and not any(k for b, k in zip(own, kept, strict=True) if b["main"])  # nothing of the article would be left
    return "\n\n".join(b["text"] for b, k in zip(own, kept, strict=True) if k or (whole and b["main"]))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """The columns of `pages` but html, with text: the main text, blocks joined by two line feeds."""
    spark = pages.sparkSession
    with Scratch(spark) as own:
        parsed = own.result(parse_pages(pages, html), "parsed")
        tree, everywhere = style_tree(own.keep(distinct_pages(parsed), "distinct"))
        floors = own.result(branches(tree).where((F.col("floor") < LEAST) | (F.col("floor") >= LEAST / OUTSIDE)), "branches")
        everywhere = own.result(everywhere, "everywhere")
    contents = F.transform("blocks", lambda b: F.xxhash64(b["text"])).alias("contents")
    out = [c for c in pages.columns if c not in (html, "text")]
    if floors.count() + everywhere.count() <= BROADCAST_ENTRIES:
        held: dict[str, tuple[dict[str, float], set[int]]] = {}
        for r in floors.toLocalIterator():
            held.setdefault(r.host, ({}, set()))[0][r.path] = r.floor
        for r in everywhere.toLocalIterator():
            held.setdefault(r.host, ({}, set()))[1].add(r.content)
        own = spark.sparkContext.broadcast(held)

        def known(b: pa.RecordBatch):
            return [own.value.get(h, ({}, ())) for h in b.column("host").to_pylist()]

        rows = parsed.select("page", "blocks", contents, "host")
    else:
        paths = parsed.select("row", "host", F.explode(F.array_distinct(F.col("blocks.path"))).alias("path")).join(floors, ["host", "path"]).groupBy("row").agg(F.collect_list(F.struct("path", "floor")).alias("floors"))
        templates = parsed.select("row", "host", F.explode(F.array_distinct(contents)).alias("content")).join(everywhere, ["host", "content"], "left_semi").groupBy("row").agg(F.collect_list("content").alias("common"))

        def known(b: pa.RecordBatch):
            return [({x["path"]: x["floor"] for x in f or ()}, set(c or ())) for f, c in zip(b.column("floors").to_pylist(), b.column("common").to_pylist(), strict=True)]

        rows = parsed.join(paths, "row", "left").join(templates, "row", "left").select("page", "blocks", contents, "floors", "common")

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 128):
                part = b.slice(a, 128)
                texts = [main_text(x, c, *k) for x, c, k in zip(part.column("blocks").to_pylist(), part.column("contents").to_pylist(), known(part), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("page"), pa.array(texts, pa.string())], names=["page", "text"])

    return rows.mapInArrow(run, extended(rows, "text string", ["page"])).select(*(F.col(f"page.`{c}`").alias(c) for c in out), "text")
