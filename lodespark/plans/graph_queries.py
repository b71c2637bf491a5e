"""Graph, wiki and joins over the stand-in graph: parts that follow each other in an order call each other."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.retrieval import bounded
from ..sources import adjacency
from .catalog import BUCKETS, CH, chunks, kept, query, table
from .retrieval_queries import FUSED, ordered

CALLS = "calls as (select distinct l_partkey src, nxt dst from (select l_partkey, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) nxt from lineitem) where nxt is not null)"
_START = "(1, 7, 42)"


def calls(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst")).where("dst is not null").distinct()


def call_graph(spark, d) -> adjacency.Adjacency:
    """The stored graph of all calls."""
    rows = calls(spark, d)
    return kept(spark, d, "lineitem", "graph", lambda root: adjacency.persist_graph(rows, root, BUCKETS), lambda root: adjacency.load_graph(rows, root, BUCKETS))


def _edges(spark, d):
    return calls(spark, d).withColumn("type", F.lit("CALLS")).withColumn("line", F.lit(None).cast("int"))


def _start(spark, ids=(1, 7, 42)):
    return spark.createDataFrame([(i,) for i in ids], "id long")


# ---- build ------------------------------------------------------------------------------------------

GC = f"{CH}, gc as (select *, case when id % 3 = 0 then 'class' else 'function' end kind, case when id % 5 = 0 then 'Base' else '' end ext, case when id % 3 <> 0 and id % 7 = 0 then 'Owner' else '' end par, ['\"os\"', repo] imports, [signature[1:4], 'run', 'run'] callee from chunks)"
NODES = """nodes as (select repo || '::' || file_path id, 'File' label from gc union select file_path || '::' || function_name, case when kind = 'class' then 'Class' else 'Function' end from gc
 union select repo || '::import::' || i, 'Import' from (select repo, unnest(['os', repo]) i from gc))"""
EDGES = """edges as (select distinct repo || '::' || file_path src, file_path || '::' || function_name dst, 'DEFINES' type, null::integer line from gc
 union select file_path || '::' || par, file_path || '::' || function_name, 'CONTAINS', null from gc where par <> ''
 union select src, dst, 'CALLS', min(line) from (select file_path || '::' || function_name src, file_path || '::' || unnest(callee) dst, unnest([1, 2, 3]) line from gc where kind = 'function') group by src, dst
 union select file_path || '::' || function_name, file_path || '::' || ext, 'EXTENDS', null from gc where kind = 'class' and ext <> ''
 union select file_path || '::' || function_name, file_path || '::Iface', 'IMPLEMENTS', null from gc where kind = 'class'
 union select repo || '::' || file_path, repo || '::import::' || i, 'IMPORTS', null from (select repo, file_path, unnest(['os', repo]) i from gc))"""


def graph_chunks(spark, d):
    c = chunks(spark, d)
    names = F.array(F.substring("signature", 1, 4), F.lit("run"), F.lit("run"))
    call = F.transform(names, lambda n, i: F.struct(n.alias("name"), F.lit("").alias("qualifier"), (i + 1).alias("line")))
    return c.withColumns({
        "name": F.col("function_name"), "kind": F.when(F.col("id") % 3 == 0, "class").otherwise("function"), "extends": F.when(F.col("id") % 5 == 0, "Base").otherwise(""),
        "parent_class": F.when((F.col("id") % 3 != 0) & (F.col("id") % 7 == 0), "Owner").otherwise(""), "implements": F.array(F.lit("Iface")), "imports": F.array(F.lit('"os"'), F.col("repo")), "calls": call,
    })


@query(f"with {GC}, {EDGES} select src, dst, type, coalesce(line, -1) line from edges")
def gr_build(spark, d):
    return graph.build(graph_chunks(spark, d))[1].select("src", "dst", "type", F.coalesce("line", F.lit(-1)).alias("line"))


@query(f"with {GC}, {NODES} select id, label from nodes")
def wn_dedup_nodes(spark, d):
    return graph.build(graph_chunks(spark, d))[0].select("id", "label")


@query(f"with {GC}, {EDGES} select type, count(*) n from edges group by type")
def wn_dedup_edges(spark, d):
    return graph.build(graph_chunks(spark, d))[1].groupBy("type").agg(F.count("*").alias("n"))


@query(f"with {GC}, {NODES} select label, count(*) n from nodes group by label")
def ag_label_counts(spark, d):
    return graph.build(graph_chunks(spark, d))[0].groupBy("label").agg(F.count("*").alias("n"))


@query(f"with {GC}, {NODES}, {EDGES} select type, count(*) n from edges where src in (select id from nodes) and dst in (select id from nodes) group by type")
def jn_edge_exists(spark, d):
    nodes, edges = graph.build(graph_chunks(spark, d))
    return graph.with_both_ends(edges, nodes).groupBy("type").agg(F.count("*").alias("n"))


@query(f"with {GC}, {NODES}, {EDGES} select src, dst, type from edges where src in (select id from nodes) and dst in (select id from nodes)", name="src_edge_upsert")
def src_edge_upsert(spark, d):
    nodes, edges = graph.build(graph_chunks(spark, d))
    return graph.with_both_ends(edges, nodes).select("src", "dst", "type")


@query(f"with {GC}, {NODES}, {EDGES} select src, dst from edges where type = 'CALLS' and src in (select id from nodes where label = 'Function') and dst in (select id from nodes where label = 'Function')")
def jn_ui_edges(spark, d):
    nodes, edges = graph.build(graph_chunks(spark, d))
    return graph.with_both_ends(edges.where("type = 'CALLS'"), nodes.where("label = 'Function'")).select("src", "dst")


# ---- traversal ---------------------------------------------------------------------------------------


@query(f"with {CALLS} select distinct id, neighbor from (select src id, dst neighbor from calls where src in {_START} union select dst, src from calls where dst in {_START})")
def jn_neighbors(spark, d):
    return graph.neighbors(_edges(spark, d), _start(spark)).select("id", "neighbor")


@query(f"with {CALLS}, n as (select distinct id, neighbor from (select src id, dst neighbor from calls where src in {_START} union select dst, src from calls where dst in {_START})) select id, neighbor from n order by id, neighbor limit 50")
def gr_neighbors(spark, d):
    return call_graph(spark, d).neighbors(_start(spark)).orderBy("id", "neighbor").limit(50)


@query(f"with {CALLS} select src, dst from calls order by src, dst limit 200")
def lm_graph(spark, d):
    return calls(spark, d).orderBy("src", "dst").limit(200)


REACH = f"{CALLS}, l1 as (select distinct dst id from calls where src in {_START}), l2 as (select distinct dst id from calls where src in (select id from l1)), seen as (select id, min(level) level from (select id, 1 level from l1 union all select id, 2 from l2 union all select distinct src, 0 from calls where src in {_START}) group by id)"


@query(f"with {CALLS} select id, cast(sum(o) as bigint) callees, cast(sum(i) as bigint) callers from (select src id, 1 o, 0 i from calls union all select dst, 0, 1 from calls) group by id")
def src_graph_index(spark, d):
    """How many calls leave and enter every node of the stored graph, each counted on its own side."""
    return call_graph(spark, d).degrees()


@query(f"with {REACH} select id, level from seen")
def gr_call_graph(spark, d):
    return call_graph(spark, d).reach(_start(spark), 2)


@query(f"with {REACH} select c.src, c.dst from calls c where (c.src in (select id from seen where level = 0) and c.dst in (select id from l1)) or (c.src in (select id from l1))")
def gr_call_graph_go(spark, d):
    """Edges on the paths: out of the start and of what one step reaches."""
    c = call_graph(spark, d)
    one = c.hop(_start(spark))
    return one.unionByName(c.hop(one.select(F.col("dst").alias("id")))).distinct()


@query(f"with {REACH} select count(*) n, cast(sum(src) as bigint) s from calls where src in (select id from seen) or dst in (select id from seen)")
def gr_expand(spark, d):
    c = call_graph(spark, d)
    return c.touching(c.reach(_start(spark), 2)).agg(F.count("*").alias("n"), F.sum("src").alias("s"))


@query(f"with {GC}, {EDGES} select src, dst, type from edges where src = (select min(src) from edges) or dst = (select min(src) from edges) order by src, dst, type limit 100")
def gr_file_deps(spark, d):
    edges = graph.build(graph_chunks(spark, d))[1]
    first = edges.agg(F.min("src").alias("id"))
    return graph.touching(edges.select("src", "dst", "type"), first).orderBy("src", "dst", "type").limit(100)


@query(f"with {GC}, {EDGES} select src, dst, type from edges where type in ('DEFINES', 'IMPORTS') and starts_with(src, 'src1::')")
def gr_repo_graph_file(spark, d):
    e = graph.build(graph_chunks(spark, d))[1].where(F.startswith("src", F.lit("src1::")))
    return e.where("type = 'DEFINES'").select("src", "dst", "type").union(e.where("type = 'IMPORTS'").select("src", "dst", "type")).distinct()


@query(f"with {GC}, {EDGES} select distinct src, dst from edges where type = 'DEFINES' union select src, dst from edges where type = 'IMPORTS'")
def st_union_distinct(spark, d):
    e = graph.build(graph_chunks(spark, d))[1]
    return e.where("type = 'DEFINES'").select("src", "dst").unionByName(e.where("type = 'IMPORTS'").select("src", "dst")).distinct()


@query(f"with {GC}, {NODES}, {EDGES} select n.label, count(e.dst) rels, count(distinct n.id) nodes from nodes n left join edges e on e.src = n.id group by n.label")
def gr_repo_graph_full(spark, d):
    nodes, edges = graph.build(graph_chunks(spark, d))
    return nodes.select("id", "label").join(edges.select(F.col("src").alias("id"), "dst"), "id", "left").groupBy("label").agg(F.count("dst").alias("rels"), F.countDistinct("id").alias("nodes"))


_LAY = """fe as (select distinct o_custkey src, 1000000 + o_orderkey % 50 dst from orders union select distinct 1000000 + o_orderkey % 50, 2000000 + o_orderkey % 7 from orders),
nd as (select src id from fe union select dst from fe), l0 as (select id from nd where id not in (select dst from fe)), l1 as (select distinct dst id from fe where src in (select id from l0)), l2 as (select distinct dst id from fe where src in (select id from l1)),
lay as (select id, cast(min(l) as integer) layer from (select id, 0 l from l0 union all select id, 1 from l1 union all select id, 2 from l2) group by id)"""


def _layers(spark, d):
    o = table(spark, d, "orders")
    mid = (F.lit(1000000) + F.col("o_orderkey") % 50).cast("long")
    e = o.select(F.col("o_custkey").alias("src"), mid.alias("dst")).unionByName(o.select(mid.alias("src"), (F.lit(2000000) + F.col("o_orderkey") % 7).cast("long").alias("dst"))).distinct()
    return graph.bfs_layers(e.select(F.col("src").alias("id")).union(e.select("dst")).distinct(), e)


@query(f"with {_LAY} select id, layer from lay")
def gr_bfs_layers(spark, d):
    return _layers(spark, d).select("id", F.col("layer").cast("int").alias("layer"))


@query(f"with {_LAY} select id, cast(layer * 220 as integer) x, cast((row_number() over (partition by layer order by id) - 1) * 80 as integer) y from lay")
def gr_layout_xy(spark, d):
    return graph.layout(_layers(spark, d)).select("id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))


@query(f"with {CH}, p as (select file_path, string_split(file_path, '/') s from chunks), e as (select unnest([s[1], s[1] || '/' || s[2]]) dir from p) select dir, count(*) files from e group by dir")
def gr_dir_tree(spark, d):
    return graph.directory_tree(chunks(spark, d).select(F.col("file_path").alias("path")))


@query(f"with {CH} select id, function_name, file_path from chunks where (contains(function_name, 'er') or contains(file_path, 'src1')) and repo = 'src1' order by id limit 20")
def gr_wiki_search(spark, d):
    c = chunks(spark, d).where((F.col("repo") == "src1") & (F.contains("function_name", F.lit("er")) | F.contains("file_path", F.lit("src1"))))
    return c.select("id", "function_name", "file_path").orderBy("id").limit(20)


# ---- wiki pages ---------------------------------------------------------------------------------------


@query(f"with {CH} select file_path, count(distinct function_name) symbols from chunks group by file_path")
def ag_wiki_tree(spark, d):
    sym = F.struct(F.col("function_name").alias("name"), F.lit("Function").alias("kind"), "file_path")
    return chunks(spark, d).groupBy("file_path").agg(F.size(F.array_sort(F.collect_set(sym))).cast("long").alias("symbols")).orderBy("file_path")


@query(f"with {GC}, {EDGES} select src file, count(*) filter (type = 'DEFINES') symbols, count(*) filter (type = 'IMPORTS') imports from edges where type in ('DEFINES', 'IMPORTS') group by src")
def ag_wiki_file(spark, d):
    e = graph.build(graph_chunks(spark, d))[1].where("type in ('DEFINES', 'IMPORTS')")
    return e.groupBy(F.col("src").alias("file")).agg(F.count_if(F.col("type") == "DEFINES").alias("symbols"), F.count_if(F.col("type") == "IMPORTS").alias("imports"))


@query(f"with {CALLS} select p_partkey id, coalesce(o.n, 0) callees, coalesce(i.n, 0) callers from part left join (select src, count(*) n from calls group by src) o on o.src = p_partkey left join (select dst, count(*) n from calls group by dst) i on i.dst = p_partkey")
def ag_wiki_function(spark, d):
    return _both(spark, d)


def _both(spark, d):
    c = calls(spark, d)
    out, into = c.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("callees")), c.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return p.join(out, "id", "left").join(into, "id", "left").select("id", F.coalesce("callees", F.lit(0)).alias("callees"), F.coalesce("callers", F.lit(0)).alias("callers"))


@query(f"with {CALLS} select p_partkey id, coalesce(o.n, 0) callees, coalesce(i.n, 0) callers from part left join (select src, count(*) n from calls group by src) o on o.src = p_partkey left join (select dst, count(*) n from calls group by dst) i on i.dst = p_partkey where coalesce(o.n, 0) + coalesce(i.n, 0) > 0")
def jn_calls_both(spark, d):
    return _both(spark, d).where("callees + callers > 0")


@query(f"with {GC}, {EDGES} select src cls, count(*) filter (type = 'EXTENDS') parents, count(*) filter (type = 'IMPLEMENTS') interfaces from edges where type in ('EXTENDS', 'IMPLEMENTS') group by src")
def ag_wiki_class(spark, d):
    e = graph.build(graph_chunks(spark, d))[1].where("type in ('EXTENDS', 'IMPLEMENTS')")
    return e.groupBy(F.col("src").alias("cls")).agg(F.count_if(F.col("type") == "EXTENDS").alias("parents"), F.count_if(F.col("type") == "IMPLEMENTS").alias("interfaces"))


@query(f"with {GC}, {EDGES}, c as (select distinct src from edges where type = 'IMPLEMENTS') select c.src, coalesce(e.dst, '') parent, i.dst interface from c left join (select * from edges where type = 'EXTENDS') e using (src) left join (select * from edges where type = 'IMPLEMENTS') i on i.src = c.src")
def jn_inheritance(spark, d):
    e = graph.build(graph_chunks(spark, d))[1]
    of = lambda t, name: e.where(F.col("type") == t).select("src", F.col("dst").alias(name))
    base = of("IMPLEMENTS", "interface")
    return base.select("src").distinct().join(of("EXTENDS", "parent"), "src", "left").join(base, "src", "left").select("src", F.coalesce("parent", F.lit("")).alias("parent"), "interface")


@query("select c_custkey, coalesce(n, 0) orders from customer left join (select o_custkey, count(*) n from orders where o_orderpriority = '1-URGENT' group by o_custkey) on o_custkey = c_custkey")
def jn_optional(spark, d):
    """Each branch is counted before it is joined, so branches do not multiply."""
    n = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"))


@query(f"with {FUSED}, {CALLS}, top as (select id from ordered where rank < 20) select distinct c.id, k.dst neighbor from top c join calls k on k.src = c.id where k.dst not in (select id from top)")
def jn_graph_anti(spark, d):
    """Neighbours of the first 20 hits that are not hits themselves."""
    first, _ = bounded(ordered(spark, d, 20).select("id"))
    near = call_graph(spark, d).hop(first).select(F.col("src").alias("id"), F.col("dst").alias("neighbor"))
    return near.join(first.select(F.col("id").alias("neighbor")), "neighbor", "left_anti").select("id", "neighbor")
