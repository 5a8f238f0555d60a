"""Queries over the call graph and the activation forest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forest, graph, ledger
from .adapters import EDGE_CUT, act, bnd, call, edge, io, r, some, stop, views
from .catalogue import query, whole


def _edges(spark, sf, whole=False):
    return edge(spark, sf, whole).select(F.col("caller").alias("src"), F.col("callee").alias("dst"), "edge_ord", "by_name", "attempts")


@query(views("edge", "bnd", recursive=True) + ", r AS (SELECT function AS node FROM bnd WHERE category IN ('net', 'db') UNION SELECT caller FROM edge JOIN r ON callee = node) SELECT node FROM r")
def io_reach(spark, sf, whole=False):
    """graph.io_reach, graph.edges"""
    start = bnd(spark, sf).where("category IN ('net', 'db')").select(F.col("function").alias("node"))
    return graph.reach(start, _edges(spark, sf, whole))


def _roots_sql(view: str, targets: str, entry: str, most: int) -> str:
    """Roots by a walk of at most `most` calls, which the graphs here do not need."""
    return (
        views(*view.split(), recursive=True)
        + f""", e AS (SELECT DISTINCT caller, callee FROM {view.split()[0]}), w AS ({targets}), r AS (SELECT target, target AS node, 0 AS d FROM w UNION SELECT target, caller, d + 1 FROM e JOIN r ON callee = node WHERE d < {most}),
n AS (SELECT target, node, min(d) AS d FROM r WHERE node <> target AND node NOT IN (SELECT callee FROM e) GROUP BY ALL),
o AS (SELECT target, node AS root, row_number() OVER (PARTITION BY target ORDER BY NOT ({entry}), d, node) - 1 AS place FROM n) SELECT target, root, CAST(place AS INTEGER) AS place FROM o WHERE place < 5"""
    )


@query(_roots_sql("edge bnd", "SELECT DISTINCT function AS target FROM bnd", "node % 11 = 0", 60).replace(f"{EDGE_CUT} AND ", ""))
def roots(spark, sf):
    """graph.roots, topk.roots5 over all edges between suppliers: entries first, then by hops"""
    t = bnd(spark, sf).select(F.col("function").alias("node"))
    return graph.roots(_edges(spark, sf, whole=True).withColumn("src_entry", F.col("src") % 11 == 0), t)


@query(_roots_sql("call stop", "SELECT node AS target FROM stop", "node % 11 = 0", 14))
def roots_whole(spark, sf):
    """graph.roots, topk.roots5 over all consecutive lines: entries first, then by hops"""
    e = call(spark, sf).select(F.col("caller").alias("src"), F.col("callee").alias("dst"), (F.col("caller") % 11 == 0).alias("src_entry"))
    return graph.roots(e, stop(spark, sf))


_WAYS = """, sync AS (SELECT caller, callee, line FROM call WHERE caller % 3 <> 0 AND callee % 3 <> 0 AND NOT offloaded),
lv AS (SELECT node, 0 AS d FROM stop WHERE node % 3 <> 0 UNION SELECT caller, d + 1 FROM sync JOIN lv ON callee = node WHERE d < 20), m AS (SELECT node, min(d) AS d FROM lv GROUP BY node),
bv AS (SELECT a.node, CASE WHEN a.d = 0 THEN NULL ELSE (SELECT arg_min(callee, (line, callee)) FROM sync JOIN m b ON b.node = callee WHERE caller = a.node AND b.d = a.d - 1) END AS via FROM m a),
ac AS (SELECT caller, callee, line FROM call WHERE caller % 3 = 0 AND NOT offloaded),
z AS (SELECT node, line, 0 AS k, CAST(NULL AS BIGINT) AS via FROM stop WHERE node % 3 = 0 UNION ALL SELECT caller, line, 1, callee FROM ac JOIN bv ON node = callee),
al AS (SELECT DISTINCT node, 0 AS d FROM z UNION SELECT caller, d + 1 FROM ac JOIN al ON callee = node WHERE d < 20), ar AS (SELECT node, min(d) AS d FROM al GROUP BY node),
aw AS (SELECT node, arg_min({'v': via}, (line, k, coalesce(via, 0))).v AS via FROM z GROUP BY node
  UNION ALL SELECT a.node, arg_min(callee, (line, callee)) FROM ar a JOIN ac ON caller = a.node JOIN ar b ON b.node = callee AND b.d < a.d WHERE a.d > 0 GROUP BY a.node),
tree AS (SELECT node, via FROM aw UNION ALL SELECT node, via FROM bv),
p AS (SELECT node, via AS last, CAST(node AS VARCHAR) AS path FROM tree UNION ALL SELECT p.node, tree.via, path || '>' || CAST(tree.node AS VARCHAR) FROM p JOIN tree ON p.last = tree.node),
way AS (SELECT node, path FROM p WHERE last IS NULL)"""


def _ways(spark, sf):
    """(functions, calls, ways of the synchronous functions that block, ways of the asynchronous ones) over all consecutive lines."""
    e = graph.cut(call(spark, sf).select(F.col("caller").alias("src"), F.col("callee").alias("dst"), "line", "offloaded"))
    functions = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).unionByName(stop(spark, sf).select("node")).distinct().withColumn("is_async", F.col("node") % 3 == 0)
    held = e.where("NOT offloaded").select("src", "dst", "line")
    start = stop(spark, sf).where("node % 3 <> 0").select("node", F.lit(0).alias("rank"), F.lit(None).cast("long").alias("via"), F.lit(None).cast("long").alias("edge_ord"))
    blocks = graph.improve(start, held.where("src % 3 <> 0 AND dst % 3 <> 0").withColumnRenamed("line", "edge_ord"), lambda rank, _: rank + 1).select("node", "via")
    return functions, e, blocks, graph.async_blocks(functions, stop(spark, sf), held, blocks)


@query(views("call", "stop", recursive=True) + _WAYS + " SELECT node, path FROM way WHERE node % 3 = 0")
def async_ways(spark, sf):
    """graph.async_blocks: asynchronous functions that block, with the way"""
    *_, ways = _ways(spark, sf)
    return ways.select("node", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(views("call", "stop", recursive=True) + _WAYS + " SELECT caller, callee, CASE WHEN NOT offloaded THEN path END AS path FROM call LEFT JOIN way ON node = callee")
def preempt_ways(spark, sf):
    """graph.cannot_preempt: every call with the way by which no deadline can end it"""
    functions, e, blocks, ways = _ways(spark, sf)
    found = graph.cannot_preempt(e, functions, blocks, ways)
    return found.select(F.col("src").alias("caller"), F.col("dst").alias("callee"), F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(views("edge", recursive=True) + ", c AS (SELECT caller AS s, callee AS d FROM edge UNION SELECT s, callee FROM c JOIN edge ON d = caller) SELECT a.s AS node, least(min(a.d), a.s) AS component FROM c a JOIN c b ON a.s = b.d AND a.d = b.s GROUP BY a.s")
def scc(spark, sf, whole=False):
    """graph.scc, rule recursion"""
    return graph.components(_edges(spark, sf, whole))


_RANK = "CASE category WHEN 'net' THEN 0 WHEN 'db' THEN 0 WHEN 'sleep' THEN 0 ELSE 1 END"


@query(
    views("edge", "bnd", recursive=True)
    + f""", s1 AS (SELECT function AS node, {_RANK} AS rank FROM bnd UNION SELECT caller, rank FROM edge JOIN s1 ON callee = node WHERE by_name = 0),
a AS (SELECT node, min(rank) AS rank FROM s1 GROUP BY node), s2 AS (SELECT node, rank FROM a UNION SELECT caller, CASE WHEN by_name = 1 THEN least(rank + 1, 2) ELSE rank END FROM edge JOIN s2 ON callee = node)
SELECT node, CASE min(rank) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity FROM s2 GROUP BY node"""
)
def blocks_stratified(spark, sf, whole=False):
    """graph.blocks: certain edges first, then edges by name with a downgrade"""
    e = _edges(spark, sf, whole)
    rank = F.when(F.col("category").isin("net", "db", "sleep"), 0).otherwise(1)
    start = bnd(spark, sf).groupBy(F.col("function").alias("node")).agg(F.min(rank).alias("rank")).select("node", "rank", F.lit(None).cast("long").alias("via"), F.lit(None).cast("long").alias("edge_ord"))
    first = graph.improve(start, e.where("by_name = 0"))
    second = graph.improve(first, e, lambda rk, _: F.when(F.col("by_name") == 1, F.least(rk + 1, F.lit(2))).otherwise(rk))
    return second.select("node", F.when(F.col("rank") == 0, "high").when(F.col("rank") == 1, "medium").otherwise("low").alias("severity"))


@query(
    views("edge", "bnd", recursive=True)
    + """, lv AS (SELECT function AS node, 0 AS d FROM bnd UNION SELECT caller, d + 1 FROM edge JOIN lv ON callee = node WHERE d < 12), m AS (SELECT node, min(d) AS d FROM lv GROUP BY node),
w AS (SELECT caller AS node, callee AS via, row_number() OVER (PARTITION BY caller ORDER BY edge_ord, callee) AS i FROM edge JOIN m a ON a.node = caller JOIN m b ON b.node = callee AND b.d = a.d - 1),
p AS (SELECT node, node AS last, 1 AS len FROM m WHERE d <= 6 UNION ALL SELECT p.node, via, len + 1 FROM p JOIN w ON w.node = p.last AND i = 1) SELECT node, CAST(max(len) AS INTEGER) AS hops, arg_max(last, len) AS boundary FROM p GROUP BY node"""
)
def block_path(spark, sf, whole=False):
    """graph.block_path, graph.io_chain: shortest witness chains to a boundary; of at most six calls as the twin has it, or of any length"""
    e = _edges(spark, sf, whole)
    start = bnd(spark, sf).select(F.col("function").alias("node")).distinct().select("node", F.lit(0).alias("rank"), F.lit(None).cast("long").alias("via"), F.lit(None).cast("long").alias("edge_ord"))
    best = graph.improve(start, e, lambda rk, _: rk + 1)
    # the witness of a node is its first edge toward a node one step nearer
    lo = best.select(F.col("node").alias("dst"), F.col("rank").alias("rd"))
    near = e.join(best.select(F.col("node").alias("src"), F.col("rank").alias("rs")), "src").join(lo, "dst").where("rd = rs - 1")
    w = near.groupBy("src").agg(F.min(F.struct("edge_ord", "dst")).alias("o")).select(F.col("src").alias("node"), F.col("o.dst").alias("via"))
    tree = some(best, "rank <= 6", whole).select("node").join(w, "node", "left")
    paths = graph.witness_paths(tree.select("node", "via"))
    return paths.select("node", F.size("path").alias("hops"), F.element_at("path", -1).alias("boundary"))


_DAG = "SELECT caller, callee, attempts FROM edge WHERE caller > callee AND by_name = 0"


def _weighted(spark, sf, w, whole):
    """Certain edges to a smaller id, as the twins have it, or every edge with calls inside a cycle counted once."""
    e = _edges(spark, sf, whole).withColumn("w", w)
    return graph.once_in_cycles(e) if whole else e.where("src > dst AND by_name = 0").select("src", "dst", "w")


@query(
    views("edge", "bnd", recursive=True)
    + f""", dag AS ({_DAG}), own AS (SELECT function AS node, max(coalesce(timeout_s, 60.0)) AS value FROM bnd GROUP BY 1),
p AS (SELECT node, value FROM own UNION SELECT caller, least(value, 100.0) * greatest(attempts, 1) FROM dag JOIN p ON callee = node) SELECT node, round(max(value), 4) + 0.0 AS wait_s FROM p GROUP BY node"""
)
def wait_worst(spark, sf, whole=False):
    """graph.wait: the callee's wait under a deadline of 100 s, times the attempts at the call"""
    e = _weighted(spark, sf, F.greatest(F.col("attempts"), F.lit(1)), whole)
    own = bnd(spark, sf).groupBy(F.col("function").alias("node")).agg(F.max(F.coalesce("timeout_s", F.lit(60.0))).alias("value"))
    return graph.worst(own, e, lambda w, v: F.least(v, F.lit(100.0)) * w).select("node", r(F.col("value")).alias("wait_s"))


@query(
    views("edge", "bnd", recursive=True)
    + f""", dag AS ({_DAG}), own AS (SELECT DISTINCT function AS node, CAST(1 AS BIGINT) AS value FROM bnd WHERE category IN ('net', 'db')),
p AS (SELECT node, value FROM own UNION SELECT caller, value * greatest(attempts, 1) FROM dag JOIN p ON callee = node) SELECT node, max(value) AS attempts FROM p GROUP BY node"""
)
def amp_best(spark, sf, whole=False):
    """graph.amp: the product of the attempts along the worst path to one I/O leaf"""
    e = _weighted(spark, sf, F.greatest(F.col("attempts"), F.lit(1)).cast("long"), whole)
    own = bnd(spark, sf).where("category IN ('net', 'db')").select(F.col("function").alias("node")).distinct().withColumn("value", F.lit(1).cast("long"))
    return graph.worst(own, e, lambda w, v: v * w).select("node", F.col("value").alias("attempts"))


_ANC = "anc AS (SELECT id, parent AS anc, 1 AS depth FROM act WHERE parent IS NOT NULL UNION ALL SELECT anc.id, a.parent, depth + 1 FROM anc JOIN act a ON a.id = anc.anc WHERE a.parent IS NOT NULL)"


@query(views("act", recursive=True) + f", {_ANC} SELECT id, owner FROM (SELECT anc.id, anc.anc AS owner, row_number() OVER (PARTITION BY anc.id ORDER BY depth) AS i FROM anc JOIN act a ON a.id = anc.anc WHERE a.fn IN ('signup', 'purchase')) WHERE i = 1")
def owner_ancestor(spark, sf):
    """join.owner, graph.span_owner: the nearest ancestor that is mapped"""
    return forest.nearest(act(spark, sf), F.col("fn").isin("signup", "purchase"))


@query(views("act", recursive=True) + f", {_ANC} SELECT a.id AS root, count(*) AS n FROM anc JOIN act a ON a.id = anc.anc JOIN act d ON d.id = anc.id WHERE a.fn = 'signup' AND d.fn = 'error' GROUP BY a.id")
def descendants_named(spark, sf):
    """graph.descendants_named"""
    return forest.descendants(act(spark, sf), F.col("fn") == "signup", F.col("fn") == "error")


@query(views("act", recursive=True) + f", {_ANC}, k AS (SELECT x.fn, anc.id, count(*) AS d FROM anc JOIN act x ON x.id = anc.id JOIN act y ON y.id = anc.anc AND y.fn = x.fn GROUP BY ALL) SELECT fn, max(d) + 1 AS depth FROM k GROUP BY fn")
def recursion_depth(spark, sf):
    """graph.recursion_depth"""
    return forest.nesting(act(spark, sf), "fn")


@query(views("act", recursive=True) + f", {_ANC} SELECT anc.id, max(a.n) AS upstream FROM anc JOIN act a ON a.id = anc.anc GROUP BY anc.id")
def upstream_max(spark, sf):
    """graph.upstream_max"""
    return forest.upstream(act(spark, sf), F.col("n"))


@query(views("act", recursive=True) + f", {_ANC} SELECT act.id, CAST(coalesce(max(depth), 0) AS INTEGER) AS depth, coalesce(string_agg(p.fn, '>' ORDER BY depth DESC), '') AS stack FROM act LEFT JOIN anc ON anc.id = act.id LEFT JOIN act p ON p.id = anc.anc GROUP BY act.id")
def span_stack(spark, sf):
    """graph.span_depth, graph.stack_of: outer to inner"""
    return forest.stacks(act(spark, sf), F.col("fn"))


@query(
    views("act", "io", recursive=True)
    + ", dn AS (SELECT id AS root, id AS node FROM act WHERE fn = 'signup' UNION ALL SELECT root, a.id FROM dn JOIN act a ON a.parent = dn.node JOIN act p ON p.id = dn.node WHERE dn.node = dn.root OR p.fn IN ('view', 'click')) SELECT root, count(*) AS io_rows FROM dn JOIN io ON io.id = dn.node WHERE dn.node <> dn.root GROUP BY root"
)
def io_under(spark, sf):
    """graph.io_under: I/O below an activation through unmapped spans only"""
    a = graph.cut(act(spark, sf).select("id", "parent", "fn"))
    calls = io(spark, sf).select("id")
    front = a.where("fn = 'signup'").select(F.col("id").alias("root"), "id")
    hits = None
    while not front.isEmpty():
        below = graph.cut(front.select("root", F.col("id").alias("parent")).join(a, "parent").select("root", "id", "fn"))
        got = below.join(calls, "id", "left_semi").select("root")
        hits = got if hits is None else hits.unionByName(got)
        front = below.where("fn IN ('view', 'click')").select("root", "id")
    return hits.groupBy("root").agg(F.count("*").alias("io_rows"))


@query(views("edge", "bnd") + ", c AS (SELECT caller AS function, callee, edge_ord, row_number() OVER (PARTITION BY callee ORDER BY by_name, attempts DESC, edge_ord, caller) AS i FROM edge JOIN bnd ON bnd.function = callee WHERE category = 'net') SELECT function, callee AS origin, i AS ord FROM c WHERE i <= 3")
def derive_callers(spark, sf, whole=False):
    """graph.derive, topk.derived3, rule propagated"""
    net = bnd(spark, sf).where("category = 'net'").select(F.col("function").alias("callee"))
    return ledger.derived(edge(spark, sf, whole), net, ["by_name", F.desc("attempts"), "edge_ord", "caller"])


@query(views("edge", "bnd", recursive=True) + ", r AS (SELECT function AS node FROM bnd UNION SELECT caller FROM edge JOIN r ON callee = node WHERE by_name = 0) SELECT caller, callee, callee IN (SELECT node FROM r) AS cannot_preempt FROM edge WHERE attempts >= 2")
def cannot_preempt(spark, sf, whole=False):
    """A deadline over a callee that reaches a boundary is useless: the plain reach; `preempt_ways` has the ways"""
    e = _edges(spark, sf, whole)
    blocks = graph.reach(bnd(spark, sf).select(F.col("function").alias("node")), e.where("by_name = 0")).withColumn("_b", F.lit(True))
    return e.where("attempts >= 2").join(blocks, e["dst"] == blocks["node"], "left").select(F.col("src").alias("caller"), F.col("dst").alias("callee"), F.coalesce("_b", F.lit(False)).alias("cannot_preempt"))


for _q in (io_reach, scc, blocks_stratified, derive_callers, cannot_preempt):
    whole(_q, EDGE_CUT)
whole(block_path, twin=False)
whole(wait_worst, twin=False)
whole(amp_best, twin=False)
