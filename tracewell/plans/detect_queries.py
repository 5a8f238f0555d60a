"""Queries over the detection rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect, graph, ledger
from ..sources import sinks
from .adapters import EDGE_CUT, bnd, call, edge, find, r, some, table, views
from .catalogue import query, whole

_CTX = "CASE function % 3 WHEN 0 THEN 'async' WHEN 1 THEN 'sync' ELSE 'offloaded' END"


def _boundaries(spark, sf):
    f = F.col("function") % 3
    return bnd(spark, sf).withColumns({"blocking": F.col("function") % 5 != 0, "context": F.when(f == 0, "async").when(f == 1, "sync").otherwise("offloaded"), "is_startup": F.col("function") % 7 == 0})


@query(views("bnd") + f" SELECT function, line, 'blocking-in-async' AS rule, CASE WHEN function % 7 = 0 THEN 'low' WHEN category = 'fs' THEN 'medium' ELSE 'high' END AS severity FROM bnd WHERE function % 5 <> 0 AND {_CTX} = 'async'")
def blocking_direct(spark, sf):
    """rule blocking-in-async (direct), pred.block_severity"""
    return detect.blocking_direct(_boundaries(spark, sf))


@query(
    views("edge", "bnd", recursive=True)
    + """, e AS (SELECT *, caller % 9 AS line FROM edge), b AS (SELECT function AS node, min(CASE WHEN category IN ('net', 'db', 'sleep') THEN 0 ELSE 1 END) AS rank FROM bnd WHERE function % 2 = 1 GROUP BY 1),
s AS (SELECT node, rank FROM b UNION SELECT caller, rank FROM edge JOIN s ON callee = node WHERE by_name = 0 AND caller % 2 = 1), m AS (SELECT node, min(rank) AS rank FROM s GROUP BY node)
SELECT caller, line, callee, CASE least(rank + by_name, 2) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity FROM (SELECT e.*, rank, row_number() OVER (PARTITION BY caller, line ORDER BY by_name, edge_ord, callee) AS i FROM e JOIN m ON m.node = callee WHERE caller % 2 = 0 AND callee % 2 = 1) WHERE i = 1"""
)
def blocking_chain(spark, sf, whole=False):
    """rule blocking-in-async (chain), sort.edges_by_conf, sort.boundaries_by_sev, sort.stable_ties: even suppliers are async"""
    e = edge(spark, sf, whole).withColumn("line", F.col("caller") % 9)
    rank = F.when(F.col("category").isin("net", "db", "sleep"), 0).otherwise(1)
    start = bnd(spark, sf).where("function % 2 = 1").groupBy(F.col("function").alias("node")).agg(F.min(rank).alias("rank")).select("node", "rank", F.lit(None).cast("long").alias("via"), F.lit(None).cast("long").alias("edge_ord"))
    sync = e.where("by_name = 0 AND caller % 2 = 1").select(F.col("caller").alias("src"), F.col("callee").alias("dst"), "edge_ord")
    blocks = graph.improve(start, sync)
    nodes = e.select(F.col("caller").alias("node")).union(e.select("callee")).distinct().withColumn("is_async", F.col("node") % 2 == 0)
    return detect.blocking_chain(e, blocks, nodes)


@query(
    views("edge", "bnd", recursive=True)
    + ", r AS (SELECT function AS node FROM bnd WHERE category IN ('net', 'db') UNION SELECT caller FROM edge JOIN r ON callee = node) SELECT caller AS function, caller % 9 AS line, CASE WHEN bool_and(by_name = 1) THEN 'low' ELSE 'medium' END AS severity FROM edge WHERE attempts > 0 AND callee IN (SELECT node FROM r) AND caller % 4 <> 0 GROUP BY caller"
)
def io_in_loop(spark, sf, whole=False):
    """rule io-in-loop"""
    e = edge(spark, sf, whole)
    reach = graph.reach(bnd(spark, sf).where("category IN ('net', 'db')").select(F.col("function").alias("node")), e.select(F.col("caller").alias("src"), F.col("callee").alias("dst")))
    calls = e.select(F.col("caller").alias("function"), "callee", (F.col("caller") % 9).alias("line"), F.col("attempts").alias("loop_depth"), (F.col("by_name") == 1).alias("forever"))
    retry = calls.where("function % 4 = 0").select("function", "line").distinct()
    return detect.io_in_loop(calls, reach, retry)


@query("SELECT l_orderkey AS function, min(l_linenumber) AS line, CASE WHEN max(CASE WHEN l_shipdate > l_shipdate THEN 1 WHEN l_suppkey % 2 = 0 THEN 1 ELSE 0 END) = 1 THEN 'high' ELSE 'medium' END AS severity FROM lineitem WHERE l_returnflag = 'R' AND l_tax > 0.02 AND l_quantity < 20 AND l_discount < 0.05 AND l_partkey % 3 <> 0 GROUP BY 1")
def wait_loops(spark, sf):
    """pred.wait_loop, rule unbounded-wait-loop"""
    i = table(spark, sf, "lineitem")
    loops = i.select(
        F.col("l_orderkey").alias("function"),
        F.col("l_linenumber").alias("line"),
        F.when(F.col("l_returnflag") == "R", "conditional").otherwise("collection").alias("kind"),
        F.when(F.col("l_tax") > 0.02, F.col("l_tax")).otherwise(0.0).alias("sleep_s"),
        F.when(F.col("l_quantity") >= 20, 1).alias("bound"),
        (F.col("l_discount") >= 0.05).alias("policy_bound"),
        (F.col("l_partkey") % 3 == 0).alias("wall_bound"),
        (F.col("l_suppkey") % 2 == 0).alias("on_request"),
    )
    return detect.wait_loops(loops)


@query("SELECT DISTINCT l_orderkey AS function FROM lineitem WHERE l_linenumber >= 2 AND l_orderkey % 2 = 0 AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def cpu_heavy(spark, sf):
    """rule cpu-heavy-in-async (loops)"""
    i = table(spark, sf, "lineitem")
    loops = i.select(F.col("l_orderkey").alias("function"), F.col("l_linenumber").alias("depth"), (F.col("l_orderkey") % 2 == 0).alias("is_async"))
    return detect.cpu_heavy(loops, i.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("function")))


@query(
    views("edge", recursive=True)
    + ", c AS (SELECT caller AS s, callee AS d FROM edge UNION SELECT s, callee FROM c JOIN edge ON d = caller), cyc AS (SELECT s AS node FROM c WHERE s = d) SELECT caller AS function, min(edge_ord) AS edge_ord FROM edge WHERE callee IN (SELECT node FROM cyc) AND caller NOT IN (SELECT node FROM cyc) GROUP BY caller"
)
def cpu_heavy_recursion(spark, sf, whole=False):
    """rule cpu-heavy-in-async (recursion): callers outside a cycle that call into one, once each"""
    e = edge(spark, sf, whole)
    cyc = graph.components(e.select(F.col("caller").alias("src"), F.col("callee").alias("dst"))).select("node")
    return e.join(cyc.withColumnRenamed("node", "callee"), "callee", "left_semi").join(cyc.withColumnRenamed("node", "caller"), "caller", "left_anti").groupBy(F.col("caller").alias("function")).agg(F.min("edge_ord").alias("edge_ord"))


@query(
    views("call", recursive=True)
    + """, e AS (SELECT DISTINCT caller, callee, min(line) OVER (PARTITION BY caller, callee) AS line FROM call), k AS (SELECT DISTINCT callee AS a FROM e WHERE caller > callee),
f AS (SELECT a, a AS node FROM k UNION SELECT a, callee FROM f JOIN e ON caller = node), b AS (SELECT a, a AS node FROM k UNION SELECT a, caller FROM b JOIN e ON callee = node),
cyc AS (SELECT DISTINCT f.node FROM f JOIN b ON f.a = b.a AND f.node = b.node WHERE f.node <> f.a UNION SELECT DISTINCT f.a FROM f JOIN e ON caller = f.node AND callee = f.a WHERE f.node <> f.a)
SELECT caller AS function, min(line) AS line FROM e WHERE callee IN (SELECT node FROM cyc) AND caller NOT IN (SELECT node FROM cyc) GROUP BY caller"""
)
def cpu_heavy_recursion_whole(spark, sf):
    """rule cpu-heavy-in-async (recursion) over all consecutive lines: callers outside a cycle that call into one, once each"""
    e = graph.cut(call(spark, sf))
    cyc = graph.components(e.select(F.col("caller").alias("src"), F.col("callee").alias("dst"))).select("node")
    return e.join(cyc.withColumnRenamed("node", "callee"), "callee", "left_semi").join(cyc.withColumnRenamed("node", "caller"), "caller", "left_anti").groupBy(F.col("caller").alias("function")).agg(F.min("line").alias("line"))


@query(views("bnd") + f" SELECT function, category FROM bnd WHERE function % 5 <> 0 AND {_CTX} <> 'offloaded'")
def injected(spark, sf):
    """pred.injected"""
    return detect.injected(_boundaries(spark, sf)).select("function", "category")


@query(
    views("find")
    + """ SELECT CASE WHEN rule < 'Brand#2' THEN 'blocking-in-async' WHEN rule < 'Brand#3' THEN 'io-in-loop' WHEN rule < 'Brand#4' THEN 'nested-loops' ELSE 'other' END AS rule,
CASE WHEN file % 11 = 0 THEN 'not-traced' WHEN file % 7 = 0 THEN 'not-exercised' WHEN rule < 'Brand#2' THEN CASE WHEN quantity > 30 THEN 'confirmed' ELSE 'not-observed' END WHEN rule < 'Brand#3' THEN CASE WHEN line > 3 THEN 'confirmed' WHEN file % 2 = 0 THEN 'not-verifiable' ELSE 'not-observed' END
WHEN rule < 'Brand#4' THEN CASE WHEN status = 'F' THEN 'measured' ELSE 'not-observed' END ELSE 'not-verifiable' END AS status, count(*) AS n FROM find GROUP BY ALL"""
)
def evidence_rules(spark, sf):
    """evidence rules, agg.status"""
    f = find(spark, sf)
    rule = F.when(F.col("rule") < "Brand#2", "blocking-in-async").when(F.col("rule") < "Brand#3", "io-in-loop").when(F.col("rule") < "Brand#4", "nested-loops").otherwise("other")
    status = detect.evidence(rule, F.col("file") % 11 != 0, F.col("file") % 7 != 0, F.col("quantity") - 30, F.col("line") - 2, F.when(F.col("status") == "F", 2.0), F.col("file") % 2 == 0)
    return f.groupBy(rule.alias("rule"), status.alias("status")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS call, CASE WHEN c_mktsegment IS NULL THEN 'unknown' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'external' WHEN o_orderkey % 3 = 0 THEN 'resolved' ELSE 'no method' END AS state FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 <> 0) ON o_custkey = c_custkey")
def typed_receiver(spark, sf):
    """join.typed_receiver: customers are receivers, segments classes, order keys divisible by three known methods"""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer").where("c_custkey % 4 <> 0")
    calls = o.select(F.col("o_orderkey").alias("call"), F.lit("f").alias("file"), F.col("o_custkey").alias("receiver"), F.when(F.col("o_orderkey") % 3 == 0, "known").otherwise("other").alias("name"))
    inst = c.select(F.lit("f").alias("file"), F.col("c_custkey").alias("receiver"), F.col("c_mktsegment").alias("cls"))
    methods = c.select(F.col("c_mktsegment").alias("cls")).distinct().where("cls <> 'AUTOMOBILE'").select("cls", F.lit("known").alias("name"), F.concat("cls", F.lit(".known")).alias("target"))
    return detect.typed_receiver(calls, inst, methods).select("call", "state")


@query("SELECT s_suppkey AS call, r_name AS type FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def field_types(spark, sf):
    """join.field_types: supplier to nation to region is a chain of two fields"""
    s, n, g = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    fields = s.select(F.concat(F.lit("s"), "s_suppkey").alias("cls"), F.lit("nation").alias("field"), F.concat(F.lit("n"), "s_nationkey").alias("type"))
    fields = fields.unionByName(n.join(g, n["n_regionkey"] == g["r_regionkey"]).select(F.concat(F.lit("n"), "n_nationkey").alias("cls"), F.lit("region").alias("field"), F.col("r_name").alias("type")))
    starts = s.select(F.col("s_suppkey").alias("call"), F.concat(F.lit("s"), "s_suppkey").alias("cls"), F.array(F.lit("nation"), F.lit("region")).alias("chain"))
    return detect.field_chain(starts, fields)


@query("WITH c AS (SELECT l_orderkey AS finding, list(l_suppkey ORDER BY l_linenumber, l_suppkey) AS ks FROM lineitem WHERE l_suppkey % 3 = 0 GROUP BY 1) SELECT o_orderkey AS finding, CASE WHEN ks IS NULL THEN CAST(o_custkey AS VARCHAR) ELSE array_to_string(list_transform(ks, lambda x: CAST(x AS VARCHAR)), ',') END AS keys FROM orders LEFT JOIN c ON finding = o_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def chain_keys(spark, sf):
    """join.chain_keys: suppliers divisible by three are known functions, the others are places"""
    i = table(spark, sf, "lineitem")
    name = F.concat(F.col("l_suppkey").cast("string"), F.when(F.col("l_suppkey") % 3 == 0, "").otherwise(" @ somewhere"))
    chain = i.groupBy(F.col("l_orderkey").alias("finding")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", name.alias("name")))), lambda x: x["name"]).alias("chain"))
    chains = chain.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("finding"), F.col("o_custkey").alias("function")), "finding")
    functions = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("name"), F.col("s_suppkey").alias("key"))
    return detect.chain_keys(chains, functions).select("finding", F.array_join(F.col("keys").cast("array<string>"), ",").alias("keys"))


@query("SELECT DISTINCT o_orderkey AS finding, a.l_orderkey AS stall FROM orders JOIN lineitem a ON a.l_linenumber = 1 AND a.l_suppkey = o_custkey % 100 AND a.l_orderkey % 10 = 0 JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_suppkey = o_orderkey % 100 WHERE o_orderkey % 10 = 0")
def stall_on_stack(spark, sf, whole=False):
    """join.stall_on_stack"""
    i = some(table(spark, sf, "lineitem"), "l_orderkey % 10 = 0", whole)
    stacks = i.groupBy(F.col("l_orderkey").alias("stall")).agg(F.collect_list("l_suppkey").alias("stack"), F.max("l_quantity").alias("dur"))
    stalls = i.where("l_linenumber = 1").select(F.col("l_orderkey").alias("stall"), F.col("l_suppkey").alias("leaf")).join(stacks, "stall")
    f = some(table(spark, sf, "orders"), "o_orderkey % 10 = 0", whole).select(F.col("o_orderkey").alias("finding"), (F.col("o_custkey") % 100).alias("leaf"), (F.col("o_orderkey") % 100).alias("function"))
    return detect.stall_on_stack(stalls, f).select("finding", "stall").distinct()


@query(views("find") + ", p AS (SELECT DISTINCT rule FROM find WHERE status = 'P' AND quantity = 50) SELECT severity, rule IN (SELECT rule FROM p) AS wrong_pattern, count(*) AS n FROM find GROUP BY ALL")
def wrong_pattern(spark, sf):
    """join.wrong_pattern"""
    f = find(spark, sf)
    return ledger.wrong_pattern(f, f.where("status = 'P' AND quantity = 50")).groupBy("severity", "wrong_pattern").agg(F.count("*").alias("n"))


@query("SELECT string_agg(m, ';' ORDER BY c) AS include FROM (SELECT p_brand AS c, p_brand || '[' || string_agg(DISTINCT split_part(p_type, ' ', 1), ',' ORDER BY split_part(p_type, ' ', 1)) || ']' AS m FROM part GROUP BY 1)")
def jvm_methods(spark, sf):
    """agg.jvm_methods"""
    return detect.jvm_methods(table(spark, sf, "part").select(F.col("p_brand").alias("cls"), F.substring_index("p_type", " ", 1).alias("method")))


@query(views("edge") + " SELECT caller, a.s_name AS caller_name, callee, b.s_name AS callee_name FROM edge LEFT JOIN supplier a ON a.s_suppkey = caller LEFT JOIN supplier b ON b.s_suppkey = callee")
def edges_with_names(spark, sf, whole=False):
    """proj.map_json"""
    f = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return sinks.edges_with_names(edge(spark, sf, whole).select("caller", "callee"), f)


@query("SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_suppkey) - 1 AS call_ord, l_suppkey AS callee FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 20 = 0 UNION ALL SELECT o_orderkey, NULL, NULL FROM orders WHERE o_orderkey % 20 = 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def flatten_calls(spark, sf, whole=False):
    """proj.flatten_calls: orders without lines keep one row"""
    i = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"]).alias("calls"))
    o = some(table(spark, sf, "orders"), "o_orderkey % 20 = 0", whole).join(i, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return sinks.flatten_calls(o.select(F.col("o_orderkey").alias("id"), "calls")).select("id", F.col("call_ord").cast("long").alias("call_ord"), F.col("call").alias("callee"))


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN '{\"p_brand\":\"' || p_brand || '\"}' ELSE '{\"p_brand\":\"' || p_brand || '\",\"p_size\":' || CAST(p_size AS VARCHAR) || '}' END AS brief FROM part")
def briefs(spark, sf):
    """proj.brief, fn.json: null fields go"""
    p = table(spark, sf, "part").withColumn("p_size", F.when(F.col("p_size") <= 40, F.col("p_size")))
    return p.select("p_partkey", sinks.brief("p_brand", "p_size").alias("brief"))


@query("SELECT l_partkey, round(l_extendedprice / 7, 4) + 0.0 AS x, l_orderkey FROM lineitem WHERE l_orderkey % 50 = 0")
def rounding(spark, sf, whole=False):
    """proj.rounding: half up on the decimal string in both engines"""
    return some(table(spark, sf, "lineitem"), "l_orderkey % 50 = 0", whole).select("l_partkey", r(F.col("l_extendedprice") / 7).alias("x"), "l_orderkey")


@query("SELECT page_id FROM pages WHERE substr(sha256(url), 1, 1) IN (SELECT substr(sha256(url), 1, 1) FROM pages WHERE page_id < 3)")
def scaffold_skip(spark, sf):
    """set.scaffold_skip: pages whose digest is registered, by its first digit"""
    p = table(spark, sf, "pages").select("page_id", F.substring(F.sha2(F.col("url").cast("binary"), 256), 1, 1).alias("h"))
    return p.join(p.where("page_id < 3").select("h").distinct(), "h", "left_semi").select("page_id")


@query("SELECT page_id FROM pages WHERE sha256(regexp_replace(url, '[?#].*$', '')) NOT IN (SELECT sha256(regexp_replace(url, '[?#].*$', '')) FROM pages WHERE page_id % 2 = 0)")
def scaffold_new(spark, sf):
    """set.scaffold_skip: pages whose whole digest is not registered; every second page is"""
    p = table(spark, sf, "pages").select("page_id", F.sha2(F.regexp_replace("url", "[?#].*$", "").cast("binary"), 256).alias("digest"))
    return ledger.without(p, p.where("page_id % 2 = 0"), "digest").select("page_id")


for _q in (blocking_chain, io_in_loop, edges_with_names):
    whole(_q, EDGE_CUT)
whole(stall_on_stack, "a.l_orderkey % 10 = 0", "o_orderkey % 10 = 0")
whole(flatten_calls, "o_orderkey % 20 = 0")
whole(rounding, "l_orderkey % 50 = 0")
