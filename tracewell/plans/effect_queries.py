"""Queries over waits, deadlines and retries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import effects, graph
from .adapters import bnd, call, edge, r, some, stop, table, views
from .catalogue import query, whole

_INF = "CAST('Infinity' AS DOUBLE)"


@query(views("bnd") + ", w AS (SELECT function, category, CASE WHEN timeout_s IS NOT NULL THEN timeout_s WHEN function % 3 = 0 THEN 30.0 WHEN function % 7 = 0 THEN 0.0 END AS w, CASE WHEN timeout_s IS NOT NULL OR function % 3 = 0 THEN 'known' WHEN function % 7 = 0 THEN 'bounded' ELSE 'unbounded' END AS wait_kind FROM bnd) SELECT function, category, w AS wait_s, wait_kind FROM w")
def boundary_wait(spark, sf):
    """fn.boundary_wait; an unbounded wait is written as null, as the documents have it"""
    none = F.lit(None).cast("double")
    args = (F.col("timeout_s"), none, F.when(F.col("function") % 3 == 0, F.lit(30.0)), F.col("function") % 7 == 0)
    w = bnd(spark, sf).select("function", "category", effects.boundary_wait(*args).alias("w"), effects.wait_kind(*args).alias("wait_kind"))
    return w.select("function", "category", F.when(F.col("w") < effects.INFINITY, F.col("w")).alias("wait_s"), "wait_kind")


@query(
    views("edge", "bnd", recursive=True)
    + f""", dag AS (SELECT caller, callee, attempts FROM edge WHERE caller > callee), own AS (SELECT function AS node, max(coalesce(timeout_s, {_INF})) AS v FROM bnd GROUP BY 1),
p AS (SELECT node, v FROM own UNION SELECT caller, v * greatest(attempts, 1) FROM dag JOIN p ON callee = node), w AS (SELECT node, max(v) AS v FROM p GROUP BY node),
r AS (SELECT function AS node FROM bnd WHERE category = 'sleep' UNION SELECT caller FROM edge JOIN r ON callee = node)
SELECT caller, callee, CASE WHEN callee IN (SELECT node FROM r) AND attempts <> 3 THEN 'cannot-preempt' WHEN attempts = 3 AND v = {_INF} THEN 'abandons-thread' WHEN v > 10 AND v < {_INF} THEN 'exceeded' ELSE 'ok' END AS status FROM edge LEFT JOIN w ON node = callee WHERE attempts >= 1"""
)
def deadlines(spark, sf, whole=False):
    """agg.deadlines, rules deadline-cannot-preempt and timeout-budget-exceeded: a deadline of 10 s on every edge with attempts; three attempts run offloaded"""
    e = edge(spark, sf, whole).select(F.col("caller").alias("src"), F.col("callee").alias("dst"), "attempts")
    b = bnd(spark, sf)
    own = b.groupBy(F.col("function").alias("node")).agg(F.max(F.coalesce("timeout_s", F.lit(effects.INFINITY))).alias("value"))
    calls = e.select("src", "dst", F.greatest("attempts", F.lit(1)).alias("w"))
    w = graph.worst(own, graph.once_in_cycles(calls) if whole else calls.where("src > dst"), lambda m, v: v * m)
    blocks = graph.reach(b.where("category = 'sleep'").select(F.col("function").alias("node")), e).withColumn("_b", F.lit(True)).withColumnRenamed("node", "dst")
    out = e.where("attempts >= 1").join(w.withColumnRenamed("node", "dst"), "dst", "left").join(blocks, "dst", "left")
    status = effects.deadline_class(F.lit(10.0), F.coalesce("value", F.lit(0.0)), F.col("attempts") == 3, F.coalesce("_b", F.lit(False)))
    return out.select(F.col("src").alias("caller"), F.col("dst").alias("callee"), status.alias("status"))


_SITES = "s AS (SELECT l_suppkey AS function, l_linenumber AS line, l_orderkey AS site, CASE WHEN l_quantity >= 48 THEN NULL WHEN l_quantity >= 40 THEN 0 ELSE CAST(l_quantity AS INTEGER) % 6 END AS attempts, CASE l_returnflag WHEN 'N' THEN 'none' WHEN 'A' THEN 'fixed' ELSE 'exponential' END AS backoff FROM lineitem WHERE l_partkey % 20 = 0)"


def _sites(spark, sf, whole=False):
    i = some(table(spark, sf, "lineitem"), "l_partkey % 20 = 0", whole)
    attempts = F.when(F.col("l_quantity") >= 48, F.lit(None).cast("int")).when(F.col("l_quantity") >= 40, F.lit(0)).otherwise(F.col("l_quantity").cast("int") % 6)
    backoff = F.when(F.col("l_returnflag") == "N", "none").when(F.col("l_returnflag") == "A", "fixed").otherwise("exponential")
    return i.select(F.col("l_suppkey").alias("function"), F.col("l_linenumber").alias("line"), F.col("l_orderkey").alias("site"), attempts.alias("attempts"), backoff.alias("backoff"))


@query("WITH " + _SITES + " SELECT function, finding, count(*) AS n FROM (SELECT function, CASE WHEN attempts IS NULL AND backoff = 'none' THEN 'unbounded-retry/high' WHEN attempts IS NULL THEN 'unbounded-retry/medium' WHEN backoff = 'none' THEN 'retry-without-backoff/medium' END AS finding FROM s WHERE attempts IS NULL OR attempts <> 1) WHERE finding IS NOT NULL GROUP BY ALL")
def retries(spark, sf, whole=False):
    """agg.retries, agg.retry_loops, rules unbounded-retry and retry-without-backoff; a single attempt is no retry"""
    s = _sites(spark, sf, whole).where("attempts IS NULL OR attempts <> 1").withColumn("finding", effects.retry_rule(F.col("attempts"), F.col("backoff")))
    return s.where("finding IS NOT NULL").groupBy("function", "finding").agg(F.count("*").alias("n"))


_LOOPS = "lp AS (SELECT l_orderkey AS function, l_partkey AS loop_id, l_linenumber AS loop_start, l_linenumber + CAST(l_quantity AS INTEGER) % 5 AS loop_end, l_returnflag <> 'N' AS retry_like, CASE WHEN l_quantity >= 49 THEN NULL ELSE CAST(l_quantity AS INTEGER) % 4 END AS attempts, l_tax AS backoff_s FROM lineitem WHERE l_orderkey % 10 = 0)"


def _loops(spark, sf, whole=False):
    i = some(table(spark, sf, "lineitem"), "l_orderkey % 10 = 0", whole)
    q = F.col("l_quantity").cast("int")
    return i.select(
        F.col("l_orderkey").alias("function"),
        F.col("l_partkey").alias("loop_id"),
        F.col("l_linenumber").alias("loop_start"),
        (F.col("l_linenumber") + q % 5).alias("loop_end"),
        (F.col("l_returnflag") != "N").alias("retry_like"),
        F.when(F.col("l_quantity") >= 49, F.lit(None).cast("int")).otherwise(q % 4).alias("attempts"),
        F.col("l_tax").alias("backoff_s"),
    )


def _calls(spark, sf, whole=False):
    return some(table(spark, sf, "orders"), "o_orderkey % 10 = 0", whole).select(F.col("o_orderkey").alias("function"), (F.col("o_custkey") % 7 + 1).cast("int").alias("line"))


_CALLS = "c AS (SELECT o_orderkey AS function, CAST(o_custkey % 7 + 1 AS INTEGER) AS line FROM orders WHERE o_orderkey % 10 = 0)"


@query(f"WITH {_LOOPS}, {_CALLS} SELECT c.function, c.line, count(*) AS loops FROM c JOIN lp USING (function) WHERE line BETWEEN loop_start AND loop_end GROUP BY ALL HAVING bool_and(retry_like)")
def retry_only(spark, sf, whole=False):
    """pred.retry_only, pred.retry_like"""
    return effects.retry_only(_calls(spark, sf, whole), _loops(spark, sf, whole), ["function", "line"])


@query(f"WITH {_LOOPS}, {_CALLS} SELECT c.function, c.line, CASE WHEN count(*) > count(attempts) THEN NULL ELSE round(product(greatest(attempts, 1))) + 0.0 END AS mult, round(sum(coalesce(backoff_s, 0)), 4) + 0.0 AS backoff_s FROM c JOIN lp USING (function) WHERE retry_like AND line BETWEEN loop_start AND loop_end GROUP BY ALL")
def site_mult(spark, sf, whole=False):
    """agg.site_mult; unbounded products are written as null"""
    s = effects.site_mult(_calls(spark, sf, whole), _loops(spark, sf, whole), ["function", "line"])
    return s.select("function", "line", F.when(F.col("mult") < effects.INFINITY, F.col("mult")).alias("mult"), r(F.col("backoff_s")).alias("backoff_s"))


@query(f"WITH {_LOOPS}, n AS (SELECT a.function, a.loop_id, count(*) AS n FROM lp a JOIN lp b ON a.function = b.function AND b.loop_start <= a.loop_start AND a.loop_end <= b.loop_end GROUP BY ALL) SELECT function, max(n) AS depth FROM n GROUP BY function")
def scaling_depth(spark, sf, whole=False):
    """agg.max_loop_depth, pred.scales, rule nested-loops"""
    return effects.scaling_depth(_loops(spark, sf, whole), "function")


@query("WITH " + _SITES + ", a AS (SELECT function, line, CAST(round(product(greatest(coalesce(attempts, 1), 1))) AS DOUBLE) AS amp, count(*) FILTER (attempts >= 2) AS layers FROM s WHERE site % 5 = 0 GROUP BY ALL) SELECT line AS leaf, function, amp, CASE WHEN layers >= 2 AND amp >= 27 THEN 'high' WHEN layers >= 2 AND amp >= 9 THEN 'medium' END AS severity FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY amp DESC, function) AS i FROM a) WHERE i = 1")
def amplification(spark, sf, whole=False):
    """agg.best_by_leaf, rule retry-amplification"""
    s = some(_sites(spark, sf, whole), "site % 5 = 0", whole)
    a = s.groupBy("function", "line").agg(F.round(F.product(F.greatest(F.coalesce("attempts", F.lit(1)), F.lit(1)).cast("double"))).alias("amp"), F.count_if(F.col("attempts") >= 2).alias("layers"))
    best = effects.best_by_leaf(a, "line", "amp", ["function", "layers"])
    return best.select(F.col("line").alias("leaf"), "function", "amp", effects.amplification(F.col("amp"), F.col("layers")).alias("severity"))


@query(
    views("edge", "bnd", recursive=True)
    + f""", own AS (SELECT function AS node, max(coalesce(timeout_s, {_INF})) AS v FROM bnd GROUP BY 1), p AS (SELECT node, v FROM own UNION SELECT caller, v FROM edge JOIN p ON callee = node), w AS (SELECT node, max(v) AS v FROM p GROUP BY node)
SELECT node AS entry, CASE WHEN v < {_INF} THEN v END AS wait_s, v = {_INF} AS hangs FROM w WHERE node NOT IN (SELECT callee FROM edge)"""
)
def entries(spark, sf, whole=False):
    """agg.entries, rule hang-reaches-entry: functions that nothing calls"""
    e = edge(spark, sf, whole).select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    own = bnd(spark, sf).groupBy(F.col("function").alias("node")).agg(F.max(F.coalesce("timeout_s", F.lit(effects.INFINITY))).alias("value"))
    w = graph.worst(own, e.withColumn("w", F.lit(1)), lambda _, v: v)
    out = w.join(e.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
    return out.select(F.col("node").alias("entry"), F.when(F.col("value") < effects.INFINITY, F.col("value")).alias("wait_s"), (F.col("value") == effects.INFINITY).alias("hangs"))


@query(
    views("call", "stop", recursive=True)
    + f""", e AS (SELECT DISTINCT caller, callee FROM call), own AS (SELECT node, CASE WHEN line % 5 = 0 THEN {_INF} ELSE line % 7 + 1.0 END AS v FROM stop),
p AS (SELECT node, v FROM own UNION SELECT caller, v FROM e JOIN p ON callee = node), w AS (SELECT node, max(v) AS v FROM p GROUP BY node)
SELECT node AS entry, CASE WHEN v < {_INF} THEN v END AS wait_s, v = {_INF} AS hangs FROM w WHERE node NOT IN (SELECT callee FROM e)"""
)
def entries_whole(spark, sf):
    """agg.entries, rule hang-reaches-entry over all consecutive lines: parts that nothing calls"""
    e = graph.cut(call(spark, sf).select(F.col("caller").alias("src"), F.col("callee").alias("dst"), F.lit(1).alias("w")))
    own = stop(spark, sf).select("node", F.when(F.col("line") % 5 == 0, F.lit(effects.INFINITY)).otherwise(F.col("line") % 7 + 1.0).alias("value"))
    w = graph.worst(own, e, lambda _, v: v).join(e.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
    return w.select(F.col("node").alias("entry"), F.when(F.col("value") < effects.INFINITY, F.col("value")).alias("wait_s"), (F.col("value") == effects.INFINITY).alias("hangs"))


@query("SELECT c_mktsegment AS category, CASE WHEN c_custkey % 4 = 0 OR (c_custkey % 3 = 0 AND c_custkey % 5 = 0) THEN 'bounded' WHEN c_custkey % 7 = 0 THEN 'low' ELSE 'medium' END AS verdict, count(*) AS n FROM customer GROUP BY ALL")
def io_without_timeout(spark, sf):
    """pred.bounded, rule io-without-timeout"""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    ok = effects.bounded(k % 4 == 0, k % 3 == 0, k % 5 == 0)
    return c.groupBy(F.col("c_mktsegment").alias("category"), F.when(ok, "bounded").when(k % 7 == 0, "low").otherwise("medium").alias("verdict")).agg(F.count("*").alias("n"))


whole(deadlines, twin=False)
whole(retries, "l_partkey % 20 = 0")
# its products leave the exact range of doubles, so the two engines would differ by their order
whole(amplification, "l_partkey % 20 = 0", "site % 5 = 0", twin=False)
whole(retry_only, "l_orderkey % 10 = 0", "o_orderkey % 10 = 0")
whole(site_mult, "l_orderkey % 10 = 0", "o_orderkey % 10 = 0")
whole(scaling_depth, "l_orderkey % 10 = 0")
