"""Detection rules over the static relations, and the evidence decision per finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut

# Boundary categories whose blocking is of medium severity, and per-language crash patterns.
MEDIUM_CATEGORIES = ("fs", "cpu")
CRASH = {"rust": r"\.(unwrap|expect)\(", "go": r",\s*_\s*:?="}
STALL_RULES = ("blocking-in-async", "cpu-heavy-in-async", "sync-over-async", "runblocking-in-suspend")
DEPENDENCY_DIR = r"(^|/)(node_modules|site-packages|vendor|\.cargo|dist-packages|third_party)(/|$)"


def block_severity(category: Column, local_store: Column) -> Column:
    """pred.block_severity: files and computing are medium, a local file database too; else high."""
    return F.when(category.isin(*MEDIUM_CATEGORIES) | local_store, "medium").otherwise("high")


def blocking_direct(bnd: DataFrame) -> DataFrame:
    """Rule blocking-in-async (direct): blocking boundaries in an async context; startup code is low."""
    hit = bnd.where("blocking AND context = 'async'")
    rule = F.when(F.col("category") == "cpu", "cpu-heavy-in-async").otherwise("blocking-in-async")
    severity = F.when(F.col("is_startup"), "low").otherwise(block_severity(F.col("category"), F.lit(False)))
    return hit.select("function", "line", rule.alias("rule"), severity.alias("severity"))


def blocking_chain(edges: DataFrame, blocks: DataFrame, is_async: DataFrame) -> DataFrame:
    """Rule blocking-in-async (chain): an edge from async to sync code that blocks; a call by name downgrades; certain edges first, one per (caller, line)."""
    a = is_async.select(F.col("node").alias("caller"), F.col("is_async").alias("_ca"))
    c = is_async.select(F.col("node").alias("callee"), F.col("is_async").alias("_cc"))
    hit = edges.join(a, "caller").join(c, "callee").where("_ca AND NOT _cc").join(blocks.select(F.col("node").alias("callee"), "rank"), "callee")
    rank = F.least(F.col("rank") + F.col("by_name"), F.lit(2))
    w = Window.partitionBy("caller", "line").orderBy("by_name", "edge_ord", "callee")
    return hit.withColumn("_i", F.row_number().over(w)).where("_i = 1").select("caller", "line", "callee", F.when(rank == 0, "high").when(rank == 1, "medium").otherwise("low").alias("severity"))


def wait_loops(loops: DataFrame) -> DataFrame:
    """pred.wait_loop, rule unbounded-wait-loop: conditional loops that sleep and have no bound; the first of each function."""
    hit = loops.where("kind = 'conditional' AND sleep_s > 0 AND bound IS NULL AND NOT policy_bound AND NOT wall_bound")
    return hit.groupBy("function").agg(F.min("line").alias("line"), F.max(F.when(F.col("on_request"), 1).otherwise(0)).alias("_r")).select("function", "line", F.when(F.col("_r") == 1, "high").otherwise("medium").alias("severity"))


def cpu_heavy(loops: DataFrame, awaited: DataFrame, least_depth: int = 2) -> DataFrame:
    """Rule cpu-heavy-in-async (loops): async functions nested deep enough without an awaited call in a loop."""
    return loops.where((F.col("depth") >= least_depth) & F.col("is_async")).select("function").distinct().join(awaited.select("function").distinct(), "function", "left_anti")


def io_in_loop(calls: DataFrame, reach: DataFrame, retry_only: DataFrame) -> DataFrame:
    """Rule io-in-loop: loop calls whose callee reaches I/O, retry loops aside; endless loops are low."""
    hit = calls.where("loop_depth > 0").join(reach.select(F.col("node").alias("callee")), "callee", "left_semi").join(retry_only, ["function", "line"], "left_anti")
    return hit.groupBy("function", "line").agg(F.bool_and("forever").alias("_f")).select("function", "line", F.when(F.col("_f"), "low").otherwise("medium").alias("severity"))


def injected(bnd: DataFrame) -> DataFrame:
    """pred.injected: blocking net, db, sleep, wait and fs boundaries that run on the loop's own thread."""
    return bnd.where(F.col("blocking") & F.col("category").isin("net", "db", "sleep", "wait", "fs") & (F.col("context") != "offloaded"))


def crashes(text: Column, lang: Column) -> Column:
    """agg.crashes: a boundary's statement that panics on or drops an error."""
    out = F.lit(False)
    for name, pattern in CRASH.items():
        out = F.when(lang == name, text.rlike(pattern)).otherwise(out)
    return out


def typed_receiver(calls: DataFrame, instances: DataFrame, methods: DataFrame) -> DataFrame:
    """join.typed_receiver: (call, target, state); a receiver of a known class without that method is external and must not match by name."""
    known = calls.join(instances, ["file", "receiver"], "left").join(methods, ["cls", "name"], "left")
    types = methods.select("cls").distinct().withColumn("_repo", F.lit(True))
    out = known.join(types, "cls", "left")
    state = F.when(F.col("cls").isNull(), "unknown").when(F.col("target").isNotNull(), "resolved").when(F.col("_repo"), "no method").otherwise("external")
    return out.select("call", "target", state.alias("state"))


def field_chain(starts: DataFrame, fields: DataFrame) -> DataFrame:
    """join.field_types: follows a chain of fields across classes to its end, one join a step; a field bound to two types ends it."""
    once = fields.groupBy("cls", "field").agg(F.min("type").alias("type"), F.count_distinct("type").alias("_n")).where("_n = 1").drop("_n")
    now = starts.withColumn("_k", F.lit(1))
    done = None
    while True:
        ready = now.where(F.col("_k") > F.size("chain")).select("call", F.col("cls").alias("type"))
        done = ready if done is None else done.unionByName(ready)
        now = cut(now.where(F.col("_k") <= F.size("chain")).withColumn("field", F.try_element_at("chain", F.col("_k"))).join(once, ["cls", "field"]).select("call", "chain", F.col("type").alias("cls"), (F.col("_k") + 1).alias("_k")))
        if now.isEmpty():
            return done


def frame_match(frames: DataFrame, functions: DataFrame) -> DataFrame:
    """join.frame_match: frames -> functions by place, each distinct frame once; a name that is unique repairs a line that is off."""
    distinct = frames.select("file", "line", "name").distinct()
    at = distinct.join(functions.select("file", "id", "start", "end"), "file").where("start <= line AND line <= end").groupBy("file", "line", "name").agg(F.min_by("id", F.col("end") - F.col("start")).alias("_at"))
    unique = functions.groupBy(F.col("fn_name").alias("name")).agg(F.min("id").alias("_by"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    m = distinct.join(at, ["file", "line", "name"], "left").join(unique, "name", "left")
    return frames.join(m.select("file", "line", "name", F.coalesce("_at", "_by").alias("function")), ["file", "line", "name"], "left")


def chain_keys(chains: DataFrame, functions: DataFrame) -> DataFrame:
    """join.chain_keys: the function keys of a chain in its order, places left out; the finding's own function where none is known."""
    one = chains.select("finding", "function", F.posexplode("chain").alias("pos", "name")).where(~F.contains("name", F.lit(" @ ")))
    keys = one.join(functions, "name").groupBy("finding").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "key"))), lambda x: x["key"]).alias("_k"))
    return chains.join(keys, "finding", "left").select("finding", F.coalesce("_k", F.array("function")).alias("keys"))


def stall_on_stack(stalls: DataFrame, findings: DataFrame) -> DataFrame:
    """join.stall_on_stack: (finding, stall) with the predicted leaf on top and the function somewhere below."""
    hit = stalls.join(findings, "leaf")
    return hit.where(F.exists("stack", lambda f: f == F.col("function"))).select("finding", "stall", "dur")


def evidence(rule: Column, traced: Column, exercised: Column, max_stall: Column, fanout: Column, exponent: Column, sampled: Column) -> Column:
    """Evidence rules: the status of a finding from its measures, one ordered CASE.

    Untraced processes and unexercised functions come first; a stall rule wants a stall on its stack, io-in-loop more than one call
    under one exact activation, nested-loops and recursion a fitted cost.
    """
    return (
        F.when(~traced, "not-traced")
        .when(~exercised, "not-exercised")
        .when(rule.isin(*STALL_RULES), F.when(max_stall > 0, "confirmed").otherwise("not-observed"))
        .when(rule == "io-in-loop", F.when(fanout > 1, "confirmed").when(sampled, "not-verifiable").otherwise("not-observed"))
        .when(rule.isin("nested-loops", "recursion"), F.when(exponent.isNotNull(), "measured").otherwise("not-observed"))
        .otherwise("not-verifiable")
    )


def jvm_methods(findings: DataFrame, most: int = 200) -> Column:
    """agg.jvm_methods: Class[m1,m2];... of the first classes."""
    per = findings.groupBy("cls").agg(F.concat(F.col("cls"), F.lit("["), F.array_join(F.sort_array(F.collect_set("method")), ","), F.lit("]")).alias("_m"))
    return per.orderBy("cls").limit(most).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cls", "_m"))), lambda x: x["_m"]), ";").alias("include"))
