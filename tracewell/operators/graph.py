"""Reachability, components and worst paths over edge tables.

Recursive joins run as a driver loop of declared joins; the edges are made once, a round cuts lineage with
a reliable checkpoint and the loop ends when a round adds nothing. Only counts
come to the driver.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .parts import parts_of


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints; one of this machine only where all of Spark is in one process."""
    if not spark.sparkContext.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not re.fullmatch(r"local(\[[^,]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(where or tempfile.mkdtemp(prefix="tracewell-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder that the session names."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _round(df: DataFrame, key: str) -> DataFrame:
    """df cut as one round of several that are put together later: it must not claim to be dealt by its key, as each round is dealt into parts of its own number."""
    rest = [c for c in df.columns if c != key]
    return cut(df.select(F.struct(key).alias("_key"), *rest)).select(F.col("_key")[key].alias(key), *rest)


#: Edges of a part, as long as there are no more parts than cores, and after that: a loop has many rounds, so a small graph gets few parts.
EDGES_A_CORE, EDGES_A_PART = 20_000, 500_000


def _parts(*tables: DataFrame) -> int:
    """How many parts all tables of a loop are dealt into, from the rows of those given."""
    rows = sum(t.count() for t in tables)
    cores = tables[0].sparkSession.sparkContext.defaultParallelism
    # one part alone does not count as dealt by a key
    return max(2, min(cores, parts_of(rows, EDGES_A_CORE)), parts_of(rows, EDGES_A_PART))


def _dealt(df: DataFrame, parts: int, key: str) -> DataFrame:
    """df dealt by its key and in its order. A checkpoint keeps both (`_as_planned`), so a join with another table dealt alike exchanges and sorts neither."""
    return df.repartition(parts, key).sortWithinPartitions(key)


@contextmanager
def _as_planned(spark: SparkSession) -> Iterator[None]:
    """Loops over dealt tables run without adaptive execution, whose plans hide from a checkpoint how its rows are dealt."""
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


def reach(start: DataFrame, edges: DataFrame) -> DataFrame:
    """graph.io_reach: nodes from which `start` can be reached (edges src -> dst), start included; one frontier a round."""
    start, edges = cut(start.select("node").distinct()), cut(edges.select("src", "dst"))
    parts = _parts(edges, start)
    nodes = start.withColumn("seen", F.lit(True)).unionByName(edges.select(F.col("src").alias("node"), F.lit(False).alias("seen")))
    with _as_planned(edges.sparkSession):
        return _reach(_dealt(nodes, parts, "node").groupBy("node").agg(F.max("seen").alias("seen")), cut(_dealt(edges, parts, "dst")), parts)


def _reach(nodes: DataFrame, by_dst: DataFrame, parts: int) -> DataFrame:
    """nodes: all nodes, `seen` if they are in the start. A left join keeps how they are dealt and their order, which a full one does not."""
    now = cut(nodes.select("node", "seen", F.col("seen").alias("_new")))
    while True:
        front = now.where("_new").select(F.col("node").alias("dst"))
        if front.isEmpty():
            return now.where("seen").select("node")
        step = _dealt(by_dst.join(front, "dst").select(F.col("src").alias("node")), parts, "node").distinct().withColumn("_hit", F.lit(True))
        hit = F.col("_hit").isNotNull()
        now = cut(now.join(step, "node", "left").select("node", (F.col("seen") | hit).alias("seen"), (~F.col("seen") & hit).alias("_new")))


def closure(edges: DataFrame) -> DataFrame:
    """All pairs (src, dst) with a path; doubling, so the rounds are the logarithm of the longest path."""
    paths = cut(edges.select("src", "dst").distinct())
    n = paths.count()
    while True:
        a, b = paths.select("src", F.col("dst").alias("_m")), paths.select(F.col("src").alias("_m"), "dst")
        paths = cut(paths.unionByName(a.join(b, "_m").select("src", "dst")).distinct())
        m = paths.count()
        if m == n:
            return paths
        n = m


def _core(e: DataFrame, parts: int) -> DataFrame:
    """The edges between nodes with a way in and a way out, again and again until none goes: the cyclic core and what lies between; dealt by src.

    Nodes count their calls and callers. A round follows the nodes that ran out of either in the one before and takes their edges from the counts
    of the others; the edges are written again once, at the end.
    """
    by_src, by_dst = cut(_dealt(e, parts, "src")), cut(_dealt(e, parts, "dst"))
    outs, ins = by_src.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("outs")), by_dst.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("ins"))
    now = cut(_dealt(outs.join(ins, "node", "full"), parts, "node").select("node", F.coalesce("outs", F.lit(0)).alias("outs"), F.coalesce("ins", F.lit(0)).alias("ins")))
    while True:
        front, alive = now.where("outs = 0 OR ins = 0").select("node"), now.where("outs > 0 AND ins > 0")
        if front.isEmpty():
            break
        called = by_src.join(front.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), F.lit(0).alias("_out"), F.lit(1).alias("_in"))
        callers = by_dst.join(front.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), F.lit(1).alias("_out"), F.lit(0).alias("_in"))
        less = _dealt(called.unionByName(callers), parts, "node").groupBy("node").agg(F.sum("_out").alias("_out"), F.sum("_in").alias("_in"))
        now = cut(alive.join(less, "node", "left").select("node", (F.col("outs") - F.coalesce("_out", F.lit(0))).alias("outs"), (F.col("ins") - F.coalesce("_in", F.lit(0))).alias("ins")))
    left = now.select("node")
    half = by_dst.join(left.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return cut(_dealt(half.select("src", "dst"), parts, "src").join(left.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "dst"))


def _colours(by_src: DataFrame, parts: int) -> DataFrame:
    """(node, colour): the smallest node that reaches it, itself included. A round follows the nodes whose colour fell."""
    now = cut(by_src.select(F.col("src").alias("node")).distinct().select("node", F.col("node").alias("colour"), F.lit(True).alias("_fell")))
    while True:
        fell = now.where("_fell").select(F.col("node").alias("src"), "colour")
        if fell.isEmpty():
            return now.drop("_fell")
        offer = _dealt(by_src.join(fell, "src").select(F.col("dst").alias("node"), F.col("colour").alias("_c")), parts, "node").groupBy("node").agg(F.min("_c").alias("_c"))
        now = cut(now.join(offer, "node", "left").select("node", F.least("colour", "_c").alias("colour"), F.coalesce(F.col("_c") < F.col("colour"), F.lit(False)).alias("_fell")))


def components(edges: DataFrame) -> DataFrame:
    """graph.scc: (node, component) of nodes on a cycle; the component is its smallest node.

    Nodes take the smallest node that reaches them as their colour; what goes back to that node inside a colour is one
    component, and it leaves the graph. All colours go on at once and a round is one join of the edges, so the size of a
    component only sets the number of rounds, not their rows. Edges with a null end are none.
    """
    e = cut(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    looped = e.where("src = dst").select(F.col("src").alias("node")).withColumn("_own", F.lit(True))
    found_in = [looped.where(F.lit(False)).select("node", F.col("node").alias("component"))]
    while not e.isEmpty():
        parts = _parts(e)
        with _as_planned(e.sparkSession):
            e = _core(e, parts)
            if e.isEmpty():
                break
            # every node of the core has a call of its own, so the colours of all nodes are dealt as the edges are
            colour = _colours(e, parts)
            src, dst = (colour.select(F.col("node").alias(end), F.col("colour").alias(f"_{end}")) for end in ("src", "dst"))
            # dealt at last: the join is on the colours too
            inside = cut(_dealt(e.join(src, "src").join(dst, "dst").where("_src = _dst").select("src", "dst"), parts, "dst"))
            found = cut(_reach(colour.select("node", (F.col("node") == F.col("colour")).alias("seen")), inside, parts).join(colour, "node").select("node", F.col("colour").alias("component")))
            gone = found.select("node")
            e = cut(_dealt(e.join(gone.withColumnRenamed("node", "src"), "src", "left_anti"), parts, "dst").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
        big = found.groupBy("component").agg(F.count("*").alias("_n"))
        kept = found.join(big, "component").join(looped, "node", "left").where("_n > 1 OR _own")
        # each round is dealt into parts of its own number, so what it found must not claim to be dealt by its node
        found_in.append(_round(kept.select("node", "component"), "node"))
    return reduce(DataFrame.unionByName, found_in)


def roots(edges: DataFrame, targets: DataFrame, top: int = 5) -> DataFrame:
    """graph.roots: (target, root, place) of the first `top` callers without callers that reach a target, entries first, then by hops, then by id.

    edges: src, dst; targets: node, and both may carry nothing else; `entries` are the nodes whose `entry` is true in edges' `src_entry`, if that
    column is there. A node without callers is no root of itself.

    A node holds labels (not entry, hops, root). A round is a hop, so a label stays as it was first held and is offered to a node's callees once. A node holds
    the first `top` entries, and other roots only as long as it holds fewer than `top` labels: what is among the first of a node is among the first of
    one of its callers, since a call adds one hop to all of a caller's labels alike. Of what a node is offered in a round it may hold `top` of either kind, so
    the first 2 * `top` are looked at.
    """
    entry = F.coalesce(F.col("src_entry"), F.lit(False)) if "src_entry" in edges.columns else F.lit(False)
    e = cut(edges.groupBy("src", "dst").agg(F.max(entry).alias("entry")))
    parts = _parts(e)
    with _as_planned(e.sparkSession):
        by_src = cut(_dealt(e, parts, "src"))
        callers = by_src.groupBy(F.col("src").alias("node")).agg(F.max("entry").alias("entry")).withColumn("called", F.lit(False))
        nodes = _dealt(callers.unionByName(e.select(F.col("dst").alias("node"), F.lit(False).alias("entry"), F.lit(True).alias("called"))), parts, "node").groupBy("node").agg(F.max("entry").alias("entry"), F.max("called").alias("called"))
        own = F.array(F.struct((~F.col("entry")).alias("later"), F.lit(0).alias("hops"), F.col("node").alias("root")))
        own = F.when(F.col("called"), F.slice(own, 1, 0)).otherwise(own)
        now, hops = cut(nodes.select("node", own.alias("held"), own.alias("new"))), 0
        by_src = by_src.select("src", "dst")
        while True:
            front = now.where(F.size("new") > 0).select(F.col("node").alias("src"), "new")
            if front.isEmpty():
                break
            hops += 1
            offer = by_src.join(front, "src").select(F.col("dst").alias("node"), F.explode("new").alias("x")).select("node", "x.later", "x.root")
            offer = _dealt(offer, parts, "node").distinct().withColumn("_i", F.row_number().over(Window.partitionBy("node", "later").orderBy("root"))).where(F.col("_i") <= 2 * top)
            offer = offer.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("later", F.lit(hops).alias("hops"), "root"))).alias("offer"))
            both = now.select("node", "held").join(offer, "node", "left")
            fresh = F.filter(F.coalesce("offer", F.slice("held", 1, 0)), lambda x: ~F.exists("held", lambda h: h["root"] == x["root"]))
            both = both.select("node", "held", fresh.alias("fresh"))
            first = F.filter("held", lambda h: ~h["later"])
            entries = F.slice(F.filter("fresh", lambda x: ~x["later"]), F.lit(1), F.lit(top) - F.size(first))
            both = both.select("node", "held", "fresh", entries.alias("entries"))
            others = F.slice(F.filter("fresh", lambda x: x["later"]), F.lit(1), F.greatest(F.lit(top) - F.size("held") - F.size("entries"), F.lit(0)))
            now = cut(both.select("node", "held", F.concat("entries", others).alias("new")).select("node", F.concat("held", "new").alias("held"), "new"))
    last = now.join(targets.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("target"), F.slice(F.sort_array("held"), 1, top).alias("labels"))
    return last.select("target", F.posexplode("labels").alias("place", "x")).where("x.root <> target").select("target", F.col("x.root").alias("root"), "place")


def async_blocks(functions: DataFrame, direct: DataFrame, calls: DataFrame, blocks: DataFrame) -> DataFrame:
    """graph.async_blocks: (node, path) of the asynchronous functions that block, with the path by which they do.

    functions: node, is_async; direct: node, line of a blocking boundary that is called in an asynchronous context; calls: src, dst, line of calls in
    such a context; blocks: node, via of the functions that block, with the next on the way or null, as `improve` gives them.

    An asynchronous function blocks if one of its calls is a blocking boundary, a synchronous function that blocks, or an asynchronous
    function that does so itself. The first two kinds start the loop, the third carries it on over the nodes found in the round before. A
    function's way goes over its first such call, by line and then callee, among those whose callee was found in an earlier round, so that
    no way leads in a circle.
    """
    kind = cut(functions.select("node", "is_async").distinct())
    asks = kind.where("is_async").select(F.col("node").alias("src"))
    inner = calls.select("src", "dst", "line").join(asks, "src", "left_semi").join(kind.select(F.col("node").alias("dst"), F.col("is_async").alias("to_async")), "dst")
    e = cut(inner)
    blocking = cut(blocks.select("node", "via").distinct())
    sync = e.where("NOT to_async").join(blocking.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"), "line", F.col("dst").alias("via"))
    own = direct.select("node", "line").join(asks.withColumnRenamed("src", "node"), "node", "left_semi").select("node", "line", F.lit(None).cast(e.schema["dst"].dataType).alias("via"))
    # a boundary comes before a call of the same line
    first = own.unionByName(sync).groupBy("node").agg(F.min(F.struct("line", F.col("via").isNotNull().alias("call"), "via")).alias("w"))
    front = _round(first.select("node", F.lit(0).alias("round"), F.col("w.line").alias("line"), F.col("w.via").alias("via")), "node")
    found, number = front, 0
    onward = e.where("to_async").select("src", "dst", "line")
    while True:
        number += 1
        near = onward.join(front.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct().join(found.select("node"), "node", "left_anti")
        # all callees that were found so far, of which the first call counts
        step = onward.withColumnRenamed("src", "node").join(near, "node", "left_semi").join(found.select(F.col("node").alias("dst")), "dst", "left_semi")
        front = _round(step.groupBy("node").agg(F.min(F.struct("line", "dst")).alias("w")).select("node", F.lit(number).alias("round"), F.col("w.line").alias("line"), F.col("w.dst").alias("via")), "node")
        if front.isEmpty():
            break
        found = found.unionByName(front)
    # synchronous functions on the way are followed by the witnesses of their own
    tree = cut(found.select("node", "via").unionByName(blocking.join(kind.where("NOT is_async"), "node", "left_semi").select("node", "via")))
    return witness_paths(tree).join(found.select("node"), "node", "left_semi")


def cannot_preempt(calls: DataFrame, functions: DataFrame, blocks: DataFrame, ways: DataFrame) -> DataFrame:
    """graph.cannot_preempt: calls (src, dst, offloaded, ...) with `path`, the way by which the callee blocks, or null if a deadline can end it.

    ways: node, path of `async_blocks`; blocks as there. What is offloaded can always be left alone.
    """
    sync = witness_paths(blocks.select("node", "via")).join(functions.where("NOT is_async").select("node"), "node", "left_semi")
    way = sync.unionByName(ways.select("node", "path")).select(F.col("node").alias("dst"), F.col("path").alias("_path"))
    return calls.join(way, "dst", "left").withColumn("path", F.when(~F.col("offloaded"), F.col("_path"))).drop("_path")


def improve(start: DataFrame, edges: DataFrame, weight: Callable[[Column, str], Column] | None = None) -> DataFrame:
    """graph.blocks for one stratum: (node, rank, via, edge_ord) as a least fixpoint of ranks over callee -> caller.

    A node's rank only ever falls and the edge that lowered it is kept as its witness, so witnesses form no cycle.
    """
    edges, best = cut(edges), cut(start)
    while True:
        offers = edges.join(best.select(F.col("node").alias("dst"), "rank"), "dst").select(F.col("src").alias("node"), (F.col("rank") if weight is None else weight(F.col("rank"), "edge")).alias("rank"), F.col("dst").alias("via"), "edge_ord")
        best_offer = offers.groupBy("node").agg(F.min(F.struct("rank", "edge_ord", "via")).alias("o"))
        merged = best.join(best_offer, "node", "full").select(
            "node",
            F.when(F.col("rank").isNull() | (F.col("o.rank") < F.col("rank")), F.struct(F.col("o.rank"), F.col("o.via"), F.col("o.edge_ord"), F.lit(1).alias("new"))).otherwise(F.struct("rank", "via", "edge_ord", F.lit(0).alias("new"))).alias("x"),
        )
        best = cut(merged.select("node", "x.rank", "x.via", "x.edge_ord", "x.new"))
        changed = best.where("new = 1").isEmpty()
        best = best.drop("new")
        if changed:
            return best


def witness_paths(best: DataFrame) -> DataFrame:
    """graph.block_path: (node, path) along the witnesses; paths double in length each round."""
    paths = cut(best.select("node", F.when(F.col("via").isNull(), F.array("node")).otherwise(F.array("node", "via")).alias("path"), F.col("via").alias("last")))
    while True:
        open_ = paths.where("last IS NOT NULL")
        tail = paths.select(F.col("node").alias("last"), F.slice("path", 2, 1_000_000).alias("_rest"), F.col("last").alias("_next"))
        step = open_.join(tail, "last").select("node", F.concat("path", "_rest").alias("path"), F.col("_next").alias("last"))
        if step.isEmpty():
            return paths.select("node", "path")
        paths = cut(paths.where("last IS NULL").unionByName(step.select("node", "path", "last")))


def once_in_cycles(edges: DataFrame) -> DataFrame:
    """edges (src, dst, w) with w = 1 where both ends are in one component: such a call passes the callee's value on and multiplies nothing."""
    edges = cut(edges.select("src", "dst", "w"))
    c = components(edges)
    own, other = (c.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")) for end in ("src", "dst"))
    return edges.join(own, "src", "left").join(other, "dst", "left").select("src", "dst", F.when(F.col("_src") == F.col("_dst"), F.lit(1)).otherwise(F.col("w")).alias("w"))


def worst(values: DataFrame, edges: DataFrame, combine: Callable[[Column, Column], Column]) -> DataFrame:
    """graph.wait, graph.amp: (node, value) as the greatest of a node's own value and combine(edge, callee's value).

    Edges must be acyclic, or inside a cycle add nothing (`once_in_cycles`), and combine must not fall as the callee's value
    rises. A round follows the calls of the nodes whose value rose in the one before.
    """
    edges, own = cut(edges.select("src", "dst", "w")), cut(values.groupBy("node").agg(F.max("value").alias("value")))
    parts = _parts(edges, own)
    with _as_planned(edges.sparkSession):
        by_dst = cut(_dealt(edges, parts, "dst"))
        nodes = own.withColumn("_own", F.lit(True)).unionByName(edges.select(F.col("src").alias("node"), F.lit(None).cast(own.schema["value"].dataType).alias("value"), F.lit(False).alias("_own")))
        nodes = _dealt(nodes, parts, "node").groupBy("node").agg(F.max("value").alias("value"), F.max("_own").alias("_own"))
        now = cut(nodes.select("node", "value", "_own", F.col("_own").alias("_rose")))
        while True:
            risen = now.where("_rose").select(F.col("node").alias("dst"), F.col("value").alias("_v"))
            if risen.isEmpty():
                return now.where("_own OR value IS NOT NULL").select("node", "value")
            offer = by_dst.join(risen, "dst").select(F.col("src").alias("node"), combine(F.col("w"), F.col("_v")).alias("_o"))
            best = _dealt(offer, parts, "node").groupBy("node").agg(F.max("_o").alias("_o"))
            rose = F.coalesce(F.col("_o") > F.col("value"), F.col("_o").isNotNull())
            now = cut(now.join(best, "node", "left").select("node", F.when(rose, F.col("_o")).otherwise(F.col("value")).alias("value"), "_own", rose.alias("_rose")))


def ancestors(tree: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, anc, depth) of a parent-pointer forest; depth 1 is the parent. Doubling."""
    hop = cut(tree.where("parent IS NOT NULL").select("id", F.col("parent").alias("anc"), F.lit(1).alias("depth")))
    all_ = hop
    far = hop
    while True:
        nxt = far.select("id", F.col("anc").alias("_m"), F.col("depth").alias("_d"))
        longest = all_.select(F.col("id").alias("_m"), F.col("anc"), "depth")
        step = cut(nxt.join(longest, "_m").select("id", "anc", (F.col("depth") + F.col("_d")).alias("depth")))
        if step.isEmpty():
            return all_
        top = far.agg(F.max("depth").alias("d")).first()["d"]
        all_ = cut(all_.unionByName(step))
        far = cut(step.where(F.col("depth") == 2 * top))
        if far.isEmpty():
            return all_
