"""Parent-pointer forests by pointer jumping: every node's pointer doubles its reach each round, so a round has one row per open node.

A chain of a hundred thousand activations takes seventeen rounds and never more rows than it has nodes; the pairs of a node and
its ancestors, quadratic in a chain, are not made. Forests are (id, parent) with a null parent, or one that is no id, at the top.
A parent chain that leads in a circle has no top: its nodes are left out of every result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut


def _linked(tree: DataFrame, *carry: str) -> DataFrame:
    """(id, parent, ...) with parents that are no id made null."""
    known = tree.select(F.col("id").alias("parent"), F.lit(True).alias("_known"))
    return tree.select("id", "parent", *carry).join(known, "parent", "left").select("id", F.when(F.col("_known"), F.col("parent")).alias("parent"), *carry)


def jump(tree: DataFrame, value: Column, join: Callable[[Column, Column], Column], stop: Column | None = None) -> DataFrame:
    """(id, value): the values of the nodes from the parent upward, joined from the nearest on; null at the top.

    `value` is taken from each node as its children see it, and `join(near, far)` must be associative. A path ends at the
    first ancestor for which `stop` holds (null is no), that one included.
    """
    stop = F.coalesce(stop, F.lit(False)) if stop is not None else F.lit(False)
    own = cut(_linked(tree.withColumn("_v", value).withColumn("_stop", stop), "_v", "_stop"))
    up = own.select(F.col("id").alias("parent"), F.col("_v").alias("value"), F.when(~F.col("_stop") & F.col("parent").isNotNull(), F.col("id")).alias("at"))
    now = cut(own.select("id", "parent").join(up, "parent", "left").select("id", "value", "at"))
    most = now.count().bit_length() + 1
    for _ in range(most):
        open_ = now.where("at IS NOT NULL")
        if open_.isEmpty():
            return now.select("id", "value")
        far = now.select(F.col("id").alias("at"), F.col("value").alias("_far"), F.col("at").alias("_next"))
        # a top has nothing above it: its own value was taken already
        step = open_.join(far, "at").select("id", F.when(F.col("_far").isNull(), F.col("value")).otherwise(join(F.col("value"), F.col("_far"))).alias("value"), F.col("_next").alias("at"))
        now = cut(now.where("at IS NULL").unionByName(step))
    return now.where("at IS NULL").select("id", "value")  # what is still open leads in a circle


def nearest(tree: DataFrame, marked: Column) -> DataFrame:
    """join.owner, graph.span_owner: (id, owner) of the nodes below a marked one."""
    found = jump(tree, F.when(marked, F.col("id")), lambda near, far: F.coalesce(near, far), marked)
    return found.where("value IS NOT NULL").withColumnRenamed("value", "owner")


def upstream(tree: DataFrame, value: Column) -> DataFrame:
    """graph.upstream_max: (id, upstream), the greatest value above each node that has a parent."""
    found = jump(tree, F.struct(F.lit(True).alias("any"), value.alias("v")), lambda near, far: F.struct(F.lit(True).alias("any"), F.greatest(near["v"], far["v"]).alias("v")))
    return found.where("value IS NOT NULL").select("id", F.col("value.v").alias("upstream"))


def depths(tree: DataFrame) -> DataFrame:
    """graph.span_depth: (id, depth), 0 at the top."""
    return jump(tree, F.lit(1), lambda near, far: near + far).select("id", F.coalesce("value", F.lit(0)).alias("depth"))


def stacks(tree: DataFrame, name: Column, mark: str = ">") -> DataFrame:
    """graph.stack_of: (id, depth, stack), the names above a node from the outermost on. The stacks themselves are as long as the paths."""
    both = F.struct(F.lit(1).alias("depth"), name.alias("stack"))
    found = jump(tree, both, lambda near, far: F.struct((near["depth"] + far["depth"]).alias("depth"), F.concat(far["stack"], F.lit(mark), near["stack"]).alias("stack")))
    return found.select("id", F.coalesce("value.depth", F.lit(0)).alias("depth"), F.coalesce("value.stack", F.lit("")).alias("stack"))


def below(tree: DataFrame, weight: Column) -> DataFrame:
    """(id, total): the sum of the weights in each node's subtree, its own included.

    After round k a node has the sum over what lies less than 2^k below it, and its pointer leads 2^k up: a round adds a node's sum to
    where it points.
    """
    now = cut(_linked(tree.withColumn("_w", weight), "_w").select("id", F.col("parent").alias("at"), F.col("_w").alias("total")))
    most = now.count().bit_length() + 1
    for _ in range(most):
        open_ = now.where("at IS NOT NULL")
        if open_.isEmpty():
            return now.select("id", "total")
        got = open_.groupBy(F.col("at").alias("id")).agg(F.sum("total").alias("_more"))
        skip = now.select(F.col("id").alias("at"), F.col("at").alias("_next"))
        moved = open_.join(skip, "at", "left").select("id", F.col("_next").alias("at"), "total").unionByName(now.where("at IS NULL"))
        now = cut(moved.join(got, "id", "left").select("id", "at", (F.col("total") + F.coalesce("_more", F.lit(0))).alias("total")))
    circle = now.where("at IS NOT NULL").select("id")
    return now.join(circle, "id", "left_anti").select("id", "total")


def preorder(tree: DataFrame) -> DataFrame:
    """(id, top, pre, size): a node's place among the nodes of its tree in the order of a walk that takes children by id, and the size of its subtree.

    The descendants of a node, and it itself, are those of its tree with pre <= place < pre + size.
    """
    linked = cut(_linked(tree))
    sized = cut(linked.join(below(linked, F.lit(1).cast("long")), "id").withColumnRenamed("total", "size"))
    earlier = F.sum("size").over(Window.partitionBy("parent").orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    placed = sized.where("parent IS NOT NULL").withColumn("step", 1 + F.coalesce(earlier, F.lit(0)))
    placed = cut(placed.unionByName(sized.where("parent IS NULL").withColumn("step", F.lit(0).cast("long"))))
    # the steps above a node, and which node they lead to: a node's own step is added at the end
    above = jump(placed, F.struct(F.col("step").alias("steps"), F.col("id").alias("top")), lambda near, far: F.struct((near["steps"] + far["steps"]).alias("steps"), far["top"].alias("top")))
    return placed.join(above, "id").select("id", F.coalesce("value.top", "id").alias("top"), (F.coalesce("value.steps", F.lit(0)) + F.col("step")).alias("pre"), "size")


def descendants(tree: DataFrame, root: Column, counted: Column) -> DataFrame:
    """graph.descendants_named: (root, n) of the nodes for which `root` holds that have counted nodes below them; one is not below itself."""
    total = below(tree.withColumn("_c", F.when(counted, F.lit(1)).otherwise(F.lit(0)).cast("long")), F.col("_c"))
    own = tree.select("id", F.coalesce(root, F.lit(False)).alias("_r"), F.when(counted, F.lit(1)).otherwise(F.lit(0)).alias("_own"))
    return total.join(own, "id").where("_r AND total > _own").select(F.col("id").alias("root"), (F.col("total") - F.col("_own")).alias("n"))


def nesting(tree: DataFrame, name: str) -> DataFrame:
    """graph.recursion_depth: (name, depth) of names that occur below themselves: how many of them lie on one path at most.

    The subtrees of one name's nodes are brackets over the places of the walk; the depth is their running sum.
    """
    at = preorder(tree).join(tree.select("id", name), "id")
    mark = F.explode(F.array(F.struct(F.col("pre").alias("place"), F.lit(1).alias("d")), F.struct((F.col("pre") + F.col("size")).alias("place"), F.lit(-1).alias("d")))).alias("m")
    events = at.select(name, "top", mark).select(name, "top", "m.place", "m.d")
    # what ends at a place ends before the next begins there
    running = F.sum("d").over(Window.partitionBy(name, "top").orderBy("place", "d").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return events.withColumn("_n", running).groupBy(name).agg(F.max("_n").alias("depth")).where("depth > 1")
