"""Tiered name resolution and first-match classification: join.call_resolve, join.rule_match, join.size_flow, join.lock_*, join.lint_*."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: More candidates than this at the best tier mean no resolution.
MAX_CANDIDATES = 4


def resolve_tiered(candidates: DataFrame, call: list[str], tier: Column, most: int = MAX_CANDIDATES) -> DataFrame:
    """join.call_resolve: keeps a call's candidates of its lowest tier, if they are few; `sole` tells a unique one.

    A count per tier decides, so a name with very many definitions needs no window over them all.
    """
    c = candidates.withColumn("tier", tier).where("tier IS NOT NULL")
    best = c.groupBy(*call, "tier").agg(F.count("*").alias("n")).groupBy(*call).agg(F.min_by(F.struct("tier", "n"), "tier").alias("_b"))
    best = best.where(F.col("_b.n") <= most).select(*call, F.col("_b.tier").alias("tier"), F.col("_b.n").alias("n_candidates"))
    return c.join(best, [*call, "tier"])


def first_rule(rules: list[tuple[str, Column]], default: str | None = None) -> Column:
    """join.rule_match: the name of the first rule that holds; the table becomes one CASE, so its patterns compile once."""
    return reduce(lambda acc, rule: F.when(rule[1], F.lit(rule[0])).otherwise(acc), reversed(rules), F.lit(default))


def arity_fits(argc: Column, lo: Column, hi: Column, takes_self: Column) -> Column:
    """pred.arity: null on either side fits; an explicit receiver may be passed as well."""
    fits = (argc >= lo) & (argc <= hi)
    with_self = takes_self & (argc - 1 >= lo) & (argc - 1 <= hi)
    return F.coalesce(fits | with_self, F.lit(True))


def visible(private: Column, same_file: Column, same_module: Column) -> Column:
    """pred.visible"""
    return ~private | same_file | same_module


def size_flow(shapes: DataFrame, least: int = 2) -> DataFrame:
    """join.size_flow: (caller, argument) -> (callee, argument) of equal size in one activation."""
    a = shapes.select(F.col("id").alias("parent"), F.col("fn").alias("caller"), F.col("arg").alias("caller_arg"), F.col("n").alias("_n"))
    b = shapes.where((F.col("n") >= least) & F.col("parent").isNotNull()).select("parent", F.col("fn").alias("callee"), F.col("arg").alias("callee_arg"), F.col("n").alias("_n"))
    return b.join(a, ["parent", "_n"]).where("caller <> callee").select("caller", "caller_arg", "callee", "callee_arg").distinct()


def lock_pairs(regions: DataFrame) -> DataFrame:
    """join.lock_nesting: (outer, inner) locks where one region begins inside another of the same function."""
    a = regions.select("function", F.col("lock").alias("outer"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    b = regions.select("function", F.col("lock").alias("inner"), F.col("start").alias("_t"))
    return a.join(b, "function").where((F.col("_t") > F.col("_s")) & (F.col("_t") <= F.col("_e")) & (F.col("outer") != F.col("inner"))).select("function", "outer", "inner").distinct()


def lock_inversions(pairs: DataFrame) -> DataFrame:
    """join.lock_inversion: locks taken in both orders, the smaller name first."""
    p = pairs.select("outer", "inner").distinct()
    q = p.select(F.col("outer").alias("inner"), F.col("inner").alias("outer"))
    return p.join(q, ["outer", "inner"]).where(F.col("outer") < F.col("inner")).select(F.col("outer").alias("a"), F.col("inner").alias("b"))


def split_match(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """join.lint_corroborate: left rows with the flag whether the other side has their keys."""
    r = right.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return left.join(r, keys, "left").withColumn("corroborated", F.coalesce("_hit", F.lit(False))).drop("_hit")


def adjacent_pairs(chain: Column) -> Column:
    """The (a, b) of neighbours in a chain."""
    n = F.size(chain)
    return F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct(F.get(chain, i).alias("a"), F.get(chain, i + 1).alias("b")))).otherwise(F.array().cast("array<struct<a:bigint,b:bigint>>"))


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """join.b_at, set.dedup_boundary, topk.first_per_fn: the first row of each key."""
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_i = 1").drop("_i")
