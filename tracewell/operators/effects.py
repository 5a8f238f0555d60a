"""Waits, deadlines and retries: the effect rules over edges, loops and boundaries.

An unknown number of attempts is null, a finite but unknown one is 0; an unbounded wait is infinity and a bounded one of unknown length is marked by wait_kind, never by the number alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INFINITY = float("inf")
#: Retry layers multiply from this product on; it is high from the second.
AMPLIFIES, AMPLIFIES_HIGH = 9, 27


def boundary_wait(timeout: Column, client: Column, default: Column, configured: Column) -> Column:
    """fn.boundary_wait: own timeout, then the client's, then the library's, then configured elsewhere (unknown but bounded), else unbounded."""
    return F.coalesce(timeout, client, default, F.when(configured, F.lit(0.0)), F.lit(INFINITY))


def wait_kind(timeout: Column, client: Column, default: Column, configured: Column) -> Column:
    return F.when(F.coalesce(timeout, client, default).isNotNull(), "known").when(configured, "bounded").otherwise("unbounded")


def bounded(has_timeout: Column, client_level: Column, client_timeout: Column) -> Column:
    """pred.bounded"""
    return has_timeout | (client_level & client_timeout)


def multiply(wait: Column, attempts: Column, backoff: Column) -> Column:
    """Attempts times wait plus the pauses between; a wait of zero stays zero, so infinity never meets it."""
    n = F.when(attempts.isNull(), F.lit(INFINITY)).otherwise(F.greatest(attempts.cast("double"), F.lit(1.0)))
    return F.when(wait <= 0, F.lit(0.0)).when(n == 1, wait).otherwise(wait * n + F.coalesce(backoff, F.lit(0.0)) * F.when(n == INFINITY, F.lit(1.0)).otherwise(n - 1))


def deadline_class(deadline: Column, wait: Column, offloaded: Column, cannot_preempt: Column) -> Column:
    """agg.deadlines"""
    return (
        F.when(cannot_preempt & ~offloaded, "cannot-preempt")
        .when(offloaded & (wait == INFINITY), "abandons-thread")
        .when((wait > deadline) & (wait < INFINITY), "exceeded")
        .otherwise("ok")
    )


def retry_rule(attempts: Column, backoff: Column) -> Column:
    """agg.retries: the rule and severity of one retry site."""
    return F.when(attempts.isNull() & (backoff == "none"), "unbounded-retry/high").when(attempts.isNull(), "unbounded-retry/medium").when(backoff == "none", "retry-without-backoff/medium")


def amplification(attempts: Column, layers: Column) -> Column:
    """Rule retry-amplification."""
    hit = (attempts >= AMPLIFIES) & (attempts < INFINITY) & (layers >= 2)
    return F.when(hit & (attempts >= AMPLIFIES_HIGH), "high").when(hit, "medium")


def retry_only(calls: DataFrame, loops: DataFrame, ids: list[str]) -> DataFrame:
    """pred.retry_only: calls around which there are loops, and all of them retry loops."""
    inside = calls.join(loops, "function").where((F.col("loop_start") <= F.col("line")) & (F.col("line") <= F.col("loop_end")))
    return inside.groupBy(*ids).agg(F.bool_and("retry_like").alias("_all"), F.count("*").alias("loops")).where("_all").drop("_all")


def site_mult(calls: DataFrame, loops: DataFrame, ids: list[str]) -> DataFrame:
    """agg.site_mult: product of the attempts of the retry loops around a line, and the sum of their pauses; null attempts are unbounded."""
    inside = calls.join(loops.where("retry_like"), "function").where((F.col("loop_start") <= F.col("line")) & (F.col("line") <= F.col("loop_end")))
    n = F.greatest(F.col("attempts"), F.lit(1)).cast("double")
    return inside.groupBy(*ids).agg(F.when(F.max(F.col("attempts").isNull()), F.lit(INFINITY)).otherwise(F.round(F.product(n))).alias("mult"), F.sum(F.coalesce("backoff_s", F.lit(0.0))).alias("backoff_s"))


def scaling_depth(loops: DataFrame, key: str) -> DataFrame:
    """agg.max_loop_depth, agg.scaling_depth: deepest nesting by containment of spans."""
    a = loops.select(key, "loop_start", "loop_end", "loop_id")
    b = loops.select(key, F.col("loop_start").alias("_s"), F.col("loop_end").alias("_e"), F.col("loop_id").alias("_o"))
    inside = a.join(b, key).where((F.col("_s") <= F.col("loop_start")) & (F.col("loop_end") <= F.col("_e")))
    return inside.groupBy(key, "loop_id").agg(F.count("*").alias("_n")).groupBy(key).agg(F.max("_n").alias("depth"))


def best_by_leaf(df: DataFrame, leaf: str, value: str, ids: list[str]) -> DataFrame:
    """agg.best_by_leaf: the most amplified row per leaf, the smallest id among equals."""
    return df.groupBy(leaf).agg(F.min(F.struct((-F.col(value)).alias("_v"), *ids)).alias("_b")).select(leaf, *[F.col(f"_b.{i}").alias(i) for i in ids], (-F.col("_b._v")).alias(value))
