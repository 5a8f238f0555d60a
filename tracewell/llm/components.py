"""Connected components of an edge table by alternating star contraction.

Both kinds of step are one grouping and one join of the edge table with itself; a
round cuts lineage with a reliable checkpoint. Nothing is collected but two
counts per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut

#: Edges in one part of a round's table.
PART_ROWS = 100_000


def _toward_least(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Links each neighbour of u to the least of u's neighbourhood: the larger neighbours, or the smaller ones and u."""
    both = edges.select(F.col("u").alias("v"), F.col("v").alias("u")).unionByName(edges) if larger_only else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # grouped by more than the join's key, so that the join exchanges both sides and Spark can split the edges of a hub among tasks
    least = both.groupBy("u", F.bitwise_not(F.col("u")).alias("_w")).agg(F.least(F.min("v"), F.col("u")).alias("m")).drop("_w")
    near = both.join(least, "u")
    if larger_only:
        out = near.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) of comparable ids -> (id, least): every id that has an edge, with the smallest id of its component."""
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark, rows = None, now.count()
    while True:
        # a small table in few parts: the rounds' files, not their rows, would be the cost
        now = cut(_toward_least(_toward_least(now, True), False).coalesce(rows // PART_ROWS + 1))
        row = now.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
        if (row["n"], row["h"]) == mark:
            break
        mark, rows = (row["n"], row["h"]), row["n"]
    stars = now.groupBy("u").agg(F.min("v").alias("least")).withColumnRenamed("u", "id")
    return stars.unionByName(stars.select(F.col("least").alias("id"), "least").distinct())
