"""How many parts a table is dealt into, so that what a task holds stays the same as tables grow."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a part that is sorted or grouped, and pairs of a part that is joined with itself or another.
ROWS_A_PART, PAIRS_A_PART = 100_000, 10_000_000

#: Values of a list that is set against other lists.
VALUES_A_LIST = 256


def parts_of(rows: int, most: int | None = None) -> int:
    return -(-rows // (most or ROWS_A_PART))


def dealt(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """df dealt by its keys into so many parts; where the session's own number of parts is enough, as it is."""
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def pairs_between(a: DataFrame, b: DataFrame, keys: list[str]) -> int:
    """The number of pairs that a join on the keys makes, from the counts of the keys."""
    n = a.groupBy(*keys).agg(F.count("*").alias("_rows_a")).join(b.groupBy(*keys).agg(F.count("*").alias("_rows_b")), keys)
    return int(n.agg(F.sum(F.col("_rows_a").cast("double") * F.col("_rows_b"))).first()[0] or 0)


def parts_of_pairs(df: DataFrame, pairs: int) -> int:
    """Parts for a join that makes so many pairs: rows are few where a key has many partners, so their bytes say nothing of the work."""
    return max(df.sparkSession.sparkContext.defaultParallelism, parts_of(pairs, PAIRS_A_PART))


def listed(df: DataFrame, keys: list[str], value: str, most: int | None = None) -> DataFrame:
    """(keys, value): the values of like keys, nulls too, as ordered lists of `most` and what is left over.

    Pairs that are made list by list and unfolded at last repeat the one value and the run of the others, which columns pack into a small part of what
    pairs in any order take, the smaller if `most` is a multiple of eight.
    """
    most = most or VALUES_A_LIST
    n = df.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.ceil(F.count("*") / (16 * most)).alias("_n"))
    alike = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    some = df.join(F.broadcast(n), alike).groupBy(*keys, F.pmod(F.xxhash64(value), F.col("_n")).alias("_some"))
    # a list of lists keeps the nulls
    long = some.agg(F.sort_array(F.flatten(F.collect_list(F.array(value)))).alias("_v"))
    lists = F.transform(F.sequence(F.lit(1), F.size("_v"), F.lit(most)), lambda at: F.slice("_v", at, most))
    return long.select(*keys, F.explode(lists).alias(value))
