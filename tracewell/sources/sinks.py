"""Writing results: one Parquet table per relation and the JSON documents made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_relations(relations: dict[str, DataFrame], folder: str) -> None:
    """sink.map, sink.trace, sink.lint, sink.report: each relation replaces its own table; the commit protocol makes it whole or absent."""
    for name, df in relations.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def append_rounds(rounds: DataFrame, folder: str) -> None:
    """sink.ledger: append-only; readers take the latest entry of each key."""
    rounds.write.mode("append").parquet(folder)


def overwrite_tests(tests: DataFrame, folder: str) -> None:
    """sink.repro: the results of the files at hand replace those files' earlier ones, other files stay."""
    tests.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").parquet(folder)


def brief(*columns: str) -> Column:
    """proj.brief: a JSON object of the fields that are not null."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})


def document(df: DataFrame, name: str) -> DataFrame:
    """A relation as one JSON line per row under a name, in the order of its rows' JSON."""
    return df.select(F.lit(name).alias("relation"), F.to_json(F.struct("*")).alias("row"))


def edges_with_names(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """proj.map_json: ids of both ends next to their names."""
    a = functions.select(F.col("id").alias("caller"), F.col("name").alias("caller_name"))
    b = functions.select(F.col("id").alias("callee"), F.col("name").alias("callee_name"))
    return edges.join(a, "caller", "left").join(b, "callee", "left")


def flatten_calls(functions: DataFrame) -> DataFrame:
    """proj.flatten_calls: one row per call; functions without calls keep one row."""
    return functions.select("id", F.posexplode_outer("calls").alias("call_ord", "call"))
