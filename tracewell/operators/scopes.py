"""Lexical scopes of brace languages as windows over tokens.

A running sum of the braces is a token's depth. What is bound at a depth lives until the first brace that closes that depth,
or until it is dropped by name; whether something else happens before is then a comparison of places, without a join of
intervals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A string or a comment hides what is in it; the rest are the tokens that matter here.
_TOKEN = (
    r"\"(?:\\.|[^\"\\])*\"|//.*$"
    r"|\blet\s+(?:mut\s+)?\w+\s*(?::[^=;]+)?=[^;]*?[.](?:lock|read|write)[(][)](?:[.]await)?(?:[.](?:unwrap|expect)[(](?:\"[^\"]*\")?[)]|[?])*\s*;"
    r"|\bdrop[(]\s*\w+\s*[)]|\bfn\s+\w+|[.]await\b|[{}]"
)


def tokens(lines: DataFrame, file: str = "file", line: str = "line_no", text: str = "line") -> DataFrame:
    """(file, line, place, token, depth): the tokens of source lines in order, with the depth before each."""
    found = lines.select(file, line, F.posexplode(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))).alias("place", "token")).where("token NOT RLIKE '^(\"|//)'")
    step = F.when(F.col("token") == "{", 1).when(F.col("token") == "}", -1).otherwise(0)
    before = Window.partitionBy(file).orderBy(line, "place").rowsBetween(Window.unboundedPreceding, -1)
    order = F.row_number().over(Window.partitionBy(file).orderBy(line, "place"))
    return found.withColumns({"depth": F.coalesce(F.sum(step).over(before), F.lit(0)), "at": order})


def locks_across_await(lines: DataFrame, file: str = "file", line: str = "line_no", text: str = "line") -> DataFrame:
    """Rule lock-across-await for Rust: (file, function, name, line, await_line) of guards that are held where something is awaited.

    A guard is a name bound to the end of a lock(), read() or write() that is not itself awaited. It is held to the end of its block,
    or until drop(name). Only the first await while it is held is told.
    """
    t = tokens(lines, file, line, text)
    bound = F.col("token").startswith("let") & ~F.col("token").contains(".await")
    name = F.when(bound, F.regexp_extract("token", r"^let\s+(?:mut\s+)?(\w+)", 1)).when(F.col("token").startswith("drop"), F.regexp_extract("token", r"[(]\s*(\w+)", 1))
    above = Window.partitionBy(file).orderBy("at")
    after = above.rowsBetween(1, Window.unboundedFollowing)
    t = t.withColumns(
        {
            "name": name,
            "function": F.last(F.when(F.col("token").startswith("fn"), F.regexp_extract("token", r"(\w+)$", 1)), ignorenulls=True).over(above),
            # the nearest await behind the token
            "_await": F.min(F.when(F.col("token") == ".await", F.struct("at", F.col(line).alias("await_line")))).over(after),
        }
    )
    # a closing brace has the depth that it ends
    in_block = Window.partitionBy(file, "depth").orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    by_name = Window.partitionBy(file, "name").orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    t = t.withColumns({"_end": F.min(F.when(F.col("token") == "}", F.col("at"))).over(in_block), "_drop": F.min(F.when(F.col("token").startswith("drop"), F.col("at"))).over(by_name)})
    held = t.where(bound & F.col("_await").isNotNull()).where((F.col("_await.at") < F.coalesce("_end", F.lit(1 << 60))) & (F.col("_await.at") < F.coalesce("_drop", F.lit(1 << 60))))
    return held.select(file, "function", "name", line, F.col("_await.await_line").alias("await_line"))
