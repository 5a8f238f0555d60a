"""Every query of the engine by name, with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def whole(f: Query, *cuts: str, twin: bool = True) -> None:
    """Registers f over all rows as <f>_whole; its twin is f's without the id filters in `cuts`."""
    name = f"{f.__name__}_whole"
    QUERIES[name] = lambda spark, sf: f(spark, sf, whole=True)
    QUERIES[name].__name__ = name
    sql = ORACLES[f.__name__]
    for c in cuts:
        assert c in sql, (name, c)
        sql = sql.replace(f" WHERE {c} AND ", " WHERE ").replace(f" AND {c}", "").replace(f" WHERE {c}", "")
    if twin:
        ORACLES[name] = sql


from . import boundary_queries, detect_queries, effect_queries, graph_queries, join_queries, rank_queries, rule_queries, source_queries, trace_queries, window_queries  # noqa: E402, F401
