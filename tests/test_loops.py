"""Rounds of the graph loops: tables that are dealt alike meet without an exchange, so a round exchanges only what it offers."""

import duckdb
import pytest

from tracewell.operators import graph
from tracewell.plans import catalogue

N = 14
CHAIN = [(i, i + 1) for i in range(N)]
RING = [*((100 + i, 101 + i) for i in range(N)), (100 + N, 100)]


@pytest.fixture
def exchanges(monkeypatch):
    """The exchanges of each plan that is cut."""
    found, cut = [], graph.cut

    def counted(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        found.append(plan.count("Exchange hashpartitioning") + plan.count("Exchange SinglePartition"))
        return cut(df)

    monkeypatch.setattr(graph, "cut", counted)
    return found


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long")


def nodes(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node long")


def one_exchange_a_round(exchanges, made_once=2):
    assert len(exchanges) > N and sum(n > 1 for n in exchanges) <= made_once


def test_rounds_of_roots(spark, exchanges):
    got = graph.roots(edges(spark, CHAIN), nodes(spark, N)).collect()
    assert [tuple(r) for r in got] == [(N, 0, 0)]
    one_exchange_a_round(exchanges)


def test_first_roots_come_late(spark):
    """Entries that are reached last come first and leave room for so many others only."""
    late = [(1000 + i, 2000) for i in range(3)] + [(2000 + i, 2001 + i) for i in range(6)]
    near = [(i, 2006) for i in range(8)]
    e = edges(spark, late + near).selectExpr("*", "src >= 1000 AND src < 2000 AS src_entry")
    got = sorted((r.place, r.root) for r in graph.roots(e, nodes(spark, 2006)).collect())
    assert got == [(0, 1000), (1, 1001), (2, 1002), (3, 0), (4, 1)]


def test_roots_take_every_edge(spark, tmp_path):
    """Lines of small quantities are calls too, in the query and in its twin."""
    orders = [(1, 2, 3), (4, 2), (11, 3), (5, 6, 5)]
    lines = [(o, n, s, 7 * o + n, float(1 + 9 * n)) for o, suppliers in enumerate(orders) for n, s in enumerate(suppliers, 1)]
    tables = {
        "lineitem": spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_quantity double"),
        "supplier": spark.createDataFrame([(i, i, 1000.0 if i in (3, 6) else 5000.0) for i in range(12)], "s_suppkey long, s_nationkey int, s_acctbal double"),
    }
    con = duckdb.connect()
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = [(3, 1, 1), (3, 4, 2), (3, 11, 0)]
    assert sorted(tuple(r) for r in catalogue.QUERIES["roots"](spark, str(tmp_path)).collect()) == want
    assert sorted(con.sql(catalogue.ORACLES["roots"]).fetchall()) == want


def test_rounds_of_components(spark, exchanges):
    got = graph.components(edges(spark, CHAIN + RING + [(N, 100), (104, 50)])).collect()
    assert {tuple(r) for r in got} == {(100 + i, 100) for i in range(N + 1)}
    one_exchange_a_round(exchanges, 3)  # tables between the three loops, and what was found


def test_rounds_of_worst_and_reach(spark, exchanges):
    own = spark.createDataFrame([(N, 5.0), (3, 9.0), (77, None)], "node long, value double")
    e = edges(spark, CHAIN)
    got = graph.worst(own, e.selectExpr("*", "1 AS w"), lambda _, v: v)
    assert {tuple(r) for r in got.collect()} == {(77, None), *((i, 9.0 if i <= 3 else 5.0) for i in range(N + 1))}
    one_exchange_a_round(exchanges)
    exchanges.clear()
    assert {r.node for r in graph.reach(nodes(spark, N, 88), e).collect()} == {88, *range(N + 1)}
    one_exchange_a_round(exchanges)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
