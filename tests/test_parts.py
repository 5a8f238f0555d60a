"""What a task holds stays the same as tables grow: parts follow the rows, or the pairs that a join makes."""

import json
import re

import duckdb
import pandas as pd
import pytest

from tests.oracle import ROOT, compare
from tracewell.operators import boundaries, parts
from tracewell.plans import catalogue
from tracewell.plans.boundary_queries import SAMPLES
from tracewell.sources import otlp


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["chrome_pairs", "evented_pairs", "sibling_self_time", "speedscope_evented"])
def test_pairs_take_one_exchange_of_as_many_parts_as_there_are_rows(spark, monkeypatch, name):
    monkeypatch.setattr(parts, "ROWS_A_PART", 500)
    rows = spark.read.parquet(f"{ROOT}/sf0.001/lineitem.parquet").count()
    dealt = re.findall(r"hashpartitioning\(.*?, (\d+)\)", plan(catalogue.QUERIES[name](spark, f"{ROOT}/sf0.001")))
    assert dealt == [str(parts.parts_of(rows))]


@pytest.mark.parametrize("name, least", [("chrome_calls", 1), ("profile_kinds", 3), ("batches_first_fit", 4)])
def test_recordings_and_findings_are_dealt_by_their_rows(spark, monkeypatch, name, least):
    monkeypatch.setattr(parts, "ROWS_A_PART", 500)
    assert plan(catalogue.QUERIES[name](spark, f"{ROOT}/sf0.001")).count("REPARTITION_BY_NUM") >= least


@pytest.mark.parametrize("name", ["chrome_pairs", "sibling_self_time", "chrome_calls", "profile_kinds", "by_function_whole"])
def test_small_parts_give_the_same_rows(spark, monkeypatch, name):
    monkeypatch.setattr(parts, "ROWS_A_PART", 2_000)
    compare(spark, catalogue.QUERIES[name], catalogue.ORACLES[name], "sf0.001")


@pytest.mark.parametrize("name", ["visible_whole", "path_warn"])
def test_pairs_of_few_rows_are_spread(spark, monkeypatch, name):
    monkeypatch.setattr(parts, "PAIRS_A_PART", 100)
    found = catalogue.QUERIES[name](spark, f"{ROOT}/sf0.01")
    sizes = found.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
    assert len(sizes) >= sum(sizes) // 100 and max(sizes) <= max(3_000, 4 * sum(sizes) // len(sizes))


def test_pairs_of_like_rows_take_little_disk(spark, tmp_path):
    """Columns pack what is made list by list."""
    catalogue.QUERIES["visible_whole"](spark, f"{ROOT}/sf0.1").write.parquet(f"{tmp_path}/out")
    made = sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    assert made < 0.8 * spark.read.parquet(f"{tmp_path}/out").count()


def test_pairs_are_unfolded_in_a_step_of_their_own(spark):
    """Compiled as one step with the join, a task would hold what one row of it makes with all others."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = plan(catalogue.QUERIES["visible_whole"](spark, f"{ROOT}/sf0.001"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    steps = [re.search(rf"\*\((\d+)\) {x}", found)[1] for x in ("Generate explode\\(c_custkey", "BroadcastHashJoin \\[nation")]
    assert steps[0] != steps[1]


@pytest.mark.parametrize("most", [8, 256])
def test_lists_lose_no_pair(spark, monkeypatch, tmp_path, most):
    """Null, negative and repeated keys, nations without one side, and one nation with nearly all."""
    monkeypatch.setattr(parts, "VALUES_A_LIST", most)
    nation = lambda i: None if i % 17 == 0 else i % 5 if i % 7 == 0 else 3
    key = lambda i: None if i % 13 == 0 else i - 40 if i % 11 else 7
    con = duckdb.connect()
    for name, at, n in (("supplier", "s", 90), ("customer", "c", 2_500)):
        rows = [(key(i), nation(i) if i % 19 else (8 if at == "s" else 9)) for i in range(n)]
        spark.createDataFrame(rows, f"{at}_{'supp' if at == 's' else 'cust'}key long, {at}_nationkey int").write.parquet(f"{tmp_path}/{name}.parquet")
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    for q in ("visible", "visible_whole"):
        got = catalogue.QUERIES[q](spark, str(tmp_path)).groupBy("cand", "caller").count().collect()
        want = con.sql(f"select cand, caller, count(*) from ({catalogue.ORACLES[q]}) group by all").fetchall()
        assert {tuple(r) for r in got} == set(want) and (q == "visible" or any(r.caller is None for r in got))


@pytest.mark.parametrize("name", ["supplier", "customer"])
def test_pairs_with_an_empty_side(spark, tmp_path, name):
    for t in ("supplier", "customer"):
        df = spark.read.parquet(f"{ROOT}/sf0.001/{t}.parquet")
        (df.limit(0) if t == name else df).write.parquet(f"{tmp_path}/{t}.parquet")
    assert catalogue.QUERIES["visible_whole"](spark, str(tmp_path)).count() == 0


def test_spans_leave_a_worker_in_bounded_batches():
    class Files:
        def select(self, *_):
            return self

        def mapInPandas(self, run, _):
            return run

    span = {"traceId": "0" * 32, "spanId": "1" * 16, "name": "x", "startTimeUnixNano": "1", "endTimeUnixNano": "2"}
    body = json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [span] * 700}]}]}).encode()
    files = pd.DataFrame({"path": [f"f{i}" for i in range(20)], "content": [body] * 19 + [b"{"]})
    sizes = [len(x) for x in otlp.bodies(Files())(iter([files]))]
    assert sum(sizes) == 19 * 700 + 1 and max(sizes) <= 4_096


def test_a_list_is_a_trace_whatever_it_holds(spark):
    from pyspark.sql import functions as F

    from tracewell.sources.recordings import profile_kind

    docs = {'[{"nodes": 1, "samples": 2}]': "chrome", ' [{"ph":"B"},': "chrome", '{"traceEvents": []}': "chrome", '{"nodes": [], "samples": []}': "cpuprofile", '{"nodes": null, "samples": []}': None, '{"nodes": [], "samples": [': None, '{"shared": {}, "profiles": []}': "speedscope", '{"result": []}': "coverage", "": None}
    got = spark.createDataFrame([(d,) for d in docs], "value string").select("value", profile_kind(F.col("value")).alias("k")).collect()
    assert {r.value: r.k for r in got} == docs


def test_rules_are_tried_once_for_calls_that_look_alike(spark):
    lang, path, kind, receiver, receiver_type, awaited, lib, *_ = SAMPLES[3]
    calls = spark.range(2_000).selectExpr("id", f"'{lang}' AS lang", "cast(id as string) AS file", f"'{path}' AS path", "'get' AS name", f"'{kind}' AS call_kind", f"'{receiver}' AS receiver", "cast(null as string) AS receiver_type", "true AS awaited")
    found = boundaries.classify(calls, calls.where("id % 2 = 0").selectExpr("file", f"'{lib}' AS imported"), ["id"])
    assert not re.search(r"RLIKE\((path|name|receiver|receiver_type)#", found._jdf.queryExecution().optimizedPlan().toString())
    assert found.count() == 1_000 and found.where("id % 2 = 1").count() == 0
