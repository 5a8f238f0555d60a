"""Findings against expected ones, over small relations with known answers."""

from tracewell.operators import scoring
from tracewell.plans import catalogue


def test_eval(spark):
    f = spark.createDataFrame([("a", "r1", "f", "x\\src\\m.py", 3), ("a", "r1", "f", "x/src/m.py", 4), ("a", "r2", "g", "n.py", 1), ("b", "r1", "f", "m.py", 9), ("b", "r3", "h", "m.py", 9)], "case string, rule string, function string, file string, line int")
    want = spark.createDataFrame([("a", 1, "r1", "f", "src/m.py", None), ("a", 2, "r1", "f", "src/m.py", 4), ("a", 3, "r1", "f", "src/m.py", 5), ("a", 4, "r2", "g", "o.py", None), ("b", 5, "r1", "f", "src/m.py", None)], "case string, want int, rule string, function string, file string, line int")
    bad = spark.createDataFrame([("b", "r3", "h"), ("a", "r3", "h"), ("a", "r2", "g")], "case string, rule string, function string")
    assert {r.want: r.found for r in scoring.eval_match(f, want).collect()} == {1: True, 2: True, 3: False, 4: False, 5: False}
    assert {tuple(r) for r in scoring.score_eval(f, want, bad).collect()} == {("r1", 4, 2, 0.5, 0), ("r2", 1, 0, 0.0, 1), ("r3", 0, 0, None, 1)}


def test_bench(spark):
    f = spark.createDataFrame([("b1", "r", "f", "m.py", 1), ("b1", "r", "f", "m.py", 2), ("b2", "r", "g", "a\\m.py", 3), ("x2", "r", "g", "a/m.py", 4), ("b3", "r", "h", "x/m.py", 5), ("clean", "r", "f", "m.py", 6)], "sample string, rule string, function string, file string, id long")
    cases = spark.createDataFrame([(1, "b1", "x1", "r", "f", "m.py"), (2, "b2", "x2", "r", "g", "a/m.py"), (3, "b3", "x3", "r", "h", "m.py")], "id int, buggy_sample string, fixed_sample string, rule string, function string, file string")
    assert {tuple(r) for r in scoring.score_bench(f, cases).collect()} == {(1, 2, 0, True, True, False), (2, 1, 1, True, False, True), (3, 0, 0, False, False, False)}
    controls = spark.createDataFrame([(1, "clean", "r", "f", "m.py"), (2, "clean", "r", "g", "m.py")], "id int, sample string, rule string, function string, file string")
    assert {tuple(r) for r in scoring.control_hits(f, controls).collect()} == {(1, 1), (2, 0)}
    mixed = cases.withColumnRenamed("buggy_sample", "sample")
    queue = spark.createDataFrame([(1, 9), (2, 3), (4, 2), (4, 1)], "item int, finding long")
    assert {(r.k, r.covered, round(r.recall, 3)) for r in scoring.top_k(f, mixed, queue, [1, 2, 5]).collect()} == {(1, 0, 0.0), (2, 1, 0.333), (5, 2, 0.667)}


def test_generic_names_and_slots(spark):
    calls = spark.createDataFrame([(1, "get"), (2, "fetch_orders"), (3, "__init__")], "call int, name string")
    assert [r.call for r in scoring.by_name(calls).collect()] == [2]
    led = lambda *n: spark.createDataFrame([(i + 1, k) for i, m in enumerate(n) for k in range(m)], "round int, item int")
    assert [tuple(scoring.round_slots(led(*n)).first()) for n in ((), (6,), (6, 6), (6, 6, 2))] == [(1, 15, 6), (2, 9, 6), (3, 3, 3), (4, 1, 0)]


def test_queries_claim_only_what_they_do():
    for name, claims in (("bench_coverage", ("join.bench_match", "agg.score_bench", "src.corpus")), ("eval_recall", ("join.eval_match", "agg.score_eval")), ("visible", ("pred.common_method",)), ("take", ("win.round_slots",))):
        assert not [c for c in claims if c in catalogue.QUERIES[name].__doc__]
