"""The queries over all rows, where the queries of the same name are fixed to a share of the ids."""

import math
import random
from collections import defaultdict

import pytest

from tests.oracle import ROOT
from tracewell.operators import graph
from tracewell.plans import catalogue

SF = f"{ROOT}/sf0.001"
WHOLE = sorted(n for n in catalogue.QUERIES if n.endswith("_whole"))
_CUTS = ("ord % 7 = 0", "ord % 5 = 0", "c_custkey % 3 = 0", "l_partkey % 20 = 0", "site % 5 = 0", "l_orderkey % 10 = 0", "o_orderkey % 10 = 0", "c_custkey % 50 = 0", "o_orderkey % 20 = 0", "l_orderkey % 50 = 0", "l_orderkey % 3 = 0", "p_partkey % 40 = 0", "c_custkey % 29 = 0", "l_quantity = 50")


@pytest.mark.parametrize("name", sorted(set(WHOLE) & set(catalogue.ORACLES)))
def test_no_id_filter_is_left(name):
    assert not [c for c in _CUTS if c in catalogue.ORACLES[name]]
    assert catalogue.ORACLES[name] != catalogue.ORACLES[name.removesuffix("_whole")]


def test_queue_holds_every_finding(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert sum(r.n for r in catalogue.QUERIES["score_queue_whole"](spark, SF).collect()) == lines
    assert sum(r.n for r in catalogue.QUERIES["skip_reason_whole"](spark, SF).collect()) == lines


def test_amplification_whole(spark):
    amp, layers = defaultdict(lambda: 1), defaultdict(int)
    for x in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey", "l_linenumber", "l_quantity").collect():
        n = 1 if x.l_quantity >= 48 else 0 if x.l_quantity >= 40 else int(x.l_quantity) % 6
        amp[x.l_linenumber, x.l_suppkey] *= max(n, 1)
        layers[x.l_linenumber, x.l_suppkey] += x.l_quantity < 48 and n >= 2
    best = {}
    for (leaf, f), a in sorted(amp.items()):
        if leaf not in best or a > best[leaf][1]:
            best[leaf] = (f, a)
    got = {r.leaf: r for r in catalogue.QUERIES["amplification_whole"](spark, SF).collect()}
    assert got.keys() == best.keys()
    for leaf, (f, a) in best.items():
        assert got[leaf].function == f and math.isclose(got[leaf].amp, a, rel_tol=1e-9)
        assert got[leaf].severity == ("high" if layers[leaf, f] >= 2 and a >= 27 else "medium" if layers[leaf, f] >= 2 and a >= 9 else None)


def _reached(edges):
    out = defaultdict(set)
    for a in {x for e in edges for x in e[:2]}:
        front = [a]
        while front:
            for s, d, _ in edges:
                if s == front[0] and d not in out[a]:
                    out[a].add(d)
                    front.append(d)
            front.pop(0)
    return out


def _walk(node, own, edges, reached, combine, running=()):
    """The worst value of a node; a call back into a running node gives nothing, one inside a cycle counts once."""
    best = own.get(node)
    for s, d, w in edges:
        if s == node and d not in running and d != node:
            v = _walk(d, own, edges, reached, combine, (*running, node))
            if v is not None:
                v = combine(1 if s in reached[d] else w, v)
                best = v if best is None else max(best, v)
    return best


@pytest.mark.parametrize("seed", range(4))
def test_worst_with_cycles(spark, seed):
    rnd = random.Random(seed)
    edges = [(a, b, rnd.randint(1, 3)) for a in range(9) for b in range(9) if a != b and rnd.random() < 0.17]
    edges += [(1, 7, 3), (7, 8, 2)]  # calls from a smaller to a larger id
    edges = list({e[:2]: e for e in edges}.values())
    own = {8: 5.0, rnd.randint(0, 6): 70.0}
    combine = lambda w, v: min(v, 100.0) * w
    reached = _reached(edges)
    want = {n: v for n in range(9) if (v := _walk(n, own, edges, reached, combine)) is not None}
    from pyspark.sql import functions as F

    e = graph.once_in_cycles(spark.createDataFrame(edges, "src long, dst long, w int"))
    got = graph.worst(spark.createDataFrame(list(own.items()), "node long, value double"), e, lambda w, v: F.least(v, F.lit(100.0)) * w)
    assert {r.node: r.value for r in got.collect()} == want


def test_worst_paths_take_every_edge(spark):
    """Against a plain loop over all edges, by name and to a larger id too."""
    from tracewell.plans.adapters import bnd, edge

    edges = [(x.caller, x.callee, max(x.attempts, 1)) for x in edge(spark, SF, whole=True).collect()]
    reached = _reached(edges)
    b = bnd(spark, SF).collect()
    wait, amp = defaultdict(float), {}
    for x in b:
        wait[x.function] = max(wait[x.function], 60.0 if x.timeout_s is None else x.timeout_s)
        if x.category in ("net", "db"):
            amp[x.function] = 1
    for own, combine, name, column in ((wait, lambda w, v: min(v, 100.0) * w, "wait_worst_whole", "wait_s"), (amp, lambda w, v: v * w, "amp_best_whole", "attempts")):
        now = dict(own)
        for _ in range(len(edges) + 1):
            for s, d, w in edges:
                if d in now:
                    now[s] = max(now.get(s, 0), combine(1 if s in reached[d] else w, now[d]))
        assert {r.node: r[column] for r in catalogue.QUERIES[name](spark, SF).collect()} == now


def test_deadlines_whole(spark):
    """Against a plain loop over every edge."""
    from tracewell.plans.adapters import bnd, edge

    e = [(x.caller, x.callee, x.attempts) for x in edge(spark, SF, whole=True).collect()]
    reached, b = _reached(e), bnd(spark, SF).collect()
    wait = defaultdict(float)
    for x in b:
        wait[x.function] = max(wait[x.function], math.inf if x.timeout_s is None else x.timeout_s)
    for _ in range(len(e) + 1):
        for s, d, n in e:
            if d in wait:
                wait[s] = max(wait[s], wait[d] * (1 if s in reached[d] else max(n, 1)))
    sleeps = {x.function for x in b if x.category == "sleep"}
    stuck = sleeps | {n for n in reached if reached[n] & sleeps}
    want = {}
    for s, d, n in e:
        v = wait.get(d, 0.0)
        if n >= 1:
            want[s, d] = "cannot-preempt" if d in stuck and n != 3 else "abandons-thread" if n == 3 and v == math.inf else "exceeded" if 10 < v < math.inf else "ok"
    assert {(r.caller, r.callee): r.status for r in catalogue.QUERIES["deadlines_whole"](spark, SF).collect()} == want


def test_field_chain_of_twenty(spark):
    from tracewell.operators import detect

    fields = spark.createDataFrame([(f"C{i}", f"f{i}", f"C{i + 1}") for i in range(20)], "cls string, field string, type string")
    chains = [(k, "C0", [f"f{i}" for i in range(k)]) for k in (1, 4, 5, 6, 20)] + [(99, "C0", ["f0", "nothing"])]
    got = detect.field_chain(spark.createDataFrame(chains, "call long, cls string, chain array<string>"), fields)
    assert {r.call: r.type for r in got.collect()} == {k: f"C{k}" for k in (1, 4, 5, 6, 20)}


def test_block_path_of_twenty(spark, monkeypatch):
    from tracewell.plans import graph_queries

    edges = spark.createDataFrame([(i + 1, i, i, 0, 1) for i in range(20)], "caller long, callee long, edge_ord long, by_name int, attempts int")
    monkeypatch.setattr(graph_queries, "edge", lambda *_: edges)
    monkeypatch.setattr(graph_queries, "bnd", lambda *_: spark.createDataFrame([(0, "net")], "function long, category string"))
    got = {r.node: (r.hops, r.boundary) for r in catalogue.QUERIES["block_path_whole"](spark, SF).collect()}
    assert got == {i: (i + 1, 0) for i in range(21)}
