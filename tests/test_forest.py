"""Forests by pointer jumping, roots, and ways of asynchronous functions, against plain loops."""

import random
from collections import deque

from pyspark.sql import functions as F

from tracewell.operators import forest, graph

TREE = "id long, parent long, fn string, n long"


def trees(seed, n=120):
    r = random.Random(seed)
    rows = [(i, r.choice([None, *range(max(0, i - 12), i)]) if i else None, r.choice("abcd"), r.randrange(100)) for i in range(n)]
    return [*rows, (500, 9999, "a", 3), (501, 500, "a", 1), (600, 601, "a", 1), (601, 600, "a", 2), (602, 600, "b", 1)]  # an unknown parent, and a circle


def above(rows):
    by = {i: p for i, p, *_ in rows}
    out = {}
    for i in by:
        path, at = [], by[i]
        while at in by and len(path) < len(by):
            path.append(at)
            at = by[at]
        out[i] = path if len(path) < len(by) else None  # a circle
    return out


def test_values_from_above(spark):
    for seed in (1,):
        rows = trees(seed)
        df, up = spark.createDataFrame(rows, TREE), above(rows)
        fn, n = {r[0]: r[2] for r in rows}, {r[0]: r[3] for r in rows}
        whole = {i: p for i, p in up.items() if p is not None}
        assert dict(map(tuple, forest.depths(df).collect())) == {i: len(p) for i, p in whole.items()}
        assert dict(map(tuple, forest.upstream(df, F.col("n")).collect())) == {i: max(n[a] for a in p) for i, p in whole.items() if p}
        owner = {i: next((a for a in p if fn[a] in "ab"), None) for i, p in whole.items()}
        got = dict(map(tuple, forest.nearest(df, F.col("fn").isin("a", "b")).collect()))
        # below a circle an owner may be found before the circle is met
        assert {i: a for i, a in got.items() if i in whole} == {i: a for i, a in owner.items() if a is not None}
        assert {r.id: (r.depth, r.stack) for r in forest.stacks(df, F.col("fn")).collect()} == {i: (len(p), ">".join(fn[a] for a in reversed(p))) for i, p in whole.items()}


def test_values_from_below(spark):
    for seed in (3,):
        rows = trees(seed)
        df, up = spark.createDataFrame(rows, TREE), above(rows)
        whole = {i for i, p in up.items() if p is not None}
        fn, n = {r[0]: r[2] for r in rows}, {r[0]: r[3] for r in rows}
        under = {i: [j for j in whole if i in up[j]] for i in whole}
        assert dict(map(tuple, forest.below(df, F.col("n")).collect())) == {i: n[i] + sum(n[j] for j in under[i]) for i in whole}
        want = {i: sum(fn[j] == "b" for j in under[i]) for i in whole if fn[i] == "a"}
        assert dict(map(tuple, forest.descendants(df, F.col("fn") == "a", F.col("fn") == "b").collect())) == {i: k for i, k in want.items() if k}
        depth = {}
        for i in whole:
            depth[fn[i]] = max(depth.get(fn[i], 0), 1 + sum(fn[a] == fn[i] for a in up[i]))
        assert dict(map(tuple, forest.nesting(df, "fn").collect())) == {f: d for f, d in depth.items() if d > 1}
        walk = {r.id: r for r in forest.preorder(df).collect()}
        assert set(walk) == whole
        for i in whole:
            assert walk[i].top == (up[i][-1] if up[i] else i) and walk[i].size == 1 + len(under[i])
            held = {j for j in whole if walk[j].top == walk[i].top and walk[i].pre <= walk[j].pre < walk[i].pre + walk[i].size}
            assert held == {i, *under[i]}


def test_a_chain_of_many_activations(spark):
    n = 100_000
    chain = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.when(F.col("id") % 1000 == 0, "m").otherwise("x").alias("fn"))
    row = forest.depths(chain).agg(F.sum("depth").alias("s"), F.max("depth").alias("m")).first()
    assert (row.s, row.m) == (n * (n - 1) // 2, n - 1)
    owner = forest.nearest(chain, F.col("fn") == "m")
    assert owner.where(F.col("owner") != F.floor((F.col("id") - 1) / 1000) * 1000).count() == 0 and owner.count() == n - 1


def plain_roots(edges, target, entries, top=5):
    callers = {}
    for s, d in edges:
        callers.setdefault(d, set()).add(s)
    hops, q = {target: 0}, deque([target])
    while q:
        at = q.popleft()
        for c in callers.get(at, ()):
            if c not in hops:
                hops[c] = hops[at] + 1
                q.append(c)
    found = sorted((c not in entries, h, c) for c, h in hops.items() if c != target and c not in callers)
    return [c for *_, c in found[:top]]


def test_roots_with_ties_and_cycles(spark):
    for seed in (1, 2):
        r = random.Random(seed)
        edges = {(r.randrange(60), r.randrange(10, 60)) for _ in range(110)}  # ten nodes are never called; cycles and loops among the rest
        entries = {0, 3, 7}
        targets = sorted({d for _, d in edges})[:25] + [0, 77]
        e = spark.createDataFrame([(s, d, s in entries) for s, d in edges], "src long, dst long, src_entry boolean")
        got = {}
        for x in graph.roots(e, spark.createDataFrame([(t,) for t in targets], "node long"), 3).orderBy("target", "place").collect():
            got.setdefault(x.target, []).append(x.root)
        want = {t: plain_roots(edges, t, entries, 3) for t in targets}
        assert got == {t: w for t, w in want.items() if w} and any(len(w) == 3 for w in want.values())


def test_async_ways(spark):
    for seed in (1, 2):
        r = random.Random(seed)
        n = 50
        calls = sorted({(r.randrange(n), r.randrange(n), r.randrange(12)) for _ in range(110)})
        direct = sorted({(r.randrange(n), r.randrange(12)) for _ in range(6)})
        is_async = {i: i % 2 == 0 for i in range(n)}
        # synchronous functions that block, with a next one nearer to the boundary
        rank, via = {i: 0 for i, _ in direct if not is_async[i]}, {}
        while True:
            new = {}
            for s, d, line in calls:
                if not is_async[s] and not is_async[d] and s not in rank and d in rank:
                    new.setdefault(s, []).append((line, d))
            if not new:
                break
            for s, ways in new.items():
                rank[s], via[s] = 1, min(ways)[1]
        # rounds over the asynchronous ones; the first call by line whose callee was found before
        found, ways = {}, {}
        k = 0
        while True:
            new = {}
            for i in range(n):
                if is_async[i] and i not in found:
                    options = [(line, False, -1) for j, line in direct if j == i and k == 0]
                    for s, d, line in calls:
                        if s == i and ((not is_async[d] and d in rank and k == 0) or (is_async[d] and d in found)):
                            options.append((line, True, d))
                    if options:
                        new[i] = min(options)
            if not new:
                break
            k += 1
            for i, (_, call, d) in new.items():
                found[i] = d if call else None
        def way(i):
            nxt = found[i] if is_async[i] else via.get(i)
            return [i] if nxt is None else [i, *way(nxt)]

        want = {i: way(i) for i in found}
        f = spark.createDataFrame(list(is_async.items()), "node long, is_async boolean")
        blocks = spark.createDataFrame([(i, via.get(i)) for i in rank], "node long, via long")
        c = spark.createDataFrame(calls, "src long, dst long, line long")
        got = graph.async_blocks(f, spark.createDataFrame(direct, "node long, line long"), c, blocks)
        assert {x.node: x.path for x in got.collect()} == want and len(want) > 2
        ended = graph.cannot_preempt(c.withColumn("offloaded", F.col("line") % 2 == 0), f, blocks, got)
        for x in ended.collect():
            held = want.get(x.dst) if is_async[x.dst] else (way(x.dst) if x.dst in rank else None)
            assert x.path == (None if x.line % 2 == 0 else held)
