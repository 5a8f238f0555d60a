import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import effects, graph, intervals, islands, rank, resolve, rules, stats


def closure_of(edges):
    out = set(edges)
    while True:
        new = {(a, d) for a, b in out for c, d in out if b == c} - out
        if not new:
            return out
        out |= new


@pytest.fixture(scope="module")
def edges(spark):
    r = random.Random(3)
    e = sorted({(r.randrange(18), r.randrange(18)) for _ in range(26)} - {(i, i) for i in range(18)})
    return e, spark.createDataFrame(e, "src long, dst long")


def test_closure_and_components(edges):
    e, df = edges
    c = closure_of(e)
    assert {tuple(r) for r in graph.closure(df).collect()} == c
    want = {a: min([d for x, d in c if x == a and (d, a) in c]) for a, b in c if (b, a) in c}
    assert dict(map(tuple, graph.components(df).collect())) == want


@pytest.mark.parametrize("seed", range(3))
def test_components_in_rows_with_loops_and_nulls(spark, seed):
    """Rings in a row, each calling the next or the one before, nodes that only call themselves, and edges without an end."""
    r = random.Random(seed)
    names = r.sample(range(100), 30)
    e = {(names[k], names[k + 1 if (k + 1) % 5 else k - 4]) for k in range(30)}
    e |= {(names[k], names[k + 5]) if seed else (names[k + 5], names[k]) for k in range(0, 25, 5)}
    e |= {(200, names[0]), (names[7], 201), (201, 201), (202, 202)}
    c = closure_of(e)
    want = {a: min([d for x, d in c if x == a and (d, a) in c]) for a, b in c if (b, a) in c}
    df = spark.createDataFrame([*e, *list(e)[:3], (None, 5), (5, None)], "src long, dst long")
    assert dict(map(tuple, graph.components(df).collect())) == want
    assert len(set(want.values())) == 8
    assert graph.components(df.where("src = 200")).count() == 0
    assert graph.components(df.where("src = -1")).count() == 0


def test_reach_and_roots(spark, edges):
    e, df = edges
    c = closure_of(e)
    got = {r.node for r in graph.reach(spark.createDataFrame([(3,)], "node long"), df).collect()}
    assert got == {3} | {a for a, b in c if b == 3}
    assert graph.reach(spark.createDataFrame([], "node long"), df).count() == 0


def test_ancestors(spark):
    rows = [(i, i - 1 if i % 7 else None) for i in range(1, 30)]
    got = {tuple(r) for r in graph.ancestors(spark.createDataFrame(rows, "id long, parent long")).collect()}
    up, want = dict(rows), set()
    for i in up:
        d, p = 1, up[i]
        while p is not None:
            want.add((i, p, d))
            p, d = up.get(p), d + 1
    assert got == want


def test_worst_with_infinity(spark):
    e = spark.createDataFrame([(3, 2, 2), (2, 1, 3), (4, 3, 1)], "src long, dst long, w long")
    v = spark.createDataFrame([(1, 5.0)], "node long, value double")
    assert dict(map(tuple, graph.worst(v, e, lambda w, x: x * w).collect())) == {1: 5.0, 2: 15.0, 3: 30.0, 4: 30.0}


def test_witnesses(spark):
    start = spark.createDataFrame([(1, 0, None, None)], "node long, rank int, via long, edge_ord long")
    e = spark.createDataFrame([(2, 1, 7), (3, 2, 8), (2, 3, 9), (4, 3, 10)], "src long, dst long, edge_ord long")
    best = graph.improve(start, e)
    assert {r.node: r.rank for r in best.collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    assert {r.node: r.path for r in graph.witness_paths(best).collect()} == {1: [1], 2: [2, 1], 3: [3, 2, 1], 4: [4, 3, 2, 1]}


def test_p95_exclusive(spark):
    rows = [("a", float(v)) for v in (1, 2, 3, 10)] + [("b", 4.0)] + [("c", float(v)) for v in range(1, 41)]
    got = {r.k: r.p95 for r in stats.p95_exclusive(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    import statistics

    assert got["a"] == pytest.approx(15.25)
    assert got["b"] == 4.0
    assert got["c"] == pytest.approx(statistics.quantiles(range(1, 41), n=20)[-1])


def test_fit_power(spark):
    rows = [("f", n, 1e-7 * n * n) for n in (10, 100, 1000, 3000) for _ in range(3)] + [("g", n, 0.5) for n in (1, 2, 3)]
    got = stats.fit_power(spark.createDataFrame(rows, "fn string, n long, dur double"), ["fn"]).collect()
    assert [(r.fn, r.exponent, r.r2) for r in got] == [("f", 2.0, 1.0)]
    p = stats.projections(spark.createDataFrame(got), F.lit(50_000)).first()
    assert 200 < p.predicted_s < 300 and p.risk


def test_enclosing_and_slack(spark):
    ranges = spark.createDataFrame([("f", 1, 1, 100), ("f", 2, 10, 20), ("f", 3, 26, 30)], "file string, fn int, start int, end int")
    pts = spark.createDataFrame([("f", 15), ("f", 22), ("f", 200)], "file string, line int")
    got = {r.line: r.fn for r in intervals.enclosing_smallest(pts, ranges, "file", "line", ["file", "line"]).collect()}
    assert got == {15: 2, 22: 1}
    got = {r.line: r.fn for r in intervals.slack_asof(pts, ranges.where("fn > 1"), "file", "line", ["file", "line"]).collect()}
    assert got == {15: 2, 22: 3}


def test_overlaps_equal_brute_force(spark):
    r = random.Random(1)
    a = [(1, r.randrange(500), 0) for _ in range(40)]
    a = [(k, s, s + r.randrange(90)) for k, s, _ in a]
    b = [(1, s := r.randrange(500), s + r.randrange(200), i, i) for i in range(40)]
    x, y = spark.createDataFrame(a, "k long, w0 long, w1 long"), spark.createDataFrame(b, "k long, start long, end long, id long, depth long")
    got = sorted(map(tuple, intervals.overlaps(x, y, "k", 50).select("w0", "w1", "id").collect()))
    assert got == sorted((w0, w1, i) for _, w0, w1 in a for _, s, e, i, _ in b if w0 <= e and s <= w1)


def test_suffix_and_qualname(spark):
    paths = spark.createDataFrame([("/w/app/x.py",), ("lib/x.py",), ("none.py",)], "path string")
    files = spark.createDataFrame([("x.py",), ("app/x.py",)], "file string")
    assert {r.path: r.file for r in intervals.longest_suffix(paths, files, "path", "file").collect()} == {"/w/app/x.py": "app/x.py", "lib/x.py": "x.py"}
    defs = spark.createDataFrame([("a.b.c",), ("z.b.c",), ("q.r",)], "qual string")
    names = spark.createDataFrame([("b.c",), ("r",), ("a.b.c",)], "name string")
    assert {r.name: r.resolved for r in intervals.unique_name(names, defs, "name", "qual").collect()} == {"b.c": None, "r": "q.r", "a.b.c": "a.b.c"}


def test_tiers_and_caps(spark):
    rows = [(1, "a", 0), (1, "b", 1), (2, "c", 1), (2, "d", 1)] + [(3, f"x{i}", 2) for i in range(5)]
    got = resolve.resolve_tiered(spark.createDataFrame(rows, "call long, cand string, t int"), ["call"], F.col("t"))
    assert sorted((r.call, r.cand, r.n_candidates) for r in got.collect()) == [(1, "a", 1), (2, "c", 2), (2, "d", 2)]


def test_islands(spark):
    rows = [("l", t, i, i == 3) for i, t in enumerate((0, 10, 20, 30, 40, 1000))]
    df = spark.createDataFrame(rows, "log string, t long, ord long, idle boolean")
    assert sorted((r.samples, r.start, r.end) for r in islands.busy_stretches(df, "log", ["t", "ord"], "idle", "t").collect()) == [(2, 40, 1000), (3, 0, 20)]
    g = islands.heartbeat_gaps(df, "log", "t", ["t"], 500).collect()
    assert [(r.w0, r.w1, r.excess) for r in g] == [(40, 1000, 950.0)]
    two = df.where("t < 20")
    assert islands.heartbeat_gaps(two, "log", "t", ["t"], 0).count() == 0
    s = spark.createDataFrame([("a", 0, 10), ("a", 5, 12), ("a", 12, 20)], "k string, start long, end long")
    assert islands.sweep(s, "k").first().peak == 2


def test_segments_drop_what_deeper_ones_explain(spark):
    rows = [("t", 1, "outer", 1, t) for t in range(0, 100, 2)] + [("t", 1, "inner", 2, t) for t in range(0, 90, 2)] + [("t", 2, "outer", 1, t) for t in range(0, 60, 2)]
    df = spark.createDataFrame(rows, "log string, stretch int, fn string, depth int, t long")
    got = sorted((r._k, r.fn) for r in islands.segment_stalls(df, "log", "stretch", "fn", "depth", "t", 50, 5).collect())
    assert got == [("t/1", "inner"), ("t/2", "outer")]


def test_effect_rules(spark):
    inf = float("inf")
    one = spark.range(1).select(
        effects.multiply(F.lit(10.0), F.lit(4), F.lit(0.0)).alias("a"),
        effects.multiply(F.lit(0.0), F.lit(None).cast("int"), F.lit(0.0)).alias("b"),
        effects.multiply(F.lit(10.0), F.lit(None).cast("int"), F.lit(0.0)).alias("c"),
        effects.multiply(F.lit(10.0), F.lit(0), F.lit(1.0)).alias("d"),
        effects.deadline_class(F.lit(2.0), F.lit(50.0), F.lit(False), F.lit(False)).alias("e"),
        effects.deadline_class(F.lit(2.0), F.lit(inf), F.lit(True), F.lit(True)).alias("f"),
        effects.deadline_class(F.lit(2.0), F.lit(inf), F.lit(False), F.lit(False)).alias("g"),
        effects.amplification(F.lit(12.0), F.lit(2)).alias("h"),
        effects.amplification(F.lit(12.0), F.lit(1)).alias("i"),
        effects.retry_rule(F.lit(None).cast("int"), F.lit("none")).alias("j"),
    ).first()
    assert tuple(one) == (40.0, 0.0, inf, 10.0, "exceeded", "abandons-thread", "ok", "medium", None, "unbounded-retry/high")


def test_first_fit():
    assert [b for _, b in rank.first_fit([(1, 10)] * 7)] == [0] * 6 + [1]
    assert [b for _, b in rank.first_fit([(1, 7000), (1, 7000), (1, 4000)])] == [0, 1, 0]
    assert [b for _, b in rank.first_fit([(13, 1), (13, 1)])] == [0, 1]


def test_batches_equal_plain_loop(spark):
    rows = [("a" if i % 3 else "b", i, 1 + i % 9, 100 * (i % 40)) for i in range(60)]
    df = spark.createDataFrame(rows, "file string, function long, findings long, chars long")
    got = {(r.file, r.function): r.batch for r in rank.batches(df, ["file"], "function").collect()}
    for f in "ab":
        own = sorted(r for r in rows if r[0] == f)
        assert [got[r[0], r[1]] for r in own] == [b for _, b in rank.first_fit([r[2:] for r in own])]


SNIPPETS = {
    "unbounded-channel": ("let (tx, rx) = unbounded_channel();", "let (tx, rx) = channel(8);"),
    "wallclock-interval": ("took = time.time() - start", "took = time.monotonic() - start"),
    "redos-regex": ("P = re.compile(r'(a+)+$')", "P = re.compile(r'a+$')"),
    "unbounded-query": ("rows = db.execute('SELECT x FROM t')", "rows = db.execute('SELECT x FROM t LIMIT 5')"),
    "fire-and-forget-task": ("    asyncio.create_task(work())", "    t = asyncio.create_task(work())"),
    "sql-injection": ("cur.execute(f\"DELETE FROM t WHERE id={x}\")", "cur.execute('DELETE FROM t WHERE id=?', (x,))"),
    "unbounded-concurrency": ("await asyncio.gather(*[f(x) for x in xs])", "await asyncio.gather(a(), b())"),
    "unbounded-threads": ("threading.Thread(target=f).start()", "pool.submit(f)"),
    "uncommitted-write": ("db.execute('INSERT INTO t VALUES (1)')", "db.execute('SELECT 1 FROM t WHERE id = 1')"),
}


@pytest.mark.parametrize("rule", sorted(SNIPPETS))
def test_rule_and_clean_twin(spark, rule):
    bad, clean = SNIPPETS[rule]
    df = spark.createDataFrame([(1, f"x = 1\n# {bad}\n{bad}\n{bad}"), (2, clean), (3, bad + " " * 400)], "doc_id long, text string")
    hits = rules.first_hits(rules.code_lines(df), rules.SOURCE_RULES, ["doc_id"]).where(F.col("rule") == rule).collect()
    assert [(h.doc_id, h.line_no) for h in hits] == [(1, 3)]


def test_jitter(spark):
    one = spark.range(1).select(rules.backoff_without_jitter(F.lit("for attempt in r: delay *= 2; retry()")).alias("a"), rules.backoff_without_jitter(F.lit("retry; delay *= 2; jitter()")).alias("b")).first()
    assert tuple(one) == (True, False)


@pytest.mark.parametrize(
    "count, idle, run, pid, paired, stalls",
    [(1, False, "r", 1, True, 1), (2, False, "r", 1, True, 2), (None, False, "r", 1, True, 2), (1, True, "r", 1, True, 2), (1, False, "other", 1, True, 2), (1, False, "r", 2, True, 2), (1, False, "r", 1, False, 2)],
)
def test_single_call_truth_table(spark, count, idle, run, pid, paired, stalls):
    f = spark.createDataFrame([("r", 1, "f", 0.0, 0.29, False), ("r", 1, "f", 0.31, 0.6, idle)], "run string, pid long, fn string, start double, end double, idle_before boolean")
    c = spark.createDataFrame([] if count is None else [(run, pid, "f", count, paired)], "run string, pid long, fn string, count long, paired boolean")
    got = islands.join_fragments(f, c).collect()
    assert len(got) == stalls
    if stalls == 1:
        assert (got[0].start, got[0].end) == (0.0, 0.6)


def test_self_time_keeps_activations_without_children(spark):
    """Three activations of one thread at a depth, one of them with a child; then two threads, random nests and a plain loop."""
    rows = [(1, "a", 1, 0, 10), (1, "b", 2, 2, 4), (1, "c", 1, 20, 30), (1, "d", 1, 30, 31)]
    r = random.Random(9)
    for thread in (2, 3):
        at = 0
        for _ in range(12):
            start, width = at, r.randrange(10, 60)
            at = start + width + r.randrange(3)
            rows.append((thread, "p", 1, start, start + width))
            inner = start
            while r.random() < 0.6 and inner + 5 < start + width:
                rows.append((thread, "q", 2, inner, inner + 3))
                inner += 3 + r.randrange(3)
    got = islands.self_of_pairs(spark.createDataFrame(rows, "thread long, fn string, depth long, start long, end long"), ["thread"]).collect()
    want = sorted((t, f, d, s, e, sum(y - x for u, _, k, x, y in rows if u == t and k == d + 1 and s <= x < e)) for t, f, d, s, e in rows)
    assert sorted((g.thread, g.fn, g.depth, g.start, g.end, g.child) for g in got) == want


def test_sweep_equals_a_plain_sweep(spark):
    r = random.Random(5)
    rows = [(k, s, s + r.randrange(200)) for k in ("x", "y") for s in (r.randrange(3000) for _ in range(300))]
    got = dict(map(tuple, islands.sweep(spark.createDataFrame(rows, "k string, start long, end long"), "k", parts=16).collect()))
    for k in ("x", "y"):
        own = sorted([(s, 1) for q, s, _ in rows if q == k] + [(e, -1) for q, _, e in rows if q == k])
        now = peak = 0
        for _, step in own:
            now += step
            peak = max(peak, now)
        assert got[k] == peak


def test_order_values_of_large_and_tied_groups(spark):
    r = random.Random(2)
    rows = [("one", 5.0)] + [("tied", 3.0)] * 9000 + [("wide", r.expovariate(1)) for _ in range(20_001)] + [(None, float(i)) for i in range(50)] + [("wide", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {x.k: x for x in stats.tails(df, ["k"], "v").collect()}
    for k in ("one", "tied", "wide", None):
        v = sorted(x for q, x in rows if q == k and x is not None)
        n = len(v)
        at = max(1, min(n - 1, 19 * (n + 1) // 20))
        delta = 19 * (n + 1) - 20 * at
        p95 = v[0] if n == 1 else v[at - 1] * (20 - delta) / 20 + v[at] * delta / 20
        half = v[n // 2] if n % 2 else 0.5 * v[n // 2 - 1] + 0.5 * v[n // 2]
        assert (got[k].p50, got[k].p95) == (pytest.approx(half, abs=1e-12), pytest.approx(p95, abs=1e-12)), k


def test_ids_are_taken_apart(spark):
    from tracewell.operators import ledger

    ids = [("a@b@12:7", ("a@b", 12, 7)), ("nothing", ("", None, None))]
    got = {r.id: tuple(r.p) for r in spark.createDataFrame([(i,) for i, _ in ids], "id string").select("id", ledger.id_parts(F.col("id")).alias("p")).collect()}
    assert got == dict(ids)
