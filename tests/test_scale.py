"""Joins and statistics whose work must not grow with the square of a group."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from tracewell.operators import intervals, rank, stats
from tracewell.sources import stores


def test_one_file_with_a_million_ranges_and_points(spark):
    """Short ranges inside long ones, all in one file: the range around a point is known without a search."""
    n = 1_000_000
    short = spark.range(n // 2).select(F.lit("f").alias("file"), F.col("id").alias("fn"), (F.col("id") * 4).alias("start"), (F.col("id") * 4 + 2).alias("end"))
    long = spark.range(n // 2).select(F.lit("f").alias("file"), (F.col("id") + n).alias("fn"), (F.floor(F.col("id") / 16) * 64).alias("start"), (F.floor(F.col("id") / 16) * 64 + 63 + F.col("id") % 16).alias("end"))
    points = spark.range(n).select(F.lit("f").alias("file"), (F.col("id") * 2 + 1).alias("line"))
    got = intervals.enclosing_smallest(points, short.unionByName(long), "file", "line", ["file", "line"])
    inner = F.floor(F.col("line") / 4)
    want = F.when(F.col("line") % 4 <= 2, inner).otherwise(n + F.floor(F.col("line") / 64) * 16)
    assert got.count() == n and got.where(F.col("fn") != want).count() == 0


def test_ranges_and_slack_against_a_plain_loop(spark):
    r = random.Random(4)
    ranges = [(r.choice("ab"), i, s, s + r.choice((0, 1, 3, 8, 30, 200, -1))) for i in range(150) for s in (r.randrange(-50, 300),)]
    points = [(f, at, at * 3) for f in "abc" for at in range(-60, 320, 3)]
    p, q = spark.createDataFrame(points, "file string, line long, extra long"), spark.createDataFrame(ranges, "file string, fn long, start long, end long")
    got = {(x.file, x.line): x for x in intervals.enclosing_smallest(p, q, "file", "line", ["file", "line"]).collect()}
    near = {(x.file, x.line): x.fn for x in intervals.slack_asof(p, q, "file", "line", ["file", "line"], 5).collect()}
    for f, at, extra in points:
        around = sorted((e - s, -s, i, s, e) for g, i, s, e in ranges if g == f and s <= at <= e)
        ahead = sorted((s, i) for g, i, s, _ in ranges if g == f and at < s <= at + 5)
        assert ((f, at) in got) == bool(around)
        if around:
            x = got[f, at]
            assert (x.fn, x.start, x.end, x.extra) == (*around[0][2:], extra)
        want = min((w, i) for w, _, i, *_ in around)[1] if around else ahead[0][1] if ahead else None
        assert near.get((f, at)) == want
    assert intervals.enclosing_smallest(p, q.limit(0), "file", "line", ["file", "line"]).count() == 0


def test_brackets_are_narrowed_until_few_values_are_left(spark, monkeypatch):
    for name, value in (("NARROW", 20), ("WHOLE_ROWS", 50), ("BRACKET", 0.05), ("PARTS", 8)):
        monkeypatch.setattr(stats, name, value)
    rounds = []
    narrowed = stats._narrowed
    monkeypatch.setattr(stats, "_narrowed", lambda *a: rounds.append(1) or narrowed(*a))
    r = random.Random(2)
    rows = [("one", 5.0)] + [("tied", 3.0)] * 900 + [("wide", r.expovariate(1)) for _ in range(20_001)] + [("some", float(r.randrange(300))) for _ in range(5000)] + [(None, float(i)) for i in range(50)]
    df = stats.order_values(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"_h": stats.MEDIAN, "_p": stats.P95})
    assert len(rounds) >= 2 and "Window" not in df._jdf.queryExecution().optimizedPlan().toString()
    for x in df.collect():
        v = sorted(b for a, b in rows if a == x.k)
        n = len(v)
        h, p = (n - 1) // 2, max(1, min(n - 1, 19 * (n + 1) // 20)) - 1
        assert (x._n, x._h.a, x._p.a) == (n, v[h], v[p])
        assert n == 1 or (x._h.b, x._p.b) == (v[h + 1], v[p + 1])


def test_one_file_of_many_items_is_packed(spark):
    r = random.Random(8)
    items = [("f", i, r.choice((1, 2, 5, 13, 24, 40)), r.choice((0, 10, 900, 5000, 20_000))) for i in range(3_000)]
    got = [x.batch for x in rank.batches(spark.createDataFrame(items, "file string, function long, findings long, chars long"), ["file"], "function").orderBy("function").collect()]
    assert got == [b for _, b in rank.first_fit([i[2:] for i in items])]
    many = spark.range(300_000).selectExpr("'f' AS file", "id AS function", "1 + id % 7 AS findings", "(id * 37) % 4000 AS chars")
    row = rank.batches(many, ["file"], "function").groupBy("batch").agg(F.count("*").alias("n"), F.sum("findings").alias("f"), F.sum("chars").alias("c")).agg(F.max("n"), F.max("f"), F.max("c"), F.sum("n")).first()
    assert row[0] <= rank.BATCH_FUNCTIONS and row[1] <= rank.BATCH_FINDINGS and row[2] <= rank.BATCH_CHARS and row[3] == 300_000


def test_trace_stores(spark, tmp_path):
    old = sqlite3.connect(tmp_path / "old.db")
    old.execute("create table meta(key, value)")
    old.execute("insert into meta values ('pid', '42')")
    old.execute("create table calls(id, parent, thread, file, line, qualname, is_coro, start, dur, self_dur, shapes)")  # without two columns
    old.execute("insert into calls values (1, null, 7, 'a.py', 3, 'f', 1, 0.5, 2.0, 1.0, '{\"n\": 10}')")
    old.execute("create table stalls(call_id, file, line, qualname, dur, at, stack)")
    old.execute("insert into stalls values (1, 'a.py', 3, 'f', 0.2, 1.0, '[[\"a.py\", 3, \"f\"]]')")
    old.commit()
    old.close()
    (tmp_path / "broken.db").write_bytes(b"no store at all" * 100)
    (tmp_path / "note.txt").write_text("no store either")
    rows = {r.pid: r for r in stores.stores(spark, str(tmp_path)).collect()}
    assert set(rows) == {42, None}
    assert (rows[42].qualname, rows[42].is_coro, rows[42].shapes, rows[42].slices, rows[42].error) == ("f", True, {"n": 10.0}, None, None)
    assert rows[None].store.endswith("broken.db") and "not a database" in rows[None].error
    (s,) = stores.stores(spark, str(tmp_path), "stalls").where("error IS NULL").collect()
    assert (s.call_id, [tuple(x) for x in s.stack]) == (1, [("a.py", 3, "f")])
    with pytest.raises(Exception, match="relation must be one of"):
        stores.stores(spark, str(tmp_path), "other").count()
    (tmp_path / "none").mkdir()
    assert stores.stores(spark, str(tmp_path / "none")).count() == 0
