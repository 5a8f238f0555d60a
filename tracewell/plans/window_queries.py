"""Queries over event order: gaps, islands, pairing, sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import islands, ledger, stats
from .adapters import act, by_order, ival, line, r, table, tick, views
from .catalogue import query

HOUR = 3_600_000_000
DAY = 24 * HOUR


def gap_windows(spark, sf):
    """Gaps of at least ten minutes between the error, purchase and signup ticks of logs with three ticks or more."""
    t = tick(spark, sf).where("fn NOT IN ('view', 'click')")
    g = islands.gaps(t, "log", "t", ["t", "ord"]).where("w1 - w0 >= 600000000")
    n = islands.gaps(t, "log", "t", ["t", "ord"]).groupBy("log").agg((F.count("*") + 1).alias("n")).where("n >= 3")
    return g.join(n, "log").select("log", "w0", "w1")


_G = "g AS (SELECT log, t, lag(t) OVER (PARTITION BY log ORDER BY t, ord) AS p FROM tick), u AS (SELECT log, quantile_cont(CAST(t - p AS DOUBLE), 0.5) AS usual, count(t - p) AS n FROM g GROUP BY log)"


@query(views("tick") + ", " + _G + f" SELECT g.log, p AS w0, t AS w1, round(t - p - usual, 1) + 0.0 AS excess FROM g JOIN u USING (log) WHERE p IS NOT NULL AND n >= 2 AND t - p - usual >= {DAY}")
def heartbeat_gaps(spark, sf):
    """win.heartbeat_gaps"""
    g = islands.heartbeat_gaps(tick(spark, sf), "log", "t", ["t", "ord"], DAY)
    return g.select("log", "w0", "w1", r(F.col("excess"), 1).alias("excess"))


@query(views("tick") + ", m AS (SELECT max(t) AS stop FROM tick), g AS (SELECT log, t - lag(t) OVER (PARTITION BY log ORDER BY t, ord) AS d FROM tick UNION ALL SELECT log, (SELECT stop FROM m) - max(t) FROM tick GROUP BY log) SELECT log, max(d) AS max_gap FROM g GROUP BY log")
def max_gap(spark, sf):
    """win.max_gap: the largest gap, the final silence included"""
    t = tick(spark, sf)
    inner = islands.gaps(t, "log", "t", ["t", "ord"]).select("log", (F.col("w1") - F.col("w0")).alias("d"))
    stop = t.agg(F.max("t").alias("stop"))
    tail = t.groupBy("log").agg(F.max("t").alias("last")).join(F.broadcast(stop)).select("log", (F.col("stop") - F.col("last")).alias("d"))
    return inner.unionByName(tail).groupBy("log").agg(F.max("d").alias("max_gap"))


@query(views("io") + ", g AS (SELECT system, target, error, t - lag(t) OVER (PARTITION BY target ORDER BY t, id) AS d FROM io) SELECT target, count(*) AS connects, count(*) FILTER (error) AS resets, min(d) AS min_gap, max(d) AS max_gap FROM g GROUP BY target")
def conn_gaps(spark, sf):
    """win.conn_gaps, agg.conn_summary"""
    from .adapters import io

    return ledger.connections(io(spark, sf), "target", "t", ["id"], "error")


@query(views("tick") + ', m AS (SELECT *, sum(CAST(idle AS INTEGER)) OVER (PARTITION BY log ORDER BY t, ord ROWS UNBOUNDED PRECEDING) AS island FROM tick) SELECT log, CAST(island AS BIGINT) AS island, count(*) AS samples, min(t) AS "start", max(t) AS "end" FROM m WHERE NOT idle GROUP BY ALL')
def busy_stretch(spark, sf):
    """win.busy_stretch"""
    return islands.busy_stretches(tick(spark, sf), "log", ["t", "ord"], "idle", "t")


_RUNS = f"g AS (SELECT *, CASE WHEN coalesce(t - lag(t) OVER (PARTITION BY log, fn ORDER BY t, ord) > {6 * HOUR}, true) THEN 1 ELSE 0 END AS b FROM tick), m AS (SELECT *, sum(b) OVER (PARTITION BY log, fn ORDER BY t, ord ROWS UNBOUNDED PRECEDING) AS run FROM g)"


@query(views("tick") + ", " + _RUNS + ' SELECT log, fn, CAST(run AS BIGINT) AS run, count(*) AS samples, min(t) AS "start", max(t) AS "end" FROM m GROUP BY ALL')
def presence_runs(spark, sf):
    """win.presence_runs"""
    return islands.presence_runs(tick(spark, sf), "log", "fn", "t", ["t", "ord"], 6 * HOUR)


@query(views("tick") + ", " + _RUNS.replace("PARTITION BY log, fn", "PARTITION BY log").replace("> 21600000000", ">= 21600000000") + ' SELECT log, min(t) AS "start", count(*) AS samples FROM m GROUP BY log, run')
def session_runs(spark, sf):
    """win.presence_runs as a session window: mergeable state per key, so it also runs on a stream"""
    e = table(spark, sf, "events").select(F.col("user_id").alias("log"), F.col("ts").cast("timestamp").alias("at"))
    return e.groupBy("log", F.session_window("at", "6 hours")).agg(F.min(F.unix_micros("at")).alias("start"), F.count("*").alias("samples")).select("log", "start", "samples")


@query(views("ival") + ', e AS (SELECT fn, "start" AS k, 1 AS step FROM ival UNION ALL SELECT fn, "end", -1 FROM ival), s AS (SELECT fn, sum(step) OVER (PARTITION BY fn ORDER BY k, step ROWS UNBOUNDED PRECEDING) AS n FROM e) SELECT fn, CAST(max(n) AS BIGINT) AS peak FROM s GROUP BY fn')
def peak_concurrency(spark, sf):
    """win.peak_concurrency, per function"""
    return islands.sweep(ival(spark, sf).select("fn", "start", "end"), "fn")


def _nested(spark, sf):
    """Well-nested events: each order opens its lines in order and closes them in reverse."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice"))
    i = by_order(spark, sf).select(F.col("l_orderkey").alias("thread"), F.col("l_suppkey").alias("fn"), n.cast("long").alias("n"))
    event = lambda at, open_: F.struct(at.alias("at"), F.lit(open_).alias("open"))
    return i.select("thread", "fn", F.explode(F.array(event(F.col("n") * 10, True), event(100_000 - F.col("n") * 10, False))).alias("x")).select("thread", "fn", "x.at", "x.open")


_PAIRS = """li AS (SELECT l_orderkey AS thread, l_suppkey AS fn, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice) AS n FROM lineitem),
ev AS (SELECT thread, fn, n * 10 AS k, true AS o FROM li UNION ALL SELECT thread, fn, 100000 - n * 10, false FROM li),
d AS (SELECT *, sum(CASE WHEN o THEN 1 ELSE -1 END) OVER (PARTITION BY thread ORDER BY k ROWS UNBOUNDED PRECEDING) + CASE WHEN o THEN 0 ELSE 1 END AS depth FROM ev),
p AS (SELECT *, lead(CASE WHEN NOT o THEN k END) OVER (PARTITION BY thread, depth ORDER BY k) AS stop FROM d)"""


@query("WITH " + _PAIRS + ' SELECT thread, fn, CAST(depth AS BIGINT) AS depth, CAST(k AS BIGINT) AS "start", CAST(stop AS BIGINT) AS "end" FROM p WHERE o AND stop IS NOT NULL')
def evented_pairs(spark, sf):
    """win.evented: each order opens its lines in order and closes them in reverse"""
    return islands.paired(_nested(spark, sf), ["thread"], ["at"], F.col("open"), "fn", "at")


@query("WITH " + _PAIRS + ", q AS (SELECT thread, fn, depth, k AS s, stop AS e FROM p WHERE o AND stop IS NOT NULL) SELECT a.thread, a.fn, CAST(a.depth AS BIGINT) AS depth, CAST(a.e - a.s - coalesce(sum(b.e - b.s), 0) AS BIGINT) AS self_time FROM q a LEFT JOIN q b ON a.thread = b.thread AND b.depth = a.depth + 1 AND b.s >= a.s AND b.s < a.e GROUP BY a.thread, a.fn, a.depth, a.s, a.e")
def chrome_pairs(spark, sf):
    """win.chrome_pairs, agg.self_time from begin and end events"""
    pairs = islands.paired(_nested(spark, sf), ["thread"], ["at"], F.col("open"), "fn", "at")
    out = islands.self_of_pairs(pairs, ["thread"])
    return out.select("thread", "fn", "depth", (F.col("end") - F.col("start") - F.col("child")).alias("self_time"))


_SIBLINGS = """li AS (SELECT l_orderkey AS thread, l_suppkey AS fn, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice) AS n, count(*) OVER (PARTITION BY l_orderkey) AS m FROM lineitem),
q AS (SELECT thread, fn, 1 AS depth, (n // 2) * 1000 AS s, (n // 2) * 1000 + 500 + fn % 7 AS e FROM li WHERE n % 2 = 0 UNION ALL SELECT thread, fn, 2, ((n + 1) // 2) * 1000 + 10, ((n + 1) // 2) * 1000 + 100 + fn % 11 FROM li WHERE n % 2 = 1 AND n < m)"""


@query("WITH " + _SIBLINGS + " SELECT a.thread, a.fn, CAST(a.s AS BIGINT) AS at, CAST(a.e - a.s - coalesce(sum(b.e - b.s), 0) AS BIGINT) AS self_time FROM q a LEFT JOIN q b ON a.thread = b.thread AND b.depth = a.depth + 1 AND b.s >= a.s AND b.s < a.e GROUP BY a.thread, a.fn, a.depth, a.s, a.e")
def sibling_self_time(spark, sf):
    """agg.self_time where a depth has several activations of a thread: every second line of an order is a parent, the line before it its child"""
    from pyspark.sql import Window

    by = Window.partitionBy("l_orderkey")
    n = F.row_number().over(by.orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")).cast("long")
    li = by_order(spark, sf).select(F.col("l_orderkey").alias("thread"), F.col("l_suppkey").alias("fn"), n.alias("n"), F.count("*").over(by).alias("m"))
    at, up = F.expr("((n + 1) DIV 2) * 1000"), F.col("n") % 2 == 0
    pick = lambda a, b: F.when(up, a).otherwise(b)
    pairs = li.where(up | (F.col("n") < F.col("m"))).select("thread", "fn", pick(F.lit(1), F.lit(2)).cast("long").alias("depth"), pick(at, at + 10).alias("start"), pick(at + 500 + F.col("fn") % 7, at + 100 + F.col("fn") % 11).alias("end"))
    out = islands.self_of_pairs(pairs, ["thread"])
    return out.select("thread", "fn", F.col("start").alias("at"), (F.col("end") - F.col("start") - F.col("child")).alias("self_time"))


@query(views("tick") + """, e AS (SELECT log, t, ord, fn, first_value(CASE WHEN fn = 'purchase' THEN t END IGNORE NULLS) OVER (PARTITION BY log ORDER BY t, ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS released FROM tick) SELECT log, ord, t AS acquired, released FROM e WHERE fn = 'signup'""")
def acquire_release(spark, sf):
    """win.acquire_release: a signup acquires, the next purchase releases, null is the end of the body"""
    t = islands.next_after(tick(spark, sf), ["log"], ["t", "ord"], F.col("fn") == "purchase", "t", "released")
    return t.where("fn = 'signup'").select("log", "ord", F.col("t").alias("acquired"), "released")


_ROLE = "CASE WHEN turn = 0 THEN 'read' WHEN role = 'assistant' THEN 'await' ELSE 'write' END"


@query(f"WITH e AS (SELECT conv_id, turn, {_ROLE} AS kind FROM conversations), f AS (SELECT conv_id, min(turn) AS read_at FROM e WHERE kind = 'read' GROUP BY 1), a AS (SELECT e.conv_id, min(turn) AS await_at FROM e JOIN f USING (conv_id) WHERE kind = 'await' AND turn > read_at GROUP BY 1), w AS (SELECT conv_id, max(turn) AS write_at FROM e WHERE kind = 'write' GROUP BY 1) SELECT conv_id, read_at, await_at, write_at FROM f JOIN a USING (conv_id) JOIN w USING (conv_id) WHERE write_at > await_at")
def race_rw(spark, sf):
    """win.read_await_write, rule race-across-await"""
    c = table(spark, sf, "conversations")
    kind = F.when(F.col("turn") == 0, "read").when(F.col("role") == "assistant", "await").otherwise("write")
    return islands.read_await_write(c.select("conv_id", "turn", kind.alias("kind")), ["conv_id"], "kind", "turn")


@query("WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), g AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS gen FROM e), h AS (SELECT user_id, gen, min(CASE WHEN event_type = 'purchase' THEN k END) AS consume, min(CASE WHEN event_type = 'error' THEN k END) AS chk FROM g GROUP BY 1, 2) SELECT user_id, min(consume) AS consume_at FROM h WHERE consume IS NOT NULL AND (chk IS NULL OR consume < chk) GROUP BY 1")
def response_check(spark, sf):
    """win.response_check: a purchase consumes, an error checks, a signup assigns anew"""
    from pyspark.sql import Window

    e = table(spark, sf, "events").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    kind = F.when(F.col("event_type") == "signup", "assign").when(F.col("event_type") == "purchase", "consume").when(F.col("event_type") == "error", "check").otherwise("other")
    return islands.unchecked(e.select("user_id", kind.alias("kind"), F.col("k").cast("long").alias("k")), ["user_id"], "kind", "k")


@query(views("line") + ", p AS (SELECT doc_id, line_no, line, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev FROM line) SELECT doc_id, count(*) AS pairs, min(line_no) AS first_line FROM p WHERE regexp_matches(line, '^[A-Z][a-z]+ ') AND regexp_matches(prev, '^[A-Z][a-z]+ ') AND regexp_extract(line, '^([A-Z][a-z]+) ', 1) <> regexp_extract(prev, '^([A-Z][a-z]+) ', 1) GROUP BY doc_id")
def seq_pair(spark, sf):
    """win.wallclock_pair, rule sequential-awaits: neighbouring lines that name different things"""
    return ledger.different_neighbours(line(spark, sf), "doc_id", "line_no", "line", "^([A-Z][a-z]+) ")


@query(views("act") + ", c AS (SELECT parent AS id, sum(dur) AS d FROM act WHERE parent IS NOT NULL GROUP BY 1) SELECT act.pid, count(*) AS stalls, max(act.id) AS last_id FROM act LEFT JOIN c USING (id) WHERE greatest(dur - coalesce(d, 0), 0) >= 120 GROUP BY act.pid")
def stall_slice(spark, sf):
    """win.stall_slice: self slices of at least the threshold"""
    s = stats.self_time(act(spark, sf)).where("self_s >= 120")
    return s.groupBy("pid").agg(F.count("*").alias("stalls"), F.max("id").alias("last_id"))


@query(views("act") + " SELECT thread, fn, count(*) AS slices, round(sum(dur), 4) + 0.0 AS total_s, max(t) - min(t) AS span FROM act GROUP BY ALL")
def suspend_resume(spark, sf):
    """win.suspend_resume: the slices of one activation, a user's calls of one function, are summed"""
    return ledger.slices(act(spark, sf), ["thread", "fn"])


_STALL = f"""s AS (SELECT thread AS log, t // {7 * DAY} AS stretch, fn, n % 5 AS depth, t FROM act), k AS (SELECT CAST(log AS VARCHAR) || '/' || CAST(stretch AS VARCHAR) AS k, fn, depth, t FROM s),
g AS (SELECT *, CASE WHEN coalesce(t - lag(t) OVER (PARTITION BY k, fn ORDER BY t) > {18 * HOUR}, true) THEN 1 ELSE 0 END AS b FROM k), m AS (SELECT *, sum(b) OVER (PARTITION BY k, fn ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM g),
lv AS (SELECT k, fn, max(depth) AS depth FROM k GROUP BY ALL), seg AS (SELECT m.k, m.fn, run, min(t) AS s, max(t) AS e, any_value(lv.depth) AS depth FROM m JOIN lv ON m.k = lv.k AND m.fn = lv.fn GROUP BY ALL HAVING max(t) - min(t) >= {6 * HOUR}),
pt AS (SELECT a.k, a.fn, a.run, greatest(a.s, b.s) AS lo, least(a.e, b.e) AS hi FROM seg a JOIN seg b ON a.k = b.k AND b.depth > a.depth AND b.s < a.e AND b.e > a.s),
pu AS (SELECT *, max(hi) OVER (PARTITION BY k, fn, run ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM pt), cv AS (SELECT k, fn, run, sum(greatest(hi - greatest(lo, coalesce(seen, lo)), 0)) AS cov FROM pu GROUP BY ALL)"""


@query(views("act") + ", " + _STALL + ' SELECT seg.k, seg.fn, seg.depth, s AS "start", e AS "end" FROM seg LEFT JOIN cv ON seg.k = cv.k AND seg.fn = cv.fn AND seg.run = cv.run WHERE coalesce(cov, 0) < 0.8 * (e - s)')
def segment_stalls(spark, sf):
    """win.segment_stalls: weeks are stretches, events are samples"""
    s = act(spark, sf).select(F.col("thread").alias("log"), F.floor(F.col("t") / (7 * DAY)).alias("stretch"), "fn", (F.col("n") % 5).alias("depth"), "t")
    return islands.segment_stalls(s, "log", "stretch", "fn", "depth", "t", 6 * HOUR, 18 * HOUR).withColumnRenamed("_k", "k")


@query(views("tick") + ", d AS (SELECT log, fn, count(*) AS n, (SELECT count(*) FROM tick x WHERE x.log = tick.log) AS all_n FROM tick GROUP BY log, fn) SELECT log, fn, n FROM (SELECT log, fn, n, row_number() OVER (PARTITION BY log ORDER BY n DESC, fn DESC) AS i FROM d WHERE n * 100 >= 20 * all_n) WHERE i = 1")
def flush_fallback(spark, sf):
    """win.flush_fallback: the function that is there in most samples of a stretch, if in enough of them"""
    return ledger.usual_function(tick(spark, sf), "log", "fn")


@query(views("tick") + ", c AS (SELECT log FROM tick WHERE fn = 'signup' GROUP BY log HAVING count(*) <= 9), " + _RUNS + ' SELECT log, fn, min("s") AS "start", max("e") AS "end", CAST(sum(k) AS BIGINT) AS samples FROM (SELECT log, fn, run, min(t) AS s, max(t) AS e, count(*) AS k FROM m GROUP BY ALL) WHERE log IN (SELECT log FROM c) GROUP BY log, fn')
def single_call_join(spark, sf):
    """win.single_call_join: fragments of a function become one where a paired count proves a single call"""
    runs = islands.presence_runs(tick(spark, sf), "log", "fn", "t", ["t", "ord"], 6 * HOUR)
    one = tick(spark, sf).where("fn = 'signup'").groupBy("log").count().where("count <= 9").select("log")
    return runs.join(one, "log", "left_semi").groupBy("log", "fn").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("samples").alias("samples"))


@query(views("tick") + f", g AS (SELECT log, t - lag(t) OVER (PARTITION BY log ORDER BY t, ord) AS d FROM tick) SELECT log, max(d - {HOUR}) AS max_lag, count(*) FILTER (d > {2 * HOUR}) AS late FROM g WHERE d IS NOT NULL GROUP BY log")
def loop_lag(spark, sf):
    """win.loop_lag: gap less period"""
    g = islands.gaps(tick(spark, sf), "log", "t", ["t", "ord"]).withColumn("d", F.col("w1") - F.col("w0"))
    return g.groupBy("log").agg(F.max(F.col("d") - HOUR).alias("max_lag"), F.count_if(F.col("d") > 2 * HOUR).alias("late"))
