"""Gaps, islands and nesting in event order: the win.* operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gaps(ticks: DataFrame, key: str, t: str, order: list[str]) -> DataFrame:
    """Successive gaps (w0, w1) of a key's ticks."""
    w = Window.partitionBy(key).orderBy(*order)
    return ticks.withColumn("w0", F.lag(t).over(w)).where("w0 IS NOT NULL").withColumn("w1", F.col(t))


def heartbeat_gaps(ticks: DataFrame, key: str, t: str, order: list[str], threshold: float) -> DataFrame:
    """win.heartbeat_gaps: gaps that exceed the key's median gap by the threshold; keys with fewer than three ticks have none."""
    g = gaps(ticks, key, t, order)
    usual = g.groupBy(key).agg(F.expr("percentile(w1 - w0, 0.5)").alias("usual"), F.count("*").alias("_n")).where("_n >= 2")
    return g.join(usual, key).withColumn("excess", F.col("w1") - F.col("w0") - F.col("usual")).where(F.col("excess") >= threshold)


def islands(df: DataFrame, keys: list[str], order: list, breaks: Column, out: str = "island") -> DataFrame:
    """Numbers the runs of a key's rows; a row where `breaks` holds begins a new one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.sum(breaks.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def busy_stretches(df: DataFrame, key: str, order: list, idle: str, t: str) -> DataFrame:
    """win.busy_stretch: consecutive rows that are not idle; an idle row closes the stretch."""
    marked = islands(df, [key], order, F.col(idle))
    return marked.where(~F.col(idle)).groupBy(key, "island").agg(F.count("*").alias("samples"), F.min(t).alias("start"), F.max(t).alias("end"))


def presence_runs(df: DataFrame, key: str, fn: str, t: str, order: list[str], bridge: int) -> DataFrame:
    """win.presence_runs: contiguous presence of a function within a key, absences up to `bridge` passed over."""
    w = Window.partitionBy(key, fn).orderBy(*order)
    gap = F.col(t) - F.lag(t).over(w)
    marked = df.withColumn("_new", F.coalesce(gap > bridge, F.lit(True))).withColumn("run", F.sum(F.col("_new").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, fn, "run").agg(F.count("*").alias("samples"), F.min(t).alias("start"), F.max(t).alias("end"))


def sweep(intervals: DataFrame, key: str, parts: int = 1024) -> DataFrame:
    """win.peak_concurrency: the largest number of open intervals per key; an end counts before a start at one time.

    A key's time is cut into `parts` equal bins. What is open when a bin begins is a running sum over the bins' totals; inside a
    bin the events run on their own, so a key with most of the intervals is spread over many tasks.
    """
    up = intervals.select(key, F.col("start").alias("at"), F.lit(1).alias("step"))
    events = up.unionByName(intervals.select(key, F.col("end").alias("at"), F.lit(-1).alias("step")))
    ends = intervals.groupBy(key).agg(F.min("start").alias("_lo"), F.max("end").alias("_hi"))
    binned = events.join(ends, key).withColumn("_bin", F.floor((F.col("at") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1) * parts).cast("int")).select(key, "_bin", "at", "step")
    before = Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    total = binned.groupBy(key, "_bin").agg(F.sum("step").alias("_t")).withColumn("_open", F.coalesce(F.sum("_t").over(before), F.lit(0)))
    w = Window.partitionBy(key, "_bin").orderBy("at", "step").rowsBetween(Window.unboundedPreceding, 0)
    inside = binned.withColumn("_n", F.sum("step").over(w)).groupBy(key, "_bin").agg(F.max("_n").alias("_n"))
    return inside.join(total, [key, "_bin"]).groupBy(key).agg(F.max(F.col("_open") + F.col("_n")).alias("peak"))


def paired(events: DataFrame, keys: list[str], order: list, opens: Column, name: str, at: str) -> DataFrame:
    """win.evented, win.chrome_pairs: each opening with the next closing at its depth.

    The depth is a running sum, so matching needs one more window and no stack. Events that are dealt by their keys stay where they are.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    d = events.withColumn("_open", opens).withColumn("_sum", F.sum(F.when(F.col("_open"), 1).otherwise(-1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("depth", F.when(F.col("_open"), F.col("_sum")).otherwise(F.col("_sum") + 1))
    at_depth = Window.partitionBy(*keys, "depth").orderBy(*order)
    d = d.withColumn("_end", F.lead(F.when(~F.col("_open"), F.col(at))).over(at_depth))
    return d.where("_open AND _end IS NOT NULL").select(*keys, name, "depth", F.col(at).alias("start"), F.col("_end").alias("end"))


def self_of_pairs(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """pairs plus `child`: the time of the pairs one level deeper inside.

    Parents and children of a level stand in one order of time, and a child belongs to the last parent that began
    before it, so the cost is one sort and not the pairs of a level. A pair is a parent of its own level and a child of the one above,
    and what its parent is told comes by a window: no row leaves its key's part.
    """
    level, took = pairs.schema["depth"].dataType, F.col("end") - F.col("start")
    row = F.struct(*pairs.columns)
    roles = F.array(F.struct(F.col("depth").alias("depth"), F.lit(0).alias("kind")), F.struct((F.col("depth") - 1).cast(level).alias("depth"), F.lit(1).alias("kind")))
    both = pairs.select(*keys, row.alias("_row"), F.col("start").alias("_at"), took.alias("_took"), F.explode(roles).alias("_x")).select(*keys, "_row", "_at", "_took", F.col("_x.depth").alias("_depth"), F.col("_x.kind").alias("_kind"))
    w = Window.partitionBy(*keys, "_depth").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    own = both.withColumn("_o", F.last(F.when(F.col("_kind") == 0, F.struct("_row.start", "_row.end")), ignorenulls=True).over(w)).where("_kind = 0 OR _at < _o.end")
    inside = own.withColumns({"_start": F.col("_o.start"), "_end": F.col("_o.end")}).drop("_o")
    told = inside.withColumn("child", F.sum(F.when(F.col("_kind") == 1, F.col("_took"))).over(Window.partitionBy(*keys, "_depth", "_start", "_end")))
    return told.where("_kind = 0").select("_row.*", F.coalesce("child", F.lit(0)).alias("child"))


def next_after(events: DataFrame, keys: list[str], order: list, wanted: Column, at: str, out: str) -> DataFrame:
    """win.acquire_release: for every row the first later `at` of the key where `wanted` holds."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return events.withColumn(out, F.first(F.when(wanted, F.col(at)), ignorenulls=True).over(w))


def read_await_write(events: DataFrame, keys: list[str], kind: str, at: str) -> DataFrame:
    """win.read_await_write: keys whose first read is followed by an await and later by a write."""
    first = events.where(F.col(kind) == "read").groupBy(*keys).agg(F.min(at).alias("read_at"))
    e = events.join(first, keys)
    wait = e.where((F.col(kind) == "await") & (F.col(at) > F.col("read_at"))).groupBy(*keys).agg(F.min(at).alias("await_at"))
    write = e.where(F.col(kind) == "write").groupBy(*keys).agg(F.max(at).alias("write_at"))
    return first.join(wait, keys).join(write, keys).where("write_at > await_at")


def unchecked(events: DataFrame, keys: list[str], kind: str, at: str) -> DataFrame:
    """win.response_check: a consume comes before any check since the last assignment."""
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    marked = events.withColumn("_gen", F.sum((F.col(kind) == "assign").cast("long")).over(w))
    g = marked.groupBy(*keys, "_gen").agg(F.min(F.when(F.col(kind) == "consume", F.col(at))).alias("consume_at"), F.min(F.when(F.col(kind) == "check", F.col(at))).alias("check_at"))
    return g.where("consume_at IS NOT NULL AND (check_at IS NULL OR consume_at < check_at)").groupBy(*keys).agg(F.min("consume_at").alias("consume_at"))


def segment_stalls(samples: DataFrame, key: str, stretch: str, fn: str, depth: str, t: str, threshold: int, bridge: int, cover: float = 0.8) -> DataFrame:
    """win.segment_stalls: presence segments of a stretch that last `threshold`, less those that deeper ones explain.

    A segment goes if the union of the deeper segments of its stretch covers at least `cover` of it.
    """
    seg = presence_runs(samples.withColumn("_k", F.concat_ws("/", F.col(key).cast("string"), F.col(stretch).cast("string"))), "_k", fn, t, [t], bridge)
    level = samples.withColumn("_k", F.concat_ws("/", F.col(key).cast("string"), F.col(stretch).cast("string"))).groupBy("_k", fn).agg(F.max(depth).alias("depth"))
    seg = seg.join(level, ["_k", fn]).where(F.col("end") - F.col("start") >= threshold)
    deeper = seg.select("_k", F.col("depth").alias("_dd"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    part = seg.join(deeper, "_k", "left").where("_dd > depth AND _s < end AND _e > start")
    part = part.withColumn("_lo", F.greatest("start", "_s")).withColumn("_hi", F.least("end", "_e"))
    ids = ["_k", fn, "run"]
    w = Window.partitionBy(*ids).orderBy("_lo", "_hi")
    part = part.withColumn("_seen", F.max("_hi").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    told = part.groupBy(*ids).agg(F.sum(F.greatest(F.col("_hi") - F.greatest("_lo", F.coalesce("_seen", "_lo")), F.lit(0))).alias("_cov"))
    out = seg.join(told, ids, "left").where(F.coalesce("_cov", F.lit(0)) < cover * (F.col("end") - F.col("start")))
    return out.select("_k", fn, "depth", "start", "end")


def join_fragments(fragments: DataFrame, counts: DataFrame, keys: tuple[str, ...] = ("run", "pid", "fn")) -> DataFrame:
    """win.single_call_join: fragments of a function become one activation where a paired count of the same run and process proves a single call.

    fragments(keys, start, end, idle_before): an idle gap always separates. counts(keys, count, paired).
    """
    one = counts.where("count = 1 AND paired").select(*keys).distinct().withColumn("_one", F.lit(True))
    marked = fragments.join(one, list(keys), "left")
    return islands(marked, list(keys), ["start"], F.col("idle_before") | F.col("_one").isNull(), "_k").groupBy(*keys, "_k").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("fragments")).drop("_k")
