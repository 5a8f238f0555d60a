"""Joins and set operations between findings, evidence, tests and verdicts: what is known, what is missing, what is refused."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .parts import pairs_between, parts_of_pairs
from .stats import rounded

_ID = r"^(.*)@(\d+):(\d+)$"


def finding_id(rule: Column, function: Column, line: Column) -> Column:
    """proj.finding_id: rule@function:line."""
    return F.concat(rule, F.lit("@"), function.cast("string"), F.lit(":"), line.cast("string"))


def id_parts(id_: Column) -> Column:
    """proj.id_split: (rule, function, line) of an id; empty and null where it is none."""
    part = lambda k: F.regexp_extract(id_, _ID, k)
    return F.struct(part(1).alias("rule"), F.try_to_number(part(2), F.lit("999999999999999999")).cast("long").alias("function"), F.try_to_number(part(3), F.lit("9999999999")).cast("int").alias("line"))


def rule_base(rule: Column) -> Column:
    """proj.rule_base: the rule that a propagated finding came from."""
    return F.regexp_replace(rule, r"^propagated:", "")


def collect(channels: dict[str, DataFrame]) -> DataFrame:
    """src.collect, set.union_all: the rows of several channels in one relation, each with its channel's name as `source`; columns that a channel lacks are null."""
    tagged = [df.withColumn("source", F.lit(name)) for name, df in channels.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def without(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """set.unflagged, set.unpredicted, set.scaffold_skip: the rows whose key is not among the known ones."""
    return rows.join(known.select(key).distinct(), key, "left_anti")


def pending(issued: list[DataFrame], recorded: DataFrame) -> DataFrame:
    """set.union_distinct, set.except: what any list issued and nobody recorded, once each; the lists have one column."""
    return reduce(DataFrame.union, issued).distinct().subtract(recorded)


def proven(planted: DataFrame, confirmed: DataFrame) -> DataFrame:
    """set.intersect"""
    return planted.intersect(confirmed)


def with_evidence(findings: DataFrame, evidence: DataFrame, key: str, order: str, value: str, missing: str = "none") -> DataFrame:
    """join.evidence: findings plus `value`; of several entries of a key the last wins."""
    last = evidence.groupBy(key).agg(F.max_by(value, order).alias(value))
    return findings.join(last, key, "left").withColumn(value, F.coalesce(value, F.lit(missing)))


def repro_status(findings: DataFrame, tests: DataFrame) -> DataFrame:
    """join.repro: findings(finding, file) plus status, from tests(finding, file, outcome).

    All tests of a finding that ran must pass. Without a test of its own, a finding's file can only say failed or missing.
    """
    own = tests.groupBy("finding").agg(F.count_if(F.col("outcome") != "skipped").alias("_n"), F.count_if(F.col("outcome") == "passed").alias("_p"))
    file = tests.groupBy("file").agg(F.count_if(F.col("outcome") == "failed").alias("_f"))
    status = F.when((F.col("_n") > 0) & (F.col("_p") == F.col("_n")), "passed").when(F.col("_n") > 0, "failed").when(F.col("_n") == 0, "missing").when(F.coalesce("_f", F.lit(0)) > 0, "failed").otherwise("missing")
    return findings.join(own, "finding", "left").join(file, "file", "left").select(*findings.columns, status.alias("status"))


def repro_counts(tests: DataFrame, file: str = "file", outcome: str = "outcome") -> DataFrame:
    """agg.repro_counts: outcomes per file, and the exit code of its run."""
    n = lambda s: F.count_if(F.col(outcome) == s)
    return tests.groupBy(file).agg(n("passed").alias("passed"), n("failed").alias("failed"), n("skipped").alias("skipped"), F.when(n("failed") > 0, 1).otherwise(0).alias("exit_code"))


def callers(edges: DataFrame, name: str, order: list[str], caller: Column, most: int = 5) -> DataFrame:
    """join.callers: per name the number of edges and the first `most` callers; the edges of a name are numbered, never listed as a whole."""
    n = edges.groupBy(name).agg(F.count("*").alias("n"))
    first = edges.withColumn("_i", F.row_number().over(Window.partitionBy(name).orderBy(*order))).where(F.col("_i") <= most)
    listed = first.groupBy(name).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", caller.alias("c")))), lambda x: x["c"]).alias("callers"))
    return n.join(listed, name)


def wrong_pattern(findings: DataFrame, rejected: DataFrame, rule: str = "rule") -> DataFrame:
    """join.wrong_pattern: findings plus whether their rule's pattern was rejected."""
    own = rejected.select(rule).distinct().withColumn("_p", F.lit(True))
    return findings.join(own, rule, "left").withColumn("wrong_pattern", F.coalesce("_p", F.lit(False))).drop("_p")


def case_clashes(names: DataFrame, folder: str, name: str, key: str) -> DataFrame:
    """pred.path_warn: (folder, a, b) of entries of one folder whose names differ by case only.

    Pairs grow with the square of the entries of a name, so the names are dealt into as many parts as there are pairs to make.
    """
    low = names.select(folder, F.lower(name).alias("_n"), key)
    low = low.repartition(parts_of_pairs(low, pairs_between(low, low, [folder, "_n"])), folder, "_n")
    return low.withColumnRenamed(key, "a").join(low.withColumnRenamed(key, "b"), [folder, "_n"]).where("a < b").select(folder, "a", "b")


def connections(io: DataFrame, target: str, t: str, order: list[str], error: str) -> DataFrame:
    """win.conn_gaps, agg.conn_summary: connects, resets and the least and greatest gap between connects of a target."""
    w = Window.partitionBy(target).orderBy(t, *order)
    g = io.withColumn("_d", F.col(t) - F.lag(t).over(w))
    return g.groupBy(target).agg(F.count("*").alias("connects"), F.count_if(error).alias("resets"), F.min("_d").alias("min_gap"), F.max("_d").alias("max_gap"))


def usual_function(samples: DataFrame, stretch: str, fn: str, percent: int = 20) -> DataFrame:
    """win.flush_fallback: the function that is in most samples of a stretch, if in `percent` of them at least; the later name among equals."""
    per = samples.groupBy(stretch, fn).agg(F.count("*").alias("n"))
    whole = per.groupBy(stretch).agg(F.sum("n").alias("_all"))
    enough = per.join(whole, stretch).where(F.col("n") * 100 >= percent * F.col("_all"))
    return enough.groupBy(stretch).agg(F.max(F.struct("n", fn)).alias("_m")).select(stretch, F.col(f"_m.{fn}").alias(fn), F.col("_m.n").alias("n"))


def slices(act: DataFrame, keys: list[str], t: str = "t", dur: str = "dur") -> DataFrame:
    """win.suspend_resume: the slices of an activation that was suspended and resumed, as one."""
    return act.groupBy(*keys).agg(F.count("*").alias("slices"), rounded(F.sum(dur)).alias("total_s"), (F.max(t) - F.min(t)).alias("span"))


def derived(edges: DataFrame, origins: DataFrame, order: list, top: int = 3) -> DataFrame:
    """graph.derive, topk.derived3: the first `top` callers of each origin, as (function, origin, ord); edges(caller, callee, ...), origins(callee)."""
    w = Window.partitionBy("callee").orderBy(*order)
    return edges.join(origins, "callee").withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= top).select(F.col("caller").alias("function"), F.col("callee").alias("origin"), "ord")


def investigation(cases: DataFrame, rule: str, verdict: str, cost: str) -> DataFrame:
    """agg.score_invest: cases, confirmed and rejected ones per rule, and what one proof cost."""
    confirmed = F.count_if(F.col(verdict) == "confirmed")
    return cases.groupBy(rule).agg(F.count("*").alias("cases"), confirmed.alias("confirmed"), F.count_if(F.col(verdict) == "rejected").alias("rejected"), rounded(F.sum(cost) / F.greatest(confirmed, F.lit(1)), 2).alias("cost_per_proof"))


def count_ratio(counts: DataFrame, key: str, fn: str, n: str, pair: Column) -> DataFrame:
    """agg.count_ratio: exact counts of a leaf against those of its caller over the keys that have both; `pair` says which (fn, leaf) belong together."""
    a = counts.select(key, F.col(fn).alias("fn"), F.col(n).alias("_nf"))
    b = counts.select(key, F.col(fn).alias("leaf"), F.col(n).alias("_nl"))
    return a.join(b, key).where(pair).groupBy("fn", "leaf").agg(rounded(F.sum("_nl") / F.sum("_nf")).alias("ratio"))


def file_digest(content: Column, length: int = 12) -> Column:
    """agg.file_digest: the beginning of the content's SHA-1."""
    return F.substring(F.sha1(content.cast("binary")), 1, length)


def map_stats(findings: DataFrame, keys: list[str]) -> DataFrame:
    """agg.map_stats: findings, functions and files per group."""
    return findings.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("function").alias("functions"), F.count_distinct("file").alias("files"))


def different_neighbours(lines: DataFrame, key: str, line_no: str, line: str, name: str) -> DataFrame:
    """win.wallclock_pair, rule sequential-awaits: neighbouring lines that both name something, and not the same thing; `name` is a pattern with one group."""
    p = lines.withColumn("_prev", F.lag(line).over(Window.partitionBy(key).orderBy(line_no)))
    first = lambda c: F.regexp_extract(c, name, 1)
    hit = p.where((first(line) != "") & (first("_prev") != "") & (first(line) != first("_prev")))
    return hit.groupBy(key).agg(F.count("*").alias("pairs"), F.min(line_no).alias("first_line"))
