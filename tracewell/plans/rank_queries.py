"""Queries over ranking, ledger and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger, rank
from .adapters import find, r, some, table, views
from .catalogue import query, whole

_SCORE = "round(CASE severity WHEN 'high' THEN 5.0 WHEN 'medium' THEN 3.0 WHEN 'low' THEN 1.0 ELSE 0.5 END::DOUBLE * CASE confidence WHEN 'exact' THEN 1.0 WHEN 'scip' THEN 1.0 WHEN 'unique' THEN 0.9 ELSE 0.5 END::DOUBLE * CASE status WHEN 'F' THEN 1.5 WHEN 'O' THEN 1.0 ELSE 0.7 END::DOUBLE * CASE WHEN rule < 'Brand#3' THEN 1.2 ELSE 1.0 END::DOUBLE + least(quantity / 10, 1.0::DOUBLE) + 1e-9, 3) + 0.0"
_FIND = views("find") + f", f AS (SELECT *, {_SCORE} AS score FROM find WHERE ord % 7 = 0)"


def _scored(spark, sf, whole=False):
    f = some(find(spark, sf), "ord % 7 = 0", whole)
    evidence = F.when(F.col("status") == "F", 1.5).when(F.col("status") == "O", 1.0).otherwise(0.7)
    rule = F.when(F.col("rule") < "Brand#3", 1.2).otherwise(1.0)
    return f.withColumn("score", rank.score(F.col("severity"), F.col("confidence"), evidence, rule, F.col("quantity")))


@query(_FIND + " SELECT severity, confidence, status, round(min(score), 3) + 0.0 AS lo, round(max(score), 3) + 0.0 AS hi, count(*) AS n FROM f GROUP BY ALL")
def score_queue(spark, sf, whole=False):
    """fn.score"""
    return _scored(spark, sf, whole).groupBy("severity", "confidence", "status").agg(r(F.min("score"), 3).alias("lo"), r(F.max("score"), 3).alias("hi"), F.count("*").alias("n"))


_RULES = ("lock-across-await", "sql-injection", "unbounded-retry", "io-in-loop", "recursion")
_EVIDENCE = ("confirmed", "measured", "not-verifiable", "not-exercised", "not-observed", "none")


@query(
    views("find")
    + """, w AS (SELECT severity, confidence, file % 6 AS e, line % 5 AS k, quantity FROM find)
SELECT severity, confidence, CAST(e AS INTEGER) AS e, CAST(k AS INTEGER) AS k, count(*) AS n, round(max(CASE severity WHEN 'high' THEN 5 WHEN 'medium' THEN 3 WHEN 'low' THEN 1 ELSE 0.5 END::DOUBLE * CASE confidence WHEN 'exact' THEN 1 WHEN 'scip' THEN 1 WHEN 'unique' THEN 0.9 ELSE 0.5 END::DOUBLE
 * CASE e WHEN 0 THEN 1.5 WHEN 1 THEN 1.2 WHEN 4 THEN 0.3 ELSE 1 END::DOUBLE * CASE k WHEN 0 THEN 1.6 WHEN 1 THEN 1.5 WHEN 2 THEN 1.3 WHEN 3 THEN 0.8 ELSE 1 END::DOUBLE + least(quantity / 10, 1)) + 1e-9, 3) + 0.0 AS hi FROM w GROUP BY ALL"""
)
def weighed_scores(spark, sf):
    """fn.score from the tables of severities, confidences, evidence and rules"""
    f = find(spark, sf).withColumns({"e": F.col("file") % 6, "k": (F.col("line") % 5).cast("int")})
    name = lambda names, i: F.element_at(F.array(*map(F.lit, names)), F.col(i) + 1)
    s = rank.weighed(F.col("severity"), F.col("confidence"), name(_EVIDENCE, "e"), name(_RULES, "k"), F.col("quantity"))
    return f.groupBy("severity", "confidence", "e", "k").agg(F.count("*").alias("n"), r(F.max(s), 3).alias("hi"))


_REASON = "CASE WHEN status = 'P' THEN 'recorded' WHEN confidence = 'name' AND severity = 'info' THEN 'low confidence' WHEN file % 10 = 0 THEN 'suppressed' WHEN severity = 'info' THEN 'info' END"


@query(_FIND + f" SELECT coalesce({_REASON}, 'queued') AS reason, count(*) AS n, count(DISTINCT function) AS functions FROM f GROUP BY 1")
def skip_reason(spark, sf, whole=False):
    """fn.skip_reason"""
    f = _scored(spark, sf, whole)
    reason = rank.skip_reason([("recorded", F.col("status") == "P"), ("low confidence", (F.col("confidence") == "name") & (F.col("severity") == "info")), ("suppressed", F.col("file") % 10 == 0), ("info", F.col("severity") == "info")])
    return f.groupBy(F.coalesce(reason, F.lit("queued")).alias("reason")).agg(F.count("*").alias("n"), F.count_distinct("function").alias("functions"))


@query(_FIND + " SELECT rule, file, ord, round(score, 3) + 0.0 AS score, covers FROM (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY rule, file) - 1 AS covers FROM f WINDOW w AS (PARTITION BY rule, file ORDER BY score DESC, ord, function)) WHERE i = 1")
def same_effect(spark, sf, whole=False):
    """agg.same_effect"""
    return rank.same_effect(_scored(spark, sf, whole), ["rule", "file"], [F.desc("score"), "ord", "function"]).select("rule", "file", "ord", r(F.col("score"), 3).alias("score"), "covers")


_UNIQUE = ", u AS (SELECT function, min(ord) AS id, score FROM f GROUP BY function, score)"


@query(
    _FIND
    + _UNIQUE
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY function ORDER BY score DESC, id) AS rn FROM u), g AS (SELECT function, arg_min(id, rn) AS id, count(*) AS n, list(score ORDER BY rn) AS ss FROM n WHERE rn <= 8 GROUP BY function)
SELECT function, id, n, list_reduce(ss, lambda a, x: round(a + 0.25 * x + 1e-9, 3)) + 0.0 AS score FROM g UNION ALL SELECT function, id, 1, score FROM n WHERE rn > 8"""
)
def by_function(spark, sf, whole=False):
    """agg.by_function: overflow findings are items of their own"""
    u = _scored(spark, sf, whole).groupBy("function", "score").agg(F.min("ord").alias("id"))
    return rank.by_function(u, "function", [F.desc("score"), "id"])


@query(_FIND + _UNIQUE + " SELECT function, id, score FROM u ORDER BY CASE WHEN score < 2 THEN 1 ELSE 0 END, score DESC, id, function LIMIT 6")
def take(spark, sf, whole=False):
    """sort.queue; the slots of a round are operators.scoring.round_slots"""
    u = _scored(spark, sf, whole).groupBy("function", "score").agg(F.min("ord").alias("id"))
    return rank.take(u, F.col("score") < 2).select("function", "id", "score")


@query()
def batches_first_fit(spark, sf):
    """agg.batches: packing is sequential, so there is no SQL twin; tests hold it against a plain loop"""
    f = find(spark, sf).groupBy("file", "function").agg(F.count("*").alias("findings"), F.sum(F.col("quantity") * 20).cast("long").alias("chars"))
    return rank.batches(f, ["file"], "function").select("file", "function", "findings", "chars", "batch")


@query("SELECT o_custkey AS finding, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) = 1 AS proof, CASE arg_max(o_orderstatus, o_orderkey) WHEN 'F' THEN 'confirmed' WHEN 'P' THEN 'rejected' ELSE 'open' END AS verdict, CASE WHEN arg_max(o_orderstatus, o_orderkey) = 'F' THEN 'proven' WHEN arg_max(o_orderstatus, o_orderkey) = 'P' THEN 'rejected' WHEN max(o_totalprice) > 300000 THEN 'observed' WHEN max(o_totalprice) > 200000 THEN 'not-observed' ELSE 'unverified' END AS status FROM orders GROUP BY 1")
def status_final(spark, sf):
    """fn.status, agg.latest"""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("finding")).agg((F.max(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)) == 1).alias("proof"), F.max_by("o_orderstatus", "o_orderkey").alias("last"), F.max("o_totalprice").alias("top"))
    o = o.withColumn("verdict", F.when(F.col("last") == "F", "confirmed").when(F.col("last") == "P", "rejected").otherwise("open"))
    evidence = F.when(F.col("top") > 300000, "measured").when(F.col("top") > 200000, "not-observed").otherwise("not-exercised")
    return o.select("finding", "proof", "verdict", rank.status(F.col("verdict"), evidence, F.col("proof")).alias("status"))


@query(views("find") + " SELECT CASE status WHEN 'F' THEN 'proven' WHEN 'O' THEN 'observed' ELSE 'rejected' END AS state, CASE WHEN quantity > 40 AND severity = 'high' THEN 'medium' WHEN quantity > 40 THEN 'low' ELSE severity END AS severity, count(*) AS n FROM find GROUP BY ALL")
def conditional(spark, sf):
    """pred.conditional, proj.severity_downgrade, sort.report: evidence that needed injected latency counts less"""
    f = find(spark, sf)
    state = F.when(F.col("status") == "F", "proven").when(F.col("status") == "O", "observed").otherwise("rejected")
    severity = F.when(F.col("quantity") > 40, rank.downgrade(F.col("severity"))).otherwise(F.col("severity"))
    return f.groupBy(state.alias("state"), severity.alias("severity")).agg(F.count("*").alias("n"))


@query(views("find") + " SELECT severity, count(*) AS n, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END <= 1 AS blocks FROM find GROUP BY severity")
def severity_gate(spark, sf):
    """sink.gate"""
    f = find(spark, sf).groupBy("severity").agg(F.count("*").alias("n"))
    return f.withColumn("blocks", rank.lookup(F.col("severity"), rank.SEVERITY_RANK, 3) <= 1)


@query(views("find") + " SELECT rule, severity, function, ord, substr(rule || ' in ' || CAST(function AS VARCHAR), 1, 240) AS message FROM find ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, file, line, rule, ord, function LIMIT 10")
def mcp_preview(spark, sf):
    """sink.summary, sort.findings, topk.preview10"""
    f = find(spark, sf).orderBy(rank.lookup(F.col("severity"), rank.SEVERITY_RANK, 3), "file", "line", "rule", "ord", "function").limit(10)
    return f.select("rule", "severity", "function", "ord", F.substring(F.concat("rule", F.lit(" in "), F.col("function").cast("string")), 1, 240).alias("message"))


@query(views("find") + " SELECT DISTINCT rule || '@' || CAST(function AS VARCHAR) || ':' || CAST(line AS VARCHAR) AS id, function, line FROM find WHERE severity = 'high' AND ord % 5 = 0")
def finding_ids(spark, sf, whole=False):
    """proj.finding_id, proj.id_split, proj.rule_base: the id is made and taken apart again"""
    f = some(find(spark, sf), "ord % 5 = 0", whole).where("severity = 'high'")
    ids = f.select(ledger.finding_id(F.col("rule"), F.col("function"), F.col("line")).alias("id")).distinct()
    parts = ledger.id_parts(F.col("id"))
    return ids.select("id", parts["function"].alias("function"), parts["line"].alias("line"))


@query("SELECT user_id AS function FROM events WHERE event_type = 'signup' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 40) GROUP BY user_id")
def unflagged(spark, sf):
    """set.unflagged, rule unflagged-hotspot"""
    e = table(spark, sf, "events").withColumnRenamed("user_id", "function")
    return ledger.without(e.where("event_type = 'signup'").select("function").distinct(), e.where("event_type = 'error' AND value > 40"), "function")


@query("SELECT l_suppkey AS leaf, count(*) AS n, round(max(l_quantity), 2) + 0.0 AS worst_s FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 2000) GROUP BY 1")
def unpredicted(spark, sf):
    """set.unpredicted, sort.stalls"""
    s = table(spark, sf, "supplier").where("s_acctbal < 2000").select(F.col("s_suppkey").alias("leaf"))
    stalls = table(spark, sf, "lineitem").where("l_returnflag = 'R'").withColumnRenamed("l_suppkey", "leaf")
    return ledger.without(stalls, s, "leaf").groupBy("leaf").agg(F.count("*").alias("n"), r(F.max("l_quantity"), 2).alias("worst_s"))


@query("SELECT id FROM (SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'P' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0) EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def pending(spark, sf):
    """set.union_distinct, set.except: issued less recorded"""
    o = table(spark, sf, "orders")
    issued = [o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")), table(spark, sf, "customer").where("c_acctbal < 0").select("c_custkey")]
    return ledger.pending(issued, o.where("o_orderstatus = 'F'").select("o_custkey"))


@query("SELECT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT p_partkey FROM part WHERE p_size > 40")
def planted_proven(spark, sf):
    """set.intersect"""
    return ledger.proven(table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("id")), table(spark, sf, "part").where("p_size > 40").select("p_partkey"))


@query(views("act", "io") + " SELECT source, fn, count(*) AS n FROM (SELECT 'calls' AS source, fn, dur FROM act UNION ALL SELECT 'io', system, dur FROM io UNION ALL SELECT 'stalls', fn, dur FROM act WHERE dur > 100) GROUP BY ALL")
def collect_channels(spark, sf):
    """src.collect, set.union_all"""
    from .adapters import act, io

    a = act(spark, sf)
    out = ledger.collect({"calls": a.select("fn"), "io": io(spark, sf).select(F.col("system").alias("fn")), "stalls": a.where("dur > 100").select("fn")})
    return out.groupBy("source", "fn").agg(F.count("*").alias("n"))


@query("SELECT function, stmt, kind, ord FROM (SELECT l_orderkey AS function, l_linenumber AS stmt, l_returnflag AS kind, l_partkey AS ord, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_returnflag ORDER BY l_partkey, l_suppkey) AS i FROM lineitem) WHERE i = 1")
def dedup_boundary(spark, sf):
    """set.dedup_boundary, sort.edges_by_conf: one boundary per function, statement and kind"""
    from ..operators.resolve import first_per_key

    i = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("function"), F.col("l_linenumber").alias("stmt"), F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias("ord"), "l_suppkey")
    return first_per_key(i, ["function", "stmt", "kind"], ["ord", "l_suppkey"]).drop("l_suppkey")


@query("SELECT l.lang AS rule, count(*) AS expected, count(*) FILTER (predicted) AS found, round(count(*) FILTER (predicted) / count(*), 4) + 0.0 AS recall FROM (SELECT d.doc_id, lang, contains(d.text, '###') OR contains(d.text, '!!') OR length(d.text) < 120 AS predicted FROM documents d JOIN labels b USING (doc_id) WHERE quality = 0) l GROUP BY l.lang")
def eval_recall(spark, sf):
    """How many of the labelled documents a plain rule finds; expected findings are scored by operators.scoring"""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels").where("quality = 0"), "doc_id")
    found = F.contains("text", F.lit("###")) | F.contains("text", F.lit("!!")) | (F.length("text") < 120)
    return d.groupBy(F.col("lang").alias("rule")).agg(F.count("*").alias("expected"), F.count_if(found).alias("found"), r(F.count_if(found) / F.count("*")).alias("recall"))


@query("SELECT l_linenumber AS rule, count(*) AS cases, count(*) FILTER (l_returnflag = 'R') AS confirmed, count(*) FILTER (l_returnflag = 'A') AS rejected, round(sum(l_extendedprice) / greatest(count(*) FILTER (l_returnflag = 'R'), 1), 2) + 0.0 AS cost_per_proof FROM lineitem GROUP BY 1")
def score_investigation(spark, sf):
    """agg.score_invest"""
    verdict = F.when(F.col("l_returnflag") == "R", "confirmed").when(F.col("l_returnflag") == "A", "rejected").otherwise("inconclusive")
    i = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("rule"), verdict.alias("verdict"), "l_extendedprice")
    return ledger.investigation(i, "rule", "verdict", "l_extendedprice")


@query("SELECT o_orderpriority AS file, count(*) FILTER (o_orderstatus = 'F') AS passed, count(*) FILTER (o_orderstatus = 'O') AS failed, count(*) FILTER (o_orderstatus = 'P') AS skipped, CASE WHEN count(*) FILTER (o_orderstatus = 'O') > 0 THEN 1 ELSE 0 END AS exit_code FROM orders GROUP BY 1")
def repro_counts(spark, sf):
    """agg.repro_counts"""
    outcome = rank.lookup(F.col("o_orderstatus"), {"F": "passed", "O": "failed", "P": "skipped"})
    return ledger.repro_counts(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("file"), outcome.alias("outcome")))


@query("SELECT c_custkey AS finding, c_acctbal < 0 AND c_custkey % 2 = 0 AS contradicts FROM customer WHERE c_custkey % 3 = 0")
def contradicts(spark, sf, whole=False):
    """pred.contradicts: a confirmed stall without a measured lag is refused"""
    c = some(table(spark, sf, "customer"), "c_custkey % 3 = 0", whole)
    state = F.when(F.col("c_custkey") % 2 == 0, "confirmed").otherwise("open")
    return c.select(F.col("c_custkey").alias("finding"), rank.confirmed_without_stall(state, F.when(F.col("c_acctbal") < 0, 0.0).otherwise(1.0)).alias("contradicts"))


whole(score_queue, "ord % 7 = 0")
whole(skip_reason, "ord % 7 = 0")
whole(same_effect, "ord % 7 = 0")
whole(by_function, "ord % 7 = 0")
whole(take, "ord % 7 = 0")
whole(finding_ids, "ord % 5 = 0")
whole(contradicts, "c_custkey % 3 = 0")
