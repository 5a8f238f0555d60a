"""Queries over recordings: statistics, fits and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger, stats
from .adapters import EDGE_CUT, act, bnd, edge, find, io, r, some, table, views
from .catalogue import query, whole

_P95 = """SELECT {k}, sum(CASE WHEN n = 1 THEN v WHEN i = lo THEN v * (20 - (19 * (n + 1) - 20 * lo)) / 20 WHEN i = lo + 1 THEN v * (19 * (n + 1) - 20 * lo) / 20 ELSE 0.0 END) AS p95
 FROM (SELECT *, greatest(1, least(n - 1, (19 * (n + 1)) // 20)) AS lo FROM (SELECT {k}, dur AS v, row_number() OVER (PARTITION BY {k} ORDER BY dur) AS i, count(*) OVER (PARTITION BY {k}) AS n FROM {t})) GROUP BY {k}"""
_STATS = views("act") + ", q AS (" + _P95.format(k="fn", t="act") + ") SELECT a.fn, calls, total_s, p50_s, max_s, round(p95, 4) + 0.0 AS p95_s FROM (SELECT fn, count(*) AS calls, round(sum(dur), 4) + 0.0 AS total_s, round(quantile_cont(dur, 0.5), 4) + 0.0 AS p50_s, round(max(dur), 4) + 0.0 AS max_s FROM act GROUP BY fn) a JOIN q USING (fn)"


@query(_STATS)
def trace_fn_stats(spark, sf):
    """agg.fn_stats"""
    return stats.fn_stats(act(spark, sf))


@query(views("act") + ", c AS (SELECT parent AS id, sum(dur) AS d FROM act WHERE parent IS NOT NULL GROUP BY 1) SELECT act.id, fn, round(greatest(dur - coalesce(d, 0), 0), 4) + 0.0 AS self_s FROM act LEFT JOIN c USING (id) ORDER BY round(greatest(dur - coalesce(d, 0), 0), 4) DESC, act.id LIMIT 50")
def trace_slow_top(spark, sf):
    """agg.self_time, sort.slow"""
    s = stats.self_time(act(spark, sf)).select("id", "fn", r(F.col("self_s")).alias("self_s"))
    return s.orderBy(F.desc("self_s"), "id").limit(50)


@query(views("act") + ", q AS (" + _P95.format(k="thread", t="act") + ") SELECT thread, round(p95, 4) + 0.0 AS p95_s FROM q")
def p95_exclusive(spark, sf):
    """agg.fn_stats, the exclusive quantile alone"""
    return stats.p95_exclusive(act(spark, sf), ["thread"], "dur").select("thread", r(F.col("p95")).alias("p95_s"))


@query(views("io") + " SELECT pid, system, count(*) AS n, CAST(sum(CAST(error AS BIGINT)) AS BIGINT) AS errors, round(quantile_cont(dur, 0.5), 4) + 0.0 AS p50_s, round(max(dur), 4) + 0.0 AS max_s, array_to_string(list_sort(list(DISTINCT target))[1:5], ',') AS targets FROM io GROUP BY ALL")
def io_stats(spark, sf):
    """agg.io_stats, agg.distinct, topk.targets5"""
    return stats.io_stats(io(spark, sf), ["pid", "system"])


@query(
    views("io")
    + ", q AS ("
    + _P95.format(k="system, target", t="io")
    + """), w AS (SELECT io.system, io.target, array_to_string(list_sort(list(DISTINCT a.fn))[1:5], ',') AS callers FROM io LEFT JOIN act a ON a.id = io.parent GROUP BY ALL)
SELECT b.*, round(p95, 4) + 0.0 AS p95_s, coalesce(callers, '') AS callers FROM (SELECT system, target, count(*) AS n, CAST(sum(CAST(error AS BIGINT)) AS BIGINT) AS errors, round(quantile_cont(dur, 0.5), 4) + 0.0 AS p50_s, round(max(dur), 4) + 0.0 AS max_s FROM io GROUP BY ALL) b JOIN q USING (system, target) JOIN w USING (system, target) ORDER BY max_s DESC, system, target LIMIT 50"""
)
def external_calls(spark, sf):
    """agg.external, sort.slow, topk.callers5"""
    callers = act(spark, sf).select(F.col("id").alias("parent"), F.col("fn").alias("caller"))
    return stats.external_calls(io(spark, sf), callers)


@query("SELECT event_type AS fn, CASE WHEN value >= 100 THEN 'confirmed' WHEN value >= 50 THEN 'measured' WHEN value > 0 THEN 'not-observed' ELSE 'not-exercised' END AS status, count(*) AS n FROM events GROUP BY ALL")
def evidence_status_counts(spark, sf):
    """agg.status"""
    status = F.when(F.col("dur") >= 100, "confirmed").when(F.col("dur") >= 50, "measured").when(F.col("dur") > 0, "not-observed").otherwise("not-exercised")
    return act(spark, sf).groupBy("fn", status.alias("status")).agg(F.count("*").alias("n"))


_FIT = """f AS (SELECT fn, count(*) AS sizes, max(n) / min(n) AS span, max(d) AS mx, round(regr_slope(ln(d), ln(n)), 4) + 0.0 AS exponent, round(regr_intercept(ln(d), ln(n)), 4) + 0.0 AS intercept, round(coalesce(regr_r2(ln(d), ln(n)), 1.0), 4) + 0.0 AS r2, max(n) AS largest
 FROM (SELECT fn, n, quantile_cont(dur, 0.5) AS d FROM act WHERE n > 0 AND dur > 0 GROUP BY ALL) GROUP BY fn HAVING count(*) >= 4 AND max(n) / min(n) >= 10 AND max(d) >= 0.001)"""
_LABEL = "CASE WHEN exponent < 0.2 THEN 'O(1)' WHEN exponent < 0.8 THEN 'sublinear' WHEN exponent < 1.2 THEN 'O(n)' WHEN exponent < 1.7 THEN 'O(n log n)' WHEN exponent < 2.3 THEN 'O(n^2)' WHEN exponent < 3.3 THEN 'O(n^3)' ELSE 'steeper' END"


@query(views("act") + ", " + _FIT + f" SELECT fn, sizes, exponent, intercept, r2, largest, {_LABEL} AS label FROM f")
def fit_power(spark, sf):
    """agg.fit_power, agg.fit_label, sort.fits"""
    f = stats.fit_power(act(spark, sf), ["fn"])
    return f.withColumn("label", stats.fit_label(F.col("exponent")))


def _part_points(spark, sf):
    """Two candidate arguments per brand: the part size squared drives the duration, the price hardly does."""
    p = table(spark, sf, "part")
    d = F.pow(F.col("p_size").cast("double"), F.lit(2.0)) / 1000 + F.col("p_partkey") % 3 * 0.001
    a = p.select(F.col("p_brand").alias("fn"), F.lit("size").alias("arg"), F.col("p_size").cast("long").alias("n"), d.alias("dur"))
    return a.unionByName(p.select(F.col("p_brand").alias("fn"), F.lit("key").alias("arg"), (F.col("p_partkey") % 50 + 1).alias("n"), d.alias("dur")))


_PART = """act AS (SELECT p_brand AS fn, 'size' AS arg, CAST(p_size AS BIGINT) AS n, pow(CAST(p_size AS DOUBLE), 2.0) / 1000 + p_partkey % 3 * 0.001 AS dur FROM part
 UNION ALL SELECT p_brand, 'key', p_partkey % 50 + 1, pow(CAST(p_size AS DOUBLE), 2.0) / 1000 + p_partkey % 3 * 0.001 FROM part), """ + _FIT.replace("SELECT fn, count", "SELECT fn, arg, count").replace("SELECT fn, n", "SELECT fn, arg, n").replace("GROUP BY fn HAVING", "GROUP BY fn, arg HAVING")


@query("WITH " + _PART + " SELECT fn, arg, exponent, r2 FROM (SELECT *, row_number() OVER (PARTITION BY fn ORDER BY r2 DESC, arg) AS i FROM f) WHERE i = 1")
def best_fit(spark, sf):
    """agg.best_fit"""
    return stats.best_fit(stats.fit_power(_part_points(spark, sf), ["fn", "arg"]), ["fn"]).select("fn", "arg", "exponent", "r2")


@query("WITH " + _PART + " SELECT fn, arg, exponent, largest * 100 AS assumed_n, round(exp(intercept) * pow(largest * 100, exponent), 3) + 0.0 AS predicted_s, round(exp(intercept) * pow(largest * 100, exponent), 3) + 0.0 >= greatest(1.0, 10 * exp(intercept) * pow(largest, exponent)) AS risk FROM f WHERE exponent >= 1.3 AND r2 >= 0.8")
def projections(spark, sf):
    """agg.projections, agg.predict, sort.projections"""
    f = stats.fit_power(_part_points(spark, sf), ["fn", "arg"])
    return stats.projections(f, F.col("largest") * 100).select("fn", "arg", "exponent", "assumed_n", "predicted_s", "risk")


@query(views("act") + ", per AS (SELECT p.fn AS parent_fn, c.parent, count(*) AS n FROM act c JOIN act p ON p.id = c.parent WHERE c.fn IN ('click', 'view') GROUP BY ALL) SELECT parent_fn, count(*) AS activations, max(n) AS fanout_max, round(avg(n), 4) + 0.0 AS fanout_mean FROM per GROUP BY parent_fn")
def fanout(spark, sf):
    """agg.fanout, join.parent"""
    a = act(spark, sf)
    c = a.where("parent IS NOT NULL").join(a.select(F.col("id").alias("parent"), F.col("fn").alias("parent_fn")), "parent")
    return stats.fanout(c, F.col("fn").isin("click", "view"))


@query("SELECT a.event_type AS fn, b.event_type AS leaf, round(count(DISTINCT b.event_id) / count(DISTINCT a.event_id), 4) + 0.0 AS ratio FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY ALL")
def count_ratio(spark, sf):
    """agg.count_ratio: exact counts of a leaf against those of its caller, over the users that have both"""
    a = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return ledger.count_ratio(a, "user_id", "event_type", "n", F.col("fn") < F.col("leaf"))


@query("SELECT p_brand AS name, min(p_size) AS value FROM part WHERE p_partkey % 40 = 0 GROUP BY p_brand HAVING min(p_size) = max(p_size)")
def constants_consistent(spark, sf, whole=False):
    """agg.constants: part keys divisible by 40 are the definitions"""
    return stats.constants(some(table(spark, sf, "part"), "p_partkey % 40 = 0", whole).withColumnRenamed("p_brand", "name"), "name", "p_size")


@query("SELECT p_partkey // 3 AS name, min(p_size % 4) AS value FROM part GROUP BY 1 HAVING min(p_size % 4) = max(p_size % 4)")
def constants_consistent_whole(spark, sf):
    """agg.constants: every part is a definition, three of a name"""
    p = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 3).alias("name"), (F.col("p_size") % 4).alias("value"))
    return stats.constants(p, "name", "value")


@query("SELECT c_nationkey AS receiver, CASE WHEN count(DISTINCT c_mktsegment) = 1 THEN max(c_mktsegment) END AS cls FROM customer WHERE c_custkey % 29 = 0 GROUP BY 1")
def instances_of(spark, sf, whole=False):
    """agg.instances"""
    return stats.instances(some(table(spark, sf, "customer"), "c_custkey % 29 = 0", whole).withColumnRenamed("c_nationkey", "receiver"), "receiver", "c_mktsegment")


@query(
    views("find", "edge", "bnd")
    + """, d AS (SELECT function, max(line) AS loop_depth FROM find WHERE quantity >= 45 GROUP BY 1)
SELECT function, round(CAST(sev AS DOUBLE) + 2 * greatest(coalesce(loop_depth, 0) - 1, 0) + 0.5 * least(coalesce(fan_in, 0), 10) + coalesce(n_bnd, 0), 2) + 0.0 AS score
FROM (SELECT function, sum(CASE severity WHEN 'high' THEN 5.0 WHEN 'medium' THEN 2.0 WHEN 'low' THEN 0.5 ELSE 1.0 END) AS sev FROM find GROUP BY 1)
LEFT JOIN (SELECT callee AS function, count(*) AS fan_in FROM edge GROUP BY 1) USING (function) LEFT JOIN (SELECT function, count(*) AS n_bnd FROM bnd GROUP BY 1) USING (function) LEFT JOIN d USING (function) ORDER BY score DESC, function DESC LIMIT 25"""
)
def hotspots(spark, sf, whole=False):
    """agg.hotspots, topk.hotspots25"""
    f = find(spark, sf)
    depth = f.where("quantity >= 45").groupBy("function").agg(F.max("line").alias("loop_depth"))
    return stats.hotspots(f, edge(spark, sf, whole), depth, bnd(spark, sf))


@query("SELECT o_custkey AS finding, count(*) AS attempts, arg_max(o_orderstatus, o_orderkey) AS verdict, max(o_orderkey) AS seq FROM orders GROUP BY 1")
def latest_verdict(spark, sf):
    """agg.latest"""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("finding"), F.col("o_orderstatus").alias("verdict"), F.col("o_orderkey").alias("seq"))
    return stats.latest(o, "finding", "seq", ["verdict", "seq"])


@query(views("find") + " SELECT severity, confidence, count(*) AS n, count(DISTINCT function) AS functions, count(DISTINCT file) AS files FROM find GROUP BY ALL")
def map_stats(spark, sf):
    """agg.map_stats"""
    return ledger.map_stats(find(spark, sf), ["severity", "confidence"])


@query("SELECT page_id, substr(sha1(html), 1, 12) AS digest FROM pages")
def file_digest(spark, sf):
    """agg.file_digest"""
    return table(spark, sf, "pages").select("page_id", ledger.file_digest(F.col("html")).alias("digest"))


@query("SELECT p_brand, sha256(string_agg(CAST(p_partkey AS VARCHAR) || ':' || h, ',' ORDER BY p_partkey)) AS fingerprint FROM (SELECT p_brand, p_partkey, sha256(p_name) AS h FROM part) GROUP BY p_brand")
def fingerprint(spark, sf):
    """agg.fingerprint: one digest over the sorted digests of a group's members"""
    p = table(spark, sf, "part").select("p_brand", "p_partkey", F.sha2(F.col("p_name").cast("binary"), 256).alias("h"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "h"))), lambda x: F.concat_ws(":", x["p_partkey"].cast("string"), x["h"]))
    return p.groupBy("p_brand").agg(F.sha2(F.array_join(rows, ",").cast("binary"), 256).alias("fingerprint"))


whole(hotspots, EDGE_CUT)
whole(instances_of, "c_custkey % 29 = 0")
