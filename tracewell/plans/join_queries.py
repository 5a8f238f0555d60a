"""Queries over the joins of the engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals, ledger, resolve
from .adapters import EDGE_CUT, act, bnd, edge, find, fnrange, ival, line, link, some, table, tick, views
from .catalogue import query, whole
from .window_queries import gap_windows

_LICENSE = "regexp_matches(lower(line), 'licen[sc]e')"
DAY = 86_400_000_000


def _license_lines(spark, sf):
    return line(spark, sf).where(F.lower("line").rlike("licen[sc]e")).select("doc_id", "line_no")


@query(
    views("line", "fnrange")
    + f', p AS (SELECT doc_id, line_no FROM line WHERE {_LICENSE}) SELECT doc_id, line_no, fn, "start", "end" FROM (SELECT p.*, fn, "start", "end", row_number() OVER (PARTITION BY p.doc_id, line_no ORDER BY "end" - "start", "start" DESC, fn) AS i FROM p JOIN fnrange f ON p.doc_id = f.doc_id AND line_no BETWEEN "start" AND "end") WHERE i = 1'
)
def enclosing_smallest(spark, sf):
    """join.location, join.lint_owner, join.span_match"""
    out = intervals.enclosing_smallest(_license_lines(spark, sf), fnrange(spark, sf), "doc_id", "line_no", ["doc_id", "line_no"])
    return out.select("doc_id", "line_no", "fn", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(
    views("line", "fnrange")
    + f""", p AS (SELECT doc_id, line_no FROM line WHERE {_LICENSE}), b AS (SELECT * FROM fnrange WHERE fn > 0 AND fn % 2 = 0)
SELECT doc_id, line_no, fn FROM (SELECT p.*, fn, row_number() OVER (PARTITION BY p.doc_id, line_no ORDER BY CASE WHEN "start" <= line_no AND line_no <= "end" THEN 0 ELSE 1 END, CASE WHEN "start" <= line_no AND line_no <= "end" THEN "end" - "start" ELSE "start" END, fn) AS i
FROM p JOIN b ON p.doc_id = b.doc_id AND (line_no BETWEEN "start" AND "end" OR ("start" > line_no AND "start" <= line_no + 8))) WHERE i = 1"""
)
def slack_asof(spark, sf):
    """join.attr_slack, over every second block"""
    ranges = fnrange(spark, sf).where("fn > 0 AND fn % 2 = 0")
    return intervals.slack_asof(_license_lines(spark, sf), ranges, "doc_id", "line_no", ["doc_id", "line_no"]).select("doc_id", "line_no", "fn")


_GAPS = """g AS (SELECT log, t, lag(t) OVER (PARTITION BY log ORDER BY t, ord) AS p FROM tick WHERE fn NOT IN ('view', 'click')),
u AS (SELECT log, count(*) AS n FROM g GROUP BY log),
win AS (SELECT g.log, p AS w0, t AS w1 FROM g JOIN u USING (log) WHERE p IS NOT NULL AND n >= 3 AND t - p >= 600000000)"""


@query(
    views("tick", "ival")
    + ", "
    + _GAPS
    + """ SELECT log, w0, w1, id FROM (SELECT w.*, i.id, row_number() OVER (PARTITION BY w.log, w0 ORDER BY depth DESC, i.id) AS k FROM win w JOIN ival i ON w.log = i.log AND least("end", w1) - greatest("start", w0) >= 0.8 * (w1 - w0)) WHERE k = 1"""
)
def heartbeat_cover(spark, sf):
    """join.heartbeat_cover"""
    w = gap_windows(spark, sf)
    return intervals.covered(w, ival(spark, sf), "log", ["log", "w0"], DAY).select("log", "w0", "w1", "id")


@query(views("tick", "ival") + ", " + _GAPS + """ SELECT log, w0, w1 FROM win w WHERE NOT EXISTS (SELECT 1 FROM ival i WHERE i.log = w.log AND "start" <= w1 AND w0 <= "end" AND least("end", w1) - greatest("start", w0) >= 0.5 * least(w1 - w0, "end" - "start"))""")
def overlap_anti(spark, sf):
    """join.overlap_anti, win.overlap_dedup"""
    return intervals.overlap_anti(gap_windows(spark, sf), ival(spark, sf), "log", ["log", "w0", "w1"], DAY).select("log", "w0", "w1")


_URL = "regexp_replace(url, '[?#].*$', '')"


@query(
    f"""WITH p AS (SELECT DISTINCT {_URL} AS path FROM pages), f AS (SELECT DISTINCT regexp_extract({_URL}, '([^/]+/[^/]+)$', 1) AS file FROM pages WHERE page_id % 3 = 0)
SELECT path, file FROM (SELECT path, file, row_number() OVER (PARTITION BY path ORDER BY length(file) DESC) AS i FROM p JOIN f ON path = file OR suffix(path, '/' || file)) WHERE i = 1"""
)
def path_suffix(spark, sf):
    """join.path_suffix"""
    p = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("path"))
    files = p.where("page_id % 3 = 0").select(F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("file"))
    return intervals.longest_suffix(p, files, "path", "file")


@query(
    """WITH d AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/:?#]+)', 1) AS qual FROM pages), n AS (SELECT DISTINCT regexp_extract(qual, '([^.]+\\.[^.]+\\.[^.]+)$', 1) AS name FROM d),
h AS (SELECT name, max(CASE WHEN qual = name THEN qual END) AS whole, count(CASE WHEN qual <> name THEN 1 END) AS k, max(CASE WHEN qual <> name THEN qual END) AS part FROM n JOIN d ON qual = name OR suffix(qual, '.' || name) WHERE name <> '' GROUP BY name)
SELECT name, coalesce(whole, CASE WHEN k = 1 THEN part END) AS resolved FROM h"""
)
def qualname_unique(spark, sf):
    """join.qualname: host names as dotted definitions"""
    d = table(spark, sf, "pages").select(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1).alias("qual"))
    names = d.select(F.regexp_extract("qual", r"([^.]+\.[^.]+\.[^.]+)$", 1).alias("name")).where("name <> ''")
    return intervals.unique_name(names, d, "name", "qual")


_TIER = "CASE WHEN c.host = d.host THEN 0 WHEN c.lang = d.lang THEN 1 ELSE 2 END"
_SITE = "regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS lang"


@query(
    views("link")
    + f""", c AS (SELECT page_id, ord, lower(name) AS name, {_SITE} FROM link), d AS (SELECT DISTINCT page_id AS def_id, lower(name) AS name, {_SITE} FROM link WHERE ord = 0),
j AS (SELECT c.page_id, c.ord, c.name, d.def_id, {_TIER} AS tier FROM c JOIN d ON c.name = d.name AND c.page_id <> d.def_id),
b AS (SELECT *, min(tier) OVER (PARTITION BY page_id, ord) AS best FROM j), k AS (SELECT *, count(*) OVER (PARTITION BY page_id, ord) AS n FROM b WHERE tier = best)
SELECT page_id, ord, name, def_id, tier, n AS n_candidates FROM k WHERE n <= 4"""
)
def resolve_tiered(spark, sf):
    """join.call_resolve, join.index_build, pred.visible: a page's first link defines its name; same host, then same language, then any"""
    at = lambda df: df.select("page_id", "ord", F.lower("name").alias("name"), F.regexp_extract("url", r"^https?://([^/:?#]+)", 1).alias("host"), F.regexp_extract("url", r"^https?://[^/]+/([a-z]+)/", 1).alias("lang"))
    c = at(link(spark, sf))
    d = c.where("ord = 0").select(F.col("page_id").alias("def_id"), "name", F.col("host").alias("dh"), F.col("lang").alias("dl")).distinct()
    j = c.join(d, "name").where("page_id <> def_id")
    tier = F.when(F.col("host") == F.col("dh"), 0).when(F.col("lang") == F.col("dl"), 1).otherwise(2)
    return resolve.resolve_tiered(j, ["page_id", "ord"], tier).select("page_id", "ord", "name", "def_id", "tier", "n_candidates")


_RULES = [("license", "licen[sc]e"), ("secret", "(token|secret|password|api_key) *="), ("mail", "[a-z0-9._]+@[a-z0-9.]+"), ("address", "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+"), ("bars", "[|]")]


@query(views("line") + ", m AS (SELECT doc_id, line_no, CASE " + " ".join(f"WHEN regexp_matches(lower(line), '{p}') THEN '{n}'" for n, p in _RULES) + " END AS rule FROM line) SELECT rule, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM m WHERE rule IS NOT NULL GROUP BY rule")
def rule_first_match(spark, sf):
    """join.rule_match: the ordered rule table as one CASE"""
    rule = resolve.first_rule([(n, F.lower("line").rlike(p)) for n, p in _RULES])
    m = line(spark, sf).withColumn("rule", rule).where("rule IS NOT NULL")
    return m.groupBy("rule").agg(F.count("*").alias("n_lines"), F.count_distinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc"))


@query(views("act") + " SELECT DISTINCT a.fn AS caller, 'k' AS caller_arg, b.fn AS callee, 'k' AS callee_arg FROM act b JOIN act a ON b.parent = a.id AND b.n = a.n WHERE b.n >= 2 AND a.fn <> b.fn")
def size_flow(spark, sf):
    """join.size_flow"""
    return resolve.size_flow(act(spark, sf).withColumn("arg", F.lit("k")))


_LOCK = 'reg AS (SELECT l_orderkey AS function, l_partkey % 50 AS lock, l_linenumber AS "start", l_linenumber + CAST(l_quantity AS INTEGER) % 3 AS "end" FROM lineitem)'


def _regions(spark, sf):
    i = table(spark, sf, "lineitem")
    return i.select(F.col("l_orderkey").alias("function"), (F.col("l_partkey") % 50).alias("lock"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 3).alias("end"))


@query(f'WITH {_LOCK} SELECT DISTINCT a.function, a.lock AS "outer", b.lock AS "inner" FROM reg a JOIN reg b ON a.function = b.function AND b."start" > a."start" AND b."start" <= a."end" AND a.lock <> b.lock')
def lock_nesting(spark, sf):
    """join.lock_nesting, join.loop_contains: orders are functions, parts are locks, lines are positions"""
    return resolve.lock_pairs(_regions(spark, sf))


@query(f'WITH {_LOCK}, p AS (SELECT DISTINCT a.lock AS o, b.lock AS i FROM reg a JOIN reg b ON a.function = b.function AND b."start" > a."start" AND b."start" <= a."end" AND a.lock <> b.lock) SELECT x.o AS a, x.i AS b FROM p x JOIN p y ON x.o = y.i AND x.i = y.o WHERE x.o < x.i')
def lock_inversion(spark, sf):
    """join.lock_inversion, rule lock-order-inversion"""
    return resolve.lock_inversions(resolve.lock_pairs(_regions(spark, sf)))


@query(views("find") + ", l AS (SELECT s_suppkey AS function, 'Brand#' || CAST(s_nationkey % 5 + 1 AS VARCHAR) || CAST(s_suppkey % 5 + 1 AS VARCHAR) AS rule FROM supplier) SELECT function, rule, EXISTS (SELECT 1 FROM find f WHERE f.function = l.function AND f.rule = l.rule AND f.severity = 'high') AS corroborated FROM l")
def lint_corroborate(spark, sf):
    """join.lint_corroborate, fn.equivalent, sort.leads: suppliers report, high findings of the same brand corroborate"""
    s = table(spark, sf, "supplier")
    rule = F.concat(F.lit("Brand#"), (F.col("s_nationkey") % 5 + 1).cast("string"), (F.col("s_suppkey") % 5 + 1).cast("string"))
    return resolve.split_match(s.select(F.col("s_suppkey").alias("function"), rule.alias("rule")), find(spark, sf).where("severity = 'high'"), ["function", "rule"])


@query(views("find") + ", e AS (SELECT o_orderkey AS order_id, arg_max(o_orderstatus, o_orderkey) AS evidence FROM orders WHERE o_totalprice > 100000 GROUP BY 1) SELECT severity, coalesce(evidence, 'none') AS evidence, count(*) AS n FROM find LEFT JOIN e USING (order_id) GROUP BY ALL")
def evidence_join(spark, sf):
    """join.evidence: the last evidence of an id wins"""
    o = table(spark, sf, "orders").where("o_totalprice > 100000").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("evidence"))
    return ledger.with_evidence(find(spark, sf), o, "order_id", "seq", "evidence").groupBy("severity", "evidence").agg(F.count("*").alias("n"))


@query(
    """WITH t AS (SELECT l_orderkey AS finding, l_suppkey AS file, CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'passed' ELSE 'skipped' END AS outcome FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 3 = 0),
a AS (SELECT finding, count(*) FILTER (outcome <> 'skipped') AS n, count(*) FILTER (outcome = 'passed') AS p FROM t GROUP BY 1), b AS (SELECT file, count(*) FILTER (outcome = 'failed') AS f FROM t GROUP BY 1)
SELECT o_orderkey AS finding, CASE WHEN a.n > 0 AND a.p = a.n THEN 'passed' WHEN a.n > 0 THEN 'failed' WHEN a.n = 0 THEN 'missing' WHEN coalesce(b.f, 0) > 0 THEN 'failed' ELSE 'missing' END AS status FROM orders LEFT JOIN a ON a.finding = o_orderkey LEFT JOIN b ON b.file = o_custkey"""
)
def repro_fallback(spark, sf, whole=False):
    """join.repro: all tests with the id must pass; without one the file can only say failed or missing"""
    i = some(table(spark, sf, "lineitem"), "l_orderkey % 3 = 0", whole).where("l_linenumber = 1")
    t = i.select(F.col("l_orderkey").alias("finding"), F.col("l_suppkey").alias("file"), F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "passed").otherwise("skipped").alias("outcome"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("finding"), F.col("o_custkey").alias("file"))
    return ledger.repro_status(o, t).select("finding", "status")


@query(views("edge") + " SELECT callee % 20 AS name, count(*) AS n, array_to_string(list_transform(list_sort(list(caller * 100000 + attempts))[1:5], lambda x: CAST(x AS VARCHAR)), ',') AS callers FROM edge GROUP BY 1")
def callers_of(spark, sf, whole=False):
    """join.callers: names collide on purpose, their callers merge"""
    e = edge(spark, sf, whole).select((F.col("callee") % 20).alias("name"), (F.col("caller") * 100000 + F.col("attempts")).alias("c"))
    return ledger.callers(e, "name", ["c"], F.col("c")).select("name", "n", F.array_join(F.col("callers").cast("array<string>"), ",").alias("callers"))


@query(views("edge", "bnd") + ", b AS (SELECT caller % 50 AS line, min(edge_ord) AS first_edge FROM edge GROUP BY 1) SELECT function, category, first_edge FROM bnd LEFT JOIN b ON bnd.function % 50 = b.line")
def boundary_at(spark, sf, whole=False):
    """join.b_at, join.e_at: the first edge at a site"""
    first = resolve.first_per_key(edge(spark, sf, whole).withColumn("line", F.col("caller") % 50), ["line"], ["edge_ord"]).select("line", F.col("edge_ord").alias("first_edge"))
    return bnd(spark, sf).withColumn("at", F.col("function") % 50).join(first, F.col("at") == first["line"], "left").select("function", "category", "first_edge")


@query(
    """WITH c AS (SELECT l_orderkey, list(l_suppkey ORDER BY l_linenumber, l_suppkey) AS chain FROM lineitem GROUP BY 1), w AS (SELECT DISTINCT a.l_suppkey AS a, b.l_suppkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_orderkey % 97 = 0)
SELECT DISTINCT c.l_orderkey AS finding FROM c, unnest(generate_series(1, len(chain) - 1)) AS u(i) JOIN w ON chain[i] = w.a AND chain[i + 1] = w.b"""
)
def suppressed_pairs(spark, sf):
    """join.wrong_edge: chains that use a rejected pair of neighbours"""
    i = table(spark, sf, "lineitem")
    chain = i.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"]).alias("chain"))
    a = i.where("l_orderkey % 97 = 0").select("l_orderkey", F.col("l_suppkey").alias("a"), (F.col("l_linenumber") + 1).alias("l_linenumber"))
    wrong = a.join(i.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("b")), ["l_orderkey", "l_linenumber"]).select("a", "b").distinct()
    pairs = chain.select(F.col("l_orderkey").alias("finding"), F.explode(resolve.adjacent_pairs(F.col("chain"))).alias("p")).select("finding", "p.a", "p.b")
    return pairs.join(wrong, ["a", "b"], "left_semi").select("finding").distinct()


@query("SELECT a.c_nationkey AS dir, a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND lower(substr(a.c_mktsegment, 1, 3)) || CAST(a.c_custkey % 40 AS VARCHAR) = lower(substr(b.c_mktsegment, 1, 3)) || CAST(b.c_custkey % 40 AS VARCHAR) AND a.c_custkey < b.c_custkey")
def path_warn(spark, sf):
    """pred.path_warn: siblings whose names differ by case only"""
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("dir"), "c_custkey", F.concat(F.substring("c_mktsegment", 1, 3), (F.col("c_custkey") % 40).cast("string")).alias("name"))
    return ledger.case_clashes(c, "dir", "name", "c_custkey")


@query("WITH e AS (SELECT item_id, regexp_replace(lower(text), '\\s+', ' ', 'g') AS t FROM benchmark), d AS (SELECT doc_id, lang, regexp_replace(lower(text), '\\s+', ' ', 'g') AS t FROM documents) SELECT lang, count(DISTINCT e.item_id) AS items_found, count(*) AS matches FROM d JOIN e ON contains(d.t, e.t) GROUP BY lang")
def bench_coverage(spark, sf):
    """Documents that hold a benchmark text: items by an anchor of four words, then in full; a bench is scored by operators.scoring"""
    fold = lambda c: F.regexp_replace(F.lower(c), r"\s+", " ")
    first = lambda c: F.array_join(F.slice(F.split(c, " "), 2, 4), " ")
    b = table(spark, sf, "benchmark").select("item_id", fold("text").alias("item")).withColumn("key", first("item"))
    d = table(spark, sf, "documents").select("doc_id", "lang", fold("text").alias("t")).withColumn("w", F.split("t", " "))
    grams = d.select("doc_id", "lang", "t", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 3, F.lit(1))), lambda i: F.array_join(F.slice("w", i, 4), " ")))).alias("key"))
    hit = grams.join(b, "key").where(F.contains("t", "item")).select("lang", "doc_id", "item_id").distinct()
    return hit.groupBy("lang").agg(F.count_distinct("item_id").alias("items_found"), F.count("*").alias("matches"))


for _q in (callers_of, boundary_at):
    whole(_q, EDGE_CUT)
whole(repro_fallback, "l_orderkey % 3 = 0")
