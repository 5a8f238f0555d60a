"""Source readers over recordings that are made from the driver's tables: a document per part, supplier, order or user.

The Spark side writes each document as text, as a recorder would, and reads it back with the source's reader; the twin
says what the reader must find, straight from the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scoring
from ..operators.graph import cut, shared_folder
from ..operators.parts import dealt, parts_of
from ..sources import manifests, otlp, recordings, stores, wire
from .adapters import act, by_order, find, micros, r, table, views
from .catalogue import query


def _text(*parts):
    """Concatenation of columns and literal texts."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _orders(spark, sf) -> DataFrame:
    """(profile, m): an order and the number of its lines."""
    i = table(spark, sf, "lineitem")
    # by the name that the documents have, so that their events stay in the parts of their lines
    return dealt(i.select(F.col("l_orderkey").cast("string").alias("profile")), parts_of(i.count()), "profile").groupBy("profile").agg(F.count("*").cast("int").alias("m"))


def _spans(spark, sf) -> DataFrame:
    """One file a user with a span for each of the user's events."""
    e = table(spark, sf, "events").withColumn("ns", micros("ts") * 1000)
    span = F.struct(
        F.lpad(F.lower(F.hex("user_id")), 32, "0").alias("traceId"),
        F.lpad(F.lower(F.hex("event_id")), 16, "0").alias("spanId"),
        F.when(F.col("event_id") % 2 == 1, F.lpad(F.lower(F.hex(F.col("event_id") - 1)), 16, "0")).alias("parentSpanId"),
        F.col("event_type").alias("name"),
        F.when(F.col("event_type") == "view", "SPAN_KIND_SERVER").otherwise("SPAN_KIND_CLIENT").alias("kind"),
        F.col("ns").cast("string").alias("startTimeUnixNano"),
        (F.col("ns") + F.col("event_id") * 7).cast("string").alias("endTimeUnixNano"),
        F.struct(F.when(F.col("event_type") == "error", 2).otherwise(1).alias("code")).alias("status"),
        F.array(F.struct(F.lit("tenant").alias("key"), F.struct((F.col("user_id") % 9).cast("string").alias("intValue")).alias("value"))).alias("attributes"),
    )
    doc = e.groupBy("user_id").agg(F.collect_list(span).alias("spans"))
    body = F.to_json(F.struct(F.array(F.struct(F.array(F.struct("spans")).alias("scopeSpans"))).alias("resourceSpans")))
    return doc.select(_text("user-", F.col("user_id"), ".json").alias("path"), body.cast("binary").alias("content"))


@query("SELECT lpad(lower(to_hex(event_id)), 16, '0') AS span_id, CASE WHEN event_id % 2 = 1 THEN lpad(lower(to_hex(event_id - 1)), 16, '0') ELSE '' END AS parent_id, event_type AS name, CASE WHEN event_type = 'view' THEN 2 ELSE 3 END AS kind, CAST(event_id * 7 AS BIGINT) AS dur_ns, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS status, CAST(user_id % 9 AS VARCHAR) AS tenant FROM events")
def otlp_explode(spark, sf):
    """src.otlp_json, src.otlp_file, src.otlp_id, fn.any_value"""
    s = otlp.spans(_spans(spark, sf))
    return s.select("span_id", "parent_id", "name", "kind", (F.col("end_ns") - F.col("start_ns")).alias("dur_ns"), "status", F.col("attrs")["tenant"].alias("tenant"))


def _sampled(spark, sf) -> DataFrame:
    """One sampled profile an order: a line is a sample as deep as its number, as long as its quantity, in the order's unit."""
    i = by_order(spark, sf)
    x = F.struct(F.sequence(F.lit(0), F.col("l_linenumber").cast("int") - 1).alias("s"), F.col("l_quantity").alias("w"))
    d = i.groupBy(F.col("l_orderkey").alias("profile")).agg(F.collect_list(x).alias("xs"))
    unit = F.when(F.col("profile") % 2 == 0, "milliseconds").otherwise("seconds")
    frames = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.struct(_text("step", k).alias("name"), F.lit("flow.py").alias("file"), (k * 11 + 2).alias("line")))
    p = F.struct(F.lit("sampled").alias("type"), _text("order ", F.col("profile")).alias("name"), unit.alias("unit"), F.lit(0).alias("startValue"), F.col("xs.s").alias("samples"), F.col("xs.w").alias("weights"))
    return d.select(F.col("profile").cast("string").alias("profile"), F.to_json(F.struct(F.struct(frames.alias("frames")).alias("shared"), F.array(p).alias("profiles"))).alias("value"))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS profile, 0 AS thread, CAST(count(*) AS INTEGER) AS samples, round(sum(l_quantity) * CASE WHEN l_orderkey % 2 = 0 THEN 0.001 ELSE 1.0 END, 4) + 0.0 AS total_s, CAST(max(l_linenumber) AS INTEGER) AS deepest FROM lineitem GROUP BY l_orderkey")
def speedscope_timeline(spark, sf):
    """src.speedscope, proj.unit_scale"""
    _, s, _ = recordings.speedscope(_sampled(spark, sf))
    return s.groupBy("profile", "thread").agg(F.count("*").cast("int").alias("samples"), r(F.sum("dt")).alias("total_s"), F.max(F.size("stack")).alias("deepest"))


def _evented(spark, sf) -> DataFrame:
    """One evented profile an order: as many frames as the order has lines, each opened inside the one before and closed in reverse."""
    event = lambda kind, k, at: F.struct(F.lit(kind).alias("type"), k.alias("frame"), at.alias("at"))
    inward = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda k: event("O", k, k * 3))
    outward = F.transform(F.sequence(F.col("m") - 1, F.lit(0), F.lit(-1)), lambda k: event("C", k, 900 - k * 5))
    p = F.struct(F.lit("evented").alias("type"), F.lit("loop").alias("name"), F.lit("milliseconds").alias("unit"), F.concat(inward, outward).alias("events"))
    shared = F.struct(F.transform(F.sequence(F.lit(0), F.col("m")), lambda k: F.struct(_text("level", k).alias("name"))).alias("frames")).alias("shared")
    return _orders(spark, sf).select(F.col("profile").cast("string").alias("profile"), F.to_json(F.struct(shared, F.array(p).alias("profiles"))).alias("value"))


_LINES = "o AS (SELECT l_orderkey, CAST(count(*) AS INTEGER) AS m FROM lineitem GROUP BY 1), k AS (SELECT l_orderkey, m, CAST(unnest(generate_series(0, m - 1)) AS INTEGER) AS k FROM o)"


@query("WITH " + _LINES + " SELECT CAST(l_orderkey AS VARCHAR) AS profile, k AS frame, k + 1 AS depth, round((900 - 8 * k) / 1000.0, 4) + 0.0 AS dur_s FROM k")
def speedscope_evented(spark, sf):
    """win.evented over a profile"""
    _, _, e = recordings.speedscope(_evented(spark, sf))
    return recordings.evented_calls(e).select("profile", "frame", F.col("depth").cast("int").alias("depth"), r(F.col("end") - F.col("start")).alias("dur_s"))


def _cpuprofiles(spark, sf) -> DataFrame:
    """One CPU profile a supplier: a chain of two to four nodes below the root, sampled twice at its end and once at its first."""
    last = (F.col("s_suppkey") % 3 + 2).cast("int")
    node = lambda k: F.struct(k.alias("id"), F.struct(F.when(k == 1, "(root)").otherwise(_text("f", k)).alias("functionName"), F.lit("w.js").alias("url"), k.alias("lineNumber")).alias("callFrame"), F.when(k < last, F.array(k + 1)).alias("children"))
    doc = F.struct(F.transform(F.sequence(F.lit(1), last), node).alias("nodes"), F.lit(5_000).alias("startTime"), F.array(last, last, F.lit(2)).alias("samples"), F.array(F.lit(-8), (F.col("s_nationkey") + 1) * 100, F.lit(300)).alias("timeDeltas"))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("profile"), F.to_json(doc).alias("value"))


@query(
    """WITH s AS (SELECT s_suppkey % 3 + 2 AS z, (s_nationkey + 1) * 100 AS a FROM supplier), x AS (SELECT z AS node, a AS us FROM s UNION ALL SELECT z, 300 FROM s UNION ALL SELECT 2, 0 FROM s)
SELECT '(root)>f2' || CASE WHEN node > 2 THEN '>f3' ELSE '' END || CASE WHEN node > 3 THEN '>f4' ELSE '' END AS stack, round(sum(us) / 1000000.0, 6) + 0.0 AS dur_s, CAST(count(*) AS INTEGER) AS samples FROM x GROUP BY 1"""
)
def cpuprofile_timeline(spark, sf):
    """src.cpuprofile: a negative delta counts as none"""
    p = recordings.cpuprofile(_cpuprofiles(spark, sf))
    return p.groupBy(F.array_join("stack", ">").alias("stack")).agg(r(F.sum("dt"), 6).alias("dur_s"), F.count("*").cast("int").alias("samples"))


def _chrome(spark, sf) -> DataFrame:
    """One event trace an order, cut off before its array is closed: a handler around as many complete events as the order has lines."""
    whole = lambda k: _text('{"ph":"X","name":"w', k, '","ts":', k * 10_000 + 1_000, ',"dur":', (k + 1) * 100, ',"pid":7,"tid":2}')
    parts = F.concat(F.array(F.lit('{"ph":"B","name":"handler","ts":0,"pid":7,"tid":2}')), F.transform(F.sequence(F.lit(0), F.col("m") - 1), whole), F.array(_text('{"ph":"E","name":"handler","ts":', F.col("m") * 10_000, ',"pid":7,"tid":2}')))
    return _orders(spark, sf).select(F.col("profile").cast("string").alias("profile"), _text("[", F.array_join(parts, ","), ",").alias("value"))


@query("WITH " + _LINES + ", c AS (SELECT 'handler' AS name, 1 AS depth, m * 10000 AS us FROM o UNION ALL SELECT 'w' || k, 2, (k + 1) * 100 FROM k) SELECT name, depth, CAST(count(*) AS INTEGER) AS calls, round(sum(us) / 1000000.0, 4) + 0.0 AS total_s FROM c GROUP BY ALL")
def chrome_calls(spark, sf):
    """src.chrome, win.chrome_pairs"""
    c = recordings.chrome_calls(recordings.chrome_events(_chrome(spark, sf)))
    return c.groupBy("name", F.col("depth").cast("int").alias("depth")).agg(F.count("*").cast("int").alias("calls"), r(F.sum(F.col("end") - F.col("start"))).alias("total_s"))


@query("SELECT 'checker' AS tool, p_brand AS rule, CASE WHEN p_partkey % 3 = 0 THEN 'note' WHEN p_size > 25 THEN 'error' ELSE 'warning' END AS level, CASE WHEN p_partkey % 2 = 0 THEN '/w/src/a file ' ELSE 'lib/x+' END || p_partkey || '.rs' AS file, p_size AS line FROM part")
def sarif_results(spark, sf):
    """src.sarif, sort.leads: own level, then the rule's default, then warning; URIs decoded"""
    rule = F.struct(F.col("p_brand").alias("id"), F.struct(F.when(F.col("p_size") > 25, "error").alias("level")).alias("defaultConfiguration"))
    uri = F.when(F.col("p_partkey") % 2 == 0, _text("file:///w/src/a%20file%20", F.col("p_partkey"), ".rs")).otherwise(_text("lib/x+", F.col("p_partkey"), ".rs"))
    place = F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), F.struct(F.col("p_size").alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("p_brand").alias("ruleId"), F.when(F.col("p_partkey") % 3 == 0, "note").alias("level"), F.struct(F.col("p_name").alias("text")).alias("message"), F.array(place).alias("locations"))
    run = F.struct(F.struct(F.struct(F.lit("checker").alias("name"), F.array(rule).alias("rules")).alias("driver")).alias("tool"), F.array(result).alias("results"))
    return recordings.sarif(table(spark, sf, "part").select(F.to_json(F.struct(F.array(run).alias("runs"))).alias("value"))).drop("message")


@query("SELECT 'parts.' || p_size AS file, 'case ' || p_partkey AS test, CASE p_partkey % 3 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' ELSE 'skipped' END AS outcome, CASE p_partkey % 3 WHEN 1 THEN 'size ' || p_size WHEN 2 THEN 'not here' END AS message, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 0 END AS evidence FROM part")
def junit_cases(spark, sf):
    """src.junit"""
    k, n = F.col("p_partkey") % 3, F.col("p_partkey")
    inner = F.when(k == 0, _text('<system-out>@@evidence {"part": ', n, "}\nnoise\n@@evidence {}\n</system-out>")).when(k == 1, _text('<failure message="size ', F.col("p_size"), '">t</failure>')).otherwise(F.lit('<skipped message="not here"/>'))
    doc = _text('<testsuite><testcase classname="parts.', F.col("p_size"), '" name="case ', n, '" time="0.25">', inner, "</testcase></testsuite>")
    return recordings.junit(table(spark, sf, "part").select(doc.alias("value"))).select("file", "test", "outcome", "message", F.size("evidence").alias("evidence"))


def _coverages(spark, sf) -> DataFrame:
    """One coverage document a supplier: a script of its nation with one function and a block inside it."""
    span = lambda a, b, n: F.struct(F.lit(a).alias("startOffset"), F.lit(b).alias("endOffset"), n.alias("count"))
    f = F.struct(F.lit("load").alias("functionName"), F.array(span(4, 90, F.col("s_suppkey")), span(30, 50, F.lit(1).cast("long"))).alias("ranges"))
    doc = F.struct(F.array(F.struct(_text("file:///n", F.col("s_nationkey"), ".js").alias("url"), F.array(f).alias("functions"))).alias("result"))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("profile"), F.to_json(doc).alias("value"))


@query("SELECT 'file:///n' || s_nationkey || '.js' AS url, 'load' AS function, CAST(sum(s_suppkey) AS BIGINT) AS count FROM supplier GROUP BY s_nationkey")
def coverage_counts(spark, sf):
    """src.coverage: the first range of a function is its own count; documents add up"""
    return recordings.coverage(_coverages(spark, sf)).select("url", "function", "count")


@query(
    """SELECT path, id, qualname, CAST(sum(CASE id WHEN 1 THEN s_suppkey WHEN 2 THEN 2 * s_suppkey ELSE 5 END) AS BIGINT) AS count
FROM (SELECT '/n' || s_nationkey || '.js' AS path, s_suppkey FROM supplier), (VALUES (1, 'app.load'), (2, 'util.helper'), (3, 'app.save')) AS f(id, qualname) GROUP BY ALL"""
)
def coverage_functions(spark, sf):
    """src.coverage, proj.lines: nested, renamed and anonymous functions of a script matched with the map's; a script a nation, a document a supplier"""
    # a source of forty lines of twenty characters, so that an offset tells its line
    at = lambda a, b, n: F.struct(F.lit(20 * a - 20).alias("startOffset"), F.lit(20 * b - 1).alias("endOffset"), n.cast("long").alias("count"))
    own = lambda name, a, b, n: F.struct(F.lit(name).alias("functionName"), F.array(at(a, b, n), at(a, a, F.lit(1))).alias("ranges"))
    k = F.col("s_suppkey")
    # the module's wrapper, a function and a closure in it, one by its name alone, one that is known by its lines and one inside it that has the name
    f = F.array(own("", 1, 40, F.lit(1)), own("load", 5, 12, k), own("", 7, 8, F.lit(900)), own("helper", 15, 19, 2 * k), own("renamed", 22, 25, F.lit(3)), own("save", 23, 24, F.lit(5)), own("other", 30, 31, F.lit(7)))
    doc = F.struct(F.array(F.struct(_text("file:///n", F.col("s_nationkey"), ".js").alias("url"), f.alias("functions"))).alias("result"))
    docs = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("profile"), F.to_json(doc).alias("value"))
    path = table(spark, sf, "supplier").select(_text("/n", F.col("s_nationkey"), ".js").alias("path")).distinct()
    sources = path.select("path", F.array_join(F.array_repeat(F.lit("x" * 19), 40), "\n").alias("content"))
    known = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(q).alias("qualname"), F.lit(a).alias("start"), F.lit(b).alias("end")) for i, q, a, b in ((1, "app.load", 5, 12), (2, "util.helper", 15, 20), (3, "app.save", 22, 25))])
    functions = path.select("path", F.explode(known).alias("x")).select("path", "x.*")
    return recordings.coverage_of_functions(docs, sources, functions)


@query("SELECT 'cpuprofile' AS kind, CAST(count(*) AS INTEGER) AS n FROM supplier UNION ALL SELECT 'coverage', CAST(count(*) AS INTEGER) FROM supplier UNION ALL SELECT 'speedscope', CAST(2 * count(DISTINCT l_orderkey) AS INTEGER) FROM lineitem UNION ALL SELECT 'chrome', CAST(count(DISTINCT l_orderkey) AS INTEGER) FROM lineitem")
def profile_kinds(spark, sf):
    """src.profile_kind"""
    docs = _cpuprofiles(spark, sf)
    for more in (_coverages(spark, sf), _sampled(spark, sf), _evented(spark, sf), _chrome(spark, sf)):
        docs = docs.unionByName(more)
    return docs.groupBy(recordings.profile_kind(F.col("value")).alias("kind")).agg(F.count("*").cast("int").alias("n"))


def _folder(spark, name: str) -> str:
    """A new folder that all executors share."""
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}".removeprefix("file:")


def _once(x, f):
    """f of a value that is computed once, however often f has it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _varint(n):
    """A number below 2^28 as the wire has it."""

    def bytes_(n):
        byte = lambda k, more: F.lpad(F.hex(F.shiftright(n, 7 * k).bitwiseAND(127) + (128 if more else 0)), 2, "0")
        upto = lambda k: F.concat(*[byte(i, i < k) for i in range(k + 1)])
        return F.unhex(F.when(n < 1 << 7, upto(0)).when(n < 1 << 14, upto(1)).when(n < 1 << 21, upto(2)).otherwise(upto(3)))

    return _once(n, bytes_)


def _tag(number: int, kind: int):
    """A field's number, below sixteen, and its wire type."""
    return F.unhex(F.lit(f"{number << 3 | kind:02x}"))


def _field(number: int, body):
    """A length-delimited field."""
    return _once(body, lambda b: F.concat(_tag(number, 2), _varint(F.length(b).cast("long")), b))


def _number(number: int, n):
    return F.concat(_tag(number, 0), _varint(n.cast("long")))


def _fixed64(number: int, n):
    little = F.regexp_replace(F.lpad(F.hex(n), 16, "0"), "(..)(..)(..)(..)(..)(..)(..)(..)", "$8$7$6$5$4$3$2$1")
    return F.concat(_tag(number, 1), F.unhex(little))


@query("SELECT 'src/l' || l_linenumber || '.py' AS file, CAST(l_orderkey % 2000 AS INTEGER) AS line0, 'pkg p' || l_partkey || '().' AS symbol, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS roles FROM lineitem")
def index_occurrences(spark, sf):
    """src.scip, src.protowire: an index per supplier, written in its wire format and read back"""
    i = table(spark, sf, "lineitem")
    span = F.concat(_varint(F.col("l_orderkey") % 2000), _varint(F.lit(4).cast("long")), _varint(F.lit(300).cast("long")))
    one = F.concat(_field(1, span), _field(2, _text("pkg p", F.col("l_partkey"), "().").cast("binary")), F.when(F.col("l_returnflag") == "N", _number(3, F.lit(1))).otherwise(F.unhex(F.lit(""))))
    doc = i.groupBy("l_suppkey", "l_linenumber").agg(F.listagg(_field(2, one)).alias("body"))
    doc = doc.select("l_suppkey", _field(2, F.concat(_field(1, _text("src/l", F.col("l_linenumber"), ".py").cast("binary")), F.col("body"))).alias("body"))
    files = doc.groupBy("l_suppkey").agg(F.listagg("body").alias("content")).select(_text("s", F.col("l_suppkey"), "/index.scip").alias("path"), "content")
    where = _folder(spark, "indexes")
    wire.write_files(files, where)
    return wire.wire_files(spark, where, "occurrences").where("error IS NULL").drop("path", "error")


def _requests(spark, sf) -> str:
    """A folder with an export request in protobuf per user: a span for each event, whose parent is the user's event before it."""
    from pyspark.sql import Window

    e = table(spark, sf, "events").withColumn("ns", micros("ts") * 1000).withColumn("before", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id")))
    id_ = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    tenant = F.concat(_field(1, F.lit("tenant").cast("binary")), _field(2, _number(3, F.col("user_id") % 9)))
    parent = F.when(F.col("before").isNull(), F.unhex(F.lit(""))).otherwise(_field(4, id_(F.col("before"))))
    span = F.concat(_field(1, F.unhex(F.lpad(F.hex("user_id"), 32, "0"))), _field(2, id_(F.col("event_id"))), parent, _field(5, F.col("event_type").cast("binary")), _number(6, F.when(F.col("event_type") == "view", 2).otherwise(3)), _fixed64(7, F.col("ns")), _fixed64(8, F.col("ns") + F.col("event_id") * 7), _field(9, tenant))
    body = e.groupBy("user_id").agg(F.listagg(_field(2, span)).alias("spans"))
    where = _folder(spark, "requests")
    wire.write_files(body.select(_text("u", F.col("user_id") % 16, "/", F.col("user_id"), ".pb").alias("path"), _field(1, _field(2, F.col("spans"))).alias("content")), where)
    return where


@query("SELECT lpad(lower(to_hex(event_id)), 16, '0') AS span_id, coalesce(lpad(lower(to_hex(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id))), 16, '0'), '') AS parent_id, event_type AS name, CASE WHEN event_type = 'view' THEN 2 ELSE 3 END AS kind, CAST(event_id * 7 AS BIGINT) AS dur_ns, CAST(user_id % 9 AS VARCHAR) AS tenant FROM events")
def request_spans(spark, sf):
    """src.otlp_pb: export requests written in protobuf and read back"""
    s = wire.wire_files(spark, _requests(spark, sf), "spans").where("error IS NULL")
    return s.select("span_id", "parent_id", "name", "kind", (F.col("end_ns") - F.col("start_ns")).alias("dur_ns"), F.col("attrs")["tenant"].alias("tenant"))


def _stores(spark, sf) -> str:
    """A new shared folder with a trace store per process: its activations, a stall for every long one, and two settings."""
    a = cut(act(spark, sf).select("pid", "id", "parent", "thread", "fn", "dur", "n"))
    where = _folder(spark, "stores")
    cell = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"}), r'(?s)^\{"x":(.*)\}$', 1)
    row = lambda *cols: F.concat(F.lit("["), F.concat_ws(",", *map(cell, cols)), F.lit("]"))
    calls = a.select("pid", F.lit("calls").alias("relation"), row(F.col("id"), F.col("parent"), F.col("thread"), F.lit("app.py"), F.col("n"), F.col("fn"), F.col("id") % 2, F.lit(0.5), F.col("dur"), F.col("dur") / 2, F.lit(1), F.col("dur"), F.create_map(F.lit("n"), F.col("n"))).alias("row"))
    frame = F.array(F.array(F.lit("app.py"), F.col("n").cast("string"), F.col("fn")))
    stalls = a.where("n % 3 = 0").select("pid", F.lit("stalls").alias("relation"), row(F.col("id"), F.lit("app.py"), F.col("n"), F.col("fn"), F.col("dur"), F.lit(1.5), frame).alias("row"))
    meta = a.select("pid").distinct().select("pid", F.lit("meta").alias("relation"), row(F.lit("command"), F.concat(F.lit("run "), F.col("pid"))).alias("row"))
    stores.write_stores(calls.unionByName(stalls).unionByName(meta).repartition("pid"), where)
    return where


@query(views("act") + " SELECT pid, id, parent, fn AS qualname, n AS line, id % 2 = 1 AS is_coro, dur, CAST(n AS DOUBLE) AS size FROM act")
def store_calls(spark, sf):
    """src.sqlite: activations written to a store per process and read back"""
    c = stores.stores(spark, _stores(spark, sf)).where("error IS NULL")
    return c.select("pid", "id", "parent", "qualname", F.col("line").cast("long").alias("line"), "is_coro", "dur", F.col("shapes")["n"].alias("size"))


@query(views("act") + " SELECT pid, fn AS qualname, count(*) AS stalls, round(sum(dur), 4) + 0.0 AS total_s, max(n) AS deepest FROM act WHERE n % 3 = 0 GROUP BY ALL")
def store_stalls(spark, sf):
    """src.sqlite: the stalls of the stores, with their stacks"""
    s = stores.stores(spark, _stores(spark, sf), "stalls").where("error IS NULL")
    top = F.max(F.element_at("stack", 1)["line"]).cast("long")
    return s.groupBy("pid", "qualname").agg(F.count("*").alias("stalls"), r(F.sum("dur")).alias("total_s"), top.alias("deepest"))


@query(views("act") + " SELECT DISTINCT pid, key, CASE key WHEN 'pid' THEN CAST(pid AS VARCHAR) ELSE 'run ' || CAST(pid AS VARCHAR) END AS value FROM act, (SELECT unnest(['pid', 'command']) AS key)")
def store_meta(spark, sf):
    """src.sqlite: the settings of the stores"""
    return stores.stores(spark, _stores(spark, sf), "meta").where("error IS NULL").select("pid", "key", "value")


@query(
    views("find")
    + """, f AS (SELECT DISTINCT function, rule, file, line FROM find WHERE severity = 'high'), x AS (SELECT DISTINCT function, rule, file, CASE WHEN quantity > 25 THEN line END AS line FROM find WHERE status = 'F'),
e AS (SELECT rule, EXISTS (SELECT 1 FROM f WHERE f.function = x.function AND f.rule = x.rule AND f.file = x.file AND (x.line IS NULL OR f.line = x.line)) AS found FROM x),
w AS (SELECT rule, count(*) AS false_positives FROM (SELECT DISTINCT function, rule FROM find WHERE severity = 'low' AND quantity = 1) a WHERE EXISTS (SELECT 1 FROM f WHERE f.function = a.function AND f.rule = a.rule) GROUP BY rule),
s AS (SELECT rule, count(*) AS expected, count(*) FILTER (found) AS found FROM e GROUP BY rule)
SELECT rule, coalesce(expected, 0) AS expected, coalesce(found, 0) AS found, CASE WHEN expected > 0 THEN round(found / expected, 4) + 0.0 END AS recall, coalesce(false_positives, 0) AS false_positives FROM s FULL JOIN w USING (rule)"""
)
def corpus_score(spark, sf):
    """src.corpus, join.eval_match, agg.score_eval: a manifest per supplier, read back and held against its findings"""
    all_ = find(spark, sf).select("function", "rule", "file", "line", "severity", "status", "quantity")
    case = F.col("function").cast("string")
    entry = lambda *parts: _text("      - {rule: ", F.col("rule"), ', function: "f', case, '"', *parts, "}")
    file = _text("f", F.col("file"), ".py")
    want = all_.where("status = 'F'").select("function", entry(", file: ", file, F.when(F.col("quantity") > 25, _text(", line: ", F.col("line"))).otherwise("")).alias("e"), F.lit(0).alias("k"))
    bad = all_.where("severity = 'low' AND quantity = 1").select("function", entry().alias("e"), F.lit(1).alias("k"))
    listed = want.unionByName(bad).distinct().groupBy("function").agg(F.sort_array(F.collect_list(F.when(F.col("k") == 0, F.col("e")))).alias("want"), F.sort_array(F.collect_list(F.when(F.col("k") == 1, F.col("e")))).alias("bad"))
    head = lambda name: F.lit(f"    {name}:")
    docs = listed.select(F.col("function").alias("manifest"), F.array_join(F.concat(F.array(F.lit("# a case"), F.lit("cases:"), _text("  - id: s", case), F.lit("    note: none"), head("expected")), "want", F.array(head("must_be_absent")), "bad"), "\n").alias("value"))
    expected, absent = manifests.corpus(docs)
    found = all_.where("severity = 'high'").select(_text("s", case).alias("case"), "rule", _text("f", case).alias("function"), _text("src/", file).alias("file"), "line")
    return scoring.score_eval(found, expected, absent).withColumn("recall", r(F.col("recall")))
