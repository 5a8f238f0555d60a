"""Views of the driver's tables as the engine's relations, and the same views as SQL for the oracle.

Each view is defined once per engine under one name. Ordinals are made here, so that every later
operator can break ties by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.parts import dealt, parts_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line items, dealt by their order into parts of bounded size."""
    i = table(spark, sf_dir, "lineitem")
    return dealt(i, parts_of(i.count()), "l_orderkey")


def some(df: DataFrame, ids: str, whole: bool) -> DataFrame:
    """The share of the rows that a query and its twin are fixed to by id, or all of them."""
    return df if whole else df.where(ids)


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def r(c: Column, n: int = 4) -> Column:
    """Rounded without a negative zero."""
    return F.round(c, n) + F.lit(0.0)


def act(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activations: one row per event; the parent is the user's previous event of the day."""
    e = table(spark, sf_dir, "events")
    day = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    return e.select(
        (F.col("user_id") % 8).alias("pid"),
        F.col("event_id").alias("id"),
        F.col("user_id").alias("thread"),
        F.col("event_type").alias("fn"),
        micros("ts").alias("t"),
        F.col("value").alias("dur"),
        F.get_json_object("props", "$.k").cast("long").alias("n"),
        F.lag("event_id").over(day).alias("parent"),
    )


def io(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outbound calls: error and purchase events."""
    a = act(spark, sf_dir).where(F.col("fn").isin("error", "purchase"))
    return a.select("pid", "id", "parent", F.col("fn").alias("system"), F.concat(F.lit("k"), F.col("n") % 10).alias("target"), "t", "dur", (F.col("fn") == "error").alias("error"))


def tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heartbeats: every event of a user is a tick of that user's log; signups are idle marks."""
    return act(spark, sf_dir).select(F.col("thread").alias("log"), "t", F.col("id").alias("ord"), (F.col("fn") == "signup").alias("idle"), "fn")


def ival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans: view and click events last `value` minutes."""
    return act(spark, sf_dir).where(F.col("fn").isin("view", "click")).select(F.col("thread").alias("log"), "id", F.col("t").alias("start"), (F.col("t") + F.floor(F.col("dur") * 60e6).cast("long")).alias("end"), F.col("n").alias("depth"), "fn")


def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files: one row per line."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "line")).select("doc_id", (F.col("p") + 1).alias("line_no"), "line")


def fnrange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions: blocks of five lines inside one range over the whole document."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "\n", -1)).alias("n"))
    block = d.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 5).cast("int"))).alias("b"))
    block = block.select("doc_id", (F.col("b") + 1).alias("fn"), (F.col("b") * 5 + 1).alias("start"), F.least(F.col("b") * 5 + 5, F.col("n")).alias("end"))
    return block.unionByName(d.select("doc_id", F.lit(0).alias("fn"), F.lit(1).alias("start"), F.col("n").alias("end")))


def find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings: one row per line item."""
    o, i, p = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    sev = F.substring("o_orderpriority", 1, 1)
    severity = F.when(sev == "1", "high").when(sev == "2", "medium").when(sev == "3", "low").otherwise("info")
    conf = F.concat("l_returnflag", "l_linestatus")
    confidence = F.when(conf == "AF", "exact").when(conf == "NO", "unique").when(conf == "RF", "scip").otherwise("name")
    n = parts_of(i.count())
    lines = dealt(i, n, "l_orderkey").join(dealt(o, n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return (
        dealt(lines, n, "l_partkey")
        .join(dealt(p, n, "p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("p_brand").alias("rule"),
            severity.alias("severity"),
            confidence.alias("confidence"),
            F.col("l_suppkey").alias("function"),
            (F.col("l_partkey") % 97).cast("int").alias("file"),
            F.col("l_linenumber").alias("line"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
            F.col("o_orderstatus").alias("status"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_orderkey").alias("order_id"),
        )
    )


#: What narrows the edges of the queries that are fixed to it; `<query>_whole` takes the edges without it.
EDGE_CUT = "a.l_quantity = 50 AND b.l_quantity >= 40"


def edge(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """Call edges between suppliers of consecutive lines of one order; the confidence follows the part. A caller's edges have ordinals of their own."""
    i = table(spark, sf_dir, "lineitem")
    a = some(i, "l_quantity = 50", whole).select("l_orderkey", F.col("l_suppkey").alias("caller"), (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("pa"))
    b = some(i, "l_quantity >= 40", whole).select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("callee"))
    e = a.join(b, ["l_orderkey", "l_linenumber"]).where("caller <> callee")
    return e.groupBy("caller", "callee").agg((F.min(F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 10_000_000 + F.col("callee")).alias("edge_ord"), F.max(F.when(F.col("pa") % 3 == 0, 1).otherwise(0)).alias("by_name"), F.min(F.col("pa") % 4).cast("int").alias("attempts"))


def call(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls between the parts of consecutive lines of one order, from the smaller to the larger; every fiftieth part is also called back, so that
    the graph has callers without callers, cycles and what lies between. A part is asynchronous if three divides it and an entry if eleven does."""
    i = table(spark, sf_dir, "lineitem")
    a = i.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("pa"))
    b = i.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("pb"))
    pairs = a.join(b, ["l_orderkey", "l_linenumber"]).where("pa <> pb").withColumns({"lo": F.least("pa", "pb"), "hi": F.greatest("pa", "pb")})
    back = (F.col("lo") % 50 == 0) & (F.col("l_orderkey") % 4 == 1)
    ends = pairs.select(F.when(back, F.col("hi")).otherwise(F.col("lo")).alias("caller"), F.when(back, F.col("lo")).otherwise(F.col("hi")).alias("callee"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"))
    return ends.groupBy("caller", "callee").agg(F.min("line").alias("line"), (F.min("line") % 5 == 0).alias("offloaded"))


def stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocking boundaries of small parts: (node, line)."""
    return table(spark, sf_dir, "part").where("p_size <= 3").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") * 7919 % 5000).alias("line"))


def bnd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries: suppliers with a low balance do blocking I/O; the category follows the nation."""
    s = table(spark, sf_dir, "supplier").where("s_acctbal < 2000")
    k = F.col("s_nationkey") % 4
    return s.select(
        F.col("s_suppkey").alias("function"),
        F.when(k == 0, "net").when(k == 1, "db").when(k == 2, "fs").otherwise("sleep").alias("category"),
        F.when(F.col("s_nationkey") % 5 == 0, F.lit(None).cast("double")).otherwise((F.col("s_nationkey") % 7 + 1).cast("double")).alias("timeout_s"),
        F.col("s_nationkey").alias("line"),
    )


def link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call sites: the links of a page, in order."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), 1)).alias("ord", "name"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


#: The same views for the oracle.
SQL = {
    "act": "act AS (SELECT user_id % 8 AS pid, event_id AS id, user_id AS thread, event_type AS fn, epoch_us(ts) AS t, value AS dur, CAST(json_extract_string(props, '$.k') AS BIGINT) AS n, lag(event_id) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS parent FROM events)",
    "io": "io AS (SELECT pid, id, parent, fn AS system, 'k' || CAST(n % 10 AS VARCHAR) AS target, t, dur, fn = 'error' AS error FROM act WHERE fn IN ('error', 'purchase'))",
    "tick": "tick AS (SELECT thread AS log, t, id AS ord, fn = 'signup' AS idle, fn FROM act)",
    "ival": """ival AS (SELECT thread AS log, id, t AS "start", t + CAST(floor(dur * 60e6) AS BIGINT) AS "end", n AS depth, fn FROM act WHERE fn IN ('view', 'click'))""",
    "line": "line AS (SELECT doc_id, CAST(generate_subscripts(ls, 1) AS INTEGER) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))",
    "fnrange": """fnrange AS (SELECT doc_id, b + 1 AS fn, b * 5 + 1 AS "start", least(b * 5 + 5, n) AS "end" FROM (SELECT doc_id, n, unnest(generate_series(0, (n - 1) // 5)) AS b FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents)) UNION ALL SELECT doc_id, 0, 1, len(string_split(text, chr(10))) FROM documents)""",
    "find": """find AS (SELECT p_brand AS rule, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'high' WHEN '2' THEN 'medium' WHEN '3' THEN 'low' ELSE 'info' END AS severity,
      CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'exact' WHEN 'NO' THEN 'unique' WHEN 'RF' THEN 'scip' ELSE 'name' END AS confidence, l_suppkey AS function, CAST(l_partkey % 97 AS INTEGER) AS file,
      l_linenumber AS line, l_orderkey * 10 + l_linenumber AS ord, o_orderstatus AS status, l_quantity AS quantity, l_orderkey AS order_id
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)""",
    "edge": """edge AS (SELECT a.l_suppkey AS caller, b.l_suppkey AS callee, min(b.l_orderkey * 8 + b.l_linenumber) * 10000000 + b.l_suppkey AS edge_ord, max(CASE WHEN a.l_partkey % 3 = 0 THEN 1 ELSE 0 END) AS by_name, CAST(min(a.l_partkey % 4) AS INTEGER) AS attempts
      FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_quantity = 50 AND b.l_quantity >= 40 AND a.l_suppkey <> b.l_suppkey GROUP BY 1, 2)""",
    "call": """call AS (SELECT caller, callee, min(line) AS line, min(line) % 5 = 0 AS offloaded FROM (SELECT CASE WHEN back THEN hi ELSE lo END AS caller, CASE WHEN back THEN lo ELSE hi END AS callee, line
      FROM (SELECT *, lo % 50 = 0 AND l_orderkey % 4 = 1 AS back FROM (SELECT b.l_orderkey, least(a.l_partkey, b.l_partkey) AS lo, greatest(a.l_partkey, b.l_partkey) AS hi, b.l_orderkey * 8 + b.l_linenumber AS line
      FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey))) GROUP BY 1, 2)""",
    "stop": "stop AS (SELECT p_partkey AS node, p_partkey * 7919 % 5000 AS line FROM part WHERE p_size <= 3)",
    "bnd": """bnd AS (SELECT s_suppkey AS function, CASE s_nationkey % 4 WHEN 0 THEN 'net' WHEN 1 THEN 'db' WHEN 2 THEN 'fs' ELSE 'sleep' END AS category,
      CASE WHEN s_nationkey % 5 = 0 THEN NULL ELSE CAST(s_nationkey % 7 + 1 AS DOUBLE) END AS timeout_s, s_nationkey AS line FROM supplier WHERE s_acctbal < 2000)""",
    "link": """link AS (SELECT page_id, url, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS ord, unnest(ls) AS name FROM (SELECT page_id, url, regexp_extract_all(html, 'href="/([^"]*)"', 1) AS ls FROM pages))""",
}
_NEEDS = {"io": ["act"], "tick": ["act"], "ival": ["act"]}


def views(*names: str, recursive: bool = False) -> str:
    """WITH clause of the named views and those they stand on."""
    order: list[str] = []
    for n in names:
        for m in [*_NEEDS.get(n, []), n]:
            if m not in order:
                order.append(m)
    return "WITH " + "RECURSIVE " * recursive + ",\n".join(SQL[n] for n in order)
