"""Queries over lines and texts: the rule catalogue and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import parts, rules, scopes
from ..operators.parts import listed, pairs_between, parts_of_pairs
from .adapters import line, r, some, table, views
from .catalogue import query, whole

_LINES = views("line") + ", src AS (SELECT doc_id, line_no, line FROM line WHERE length(line) < 400 AND NOT regexp_matches(line, '^\\s*(//|#|\\*|/\\*|--)'))"


def _hit_sql(x) -> str:
    unless = f" AND NOT regexp_matches(line, '{x.unless}')" if x.unless else ""
    return f"SELECT doc_id, '{x.name}' AS rule, '{x.severity}' AS severity, line_no FROM src WHERE regexp_matches(line, '{x.pattern}'){unless}"


@query(_LINES + " SELECT doc_id, rule, severity, min(line_no) AS line_no FROM (" + " UNION ALL ".join(map(_hit_sql, rules.DOCUMENT_RULES)) + ") GROUP BY ALL")
def pattern_first_hits(spark, sf):
    """proj.lines, topk.first_per_fn and the pattern rules' engine over documents"""
    return rules.first_hits(rules.code_lines(table(spark, sf, "documents")), rules.DOCUMENT_RULES, ["doc_id"])


@query(_LINES + " SELECT rule, severity, count(DISTINCT doc_id) AS docs, count(*) AS lines FROM (" + " UNION ALL ".join(map(_hit_sql, rules.DOCUMENT_RULES)) + ") GROUP BY ALL")
def pattern_counts(spark, sf):
    """agg.map_stats over the rules"""
    hits = rules.hits(rules.code_lines(table(spark, sf, "documents")), rules.DOCUMENT_RULES, ["doc_id"])
    return hits.groupBy("rule", "severity").agg(F.count_distinct("doc_id").alias("docs"), F.count("*").alias("lines"))


# Lines of source, some that show rules and some that nearly do. What each must show is stated here by hand, so that a wrong pattern is no agreement.
SNIPPETS = (
    ("python", "jobs = asyncio.Queue()", "unbounded-channel/low"), ("python", "jobs = asyncio.Queue(maxsize=40)", ""), ("python", "jobs = queue.Queue(0)", "unbounded-channel/low"), ("python", "last = deque()", "unbounded-channel/low"),
    ("python", "last = deque(maxlen=9)", ""), ("rust", "let (tx, rx) = mpsc::channel();", "unbounded-channel/low"), ("rust", "let (tx, rx) = mpsc::sync_channel(8);", ""), ("rust", "let (tx, rx) = tokio::sync::mpsc::channel(8);", ""),
    ("rust", "let (tx, rx) = unbounded_channel::<Job>();", "unbounded-channel/low"), ("java", "var q = new LinkedBlockingQueue<Job>();", "unbounded-channel/low"), ("java", "var q = new LinkedBlockingQueue<Job>(64);", ""), ("java", "var q = new SynchronousQueue<Job>();", ""),
    ("go", "work := make(chan int, 50000)", "unbounded-channel/low"), ("go", "work := make(chan int, 50)", ""), ("go", "work := make([]int, 50000)", ""),
    ("typescript", "unitPrice: double", "float-money/medium"), ("python", "balance: float", "float-money/medium"), ("python", "balance: Decimal", ""), ("java", "double amountDue = 0;", "float-money/medium"), ("java", "double angle = 0;", ""), ("python", "tax = float(row)", "float-money/medium"),
    ("python", "spent = time.time() - t0", "wallclock-interval/medium"), ("python", "spent = time.monotonic() - t0", ""), ("python", "until = time.time() + 5", ""), ("javascript", "const ms = Date.now() - began;", "wallclock-interval/medium"), ("javascript", "const ms = performance.now() - began;", ""),
    ("java", "long d = System.currentTimeMillis() - begin;", "wallclock-interval/medium"), ("rust", "let d = SystemTime::now().elapsed();", "wallclock-interval/medium"), ("rust", "let d = Instant::now().elapsed();", ""),
    ("rust", "let n: u32 = line.parse().unwrap();", "panic-on-external-data/medium"), ("rust", "let n: u32 = line.parse()?;", ""), ("rust", "let c: C = serde_json::from_str(&body).expect(\"json\");", "panic-on-external-data/medium"), ("go", "n, _ := strconv.Atoi(arg)", "panic-on-external-data/medium"), ("go", "n, err := strconv.Atoi(arg)", ""),
    ("python", "P = re.compile('(a+)+b')", "redos-regex/medium"), ("python", "P = re.compile('a+b')", ""), ("python", "P = re.compile('(ab)+')", ""),
    ("python", "rows = db.run('select id from orders')", "unbounded-query/low"), ("python", "rows = db.run('select id from orders where id = 3')", ""), ("python", "users = User.objects.all()", "unbounded-query/low"), ("rust", "let all = q.fetch_all(&pool);", "unbounded-query/low"), ("rust", "let one = q.fetch_one(&pool);", ""),
    ("java", "return repo.findAll();", "unbounded-query/low"), ("java", "return repo.findAll(page);", ""), ("javascript", "await users.find({})", "unbounded-query/low"), ("javascript", "await users.find({ id })", ""),
    ("python", "asyncio.create_task(poll())", "fire-and-forget-task/medium"), ("python", "task = asyncio.create_task(poll())", ""), ("rust", "tokio::spawn(run());", "fire-and-forget-task/low"), ("rust", "let h = tokio::spawn(run());", ""), ("java", "new Thread(job).start();", "fire-and-forget-task/low"),
    ("python", "cur.execute(f\"delete from t where k = {key}\")", "sql-injection/high"), ("python", "cur.execute(\"delete from t where k = ?\", key)", "uncommitted-write/medium"), ("python", "cur.execute('select ' + what)", "sql-injection/high"), ("javascript", "db.query(`select * from t where k = ${key}`)", "sql-injection/high"), ("javascript", "db.query('select 1')", ""),
    ("java", "st.executeQuery(\"select 1 where k = \" + key)", "sql-injection/high"), ("go", "db.Query(fmt.Sprintf(q, key))", "sql-injection/high"), ("go", "db.Query(q, key)", ""),
    ("python", "http.get(f\"/find?name={name}\")", "unsanitized-url-query/medium"), ("python", "http.get(f\"/find/{name}\")", ""), ("javascript", "fetch(`/find?name=${name}`)", "unsanitized-url-query/medium"), ("javascript", "fetch(`/find/${name}`)", ""),
    ("python", "conn.execute('update t set a = 1')", "uncommitted-write/medium"), ("python", "conn.execute('update t set a = 1'); conn.commit()", ""), ("python", "await asyncio.gather(*jobs)", "unbounded-concurrency/medium"), ("python", "await asyncio.gather(a, b)", ""), ("go", "  go handle(c)", "unbounded-concurrency/medium"), ("go", "  going(c)", ""),
    ("python", "threading.Thread(target=run)", "unbounded-threads/medium"), ("go", "    defer f.Close()", "defer-in-loop/low"), ("go", "defer f.Close()", ""), ("rust", "sock.read(&mut buf).unwrap();", "panic-on-io-error/medium"), ("rust", "sock.read(&mut buf)?;", ""), ("go", "res, _ := http.Get(url)", "ignored-io-error/low"), ("go", "res, err := http.Get(url)", ""),
    ("python", "with requests.Session() as s:", "client-per-call/medium"), ("rust", "let c = reqwest::Client::new();", "client-per-call/medium"), ("python", "# asyncio.Queue()", ""),
)
_LIT = lambda x: "'" + x.replace("'", "''") + "'"


def _code(spark, sf):
    """Source lines: a part is a line of one of a hundred files."""
    p = table(spark, sf, "part")
    pick = (F.col("p_partkey") % len(SNIPPETS) + 1).cast("int")
    return p.select((F.col("p_partkey") % 100).alias("file"), F.col("p_partkey").alias("line_no"), F.element_at(F.array(*[F.lit(s[0]) for s in SNIPPETS]), pick).alias("lang"), F.element_at(F.array(*[F.lit(s[1]) for s in SNIPPETS]), pick).alias("line"))


@query(
    f"SELECT split_part(shown, '/', 1) AS rule, split_part(shown, '/', 2) AS severity, lang, count(*) AS n FROM (SELECT [{', '.join(_LIT(s[2]) for s in SNIPPETS)}][1 + p_partkey % {len(SNIPPETS)}] AS shown, "
    f"[{', '.join(_LIT(s[0]) for s in SNIPPETS)}][1 + p_partkey % {len(SNIPPETS)}] AS lang FROM part) WHERE shown <> '' GROUP BY ALL"
)
def source_rules(spark, sf):
    """The pattern rules of every language over source lines: unbounded-channel to client-per-call; the twin has what each line must show"""
    lines = _code(spark, sf).where(~F.col("line").rlike(rules.COMMENT))
    return rules.hits(lines, rules.SOURCE_RULES, ["file", "lang"], "lang").groupBy("rule", "severity", "lang").agg(F.count("*").alias("n"))


@query("SELECT p_partkey % 50 AS file, p_partkey AS line_no, 'K' || (p_partkey % 7) AS name FROM part WHERE p_partkey % 3 = 0 AND EXISTS (SELECT 1 FROM part q WHERE q.p_partkey % 3 = 1 AND q.p_partkey % 2 = 0 AND q.p_partkey % 50 = part.p_partkey % 50 AND q.p_partkey % 7 = part.p_partkey % 7)")
def regex_constants(spark, sf):
    """rule redos-regex (module constant): a third of the lines set a pattern, a third compile one by its name"""
    k = F.col("p_partkey")
    name = F.concat(F.lit("K"), (k % 7).cast("string"))
    text = F.when(k % 3 == 1, F.concat(name, F.when(k % 2 == 0, " = r'(x+)*y'").otherwise(" = r'x+y'"))).when(k % 3 == 0, F.concat(F.lit("P = re.compile("), name, F.lit(")"))).otherwise("pass")
    return rules.regex_constants(table(spark, sf, "part").select((k % 50).alias("file"), k.alias("line_no"), text.alias("line")))


# Bodies of Rust functions; the last two numbers say by hand in which line of the body a guard is bound and where it is held over an await, 0 for a clean one.
BODIES = (
    ("let g = state.lock().unwrap();\n    send(&g).await;", 1, 2),
    ("let g = state.lock().unwrap();\n    drop(g);\n    send().await;", 0, 0),
    ("{\n    let g = state.lock().unwrap();\n    g.push(1);\n    }\n    send().await;", 0, 0),
    ("{\n    let mut g = map.write().expect(\"poisoned\");\n    if g.is_empty() {\n    fill(&mut g).await?;\n    }\n    }", 2, 4),
    ("let g = state.lock().await;\n    send(&g).await;", 0, 0),
    ("let n = state.lock().unwrap().len();\n    send(n).await;", 0, 0),
    ("if ready {\n    let g = table.read()?;\n    use_it(&g);\n    } else { wait().await; }\n    let h = table.read()?;\n    log(\"}\");\n    h.get(1).fetch().await;", 5, 7),
    ("let g = state.lock().unwrap();\n    note(\".await\"); // send(&g).await", 0, 0),
    ("send().await;\n    let g = state.lock().unwrap();\n    g.push(2);", 0, 0),
)
_AT = f"1 + p_partkey % {len(BODIES)}"


@query(f"SELECT p_partkey AS file, 'f' || p_partkey AS function, [{', '.join(str(b[1]) for b in BODIES)}][{_AT}] + 1 AS line_no, [{', '.join(str(b[2]) for b in BODIES)}][{_AT}] + 1 AS await_line FROM part WHERE [{', '.join(str(b[1]) for b in BODIES)}][{_AT}] > 0")
def lock_scopes(spark, sf):
    """rule lock-across-await (rust): every part is a file with one function; the twin has what each body must show"""
    p = table(spark, sf, "part")
    body = F.element_at(F.array(*[F.lit(b[0]) for b in BODIES]), (F.col("p_partkey") % len(BODIES) + 1).cast("int"))
    whole_text = F.concat(F.lit("async fn f"), F.col("p_partkey"), F.lit("() {\n    "), body, F.lit("\n}"))
    lines = p.select(F.col("p_partkey").alias("file"), F.posexplode(F.split(whole_text, "\n", -1)).alias("p", "line")).withColumn("line_no", F.col("p") + 1)
    return scopes.locks_across_await(lines).select("file", "function", "line_no", "await_line")


@query("SELECT p_partkey FROM part WHERE p_size % 3 = 0")
def backoff_without_jitter(spark, sf):
    """rule backoff-without-jitter with its own patterns, over bodies of which a third has no jitter, a third has one and a third never retries"""
    k = F.col("p_size") % 3
    body = F.when(k == 0, "for attempt in range(4): sleep(2 ** attempt)").when(k == 1, "for attempt in range(4): sleep(random() * 2 ** attempt)").otherwise("sleep(2)")
    return table(spark, sf, "part").where(rules.backoff_without_jitter(body)).select("p_partkey")


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)tion') AND regexp_matches(text, '(?i)ing ') AND NOT regexp_matches(text, '(?i)the ')")
def jitter(spark, sf):
    """rule backoff-without-jitter: two patterns present, a third absent, per body"""
    d = table(spark, sf, "documents")
    return d.where(rules.backoff_without_jitter(F.col("text"), "(?i)tion", "(?i)ing ", "(?i)the ")).select("doc_id")


@query("SELECT l_suppkey AS file, l_partkey % 30 AS name, count(*) FILTER (l_returnflag = 'N') AS grows, min(CASE WHEN l_returnflag = 'N' THEN l_linenumber END) AS line FROM lineitem WHERE l_orderkey % 10 = 0 GROUP BY ALL HAVING count(*) FILTER (l_returnflag = 'N') > 0 AND count(*) FILTER (l_returnflag = 'R') = 0")
def unbounded_container(spark, sf, whole=False):
    """rule unbounded-module-container"""
    i = some(table(spark, sf, "lineitem"), "l_orderkey % 10 = 0", whole)
    op = F.when(F.col("l_returnflag") == "N", "grow").when(F.col("l_returnflag") == "R", "shrink").otherwise("read")
    ops = i.select(F.col("l_suppkey").alias("file"), (F.col("l_partkey") % 30).alias("name"), op.alias("op"), F.col("l_linenumber").alias("line"))
    return rules.unbounded_container(ops).select("file", "name", "grows", "line")


@query("SELECT page_id, replace(replace(regexp_replace(url, '^(https?)://([^/?#:]+).*$', '\\2'), '.', '::'), '::', '.') AS qual, regexp_replace(url, '[?#].*$', '') AS path FROM pages")
def norm_qualname(spark, sf):
    """fn.norm_qual: a host written with double colons comes back dotted"""
    p = table(spark, sf, "pages")
    host = F.regexp_extract("url", r"^https?://([^/?#:]+)", 1)
    return p.select("page_id", fn.norm_qualname(F.concat(F.regexp_replace(host, r"\.", "::"), F.lit("(a, b)"))).alias("qual"), F.regexp_replace("url", r"[?#].*$", "").alias("path"))


@query("SELECT doc_id, CASE WHEN n_chars < 1000 THEN CAST(n_chars AS VARCHAR) || ' ms' WHEN n_chars < 60000 THEN regexp_replace(printf('%.3f', n_chars / 1000.0), '\\.?0+$', '') || ' s' ELSE printf('%.1f', n_chars / 60000.0) || ' min' END AS label FROM documents")
def format_seconds(spark, sf):
    """fn.fmt: a document's characters as milliseconds"""
    return table(spark, sf, "documents").select("doc_id", fn.format_seconds(F.col("n_chars") / 1000).alias("label"))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) * CASE p_size % 4 WHEN 0 THEN 0.001 WHEN 1 THEN 1.0 WHEN 2 THEN 60.0 ELSE NULL END AS seconds FROM part")
def durations(spark, sf):
    """fn.parse_default: sizes written with a unit; ms, s and min are known"""
    p = table(spark, sf, "part")
    unit = F.when(F.col("p_size") % 4 == 0, "ms").when(F.col("p_size") % 4 == 1, "s").when(F.col("p_size") % 4 == 2, "min").otherwise("hours")
    return p.select("p_partkey", fn.parse_default(F.concat(F.col("p_size").cast("string"), F.lit(" "), unit, F.lit(" (default)"))).alias("seconds"))


@query("SELECT page_id, 'a/' || regexp_extract(url, '([^/?#]*)[?#]?[^/]*$', 1) || '+b c' AS path FROM pages")
def uri_paths(spark, sf):
    """fn.uri_path: %20 is decoded, a plus sign stays"""
    tail = F.regexp_extract("url", r"([^/?#]*)[?#]?[^/]*$", 1)
    return table(spark, sf, "pages").select("page_id", fn.uri_path(F.concat(F.lit("file://a/"), tail, F.lit("+b%20c"))).alias("path"))


@query("SELECT l_orderkey AS site, l_linenumber AS arg, l_partkey % 7 BETWEEN l_suppkey % 3 AND l_suppkey % 3 + 3 OR (l_returnflag = 'R' AND l_partkey % 7 - 1 BETWEEN l_suppkey % 3 AND l_suppkey % 3 + 3) AS fits, count(*) AS n FROM lineitem GROUP BY ALL")
def arity_fits(spark, sf):
    """pred.arity"""
    from ..operators import resolve

    i = table(spark, sf, "lineitem")
    lo = F.col("l_suppkey") % 3
    return i.groupBy(F.col("l_orderkey").alias("site"), F.col("l_linenumber").alias("arg"), resolve.arity_fits(F.col("l_partkey") % 7, lo, lo + 3, F.col("l_returnflag") == "R").alias("fits")).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey AS cand, c_custkey AS caller FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE c_custkey % 50 = 0 AND (s_suppkey % 2 = 0 OR s_suppkey % 10 = c_custkey % 10 OR s_suppkey % 4 = c_custkey % 4)")
def visible(spark, sf, whole=False):
    """pred.visible; generic names are operators.scoring.by_name"""
    from ..operators import resolve

    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    c = some(table(spark, sf, "customer"), "c_custkey % 50 = 0", whole).select("c_custkey", F.col("c_nationkey").alias("nation"))
    pairs, widest = pairs_between(s, c, ["nation"]), s.groupBy("nation").count().agg(F.max("count")).first()[0] or 1
    # what is visible follows from the nation and the keys' last digits in base 20, so all of a list is visible to all of another or to none
    s, c = s.withColumn("s_like", F.col("s_suppkey") % 20), c.withColumn("c_like", F.col("c_custkey") % 20)
    # a nation is one key of 25: the few suppliers go to every task, and lists of callers are dealt by the pairs that they make
    callers = listed(c, ["nation", "c_like"], "c_custkey", max(8, min(parts.VALUES_A_LIST, parts.PAIRS_A_PART // widest // 8 * 8)))
    n, a, b = parts_of_pairs(c, pairs), F.col("s_like"), F.col("c_like")
    lists = callers.repartition(n).join(F.broadcast(listed(s, ["nation", "s_like"], "s_suppkey")), "nation")
    # coalesce ends the step of the join: compiled as one with it, a task would hold all pairs of a list of callers at once, not those of two lists
    lists = lists.where(resolve.visible(a % 2 != 0, a % 10 == b % 10, a % 4 == b % 4)).coalesce(n)
    return lists.select(F.explode("s_suppkey").alias("cand"), "c_custkey").select("cand", F.explode("c_custkey").alias("caller"))


@query("SELECT system, target, count(*) AS n FROM (SELECT CASE event_type WHEN 'purchase' THEN 'db' WHEN 'view' THEN 'http' WHEN 'error' THEN 'rpc' ELSE 'messaging' END AS system, 'k' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS VARCHAR) AS target FROM events WHERE event_type <> 'signup') GROUP BY ALL")
def io_info(spark, sf):
    """proj.io_info: attribute precedence http, db, rpc, messaging; server spans are no calls"""
    from ..sources.otlp import io_info as info

    e = table(spark, sf, "events")
    k = F.concat(F.lit("k"), F.get_json_object("props", "$.k").cast("long") % 5)
    name = F.when(F.col("event_type") == "view", "http.url").when(F.col("event_type") == "purchase", "db.system").when(F.col("event_type") == "error", "rpc.service").otherwise("messaging.system")
    spans = e.select(F.when(F.col("event_type") == "signup", 2).otherwise(3).alias("kind"), F.create_map(name, k).alias("attrs"))
    return info(spans).groupBy("system", "target").agg(F.count("*").alias("n"))


@query(views("line") + " SELECT doc_id, min(line_no) AS line_no, max(length(line)) AS longest FROM line WHERE length(line) >= 400 GROUP BY doc_id")
def overlong_lines(spark, sf):
    """What the rule engine passes over is recorded: lines of 400 characters and more"""
    return line(spark, sf).where(F.length("line") >= 400).groupBy("doc_id").agg(F.min("line_no").alias("line_no"), F.max(F.length("line")).alias("longest"))


@query(views("line") + ", e AS (SELECT doc_id, line_no, line FROM line WHERE line_no BETWEEN 1 AND 4) SELECT doc_id, string_agg(lpad(CAST(line_no AS VARCHAR), 5, ' ') || '  ' || line, chr(10) ORDER BY line_no) AS excerpt FROM e GROUP BY doc_id")
def excerpts(spark, sf):
    """proj.excerpt"""
    return table(spark, sf, "documents").select("doc_id", fn.excerpt(F.col("text"), F.lit(1), 2).alias("excerpt"))


# -- bracket-aware functions ------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_size % 5 + 1 AS argc, 6 + 9 * (p_size % 5 + 1) + 2 * (p_size % 5) AS closing FROM part")
def call_arguments(spark, sf):
    """fn.split_top, fn.argc, fn.matching_paren: f called with one to five calls"""
    args = F.array_join(F.transform(F.sequence(F.lit(0), F.col("p_size") % 5), lambda i: F.concat(F.lit("g(1, '"), i.cast("string"), F.lit("')"))), ", ")
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("f.get("), args).alias("t"))
    inner = F.substring("t", 7, 10_000)
    return p.select("p_partkey", fn.vec_argc(inner).cast("int").alias("argc"), fn.vec_matching_paren(F.concat("t", F.lit(")")), F.lit(5)).cast("int").alias("closing"))


@query("SELECT p_partkey, 'm' || p_size || '.run' AS callee, p_size % 3 AS least, CASE WHEN p_size % 2 = 0 THEN NULL ELSE CAST(p_size % 3 + 1 AS DOUBLE) END AS most FROM part")
def callee_and_arity(spark, sf):
    """fn.normalize, fn.arity, fn.split_params: type parameters and arguments go; a rest parameter has no upper bound"""
    size = F.col("p_size")
    raw = F.concat(F.lit("m"), size.cast("string"), F.lit("::<Vec<T>>::run(a, b(c))"))
    must = F.array_join(F.transform(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda i: i < size % 3), lambda i: F.concat(F.lit("p"), i.cast("string"), F.lit(": Map<K, V>"))), ", ")
    params = F.concat_ws(", ", F.lit("self"), F.when(size % 3 > 0, must), F.lit("q: int = 3"), F.when(size % 2 == 0, "*rest"))
    a = fn.vec_arity(params)
    return table(spark, sf, "part").select("p_partkey", fn.vec_normalize(raw).alias("callee"), a["least"].cast("int").alias("least"), a["most"].alias("most"))


_FORMS = ("Duration::from_millis({})", "Duration.ofMinutes({})", "{} * time.Second", "await({}, TimeUnit.MILLISECONDS)", "timedelta(hours={})", "wait_for(x(1), {})", "get(u, timeout={})", "no time at all {}")


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) * CASE p_partkey % 8 WHEN 0 THEN 0.001 WHEN 1 THEN 60 WHEN 2 THEN 1 WHEN 3 THEN 0.001 WHEN 4 THEN 3600 WHEN 5 THEN 1 WHEN 6 THEN 1 END AS seconds, CAST(p_size AS DOUBLE) / CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000000 ELSE 1000 END AS sleep_s FROM part")
def call_durations(spark, sf):
    """fn.parse_duration, fn.sleep_duration: every form, and bare sleeps in seconds, micro- and milliseconds"""
    size = F.col("p_size").cast("string")
    text = F.element_at(F.array(*[F.concat(F.lit(x.split("{}")[0]), size, F.lit(x.split("{}")[1])) for x in _FORMS]), (F.col("p_partkey") % 8 + 1).cast("int"))
    nap = F.concat(F.element_at(F.array(F.lit("sleep("), F.lit("usleep("), F.lit("delay(")), (F.col("p_partkey") % 3 + 1).cast("int")), size, F.lit(")"))
    return table(spark, sf, "part").select("p_partkey", r(fn.vec_duration(text, F.lit("python")), 6).alias("seconds"), r(fn.vec_sleep(nap, F.lit("python")), 6).alias("sleep_s"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'counted' WHEN 1 THEN 'counted' WHEN 2 THEN 'forever' ELSE 'collection' END AS kind, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size + 1 END AS bound, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS attempts, CASE WHEN p_partkey % 2 = 0 THEN 'exponential' END AS backoff FROM part")
def loop_headers(spark, sf):
    """fn.count, fn.const, fn.retry_decorator, fn.resolve_constants: headers with literal and named bounds, decorators with attempts"""
    size = F.col("p_size").cast("string")
    k = F.col("p_partkey")
    known = F.create_map(F.lit("LIMIT"), F.col("p_size").cast("double"))
    head = F.when(k % 4 == 0, fn.vec_resolve_constants(F.lit("for i in range(cfg.LIMIT):"), known)).when(k % 4 == 1, F.concat(F.lit("for (let i = 0; i <= "), size, F.lit("; i++)"))).when(k % 4 == 2, F.lit("while True:")).otherwise(F.lit("for x in rows:"))
    c = fn.vec_loop_count(head)
    d = fn.vec_retry_decorator(F.when(k % 2 == 0, F.concat(F.lit("@retry(stop=stop_after_attempt("), size, F.lit("), wait=wait_exponential())"))).otherwise("@cached"))
    return table(spark, sf, "part").select("p_partkey", c["kind"].alias("kind"), c["bound"].cast("int").alias("bound"), d["attempts"].cast("int").alias("attempts"), d["backoff"].alias("backoff"))


@query("SELECT p_partkey, 'a.b' || p_size || '=x.a.b' || p_size || ';c=x.q' AS names, p_size % 3 + 1 AS lines FROM part")
def imports_and_lines(spark, sf):
    """fn.expand_braced, proj.joined_lets: nested import lists, and calls over several lines as one"""
    size = F.col("p_size").cast("string")
    spec = F.concat(F.lit("x.{a.b"), size, F.lit(" as a.b"), size, F.lit(", q as c}"))
    text = F.concat(F.lit("f("), F.array_join(F.array_repeat(F.lit("\n1,"), F.col("p_size") % 4), ""), F.lit("\n2)"), F.array_join(F.array_repeat(F.lit("\ng(3)"), F.col("p_size") % 3), ""))
    pairs = fn.vec_expand_braced(spec, F.lit("."))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(pairs, lambda x: F.concat(x["alias"], F.lit("="), x["path"])), ";").alias("names"), F.size(fn.vec_joined_lines(text)).alias("lines"))


whole(unbounded_container, "l_orderkey % 10 = 0")
whole(visible, "c_custkey % 50 = 0")
