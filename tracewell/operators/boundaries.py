"""Classification of calls as I/O boundaries: join.rule_match over an inverted index of the rules.

A rule is looked up by what it names literally: its methods, its whole name, or the first or last part of its path.
Calls meet their candidates by equality on (language, key); only those are tested, and the lowest ordinal that holds wins. The
keys of a path pattern are read from the pattern itself, so a rule that is added to a table needs no second entry; a
pattern that names no whole part is a candidate for every call of its language.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut

#: Rows of an index that are sent to every task; a larger index is joined by exchange.
SMALL_INDEX = 20_000
EVERY = "*"


@dataclass(frozen=True)
class BoundaryRule:
    """What a call must show. Patterns are searched for; `path` decides alone, else methods and name must both fit where given.

    `awaited`: true or false asks for it, null takes both; a blocking rule never takes an awaited call.
    """

    kind: str
    category: str
    path: str | None = None
    methods: str | None = None
    imports: str | None = None
    name: str | None = None
    receiver: str | None = None
    receiver_type: str | None = None
    blocking: bool = False
    awaited: bool | None = None
    unless_name: str | None = None
    default_timeout: str | None = None
    default_client: bool = False
    client_level: bool = True
    sure: bool = False

    @property
    def confidence(self) -> str:
        return "exact" if self.sure or (self.path is not None and self.receiver is None) else "heuristic"


# The boundary rules of the nine languages in their order, with the names and patterns that decide which call is one.
API_NAME = "(?i)fetch|request|http|api|rpc|download|upload|subscribe|connect|get_?(ticker|price|quote|order|orders|balance|book|position)"
CONSTRUCTOR = r"^(new|builder|default|with_\w+|from_\w+|from|create|extend|Builder|New)$"
PYTHON_CONSTRUCTOR = r"^([A-Z]\w*|new|builder)$"
HTTP_VERBS = "get post put patch delete head options request send stream"
RPC_METHODS = (
    "get_slot get_slot_with_commitment get_account get_account_with_commitment get_account_data get_multiple_accounts get_multiple_accounts_with_commitment "
    "get_balance get_balance_with_commitment get_transaction get_transaction_with_config get_block get_block_with_config get_block_height get_latest_blockhash "
    "get_latest_blockhash_with_commitment get_signature_status get_signature_statuses get_signature_statuses_with_history get_token_account_balance "
    "get_token_supply get_token_accounts_by_owner get_token_largest_accounts get_signatures_for_address get_signatures_for_address_with_config "
    "get_program_accounts get_program_accounts_with_config get_recent_prioritization_fees send_transaction send_transaction_with_config "
    "send_and_confirm_transaction send_and_confirm_transaction_with_spinner confirm_transaction request_airdrop simulate_transaction "
    "simulate_transaction_with_config send"
)
HTTPX, AIOHTTP, SQLITE = "5s (httpx default)", "300s total (aiohttp ClientTimeout default)", "5s (sqlite3 busy timeout default)"
REQWEST = "30s (reqwest::blocking default, src/blocking/client.rs: Timeout(Some(Duration::from_secs(30))))"
OKHTTP = "10s connect/read/write (OkHttp default)"
_B = BoundaryRule
PYTHON = (
    _B("rpc", "net", path=r"^grpc\.aio\.stream_read$", awaited=True, client_level=False),
    _B("http", "net", path=r"^requests\.", blocking=True, unless_name=PYTHON_CONSTRUCTOR, default_client=True),
    _B("http", "net", methods=HTTP_VERBS, receiver="(?i)session|client|http|requests", imports=r"^requests\b", blocking=True, client_level=False),
    _B("http", "net", path=r"^urllib\.request\.(urlopen|urlretrieve)$", blocking=True),
    _B("http", "net", path=r"^urllib3\.", blocking=True, unless_name=PYTHON_CONSTRUCTOR),
    _B("http", "net", path=r"^httpx\.(get|post|put|patch|delete|head|request|stream)$", blocking=True, default_timeout=HTTPX),
    _B("http", "net", methods=HTTP_VERBS, receiver="(?i)client|session|http", imports=r"^httpx\b", awaited=True, default_timeout=HTTPX),
    _B("http", "net", methods=HTTP_VERBS, receiver="(?i)client|session|http", imports=r"^httpx\b", blocking=True, default_timeout=HTTPX),
    _B("http", "net", methods="get post put patch delete head options request stream", receiver="(?i)session|client|http", imports=r"^aiohttp\b", awaited=True, default_timeout=AIOHTTP),
    _B("sleep", "sleep", path=r"^time\.sleep$", blocking=True),
    _B("process", "process", path=r"^(subprocess\.(run|call|check_call|check_output)|os\.system)$", blocking=True),
    _B("net", "net", path=r"^socket\.(create_connection|getaddrinfo|gethostbyname)$", blocking=True),
    _B("db", "db", path=r"^sqlite3\.", blocking=True, unless_name=PYTHON_CONSTRUCTOR, default_timeout=SQLITE),
    _B("db", "db", methods="execute executemany executescript fetchall fetchone commit", imports=r"^sqlite3\b", blocking=True, default_timeout=SQLITE),
    _B("db", "db", path=r"^(psycopg2?|pymysql|MySQLdb|pymongo|redis)\.", blocking=True, unless_name=PYTHON_CONSTRUCTOR),
    _B("db", "db", methods="execute executemany fetchall fetchone commit", imports=r"^(psycopg2?|pymysql|MySQLdb|sqlalchemy|django\.db)\b", blocking=True),
    _B("db", "db", methods="get first count exists create save delete update aggregate one scalar", receiver=r"\.objects\b|\.query\b|(?i:session)", imports=r"^(django|sqlalchemy|flask_sqlalchemy)\b", blocking=True),
    _B("db", "db", methods="execute fetch fetchrow fetchval find_one insert_one get set", receiver="(?i)conn|pool|db|redis|collection|session", imports=r"^(asyncpg|motor|databases|sqlalchemy\.ext\.asyncio|redis\.asyncio|aioredis)\b", awaited=True),
    _B("file", "fs", path=r"^(io\.)?open$|^os\.(listdir|scandir|walk|stat|remove|unlink|rename|replace|makedirs|mkdir|rmdir|fsync|read|write)$|^shutil\.\w+$", blocking=True),
    _B("file", "fs", methods="read_text write_text read_bytes write_bytes", blocking=True),
    _B("runtime", "runtime", path=r"^asyncio\.run$|(^|\.)run_until_complete$", blocking=True),
    _B("cpu", "cpu", path=r"^hashlib\.(pbkdf2_hmac|scrypt)$|^bcrypt\.(hashpw|checkpw|kdf)$|^(argon2|passlib\.hash)\.\w+\.(hash|verify)$|^scrypt\.(hash|encrypt)$", blocking=True),
    _B("future", "wait", methods="result", receiver=r"(?i)future|\bfut\b|\btask\b", imports=r"^concurrent\.futures\b", blocking=True),
    _B("thread-join", "wait", methods="join", receiver=r"(?i)thread|\bt\b|\bth\b|\bworker\b", imports=r"^threading\b", blocking=True),
    _B("api", "net", name=API_NAME, awaited=True),
)
RUST = (
    _B("http", "net", path=r"^reqwest\.blocking\.", blocking=True, unless_name=CONSTRUCTOR, default_timeout=REQWEST),
    _B("http", "net", path=r"^(ureq|attohttpc|minreq)\.", blocking=True, unless_name=CONSTRUCTOR),
    _B("http", "net", methods="send execute", imports=r"^reqwest\.blocking\b", blocking=True, default_timeout=REQWEST),
    _B("http", "net", methods="call send", imports=r"^(ureq|attohttpc|minreq)\b", blocking=True),
    _B("sleep", "sleep", path=r"^(std\.)?thread\.sleep$", blocking=True),
    _B("fs", "fs", path=r"^std\.fs\.", blocking=True, unless_name=CONSTRUCTOR),
    _B("stdio", "fs", path=r"^std\.(print|println|eprint|eprintln)$", blocking=True),
    _B("stdio", "fs", path=r"^std\.io\.(stdout|stderr)(\.lock)?\.(write|write_all|write_fmt|flush)$", blocking=True),
    _B("fs", "fs", methods="read read_exact read_to_end read_to_string write write_all write_fmt flush sync_all sync_data", receiver_type=r"^std\.(fs\.File|io\.(Stdout|Stderr)(Lock)?)$", blocking=True, sure=True),
    _B("rpc", "net", methods=RPC_METHODS, receiver_type=r"^solana_(client|rpc_client)\.rpc_client\.RpcClient$", blocking=True, sure=True, client_level=False),
    _B("rpc", "net", methods=RPC_METHODS, receiver_type=r"^solana_(client|rpc_client)\.nonblocking\.rpc_client\.RpcClient$", awaited=True, sure=True, client_level=False),
    _B("net", "net", path=r"^std\.net\.(TcpStream|TcpListener|UdpSocket)\.", blocking=True, unless_name=CONSTRUCTOR),
    _B("dns", "net", methods="to_socket_addrs", blocking=True),
    _B("process", "process", path=r"^std\.process\.Command\b.*\.(output|status|wait)$", blocking=True),
    _B("block_on", "runtime", path=r"(^|\.)block_on$", blocking=True),
    _B("channel", "wait", methods="recv", imports=r"^(std\.sync\.mpsc|crossbeam)", blocking=True),
    _B("http", "net", path=r"^(reqwest|hyper)\.", awaited=True, unless_name=CONSTRUCTOR),
    _B("http", "net", methods="send execute request", imports=r"^(reqwest|hyper)\b", awaited=True),
    _B("db", "db", path=r"^(sqlx|redis|mongodb|tokio_postgres|diesel_async)\.", awaited=True),
    _B("db", "db", methods="fetch_one fetch_all fetch_optional query execute query_as", imports=r"^(sqlx|tokio_postgres|redis|mongodb|sea_orm)\b", awaited=True),
    _B("rpc", "net", path=r"^(tonic|tokio_tungstenite)\.", awaited=True, unless_name=CONSTRUCTOR),
    _B("net", "net", path=r"^tokio\.net\.(TcpStream|UnixStream)\.connect$|(^|\.)connect_async$", awaited=True),
    _B("api", "net", name=API_NAME, awaited=True),
)
GO = (
    _B("http", "net", path=r"^net/http\.(Get|Post|PostForm|Head)$", default_client=True),
    _B("http", "net", path=r"^net/http\.DefaultClient\.(Do|Get|Post|PostForm|Head)$", default_client=True),
    _B("http", "net", methods="Do Get Post PostForm Head", receiver="(?i)client|http", imports="^net/http$"),
    _B("net", "net", path=r"^net\.(Dial|Listen)$"),
    _B("db", "db", methods="Query QueryRow Exec QueryContext QueryRowContext ExecContext Get Select Prepare", receiver="(?i)db|tx|conn|pool|stmt|repo|store", imports=r"^(database/sql|github\.com/jmoiron/sqlx|github\.com/jackc/pgx.*|gorm\.io/gorm)$"),
    _B("db", "db", methods="Find First Create Save Delete Updates Take Last Count", receiver="(?i)db|tx|gorm", imports=r"^gorm\.io/gorm$"),
    _B("rpc", "net", name="^(Invoke|NewStream)$", imports=r"^google\.golang\.org/grpc$"),
    _B("sleep", "sleep", path=r"^time\.Sleep$", blocking=True),
    _B("process", "process", methods="Run Output CombinedOutput Wait", receiver="(?i)cmd|exec", imports="^os/exec$", blocking=True),
)
JAVASCRIPT = (
    _B("fs", "fs", path=r"^(fs|fs-extra|graceful-fs)\.\w+Sync$", blocking=True),
    _B("process", "process", path=r"^child_process\.(execSync|execFileSync|spawnSync)$", blocking=True),
    _B("cpu", "cpu", path=r"^crypto\.(pbkdf2Sync|scryptSync|generateKeyPairSync)$|^bcrypt(js)?\.(hashSync|compareSync)$", blocking=True),
    _B("wait", "wait", path=r"^Atomics\.wait$", blocking=True),
    _B("db", "db", methods="run get all exec iterate", receiver="(?i)stmt|db|statement|sqlite", imports="^better-sqlite3$", blocking=True),
    _B("http", "net", path=r"^((window|globalThis|self)\.)?fetch$|^(node-fetch|undici|cross-fetch)(\.(fetch|request))?$", default_client=True),
    _B("http", "net", path=r"^(axios|got|ky|superagent|needle)(\.\w+)?$", unless_name=CONSTRUCTOR),
    _B("http", "net", path=r"^(http|https)\.(get|request)$"),
    _B("http", "net", methods="get post put patch delete request head", receiver="(?i)client|api|http|instance|axios", imports="^(axios|got|ky)$"),
    _B("db", "db", methods="findUnique findFirst findMany create createMany update updateMany upsert delete deleteMany aggregate count groupBy $queryRaw $executeRaw", receiver="(?i)prisma|db|tx", imports="^@prisma/client$"),
    _B("db", "db", methods="find findOne findById aggregate insertOne insertMany updateOne updateMany deleteOne countDocuments exec bulkWrite", imports="^(mongoose|mongodb)$"),
    _B("db", "db", methods="query execute raw findAll findOne findByPk save findOneBy getMany", receiver=r"(?i)db|pool|client|conn|knex|repo|repository|sequelize|manager|model|\b[A-Z]\w*$", imports="^(pg|mysql2?(/promise)?|knex|sequelize|typeorm|kysely|drizzle-orm.*)$"),
    _B("api", "net", name=API_NAME, awaited=True),
)
JAVA = (
    _B("http", "net", methods="send sendAsync", receiver="(?i)client|http", imports=r"^java\.net\.http\b", client_level=False),
    _B("http", "net", methods="execute", receiver="(?i)newCall|call", imports=r"^okhttp3\b", default_timeout=OKHTTP),
    _B("http", "net", methods="getForObject getForEntity postForObject postForEntity exchange patchForObject delete put", receiver="(?i)rest", imports=r"springframework\.web\.client"),
    _B("http", "net", methods="retrieve exchangeToMono exchangeToFlux", imports=r"reactive\.function\.client"),
    _B("http", "net", methods="openConnection getInputStream connect", receiver="(?i)url|conn", imports=r"^java\.net\.(URL|HttpURLConnection)$"),
    _B("db", "db", methods="executeQuery executeUpdate execute executeBatch", receiver="(?i)stmt|statement|ps|prepared", imports=r"^java\.sql\b"),
    _B("db", "db", name=r"^(find|get|read|query|count|exists|delete|stream)\w*By\w*$|^(findAll|findById|save|saveAll|deleteById|existsById|getReferenceById|saveAndFlush)$", receiver="(?i)repo|repository|dao"),
    _B("db", "db", methods="createQuery createNativeQuery find persist merge getResultList getSingleResult", receiver=r"(?i)\bem\b|entityManager|session|query", imports="persistence|hibernate"),
    _B("sleep", "sleep", path=r"(^|\.)Thread\.sleep$", blocking=True),
)
C = (
    _B("http", "net", path="^curl_easy_perform$", blocking=True),
    _B("net", "net", path="^(connect|recv|recvfrom|accept|gethostbyname|getaddrinfo)$", blocking=True),
    _B("sleep", "sleep", path="^(sleep|usleep|nanosleep|Sleep)$", blocking=True),
    _B("db", "db", path="^(sqlite3_exec|sqlite3_step|PQexec|PQexecParams|mysql_query|mysql_real_query)$", blocking=True),
    _B("process", "process", path="^(system|popen)$", blocking=True),
)
CPP = (
    *C,
    _B("sleep", "sleep", path=r"^std\.this_thread\.sleep_(for|until)$", blocking=True),
    _B("wait", "wait", methods="get wait", receiver="(?i)fut|future|promise", blocking=True),
    _B("http", "net", path=r"^cpr\.(Get|Post|Put|Delete|Patch|Head)$", blocking=True),
)
RULES: dict[str, tuple[BoundaryRule, ...]] = {"python": PYTHON, "rust": RUST, "go": GO, "javascript": JAVASCRIPT, "typescript": JAVASCRIPT, "tsx": JAVASCRIPT, "java": JAVA, "c": C, "cpp": CPP}
# End of the fixed values.


def _alternatives(pattern: str) -> list[str]:
    """The parts of a pattern between bars that stand outside brackets."""
    out, depth, begin, k = [], 0, 0, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
        depth += c in "([" and 1 or c in ")]" and -1
        if c == "|" and depth == 0:
            out.append(pattern[begin:k])
            begin = k + 1
        k += 1
    return [*out, pattern[begin:]]


def _closing(pattern: str, k: int) -> int:
    depth = 0
    while True:
        depth += {"(": 1, ")": -1}.get(pattern[k], 0)
        if depth == 0:
            return k
        k += 2 if pattern[k] == "\\" else 1


def openings(pattern: str) -> set[tuple[str, bool]]:
    """What texts that match a pattern without its leading ^ begin with: (literal beginning, whether it is the whole text)."""
    found: set[tuple[str, bool]] = set()
    for part in _alternatives(pattern):
        begun = {""}
        k = 0
        while k < len(part):
            if part[k] == "$":
                found |= {(b, True) for b in begun}
                begun = set()
                break
            if part[k] == "(" and part[k + 1 : k + 2] != "?":
                end = _closing(part, k)
                options = {o for o, _ in openings(part[k + 1 : end])}
                if not all(map(_spelt, _alternatives(part[k + 1 : end]))):
                    # only its beginning is literal: nothing is known behind it, but it may be left out
                    found |= {(b + o, False) for b in begun for o in options}
                    options = set()
                k = end + 1
                if not options and part[k : k + 1] != "?":
                    begun = set()
                    break
            elif part[k] == "\\" and not part[k + 1].isalnum():
                options, k = {part[k + 1]}, k + 2
            elif part[k] not in "\\.[*+?{^":
                options, k = {part[k]}, k + 1
            else:
                break
            if part[k : k + 1] == "?":
                options, k = options | {""}, k + 1
            elif part[k : k + 1] in ("*", "+", "{"):
                break
            begun = {b + o for b in begun for o in options}
        found |= {(b, False) for b in begun}
    return found


def _spelt(pattern: str) -> bool:
    """Only characters, escaped marks and groups of such."""
    k = 0
    while k < len(pattern):
        if pattern[k] == "\\":
            if pattern[k + 1].isalnum():
                return False
            k += 2
        elif pattern[k] == "(":
            end = _closing(pattern, k)
            if not all(map(_spelt, _alternatives(pattern[k + 1 : end]))):
                return False
            k = end + 1
        elif pattern[k] in ".[*+{^$":
            return False
        else:
            k += 1
    return True


def keys_of(rule: BoundaryRule) -> set[str]:
    """The index keys of a rule: `name:` of a method or called name, `head:` and `tail:` of the first and last part of a path, or EVERY."""
    if rule.path is None:
        if rule.methods is not None:
            return {f"name:{m}" for m in rule.methods.split()}
        whole = [o for a in _alternatives(rule.name) for o in (openings(a[1:]) if a.startswith("^") else {("", False)})]
        return {f"name:{o}" for o, all_ in whole} if all(all_ for _, all_ in whole) else {EVERY}
    keys: set[str] = set()
    for part in _alternatives(rule.path):
        if part.startswith("^"):
            for begin, whole in openings(part[1:]):
                head, dot, _ = begin.partition(".")
                keys.add(f"head:{head}" if dot or whole else EVERY)
        elif part.startswith(r"(^|\.)") and part.endswith("$") and _spelt(part[6:-1]):
            keys |= {f"tail:{o.rpartition('.')[2]}" for o, _ in openings(part[6:])}
        else:
            keys.add(EVERY)
    return {EVERY} if EVERY in keys else keys


def index(rules: dict[str, tuple[BoundaryRule, ...]] = RULES) -> list[tuple[str, str, int, int]]:
    """(language, key, ordinal within the language, number over all languages) of every key of every rule."""
    out, number = [], 0
    for lang, table in rules.items():
        for ordinal, rule in enumerate(table):
            out += [(lang, key, ordinal, number) for key in sorted(keys_of(rule))]
            number += 1
    return out


def _holds(rule: BoundaryRule) -> Column:
    """The conditions of a rule on a candidate call, all but its language."""
    tests = []
    if rule.awaited is True:
        tests.append(F.col("awaited"))
    if rule.awaited is False or rule.blocking:
        tests.append(~F.col("awaited"))
    if rule.unless_name:
        tests.append(~F.col("name").rlike(rule.unless_name))
    if rule.path is not None:
        tests.append(F.col("path").rlike(rule.path))
    else:
        if rule.methods is not None:
            tests.append((F.col("call_kind") != "ident") & F.col("name").isin(*rule.methods.split()))
        if rule.name is not None:
            tests.append(F.col("name").rlike(rule.name))
    if rule.receiver is not None:
        tests.append(F.col("receiver").rlike(rule.receiver))
    if rule.receiver_type is not None:
        tests.append(F.coalesce("receiver_type", F.lit("")).rlike(rule.receiver_type))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def imported_rules(imports: DataFrame, rules: dict[str, tuple[BoundaryRule, ...]] = RULES) -> DataFrame:
    """(file, has): per file the numbers of the patterns that one of its imports shows. Patterns are tested once per distinct imported name."""
    patterns = sorted({r.imports for table in rules.values() for r in table if r.imports})
    shown = F.filter(F.array(*[F.when(F.col("imported").rlike(p), F.lit(k)) for k, p in enumerate(patterns)]), lambda x: x.isNotNull())
    names = imports.select("imported").distinct().withColumn("_k", F.explode(shown))
    return imports.select("file", "imported").distinct().join(names, "imported").groupBy("file").agg(F.collect_set("_k").alias("has"))


def classify(calls: DataFrame, imports: DataFrame, ids: list[str], rules: dict[str, tuple[BoundaryRule, ...]] = RULES) -> DataFrame:
    """join.rule_match: the calls that are a boundary, with ordinal, kind, category, blocking, confidence, default_timeout, default_client and client_level.

    calls: `ids`, lang, file, path (the dotted callee), name (its last part), call_kind (`ident` for a plain name), receiver,
    receiver_type, awaited; imports: file, imported. A null text shows nothing and a null flag is false. Languages without a table have no boundary.
    """
    spark = calls.sparkSession
    rows = index(rules)
    keyed = spark.createDataFrame(rows, "lang string, key string, ordinal int, number int")
    keyed = F.broadcast(keyed) if len(rows) <= SMALL_INDEX else keyed
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    shown_as = {c: text(c) for c in ("path", "name", "call_kind", "receiver")} | {"lang": F.col("lang"), "file": F.col("file"), "receiver_type": text("receiver_type"), "awaited": F.coalesce("awaited", F.lit(False)).alias("awaited")}
    c = calls.select(*[k for k in ids if k not in shown_as], *shown_as.values())
    # what the rules look at is the same for many calls: each is tried once, and calls meet the rules that fit by equality
    shape = ["lang", "path", "name", "call_kind", "receiver", "receiver_type", "awaited"]
    seen = c.select(*shape).where("lang IS NOT NULL").distinct()
    parts = F.split("path", r"\.")
    found = F.array_distinct(F.array(F.lit(EVERY), F.concat(F.lit("name:"), "name"), F.concat(F.lit("head:"), F.get(parts, F.lit(0))), F.concat(F.lit("tail:"), F.element_at(parts, -1))))
    candidates = seen.withColumn("key", F.explode(found)).join(keyed, ["lang", "key"])
    flat = [r for table in rules.values() for r in table]
    patterns = {p: k for k, p in enumerate(sorted({r.imports for r in flat if r.imports}))}
    needs = F.element_at(F.array(*[F.lit(patterns.get(r.imports, -1)) for r in flat]), F.col("number") + 1)
    fits = reduce(lambda acc, k: F.when(F.col("number") == k, _holds(flat[k])).otherwise(acc), range(len(flat)), F.lit(False))
    fitting = cut(candidates.where(fits).groupBy(*shape).agg(F.collect_set(F.struct("ordinal", "number", needs.alias("needs"))).alias("_fit")))
    fitting = F.broadcast(fitting) if fitting.count() <= SMALL_INDEX else fitting
    candidates = c.join(fitting, shape)
    shown_by = F.filter("_fit", lambda x: (x["needs"] < 0) | F.array_contains("has", x["needs"]))
    candidates = candidates.join(imported_rules(imports, rules), "file", "left").withColumn("_b", F.array_min(shown_by)).where("_b IS NOT NULL")
    # ordinal and number as one whole number, which a hash table can hold the least of; the number tells the language too
    best = candidates.groupBy(*ids).agg(F.min(F.shiftleft(F.col("_b.ordinal").cast("long"), 32) + F.col("_b.number")).alias("_b"))
    best = best.select(*ids, F.struct(F.shiftright("_b", 32).cast("int").alias("ordinal"), F.col("_b").bitwiseAND(0xFFFFFFFF).cast("int").alias("number")).alias("_b"))
    best = best.withColumn("lang", F.element_at(F.array(*[F.lit(lang) for lang, t in rules.items() for _ in t]), F.col("_b.number") + 1))
    shown = F.element_at(
        F.array(
            *[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.category).alias("category"), F.lit(r.blocking).alias("blocking"), F.lit(r.confidence).alias("confidence"), F.lit(r.default_timeout).cast("string").alias("default_timeout"), F.lit(r.default_client).alias("default_client"), F.lit(r.client_level).alias("client_level")) for r in flat]
        ),
        F.col("_b.number") + 1,
    )
    return best.select(*ids, "lang", F.col("_b.ordinal").alias("ordinal"), shown.alias("_r")).select(*ids, "lang", "ordinal", "_r.*")
