"""join.rule_match over the boundary tables of all languages.

Every line item is a call in the source of its supplier, written like one of the samples below. What each sample must be is stated here by
hand, not taken from the tables: the twin looks the expectation up.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boundaries
from .adapters import table
from .catalogue import query

# (language, path, kind of call, receiver, receiver type, awaited, library that half of the files import, what it is with that import, what it is without)
SAMPLES = (
    ("python", "requests.get", "attr", "requests", None, False, "requests", "http/net", "http/net"),
    ("python", "requests.Session", "attr", "requests", None, False, "requests", None, None),
    ("python", "self.session.post", "attr", "self.session", None, False, "requests", "http/net", None),
    ("python", "self.client.get", "attr", "self.client", None, True, "httpx", "http/net", None),
    ("python", "session.send", "attr", "session", None, True, "aiohttp.client", None, None),
    ("python", "session.patch", "attr", "session", None, True, "aiohttp", "http/net", None),
    ("python", "time.sleep", "attr", "time", None, False, "time", "sleep/sleep", "sleep/sleep"),
    ("python", "os.system", "attr", "os", None, False, "os", "process/process", "process/process"),
    ("python", "psycopg.connect", "attr", "psycopg", None, False, "psycopg", "db/db", "db/db"),
    ("python", "cur.fetchall", "attr", "cur", None, False, "sqlite3", "db/db", None),
    ("python", "User.objects.get", "attr", "User.objects", None, False, "django.db", "db/db", None),
    ("python", "pool.fetchrow", "attr", "pool", None, True, "asyncpg", "db/db", "api/net"),
    ("python", "open", "ident", "", None, False, "io", "file/fs", "file/fs"),
    ("python", "path.read_text", "attr", "path", None, False, "pathlib", "file/fs", "file/fs"),
    ("python", "read_text", "ident", "", None, False, "pathlib", None, None),
    ("python", "loop.run_until_complete", "attr", "loop", None, False, "asyncio", "runtime/runtime", "runtime/runtime"),
    ("python", "argon2.low.verify", "attr", "argon2.low", None, False, "argon2", "cpu/cpu", "cpu/cpu"),
    ("python", "fut.result", "attr", "fut", None, False, "concurrent.futures", "future/wait", None),
    ("python", "fetch_prices", "ident", "", None, True, "os", "api/net", "api/net"),
    ("python", "fetch_prices", "ident", "", None, False, "os", None, None),
    ("rust", "reqwest.blocking.get", "attr", "reqwest.blocking", None, False, "reqwest.blocking", "http/net", "http/net"),
    ("rust", "reqwest.Client.new", "attr", "reqwest.Client", None, True, "reqwest", None, None),
    ("rust", "req.send", "attr", "req", None, False, "ureq", "http/net", None),
    ("rust", "thread.sleep", "attr", "thread", None, False, "std.thread", "sleep/sleep", "sleep/sleep"),
    ("rust", "std.fs.read", "attr", "std.fs", None, False, "std.fs", "fs/fs", "fs/fs"),
    ("rust", "std.io.stdout.lock.flush", "attr", "std.io.stdout.lock", None, False, "std.io", "stdio/fs", "stdio/fs"),
    ("rust", "f.sync_all", "attr", "f", "std.fs.File", False, "std.fs", "fs/fs", "fs/fs"),
    ("rust", "f.sync_all", "attr", "f", None, False, "std.fs", None, None),
    ("rust", "rpc.get_slot", "attr", "rpc", "solana_client.rpc_client.RpcClient", False, "x", "rpc/net", "rpc/net"),
    ("rust", "addr.to_socket_addrs", "attr", "addr", None, False, "std.net", "dns/net", "dns/net"),
    ("rust", "handle.block_on", "attr", "handle", None, False, "tokio", "block_on/runtime", "block_on/runtime"),
    ("rust", "rx.recv", "attr", "rx", None, False, "std.sync.mpsc", "channel/wait", None),
    ("rust", "sqlx.query", "attr", "sqlx", None, True, "sqlx", "db/db", "db/db"),
    ("rust", "q.fetch_one", "attr", "q", None, True, "sqlx", "db/db", "api/net"),
    ("rust", "ws.connect_async", "attr", "ws", None, True, "x", "net/net", "net/net"),
    ("go", "net/http.Get", "attr", "net/http", None, False, "net/http", "http/net", "http/net"),
    ("go", "client.Do", "attr", "client", None, False, "net/http", "http/net", None),
    ("go", "db.Query", "attr", "db", None, False, "database/sql", "db/db", None),
    ("go", "tx.Find", "attr", "tx", None, False, "gorm.io/gorm", "db/db", None),
    ("go", "conn.Invoke", "attr", "conn", None, False, "google.golang.org/grpc", "rpc/net", None),
    ("go", "time.Sleep", "attr", "time", None, False, "time", "sleep/sleep", "sleep/sleep"),
    ("go", "cmd.Output", "attr", "cmd", None, False, "os/exec", "process/process", None),
    ("javascript", "fs.readFileSync", "attr", "fs", None, False, "fs", "fs/fs", "fs/fs"),
    ("javascript", "bcryptjs.hashSync", "attr", "bcryptjs", None, False, "bcryptjs", "cpu/cpu", "cpu/cpu"),
    ("javascript", "window.fetch", "attr", "window", None, True, "x", "http/net", "http/net"),
    ("javascript", "axios", "ident", "", None, True, "axios", "http/net", "http/net"),
    ("javascript", "axios.create", "attr", "axios", None, False, "axios", None, None),
    ("typescript", "prisma.user.findMany", "attr", "prisma.user", None, True, "@prisma/client", "db/db", None),
    ("typescript", "users.findOne", "attr", "users", None, True, "mongoose", "db/db", None),
    ("typescript", "knex.raw", "attr", "knex", None, True, "knex", "db/db", None),
    ("tsx", "api.get", "attr", "api", None, True, "axios", "http/net", None),
    ("tsx", "loadUser", "ident", "", None, True, "axios", None, None),
    ("java", "client.sendAsync", "attr", "client", None, False, "java.net.http.HttpClient", "http/net", None),
    ("java", "restTemplate.exchange", "attr", "restTemplate", None, False, "org.springframework.web.client.RestTemplate", "http/net", None),
    ("java", "stmt.executeQuery", "attr", "stmt", None, False, "java.sql.Statement", "db/db", None),
    ("java", "userRepository.findOneByName", "attr", "userRepository", None, False, "x", "db/db", "db/db"),
    ("java", "java.lang.Thread.sleep", "attr", "java.lang.Thread", None, False, "x", "sleep/sleep", "sleep/sleep"),
    ("c", "recv", "ident", "", None, False, "sys/socket.h", "net/net", "net/net"),
    ("c", "PQexec", "ident", "", None, False, "libpq-fe.h", "db/db", "db/db"),
    ("c", "receive", "ident", "", None, False, "x", None, None),
    ("cpp", "usleep", "ident", "", None, False, "unistd.h", "sleep/sleep", "sleep/sleep"),
    ("cpp", "std.this_thread.sleep_for", "attr", "std.this_thread", None, False, "thread", "sleep/sleep", "sleep/sleep"),
    ("cpp", "promise.wait", "attr", "promise", None, False, "future", "wait/wait", "wait/wait"),
    ("cobol", "recv", "ident", "", None, False, "x", None, None),
)
_LIT = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
_LIST = lambda k: "[" + ", ".join(_LIT(s[k]) for s in SAMPLES) + "]"


@query(
    f"WITH c AS (SELECT 1 + l_partkey % {len(SAMPLES)} AS s, l_suppkey % 2 = 0 AS imported FROM lineitem), e AS (SELECT {_LIST(0)}[s] AS lang, {_LIST(1)}[s] AS path, CASE WHEN imported THEN {_LIST(7)}[s] ELSE {_LIST(8)}[s] END AS found FROM c) "
    "SELECT lang, path, split_part(found, '/', 1) AS kind, split_part(found, '/', 2) AS category, count(*) AS n FROM e WHERE found IS NOT NULL GROUP BY ALL"
)
def boundary_rules(spark, sf):
    """join.rule_match: the boundary tables of nine languages over every line item as a call of its supplier's source, with and without the import that a rule asks for"""
    i = table(spark, sf, "lineitem")
    # lines that share their numbers and sample are one call so many times; all else follows from these four
    i = i.groupBy("l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_partkey") % len(SAMPLES) + 1).cast("int").alias("sample")).agg(F.count("*").alias("times"))
    at = F.col("sample")
    pick = lambda k, kind="string": F.element_at(F.array(*[F.lit(s[k]).cast(kind) for s in SAMPLES]), at)
    # a file holds the calls of one sample of one supplier, so that it imports one library
    file = F.concat_ws("/", F.col("l_suppkey"), at)
    calls = i.select("l_orderkey", "l_linenumber", "times", file.alias("file"), (F.col("l_suppkey") % 2 == 0).alias("importing"), pick(0).alias("lang"), pick(1).alias("path"), pick(2).alias("call_kind"), pick(3).alias("receiver"), pick(4).alias("receiver_type"), pick(5, "boolean").alias("awaited"), pick(6).alias("imported"))
    calls = calls.withColumn("name", F.element_at(F.split("path", r"\."), -1))
    imports = calls.where("importing").select("file", "imported")
    found = boundaries.classify(calls, imports, ["l_orderkey", "l_linenumber", "file", "path", "times"])
    return found.groupBy("lang", "path", "kind", "category").agg(F.sum("times").alias("n"))
