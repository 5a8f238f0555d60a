import pytest
from pyspark.sql import functions as F

from tracewell.functions import text as fn

INF = float("inf")


@pytest.mark.parametrize(
    "source, lang, seconds",
    [
        ("Duration::from_secs(30)", "rust", 30.0),
        ("Duration::from_millis(250)", "rust", 0.25),
        ("timeout=5", "python", 5.0),
        ("timeout: 5000", "javascript", 5.0),
        ("5 * time.Second", "go", 5.0),
        ("timedelta(minutes=2)", "python", 120.0),
        ("Duration.ofSeconds(10)", "java", 10.0),
        ("10, TimeUnit.MILLISECONDS", "java", 0.01),
        ("fetch(url)", "python", None),
        ("timeout=1.5, retries=3", "python", 1.5),
    ],
)
def test_parse_duration(source, lang, seconds):
    assert fn.parse_duration(source, lang) == seconds


def test_sleep_duration():
    assert fn.sleep_duration("time.sleep(2)") == 2.0
    assert fn.sleep_duration("setTimeout(resolve, 1500)", "javascript") == 1.5
    assert fn.sleep_duration("work()") is None


def test_split_top_and_braces():
    assert fn.split_top("a, f(b, c), {d: [e, g]}, 'x,y'") == ["a", "f(b, c)", "{d: [e, g]}", "'x,y'"]
    assert fn.split_top("") == []
    assert fn.expand_braced("a::{b, c::{self, D as E}}") == [("b", "a::b"), ("c", "a::c"), ("E", "a::c::D")]
    assert fn.matching_paren("f(a(b)c)d", 1) == 7
    assert fn.matching_paren("f(a", 1) == -1


def test_normalize():
    assert fn.normalize("a::<T<U>>::b (x)(y).c") == "a.b.c"
    assert fn.normalize("self . client\n.get") == "self.client.get"
    assert fn.normalize("x?.y[0].z") == "x.y.z"


def test_arity():
    assert fn.arity("self, a, b=1") == (1, 2.0, True)
    assert fn.arity("a, *rest") == (1, INF, False)
    assert fn.arity("&mut self") == (0, 0.0, True)
    assert fn.arity("") == (0, 0.0, False)


def test_loop_count():
    assert fn.loop_count("for i in range(3)") == ("counted", 3)
    assert fn.loop_count("for i in range(2, N)", {"N": 7.0}) == ("counted", 5)
    assert fn.loop_count("for i in 0..=4") == ("counted", 5)
    assert fn.loop_count("for (let i = 0; i < 9; i++)") == ("counted", 9)
    assert fn.loop_count("while True") == ("forever", None)
    assert fn.loop_count("while x < 3") == ("conditional", None)
    assert fn.loop_count("for x in items") == ("collection", None)


def test_retry_decorator():
    assert fn.retry_decorator("@retry(stop=stop_after_attempt(4), wait=wait_exponential())") == (4, "exponential")
    assert fn.retry_decorator("@retry") == (None, "none")
    assert fn.retry_decorator("@cached") is None


def test_constants_and_lines():
    assert fn.resolve_constants("range(cfg.ATTEMPTS) * CALL", {"ATTEMPTS": 3.0}) == "range(3) * CALL"
    assert fn.joined_lines(["let a = f(", "  1,", "  2);", "b()"]) == [(1, "let a = f( 1, 2);"), (4, "b()")]


def test_columns(spark):
    df = spark.createDataFrame([("a/b/__init__.py", "x::y#z(1)", "file:///a%20b+c", 0.12), ("a/b/c.rs", "p$q", "src/x.rs", 120.0)], "path string, q string, uri string, s double")
    got = df.select(
        fn.language_of(F.col("path")).alias("lang"),
        F.array_join(fn.default_module(F.col("path"), F.lit(True)), ".").alias("module"),
        fn.norm_qualname(F.col("q")).alias("q"),
        fn.uri_path(F.col("uri")).alias("uri"),
        fn.format_seconds(F.col("s")).alias("s"),
        fn.format_trace(F.col("s")).alias("t"),
        fn.test_name(F.col("path")).alias("n"),
    ).collect()
    assert tuple(got[0]) == ("python", "a.b", "x.y.z", "/a b+c", "120 ms", "120 ms", "test_a_b_init_py")
    assert tuple(got[1]) == ("rust", "a.b.c", "p.q", "src/x.rs", "2.0 min", "120.00 s", "test_a_b_c_rs")
    one = spark.range(1).select(
        fn.format_seconds(F.lit(INF)).alias("a"),
        fn.format_seconds(F.lit(2.0)).alias("b"),
        fn.otlp_id(F.lit("0C0C0C0C0C0C0C0C")).alias("c"),
        fn.guard_reason(F.lit("rm -rf /x")).alias("d"),
        fn.guard_reason(F.lit("ls")).alias("e"),
        fn.sql_values(F.lit("SELECT a FROM t WHERE x = {user_id}")).alias("f"),
        fn.sql_values(F.lit("SELECT {columns} FROM t")).alias("g"),
        fn.line_of(F.lit("a\nb\nc"), F.lit(4)).alias("h"),
        fn.canon(F.lit("np.random.rand"), F.create_map(F.lit("np"), F.lit("numpy"))).alias("i"),
        F.array_join(fn.rust_module(F.lit("crates/x/src/net/mod.rs"), F.lit("x")), "::").alias("j"),
        fn.family(F.lit("tsx")).alias("k"),
        fn.parse_default(F.lit("30s (library)")).alias("l"),
    ).first()
    assert tuple(one) == ("unbounded", "2 s", "0c0c0c0c0c0c0c0c", "destructive", None, True, False, 3, "numpy.random.rand", "x::net", "javascript", 30.0)


def test_loop_flags_and_headers(spark):
    body = "for attempt in range(3):\n    try:\n        return get()\n    except E:\n        time.sleep(2 ** attempt)"
    one = spark.range(1).select(
        fn.loop_flags(F.lit(body)).alias("f"),
        fn.retry_like(fn.loop_flags(F.lit(body))).alias("r"),
        fn.retry_like(fn.loop_flags(F.lit("for x in xs: total += x"))).alias("n"),
        fn.signature(F.lit("x\ndef f(a,\n      b):\n    pass"), F.lit(2), F.lit(4)).alias("s"),
        fn.constant(F.lit("cfg.LIMIT"), F.create_map(F.lit("LIMIT"), F.lit(3))).alias("c"),
        fn.dependency(F.lit("a/node_modules/b.js")).alias("d"),
        fn.dependency(F.lit("src/vendors.py")).alias("e"),
    ).first()
    assert one.f.asDict() == {"handles_errors": True, "sleeps": True, "exponential": True, "exits": True, "retryish": True, "wall_bound": False}
    assert tuple(one)[1:] == (True, False, "def f(a, b):", 3, True, False)
    assert fn.argc("a, f(b, c)") == 2
