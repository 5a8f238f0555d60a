import gzip
import json
import sqlite3
import struct

from pyspark.sql import functions as F

from tracewell.sources import otlp, python_ast, recordings
from tracewell.streaming import ticks


#: Two spans of one trace, as a collector writes them.
OTLP = {"resourceSpans": [{"scopeSpans": [{"spans": [
    {"traceId": "5e" * 16, "spanId": "77" * 8, "parentSpanId": "78" * 8, "name": "reserve", "kind": 3, "startTimeUnixNano": "400", "endTimeUnixNano": "950", "status": {"code": 2}, "attributes": [{"key": "seats", "value": {"intValue": "4"}}]},
    {"traceId": "5e" * 16, "spanId": "79" * 8, "name": "quote", "kind": "SPAN_KIND_INTERNAL", "startTimeUnixNano": "100", "endTimeUnixNano": "1200", "attributes": []},
]}]}]}


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def field(n, kind, body):
    return varint(n << 3 | kind) + (varint(len(body)) + body if kind == 2 else body)


def test_protobuf_spans():
    attr = lambda k, v: field(9, 2, field(1, 2, k) + field(2, 2, v))
    span = field(1, 2, bytes(range(16))) + field(2, 2, bytes(range(60, 68))) + field(5, 2, b"POST /cart") + field(6, 0, varint(3)) + field(7, 1, struct.pack("<Q", 333)) + field(8, 1, struct.pack("<Q", 777)) + attr(b"left", field(3, 0, varint(-12))) + attr(b"rate", field(4, 1, struct.pack("<d", 0.25)))
    body = field(1, 2, field(2, 2, field(2, 2, span)))
    for data in (body, gzip.compress(body)):
        (s,) = otlp.load_body(data)
        assert (s["name"], s["kind"], s["end_ns"] - s["start_ns"], s["attrs"]) == ("POST /cart", 3, 444, {"left": -12, "rate": 0.25})


def test_json_lines_and_errors(spark):
    two = (json.dumps(OTLP) + "\n") * 2
    files = spark.createDataFrame([("a", bytearray(two, "utf-8")), ("b", bytearray(b"\xff\xff\xff")), ("c", bytearray(b"{oops"))], "path string, content binary")
    assert otlp.spans(files).count() == 4
    assert {r.path for r in otlp.parse_errors(files).collect()} == {"b", "c"}


def test_span_lines(spark, tmp_path):
    p = str(tmp_path / "spans.jsonl")
    with open(p, "w") as f:
        f.write('{"meta": "m"}\n{"trace_id": "t", "span_id": "s", "name": "n", "kind": 3, "start_ns": 1, "end_ns": 9223372036854775807, "attrs": {"db.system": "pg"}}\n')
    s = otlp.spans_jsonl(spark, p)
    assert [(r.end_ns, r.attrs) for r in s.collect()] == [(2**63 - 1, {"db.system": "pg"})]
    assert [(r.system, r.target) for r in otlp.io_info(s).collect()] == [("db", "pg")]


def test_sqlite_store(spark, tmp_path):
    p = tmp_path / "x.db"
    db = sqlite3.connect(p)
    db.execute("create table meta(key, value)")
    db.execute("insert into meta values ('pid', '42')")
    db.execute("create table calls(id, parent, thread, file, line, qualname, is_coro, start, dur, self_dur, slices, max_self_slice, shapes)")
    db.execute("insert into calls values (1, null, 7, 'a.py', 3, 'f', 1, 0.5, 2.0, 1.0, 1, 1.0, '{\"n\": 10}')")
    db.commit()
    db.close()
    files = spark.createDataFrame([(bytearray(p.read_bytes()),), (bytearray(b"no store"),)], "content binary")
    (r,) = recordings.sqlite_calls(files).collect()
    assert (r.pid, r.qualname, r.is_coro, r.shapes) == (42, "f", True, {"n": 10.0})


def test_scip(spark):
    occ = lambda line, sym, role: field(2, 2, field(1, 2, varint(line) + varint(0) + varint(4)) + field(2, 2, sym) + field(3, 0, varint(role)))
    index = field(2, 2, field(1, 2, b"a.rs") + occ(9, b"f().", 1) + occ(20, b"f().", 0))
    o = recordings.scip_occurrences(spark.createDataFrame([(bytearray(index),)], "content binary"))
    assert sorted(map(tuple, o.collect())) == [("a.rs", 9, "f().", 1), ("a.rs", 20, "f().", 0)]
    fns = spark.createDataFrame([("a.rs", "outer", 1, 50), ("a.rs", "inner", 8, 15)], "file string, id string, line int, end_line int")
    bound = recordings.bind_definitions(o, fns)
    assert [tuple(r) for r in bound.collect()] == [("f().", "inner")]
    assert [tuple(r) for r in recordings.bind_references(o, bound).collect()] == [("a.rs", 21, ["inner"])]


def test_files_and_parser(spark, tmp_path):
    (tmp_path / "tests").mkdir()
    (tmp_path / "app.py").write_text("import x\nclass C:\n    async def f(self):\n        for i in range(3):\n            await x.get(i)\n        for y in x.items():\n            pass\n")
    (tmp_path / "bad.py").write_text("def (:\n")
    (tmp_path / "tests" / "test_a.py").write_text("pass\n")
    (tmp_path / "notes.txt").write_text("no source\n")
    files = recordings.source_files(spark, str(tmp_path))
    assert sorted(r.path.split("/")[-1] for r in files.collect()) == ["app.py", "bad.py"]
    rows = python_ast.parse(files).collect()
    assert [(r.qualname, r.is_async) for r in rows if r.kind == "function"] == [("C.f", True)]
    assert sorted((r.path, r.awaited, r.loop_depth) for r in rows if r.kind == "call") == [("range", False, 0), ("x.get", True, 1), ("x.items", False, 0)]
    assert [(r.loop_kind, r.bound) for r in rows if r.kind == "loop"] == [("counted", 3), ("collection", None)]
    assert [r.kind for r in rows if r.error] == ["error"]


def test_clock_shift(spark):
    one = spark.range(1).select(recordings.clock_shift(F.lit(100.0), F.lit(5000.0), F.lit(90.0)).alias("a"), recordings.clock_shift(F.lit(10.0), F.lit(5000.0), F.lit(90.0)).alias("b")).first()
    assert tuple(one) == (4910.0, 0.0)


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text("".join(json.dumps({"log": "l", "at": f"2026-01-01 00:00:{s:02d}", "line": "t"}) + "\n" for s in (0, 1, 2, 30, 31)))
    q = ticks.stalls(ticks.read_ticks(spark, str(src)), 10.0).writeStream.format("memory").queryName("stalls").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    got = spark.table("stalls").collect()
    assert [(r.log, (r.w1_us - r.w0_us) // 1_000_000) for r in got] == [("l", 28)]
    q = ticks.sessions(ticks.read_ticks(spark, str(src))).writeStream.format("memory").queryName("runs").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    assert sorted(r.ticks for r in spark.table("runs").collect()) == [2, 3]


def test_sinks(spark, tmp_path):
    """Relations replace their own table, ledgers append, test results replace those of their files only."""
    from tracewell.sources import sinks

    folder = str(tmp_path)
    for n in (3, 2):
        sinks.write_relations({"functions": spark.range(n), "edges": spark.range(1)}, folder)
    assert spark.read.parquet(f"{folder}/functions").count() == 2
    for seq in (1, 2):
        sinks.append_rounds(spark.createDataFrame([("f", seq)], "finding string, seq long"), f"{folder}/ledger")
    assert spark.read.parquet(f"{folder}/ledger").count() == 2
    row = lambda *x: spark.createDataFrame(x, "test string, outcome string, file string")
    sinks.overwrite_tests(row(("t1", "failed", "a"), ("t2", "passed", "b")), f"{folder}/tests")
    sinks.overwrite_tests(row(("t1", "passed", "a")), f"{folder}/tests")
    assert {tuple(r) for r in spark.read.parquet(f"{folder}/tests").select("test", "outcome", "file").collect()} == {("t1", "passed", "a"), ("t2", "passed", "b")}
    (doc,) = sinks.document(spark.range(1), "nodes").collect()
    assert (doc.relation, json.loads(doc.row)) == ("nodes", {"id": 0})
