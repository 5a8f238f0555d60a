"""Profiles, coverage, event traces, heartbeats, stores and test reports as DataFrames."""

from __future__ import annotations

import json
import os
import sqlite3
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph, intervals, islands

# Seconds per unit of a speedscope profile.
UNITS = {"nanoseconds": 1e-9, "microseconds": 1e-6, "milliseconds": 1e-3, "seconds": 1.0, "none": 1.0}
# Directories that are not looked at, those that hold tests, and the names of tests and generated files.
SKIPPED = (
    ".git .hg .svn .audit node_modules target vendor dist build out .venv venv env __pycache__ .tox .mypy_cache .pytest_cache obj "
    ".gradle .idea .vscode Pods DerivedData .next .nuxt coverage bower_components site-packages .terraform"
).split()
TESTING = "test tests __tests__ spec specs testdata fixtures e2e benches".split()
TEST_FILE = r"(^|/)test_[^/]*\.py$|_test\.(py|go)$|\.(test|spec)\.[cm]?[jt]sx?$|Tests?\.java$"
GENERATED = r"\.(min|bundle|pb|g|generated|designer)\.\w+$|_pb2(_grpc)?\.py$"
# End of the fixed values.
MAX_FILE_BYTES = 2_000_000


def _below(names: list[str]) -> str:
    """A pattern of paths that lead through a directory of one of these names."""
    return "(^|/)(" + "|".join(n.replace(".", "[.]") for n in names) + ")/"


def source_files(spark: SparkSession, root: str, include_tests: bool = False) -> DataFrame:
    """src.files, src.size_guard: (path, length, content, skipped_large) of the source files below a root.

    The filters stand on the path and length before the content is looked at, so the reader prunes files.
    """
    from ..functions.text import language_of

    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.col("path")
    f = f.where(~path.rlike(_below(SKIPPED)) & ~path.rlike(GENERATED)).withColumn("lang", language_of(path)).where("lang IS NOT NULL")
    if not include_tests:
        f = f.where(~path.rlike(_below(TESTING)) & ~path.rlike(TEST_FILE))
    big = F.col("length") > MAX_FILE_BYTES
    return f.select("path", "lang", "length", F.when(~big, F.col("content")).alias("content"), big.alias("skipped_large"))


def profile_kind(text: Column) -> Column:
    """src.profile_kind: by the keys at the top of the document; null where none fits. A list has no keys, so it is not searched for them."""
    has = lambda k: F.get_json_object(text, f"$.{k}").isNotNull()
    return F.when(text.rlike(r"^\s*\["), "chrome").when(has("nodes") & has("samples"), "cpuprofile").when(has("profiles") & has("shared"), "speedscope").when(has("result"), "coverage").when(has("traceEvents"), "chrome")


def speedscope(docs: DataFrame, name: str = "profile", text: str = "value") -> tuple[DataFrame, DataFrame, DataFrame]:
    """src.speedscope, proj.unit_scale: (frames, samples, evented) of speedscope documents; seconds."""
    kind = "shared struct<frames: array<struct<name: string, file: string, line: int, col: int>>>, profiles array<struct<type: string, name: string, unit: string, startValue: double, samples: array<array<int>>, weights: array<double>, events: array<struct<type: string, frame: int, at: double>>>>"
    d = docs.select(name, F.from_json(text, kind).alias("d"))
    frames = d.select(name, F.posexplode("d.shared.frames").alias("frame", "f")).select(name, "frame", "f.name", "f.file", "f.line", "f.col")
    p = d.select(name, F.posexplode("d.profiles").alias("thread", "p"))
    scale = F.lit(1.0)
    for unit, s in UNITS.items():
        scale = F.when(F.col("p.unit") == unit, s).otherwise(scale)
    s = p.where("p.type = 'sampled'").select(name, "thread", scale.alias("k"), F.posexplode(F.arrays_zip("p.samples", "p.weights")).alias("seq", "x"))
    w = Window.partitionBy(name, "thread").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    s = s.select(name, "thread", "seq", F.col("x.samples").alias("stack"), (F.col("x.weights") * F.col("k")).alias("dt"))
    samples = s.withColumn("t", F.coalesce(F.sum("dt").over(w), F.lit(0.0)))
    e = p.where("p.type = 'evented'").select(name, "thread", scale.alias("k"), F.posexplode("p.events").alias("ord", "e"))
    return frames, samples, e.select(name, "thread", "ord", F.col("e.type").alias("type"), F.col("e.frame").alias("frame"), (F.col("e.at") * F.col("k")).alias("at"))


def evented_calls(evented: DataFrame, name: str = "profile") -> DataFrame:
    """win.evented over a speedscope profile."""
    return islands.paired(evented, [name, "thread"], ["ord"], F.col("type") == "O", "frame", "at")


def cpuprofile(docs: DataFrame, name: str = "profile", text: str = "value") -> DataFrame:
    """src.cpuprofile: (profile, seq, t, dt, stack of function names outer to inner) in seconds; negative deltas count as none."""
    kind = "nodes array<struct<id: int, callFrame: struct<functionName: string, url: string, lineNumber: int>, children: array<int>>>, startTime double, samples array<int>, timeDeltas array<double>"
    d = docs.select(name, F.from_json(text, kind).alias("d"))
    nodes = d.select(name, F.explode("d.nodes").alias("n")).select(name, F.col("n.id").alias("node"), F.col("n.callFrame.functionName").alias("fn"), F.col("n.children").alias("children"))
    tree = nodes.select(name, F.col("node").alias("up"), F.explode("children").alias("node"))
    ids = nodes.join(tree, [name, "node"], "left").select(F.struct(name, "node").alias("id"), F.when(F.col("up").isNotNull(), F.struct(F.col(name), F.col("up").alias("node"))).alias("parent"))
    anc = graph.ancestors(ids)
    names = nodes.select(F.struct(name, "node").alias("anc"), "fn")
    outer = anc.join(names, "anc").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("depth", "fn")), asc=False).alias("o"))
    stacks = nodes.select(F.struct(name, "node").alias("id"), "fn").join(outer, "id", "left").select(F.col(f"id.{name}").alias(name), F.col("id.node").alias("node"), F.concat(F.coalesce(F.transform("o", lambda x: x["fn"]), F.array().cast("array<string>")), F.array("fn")).alias("stack"))
    s = d.select(name, F.col("d.startTime").alias("t0"), F.posexplode(F.arrays_zip("d.samples", "d.timeDeltas")).alias("seq", "x")).select(name, "t0", "seq", F.col("x.samples").alias("node"), F.greatest(F.col("x.timeDeltas"), F.lit(0.0)).alias("us"))
    w = Window.partitionBy(name).orderBy("seq")
    s = s.withColumn("t", (F.col("t0") + F.sum("us").over(w.rowsBetween(Window.unboundedPreceding, 0))) / 1e6).withColumn("dt", F.coalesce(F.lead("us").over(w), F.lit(0.0)) / 1e6)
    return s.join(stacks, [name, "node"]).select(name, "seq", "t", "dt", "stack")


def clock_shift(start: Column, epoch: Column, mono: Column) -> Column:
    """proj.clock_shift: monotonic starts within a week of the recording's monotonic clock move to epoch time."""
    return F.when((start >= mono - 1) & (start <= mono + 604_800), epoch - mono).otherwise(F.lit(0.0))


def coverage(docs: DataFrame, text: str = "value") -> DataFrame:
    """src.coverage: exact counts of (url, function); the first range of a function is its own."""
    kind = "result array<struct<url: string, functions: array<struct<functionName: string, ranges: array<struct<startOffset: int, endOffset: int, count: bigint>>>>>>"
    r = docs.select(F.explode(F.from_json(text, kind)["result"]).alias("r")).select("r.url", F.explode("r.functions").alias("f"))
    return r.groupBy("url", F.col("f.functionName").alias("function"), F.col("f.ranges")[0]["startOffset"].alias("offset")).agg(F.sum(F.col("f.ranges")[0]["count"]).alias("count"))


def coverage_of_functions(docs: DataFrame, sources: DataFrame, functions: DataFrame, profile: str = "profile", text: str = "value") -> DataFrame:
    """src.coverage: (path, id, qualname, count) of the map's functions: exact call counts, added up over documents.

    sources: path, content; functions: path, id, qualname, start, end (lines). The offsets of a script's functions become lines; the function of
    the map is the smallest around the first line, and it takes the one script function that has its name, else its lines: closures and
    the wrapper of the module share its lines but are not it. Among equals the first one counts. Scripts without a source give none.
    """
    from ..functions.text import uri_path

    kind = "result array<struct<url: string, functions: array<struct<functionName: string, ranges: array<struct<startOffset: int, endOffset: int, count: bigint>>>>>>"
    scripts = docs.select(profile, F.posexplode(F.from_json(text, kind)["result"]).alias("script", "r")).select(profile, "script", uri_path(F.col("r.url")).alias("path"), F.posexplode("r.functions").alias("ord", "f"))
    own = F.col("f.ranges")[0]
    seen = scripts.select(profile, "script", "path", "ord", F.col("f.functionName").alias("name"), own["startOffset"].alias("from"), F.greatest(own["startOffset"], own["endOffset"] - 1).alias("to"), own["count"].alias("count"))
    # a line is the range of offsets from its first character to its end
    cut_up = sources.select("path", F.posexplode(F.split("content", "\n", -1)).alias("p", "_l")).withColumn("_n", F.length("_l") + 1)
    after = F.sum("_n").over(Window.partitionBy("path").orderBy("p"))
    lines = cut_up.select("path", (F.col("p") + 1).alias("fn"), (after - F.col("_n")).alias("start"), (after - 1).alias("end"))
    ids = [profile, "script", "ord"]
    line_of = lambda at: intervals.enclosing_smallest(seen.select(*ids, "path", F.col(at).alias("at")), lines, "path", "at", ids).select(*ids, F.col("fn").alias(f"{at}_line"))
    placed = seen.join(line_of("from"), ids).join(line_of("to"), ids)
    around = intervals.enclosing_smallest(placed, functions.withColumnRenamed("id", "fn"), "path", "from_line", ids)
    short = lambda c: F.element_at(F.split(c, r"[.]|::"), -1)
    name = F.coalesce("name", F.lit(""))
    by_name, by_lines = (name != "") & (short(F.col("qualname")) == short(name)), (F.col("start") == F.col("from_line")) & (F.col("end") == F.col("to_line"))
    best = around.where(by_name | by_lines).groupBy(profile, "script", "path", "fn", "qualname").agg(F.min_by("count", F.struct(~by_name, ~by_lines, "ord")).alias("count"))
    return best.groupBy("path", F.col("fn").alias("id"), "qualname").agg(F.sum("count").alias("count"))


def chrome_events(docs: DataFrame, name: str = "profile", text: str = "value") -> DataFrame:
    """src.chrome: begin and end events; an array that was never closed is closed, complete events become pairs.

    Ties: an end comes before a begin, and of begins at one time the longer event comes first.
    """
    kind = "array<struct<ph: string, name: string, ts: double, pid: bigint, tid: bigint, dur: double>>"
    body = F.coalesce(F.get_json_object(text, "$.traceEvents"), F.col(text))
    whole = F.when(F.trim(body).endswith("]"), body).otherwise(F.concat(F.regexp_replace(body, r",\s*$", ""), F.lit("]")))
    e = docs.select(name, F.posexplode(F.from_json(whole, kind)).alias("ord", "e")).select(name, "ord", "e.*").where("ph IN ('B', 'E', 'X')")
    both = F.when(F.col("ph") == "X", F.array(F.struct(F.lit("B").alias("ph"), F.col("ts").alias("at"), (-F.col("dur")).alias("k")), F.struct(F.lit("E").alias("ph"), (F.col("ts") + F.col("dur")).alias("at"), F.col("dur").alias("k")))).otherwise(F.array(F.struct("ph", F.col("ts").alias("at"), F.lit(0.0).alias("k"))))
    out = e.select(name, "pid", "tid", "name", "ord", F.explode(both).alias("x")).select(name, "pid", "tid", F.col("name"), "ord", "x.ph", "x.at", "x.k")
    return out.withColumn("rank", F.when(F.col("ph") == "E", 0).otherwise(1))


def chrome_calls(events: DataFrame, name: str = "profile") -> DataFrame:
    """win.chrome_pairs over trace events, in seconds."""
    pairs = islands.paired(events, [name, "pid", "tid"], ["at", "rank", "k", "ord"], F.col("ph") == "B", "name", "at")
    return pairs.withColumns({"start": F.col("start") / 1e6, "end": F.col("end") / 1e6})


def heartbeats(spark: SparkSession, path: str) -> DataFrame:
    """src.heartbeat: (file, t_ns, line) of tick logs; the meta line goes."""
    return spark.read.schema("t_ns bigint, line string, meta string").json(path).where("t_ns IS NOT NULL").select(F.input_file_name().alias("file"), "t_ns", "line")


def sarif(docs: DataFrame, text: str = "value") -> DataFrame:
    """src.sarif: one row per result and location; the level falls back to the rule's default, then to warning."""
    loc = "struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int>>>"
    kind = f"runs array<struct<tool: struct<driver: struct<name: string, rules: array<struct<id: string, defaultConfiguration: struct<level: string>>>>>, results: array<struct<ruleId: string, level: string, message: struct<text: string>, locations: array<{loc}>>>>>"
    r = docs.select(F.explode(F.from_json(text, kind)["runs"]).alias("r")).select(F.col("r.tool.driver.name").alias("tool"), F.col("r.tool.driver.rules").alias("rules"), F.explode("r.results").alias("x"))
    r = r.select("tool", "rules", "x", F.explode("x.locations").alias("l"))
    default = F.get(F.filter("rules", lambda q: q["id"] == F.col("x.ruleId")), F.lit(0))["defaultConfiguration"]["level"]
    from ..functions.text import uri_path

    return r.select("tool", F.col("x.ruleId").alias("rule"), F.coalesce("x.level", default, F.lit("warning")).alias("level"), F.col("x.message.text").alias("message"), uri_path(F.col("l.physicalLocation.artifactLocation.uri")).alias("file"), F.col("l.physicalLocation.region.startLine").alias("line"))


def junit(docs: DataFrame, text: str = "value") -> DataFrame:
    """src.junit: one row per test case of JUnit documents, with the evidence lines that it printed."""
    case = "_classname string, _name string, _time double, failure struct<_message: string, _VALUE: string>, error struct<_message: string, _VALUE: string>, skipped struct<_message: string>, `system-out` string"
    parts = docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?s)(<testcase\b(?:[^>]*/>|.*?</testcase>))"), 1)).alias("x"))
    c = parts.select(F.from_xml("x", case, {"rowTag": "testcase"}).alias("c"), "x")
    outcome = F.when(F.col("x").rlike("<failure"), "failed").when(F.col("x").rlike("<error"), "error").when(F.col("x").rlike("<skipped"), "skipped").otherwise("passed")
    return c.select(F.col("c._classname").alias("file"), F.col("c._name").alias("test"), outcome.alias("outcome"), F.col("c._time").alias("time_s"), F.coalesce("c.failure._message", "c.error._message", "c.skipped._message").alias("message"), F.regexp_extract_all(F.coalesce("c.system-out", F.lit("")), F.lit(r"@@evidence (\{[^\n]*\})"), 1).alias("evidence"))


def verdicts(spark: SparkSession, path: str) -> DataFrame:
    """src.verdicts: a JSON object or list of verdicts."""
    return spark.read.option("multiLine", "true").json(path)


def sqlite_calls(files: DataFrame) -> DataFrame:
    """src.sqlite: the activations of trace stores given as binary files; a store that cannot be read gives none."""
    schema = "pid bigint, id bigint, parent bigint, thread bigint, file string, line int, qualname string, is_coro boolean, start double, dur double, self_dur double, slices int, max_self_slice double, shapes map<string,double>"
    names = [p.split()[0] for p in schema.replace("map<string,double>", "map").split(", ")]

    def run(batches):
        import pandas as pd

        for df in batches:
            rows = []
            for body in df["content"]:
                f = tempfile.NamedTemporaryFile(suffix=".db", delete=False)  # noqa: SIM115  sqlite opens it by name
                try:
                    f.write(bytes(body))
                    f.close()
                    db = sqlite3.connect(f"file:{f.name}?mode=ro", uri=True)
                    pid = int((db.execute("select value from meta where key = 'pid'").fetchone() or ["0"])[0])
                    have = [r[1] for r in db.execute("pragma table_info(calls)")]
                    for r in db.execute("select * from calls"):
                        d = dict(zip(have, r))
                        d["shapes"] = {k: float(v) for k, v in json.loads(d.get("shapes") or "{}").items()}
                        d["is_coro"] = bool(d.get("is_coro"))
                        rows.append(tuple(pid if n == "pid" else d.get(n) for n in names))
                    db.close()
                except sqlite3.Error:
                    continue
                finally:
                    os.unlink(f.name)
            yield pd.DataFrame(rows, columns=names)

    return files.select("content").mapInPandas(run, schema)


def scip_occurrences(files: DataFrame) -> DataFrame:
    """src.scip, src.protowire: (path, line0, symbol, roles) of SCIP indexes given as binary files."""
    from .otlp import packed, wire_fields

    def run(batches):
        import pandas as pd

        for df in batches:
            rows = []
            for body in df["content"]:
                for n, _, doc in wire_fields(bytes(body)):
                    if n != 2:
                        continue
                    path, found = "", []
                    for m, _, v in wire_fields(doc):
                        if m == 1:
                            path = v.decode("utf-8", "replace")
                        elif m == 2:
                            line, symbol, roles = 0, "", 0
                            for k, kind, x in wire_fields(v):
                                if k == 1:
                                    line = (packed(x) if kind == 2 else [x])[0]
                                elif k == 2:
                                    symbol = x.decode("utf-8", "replace")
                                elif k == 3:
                                    roles = x
                            found.append((line, symbol, roles))
                    rows += [(path, *f) for f in found]
            yield pd.DataFrame(rows, columns=["path", "line0", "symbol", "roles"])

    return files.select("content").mapInPandas(run, "path string, line0 int, symbol string, roles int")


def bind_definitions(occurrences: DataFrame, functions: DataFrame) -> DataFrame:
    """join.scip_defs: a definition inside a function's range goes to the function that starts nearest above it."""
    d = occurrences.where("roles % 2 = 1").select(F.col("path").alias("file"), (F.col("line0") + 1).alias("at"), "symbol")
    hit = d.join(functions.select("file", "id", "line", "end_line"), "file").where("line <= at AND at <= end_line")
    return hit.groupBy("symbol").agg(F.min_by("id", F.col("at") - F.col("line")).alias("id"))


def bind_references(occurrences: DataFrame, bound: DataFrame) -> DataFrame:
    """join.scip_refs: the functions that a site refers to."""
    refs = occurrences.where("roles % 2 = 0").join(bound, "symbol")
    return refs.groupBy(F.col("path").alias("file"), (F.col("line0") + 1).alias("line")).agg(F.sort_array(F.collect_set("id")).alias("targets"))
