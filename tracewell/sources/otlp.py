"""OpenTelemetry spans: JSON documents and lines, protobuf bodies, gzip; src.otlp_*, src.spans_jsonl, proj.io_info."""

from __future__ import annotations

import base64
import gzip
import json
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = "trace_id string, span_id string, parent_id string, name string, kind int, start_ns bigint, end_ns bigint, attrs map<string,string>, status int"
_NAMES = [c.split(" ")[0] for c in SPAN.replace("map<string,string>", "map").split(", ")]
# Fixed values of the format: span kinds and status codes by name.
KINDS = ["SPAN_KIND_UNSPECIFIED", "SPAN_KIND_INTERNAL", "SPAN_KIND_SERVER", "SPAN_KIND_CLIENT", "SPAN_KIND_PRODUCER", "SPAN_KIND_CONSUMER"]
STATUS = ["STATUS_CODE_UNSET", "STATUS_CODE_OK", "STATUS_CODE_ERROR"]
#: Spans that a worker passes on at once, however many the files of an Arrow batch hold.
BATCH_SPANS = 4_096


def wire_fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(field number, wire type, value) of a protobuf message: varints as integers, the other kinds as bytes."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < end:
        key = varint()
        number, kind = key >> 3, key & 7
        if kind == 0:
            yield number, kind, varint()
        else:
            size = {1: 8, 5: 4}.get(kind)
            if kind == 2:
                size = varint()
            if size is None or at + size > end:
                raise ValueError(f"bad wire type {kind} at {at}")
            yield number, kind, data[at : at + size]
            at += size


def signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def packed(data: bytes) -> list[int]:
    """Packed varints."""
    out, value, shift = [], 0, 0
    for b in data:
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(value)
            value = shift = 0
    return out


def _wire_value(data: bytes):
    for n, kind, v in wire_fields(data):
        if n == 1:
            return v.decode("utf-8", "replace")
        if n == 2:
            return bool(v)
        if n == 3:
            return signed(v)
        if n == 4:
            return struct.unpack("<d", v)[0]
        if n == 5:
            return [_wire_value(x) for m, _, x in wire_fields(v) if m == 1]
        if n == 6:
            return dict(_wire_pair(x) for m, _, x in wire_fields(v) if m == 1)
        if n == 7:
            return base64.b64encode(v).decode()
    return None


def _wire_pair(data: bytes) -> tuple[str, object]:
    key, value = "", None
    for n, _, v in wire_fields(data):
        if n == 1:
            key = v.decode("utf-8", "replace")
        elif n == 2:
            value = _wire_value(v)
    return key, value


def decode_protobuf(body: bytes) -> list[dict]:
    """src.otlp_pb: the spans of an export request."""
    out = []
    for n, _, resource in wire_fields(body):
        for m, _, scope in wire_fields(resource) if n == 1 else ():
            for k, _, span in wire_fields(scope) if m == 2 else ():
                if k != 2:
                    continue
                s: dict = {"trace_id": "", "span_id": "", "parent_id": "", "name": "", "kind": 0, "start_ns": 0, "end_ns": 0, "attrs": {}, "status": 0}
                for f, _, v in wire_fields(span):
                    if f in (1, 2, 4):
                        s[{1: "trace_id", 2: "span_id", 4: "parent_id"}[f]] = v.hex()
                    elif f == 5:
                        s["name"] = v.decode("utf-8", "replace")
                    elif f == 6:
                        s["kind"] = v
                    elif f in (7, 8):
                        s["start_ns" if f == 7 else "end_ns"] = struct.unpack("<Q", v)[0]
                    elif f == 9:
                        key, value = _wire_pair(v)
                        s["attrs"][key] = value
                    elif f == 15:
                        s["status"] = next((x for g, _, x in wire_fields(v) if g == 3), 0)
                out.append(s)
    return out


def _json_value(v: dict):
    """fn.any_value, in JSON."""
    for key, value in v.items():
        k = key.replace("_v", "V")
        if k == "intValue":
            return int(value)
        if k == "arrayValue":
            return [_json_value(x) for x in value.get("values", [])]
        if k == "kvlistValue":
            return {p["key"]: _json_value(p.get("value", {})) for p in value.get("values", [])}
        return value
    return None


def _id(v: str | None) -> str:
    if not v:
        return ""
    if len(v) in (16, 32) and all(c in "0123456789abcdefABCDEF" for c in v):
        return v.lower()
    return base64.b64decode(v).hex()


def decode_json(doc: dict) -> list[dict]:
    """src.otlp_json: camel and snake case keys, kinds and states by name or number."""
    get = lambda d, *names, default=None: next((d[n] for n in names if n in d), default)
    number = lambda v, names: names.index(v) if v in names else int(v or 0)
    out = []
    for r in get(doc, "resourceSpans", "resource_spans", default=[]):
        for scope in get(r, "scopeSpans", "scope_spans", default=[]):
            for s in scope.get("spans", []):
                out.append(
                    {
                        "trace_id": _id(get(s, "traceId", "trace_id")),
                        "span_id": _id(get(s, "spanId", "span_id")),
                        "parent_id": _id(get(s, "parentSpanId", "parent_span_id")),
                        "name": s.get("name", ""),
                        "kind": number(s.get("kind"), KINDS),
                        "start_ns": int(get(s, "startTimeUnixNano", "start_time_unix_nano", default=0)),
                        "end_ns": int(get(s, "endTimeUnixNano", "end_time_unix_nano", default=0)),
                        "attrs": {a["key"]: _json_value(a.get("value", {})) for a in s.get("attributes", [])},
                        "status": number((s.get("status") or {}).get("code"), STATUS),
                    }
                )
    return out


def load_body(data: bytes) -> list[dict]:
    """src.otlp_file: gzip, one JSON document, JSON lines or protobuf, told apart by content."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    head = data.lstrip()[:1]
    if head != b"{":
        return decode_protobuf(data)
    try:
        return decode_json(json.loads(data))
    except ValueError:
        return [s for part in data.splitlines() if part.strip() for s in decode_json(json.loads(part))]


def row(s: dict) -> tuple:
    """A span in the order of SPAN."""
    text = lambda v: v if isinstance(v, str) else json.dumps(v)
    return (s["trace_id"], s["span_id"], s["parent_id"], s["name"], s["kind"], s["start_ns"], s["end_ns"], {k: text(v) for k, v in s["attrs"].items()}, s["status"])


def bodies(files: DataFrame, at: str | None = None) -> DataFrame:
    """src.otlp_file, src.parse_error_isolation: path, the spans' columns and error of binary files (path, content), a stream of them too.

    A file that cannot be read is one row with its error. `at` names a column of times of the files that each row keeps.
    """
    kept = [at] if at else []
    whole = ("kind", "start_ns", "end_ns", "status")

    def table(pd, rows):
        out = pd.DataFrame(rows, columns=["path", *_NAMES, "error", *kept])
        return pd.DataFrame({c: out[c].astype("Int64") if c in whole else out[c] if c in kept else out[c].astype(object) for c in out})

    def run(batches):
        import pandas as pd

        for df in batches:
            rows = []
            for path, body, *time in zip(df["path"], df["content"], *(df[c] for c in kept)):
                try:
                    rows += [(path, *row(s), None, *time) for s in load_body(bytes(body))]
                except (ValueError, KeyError, IndexError, TypeError, AttributeError, OSError, EOFError, struct.error) as e:
                    rows.append((path, None, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}", *time))
                while len(rows) >= BATCH_SPANS:
                    yield table(pd, rows[:BATCH_SPANS])
                    del rows[:BATCH_SPANS]
            yield table(pd, rows)

    return files.select("path", "content", *kept).mapInPandas(run, f"path string, {SPAN}, error string" + (f", {at} timestamp" if at else ""))


def spans(files: DataFrame) -> DataFrame:
    """Spans of binary files (path, content); a file that cannot be read gives no span. Use bodies for those."""
    return bodies(files).where("error IS NULL").drop("path", "error")


def parse_errors(files: DataFrame, reader=load_body) -> DataFrame:
    """src.parse_error_isolation: (path, error) of files that a reader refuses."""

    def run(batches):
        import pandas as pd

        for df in batches:
            rows = []
            for path, body in zip(df["path"], df["content"]):
                try:
                    reader(bytes(body))
                except Exception as e:  # noqa: BLE001  a reader may refuse a file in any way
                    rows.append((path, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, error string")


def spans_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """src.spans_jsonl: raw span lines; the optional first line with meta goes."""
    return spark.read.schema(SPAN + ", meta string").json(path).where("meta IS NULL").drop("meta")


def write_spans_jsonl(df: DataFrame, path: str) -> None:
    """sink.spans_jsonl"""
    df.write.json(path)


def io_info(df: DataFrame) -> DataFrame:
    """proj.io_info: (system, target) of outbound spans by the precedence http, db, rpc, messaging, other."""
    a = lambda *names: F.coalesce(*[F.try_element_at("attrs", F.lit(n)) for n in names])
    forms = [("http", a("http.url", "url.full", "http.target", "server.address")), ("db", a("db.system", "db.name", "db.statement")), ("rpc", a("rpc.service", "rpc.method")), ("messaging", a("messaging.system", "messaging.destination.name"))]
    system, target = F.when(F.col("kind") == 3, "other"), F.when(F.col("kind") == 3, F.coalesce(a("server.address", "peer.service"), F.lit("")))
    for name, value in reversed(forms):
        system, target = F.when(value.isNotNull(), name).otherwise(system), F.when(value.isNotNull(), value).otherwise(target)
    out = df.where(~F.col("kind").isin(2, 5)).withColumns({"system": system, "target": target})
    return out.where("system IS NOT NULL")
