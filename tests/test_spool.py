"""Spans in a spool directory: parents that come later, restarts, files that cannot be read."""

import json
import os

from tracewell.streaming import spool


def request(*spans):
    rows = [{"traceId": t, "spanId": s, "parentSpanId": p, "name": f"n{s}", "startTimeUnixNano": str(a), "endTimeUnixNano": str(a + 5)} for t, s, p, a in spans]
    return json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": rows}]}]})


def put(folder, name, at, text):
    with open(folder / f".{name}", "w") as f:
        f.write(text)
    os.utime(folder / f".{name}", (at, at))
    os.rename(folder / f".{name}", folder / name)


def test_parents_that_come_later(spark, tmp_path):
    t, ids = "ab" * 16, [f"{k:016x}" for k in range(9)]
    src, began = tmp_path / "spool", 1_700_000_000
    src.mkdir()

    def after():
        spool.follow(spark, str(src), str(tmp_path / "out"), str(tmp_path / "state"), wait_s=30, late_s=5)
        return sorted((r.trace_id[0], r.span_id[-1], r.parent_name and r.parent_name[-1], r.parent_start_ns, r.state) for r in spark.read.schema(spool.PARENTED).parquet(str(tmp_path / "out")).collect())

    put(src, "a.json", began, request((t, ids[2], ids[1], 20), (t, ids[3], ids[1], 30), (t, ids[5], ids[8], 1)))
    put(src, "bad.json", began, "{oops")
    assert after() == []
    put(src, "b.json", began + 10, request((t, ids[1], "", 10), ("cd" * 16, ids[1], "", 11)))
    first = [("a", "1", None, None, "root"), ("a", "2", "1", 10, "matched"), ("a", "3", "1", 10, "matched"), ("c", "1", None, None, "root")]
    assert after() == first
    # nothing new: nothing is written again
    assert after() == first
    put(src, "c.json", began + 20, request((t, ids[6], ids[1], 50)))
    first = sorted([*first, ("a", "6", "1", 10, "matched")])
    assert after() == first
    put(src, "d.json", began + 100, request((t, ids[4], "", 40)))
    assert after() == sorted([*first, ("a", "4", None, None, "root"), ("a", "5", None, None, "orphan")])
    assert spark.conf.get(spool.PROVIDER, None) != spool.ROCKS
