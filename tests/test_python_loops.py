"""Loops of Python files with all their attributes."""

from pyspark.sql import functions as F

from tracewell.sources import python_loops

SOURCE = '''
import time
LIMIT = 4
HOSTS = ("a", "b")

def retry(get):
    for attempt in range(LIMIT):
        try:
            return get()
        except OSError:
            time.sleep(2 ** attempt)

def hot(get):
    while True:
        try:
            get()
        except OSError:
            continue
        time.sleep(0.5)

def plain(xs):
    for x in xs:
        total = x + 1
    for host in HOSTS:
        ping(host)

def bounded(get, deadline):
    n = 0
    while n <= 6:
        n += 1
    while not get():
        if time.monotonic() > deadline or tries >= LIMIT:
            break
        def inner():
            return 1
'''


def test_loop_info(spark):
    files = spark.createDataFrame([("a.py", bytearray(SOURCE, "utf-8")), ("bad.py", bytearray(b"def (")), ("none.py", bytearray(b""))], "path string, content binary")
    rows = python_loops.loop_info(files).orderBy("file", "line").collect()
    flags = ["handles_errors", "exponential", "exits", "retryish", "policy_bound", "hot_error_path", "fixed", "wall_bound"]
    got = [(r.line, r.end_line, r.kind, r.bound, r.sleep_s, {f for f in flags if r[f]}) for r in rows if r.error is None]
    assert got == [
        (7, 11, "counted", 4, 0.0, {"handles_errors", "exponential", "exits", "retryish", "fixed"}),
        (14, 19, "forever", None, 0.5, {"handles_errors", "hot_error_path"}),
        (22, 23, "collection", None, None, set()),
        (24, 25, "collection", None, None, {"fixed"}),
        (29, 30, "conditional", 7, None, set()),
        (31, 35, "conditional", None, None, {"exits", "retryish", "policy_bound", "wall_bound"}),
    ]
    assert [(r.file, r.kind) for r in rows if r.error] == [("bad.py", None)]
    assert python_loops.loop_info(files.where(F.lit(False))).count() == 0
