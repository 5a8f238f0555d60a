"""Indexes and export requests as a data source, with files that cannot be read."""

import gzip
import json

import pytest

from tests.test_sources import OTLP, field, varint
from tracewell.sources import otlp, wire


def occurrence(line, symbol, roles):
    return field(2, 2, field(1, 2, varint(line) + varint(2) + varint(9)) + field(2, 2, symbol) + (field(3, 0, varint(roles)) if roles else b""))


def document(path, *occurrences):
    return field(2, 2, field(1, 2, path) + b"".join(occurrences))


def test_indexes(spark, tmp_path):
    first = document(b"a.py", occurrence(4, b"pkg f().", 1), occurrence(700, b"pkg g().", 0))
    files = [
        ("deep/one.scip", field(1, 2, b"metadata") + first + document(b"b.py")),
        ("cut.scip", first + document(b"c.py", occurrence(1, b"x", 1))[:-3]),
        ("noise.scip", b"\xff\xff\xff"),
        ("empty.scip", b""),
        (".hidden", first),
    ]
    wire.write_files(spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary"), str(tmp_path))
    rows = wire.wire_files(spark, str(tmp_path), "occurrences", part_bytes=40).collect()
    want = [("a.py", 4, "pkg f().", 1), ("a.py", 700, "pkg g().", 0)]
    of = lambda name: [r for r in rows if r.path.endswith(name)]
    assert [tuple(r[1:5]) for r in of("one.scip")] == want and all(r.error is None for r in of("one.scip"))
    # what is whole before the fault counts, and the fault has its row
    assert [tuple(r[1:5]) for r in of("cut.scip")[:-1]] == want and "missing" in of("cut.scip")[-1].error and of("cut.scip")[-1].file is None
    (noise,) = of("noise.scip")
    assert noise.error and noise.symbol is None
    assert len(rows) == 6
    assert wire.wire_files(spark, str(tmp_path / "none"), "occurrences").count() == 0


def test_requests(spark, tmp_path):
    text = json.dumps(OTLP).encode()
    span = field(1, 2, bytes(16)) + field(2, 2, bytes(8)) + field(5, 2, b"pay")
    files = [("a.json", text), ("b.gz", gzip.compress(text)), ("c.pb", field(1, 2, field(2, 2, field(2, 2, span)))), ("d.json", b"{oops"), ("e.pb", b"\xff\xff"), ("f.gz", gzip.compress(text)[:40])]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")
    wire.write_files(df, str(tmp_path))
    # written again: the same files
    wire.write_files(df, str(tmp_path))
    rows = wire.wire_files(spark, str(tmp_path), "spans").collect()
    good, bad = [r for r in rows if r.error is None], [r for r in rows if r.error]
    assert sorted(r.name for r in good) == ["pay", "quote", "quote", "reserve", "reserve"]
    assert sorted(r.path.rsplit("/", 1)[1] for r in bad) == ["d.json", "e.pb", "f.gz"]
    assert {r.path for r in otlp.bodies(df).where("error IS NOT NULL").collect()} == {"d.json", "e.pb", "f.gz"}
    with pytest.raises(Exception, match="leads out"):
        wire.write_files(spark.createDataFrame([("../x", bytearray(b"1"))], "path string, content binary"), str(tmp_path))
