"""Files in wire formats as a Spark data source: SCIP indexes and OpenTelemetry export requests; src.scip, src.otlp_pb, src.otlp_file.

`spark.read.format("wire_files").option("relation", "occurrences").load(folder)` deals the files to partitions by their bytes, each relation has its
schema, and a file that cannot be read gives a row that names it and says why, in the same scan, after the rows before the fault.
An index is read document by document, so that its size does not matter. Written rows (path, content) become files, each under its name
only when it is whole. The folder must be one that all executors see under the same path.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from . import otlp

NAME = "wire_files"
#: Bytes of files that a partition takes; a larger file has one of its own.
PART_BYTES = 64 << 20
RELATIONS = {"occurrences": "file string, line0 int, symbol string, roles int", "spans": otlp.SPAN}


def _messages(f: BinaryIO, number: int) -> Iterator[bytes]:
    """The length-delimited fields of that number of the message that a file is; one is held at a time."""

    def varint() -> int | None:
        value = shift = 0
        while b := f.read(1):
            value |= (b[0] & 127) << shift
            if b[0] < 128:
                return value
            shift += 7
        if shift:
            raise ValueError("a number is cut off")
        return None

    def exactly(size: int) -> bytes:
        data = f.read(size)
        if len(data) < size:
            raise ValueError(f"{size - len(data)} bytes are missing at the end")
        return data

    while (key := varint()) is not None:
        kind = key & 7
        if kind == 0:
            varint()
        elif kind in (1, 5):
            exactly(8 if kind == 1 else 4)
        elif kind == 2:
            data = exactly(varint() or 0)
            if key >> 3 == number:
                yield data
        else:
            raise ValueError(f"bad wire type {kind} at {f.tell()}")


def _occurrences(path: str) -> Iterator[tuple]:
    with open(path, "rb") as f:
        for doc in _messages(f, 2):
            fields = list(otlp.wire_fields(doc))
            file = next((v.decode("utf-8", "replace") for n, _, v in fields if n == 1), "")
            for n, _, v in fields:
                if n != 2:
                    continue
                line, symbol, roles = 0, "", 0
                for k, kind, x in otlp.wire_fields(v):
                    if k == 1:
                        line = (otlp.packed(x) or [0])[0] if kind == 2 else line
                    elif k == 2:
                        symbol = x.decode("utf-8", "replace")
                    elif k == 3:
                        roles = x
                yield file, line, symbol, roles


def _spans(path: str) -> Iterator[tuple]:
    with open(path, "rb") as f:
        body = f.read()  # one export request
    yield from map(otlp.row, otlp.load_body(body))


READERS = {"occurrences": _occurrences, "spans": _spans}


@dataclass
class Part(InputPartition):
    paths: list[str]


class _Reader(DataSourceReader):
    def __init__(self, folder: str, relation: str, part_bytes: int):
        self.folder, self.relation, self.part_bytes = folder.removeprefix("file:"), relation, part_bytes

    def partitions(self) -> list[Part]:
        if os.path.isfile(self.folder):
            return [Part([self.folder])]
        parts, room = [Part([])], self.part_bytes
        for at, _, names in sorted(os.walk(self.folder)):
            for name in sorted(names):
                if name.startswith((".", "_")):
                    continue
                size = os.path.getsize(os.path.join(at, name))
                if size > room and parts[-1].paths:
                    parts.append(Part([]))
                    room = self.part_bytes
                parts[-1].paths.append(os.path.join(at, name))
                room -= size
        return parts

    def read(self, partition: Part) -> Iterator[tuple]:
        nothing = (None,) * len(RELATIONS[self.relation].split(", "))
        for path in partition.paths:
            try:
                for values in READERS[self.relation](path):
                    yield (path, *values, None)
            except (ValueError, KeyError, IndexError, TypeError, AttributeError, OSError, EOFError, struct.error) as e:
                yield (path, *nothing, f"{type(e).__name__}: {e}")


class _Writer(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = os.path.normpath(folder.removeprefix("file:"))

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        for r in iterator:
            path = os.path.normpath(os.path.join(self.folder, r.path))
            if not path.startswith(self.folder + os.sep):
                raise ValueError(f"{r.path} leads out of the folder")
            os.makedirs(os.path.dirname(path), exist_ok=True)
            part = os.path.join(os.path.dirname(path), f".{uuid.uuid4().hex}")
            with open(part, "wb") as f:
                f.write(r.content)
            # an attempt that comes again puts the same file in its place
            os.replace(part, path)
        return WriterCommitMessage()


class WireFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _relation(self) -> str:
        relation = self.options.get("relation", "spans")
        if relation not in RELATIONS:
            raise ValueError(f"relation must be one of {', '.join(RELATIONS)}")
        return relation

    def schema(self) -> str:
        return f"path string, {RELATIONS[self._relation()]}, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._relation(), int(self.options.get("part_bytes", PART_BYTES)))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def wire_files(spark: SparkSession, folder: str, relation: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """path, the columns of the relation (`occurrences` of SCIP indexes, `spans` of export requests in protobuf, JSON, lines or gzip) and error.

    Error is null but for a file that cannot be read. An empty folder and an empty file give no row; files whose name begins with a dot or an underscore are not read.
    """
    spark.dataSource.register(WireFiles)
    return spark.read.format(NAME).option("relation", relation).option("part_bytes", part_bytes).load(folder)


def write_files(files: DataFrame, folder: str) -> None:
    """Rows (path, content) as files below the folder; of rows with the same path one stays."""
    files.sparkSession.dataSource.register(WireFiles)
    files.select("path", "content").write.format(NAME).mode("append").save(folder)
