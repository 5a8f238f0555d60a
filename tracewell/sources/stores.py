"""Trace stores (SQLite files) as a Spark data source: src.sqlite and its sink.

`spark.read.format("trace_store").option("relation", "calls").load(folder)` has one partition per store, `meta`, `calls` and
`stalls` have a schema each, and a store that cannot be read gives a row that names it and says why, in the same scan. Written rows
(pid, relation, row as a JSON list) become a store per pid and task, under its final name only when it is whole.
The folder must be one that all executors see under the same path.
"""

from __future__ import annotations

import json
import os
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

NAME = "trace_store"
#: Names the stores of a folder that were written here; a folder without it is taken as it is.
LIST = "_STORES"
#: Rows that are read or written at once.
ROWS = 5_000
# The tables of a store and their columns.
TABLES = {
    "meta": "key, value",
    "calls": "id, parent, thread, file, line, qualname, is_coro, start, dur, self_dur, slices, max_self_slice, shapes",
    "stalls": "call_id, file, line, qualname, dur, at, stack",
}
_TYPES = {
    "meta": "key string, value string",
    "calls": "id bigint, parent bigint, thread bigint, file string, line int, qualname string, is_coro boolean, start double, dur double, self_dur double, slices int, max_self_slice double, shapes map<string,double>",
    "stalls": "call_id bigint, file string, line int, qualname string, dur double, at double, stack array<struct<file:string,line:int,qualname:string>>",
}


def _value(column: str, x):
    if column == "shapes":
        return {k: float(v) for k, v in json.loads(x or "{}").items()}
    if column == "stack":
        return [(file, int(line), name) for file, line, name in json.loads(x or "[]")]
    return bool(x) if column == "is_coro" else x


@dataclass
class Store(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, folder: str, relation: str):
        self.folder, self.relation = folder.removeprefix("file:"), relation

    def partitions(self) -> list[Store]:
        if os.path.isfile(self.folder):
            return [Store(self.folder)]
        found = []
        for at, _, names in sorted(os.walk(self.folder)):
            listed = set(names)
            if LIST in names:
                with open(os.path.join(at, LIST)) as f:
                    listed = set(f.read().split("\n"))
            found += [Store(os.path.join(at, f)) for f in sorted(listed) if f.endswith(".db")]
        return found or [Store("")]

    def read(self, partition: Store) -> Iterator[tuple]:
        if not partition.path:
            return
        columns = TABLES[self.relation].split(", ")
        empty = (None,) * len(columns)
        try:
            db = sqlite3.connect(f"file:{partition.path}?mode=ro", uri=True)
            try:
                found = db.execute("select value from meta where key = 'pid'").fetchone()
                pid = int(found[0]) if found else 0
                have = {r[1] for r in db.execute(f"pragma table_info({self.relation})")}
                # an older store may lack a column
                for row in db.execute("select " + ", ".join(c if c in have else "null" for c in columns) + f" from {self.relation}"):
                    yield (partition.path, pid, *map(_value, columns, row), None)
            finally:
                db.close()
        except (sqlite3.Error, ValueError, TypeError, AttributeError) as e:
            yield (partition.path, None, *empty, f"{type(e).__name__}: {e}")


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder.removeprefix("file:")

    def write(self, iterator: Iterator) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        open_: dict[int, tuple[sqlite3.Connection, str]] = {}
        try:
            while rows := list(islice(iterator, ROWS)):
                for pid in {r.pid for r in rows} - set(open_):
                    path = os.path.join(self.folder, f"{pid}-{uuid.uuid4().hex}.db.part")
                    db = sqlite3.connect(path, isolation_level=None)
                    open_[pid] = db, path
                    db.execute("begin")
                    for table, columns in TABLES.items():
                        db.execute(f"create table {table} ({columns})")
                    db.execute("insert into meta values ('pid', ?)", (str(pid),))
                for r in rows:
                    db, values = open_[r.pid][0], json.loads(r.row)
                    db.execute(f"insert into {r.relation} values ({', '.join('?' * len(TABLES[r.relation].split(', ')))})", [json.dumps(v) if isinstance(v, (list, dict)) else v for v in values])
            done = []
            for db, path in open_.values():
                db.execute("commit")
                db.close()
                os.rename(path, path.removesuffix(".part"))
                done.append(path.removesuffix(".part"))
            return Written(done)
        except BaseException:
            for db, path in open_.values():
                db.close()
                if os.path.exists(path):
                    os.unlink(path)
            raise

    def commit(self, messages: list[Written | None]) -> None:
        """The folder's list of the stores that count: an attempt that was lost after its last rename is not on it."""
        with open(os.path.join(self.folder, LIST), "a") as f:
            f.writelines(f"{os.path.basename(p)}\n" for m in messages if m for p in m.paths)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for p in m.paths if m else ():
                if os.path.exists(p):
                    os.unlink(p)


class TraceStores(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _relation(self) -> str:
        relation = self.options.get("relation", "calls")
        if relation not in TABLES:
            raise ValueError(f"relation must be one of {', '.join(TABLES)}")
        return relation

    def schema(self) -> str:
        return f"store string, pid bigint, {_TYPES[self._relation()]}, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._relation())

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def stores(spark: SparkSession, folder: str, relation: str = "calls") -> DataFrame:
    """src.sqlite: store, pid, the columns of the relation (`meta`, `calls` or `stalls`) and error, null but for a store that cannot be read.

    An empty folder gives no row; a column that a store lacks is null.
    """
    spark.dataSource.register(TraceStores)
    return spark.read.format(NAME).option("relation", relation).load(folder)


def write_stores(rows: DataFrame, folder: str) -> None:
    """sink.sqlite: rows (pid, relation, row as a JSON list of the relation's values) as one store per pid, or more where a pid's rows are in several tasks."""
    rows.sparkSession.dataSource.register(TraceStores)
    rows.select("pid", "relation", "row").write.format(NAME).mode("append").save(folder)
