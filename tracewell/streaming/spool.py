"""Export requests that arrive in a spool directory, as a stream; spans meet their parents whichever comes first.

This is the engine's side of src.otlp_receiver: whatever takes requests from the network puts each into the directory as a file, under
its name when it is whole. The directory must be one that all executors see.

A span is sent twice, under its own id and under its parent's, so that a key holds one parent and those who wait for it, however
many spans a trace has. Time is the time at which a file arrived (its modification time), not that of its spans, so a span is not lost for
being old: a child whose parent does not come in time is given out as an orphan.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources import otlp

if TYPE_CHECKING:
    import pandas as pd

FILE = "path string, modificationTime timestamp, length bigint, content binary"
PARENTED = "trace_id string, span_id string, name string, start_ns bigint, end_ns bigint, parent_id string, parent_name string, parent_start_ns bigint, state string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_CHILD = ["span_id", "name", "start_ns", "end_ns"]


def read_spool(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """src.otlp_receiver: path, spans, error and modificationTime, file by file as they arrive; a request that cannot be read is a row with its error and stops nothing."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return otlp.bodies(files, "modificationTime")


class _Meeting(StatefulProcessor):
    """State of a key: its span, once that came, and the children that wait for it."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.own = handle.getValueState("own", "name string, start_ns bigint")
        self.waiting = handle.getListState("waiting", "span_id string, name string, start_ns bigint, end_ns bigint")

    def _out(self, key: tuple, children: list[tuple], own: tuple | None, state: str) -> pd.DataFrame:
        import pandas as pd

        name, start = own or (None, None)
        out = pd.DataFrame([(key[0], *c, key[1], name, start, state) for c in children], columns=["trace_id", *_CHILD, "parent_id", "parent_name", "parent_start_ns", "state"])
        return out.astype({c: "Int64" for c in ("start_ns", "end_ns", "parent_start_ns")})

    def _wait(self, now: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(now + self.wait_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = 0
        own = tuple(self.own.get()) if self.own.exists() else None
        held = self.waiting.exists()
        for df in rows:
            now = max(now, int(df["arrived_ms"].max()))
            me = df[df["is_own"]]
            if len(me) and own is None:
                first = min(zip(me["start_ns"], me["name"]))
                own = (first[1], int(first[0]))
                self.own.update(own)
                self._wait(now)
                if held:
                    yield self._out(key, [tuple(c) for c in self.waiting.get()], own, "matched")
                    self.waiting.clear()
                    held = False
            top = me[me["is_root"]]
            if len(top):
                out = self._out((key[0], ""), list(zip(*(top[c] for c in _CHILD))), None, "root")
                yield out
            children = [(s, n, int(a), int(b)) for s, n, a, b in zip(*(df.loc[~df["is_own"], c] for c in _CHILD))]
            if children and own is not None:
                yield self._out(key, children, own, "matched")
            elif children:
                self.waiting.appendList(children)
                if not held:
                    self._wait(now)
                held = True

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.waiting.exists():
            yield self._out(key, [tuple(c) for c in self.waiting.get()], None, "orphan")
            self.waiting.clear()
        self.own.clear()

    def close(self) -> None:
        pass


def with_parents(spans: DataFrame, wait_s: float = 600.0, late_s: float = 60.0) -> DataFrame:
    """join.parent on a stream: every span once, as root, matched (with its parent's name and start) or orphan.

    A child waits for its parent, and a parent is remembered for children to come, until files have arrived that are more than `wait_s` and `late_s` younger. A file
    that is put into the spool with a time more than `late_s` older than one already taken is too late for the watermark, and its spans are left out.
    Of spans that share an id the earliest is the parent, among those of the first batch that has one; a span that is sent twice is given out twice. Rows of files that
    cannot be read, and null ids, are not spans. The state store must be RocksDB (see `follow`).
    """
    s = spans.withWatermark("modificationTime", f"{late_s} seconds").withColumn("arrived_ms", F.unix_millis("modificationTime"))
    s = s.where("trace_id IS NOT NULL AND span_id IS NOT NULL").withColumns({"parent_id": F.coalesce("parent_id", F.lit("")), "name": F.coalesce("name", F.lit("")), "start_ns": F.coalesce("start_ns", F.lit(0)), "end_ns": F.coalesce("end_ns", F.lit(0))})
    root = F.col("parent_id") == ""
    both = F.array(F.struct(F.col("span_id").alias("node"), F.lit(True).alias("is_own")), F.struct(F.col("parent_id").alias("node"), F.lit(False).alias("is_own")))
    sent = s.select("trace_id", *_CHILD, "modificationTime", "arrived_ms", root.alias("is_root"), F.explode(F.when(root, F.slice(both, 1, 1)).otherwise(both)).alias("x")).select("trace_id", "x.node", "x.is_own", "is_root", "modificationTime", "arrived_ms", *_CHILD)
    return sent.groupBy("trace_id", "node").transformWithStateInPandas(_Meeting(int(wait_s * 1000)), PARENTED, "append", "eventTime")


def follow(spark: SparkSession, folder: str, out: str, checkpoint: str, wait_s: float = 600.0, late_s: float = 60.0, files_per_batch: int = 1000, once: bool = True):
    """Spans with parents of a spool directory as Parquet files in `out`; started again with the same checkpoint it goes on where it was, and no row is written twice.

    `once` takes what is there and ends; without it the running query is returned.
    """
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        rows = with_parents(read_spool(spark, folder, files_per_batch), wait_s, late_s)
        writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
        query = (writer.trigger(availableNow=True) if once else writer).start()
        if once:
            query.awaitTermination()
        return query
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
