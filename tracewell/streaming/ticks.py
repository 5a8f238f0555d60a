"""Heartbeats and spans as streams.

The recordings accumulate in a folder. The batch form reads it again; this form follows it. Watermarks are this engine's own design: a tick later than the
watermark is dropped by the session aggregation, as Structured Streaming has it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TICK = "log string, at timestamp, line string"


def read_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """Tick lines of JSON files as they arrive."""
    return spark.readStream.schema(TICK).json(folder)


def sessions(ticks: DataFrame, gap: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """win.presence_runs on a stream: runs of ticks without a gap."""
    w = F.session_window("at", gap)
    return ticks.withWatermark("at", late).groupBy("log", w).agg(F.count("*").alias("ticks")).select("log", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "ticks")


def stalls(ticks: DataFrame, threshold_s: float, late: str = "1 minute") -> DataFrame:
    """win.heartbeat_gaps on a stream: one row when a log's next tick comes later than the threshold; the state is one time per log."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches, state: GroupState):
        import pandas as pd

        last = state.get[0] if state.exists else None
        rows = []
        for df in batches:
            for t in sorted(df["at"].astype("int64") // (1000 if df["at"].dtype == "datetime64[ns]" else 1)):
                if last is not None and t - last >= threshold_s * 1e6:
                    rows.append((key[0], last, int(t)))
                last = int(t) if last is None else max(last, int(t))
        state.update((last,))
        yield pd.DataFrame(rows, columns=["log", "w0_us", "w1_us"])

    return ticks.withWatermark("at", late).groupBy("log").applyInPandasWithState(step, "log string, w0_us long, w1_us long", "last long", "append", GroupStateTimeout.NoTimeout)
