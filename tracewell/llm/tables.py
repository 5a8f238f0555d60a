"""Reading of the corpus tables and the few helpers that every operator shares."""

from __future__ import annotations

import ctypes
import re
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where all run in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[[^,]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="tracewell-")
    return where


def gathered(df: DataFrame, n: int, most: int) -> DataFrame:
    """df in no more parts than n units of work at `most` a part ask for: tiny parts are put together, large tables stay as they are."""
    return df.coalesce(n // most + 1)


def cut(df: DataFrame, rows: int | None = None, most: int = 100_000) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the folder that the cluster names.

    `rows` is a bound on df's rows, where one is known: each part is a file, so a small table is written in few.
    """
    spark = df.sparkSession
    df = df if rows is None else gathered(df, rows, most)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


#: Bytes of one Arrow batch on its way to a worker.
BATCH_BYTES = 4 << 20


def lean(df: DataFrame) -> DataFrame:
    """df; its session sends Arrow batches of a bounded number of bytes from now on, however long the texts are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = df.sparkSession.conf.get(key, None)
    if have is None or not have.isdigit() or int(have) > BATCH_BYTES:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


def small(batches, rows: int = 512):
    """Arrow batches cut to `rows` rows, so that a worker holds few texts as Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def spare() -> None:
    """Gives freed memory back to the system: a worker outlives its task, and what its allocators keep adds to the next stage's need."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the C library's own, where it has one
        trim(0)


def fold(key: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id falls into fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % n, F.lit(0))


def text_bytes(df: DataFrame, text: str = "text") -> int:
    return int(df.select(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0)


def without(df: DataFrame, names: list[str]) -> list[str]:
    """Columns of df that an operator passes on: those it does not itself return."""
    drop = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in drop]


def named(name: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or that with underscores after it, so that no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def beside(docs: DataFrame, outs: list[str], text: str, only: list[str] | None = None, extra: tuple[Column, ...] = ()) -> tuple[DataFrame, int, int]:
    """(rows for an Arrow function, position of the text, number of leading columns to pass on).

    The leading columns are those of docs (or those in `only`) that are no output, then `extra`. The text travels
    once: among them, or behind them where it is not passed on.
    """
    keep = [c for c in without(docs, outs) if only is None or c in only]
    at = keep.index(text) if text in keep else len(keep) + len(extra)
    own = [] if text in keep else [named(text).alias(fresh(docs, "text_"))]
    return lean(docs.select(*map(named, keep), *extra, *own)), at, len(keep) + len(extra)
