"""Ranking, budget and ledger: which finding to look at next, and what became of it."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The queue's weights, by severity, confidence and evidence.
SEVERITY_WEIGHT = {"high": 5.0, "medium": 3.0, "low": 1.0, "info": 0.5}
CONFIDENCE_WEIGHT = {"exact": 1.0, "scip": 1.0, "unique": 0.9, "heuristic": 0.8, "name": 0.5}
EVIDENCE_WEIGHT = {"confirmed": 1.5, "measured": 1.2, "not-verifiable": 1.0, "not-exercised": 1.0, "not-observed": 0.3}
RULE_WEIGHT = {
    "lock-across-await": 1.6, "lock-order-inversion": 1.6, "sql-injection": 1.5, "deadline-cannot-preempt": 1.4, "hang-reaches-entry": 1.4, "unbounded-retry": 1.3,
    "retry-amplification": 1.3, "timeout-budget-exceeded": 1.2, "io-in-loop": 0.8, "nested-loops": 0.8,
}
SEVERITY_RANK = {"high": 0, "medium": 1, "low": 2, "info": 3}
STATUS_ORDER = ["proven", "observed", "unverified", "inconclusive", "not-observed", "rejected"]
PER_ITEM, TOTAL, PER_ROUND = 8, 15, 6
#: Limits of one batch: functions, findings, characters.
BATCH_FUNCTIONS, BATCH_FINDINGS, BATCH_CHARS = 6, 24, 12_000


def lookup(c: Column, values: dict, default=None) -> Column:
    """A small fixed table as one CASE."""
    out = F.lit(default)
    for k, v in reversed(values.items()):
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def round_half(c: Column, n: int = 3) -> Column:
    """Half up; a half that binary arithmetic leaves just short of one counts as a half."""
    return F.round(c + 1e-9, n) + F.lit(0.0)


def score(severity: Column, confidence: Column, evidence: Column, rule: Column, hotspot: Column) -> Column:
    """fn.score"""
    return round_half(lookup(severity, SEVERITY_WEIGHT, 1.0) * lookup(confidence, CONFIDENCE_WEIGHT, 0.5) * evidence * rule + F.least(hotspot / 10, F.lit(1.0)))


def weighed(severity: Column, confidence: Column, evidence: Column, rule: Column, hotspot: Column) -> Column:
    """fn.score from the names: the evidence's and the rule's weights come from their tables, 1 where a name is in none."""
    return score(severity, confidence, lookup(evidence, EVIDENCE_WEIGHT, 1.0), lookup(rule, RULE_WEIGHT, 1.0), hotspot)


def penalised(s: Column, pattern: Column) -> Column:
    """Half the score for a rejected pattern, rounded a second time."""
    return F.when(pattern, round_half(s * 0.5)).otherwise(s)


def skip_reason(checks: list[tuple[str, Column]]) -> Column:
    """fn.skip_reason: the first reason that holds, in the order given."""
    out = F.lit(None).cast("string")
    for name, c in reversed(checks):
        out = F.when(c, F.lit(name)).otherwise(out)
    return out


def same_effect(items: DataFrame, keys: list[str], order: list) -> DataFrame:
    """agg.same_effect: the best item of each (rule, leaf), with the number of the others it covers."""
    w = Window.partitionBy(*keys)
    return items.withColumn("_i", F.row_number().over(w.orderBy(*order))).withColumn("covers", F.count("*").over(w) - 1).where("_i = 1").drop("_i")


def by_function(items: DataFrame, function: str, order: list, most: int = PER_ITEM) -> DataFrame:
    """agg.by_function: the best finding of a function heads an item with up to `most` findings; every further one is an item of its own.

    Riders add a quarter of their score to the head's, rounded after each.
    """
    w = Window.partitionBy(function).orderBy(*order)
    r = items.withColumn("_rn", F.row_number().over(w))
    group = r.where(F.col("_rn") <= most).groupBy(function).agg(
        F.min_by("id", "_rn").alias("id"),
        F.count("*").alias("n"),
        F.aggregate(F.array_sort(F.collect_list(F.struct("_rn", "score"))), F.lit(None).cast("double"), lambda a, x: F.when(a.isNull(), x["score"]).otherwise(round_half(a + 0.25 * x["score"]))).alias("score"),
    )
    rest = r.where(F.col("_rn") > most).select(function, "id", F.lit(1).cast("long").alias("n"), "score")
    return group.select(function, "id", "n", "score").unionByName(rest)


def take(items: DataFrame, low_tail: Column, n: int = PER_ROUND) -> DataFrame:
    """sort.queue: low tail last, then by falling score; ids and functions break ties."""
    ties = [c for c in ("id", "function") if c in items.columns]
    return items.withColumn("_tail", low_tail.cast("int")).orderBy("_tail", F.desc("score"), *ties).limit(n).drop("_tail")


def first_fit(rows: Iterator[tuple]) -> Iterator[tuple[int, int]]:
    """(row number, batch number) of (findings, chars) rows in order: each goes into the first batch with room."""
    open_: list[list[int]] = []
    for i, (findings, chars) in enumerate(rows):
        for b, room in enumerate(open_):
            if room[0] + 1 <= BATCH_FUNCTIONS and room[1] + findings <= BATCH_FINDINGS and room[2] + chars <= BATCH_CHARS:
                break
        else:
            b = len(open_)
            open_.append([0, 0, 0])
        open_[b] = [open_[b][0] + 1, open_[b][1] + findings, open_[b][2] + chars]
        yield i, b


class _Rooms:
    """A tournament tree over the batches. A node knows, for every number of findings, the most characters that a batch below it takes beside
    as many; so the first batch with room is found by going down once, without trying any in vain."""

    def __init__(self):
        import numpy as np

        self.np, self.n, self.size = np, 0, 1
        self.most = np.full((2, BATCH_FINDINGS + 1), -1, np.int64)
        self.room: list[tuple[int, int, int]] = []

    def _set(self, at: int, room: tuple[int, int, int]) -> None:
        functions, findings, chars = room
        leaf = self.most[self.size + at]
        leaf[:] = -1
        if functions > 0 and findings >= 0 and chars >= 0:
            leaf[: findings + 1] = chars
        at = (self.size + at) // 2
        while at:
            self.np.maximum(self.most[2 * at], self.most[2 * at + 1], out=self.most[at])
            at //= 2

    def put(self, findings: int, chars: int) -> int:
        """The number of the first batch that takes the item, a new one if there is none."""
        if findings <= BATCH_FINDINGS and self.most[1, findings] >= chars:
            at = 1
            while at < self.size:
                at = 2 * at if self.most[2 * at, findings] >= chars else 2 * at + 1
            at -= self.size
        else:
            at, self.n = self.n, self.n + 1
            self.room.append((BATCH_FUNCTIONS, BATCH_FINDINGS, BATCH_CHARS))
            if at == self.size:  # twice as many leaves
                leaves = self.most[self.size :]
                self.size *= 2
                self.most = self.np.full((2 * self.size, BATCH_FINDINGS + 1), -1, self.np.int64)
                self.most[self.size : self.size + len(leaves)] = leaves
                for i in range(self.size - 1, 0, -1):
                    self.np.maximum(self.most[2 * i], self.most[2 * i + 1], out=self.most[i])
        room = self.room[at]
        self.room[at] = (room[0] - 1, room[1] - findings, room[2] - chars)
        self._set(at, self.room[at])
        return at


def batches(items: DataFrame, keys: list[str], order: str) -> DataFrame:
    """agg.batches: items (findings, chars, ...) with `batch`, packed first-fit per key in the order of a column.

    An item goes into the first batch that has room for it, or opens one. An item that is over a limit by itself opens a batch too,
    which then has no room. Keys are sorted streams: a task holds the rooms of one key's batches and never its items. A null number, or one below 0, counts as 0.
    """
    import pyarrow as pa

    def pack(it):
        key, rooms = None, _Rooms()
        for batch in it:
            cols = {c: batch.column(c).to_pylist() for c in (*keys, "findings", "chars")}
            out = []
            for own, findings, chars in zip(zip(*(cols[k] for k in keys)), cols["findings"], cols["chars"]):
                if own != key:
                    key, rooms = own, _Rooms()
                out.append(rooms.put(max(0, int(findings or 0)), max(0, int(chars or 0))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "batch"])

    schema = T.StructType([*items.schema.fields, T.StructField("batch", T.LongType())])
    rest = [c for c in items.columns if c not in (*keys, order)]
    return items.repartition(*keys).sortWithinPartitions(*keys, order, *rest).mapInArrow(pack, schema)


def status(verdict: Column, evidence: Column, proof: Column) -> Column:
    """fn.status: verdict first, then evidence."""
    return (
        F.when((verdict == "confirmed") & proof, "proven")
        .when(verdict == "rejected", "rejected")
        .when(verdict.isin("confirmed", "inconclusive"), "inconclusive")
        .when(evidence.isin("confirmed", "measured"), "observed")
        .when(evidence == "not-observed", "not-observed")
        .otherwise("unverified")
    )


def downgrade(severity: Column) -> Column:
    """proj.severity_downgrade"""
    return F.when(severity == "high", "medium").otherwise("low")


def leaf(chain: Column) -> Column:
    """fn.leaf: the last name of a chain that is neither a place nor a call."""
    return F.element_at(F.filter(chain, lambda x: ~x.contains(" @ ") & ~x.contains("(")), -1)


def confirmed_without_stall(status_: Column, max_lag: Column, least: float = 0.05) -> Column:
    """pred.contradicts"""
    return (status_ == "confirmed") & (max_lag < least)
