"""Sharding by a k-d tree over document metadata.

A node that owns k shards is split at the weighted quantile that gives its left
child floor(k/2) of them, along its widest dimension, until every leaf is one shard of about
the target bytes. The weights are bytes, so the law is `bytes`: sizes near equal.

The dimensions are functions of the text alone (size, bytes per character, line
length, checksum), so equal texts share one point of the tree and stay in one shard.
Only a group of copies that is heavier than the tolerance is divided, by the
rows' ids, because no point could divide it.

Medians are distributed: a round is one histogram per open node, of a fixed
number of bins, and each round narrows the bin that holds the quantile. The driver sees
at most nodes x bins sums a round, whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut, named, without

SHARDS = 24
#: Part of the target bytes that a cut may miss its quantile by, to leave a group of equal texts whole.
TOLERANCE = 0.002
BINS = 1 << 11
#: Bits of a coordinate: a quantised dimension over the checksum.
HIGH, LOW = 20, 32
OUT = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


@dataclass
class _Node:
    shards: tuple[int, int]  # first, past the last
    level: int = 0
    dim: str = ""
    lo: int = 0
    hi: int = 0  # past the last key
    before: int = 0  # weight of the node's rows below lo
    want: int = 0  # weight to the left of the cut
    cut: int | None = None
    tie: bool = False  # the keys are ids inside one point
    point: int = 0


def _quantised(x: Column, lo: float, hi: float) -> Column:
    span = max(hi - lo, 1e-12)
    return F.floor(F.least(F.greatest((x - lo) / span, F.lit(0.0)), F.lit(1.0)) * ((1 << HIGH) - 1)).cast("long")


DIMENSIONS = ("log_size", "width", "line", "crc")


def _points(docs: DataFrame, ids: str, text: str, keep: list[str]) -> DataFrame:
    """(other columns, id, size, crc, raw dimensions, tie) of every row; the text is read once and left behind."""
    t = F.coalesce(named(text), F.lit(""))
    size = F.octet_length(t).cast("long")
    return docs.select(
        F.struct(*map(named, keep)).alias("_extra") if keep else F.lit(None).cast("string").alias("_extra"),
        named(ids).alias("_id"),
        (size + 8).alias("size"),
        F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"),
        F.log2((size + 8).cast("double")).alias("log_size"),
        (size / F.greatest(F.length(t), F.lit(1))).alias("width"),
        F.log2(size / (F.length(t) - F.length(F.translate(t, "\n", "")) + 1) + 1).alias("line"),
        # rows without an id are told apart by where they were read; the checkpoint keeps that
        F.shiftright(F.coalesce(named(ids).try_cast("long"), F.xxhash64(F.monotonically_increasing_id())), 1).alias("_tie"),
    )


def _keys(points: DataFrame) -> DataFrame:
    """Adds one 52-bit key per dimension: the quantised dimension, then the checksum, so that equal texts are one key."""
    ends = points.agg(*[f(c).alias(f"{n}_{c}") for c in DIMENSIONS[:3] for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = {}
    for c in DIMENSIONS[:3]:
        out[c] = F.shiftleft(_quantised(F.col(c), ends[f"lo_{c}"] or 0.0, ends[f"hi_{c}"] or 0.0), LOW) + F.col("text_crc32")
    out["crc"] = F.shiftleft(F.col("text_crc32"), HIGH) + F.shiftright(out["log_size"], LOW)
    return points.select("_extra", "_id", "size", "text_crc32", "_tie", *[v.alias(k) for k, v in out.items()])


def _case(nodes: list[tuple[int, Column]], default: Column) -> Column:
    out = default
    for i, value in nodes:
        out = F.when(F.col("_node") == i, value).otherwise(out)
    return out


def _split_level(rows: DataFrame, nodes: dict[int, _Node], target: float) -> dict[int, _Node]:
    """Finds the cut of every node that owns more than one shard."""
    open_ = {i: n for i, n in nodes.items() if n.shards[1] - n.shards[0] > 1}
    stats = rows.where(F.col("_node").isin(*open_)).groupBy("_node").agg(F.sum("size").alias("w"), *[F.min(c).alias(f"lo_{c}") for c in DIMENSIONS], *[F.max(c).alias(f"hi_{c}") for c in DIMENSIONS]).collect()
    for r in stats:
        n = open_[r["_node"]]
        n.dim = max(DIMENSIONS, key=lambda c: (r[f"hi_{c}"] - r[f"lo_{c}"], c))
        n.lo, n.hi, n.before = r[f"lo_{n.dim}"], r[f"hi_{n.dim}"] + 1, 0
        k = n.shards[1] - n.shards[0]
        n.want = r["w"] * (k // 2) // k
    full = {r["_node"]: open_[r["_node"]] for r in stats}
    for i in open_.keys() - full.keys():
        open_[i].cut = 0
    while True:
        todo = {i: n for i, n in full.items() if n.cut is None}
        if not todo:
            return nodes
        key = _case([(i, F.when(F.col(n.dim) == n.point, F.col("_tie")) if n.tie else F.col(n.dim)) for i, n in todo.items()], F.lit(None).cast("long"))
        width = {i: -(-(n.hi - n.lo) // BINS) for i, n in todo.items()}
        inside = _case([(i, (F.col("_k") >= n.lo) & (F.col("_k") < n.hi)) for i, n in todo.items()], F.lit(False))
        number = _case([(i, F.expr(f"CAST((_k - ({n.lo}L)) DIV {width[i]}L AS INT)")) for i, n in todo.items()], F.lit(0))
        sums = rows.where(F.col("_node").isin(*todo)).withColumn("_k", key).where(inside).groupBy("_node", number.alias("_bin")).agg(F.sum("size").alias("w")).collect()
        by: dict[int, dict[int, int]] = {i: {} for i in todo}
        for r in sums:
            by[r["_node"]][r["_bin"]] = r["w"]
        for i, n in todo.items():
            at = n.before
            for b in sorted(by[i]):
                if at + by[i][b] > n.want:
                    break
                at += by[i][b]
            else:
                n.cut = n.hi
                continue
            lo, weight = n.lo + b * width[i], by[i][b]
            n.before, n.lo, n.hi = at, lo, min(n.hi, lo + width[i])
            # an edge of the bin that is near enough to the quantile is the cut, and no point is divided by it
            left, right = n.want - at, at + weight - n.want
            if min(left, right) <= TOLERANCE * target or (n.tie and width[i] == 1):
                n.cut = n.lo if left <= right else n.hi
            elif width[i] == 1:
                # one point holds the quantile and is heavy: divide it by the ids
                n.tie, n.point = True, lo
                n.lo, n.hi = -(1 << 62), 1 << 62


def shard(docs: DataFrame, ids: str = "doc_id", text: str = "text", n_shards: int = SHARDS) -> DataFrame:
    """One row per row of docs: its columns but for the text, size, text_crc32, law, shard, slot and grown_shard.

    size is the UTF-8 bytes of the text plus 8; null and empty texts have size 8 and checksum 0. law is `bytes`: a cut misses its
    quantile by TOLERANCE of the target bytes or by a row at most, so the shards' sizes differ by little more than the heaviest row. slot numbers the rows of a shard from 0 without gaps, in order of a hash of the id.
    grown_shard is null under this law. A null id is allowed and returned. Rows that repeat an id and a text stay together.
    An empty table gives an empty result, and a text may be of any length. Equal sizes are cut anywhere: ties do not matter. Input columns named like an output are replaced.
    """
    keep = [c for c in without(docs, [*OUT, text]) if c != ids]
    rows = cut(_keys(cut(_points(docs, ids, text, keep))).withColumn("_node", F.lit(1)))
    total = rows.agg(F.sum("size").alias("w")).first()["w"] or 0
    nodes = {1: _Node((0, n_shards))}
    while any(n.shards[1] - n.shards[0] > 1 for n in nodes.values()) and total:
        nodes = _split_level(rows, nodes, total / n_shards)
        children: dict[int, _Node] = {}
        step = []
        for i, n in nodes.items():
            k = n.shards[1] - n.shards[0]
            if k == 1:
                children[i] = n
                continue
            mid = n.shards[0] + k // 2
            left, right = 2 * i, 2 * i + 1
            children[left], children[right] = _Node((n.shards[0], mid)), _Node((mid, n.shards[1]))
            goes = F.col(n.dim or "crc") < (n.point if n.tie else n.cut)
            if n.tie:
                goes = goes | ((F.col(n.dim) == n.point) & (F.col("_tie") < n.cut))
            step.append((i, F.when(goes, F.lit(left)).otherwise(F.lit(right))))
        rows = cut(rows.withColumn("_node", _case(step, F.col("_node"))))
        nodes = children
    placed = rows.withColumn("shard", _case([(i, F.lit(n.shards[0])) for i, n in nodes.items()], F.lit(0)).cast("int"))
    # slots: number the rows of each (shard, hash bucket), then shift each bucket by the rows before it
    placed = cut(placed.select("_id", "_tie", "size", "text_crc32", "shard", "_extra").withColumn("_bucket", F.pmod(F.xxhash64("_tie", "text_crc32"), F.lit(512)).cast("int")))
    counts = placed.groupBy("shard", "_bucket").agg(F.count("*").alias("n"))
    offset = counts.withColumn("_off", F.sum("n").over(Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).select("shard", "_bucket", F.coalesce("_off", F.lit(0)).alias("_off"))
    numbered = placed.withColumn("_rn", F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("_tie", "text_crc32", "_id", "size")))
    out = numbered.join(F.broadcast(offset), ["shard", "_bucket"])
    return out.select(
        F.col("_id").alias(ids),
        *[F.col("_extra").getField(c).alias(c) for c in keep],
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_off") + F.col("_rn") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
