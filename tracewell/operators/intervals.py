"""Range, nearest and interval joins. Every join carries an equality, so none is planned as a nested loop over both whole sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _up(x: Column, level: int) -> Column:
    """x / 2^level, rounded down."""
    return F.shiftright(x.cast("long"), level)


def cover(start: Column, end: Column, levels: int) -> Column:
    """The aligned blocks struct(level, block) that make up the whole numbers from start to end: at most two of each length, and none if end < start."""
    found = []
    for k in range(levels):
        lo, hi = -_up(-start.cast("long"), k), _up(end.cast("long") + 1, k)
        odd = lo % 2 != 0
        block = lambda x, k=k: F.struct(F.lit(k).alias("level"), x.alias("block"))
        found += [F.when(odd & (lo < hi), block(lo)), F.when((hi % 2 != 0) & (lo + odd.cast("long") < hi), block(hi - 1))]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def holders(at: Column, levels: int) -> Column:
    """The aligned blocks struct(level, block) that hold a number, one of each length."""
    return F.array(*[F.struct(F.lit(k).alias("level"), _up(at, k).alias("block")) for k in range(levels)])


def _levels(longest: int | None) -> int:
    return (longest or 0).bit_length()


def _first_around(points: DataFrame, ranges: DataFrame, key: str, at: str, order: list[Column]) -> DataFrame:
    """points with `_best`, the first range around each in this order, without those that have none.

    A range is dealt to the blocks that it is made of, a point to those that hold it. All points of a block lie in all ranges of the block, so
    only the first range of a block is kept: a point meets one row per length of block, however many ranges there are.
    """
    r = ranges.where(F.col("start") <= F.col("end"))
    levels = _levels(r.agg(F.max(F.col("end") - F.col("start") + 1).alias("n")).first()["n"])
    best = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c) for c in r.columns if c != key])
    index = r.withColumn("_b", F.explode(cover(F.col("start"), F.col("end"), levels))).groupBy(key, "_b").agg(F.min(best).alias("_best")) if levels else r.select(key, F.struct(F.lit(0).alias("level"), F.lit(0).cast("long").alias("block")).alias("_b"), best.alias("_best"))
    return points.withColumn("_b", F.explode(holders(F.col(at), max(levels, 1)))).join(index, [key, "_b"]).drop("_b")


def _one_each(hits: DataFrame, points: DataFrame, ranges: DataFrame, key: str, ids: list[str]) -> DataFrame:
    """The least `_best` per ids, as the columns of points and ranges."""
    rest = [c for c in points.columns if c not in ids]
    won = hits.groupBy(*ids).agg(F.min(F.struct("_best", *rest)).alias("_x"))
    return won.select(*ids, *[F.col(f"_x.{c}").alias(c) for c in rest], *[F.col(f"_x._best.{c}").alias(c) for c in ranges.columns if c != key])


def enclosing_smallest(points: DataFrame, ranges: DataFrame, key: str, at: str, ids: list[str]) -> DataFrame:
    """join.location: (key, at) -> the smallest range of that key around it, the later start among equals, then the smaller fn. Whole numbers only."""
    hits = _first_around(points, ranges, key, at, [F.col("end") - F.col("start"), -F.col("start"), F.col("fn")])
    return _one_each(hits, points, ranges, key, ids)


def slack_asof(points: DataFrame, ranges: DataFrame, key: str, at: str, ids: list[str], slack: int = 8) -> DataFrame:
    """join.attr_slack: the smallest range around the point, else the nearest start within `slack` after it; the smaller fn among equals."""
    order = lambda ahead, measure: [F.lit(ahead), measure.cast("long"), F.col("fn")]
    inside = _first_around(points, ranges, key, at, order(0, F.col("end") - F.col("start")))
    # the numbers after a point are blocks as well, and each keeps its first start
    best = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order(1, F.col("start")))], *[F.col(c) for c in ranges.columns if c != key])
    starts = ranges.withColumn("_b", F.explode(holders(F.col("start"), _levels(slack)))).groupBy(key, "_b").agg(F.min(best).alias("_best"))
    ahead = points.withColumn("_b", F.explode(cover(F.col(at) + 1, F.col(at) + slack, _levels(slack)))).join(starts, [key, "_b"]).drop("_b")
    return _one_each(inside.unionByName(ahead), points, ranges, key, ids)


def bins(start: Column, end: Column, width: int) -> Column:
    """The numbers of the bins of `width` that an interval touches."""
    return F.sequence(F.floor(start / width), F.floor(end / width))


def overlaps(a: DataFrame, b: DataFrame, key: str, width: int) -> DataFrame:
    """All pairs (a.w0..w1, b.start..end) of a key that overlap, each once.

    Both sides are dealt to bins of a fixed width, and a pair belongs to the bin where its overlap begins, so a key with
    a long history is spread over many tasks.
    """
    x = a.withColumn("_bin", F.explode(bins(F.col("w0"), F.col("w1"), width)))
    y = b.withColumn("_bin", F.explode(bins(F.col("start"), F.col("end"), width)))
    both = x.join(y, [key, "_bin"]).where((F.col("w0") <= F.col("end")) & (F.col("start") <= F.col("w1")))
    return both.where(F.floor(F.greatest("w0", "start") / width) == F.col("_bin")).drop("_bin")


def covered(windows: DataFrame, spans: DataFrame, key: str, ids: list[str], width: int, share: float = 0.8) -> DataFrame:
    """join.heartbeat_cover: the deepest span that covers at least `share` of a window."""
    part = F.least("end", "w1") - F.greatest("start", "w0")
    hit = overlaps(windows, spans, key, width).where(part >= share * (F.col("w1") - F.col("w0")))
    w = Window.partitionBy(*ids).orderBy(F.desc("depth"), "id")
    return hit.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def overlap_anti(windows: DataFrame, spans: DataFrame, key: str, ids: list[str], width: int, share: float = 0.5) -> DataFrame:
    """join.overlap_anti: windows that no span explains for at least `share` of the shorter of the two."""
    part = F.least("end", "w1") - F.greatest("start", "w0")
    short = F.least(F.col("w1") - F.col("w0"), F.col("end") - F.col("start"))
    hit = overlaps(windows, spans, key, width).where(part >= share * short).select(*ids).distinct()
    return windows.join(hit, ids, "left_anti")


def longest_suffix(paths: DataFrame, files: DataFrame, path: str, file: str) -> DataFrame:
    """join.path_suffix: path -> the longest file that is the path or ends it after a slash.

    Suffixes are generated per path and joined by equality: the work is the number of path parts, not paths times files.
    """
    parts = F.split(path, "/")
    n = F.size(parts)
    own = paths.select(path).distinct().withColumn("_k", F.explode(F.sequence(F.lit(1), n)))
    own = own.withColumn(file, F.array_join(F.slice(parts, n - F.col("_k") + 1, F.col("_k")), "/"))
    return own.join(files.select(file).distinct(), file).groupBy(path).agg(F.max_by(file, "_k").alias(file))


def unique_name(names: DataFrame, defs: DataFrame, name: str, qual: str) -> DataFrame:
    """join.qualname: an equal definition that is unique, else a definition that ends in the name after a dot and is unique."""
    distinct = names.select(name).distinct()
    d = defs.select(qual).distinct()
    parts = d.select(qual, F.split(qual, r"\.").alias("_p"))
    tail = parts.select(qual, F.size("_p").alias("_n"), F.explode(F.sequence(F.lit(1), F.size("_p"))).alias("_k"), "_p").select(qual, "_n", "_k", F.array_join(F.expr("slice(_p, _n - _k + 1, _k)"), ".").alias(name))
    hit = distinct.join(tail, name)
    whole = F.max(F.when(F.col("_k") == F.col("_n"), F.col(qual)))
    n_part = F.count(F.when(F.col("_k") < F.col("_n"), 1))
    out = hit.groupBy(name).agg(whole.alias("_whole"), n_part.alias("_n_part"), F.max(F.when(F.col("_k") < F.col("_n"), F.col(qual))).alias("_part"))
    return out.select(name, F.coalesce("_whole", F.when(F.col("_n_part") == 1, F.col("_part"))).alias("resolved"))
