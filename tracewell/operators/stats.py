"""Aggregations over activations and outbound calls: agg.fn_stats, agg.io_stats, agg.external, agg.fit_*, agg.projections and kin."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut

#: Power fits need so many sizes, such a span of sizes and such a slowest median (agg.fit_power).
MIN_SIZES, MIN_SPAN, MIN_MAX_DUR = 4, 10.0, 0.001
#: A fit projects from this exponent and quality on (agg.projections).
MIN_EXPONENT, MIN_R2 = 1.3, 0.8


def rounded(c: Column, n: int = 4) -> Column:
    """HALF_UP on the decimal string, never a negative zero."""
    return F.round(c, n) + F.lit(0.0)


#: Groups of more rows have their order statistics bracketed first, by so much on either side of the share asked for. A bracket with more
#: different values than NARROW is narrowed again, by PARTS to one, until it has no more.
WHOLE_ROWS, BRACKET = 4_096, 0.002
NARROW, PARTS = 4_096, 256


def _same(keys: list[str], other: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, other)])


def order_values(df: DataFrame, keys: list[str], value: str, wanted: dict[str, tuple[float, Callable[[Column], Column]]]) -> DataFrame:
    """One row per group: keys, _n, and for each name its struct (a, b): the values at the rank that its function of _n gives and at the next.

    A sketch of each group brackets the ranks; rows below a bracket are only counted, and those inside it, some thousandths of
    a large group, are counted by value. The brackets are twenty times wider than the sketch's error, so the values are exact. A bracket that still has
    many values is narrowed round by round, all groups in one; what is put in order in the end is at most NARROW values of a group and rank.
    """
    v = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    ends = [x for share, _ in wanted.values() for x in (max(0.0, share - BRACKET), min(1.0, share + BRACKET))]
    own = [f"_k{i}" for i in range(len(keys))]
    stat = v.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_v", ends, 10_000).alias("_q"))
    # one row a group, used twice: the rows are read twice and not three times
    stat = cut(stat.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], "_n", "_q"))
    largest = stat.agg(F.max("_n").alias("n")).first()["n"] or 0
    j = v.join(stat, _same(keys, own))
    cells = []
    for i, name in enumerate(wanted):
        lo, hi = F.col("_q")[2 * i], F.col("_q")[2 * i + 1]
        cell = lambda inside, x, name=name: F.struct(F.lit(name).alias("name"), F.lit(inside).alias("in"), x.alias("v"))
        cells.append(F.when((F.col("_n") <= WHOLE_ROWS) | F.col("_v").between(lo, hi), cell(1, F.col("_v"))).when(F.col("_v") < lo, cell(0, F.lit(None).cast(v.schema["_v"].dataType))))
    c = j.select(*keys, "_n", F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("_c")).groupBy(*keys, "_n", F.col("_c.name").alias("_name"), F.col("_c.in").alias("_in"), F.col("_c.v").alias("_v")).agg(F.count("*").alias("_m"))
    rank = reduce(lambda acc, x: F.when(F.col("_name") == x[0], x[1][1](F.col("_n"))).otherwise(acc), wanted.items(), F.lit(None)).cast("long")
    group = [*keys, "_n", "_name"]
    # ties apart, a bracket has no more different values than rows; only very large groups can have too many
    if 3 * BRACKET * largest > NARROW:
        c = cut(c)
        while (c.where("_in = 1").groupBy(*group).agg(F.count("*").alias("d")).agg(F.max("d").alias("d")).first()["d"] or 0) > NARROW:
            c = cut(_narrowed(c, group, rank))
    seen = c.groupBy(*group).agg(F.coalesce(F.sum(F.when(F.col("_in") == 0, F.col("_m"))), F.lit(0)).alias("_below"), F.sort_array(F.collect_list(F.when(F.col("_in") == 1, F.struct("_v", "_m")))).alias("_in")).withColumn("_r", rank)
    none = F.lit(None).cast(v.schema["_v"].dataType)

    def step(acc: Column, x: Column) -> Column:
        to = acc["to"] + x["_m"]
        holds = lambda r: (acc["to"] < r) & (to >= r)
        return F.struct(to.alias("to"), F.when(holds(F.col("_r")), x["_v"]).otherwise(acc["a"]).alias("a"), F.when(holds(F.col("_r") + 1), x["_v"]).otherwise(acc["b"]).alias("b"))

    ranked = seen.withColumn("_x", F.aggregate("_in", F.struct(F.col("_below").alias("to"), none.alias("a"), none.alias("b")), step))
    pick = lambda name: F.max(F.when(F.col("_name") == name, F.struct(F.col("_x.a").alias("a"), F.col("_x.b").alias("b")))).alias(name)
    return ranked.groupBy(*keys, "_n").agg(*[pick(name) for name in wanted])


def _narrowed(c: DataFrame, group: list[str], rank: Column) -> DataFrame:
    """The counted values c with each bracket cut to the one part, or two, of PARTS that hold the rank and the next; what lies below is added up."""
    own = [f"_g{i}" for i in range(len(group))]
    parts = [i / PARTS for i in range(1, PARTS)]
    low = F.coalesce(F.sum(F.when(F.col("_in") == 0, F.col("_m"))), F.lit(0))
    info = c.groupBy(*group).agg(low.alias("_below"), F.percentile_approx(F.when(F.col("_in") == 1, F.col("_v")), parts, 10_000).alias("_q")).withColumn("_r", rank - F.col("_below"))
    info = info.select(*[F.col(g).alias(o) for g, o in zip(group, own)], "_below", "_q", "_r")
    inside = c.where("_in = 1").join(info, _same(group, own)).withColumn("_part", F.size(F.filter("_q", lambda q: q < F.col("_v"))))
    # at most PARTS rows of a group go through the window
    w = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    held = inside.groupBy(*group, "_part", "_below", "_r").agg(F.sum("_m").alias("_s")).withColumn("_to", F.sum("_s").over(w)).withColumn("_from", F.col("_to") - F.col("_s"))
    held = held.where((F.col("_from") < F.col("_r") + 1) & (F.col("_to") >= F.col("_r")))
    ends = held.groupBy(*group).agg(F.min("_part").alias("_lo"), F.max("_part").alias("_hi"), F.min(F.col("_from") + F.col("_below")).alias("_under"))
    ends = ends.select(*[F.col(g).alias(o) for g, o in zip(group, own)], "_lo", "_hi", "_under")
    kept = inside.drop(*own).join(ends, _same(group, own)).where("_part BETWEEN _lo AND _hi").select(*group, "_in", "_v", "_m")
    under = ends.select(*[F.col(o).alias(g) for g, o in zip(group, own)], F.lit(0).alias("_in"), F.lit(None).cast(c.schema["_v"].dataType).alias("_v"), F.col("_under").alias("_m"))
    return kept.unionByName(under)


def _p95_rank(n: Column) -> Column:
    return F.greatest(F.lit(1), F.least(n - 1, F.floor(19 * (n + 1) / 20)))


def _p95(name: str) -> Column:
    delta = 19 * (F.col("_n") + 1) - 20 * _p95_rank(F.col("_n"))
    a, b = F.col(f"{name}.a"), F.col(f"{name}.b")
    return F.when(F.col("_n") == 1, a).otherwise(a * (20 - delta) / 20 + b * delta / 20)


def _median(name: str) -> Column:
    a, b = F.col(f"{name}.a").cast("double"), F.col(f"{name}.b").cast("double")
    return F.when(F.col("_n") % 2 == 1, a).otherwise(0.5 * a + 0.5 * b)


P95 = (0.95, _p95_rank)
MEDIAN = (0.5, lambda n: F.floor((n - 1) / 2) + 1)


def p95_exclusive(df: DataFrame, keys: list[str], value: str, out: str = "p95") -> DataFrame:
    """The last of 20 exclusive quantiles per group: position 0.95 * (n + 1), carried on beyond the largest value."""
    return order_values(df, keys, value, {"_p": P95}).select(*keys, _p95("_p").alias(out))


def tails(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, p50, p95) per group: the median and the exclusive 95th percentile."""
    return order_values(df, keys, value, {"_h": MEDIAN, "_p": P95}).select(*keys, _median("_h").alias("p50"), _p95("_p").alias("p95"))


def _with(base: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """base with the columns of more for equal keys, nulls among them equal."""
    on = [F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in keys]
    return base.alias("_l").join(more.alias("_r"), reduce(lambda x, y: x & y, on), "left").select("_l.*", *[F.col(f"_r.{c}") for c in more.columns if c not in keys])


def fn_stats(act: DataFrame, key: str = "fn") -> DataFrame:
    """agg.fn_stats: calls, total, p50, exclusive p95 and max per function."""
    base = act.groupBy(key).agg(F.count("*").alias("calls"), rounded(F.sum("dur")).alias("total_s"), rounded(F.max("dur")).alias("max_s"))
    tail = tails(act, [key], "dur").select(key, rounded(F.col("p50")).alias("p50_s"), rounded(F.col("p95")).alias("p95_s"))
    return _with(base, tail, [key])


def self_time(act: DataFrame) -> DataFrame:
    """agg.self_time: duration minus the children's, floored at 0."""
    child = act.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.sum("dur").alias("child_s"))
    return act.join(child, "id", "left").withColumn("self_s", F.greatest(F.col("dur") - F.coalesce("child_s", F.lit(0.0)), F.lit(0.0)))


def io_stats(io: DataFrame, keys: list[str]) -> DataFrame:
    """agg.io_stats: count, errors, p50, max and the first five targets."""
    base = io.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("error").cast("long")).alias("errors"), rounded(F.max("dur")).alias("max_s"))
    half = order_values(io, keys, "dur", {"_h": MEDIAN}).select(*keys, rounded(_median("_h")).alias("p50_s"))
    return _with(_with(base, half, keys), first_five(io, keys, "target", "targets"), keys)


def first_five(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """(keys, out): the first five distinct values of each group, joined by commas; a group's values are numbered, never listed as a whole."""
    distinct = df.where(F.col(value).isNotNull()).select(*keys, value).distinct()
    ranked = distinct.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(value))).where("_i <= 5")
    return ranked.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(value)), ",").alias(out))


def external_calls(io: DataFrame, callers: DataFrame, top: int = 50) -> DataFrame:
    """agg.external: per (system, target) counts, quantiles and five callers; slowest first."""
    keys = ["system", "target"]
    base = io.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("error").cast("long")).alias("errors"), rounded(F.max("dur")).alias("max_s"))
    tail = tails(io, keys, "dur").select(*keys, rounded(F.col("p50")).alias("p50_s"), rounded(F.col("p95")).alias("p95_s"))
    who = first_five(io.join(callers, "parent"), keys, "caller", "callers").select(*keys, "callers")
    out = _with(_with(base, tail, keys), who, keys).withColumn("callers", F.coalesce("callers", F.lit("")))
    return out.select(*keys, "n", "errors", "p50_s", "max_s", "p95_s", "callers").orderBy(F.desc("max_s"), *keys).limit(top)


def fit_power(points: DataFrame, keys: list[str], size: str = "n", dur: str = "dur") -> DataFrame:
    """agg.fit_power: least squares of ln(median duration) on ln(size), where sizes are many and wide enough."""
    med = points.where((F.col(size) > 0) & (F.col(dur) > 0)).groupBy(*keys, size).agg(F.expr(f"percentile({dur}, 0.5)").alias("_d"))
    x, y = F.ln(F.col(size).cast("double")), F.ln("_d")
    fit = med.groupBy(*keys).agg(
        F.count("*").alias("sizes"),
        (F.max(size) / F.min(size)).alias("_span"),
        F.max("_d").alias("_max"),
        rounded(F.regr_slope(y, x)).alias("exponent"),
        rounded(F.regr_intercept(y, x)).alias("intercept"),
        rounded(F.coalesce(F.regr_r2(y, x), F.lit(1.0))).alias("r2"),
        F.max(size).alias("largest"),
    )
    return fit.where((F.col("sizes") >= MIN_SIZES) & (F.col("_span") >= MIN_SPAN) & (F.col("_max") >= MIN_MAX_DUR)).drop("_span", "_max")


def fit_label(k: Column) -> Column:
    """agg.fit_label: the order of growth that an exponent stands for."""
    return F.when(k < 0.2, "O(1)").when(k < 0.8, "sublinear").when(k < 1.2, "O(n)").when(k < 1.7, "O(n log n)").when(k < 2.3, "O(n^2)").when(k < 3.3, "O(n^3)").otherwise("steeper")


def predict(n: Column) -> Column:
    """agg.predict on the rounded coefficients."""
    return F.exp("intercept") * F.pow(n, F.col("exponent"))


def best_fit(fits: DataFrame, keys: list[str]) -> DataFrame:
    """agg.best_fit: the argument with the best R², the first by name among equals."""
    w = Window.partitionBy(*keys).orderBy(F.desc("r2"), "arg")
    return fits.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def projections(fits: DataFrame, assumed: Column, least_exponent: float = MIN_EXPONENT, least_r2: float = MIN_R2) -> DataFrame:
    """agg.projections: the duration at an assumed size, and whether it is a risk (a second and ten times the observed)."""
    p = fits.where((F.col("exponent") >= least_exponent) & (F.col("r2") >= least_r2)).withColumn("assumed_n", assumed)
    p = p.withColumn("predicted_s", rounded(predict(F.col("assumed_n").cast("double")), 3)).withColumn("_seen", predict(F.col("largest").cast("double")))
    return p.withColumn("risk", F.col("predicted_s") >= F.greatest(F.lit(1.0), 10 * F.col("_seen"))).drop("_seen")


def fanout(children: DataFrame, leaf: Column) -> DataFrame:
    """agg.fanout: largest and mean number of leaf calls below one activation, per parent function."""
    per = children.where(leaf).groupBy("parent_fn", "parent").agg(F.count("*").alias("_n"))
    return per.groupBy("parent_fn").agg(F.count("*").alias("activations"), F.max("_n").alias("fanout_max"), rounded(F.avg("_n")).alias("fanout_mean"))


def constants(named: DataFrame, name: str, value: str) -> DataFrame:
    """agg.constants: names bound to one value only."""
    return named.groupBy(name).agg(F.min(value).alias("value"), F.max(value).alias("_hi")).where("value = _hi").drop("_hi")


def instances(bound: DataFrame, receiver: str, cls: str) -> DataFrame:
    """agg.instances: the class of a receiver, null where two were bound."""
    return bound.groupBy(receiver).agg(F.when(F.count_distinct(cls) == 1, F.max(cls)).alias("cls"))


def hotspots(find: DataFrame, edge: DataFrame, depth: DataFrame, bnd: DataFrame, top: int = 25) -> DataFrame:
    """agg.hotspots: severity weights, loop depth, callers up to ten and boundaries, per function."""
    weight = F.when(F.col("severity") == "high", 5.0).when(F.col("severity") == "medium", 2.0).when(F.col("severity") == "low", 0.5).otherwise(1.0)
    a = find.groupBy("function").agg(F.sum(weight).alias("sev"))
    b = edge.groupBy(F.col("callee").alias("function")).agg(F.count("*").alias("fan_in"))
    c = bnd.groupBy("function").agg(F.count("*").alias("n_bnd"))
    out = a.join(b, "function", "left").join(c, "function", "left").join(depth, "function", "left")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    score = F.col("sev") + 2 * F.greatest(zero("loop_depth") - 1, F.lit(0)) + 0.5 * F.least(zero("fan_in"), F.lit(10)) + zero("n_bnd")
    return out.select("function", rounded(score, 2).alias("score")).orderBy(F.desc("score"), F.desc("function")).limit(top)


def latest(log: DataFrame, key: str, seq: str, columns: list[str]) -> DataFrame:
    """agg.latest: the last entry of a key replaces the others and counts them."""
    return log.groupBy(key).agg(F.count("*").alias("attempts"), F.max_by(F.struct(*columns), seq).alias("_e")).select(key, "attempts", *[F.col(f"_e.{c}").alias(c) for c in columns])
