"""Quality rules: one threshold table compiled into one Spark projection.

Every ratio is a built-in expression over the text's own words and lines, so
the plan is a scan and a chain of projections: no shuffle, no user functions, nothing kept per group.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import named, without

# The word separator class, the symbols, and frequent function words of four languages.
SEPARATORS = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "a an and are as at be by for from has he in is it not of on or that the this to was were which with "
    "als auf aus bei das dem den der des die ein eine einer für im ist mit nicht sich sie und von zu "
    "au aux avec ce dans de des du elle en est et il la le les par pas pour que qui sur un une "
    "al como con de del el en es la las lo los no para por que se su un una y"
).split()
WINDOW, REPEAT_PERCENT, LEAST_WORDS = 8, 30, 20
OUT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules"]


@dataclass(frozen=True)
class Rule:
    """Fails where 1000 * over / under lies outside least..most; under = 0 passes."""

    name: str
    over: str
    under: str
    least: int | None = None
    most: int | None = None


#: The threshold table. Counts are exact integers, so no rounding decides a verdict.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2_000, 14_000),
    Rule("symbol_ratio", "n_symbols", "word_chars", None, 80),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 30, None),
    Rule("dup_line_ratio", "n_dup_lines", "n_full_lines", None, 500),
    Rule("upper_ratio", "n_upper", "word_chars", None, 400),
)


def words(text: Column) -> Column:
    return F.filter(F.split(text, SEPARATORS, -1), lambda w: w != "")


def repeat_starts(df: DataFrame, array: str, window: int) -> DataFrame:
    """Adds _starts: sorted starts of the windows of `array` that occur twice or more in their row.

    Windows are found by 64-bit hashes of their words' 64-bit hashes and confirmed on the words themselves. Rows without
    a repeat, nearly all, only pay for a distinct count; the others sort (hash, start) once, so a long text costs n log n.
    """
    n = F.size(array)
    df = df.withColumn("_h", F.transform(array, lambda w: F.xxhash64(w)))
    df = df.withColumn("_win", F.when(n >= window, F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*[F.get(F.col("_h"), i + k) for k in range(window)]))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("_rep", F.size(F.array_distinct("_win")) < F.size("_win"))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    df = df.withColumn("_pairs", F.when(F.col("_rep"), F.array_sort(F.transform("_win", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(none))
    same = lambda of, by, i: F.coalesce(F.get(F.col(of), i)[by] == F.get(F.col(of), i - 1)[by], F.lit(False))
    beside = lambda of, by: F.filter(F.col(of), lambda x, i: (i > 0) & same(of, by, i) | same(of, by, i + 1))
    # windows of one hash, sorted by their words: equal ones are neighbours, even where two share a hash by chance
    spelt = F.array_sort(F.transform(beside("_pairs", "h"), lambda x: F.struct(F.array_join(F.slice(array, x["i"] + 1, window), " ").alias("w"), x["i"].alias("i"))))
    df = df.withColumn("_spelt", F.when(F.col("_rep"), spelt).otherwise(F.array().cast("array<struct<w:string,i:int>>")))
    df = df.withColumn("_starts", F.when(F.col("_rep"), F.array_sort(F.transform(beside("_spelt", "w"), lambda x: x["i"]))).otherwise(F.array().cast("array<int>")))
    return df.drop("_h", "_win", "_rep", "_pairs", "_spelt")


def quality(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, only: list[str] | None = None) -> DataFrame:
    """docs (or the columns in `only`), plus the base counts, base_failed, kept and failed_rules array<string>.

    A null or wordless text has zero counts, fails the base (fewer than 20 words) and is not kept. A ratio whose
    denominator is zero passes. Texts may be of any length, repeated rows are judged alike, an empty table gives none. Input columns named like an output are replaced.
    """
    keep = [c for c in without(docs, OUT) if only is None or c in only]
    held = F.struct(*map(named, keep)) if keep else F.lit(None).cast("string")
    df = docs.select(held.alias("_held"), F.coalesce(named(text), F.lit("")).alias("_text"))
    df = df.withColumns({"_words": words(F.col("_text")), "_lines": F.filter(F.split("_text", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))})
    bare = F.regexp_replace("_text", SEPARATORS, "")
    df = df.withColumn("_bare", bare)
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length("_bare").cast("long"),
            "n_symbols": (F.length("_bare") - F.length(F.translate("_bare", SYMBOLS, ""))).cast("long"),
            "n_full_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_upper": F.length(F.regexp_replace("_bare", "[^A-ZÀ-ÖØ-Þ]", "")).cast("long"),
            "n_stop_words": F.size(F.filter("_words", lambda w: F.rtrim(F.lower(w), F.lit(".,;:!?")).isin(*dict.fromkeys(STOP_WORDS)))).cast("long"),
        }
    )
    df = repeat_starts(df, "_words", WINDOW)
    covered = F.aggregate("_starts", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("p")), lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["p"])).alias("n"), x.alias("p")))
    df = df.withColumn("n_repeat_words", covered["n"].cast("long"))
    broken = []
    for r in rules:
        over, under = F.col(r.over) * 1000, F.col(r.under)
        out = [c for c in ((over < under * r.least) if r.least is not None else None, (over > under * r.most) if r.most is not None else None) if c is not None]
        broken.append(F.when((under > 0) & reduce(lambda a, b: a | b, out), F.lit(r.name)))
    base_failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    df = df.withColumns({"base_failed": base_failed, "failed_rules": F.filter(F.array(*broken), lambda x: x.isNotNull())})
    df = df.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return df.select(*[F.col("_held").getField(c).alias(c) for c in keep], *OUT)
