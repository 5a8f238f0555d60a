"""Conversation structure repair as a fold of Spark's own higher-order functions.

Window functions flag each turn's first fault, a conversation's turns are collected
in order, and `aggregate()` folds them through four states: nothing said yet, only
a system turn, a user has spoken, an assistant has spoken. Each state carries the
least (cost, audit) that leads to it, so one pass gives the cheapest edits whose
roles read `(s?(ua)+)?`. Of two audits of one cost neither is a beginning of the
other in one state (they name the same turns, and one more insertion costs more),
so the least of the prefixes stays the least of the whole.

Everything is built-in expressions after one exchange by conversation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import named

#: Fixed values of the contract: white space, sentence ends, pairs of initials that may follow each other.
WHITE, ENDS, LEGAL = " \t\n\x0b\x0c\r", (".", "!", "?"), ("su", "ua", "au")
STATES = ("none", "system", "user", "assistant")
#: More than any conversation costs, and far enough from the largest long to be added to.
NEVER = 1 << 60
OUT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"]


@dataclass(frozen=True)
class Costs:
    """What an edit costs; keeping a turn costs nothing, and `insert` must be positive."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def _let(x: Column, f) -> Column:
    """f(x) with x computed once."""
    return F.transform(F.array(x), f)[0]


def _step(x: Column, cost: int | Column, letters: str | Column) -> Column:
    cost = F.lit(cost).cast("long") if isinstance(cost, int) else cost
    letters = F.lit(letters) if isinstance(letters, str) else letters
    return F.struct((x["cost"] + cost).alias("cost"), F.concat(x["audit"], letters).alias("audit"))


def _with_insertions(states: Column, c: Costs) -> Column:
    """The states after up to two insertions; a third would come back to a state at a higher cost."""

    def inserted(x: Column) -> Column:
        none, system, user, assistant = (x[s] for s in STATES)
        return F.struct(
            none.alias("none"),
            system.alias("system"),
            F.least(user, _step(none, c.insert, "I"), _step(system, c.insert, "I"), _step(assistant, c.insert, "I")).alias("user"),
            F.least(assistant, _step(user, c.insert, "I"), _step(none, 2 * c.insert, "II"), _step(system, 2 * c.insert, "II")).alias("assistant"),
        )

    return _let(states, inserted)


def _fold(turns: Column, c: Costs) -> Column:
    """struct(cost, audit) of the cheapest edits of an array of struct(initial, must_go, truncated, ...)."""
    at = lambda cost: F.struct(F.lit(cost).cast("long").alias("cost"), F.lit("").alias("audit"))

    def turn(acc: Column, t: Column) -> Column:
        more = F.when(t["must_go"], F.lit(NEVER)).when(t["truncated"], F.lit(c.truncated)).otherwise(F.lit(0)).cast("long")

        def as_role(x: Column, initial: str) -> Column:
            own = t["initial"] == initial
            return _step(x, F.when(own, F.lit(0)).otherwise(F.lit(c.rerole)) + more, F.when(own, F.lit("K")).otherwise(F.lit("R")))

        none, system, user, assistant = (acc[s] for s in STATES)
        kept_system = _step(none, F.when(t["initial"] == "s", more).otherwise(F.lit(NEVER)), "K")
        gone = lambda x: _step(x, c.delete, "D")
        states = F.struct(
            gone(none).alias("none"),
            _let(F.least(gone(system), kept_system), lambda x: F.when(x["cost"] < NEVER, x).otherwise(at(NEVER))).alias("system"),
            F.least(gone(user), as_role(none, "u"), as_role(system, "u"), as_role(assistant, "u")).alias("user"),
            F.least(gone(assistant), as_role(user, "a")).alias("assistant"),
        )
        return _with_insertions(states, c)

    start = _with_insertions(F.struct(at(0).alias("none"), *[at(NEVER).alias(s) for s in STATES[1:]]), c)
    return F.aggregate(turns, start, turn, lambda acc: F.least(acc["none"], acc["assistant"]))


def _repaired(df: DataFrame) -> DataFrame:
    """df with `repaired`, the array<struct<role, text>> that its audit makes of its turns."""
    df = df.withColumn("_letters", F.filter(F.split("audit", ""), lambda x: x != ""))
    df = df.withColumns(
        {
            "_out": F.filter("_letters", lambda x: x != "D"),
            "_kept": F.filter(F.arrays_zip(F.filter("_letters", lambda x: x != "I").alias("edit"), F.col("_turns").alias("turn")), lambda x: x["edit"] != "D"),
            "_inserts": F.instr("audit", "I") > 0,
        }
    )
    with_system = F.coalesce((F.get("_out", F.lit(0)) == "K") & (F.get("_kept", F.lit(0))["turn"]["initial"] == "s"), F.lit(False))
    df = df.withColumn("_shift", with_system.cast("int"))

    def line(x: Column, j: Column) -> Column:
        before = F.when(F.col("_inserts"), F.size(F.filter(F.slice("_out", F.lit(1), j), lambda y: y == "I"))).otherwise(F.lit(0))
        of = F.get("_kept", j - before)["turn"]
        role = F.when((j + F.col("_shift")) % 2 == 0, F.lit("user")).otherwise(F.lit("assistant"))
        return F.struct(F.when(x == "K", of["role"]).otherwise(role).alias("role"), F.when(x == "I", F.lit("")).otherwise(of["text"]).alias("text"))

    return df.withColumn("repaired", F.transform("_out", line))


def repair_conversations(rows: DataFrame, ids: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None, costs: Costs = Costs()) -> DataFrame:
    """One row per conversation: its id, gaps, counts of faults and illegal neighbours, cost, audit and the repaired turns.

    Turns are taken by `turn`, nulls first, then by role and text. The first fault of a turn counts: blank (no character
    but white space), duplicate (role and text seen earlier in the conversation), truncated (the last character that is no
    white space ends no sentence). Blank and duplicate turns are deleted; any other may stay, get another role
    or go, and empty turns may be inserted. `audit` spells the cheapest edits (Keep, Rerole, Delete, Insert), the least in ASCII order among those of
    one cost; `repaired` is array<struct<role, text>>.

    Null roles and texts read as one space, so such a text is blank. A null id is a conversation of its own. A turn that is no
    integer counts as null. gaps ignores null turns, is 0 if all are null, and null beyond the range of a long. Rows whose `present`
    is not true are as if absent, but their conversation is returned; one without rows has zeros, an empty audit and no turns.
    Repeated rows are duplicates. Other columns are not read, so their names clash with nothing. An empty table gives no row. One
    conversation is one row of the result and is held as such: it may have as many turns as a row can hold (2 GB), and
    conversations of any number are independent.
    """
    here = F.coalesce(named(present).cast("boolean"), F.lit(False)) if present else F.lit(True)
    slim = rows.select(
        named(ids).alias("_conv"),
        named(turn).try_cast("long").alias("_turn"),
        F.coalesce(named(role), F.lit(" ")).alias("_role"),
        F.coalesce(named(text), F.lit(" ")).alias("_text"),
        here.alias("_here"),
    )
    in_order = Window.partitionBy("_conv").orderBy(F.desc("_here"), F.asc_nulls_first("_turn"), "_role", "_text")
    told = slim.withColumns({"_pos": F.row_number().over(in_order), "_last_role": F.lag("_role").over(in_order), "_last_turn": F.lag("_turn").over(in_order)})
    told = told.withColumn("_nth", F.row_number().over(Window.partitionBy("_conv", "_role", "_text").orderBy("_pos")))
    bare = F.rtrim("_text", F.lit(WHITE))
    initial = F.substring("_role", 1, 1)
    told = told.withColumn("_fault", F.when(bare == "", "blank").when(F.col("_nth") > 1, "duplicate").when(~F.substring(bare, -1, 1).isin(*ENDS), "truncated").otherwise(""))
    illegal = (F.col("_pos") > 1) & ~F.concat(F.substring("_last_role", 1, 1), initial).isin(*LEGAL)
    first_of_turn = F.col("_turn").isNotNull() & ((F.col("_pos") == 1) | ~F.col("_last_turn").eqNullSafe(F.col("_turn")))
    one = F.struct(F.col("_pos").alias("pos"), initial.alias("initial"), F.col("_fault").isin("blank", "duplicate").alias("must_go"), (F.col("_fault") == "truncated").alias("truncated"), F.col("_role").alias("role"), F.col("_text").alias("text"))
    count = lambda x: F.count(F.when(F.col("_here") & x, 1))
    wide = lambda x: x.cast("decimal(20,0)")
    here_turn = F.when(F.col("_here"), F.col("_turn"))
    whole = told.groupBy("_conv").agg(
        F.coalesce(wide(F.max(here_turn)) - wide(F.min(here_turn)) + 1 - count(first_of_turn), F.lit(0)).try_cast("long").alias("gaps"),
        *[count(F.col("_fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        count(illegal).alias("illegal"),
        F.sort_array(F.collect_list(F.when(F.col("_here"), one))).alias("_turns"),
    )
    best = whole.withColumn("_best", _fold(F.col("_turns"), costs)).withColumns({"cost": F.col("_best.cost"), "audit": F.col("_best.audit")})
    return _repaired(best).select(F.col("_conv").alias(ids), *OUT)


def damage(rows: DataFrame) -> DataFrame:
    """Damaged copies of conversation rows: conv_id, turn, role, text and `present`, false where the row is dropped.

    The crc32 of `conv_id:turn` modulo 20 says what happens: 0 drops the row, 1 empties its text, 2 takes out `.!?`, 3 repeats it,
    4 makes its role user. Nulls in the key, the role and the text read as one space.
    """
    spelt = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spelt("conv_id"), F.lit(":"), spelt("turn")).cast("binary")) % 20
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace(spelt("text"), "[.!?]", "")).otherwise(spelt("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(spelt("role"))
    copies = F.array_repeat(F.lit(1), F.when(F.col("_kind") == 3, F.lit(2)).otherwise(F.lit(1)))
    hit = rows.select("conv_id", "turn", "role", "text", kind.alias("_kind"))
    return hit.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_kind") != 0).alias("present"), F.explode(copies).alias("_copy")).drop("_copy")
