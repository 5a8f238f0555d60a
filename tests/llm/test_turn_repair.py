"""The fold against an exhaustive search over edits, and its defined cases."""

import random
from itertools import product

import pytest

from tests.oracle import compare
from tracewell.llm import queries
from tracewell.llm.turn_repair import OUT, Costs, damage, repair_conversations

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def faults(rows):
    """(row, fault) of a conversation's rows in order."""
    seen, out = set(), []
    for turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        bare = text.rstrip(WHITE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(((turn, role, text), fault))
    return out


def legal(roles):
    spelt = "".join(r[:1] or "-" for r in roles)
    spelt = spelt[1:] if spelt[:2] == "su" else spelt
    return spelt == "ua" * (len(spelt) // 2) and len(spelt) % 2 == 0 and (spelt != "" or not roles)


def search(rows, c):
    """The least (cost, audit) over all edits with at most two insertions in a gap, and the turns that it leaves."""
    told = faults(rows)
    best = None
    gaps = [[()] + [("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")] for _ in range(len(told) + 1)]
    edits = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ruser", "Rassistant"] for _, f in told]
    for puts in product(*gaps):
        for pick in product(*edits):
            cost, audit, turns = 0, "", []
            for i in range(len(told) + 1):
                for role in puts[i]:
                    cost, audit = cost + c.insert, audit + "I"
                    turns.append((role, ""))
                if i < len(told):
                    (_, role, text), fault = told[i]
                    e = pick[i]
                    audit += e[0]
                    cost += c.delete if e == "D" else (c.truncated if fault == "truncated" else 0) + (c.rerole if e[0] == "R" else 0)
                    if e != "D":
                        turns.append((role if e == "K" else e[1:], text))
            if (best is None or (cost, audit) < best[:2]) and legal([r for r, _ in turns]):
                best = cost, audit, turns
    return best


def run(spark, rows, **more):
    out = repair_conversations(spark.createDataFrame(rows, SCHEMA), **more).collect()
    return {r["conv_id"]: r for r in out}


@pytest.mark.parametrize("costs", [Costs(), Costs(rerole=3, delete=4, insert=1, truncated=2), Costs(insert=2)])
def test_cheapest_edits(spark, costs):
    r = random.Random(5)
    roles, texts = ["user", "assistant", "system", "tool", "u", ""], ["Yes.", "No!", "cut off", " ", "Why? \n", "Yes."]
    rows = [(conv, t if r.random() < 0.9 else None, r.choice(roles), r.choice(texts)) for conv in range(60) for t in range(conv % 4)]
    got = run(spark, rows, costs=costs)
    assert len(got) == 45
    for conv, row in got.items():
        mine = [x[1:] for x in rows if x[0] == conv]
        cost, audit, turns = search(mine, costs)
        assert (row["cost"], row["audit"], [tuple(t) for t in row["repaired"]]) == (cost, audit, turns), mine
        told = faults(mine)
        assert [row[f] for f in ("blank", "duplicate", "truncated")] == [sum(f == g for _, g in told) for f in ("blank", "duplicate", "truncated")]
        initials = [x[1][:1] for x, _ in told]
        assert row["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = [x[0] for x in mine if x[0] is not None]
        assert row["gaps"] == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)


def test_defined_cases(spark):
    rows = [
        (1, None, None, None),  # nulls read as one space: a blank turn
        (2, 5, "user", "Hello."), (2, 5, "user", "Hello."), (2, 9, "assistant", "Hi."),  # a repeated row
        (None, 1, "user", "A."), (None, 2, "assistant", "B."),  # no id: a conversation of its own
        (3, -(2**63), "user", "A."), (3, 2**63 - 1, "assistant", "B."),  # no long holds the gap
        (4, 1, "system", "Be brief."), (4, 2, "user", "x" * 200_000 + "."), (4, 3, "assistant", "B."),
        (5, 1, "system", "Only this."),
    ]
    got = run(spark, rows)
    assert [(got[k]["cost"], got[k]["audit"]) for k in (1, 2, None, 3, 4, 5)] == [(2, "D"), (2, "KDK"), (0, "KK"), (0, "KK"), (0, "KKK"), (2, "D")]
    assert (got[2]["gaps"], got[2]["duplicate"], got[3]["gaps"], got[1]["gaps"], got[1]["blank"]) == (3, 1, None, 0, 1)
    assert len(got[4]["repaired"][1]["text"]) == 200_001


def test_absent_rows_empty_tables_and_other_columns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "A.", False, 7), (1, 1, "user", "B.", None, 7)], SCHEMA + ", cost boolean, audit int")
    (row,) = repair_conversations(rows, present="cost").collect()
    assert row.asDict() == {"conv_id": 1, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired": []}
    empty = repair_conversations(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["conv_id", *OUT] and empty.count() == 0
    odd = spark.createDataFrame([(1, "one", "user", "A."), (1, "2", "assistant", "B.")], "conv_id long, turn string, role string, text string")
    assert repair_conversations(odd).first()["audit"] == "KK"  # a turn that is no integer counts as null and comes first


def test_a_conversation_of_many_turns(spark):
    rows = spark.range(20_000).selectExpr("1L AS conv_id", "id AS turn", "CASE WHEN id % 3 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('Turn ', id, '.') AS text")
    row = repair_conversations(rows).first()
    assert len(row["audit"]) == 20_000 and legal([t["role"] for t in row["repaired"]]) and row["cost"] == sum({"R": 1, "D": 2, "K": 0}[x] for x in row["audit"])


def test_one_exchange_and_no_python(spark):
    df = repair_conversations(damage(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")), present="present")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Arrow" not in plan


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "Well. Yes! No?") for c in range(8) for t in range(12)] + [(None, None, None, None)]
    got = sorted(map(tuple, damage(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", " " if text is None else text
        text = "" if kind == 1 else text.translate(str.maketrans("", "", ".!?")) if kind == 2 else text
        want += [(c, t, "user" if kind == 4 else role, text, kind != 0)] * (2 if kind == 3 else 1)
    assert got == sorted(want, key=repr)


def test_twin(spark):
    compare(spark, queries.QUERIES["op11_turn_fold"], queries.ORACLES["op11_turn_fold"], "sf0.01")
