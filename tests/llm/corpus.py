"""Small documents with every awkward case: nulls, empty texts, one very long text, ties, repeated rows, clashing column names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, class_id string, size string"


def sentence(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice(("ba", "ko", "ri", "tu", "se", "la")) for _ in range(r.randint(1, 4))) for _ in range(n))


def documents(seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    base = [sentence(r, r.randint(20, 120)) for _ in range(14)]
    passage = sentence(r, 40)
    texts: list[str | None] = list(base)
    texts += [base[0], base[0], base[1]]  # exact copies
    near = base[2].split()
    near[3] = "changed"
    texts.append(" ".join(near))  # a near copy
    texts += [f"{sentence(r, 15)} {passage}\n{sentence(r, 12)}" for _ in range(4)]  # a shared passage
    texts += [f"{passage} {passage}"]  # a passage twice in one text
    texts += [None, "", " \t\n", "one two", "one two", "x"]
    texts += [sentence(r, 6000)]  # very long
    texts += ["la la la " * 60]  # one window again and again
    texts += ["naïve über été wörter 日本 😀 " * 5]
    rows = [(i, t, "en" if i % 3 else None, "s0" if i % 4 else None, len(t) if t else None, 0.5, "x", None) for i, t in enumerate(texts)]
    rows.append(rows[4])  # a repeated row
    rows.append((None, base[5], "en", "s1", 3, None, None, None))  # no id
    rows.append((7, "another text under an id that is taken " * 3, "de", "s1", 3, None, None, None))
    r.shuffle(rows)
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
