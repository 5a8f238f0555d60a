"""Spelling variants against all pairs, and the automaton against a plain dictionary."""

import random
import zlib
from collections import Counter

from tests.llm.corpus import frame
from tests.oracle import compare
from tracewell.llm import queries, spelling
from tracewell.llm.spelling import Automaton, near_words, spelling_forms, typed_words


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def vocabulary(seed, n, alphabet="ab", lengths=(7, 11)):
    r = random.Random(seed)
    out = {"".join(r.choice(alphabet) for _ in range(r.randint(*lengths))) for _ in range(n)}
    for w in sorted(out)[: n // 3]:
        i = r.randrange(len(w))
        out |= {w[:i] + w[i + 1 :], w[:i] + "é" + w[i:], w[:i] + "ÿ" + w[i + 1 :]}
    return {w: r.choice((1, 2, 20, 300, 5000)) for w in out}


def brute(words, ratio=10, shortest=7):
    words = {w: n for w, n in words.items() if len(w) >= shortest}
    out = {}
    for w, n in words.items():
        beside = sorted((v for v in words if near(w, v)), key=lambda v: (-words[v], v))
        form = beside[0] if beside and words[beside[0]] >= ratio * n else None
        out[w] = [w, form, None, n, len(beside), words[form] if form else None]
    for w, row in out.items():
        at = w
        while out[at][1]:
            at = out[at][1]
        row[2] = at
    return sorted(map(tuple, out.values()))


def rows(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long")


def test_all_pairs(spark):
    for seed, n, alphabet in ((1, 250, "ab"), (2, 200, "abcdefgh"), (3, 60, "a")):
        words = vocabulary(seed, n, alphabet)
        got = sorted(map(tuple, spelling_forms(rows(spark, words)).collect()), key=lambda r: r[0])
        assert got == brute(words)


def test_each_pair_once_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BUCKET_CHARS", 2_000)
    monkeypatch.setattr(spelling, "CHUNK_CHARS", 300)  # a bucket is dealt into many chunks
    words = vocabulary(4, 300)
    got = [tuple(sorted((r["word"], r["near"]))) for r in near_words(rows(spark, words)).collect()]
    want = {(a, b) for a in words for b in words if a < b and near(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_forms_lead_to_the_root(spark):
    words = {"abcdefg": 1, "abcdefgh": 10, "abcdefghi": 100, "abcdefghij": 1000, "abcdefghijk": 10_000, "abcdefghijz": 9_999}
    got = {r["word"]: (r["form"], r["root"], r["form_n"]) for r in spelling_forms(rows(spark, words)).collect()}
    assert got["abcdefg"] == ("abcdefgh", "abcdefghijk", 10)
    assert got["abcdefghijk"] == (None, "abcdefghijk", None) and got["abcdefghijz"] == (None, "abcdefghijz", None)


def test_ties_go_to_the_smallest_code_point(spark):
    got = {r["word"]: r["form"] for r in spelling_forms(rows(spark, {"zzzzzzz": 1, "zzzzzzé": 50, "zzzzzzb": 50, "zzzzzzzÿ": 50})).collect()}
    assert got["zzzzzzz"] == "zzzzzzb"


def test_defined_cases(spark):
    df = spark.createDataFrame([(None, 5, "x"), ("abcdefg", None, "x"), ("abcdefh", 2, "x"), ("abcdefh", 3, "x"), ("short", 9, "x"), ("", 1, "x"), ("q" * 30_000, 4, "x")], "word string, n long, root string")
    got = sorted(map(tuple, spelling_forms(df).collect()))
    assert got == [("abcdefh", None, "abcdefh", 5, 0, None), ("q" * 30_000, None, "q" * 30_000, 4, 0, None)]
    assert spelling_forms(df.limit(0)).count() == 0


def test_automaton():
    words = sorted(vocabulary(7, 400, "abc"))
    a = Automaton.build(words)
    assert len(a.first) - 1 < sum(map(len, words)) // 3  # suffixes are shared
    q, k = a.one_error(words, __import__("numpy").array([len(w) // 2 for w in words]))
    got = sorted(zip((words[i] for i in q.tolist()), (words[i] for i in k.tolist())))
    want = sorted((w, v) for w in words for v in words if near(w, v) and len(v) >= len(w) and v[: len(w) // 2] == w[: len(w) // 2])
    assert got == want


def test_typed_words(spark):
    docs = frame(spark)
    import re

    upper = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    want = Counter()
    for row in docs.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", row["text"] or ""):
            run = run.translate(upper)
            h = zlib.crc32(f"{'' if row['doc_id'] is None else row['doc_id']}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    assert {r["word"]: r["n"] for r in typed_words(docs).collect()} == want


def test_twin(spark):
    compare(spark, queries.QUERIES["op12_spelling_automata"], queries.ORACLES["op12_spelling_automata"], "sf0.001")
