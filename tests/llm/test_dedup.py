import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.corpus import documents, frame
from tracewell.llm import near_dups, substring_dedup
from tracewell.llm.components import components


def brute_substrings(rows, k=13):
    first = {}
    for i, t in [(r[0], r[1]) for r in rows]:
        w = (t or "").encode().split()
        for p in range(len(w) - k + 1):
            key = tuple(w[p : p + k])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in [(r[0], r[1]) for r in rows]:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - k + 1):
            if i is not None and first[tuple(w[p : p + k])] < i:
                gone[p : p + k] = [True] * k
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i if i is not None else -1, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("chunk", [2_000, 8 << 20])
def test_substrings_equal_brute_force(spark, chunk):
    rows = documents()
    got = substring_dedup.dedup_substrings(frame(spark, rows), chunk_bytes=chunk)
    assert set(got.columns) == {"doc_id", "lang", "source", "n_chars", "score", "class_id", "size", "n_words", "n_removed", "kept_text", "kept_sha256"}
    data = got.collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept_sha256) for r in data) == brute_substrings(rows)
    for r in data:
        assert hashlib.sha256(" ".join((r.kept_text or "").encode().decode().split()).encode()).hexdigest() == r.kept_sha256 or " " in r.kept_text
    assert any(r.n_removed for r in data)


def test_substrings_of_nothing(spark):
    assert substring_dedup.dedup_substrings(frame(spark, [])).count() == 0


def brute_classes(rows, least=0.8):
    docs = defaultdict(set)
    for i, t, *_ in rows:
        if i is not None:
            docs[i].add(tuple((t or "").encode().split()))
    bag = lambda w: Counter(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else Counter([w])
    up = {i: i for i in docs}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(docs)
    for x in ids:
        for y in ids:
            if x < y and any(a and b and near_dups.overlap(bag(a), bag(b)) >= least for a in docs[x] for b in docs[y]):
                a, b = top(x), top(y)
                up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    rows = documents()
    got = near_dups.near_duplicates(frame(spark, rows).drop("class_id")).collect()
    assert len(got) == len(rows)
    want = brute_classes(rows)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    assert [r.class_id for r in got if r.doc_id is None] == [None]
    assert max(r.class_size for r in got) >= 3
    assert {r.doc_id for r in got if r.n_links} >= {2}


def test_near_duplicates_of_nothing(spark):
    assert near_dups.near_duplicates(frame(spark, [])).count() == 0
    lone = [(1, "a b c d e f g", None, None, None, None, None, None), (2, None, None, None, None, None, None, None)]
    got = near_dups.near_duplicates(frame(spark, lone)).collect()
    assert sorted((r.doc_id, r.class_id, r.class_size, r.n_links) for r in got) == [(1, 1, 1, 0), (2, 2, 1, 0)]


def test_large_group_of_near_copies(spark):
    base = [f"w{k}" for k in range(120)]
    rows = [(0, " ".join(base), *[None] * 6)]
    for i in range(1, 60):
        w = list(base)
        w[i], w[(7 * i) % 120] = f"x{i}", f"y{i}"
        rows.append((i, " ".join(w), *[None] * 6))
    got = near_dups.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(rows)


def test_planted_near_copies_are_all_found(spark):
    """Edits of one to eight words in texts of 60 to 200: every link that brute force finds at 0.8 is met."""
    r = random.Random(4)
    rows, links = [], 0
    for g in range(40):
        base = [f"g{g}w{r.randrange(400)}" for _ in range(r.randrange(60, 200))]
        for k in range(5):
            w = list(base)
            for _ in range(r.randrange(0, 4) if k else 0):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w), *[None] * 6))
    got = {r.doc_id: r.class_id for r in near_dups.near_duplicates(frame(spark, rows)).collect()}
    want = brute_classes(rows)
    links = sum(a != b for a, b in want.items())
    assert links > 80
    assert got == want


def test_one_large_class_among_strangers(spark):
    """Texts at 0.6 to the group share bands with it; only true links join."""
    base = [f"w{k}" for k in range(100)]
    rows = []
    for i in range(50):
        w = list(base)
        w[i] = f"x{i}"
        rows.append((i, " ".join(w), *[None] * 6))
    for i in range(50, 60):
        w = list(base)
        for k in range(0, 100, 18):
            w[k] = f"y{i}{k}"
        rows.append((i, " ".join(w), *[None] * 6))
    got = {r.doc_id: r.class_id for r in near_dups.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_classes(rows)


def test_clashing_names_are_replaced_or_kept(spark):
    rows = documents()
    df = frame(spark, rows).withColumnsRenamed({"score": "_near_id", "size": "near_id", "lang": "n_links"})
    got = near_dups.near_duplicates(df)
    assert got.columns == ["doc_id", "text", "source", "n_chars", "_near_id", "near_id", "class_id", "class_size", "n_links"]
    assert {r.doc_id: r.class_id for r in got.collect() if r.doc_id is not None} == brute_classes(rows)


def test_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    a = rng.integers(1, 2**62, 400).astype(np.uint64)
    na = rng.integers(1, 5, 400)
    b, nb = a.copy(), na.copy()
    nb[:80] += rng.integers(0, 6, 80)
    b[300:] = rng.integers(1, 2**62, 100).astype(np.uint64)
    da, db = dict(zip(a.tolist(), na)), dict(zip(b.tolist(), nb))
    both = sum(min(n, db.get(x, 0)) for x, n in da.items())
    want = both / (sum(da.values()) + sum(db.values()) - both)
    sig = near_dups.bag_minhash(np.r_[np.zeros(400, int), np.ones(400, int)], np.r_[a, b], np.r_[na, nb], 2)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.09
    again = near_dups.bag_minhash(np.zeros(400, int), a[::-1], na[::-1], 1)
    assert (again[0] == sig[0]).all()


def test_components(spark):
    e = [(5, 4), (4, 3), (9, 8), (3, 1), (8, 9), (7, 7)] + [(100 + i, 101 + i) for i in range(40)]
    got = dict(map(tuple, components(spark.createDataFrame(e, "u long, v long")).collect()))
    assert got == {5: 1, 4: 1, 3: 1, 1: 1, 9: 8, 8: 8} | {100 + i: 100 for i in range(41)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_ids_that_are_no_numbers_count_as_null(spark):
    """Such a row is a class of its own, is scanned for leaks, and gets a shard like any other."""
    from tracewell.llm import decontaminate, kd_shard, near_dups

    long = "one passage that both of these rows hold word for word " * 4
    docs = spark.createDataFrame([("abc", long), ("7", long), ("8", "something else entirely")], "doc_id string, text string")
    classes = sorted((r.doc_id, r.class_id, r.class_size) for r in near_dups.near_duplicates(docs).collect())
    assert classes == [("7", 7, 1), ("8", 8, 1), ("abc", None, 1)]
    items = spark.createDataFrame([(1, long)], "item_id int, text string")
    assert sorted((r.doc_id or -1, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()) == [(-1, 1), (7, 1)]
    assert kd_shard.shard(docs).count() == 3
