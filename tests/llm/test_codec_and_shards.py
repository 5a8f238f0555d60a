import random
import zlib
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

import public_tokenizers
from tests.llm.corpus import documents, frame
from tests.oracle import ROOT
from tracewell.llm import decontaminate, kd_shard, lexicon_bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "  ", "Hello  wörld, it's THE\n#1 naïve 12 été!! <|endoftext|> foo   bar​ ẞ İ 日本 ΑΣ Σ ΣΑ", "a\x1cb\x1d c\x85d\xa0e", "don't I'll WE'VE they'd '' 's", "é Å ﬁ ½ ² ٣ Ⅷ", "<|startoftext|><|endoftext|>x<|end", "x" * 5000, "😀😀 a😀b", "\x00\x01 \x7f", "ǅ ŉ ß STRASSE", " 　x", "_a_b__ 1_2", "a‍b‌c ﻿", "กำ क्षि"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_codec_equals_library(spark, library):
    rows = documents() + [(500 + i, t, *[None] * 6) for i, t in enumerate(ODD)]
    got = lexicon_bpe.bpe_codec(frame(spark, rows), PATH).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[(i, tuple(ids), library.decode(ids, skip_special_tokens=False))] += 1
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == want
    assert lexicon_bpe.bpe_codec(frame(spark, []), PATH).count() == 0


def test_lexicon_does_not_change_results():
    with open(PATH) as f:
        spec = f.read()
    r = random.Random(4)
    texts = [" ".join("".join(r.choice("aeiouthsn") for _ in range(r.randint(1, 9))) for _ in range(50)) for _ in range(20)]
    plain, quick = lexicon_bpe.Bpe(spec), lexicon_bpe.Bpe(spec, lexicon_bpe.compile_lexicon(spec, texts[:10]))
    assert [plain.encode(t) for t in texts] == [quick.encode(t) for t in texts]


def test_lexicon_comes_from_the_vocabulary_and_not_from_rows(spark, library):
    sc = spark.sparkContext
    docs = frame(spark, documents())
    sc.setJobGroup("lexicon", "no row is read before the codec runs")
    try:
        lexicon_bpe.bpe_codec(docs, PATH)
        assert not sc.statusTracker().getJobIdsForGroup("lexicon")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    with open(PATH) as f:
        spec = f.read()
    lexicon, words = lexicon_bpe.Lexicon.mapped(lexicon_bpe.compile_lexicon(spec)), lexicon_bpe.vocabulary_words(lexicon_bpe.Bpe(spec))
    assert len(words) > 20_000
    for w in words[::97]:
        if lexicon_bpe.Bpe.split(w) == [w]:
            assert lexicon.get(w.encode()) == library.encode(w, add_special_tokens=False).ids


def test_automaton_is_minimal_and_exact():
    words = {w.encode(): [n] for n, w in enumerate(["talking", "walking", "king", "talk", "walk", "walked", "talked", "a"])}
    lex = lexicon_bpe.Lexicon.mapped(lexicon_bpe.Lexicon.build(words).to_bytes())
    assert {w: lex.get(w) for w in words} == words
    assert all(lex.get(w) is None for w in (b"", b"tal", b"walks", b"z"))
    languages = set()
    for w in sorted(words):
        for k in range(len(w) + 1):
            languages.add(frozenset(x[k:] for x in words if x[:k] == w[:k]))
    assert lex.n_states == len(languages)


def edit_search(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_myers_equals_dynamic_programme():
    r = random.Random(5)
    for _ in range(300):
        p = "".join(r.choice("abc") for _ in range(r.randint(1, 90)))
        t = "".join(r.choice("abc") for _ in range(r.randint(0, 60)))
        assert decontaminate.myers(p, t)[0] == edit_search(p, t)


def whole_words_distance(item, text):
    """Least edit distance of the item to any stretch of the text that cuts no word, by a plain table."""
    best = len(item) + 1
    for s in range(len(text) + 1):
        if not decontaminate.between(text, s):
            continue
        part = text[s : s + 2 * len(item) + 2]
        row = list(range(len(part) + 1))
        for i, p in enumerate(item, 1):
            new = [i]
            for j, t in enumerate(part, 1):
                new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
            row = new
        best = min([best] + [d for j, d in enumerate(row) if decontaminate.between(text, s + j)])
    return best


def test_leaks_equal_brute_force(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(2, 7)))
    # items of 5 to 39 characters and longer ones, under the one law
    items = [(i, " ".join(word() for _ in range(r.randint(14, 20)))) for i in range(3)] + [(10 + n, " ".join(word() for _ in range(n))[: 5 + 6 * n].strip()) for n in range(1, 6)] + [(6, "short Item"), (7, None), (8, "")]
    rows = [(i, " ".join(word() for _ in range(30)), *[None] * 6) for i in range(4)]
    for i, t in items[:8]:
        for edits in range(3):
            s = list(t.upper())
            for _ in range(edits):
                k = r.randrange(len(s))
                s[k] = r.choice(("", "#", s[k] + "q"))
            rows.append((100 + 10 * i + edits, f"{word()} {word()}\n {''.join(s)}  {word()}", *[None] * 6))
    rows += [(900, f"glued{items[0][1]}", *[None] * 6), (901, f"{items[1][1]}ed on", *[None] * 6)]
    rows += [(200, "has a short  item in it", *[None] * 6), (201, None, *[None] * 6), (202, "", *[None] * 6), (None, items[0][1], *[None] * 6), (100, items[0][1], *[None] * 6), (203, "noise " * 20_000 + items[2][1], *[None] * 6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t, *_ in rows:
        for i, x in items:
            c, x = decontaminate.canonical(t)[-500:], decontaminate.canonical(x)
            if x and whole_words_distance(x, c) <= decontaminate.budget(len(x)):
                want.add((d, i))
    for size in (60, 4_000_000):  # many blocks, one block
        got = decontaminate.find_leaks(frame(spark, rows), bench, block_chars=size).collect()
        assert {(g.doc_id, g.item_id) for g in got} == want
    assert any(g.edits > 0 for g in got) and (203, 2) in want
    docs = frame(spark, [*rows, rows[0]]).withColumnRenamed("score", "leak_id")
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert Counter(c.doc_id for c in clean.collect()) == Counter(d for d, *_ in [*rows, rows[0]] if d is None or d not in {d for d, _ in want})
    assert decontaminate.find_leaks(frame(spark, []), bench).count() == 0
    assert decontaminate.find_leaks(frame(spark, rows), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_one_piece_survives_any_edits():
    r = random.Random(8)
    item = "".join(r.choice("abcdefghij") for _ in range(200))
    e = decontaminate.budget(len(item))
    for _ in range(200):
        s = list(item)
        for _ in range(e):
            s[r.randrange(len(s))] = r.choice(("", "z", "zz"))
        assert any(p in "".join(s) for _, p in decontaminate.pieces(item, e))


def check_shards(rows, got, tolerance):
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    size, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    texts = defaultdict(set)
    for i, t, *_ in rows:
        texts[i].add((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())))
    for r in got:
        assert (r.size if isinstance(r.size, int) else int(r.size), r.text_crc32) in texts[r.doc_id]
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 24
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        homes[(r.size, r.text_crc32)].add(r.shard)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    mean = sum(size.values()) / 24
    assert max(size.values()) <= mean + tolerance and (len(size) == 24 and min(size.values()) >= mean - tolerance)
    return homes


def test_shards(spark):
    folder = f"{ROOT}/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op4_kd_shards"](spark, folder).collect()
    check_shards(rows, got, max(len(r[1].encode()) + 8 for r in rows))


def test_shards_of_one_hot_group(spark):
    rows = [(i, "the same text for all", None, "s", 1, None, None, None) for i in range(2000)] + [(5000 + i, f"text number {i} " * (1 + i % 7), None, None, None, None, None, None) for i in range(600)]
    got = kd_shard.shard(frame(spark, rows)).collect()
    homes = check_shards(rows, got, 400)
    assert sum(len(v) > 1 for v in homes.values()) <= 3


def test_shards_of_awkward_rows(spark):
    rows = documents()
    got = kd_shard.shard(frame(spark, rows)).collect()
    assert len(got) == len(rows) and {"lang", "source", "n_chars"} <= set(got[0].asDict())
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    check_shards(rows, got, max(len((r[1] or "").encode()) + 8 for r in rows)) if len({r.shard for r in got}) == 24 else None
    assert all(r.law == "bytes" and r.grown_shard is None for r in got)
    assert kd_shard.shard(frame(spark, [])).count() == 0


def test_shards_divide_a_heavy_group_without_ids(spark):
    rows = [(None, "one text for all of them", None, "s", 1, None, None, None)] * 4800
    got = kd_shard.shard(frame(spark, rows)).collect()
    sizes = Counter(r.shard for r in got)
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 60


def test_short_items_cut_no_word(spark):
    items = spark.createDataFrame([(1, "yes"), (2, "(a)"), (3, "北京")], "item_id long, text string")
    texts = ["my eyes", "yesterday", "Yes.", "he said yes", "eyes, yes!", "yes_no", "ye\u0301s yes\u0301", "f(a)b", "我在北京住"]
    docs = frame(spark, [(i, t, *[None] * 6) for i, t in enumerate(texts)])
    got = {(g.doc_id, g.item_id, g.edits) for g in decontaminate.find_leaks(docs, items).collect()}
    assert got == {(2, 1, 0), (3, 1, 0), (4, 1, 0), (7, 2, 0), (8, 3, 0)}
    assert {r.doc_id for r in decontaminate.decontaminate(docs, items).collect()} == {0, 1, 5, 6}
