import os
import zlib

import numpy as np
import pytest

from tests.llm.corpus import documents, frame
from tests.oracle import ROOT, compare
from tracewell.llm import html_extract, language_id, quality_model, quality_rules, queries, toxicity

LABELS = "doc_id long, quality int, toxic int"


def labels(spark, rows=None):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 1)) for i in range(20)] if rows is None else rows, LABELS)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_twin(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLES[name])


def test_rules_on_awkward_rows(spark):
    rows = documents()
    got = quality_rules.quality(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    for i, t, *_ in rows:
        if i is None or i == 7:
            continue
        w = (t or "").encode().split()
        wins = [tuple(w[p : p + 8]) for p in range(len(w) - 7)]
        hit = [False] * len(w)
        for p, x in enumerate(wins):
            if wins.count(x) > 1:
                hit[p : p + 8] = [True] * 8
        assert (by[i].n_words, by[i].n_repeat_words) == (len(w), sum(hit)), i
        assert by[i].base_failed == (len(w) < 20 or 100 * sum(hit) > 30 * len(w))
    assert quality_rules.quality(frame(spark, [])).count() == 0


def test_rules_plan_is_one_projection(spark):
    plan = quality_rules.quality(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def folds(rows, n, held):
    return {i: zlib.crc32(str(i).encode()) % n == held for i, *_ in rows if i is not None}


@pytest.mark.parametrize("score, n, held", [(toxicity.score_toxicity, 5, 0), (quality_model.score_quality, 4, 2)])
def test_scorers_on_awkward_rows(spark, score, n, held):
    rows = documents()
    for table in (labels(spark), labels(spark, []), labels(spark, [(1, 1, 0), (None, 1, 1), (2, None, None)])):
        got = score(frame(spark, rows), table).collect()
        assert len(got) == len(rows)
        assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
        assert {r.doc_id: r.held_out for r in got if r.doc_id is not None} == folds(rows, n, held)
    assert score(frame(spark, []), labels(spark)).count() == 0


@pytest.mark.parametrize("score, n, held", [(toxicity.score_toxicity, 5, 0), (quality_model.score_quality, 4, 2)])
def test_held_out_labels_do_not_matter(spark, score, n, held):
    rows = [r for r in documents() if r[0] is not None]
    table = [(i, i % 2, i % 2) for i in range(20)]
    out = lambda i: zlib.crc32(str(i).encode()) % n == held
    flipped = [(i, 1 - q, 1 - t) if out(i) else (i, q, t) for i, q, t in table]
    assert flipped != table
    a, b = (score(frame(spark, rows), labels(spark, x)).select("doc_id", "score").collect() for x in (table, flipped))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


@pytest.mark.parametrize("table", [[], [(1, 1, 1), (2, 1, 1), (3, 0, 1)], [(1, 1, 0), (2, 1, 0)], [(1, None, None)]])
def test_nothing_is_toxic_without_both_classes(spark, table):
    rows = documents()
    got = toxicity.score_toxicity(frame(spark, rows), labels(spark, table)).collect()
    assert len(got) == len(rows) and {r.predicted for r in got} == {0} and max(r.score for r in got) < 1e-6


def test_one_long_labelled_text_takes_no_other_row(spark):
    """A text longer than all that is taken for fitting only loses itself."""
    rows = [r for r in documents() if r[0] is not None and r[0] != 7]
    table = [(i, i % 2, i % 2) for i in range(40)]
    df = frame(spark, rows).unionByName(spark.range(1).selectExpr("1000L AS doc_id", "repeat('very long text ', 4800000) AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars", "CAST(NULL AS double) AS score", "CAST(NULL AS string) AS class_id", "CAST(NULL AS string) AS size"))
    want = toxicity.labelled(frame(spark, rows), labels(spark, table), "toxic", 5, 0, 100)
    got = toxicity.labelled(df, labels(spark, [*table, (1000, 1, 1)]), "toxic", 5, 0, 100)
    assert 15 * 4_800_000 > toxicity.SAMPLE_BYTES and len(want) > 20 and got == want


@pytest.mark.parametrize("name, column, least", [("op6_ftrl_quality", "quality", 0.97), ("op7_compression_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, column, least):
    folder = f"{ROOT}/sf0.1"
    truth = {r.doc_id: r[column] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = [(r.score, truth[r.doc_id]) for r in queries.QUERIES[name](spark, folder).where("held_out").collect() if r.doc_id in truth]
    s, y = np.array([g[0] for g in got]), np.array([g[1] for g in got])
    rank = np.argsort(np.argsort(s)) + 1
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > least


def test_toxic_documents_are_caught_at_the_small_size(spark):
    """The decision at 0.5 by the held-out fold of the tables that are always here: 97 toxic rows, of which some contradict their text."""
    folder = f"{ROOT}/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic IS NOT NULL").collect()}
    got = [(r.predicted, truth[r.doc_id]) for r in queries.QUERIES["op7_compression_toxicity"](spark, folder).where("held_out").collect() if r.doc_id in truth]
    assert np.mean([p for p, t in got if t]) >= 0.8
    assert np.mean([t for p, t in got if p]) >= 0.95


def test_toxic_documents_are_caught_in_each_language(spark):
    """The decision at 0.5 over the larger labelled table, by the held-out fold. Some labels there contradict the text."""
    folder = f"{ROOT}/check_s"
    if not os.path.isdir(folder):
        pytest.skip("the larger tables are not here")
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic IS NOT NULL").collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = toxicity.score_toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet"), only=["doc_id", "lang"]).where("held_out").collect()
    rows = [(r.lang, r.predicted, truth[r.doc_id]) for r in got if r.doc_id in truth]
    hit = [p for _, p, t in rows if t]
    assert np.mean(hit) >= 0.9
    assert np.mean([t for _, p, t in rows if p]) >= 0.95
    assert all(np.mean([p for g, p, t in rows if g == lang and t]) >= 0.7 for lang in ("en", "de", "fr", "es"))


def test_language(spark):
    folder = f"{ROOT}/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.QUERIES["op9_hyperdimensional_language"](spark, folder).where("held_out").collect()
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got]) > 0.99
    rows = documents()
    out = language_id.identify_language(frame(spark, rows)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in out} <= {"en", "de", "und"}
    assert language_id.identify_language(frame(spark, [])).count() == 0
    empty = [(1, "12 34 !", None, None, None, None, None, None), (2, None, "en", None, None, None, None, None)]
    assert {(r.doc_id, r.lang_pred) for r in language_id.identify_language(frame(spark, empty)).collect()} == {(1, "und"), (2, "und")}


def test_profile_is_the_sum_of_bound_vectors():
    a = language_id.letters()
    at = language_id.trigrams("ab")
    c = language_id.classes()
    want = np.zeros(language_id.DIMENSION)
    seq = [0, int(c[ord("a")]), int(c[ord("b")]), 0]
    for x, y, z in zip(seq, seq[1:], seq[2:]):
        want += np.roll(a[x], 2) * np.roll(a[y], 1) * a[z]
    assert len(at) == 2 and np.allclose(language_id.vector("ab"), want)
    assert list(language_id.trigrams("a  1 b")) == list(language_id.trigrams("a b"))


PAGE = """<html><head><title>T</title></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav>
<article><h1>Title of it</h1><p>First &amp; second sentence of this very ordinary article text.<br>More words follow here. <p>Another paragraph
of the article, which ends here.</article>
<div class="comments"><h3>Comments</h3><div class="comment"><p>I liked this article very much, thank you for it.</p></div></div>
<form><label>Name</label><input></form><footer>&copy; Somebody 2020, all rights reserved.</footer><script>var p = "<p>no</p>";</script></body>"""


def test_html(spark):
    m = html_extract.default_model()
    assert m.extract([PAGE]) == ["Title of it\n\nFirst & second sentence of this very ordinary article text. More words follow here.\n\nAnother paragraph of the article, which ends here."]
    odd = [None, "", "plain", "<", "<p", "<a href='x", "<!-- never closed <p>x</p>", "<script>x", "&am", "<p>" * 3000, "</div></div>", "<table><tr><td>a<td>b<tr><td>c</table>", "<p title='a>b'>q</p>", "\x00<p>z"]
    df = spark.createDataFrame([(i, "u", h, "old", 1.0) for i, h in enumerate([*odd, PAGE, PAGE * 50])], "page_id long, url string, html string, text string, n_chars double")
    got = {r.page_id: r for r in html_extract.extract_main_text(df).collect()}
    assert len(got) == len(odd) + 2
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert got[0].text == got[1].text == "" and got[len(odd)].text.startswith("Title of it")
    assert html_extract.extract_main_text(df.limit(0)).count() == 0


def test_elements_without_end():
    """Raw-text elements take the rest of the page; any other element without an end is only its tag."""
    text = lambda page: [t for t in html_extract.parse(page).text if t]
    assert text("<p>a</p><button>b<p>rest of page") == ["a", "b", "rest of page"]
    assert text("<p>a</p><object data=x><p>rest</p><svg><path d='x'/></svg>z") == ["a", "rest", "z"]
    assert text("<svg><svg></svg>inner</svg><p>z") == ["z"]
    assert text("<button>go<p>kept</p><button>x</button>end") == ["go", "kept", "end"]
    assert text("<p>x<math><mi>y</mi></math></p><script>'<button>'</script><button>n</button>q") == ["xy", "q"]
    assert text("<p>a</p><script>b<p>c") == ["a"]
    assert text("<select><option>1</select><video/>v<noscript><p>no</p></noscript>") == ["v"]
    assert text("<button>" * 3000 + "end")[-1] == "end"


# Pages written by hand, none of them a layout of the generator; the first of each pair is the page, the second its article.
HAND_MADE = [
    (
        """<body><div id="wrap"><div class="top-bar"><a href="/">Paper</a> <a href="/w">World</a> <a href="/s">Sports</a></div><div role="main"><h1>Bridge reopens</h1>
<p class="lead">The old bridge over the river was opened again on Monday, two years after the flood.</p><p>Engineers had replaced all of its bearings, and the town
paid a third of the price.</p><h2>What comes next</h2><ul><li>A new path for cyclists will be built along the bank.</li><li>Lorries stay banned from the bridge until spring.</li></ul></div>
<div class="sidebar-right"><h4>Most read</h4><ol><li><a href="/1">Ten recipes</a></li><li><a href="/2">Cold winter</a></li></ol></div><div id="site-footer">Contact | Imprint | &copy; 2021 Paper</div></div></body>""",
        "Bridge reopens\n\nThe old bridge over the river was opened again on Monday, two years after the flood.\n\nEngineers had replaced all of its bearings, and the town paid a third of the price.\n\nWhat comes next\n\nA new path for cyclists will be built along the bank.\n\nLorries stay banned from the bridge until spring.",
    ),
    (
        """<html><body><header><nav><a href=/a>Start</a> <a href=/b>Archive</a></nav></header><main><article><header><h1>Notes on bread</h1></header><section><p>Flour, water and salt are all it takes, and
a good deal of patience.</p><blockquote>My grandmother never weighed a thing in her whole life.</blockquote><p>Let the dough rest for a night in a cool place before you bake it.</p></section></article>
<section id="comments"><h2>2 Comments</h2><div class="comment"><p>Thank you for this, it worked at once for me.</p></div><div class="comment"><p>Mine did not rise at all, what did I do wrong?</p></div></section></main>
<aside><form action="/n"><p>Get our letter every week.</p><input name=m><button>Go</button></form></aside><footer><p>All rights reserved by the bakers.</p></footer></body></html>""",
        "Notes on bread\n\nFlour, water and salt are all it takes, and a good deal of patience.\n\nMy grandmother never weighed a thing in her whole life.\n\nLet the dough rest for a night in a cool place before you bake it.",
    ),
    (
        """<div class="cookie-banner"><p>We use cookies to make this site better for you.</p><button>Fine</button></div><div class=container><div class="post-body"><h2>Moving to the coast</h2><p>We packed
the van in an afternoon &amp; left before it got dark.</p><p>The house was cold, but the view made up for all of it.<p>Nobody missed the city.</div><div class="ad-slot"><p>Buy two pairs of shoes and pay for one only today.</p></div>
<div class="related-posts"><h3>Related</h3><ul><li><a href="/x">Selling a flat</a></li><li><a href="/y">Vans</a></li></ul></div></div>""",
        "Moving to the coast\n\nWe packed the van in an afternoon & left before it got dark.\n\nThe house was cold, but the view made up for all of it.\n\nNobody missed the city.",
    ),
]


def test_html_model_on_hand_made_pages():
    assert html_extract.default_model().extract([p for p, _ in HAND_MADE]) == [t for _, t in HAND_MADE]


def test_html_model_on_unseen_layouts():
    m, right, total = html_extract.default_model(), 0, 0
    for page in html_extract.training_pages(60, seed=77):
        p = html_extract.parse(page)
        f = html_extract.Forest([p])
        marginal, _ = f.marginals(m.weights, m.edges)
        for k, s in enumerate(p.text):
            if s:
                total += 1
                right += (marginal[k] >= 0.5) == bool(p.label[k])
    assert right / total > 0.97


def test_messages_equal_enumeration():
    p = html_extract.parse("<div class=nav><p>some words here</p><p>more words, and a lot of them, in one place.</p></div>")
    rng = np.random.default_rng(2)
    w, e = rng.normal(size=len(html_extract._FEATURES)), rng.normal(size=(len(html_extract.EDGES), 2, 2))
    f = html_extract.Forest([p])
    unary = np.bincount(f.node, w[f.feat], f.n)
    total, mass = 0.0, np.zeros(f.n)
    for bits in range(1 << f.n):
        x = [(bits >> k) & 1 for k in range(f.n)]
        v = np.exp(sum(unary[k] * x[k] for k in range(f.n)) + sum(e[f.kind[k]][x[f.parent[k]]][x[k]] for k in range(f.n) if f.parent[k] >= 0))
        total += v
        mass += v * np.array(x)
    assert np.allclose(f.marginals(w, e)[0], mass / total)


def test_ordinary_dictionary_sees_every_clean_row(monkeypatch):
    texts = [f"plain{k} " * 24 for k in range(41_000)] + [f"später{k} Wort" for k in range(50)]
    seen = []
    monkeypatch.setattr(toxicity, "_dictionary", lambda samples, size: seen.append(len(samples)) or b"".join(dict.fromkeys(samples))[-size:])
    model = toxicity.fit(texts, [0] * len(texts))
    assert len(texts) in seen
    assert "später49".encode() in model.ordinary
