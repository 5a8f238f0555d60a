import pytest

import corpus_pipeline as c
from tests.llm.corpus import documents, frame
from tests.llm.test_dedup import brute_classes
from tests.oracle import ROOT
from tracewell.llm import decontaminate, near_dups, toxicity


def test_stages_take_effect(spark, tmp_path):
    folder = f"{ROOT}/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in c.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "encode"]
    for name, stage in c.STAGES:
        before = docs
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        had = {r.doc_id: r.text for r in before.select("doc_id", "text").collect()}
        assert ids <= set(had)
        if name == "toxicity":
            bad = toxicity.score_toxicity(before, spark.read.parquet(f"{folder}/labels.parquet")).where("predicted = 1").collect()
            assert set(had) - ids == {r.doc_id for r in bad}
        if name == "near_dedup":
            classes = {}
            for r in near_dups.near_duplicates(before).collect():
                classes.setdefault(r.class_id, set()).add(r.doc_id)
            assert ids == {min(v) for v in classes.values()}
        if name == "substring_dedup":
            assert ids == set(had)
            now = {r.doc_id: r.text for r in docs.collect()}
            assert any(now[i] != had[i] for i in ids) and all(len(now[i]) <= len(had[i]) for i in ids)
        if name == "decontamination":
            items = [decontaminate.canonical(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            for i, t in had.items():
                if any(x in decontaminate.canonical(t) for x in items):
                    assert i not in ids
        if name != "encode":
            assert docs.columns == c.COLUMNS
    assert {"ids", "decoded", "n_tokens"} <= set(docs.columns)


@pytest.mark.parametrize("name, stage", c.STAGES)
def test_stage_on_awkward_rows(spark, tmp_path, name, stage):
    """Nulls in every column, empty and very long texts, repeated rows, clashing names, then an empty table."""
    spark.createDataFrame([(i, i % 2, int(i % 5 == 1)) for i in range(20)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "an item that no text holds at all"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = documents()
    rows += [(700, "word " * 200_000, None, None, None, None, None, None), (None, None, None, None, None, None, None, None), rows[0]]
    extra = frame(spark, rows).withColumnsRenamed({"score": "gone_id", "class_id": "predicted", "size": "ids"})
    got = stage(spark, extra, str(tmp_path))
    if name == "encode":
        assert {"doc_id", "ids", "decoded", "n_tokens"} <= set(got.columns)
    else:
        assert got.columns == c.COLUMNS
    out = got.collect()
    ids = [r.doc_id for r in out]
    assert set(ids) <= {r[0] for r in rows} and ids.count(None) == 2
    if name in ("substring_dedup", "decontamination", "encode"):
        assert len(out) == len(rows)
    nulls = {i for i, t, *_ in rows if t is None}
    assert nulls <= set(ids)
    if name == "near_dedup":
        want = brute_classes([r for r in rows if r[0] != 700])
        assert set(ids) - {None, 700} == {i for i, k in want.items() if i == k}
    assert stage(spark, extra.limit(0), str(tmp_path)).count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 1, 1), (2, 0, 1)], [(1, None, None)]])
def test_no_document_goes_without_usable_labels(spark, tmp_path, labels):
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame(spark).select(*c.COLUMNS)
    assert c.toxicity(spark, docs, str(tmp_path)).count() == docs.count()


def test_run(spark):
    assert c.run(spark, f"{ROOT}/sf0.001").count() > 0
