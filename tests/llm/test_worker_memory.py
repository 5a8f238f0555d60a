"""What a worker holds at once, and what it leaves to the stage after: two workers and a JVM share an executor's memory."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.oracle import ROOT
from tracewell.llm import decontaminate, lexicon_bpe, near_dups, substring_dedup, toxicity


def texts(n_bytes: int) -> pa.Table:
    """Rows of sf0.1 with so many bytes of text."""
    table = pq.read_table(f"{ROOT}/sf0.1/documents.parquet", columns=["doc_id", "text"])
    have = np.cumsum([len(t or "") for t in table.column("text").to_pylist()])
    return table.slice(0, int(np.searchsorted(have, n_bytes)) + 1).combine_chunks()


def peak_mb(f) -> float:
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("f", [near_dups._sign, near_dups._squeeze])
def test_signatures_hold_few_points_at_once(f):
    batches = texts(1 << 20).to_batches()
    assert peak_mb(lambda: [None for _ in f(iter(batches))]) < 40


def test_points_at_once_change_no_signature(monkeypatch):
    rng = np.random.default_rng(5)
    doc, h, n = np.repeat(np.arange(40), 200), rng.integers(0, 2**63, 8_000).astype(np.uint64), rng.integers(1, 9, 8_000)
    want = near_dups.bag_minhash(doc, h, n, 40)
    for points in (1, 1_000, 1 << 20):
        monkeypatch.setattr(near_dups, "POINTS", points)
        if points > 1:
            assert (near_dups.bag_minhash(doc, h, n, 40) == want).all()
        else:
            assert (near_dups.bag_minhash(doc[:400], h[:400], n[:400], 2) == want[:2]).all()


def test_a_chunk_holds_little_beside_its_strings():
    rows = texts(2 << 20)
    assert peak_mb(lambda: substring_dedup._Chunk(rows, "doc_id", "text", 13)) < 29


@pytest.mark.parametrize(
    "module, run",
    [
        (near_dups, near_dups._sign),
        (near_dups, near_dups._squeeze),
        (near_dups, near_dups._verify),
        (toxicity, toxicity._score(toxicity.ToxicityModel(b"", b""), 0.5, 0, 1)),
        (decontaminate, decontaminate._scan([(1, "an item")], 6)),
        (lexicon_bpe, lexicon_bpe._run('{"model": {"vocab": {}, "merges": []}, "added_tokens": []}', b"", 0, 0, False)),
    ],
)
def test_a_task_gives_back_what_it_freed(monkeypatch, module, run):
    calls = []
    monkeypatch.setattr(module, "spare", lambda: calls.append(1))
    assert list(run(iter([]))) == [] and calls == [1]
