"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Tokens are runs of letters and digits, and runs of other visible characters.
The features of a text are the hashed tokens, token pairs and repeats of four-token runs
(all repeats share one slot), each with its share of the text's tokens and pairs; the score is the logistic of a sparse dot product. The
per-coordinate learner keeps weights at zero until the evidence outweighs its L1 term.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import batches, hash_ranges, mix64
from .tables import beside, fold, small
from .toxicity import labelled

BITS = 18
#: Labelled rows that the weights learn from, at most, and passes over them.
SAMPLE_ROWS, PASSES = 8_000, 4
OUT = ["held_out", "score", "predicted"]
_SALT = np.uint64(0xA0761D6478BD642F)


def _kinds() -> np.ndarray:
    """0 white space and controls, 1 letters, digits and non-ASCII bytes, 2 other visible characters."""
    out = np.ones(256, np.uint8)
    out[:33] = 0
    for b in range(33, 128):
        out[b] = 1 if chr(b).isalnum() else 2
    return out


_KINDS = _kinds()


class Tokens:
    """Hashes of all tokens of a batch of texts, with the text of each."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode("utf-8", "surrogatepass").replace(b"\n", b" ") for t in texts]
        arr = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        kind = _KINDS[arr]
        edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        start = np.concatenate([[0], edge])
        end = np.concatenate([edge, [len(arr)]])
        full = kind[start] > 0
        self.start, self.end = start[full], end[full]
        stop = np.cumsum([len(r) + 1 for r in raw])
        self.doc = np.searchsorted(stop, self.start, "right")
        self.hash = hash_ranges(arr, self.start, self.end)


def features(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, slot, value) of every feature occurrence; the values of tokens and pairs of a text sum to 1. Slot 0 holds the repeats."""
    t = Tokens(texts)
    same = t.doc[1:] == t.doc[:-1]
    pair = mix64(t.hash[:-1] * _SALT + t.hash[1:])
    whole = t.doc[3:] == t.doc[:-3]
    four = mix64(pair[:-2] * _SALT + pair[2:])[whole] if len(pair) > 2 else np.zeros(0, np.uint64)
    where = t.doc[:-3][whole]
    # one sort of runs marked with their text; equal neighbours are repeats
    order = np.argsort(four ^ mix64(where.astype(np.uint64)))
    f, w = four[order], where[order]
    again = w[1:][(f[1:] == f[:-1]) & (w[1:] == w[:-1])]
    doc = np.concatenate([t.doc, t.doc[:-1][same], again])
    slot = np.concatenate([(np.concatenate([t.hash, pair[same]]) >> np.uint64(64 - bits)).astype(np.int64), np.zeros(len(again), np.int64)])
    n = np.bincount(t.doc, minlength=len(texts)) * 2 - 1
    return doc, slot, 1.0 / n[doc] if len(doc) else np.zeros(0)


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Whole texts, in sub-batches of about a megabyte."""
        out = np.zeros(len(texts))
        for lo, hi in batches([len(t or "") for t in texts]):
            doc, slot, value = features(texts[lo:hi])
            out[lo:hi] = np.bincount(doc, self.weights[slot] * value, hi - lo) + self.bias
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(texts: list[str | None], labels: list[int], bits: int = BITS, passes: int = PASSES, alpha: float = 10.0, beta: float = 1.0, l1: float = 0.01, l2: float = 0.0) -> QualityModel:
    """One follow-the-regularised-leader step per text, in an order that a fixed seed shuffles."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0
    rows = []
    for lo, hi in batches([len(t or "") for t in texts]):
        doc, slot, value = features(texts[lo:hi], bits)
        order = np.argsort(doc, kind="stable")
        cuts = np.searchsorted(doc[order], np.arange(1, hi - lo))
        for s, v in zip(np.split(slot[order], cuts), np.split(value[order], cuts)):
            u, inv = np.unique(s, return_inverse=True)
            rows.append((u, np.bincount(inv, v) if len(u) else np.zeros(0)))
    rng = np.random.default_rng(11)

    def weight(at):
        zz, nn = z[at], n[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    for _ in range(passes if rows else 0):
        for i in rng.permutation(len(rows)):
            u, v = rows[i]
            v = v * SCALE
            w = weight(u)
            wb = -zb / ((beta + nb**0.5) / 0.5)
            p = 1 / (1 + np.exp(-np.clip(w @ v + wb, -30, 30)))
            g = (p - labels[i]) * v
            z[u] += g - (np.sqrt(n[u] + g * g) - np.sqrt(n[u])) / alpha * w
            n[u] += g * g
            gb = p - labels[i]
            zb += gb - ((nb + gb * gb) ** 0.5 - nb**0.5) / 0.5 * wb
            nb += gb * gb
    return QualityModel(weight(np.arange(1 << bits)) * SCALE, float(-zb / ((beta + nb**0.5) / 0.5)))


#: Factor on the feature shares, so that a step of the learner moves a text's score noticeably.
SCALE = 10.0


def _score(model: QualityModel, cut: float, at: int, n: int):
    def run(it):
        for batch in small(it):
            score = model.score(batch.column(at).to_pylist())
            cols = [batch.column(i) for i in range(n)]
            yield pa.record_batch([*cols, pa.array(score, pa.float64()), pa.array((score >= cut).astype(np.int32), pa.int32())], [*batch.schema.names[:n], "score", "predicted"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, ids: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 4, held: int = 2, sample_rows: int = SAMPLE_ROWS, cut: float = 0.7, only: list[str] | None = None) -> DataFrame:
    """docs (or the columns in `only`), plus held_out boolean, score double in 0..1 and predicted int (score >= cut).

    Learns from at most sample_rows labelled rows whose crc32 of the id modulo `folds` is not `held` (at most toxicity.SAMPLE_BYTES of text,
    none over toxicity.SAMPLE_TEXT). A null or empty text has no feature and gets the score of the constant. A null id is in fold 0. Without labels every score is 0.5.
    Repeated rows are scored alike, an empty table gives none, and a text may be of any length.
    Input columns named like an output are replaced.
    """
    rows = labelled(docs, labels, label, folds, held, sample_rows, ids, text)
    model = fit([r[0] for r in rows], [r[1] for r in rows])
    base, at, n = beside(docs, OUT, text, only, ((fold(ids, folds) == held).alias("held_out"),))
    schema = T.StructType([*base.schema.fields[:n], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return base.mapInArrow(_score(model, cut, at, n), schema)
