"""Toxicity by compression distance.

Two zstandard dictionaries are made, one trained on ordinary text and one of the passages
that set toxic text apart; the toxic one rests on the ordinary one, so that what
both explain cancels out. Every window of eight words is compressed under
both. The bytes that the toxic dictionary saves and the windows in which it saves any,
set against the windows' number, go through thresholds and weights calibrated on the
training rows into a probability.

A passage is the beginning of a word, of four bytes or more, or the whole word. A likelihood-ratio test over rows
tells which passages set toxic rows apart; of those that a word has, the one that saves most bytes over all rows
goes into the toxic dictionary, and the whole word too where it is common enough.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import beside, fold, small, spare

#: Labelled rows that the dictionaries and the calibration learn from, at most.
SAMPLE_ROWS = 6_000
WINDOW_WORDS = 8
ORDINARY_BYTES, TOXIC_BYTES = 12_288, 4_096
#: Bytes saved from which a window counts.
STEPS = (1, 2, 3, 4)
#: A passage is toxic from this log-odds ratio on and, with 300 rows, this doubled log-likelihood ratio.
LEAST_ODDS, LEAST_GAIN = 1.5, 20.0
#: Bytes that a match itself costs; share of the toxic rows from which a whole word is a passage of its own.
MATCH_COST, WHOLE_SHARE = 3, 0.05
#: Bytes of labelled texts that the driver takes for fitting, at most, and of one of them. A longer text is not learned from; no other row is lost by it.
SAMPLE_BYTES, SAMPLE_TEXT = 64 << 20, 1 << 20
OUT = ["held_out", "score", "predicted"]
_EDGE = b".,;:!?#*$%&|<>\"'()[]{}-"


def _words(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split() if text else []


def _passages(word: bytes) -> list[bytes]:
    """The word as it stands between spaces, and its beginnings of four to eight bytes."""
    w = word.strip(_EDGE)
    return [b" " + w + b" ", *(b" " + w[:n] for n in range(4, 9) if len(w) > n)] if w else []


def windows(words: list[bytes], n: int = WINDOW_WORDS) -> list[bytes]:
    return [b" " + b" ".join(words[k : k + n]) + b" " for k in range(0, len(words), n)]


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the distinct samples themselves where they are too few to train on."""
    whole = b"".join(dict.fromkeys(samples))
    if len(whole) <= size:
        return whole
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()[-size:]
    except zstandard.ZstdError:
        return whole[-size:]


@dataclass
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_pair"}

    def pair(self):
        if not hasattr(self, "_pair"):
            how = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_GREEDY, min_match=4, window_log=15, hash_log=14, chain_log=15, search_log=6, target_length=64, write_content_size=False, write_checksum=False, write_dict_id=False)
            self._pair = tuple(zstandard.ZstdCompressor(compression_params=how, dict_data=zstandard.ZstdCompressionDict(d.rjust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress for d in (self.ordinary, self.toxic + self.ordinary))
        return self._pair

    def features(self, text: str | None) -> list[float]:
        a, b = self.pair()
        gain = [len(a(w)) - len(b(w)) for w in windows(_words(text))]
        n = max(1, len(gain))
        sums = [sum(g for g in gain if g >= s) for s in STEPS]
        counts = [sum(g >= s for g in gain) for s in STEPS]
        by_bytes = [*(s / n for s in sums), *(s / math.sqrt(n) for s in sums), *(math.log1p(s) for s in sums)]
        by_windows = [*(c / n for c in counts), *(math.sqrt(c / n) for c in counts), *(math.log1p(c) for c in counts)]
        return [*by_bytes, *by_windows, math.log(n)]

    def score(self, rows: list[list[float]]) -> np.ndarray:
        x = (np.array(rows) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first weight is the constant."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, pen = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    pen[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pen), x.T @ (y - p) - pen * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def originals(texts: list[str | None]) -> list[int]:
    """Numbers of the texts that share neither the least nor the greatest hash of their five-word runs with an earlier text.

    A copied text would count every one of its words as often as it was copied.
    """
    seen: set[tuple[int, int]] = set()
    out = []
    for i, text in enumerate(texts):
        w = _words(text)
        runs = [zlib.crc32(b" ".join(w[k : k + 5])) for k in range(max(1, len(w) - 4))]
        own = {(0, min(runs)), (1, max(runs))}
        if not own & seen:
            out.append(i)
        seen |= own
    return out


def fit(texts: list[str | None], toxic: list[int]) -> ToxicityModel:
    """Trains dictionaries and calibration on the texts that are no copies; without both classes nothing is known and every score is next to 0."""
    own = originals(texts)
    texts, toxic = [texts[i] for i in own], [toxic[i] for i in own]
    y = np.array(toxic, float)
    n_pos, n_neg = int(y.sum()), int(len(y) - y.sum())
    pos: Counter = Counter()
    for text, t in zip(texts, toxic):
        if t:
            pos.update({p for x in set(_words(text)) for p in _passages(x)})
    pos = Counter({p: a for p, a in pos.items() if a >= max(3, 0.004 * n_pos)})
    neg: Counter = Counter()
    plain: list[bytes] = []
    for text, t in zip(texts, toxic):
        if not t:
            words = _words(text)
            neg.update({p for x in set(words) for p in _passages(x) if p in pos})
            plain += windows(words, 24)
    # more rows bring more passages to test, so the bar rises with them
    bar = LEAST_GAIN * (1 + max(0.0, math.log10(max(1, len(y)) / 300)))
    telling = set()
    for p, a in pos.items():
        b = neg[p]
        odds = math.log((a + 0.5) / (n_pos - a + 0.5)) - math.log((b + 0.5) / (n_neg - b + 0.5))
        share = (a + b) / (n_pos + n_neg)
        gain = 2 * (a * math.log(a / (share * n_pos)) + (b * math.log(b / (share * n_neg)) if b else 0.0))
        if odds > LEAST_ODDS and gain > bar:
            telling.add(p)
    spans: Counter = Counter()
    for text, t in zip(texts, toxic):
        for x in _words(text) if t else ():
            own = [p for p in _passages(x) if p in telling]
            if own:
                spans[max(own, key=lambda p: pos[p] * (len(p) - MATCH_COST))] += 1
                whole = max(own, key=len)
                if pos[whole] >= WHOLE_SHARE * n_pos:
                    spans[whole] += 1
    if not spans:
        spans.update(x for text, t in zip(texts, toxic) if t for x in windows(_words(text), 24))
    # the most frequent passage stands last, nearest to the window
    ordered = [p for p, _ in sorted(spans.items(), key=lambda x: (x[1], x[0]))]
    model = ToxicityModel(_dictionary(plain, ORDINARY_BYTES), _dictionary(ordered, TOXIC_BYTES))
    x = np.array([model.features(t) for t in texts]) if texts else np.zeros((0, 6 * len(STEPS) + 1))
    model.mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    model.scale = np.maximum(x.std(axis=0), 1e-6) if len(x) else np.ones(x.shape[1])
    if 0 < y.sum() < len(y):
        model.weights = logistic((x - model.mean) / model.scale, y)
    else:
        model.weights = np.concatenate([[-30.0], np.zeros(x.shape[1])])
    return model


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, rows: int, ids: str = "doc_id", text: str = "text", most_bytes: int = SAMPLE_BYTES, most_text: int = SAMPLE_TEXT) -> list[tuple[str | None, int]]:
    """(text, label) of at most `rows` labelled ids outside the held-out fold, those with the smallest hashes, and no more than `most_bytes` of text.

    An id that repeats gives its smallest text, so the driver takes one text per id. Texts of more than `most_text` bytes are not
    taken, and they take no room from others: `most_bytes` only ends the sample after that many bytes of shorter texts.
    """
    picked = (
        labels.where(F.col(label).isNotNull() & F.col(ids).isNotNull())
        .where(fold(ids, folds) != held)
        .groupBy(F.col(ids).alias("_id"))
        .agg(F.max(label).alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(rows)
    )
    texts = docs.select(F.col(ids).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(picked), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_label").alias("_label"))
    # the window is over at most `rows` rows of at most `most_text` bytes
    sized = texts.where(F.coalesce(F.octet_length("_text"), F.lit(0)) <= most_text).withColumn("_bytes", F.sum(F.coalesce(F.octet_length("_text"), F.lit(0))).over(Window.orderBy(F.xxhash64("_id"), "_id")))
    got = sized.where(F.col("_bytes") <= most_bytes).select("_id", "_text", "_label").collect()
    return [(r["_text"], int(r["_label"])) for r in sorted(got, key=lambda r: (r["_id"], r["_text"] or ""))]


def _score(model: ToxicityModel, cut: float, at: int, n: int):
    def run(it):
        for batch in small(it):
            texts = batch.column(at).to_pylist()
            score = model.score([model.features(t) for t in texts]) if texts else np.zeros(0)
            cols = [batch.column(i) for i in range(n)]
            yield pa.record_batch([*cols, pa.array(score, pa.float64()), pa.array((score >= cut).astype(np.int32), pa.int32())], [*batch.schema.names[:n], "score", "predicted"])
        spare()

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, ids: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5, held: int = 0, sample_rows: int = SAMPLE_ROWS, cut: float = 0.5, only: list[str] | None = None) -> DataFrame:
    """docs (or the columns in `only`), plus held_out boolean, score double in 0..1 and predicted int (score >= cut).

    Learns from at most sample_rows labelled rows whose crc32 of the id modulo `folds` is not `held` (at most SAMPLE_BYTES of text, none
    over SAMPLE_TEXT). A null or wordless text is scored like any other text without savings. A null id is in fold 0. With no usable label, or one class
    only, nothing tells toxic from ordinary text: every score is next to 0 and no row is predicted toxic. Repeated rows are scored alike, an empty table gives none, and a
    text may be of any length. Input columns named like an output are replaced.
    """
    rows = labelled(docs, labels, label, folds, held, sample_rows, ids, text)
    model = fit([r[0] for r in rows], [r[1] for r in rows])
    base, at, n = beside(docs, OUT, text, only, ((fold(ids, folds) == held).alias("held_out"),))
    schema = T.StructType([*base.schema.fields[:n], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return base.mapInArrow(_score(model, cut, at, n), schema)
