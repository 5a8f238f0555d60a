"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram is bound by multiplying
its letters' vectors, the first rolled by two places and the second by one; a text
is the sum of its trigrams' vectors, and a language the sum of its training
texts, each with the same weight. A text takes the language whose prototype has the largest cosine.

A text's vector is its trigram counts times the table of bound vectors, so one
pass over the letters counts trigrams and the binding is paid per distinct
trigram.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import beside, fold, small

DIMENSION = 512
#: Letter classes: 0 between words, 1-26 a-z, the others share the rest by a hash.
CLASSES = 40
#: Training texts per language, at most about.
SAMPLE_ROWS = 2_000
OUT = ["held_out", "lang_pred", "score"]


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Letter class of every code point of the basic plane; 255 marks combining marks, which are skipped."""
    out = np.zeros(65536, np.uint8)
    for c in range(65536):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind[0] == "L":
            low = ord(ch.lower()[0])
            out[c] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 % 2**32 >> 7) % (CLASSES - 27)
        elif kind[0] == "M":
            out[c] = 255
    return out


@lru_cache(maxsize=1)
def letters(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (CLASSES, DIMENSION))


@lru_cache(maxsize=1)
def bound() -> np.ndarray:
    """int8 (CLASSES**3, DIMENSION): the vector of each trigram."""
    a = letters()
    two, one = np.roll(a, 2, axis=1), np.roll(a, 1, axis=1)
    return (two[:, None, None, :] * one[None, :, None, :] * a[None, None, :, :]).reshape(CLASSES**3, DIMENSION)


def trigrams(text: str | None) -> np.ndarray:
    """Trigram numbers of a text; runs of other characters count as one gap, and a gap stands before and after."""
    if not text:
        return np.zeros(0, np.int64)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    cls = classes()[np.minimum(code, 65535)]
    high = code > 65535
    if high.any():
        cls = cls.copy()
        cls[high] = [27 + (c >> 7) % (CLASSES - 27) if unicodedata.category(chr(c))[0] == "L" else 0 for c in code[high].tolist()]
    cls = cls[cls != 255]
    if not cls.any():
        return np.zeros(0, np.int64)
    cls = np.concatenate([[0], cls, [0]]).astype(np.int64)
    cls = cls[np.concatenate([[True], (cls[1:] != 0) | (cls[:-1] != 0)])]
    return (cls[:-2] * CLASSES + cls[1:-1]) * CLASSES + cls[2:]


def vector(text: str | None) -> np.ndarray | None:
    """The sum of the text's trigram vectors; none without a letter."""
    at = trigrams(text)
    if not len(at):
        return None
    n = np.bincount(at, minlength=1)
    seen = np.flatnonzero(n)
    return n[seen].astype(np.float32) @ bound()[seen].astype(np.float32)


@dataclass
class Profiles:
    langs: list[str]
    prototypes: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        v = vector(text)
        if v is None or not self.langs:
            return "und", 0.0
        cos = self.prototypes @ v / max(float(np.linalg.norm(v)), 1e-9)
        k = int(np.argmax(cos))
        return self.langs[k], float(min(1.0, max(0.0, cos[k])))


def fit(texts: list[tuple[str | None, str]]) -> Profiles:
    langs = sorted({lang for _, lang in texts})
    share = {lang: np.zeros(CLASSES**3, np.float64) for lang in langs}
    for text, lang in texts:
        at = trigrams(text)
        if len(at):
            share[lang] += np.bincount(at, minlength=CLASSES**3) / len(at)
    sums = np.zeros((len(langs), DIMENSION))
    for k, lang in enumerate(langs):
        seen = np.flatnonzero(share[lang])
        for part in np.array_split(seen, len(seen) // 4096 + 1):
            sums[k] += share[lang][part] @ bound()[part].astype(np.float64)
    return Profiles(langs, (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)).astype(np.float32))


def _predict(model: Profiles, at: int, n: int):
    def run(it):
        for batch in small(it):
            got = [model.predict(t) for t in batch.column(at).to_pylist()]
            cols = [batch.column(i) for i in range(n)]
            yield pa.record_batch([*cols, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*batch.schema.names[:n], "lang_pred", "score"])

    return run


def identify_language(docs: DataFrame, ids: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, held: int = 2, sample_rows: int = SAMPLE_ROWS, only: list[str] | None = None) -> DataFrame:
    """docs (or the columns in `only`), plus held_out boolean, lang_pred string and score double (cosine, 0..1).

    Learns from about sample_rows ids of each language, chosen by a hash of the id, outside the held-out fold and
    with a language; an id that repeats gives its smallest text. A text that is null or has no letter gets `und` and 0, and so does every text where nothing
    could be learned. A null id is in fold 0. Equal cosines go to the first language in alphabetical order.
    Repeated rows are told alike, an empty table gives none, and a text may be of any length.
    Input columns named like an output are replaced.
    """
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (fold(ids, folds) != held)).select(F.col(lang).alias("_l"), F.col(ids).alias("_i"), F.col(text).alias("_t"))
    share = usable.groupBy("_l").agg(F.least(F.lit(1 << 20), F.lit(sample_rows * (1 << 20)) / F.count("*")).alias("_share"))
    picked = usable.withColumn("_h", F.pmod(F.xxhash64("_i"), F.lit(1 << 20))).join(F.broadcast(share), "_l").where("_h < _share")
    rows = picked.groupBy("_l", "_i").agg(F.min("_t").alias("_t")).collect()
    model = fit(sorted((r["_t"], r["_l"]) for r in rows))
    base, at, n = beside(docs, OUT, text, only, ((fold(ids, folds) == held).alias("held_out"),))
    schema = T.StructType([*base.schema.fields[:n], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return base.mapInArrow(_predict(model, at, n), schema)
