"""Benchmark decontamination by pigeonhole edit matching.

An item of n characters with an error budget of e is split into e + 1 pieces: whatever e
edits do, one piece survives unchanged. One pass over each document finds all
exact piece hits with an Aho-Corasick automaton; a hit fixes where the item
would have to stand, and Myers' bit-parallel distance verifies that place.

One law holds for items of every length: an item is in a text if its edit distance to some
stretch of whole words of the text is within the budget. So `yes` is not found in
`eyes`, and a long item that stands glued to some letters is.

The items are a stated query set: they are dealt in blocks of a bounded number
of characters, each block is one automaton and one pass over the documents. A
block is built on the driver and travels with the task.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import fresh, lean, named, small, spare

#: Edits allowed per hundred characters of an item.
BUDGET = 6
#: Characters of items in one block.
BLOCK_CHARS = 4_000_000
OUT = ["doc_id", "item_id", "edits", "at"]
_SPACE = re.compile(r"\s+")
#: Scripts that put no space between words: a hit beside their letters cuts no word.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def canonical(text: str | None) -> str:
    """Lower case, white space runs as one space."""
    return _SPACE.sub(" ", text).strip().lower() if text else ""


def budget(n: int, percent: int = BUDGET) -> int:
    return n * percent // 100


def pieces(item: str, e: int) -> list[tuple[int, str]]:
    """(offset, text) of e + 1 pieces of nearly equal length."""
    cut = [len(item) * i // (e + 1) for i in range(e + 2)]
    return [(lo, item[lo:hi]) for lo, hi in zip(cut, cut[1:])]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of the pattern to any substring of the text, end of the first such substring)."""
    m = len(pattern)
    if not m:
        return 0, 0
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score < best:
            best, end = score, j
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
    return best, end


def _joins(c: str) -> bool:
    return (c.isalnum() or c == "_" or unicodedata.category(c)[0] == "M") and not _UNSPACED.match(c)


def between(text: str, at: int) -> bool:
    """No word of the text goes on over position `at`."""
    return not (0 < at < len(text) and _joins(text[at - 1]) and _joins(text[at]))


def anchored(pattern: str, text: str, begin: int, stop: int) -> tuple[int, int]:
    """(least edit distance of the pattern to text[begin:end], that end) over the ends up to `stop` that cut no word."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m + 1, begin
    for j in range(begin, stop):
        eq = masks.get(text[j], 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        if score < best and between(text, j + 1):
            best, end = score, j + 1
        ph = (ph << 1 | 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
    return best, end


def place(item: str, text: str, begin: int, e: int) -> tuple[int, int]:
    """(least edit distance of the item to whole words that begin within e of `begin`, their end); a distance beyond e where there is none within it."""
    if 0 <= begin and text.startswith(item, begin) and between(text, begin) and between(text, begin + len(item)):
        return 0, begin + len(item)
    lo, hi = max(0, begin - e), min(len(text), begin + len(item) + e)
    if myers(item, text[lo:hi])[0] > e:
        return e + 1, 0
    return min((anchored(item, text, s, min(len(text), s + len(item) + e)) for s in range(lo, min(len(text), begin + e + 1)) if between(text, s)), default=(e + 1, 0))


def automaton(items: list[tuple[int, str]], percent: int):
    by: dict[str, list[tuple[int, int]]] = {}
    for k, (_, item) in enumerate(items):
        for at, piece in pieces(item, budget(len(item), percent)):
            if piece:
                by.setdefault(piece, []).append((k, at))
    auto = ahocorasick.Automaton()
    for piece, where in by.items():
        auto.add_word(piece, (len(piece), where))
    if by:
        auto.make_automaton()
    return auto if by else None


def matches(text: str, items: list[tuple[int, str]], auto, percent: int) -> list[tuple[int, int, int]]:
    """(item number, edits, end) of each item within its budget of some whole words of the text, at its best place."""
    best: dict[int, tuple[int, int]] = {}
    tried: set[tuple[int, int]] = set()
    for end, (n, where) in auto.iter(text):
        for k, at in where:
            begin = end - n + 1 - at
            if (k, begin) in tried or (k in best and best[k][0] == 0):
                continue
            tried.add((k, begin))
            e = budget(len(items[k][1]), percent)
            found = place(items[k][1], text, begin, e)
            if found[0] <= e and (k not in best or found < best[k]):
                best[k] = found
    return [(k, *v) for k, v in best.items()]


def _scan(items: list[tuple[int, str]], percent: int):
    def run(it):
        auto = automaton(items, percent)
        for batch in small(it):
            rows = []
            for who, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, d, end in matches(canonical(text), items, auto, percent) if auto is not None else ():
                    rows.append((who, items[k][0], d, end))
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], OUT)
        spare()

    return run


def blocks(items: list[tuple[int, str]], most: int = BLOCK_CHARS) -> list[list[tuple[int, str]]]:
    out, size = [[]], 0
    for item in items:
        if out[-1] and size + len(item[1]) > most:
            out.append([])
            size = 0
        out[-1].append(item)
        size += len(item[1])
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, ids: str = "doc_id", text: str = "text", item_ids: str = "item_id", item_text: str = "text", percent: int = BUDGET, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per (document, item) where some whole words of the text are within the item's budget.

    Returns doc_id, item_id, edits (least distance met) and at (end of that place in the text after lower-casing
    and white-space folding; the first of equals). Empty and null items match nothing, null and empty texts hold nothing.
    A row with a null id is scanned and its id stays null. Repeated rows and repeated items give repeated matches. A text may be
    of any length; an empty table gives no row. Ids are integers: one that is no number counts as null.
    """
    rows = benchmark.select(F.col(item_ids).try_cast("long").alias("i"), F.col(item_text).alias("t")).orderBy("i", "t").toLocalIterator()
    items = [(r["i"], c) for r in rows if (c := canonical(r["t"]))]
    slim = lean(docs.select(named(ids).try_cast("long").alias("doc_id"), named(text).alias("text")))
    parts = [slim.mapInArrow(_scan(b, percent), "doc_id long, item_id long, edits long, at long") for b in blocks(items, block_chars)]
    return reduce(DataFrame.unionByName, parts)


def decontaminate(docs: DataFrame, benchmark: DataFrame, ids: str = "doc_id", **kw) -> DataFrame:
    """docs without the rows whose id has a leak.

    Rows with a null id stay, and so do null and empty texts. All rows of an id go if one of them has a leak. Every column is
    passed on under its name, an empty table gives none, and a text may be of any length.
    """
    own = fresh(docs, "leak_id")
    hit = find_leaks(docs, benchmark, ids, **kw).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(hit, named(ids).try_cast("long") == F.col(own), "left_anti")
