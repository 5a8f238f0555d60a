"""Substring dedup by super-k-mer partitioning.

Every window of 13 words of a document has a minimiser: the smallest hash among
its runs of three words. Consecutive windows with one minimiser travel as one
packed string to the bucket of that minimiser, so that equal windows meet
wherever they stand. A bucket sorts its windows, counts the equal ones exactly
and tells each document chunk which of its windows also start in a document
with a smaller id.

Documents are dealt once by a hash of the row into chunks of about 8 MB; one
exchange serves both the outward and the return pass. A chunk sends each
distinct packed string once, whatever the number of its copies there, so a
passage that a third of all rows share reaches its bucket once per chunk and
not once per row. Nothing is collected: the driver only sees one byte count.
"""

from __future__ import annotations

import hashlib
import struct
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import FLAT_BYTES, Flat, batches, words_of
from .tables import fresh, named, spare, text_bytes, without

WINDOW, MER = 13, 3
CHUNK_BYTES = 8 << 20
#: Chunks up to this number get a partition each.
MIN_PARTS = 2_000
#: Runs of three words with at most so many bytes are frequent; they serve as minimiser only where nothing else does.
SHORT_MER = 14
OUT = ["n_words", "n_removed", "kept_text", "kept_sha256"]


def super_kmers(flat: Flat, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, minimiser) of each run of windows with one minimiser; a window is named by its first word."""
    none = np.zeros(0, np.int64)
    n = len(flat) - k + 1
    if n <= 0:
        return none, none, none.astype(np.uint64)
    m = min(MER, k)
    lo, hi = flat.start[: len(flat) - m + 1], flat.end[m - 1 :]
    key = flat.hash_bytes(lo, hi) >> np.uint64(1)
    key |= (hi - lo <= SHORT_MER).astype(np.uint64) << np.uint64(63)
    width, have = k - m + 1, 1
    least = key
    while have * 2 <= width:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    ok = flat.doc[:n] == flat.doc[k - 1 :]
    new = ok.copy()
    new[1:] &= ~ok[:-1] | (least[1:] != least[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return none, none, none.astype(np.uint64)
    run = np.cumsum(new) - 1
    at = np.flatnonzero(ok)
    last = np.zeros(len(first), np.int64)
    last[run[at]] = at
    return first, last, least[first]


class _Chunk:
    """The distinct packed strings of one chunk, in an order that both passes share."""

    def __init__(self, table: pa.Table, ids: str, text: str, k: int):
        id_list, texts = table.column(ids).to_pylist(), table.column(text).to_pylist()
        self.order = sorted(range(len(id_list)), key=lambda i: (id_list[i] is None, id_list[i] or 0, texts[i] or ""))
        self.ids = [id_list[i] for i in self.order]
        #: words of each text, joined by one space
        self.joined = [b" ".join(words_of(texts[i])) for i in self.order]
        del texts
        self.seen: dict[bytes, int] = {}
        self.first, self.last, self.mini = array("q"), array("q"), array("Q")
        #: of each super-k-mer met: string, document, number of its first word in the document
        self.hit: list[np.ndarray] = []
        seen, first, last, mini = self.seen, self.first, self.last, self.mini
        sent = [j if i is not None else b"" for j, i in zip(self.joined, self.ids)]
        for lo, hi in batches([len(x) for x in sent], FLAT_BYTES):
            flat = Flat(sent[lo:hi])
            a, b, key = super_kmers(flat, k)
            if not len(a):
                continue
            doc = flat.doc[a]
            base = np.searchsorted(flat.doc, np.arange(hi - lo))
            data, at = flat.data, np.empty(len(a), np.int32)
            ends = flat.end[b + k - 1]
            for j, (s, e, d, key_) in enumerate(zip(flat.start[a].tolist(), ends.tolist(), doc.tolist(), key.tolist())):
                what, who = data[s:e], self.ids[lo + d]
                i = seen.setdefault(what, len(first))
                if i == len(first):
                    first.append(who)
                    last.append(who)
                    mini.append(key_)
                else:
                    last[i] = who
                at[j] = i
            self.hit.append(np.stack([at, (doc + lo).astype(np.int32), (a - base[doc]).astype(np.int32)]))


def _pack(parts: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(struct.pack("<I", len(p)) for p in parts) + b"".join(parts))


def _steps(x: np.ndarray) -> bytes:
    """Differences of nearly sorted numbers: small, so they pack well."""
    return np.diff(x, prepend=x.dtype.type(0)).tobytes()


def _unpack(blob: bytes, n: int) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 4 * n
    for size in struct.unpack(f"<{n}I", raw[:at]):
        out.append(raw[at : at + size])
        at += size
    return out


def _outward(ids: str, text: str, k: int, n_buckets: int):
    def run(key, table):
        chunk = _Chunk(table, ids, text, k)
        del chunk.joined, chunk.hit
        strings = list(chunk.seen)
        bucket = (np.frombuffer(chunk.mini, np.uint64) % np.uint64(n_buckets)).astype(np.int64)
        first, last = np.frombuffer(chunk.first, np.int64), np.frombuffer(chunk.last, np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        rows = []
        for part in np.split(order, cuts) if len(order) else []:
            rows.append((int(bucket[part[0]]), _pack([_steps(part.astype(np.int32)), _steps(first[part]), (last[part] - first[part]).tobytes(), b"\n".join([strings[i] for i in part.tolist()])])))
        del chunk, strings
        spare()
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "chunk": pa.array([key[0].as_py()] * len(rows), pa.int64()), "blob": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _count(k: int):
    def run(key, table):
        chunks = table.column("chunk").to_pylist()
        number, first, last, payload, owner = [], [], [], [], []
        for i, blob in enumerate(table.column("blob").to_pylist()):
            n, f, x, p = _unpack(blob, 4)
            number.append(np.cumsum(np.frombuffer(n, np.int32), dtype=np.int32))
            first.append(np.cumsum(np.frombuffer(f, np.int64)))
            last.append(first[-1] + np.frombuffer(x, np.int64))
            payload.append(p)
            owner.append(np.full(len(number[-1]), i))
        split_at = number
        number, first, last, owner = map(np.concatenate, (number, first, last, owner))
        # the flat view of a part of the payloads at a time: only the windows' hashes and places are kept;
        # a "document" of the view is one packed string here
        data = b"\n".join(payload)
        starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in payload])])
        counts = np.concatenate([[0], np.cumsum([len(n) for n in split_at])])
        hashes, strings, places, stops, words = [], [], [], [], []
        for lo, hi in batches([len(p) for p in payload], FLAT_BYTES):
            flat = Flat(payload[lo:hi])
            at, h = flat.grams(k)
            own = flat.doc[at]
            hashes.append(h)
            strings.append((own + counts[lo]).astype(np.int32))
            places.append(flat.start[at] + starts[lo])
            stops.append(flat.end[at + k - 1] + starts[lo])
            words.append((at - np.searchsorted(flat.doc, own)).astype(np.int32))
        del payload
        h, string, start, end, word = map(np.concatenate, (hashes, strings, places, stops, words))
        del hashes, strings, places, stops, words
        order = np.argsort(h, kind="stable")
        new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
        run_of = np.cumsum(new) - 1
        size = np.bincount(run_of)
        least = np.full(len(size), np.iinfo(np.int64).max)
        np.minimum.at(least, run_of, first[string[order]])
        lo = np.flatnonzero(new)
        hit = least[run_of] < last[string[order]]
        touched = np.unique(run_of[hit])
        gmin = np.full(len(h), np.iinfo(np.int64).max)
        gmin[order] = least[run_of]
        for r in touched.tolist():
            if size[r] == 1:
                continue
            own = order[lo[r] : lo[r] + size[r]].tolist()
            what = [data[start[i] : end[i]] for i in own]
            if what.count(what[0]) != len(what):  # two window texts with one hash: count by text
                by: dict[bytes, int] = {}
                for w, i in zip(what, own):
                    by[w] = min(by.get(w, np.iinfo(np.int64).max), int(first[string[i]]))
                for w, i in zip(what, own):
                    gmin[i] = by[w]
        told = np.flatnonzero(gmin < last[string])
        offset = word[told]
        own = owner[string[told]]
        sort = np.argsort(own, kind="stable")
        rows: list[tuple[int, bytes]] = []
        cuts = np.flatnonzero(np.diff(own[sort])) + 1
        for part in np.split(sort, cuts) if len(sort) else []:
            rows.append((chunks[int(own[part[0]])], _pack([number[string[told[part]]].astype(np.int32).tobytes(), offset[part].tobytes(), gmin[told[part]].tobytes()])))
        spare()
        return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int64()), "blob": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _remove(ids: str, text: str, k: int, keep: list[str], kinds: dict[str, pa.DataType]):
    def run(key, docs, replies):
        chunk = _Chunk(docs, ids, text, k)
        del chunk.seen, chunk.first, chunk.last, chunk.mini
        spare()
        told = [_unpack(b, 3) for b in replies.column("blob").to_pylist()]
        sizes = [j.count(b" ") + 1 if j else 0 for j in chunk.joined]
        gone: list[np.ndarray | None] = [None] * len(sizes)
        if told and chunk.hit:
            string = np.concatenate([np.frombuffer(t[0], np.int32) for t in told]).astype(np.int64)
            offset = np.concatenate([np.frombuffer(t[1], np.int32) for t in told]).astype(np.int64)
            gmin = np.concatenate([np.frombuffer(t[2], np.int64) for t in told])
            sort = np.argsort(string, kind="stable")
            string, offset, gmin = string[sort], offset[sort], gmin[sort]
            who = np.array([i if i is not None else np.iinfo(np.int64).min for i in chunk.ids], np.int64)
            for at, doc, word in chunk.hit:
                lo, hi = np.searchsorted(string, at), np.searchsorted(string, at, "right")
                n = hi - lo
                if not n.sum():
                    continue
                src = np.repeat(np.arange(len(at)), n)
                row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[src]
                ok = gmin[row] < who[doc[src]]
                for d, w in zip(doc[src][ok].tolist(), (word[src] + offset[row])[ok].tolist()):
                    if gone[d] is None:
                        gone[d] = np.zeros(sizes[d] + 1, np.int32)
                    gone[d][w] += 1
                    gone[d][w + k] -= 1
        docs = docs.take(pa.array(chunk.order, pa.int64()))
        n_removed, kept, digest = [], [], []
        for joined, mark, n, raw in zip(chunk.joined, gone, sizes, docs.column(text)):
            out, lost = joined, 0
            if mark is not None:
                cover = np.cumsum(mark)[:-1] > 0
                lost = int(cover.sum())
                out = b" ".join([w for w, c in zip(joined.split(b" "), cover.tolist()) if not c])
            n_removed.append(lost)
            kept.append(out.decode("utf-8", "surrogatepass") if lost else raw.as_py())
            digest.append(hashlib.sha256(out).hexdigest())
        cols = {c: docs.column(c).cast(kinds[c]) for c in keep}
        return pa.table(cols | {"n_words": pa.array(sizes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.string()), "kept_sha256": pa.array(digest, pa.string())})

    return run


def dedup_substrings(docs: DataFrame, ids: str = "doc_id", text: str = "text", window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, only: list[str] | None = None) -> DataFrame:
    """Marks and removes every word covered by a window that also starts in a document with a smaller id.

    Returns the columns of docs (or those in `only`) but for `text`, then n_words, n_removed,
    kept_text (the text as it was where nothing is removed, else the kept words joined by
    one space) and kept_sha256 (of the kept words joined by one space).

    A null text has no words and gives a null kept_text. A row with a null id neither removes nor loses words. Rows with
    equal ids are not smaller than each other, so they do not remove from each other. A text of
    fewer words than the window is kept whole. Repeated rows are treated alike, an empty table gives none, and a text may be of
    any length. Ids are 64-bit integers. Input columns named like an output are replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kept = [c for c in without(docs, [*OUT, text]) if only is None or c in only or c == ids]
    n_chunks = max(1, text_bytes(docs, text) // chunk_bytes + 1)
    n_buckets = 3 * n_chunks
    # many chunks share a partition where there are many: a group is one chunk at a time
    n_parts = min(n_chunks, max(MIN_PARTS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    own = fresh(docs, "chunk")
    base = docs.select(*map(named, kept), named(text)).withColumn(own, F.pmod(F.xxhash64(named(ids), named(text)), F.lit(n_chunks))).repartition(n_parts, own)
    sent = base.groupBy(own).applyInArrow(_outward(ids, text, window, n_buckets), "bucket long, chunk long, blob binary")
    replies = sent.groupBy("bucket").applyInArrow(_count(window), "chunk long, blob binary").withColumnRenamed("chunk", own)
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("kept_sha256", T.StringType())])
    kinds = {c: to_arrow_type(docs.schema[c].dataType) for c in kept}
    return base.groupBy(own).cogroup(replies.groupBy(own)).applyInArrow(_remove(ids, text, window, kept, kinds), schema)
