"""Near-duplicate classes by BagMinHash signatures over multisets of five-word shingles.

A document is a multiset of shingles. Each shingle carries one Poisson process
per dyadic range of its weight, (0,1], (1,2], (2,4], ...; points of a range that a
document's weight covers only in part are thinned by their position. A point has
a time, a register and an identity, all functions of the shingle alone. A
register keeps the identity of its earliest point, so two documents agree in a
register with a probability equal to their weighted Jaccard similarity. Points
are generated in order of time and stop once they can no longer change a
register.

512 registers make 64 bands of 8: a pair at similarity 0.8 shares at least one
band with probability 0.99999, a pair at 0.4 with 0.04. Documents of one word
sequence are represented by the one with the smallest id before any band is
dealt out. Inside a band the members are first compared with one centre, the member with most
company, and then with each other; the second pass leaves out pairs that are in one class by then, pairs whose distances to the first centre
differ by more than the limit, which the triangle inequality rules out, and pairs whose
registers agree less often than those of any link, but three in 100,000, do. So a large group of copies is
resolved by its centres and never becomes a table of all its pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .flat import FLAT_BYTES, Flat, batches, mix64, words_of
from .tables import cut, fresh, gathered, lean, named, small, spare, without

SHINGLE, LEAST = 5, 0.8
REGISTERS, ROWS = 512, 8
BANDS = REGISTERS // ROWS
#: Texts, or pairs of them, in one part of a table that workers read, at least.
PART_TEXTS = 4_000
#: Points that a worker generates at once: some ten arrays of that length live together.
POINTS = 1 << 16
OUT = ["class_id", "class_size", "n_links"]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LEVEL = 0xD1B54A32D192ED03
_PLACE = np.uint64(0x8CB92BA72F3D8DD7)
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


def _ranges(doc: np.ndarray, h: np.ndarray, n: np.ndarray):
    """One row per (shingle, dyadic range that its weight reaches into): document, seed, length, lower bound, weight."""
    docs, seeds, length, low, weight = [doc], [mix64(h)], [np.ones(len(h))], [np.zeros(len(h))], [n]
    lo, level = 1, 1
    at = np.flatnonzero(n > 1)
    while len(at):
        docs.append(doc[at])
        seeds.append(mix64(h[at] + np.uint64(_LEVEL * level % 2**64)))
        length.append(np.full(len(at), float(lo)))
        low.append(np.full(len(at), float(lo)))
        weight.append(n[at])
        lo, level = lo * 2, level + 1
        at = at[n[at] > lo]
    return tuple(map(np.concatenate, (docs, seeds, length, low, weight)))


def bag_minhash(doc: np.ndarray, h: np.ndarray, n: np.ndarray, n_docs: int, m: int = REGISTERS) -> np.ndarray:
    """(n_docs, m) identities of the earliest points; rows of documents without shingles are zero."""
    doc, seed, length, low, weight = _ranges(doc, h, n.astype(np.float64))
    total = np.bincount(doc[low == 0], weight[low == 0], n_docs) if len(doc) else np.zeros(n_docs)
    until = np.where(total > 0, m * (np.log(m) + 4) / np.maximum(total, 1), 0.0)
    best, who = np.full(n_docs * m, np.inf), np.zeros(n_docs * m, np.uint64)
    todo = np.arange(len(doc))
    open_docs = total > 0
    while len(todo):
        expect = until[doc[todo]] * length[todo]
        size = np.exp2(np.ceil(np.log2(np.maximum(1.0, 1.2 * expect + 1)))).astype(np.int64)
        for k in np.unique(size).tolist():
            rows = todo[size == k]
            for part in np.array_split(rows, max(1, -(-len(rows) * k // POINTS))):
                time, step = np.zeros(len(part)), 0
                while len(part):
                    x = mix64(seed[part][:, None] + _STEP * np.arange(step + 1, step + k + 1, dtype=np.uint64)[None, :])
                    t = np.cumsum(-np.log(((x >> np.uint64(12)) + np.uint64(1)).astype(np.float64) * 2.0**-52) / length[part][:, None], axis=1)
                    t += time[:, None]
                    ok = t <= until[doc[part]][:, None]
                    split = low[part] + length[part] > weight[part]
                    if split.any():
                        place = low[part][split, None] + length[part][split, None] * ((mix64(x[split] ^ _PLACE) >> np.uint64(12)).astype(np.float64) * 2.0**-52)
                        ok[split] &= place <= weight[part][split, None]
                    reg = (doc[part] * m)[:, None] + (x & np.uint64(m - 1)).astype(np.int64)
                    reg, tt, xx = reg[ok], t[ok], x[ok]
                    np.minimum.at(best, reg, tt)
                    won = tt == best[reg]
                    who[reg[won]] = xx[won]
                    time = t[:, -1]
                    alive = time <= until[doc[part]]
                    part, time, step = part[alive], time[alive], step + k
        open_docs = open_docs & np.isinf(best.reshape(n_docs, m)).any(axis=1)
        until = np.where(open_docs, until * 2, until)
        todo = np.flatnonzero(open_docs[doc])
    return who.reshape(n_docs, m)


def shingles(flat: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, count) of the distinct shingles; a text of one to four words is one shingle."""
    at, h = flat.grams(SHINGLE)
    doc = flat.doc[at]
    n = np.bincount(flat.doc, minlength=flat.n_docs)
    few = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(few):
        lo = np.searchsorted(flat.doc, few)
        doc = np.concatenate([doc, few])
        h = np.concatenate([h, mix64(flat.hash_bytes(flat.start[lo], flat.end[lo + n[few] - 1]) + _PLACE)])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(new)
    return doc[first], h[first], np.diff(np.append(first, len(doc)))


def band_keys(sig: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sig), BANDS), np.uint64)
    parts = sig.reshape(len(sig), BANDS, ROWS)
    for r in range(ROWS):
        out = mix64(out + parts[:, :, r])
    return mix64(out + np.arange(BANDS, dtype=np.uint64)[None, :])


def _sign(it):
    """Per row the digest of its word sequence, and the band keys where the partition meets that digest first."""
    seen: set[bytes] = set()
    for batch in small(it):
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        joined = [b" ".join(words_of(t)) for t in texts]
        digest = [hashlib.blake2b(j, digest_size=16).digest() if j else None for j in joined]
        fresh = []
        for i, d in enumerate(digest):
            if d is not None and d not in seen:
                seen.add(d)
                fresh.append(i)
        keys: list[bytes | None] = [None] * len(texts)
        for lo, hi in batches([len(joined[i]) for i in fresh], FLAT_BYTES):
            flat = Flat([joined[i] for i in fresh[lo:hi]])
            bands = band_keys(bag_minhash(*shingles(flat), flat.n_docs))
            for i, row in zip(fresh[lo:hi], bands):
                keys[i] = row.tobytes()
        yield pa.record_batch([ids, pa.array(digest, pa.binary()), pa.array(keys, pa.binary())], ["id", "digest", "bands"])
    spare()


def _deal(it):
    """One row per band of each representative."""
    for batch in it:
        ids = np.asarray(batch.column(0).to_pylist(), np.int64)
        keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
        yield pa.record_batch([pa.array(np.repeat(ids, BANDS)), pa.array(keys), pa.array(np.tile(np.arange(BANDS, dtype=np.int8), len(ids)))], ["id", "key", "band"])


#: Long columns of a sketch: four bits of each register of two independent signatures.
SIGNATURES = 2
SKETCH = [f"s{k}" for k in range(SIGNATURES * REGISTERS // 16)]
#: Long columns with 32 bits of each band key, two bands in a column.
PRINTS = [f"p{k}" for k in range(BANDS // 2)]


def sketches(sig: np.ndarray) -> np.ndarray:
    """(documents, REGISTERS / 16) integers that hold four bits of every register."""
    # the lowest bits of an identity name its register and the highest its time: neither would tell texts apart
    low = ((sig >> np.uint64(14)) & np.uint64(15)).reshape(len(sig), -1, 16)
    return (low << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64).view(np.int64)


def _alike(least: float):
    """Sketches of (u, v) agree as often as texts at the limit do, less four standard deviations: a link passes with probability 0.99997."""
    p = least + (1 - least) / 16
    n = SIGNATURES * REGISTERS
    most = math.floor(n * (1 - p + 4 * math.sqrt(p * (1 - p) / n)))
    differ = []
    for c in SKETCH:
        x = F.col(f"u{c}").bitwiseXOR(F.col(f"v{c}"))
        any_bit = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        differ.append(F.bit_count(any_bit.bitwiseAND(F.lit(0x1111111111111111))))
    return reduce(lambda a, b: a + b, differ) <= most


def prints(keys: np.ndarray) -> np.ndarray:
    """(documents, BANDS / 2) integers: the low halves of two neighbouring band keys in each."""
    low = keys & np.uint64(0xFFFFFFFF)
    return (low[:, 0::2] | low[:, 1::2] << np.uint64(32)).view(np.int64)


def _first_shared():
    """The pair shares no band before this one, so it is looked at once and not once per shared band."""
    earlier = F.lit(False)
    for k, c in enumerate(PRINTS):
        x = F.col(f"u{c}").bitwiseXOR(F.col(f"v{c}"))
        earlier = earlier | ((F.col("uband") > 2 * k) & (x.bitwiseAND(F.lit(0xFFFFFFFF)) == 0)) | ((F.col("uband") > 2 * k + 1) & (F.shiftrightunsigned(x, 32) == 0))
    return ~earlier


def _squeeze(it):
    z = zstandard.ZstdCompressor(level=3)
    for batch in small(it):
        joined = [b" ".join(words_of(t)) for t in batch.column(1).to_pylist()]
        parts = [np.zeros((0, len(SKETCH) + len(PRINTS)), np.int64)]
        for lo, hi in batches([len(j) for j in joined], FLAT_BYTES):
            flat = Flat(joined[lo:hi])
            doc, h, n = shingles(flat)
            first, second = (bag_minhash(doc, x, n, flat.n_docs) for x in (h, h ^ _SECOND))
            parts.append(np.hstack([sketches(first), sketches(second), prints(band_keys(first))]))
        sk = np.concatenate(parts)
        yield pa.record_batch([batch.column(0), pa.array([z.compress(j) for j in joined], pa.binary()), *(pa.array(sk[:, k]) for k in range(sk.shape[1]))], ["id", "z", *SKETCH, *PRINTS])
    spare()


def bag(z: bytes) -> Counter:
    w = zstandard.ZstdDecompressor().decompress(z).split(b" ")
    return Counter(zip(*(w[i:] for i in range(SHINGLE)))) if len(w) >= SHINGLE else Counter([tuple(w)])


def overlap(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two multisets."""
    if len(a) > len(b):
        a, b = b, a
    both = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return both / (a.total() + b.total() - both)


def _verify(it):
    last, held = None, Counter()
    for batch in small(it):
        u, _, zu, zv = (c.to_pylist() for c in batch.columns)
        sim = []
        for i in range(len(u)):
            if u[i] != last:
                last, held = u[i], bag(zu[i])
            sim.append(overlap(held, bag(zv[i])))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sim, pa.float64())], ["u", "v", "sim"])
    spare()


def _per(df: DataFrame, key: str, *aggs) -> DataFrame:
    """One row per key, grouped by the key and its complement.

    A join of the result with df on the key alone then exchanges both sides, which lets Spark split the rows of a
    frequent key among tasks; a plain grouping would pin them to the grouping's own task.
    """
    return df.groupBy(key, F.bitwise_not(F.col(key)).alias("_w")).agg(*aggs).drop("_w")


def _crosswise(left: DataFrame, close: Column) -> DataFrame:
    """Pairs (u, v) of members of one bucket in different classes for which `close` holds, each once.

    The members of a bucket's largest class are only set against the others of the bucket, so one large class with a few
    strangers costs their product and not the square of the class.
    """
    most = left.groupBy("key", "c").agg(F.count("*").alias("_k")).groupBy("key").agg(F.max_by("c", F.struct("_k", "c")).alias("_large"))
    split = left.join(most, "key").withColumn("_in", F.col("c") == F.col("_large")).drop("_large")
    names = [c for c in split.columns if c not in ("key", "_in")]
    side = lambda df, x: df.select("key", *[F.col(c).alias(f"{x}{c}") for c in names])
    rest = split.where("NOT _in")
    found = [
        side(rest, "u").join(side(split.where("_in"), "v"), "key").where(close),
        side(rest, "u").join(side(rest, "v"), "key").where((F.col("uid") < F.col("vid")) & (F.col("uc") != F.col("vc")) & close),
    ]
    return found[0].select("uid", "vid").unionByName(found[1].select("uid", "vid")).select(F.least("uid", "vid").alias("u"), F.greatest("uid", "vid").alias("v")).distinct()


def near_duplicates(docs: DataFrame, ids: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """One row per document: its columns, class_id (smallest id of its class), class_size and n_links.

    Two texts are linked if the weighted Jaccard similarity of their multisets of five-word
    shingles is at least `least`; classes are the connected components of the links. n_links counts
    the verified links of a document's word sequence to other word sequences; links that a shared class makes
    redundant are not searched for. Equal word sequences are one class without being compared.

    A null or wordless text is a class of its own, and so is a row with a null id (class_id null). Rows
    with one id and different texts fall into one class. Repeated rows share a class, an empty table gives none, and a text
    may be of any length. Ids are integers: an id that is no number counts as null. Input columns named like an output are replaced.
    """
    spark = docs.sparkSession
    slim = lean(docs.select(named(ids).try_cast("long").alias("id"), named(text).alias("text")).where("id IS NOT NULL"))
    n = slim.count()
    signed = cut(gathered(slim, n, PART_TEXTS).mapInArrow(_sign, "id long, digest binary, bands binary"))
    copies = signed.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("rep"), F.max("bands").alias("bands"))
    deck = copies.select(F.col("rep").alias("id"), "bands").mapInArrow(_deal, "id long, key long, band tinyint")
    held = deck.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(deck.join(held, "key"), n * BANDS)
    n_shared = shared.count()
    # the member with most company over all bands is everywhere the first centre: an original before its copies
    weight = shared.groupBy("id").agg(F.sum("n").alias("w"))
    weighed = shared.join(weight, "id")
    centres = _per(weighed, "key", F.min(F.struct((-F.col("w")).alias("w"), "id"))["id"].alias("centre"))
    members = cut(shared.join(centres, "key").where("centre <> id"), n_shared)
    texts = cut(gathered(slim.join(weight.select("id"), "id", "left_semi").dropDuplicates(["id"]), n, PART_TEXTS).mapInArrow(_squeeze, "id long, z binary, " + ", ".join(f"{c} long" for c in (*SKETCH, *PRINTS))))

    pairs = cut(members.select(F.col("centre").alias("u"), F.col("id").alias("v")).distinct(), n_shared)
    links, labels = None, None
    for last in (False, True):
        n_pairs = pairs.count()
        if not n_pairs:
            break
        full = pairs.join(texts.select(F.col("id").alias("v"), F.col("z").alias("zv")), "v").join(texts.select(F.col("id").alias("u"), F.col("z").alias("zu")), "u")
        tried = cut(gathered(full.select("u", "v", "zu", "zv"), n_pairs, PART_TEXTS).mapInArrow(_verify, "u long, v long, sim double"))
        found = tried.where(F.col("sim") >= least).select("u", "v")
        links = found if links is None else links.unionByName(found)
        labels = cut(components(links))
        if last:
            break
        left = members.where("n > 2").join(labels, "id", "left").withColumn("c", F.coalesce("least", "id")).select("key", "band", "id", "centre", "c")
        mixed = left.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
        # distance of each member to the centre of its bucket
        near = tried.select(F.col("u").alias("centre"), F.col("v").alias("id"), (1 - F.col("sim")).alias("d"))
        left = left.join(mixed, "key", "left_semi").join(near, ["centre", "id"]).join(texts.select("id", *SKETCH, *PRINTS), "id")
        left = cut(left.select("key", "band", "id", "c", "d", *SKETCH, *PRINTS), n_shared, 20_000)
        # one minus the weighted Jaccard similarity is a metric, so texts whose distances to a common centre differ by more than the limit are no link
        new = _crosswise(left, (F.abs(F.col("ud") - F.col("vd")) <= 1 - least + 1e-9) & _first_shared() & _alike(least))
        either = tried.select("u", "v").unionByName(tried.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # their number is not known before; a part is a bucket's share of the pairs
        pairs = cut(new.join(either, ["u", "v"], "left_anti"), n_shared)
    if links is None:
        links = spark.createDataFrame([], "u long, v long")

    reps = copies.select("digest", "rep")
    known = signed.where("digest IS NOT NULL").select("id", "digest").join(reps, "digest").select("id", "rep").groupBy("id").agg(F.min("rep").alias("rep"))
    if labels is not None:
        degree = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct().groupBy("u").count().select(F.col("u").alias("rep"), F.col("count").alias("n_links"))
        known = known.join(labels.withColumnRenamed("id", "rep"), "rep", "left").join(degree, "rep", "left")
    else:
        known = known.withColumn("least", F.lit(None).cast("long")).withColumn("n_links", F.lit(None).cast("long"))
    known = cut(known.select("id", F.coalesce("least", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), n)
    sizes = _per(known, "class_id", F.count("*").alias("class_size"))
    known = known.join(sizes, "class_id")
    own = fresh(docs, "near_id")
    out = docs.select(*map(named, without(docs, OUT))).join(known.withColumnRenamed("id", own), named(ids).try_cast("long") == F.col(own), "left").drop(own)
    found = {"class_id": F.coalesce("class_id", named(ids).try_cast("long")), "class_size": F.coalesce("class_size", F.lit(1)).cast("long"), "n_links": F.coalesce("n_links", F.lit(0)).cast("long")}
    return out.select(*map(named, without(docs, OUT)), *[found[c].alias(c) for c in OUT])
