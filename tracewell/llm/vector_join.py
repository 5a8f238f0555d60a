"""Near-duplicate vectors by an exact metric range join.

Vectors of length one lie on a sphere, where a cosine of at least c is a distance of
at most eps = sqrt(2 - 2c). Pivots, spread over a bounded sample, cut the sphere into
cells: a vector belongs to its nearest pivot. For every cell and every pivot the
least and greatest distance of the cell's members to that pivot are aggregated, and
a vector is replicated to a cell only if the triangle inequality leaves room for a
link: for no pivot may its own distance lie more than eps outside the cell's range, nor
may it be more than 2 eps farther from the cell's pivot than from its own. A cell with
many members is dealt into blocks, so that a hot cell is many tasks. Cells and
blocks are numbered, and a vector goes only to those below its own, so that each pair
meets once; a task holds one block and lets the visitors stream by.

A task hands on link counts and, instead of all pairs, the edges of a spanning
forest of what it linked. Equal vectors are one vector with a weight from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import cut, fresh, named, without

LEAST = 0.9
#: Vectors of the sample that pivots are taken from, and bounds on the number of pivots: the table of ranges is its square.
SAMPLE, FEWEST, MOST = 4_000, 16, 512
#: Members of a cell per pivot that the number of pivots aims at, and of a block at most (on average: members are dealt by hash).
CELL, BLOCK = 4_096, 4_096
#: Cosines this near to the limit are computed again from the vectors themselves.
UNSURE = 1e-9
OUT = ["n_links", "component_id", "kept"]


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two near their largest component: no square overflows or vanishes, and no digit is lost."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one."""
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    a, b = _scaled(a), _scaled(b)
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def distances(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (u @ pivots.T), 0))


def spread(sample: np.ndarray, k: int) -> np.ndarray:
    """Up to k different rows of the sample, each the farthest from those before it."""
    chosen, far = [0], distances(sample, sample[:1])[:, 0]
    while len(chosen) < k and far.max() > 1e-6:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(sample, sample[chosen[-1] :][:1])[:, 0])
    return sample[chosen]


class Pivots:
    """The pivots of each dimension, and where a vector may have links. Cells are numbered over all dimensions; a dimension without pivots is one cell."""

    def __init__(self, by_dim: dict[int, np.ndarray]):
        self.by_dim, self.first, at = by_dim, {}, 0
        for d in sorted(by_dim):
            self.first[d] = at
            at += len(by_dim[d])
        self.n = at

    def owners(self, d: int, u: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """(cell, distances to the pivots of that dimension)."""
        if d not in self.by_dim:
            return np.full(len(u), self.n + d, np.int64), None
        far = distances(u, self.by_dim[d])
        return self.first[d] + far.argmin(axis=1), far


def _by_dim(batch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, row numbers, float64 rows) of a batch whose second column holds packed doubles."""
    blobs = batch.column(1)
    size = np.array([len(b.as_buffer()) >> 3 for b in blobs], np.int64)
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        yield d, rows, np.frombuffer(b"".join(blobs[int(i)].as_py() for i in rows)).reshape(len(rows), d)


def _pack(it):
    """(embedding, copies, least id) with the vector as packed doubles."""
    for batch in it:
        lists = batch.column(0)
        flat, ends = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        data, starts = np.ascontiguousarray(flat).tobytes(), np.concatenate([[0], ends[:-1]])
        blobs = [data[8 * a : 8 * b] for a, b in zip(starts.tolist(), ends.tolist())]
        yield pa.record_batch([lists, pa.array(blobs, pa.binary()), batch.column(1), batch.column(2)], ["embedding", "vec", "copies", "vec_id"])


def _ranges(pivots: Pivots):
    """Per partition and cell the number of members, and their least and greatest distance to each pivot."""

    def run(it):
        count: dict[int, int] = {}
        span: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in it:
            for d, _, x in _by_dim(batch):
                cell, far = pivots.owners(d, unit(x))
                for c in np.unique(cell).tolist():
                    mine = cell == c
                    count[c] = count.get(c, 0) + int(mine.sum())
                    if far is not None:
                        lo, hi = far[mine].min(axis=0), far[mine].max(axis=0)
                        if c in span:
                            lo, hi = np.minimum(lo, span[c][0]), np.maximum(hi, span[c][1])
                        span[c] = lo, hi
        for c, n in count.items():
            lo, hi = span.get(c, (np.zeros(1), np.zeros(1)))
            k = len(lo)
            yield pa.record_batch([pa.array(np.full(k, c)), pa.array(np.arange(k)), pa.array(np.where(np.arange(k) == 0, n, 0)), pa.array(lo), pa.array(hi)], ["cell", "pivot", "n", "lo", "hi"])

    return run


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def _deal(pivots: Pivots, blocks: dict[int, int], span: dict[int, tuple[np.ndarray, np.ndarray]], eps: float):
    """Each vector once as a member of its cell's block, and as a visitor of all lower blocks that may hold links."""

    def run(it):
        for batch in it:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            who, cells, block, member = [], [], [], []

            def add(rows, c, b, m):
                who.append(rows), cells.append(c), block.append(b), member.append(np.full(len(rows), m))

            for d, rows, x in _by_dim(batch):
                cell, far = pivots.owners(d, unit(x))
                parts = np.array([blocks[c] for c in cell.tolist()], np.int64)
                own = (_mix(ids[rows]) % parts.astype(np.uint64)).astype(np.int64)
                add(rows, cell, own, True)
                for b in range(int(own.max())):  # lower blocks of the own cell
                    up = np.flatnonzero(own > b)
                    add(rows[up], cell[up], np.full(len(up), b), False)
                if far is None:
                    continue
                nearest = far.min(axis=1)
                for c in range(pivots.first[d], int(cell.max())):  # lower cells
                    if c not in span:
                        continue
                    lo, hi = span[c]
                    near = (cell > c) & (far[:, c - pivots.first[d]] <= nearest + 2 * eps) & ((far >= lo - eps) & (far <= hi + eps)).all(axis=1)
                    up = np.flatnonzero(near)
                    for b in range(blocks[c]):
                        add(rows[up], np.full(len(up), c), np.full(len(up), b), False)
            who = np.concatenate(who)
            out = batch.take(pa.array(who))
            for at in range(0, len(who), 2048):
                s = slice(at, at + 2048)
                yield pa.record_batch([pa.array(np.concatenate(cells)[s]), pa.array(np.concatenate(block)[s].astype(np.int32)), pa.array(np.concatenate(member)[s].astype(bool)), *out.slice(at, 2048).columns], ["cell", "block", "member", "id", "vec", "copies"])

    return run


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


class _Block:
    """The members of one block and what is linked to them."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, x: np.ndarray, least: float):
        self.ids, self.copies, self.x, self.u, self.least = ids, copies, x, unit(x), least
        self.links = np.zeros(len(ids), np.int64)
        self.forest = _Forest(len(ids))

    def _linked(self, x: np.ndarray, u: np.ndarray) -> np.ndarray:
        cos = self.u @ u.T
        hit = cos >= self.least
        for i, j in np.argwhere(np.abs(cos - self.least) < UNSURE).tolist():
            hit[i, j] = cosine(self.x[i], x[j]) >= self.least
        return hit

    def _join(self, hit: np.ndarray) -> None:
        """Members that are linked to one column are joined; columns with the same members need it once."""
        for column in np.unique(hit[:, hit.sum(axis=0) > 1], axis=1).T if hit.any() else ():
            first, *rest = np.flatnonzero(column).tolist()
            for i in rest:
                self.forest.join(first, i)

    def inside(self) -> None:
        for at in range(0, len(self.ids), 512):
            hit = self._linked(self.x[at : at + 512], self.u[at : at + 512])
            hit[np.arange(at, at + hit.shape[1]), np.arange(hit.shape[1])] = False
            self.links += hit @ self.copies[at : at + 512]
            for j in np.flatnonzero(hit.any(axis=0)).tolist():
                hit[at + j, j] = True
            self._join(hit)

    def visit(self, ids: np.ndarray, copies: np.ndarray, x: np.ndarray):
        hit = self._linked(x, unit(x))
        at = np.flatnonzero(hit.any(axis=0))
        if not len(at):
            return None
        self.links += hit[:, at] @ copies[at]
        self._join(hit[:, at])
        return _found(ids[at], self.copies @ hit[:, at], self.ids[hit[:, at].argmax(axis=0)])

    def end(self):
        root = np.array([self.forest.root(i) for i in range(len(self.ids))], np.int64)
        at = np.flatnonzero((self.links > 0) | (root != np.arange(len(root))))
        return _found(self.ids[at], self.links[at], self.ids[root[at]])


def _found(ids: np.ndarray, links: np.ndarray, to: np.ndarray):
    return pa.record_batch([pa.array(ids), pa.array(links.astype(np.int64)), pa.array(to)], ["id", "links", "to"])


def _match(least: float):
    """Rows sorted by (cell, block), members first: per vector and block its links there, and one vector that it is connected with."""

    def run(it):
        key, block, held = None, None, []
        for batch in it:
            cells, blocks, member = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            new = np.flatnonzero(np.concatenate([[True], (cells[1:] != cells[:-1]) | (blocks[1:] != blocks[:-1]) | (member[1:] != member[:-1])]))
            for lo, hi in zip(new.tolist(), [*new[1:].tolist(), len(cells)]):
                if (cells[lo], blocks[lo]) != key:
                    yield from _closed(block, held, least)
                    key, block, held = (cells[lo], blocks[lo]), None, []
                part = batch.slice(lo, hi - lo).select(["id", "vec", "copies"])
                if member[lo]:
                    held.append(part)
                    continue
                if block is None and held:
                    block = _opened(held, least)
                if block is not None:
                    for at in range(0, part.num_rows, 512):
                        out = block.visit(*_rows(part.slice(at, 512)))
                        if out is not None:
                            yield out
        yield from _closed(block, held, least)

    return run


def _rows(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ((_, _, x),) = _by_dim(batch)
    return batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False), x


def _opened(held: list, least: float) -> _Block:
    parts = [_rows(p) for p in held]
    block = _Block(*(np.concatenate([p[k] for p in parts]) for k in range(3)), least)
    block.inside()
    return block


def _closed(block, held: list, least: float):
    if block is None and held:
        block = _opened(held, least)
    if block is not None:
        yield block.end()


def usable(vector: Column) -> Column:
    """The vector has components, all of them finite numbers, and not all zero."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad) & F.exists(vector, lambda v: v != 0), F.lit(False))


def _choose(vectors: DataFrame, n: int) -> Pivots:
    """Pivots from a sample of at most SAMPLE vectors, the first in the order of a hash."""
    rows = vectors.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).collect()
    by_dim: dict[int, list[bytes]] = {}
    for r in rows:
        by_dim.setdefault(len(r["vec"]) >> 3, []).append(bytes(r["vec"]))
    k = min(max(n // CELL, FEWEST), MOST)
    return Pivots({d: spread(unit(np.frombuffer(b"".join(v)).reshape(len(v), d)), max(1, k * len(v) // len(rows))) for d, v in by_dim.items()})


def near_vectors(df: DataFrame, ids: str = "vec_id", vector: str = "embedding", least: float = LEAST) -> DataFrame:
    """df with n_links, component_id and kept: links are pairs of vectors with a cosine of at least `least`, computed in double precision.

    n_links counts the other rows that a row is linked with, component_id is the smallest id that is reachable by links (its own
    included) and kept says that this is the row's own id. No pair is lost: pivots and cells only decide where a pair is compared.

    A vector that is null, empty, zero or holds a null or a number that is not finite links with nothing, and neither do vectors of different
    lengths. Repeated rows and rows that share an id are rows like any other. A row with a null id has links; its component_id
    is the smallest id of its component, or null if there is none, and kept then is true only for null. An empty table gives none.
    Columns of df named like an output are replaced, all others passed on.
    """
    spark = df.sparkSession
    good = df.select(named(ids).alias("vec_id"), named(vector).alias("embedding")).where(usable(F.col("embedding")))
    plain = good.groupBy("embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("vec_id"))
    id_type = plain.schema["vec_id"].dataType.simpleString()
    v_type = plain.schema["embedding"].dataType.simpleString()
    packed = plain.select("embedding", "copies", "vec_id").mapInArrow(_pack, f"embedding {v_type}, vec binary, copies long, vec_id {id_type}")
    # numbered once and written, so that the numbers stay whatever happens to an executor later
    whole = cut(packed.withColumn("id", F.monotonically_increasing_id()))
    n = whole.count()
    slim = whole.select("id", "vec", "copies")
    pivots = _choose(whole, n)
    eps = math.sqrt(2 - 2 * least) + 1e-6
    # one row per cell and pivot: at most MOST squared, whatever the data
    ranges = slim.mapInArrow(_ranges(pivots), "cell long, pivot long, n long, lo double, hi double").groupBy("cell", "pivot").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    count: dict[int, int] = {}
    bounds: dict[int, list[tuple[int, float, float]]] = {}
    for r in ranges:
        count[r["cell"]] = count.get(r["cell"], 0) + r["n"]
        bounds.setdefault(r["cell"], []).append((r["pivot"], r["lo"], r["hi"]))
    blocks = {c: -(-m // BLOCK) for c, m in count.items()}
    span = {c: (np.array([x[1] for x in sorted(b)]), np.array([x[2] for x in sorted(b)])) for c, b in bounds.items()}
    dealt = slim.mapInArrow(_deal(pivots, blocks, span, eps), "cell long, block int, member boolean, id long, vec binary, copies long")
    grouped = dealt.repartition("cell", "block").sortWithinPartitions("cell", "block", F.desc("member"))
    found = cut(grouped.mapInArrow(_match(least), "id long, links long, to long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    labels = components(found.where("id <> to").select(F.col("id").alias("u"), F.col("to").alias("v"))).withColumnRenamed("least", "root")
    known = whole.select("id", "embedding", "copies", "vec_id").join(links, "id", "left").join(labels, "id", "left").withColumn("root", F.coalesce("root", "id"))
    first = known.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    known = known.join(first, "root").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")

    own = {c: fresh(df, f"near_{c}") for c in ("vector", "links", "component")}
    known = known.select(F.col("embedding").alias(own["vector"]), F.col("n_links").alias(own["links"]), F.col("component_id").alias(own["component"]))
    keep = [c for c in without(df, OUT) if c != ids]
    key = F.when(usable(named(vector)), named(vector))
    out = df.join(known, key == named(own["vector"]), "left")
    component = F.when(named(own["vector"]).isNull(), named(ids)).otherwise(named(own["component"]))
    return out.select(named(ids), *map(named, keep), F.coalesce(named(own["links"]), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(named(ids)).alias("kept"))
