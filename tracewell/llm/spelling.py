"""Spelling variants: words of one edit, found with forward and backward minimal acyclic automata.

If two words differ by one inserted, deleted or replaced code point and the shorter
has L of them, they share the first L // 2 code points or the last L - L // 2. So every
word is dealt to the bucket of its first half, as it is, and to that of its second half,
spelt backward; a word is in a pair the shorter one, or of the same length, or the
longer one, so it goes by two lengths in either direction. A bucket's words become a
minimal acyclic automaton whose arcs carry the number of words that leave a state
before them: the sum along a path is the word's number, which leads to its count. Each
word walks its half exactly and is completed with one error. A pair that shares the first
half is found forward and skipped backward, so each is found once.

Buckets are of even size by the number of words; one that is too large, because many words share one half,
is dealt into chunks that all its queries visit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut, named

#: Code points of words in a bucket on average, and in one automaton at most (a single longer word is one by itself).
BUCKET_CHARS, CHUNK_CHARS = 150_000, 600_000
#: Queries that walk an automaton side by side.
WALKERS = 4_096
#: Rows in one part of a table between the steps.
PART_ROWS = 50_000
#: Fixed values of the contract: what a word consists of, the shortest, fewest occurrences, and how much more frequent a form is.
LETTERS, SHORTEST, FEWEST, RATIO = "[A-Za-zÀ-ÿ]", 7, 2, 10
_SHIFT = np.int64(21)  # code points have 21 bits


@dataclass
class Automaton:
    """Word -> number in the order of code points. `key` has state and label of every arc, in order."""

    key: np.ndarray
    target: np.ndarray
    before: np.ndarray
    first: np.ndarray
    final: np.ndarray
    root: int

    @classmethod
    def build(cls, words: list[str]) -> Automaton:
        """From different words in order: what the next word does not continue is merged with a state of the same future."""
        known: dict[tuple, int] = {}
        states: list[tuple] = []
        size: list[int] = []
        open_final, open_labels, open_targets = [False], [[]], [[]]
        last = ""

        def close() -> int:
            state = (open_final.pop(), *open_labels.pop(), *open_targets.pop())
            at = known.get(state)
            if at is None:
                at = known[state] = len(states)
                states.append(state)
                size.append(state[0] + sum(size[t] for t in state[1 + len(state) // 2 :]))
            return at

        for word in words:
            same, most = 0, min(len(word), len(last))
            while same < most and word[same] == last[same]:
                same += 1
            for _ in range(len(last) - same):
                at = close()
                open_targets[-1].append(at)
            for ch in word[same:]:
                open_labels[-1].append(ch)
                open_final.append(False), open_labels.append([]), open_targets.append([])
            open_final[-1] = True
            last = word
        for _ in range(len(last)):
            at = close()
            open_targets[-1].append(at)
        root = close()
        n_arcs = np.array([len(s) // 2 for s in states])
        label = np.array([ord(c) for s in states for c in s[1 : 1 + len(s) // 2]], np.int64)
        target = np.array([t for s in states for t in s[1 + len(s) // 2 :]], np.int64)
        first = np.concatenate([[0], np.cumsum(n_arcs)])
        final = np.array([s[0] for s in states], bool)
        source = np.repeat(np.arange(len(states)), n_arcs)
        words_of = np.array(size, np.int64)[target] if len(target) else target
        ends = np.cumsum(words_of)
        start = np.concatenate([[0], ends])[first[:-1]]
        before = ends - words_of - start[source] + final[source]
        return cls(source << _SHIFT | label, target, before, first, final, root)

    def follow(self, state: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The arcs by these labels, -1 where there is none."""
        if not len(self.key):
            return np.full(len(state), -1)
        want = state << _SHIFT | label
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, at, -1)

    def arcs(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of `state`, arc) of all arcs of these states."""
        n = self.first[state + 1] - self.first[state]
        row = np.repeat(np.arange(len(state)), n)
        return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + self.first[state][row]

    def one_error(self, words: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, number) of all words that equal a query in its first `exact` code points and then have one replaced or one more."""
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        length = np.array([len(w) for w in words], np.int64)
        at = np.cumsum(length) - length
        code = np.append(code, -1)  # what a query has behind its end matches no label

        def expected(q: np.ndarray, pos: np.ndarray) -> np.ndarray:
            return np.where(pos < length[q], code[np.minimum(at[q] + pos, len(code) - 1)], -1)

        def advance(q, pos, state, number):
            arc = self.follow(state, expected(q, pos))
            ok = arc >= 0
            arc = arc[ok]
            return q[ok], pos[ok] + 1, self.target[arc], number[ok] + self.before[arc]

        q = np.arange(len(words))
        now = q, np.zeros(len(q), np.int64), np.full(len(q), self.root), np.zeros(len(q), np.int64)
        wrong: list[tuple] = []
        while len(now[0]):
            q, pos, state, number = now
            half = pos >= exact[q]
            hq, hpos, hstate, hnumber = (x[half] for x in now)
            row, arc = self.arcs(hstate)
            other = (self.key[arc] & ((1 << _SHIFT) - 1)) != expected(hq, hpos)[row]
            row, arc = row[other], arc[other]
            # one more of the same letter is the same word wherever it stands: it is added behind the last of them
            wrong.append((hq[row], hpos[row], self.target[arc], hnumber[row] + self.before[arc]))
            put = hpos[row] < length[hq[row]]
            wrong.append(tuple(x[put] for x in (hq[row], hpos[row] + 1, self.target[arc], hnumber[row] + self.before[arc])))
            now = advance(*now)
        found_q, found = [], []
        now = tuple(map(np.concatenate, zip(*wrong))) if wrong else now
        while len(now[0]):
            q, pos, state, number = now
            done = pos == length[q]
            good = done & self.final[state]
            found_q.append(q[good]), found.append(number[good])
            now = advance(*(x[~done] for x in now))
        return np.concatenate([np.zeros(0, np.int64), *found_q]), np.concatenate([np.zeros(0, np.int64), *found])


def _near_in_chunk(words: list[str], counts: list[int], member: list[bool], asks: list[bool], backward: bool):
    """Pairs within one chunk as a batch of (word, n, near, near_n), each pair once."""
    spelt = (lambda w: w[::-1]) if backward else (lambda w: w)
    n_of = {spelt(w): n for w, n, m in zip(words, counts, member) if m}
    entries = sorted(n_of)
    if not entries:
        return
    automaton = Automaton.build(entries)
    ask = sorted({(spelt(w), n) for w, n, a in zip(words, counts, asks) if a})
    for lo in range(0, len(ask), WALKERS):
        part = ask[lo : lo + WALKERS]
        exact = np.array([len(w) - len(w) // 2 if backward else len(w) // 2 for w, _ in part], np.int64)
        out: list[tuple[str, int, str, int]] = []
        for q, k in zip(*map(np.ndarray.tolist, automaton.one_error([w for w, _ in part], exact))):
            (w, n), v = part[q], entries[k]
            near_n = n_of[v]
            if backward:
                w, v = w[::-1], v[::-1]
                if w[: len(w) // 2] == v[: len(w) // 2]:
                    continue  # found forward
            if len(w) < len(v) or w < v:
                out.append((w, n, v, near_n))
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.int64()))], ["word", "n", "near", "near_n"])


def _search(it):
    """Rows sorted by (bucket, chunk): an odd bucket is spelt backward."""
    key, held = None, ([], [], [], [])
    for batch in it:
        bucket, chunk = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
        new = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (chunk[1:] != chunk[:-1])]))
        for lo, hi in zip(new.tolist(), [*new[1:].tolist(), len(bucket)]):
            if (bucket[lo], chunk[lo]) != key:
                if key is not None:
                    yield from _near_in_chunk(*held, backward=bool(key[0] % 2))
                key, held = (bucket[lo], chunk[lo]), ([], [], [], [])
            for have, column in zip(held, ("word", "n", "member", "asks")):
                have.extend(batch.column(column).slice(lo, hi - lo).to_pylist())
    if key is not None:
        yield from _near_in_chunk(*held, backward=bool(key[0] % 2))


def near_words(words: DataFrame) -> DataFrame:
    """words(word, n), each word once -> (word, n, near, near_n): every pair of words one edit apart, once."""
    size = words.agg(F.sum(F.length("word")).alias("chars")).first()["chars"] or 0
    buckets = 4 * size // BUCKET_CHARS + 1
    long = F.length("word")
    shorter = F.explode(F.array(long, long - 1)).alias("of")  # the length of the shorter word of a pair
    by_length = words.select("word", "n", shorter)
    half = F.floor(F.col("of") / 2).cast("int")
    ends = F.array(F.struct(F.lit(0).alias("way"), F.substring(F.col("word"), F.lit(1), half).alias("part")), F.struct(F.lit(1).alias("way"), F.expr("right(word, of - int(floor(of / 2)))").alias("part")))
    dealt = by_length.select("word", "n", "of", F.explode(ends).alias("end"))
    dealt = dealt.select("word", "n", (F.col("of") == F.length("word")).alias("asks"), (F.pmod(F.xxhash64("of", "end.part"), F.lit(buckets)) * 2 + F.col("end.way")).alias("bucket"))
    # one row per bucket; chunks only where a bucket is too large for one automaton
    large = dealt.groupBy("bucket").agg(F.ceil(F.sum(F.length("word")) / CHUNK_CHARS).alias("chunks")).where("chunks > 1")
    dealt = dealt.join(large, "bucket", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)).cast("long"))
    own = F.pmod(F.xxhash64("word"), F.col("chunks"))
    dealt = dealt.withColumn("own", own).withColumn("chunk", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(F.array("own"))))
    rows = dealt.select("bucket", "chunk", "word", "n", (F.col("chunk") == F.col("own")).alias("member"), "asks")
    grouped = rows.repartition("bucket", "chunk").sortWithinPartitions("bucket", "chunk")
    return grouped.mapInArrow(_search, "word string, n long, near string, near_n long")


def spelling_forms(words: DataFrame, ratio: int = RATIO, shortest: int = SHORTEST) -> DataFrame:
    """words(word, n) -> word, n, n_near, form, form_n and root.

    Near words differ by exactly one inserted, deleted or replaced code point. The form is the near word of largest n,
    of several the smallest in code-point order, if its n is at least `ratio` (over 1) times the word's own; form_n is its n. The root is where the
    forms end, the word itself if it has none. Rows with a null word, a null n or fewer than `shortest` code points are left out; the rows of one word
    are added up. An empty table gives none. Columns of other names are not read.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1, or forms could lead in a circle")
    slim = words.select(F.col("word").cast("string").alias("word"), F.col("n").cast("long").alias("n")).where((F.length("word") >= shortest) & F.col("n").isNotNull())
    whole = cut(slim.groupBy("word").agg(F.sum("n").alias("n")))
    pairs = near_words(whole)
    both = F.explode(F.array(F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))).alias("x")
    sides = pairs.select(both).select("x.word", F.lit(None).cast("long").alias("n"), F.struct((-F.col("x.near_n")).alias("less"), F.col("x.near").alias("form")).alias("best"))
    alone = whole.select("word", "n", F.lit(None).cast(sides.schema["best"].dataType).alias("best"))
    found = alone.unionByName(sides).groupBy("word").agg(F.max("n").alias("n"), F.count("best").alias("n_near"), F.min("best").alias("best"))
    has = -F.col("best.less") >= ratio * F.col("n")
    found = cut(found.select("word", "n", "n_near", F.when(has, F.col("best.form")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")))
    # each step multiplies n, so chains are short, and a round doubles how far they are followed
    up = found.where("form IS NOT NULL").select("word", F.col("form").alias("to"))
    while True:
        on = up.select(F.col("word").alias("to"), F.col("to").alias("next"))
        up = cut(up.join(on, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        if not up.where("moved").limit(1).count():
            break
        up = up.drop("moved")
    return found.join(up.select("word", "to"), "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def typed_words(docs: DataFrame, ids: str = "doc_id", text: str = "text", shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """word and n: runs of letters of the whole texts with A to Z in lower case, some with a letter left out.

    The crc32 of `doc_id:run` says which: where 31 divides it, the code point at the crc modulo the length goes. A null text has no words, a null id is
    spelt as the empty string. Only words of at least `shortest` code points and `fewest` occurrences are returned.
    """
    runs = docs.select(named(ids).cast("string").alias("id"), F.explode(F.regexp_extract_all(named(text), F.lit(f"{LETTERS}{{{shortest},}}"), F.lit(0))).alias("run"))
    upper = "".join(map(chr, range(65, 91)))
    low = runs.select("id", F.translate("run", upper, upper.lower()).alias("run"))
    hit = low.select("run", F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % 31 == 0, short).otherwise(F.col("run"))
    return hit.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= fewest)
