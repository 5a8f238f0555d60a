"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The words of the vocabulary are compiled into a shared-suffix automaton whose arcs carry the
number of words that leave a state before them. The sum along a word's path is
the word's rank, and the rank leads to its id sequence, so states with one
suffix language are shared although the outputs differ. The automaton is a
handful of integer arrays, memory-mapped by each worker from a file that is
unlinked as soon as it is mapped. A word that the lexicon lacks is merged
exactly, lowest rank first. The lexicon only saves time: no result depends on
which words it holds.
"""

from __future__ import annotations

import json
import mmap
import re
import tempfile
import unicodedata
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import beside, small, spare, without

#: Distinct words that a worker remembers at once.
MEMO = 300_000
#: Rows that a worker codes at once: their texts, ids and decoded texts live together.
SLICE = 64
OUT = ["ids", "decoded"]

# Fixed values of the vocabulary file's format: its word pattern, white space, and the byte alphabet.
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
#: The same pattern for texts within Latin-1, where the letters and numbers can be named.
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\sa-z0-9ªµºß-öø-ÿ²³¹¼½¾]+")
_END = "</w>"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
    return [other.get(b, chr(b)) for b in range(256)]


class Lexicon:
    """Word -> rank in a minimal acyclic automaton over bytes; arrays only."""

    def __init__(self, first, label, target, before, root: int, offset, ids):
        self.first, self.label, self.target, self.before, self.root, self.offset, self.ids = first, label, target, before, root, offset, ids

    @classmethod
    def build(cls, words: dict[bytes, list[int]]) -> Lexicon:
        """Adds the words in order and freezes each state once no later word can reach it."""
        order = sorted(words)
        register: dict[tuple, int] = {}
        states: list[tuple] = []  # (is a word, ((label, state), ...))
        path: list[list] = [[False, []]]
        text = b""

        def freeze(depth: int) -> None:
            while len(path) - 1 > depth:
                final, arcs = path.pop()
                key = (final, tuple(arcs))
                if key not in register:
                    register[key] = len(states)
                    states.append(key)
                path[-1][1][-1] = (path[-1][1][-1][0], register[key])

        for word in order:
            same = 0
            while same < min(len(word), len(text)) and word[same] == text[same]:
                same += 1
            freeze(same)
            for b in word[same:]:
                path[-1][1].append((b, -1))
                path.append([False, []])
            path[-1][0] = True
            text = word
        freeze(0)
        states.append((path[0][0], tuple(path[0][1])))
        count: list[int] = []
        for final, arcs in states:  # targets come before their sources
            count.append(final + sum(count[t] for _, t in arcs))
        first, label, target, before = [0], [], [], []
        for final, arcs in states:
            n = int(final)
            for b, t in sorted(arcs):
                label.append(b)
                target.append(t)
                before.append(n)
                n += count[t]
            first.append(len(label))
        final = np.array([s[0] for s in states], np.int32)
        offset = np.concatenate([[0], np.cumsum([len(words[w]) for w in order])]).astype(np.int32)
        flat = np.array([i for w in order for i in words[w]], np.int32)
        out = cls(np.array(first, np.int32) * 2, np.array(label, np.int32), np.array(target, np.int32), np.array(before, np.int32), len(states) - 1, offset, flat)
        out.first[:-1] |= final  # the lowest bit says whether a word ends here
        return out

    @property
    def n_states(self) -> int:
        return len(self.first) - 1

    def rank(self, word: bytes) -> int:
        state, rank = self.root, 0
        first, label, target, before = self.first, self.label, self.target, self.before
        for b in word:
            hi = first[state + 1] >> 1
            arc = bisect_left(label, b, first[state] >> 1, hi)
            if arc == hi or label[arc] != b:
                return -1
            rank += before[arc]
            state = target[arc]
        return rank if first[state] & 1 else -1

    def get(self, word: bytes) -> list[int] | None:
        r = self.rank(word)
        return None if r < 0 else list(self.ids[self.offset[r] : self.offset[r + 1]])

    def to_bytes(self) -> bytes:
        parts = [self.first, self.label, self.target, self.before, self.offset, self.ids]
        head = np.array([self.root, *map(len, parts)], np.int32)
        return b"".join(x.astype(np.int32).tobytes() for x in (head, *parts))

    @classmethod
    def mapped(cls, data: bytes) -> Lexicon:
        """The arrays as views of a read-only memory map; its scratch file is gone once mapped."""
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            view = memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)).cast("i")
        cuts = list(accumulate([7, *view[1:7]]))
        first, label, target, before, offset, ids = (view[a:b] for a, b in zip(cuts, cuts[1:]))
        return cls(first, label, target, before, view[0], offset, ids)


class _Memo(dict):
    """Ids of the words met lately."""

    def __init__(self, miss):
        super().__init__()
        self.miss = miss

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= MEMO:
            self.clear()
        self[word] = out = self.miss(word)
        return out


class Bpe:
    def __init__(self, spec: str, lexicon: bytes | None = None):
        d = json.loads(spec)
        self.vocab: dict[str, int] = d["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in d["model"]["merges"]]
        self.ranks = {m: i for i, m in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.cut = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.alphabet = byte_alphabet()
        self.lexicon = Lexicon.mapped(lexicon) if lexicon else None
        self.memo = _Memo(self.word)

    def merge(self, word: str) -> list[int]:
        """Ids of one word: the pair of the lowest rank is joined, leftmost first, until none is left.

        Long words keep their pairs in a heap, so the time is n log n.
        """
        import heapq

        parts = [self.alphabet[b] for b in word.encode("utf-8", "surrogatepass")]
        parts[-1] += _END
        n = len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (r := self.ranks.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [self.vocab[p] for p in parts if p and p in self.vocab]

    def word(self, word: str) -> tuple[int, ...]:
        got = self.lexicon.get(word.encode("utf-8", "surrogatepass")) if self.lexicon else None
        return tuple(self.merge(word) if got is None else got)

    @staticmethod
    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
            if not _ODD.search(text):
                return _PLAIN.findall(text.lower())
        except UnicodeEncodeError:
            pass
        text = _SPACE.sub(" ", unicodedata.normalize("NFC", text))
        return _WORD.findall(text.replace("Σ", "σ").lower())

    def _plain(self, text: str, out: list[int]) -> None:
        out.extend(chain.from_iterable(map(self.memo.__getitem__, self.split(text))))

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        at = 0
        for m in self.cut.finditer(text or "") if self.cut and "<|" in (text or "") else ():
            self._plain(text[at : m.start()], out)
            out.append(self.special[m[0]])
            at = m.end()
        self._plain((text or "")[at:], out)
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens of the ids with one space between them: the file names no decoder."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])


#: Characters on which the ASCII pattern's white space differs from the file's.
_ODD = re.compile("[\x1c-\x1f]")


@lru_cache(maxsize=1)
def _bpe(spec: str, lexicon: bytes) -> Bpe:
    return Bpe(spec, lexicon)


def vocabulary_words(bpe: Bpe) -> list[str]:
    """The whole words that have an id of their own."""
    code = {c: b for b, c in enumerate(bpe.alphabet)}
    words = []
    for token in bpe.vocab:
        if token.endswith(_END) and token != _END:
            try:
                words.append(bytes(map(code.__getitem__, token[: -len(_END)])).decode())
            except (KeyError, UnicodeDecodeError):  # no text has such a word
                continue
    return words


def compile_lexicon(spec: str, texts: list[str] | None = None) -> bytes:
    """The lexicon of the vocabulary's own words, or of those in `texts`."""
    bpe = Bpe(spec)
    words = vocabulary_words(bpe) if texts is None else {w for t in texts for w in Bpe.split(t)}
    return Lexicon.build({w.encode("utf-8", "surrogatepass"): bpe.merge(w) for w in words}).to_bytes()


def _run(spec: str, lexicon: bytes, at: int, kept: int, digest: bool):
    import hashlib

    def run(it):
        bpe = _bpe(spec, lexicon)
        bpe.memo.clear()  # a worker outlives its task; its memory should not
        for batch in small(it, SLICE):
            n, ids, decoded = [], [], []
            for t in batch.column(at).to_pylist():
                got = bpe.encode(t)
                back = bpe.decode(got)
                if digest:
                    n.append(len(got))
                    ids.append(hashlib.sha256(np.array(got, "<u4").tobytes()).hexdigest())
                    decoded.append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                else:
                    ids.append(np.array(got, np.int32))
                    decoded.append(back)
            cols, keep = [batch.column(i) for i in range(kept)], batch.schema.names[:kept]
            if digest:
                yield pa.record_batch([*cols, pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], [*keep, "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.record_batch([*cols, pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], [*keep, "ids", "decoded"])
        bpe.memo.clear()
        spare()

    return run


def bpe_codec(docs: DataFrame, spec_path: str, text: str = "text", digest: bool = False) -> DataFrame:
    """docs but for the text, plus ids array<int> and decoded string; with digest: n_tokens, ids_sha256 and decoded_sha256 instead.

    The ids equal those of the vocabulary's own library without special tokens added; special tokens
    that stand in a text are recognised. decoded is its decode() with special tokens kept. Null and empty
    texts give no ids and an empty string. A text may be of any length; words are merged in n log n. Repeated
    rows are coded alike and an empty table gives none.
    Input columns named like an output are replaced. spec_path is read on the driver; its content travels with the task. The lexicon is made from it alone, no row is read for it.
    """
    with open(spec_path, encoding="utf-8") as f:
        spec = f.read()
    lexicon = compile_lexicon(spec)
    outs = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else OUT
    kinds = [T.LongType(), T.StringType(), T.StringType()] if digest else [T.ArrayType(T.IntegerType()), T.StringType()]
    base, at, n = beside(docs, outs, text, without(docs, [text]))
    schema = T.StructType([*base.schema.fields[:n], *(T.StructField(x, k) for x, k in zip(outs, kinds))])
    return base.mapInArrow(_run(spec, lexicon, at, n, digest), schema)
