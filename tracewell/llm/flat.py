"""Vectorised views of many short texts at once.

A batch of texts becomes one byte string in which words are separated by one
space and documents by one line feed. Word bounds, document numbers and
n-word hashes are then numpy arrays, so the cost per word is a few machine
operations and not a few Python objects.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Odd multiplier of the polynomial hash and its inverse modulo 2**64.
_G = 0x9E3779B97F4A7C15
_G_INV = pow(_G, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for the next batch while small."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 1 << 21:
            _powers[base] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(arr: np.ndarray) -> np.ndarray:
    out = np.zeros(len(arr) + 1, np.uint64)
    vals = arr.astype(np.uint64)
    vals += np.uint64(1)
    vals *= _power(_G, len(vals))
    np.cumsum(vals, out=out[1:])
    return out


def hash_ranges(arr: np.ndarray, start: np.ndarray, end: np.ndarray, prefix: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the byte ranges start..end of arr, a function of their bytes alone."""
    p = prefix_sums(arr) if prefix is None else prefix
    out = p[end] - p[start]
    out *= _power(_G_INV, len(arr) + 1)[start]
    out += (end - start).astype(np.uint64)
    return mix64(out)


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of characters other than space and \\x09-\\x0d, as UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class Flat:
    """Words of a batch of documents in document order.

    start, end: byte bounds in `data`; doc: number of the document in the batch.
    """

    def __init__(self, joined: list[bytes]):
        self.data = b"\n".join(joined)
        arr = np.frombuffer(self.data, np.uint8)
        cut = np.flatnonzero((arr == 32) | (arr == 10))
        start = np.concatenate([np.zeros(1, np.int64), cut + 1])
        end = np.concatenate([cut, np.array([len(arr)], np.int64)])
        doc = np.concatenate([np.zeros(1, np.int64), np.cumsum(arr[cut] == 10)])
        full = end > start
        self.start, self.end, self.doc = start[full], end[full], doc[full]
        self.n_docs = len(joined)
        self._arr = arr

    def __len__(self) -> int:
        return len(self.start)

    def prefix(self) -> np.ndarray:
        if not hasattr(self, "_prefix"):
            self._prefix = prefix_sums(self._arr)
        return self._prefix

    def hash_bytes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges, a function of the bytes alone."""
        return hash_ranges(self._arr, start, end, self.prefix())

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of n words inside one document."""
        if len(self) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[: len(self) - n + 1] == self.doc[n - 1 :])
        return at, self.hash_bytes(self.start[at], self.end[at + n - 1])


#: Bytes of text in one flat view, at most, where it shares a worker with much else: its sums and powers take some 50 times that.
FLAT_BYTES = 1 << 18


def batches(sizes: list[int], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Cuts 0..len(sizes) into runs of at most `most` bytes, or of one long text."""
    at = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield at, i
            at, total = i, 0
        total += n + 1
    if at < len(sizes):
        yield at, len(sizes)
