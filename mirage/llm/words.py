"""Words of many texts at once, as numpy arrays (runs inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.array([1], np.uint64)]
#: Words that are hashed at a time.
SLICE = 100_000


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        _POWERS[0] = np.cumprod(np.r_[np.uint64(1), np.full(2 * n, _BASE, np.uint64)], dtype=np.uint64)
    return _POWERS[0]


class Words:
    """Words of the byte strings ``texts``: byte positions ``start`` and
    ``end`` in ``data``, number of the text ``text``, 64-bit ``hash``, and
    ``first``/``count``: each text's first word and number of words."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.data = b"\n".join(texts)
        raw = np.frombuffer(self.data, np.uint8)
        inside = np.empty(len(raw) + 2, bool)
        inside[0] = inside[-1] = False
        np.logical_not(_SPACE[raw], out=inside[1:-1])
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = turns[0::2], turns[1::2]
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        bounds = np.cumsum(sizes)
        self.first = np.searchsorted(self.start, bounds - sizes)
        self.count = np.searchsorted(self.start, bounds) - self.first
        self.text = np.repeat(np.arange(len(texts)), self.count)
        lengths = self.end - self.start
        if not len(lengths):
            self.hash = np.zeros(0, np.uint64)
            return
        # In slices: the arrays over bytes are many times the size of the text.
        self.hash = np.empty(len(lengths), np.uint64)
        for lo in range(0, len(lengths), SLICE):
            self.hash[lo:lo + SLICE] = self._hash(raw[self.start[lo]:self.end[min(lo + SLICE, len(lengths)) - 1]],
                                                  lengths[lo:lo + SLICE], lower)

    def _hash(self, raw: np.ndarray, lengths: np.ndarray, lower: bool) -> np.ndarray:
        """Hashes of the words in ``raw``, which starts and ends with one."""
        at = np.cumsum(lengths) - lengths
        value = raw[~_SPACE[raw]].astype(np.uint64)
        if lower:
            value |= ((value >= 65) & (value <= 90)).astype(np.uint64) << np.uint64(5)
        value += np.uint64(1)
        value *= powers(int(lengths.max()))[np.arange(len(value)) - np.repeat(at, lengths)]
        return mix(np.add.reduceat(value, at) + lengths.astype(np.uint64))


def runs_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive word hashes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out *= np.uint64(_BASE)
        out += h[k:len(h) - n + 1 + k]
    return mix(out)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Smallest of every ``n`` consecutive values."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that each holds about ``most`` bytes of text (or
    one row), in the order they come."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array([x or 0 for x in pa.compute.binary_length(batch.column(text)).to_pylist()], np.int64)
        part = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def raw_texts(column: pa.Array) -> list[bytes]:
    """The column's strings as bytes, a missing one as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
