"""Words and their hashes for whole batches of texts at once, inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space that parts words: U+0020 and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
# A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class _Powers:
    """Powers of the base and of its inverse, as far as any text so far has needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 20)
            self.up = np.full(size, _BASE, np.uint64)
            self.down = np.full(size, _INVERSE, np.uint64)
            self.up[0] = self.down[0] = 1
            np.multiply.accumulate(self.up, out=self.up)
            np.multiply.accumulate(self.down, out=self.down)
        return self.up, self.down


_POWERS = _Powers()


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each begins (with the end of the last); null is empty."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(texts: pa.Array, most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges with about ``most`` bytes of text each, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    if not len(sizes):
        return
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
    edges = [0, *cuts.tolist(), len(sizes)]
    yield from zip(edges, edges[1:], strict=False)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and at which word each text begins (with the total at the end).

    A word is a run of bytes other than the six white-space ones, A-Z lower-cased.  The hash is a
    polynomial over the word's bytes modulo 2**64, mixed; equal words have equal hashes wherever
    they stand.
    """
    data, at = raw(texts)
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    inside = ~SPACE[data]
    # A text also ends a word.
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    firsts = at[:-1][at[:-1] < n]
    starts[firsts] = inside[firsts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    lasts = at[1:][at[1:] > 0] - 1
    ends[lasts] = inside[lasts]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends)
    up, down = _POWERS.upto(n)
    value = LOWER[data].astype(np.uint64)
    value += _U(1)
    value *= up[:n]
    np.cumsum(value, out=value)
    total = value[e]
    before = value[s - 1]
    before[s == 0] = 0
    return mix((total - before) * down[s]), np.searchsorted(s, at)


def hashes_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of stretches of bytes; equal stretches have equal hashes wherever they stand."""
    up, down = _POWERS.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * up[: len(data)], out=total[1:])
    return mix((total[starts + lengths] - total[starts]) * down[starts] + lengths.astype(np.uint64))


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two, in this order."""
    return mix(a * _U(_BASE) + b)


def ngram_hashes(words: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words within a text, and at which each text's runs begin.

    A text of fewer words, but one at least, has its whole sequence as one run.
    """
    count = np.diff(at)
    runs = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(runs)])
    first = np.repeat(at[:-1] - begin[:-1], runs) + np.arange(begin[-1])
    length = np.repeat(np.minimum(count, n), runs)
    out = length.astype(np.uint64)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    for k in range(n):
        step = out * _U(_BASE) + padded[first + k]
        out = step if n == 1 else np.where(k < length, step, out)
    return mix(out), begin
