"""Vectorised 64-bit hashes of words and word shingles of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: one odd random value per byte value, fixed by the seed
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_POWERS = np.ones(1, dtype=np.uint64)
#: bytes of text that a task hashes at once where it holds much besides; the hashes' arrays take about 30 times as much
FEW_BYTES = 1 << 18


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 64), _BASE, dtype=np.uint64)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def blocks(texts: Sequence[bytes], limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes together (a longer text alone)."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number, first byte and byte length of each word of the texts, in order.

    Words are runs of bytes other than ASCII white space.  Byte offsets are
    within the texts joined by one white-space byte.
    """
    raw = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    none = np.zeros(0, dtype=np.int64)
    if not len(raw):
        return np.zeros(0, dtype=np.uint64), none, none, none
    white = _WHITE[raw]
    begins = ~white
    begins[1:] &= white[:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), none, none, none
    raw, white = raw[starts[0]:], white[starts[0]:]
    at = starts - starts[0]
    within = np.arange(len(raw)) - np.repeat(at, np.diff(np.r_[at, len(raw)]))
    values = _BYTE[raw] * _powers(int(within.max()) + 1)[within]
    values[white] = 0
    lengths = np.add.reduceat(~white, at, dtype=np.int64)
    hashes = mix(np.add.reduceat(values, at) + lengths.astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.searchsorted(ends, starts, side="right"), starts, lengths


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words (empty when there are fewer)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out += words[j:j + n] * (_powers(2 * k + 2)[2 * j + 1] | U64(1))
    return mix(out)
