"""Words of many texts as numpy arrays: where they lie, 64-bit hashes of them and of runs of them."""

from __future__ import annotations

import numpy as np

_BYTE = np.uint64(0x9E3779B97F4A7C15)
_WORD = np.uint64(0xD1342543DE82EF95)
_GRAM = np.uint64(0xA0761D6478BD642F)
_tables: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    table = _tables.get(int(base))
    if table is None or len(table) < n:
        size = 1 << max(12, (n - 1).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        table = np.multiply.accumulate(steps)
        if size <= 1 << 21:
            _tables[int(base)] = table
    return table[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values, in a new array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, number of the first word of each text and of all words) for words ``[^\\x20\\x09-\\x0D]+``."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    begins, stops = inside.copy(), inside.copy()
    cut = np.zeros(len(data) + 1, bool)  # a text begins here
    cut[offsets] = True
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    stops[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _chars(data: np.ndarray, within: np.ndarray) -> np.ndarray:
    """64 scrambled bits for each byte at its place in a word."""
    return mixed((within.astype(np.uint64) << np.uint64(8) | data) * _BYTE + _WORD)


#: ``_chars`` of all bytes at a word's first places.
_PLACES = 64
_FIRST = _chars(np.tile(np.arange(256, dtype=np.uint64), _PLACES), np.repeat(np.arange(_PLACES), 256))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a sum of scrambled bits, so no arrangement of letters is special."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    at = np.cumsum(lengths)
    within = np.arange(at[-1]) - np.repeat(at - lengths, lengths)
    chars = data[within + np.repeat(starts, lengths)]
    bits = _FIRST[np.minimum(within, _PLACES - 1) << 8 | chars]
    far = np.flatnonzero(within >= _PLACES)
    if len(far):
        bits[far] = _chars(chars[far].astype(np.uint64), within[far])
    return mixed(np.add.reduceat(bits, at - lengths))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words; shorter than ``hashes`` by n - 1."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(size, np.uint64)
    for i in range(n):
        out *= _GRAM
        out += hashes[i : i + size]
    return mixed(out)


def run_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the words from each of ``starts`` up to the one before each of ``ends``."""
    inverse = np.uint64(pow(int(_WORD), -1, 1 << 64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(_WORD, max(1, len(hashes)))[: len(hashes)])])
    value = (sums[ends] - sums[starts]) * powers(inverse, int(starts.max(initial=0)) + 1)[starts]
    return mixed(value + (ends - starts).astype(np.uint64) * _GRAM)
