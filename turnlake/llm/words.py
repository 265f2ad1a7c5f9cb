"""Vectorised word hashing over Arrow text columns, for operators that run in tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at once; a longer document is handled alone.
CHUNK = 1 << 18
_rng = np.random.Generator(np.random.PCG64(20240229))
_weights = _rng.integers(0, 2**63, 1 << 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes between words of ASCII letters, digits and whatever is beyond ASCII.
NOT_ALPHANUMERIC = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def weights(n: int) -> np.ndarray:
    """n odd 64-bit constants, the same in every process."""
    global _weights
    while len(_weights) < n:
        more = np.random.Generator(np.random.PCG64(len(_weights))).integers(0, 2**63, len(_weights), dtype=np.uint64)
        _weights = np.concatenate([_weights, more * np.uint64(2) + np.uint64(1)])
    return _weights[:n]


_BASE = int(_weights[0])
_powers: tuple[np.ndarray, np.ndarray] | None = None


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd constant and of its inverse, modulo 2^64; those that a chunk needs are kept."""
    global _powers
    if n > CHUNK:
        return tuple(_raised(b, n) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    if _powers is None:
        _powers = tuple(_raised(b, CHUNK) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return _powers[0][:n], _powers[1][:n]


def _raised(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Words:
    """Words of consecutive texts: hashes, byte spans, and where each text's words begin (`first`, n + 1 entries)."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool = False, lines: bool = False, between: np.ndarray = _WHITE):
        inner = ~between[data]
        if lower:
            data = _LOWER[data]
        self.data = data
        begins, ends = inner.copy(), inner.copy()
        if len(data) > 1:
            begins[1:] &= ~inner[:-1]
            ends[:-1] &= ~inner[1:]
            # words end with their text
            cut = bounds[1:-1]
            cut = cut[(cut > 0) & (cut < len(data))]
            begins[cut] |= inner[cut]
            ends[cut - 1] |= inner[cut - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        # a word's hash is that of its bytes as a polynomial, from sums over all bytes before its start and its end
        sums = np.zeros(len(data) + 1, np.uint64)
        up, down = powers(len(data))
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
        self.hash = mixed((sums[self.end] - sums[self.start]) * down[self.start])
        self.first = np.searchsorted(self.start, bounds)
        self.bounds = bounds
        if lines:
            self.breaks = np.flatnonzero(data == 10)


def byte_chunks(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, bounds of the texts in them) of runs of texts of about `size` bytes, over an Arrow string array without nulls."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts):
        return
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
        yield at, raw[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to


def chunks(texts: pa.Array, lower: bool = False, lines: bool = False, between: np.ndarray = _WHITE, size: int | None = None) -> Iterator[tuple[int, int, Words]]:
    """(from, to, words of the texts from..to) over an Arrow string array without nulls."""
    for at, data, bounds in byte_chunks(texts, size or CHUNK):
        yield at, at + len(bounds) - 1, Words(data, bounds, lower, lines, between)


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside a text, and the first gram of each text (n_texts + 1 entries).

    A text of fewer words, but some, has one gram: all its words.
    """
    h, first = words.hash, words.first
    counts = np.diff(first)
    sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    # where each gram starts among the words
    at = np.repeat(first[:-1] - begin[:-1], sizes) + np.arange(begin[-1])
    w = weights(n + 1)
    out = np.full(len(at), w[n], np.uint64)
    last = np.repeat(first[1:], sizes)
    for i in range(n):
        j = at + i
        inside = j < last
        if inside.all():
            out += h[j] * w[i]
        else:
            out[inside] += h[j[inside]] * w[i]
            # a shorter sequence differs from any longer one
            out[~inside] += w[i]
    return mixed(out), begin


def long_array(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def list_array(values: pa.Array, begin: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), values)
