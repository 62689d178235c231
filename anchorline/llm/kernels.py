"""Numpy routines over Arrow string columns, run inside tasks.

Hashes are polynomials modulo 2**64 taken from running sums, so the hash of any range of tokens costs two look-ups.
They route work and find candidates; where a result must be exact, the bytes themselves are compared afterwards.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BASE = 0x9E3779B97F4A7C15
CHUNK = 1 << 18  # tokens handled at a time
PLACE_BITS = 20  # enough for the places inside a chunk and its margin


def mix(x: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit function of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, modulo 2**64."""
    both = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(max(n, 1), base, np.uint64)
        p[0] = 1
        both.append(np.cumprod(p, dtype=np.uint64))
    return both[0], both[1]


class RangeHash:
    """Hashes of ranges of a sequence of 64-bit codes."""

    def __init__(self, codes: np.ndarray, scale: tuple[np.ndarray, np.ndarray] | None = None):
        up, self.down = scale if scale is not None and len(scale[0]) > len(codes) else powers(len(codes) + 1)
        self.sums = np.empty(len(codes) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(codes * up[: len(codes)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """Of every range of k codes."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:-k]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def joined_bytes(texts: pa.Array, end: str = "") -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (null: empty) one after another, each followed by ``end``, and their bounds."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if end:
        texts = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar(end, pa.large_string()))
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def text_bounds(texts: pa.Array) -> np.ndarray:
    """Bounds of the texts' bytes, without touching the bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate([[0], np.cumsum(sizes)])


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the ranges [start, start + size), one range after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def slices_of(bounds: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of items that hold about ``limit`` units each; an item is never split."""
    n, a = len(bounds) - 1, 0
    while a < n:
        b = max(int(np.searchsorted(bounds, bounds[a] + limit, "right")) - 1, a + 1)
        yield a, b
        a = b


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the two-byte capitals À to Þ."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    out = table[data]
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    capital = after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    out[capital] += 32
    return out


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ASCII letters, digits and bytes from 0x80 on that do not cross ``bounds``: starts, ends, and the number
    of words before each bound."""
    part = np.zeros(256, bool)
    part[48:58] = part[65:91] = part[97:123] = True
    part[128:] = True
    inside = part[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begin[cuts] = inside[cuts]
    end[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, bounds)


class ByteTokens:
    """Each byte is a token."""

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = joined_bytes(texts)
        self.table = byte_codes()

    def codes(self, lo: int, hi: int) -> np.ndarray:
        return self.table[self.data[lo:hi]]

    def byte_range(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return lo, hi


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    table, scale, out = byte_codes(), powers(CHUNK + 1), np.empty(len(starts), np.uint64)
    for a, b in slices_of(np.append(starts, len(data)), CHUNK) if len(starts) else ():
        lo = starts[a]
        found = RangeHash(table[data[lo : ends[b - 1]]], scale)
        out[a:b] = found.of(starts[a:b] - lo, ends[a:b] - lo)
    return out


SPACES = (9, 10, 11, 12, 13, 32)


class WordTokens:
    """Words are runs of bytes other than ASCII white space; ``data`` holds them, each followed by one blank."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        raw, bounds = joined_bytes(texts, "\n")
        if lower:  # A-Z only
            raw = raw + (((raw >= 65) & (raw <= 90)) * np.uint8(32))
        solid = np.ones(256, bool)
        solid[list(SPACES)] = False
        word = solid[raw]
        keep = word.copy()
        keep[1:] |= word[:-1]
        self.data = np.where(word, raw, np.uint8(32))[keep]
        ends = np.flatnonzero(~word[keep])
        self.starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        self.ends = ends
        first = word.copy()
        first[1:] &= ~word[:-1]
        self.offsets = np.searchsorted(np.flatnonzero(first), bounds)
        self.hashes = word_hashes(self.data, self.starts, self.ends)


    def codes(self, lo: int, hi: int) -> np.ndarray:
        return self.hashes[lo:hi]

    def byte_range(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.starts[lo], self.ends[hi - 1]


def anchored_runs(tokens, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of ``span`` tokens that share an anchor: first window, last window, hash of the anchor.

    The anchor of a window is its leftmost gram of least hash, so equal windows anywhere have equal anchors. Every
    window inside a text belongs to exactly one run; windows over a text's end belong to none.
    """
    width, n = span - gram + 1, int(tokens.offsets[-1])
    scale, mask = powers(CHUNK + span + 1), np.uint64((1 << PLACE_BITS) - 1)
    firsts, lasts, hashes = [], [], []
    ends = tokens.offsets[1:]
    for lo in range(0, n - span + 1, CHUNK):
        hi = min(lo + CHUNK, n - span + 1)
        grams = RangeHash(tokens.codes(lo, hi + span - 1), scale).grams(gram)
        least = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[: hi - lo], least[width - size : width - size + hi - lo])
        place = (least[: hi - lo] & mask).astype(np.int64)
        near = ends[np.searchsorted(ends, lo, "right") : np.searchsorted(ends, hi + span, "left")]
        over = (np.unique(near)[:, None] - lo - np.arange(1, span)).ravel()
        place[over[(over >= 0) & (over < hi - lo)]] = -1
        starts = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
        stops = np.concatenate([starts[1:], [hi - lo]]) - 1
        real = place[starts] >= 0
        starts, stops = starts[real], stops[real]
        firsts.append(starts + lo)
        lasts.append(stops + lo)
        hashes.append(grams[place[starts]])
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(firsts), np.concatenate(lasts), mix(np.concatenate(hashes) + np.uint64(1))
