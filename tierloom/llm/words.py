"""Words of many texts at once, as byte ranges and 64-bit hashes, straight from Arrow's buffers.

A word is a run of bytes other than \\x20 and \\x09-\\x0D. Hashes are polynomials modulo 2**64 over random
byte and word values, so that the hash of any span of words is a difference of prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
VALUES = np.random.default_rng(7).integers(1, 2**64, 256, np.uint64)
LOWER = VALUES.copy()
LOWER[65:91] = LOWER[97:123]
BYTE, WORD = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Texts are taken together up to so many bytes, words are hashed so many at a time.
CHUNK_BYTES, HASH_WORDS = 1 << 18, 1 << 15
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2**64 for i < n at least."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads each bit over all."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values) + 1)[: len(values)], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the ranges [start, end) of what `sums` is the prefix of; equal ranges have equal hashes wherever they stand."""
    return (sums[end] - sums[start]) * powers(pow(base, -1, 1 << 64), len(sums) + 1)[start]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and the offsets of each; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK_BYTES; a longer text is a range of its own."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK_BYTES, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


@dataclass
class Words:
    doc: np.ndarray  # of each word, from 0
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each document, and the number of all words at the end


def words(data: np.ndarray, offsets: np.ndarray, low: int, high: int, lower: bool = False) -> Words:
    """Words of the texts low..high; positions are relative to the first of them."""
    part = data[offsets[low] : offsets[high]]
    at = offsets[low : high + 1] - offsets[low]
    letter = ~SPACE[part]
    opens, closes = letter.copy(), letter.copy()
    opens[1:] &= ~letter[:-1]
    closes[:-1] &= ~letter[1:]
    inner = at[(at > 0) & (at < len(part))]
    opens[inner] = letter[inner]
    closes[inner - 1] = letter[inner - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    doc = np.searchsorted(at, start, "right") - 1
    out = np.empty(len(start), np.uint64)
    table = LOWER if lower else VALUES
    for a in range(0, len(start), HASH_WORDS):
        b = min(a + HASH_WORDS, len(start))
        base = start[a]
        sums = prefix(table[part[base : end[b - 1]]], BYTE)
        out[a:b] = mix(spans(sums, start[a:b] - base, end[a:b] - base, BYTE))
    return Words(doc, start, end, out, np.searchsorted(doc, np.arange(high - low + 1)))
