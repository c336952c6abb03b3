"""Presence of hashed character n-grams, for the classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Code points below 128 that aren't letters are one character to the language kernel.
PLAIN = np.arange(128, dtype=np.uint32)
PLAIN[[c for c in range(128) if not chr(c).isalpha()]] = 32


class Presence:
    """Sorted indexes of the n-grams (of each length in `lengths`) that a text has, hashed to `1 << bits` buckets."""

    def __init__(self, lengths: range, bits: int, letters: bool):
        self.lengths, self.bits, self.letters = lengths, bits, letters
        self.seen = np.zeros(1 << bits, bool)

    def codes(self, text: str) -> np.ndarray:
        if self.letters:
            text = f" {text.lower()} "
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if self.letters:
            c = np.where(c < 128, PLAIN[np.minimum(c, 127)], c)
        return c

    def __call__(self, text: str) -> np.ndarray:
        c = self.codes(text)
        h = np.zeros(len(c), np.uint32)
        with np.errstate(over="ignore"):
            for n in range(1, self.lengths.stop):
                if n > len(c):
                    break
                h = (h[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :] + np.uint32(1)) * np.uint32(0x9E3779B1)
                if n in self.lengths:
                    self.seen[(h ^ h >> np.uint32(15)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - self.bits)] = True
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found.astype(np.int32)


def sums(weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """The product of a batch's presence matrix with `weights`: a row of sums for each text."""
    out = np.zeros((len(rows), weights.shape[1]))
    full = [i for i, r in enumerate(rows) if len(r)]
    if full:
        ends = np.cumsum([len(rows[i]) for i in full])
        out[full] = np.add.reduceat(weights[np.concatenate([rows[i] for i in full])], np.concatenate([[0], ends[:-1]]), axis=0)
    return out


def batches(rows: Iterator, size: int) -> Iterator[list]:
    part: list = []
    for row in rows:
        part.append(row)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part
