"""Splitting text before the merges, with tables of words already encoded.

Tokenizer libraries merge one pre-token at a time, so a pre-token's ids can be kept and used again.
"""

from __future__ import annotations

import re
import unicodedata

import regex

#: Letters and numbers of the Latin letters below U+0180; texts of these, of ASCII and of a few signs take the fast pattern.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
NUMBERS = "0-9²³¹¼-¾"
SPACE = "\t-\r \u0085 "
SIMPLE = re.compile("[\t-\r -~ -įı-ž]*")


def fast_pattern(pattern: str) -> re.Pattern:
    """`pattern` for texts that SIMPLE matches: the properties as character sets, compiled by `re`."""
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{SPACE}{LETTERS}{NUMBERS}]")
    out = out.replace(r"[\p{L}]", f"[{LETTERS}]").replace(r"[\p{N}]", f"[{NUMBERS}]")
    out = out.replace(r"\p{L}", f"[{LETTERS}]").replace(r"\p{N}", f"[{NUMBERS}]").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")
    return re.compile(out)


#: A character that no version of Unicode has assigned.
UNASSIGNED = "\u0378"


def newer_characters() -> dict[int, str]:
    """Letters and numbers of `regex` that tiktoken's older Unicode tables don't have, each mapped to UNASSIGNED."""
    import tiktoken

    unknown = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn")
    one_byte = {bytes([i]): i for i in range(256)}
    out = {}
    for kind in (r"\p{L}", r"\p{N}"):
        other = tiktoken.Encoding("probe", pat_str=kind, mergeable_ranks=one_byte, special_tokens={})
        out |= {ord(c): UNASSIGNED for c in regex.findall(kind, unknown) if not other.encode_ordinary(c)}
    return out


class Splitter:
    """Pre-tokens of a text by `pattern`, in its order."""

    def __init__(self, pattern: str):
        self.fast, self.full = fast_pattern(pattern), regex.compile(pattern)
        self.newer = newer_characters()

    def __call__(self, text: str) -> list[str]:
        if SIMPLE.fullmatch(text):
            return self.fast.findall(text)
        plain = text.translate(self.newer)
        if plain == text:
            return self.full.findall(text)
        return [text[m.start() : m.end()] for m in self.full.finditer(plain)]


class Kept(dict):
    """Ids of pre-tokens as bytes, in two generations of `most` at most, so that its memory is bounded.

    When the new generation is full it becomes the old one; what is used again of the old one moves to the new one.
    """

    def __init__(self, encode, most: int = 350_000, longest: int = 64):
        super().__init__()
        self.encode, self.most, self.longest, self.old = encode, most, longest, {}

    def ids(self, texts: list[list[str]]) -> list[bytes]:
        """Ids of each text's pieces, joined, as little-endian unsigned 32-bit integers."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        new = set().union(*texts).difference(self)
        again = new.intersection(self.old)
        self.update((p, self.old[p]) for p in again)
        new -= again
        long = {p for p in new if len(p) > self.longest}
        new = list(new)
        self.update(zip(new, self.encode(new)))
        out = [b"".join(map(self.__getitem__, pieces)) for pieces in texts]
        for p in long:
            del self[p]
        return out


def blocks(texts: list[str], chars: int = 2_000_000) -> list[list[str]]:
    """Consecutive texts, so many that a block has `chars` characters or a little more."""
    out: list[list[str]] = []
    size = chars
    for t in texts:
        if size >= chars:
            out.append([])
            size = 0
        out[-1].append(t)
        size += len(t)
    return out
