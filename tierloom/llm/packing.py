"""Hierarchical multi-length packing of documents into token sequences.

Context sizes are tiers: powers of two up to `longest`. Whole windows of the longest tier are cut from long
documents; what is left of a document goes to the smallest tier that holds it. Tiers are packed from the longest down:
each window opens with a document of its tier, its gap is filled with the longest pieces of the shorter tiers that
fit, and, when none does, with the head of the shortest document left. So all windows are full; the last
tokens of a block become windows of shorter tiers, which need no padding either. Each block's sequences are then dealt to step
groups of equal token counts.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from array import array
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierloom.llm.shared import small_batches
from tierloom.llm.tokenize import SIMPLE, Kept, blocks, fast_pattern

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
#: A task packs its documents in blocks of about so many tokens, which bounds its memory.
BLOCK_TOKENS = 4 << 20
#: Sequence and step ids are the task's number times this plus a number within the task.
IDS = 1 << 36


def _byte_letters() -> dict[int, int]:
    """The public byte-level alphabet: printable Latin characters stand for themselves, other bytes for U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in plain)}


BYTE_LETTERS = _byte_letters()


def pack(lengths: list[int], longest: int = 2048) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences as (tier, [(document, start, length), ...]) for documents of the given lengths.

    Each token of each document lies in one piece, and each sequence is as long as its tier.
    """
    out: list[tuple[int, list[tuple[int, int, int]]]] = []
    waiting: dict[int, deque[tuple[int, int]]] = defaultdict(deque)  # (document, start) by length of the rest
    have = 0  # bit n is set if a rest of length n waits

    def put(doc: int, start: int, n: int) -> None:
        nonlocal have
        waiting[n].append((doc, start))
        have |= 1 << n

    def take(n: int) -> tuple[int, int]:
        nonlocal have
        rest = waiting[n]
        found = rest.popleft()
        if not rest:
            have ^= 1 << n
        return found

    for doc, n in enumerate(lengths):
        whole = n - n % longest
        out += [(longest, [(doc, at, longest)]) for at in range(0, whole, longest)]
        if n % longest:
            put(doc, whole, n % longest)
    tier = longest
    left: list[tuple[int, int, int]] = []
    while have:
        n = have.bit_length() - 1  # the longest rest
        while tier // 2 >= n and tier > 1:
            tier //= 2
        doc, start = take(n)
        window, gap = [(doc, start, n)], tier - n
        while gap and have:
            fits = (have & ((1 << gap + 1) - 1)).bit_length() - 1
            if fits > 0:
                window.append((*take(fits), fits))
                gap -= fits
            else:
                n = (have & -have).bit_length() - 1  # the shortest rest: its head fills the gap
                doc, start = take(n)
                window.append((doc, start, gap))
                put(doc, start + gap, n - gap)
                gap = 0
        if gap:
            left = window
        else:
            out.append((tier, window))
    # the last window isn't full: it is cut into windows of shorter tiers
    pieces, total = deque(left), sum(x[2] for x in left)
    while total:
        tier = 1 << total.bit_length() - 1
        window, gap = [], tier
        while gap:
            doc, start, n = pieces.popleft()
            window.append((doc, start, min(n, gap)))
            if n > gap:
                pieces.appendleft((doc, start + gap, n - gap))
            gap -= min(n, gap)
        out.append((tier, window))
        total -= tier
    return out


def step_groups(tiers: list[int], tokens: int) -> list[int]:
    """A step group for each sequence: as many groups as hold `tokens` each, longest sequences first to the emptiest group."""
    n = max(1, -(-sum(tiers) // tokens))
    load = [(0, g) for g in range(n)]
    out = [0] * len(tiers)
    for i in sorted(range(len(tiers)), key=lambda i: (-tiers[i], i)):
        now, g = heapq.heappop(load)
        out[i] = g
        heapq.heappush(load, (now + tiers[i], g))
    return out


class WordTokens:
    """Ids of whole texts by a `tokenizers` file whose text is lower-cased and cut into words before the merges.

    Texts of plain Latin characters are cut here and encoded word by word, with words kept; others are left to the library.
    """

    def __init__(self, data: str, ordinary_specials: bool = False):
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(data)
        self.tok.encode_special_tokens = ordinary_specials
        spec = json.loads(data)
        self.words = None
        steps = spec["pre_tokenizer"].get("pretokenizers", [{}]) if spec.get("pre_tokenizer") else [{}]
        norms = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        if norms == ["NFC", "Replace", "Lowercase"] and steps[0].get("type") == "Split" and steps[0]["invert"] and steps[0]["behavior"] == "Removed" and steps[1]["type"] == "ByteLevel" and not steps[1]["use_regex"]:
            self.words = fast_pattern(steps[0]["pattern"]["Regex"])
            self.model = self.tok.model  # its merges alone, for words that are cut and lower-cased already
        specials = [re.escape(t["content"]) for t in spec.get("added_tokens") or [] if not (t["special"] and ordinary_specials)]
        self.specials = re.compile("|".join(specials), re.IGNORECASE) if specials else None  # left to the library, which may look for them before or after it lower-cases
        self.kept = Kept(self._merge)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _merge(self, words: list[str]) -> list[bytes]:
        merge = self.model.tokenize
        mapped = [w if w.isascii() else w.encode().decode("latin-1").translate(BYTE_LETTERS) for w in words]
        return [array("I", [t.id for t in merge(w)]).tobytes() for w in mapped]

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [i for i, t in enumerate(texts) if self.words and SIMPLE.fullmatch(t) and not (self.specials and self.specials.search(t))]
        out: list[bytes] = [b""] * len(texts)
        for i, ids in zip(plain, self.kept.ids([self.words.findall(texts[i].lower()) for i in plain])):
            out[i] = ids
        rest = sorted(set(range(len(texts))) - set(plain))
        for i, ids in zip(rest, self._encode([texts[i] for i in rest])):
            out[i] = ids
        return out


_OPEN: dict[str, WordTokens] = {}


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, longest: int = 2048, step_tokens: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text", ordinary_specials: bool = False) -> DataFrame:
    """Tokenise and pack all documents: one row per piece (id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group).

    Ids are the library's with add_special_tokens=False: special tokens that a text spells out, such as <|endoftext|>, have their
    special ids, unless `ordinary_specials` makes them ordinary text (`encode_special_tokens`), so that no text can forge an end.
    A document's ids end with `end_id`, so empty and null texts are one token. Each task packs the documents that it
    reads, without a shuffle; sequence ids hold the task's number, and a task that runs again gives the same pieces.
    Rows that repeat are documents of their own; an empty table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        data = f.read()
    sent = docs.sparkSession.sparkContext.broadcast(data)  # of fixed size
    key = hashlib.sha1(data.encode()).hexdigest() + str(ordinary_specials)
    last = np.array([end_id], "<u4").tobytes()

    def packed(ids: list[pa.Scalar | int], tokens: list[bytes], first: int, group: int) -> tuple[pa.RecordBatch, int, int]:
        sizes = [len(t) // 4 for t in tokens]
        sequences = pack(sizes, longest)
        groups = step_groups([t for t, _ in sequences], step_tokens)
        rows = []
        for k, (tier, window) in enumerate(sequences):
            at = 0
            for doc, start, n in window:
                rows.append((ids[doc], start, n, zlib.crc32(memoryview(tokens[doc])[4 * start : 4 * (start + n)]), sizes[doc], first + k, at, tier, group + groups[k]))
                at += n
        kinds = (pa.int64(),) * 7 + (pa.int32(), pa.int64())
        names = [id_col, *(x.split()[0] for x in PIECES.split(", "))]
        cols = list(zip(*rows)) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names), first + len(sequences), group + max(groups, default=-1) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _OPEN:
            _OPEN[key] = WordTokens(sent.value, ordinary_specials)
        words = _OPEN[key]
        first = group = TaskContext.get().partitionId() * IDS
        ids: list[int] = []
        tokens: list[bytes] = []
        size = 0
        for batch in batches:
            at = 0
            names = batch.column(0).to_pylist()
            for texts in blocks([t or "" for t in batch.column(1).to_pylist()]):
                new = [t + last for t in words.encode(texts)]
                ids += names[at : at + len(new)]
                at += len(new)
                tokens += new
                size += sum(map(len, new)) // 4
                if size >= BLOCK_TOKENS:
                    out, first, group = packed(ids, tokens, first, group)
                    ids, tokens, size = [], [], 0
                    yield out
        if tokens:
            yield packed(ids, tokens, first, group)[0]

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"`{id_col}` long, {PIECES}")
