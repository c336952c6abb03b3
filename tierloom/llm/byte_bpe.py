"""Byte-level BPE by a sentencepiece model that is serialised from the rank file.

Each token's bytes become one character each (byte b is the character U+0100 + b), pieces are scored
by negative rank, and the normaliser is the identity. sentencepiece then merges the adjacent pair
of the best score, which is the pair of the lowest rank. The text is cut by the pattern first, a match that is itself
a token is that token, and ids are decoded by the inverse mapping.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierloom.llm.shared import small_batches
from tierloom.llm.tokenize import Kept, Splitter, blocks

#: Byte b as a character, clear of white space and of sentencepiece's own signs.
CHARS = [chr(0x100 + b) for b in range(256)]
TO_CHARS = {b: 0x100 + b for b in range(256)}


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ranks, which must be 0, 1, 2, ..."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, f.read().splitlines()))}
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError(f"the ranks of {path} are not 0, 1, 2, ...")
    return tokens


def model_bytes(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: piece 0 is <unk>, piece r + 1 the token of rank r."""
    pieces = [_field(1, "<unk>".encode()) + _field(2, 0.0) + _field(3, 2)]
    pieces += [_field(1, t.decode("latin-1").translate(TO_CHARS).encode()) + _field(2, float(-r)) for r, t in enumerate(tokens)]
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + _field(41, 2**64 - 1) + _field(42, 2**64 - 1) + _field(43, 2**64 - 1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class ByteBpe:
    """Encoder and decoder; `ids` are those of the rank file."""

    def __init__(self, tokens: list[bytes], pattern: str, model: bytes | None = None):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model or model_bytes(tokens))
        self.tokens, self.split = tokens, Splitter(pattern)
        self.whole = {t: struct.pack("<I", r) for r, t in enumerate(tokens)}
        self.kept = Kept(self._encode)

    def _encode(self, pieces: list[str]) -> list[bytes]:
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        rest = [r for r in raw if r not in self.whole]
        ids = iter(self.sp.encode([r.decode("latin-1").translate(TO_CHARS) for r in rest], num_threads=1))
        return [self.whole[r] if r in self.whole else struct.pack(f"<{len(x := next(ids))}I", *[i - 1 for i in x]) for r in raw]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return self.kept.ids([self.split(t) for t in texts])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_OPEN: dict[str, ByteBpe] = {}


def byte_bpe(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode each whole text and decode the ids: (id, n_tokens, ids_sha256, decoded_sha256[, ids]).

    The rank file is read by the driver and sent to the executors: it is of fixed size. Null texts are
    empty texts and have no ids. Rows that repeat give rows that repeat; an empty table gives an empty result;
    other columns are ignored. `with_ids` adds the ids themselves.
    """
    small_batches(docs.sparkSession)
    tokens = read_ranks(ranks_path)
    sent = docs.sparkSession.sparkContext.broadcast((tokens, model_bytes(tokens)))
    key = hashlib.sha1(repr((ranks_path, pattern)).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _OPEN:
            _OPEN[key] = ByteBpe(sent.value[0], pattern, sent.value[1])
        bpe = _OPEN[key]
        for batch in batches:
            out = [[], [], [], []]
            for ids in chain.from_iterable(map(bpe.encode, blocks([t or "" for t in batch.column(1).to_pylist()]))):
                found = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest(), np.frombuffer(ids, "<u4").astype("i4") if with_ids else None)
                for o, v in zip(out, found):
                    o.append(v)
            cols = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(out[3], pa.list_(pa.int32()))] * with_ids, names=names + ["ids"] * with_ids)

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
