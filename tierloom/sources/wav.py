"""WAV files."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierloom.sources.files import binary_files, open_fs


@dataclass(frozen=True)
class Header:
    """What a WAV file says of itself: kind of samples, and the bytes that hold them."""

    kind: int
    channels: int
    rate: int
    bits: int
    start: int
    size: int

    @property
    def frame(self) -> int:
        return self.channels * self.bits // 8


def header(read: Callable[[int, int], bytes], length: int) -> Header:
    """From `read(offset, size)` of a file of so many bytes: only the chunks' heads are read."""
    head = read(0, 12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, fmt, data = 12, None, (0, 0)
    while at + 8 <= length:
        name, size = struct.unpack("<4sI", read(at, 8))
        if name == b"fmt ":
            body = read(at + 8, size)
            fmt = struct.unpack("<HHIIHH", body[:16])
            if fmt[0] == 0xFFFE:
                fmt = (struct.unpack("<H", body[24:26])[0], *fmt[1:])
        elif name == b"data":
            data = (at + 8, min(size, length - at - 8))
        at += 8 + size + size % 2
    if fmt is None or not fmt[1] or fmt[5] < 8:
        raise ValueError("no format chunk")
    kind, channels, rate, _, _, bits = fmt
    return Header(kind, channels, rate, bits, *data)


def samples(h: Header, data: bytes) -> np.ndarray:
    """Channels x samples in -1..1 of RIFF PCM of 8 to 32 bits or IEEE floats."""
    data = data[: len(data) // h.frame * h.frame]
    if h.kind == 3:
        y = np.frombuffer(data, f"<f{h.bits // 8}").astype(np.float32)
    elif h.bits == 8:
        y = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    elif h.bits == 24:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        y = (((b[:, 0] << 8) | (b[:, 1] << 16) | (b[:, 2] << 24)) >> 8).astype(np.float32) / (1 << 23)
    else:
        y = np.frombuffer(data, f"<i{h.bits // 8}").astype(np.float64) / (1 << h.bits - 1)
    return y.reshape(-1, h.channels).T.astype(np.float32)


def parse(raw: bytes) -> tuple[int, np.ndarray]:
    """(rate, channels x samples) of a whole file."""
    h = header(lambda at, n: raw[at : at + n], len(raw))
    return h.rate, samples(h, raw[h.start : h.start + h.size])


def to_bytes(y: np.ndarray, fs: int) -> bytes:
    """16-bit WAV of channels x samples, or of one channel."""
    y = np.atleast_2d(y)
    data = np.rint(np.clip(y.T, -1, 1) * 32767).astype("<i2").tobytes()
    head = struct.pack("<HHIIHH", 1, len(y), fs, fs * 2 * len(y), 2 * len(y), 16)
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(data)) + data


#: Signals are handed back in batches of about so many samples.
BATCH = 1 << 20


def load_signals(spark: SparkSession, path: str, channels: Sequence[int] = (), offset: float = 0.0, duration: float | None = None, fs: float | None = None, glob: str = "*.wav", errors: str = "raise") -> DataFrame:
    """(path, chan, fs, y) of each channel, or of those chosen, in the order of choice, resampled if fs is given.

    A file is one row for each channel; for recordings too long for that see `load_chunks`. A file that isn't a WAV file, or
    lacks a chosen channel, fails the job, or gives no rows with errors="ignore".
    """
    if errors not in ("raise", "ignore"):
        raise ValueError(f"unknown errors {errors}")
    chosen = list(channels)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tierloom.dsp.filters import resample_fft

        for pdf in frames:
            rows, waiting = [], 0
            for path, raw in zip(pdf.path, pdf.content):
                try:
                    rate, y = parse(raw)
                    if chosen and max(chosen) >= len(y):
                        raise ValueError(f"no channel {max(chosen)} in {path}")
                except (ValueError, struct.error, IndexError) as e:
                    if errors == "ignore":
                        continue
                    raise ValueError(f"not a whole WAV file: {path}: {e}") from None
                start = int(offset * rate)
                y = y[:, start : None if duration is None else start + int(duration * rate)]
                picked = chosen or list(range(len(y)))
                out = [y[c] if fs in (None, rate) else resample_fft(y[c], int(y.shape[1] * fs / rate)).astype(np.float32) for c in picked]
                rows += [(path, c, float(fs or rate), v) for c, v in zip(picked, out)]
                waiting += sum(map(len, out))
                if waiting >= BATCH:
                    yield pd.DataFrame(rows, columns=["path", "chan", "fs", "y"])
                    rows, waiting = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["path", "chan", "fs", "y"])

    files = binary_files(spark, path, glob)
    return files.select("path", "content").mapInPandas(run, "path string, chan int, fs double, y array<float>")


CHUNKS = "path string, chan int, chunk int, start double, fs double, y array<float>"


def load_chunks(spark: SparkSession, path: str, seconds: float = 60.0, overlap: float = 0.0, glob: str = "*.wav") -> DataFrame:
    """(path, chan, chunk, start, fs, y): recordings of any length in rows of so many seconds, each `overlap` seconds longer than the step.

    A file's head alone is read first; then each chunk is a byte range that any task can read, so a long recording is dealt to many.
    """

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[str, int, int, int]] = []
            for name, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, at = open_fs(name)
                with store.open_input_file(at) as f:
                    h = header(lambda start, n: f.read_at(n, start), length)
                n, step = h.size // h.frame, max(1, int(seconds * h.rate))
                rows += [(name, length, k, k * step) for k in range(-(-n // step))]
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.int64()))], names=["path", "length", "chunk", "first"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, length, chunk, first in zip(*(batch.column(c).to_pylist() for c in range(4))):
                store, at = open_fs(name)
                with store.open_input_file(at) as f:
                    h = header(lambda start, n: f.read_at(n, start), length)
                    n = min(int((seconds + overlap) * h.rate), h.size // h.frame - first)
                    y = samples(h, f.read_at(n * h.frame, h.start + first * h.frame))
                k = len(y)
                cols = [[name] * k, list(range(k)), [chunk] * k, [first / h.rate] * k, [float(h.rate)] * k, list(y)]
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["path", "chan", "chunk", "start", "fs", "y"])

    files = binary_files(spark, path, glob).select("path", "length")
    ranges = files.mapInArrow(plan, "path string, length long, chunk int, first long")
    return ranges.repartition("path", F.col("chunk")).mapInArrow(read, CHUNKS)
