"""Signal operators on tables of signals (*keys, fs, y), one row for each recording and channel.

A kernel sees one signal at a time, or some whose frames it works out together: rows go to Python workers as Arrow batches and come back as
measures. Columns that a kernel doesn't need aren't sent.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierloom.dsp import filters, hearing, spectra, voice

#: Gives rows, columns, or an iterator of either for signals whose measures shouldn't be held at once.
Kernel = Callable[[np.ndarray, float, dict], list[dict] | dict[str, np.ndarray] | Iterator[list[dict]]]
ARROW = {"double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<double>": pa.list_(pa.float64()), "array<smallint>": pa.list_(pa.int16())}
#: Measures are handed back in batches of about so many numbers.
BATCH = 1 << 20


def _column(parts: list, kind: pa.DataType) -> pa.Array:
    """One column from the arrays or lists of each signal; NaN becomes null."""
    if pa.types.is_floating(kind):
        return pa.array(np.concatenate([np.asarray([np.nan if v is None else v for v in p] if isinstance(p, list) else p, float) for p in parts]), kind, from_pandas=True)
    return pa.array([v for p in parts for v in (p.tolist() if isinstance(p, np.ndarray) and p.ndim == 1 else p)], kind)


#: Signals are dealt to tasks of about so many stored bytes, up to so many tasks unless their input's splits are more.
PIECE, TASKS = 1 << 20, 10_000
#: Of no table: Spark's sizes from here on stand for unknown ones.
UNKNOWN = 1 << 60
#: Seconds of signals that a kernel of many signals is given at once.
TOGETHER = 60.0


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Deal signals to tasks of bounded size, and to all cores at least, by their keys.

    The number of tasks grows with the size of the tables that are read, since kernels take far longer than the shuffle. Input of
    unknown size stays as it is, and so does input that is read in pieces as small.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()  # estimates, made without reading; those of joins are products
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    if size >= UNKNOWN or split <= PIECE and size >= split * cores:
        return df
    return df.repartition(max(cores, min(-(-size // PIECE), TASKS), -(-size // split)), *keys)


def measure(signals: DataFrame, keys: Sequence[str], kernel: Kernel | Callable[[list[tuple[np.ndarray, float]]], list], schema: str, extra: Sequence[str] = (), many: bool = False) -> DataFrame:
    """Rows of `kernel(y, fs, row)` for each signal, with its keys; NaN becomes null. Null and empty signals give no rows.

    With `many` the kernel is given some signals at once, as a list of (y, fs), and gives a list with what it found for each.
    """
    cols = [c.split()[0] for c in schema.split(", ")]
    kinds = [ARROW[c.split()[1]] for c in schema.split(", ")]
    types = dict(signals.dtypes)
    shape = ", ".join([*(f"`{k}` {types[k]}" for k in keys), schema])

    def measured(batch: pa.RecordBatch) -> Iterator[tuple[int, list[dict] | dict | Iterator[list[dict]]]]:
        names = batch.schema.names
        small = batch.select([c for c in names if c != "y"]).to_pylist()
        signal = batch.column(names.index("y"))
        held: list[tuple[np.ndarray, float]] = []
        places: list[int] = []
        seconds = 0.0
        for i, row in enumerate(small):
            y = signal[i].values
            if y is None or not len(y) or row["fs"] is None:
                continue
            y, fs = np.asarray(y.to_numpy(zero_copy_only=False), float), float(row["fs"])
            if not many:
                yield i, kernel(y, fs, row)
                continue
            held.append((y, fs))
            places.append(i)
            seconds += len(y) / abs(fs)
            if seconds >= TOGETHER:
                yield from zip(places, kernel(held))
                held, places, seconds = [], [], 0.0
        if held:
            yield from zip(places, kernel(held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list] = [[] for _ in cols]
            sizes: list[int] = []
            rows: list[int] = []
            waiting = 0
            names = batch.schema.names

            def built() -> pa.RecordBatch:
                at = pa.array(np.repeat(rows, sizes))
                taken = [batch.column(names.index(k)).take(at) for k in keys]
                return pa.RecordBatch.from_arrays([*taken, *map(_column, parts, kinds)], names=[*keys, *cols])

            for i, found in measured(batch):
                for some in found if isinstance(found, Iterator) else [found]:
                    own = [[r[c] for r in some] for c in cols] if isinstance(some, list) else [some[c] for c in cols]
                    if not len(own[0]):
                        continue
                    for part, new in zip(parts, own):
                        part.append(new)
                        waiting += sum(np.size(v) for v in new) if isinstance(new, list) else np.size(new)
                    rows.append(i)
                    sizes.append(len(own[0]))
                    if waiting >= BATCH:
                        yield built()
                        parts, sizes, rows, waiting = [[] for _ in cols], [], [], 0
            if rows:
                yield built()

    needed = [*dict.fromkeys([*keys, *extra]), "fs", "y"]
    return spread(signals.select(*needed), keys).mapInArrow(run, shape)


def seeded(seed: int, row: dict, keys: Sequence[str]) -> np.random.Generator:
    """A generator of its own for each signal, whatever the partitioning."""
    return np.random.Generator(np.random.PCG64([seed, zlib.crc32(repr([row[k] for k in keys]).encode())]))


def prep_audio(signals: DataFrame, keys: Sequence[str], target_fs: float | None = 22050, pre: float = 0, scale: bool = True, outtype: str = "float") -> DataFrame:
    def kernel(y, fs, row):
        out, rate = filters.prepare(y, fs, target_fs, pre, scale, outtype)
        return [{"fs": rate, "y": out}]

    return measure(signals, keys, kernel, f"fs double, y array<{'smallint' if outtype.startswith('int') else 'double'}>")


FORMANTS = "sec double, rms double, F1 double, F2 double, F3 double, F4 double, F5 double, F6 double, f0 double, c double"


def track_formants(signals: DataFrame, keys: Sequence[str], method: str = "lpc", preemphasis: float = 1.0, f0_range=(63, 400), speaker: int = 0, order: int = -1) -> DataFrame:
    """Formants by LPC roots, or by inverse-filter control (ifc, ifc_old, ifc_fast); F1 to F6 are null where there are none."""
    if method not in ("lpc", "ifc", "ifc_old", "ifc_fast"):
        raise ValueError(f"unknown method {method}")

    if method == "lpc":
        return measure(signals, keys, lambda y, fs, row: voice.formants_lpc(y, fs, preemphasis, f0_range, order), FORMANTS)

    def kernel(some):
        found = voice.formants_ifc_of(some, preemphasis, f0_range, speaker, method)
        return [own | {k: np.full(len(own["sec"]), np.nan) for k in ("F5", "F6")} for own in found]

    return measure(signals, keys, kernel, FORMANTS, many=True)


PITCH = "sec double, f0 double, rms double, c double, probv double, voiced boolean"


def get_f0(signals: DataFrame, keys: Sequence[str], f0_range=(63, 400), pre: float = 1.0) -> DataFrame:
    return measure(signals, keys, lambda y, fs, row: voice.f0_residual(y, fs, f0_range, pre), PITCH)


def get_f0_srh(signals: DataFrame, keys: Sequence[str], f0_range=(60, 400), pre: float = 0.94) -> DataFrame:
    return measure(signals, keys, lambda some: voice.f0_harmonics_of(some, f0_range, pre), PITCH, many=True)


def get_f0_cor(signals: DataFrame, keys: Sequence[str], f0_range=(60, 400)) -> DataFrame:
    return measure(signals, keys, lambda y, fs, row: voice.f0_autocorrelation(y, fs, f0_range), PITCH)


def get_f0_acd(signals: DataFrame, keys: Sequence[str], f0_range=(60, 400), prom: float = 3, min_height: float = 0.5, crit_c: float = 3.5) -> DataFrame:
    return measure(signals, keys, lambda y, fs, row: voice.f0_spectral(y, fs, f0_range, prom, min_height, crit_c), "sec double, f0 double, rms double, c double")


def fricative(signals: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
    """Spectral measures at the time in column t; no row where the window leaves the signal."""
    shape = "t double, Fm double, FmB double, Am double, mode string, COG double, SD double, Skew double, Kurtosis double, spec array<double>, freq array<double>"

    def kernel(y, fs, row):
        found = voice.fricative(y, fs, row[t])
        return [{"t": row[t], **found}] if found else []

    return measure(signals, keys, kernel, shape, [t])


def burst(signals: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    def kernel(y, fs, row):
        at, score = voice.burst(y, fs, row[start], row[end])
        return [{"burst_time": at, "maxb": score}]

    return measure(signals, keys, kernel, "burst_time double, maxb double", [start, end])


def amplitude_envelope(signals: DataFrame, keys: Sequence[str], bounds=None, target_fs: float = 22050, cutoff: float = 30, order: int = 2) -> DataFrame:
    def kernel(y, fs, row):
        out, rate = filters.envelope(y, fs, bounds, target_fs, cutoff, order)
        return [{"fs": rate, "y": out}]

    return measure(signals, keys, kernel, "fs double, y array<double>")


def compute_sgram(signals: DataFrame, keys: Sequence[str], window: float = 0.008, nfft: int = 8192) -> DataFrame:
    """One row for each frame; bin k is at k * fs / nfft."""

    def kernel(y, fs, row):
        return ([{"frame": first + i, "sec": s, "mag": m} for i, (s, m) in enumerate(zip(sec, levels))] for first, sec, levels in spectra.spectrogram_parts(y, fs, window, nfft=nfft))

    return measure(signals, keys, kernel, "frame int, sec double, mag array<double>")


def sgram(signals: DataFrame, keys: Sequence[str], start: float = 0, end: float = -1, tf: float = 8000, band: str = "wb", preemph: float = 0.94, slice_time: float = -1) -> DataFrame:
    """The data of a spectrogram display up to tf Hz: all frames, or the one nearest to slice_time."""

    def kernel(y, fs, row):
        y = y[int(start * fs) : len(y) if end < 0 else int(end * fs)]
        y, rate = filters.prepare(y, fs, 2 * tf, preemph)
        found = spectra.spectrogram_parts(y, rate, 0.008 if band == "wb" else 0.04)
        rows = ({"frame": first + i, "sec": s + start, "mag": m} for first, sec, levels in found for i, (s, m) in enumerate(zip(sec, levels)))
        if slice_time >= 0:
            nearest = min(rows, key=lambda r: abs(r["sec"] - slice_time), default=None)
            return [nearest] if nearest else []
        return ([r] for r in rows)

    return measure(signals, keys, kernel, "frame int, sec double, mag array<double>")


def get_rhythm_spectrum(signals: DataFrame, keys: Sequence[str], chunk: float = 4) -> DataFrame:
    def kernel(y, fs, row):
        return [{"freq": f, "power": p} for f, p in zip(*voice.rhythm_spectrum(y, fs, chunk))]

    return measure(signals, keys, kernel, "freq double, power double")


def rhythmogram(signals: DataFrame, keys: Sequence[str], chunk: float = 4) -> DataFrame:
    def kernel(y, fs, row):
        freq, sec, power = voice.rhythmogram(y, fs, chunk)
        return [{"sec": s, "freq": freq, "power": p} for s, p in zip(sec, power)]

    return measure(signals, keys, kernel, "sec double, freq array<double>, power array<double>")


def egg_to_oq(signals: DataFrame, keys: Sequence[str], **params) -> DataFrame:
    return measure(signals, keys, lambda y, fs, row: voice.open_quotient(y, fs, **params), "sec double, OQ double, f0 double")


def auditory(signals: DataFrame, keys: Sequence[str], kind: str = "zgram", model: hearing.AuditoryModel | None = None, **params) -> DataFrame:
    """Frames of an auditory spectrogram: zgram, sharpgram, blurgram or tgram; band k is at model.bands[k] Bark."""
    model = model or hearing.AuditoryModel()
    if kind not in ("zgram", "sharpgram", "blurgram", "tgram"):
        raise ValueError(f"unknown kind {kind}")

    def kernel(y, fs, row):
        sec, gram = model.zgram(y, fs)
        if len(gram) < 2:
            return []
        gram = gram if kind == "zgram" else getattr(model, kind)(gram, **params)
        return [{"frame": i, "sec": s, "mag": g} for i, (s, g) in enumerate(zip(sec, gram))]

    return measure(signals, keys, kernel, "frame int, sec double, mag array<double>")


def mfcc(signals: DataFrame, keys: Sequence[str], num: int = 12, include_energy: bool = True) -> DataFrame:
    """Mel-frequency cepstral coefficients: c0 (if include_energy) and c1 to c<num>."""

    def kernel(y, fs, row):
        sec, c = spectra.mfcc(y, fs, num)
        return {"sec": sec, **{f"c{k}": c[:, k] for k in range(0 if include_energy else 1, num + 1)}}

    return measure(signals, keys, kernel, ", ".join(["sec double", *(f"c{k} double" for k in range(0 if include_energy else 1, num + 1))]))


def intensity(signals: DataFrame, keys: Sequence[str], window: float = 0.02, hop: float = 0.01) -> DataFrame:
    """Level of each frame in dB above 2e-5."""

    def kernel(y, fs, row):
        n, h = int(window * fs), max(1, int(hop * fs))
        f = spectra.frames(y, n, h)
        return {"sec": (np.arange(len(f)) * h + n / 2) / fs, "intensity": 20 * np.log10(np.maximum(np.sqrt((f**2).mean(1)), 1e-12) / 2e-5)}

    return measure(signals, keys, kernel, "sec double, intensity double")


def _signal(signals: DataFrame, keys: Sequence[str], make: Callable) -> DataFrame:
    return measure(signals, keys, lambda y, fs, row: [dict(zip(("fs", "y"), make(y, fs, row)))], "fs double, y array<double>")


def add_noise(signals: DataFrame, keys: Sequence[str], noise_type="white", snr: float = 0, target_amp: float = -2, seed: int = 0) -> DataFrame:
    return _signal(signals, keys, lambda y, fs, row: (fs, hearing.add_noise(y, fs, noise_type, snr, target_amp, seeded(seed, row, keys))))


def add_noise_and_norm(signals: DataFrame, keys: Sequence[str], noise, noise_db: float, norm_db: float, seed: int = 0, hz: float = 440) -> DataFrame:
    """Signals mixed with noise of a kind, a periodic wave or a recording, by peak levels in dB."""
    return _signal(signals, keys, lambda y, fs, row: (fs, hearing.mix_with_noise(y, fs, noise, noise_db, norm_db, seeded(seed, row, keys), hz)))


def sigcor_noise(signals: DataFrame, keys: Sequence[str], flip_rate: float = 0.5, start: float = 0, end: float = -1, seed: int = 0) -> DataFrame:
    return _signal(signals, keys, lambda y, fs, row: (fs, hearing.sign_flip_noise(y, fs, flip_rate, start, end, seeded(seed, row, keys))))


def vocode(signals: DataFrame, keys: Sequence[str], bands, target_fs: float | None = None, seed: int = 0, level_bands: bool = False) -> DataFrame:
    return _signal(signals, keys, lambda y, fs, row: hearing.vocode(y, fs, bands, target_fs, seeded(seed, row, keys), level_bands)[::-1])


def apply_filterbank(signals: DataFrame, keys: Sequence[str], bands, target_fs: float | None = 22050, order: int = 8) -> DataFrame:
    def kernel(y, fs, row):
        y, rate = filters.prepare(y, fs, target_fs)
        return [{"band": k, "fs": rate, "y": b} for k, b in enumerate(filters.filterbank(y, bands, rate, order))]

    return measure(signals, keys, kernel, "band int, fs double, y array<double>")


def peak_rms(signals: DataFrame, keys: Sequence[str]) -> DataFrame:
    return measure(signals, keys, lambda y, fs, row: [{"peak_rms": spectra.peak_rms(y)}], "peak_rms double")


def smoothn(signals: DataFrame, keys: Sequence[str], s: float = 1.0, robust: bool = False) -> DataFrame:
    return _signal(signals, keys, lambda y, fs, row: (fs, spectra.smoothn(y, s, robust)))


def sine_synth(tracks: DataFrame, keys: Sequence[str], fs: float = 16000) -> DataFrame:
    """Signals from formant tracks (*keys, sec, rms, F1..F4): one recording's track, 100 rows a second, is one group.

    Tracks are read as columns and signals are handed back in batches of bounded size, so that a task holds few at once.
    """
    cols = ["sec", "rms", "F1", "F2", "F3", "F4"]
    packed = tracks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in cols]))).alias("track"))
    kinds = dict(packed.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tracks, first, made, waiting = batch.column(len(keys)), 0, [], 0
            for i in range(len(tracks)):
                m = np.stack([tracks[i].values.field(c).to_numpy(zero_copy_only=False) for c in cols], axis=1)
                made.append(hearing.sine_synth(m[:, 0], m[:, 1], m[:, 2:], fs))
                waiting += len(made[-1])
                if waiting >= BATCH or i == len(tracks) - 1:
                    ends = np.cumsum([0, *map(len, made)])
                    y = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(made), pa.float64(), from_pandas=True))
                    own = [batch.column(k).slice(first, len(made)) for k in range(len(keys))]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(made), float(fs))), y], names=[*keys, "fs", "y"])
                    first, made, waiting = i + 1, [], 0

    return packed.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "fs double, y array<double>"]))


def sample_track(track: DataFrame, targets: DataFrame, keys: Sequence[str], t: str, columns: Sequence[str], nearest: bool = False, tol: float | None = None) -> DataFrame:
    """Values of a track (formants, pitch, intensity, cepstra) at given times, interpolated or of the nearest frame."""
    from tierloom.operators import asof

    track = track.select(*keys, "sec", *columns)
    if nearest:
        return asof.nearest(targets, track, keys, t, "sec", tol, prefix="").drop("sec")
    return asof.interpolate(track, targets, keys, "sec", t, tol, default_tolerance=False)
