"""Tracks of signals sampled at given times: formants, pitch, intensity and cepstra, by frame or interpolated."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierloom.dsp import spectra, voice
from tierloom.functions import scales
from tierloom.operators import asof
from tierloom.signal.measures import get_f0, measure, mfcc

#: Half-widths of the windowed sinc interpolators, in frames.
SINC = {"SINC70": 70, "SINC700": 700}
LEVEL_KINDS = ("NEAREST", "LINEAR", "CUBIC", *SINC)


def _at(track: DataFrame, targets: DataFrame | None, keys: Sequence[str], t: str, values: Sequence[str], nearest: bool) -> DataFrame:
    """The track's own frames, its time called `t`, or its values at the targets' times."""
    if targets is None:
        return track.select(*keys, F.col("sec").alias(t), *values)
    if t not in targets.columns:
        raise ValueError(f"targets have no column {t}")
    track = track.select(*keys, "sec", *values)
    if nearest:
        return asof.nearest(targets, track, keys, t, "sec", prefix="").drop("sec", "distance", "within")
    return asof.interpolate(track, targets, keys, "sec", t, default_tolerance=False).drop("within")


def formant_to_df(signals: DataFrame, keys: Sequence[str], num: int = 4, targets: DataFrame | None = None, t: str = "t1", unit: str = "HERTZ", include_bw: bool = False) -> DataFrame:
    """F1 to F<num>, and their bandwidths B1 to B<num>, in Hz or Bark, at each frame or at the targets' times."""
    if unit not in ("HERTZ", "BARK"):
        raise ValueError(f"unknown unit {unit}")
    names = [f"F{k}" for k in range(1, num + 1)] + [f"B{k}" for k in range(1, num + 1)] * include_bw
    track = measure(signals, keys, lambda y, fs, row: voice.formants_lpc(y, fs), ", ".join(f"{c} double" for c in ("sec", *names)))
    out = _at(track, targets, keys, t, names, False)
    if unit == "BARK":
        # a bandwidth in Bark is the distance between the two edges
        wide = {f"B{k}": scales.hz2bark(F.col(f"F{k}") + F.col(f"B{k}") / 2) - scales.hz2bark(F.col(f"F{k}") - F.col(f"B{k}") / 2) for k in range(1, num + 1)} if include_bw else {}
        out = out.withColumns({f"F{k}": scales.hz2bark(F.col(f"F{k}")) for k in range(1, num + 1)} | wide)
    return out


def pitch_to_df(signals: DataFrame, keys: Sequence[str], targets: DataFrame | None = None, t: str = "t1", unit: str = "HERTZ", interpolation: str = "LINEAR", track=get_f0) -> DataFrame:
    """f0 in any pitch unit, of voiced frames or at the targets' times, interpolated between voiced frames or of the nearest."""
    if interpolation not in ("LINEAR", "NEAREST"):
        raise ValueError(f"unknown interpolation {interpolation}")
    frames = track(signals, keys)
    frames = (frames.where("voiced") if "voiced" in frames.columns else frames).where(F.col("f0").isNotNull())
    return _at(frames, targets, keys, t, ["f0"], interpolation == "NEAREST").withColumn("f0", scales.pitch_unit(F.col("f0"), unit))


def interpolated(sec: np.ndarray, level: np.ndarray, at: np.ndarray, kind: str) -> np.ndarray:
    """Values at the times `at` of frames at equal distances; the first and last frame hold beyond them."""
    if not len(sec):
        return np.full(len(at), np.nan)
    x = np.clip((at - sec[0]) / (sec[1] - sec[0]) if len(sec) > 1 else np.zeros(len(at)), 0, len(sec) - 1)
    near = np.floor(x + 0.5).astype(int)
    if kind == "NEAREST" or len(sec) == 1:
        return level[np.minimum(near, len(sec) - 1)]
    left = np.minimum(np.floor(x).astype(int), len(sec) - 2)
    part = x - left
    if kind == "LINEAR":
        return level[left] * (1 - part) + level[left + 1] * part
    if kind == "CUBIC":
        slope = np.gradient(level)
        a, b, da, db = level[left], level[left + 1], slope[left], slope[left + 1]
        return a + part * (da + part * (3 * (b - a) - 2 * da - db + part * (da + db - 2 * (b - a))))
    reach = min(SINC[kind], len(level))
    padded = np.pad(level, reach, mode="edge")
    offset = np.arange(-reach + 1, reach + 1)
    d = part[:, None] - offset
    weight = np.sinc(d) * (0.5 + 0.5 * np.cos(np.pi * np.clip(d / reach, -1, 1)))
    return (padded[left[:, None] + reach + offset] * weight).sum(1) / weight.sum(1)


def intensity_to_df(signals: DataFrame, keys: Sequence[str], targets: DataFrame | None = None, t: str = "t1", interpolation: str = "CUBIC", window: float = 0.02, hop: float = 0.01) -> DataFrame:
    """Intensity in dB of each frame, or at the targets' times by NEAREST, LINEAR, CUBIC, SINC70 or SINC700 interpolation.

    A recording's target times go to its kernel as one array.
    """
    if interpolation not in LEVEL_KINDS:
        raise ValueError(f"unknown interpolation {interpolation}")

    def levels(y, fs):
        n, h = int(window * fs), max(1, int(hop * fs))
        f = spectra.frames(y, n, h)
        return (np.arange(len(f)) * h + n / 2) / fs, 20 * np.log10(np.maximum(np.sqrt((f**2).mean(1)), 1e-12) / 2e-5)

    shape = f"{t} double, intensity double"
    if targets is None:
        return measure(signals, keys, lambda y, fs, row: dict(zip((t, "intensity"), levels(y, fs))), shape)
    if t not in targets.columns:
        raise ValueError(f"targets have no column {t}")
    asked = targets.groupBy(*keys).agg(F.collect_set(F.col(t).cast("double")).alias("_at"))

    def kernel(y, fs, row):
        at = np.sort(np.asarray(row["_at"], float))
        return {t: at, "intensity": interpolated(*levels(y, fs), at, interpolation)}

    found = measure(signals.join(asked, list(keys)), keys, kernel, shape, ["_at"])
    return targets.join(found, [*keys, t], "left")


def mfcc_to_df(signals: DataFrame, keys: Sequence[str], num: int = 12, targets: DataFrame | None = None, t: str = "t1", include_energy: bool = True) -> DataFrame:
    """Cepstral coefficients of each frame, or of the frames nearest to the targets' times."""
    names = [f"c{k}" for k in range(0 if include_energy else 1, num + 1)]
    return _at(mfcc(signals, keys, num, include_energy), targets, keys, t, names, True)
