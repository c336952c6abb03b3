"""Frequency, level and voicing scales as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierloom.dsp.hearing import LOUDNESS, LOUDNESS_DOMAIN


def hz2bark(hz: Column) -> Column:
    return F.lit(7.0) * F.asinh(hz / F.lit(650.0))


def bark2hz(bark: Column) -> Column:
    return F.lit(650.0) * F.sinh(bark / F.lit(7.0))


def db(power: Column) -> Column:
    """10 log10; null for values that aren't positive."""
    return F.when(power > 0, F.lit(10.0) * F.log10(power))


def amplitude_db(amplitude: Column, reference: Column | float = 1.0) -> Column:
    ratio = amplitude / (reference if isinstance(reference, Column) else F.lit(float(reference)))
    return F.when(ratio > 0, F.lit(20.0) * F.log10(ratio))


def voicing_probability(rms_db: Column, c: Column, weights: tuple[float, float, float] = (-4.2, 0.17, 13.2)) -> Column:
    """Logistic model; `weights` are the intercept and those of the level and the correlation. Never NaN, however large they are."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(weights[0]) + F.lit(weights[1]) * rms_db + F.lit(weights[2]) * c)))


#: Pitch units of public use, from Hz.
def pitch_unit(hz: Column, unit: str = "HERTZ") -> Column:
    if unit in ("HERTZ", "HERTZ_LOGARITHMIC"):
        return hz
    if unit == "LOG_HERTZ":
        return F.log10(hz)
    if unit == "MEL":
        return F.lit(550.0) * F.log(F.lit(1.0) + hz / F.lit(550.0))
    if unit == "ERB":
        return F.lit(11.17) * F.log((hz + F.lit(312.0)) / (hz + F.lit(14680.0))) + F.lit(43.0)
    if unit.startswith("SEMITONES_"):
        return F.lit(12.0) * F.log(hz / F.lit(float(unit.rpartition("_")[2]))) / F.lit(math.log(2.0))
    raise ValueError(f"unknown unit {unit}")


def third_octave_bounds(cf: Column) -> tuple[Column, Column]:
    return cf / F.lit(2 ** (1 / 6)), cf * F.lit(2 ** (1 / 6))


def octave_frequencies(low: float, high: float) -> list[float]:
    return [low * 2.0**k for k in range(math.ceil(math.log2(high) - math.log2(low)))]


def third_octave_bands(spark: SparkSession, low: float = 100, high: float = 5000) -> DataFrame:
    """(band, low, high) of bands a third of an octave wide, an octave apart."""
    centre = F.lit(float(low)) * F.pow(F.lit(2.0), F.col("band").cast("double"))
    a, b = third_octave_bounds(centre)
    return spark.range(len(octave_frequencies(low, high))).withColumnRenamed("id", "band").select("band", a.alias("low"), b.alias("high"))


def shannon_bands(spark: SparkSession, nc: int = 24, low: float = 70, high: float = 5000) -> DataFrame:
    """(band, low, high) of nc bands of equal width on a logarithmic scale."""
    start, step = math.log(low), (math.log(high - 1) - math.log(low)) / nc
    edge = lambda k: F.exp(F.lit(start) + k * F.lit(step))
    return spark.range(nc).withColumnRenamed("id", "band").select("band", edge(F.col("band")).alias("low"), edge(F.col("band") + 1).alias("high"))


def window_function(kind: str, i: Column, n: int) -> Column:
    """Value i of a symmetric window of n points: hamming, blackmanharris or tukey (a tenth tapered)."""
    x = F.lit(2 * math.pi) * i / F.lit(float(n - 1))
    if kind == "hamming":
        return F.lit(0.54) - F.lit(0.46) * F.cos(x)
    if kind == "blackmanharris":
        return F.lit(0.35875) - F.lit(0.48829) * F.cos(x) + F.lit(0.14128) * F.cos(2 * x) - F.lit(0.01168) * F.cos(3 * x)
    if kind == "tukey":
        edge = 0.1 * (n - 1) / 2
        near = F.least(i, F.lit(n - 1) - i)
        return F.when(near < F.lit(edge), F.lit(0.5) * (F.lit(1.0) + F.cos(F.lit(math.pi) * (near / F.lit(edge) - F.lit(1.0))))).otherwise(F.lit(1.0))
    raise ValueError(f"unknown window {kind}")


def ordered(*cols: str) -> Column:
    return F.array_sort(F.array(*cols))


def loudness_db(hz: Column) -> Column:
    """Equal-loudness curve of the auditory model, in dB at a frequency in Hz."""
    low, high = LOUDNESS_DOMAIN
    x = (hz - low) * 2 / float(high - low) - 1
    out = F.lit(0.0)
    for c in reversed(LOUDNESS):
        out = out * x + F.lit(c)
    return out
