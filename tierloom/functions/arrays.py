"""Whole-signal measures and transformations of array columns, without exploding them: no shuffle, one pass for each row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _y(y: Column | str) -> Column:
    return F.transform(F.col(y) if isinstance(y, str) else y, lambda x: x.cast("double"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, not for each element of the arrays that `body` goes through."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(z: Column, f: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.aggregate(z, F.lit(0.0), lambda a, x: a + f(x))


def _size(z: Column) -> Column:
    return F.nullif(F.size(z), F.lit(0))


def _mean(z: Column) -> Column:
    return _sum(z) / _size(z)


def total(y: Column | str) -> Column:
    return _sum(_y(y))


def mean(y: Column | str) -> Column:
    return let(_y(y), _mean)


def rms(y: Column | str) -> Column:
    return let(_y(y), lambda z: F.sqrt(_sum(z, lambda x: x * x) / _size(z)))


def _deviation(z: Column, m: Column) -> Column:
    return F.sqrt(_sum(z, lambda x: (x - m) * (x - m)) / _size(z))


def deviation(y: Column | str) -> Column:
    """Population standard deviation."""
    return let(_y(y), lambda z: let(_mean(z), lambda m: _deviation(z, m)))


def _before(z: Column) -> Column:
    """The array moved by one: null, then all but the last."""
    return F.slice(F.concat(F.array(F.lit(None).cast("double")), z), F.lit(1), F.size(z))


def _after(z: Column) -> Column:
    return F.slice(F.concat(z, F.array(F.lit(None).cast("double"))), F.lit(2), F.size(z))


def differences(y: Column | str) -> Column:
    """Each sample less the one before; null for the first."""
    return let(_y(y), lambda z: F.zip_with(z, _before(z), lambda x, p: x - p))


def gradient(y: Column | str) -> Column:
    """Central differences, one-sided at the ends."""

    def central(z: Column) -> Column:
        sides = F.zip_with(_before(z), _after(z), lambda p, n: F.struct(p.alias("p"), n.alias("n")))
        step = lambda x, s: F.when(s["p"].isNull(), s["n"] - x).when(s["n"].isNull(), x - s["p"]).otherwise((s["n"] - s["p"]) / 2)
        return F.zip_with(z, sides, step)

    return let(_y(y), central)


def without_mean(y: Column | str) -> Column:
    return let(_y(y), lambda z: let(_mean(z), lambda m: F.transform(z, lambda x: x - m)))


def standardised(y: Column | str) -> Column:
    """Less the mean, divided by the population deviation; null where all samples are the same."""
    scaled = lambda z, m, sd: F.transform(z, lambda x: (x - m) / F.nullif(sd, F.lit(0.0)))
    return let(_y(y), lambda z: let(_mean(z), lambda m: let(_deviation(z, m), lambda sd: scaled(z, m, sd))))


def _bounds(z: Column) -> Column:
    return F.struct(F.array_min(z).alias("low"), F.array_max(z).alias("high"))


def between_extremes(y: Column | str) -> Column:
    """Scaled from 0 at the least sample to 1 at the largest; null where all are the same."""
    return let(_y(y), lambda z: let(_bounds(z), lambda b: F.transform(z, lambda x: (x - b["low"]) / F.nullif(b["high"] - b["low"], F.lit(0.0)))))


def above_threshold(y: Column | str, share: float = 0.5) -> Column:
    """Samples below least + share * (largest - least) are null."""
    return let(_y(y), lambda z: let(_bounds(z), lambda b: F.transform(z, lambda x: F.when(x >= b["low"] + (b["high"] - b["low"]) * share, x))))


def rolling(y: Column | str, n: int, min_periods: int, how: str = "max") -> Column:
    """Extreme of the last n samples; null before `min_periods` of them."""
    extreme = {"max": F.array_max, "min": F.array_min}[how]

    def run(z: Column) -> Column:
        last = lambda i: F.slice(z, F.greatest(i - n + 1, F.lit(0)) + 1, F.least(i + 1, F.lit(n)))
        return F.transform(z, lambda x, i: F.when(i + 1 >= min_periods, extreme(last(i))))

    return let(_y(y), run)


def crossings(y: Column | str, level: float = 0.0) -> tuple[Column, Column]:
    """How often the signal comes to the level or above it from below, and falls below it."""

    def count(hit: Callable[[Column, Column], Column]) -> Column:
        pairs = lambda z: F.zip_with(z, _before(z), lambda x, p: F.coalesce(hit(x, p), F.lit(False)).cast("long"))
        return let(_y(y), lambda z: F.aggregate(pairs(z), F.lit(0).cast("long"), lambda a, x: a + x))

    return count(lambda x, p: (p < level) & (x >= level)), count(lambda x, p: (p >= level) & (x < level))


def highest(y: Column | str, n: int = 3) -> Column:
    """(index, value) of the n largest samples, of equal ones the first."""
    ranked = F.array_sort(F.transform(_y(y), lambda x, i: F.struct((-x).alias("minus"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, n), lambda r: F.struct(r["i"].alias("i"), (-r["minus"]).alias("v")))


def moments(w: Column | str, f: Column | None = None) -> Column:
    """Struct (cog, sd, skew, kurtosis) of the weights `w` at the places `f`, by default their indexes."""

    def shape(r: Column) -> Column:
        at = lambda k: _sum(F.transform(r["w"], lambda v: v["w"] * F.pow(v["f"] - r["g"], F.lit(float(k)))))
        result = lambda m: F.struct(r["g"].alias("cog"), F.sqrt(m["m2"]).alias("sd"), (m["m3"] / F.pow(m["m2"], F.lit(1.5))).alias("skew"), (m["m4"] / (m["m2"] * m["m2"]) - 3).alias("kurtosis"))
        return let(F.struct(*[at(k).alias(f"m{k}") for k in (2, 3, 4)]), result)

    def centred(z: Column) -> Column:
        places = f if f is not None else F.transform(z, lambda x, i: i.cast("double"))
        share = let(_sum(z), lambda t: F.zip_with(z, places, lambda x, p: F.struct((x / F.nullif(t, F.lit(0.0))).alias("w"), p.alias("f"))))
        return let(share, lambda v: let(F.struct(v.alias("w"), _sum(F.transform(v, lambda x: x["w"] * x["f"])).alias("g")), shape))

    return let(_y(w), centred)


def time_of_max(y: str, fs: float) -> Column:
    return (F.array_position(y, F.array_max(y)) - 1) / F.lit(float(fs))


def time_of_min(y: str, fs: float) -> Column:
    return (F.array_position(y, F.array_min(y)) - 1) / F.lit(float(fs))


def value_at(y: str, t: Column, fs: float) -> Column:
    """The sample nearest to the time; null outside."""
    return F.get(y, F.rint(t * F.lit(float(fs))).cast("int")).cast("double")


def part(y: str, t1: Column, t2: Column, fs: float) -> Column:
    """Samples from t1 up to t2."""
    start = F.greatest(F.floor(t1 * F.lit(float(fs))).cast("int"), F.lit(0))
    return F.slice(y, start + 1, F.greatest(F.floor(t2 * F.lit(float(fs))).cast("int") - start, F.lit(0)))


def polarity(y: Column | str) -> Column:
    """The signal with its larger peak positive."""
    return let(_y(y), lambda z: F.when(F.array_max(z) + F.array_min(z) < 0, F.transform(z, lambda x: -x)).otherwise(z))


def preemphasised(y: Column | str, pre: float) -> Column:
    """Each sample less `pre` times the one before; the first as it is."""
    return let(_y(y), lambda z: F.zip_with(z, _before(z), lambda x, p: x - F.lit(pre) * F.coalesce(p, F.lit(0.0))))


def scaled(y: Column | str, peak: float = 0.99) -> Column:
    """Scaled so that the largest value, not the largest magnitude, is `peak`."""
    return let(_y(y), lambda z: let(F.nullif(F.array_max(z), F.lit(0.0)), lambda top: F.transform(z, lambda x: x / top * F.lit(peak))))


def to_int16(y: Column | str) -> Column:
    return F.transform(_y(y), lambda x: F.rint(x * F.lit(32767.0)).cast("smallint"))
