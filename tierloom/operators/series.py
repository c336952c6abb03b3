"""Window operators on sampled values: differences, normalisation, rolling extremes, framing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def samples(df: DataFrame, array: str, keys: Sequence[str], index: str = "i", value: str = "y") -> DataFrame:
    """One row for each sample of an array column."""
    return df.select(*keys, F.posexplode(array).alias(index, value)).withColumn(value, F.col(value).cast("double"))


def diff(value: str, keys: Sequence[str], order: Sequence[str]) -> Column:
    return F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))


def preemphasis(value: str, keys: Sequence[str], order: Sequence[str], pre: float = 0.94) -> Column:
    """y[n] = x[n] - pre * x[n - 1], with y[0] = x[0]."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return F.col(value) - F.lit(pre) * F.coalesce(F.lag(value).over(w), F.lit(0.0))


def gradient(value: str, keys: Sequence[str], order: Sequence[str]) -> Column:
    """Central differences, one-sided at the ends."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before, after, x = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    return F.when(before.isNull(), after - x).when(after.isNull(), x - before).otherwise((after - before) / 2)


def zscore(value: str, keys: Sequence[str]) -> Column:
    w = Window.partitionBy(*keys)
    return (F.col(value) - F.avg(value).over(w)) / F.nullif(F.stddev_pop(value).over(w), F.lit(0.0))


def minmax(value: str, keys: Sequence[str]) -> Column:
    w = Window.partitionBy(*keys)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return (F.col(value) - low) / F.nullif(high - low, F.lit(0.0))


def remove_dc(value: str, keys: Sequence[str]) -> Column:
    return F.col(value) - F.avg(value).over(Window.partitionBy(*keys))


def rolling(value: str, keys: Sequence[str], order: Sequence[str], n: int, min_periods: int, how: str = "max") -> Column:
    """Extreme of the last n rows; null before `min_periods` of them are there."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - n, 0)
    return F.when(F.count(value).over(w) >= min_periods, getattr(F, how)(value).over(w))


def above_threshold(value: str, keys: Sequence[str], share: float = 0.5) -> Column:
    """The value, null below min + share * (max - min) of its group."""
    w = Window.partitionBy(*keys)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(F.col(value) >= low + (high - low) * share, F.col(value))


def frames(df: DataFrame, array: str, length: int, hop: int, keys: Sequence[str], fs: float = 1.0) -> DataFrame:
    """Overlapping frames of an array: (*keys, frame, sec, y), sec at the middle of each."""
    last = F.size(array) - length
    starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(hop)))
    out = df.select(*keys, array, F.posexplode(starts).alias("frame", "_at"))
    return out.select(*keys, "frame", ((F.col("_at") + length / 2) / fs).alias("sec"), F.slice(array, F.col("_at") + 1, length).alias("y"))


def crossings(value: str, keys: Sequence[str], order: Sequence[str], level: float = 0.0) -> tuple[Column, Column]:
    """Whether a row is the first at or above, or below, the level after one on the other side."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return (before < level) & (F.col(value) >= level), (before >= level) & (F.col(value) < level)


def top_n(df: DataFrame, keys: Sequence[str], by: Sequence[Column], n: int = 3) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("rank") <= n)


def describe(df: DataFrame, keys: Sequence[str], value: str, accuracy: int | None = None) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles.

    Quartiles are exact, for which the distinct values of a group are held in one task. With `accuracy` they are values of the group whose
    ranks are off by its size / accuracy at most, from sketches of fixed size that are merged: for groups of any size.
    """
    quantile = (lambda p: F.percentile(value, F.lit(p))) if accuracy is None else lambda p: F.percentile_approx(value, F.lit(p), F.lit(accuracy))
    q = {f"p{int(100 * p)}": quantile(p) for p in (0.25, 0.5, 0.75)}
    aggs = {"count": F.count(value), "mean": F.avg(value), "std": F.stddev_samp(value), "min": F.min(value), **q, "max": F.max(value)}
    return df.groupBy(*keys).agg(*[a.alias(f"{value}_{name}") for name, a in aggs.items()])


def sample_per_class(df: DataFrame, cls: str, n: int, replace: bool = False, seed: int = 0, id_cols: Sequence[str] = ()) -> DataFrame:
    """n rows of each class at random; with `replace` each row is drawn a Poisson number of times, n of them on average."""
    key = F.xxhash64(F.lit(seed), *(id_cols or df.columns))
    if not replace:
        return top_n(df.withColumn("_key", key), [cls], [F.col("_key")], n).drop("_key", "rank")
    sizes = df.groupBy(cls).agg(F.count(F.lit(1)).alias("_n"))
    u = F.pmod(key, F.lit(1 << 52)) / float(1 << 52)
    rate = F.lit(float(n)) / F.col("_n")
    start = F.struct(F.exp(-rate).alias("term"), F.exp(-rate).alias("sum"), F.lit(0).alias("k"))

    def step(acc: Column, x: Column) -> Column:
        term = acc["term"] * rate / x
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"), (acc["k"] + F.when(u >= acc["sum"], 1).otherwise(0)).alias("k"))

    times = F.aggregate(F.sequence(F.lit(1), F.lit(100)), start, step, lambda acc: acc["k"])
    out = df.join(sizes, cls).withColumn("_times", times)
    return out.where("_times > 0").withColumn("_t", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_t", "_times", "_n")
