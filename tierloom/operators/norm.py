"""Vocal-tract normalisation by the mean formant spacing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMANTS = ("F1", "F2", "F3", "F4")
SPEED_OF_SOUND = 35300.0
#: Rows of a group that meet in one task.
PART = 100_000


def _spacing(formants: Sequence[str], over) -> Column:
    """Mean over all cells of F_k / (k - 1/2), nulls left out."""
    total = sum((F.coalesce(over(F.sum(F.col(f) / (k + 0.5))), F.lit(0.0)) for k, f in enumerate(formants)), F.lit(0.0))
    cells = sum((over(F.count(f)) for f in formants), F.lit(0))
    return total / F.nullif(cells, F.lit(0))


def delta_f(df: DataFrame, keys: Sequence[str] = (), formants: Sequence[str] = FORMANTS, vtl: bool = False) -> DataFrame:
    """Formant spacing, or the vocal-tract length that it implies, of each group or of all rows."""
    value = _spacing(formants, lambda x: x)
    return df.groupBy(*keys).agg((F.lit(SPEED_OF_SOUND) / (2 * value) if vtl else value).alias("vtl" if vtl else "deltaF"))


def delta_f_norm(df: DataFrame, keys: Sequence[str] = (), factor: float | None = None, formants: Sequence[str] = FORMANTS, suffix: str = "/∆F") -> DataFrame:
    """Add each formant divided by the spacing, and `deltaF`: of its group, of all rows, or the given factor.

    Groups are summed up before they meet and their spacings are joined back. Rows meet them by group and part, of which a group has
    one for every `PART` rows, so that no task reads a large group; the groups of several parts, which are broadcast, are so few.
    """
    if factor is not None:
        out = df.withColumn("deltaF", F.lit(float(factor)))
    elif keys:
        spacing = _spacing(formants, lambda x: x).alias("deltaF")
        groups = df.groupBy(*keys).agg(spacing, (F.count(F.lit(1)) / PART).cast("int").alias("_last")).withColumnsRenamed({k: f"_of_{k}" for k in keys})
        same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
        own = df.drop("deltaF")
        large = groups.where("_last > 0").drop("deltaF")
        part = F.pmod(F.xxhash64(*formants, F.spark_partition_id()), F.coalesce("_last", F.lit(0)) + 1)  # alike when a task is run again
        dealt = own.join(F.broadcast(large), same, "left").select(*own.columns, part.alias("_part"))
        parts = groups.withColumn("_of_part", F.explode(F.sequence(F.lit(0), "_last")))
        out = dealt.join(parts, [*same, F.col("_part") == F.col("_of_part")], "left").select(*own.columns, "deltaF")
    else:
        out = df.withColumn("deltaF", delta_f(df, formants=formants).scalar())
    return out.withColumns({f"{f}{suffix}": F.col(f) / F.col("deltaF") for f in formants})
