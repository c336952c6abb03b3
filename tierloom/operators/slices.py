"""Windows over recordings too long for one task.

A recording is cut into slices of `width` time units. What a window needs is found within each slice, and across slices from
a few rows or one summary of each slice, so that no task sorts more than a slice or a row or two for every slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "_slice"


def cut(df: DataFrame, time: str, width: float) -> DataFrame:
    return df.withColumn(SLICE, F.floor(F.col(time) / F.lit(width)))


def shifted(df: DataFrame, keys: Sequence[str], order: Sequence[str], shifts: dict[str, tuple[str, int]], width: float | None = None) -> DataFrame:
    """Add columns with the value of another column some rows before (positive) or after (negative), in order within the keys.

    With `width` the first column of `order` is the time. The rows next to the edges of slices, as many as the largest
    shift, are put in one order for each recording; all others have their neighbours in their own slice.
    """

    def over(w) -> dict[str, Column]:
        return {new: (F.lag(old, k) if k > 0 else F.lead(old, -k)).over(w) for new, (old, k) in shifts.items()}

    if width is None:
        return df.withColumns(over(Window.partitionBy(*keys).orderBy(*order)))
    reach = max((abs(k) for _, k in shifts.values()), default=0)
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order)
    rows = cut(df, order[0], width).withColumns({"_first": F.row_number().over(inside) <= reach, "_last": F.lead(F.lit(True), reach).over(inside).isNull()} | over(inside))
    edge = rows.where(F.col("_first") | F.col("_last"))
    across = {f"_across_{new}": col for new, col in over(Window.partitionBy(*keys).orderBy(*order)).items()}
    at = {new: F.when(F.col("_first" if k > 0 else "_last"), F.col(f"_across_{new}")).otherwise(F.col(new)) for new, (_, k) in shifts.items()}
    edge = edge.withColumns(across).withColumns(at).drop(*across)
    return rows.where(~(F.col("_first") | F.col("_last"))).unionByName(edge).drop(SLICE, "_first", "_last")


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], new: str, value: str, how: str = "max", width: float | None = None) -> DataFrame:
    """Add the sum or maximum of `value` over the rows before each row."""
    agg = {"max": F.max, "sum": F.sum}[how]
    before = lambda w: agg(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    if width is None:
        return df.withColumn(new, before(Window.partitionBy(*keys).orderBy(*order)))
    rows = cut(df, order[0], width).withColumn(new, before(Window.partitionBy(*keys, SLICE).orderBy(*order)))
    whole = rows.groupBy(*keys, SLICE).agg(agg(value).alias("_whole"))
    carried = whole.select(*keys, SLICE, agg("_whole").over(Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    both = F.greatest(new, "_carried") if how == "max" else F.when(F.col(new).isNotNull() | F.col("_carried").isNotNull(), F.coalesce(new, F.lit(0)) + F.coalesce("_carried", F.lit(0)))
    return rows.join(carried, [*keys, SLICE], "left").withColumn(new, both).drop(SLICE, "_carried")
