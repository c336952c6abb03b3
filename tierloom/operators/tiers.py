"""Operators on tiers: context, explosion, gaps, runs, checks, speakers, contours.

With `width`, a span of time (the first column of the order), recordings too long for one task are handled in slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierloom.operators.asof import last_known
from tierloom.operators.slices import running, shifted

def add_context(df: DataFrame, col: str, n_prev: int, n_next: int, keys: Sequence[str], order: Sequence[str], prefixes: tuple[str, str] = ("prev_", "next_"), fill: str = "", context: str | None = None, sep: str = " ", width: float | None = None) -> DataFrame:
    """Labels of the rows before and after, as columns around `col`; `context` joins them all."""
    before = {f"{prefixes[0]}{col}{k}": (col, k) for k in range(n_prev, 0, -1)}
    after = {f"{prefixes[1]}{col}{k}": (col, -k) for k in range(1, n_next + 1)}
    names = [*before, *after, *([context] if context else [])]
    if len(set(names)) < len(names) or set(names) & set(df.columns):
        raise ValueError("context columns repeat or exist")
    at = df.columns.index(col)
    filled = lambda names: [F.coalesce(c, F.lit(fill)).alias(c) for c in names]
    out = shifted(df, keys, order, before | after, width).select(*df.columns[:at], *filled(before), col, *filled(after), *df.columns[at + 1 :])
    if context:
        out = out.withColumn(context, F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit(fill)) for c in (*before, col, *after)]))
    return out


def explode_intervals(df: DataFrame, divs: int | Sequence[float], t1: str = "t1", t2: str = "t2", prefix: str = "obs_") -> DataFrame:
    """Rows at equal parts of each interval (an integer gives divs + 1 of them), or at the given proportions."""
    start, length = F.col(t1), F.col(t2) - F.col(t1)
    if isinstance(divs, int):
        out = df.withColumn(f"{prefix}id", F.explode(F.sequence(F.lit(0), F.lit(divs))))
        k = F.col(f"{prefix}id")
        return out.withColumn(f"{prefix}t", F.when(k == divs, F.col(t2).cast("double")).otherwise(start + length * k / F.lit(float(divs))))
    out = df.withColumn(f"{prefix}id", F.explode(F.array(*[F.lit(float(p)) for p in divs])))
    return out.withColumn(f"{prefix}t", start + length * F.col(f"{prefix}id"))


def fill_gaps(df: DataFrame, keys: Sequence[str], label: str, t1: str = "t1", t2: str = "t2", start: float | None = None, end: float | None = None, fill: str = "", width: float | None = None) -> DataFrame:
    """Add intervals labelled `fill` between intervals that don't meet, before the first (`start`) and after the last (`end`)."""
    rows = df.select(*keys, t1, t2, label)
    kind = dict(rows.dtypes)[t1]
    follows = F.coalesce("_next", F.lit(end).cast(kind))
    after = shifted(rows, keys, [t1, t2], {"_next": (t1, -1)}, width).select(*keys, F.col(t2).alias(t1), follows.alias(t2), F.lit(fill).alias(label)).where(F.col(t1) < F.col(t2))
    out = rows.unionByName(after)
    if start is not None:
        first = rows.groupBy(*keys).agg(F.min(t1).alias(t2)).where(F.col(t2) > start)
        out = out.unionByName(first.select(*keys, F.lit(start).cast(kind).alias(t1), t2, F.lit(fill).alias(label)))
    return out


def nonzero_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column, min_len: int = 1, include_any: Column | None = None, width: float | None = None) -> DataFrame:
    """Maximal runs of rows for which `flag` holds: (*keys, run, first, last, length), positions from 0.

    Runs shorter than `min_len` are left out, and those without a row for which `include_any` holds.
    """
    rows = df.select(*keys, *order, F.coalesce(flag, F.lit(False)).alias("_on"), (F.lit(True) if include_any is None else include_any).alias("_any")).withColumns({"_one": F.lit(1), "_off": F.when(F.col("_on"), 0).otherwise(1)})
    if width is None:
        # rows of a run have the same number of rows that aren't on before them
        w = Window.partitionBy(*keys).orderBy(*order)
        rows = rows.withColumns({"_at": F.row_number().over(w) - 1, "_group": F.sum("_off").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    else:
        for new, value in (("_at", "_one"), ("_group", "_off")):
            rows = running(rows, keys, order, new, value, "sum", width).withColumn(new, F.coalesce(new, F.lit(0)))
    rows = rows.where("_on")
    runs = rows.groupBy(*keys, "_group").agg(F.min("_at").alias("first"), F.max("_at").alias("last"), F.count(F.lit(1)).alias("length"), F.max("_any").alias("_any"))
    runs = runs.where((F.col("length") >= min_len) & F.col("_any"))
    return runs.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("first")) - 1).alias("run"), "first", "last", "length")


def validate_tier(df: DataFrame, keys: Sequence[str], t1: str = "t1", t2: str = "t2", width: float | None = None) -> DataFrame:
    """Counts of broken rules for each tier: starts or ends that don't increase, intervals that don't end after their start, overlaps."""
    before1, before2 = F.col("_before1"), F.col("_before2")
    marked = shifted(df.select(*keys, t1, t2), keys, [t1, t2], {"_before1": (t1, 1), "_before2": (t2, 1)}, width).select(*keys, (F.col(t1) <= before1).alias("a"), (F.col(t2) <= before2).alias("b"), (F.col(t2) <= F.col(t1)).alias("c"), (F.col(t1) < before2).alias("d"))
    return marked.groupBy(*keys).agg(F.count_if("a").alias("bad_starts"), F.count_if("b").alias("bad_ends"), F.count_if("c").alias("bad_lengths"), F.count_if("d").alias("overlaps"))


def overlaps(df: DataFrame, keys: Sequence[str], t1: str = "t1", t2: str = "t2", width: float | None = None) -> DataFrame:
    """Rows that start before an earlier row of the same keys has ended, with that end as `prev_end`."""
    return running(df, keys, [t1, t2], "prev_end", t2, "max", width).select(*df.columns, "prev_end").where(F.col("prev_end") > F.col(t1))


def split_speakers(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str = "text", sep: str | None = None, ffill: bool = True, include: Sequence[str] = (), exclude: Sequence[str] = (), max_split: int | None = None, width: float | None = None) -> DataFrame:
    """Split `speaker<sep>text`: columns `speaker` and the text.

    Only texts with exactly two parts name a speaker (unless `max_split` is 1); others keep their first part and take the speaker before
    them, or `*`. Speakers that are neither in `include` nor in `exclude` raise ValueError if either is
    given, and only those in `include` are kept.
    """
    pattern = r"\s+" if sep is None else r"\Q" + sep.replace(r"\E", r"\E\\E\Q") + r"\E"
    parts = F.split(F.trim(text) if sep is None else F.col(text), pattern, -1 if max_split is None else max_split + 1)
    two = F.size(parts) == 2
    out = df.withColumn("_parts", parts).withColumn("speaker", F.when(two, F.get("_parts", F.lit(0))))
    out = out.withColumn(text, F.when(two, F.get("_parts", F.lit(1))).otherwise(F.get("_parts", F.lit(0)))).drop("_parts")
    if ffill:
        out = last_known(out.withColumnRenamed("speaker", "_named"), keys, order[0], order[1:], {"speaker": "_named"}, width).drop("_named")
    out = out.withColumn("speaker", F.coalesce("speaker", F.lit("*")))
    if include or exclude:
        known = [*include, *exclude, "*"]
        if bad := [r[0] for r in out.where(~F.col("speaker").isin(known)).select("speaker").distinct().limit(20).collect()]:
            raise ValueError(f"speakers neither included nor excluded: {bad}")
    return out.where(F.col("speaker").isin(list(include))) if include else out


def contour(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str = "contour") -> DataFrame:
    """A letter for each step of a group's values, `r` if it rises and else `f`."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.lag(value).over(w)
    rows = df.select(*keys, order, F.row_number().over(w).alias("_k"), F.when(F.col(value) > before, "r").otherwise("f").alias("_c"))
    steps = F.array_sort(F.collect_list(F.when(F.col("_k") > 1, F.struct("_k", "_c"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(steps, lambda x: x["_c"]), "").alias(name))
