"""Joins on time: as-of, nearest with tolerance, containment, and interpolation.

Both sides are united and sorted by time within each recording, so each operator is one shuffle and one sort. A
recording that is too long for one task is cut into slices of `width` time units: each slice is handled
alone and the last known row of the slices before is carried into it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierloom.operators.slices import running


def last_known(df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], values: dict[str, str], width: float | None = None, backward: bool = False) -> DataFrame:
    """Add columns with the last value that isn't null up to each row; `values` maps new columns to old ones.

    `backward` looks at the rows that follow. It sorts in descending order: a frame that reaches forward without bound is
    evaluated anew for each row.
    """
    turn = F.desc if backward else F.asc
    by = [turn(time), *map(turn, order)]
    if width is None:
        frame = Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({new: F.last(old, ignorenulls=True).over(frame) for new, old in values.items()})
    df = df.withColumn("_slice", F.floor(F.col(time) / F.lit(width)))
    frame = Window.partitionBy(*keys, "_slice").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    pick = F.min_by if backward else F.max_by
    rank = F.struct(time, *order)
    ends = df.groupBy(*keys, "_slice").agg(*[pick(old, F.when(F.col(old).isNotNull(), rank)).alias(f"_end_{new}") for new, old in values.items()])
    before = Window.partitionBy(*keys).orderBy(turn("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_slice", *[F.last(f"_end_{new}", ignorenulls=True).over(before).alias(f"_carried_{new}") for new in values])
    out = df.withColumns({new: F.last(old, ignorenulls=True).over(frame) for new, old in values.items()}).join(carried, [*keys, "_slice"], "left")
    return out.withColumns({new: F.coalesce(new, f"_carried_{new}") for new in values}).drop("_slice", *[f"_carried_{new}" for new in values])


def _tagged(rows: DataFrame, keys: Sequence[str], time: str, side: int, payload: str, other: tuple[str, DataFrame], tie: Column | None = None) -> DataFrame:
    name, frame = other
    kind = frame.select(F.struct(*[F.col(c) for c in frame.columns]).alias("x")).schema["x"].dataType
    packed = F.struct(*[F.col(c) for c in rows.columns])
    return rows.select(*keys, F.col(time).alias("_t"), F.lit(side).alias("_side"), (F.lit(0) if tie is None else tie).cast("long").alias("_tie"), packed.alias(payload), F.lit(None).cast(kind).alias(name))


def merge_tiers(inner: DataFrame, outer: DataFrame, keys: Sequence[str], inner_t: str = "t1", outer_t: str = "t1", suffixes: tuple[str, str] = ("_inner", "_outer"), drop_repeated: str | None = None, outer_end: str | None = None, tie: str | None = None, width: float | None = None) -> DataFrame:
    """As-of left join: each inner row gets the last outer row that starts at or before it, else nulls.

    Columns of both sides take the suffixes; `drop_repeated` ("inner" or "outer") drops those columns but the times from one
    side instead. Of outer rows that start together the last by `tie` is taken. With `outer_end` a row must also
    end after the inner start.
    """
    for frame, cols in ((inner, [*keys, inner_t]), (outer, [*keys, outer_t])):
        if missing := [c for c in cols if c not in frame.columns]:
            raise KeyError(f"no such columns: {missing}")
    both = [c for c in inner.columns if c in outer.columns and c not in keys]
    cut = {"inner": [c for c in both if c != inner_t], "outer": [c for c in both if c != outer_t], None: []}[drop_repeated]
    left = [c for c in inner.columns if c not in keys and not (drop_repeated == "inner" and c in cut)]
    right = [c for c in outer.columns if c not in keys and not (drop_repeated == "outer" and c in cut)]
    shared = set(left) & set(right)
    united = _tagged(outer, keys, outer_t, 0, "_outer", ("_inner", inner), F.col(tie) if tie else None).unionByName(_tagged(inner, keys, inner_t, 1, "_inner", ("_outer", outer)))
    found = last_known(united, keys, "_t", ["_side", "_tie"], {"_found": "_outer"}, width).where("_side = 1")
    ok = F.lit(True) if outer_end is None else F.col(f"_found.{outer_end}") > F.col("_t")
    name = lambda c, s: c + s if c in shared else c
    return found.select(*keys, *[F.col(f"_inner.{c}").alias(name(c, suffixes[0])) for c in left], *[F.when(ok, F.col(f"_found.{c}")).alias(name(c, suffixes[1])) for c in right])


def nearest(targets: DataFrame, source: DataFrame, keys: Sequence[str], target_t: str = "t", source_t: str = "t", tolerance: float | None = None, prefix: str = "near_", width: float | None = None) -> DataFrame:
    """Each target with the source row nearest in time: columns `near_*`, `distance` and `within`.

    Of two that are equally near the later is taken, and a distance equal to the tolerance is within it.
    """
    united = _tagged(source, keys, source_t, 0, "_src", ("_tgt", targets)).unionByName(_tagged(targets, keys, target_t, 1, "_tgt", ("_src", source)))
    united = last_known(united, keys, "_t", ["_side"], {"_before": "_src"}, width)
    united = last_known(united.withColumn("_back", -F.col("_side")), keys, "_t", ["_back"], {"_after": "_src"}, width, backward=True).where("_side = 1")
    ahead, behind = F.col(f"_after.{source_t}") - F.col("_t"), F.col("_t") - F.col(f"_before.{source_t}")
    later = F.col("_before").isNull() | (F.col("_after").isNotNull() & (ahead <= behind))
    chosen = F.when(later, F.col("_after")).otherwise(F.col("_before"))
    distance = F.when(later, ahead).otherwise(behind)
    within = distance.isNotNull() if tolerance is None else F.coalesce(distance <= F.lit(tolerance), F.lit(False))
    cols = [c for c in source.columns if c not in keys]
    rest = [F.col(f"_tgt.{c}").alias(c) for c in targets.columns if c not in keys]
    return united.withColumn("_near", chosen).select(*keys, *rest, *[F.col(f"_near.{c}").alias(prefix + c) for c in cols], distance.alias("distance"), within.alias("within"))


def match_frames(targets: DataFrame, track: DataFrame, keys: Sequence[str], t: str = "t", sec: str = "sec", index: str = "frame", width: float | None = None) -> DataFrame:
    """Targets with the number (from 0) of the nearest frame of their recording, in order of time, as `index`; of two that are equally near the later.

    Times may be numbers, or arrays of numbers of any depth up to two: then `index` has the same shape, null for null times.
    """
    after = F.row_number().over(Window.partitionBy(*keys).orderBy(sec)) - 1
    frames = track.select(*keys, F.col(sec).alias("_sec"), after.alias("_frame")) if width is None else running(track.select(*keys, F.col(sec).alias("_sec"), F.lit(1).alias("_one")), keys, ["_sec"], "_frame", "_one", "sum", width).select(*keys, "_sec", F.coalesce("_frame", F.lit(0)).cast("int").alias("_frame"))
    depth = str(dict(targets.dtypes)[t]).count("array<")
    if not depth:
        out = nearest(targets, frames, keys, t, "_sec", prefix="", width=width)
        return out.select(*targets.columns, F.col("_frame").alias(index))
    if depth > 2:
        raise TypeError(f"{t} has more than two dimensions")
    # a row goes along with its times, so that they come together again without a second look at the targets
    rows = targets.select(*keys, F.monotonically_increasing_id().alias("_row"), F.struct(*targets.columns).alias("_whole"), F.col(t).alias("_time"))
    at = ["_i", "_j"][:depth]
    for i in at:
        rows = rows.select(*keys, "_row", "_whole", *[k for k in at if k < i], F.posexplode_outer("_time").alias(i, "_time"))
    each = match_frames(rows, track, keys, "_time", sec, index, width).withColumn("v", F.when(F.col("_time").isNotNull(), F.col(index)))
    for i in reversed(at):
        outer = [k for k in at if k < i]
        entry = F.when(F.col(i).isNotNull(), F.struct(i, "v"))
        each = each.groupBy("_row", *outer).agg(F.first("_whole").alias("_whole"), F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["v"]).alias("v"))
    return each.select("_whole.*", F.when(F.col(f"_whole.{t}").isNotNull(), F.col("v")).alias(index))


def adjust_boundaries(*, inner: DataFrame, outer: DataFrame, keys: Sequence[str], tolerance: float, inner_t: str = "t", outer_t: str = "t", on_error: str = "raise", shown: int = 20, width: float | None = None) -> DataFrame:
    """Snap outer times to the nearest inner time: outer rows with `snapped`.

    Times farther than the tolerance raise ValueError with some of them, or keep `snapped` null with on_error="flag".
    """
    out = nearest(outer, inner.select(*keys, F.col(inner_t).alias("_at")), keys, outer_t, "_at", tolerance, width=width)
    if on_error == "raise":
        bad = [r[0] for r in out.where(~F.col("within")).select(outer_t).limit(shown).collect()]
        if bad:
            raise ValueError("times without an inner time within the tolerance", bad)
    return out.withColumn("snapped", F.when(F.col("within"), F.col("near__at"))).drop("near__at", "distance", "within")


def contained(points: DataFrame, intervals: DataFrame, keys: Sequence[str], t: str, t1: str, t2: str, how: str = "inner", bin_width: float | None = None) -> DataFrame:
    """Join points to the closed intervals that hold them, within equal keys.

    With `bin_width` both sides also carry the number of a bin of time, intervals one for each bin that they meet, so
    that a long recording is dealt over many tasks.
    """
    inside = (F.col(t) >= F.col(t1)) & (F.col(t) <= F.col(t2))
    p, i = points, intervals
    match = [F.col(f"p.{k}") == F.col(f"i.{k}") for k in keys]
    if bin_width is not None:
        low, high = F.floor(F.col(t1) / bin_width), F.floor(F.col(t2) / bin_width)
        p = p.withColumn("_bin", F.floor(F.col(t) / bin_width))
        i = i.where(F.col(t1) <= F.col(t2)).withColumn("_bin", F.explode(F.sequence(low, high)))
        match.append(F.col("p._bin") == F.col("i._bin"))
    condition = inside
    for m in match:
        condition = condition & m
    joined = p.alias("p").join(i.alias("i"), condition, how)
    return joined.select("p.*", *[F.col(f"i.{c}") for c in intervals.columns if c not in keys]).drop("_bin")


def interpolate(measures: DataFrame, targets: DataFrame, keys: Sequence[str], meas_t: str = "t", target_t: str = "t", tolerance: float | None = None, default_tolerance: bool = True, columns: Sequence[str] | None = None, overwrite: bool = False, width: float | None = None) -> DataFrame:
    """Linear interpolation of all numeric measures at the targets' times, with `within`.

    Beyond the first and last measure the end value holds. `within` tells whether a measure is as near as the tolerance, by
    default half the mean step of the recording; values of others are null.
    """
    columns = list(columns or [c for c in measures.columns if c not in keys and c != meas_t])
    if clash := [c for c in columns if c in targets.columns]:
        if not overwrite:
            raise ValueError(f"targets have the columns {clash}")
        targets = targets.drop(*clash)
    kinds = dict(measures.dtypes)
    if bad := [c for c in columns if not kinds[c].startswith(("double", "float", "int", "bigint", "smallint", "tinyint", "decimal"))]:
        raise TypeError(f"not numeric: {bad}")
    source = measures.select(*keys, F.col(meas_t).alias("_m"), *[F.col(c).cast("double").alias(f"_v_{c}") for c in columns])
    united = _tagged(source, keys, "_m", 0, "_src", ("_tgt", targets)).unionByName(_tagged(targets, keys, target_t, 1, "_tgt", ("_src", source)))
    if tolerance is None and default_tolerance:
        half = lambda low, high, n: (high - low) / F.nullif(n - 1, F.lit(0)) / 2
        if width is None:
            times, whole = F.when(F.col("_side") == 0, F.col("_t")), Window.partitionBy(*keys)
            united = united.withColumn("_tol", half(*(f(times).over(whole) for f in (F.min, F.max, F.count))))
        else:
            # summed up before recordings meet; Spark broadcasts the steps when they turn out few
            steps = source.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(half(F.min("_m"), F.max("_m"), F.count("_m")).alias("_tol"))
            united = united.join(steps, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], "left").drop(*[f"_of_{k}" for k in keys])
    else:
        united = united.withColumn("_tol", F.lit(tolerance).cast("double"))
    united = last_known(united, keys, "_t", ["_side"], {"_before": "_src"}, width)
    united = last_known(united.withColumn("_back", -F.col("_side")), keys, "_t", ["_back"], {"_after": "_src"}, width, backward=True).where("_side = 1")
    t, t0, t1 = F.col("_t"), F.col("_before._m"), F.col("_after._m")
    gap = F.least(t - t0, t1 - t)
    within = F.coalesce(gap <= F.col("_tol"), F.col("_tol").isNull() & gap.isNotNull())

    def value(c: str) -> Column:
        v0, v1 = F.col(f"_before._v_{c}"), F.col(f"_after._v_{c}")
        inner = F.when(t1 == t0, v0).otherwise(v0 + (v1 - v0) * (t - t0) / F.nullif(t1 - t0, F.lit(0).cast("double")))
        return F.when(within, F.coalesce(inner, v0, v1)).alias(c)

    rest = [F.col(f"_tgt.{c}").alias(c) for c in targets.columns if c not in keys]
    return united.select(*keys, *rest, *[value(c) for c in columns], within.alias("within"))


def interpolate_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Fill nulls linearly by row position; ends take the nearest value."""
    row = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("double")
    out = df.withColumn("_row", row)
    for c in columns:
        known = F.when(F.col(c).isNotNull(), F.struct(F.col("_row").alias("x"), F.col(c).cast("double").alias("y")))
        out = last_known(out.withColumn("_known", known), keys, "_row", [], {"_before": "_known"})
        out = last_known(out, keys, "_row", [], {"_after": "_known"}, backward=True)
        x0, y0, x1, y1 = (F.col(f) for f in ("_before.x", "_before.y", "_after.x", "_after.y"))
        line = F.when(x0 == x1, y0).otherwise(y0 + (y1 - y0) * (F.col("_row") - x0) / F.nullif(x1 - x0, F.lit(0.0)))
        out = out.withColumn(c, F.coalesce(line, y0, y1)).drop("_known", "_before", "_after")
    return out.drop("_row")
