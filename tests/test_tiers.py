import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tierloom.operators import asof, norm, series, tiers


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def track(spark, seed, n, name="t", value="v"):
    r = random.Random(seed)
    return spark.createDataFrame([(r.choice("ab"), float(r.randrange(60)), float(i)) for i in range(n)], f"rec string, {name} double, {value} double")


@pytest.mark.parametrize("width", [None, 7.0, 1000.0])
def test_merge_tiers_is_pandas_merge_asof(spark, width):
    inner, outer = track(spark, 1, 50, "t", "x"), track(spark, 2, 30, "o", "y")
    got = asof.merge_tiers(inner, outer, ["rec"], "t", "o", tie="y", width=width).toPandas().sort_values(["rec", "x"]).reset_index(drop=True)
    a, b = inner.toPandas().sort_values(["t", "x"]), outer.toPandas().sort_values(["o", "y"])
    want = pd.merge_asof(a, b, left_on="t", right_on="o", by="rec").sort_values(["rec", "x"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got[["rec", "t", "x", "o", "y"]], want[["rec", "t", "x", "o", "y"]])


def test_merge_tiers_columns(spark):
    a = spark.createDataFrame([("r", 1.0, 2.0, "p")], "rec string, t1 double, t2 double, note string")
    b = spark.createDataFrame([("r", 0.0, 1.0, "w")], "rec string, t1 double, t2 double, note string")
    assert asof.merge_tiers(a, b, ["rec"], suffixes=("_ph", "_wd")).columns == ["rec", "t1_ph", "t2_ph", "note_ph", "t1_wd", "t2_wd", "note_wd"]
    assert asof.merge_tiers(a, b, ["rec"], outer_end="t2").first()["note_outer"] is None
    with pytest.raises(KeyError):
        asof.merge_tiers(a, b, ["rec"], inner_t="nope")


@pytest.mark.parametrize("width", [None, 9.0])
def test_nearest_takes_the_later_of_two(spark, width):
    a = spark.createDataFrame([("r", x) for x in (0.0, 5.0, 10.0, 99.0)], "rec string, t double")
    b = spark.createDataFrame([("r", 2.0), ("r", 8.0), ("r", 12.0)], "rec string, s double")
    got = {r["t"]: (r["near_s"], r["within"]) for r in asof.nearest(a, b, ["rec"], "t", "s", 3.0, width=width).collect()}
    assert got == {0.0: (2.0, True), 5.0: (8.0, True), 10.0: (12.0, True), 99.0: (12.0, False)}


def test_adjust_boundaries_raises_or_flags(spark):
    inner = spark.createDataFrame([("r", 1.0), ("r", 2.0)], "rec string, t double")
    outer = spark.createDataFrame([("r", 1.1), ("r", 7.0)], "rec string, t double")
    with pytest.raises(ValueError) as e:
        asof.adjust_boundaries(inner=inner, outer=outer, keys=["rec"], tolerance=0.2)
    assert e.value.args[1] == [7.0]
    got = rows(asof.adjust_boundaries(inner=inner, outer=outer, keys=["rec"], tolerance=0.2, on_error="flag"), "t", "snapped")
    assert got == [(1.1, 1.0), (7.0, None)]


@pytest.mark.parametrize("width", [None, 5.0])
def test_interpolate_is_numpy_interp(spark, width):
    r = random.Random(3)
    times = sorted(r.sample(range(100), 20))
    m = spark.createDataFrame([("r", float(t), r.random()) for t in times], "rec string, t double, v double")
    q = spark.createDataFrame([("r", r.random() * 120 - 10) for _ in range(60)] + [("r", float(times[3]))], "rec string, q double")
    got = asof.interpolate(m, q, ["rec"], "t", "q", default_tolerance=False, width=width).toPandas()
    p = m.toPandas()
    assert np.allclose(got.v, np.interp(got.q, p.t, p.v))
    near = asof.interpolate(m, q, ["rec"], "t", "q", 0.5).toPandas()
    assert (near.within == [min(abs(x - t) for t in times) <= 0.5 for x in near.q]).all()
    assert near.v[~near.within].isna().all()


def test_interpolate_checks_columns(spark):
    m = spark.createDataFrame([("r", 1.0, "x")], "rec string, t double, v string")
    q = spark.createDataFrame([("r", 1.0, 1.0)], "rec string, q double, v double")
    with pytest.raises(ValueError):
        asof.interpolate(m, q, ["rec"], "t", "q")
    with pytest.raises(TypeError):
        asof.interpolate(m, q.drop("v"), ["rec"], "t", "q")


def test_interpolate_positions(spark):
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate([None, 1.0, None, None, 4.0, None])], "rec string, i int, v double")
    assert [v for _, v in rows(asof.interpolate_positions(df, ["rec"], ["i"], ["v"]), "i", "v")] == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]


def test_contained_is_closed_and_equal_with_bins(spark):
    p = spark.createDataFrame([("r", float(x)) for x in range(20)] + [("s", 3.0)], "rec string, t double")
    i = spark.createDataFrame([("r", 3.0, 9.0), ("r", 9.0, 9.0), ("r", 12.5, 30.0)], "rec string, t1 double, t2 double")
    plain = rows(asof.contained(p, i, ["rec"], "t", "t1", "t2"), "rec", "t", "t1")
    assert len(plain) == 7 + 1 + 7
    assert rows(asof.contained(p, i, ["rec"], "t", "t1", "t2", bin_width=4.0), "rec", "t", "t1") == plain


def test_add_context_order_and_fill(spark):
    df = spark.createDataFrame([("r", 1, "a", 0), ("r", 2, None, 0), ("r", 3, "c", 0)], "rec string, t int, x string, z int")
    out = tiers.add_context(df, "x", 2, 1, ["rec"], ["t"], fill="#", context="ctx")
    assert out.columns == ["rec", "t", "prev_x2", "prev_x1", "x", "next_x1", "z", "ctx"]
    assert [r["ctx"] for r in out.orderBy("t").collect()] == ["# # a #", "# a # c", "a # c #"]
    with pytest.raises(ValueError):
        tiers.add_context(df, "x", 1, 1, ["rec"], ["t"], context="z")


def test_explode_intervals(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "t1 double, t2 double")
    assert [r["obs_t"] for r in tiers.explode_intervals(df, 2).orderBy("obs_id").collect()] == [2.0, 2.5, 3.0]
    assert [r["q_t"] for r in tiers.explode_intervals(df, [0.25, 0.75], prefix="q_").orderBy("q_id").collect()] == [2.25, 2.75]


def test_nonzero_runs(spark):
    a = [2, 0, 1, 2, 3, 2, 1, 0, 0, 2, 4, 6, 4, 2, 0, 2]
    df = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(a)], "rec string, i int, v double")
    flag = F.col("v") > 1.5
    assert rows(tiers.nonzero_runs(df, ["rec"], ["i"], flag), "first", "last") == [(0, 0), (15, 15), (3, 5), (9, 13)]
    assert rows(tiers.nonzero_runs(df, ["rec"], ["i"], flag, 3, F.col("i") == 4), "run", "first", "length") == [(0, 3, 3)]


def test_gaps_checks_and_overlaps(spark):
    df = spark.createDataFrame([("r", 1.0, 2.0, "a"), ("r", 3.0, 4.0, "b")], "rec string, t1 double, t2 double, w string")
    assert rows(tiers.fill_gaps(df, ["rec"], "w", start=0.0, end=5.0), "t1", "t2", "w") == [(0.0, 1.0, ""), (1.0, 2.0, "a"), (2.0, 3.0, ""), (3.0, 4.0, "b"), (4.0, 5.0, "")]
    assert tuple(tiers.validate_tier(df, ["rec"]).first())[1:] == (0, 0, 0, 0)
    bad = df.unionByName(spark.createDataFrame([("r", 1.5, 1.4, "x")], df.schema))
    assert tuple(tiers.validate_tier(bad, ["rec"]).first())[1:] == (0, 1, 1, 1)
    assert rows(tiers.overlaps(bad, ["rec"]), "t1", "prev_end") == [(1.5, 2.0)]


def test_split_speakers(spark):
    df = spark.createDataFrame([("c", 1, "hm"), ("c", 2, "A: hi"), ("c", 3, "more"), ("c", 4, "B: x: y")], "k string, i int, text string")
    assert rows(tiers.split_speakers(df, ["k"], ["i"], sep=": "), "i", "speaker", "text") == [(1, "*", "hm"), (2, "A", "hi"), (3, "A", "more"), (4, "A", "B")]
    assert rows(tiers.split_speakers(df, ["k"], ["i"], sep=": ", max_split=1), "i", "speaker", "text")[3] == (4, "B", "x: y")
    assert rows(tiers.split_speakers(df, ["k"], ["i"], sep=": ", ffill=False), "speaker")[0] == ("*",)
    with pytest.raises(ValueError):
        tiers.split_speakers(df, ["k"], ["i"], sep=": ", include=["Z"])


def test_contour_and_delta_f(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 2.0, 2.0, None, 3.0])] + [("b", 0, 1.0)], "k string, t int, v double")
    assert rows(tiers.contour(df, ["k"], "t", "v"), "k", "contour") == [("a", "rfff"), ("b", "")]
    f = spark.createDataFrame([("s", 0.5, 4.5, None, None), ("s", None, 4.5, None, None)], "spk string, F1 double, F2 double, F3 double, F4 double")
    assert norm.delta_f(f).first()[0] == pytest.approx((1 + 3 + 3) / 3)
    assert norm.delta_f(f, ["spk"], vtl=True).first()["vtl"] == pytest.approx(35300 / (2 * 7 / 3))
    assert norm.delta_f_norm(f, ["spk"]).first()["F2/∆F"] == pytest.approx(4.5 / (7 / 3))
    assert norm.delta_f_norm(f, factor=2.0).first()["F2/∆F"] == 2.25
    assert norm.delta_f_norm(f).count() == 2


def test_partitioning_and_other_recordings_change_nothing(spark):
    a = track(spark, 5, 80)
    views = track(spark, 6, 40, "o", "y")
    want = rows(asof.merge_tiers(a, views, ["rec"], "t", "o", tie="y"), "rec", "v", "y")
    more = a.unionByName(spark.createDataFrame([("zz", 1.0, -1.0)], a.schema)).repartition(7)
    assert rows(asof.merge_tiers(more, views.repartition(3), ["rec"], "t", "o", tie="y").where("rec <> 'zz'"), "rec", "v", "y") == want


def test_empty_tables(spark):
    e = spark.createDataFrame([], "rec string, t1 double, t2 double, w string")
    assert tiers.fill_gaps(e, ["rec"], "w", start=0.0, end=1.0).count() == 0
    assert asof.merge_tiers(e, e, ["rec"]).count() == 0
    assert tiers.nonzero_runs(e, ["rec"], ["t1"], F.col("t1") > 0).count() == 0


def test_samples(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") < 3000, "x").otherwise("y").alias("c"))
    assert rows(series.sample_per_class(df, "c", 50).groupBy("c").count(), "c", "count") == [("x", 50), ("y", 50)]
    n = {r["c"]: r["count"] for r in series.sample_per_class(df, "c", 1000, True).groupBy("c").count().collect()}
    assert all(800 < v < 1200 for v in n.values())


def test_match_frames_keeps_the_shape_of_times(spark):
    from tierloom.operators.asof import match_frames

    track = spark.createDataFrame([("a", x) for x in (0.0, 1.0, 2.0, 4.0)] + [("b", 5.0)], "rec string, sec double")
    flat = spark.createDataFrame([("a", 0.5, 1), ("a", 3.9, 2), ("b", -9.0, 3), ("c", 1.0, 4)], "rec string, t double, n int")
    assert sorted((r["n"], r["frame"]) for r in match_frames(flat, track, ["rec"]).collect()) == [(1, 1), (2, 3), (3, 0), (4, None)]
    one = spark.createDataFrame([("a", [0.1, None, 9.0]), ("a", []), ("a", None), ("b", [1.0]), ("b", [1.0])], "rec string, t array<double>")
    got = match_frames(one, track, ["rec"], width=1.5)
    assert got.columns == ["rec", "t", "frame"] and sorted(((r["rec"], r["frame"]) for r in got.collect()), key=str) == sorted([("a", [0, None, 3]), ("a", []), ("a", None), ("b", [0]), ("b", [0])], key=str)
    two = spark.createDataFrame([("a", [[0.1, 1.2], [], [4.0]])], "rec string, t array<array<double>>")
    assert match_frames(two, track, ["rec"]).first()["frame"] == [[0, 1], [], [3]]
