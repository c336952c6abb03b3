"""Recordings in slices give what whole recordings give."""

import random

import pytest
from pyspark.sql import functions as F

from tierloom.operators import asof, tiers
from tierloom.operators.slices import running, shifted

WIDTHS = [0.5, 3.0, 20.0, 1000.0]


@pytest.fixture(scope="module")
def spans(spark):
    r, rows = random.Random(2), []
    for rec in "abc":
        t = 0.0
        for k in range(60 if rec != "c" else 1):
            t += r.choice([0.1, 0.4, 1.0, 7.0])
            rows.append((rec, k, t, t + r.choice([0.05, 0.4, 1.5, 9.0]), r.choice(["x", "y", None]), r.random()))
    return spark.createDataFrame(rows, "rec string, k int, t1 double, t2 double, label string, v double").repartition(5)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("width", WIDTHS)
def test_slices_change_nothing(spans, width):
    pairs = [
        lambda w: shifted(spans, ["rec"], ["t1", "k"], {"a": ("v", 2), "b": ("label", 1), "c": ("v", -3), "d": ("k", -1)}, w),
        lambda w: running(spans, ["rec"], ["t1", "k"], "m", "t2", "max", w),
        lambda w: running(spans, ["rec"], ["t1", "k"], "s", "k", "sum", w),
        lambda w: tiers.add_context(spans, "label", 2, 3, ["rec"], ["t1", "k"], context="all", width=w),
        lambda w: tiers.fill_gaps(spans, ["rec"], "label", start=0.0, end=900.0, width=w),
        lambda w: tiers.validate_tier(spans, ["rec"], width=w),
        lambda w: tiers.overlaps(spans, ["rec"], width=w),
        lambda w: tiers.nonzero_runs(spans, ["rec"], ["t1", "k"], F.col("v") > 0.4, 2, width=w),
        lambda w: asof.interpolate(spans.select("rec", "t1", F.col("v").alias("m")), spans.select("rec", "k", "t2"), ["rec"], "t1", "t2", width=w),
        lambda w: asof.match_frames(spans.select("rec", "k", F.array("t1", "t2").alias("t")), spans.select("rec", F.col("t1").alias("sec")).distinct(), ["rec"], width=w),
        lambda w: tiers.split_speakers(spans.withColumn("text", F.when(F.col("v") > 0.7, F.concat(F.lit("p"), "k", F.lit(": hm"))).otherwise("hm")), ["rec"], ["t1", "k"], sep=": ", width=w),
    ]
    for make in pairs:
        whole, sliced = make(None), make(width)
        assert whole.columns == sliced.columns
        assert rows(whole) == rows(sliced)
