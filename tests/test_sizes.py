"""What a task holds, reads and does at once is bounded, however large the input."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tierloom.dsp import hearing, voice
from tierloom.operators import norm
from tierloom.signal import measures
from tierloom.sources import files, srt, textgrid, wav


@pytest.fixture
def functions(spark, monkeypatch):
    """The functions that are given to mapInArrow from now on."""
    found, frame = [], type(spark.range(1))
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, _map=frame.mapInArrow, **b: found.append(f) or _map(self, f, *a, **b))
    return found


def test_sine_synth_hands_back_few_signals_at_once(spark, functions):
    cols = ["sec", "rms", "F1", "F2", "F3", "F4"]
    at = F.col("id") % 100
    rows = spark.range(300).select((F.col("id") / 100).cast("int").alias("k"), (at * 0.1).alias("sec"), F.sin(at + F.col("id")).alias("rms"), *[(500.0 * k + at + F.col("id")).alias(f"F{k}") for k in (1, 2, 3)], F.when(at == 7, None).otherwise(3500.0).alias("F4"))
    got = {r["k"]: (r["fs"], r["y"]) for r in measures.sine_synth(rows, ["k"], 50000).collect()}
    tracks = {k: rows.where(F.col("k") == k).orderBy("sec").select(*cols).toPandas().to_numpy(float) for k in range(3)}
    for k, m in tracks.items():
        assert got[k][0] == 50000 and np.allclose(got[k][1], hearing.sine_synth(m[:, 0], m[:, 1], m[:, 2:], 50000))
    kinds = pa.list_(pa.struct([(c, pa.float64()) for c in cols]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(9), pa.int32()), pa.array([[dict(zip(cols, map(float, r))) for r in tracks[k % 3]] for k in range(9)], kinds)], names=["k", "track"])
    made = list(functions[0](iter([batch])))
    assert len(made) > 1 and max(len(b.column(2).values) for b in made) < measures.BATCH + 500_000
    assert sum((b.column(0).to_pylist() for b in made), []) == list(range(9))
    assert sum(map(len, (b.column(2).flatten() for b in made))) == 9 * len(got[0][1])


def tones(count: int) -> list[tuple[np.ndarray, float]]:
    """Signals of several lengths and rates, some too short for a frame, one silent."""
    rng = np.random.default_rng(1)
    shapes = [(64, 640.0), (300, 1000.0), (5, 640.0), (2500, 12000.0), (4800, 16000.0)]
    out = [(rng.normal(size=n) + np.sin(np.arange(n) * (0.1 + k / 50)), fs) for k in range(count) for n, fs in [shapes[k % 5]]]
    return [(np.zeros_like(y), fs) if k == 3 else (y, fs) for k, (y, fs) in enumerate(out)]


@pytest.mark.parametrize("many, one", [
    (lambda s: voice.f0_harmonics_of(s), lambda y, fs: voice.f0_harmonics(y, fs)),
    *[(lambda s, m=m: voice.formants_ifc_of(s, method=m), lambda y, fs, m=m: voice.formants_ifc(y, fs, method=m)) for m in ("ifc", "ifc_fast", "ifc_old")],
])
def test_frames_of_many_signals_are_measured_as_those_of_one(many, one):
    signals = tones(12)
    for got, (y, fs) in zip(many(signals), signals, strict=True):
        for k, v in one(y, fs).items():
            assert len(got[k]) == len(v) and np.allclose(got[k], v, equal_nan=True), k


@pytest.mark.parametrize("method", ["ifc", "ifc_fast", "ifc_old"])
def test_inverse_filter_control_takes_frames_of_many_signals_at_once(spark, functions, monkeypatch, method):
    rows = [(k, fs, y.tolist()) for k, (y, fs) in enumerate(tones(40))]
    df = spark.createDataFrame(rows, "k int, fs double, y array<double>")
    measures.track_formants(df, ["k"], method, 0.94)
    calls, real = [], voice._control
    monkeypatch.setattr(voice, "_control", lambda f, *a: calls.append(len(f)) or real(f, *a))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["k", "fs", "y"])
    made = pa.Table.from_batches(functions[0](iter([batch]))).to_pandas()
    monkeypatch.undo()
    want = {k: len(voice.formants_ifc(np.array(y), fs, 0.94, method="ifc_fast")["sec"]) for k, fs, y in rows}
    assert made.groupby("k").size().to_dict() == {k: n for k, n in want.items() if n}
    assert len(calls) == -(-sum(want.values()) // voice.FRAMES) and sum(calls) == sum(want.values())


def test_harmonics_take_frames_of_many_signals_at_once(spark, functions, monkeypatch):
    rows = [(k, fs, y.tolist()) for k, (y, fs) in enumerate(tones(40))]
    measures.get_f0_srh(spark.createDataFrame(rows, "k int, fs double, y array<double>"), ["k"])
    monkeypatch.setattr(measures, "TOGETHER", 3.0)
    calls, real = [], voice.f0_harmonics_of
    monkeypatch.setattr(voice, "f0_harmonics_of", lambda some, *a: calls.append(len(some)) or real(some, *a))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["k", "fs", "y"])
    made = pa.Table.from_batches(functions[0](iter([batch]))).to_pandas()
    assert 1 < len(calls) < 10 and sum(calls) == 40
    for k, fs, y in rows[::7]:
        want = voice.f0_harmonics(np.array(y), fs)
        assert np.allclose(made.f0[made.k == k].to_numpy(float), want["f0"], equal_nan=True)


def test_signals_are_dealt_to_more_tasks_the_more_they_are(spark, monkeypatch):
    monkeypatch.setattr(measures, "PIECE", 1000)
    few, many = (spark.range(n).select("id", F.lit(640.0).alias("fs"), F.array(F.rand(1), F.rand(2)).alias("y")) for n in (1000, 8000))
    a, b = (measures.peak_rms(df, ["id"]).rdd.getNumPartitions() for df in (few, many))
    assert 7 * a <= b <= 9 * a and a > spark.sparkContext.defaultParallelism
    assert measures.peak_rms(many, ["id"]).count() == 8000


def test_many_small_files_are_read_in_few_tasks(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    for k in range(40 * cores):
        (tmp_path / f"{k}.wav").write_bytes(wav.to_bytes(np.full(10, k / 1000), 8000))
        (tmp_path / f"{k}.TextGrid").write_text(f'File type = "ooTextFile"\nObject class = "TextGrid"\n\n0\n1\n<exists>\n1\n"IntervalTier"\n"w"\n0\n1\n1\n0\n1\n"n{k}"\n')
    one = tmp_path / "x.srt"
    one.write_text("1\n00:00:01,000 --> 00:00:02,000\nhello\n")
    sounds, grids = wav.load_signals(spark, str(tmp_path)), textgrid.read_textgrid(spark, str(tmp_path / "*.TextGrid"))
    assert sounds.rdd.getNumPartitions() == grids.rdd.getNumPartitions() == cores
    assert sorted(round(r["y"][0] * 1000) for r in sounds.collect()) == list(range(40 * cores))
    assert {r["label"] for r in grids.collect()} == {f"n{k}" for k in range(40 * cores)}
    assert [r["text"] for r in srt.read_srt(spark, str(one)).collect()] == ["hello"]


def test_large_files_keep_their_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "FILES", 2)
    for k in range(64):
        (tmp_path / f"{k}.wav").write_bytes(wav.to_bytes(np.zeros(10), 8000))
    assert files.binary_files(spark, str(tmp_path), "*.wav").rdd.getNumPartitions() == spark.read.format("binaryFile").load(str(tmp_path)).rdd.getNumPartitions()


def test_rows_of_a_large_group_meet_its_spacing_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(norm, "PART", 100, raising=False)
    x = F.col("id").cast("double")
    key = F.when(F.col("id") < 3000, "a").when(F.col("id") < 3090, "b").when(F.col("id") < 3500, None).otherwise(F.col("id").cast("string"))
    rows = spark.range(3510).select(key.alias("spk"), "id", *[(x * k + 1).alias(f"F{k}") for k in (1, 2, 3)], F.when(x % 2 == 0, x).alias("F4"))
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in plain}
    for name, value in plain.items():
        spark.conf.set(name, value)
    try:
        found = norm.delta_f_norm(rows, ["spk"]).withColumn("at", F.spark_partition_id()).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    want = {r["spk"]: r["deltaF"] for r in norm.delta_f(rows, ["spk"]).collect()}
    assert sorted(r["id"] for r in found) == list(range(3510))
    assert all(r["deltaF"] == pytest.approx(want[r["spk"]]) and r["F2/∆F"] == pytest.approx(r["F2"] / want[r["spk"]]) for r in found)
    at = [r["at"] for r in found if r["spk"] == "a"]
    assert max(map(at.count, set(at))) < 1800
