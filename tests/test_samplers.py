import numpy as np
import pytest
from test_dsp import FS, vowel

from tierloom import api
from tierloom.signal.samplers import interpolated

SEC = np.arange(40) * 0.01 + 0.005
WAVE = 60 + 5 * np.sin(SEC * 20)


@pytest.mark.parametrize("kind, tol", [("LINEAR", 0.05), ("CUBIC", 0.01), ("SINC70", 0.15), ("SINC700", 0.15), ("NEAREST", 0.6)])
def test_interpolated(kind, tol):
    at = np.array([0.1, 0.1234, 0.2, 0.251])
    assert np.abs(interpolated(SEC, WAVE, at, kind) - (60 + 5 * np.sin(at * 20))).max() < tol
    assert interpolated(SEC, WAVE, SEC[[3, 7]], kind) == pytest.approx(WAVE[[3, 7]])
    assert interpolated(SEC, WAVE, np.array([-1.0, 9.0]), kind) == pytest.approx(WAVE[[0, -1]], abs=tol)
    assert interpolated(SEC[:1], WAVE[:1], at, kind).tolist() == [WAVE[0]] * 4
    assert np.isnan(interpolated(SEC[:0], WAVE[:0], at, kind)).all()


@pytest.fixture(scope="module")
def signals(spark):
    return spark.createDataFrame([("a", float(FS), vowel().tolist()), ("b", float(FS), None), ("c", float(FS), [])], "rec string, fs double, y array<double>")


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame([("a", 0.1), ("a", 0.2), ("b", 0.1)], "rec string, t double")


def test_formants_at_times(signals, targets):
    got = {(r["rec"], r["t"]): r for r in api.formant_to_df(signals, ["rec"], 3, targets, "t", include_bw=True).collect()}
    assert got["a", 0.1]["F1"] == pytest.approx(500, rel=0.05) and 0 < got["a", 0.2]["B1"] < 200 and got["b", 0.1]["F1"] is None
    bark = api.formant_to_df(signals, ["rec"], 1, targets, "t", "BARK").where("rec = 'a'").first()
    assert bark["F1"] == pytest.approx(7 * np.arcsinh(got["a", bark["t"]]["F1"] / 650))
    with pytest.raises(ValueError):
        api.formant_to_df(signals, ["rec"], 1, targets, "nowhere")


@pytest.mark.parametrize("kind", ["LINEAR", "NEAREST"])
def test_pitch_at_times(signals, targets, kind):
    got = [r["f0"] for r in api.pitch_to_df(signals, ["rec"], targets, "t", "SEMITONES_100", kind).where("rec = 'a'").collect()]
    assert got == pytest.approx([12 * np.log2(1.25)] * 2, abs=0.4)
    assert {r["rec"] for r in api.pitch_to_df(signals, ["rec"]).collect()} == {"a"}


def test_intensity_and_cepstra_at_times(signals, targets):
    got = api.intensity_to_df(signals, ["rec"], targets, "t").collect()
    assert len(got) == 3 and all((r["intensity"] is None) == (r["rec"] == "b") for r in got)
    frames = api.mfcc_to_df(signals, ["rec"])
    near = api.mfcc_to_df(signals, ["rec"], targets=targets, t="t").where("rec = 'a'").collect()
    assert {r["c1"] for r in near} <= {r["c1"] for r in frames.collect()} and len(near) == 2
