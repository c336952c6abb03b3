import numpy as np
import pytest

from tierloom.operators.workflow import measure_texts, process_missing, read_measures
from tierloom.signal import measures
from tierloom.sources import files, listing, srt, textgrid, wav
from tierloom.streaming.incremental import process_new_files

ROWS = [("r", 0, "word", 0.0, 0.5, 'say "x"'), ("r", 0, "word", 0.7, 1.0, "[2] 3"), ("r", 1, "pt", 0.3, None, "p"), ("r", 1, "pt", 0.4, None, None)]
SCHEMA = "rec string, tier_no int, tier string, t1 double, t2 double, label string"


@pytest.mark.parametrize("style", ["short", "long"])
def test_textgrid_round_trip(spark, tmp_path, style):
    text = textgrid.textgrid_text(spark.createDataFrame(ROWS, SCHEMA), ["rec"], style).first()["text"]
    got = [(r[0], r[1], r[4], r[5], r[6]) for r in textgrid.parse(text)]
    assert got == [(0, "word", 0.0, 0.5, 'say "x"'), (0, "word", 0.5, 0.7, ""), (0, "word", 0.7, 1.0, "[2] 3"), (1, "pt", 0.3, None, "p"), (1, "pt", 0.4, None, "")]
    for name, raw in (("a", text.encode()), ("b", text.encode("utf-16"))):
        (tmp_path / f"{name}.TextGrid").write_bytes(raw)
    df = textgrid.read_textgrid(spark, str(tmp_path), ["pt", 0], ["points", "words"])
    assert sorted({(r["tier_no"], r["tier"]) for r in df.collect()}) == [(0, "points"), (1, "words")] and df.count() == 10
    with pytest.raises(ValueError):
        textgrid.read_textgrid(spark, str(tmp_path), ["pt", 0], ["one"])


def test_textgrid_refuses_bad_tiers(spark):
    bad = spark.createDataFrame([("r", 0, "w", 0.0, 1.0, "a"), ("r", 0, "w", 0.5, 2.0, "b")], SCHEMA)
    with pytest.raises(RuntimeError):
        textgrid.textgrid_text(bad, ["rec"])


def test_textgrid_files(spark, tmp_path):
    textgrid.write_textgrids(textgrid.textgrid_text(spark.createDataFrame(ROWS, SCHEMA), ["rec"]), "rec", f"{tmp_path}/out")
    assert textgrid.read_textgrid(spark, f"{tmp_path}/out").count() == 5


def test_srt(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:01,500 --> 00:00:02,000\nA: hi\nthere\n\n2\n01:00:00,000 --> 01:00:01,250\nB\n")
    got = [(r["t1"], r["t2"], r["text"]) for r in srt.read_srt(spark, str(tmp_path)).orderBy("t1").collect()]
    assert got == [(1.5, 2.0, "A: hi\nthere"), (3600.0, 3601.25, "B")]


@pytest.fixture(scope="module")
def sounds(tmp_path_factory):
    folder = tmp_path_factory.mktemp("wav")
    for k in range(2):
        t = np.arange(8000) / 8000
        (folder / f"s{k}.wav").write_bytes(wav.to_bytes(np.array([np.sin(2 * np.pi * 120 * t), 0.5 * np.sin(2 * np.pi * 200 * t)]), 8000))
    return str(folder)


def test_wav(spark, sounds):
    df = wav.load_signals(spark, sounds)
    assert df.count() == 4 and {r["fs"] for r in df.collect()} == {8000.0}
    part = wav.load_signals(spark, sounds, channels=[1, 0, 1], offset=0.5, duration=0.25, fs=16000).collect()
    assert [r["chan"] for r in part] == [1, 0, 1] * 2 and len(part[0]["y"]) == 4000
    assert max(part[0]["y"]) == pytest.approx(0.5, abs=0.02)


def test_signal_operators(spark, sounds):
    keys = ["path", "chan"]
    df = wav.load_signals(spark, sounds).where("chan = 0").limit(1)
    f0 = measures.get_f0_cor(df, keys).toPandas()
    assert f0.f0.median() == pytest.approx(120, rel=0.03)
    assert measures.track_formants(df, keys).columns == ["path", "chan", "sec", "rms", "F1", "F2", "F3", "F4", "F5", "F6", "f0", "c"]
    for out in (measures.get_f0(df, keys), measures.get_f0_srh(df, keys), measures.get_f0_acd(df, keys), measures.compute_sgram(df, keys, nfft=512), measures.auditory(df, keys, "tgram"), measures.mfcc(df, keys),
                measures.prep_audio(df, keys), measures.amplitude_envelope(df, keys), measures.add_noise(df, keys), measures.sigcor_noise(df, keys), measures.vocode(df, keys, [(100, 500), (500, 1500)]),
                measures.apply_filterbank(df, keys, [(100, 500)]), measures.peak_rms(df, keys), measures.egg_to_oq(df, keys), measures.get_rhythm_spectrum(df, keys, 1), measures.intensity(df, keys)):
        assert out.count() > 0
    track = measures.track_formants(df, keys).fillna(0.0)
    assert measures.sine_synth(track, keys).count() == 1
    at = df.selectExpr("path", "chan", "0.5D AS t")
    assert measures.sample_track(measures.intensity(df, keys), at, keys, "t", ["intensity"]).first()["intensity"] > 60
    spans = df.selectExpr("*", "0.5D AS t", "0.1D AS a", "0.6D AS b")
    assert measures.fricative(spans, keys, "t").count() == 1 and measures.burst(spans, keys, "a", "b").count() == 1


def test_listing(spark, tmp_path):
    for d in ("s1/t1", "s1/t2", "s2/t1"):
        (tmp_path / d).mkdir(parents=True)
        (tmp_path / d / "acq1.tg").write_text("x")
    (tmp_path / "s1/t2/.hid").write_text("x")
    (tmp_path / "s2/t1/.bad.txt").write_text("x")
    df = listing.list_files(spark, str(tmp_path), r"^(?P<token>.+)\.tg$", r"^(?P<subj>s\d)/", add=["barename", "ext", "bytes"])
    assert sorted(tuple(r) for r in df.collect()) == [("s1/t1", "acq1.tg", "acq1", ".tg", 1, "s1", "acq1"), ("s1/t2", "acq1.tg", "acq1", ".tg", 1, "s1", "acq1")]
    assert listing.list_files(spark, str(tmp_path), dotfiles=True).count() == 3


def test_listing_takes_any_group_name_and_reference(spark, tmp_path):
    for d in ("s1/a b", "s2/x+y"):
        (tmp_path / d).mkdir(parents=True)
        (tmp_path / d / "ab_ab.tg").write_text("x")
        (tmp_path / d / "ab_cd.tg").write_text("x")
    (tmp_path / "s2/.bad.txt").write_text("")
    for root in (str(tmp_path), f"file://{tmp_path}"):
        df = listing.list_files(spark, root, r"^(?P<first_id>[a-z]+)_(?P=first_id)(?P<e_x_t>\.(tg))$", r"^(?P<sub_id>s\d)/")
        assert df.columns == ["relpath", "fname", "sub_id", "first_id", "e_x_t"]
        assert sorted(tuple(r) for r in df.collect()) == [("s1/a b", "ab_ab.tg", "s1", "ab", ".tg"), ("s2/x+y", "ab_ab.tg", "s2", "ab", ".tg")]
    (tmp_path / "s2/x+y/.bad.txt").write_text("")
    for hidden in (False, True):
        assert {r["relpath"] for r in listing.list_files(spark, f"file://{tmp_path}", dotfiles=hidden).collect()} == {"s1/a b"}


def test_bad_files_are_ignored_if_asked(spark, tmp_path):
    text = textgrid.textgrid_text(spark.createDataFrame(ROWS, SCHEMA), ["rec"]).first()["text"]
    (tmp_path / "tg").mkdir()
    for name, x in (("a", text), ("b", text[: len(text) // 2]), ("c", "no such file"), ("d", "")):
        (tmp_path / f"tg/{name}.TextGrid").write_text(x)
    assert textgrid.read_textgrid(spark, f"{tmp_path}/tg", errors="ignore").count() == 5
    with pytest.raises(Exception, match="not a whole TextGrid"):
        textgrid.read_textgrid(spark, f"{tmp_path}/tg").count()
    (tmp_path / "w").mkdir()
    good = wav.to_bytes(np.zeros(100), 8000)
    for name, x in (("a", good), ("b", good[:20]), ("c", b"RIFF")):
        (tmp_path / f"w/{name}.wav").write_bytes(x)
    assert wav.load_signals(spark, f"{tmp_path}/w", errors="ignore").count() == 1
    assert wav.load_signals(spark, f"{tmp_path}/w", channels=[1], errors="ignore").count() == 0
    with pytest.raises(Exception, match="WAV|format"):
        wav.load_signals(spark, f"{tmp_path}/w").count()


def test_long_recordings_come_in_chunks(spark, sounds):
    whole = {(r["path"], r["chan"]): r["y"] for r in wav.load_signals(spark, sounds).collect()}
    rows = wav.load_chunks(spark, sounds, 0.3, 0.05).collect()
    assert len(rows) == 4 * 4
    for r in rows:
        first = int(r["start"] * 8000 + 0.5)
        assert r["y"] == whole[(r["path"], r["chan"])][first : first + 2800] and first == r["chunk"] * 2400


def test_write_files(spark, tmp_path):
    df = spark.createDataFrame([("a/b.txt", "é"), ("c.txt", None), (None, "x")], "name string, content string")
    for _ in range(2):
        assert sorted(tuple(r) for r in files.write_files(df, f"file://{tmp_path}/o").collect()) == [("a/b.txt", 2), ("c.txt", 0)]
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()) == ["o/a/b.txt", "o/c.txt"]


def test_measures_and_arrays_are_written(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.2, 'x\ty"\\'), ("a", 0.1, None), ("b", 1.0, "z")], "rec string, sec double, label string")
    texts = measure_texts(df, ["rec"], ["sec", "label"], ["sec"])
    assert files.write_files(texts.selectExpr("concat(rec, '.ifc') AS name", "content"), str(tmp_path / "m")).count() == 2
    got = read_measures(spark, f"{tmp_path}/m", "sec double, label string", f"{tmp_path}/m")
    assert sorted((r["barename"], r["sec"], r["label"]) for r in got.collect()) == [("a", 0.1, None), ("a", 0.2, 'x\ty"\\'), ("b", 1.0, "z")]
    arrays = spark.createDataFrame([("a", [1.0, 2.0], 3), ("b", None, 4)], "rec string, y array<double>, n int")
    files.write_files(files.npz_contents(arrays, ["rec"], ["y", "n"]).selectExpr("concat(rec, '.npz') AS name", "content"), str(tmp_path / "z")).count()
    a, b = (np.load(tmp_path / f"z/{k}.npz") for k in "ab")
    assert a["y"].tolist() == [1.0, 2.0] and int(a["n"]) == 3 and b.files == ["n"]


def test_measures_and_incremental_runs(spark, tmp_path):
    (tmp_path / "m/s1").mkdir(parents=True)
    (tmp_path / "m/s1/a.ifc").write_text("sec\tf0\n0.1\t100\n0.2\t0\n")
    df = read_measures(spark, f"{tmp_path}/m", "sec double, f0 double", f"{tmp_path}/m")
    assert [(r["relpath"], r["barename"], r["f0"]) for r in df.orderBy("sec").collect()] == [("s1", "a", 100.0), ("s1", "a", 0.0)]
    todo = spark.createDataFrame([(1,), (2,)], "id int")
    assert process_missing(todo, ["id"], f"{tmp_path}/out", lambda d: d.selectExpr("id", "id * 2 AS v")).count() == 2
    more = spark.createDataFrame([(2,), (3,)], "id int")
    assert sorted(tuple(r) for r in process_missing(more, ["id"], f"{tmp_path}/out", lambda d: d.selectExpr("id", "id * 2 AS v")).collect()) == [(1, 2), (2, 4), (3, 6)]


def test_stream_takes_each_file_once(spark, sounds, tmp_path):
    for _ in range(2):
        process_new_files(spark, sounds, lambda f: f.selectExpr("path", "length(content) AS n"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_fixed_formats_round_what_is_stored(spark):
    from tierloom.sources.textgrid import number

    values = [1704527041.01485, 1705909278.40565, 0.00005, 2.5, -1.00015, 1e15]
    df = spark.createDataFrame([(v,) for v in values], "t double")
    assert [r[0] for r in df.select(number("%.4f", "t")).collect()] == [f"{v:.4f}" for v in values]
