import numpy as np
import pytest

from tierloom.dsp import filters, hearing, spectra, voice

FS = 16000
T = np.arange(FS) / FS


def tone(f, fs=FS, n=FS):
    return np.sin(2 * np.pi * f * np.arange(n) / fs)


def vowel(f0=125, formants=((500, 60), (1500, 90), (2500, 120), (3500, 150)), n=8000):
    x = np.zeros(n)
    x[:: int(FS / f0)] = 1
    for f, b in formants:
        r = np.exp(-np.pi * b / FS)
        k = np.arange(2000)
        theta = 2 * np.pi * f / FS
        x = np.convolve(x, r**k * np.sin((k + 1) * theta) / np.sin(theta))[:n]
    return x


@pytest.mark.parametrize("kind, cut, keep", [("low", (300.0,), 100), ("high", (1000.0,), 2000), ("band", (300.0, 700.0), 500)])
@pytest.mark.parametrize("order", [2, 5, 8])
def test_butterworth_keeps_its_band(kind, cut, keep, order):
    sos = filters.butterworth(order, cut, FS, kind)
    at = lambda f: abs(np.prod([np.polyval(s[2::-1], np.exp(-2j * np.pi * f / FS)) / np.polyval(s[:2:-1], np.exp(-2j * np.pi * f / FS)) for s in sos]))
    for c in cut:
        assert at(c) == pytest.approx(2**-0.5, abs=1e-3)
    y = filters.filtfilt(sos, tone(keep) + 3 * (kind == "high"))
    assert np.abs(y - at(keep) ** 2 * tone(keep))[2000:-2000].max() < 1e-3 and at(keep) > 0.97


@pytest.mark.parametrize("n", [1, 2, 31, 32, 33, 500])
def test_sosfilt_is_the_recursion(n):
    sos, x = filters.butterworth(5, (300.0,), FS), np.random.default_rng(n).normal(size=(3, n))
    want = x.copy()
    for b0, b1, b2, _, a1, a2 in sos:
        z1 = z2 = np.zeros(3)
        for i in range(n):
            v = want[:, i].copy()
            want[:, i] = b0 * v + z1
            z1, z2 = b1 * v - a1 * want[:, i] + z2, b2 * v - a2 * want[:, i]
    assert np.allclose(filters.sosfilt(sos, x), want, atol=1e-12)
    assert np.allclose(filters.filtfilt(sos, x)[1], filters.filtfilt(sos, x[1]), atol=1e-12)


def test_resample_keeps_tones():
    assert np.allclose(filters.resample_fft(tone(100), 8000), tone(100, 8000, 8000), atol=1e-9)
    assert np.allclose(filters.resample_fft(tone(100, 8000, 8000), FS), tone(100), atol=1e-9)


def test_prepare():
    y, fs = filters.prepare(np.array([0.1, -0.5, 0.2]), 8000, None)
    assert fs == 8000 and y.max() == pytest.approx(0.99) and y[1] == pytest.approx(0.99)
    assert filters.prepare(np.array([0.0, 1.0]), 8000, None, outtype="int16")[0].tolist() == [0, 32439]


@pytest.mark.parametrize("f", [voice.f0_residual, lambda y, fs: voice.f0_spectral(y, fs, (90, 180))])
def test_f0_of_a_vowel(f):
    assert np.nanmedian(f(vowel(), FS)["f0"]) == pytest.approx(125, rel=0.02)


def test_f0_of_a_vowel_by_harmonics():
    """The pulses have no spectral tilt, so there is none to undo; with the tilt of a voice the default pre-emphasis undoes it."""
    assert np.nanmedian(voice.f0_harmonics(vowel(), FS, pre=0)["f0"]) == pytest.approx(125, rel=0.02)
    tilted = np.convolve(vowel(), 0.94 ** np.arange(400))[:8000]
    assert np.nanmedian(voice.f0_harmonics(tilted, FS)["f0"]) == pytest.approx(125, rel=0.02)


def test_f0_of_a_tone_by_autocorrelation():
    assert np.nanmedian(voice.f0_autocorrelation(tone(150), FS)["f0"]) == pytest.approx(150, rel=0.02)


@pytest.mark.parametrize("track", [voice.formants_lpc, voice.formants_ifc, lambda x, fs: voice.formants_ifc(x, fs, method="ifc_fast"), lambda x, fs: voice.formants_ifc(x, fs, method="ifc_old")])
def test_formants_of_a_vowel(track):
    found = track(vowel(), FS)
    for k, f in enumerate((500, 1500, 2500, 3500), 1):
        assert np.nanmedian(found[f"F{k}"]) == pytest.approx(f, rel=0.04)


def test_find_peaks():
    y = np.array([0, 1, 0, 3, 2.5, 2.9, 0, 2, 2, 2, 0.0])
    assert spectra.find_peaks(y).tolist() == [1, 3, 5, 8]
    assert spectra.find_peaks(y, height=2).tolist() == [3, 5, 8]
    assert spectra.find_peaks(y, distance=3).tolist() == [3, 8]
    assert spectra.find_peaks(y, prominence=1).tolist() == [1, 3, 8]
    assert spectra.find_peaks(np.zeros(5)).tolist() == []


def test_multitaper_keeps_the_energy():
    y = np.random.default_rng(0).standard_normal(320)
    _, p = spectra.multitaper(y)
    assert p.sum() / 320 == pytest.approx(np.var(y), rel=0.1)


def test_fricative_and_burst():
    noise = np.random.default_rng(0).standard_normal(FS)
    found = voice.fricative(noise, FS, 0.5)
    assert 3000 < found["COG"] < 5500 and abs(found["Skew"]) < 0.5
    assert voice.fricative(noise, FS, 0.0) is None
    y = np.concatenate([noise[:4000] * 1e-3, noise[4000:4500] * np.exp(-np.arange(500) / 100), noise[:4000] * 1e-3])
    at, score = voice.burst(y, FS, 0, 0.5)
    assert at == pytest.approx(0.25, abs=0.005) and score > 0
    assert voice.burst(np.zeros(9000), FS, 0, 0.5) == (-1.0, 0.0)


def test_rhythm_finds_the_modulation():
    x = np.random.default_rng(0).standard_normal(8 * FS) * (1 + tone(4, FS, 8 * FS))
    f, p = voice.rhythm_spectrum(x, FS)
    assert f[p.argmax()] == pytest.approx(4, abs=0.3) and 0.5 < f[0] and f[-1] < 7
    assert voice.rhythmogram(x, FS)[2].shape == (9, len(f))


def test_open_quotient():
    phase = (T * 100) % 1
    found = voice.open_quotient(np.where(phase < 0.6, np.sin(np.pi * phase / 0.6), 0), FS)
    assert np.nanmedian(found["f0"]) == pytest.approx(100, rel=0.02)
    assert 0.2 < np.nanmedian(found["OQ"]) < 0.8


def test_auditory_model():
    m = hearing.AuditoryModel()
    _, z = m.zgram(tone(1000) * 0.5, FS)
    assert hearing.hertz(m.bands[z.mean(0).argmax()]) == pytest.approx(1000, rel=0.08)
    for g in (m.sharpgram(z), m.blurgram(z)):
        assert g.min() == 0 and g.max() == pytest.approx(1)
    assert m.sharp_kernel().sum() == pytest.approx(1) and len(m.blur_kernel()) % 2 == 1
    assert m.tgram(z).shape == z.shape


def test_stimuli():
    x = vowel()
    y = hearing.add_noise(x, FS, "pink", 10)
    assert len(y) == len(x) + FS and np.abs(y).max() == pytest.approx(10 ** (-2 / 20))
    with pytest.raises(ValueError):
        hearing.add_noise(x, FS, "purple")
    assert (hearing.sign_flip_noise(x, FS, 1.0) == -x).all() and (hearing.sign_flip_noise(x, FS, 0.0) == x).all()
    assert hearing.vocode(x, FS, [(100, 500), (500, 2000)])[0].std() > 0
    s = hearing.sine_synth(np.arange(100) * 0.01, np.arange(100.0), np.tile([500.0, 1500, 2500, 3500], (100, 1)), FS)
    assert np.abs(np.fft.rfft(s)).argmax() * FS / len(s) in (500, 1500, 2500, 3500)


@pytest.mark.parametrize("n", [1, 2, 3, 8, 9, 100])
def test_dct_is_its_definition(n):
    x, k = np.random.default_rng(n).normal(size=n), np.arange(n)
    basis = np.cos(np.pi * k[:, None] * (k[None, :] + 0.5) / n) * np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n))[:, None]
    assert np.allclose(spectra.dct2(x), basis @ x) and np.allclose(spectra.dct2(x, True), basis.T @ x)


def test_parts_change_nothing(monkeypatch):
    whole = [f(vowel(), FS) for f in (voice.f0_residual, voice.f0_autocorrelation, voice.f0_spectral, voice.formants_lpc)]
    monkeypatch.setattr(spectra, "PART", 5000)
    for f, want in zip((voice.f0_residual, voice.f0_autocorrelation, voice.f0_spectral, voice.formants_lpc), whole):
        got = f(vowel(), FS)
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], equal_nan=True) for k in want)


def test_smoothn_and_peak_rms():
    y = np.sin(np.arange(200) / 20)
    noisy = y + np.random.default_rng(0).normal(0, 0.2, 200)
    noisy[50] = np.nan
    assert np.abs(spectra.smoothn(noisy, 50) - y).mean() < 0.1
    assert spectra.peak_rms(np.ones(9000)) == pytest.approx(1)
    assert spectra.mfcc(vowel(), FS, 12)[1].shape[1] == 13


def brute_harmonics(peaks):
    """The published cost, numbering by numbering and peak by peak."""
    best, cost = np.nan, 5.0
    for start in range(3):
        for first in (1, 2):
            base = peaks[start] / first
            found, reached = [base], first
            for f in peaks[start + 1 :]:
                ways = [(abs(f / k - base), k) for k in range(reached + 1, 7)]
                if ways and min(ways)[0] < 0.05 * base:
                    found.append(f / min(ways)[1])
                    reached += 1
            c = (reached - 1 + len(peaks)) / len(found)
            if c < cost:
                best, cost = np.mean(found), c
    return best, cost


def test_harmonic_fits_are_brute_force():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(200):
        f0 = rng.uniform(70, 300)
        p = f0 * np.arange(1, rng.integers(7, 12)) * rng.normal(1, 0.01, 1)
        p = np.sort(np.concatenate([p[rng.random(len(p)) < 0.9], rng.uniform(70, 2000, rng.integers(0, 4))]))
        if len(p) > 5:
            rows.append(p)
    padded = np.full((len(rows), max(map(len, rows))), np.nan)
    for i, p in enumerate(rows):
        padded[i, : len(p)] = p
    got = voice.harmonic_fits(padded, np.array(list(map(len, rows))))
    np.testing.assert_allclose(np.stack(got, 1), [brute_harmonics(p) for p in rows])


def test_frame_peaks_are_those_of_each_frame():
    rng = np.random.default_rng(0)
    for trial in range(60):
        s = rng.standard_normal((5, 60)).cumsum(1) if trial % 2 else np.round(rng.standard_normal((5, 60)) * 2)
        distance, prominence, wlen, height = rng.integers(1, 9), rng.random() * 2, rng.integers(3, 20), rng.standard_normal(5)
        row, at = spectra.frame_peaks(s, height, distance, prominence, wlen)
        for i in range(5):
            assert at[row == i].tolist() == spectra.find_peaks(s[i], height[i], distance, prominence, wlen).tolist()


def test_harmonic_summation_is_that_of_the_whole_spectrum():
    y = vowel()[: FS // 4]
    got = voice.f0_harmonics(y, FS, (60, 400))
    x, fs = filters.prepare(y, FS, 12000)
    f = spectra.frames(voice.emphasised(x, 0.94), 1200, 120)
    cand = np.arange(60, 400)
    for i, frame in enumerate(f):
        r = voice.residual(frame[None], voice.burg(frame[None] * np.hamming(1200), 14))[0] * np.hamming(1200)
        s = np.abs(np.fft.rfft(r, 1 << 16))
        s /= np.sqrt((s**2).sum() * 1200 / (1 << 16))
        at = lambda k: s[np.rint(cand * k * (1 << 16) / fs).astype(int)]
        score = at(1) + sum(at(k) - at(k - 0.5) for k in range(2, 7))
        assert got["f0"][i] == cand[(score >= 0.85 * score.max()).argmax()]
        assert got["c"][i] == pytest.approx(score[int(got["f0"][i]) - 60] / 6, rel=1e-9)


def brute_half_periods(y, fs, number, kind):
    """The mean of half periods (of the first formant) or periods in a window that narrows, sample by sample, first loop."""
    y = y - y.mean()
    f = min(max(np.arccos(np.clip((y[1:] * y[:-1]).sum() / (y * y).sum(), -1, 1)) * fs / 2 / np.pi, 200), 6000)
    marks = [0.0]
    for i in range(len(y) - 1):
        if y[i] * y[i + 1] < 0 or (y[i] != 0 and y[i + 1] == 0):
            marks.append(i + abs(y[i]) / (abs(y[i]) + abs(y[i + 1])))
    half = [b - a for a, b in zip(marks, marks[1:])][:-1]
    hz = [fs / 2 / h for h in half] if number == 1 else [fs / (a + b) for a, b in zip(half, half[1:])]
    sides = []
    for side in ("near", "below"):
        low, high = kind[side]
        slope, base = ((high - low) / 1000, low) if number == 1 else (3600 / 4300, 400) if number < 4 else (0.83721, 400)
        sides.append((slope, base - 200 * slope))
    narrowing = True
    for k in range(3):
        up, down = (f * a + b for a, b in sides)
        if narrowing:
            up, down = up * (1 - 0.25 * k), down * (1 - 0.25 * k)
            narrowing = up > 100 and down > 100
        w = [max(0, 1 - ((h - f) / up if h >= f else (f - h) / down)) for h in hz]
        if sum(w) > 0:
            f = sum(a * b for a, b in zip(w, hz)) / sum(w)
    return min(max(f, 200), 6000)


@pytest.mark.parametrize("number", [1, 2, 4])
def test_half_period_frequency_is_brute_force(number):
    rng = np.random.default_rng(1)
    y = np.sin(2 * np.pi * rng.uniform(300, 3000, (20, 1)) * np.arange(240) / 12000) + 0.4 * rng.standard_normal((20, 240))
    for kind in voice.SPEAKERS:
        got = voice.half_period_frequency(y, 12000, 0, number, np.zeros(20), kind)
        np.testing.assert_allclose(got, [brute_half_periods(r, 12000, number, kind) for r in y], rtol=1e-9)


@pytest.mark.parametrize("n", [64, 441])
def test_tapers_are_eigenvectors_of_the_band_limiting_kernel(n):
    tapers, share = spectra.slepian(n)
    d = np.subtract.outer(np.arange(n), np.arange(n))
    kernel = 8 / n * np.sinc(8 / n * d)  # energy within 4 / n of 0
    np.testing.assert_allclose(tapers @ kernel, share[:, None] * tapers, atol=1e-8)
    np.testing.assert_allclose(tapers @ tapers.T, np.eye(len(tapers)), atol=1e-9)
    assert (share > 0.9).all() and len(share) >= 6


@pytest.mark.parametrize("kind", ["sine", "square", "triangle", "sawtooth", "trapezium", "exp", "noise", "whitenoise", "tpdfnoise", "pinknoise", "brownnoise", "pluck"])
def test_noises_mix_by_peak_levels(kind):
    x = np.sin(np.arange(4000) / 9)
    rng = np.random.default_rng(0)
    out = hearing.mix_with_noise(x, 8000, kind, -200, -1, rng)
    np.testing.assert_allclose(out, x / np.abs(x).max() * 10 ** -0.05, atol=1e-9)
    other = hearing.noise_like(kind, 4000, 8000, np.random.default_rng(1))
    loud = hearing.mix_with_noise(x, 8000, kind, 40, 0, np.random.default_rng(1))
    assert np.abs(loud).max() == pytest.approx(1) and np.corrcoef(loud, other)[0, 1] > 0.99
    if kind in ("sine", "square", "triangle", "sawtooth", "trapezium", "exp"):
        assert np.abs(other).max() <= 1 and np.argmax(np.abs(np.fft.rfft(other - other.mean()))) == 220
    with pytest.raises(ValueError):
        hearing.mix_with_noise(x, 8000, np.zeros(10), 0, 0)
