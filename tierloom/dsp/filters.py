"""Resampling, Butterworth filters and zero-phase filtering in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def resample_fft(y: np.ndarray, n: int) -> np.ndarray:
    """n samples over the same time, by cutting or padding the spectrum."""
    if n == len(y) or not len(y) or n <= 0:
        return np.asarray(y, float)[: max(n, 0)].copy()
    spec = np.fft.rfft(y)
    out = np.zeros(n // 2 + 1, complex)
    keep = min(len(spec), len(out))
    out[:keep] = spec[:keep]
    half = min(n, len(y))
    if half % 2 == 0:
        out[half // 2] *= 0.5 if n > len(y) else 2.0 if n < len(y) and half // 2 < len(spec) - 1 else 1.0
        if n < len(y):
            out[half // 2] = out[half // 2].real
    return np.fft.irfft(out, n) * (n / len(y))


@lru_cache(maxsize=256)
def butterworth(order: int, cut: tuple[float, ...], fs: float, kind: str = "low") -> np.ndarray:
    """Second-order sections (b0 b1 b2 1 a1 a2) of a digital Butterworth filter: low, high or band (two cuts)."""
    edges = 2 * fs * np.tan(np.pi * np.asarray(cut, float) / fs)
    k = np.arange(order)
    proto = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))
    if kind == "low":
        poles, zeros = proto * edges[0], []
    elif kind == "high":
        poles, zeros = edges[0] / proto, [0.0] * order
    else:
        width, centre = edges[1] - edges[0], np.sqrt(edges[0] * edges[1])
        half = proto * width / 2
        root = np.sqrt(half**2 - centre**2 + 0j)
        poles, zeros = np.concatenate([half + root, half - root]), [0.0] * order
    zp = (2 * fs + poles) / (2 * fs - poles)
    zz = np.concatenate([(2 * fs + np.asarray(zeros, complex)) / (2 * fs - np.asarray(zeros, complex)), -np.ones(len(poles) - len(zeros))])
    # pairs of conjugate poles; real poles are paired with each other, or stand alone
    upper = sorted(zp[zp.imag > 1e-12], key=lambda p: abs(1 - abs(p)), reverse=True)
    real = sorted(zp[np.abs(zp.imag) <= 1e-12].real)
    groups = [(p, p.conjugate()) for p in upper] + [tuple(real[i : i + 2]) for i in range(0, len(real), 2)]
    ones, minus = [z for z in zz.real if z > 0], [z for z in zz.real if z <= 0]
    sections = []
    for g in groups:
        z = [(ones if len(ones) > len(minus) or not minus else minus).pop() for _ in g] if len(ones) + len(minus) >= len(g) else []
        b, a = np.real(np.poly(z)) if z else np.array([1.0]), np.real(np.poly(g))
        sections.append(np.concatenate([np.pad(b, (0, 3 - len(b))), np.pad(a, (0, 3 - len(a)))]))
    sos = np.array(sections)
    at = {"low": 0.0, "high": np.pi}.get(kind, 2 * np.arctan(np.sqrt(edges[0] * edges[-1]) / (2 * fs)))
    zi = np.exp(-1j * at * np.arange(3))
    gain = np.prod([(s[:3] @ zi) / (s[3:] @ zi) for s in sos])
    sos[0, :3] /= abs(gain)
    return sos


#: Samples that a section filters by one matrix product.
BLOCK = 32


@lru_cache(maxsize=1024)
def _block(section: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Matrices of BLOCK steps of a section in state-space form: outputs by inputs and by the state, the state after them by inputs and by the state."""
    b0, b1, b2, _, a1, a2 = np.frombuffer(section).tolist()
    a = np.array([[-a1, 1.0], [-a2, 0.0]])
    b = np.array([b1 - a1 * b0, b2 - a2 * b0])
    power = [np.eye(2)]
    for _ in range(BLOCK):
        power.append(a @ power[-1])
    seen = np.array([p[0] for p in power[:BLOCK]])  # the first state is what the output sees
    impulse = np.concatenate([[b0], seen[: BLOCK - 1] @ b])
    lag = np.arange(BLOCK)[:, None] - np.arange(BLOCK)[None, :]
    outputs = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)
    return outputs, seen, np.array([p @ b for p in power[:BLOCK]][::-1]).T, power[BLOCK]


def _section(s: np.ndarray, x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """One second-order section over the last axis, started from the states z (..., 2)."""
    outputs, seen, gather, carry = _block(np.ascontiguousarray(s, float).tobytes())
    n = x.shape[-1]
    full = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(0, -n % BLOCK)]).reshape(*x.shape[:-1], -1, BLOCK)
    # states at the start of each block, by doubling: after step i they hold what the last 2 ** i blocks pushed
    states = np.concatenate([z[..., None, :], (full @ gather.T)[..., :-1, :]], -2)
    step = 1
    while step < states.shape[-2]:
        states[..., step:, :] += states[..., :-step, :] @ carry.T
        step, carry = 2 * step, carry @ carry
    y = full @ outputs.T + states @ seen.T
    return y.reshape(*x.shape[:-1], -1)[..., :n]


def sosfilt(sos: np.ndarray, x: np.ndarray, steady: np.ndarray | None = None) -> np.ndarray:
    """Filter along the last axis; with `steady` from the state that the constant input `steady` would have left."""
    x = np.asarray(x, float)
    level = np.zeros(x.shape[:-1]) if steady is None else np.asarray(steady, float)
    for s in sos:
        out = level * (s[:3].sum() / s[3:].sum())
        z2 = s[2] * level - s[5] * out
        x, level = _section(s, x, np.stack([s[1] * level - s[4] * out + z2, z2], -1)), out
    return x


def filtfilt(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Zero-phase filtering along the last axis, with odd extension at both ends."""
    x = np.asarray(x, float)
    n = x.shape[-1]
    if not n:
        return x
    edge = 3 * (2 * len(sos) + 1 - min((sos[:, 2] == 0).sum(), (sos[:, 5] == 0).sum()))
    edge = int(min(edge, n - 1))
    if edge:
        x = np.concatenate([2 * x[..., :1] - x[..., edge:0:-1], x, 2 * x[..., -1:] - x[..., -2 : -edge - 2 : -1]], -1)
    y = sosfilt(sos, x, x[..., 0])
    y = sosfilt(sos, y[..., ::-1], y[..., -1])[..., ::-1]
    return y[..., edge : edge + n]


def prepare(x: np.ndarray, fs: float, target_fs: float | None = 22050, pre: float = 0.0, scale: bool = True, outtype: str = "float") -> tuple[np.ndarray, float]:
    """Resample, make the larger peak positive, pre-emphasise, scale to a maximum of 0.99."""
    y = np.asarray(x, float)
    if target_fs and target_fs != fs:
        y, fs = resample_fft(y, int(len(y) * target_fs / fs)), target_fs
    if len(y):
        if y.max() + y.min() < 0:
            y = -y
        if pre > 0:
            y = np.concatenate([y[:1], y[1:] - pre * y[:-1]])
        if scale and y.max() > 0:
            y = y / y.max() * 0.99
    if outtype in ("int", "int16"):
        return np.rint(32767 * y).astype(np.int16), fs
    return y, fs


def envelope(x: np.ndarray, fs: float, bounds: tuple[float, float] | None = None, target_fs: float | None = 22050, cutoff: float = 30, order: int = 2, scale: bool = True) -> tuple[np.ndarray, float]:
    """Amplitude envelope: optional band-pass, magnitude, low-pass."""
    y, fs = prepare(x, fs, target_fs, scale=scale)
    if bounds:
        y = filtfilt(butterworth(8, tuple(bounds), fs, "band"), y)
    return filtfilt(butterworth(order, (cutoff,), fs), np.abs(y)), fs


def filterbank(x: np.ndarray, bands: list[tuple[float, float]], fs: float, order: int = 8) -> np.ndarray:
    """Zero-phase band-pass outputs, bands x samples."""
    return np.array([filtfilt(butterworth(order, tuple(b), fs, "band"), x) for b in bands]).reshape(len(bands), len(x))
