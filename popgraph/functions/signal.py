"""Filters, resampling and spectra of one stretch of signal, in NumPy. Each works on an array that one task holds."""

from __future__ import annotations

from fractions import Fraction

import numpy as np


def butter_bandpass(order: int, low: float, high: float, fs: float) -> np.ndarray:
    """Second-order sections (b0 b1 b2 1 a1 a2) of a Butterworth band-pass, by the bilinear transform."""
    warp = 2 * fs * np.tan(np.pi * np.array([low, high]) / fs)
    width, centre = warp[1] - warp[0], np.sqrt(warp[0] * warp[1])
    proto = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    half = proto * width / 2
    root = np.sqrt(half**2 - centre**2)
    s = np.concatenate([half + root, half - root])
    z = (2 * fs + s) / (2 * fs - s)
    gain = np.real(width**order * (2 * fs) ** order / np.prod(2 * fs - s))
    upper = z[z.imag > 0] if np.all(np.abs(z.imag) > 1e-12) else None
    if upper is None or len(upper) * 2 != len(z):
        raise ValueError("the band is too wide for this filter")
    upper = upper[np.argsort(np.abs(np.abs(upper) - 1))[::-1]]
    sections = np.array([[1.0, 0.0, -1.0, 1.0, -2 * p.real, abs(p) ** 2] for p in upper])
    sections[0, :3] *= gain
    return sections


def _run(sections: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Filters x, section by section, from a state of two numbers a section (direct form II transposed)."""
    y = x.astype(float)
    for (b0, b1, b2, _, a1, a2), (z1, z2) in zip(sections, state, strict=True):
        out = np.empty_like(y)
        for k, v in enumerate(y.tolist()):
            w = b0 * v + z1
            z1 = b1 * v - a1 * w + z2
            z2 = b2 * v - a2 * w
            out[k] = w
        y = out
    return y


def _steady(sections: np.ndarray) -> np.ndarray:
    """State after a long constant input of 1."""
    out, scale = [], 1.0
    for b0, b1, b2, _, a1, a2 in sections:
        level = (b0 + b1 + b2) / (1 + a1 + a2)
        z2 = b2 - a2 * level
        out.append((scale * (b1 - a1 * level + z2), scale * z2))
        scale *= level
    return np.array(out)


def zero_phase(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Filters forwards and backwards, over ends that are continued by odd reflection."""
    n = len(sections)
    taps = 2 * n + 1 - min(int((sections[:, 2] == 0).sum()), int((sections[:, 5] == 0).sum()))
    edge = min(3 * taps, len(x) - 1)
    ext = np.concatenate([2 * x[0] - x[edge:0:-1], x, 2 * x[-1] - x[-2 : -edge - 2 : -1]]) if edge > 0 else np.asarray(x, float)
    steady = _steady(sections)
    y = _run(sections, ext, steady * ext[0])
    y = _run(sections, y[::-1], steady * y[-1])[::-1]
    return y[edge : len(y) - edge] if edge > 0 else y


def memory(sections: np.ndarray) -> int:
    """Samples after which what a filter holds has shrunk to 1e-15: the slowest pole's radius to that power."""
    slowest = np.sqrt(np.abs(sections[:, 5]).max())
    return int(np.ceil(np.log(1e-15) / np.log(slowest))) if 0 < slowest < 1 else 0


def ratio(fs: float, to: float) -> tuple[int, int]:
    """(up, down): the nearest ratio to / fs of small integers."""
    found = Fraction(to / fs).limit_denominator(10_000)
    return found.numerator, found.denominator


#: Taps of the resampling filter on each side of its middle, in steps of the slower rate.
RESAMPLE_HALF = 10


def resample(x: np.ndarray, fs: float, to: float) -> np.ndarray:
    """Polyphase resampling by the nearest ratio of small integers, with a Kaiser-windowed low-pass (beta 5)."""
    up, down = ratio(fs, to)
    x = np.asarray(x, float)
    if up == down:
        return x.copy()
    most = max(up, down)
    half = RESAMPLE_HALF * most
    t = np.arange(-half, half + 1)
    h = np.sinc(t / most) * np.kaiser(2 * half + 1, 5.0)
    h *= up / h.sum()
    n = -(-len(x) * up // down)
    out = np.zeros(n)
    at = np.arange(n) * down + half  # place in the full convolution of the up-sampled signal
    for phase in range(up):  # outputs whose taps fall on the same phase
        own = np.flatnonzero(at % up == phase)
        if len(own):
            taps = h[phase::up]
            last = at[own] // up
            k = last[:, None] - np.arange(len(taps))[None, :]
            ok = (k >= 0) & (k < len(x))
            out[own] = (np.where(ok, x[np.clip(k, 0, len(x) - 1)], 0.0) * taps).sum(axis=1)
    return out


def spectrogram(x: np.ndarray, fs: float, window: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frequencies, centre seconds, density) with a periodic Hann window and each stretch less its mean."""
    step = window - overlap
    starts = np.arange(0, len(x) - window + 1, step)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / window)
    parts = x[starts[:, None] + np.arange(window)]
    parts = (parts - parts.mean(axis=1, keepdims=True)) * w
    p = np.abs(np.fft.rfft(parts, axis=1)) ** 2 / (fs * (w**2).sum())
    p[:, 1 : (-1 if window % 2 == 0 else None)] *= 2
    return np.fft.rfftfreq(window, 1 / fs), (starts + window / 2) / fs, p.T


def moving_power(x: np.ndarray, width: int) -> np.ndarray:
    """Mean square over width neighbours; beyond the ends the signal is 0 and still counts."""
    total = np.concatenate([[0.0], np.cumsum(np.square(x))])
    lo = np.arange(len(x)) - width // 2
    return (total[np.minimum(lo + width, len(x))] - total[np.maximum(lo, 0)]) / width
