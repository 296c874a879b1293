"""Scores of whole signals on numpy arrays; intelligibility after Taal et al. (2011) and Jensen and Taal (2016)."""

from __future__ import annotations

import numpy as np

from .spectral import resample

EPS = 1e-10


def aligned(ref: np.ndarray, est: np.ndarray, most: int = 256) -> tuple[np.ndarray, np.ndarray]:
    if abs(len(ref) - len(est)) > most:
        raise ValueError(f"lengths differ by {abs(len(ref) - len(est))}, more than {most}")
    n = min(len(ref), len(est))
    return np.asarray(ref[:n], float), np.asarray(est[:n], float)


def si_sdr(ref: np.ndarray, est: np.ndarray) -> float:
    r, e = aligned(ref, est)
    r, e = r - r.mean(), e - e.mean()
    target = (e @ r) / (r @ r + EPS) * r
    rest = e - target
    return float(10 * np.log10((target @ target + EPS) / (rest @ rest + EPS)))


def sdr(ref: np.ndarray, est: np.ndarray) -> float:
    r, e = aligned(ref, est)
    return float(10 * np.log10((r @ r + EPS) / ((e - r) @ (e - r) + EPS)))


def seg_snr(ref: np.ndarray, est: np.ndarray, frame: int = 512, hop: int = 256, low: float = -10.0, high: float = 35.0) -> float:
    """Mean of the clipped ratios of the frames that are not silent; a signal shorter than a frame is one frame."""
    r, e = aligned(ref, est)
    if not len(r):
        return float("nan")
    cut = lambda x: np.lib.stride_tricks.sliding_window_view(x, min(frame, len(x)))[::hop]
    s, d = (cut(r) ** 2).sum(axis=1), ((cut(r) - cut(e)) ** 2).sum(axis=1) + EPS
    live = s >= (r**2).mean() * 1e-4
    with np.errstate(divide="ignore"):
        return float(np.clip(10 * np.log10(s[live] / d[live]), low, high).mean()) if live.any() else float("nan")


def _bands(sr: int = 10_000, size: int = 512, count: int = 15, lowest: float = 150.0) -> np.ndarray:
    """Third-octave bands as rows of 0 and 1 over the lines of a spectrum."""
    hz = np.linspace(0, sr, size + 1)[: size // 2 + 1]
    out = np.zeros((count, len(hz)))
    for k in range(count):
        a, b = (int(np.argmin(np.abs(hz - lowest * 2 ** ((2 * k + d) / 6)))) for d in (-1, 1))
        out[k, a:b] = 1
    return out


def _voiced(ref: np.ndarray, est: np.ndarray, frame: int = 256, hop: int = 128, range_db: float = 40.0) -> tuple[np.ndarray, np.ndarray]:
    """Both signals without the frames in which the reference is silent."""
    w = np.hanning(frame + 2)[1:-1]
    cut = lambda x: np.lib.stride_tricks.sliding_window_view(x, frame)[::hop] * w
    r, e = cut(ref), cut(est)
    level = 20 * np.log10(np.linalg.norm(r, axis=1) + np.finfo(float).eps)
    keep = level > level.max() - range_db
    out = []
    for x in (r[keep], e[keep]):
        y = np.zeros((len(x) - 1) * hop + frame if len(x) else 0)
        for t, f in enumerate(x):
            y[t * hop : t * hop + frame] += f
        out.append(y)
    return out[0], out[1]


def stoi(ref: np.ndarray, est: np.ndarray, sr: int = 16_000, extended: bool = False, span: int = 30, lowest_sdr: float = -15.0) -> float:
    """Short-time objective intelligibility; 1e-5 for signals too short for one span."""
    r, e = aligned(ref, est)
    r, e = _voiced(resample(r, sr, 10_000), resample(e, sr, 10_000))
    w = np.hanning(258)[1:-1]
    if len(r) < 256:
        return 1e-5
    spec = lambda x: np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(x, 256)[::128] * w, 512, axis=1)) ** 2
    bands = _bands()
    x, y = (np.sqrt(spec(v) @ bands.T).T for v in (r, e))
    if x.shape[1] < span:
        return 1e-5
    xs, ys = (np.lib.stride_tricks.sliding_window_view(v, span, axis=1).transpose(1, 0, 2) for v in (x, y))
    tiny = np.finfo(float).eps
    unit = lambda v, axis: (d := v - v.mean(axis=axis, keepdims=True)) / (np.linalg.norm(d, axis=axis, keepdims=True) + tiny)
    if extended:
        return float((unit(unit(xs, 2), 1) * unit(unit(ys, 2), 1)).sum(axis=1).mean())
    scaled = ys * np.linalg.norm(xs, axis=2, keepdims=True) / (np.linalg.norm(ys, axis=2, keepdims=True) + tiny)
    limited = np.minimum(scaled, xs * (1 + 10 ** (-lowest_sdr / 20)))
    return float((unit(xs, 2) * unit(limited, 2)).sum(axis=2).mean())


def decay_time(h: np.ndarray, sr: int = 16_000, low: float = -5.0, high: float = -35.0) -> float:
    """T60 from the slope of the energy decay between two levels; NaN where it cannot be told."""
    h = h[int(np.argmax(np.abs(h))) :]
    rest = np.cumsum(h[::-1] ** 2)[::-1]
    if not len(rest) or rest[0] <= 0:
        return float("nan")
    level = 10 * np.log10(np.maximum(rest / rest[0], 1e-20))
    a, b = (int(np.argmax(level <= x)) if (level <= x).any() else -1 for x in (low, high))
    if a < 0 or b < 0 or b - a < 2:
        return float("nan")
    slope = np.polyfit(np.arange(a, b) / sr, level[a:b], 1)[0]
    return float("nan") if slope >= -1e-9 else float(-60 / slope)
