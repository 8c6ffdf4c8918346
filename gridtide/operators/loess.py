"""Local line smoothing and one seasonal-trend inner loop on a NumPy array.

Small helper for the chunked decomposition jobs, after Cleveland et al. (1990).
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 21  # weights held at once
FFT_WINDOW = 256


def _weights(target, left, width, span, robust, total):
    """Local-line weights of each target position over ``left .. left + width - 1``.

    The fit is flat where the points spread little against ``total``, the length of the whole series.
    """
    at = left[:, None] + np.arange(width)[None, :]
    away = np.abs(at - target[:, None])
    w = (1.0 - np.minimum(away / np.maximum(span, 1e-300)[:, None], 1.0) ** 3) ** 3
    w[away <= 0.001 * span[:, None]] = 1.0
    w[away > 0.999 * span[:, None]] = 0.0
    if robust is not None:
        w = w * robust[at]
    mass = w.sum(axis=1)
    usable = mass > 0
    w = w / np.where(usable, mass, 1.0)[:, None]
    centre = (w * at).sum(axis=1)
    spread = (w * (at - centre[:, None]) ** 2).sum(axis=1)
    tilts = np.sqrt(spread) > 0.001 * (total - 1)
    slope = np.where(tilts, (target - centre) / np.where(tilts, spread, 1.0), 0.0)
    return at, w * (1.0 + slope[:, None] * (at - centre[:, None])), usable


def smooth_at(y, window, target, robust=None, total=None):
    """Local-line fit at the given positions (may lie one step outside the data).

    ``total`` is the length of the whole series when ``y`` is a chunk of it.
    """
    n = len(y)
    total = n if total is None else total
    width = min(window, n)
    inside = np.clip(target, 0, n - 1).astype(int)
    left = np.clip(inside - (width - 1) // 2, 0, n - width)
    span = np.maximum(target - left, left + width - 1 - target).astype(float)
    if window > n:
        span = span + (window - n) // 2
    out = np.empty(len(target))
    ok = np.empty(len(target), dtype=bool)
    rows = max(1, BLOCK // width)
    for a in range(0, len(target), rows):
        part = slice(a, a + rows)
        at, w, usable = _weights(target[part], left[part], width, span[part], robust, total)
        out[part] = (w * y[at]).sum(axis=1)
        ok[part] = usable
    return out, ok


def _weighted_runs(y, w):
    """Weighted sums over every run of ``len(w)`` values; long windows go through the FFT."""
    if len(w) <= FFT_WINDOW:
        return np.convolve(y, w[::-1], mode="valid")
    size = 1 << int(np.ceil(np.log2(len(y) + len(w) - 1)))
    full = np.fft.irfft(np.fft.rfft(y, size) * np.fft.rfft(w[::-1], size), size)
    return full[len(w) - 1 : len(y)]


def smooth(y, window, robust=None, total=None):
    """Local-line smoothing at every position; interior weights are shared when not robust."""
    n = len(y)
    total = n if total is None else total
    if n == 1:
        return y.copy()
    half = (window - 1) // 2
    if robust is None and n > 2 * window:
        target = np.array([half])
        _, w, _ = _weights(target, np.array([0]), window, np.array([float(half)]), None, total)
        middle = _weighted_runs(y, w[0])
        edge = np.concatenate([np.arange(half), np.arange(n - half, n)])
        ends, _ = smooth_at(y, window, edge, None, total)
        return np.concatenate([ends[:half], middle, ends[half:]])
    fit, ok = smooth_at(y, window, np.arange(n), robust, total)
    return np.where(ok, fit, y)


def _running_mean(y, k):
    total = np.concatenate([[0.0], np.cumsum(y)])
    return (total[k:] - total[:-k]) / k


def _smooth_phase(y, window, robust, total):
    """Smoothed values with one extrapolated point at each end."""
    n = len(y)
    ends, ok = smooth_at(y, window, np.array([-1, n]), robust, total)
    body = smooth(y, window, robust, total)
    first = ends[0] if ok[0] else body[0]
    last = ends[1] if ok[1] else body[-1]
    return np.concatenate([[first], body, [last]])


def inner_loop(y, period, seasonal, trend_window, low_window, rounds, trend, robust=None, total=None, start=0):
    """``rounds`` passes of seasonal and trend smoothing; returns (seasonal, trend).

    A chunk gives the length ``total`` of its whole series and its own ``start`` in it, so that
    every fit tilts as it would there.
    """
    n = len(y)
    total = n if total is None else total
    season = np.zeros(n)
    for _ in range(rounds):
        detrended = y - trend
        cycle = np.empty(n + 2 * period)
        for phase in range(period):
            weights = None if robust is None else robust[phase::period]
            cycles = -(-(total - (start + phase) % period) // period)  # of this phase in the whole series
            cycle[phase::period] = _smooth_phase(detrended[phase::period], seasonal, weights, cycles)
        low = _running_mean(_running_mean(_running_mean(cycle, period), period), 3)
        season = cycle[period : period + n] - smooth(low, low_window, None, total)
        trend = smooth(y - season, trend_window, robust, total)
    return season, trend


def bisquare(residual_size, median):
    """Robustness weights from absolute residuals and their median."""
    reach = 6.0 * median
    share = residual_size / reach if reach > 0 else np.zeros(len(residual_size))
    w = (1.0 - np.minimum(share, 1.0) ** 2) ** 2
    w[share <= 0.001] = 1.0
    w[share > 0.999] = 0.0
    return w
