"""Words of whole batches of texts as numpy arrays: places and hashes without a Python loop over words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
LOWER_BYTES = LOWER.tobytes()
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[name]) < n:
        table = np.full(max(n, 1 << 20), base, np.uint64)
        table[0] = 1
        _powers[name] = np.multiply.accumulate(table)
    return _powers[name][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """``first[i]:first[i + 1]`` are text i's words; ``start``/``end`` are byte places in the batch."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans that depend on their content alone."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, n), out=sums[1:])
    return mixed((sums[end] - sums[start]) * _power("down", _BACK, n + 1)[start] + (end - start).astype(np.uint64))


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, separator: np.ndarray = SEPARATOR) -> Words:
    """Runs of bytes outside ``separator`` (by default space and tab to carriage return), never across texts."""
    solid = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(start, end, np.searchsorted(start, offsets), span_hashes(LOWER[data] if lower else data, start, end))


def chained(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive entries; the result is n - 1 shorter."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[i : len(h) - n + 1 + i]
    return mixed(out)


def sums_by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each text's entries (0 for a text without any)."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
