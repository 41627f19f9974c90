"""Hashes of sliding windows and the anchor (least gram hash) of each window."""

from __future__ import annotations

import numpy as np

PRIME = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every window of ``width`` consecutive values, by doubling."""
    size = len(values) - width + 1
    if size < 1:
        return np.zeros(0, np.uint64)
    out, done, step, power = np.zeros(size, np.uint64), 0, 1, values.astype(np.uint64)
    rest, factor = width, PRIME
    while rest:
        # ``power`` has the hashes of windows of ``step`` values; the bits of the width say which ones to chain.
        if rest & 1:
            out = mixed(out * factor + power[done:done + size])
            done += step
        rest >>= 1
        if rest:
            power = mixed(power[:-step] * PRIME + power[step:] + np.uint64(step))
            step *= 2
    return out


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values, by doubling."""
    step, out = 1, values
    while step * 2 <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    size = len(values) - width + 1
    return np.minimum(out[:size], out[width - step:width - step + size]) if size > 0 else values[:0]


def anchors(values: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For every window of ``window`` values the least hash of its grams: equal windows have equal anchors."""
    return sliding_minimum(window_hashes(values, gram), window - gram + 1)
