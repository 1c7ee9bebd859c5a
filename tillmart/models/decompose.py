"""Robust STL for one evenly spaced series (Cleveland, Cleveland, McRae and Terpenning, 1990)."""

from __future__ import annotations

import math

import numpy as np

SEASONAL_SPAN, INNER, OUTER = 7, 2, 15


def loess(y: np.ndarray, span: int, at: np.ndarray, robust: np.ndarray) -> np.ndarray:
    """Local linear fit of ``y`` (at 0, 1, ...) at the positions ``at``, with tricube times robustness weights."""
    n = len(y)
    width = min(span, n)
    left = np.clip(at.astype(int) - (span + 1) // 2 + 1, 0, n - width)
    near = left[:, None] + np.arange(width)
    reach = np.maximum(at - left, left + width - 1 - at) + max(0, (span - n) // 2)
    distance = np.abs(near - at[:, None]) / np.maximum(reach, 1e-12)[:, None]
    w = np.where(distance <= 0.999, (1 - np.where(distance <= 0.001, 0, distance) ** 3) ** 3, 0.0) * robust[near]
    total = w.sum(axis=1)
    dead = total <= 0
    w = np.where(dead[:, None], 1.0 / width, w / np.where(dead, 1, total)[:, None])
    center = (w * near).sum(axis=1)
    spread = (w * (near - center[:, None]) ** 2).sum(axis=1)
    sloped = np.sqrt(spread) > 0.001 * (n - 1)
    slope = np.where(sloped, (at - center) / np.where(sloped, spread, 1), 0.0)
    return (w * (1 + slope[:, None] * (near - center[:, None])) * y[near]).sum(axis=1)


def _moving_average(y: np.ndarray, span: int) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(y)])
    return (total[span:] - total[:-span]) / span


def decompose(y: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """(trend, seasonal). A series shorter than two periods has its mean as trend and no seasonal part."""
    n = len(y)
    if n < 2 * period:
        return np.full(n, y.mean() if n else 0.0), np.zeros(n)
    low_span = period + 1
    low_span += 1 - low_span % 2
    trend_span = math.ceil(1.5 * period / (1 - 1.5 / SEASONAL_SPAN))
    trend_span += 1 - trend_span % 2
    days = np.arange(n, dtype=float)
    robust, trend, seasonal = np.ones(n), np.zeros(n), np.zeros(n)
    for _ in range(OUTER + 1):
        for _ in range(INNER):
            cycle = np.zeros(n + 2 * period)
            detrended = y - trend
            for phase in range(period):  # each weekday, smoothed and extended by one cycle at both ends
                sub = detrended[phase::period]
                ends = np.arange(-1, len(sub) + 1, dtype=float)
                cycle[phase::period] = loess(sub, SEASONAL_SPAN, ends, robust[phase::period])
            low = _moving_average(_moving_average(_moving_average(cycle, period), period), 3)
            seasonal = cycle[period:period + n] - loess(low, low_span, days, np.ones(n))
            trend = loess(y - seasonal, trend_span, days, robust)
        residual = np.abs(y - trend - seasonal)
        limit = 6 * np.median(residual)
        if limit <= 0:
            break
        u = residual / limit
        robust = np.where(u <= 0.001, 1.0, np.where(u <= 0.999, (1 - np.minimum(u, 1) ** 2) ** 2, 0.0))
    return trend, seasonal
