"""Numeric helpers for the lifetime-value fits."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_SHIFT = 8


def lgamma(x) -> np.ndarray:
    """log Gamma for positive arguments: Stirling's series after shifting the argument up by 8."""
    x = np.asarray(x, float)
    product = np.ones_like(x)
    for i in range(_SHIFT):
        product = product * (x + i)
    y = x + _SHIFT
    s = 1 / (y * y)
    series = (1 / 12 - s * (1 / 360 - s * (1 / 1260 - s * (1 / 1680 - s / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(product)


def digamma(x) -> np.ndarray:
    """First derivative of log Gamma for positive arguments."""
    x = np.asarray(x, float)
    y = x + _SHIFT
    s = 1 / (y * y)
    series = s * (1 / 12 - s * (1 / 120 - s * (1 / 252 - s * (1 / 240 - s / 132))))
    return np.log(y) - 0.5 / y - series - sum(1 / (x + i) for i in range(_SHIFT))


def trigamma(x) -> np.ndarray:
    """Second derivative of log Gamma for positive arguments."""
    x = np.asarray(x, float)
    y = x + _SHIFT
    s = 1 / (y * y)
    series = (1 / 6 - s * (1 / 30 - s * (1 / 42 - s * (1 / 30 - s * 5 / 66)))) * s / y
    return 1 / y + s / 2 + series + sum(1 / (x + i) ** 2 for i in range(_SHIFT))


def hyp2f1(a, b, c, z, max_terms: int = 100_000) -> np.ndarray:
    """Gauss hypergeometric function for 0 <= z < 1, by Euler's transformation: its parameters c-a and c-b stay small
    where a, b and c grow together."""
    a, b, c, z = np.broadcast_arrays(*[np.asarray(v, float) for v in (a, b, c, z)])
    p, q = c - a, c - b
    term, total = np.ones_like(z), np.ones_like(z)
    for n in range(max_terms):
        term = term * (p + n) * (q + n) / ((c + n) * (n + 1)) * z
        total = total + term
        if np.all(np.abs(term) <= 1e-16 * np.abs(total) * (1 - z)):
            break
    else:
        raise ArithmeticError(f"the series has not converged after {max_terms} terms")
    return (1 - z) ** (c - a - b) * total


def minimize(losses: Callable[[np.ndarray], np.ndarray], start: np.ndarray, h: float = 1e-3, tol: float = 1e-10,
             max_iter: int = 100) -> np.ndarray:
    """Newton's method on central differences. ``losses`` values many points in one call: the whole difference
    stencil, then all trial steps along the direction."""
    at, d = np.asarray(start, float), len(start)
    unit = np.eye(d) * h
    pairs = [(i, j) for i in range(d) for j in range(i)]
    for _ in range(max_iter):
        moves = [np.zeros(d), *unit, *-unit, *[unit[i] + unit[j] for i, j in pairs],
                 *[-unit[i] - unit[j] for i, j in pairs]]
        f = losses(at + np.array(moves))
        up, down = f[1:d + 1], f[d + 1:2 * d + 1]
        gradient = (up - down) / (2 * h)
        hessian = np.diag((up - 2 * f[0] + down) / h ** 2)
        both = f[2 * d + 1:]
        for k, (i, j) in enumerate(pairs):
            mixed = (both[k] + both[k + len(pairs)] + 2 * f[0] - up[i] - up[j] - down[i] - down[j]) / (2 * h ** 2)
            hessian[i, j] = hessian[j, i] = mixed
        scale, axes = np.linalg.eigh(hessian)
        step = -axes @ ((axes.T @ gradient) / np.maximum(np.abs(scale), 1e-8))
        step *= min(1.0, 4.0 / max(np.linalg.norm(step), 1e-300))
        lengths = np.array([1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 0.001])
        trial = losses(at + lengths[:, None] * step)
        best = int(np.nanargmin(trial))
        if not trial[best] < f[0]:
            break
        at = at + lengths[best] * step
        if f[0] - trial[best] < tol * max(1.0, abs(f[0])):
            break
    else:
        raise ArithmeticError(f"no minimum after {max_iter} steps")
    return at


Slopes = tuple[float, np.ndarray, np.ndarray]
#: Parts of a step to try, in one call, when the whole step does not lower the loss.
SHORTER = np.array([0.5, 0.25, 0.1, 0.03, 0.01, 0.001])


def newton(slopes: Callable[[np.ndarray], Slopes], losses: Callable[[np.ndarray], np.ndarray], start: np.ndarray,
           tol: float = 1e-10, max_iter: int = 100) -> np.ndarray:
    """Newton's method: ``slopes`` gives loss, gradient and Hessian at a point, one call per step; ``losses`` values several
    points and is called only where a whole step does not lower the loss."""
    at = np.asarray(start, float)
    f, gradient, hessian = slopes(at)
    for _ in range(max_iter):
        scale, axes = np.linalg.eigh(hessian)
        step = -axes @ ((axes.T @ gradient) / np.maximum(np.abs(scale), 1e-8))
        step *= min(1.0, 4.0 / max(np.linalg.norm(step), 1e-300))
        ahead = slopes(at + step)
        if not ahead[0] < f:
            values = losses(at + SHORTER[:, None] * step)
            if not np.nanmin(values) < f:
                return at
            step = step * SHORTER[int(np.nanargmin(values))]
            ahead = slopes(at + step)
        at, gained = at + step, f - ahead[0]
        f, gradient, hessian = ahead
        if gained < tol * max(1.0, abs(f)):
            return at
    raise ArithmeticError(f"no minimum after {max_iter} steps")
