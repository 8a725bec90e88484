"""Linear models over hashed character n-grams: the slots of a text and a logistic fit."""

from __future__ import annotations

import numpy as np

_STEP, _SPREAD = np.uint32(16777619), np.uint32(2654435769)


def slots(text: str | None, low: int, high: int, bits: int) -> np.ndarray:
    """Slot numbers of all n-grams of low..high UTF-8 bytes, A-Z lower-cased, one for each place."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8).astype(np.uint32)
    out, h = [], data + np.uint32(1)
    for n in range(2, high + 1):
        if len(data) < n:
            break
        h = h[:-1] * _STEP + data[n - 1:] + np.uint32(1)
        if n >= low:
            out.append((h * _SPREAD) >> np.uint32(32 - bits))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, n_features: int,
                 weight: np.ndarray | None = None, l2: float = 1.0, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-regularised logistic regression over sparse (row, col, value) entries.

    Accelerated gradient descent with a step per feature; the same input gives the same model.
    """
    n = len(y)
    weight = np.ones(n) if weight is None else weight
    curvature = np.bincount(cols, weights=values ** 2 * weight[rows], minlength=n_features) / 4
    width = np.bincount(rows, minlength=n).max(initial=1)
    step = 1 / (curvature * min(width, 40) + l2)
    bias_step = 1 / (weight.sum() / 4 * 2 + 1e-9)
    w = v = np.zeros(n_features)
    p = min(max((y * weight).sum() / max(weight.sum(), 1e-9), 1e-3), 1 - 1e-3)
    b = c = float(np.log(p / (1 - p)))
    for k in range(rounds):
        z = np.bincount(rows, weights=values * v[cols], minlength=n) + c
        gap = (sigmoid(z) - y) * weight
        w_next = v - step * (np.bincount(cols, weights=values * gap[rows], minlength=n_features) + l2 * v)
        b_next = c - bias_step * gap.sum()
        pace = k / (k + 3)
        v, c = w_next + pace * (w_next - w), b_next + pace * (b_next - b)
        w, b = w_next, b_next
    return w, float(b)
