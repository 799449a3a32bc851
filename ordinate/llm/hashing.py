"""Hashed character n-grams of whole texts, by array operations."""

from __future__ import annotations

import numpy as np

MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)


def letters() -> np.ndarray:
    """For each code point, whether it is a letter; made once in a task."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def spaced(text: str, is_letter: np.ndarray) -> np.ndarray:
    """Code points of the lower-cased text, with one space for each run of others than letters and at both ends."""
    a = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    keep = is_letter[a]
    a = np.where(keep, a, 32)
    first = np.empty(len(a), bool)
    first[0] = True
    first[1:] = keep[1:] | keep[:-1]
    return a[first]


def ngrams(a: np.ndarray, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """Buckets of all n-grams of these sizes, repeats included."""
    h, out = a.astype(np.uint64), []
    base = h
    for size in range(1, max(sizes) + 1):
        if size > 1:
            if len(base) < size:
                break
            h = h[:-1] * STEP + base[size - 1 :]
        if size in sizes:
            out.append(((h + np.uint64(size)) * MIX) >> np.uint64(64 - bits))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def fit_logistic(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, scale: np.ndarray, values: list[np.ndarray] | None = None, l2: float = 1e-3, steps: int = 300, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model over sparse rows (feature numbers), whose features count ``scale`` each, times ``values`` where given.

    ``y`` may hold probabilities.  Adam with a fixed number of full steps, so that equal inputs give equal models.
    """
    index = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    value = scale[index] if values is None else scale[index] * np.concatenate([*values, np.zeros(0)])
    n, m = len(rows), len(scale)
    w, b = np.zeros(m + 1), 0.0
    first, second = np.zeros(m + 1), np.zeros(m + 1)
    weight = weight / max(weight.sum(), 1e-12)
    for step in range(1, steps + 1):
        z = np.bincount(owner, w[index] * value, n) + w[m]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        g = np.empty(m + 1)
        g[:m] = np.bincount(index, error[owner] * value, m) + l2 * w[:m] / max(n, 1)
        g[m] = error.sum()
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    b = float(w[m])
    return w[:m], b
