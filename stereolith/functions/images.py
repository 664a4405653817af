"""Small kernels on images given as arrays."""

from __future__ import annotations

import numpy as np


def shrink(image: np.ndarray, long_side: int = 480) -> np.ndarray:
    """Area average of a grey image to a long side of at most ``long_side``."""
    h, w = image.shape
    scale = max(h, w) / long_side
    if scale <= 1:
        return image.astype(float)

    def axis(a: np.ndarray, n: int) -> np.ndarray:
        edges = np.linspace(0, len(a), n + 1)
        c = np.concatenate([np.zeros((1, a.shape[1])), np.cumsum(a, 0)])
        low = np.minimum(edges.astype(int), len(a) - 1)
        at = c[low] + (edges - low)[:, None] * a[low]
        return np.diff(at, axis=0) / (len(a) / n)

    return axis(axis(image.astype(float), max(1, round(h / scale))).T, max(1, round(w / scale))).T


def laplacian_variance(image: np.ndarray) -> float:
    """Population variance of the 3x3 Laplacian, borders mirrored without the edge pixel."""
    p = np.pad(image.astype(float), 1, mode="reflect" if min(image.shape) > 1 else "edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


def grey(bgr: np.ndarray) -> np.ndarray:
    return bgr @ np.array([0.114, 0.587, 0.299])


def colors_at(bgr: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """RGB of the nearest pixels (halves to even), clamped to the image."""
    x, y = np.clip(np.rint(u).astype(int), 0, bgr.shape[1] - 1), np.clip(np.rint(v).astype(int), 0, bgr.shape[0] - 1)
    return bgr[y, x][:, ::-1]
