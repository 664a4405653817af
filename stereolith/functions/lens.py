"""Lens models and their inverses on arrays of pixels."""

from __future__ import annotations

import numpy as np


def fisheye_forward(x: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Distorted normalised points of equidistant ones. d: fx fy cx cy k1..k4-like order (k1, k2, p1, p2, k3, k4, s1, s3) behind four camera values."""
    k, p, s = d[[0, 1, 4, 5]], d[[2, 3]], d[[6, 7]]
    u, v = x[:, 0], x[:, 1]
    q = u * u + v * v
    radial = 1 + q * (k[0] + q * (k[1] + q * (k[2] + q * k[3])))
    return np.stack([u * radial + 2 * p[0] * u * v + p[1] * (q + 2 * u * u) + s[0] * q, v * radial + 2 * p[1] * u * v + p[0] * (q + 2 * v * v) + s[1] * q], 1)


def fisheye_distort(uv: np.ndarray, k: tuple[float, float, float, float], dist: np.ndarray) -> np.ndarray:
    """Pinhole pixels to pixels of the 12-parameter lens (four camera values, then eight coefficients)."""
    fx, fy, cx, cy = k
    p = np.stack([(uv[:, 0] - cx) / fx, (uv[:, 1] - cy) / fy], 1)
    r = np.linalg.norm(p, axis=1)
    scale = np.where(r < 1e-9, 1, np.arctan(r) / np.maximum(r, 1e-12))
    y = fisheye_forward(p * scale[:, None], dist[4:])
    return np.stack([y[:, 0] * fx + cx, y[:, 1] * fy + cy], 1)


def opencv_forward(x: np.ndarray, d: np.ndarray) -> np.ndarray:
    k = np.zeros(8)
    k[: len(d)] = d
    u, v = x[:, 0], x[:, 1]
    q = u * u + v * v
    radial = (1 + q * (k[0] + q * (k[1] + q * k[4]))) / (1 + q * (k[5] + q * (k[6] + q * k[7])))
    return np.stack([u * radial + 2 * k[2] * u * v + k[3] * (q + 2 * u * u), v * radial + k[2] * (q + 2 * v * v) + 2 * k[3] * u * v], 1)


def _invert(forward, y: np.ndarray, d: np.ndarray, steps: int) -> np.ndarray:
    """Newton's method with numeric Jacobians; a step is at most a tenth of the radius (of 1 near the centre)."""
    x = y.copy()
    h = 1e-6
    for _ in range(steps):
        e = forward(x, d) - y
        if np.nanmax(np.abs(e), initial=0) < 1e-13:
            break
        a = (forward(x + [h, 0], d) - forward(x - [h, 0], d)) / (2 * h)
        b = (forward(x + [0, h], d) - forward(x - [0, h], d)) / (2 * h)
        det = a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]
        det = np.where(np.abs(det) < 1e-12, 1e-12, det)
        step = np.stack([(e[:, 0] * b[:, 1] - e[:, 1] * b[:, 0]) / det, (e[:, 1] * a[:, 0] - e[:, 0] * a[:, 1]) / det], 1)
        n = np.linalg.norm(step, axis=1)
        most = np.maximum(0.1 * np.linalg.norm(x, axis=1), 0.1)
        x = x - step * np.minimum(1, most / np.maximum(n, 1e-15))[:, None]
    return x


def undistort(uv: np.ndarray, k: tuple[float, float, float, float], dist: np.ndarray) -> np.ndarray:
    """Pinhole pixels. 12 parameters apply if their first four are the camera's; what has no finite solution keeps its pixel."""
    fx, fy, cx, cy = k
    y = np.stack([(uv[:, 0] - cx) / fx, (uv[:, 1] - cy) / fy], 1)
    if len(dist) == 12:
        if not np.allclose(dist[:4], k, rtol=1e-4, atol=1e-3):
            return uv
        x = _invert(fisheye_forward, y, dist[4:], 100)
        r = np.linalg.norm(x, axis=1)
        x = x * np.where(r < 1e-9, 1, np.tan(np.minimum(r, np.pi / 2)) / np.maximum(r, 1e-12))[:, None]
    else:
        x = _invert(opencv_forward, y, dist, 50)
    out = np.stack([x[:, 0] * fx + cx, x[:, 1] * fy + cy], 1)
    return np.where(np.isfinite(out).all(1, keepdims=True), out, uv)
