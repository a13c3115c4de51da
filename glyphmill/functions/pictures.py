"""What is done to one RGBA picture: another size, a canvas, a ground, its colours."""

from __future__ import annotations

import numpy as np


def filled(height: int, width: int, y, x0, x1, colour: np.ndarray) -> np.ndarray:
    """RGBA pixels of runs and their colours (a row each, of one or three numbers); opaque, and where no run lies all zero."""
    y, x0, x1 = (np.asarray(v, dtype=np.int64) for v in (y, x0, x1))
    n = x1 - x0
    at = np.repeat(y * width + x0 - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    out = np.zeros((height * width, 4), np.uint8)
    out[at, : colour.shape[1]] = np.repeat(colour, n, axis=0)
    out[at, 3] = 255
    return out.reshape(height, width, 4)


def _lanczos(size: int, to: int) -> np.ndarray:
    """Weights of a three-lobed Lanczos filter, widened where the picture shrinks: one row for each new pixel."""
    ratio = size / to
    wide = max(1.0, ratio)
    centre = (np.arange(to) + 0.5) * ratio
    x = (np.arange(size) + 0.5 - centre[:, None]) / wide
    weights = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return weights / weights.sum(axis=1, keepdims=True)


def resample(rgba: np.ndarray, width: int, height: int) -> np.ndarray:
    """The picture in another size; colours count by their opacity, so that clear pixels leave no fringe."""
    if (height, width) == rgba.shape[:2]:
        return rgba
    alpha = rgba[..., 3:].astype(np.float64) / 255
    flat = np.concatenate([rgba[..., :3] * alpha, alpha * 255], axis=2)
    down, across = _lanczos(rgba.shape[0], height), _lanczos(rgba.shape[1], width)
    out = np.einsum("yh,hwc,xw->yxc", down, flat, across, optimize=True).clip(0, 255)
    with np.errstate(all="ignore"):
        colour = np.where(out[..., 3:] > 0, out[..., :3] * 255 / out[..., 3:], 0)
    return np.rint(np.concatenate([colour.clip(0, 255), out[..., 3:]], axis=2)).astype(np.uint8)


def compose(rgba: np.ndarray, width: int, height: int, new_w: int, new_h: int, off_x: int, off_y: int, ground=(0, 0, 0, 0)) -> np.ndarray:
    """The picture in its new size over a canvas of one colour, cut off where it is larger than the canvas."""
    picture = resample(rgba, new_w, new_h)
    canvas = np.empty((height, width, 4), np.uint8)
    canvas[:] = ground
    x, y = max(0, off_x), max(0, off_y)
    sx, sy = max(0, -off_x), max(0, -off_y)
    w, h = min(new_w - sx, width - x), min(new_h - sy, height - y)
    if w > 0 and h > 0:
        canvas[y : y + h, x : x + w] = over(picture[sy : sy + h, sx : sx + w], canvas[y : y + h, x : x + w])
    return canvas


def over(top: np.ndarray, below: np.ndarray) -> np.ndarray:
    """One RGBA picture laid over another."""
    a, b = top[..., 3:] / 255, below[..., 3:] / 255
    alpha = a + b * (1 - a)
    with np.errstate(all="ignore"):
        colour = np.where(alpha > 0, (top[..., :3] * a + below[..., :3] * b * (1 - a)) / alpha, 0)
    return np.rint(np.concatenate([colour, alpha * 255], axis=2)).astype(np.uint8)


def flattened(rgba: np.ndarray, ground: tuple[int, int, int] = (255, 255, 255)) -> np.ndarray:
    """Without opacity, over a ground of one colour, for formats that have none."""
    below = np.empty_like(rgba)
    below[:] = (*ground, 255)
    return over(rgba, below)[..., :3]


def palette(rgba: np.ndarray, most: int = 4) -> list[str]:
    """The commonest colours, in steps of 16, of pixels that aren't clear; of equal counts the lighter first."""
    seen = rgba[rgba[..., 3] > 0][:, :3] // 16 * 16
    if not len(seen):
        return []
    colours, counts = np.unique(seen, axis=0, return_counts=True)
    return ["#{:02x}{:02x}{:02x}".format(*colours[i]) for i in np.argsort(counts, kind="stable")[::-1][:most]]
