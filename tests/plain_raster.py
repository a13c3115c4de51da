"""Detection on one sheet's pixels in plain numpy: what the operators on runs are held against."""

from __future__ import annotations

import numpy as np


def ellipse(size: int) -> np.ndarray:
    """Elliptic kernel: each row's half width follows the ellipse of the box."""
    r = size // 2
    dy = np.arange(size) - r
    half = np.rint(r * np.sqrt(np.maximum(1 - (dy / max(r, 1)) ** 2, 0))).astype(int)
    return np.abs(np.arange(size) - r)[None, :] <= half[:, None]


def _shifted(mask: np.ndarray, kernel: np.ndarray, fill: bool):
    r, c = kernel.shape[0] // 2, kernel.shape[1] // 2
    padded = np.pad(mask, ((r, r), (c, c)), constant_values=fill)
    for dy, dx in np.argwhere(kernel):
        yield padded[dy : dy + mask.shape[0], dx : dx + mask.shape[1]]


def dilate(mask: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    return np.logical_or.reduce(list(_shifted(mask, kernel, False)))


def erode(mask: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Pixels out of the image don't count against a pixel."""
    return np.logical_and.reduce(list(_shifted(mask, kernel, True)))


def opened(mask, kernel):
    return dilate(erode(mask, kernel), kernel)


def closed(mask, kernel, times=1):
    for _ in range(times):
        mask = dilate(mask, kernel)
    for _ in range(times):
        mask = erode(mask, kernel)
    return mask


def lab(bgr: np.ndarray) -> np.ndarray:
    """CIELAB (D65) of 8-bit BGR pixels, in 8-bit steps: L times 2.55, a and b plus 128."""
    rgb = bgr[..., 2::-1].astype(np.float64) / 255
    linear = np.where(rgb <= 0.04045, rgb / 12.92, ((rgb + 0.055) / 1.055) ** 2.4)
    to_xyz = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
    xyz = linear @ to_xyz.T / np.array([0.950456, 1.0, 1.088754])
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    light = np.where(xyz[..., 1] > 0.008856, 116 * np.cbrt(xyz[..., 1]) - 16, 903.3 * xyz[..., 1])
    out = np.stack([light * 255 / 100, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], axis=-1)
    return np.rint(np.clip(out, 0, 255))


def gray(bgr: np.ndarray) -> np.ndarray:
    return ((bgr[..., :3].astype(np.int64) @ np.array([3735, 19235, 9798]) + 16384) >> 15).astype(np.uint8)


def otsu(values: np.ndarray) -> int:
    counts = np.bincount(values.ravel(), minlength=256).astype(np.float64)
    below, mass = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    with np.errstate(all="ignore"):
        gap = mass / below - (mass[-1] - mass) / (below[-1] - below)
        between = np.nan_to_num(below * (below[-1] - below) * gap**2)
    return int(np.argmax(np.round(between, 3)))


def border(pixels: np.ndarray) -> np.ndarray:
    """The four border bands one after another; corners come twice."""
    h, w = pixels.shape[:2]
    band = max(1, min(12, h // 4 or 1, w // 4 or 1))
    parts = pixels[:band], pixels[-band:], pixels[:, :band], pixels[:, -band:]
    return np.concatenate([p.reshape(-1, *pixels.shape[2:]) for p in parts])


def background(bgr: np.ndarray) -> tuple[int, int, int]:
    b, g, r = (int(np.median(border(bgr)[:, i])) for i in range(3))
    return r, g, b


def dark_mask(values: np.ndarray) -> np.ndarray:
    return closed(values <= otsu(values), np.ones((3, 3), bool))


def foreground(bgr: np.ndarray) -> np.ndarray:
    """Pixels that differ from the border in colour or lightness, or are dark; opened once and closed twice."""
    colours = lab(bgr)
    edge = border(colours)
    mean = edge.mean(axis=0)
    far = lambda p: np.linalg.norm(p - mean, axis=-1)
    light = lambda p: np.abs(p[..., 0] - mean[0])
    limit = max(12.0, np.percentile(far(edge), 95) * 2.5 + 6)
    light_limit = max(10.0, np.percentile(light(edge), 95) * 2.5 + 4)
    mask = (far(colours) > limit) | (light(colours) > light_limit) | dark_mask(gray(bgr))
    plus = ellipse(3)
    return closed(opened(mask, plus), plus, 2)


def label(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Component numbers from 1, in order of first pixel; 0 elsewhere. Runs of a row are united with runs above."""
    h, w = mask.shape
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    ys, starts = np.nonzero(edge == 1)
    ends = np.nonzero(edge == -1)[1]
    parent = list(range(len(ys)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    rows = np.searchsorted(ys, np.arange(h + 1))
    reach = int(diagonal)
    for y in range(1, h):
        above, at = rows[y - 1], rows[y]
        for i in range(at, rows[y + 1]):
            while above < at and ends[above] + reach <= starts[i]:
                above += 1
            j = above
            while j < at and starts[j] < ends[i] + reach:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
                j += 1
    roots = np.array([find(i) for i in range(len(ys))], dtype=np.int64)
    number = np.unique(roots, return_inverse=True)[1] + 1 if len(roots) else roots
    out = np.zeros((h, w), dtype=np.int32)
    for y, s, e, n in zip(ys, starts, ends, number, strict=True):
        out[y, s:e] = n
    return out


def exterior(mask: np.ndarray) -> np.ndarray:
    """Background reachable from outside (four neighbours); enclosed holes are not."""
    outside = label(~np.pad(mask, 1), diagonal=False)
    return (outside == outside[0, 0])[1:-1, 1:-1]


def transparent_crop(bgr: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return np.dstack([bgr[..., 2::-1], np.where(exterior(mask), 0, 255).astype(np.uint8)])


def detect(bgr: np.ndarray, min_area: int, merge_gap: int) -> list[tuple[tuple, tuple, int]]:
    """(tightened box, spread box, area) of each icon: the mask is spread so that strokes near each other join; the
    area is the spread one's."""
    mask = foreground(bgr)
    spread = dilate(mask, ellipse(max(3, merge_gap + (merge_gap % 2 == 0))))
    labels = label(spread)
    ys, xs = np.nonzero(labels)
    number = labels[ys, xs]
    order = np.argsort(number, kind="stable")
    edges = np.searchsorted(number[order], np.arange(1, number.max(initial=0) + 2))
    out = []
    for s, e in zip(edges[:-1], edges[1:], strict=True):
        if e - s < min_area:
            continue
        own = order[s:e]
        wide = box_of(ys[own], xs[own])
        x, y, w, h = wide
        py, px = np.nonzero(mask[y : y + h, x : x + w])
        out.append((box_of(py + y, px + x) if len(py) else wide, wide, int(e - s)))
    return out


def box_of(ys: np.ndarray, xs: np.ndarray) -> tuple[int, int, int, int]:
    x, y = int(xs.min()), int(ys.min())
    return x, y, int(xs.max()) + 1 - x, int(ys.max()) + 1 - y
