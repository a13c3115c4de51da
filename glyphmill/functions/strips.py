"""Steps on the runs of many pieces at once, as arrays.

A strip's lines are numbered through all pieces of a batch, those of a piece one after the other; a line knows its piece and its width.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np


@dataclass
class Strips:
    """Runs (line, x0, x1), and the piece and width of every line, with or without runs; layer where runs have one."""

    line: np.ndarray
    x0: np.ndarray
    x1: np.ndarray
    piece: np.ndarray
    width: np.ndarray
    layer: np.ndarray | None = None

    def where(self, keep: np.ndarray) -> Strips:
        return replace(self, line=self.line[keep], x0=self.x0[keep], x1=self.x1[keep], layer=None)


def together(a: Strips, b: Strips) -> Strips:
    both = {n: np.concatenate([getattr(a, n), getattr(b, n)]) for n in ("line", "x0", "x1")}
    return united(replace(a, **both, layer=None))


def united(s: Strips) -> Strips:
    """Runs of a line that overlap or touch become one; runs are in order then."""
    if not len(s.line):
        return s
    low = min(0, int(s.x0.min()))
    wide = int(s.x1.max()) - low + 2
    begins = s.line * wide + s.x0 - low
    order = np.argsort(begins, kind="stable")
    begins = begins[order]
    reached = np.maximum.accumulate((s.line * wide + s.x1 - low)[order])
    first = np.flatnonzero(np.r_[True, begins[1:] > reached[:-1]])
    line = s.line[order][first]
    return replace(s, line=line, x0=s.x0[order][first], x1=reached[np.r_[first[1:] - 1, len(begins) - 1]] - line * wide + low, layer=None)


def complement(s: Strips) -> Strips:
    """What lies between united runs of every line."""
    n = len(s.width)
    at = np.searchsorted(s.line, np.arange(n)) + np.arange(n)  # where each line's gaps begin
    opens, own = np.zeros(n + len(s.line), bool), np.zeros(n + len(s.line), np.int64)
    opens[at] = True
    line = np.cumsum(opens) - 1
    own[~opens] = s.x1
    ends = np.append(~opens[1:], False) if len(opens) else opens
    stop = s.width[line]
    stop[ends] = np.minimum(s.x0, stop[ends])
    keep = own < stop
    return replace(s, line=line[keep], x0=own[keep], x1=stop[keep], layer=None)


def dilated(s: Strips, kernel) -> Strips:
    """A pixel is set if any pixel under the kernel (rows of dy, lo, hi) is. A run gives a wider run for each row of the kernel."""
    n = len(s.width)
    own, moved = s.piece[s.line], []
    for dy, lo, hi in kernel:
        to = s.line - dy
        held = np.clip(to, 0, max(n - 1, 0))
        x0, x1 = np.maximum(s.x0 - hi, 0), np.minimum(s.x1 - lo, s.width[held])
        ok = (to == held) & (s.piece[held] == own) & (x0 < x1)
        moved.append((to[ok], x0[ok], x1[ok]))
    line, x0, x1 = (np.concatenate(v) for v in zip(*moved, strict=True))
    return united(replace(s, line=line, x0=x0, x1=x1, layer=None))


def eroded(s: Strips, kernel) -> Strips:
    """A pixel stays if all pixels of the picture under the kernel are set."""
    return complement(dilated(complement(s), kernel))


def opened(s: Strips, kernel) -> Strips:
    return dilated(eroded(s, kernel), kernel)


def closed(s: Strips, kernel, times: int = 1) -> Strips:
    for _ in range(times):
        s = dilated(s, kernel)
    for _ in range(times):
        s = eroded(s, kernel)
    return s
