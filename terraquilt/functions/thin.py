"""Line simplification of a batch of rings."""

from __future__ import annotations

import numpy as np

from terraquilt.functions.packed import Shapes, offsets, overlaps, ranges


def _kept_points(s: Shapes, tol: float) -> np.ndarray:
    """Points a Douglas-Peucker pass keeps. All rings advance together: each
    round handles every open stretch and splits those that bulge too far."""
    keep = np.zeros(len(s.x), bool)
    lo, hi = s.ring_at[:-1][s.sizes > 0], s.ring_at[1:][s.sizes > 0] - 1
    keep[lo] = keep[hi] = True
    while True:
        wide = hi - lo >= 2
        lo, hi = lo[wide], hi[wide]
        if not len(lo):
            return keep
        inner = hi - lo - 1
        at = np.repeat(np.arange(len(lo)), inner)
        k = lo[at] + 1 + ranges(inner)
        bx, by = (s.x[hi] - s.x[lo])[at], (s.y[hi] - s.y[lo])[at]
        px, py = s.x[k] - s.x[lo][at], s.y[k] - s.y[lo][at]
        base = bx * bx + by * by
        along = np.clip((px * bx + py * by) / np.where(base > 0, base, 1.0), 0.0, 1.0)
        off = np.hypot(px - along * bx, py - along * by)
        first = np.cumsum(inner) - inner
        worst = np.maximum.reduceat(off, first)
        far = np.minimum.reduceat(np.where(off == worst[at], k, len(s.x)), first)
        split = worst > tol
        lo, mid, hi = lo[split], far[split], hi[split]
        keep[mid] = True
        lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])


def _select(s: Shapes, keep: np.ndarray) -> Shapes:
    ring = np.repeat(np.arange(len(s.sizes)), s.sizes)
    sizes = np.bincount(ring[keep], minlength=len(s.sizes))
    return Shapes(s.rows, s.ring_row, s.ring_part, s.ring_hole, offsets(sizes), s.x[keep], s.y[keep])


def _crossing_rings(s: Shapes, rings: np.ndarray) -> np.ndarray:
    """Which of the flagged rings have two edges that meet though they do not
    follow each other."""
    n = np.where(rings, np.maximum(s.sizes - 1, 0), 0)
    ring = np.repeat(np.arange(len(n)), n)
    pos = ranges(n)
    p = s.ring_at[:-1][ring] + pos
    x, y, rx, ry = s.x[p], s.y[p], s.x[p + 1] - s.x[p], s.y[p + 1] - s.y[p]
    bad = np.zeros(len(n), bool)
    lo, hi = np.minimum(x, x + rx), np.maximum(x, x + rx)
    low, high = np.minimum(y, y + ry), np.maximum(y, y + ry)
    for i, j in overlaps(ring, lo, hi, ring, lo, hi):
        apart = (pos[j] > pos[i] + 1) & ~((pos[i] == 0) & (pos[j] == n[ring[j]] - 1))
        apart &= (low[i] <= high[j]) & (low[j] <= high[i])
        i, j = i[apart], j[apart]
        wx, wy = x[j] - x[i], y[j] - y[i]
        a0 = rx[i] * wy - ry[i] * wx
        a1 = a0 + rx[i] * ry[j] - ry[i] * rx[j]
        b0 = ry[j] * wx - rx[j] * wy
        b1 = b0 + rx[j] * ry[i] - ry[j] * rx[i]
        meet = (a0 * a1 <= 0) & (b0 * b1 <= 0) & ((a0 != 0) | (a1 != 0))
        bad[ring[i[meet]]] = True
    return bad


def simplified(s: Shapes, tol: float) -> Shapes:
    """Thinned rings; one that would collapse or cross itself stays as it was."""
    keep = _kept_points(s, tol)
    thin = _select(s, keep)
    changed = thin.sizes < s.sizes
    undo = changed & ((thin.sizes < 4) | _crossing_rings(thin, changed))
    keep |= np.repeat(undo, s.sizes)
    return _select(s, keep)
