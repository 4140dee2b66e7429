"""Edges of shapes, one Arrow batch at a time: which shapes are plain, and which plain ones meet."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from terraquilt.functions.packed import CHUNK, offsets, ranges, unpack_shapes


def tangled(row, ring, k, n, p, x0, y0, x1, y1, rows: int) -> np.ndarray:
    """Rows of which edges that don't follow each other touch, or one turns back on the one before. Edges come by
    rows and rings: k is an edge's number in its ring, n the ring's number of edges, p an edge's number in its row."""
    bad = np.zeros(rows, bool)
    later = np.bincount(row, minlength=rows)[row] - 1 - p
    upto, lo = np.cumsum(later), 0

    def turn(e, f, x, y):
        return np.sign((x1[e] - x0[e]) * (y[f] - y0[e]) - (x[f] - x0[e]) * (y1[e] - y0[e]))

    while lo < len(row):  # in bounded chunks
        base = upto[lo - 1] if lo else 0
        hi = max(int(np.searchsorted(upto, base + CHUNK, side="right")), lo + 1)
        a = np.repeat(np.arange(lo, hi), later[lo:hi])
        b = a + 1 + ranges(later[lo:hi])
        follows = (ring[a] == ring[b]) & ((k[b] == k[a] + 1) | ((k[a] == 0) & (k[b] == n[b] - 1)))
        near = np.ones(len(a), bool)
        for v0, v1 in ((x0, x1), (y0, y1)):
            least, most = np.minimum(v0, v1), np.maximum(v0, v1)
            near &= np.maximum(least[a], least[b]) <= np.minimum(most[a], most[b])
        a, b, follows = a[near], b[near], follows[near]
        to0, to1 = turn(a, b, x0, y0), turn(a, b, x1, y1)
        touch = (to0 * to1 <= 0) & (turn(b, a, x0, y0) * turn(b, a, x1, y1) <= 0)
        back = (to0 == 0) & (to1 == 0) & ((x1[a] - x0[a]) * (x1[b] - x0[b]) + (y1[a] - y0[a]) * (y1[b] - y0[b]) < 0)
        bad[row[a[np.where(follows, back, touch)]]] = True
        lo = hi
    return bad


def plain_edges(shapes: pa.Array, most: int) -> pa.Array:
    """For packed shapes that don't cross or touch themselves their directed edges, list<struct<x0, y0, x1, y1>>; null
    for others, and for those with fewer than three or more than `most`."""
    s = unpack_shapes(shapes)
    own = np.ones(len(s.x), bool)
    own[s.ring_at[1:][s.sizes > 0] - 1] = False  # a ring's last point starts no edge
    at = np.flatnonzero(own)
    at = at[(s.x[at] != s.x[at + 1]) | (s.y[at] != s.y[at + 1])]
    ring = np.repeat(np.arange(len(s.sizes)), s.sizes)[at]
    row = s.ring_row[ring]
    count = np.bincount(row, minlength=s.rows)
    wrong = (count < 3) | (count > most)
    wrong[row[~np.isfinite(s.x[at] + s.x[at + 1] + s.y[at] + s.y[at + 1])]] = True
    keep = ~wrong[row]
    at, ring, row = at[keep], ring[keep], row[keep]
    corners = s.x[at], s.y[at], s.x[at + 1], s.y[at + 1]
    n = np.bincount(ring, minlength=len(s.sizes))
    k, p = np.arange(len(at)) - offsets(n)[ring], ranges(np.bincount(row, minlength=s.rows)[~wrong])
    bad = tangled(row, ring, k, n[ring], p, *corners, s.rows)
    keep = ~bad[row]
    edges = pa.StructArray.from_arrays([pa.array(v[keep]) for v in corners], names=["x0", "y0", "x1", "y1"])
    own_at = offsets(np.bincount(row[keep], minlength=s.rows)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(own_at), edges, mask=pa.array(wrong | bad))


def _flat(edges: pa.Array) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Number of edges in each row, and their corners; null rows have none."""
    flat = edges.flatten()
    return (
        edges.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64),
        tuple(flat.field(c).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1")),
    )


def meet(left: pa.Array, right: pa.Array) -> pa.Array:
    """For pairs of plain shapes, whether they share a point: edges touch, or one holds a ring of the other. A row
    without edges on a side meets nothing."""
    (n_l, l), (n_r, r) = _flat(left), _flat(right)
    at_l, at_r, upto = offsets(n_l), offsets(n_r), np.cumsum(n_l * n_r)
    hit, lo = np.zeros(len(left), bool), 0
    while lo < len(hit):  # in bounded chunks
        base = upto[lo - 1] if lo else 0
        hi = max(int(np.searchsorted(upto, base + CHUNK, side="right")), lo + 1)
        count = (n_l * n_r)[lo:hi]
        row = np.repeat(np.arange(lo, hi), count)
        i, j = np.divmod(ranges(count), n_r[row])
        i, j = i + at_l[row], j + at_r[row]
        ex0, ey0, ex1, ey1 = (v[i] for v in l)
        fx0, fy0, fx1, fy1 = (v[j] for v in r)
        ax, ay, bx, by = ex1 - ex0, ey1 - ey0, fx1 - fx0, fy1 - fy0
        f0, f1 = ax * (fy0 - ey0) - (fx0 - ex0) * ay, ax * (fy1 - ey0) - (fx1 - ex0) * ay
        e0, e1 = bx * (ey0 - fy0) - (ex0 - fx0) * by, bx * (ey1 - fy0) - (ex1 - fx0) * by
        touch = (np.sign(f0) * np.sign(f1) <= 0) & (np.sign(e0) * np.sign(e1) <= 0)
        for p0, p1, q0, q1 in ((ex0, ex1, fx0, fx1), (ey0, ey1, fy0, fy1)):
            touch &= np.maximum(np.minimum(p0, p1), np.minimum(q0, q1)) <= np.minimum(np.maximum(p0, p1), np.maximum(q0, q1))
        hit[row[touch]] = True
        # Even-odd test of each edge's start against the other shape; starts that lie on its edges have touched already.
        over_f = ((fy0 <= ey0) != (fy1 <= ey0)) & ((e0 > 0) == (fy1 > fy0))
        over_e = ((ey0 <= fy0) != (ey1 <= fy0)) & ((f0 > 0) == (ey1 > ey0))
        for over, k, at, n in ((over_f, i, at_l, n_l), (over_e, j, at_r, n_r)):
            odd = np.bincount(k[over] - at[lo], minlength=at[hi] - at[lo]) % 2 == 1
            hit[np.repeat(np.arange(lo, hi), n[lo:hi])[odd]] = True
        lo = hi
    return pa.array(hit)
