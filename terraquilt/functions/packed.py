"""Geometry batches as flat numpy arrays, for use inside tasks.

Two Arrow forms are read: the nested ``rings`` type and the packed form that
joins carry, one ``array<double>`` per shape holding the number of rings, then
size and hole flag of each ring, then x and y of every point. The packed form is
made by Columns (``geom.pack_shape``) and costs a plain memory copy per row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 200_000  # index pairs looked at together; small enough to stay in cache
ARROW_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
ARROW_RING = pa.struct(
    [("part", pa.int32()), ("hole", pa.bool_()), ("pts", pa.list_(ARROW_POINT))]
)


@dataclass
class Shapes:
    """One batch of geometries. Ring ``i`` belongs to row ``ring_row[i]``
    (ascending) and owns points ``ring_at[i]:ring_at[i + 1]``."""

    rows: int
    ring_row: np.ndarray
    ring_part: np.ndarray
    ring_hole: np.ndarray
    ring_at: np.ndarray
    x: np.ndarray
    y: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.ring_at)


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..count-1 for every count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def overlaps(row_a: np.ndarray, lo_a: np.ndarray, hi_a: np.ndarray,
             row_b: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray):
    """Index pairs (i, j) of equal rows whose closed intervals meet, in bounded chunks.
    Sorted by where intervals begin, so only pairs that meet are looked at."""
    na, nb = len(row_a), len(row_b)
    value = np.concatenate([lo_a, hi_a, lo_b, hi_b])
    row = np.concatenate([row_a, row_a, row_b, row_b])
    order = np.lexsort((value, row))
    new = np.zeros(len(order), np.int64)
    new[1:] = (value[order][1:] != value[order][:-1]) | (row[order][1:] != row[order][:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    begin_a, end_a, begin_b, end_b = np.split(rank, [na, 2 * na, 2 * na + nb])
    by_a, by_b = np.argsort(begin_a, kind="stable"), np.argsort(begin_b, kind="stable")
    sorted_a, sorted_b = begin_a[by_a], begin_b[by_b]
    # j begins inside i, then i begins inside j and after it: each pair once
    sides = (
        (np.searchsorted(sorted_b, begin_a, "left"), np.searchsorted(sorted_b, end_a, "right"), by_b, False),
        (np.searchsorted(sorted_a, begin_b, "right"), np.searchsorted(sorted_a, end_b, "right"), by_a, True),
    )
    for first, last, by, turned in sides:
        count = np.maximum(last - first, 0)
        upto, lo = np.cumsum(count), 0
        while lo < len(count):
            base = upto[lo - 1] if lo else 0
            hi = max(int(np.searchsorted(upto, base + CHUNK, side="right")), lo + 1)
            reps = count[lo:hi]
            own = np.repeat(np.arange(lo, hi), reps)
            other = by[first[own] + ranges(reps)]
            yield (other, own) if turned else (own, other)
            lo = hi


def signed_areas(s: Shapes) -> np.ndarray:
    """Planar area of each ring, positive when it runs counter-clockwise."""
    ring = np.repeat(np.arange(len(s.sizes)), s.sizes)
    first = s.ring_at[:-1][ring]
    x, y = s.x - s.x[first], s.y - s.y[first]
    cross = np.zeros(len(x))
    cross[:-1] = x[:-1] * y[1:] - x[1:] * y[:-1]
    cross[s.ring_at[1:][s.sizes > 0] - 1] = 0.0
    return np.bincount(ring, cross, len(s.sizes)) / 2


def oriented(s: Shapes) -> Shapes:
    """The same rings, exteriors counter-clockwise and holes clockwise."""
    back = np.repeat((signed_areas(s) > 0) == s.ring_hole, s.sizes)
    start, pos = np.repeat(s.ring_at[:-1], s.sizes), ranges(s.sizes)
    take = start + np.where(back, np.repeat(s.sizes, s.sizes) - 1 - pos, pos)
    return Shapes(s.rows, s.ring_row, s.ring_part, s.ring_hole, s.ring_at, s.x[take], s.y[take])


def unpack(rings: pa.Array) -> Shapes:
    """Nested ``rings`` to flat arrays; null rows have no rings."""
    counts = rings.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = rings.flatten()
    pts = flat.field("pts")
    xy = pts.flatten()
    return Shapes(
        rows=len(rings),
        ring_row=np.repeat(np.arange(len(rings)), counts),
        ring_part=flat.field("part").to_numpy(zero_copy_only=False),
        ring_hole=flat.field("hole").to_numpy(zero_copy_only=False).astype(bool),
        ring_at=offsets(pts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)),
        x=xy.field("x").to_numpy(zero_copy_only=False),
        y=xy.field("y").to_numpy(zero_copy_only=False),
    )


def unpack_shapes(shapes: pa.Array) -> Shapes:
    """Packed ``array<double>`` shapes to flat arrays."""
    length = shapes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = shapes.flatten().to_numpy(zero_copy_only=False)
    at = offsets(length)[:-1]
    rings = np.zeros(len(length), np.int64)
    full = length > 0
    rings[full] = flat[at[full]]
    ring_row = np.repeat(np.arange(len(length)), rings)
    head = at[ring_row] + 1 + 2 * ranges(rings)
    points = (length - 1 - 2 * rings) // 2
    points[~full] = 0
    xy = np.repeat(at + 1 + 2 * rings, points) + 2 * ranges(points)
    return Shapes(
        rows=len(length),
        ring_row=ring_row,
        ring_part=np.zeros(len(ring_row), np.int32),
        ring_hole=flat[head + 1] > 0,
        ring_at=offsets(flat[head].astype(np.int64)),
        x=flat[xy],
        y=flat[xy + 1],
    )


def to_arrow(s: Shapes, null: np.ndarray | None = None) -> pa.Array:
    """Flat arrays to the nested ``rings`` type."""
    points = pa.StructArray.from_arrays(
        [pa.array(np.ascontiguousarray(v, dtype=np.float64)) for v in (s.x, s.y)], fields=list(ARROW_POINT)
    )
    ring = pa.StructArray.from_arrays(
        [
            pa.array(s.ring_part.astype(np.int32)),
            pa.array(s.ring_hole.astype(bool)),
            pa.ListArray.from_arrays(pa.array(s.ring_at.astype(np.int32)), points),
        ],
        fields=list(ARROW_RING),
    )
    at = offsets(np.bincount(s.ring_row, minlength=s.rows)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), ring, mask=None if null is None else pa.array(null))


def from_rows(rows: list) -> tuple[Shapes, np.ndarray]:
    """Rows of ``None`` or ``[(part, hole, xy), ...]`` as shapes and null flags."""
    rings = [(i, *ring) for i, r in enumerate(rows) if r is not None for ring in r]
    xy = np.concatenate([r[3] for r in rings]) if rings else np.empty((0, 2))
    shapes = Shapes(
        rows=len(rows),
        ring_row=np.array([r[0] for r in rings], np.int64),
        ring_part=np.array([r[1] for r in rings], np.int32),
        ring_hole=np.array([r[2] for r in rings], bool),
        ring_at=offsets(np.array([len(r[3]) for r in rings], np.int64)),
        x=xy[:, 0],
        y=xy[:, 1],
    )
    return shapes, np.array([r is None for r in rows], bool)


def pack(rows: list) -> pa.Array:
    return to_arrow(*from_rows(rows))


def stack(a: Shapes, b: Shapes) -> Shapes:
    """Rings of two batches over the same rows, in row order."""
    row = np.concatenate([a.ring_row, b.ring_row])
    order = np.argsort(row, kind="stable")
    size = np.concatenate([a.sizes, b.sizes])[order]
    start = np.concatenate([a.ring_at[:-1], b.ring_at[:-1] + len(a.x)])[order]
    take = np.repeat(start, size) + ranges(size)
    return Shapes(
        a.rows,
        row[order],
        np.concatenate([a.ring_part, b.ring_part])[order],
        np.concatenate([a.ring_hole, b.ring_hole])[order],
        offsets(size),
        np.concatenate([a.x, b.x])[take],
        np.concatenate([a.y, b.y])[take],
    )
