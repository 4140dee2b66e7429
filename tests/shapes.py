"""Small shapes as rings ``(part, hole, xy)`` and helpers to use them."""

import numpy as np
import pyarrow as pa

from terraquilt.functions.kernel import intersect


def ring(*points, part=0, hole=False):
    return part, hole, np.array([*points, points[0]], float)


def square(x0, y0, x1, y1, **kw):
    return ring((x0, y0), (x1, y0), (x1, y1), (x0, y1), **kw)


def star(cx, cy, radii):
    """A simple polygon around a centre, one vertex per radius."""
    angle = 2 * np.pi * np.arange(len(radii)) / len(radii)
    r = np.asarray(radii, float)
    return [ring(*zip(cx + r * np.cos(angle), cy + r * np.sin(angle)))]


def packed(rings):
    if rings is None:
        return None
    head = [float(len(rings))]
    for _, hole, xy in rings:
        head += [float(len(xy)), float(hole)]
    return head + [float(v) for _, _, xy in rings for v in xy.ravel()]


def clip(pairs, with_geometry=False):
    """Run the kernel on a list of (rings, rings); rows as dicts."""
    left, right = (pa.array([packed(p[i]) for p in pairs], pa.list_(pa.float64())) for i in (0, 1))
    return intersect(left, right, with_geometry).to_pylist()


def shoelace(rings):
    total = 0.0
    for _, hole, xy in rings:
        a = abs(np.sum(xy[:-1, 0] * xy[1:, 1] - xy[1:, 0] * xy[:-1, 1]) / 2)
        total += -a if hole else a
    return total


def row(rings):
    """Rings as Spark row values."""
    return None if rings is None else [
        (part, hole, [(float(x), float(y)) for x, y in xy]) for part, hole, xy in rings
    ]
