"""Exact intersection of polygon pairs, one Arrow batch at a time.

For every pair (A, B) in the batch the boundary of A is split where it meets B
and the pieces inside B are kept, and the other way round. The kept pieces,
still directed with the interior on their left, bound the intersection, so its
area is a sum over pieces and needs no ring assembly. A piece lying on both
boundaries counts once when the two run the same way and not at all when they
run against each other. Points of the two boundaries within the tolerance of each other
are made the same point first, so that whether pieces coincide is a question of equal
numbers. Shapes that cross themselves are measured by the even-odd rule: a bow-tie is its
two lobes. Spark decides which pairs meet here and measures nothing itself; this
module only does the arithmetic for a bounded batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from terraquilt.functions.packed import (
    Shapes,
    from_rows,
    offsets,
    overlaps,
    ranges,
    signed_areas,
    stack,
    to_arrow,
    unpack_shapes,
)
from terraquilt.model import EARTH_RADIUS_M, ECC, ECC2, SQM_PER_HA

TOLERANCE = 1e-9  # degrees; about a tenth of a millimetre


def cea_y(lat: np.ndarray) -> np.ndarray:
    s = np.sin(np.radians(lat))
    q = (1 - ECC2) * (s / (1 - ECC2 * s * s) - np.log((1 - ECC * s) / (1 + ECC * s)) / (2 * ECC))
    return q * (EARTH_RADIUS_M / 2)


@dataclass
class Edges:
    row: np.ndarray  # pair the edge belongs to, ascending
    ring: np.ndarray
    x0: np.ndarray
    y0: np.ndarray
    x1: np.ndarray
    y1: np.ndarray

    def take(self, keep: np.ndarray) -> "Edges":
        return Edges(*(getattr(self, f)[keep] for f in ("row", "ring", "x0", "y0", "x1", "y1")))


def _edges(s: Shapes, ox: np.ndarray, oy: np.ndarray) -> Edges:
    """Directed edges relative to each pair's origin, exteriors running
    counter-clockwise and holes clockwise whatever the input did."""
    n = np.maximum(s.sizes - 1, 0)
    ring = np.repeat(np.arange(len(n)), n)
    pos = ranges(n)
    wrong = (signed_areas(s) > 0) == s.ring_hole
    back = wrong[ring]
    start = s.ring_at[:-1][ring]
    last = s.sizes[ring] - 1
    i = start + np.where(back, last - pos, pos)
    j = start + np.where(back, last - pos - 1, pos + 1)
    row = s.ring_row[ring]
    e = Edges(row, ring, s.x[i] - ox[row], s.y[i] - oy[row], s.x[j] - ox[row], s.y[j] - oy[row])
    return e.take((e.x0 != e.x1) | (e.y0 != e.y1))


def _row_bounds(s: Shapes):
    """Bounding box of each row; an empty row gets an inverted, infinite box."""
    points = np.bincount(s.ring_row, s.sizes, s.rows).astype(np.int64)
    full = points > 0
    first = offsets(points)[:-1][full]
    out = []
    for v, f, empty in ((s.x, np.minimum, np.inf), (s.y, np.minimum, np.inf),
                        (s.x, np.maximum, -np.inf), (s.y, np.maximum, -np.inf)):
        box = np.full(s.rows, empty)
        if len(first):
            box[full] = f.reduceat(v, first)
        out.append(box)
    return out


def _near_boxes(e: Edges, lo_x, lo_y, hi_x, hi_y, tol: float) -> np.ndarray:
    return (
        (np.maximum(e.x0, e.x1) >= lo_x[e.row] - tol)
        & (np.minimum(e.x0, e.x1) <= hi_x[e.row] + tol)
        & (np.maximum(e.y0, e.y1) >= lo_y[e.row] - tol)
        & (np.minimum(e.y0, e.y1) <= hi_y[e.row] + tol)
    )


def _hashed(row: np.ndarray, values) -> np.ndarray:
    """64-bit hashes of pair numbers and further 64-bit values."""
    h = row.astype(np.uint64)
    for v in (np.uint64(1), *values):
        h = (h ^ v) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _cells(row, x, y, size: float, dx: float, dy: float) -> np.ndarray:
    return _hashed(row, (np.floor(v / size + d).astype(np.int64).view(np.uint64) for v, d in ((x, dx), (y, dy))))


def _onto(row, x, y, to: Edges, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """Points moved to the nearest vertex of ``to`` within one and a half tolerances. What
    stays within a tolerance of an edge is then clearly between its ends."""
    x, y, reach = x.copy(), y.copy(), 1.5 * tol
    best = np.full(len(x), reach * reach)
    ox, oy = x.copy(), y.copy()
    for dx, dy in ((0, 0), (0, 0.5), (0.5, 0), (0.5, 0.5)):  # near points share one of four grids
        cell = _cells(to.row, to.x0, to.y0, 4 * tol, dx, dy)
        order = np.argsort(cell, kind="stable")
        own, ranked = _cells(row, ox, oy, 4 * tol, dx, dy), cell[order]
        first, last = np.searchsorted(ranked, own, "left"), np.searchsorted(ranked, own, "right")
        some = np.flatnonzero(last > first)
        if not len(some):
            continue
        count = (last - first)[some]
        i = np.repeat(some, count)
        j = order[np.repeat(first[some], count) + ranges(count)]
        far = (ox[i] - to.x0[j]) ** 2 + (oy[i] - to.y0[j]) ** 2
        take = np.lexsort((to.y0[j], to.x0[j], far, i))
        i, j, far = i[take], j[take], far[take]
        head = np.ones(len(i), bool)
        head[1:] = i[1:] != i[:-1]
        i, j, far = i[head], j[head], far[head]
        nearer = (far < best[i]) & (row[i] == to.row[j])
        i, j = i[nearer], j[nearer]
        best[i], x[i], y[i] = far[nearer], to.x0[j], to.y0[j]
    return x, y


def _joined(b: Edges, a: Edges, tol: float) -> Edges:
    """B with its vertices on those of A where they are that close."""
    x0, y0 = _onto(b.row, b.x0, b.y0, a, tol)
    x1, y1 = _onto(b.row, b.x1, b.y1, a, tol)
    return Edges(b.row, b.ring, x0, y0, x1, y1).take((x0 != x1) | (y0 != y1))


def _maybe_crossing(e: Edges, n_rows: int) -> np.ndarray:
    """Rows whose boundary might cross itself: all but those of one convex ring."""
    plain = np.ones(n_rows, bool)
    if not len(e.row):
        return ~plain
    start = np.flatnonzero(np.r_[True, e.ring[1:] != e.ring[:-1]])
    count = np.diff(np.append(start, len(e.ring)))
    nxt = np.arange(1, len(e.ring) + 1)
    nxt[np.append(start[1:], len(e.ring)) - 1] = start
    dx, dy = e.x1 - e.x0, e.y1 - e.y0
    turn = dx * dy[nxt] - dy * dx[nxt]
    left, right = np.minimum.reduceat(turn, start) >= 0, np.maximum.reduceat(turn, start) <= 0
    # A convex ring goes right once and left once: two changes of direction
    side = np.where(dx != 0, dx > 0, dy > 0)
    turns = np.add.reduceat((side != side[nxt]).astype(np.int64), start)
    rings = np.bincount(e.row[start], minlength=n_rows)
    plain[e.row[start[~((left | right) & (turns <= 2) & (count > 2))]]] = False
    return ~plain | (rings > 1)


def _valid(e: Edges, n_rows: int, tol: float) -> Edges:
    """Edges of shapes that cross themselves split at the crossings and directed with
    the inside (even-odd) on their left; other shapes as they are."""
    doubt = _maybe_crossing(e, n_rows)[e.row]
    if not doubt.any():
        return e
    d = e.take(doubt)
    lo, hi = np.minimum(d.x0, d.x1), np.maximum(d.x0, d.x1)
    low, high = np.minimum(d.y0, d.y1), np.maximum(d.y0, d.y1)
    cuts, bad = [], np.zeros(n_rows, bool)
    for i, j in overlaps(d.row, lo, hi, d.row, lo, hi):
        near = (i < j) & (low[i] <= high[j]) & (low[j] <= high[i])
        i, j = i[near], j[near]
        rx, ry, sx, sy = d.x1[i] - d.x0[i], d.y1[i] - d.y0[i], d.x1[j] - d.x0[j], d.y1[j] - d.y0[j]
        wx, wy = d.x0[j] - d.x0[i], d.y0[j] - d.y0[i]
        cross = rx * sy - ry * sx
        safe = np.where(cross == 0, 1.0, cross)
        t, u = (wx * sy - wy * sx) / safe, (wx * ry - wy * rx) / safe
        et, eu = tol / np.hypot(rx, ry), tol / np.hypot(sx, sy)
        inside_t, inside_u = (t > et) & (t < 1 - et), (u > eu) & (u < 1 - eu)
        meets = (cross != 0) & (t >= -et) & (t <= 1 + et) & (u >= -eu) & (u <= 1 + eu)
        px, py = d.x0[i] + t * rx, d.y0[i] + t * ry
        # at an end of one edge the crossing is that very vertex
        for end, ex, ey in ((t <= et, d.x0[i], d.y0[i]), (t >= 1 - et, d.x1[i], d.y1[i]),
                            (u <= eu, d.x0[j], d.y0[j]), (u >= 1 - eu, d.x1[j], d.y1[j])):
            px, py = np.where(end, ex, px), np.where(end, ey, py)
        for k, at, own in ((i, t, meets & inside_t), (j, u, meets & inside_u)):
            cuts.append((k[own], at[own], px[own], py[own]))
        bad[d.row[i[meets & inside_t & inside_u]]] = True
        # collinear edges that share more than an end
        flat = (cross == 0) & (np.abs(rx * wy - ry * wx) <= tol * np.hypot(rx, ry))
        for k, m in ((i, j), (j, i)):
            vx, vy = d.x1[k] - d.x0[k], d.y1[k] - d.y0[k]
            for ex, ey in ((d.x0[m], d.y0[m]), (d.x1[m], d.y1[m])):
                at = ((ex - d.x0[k]) * vx + (ey - d.y0[k]) * vy) / (vx * vx + vy * vy)
                own = flat & (at > 0) & (at < 1)
                cuts.append((k[own], at[own], ex[own], ey[own]))
                bad[d.row[k[own]]] = True
        twins = flat & (((d.x0[i] == d.x0[j]) & (d.x1[i] == d.x1[j])) | ((d.x0[i] == d.x1[j]) & (d.x1[i] == d.x0[j])))
        bad[d.row[i[twins]]] = True
    if not bad.any():
        return e
    wrong = bad[d.row]
    number = np.cumsum(wrong) - 1
    cuts = [(number[k[own]], at[own], x[own], y[own]) for k, at, x, y in cuts for own in (wrong[k],)]
    w = d.take(wrong)
    p = _split(w, cuts, np.ones(len(w.row), bool))
    # Pieces that lie on each other cancel in pairs
    flip = (p.x0 > p.x1) | ((p.x0 == p.x1) & (p.y0 > p.y1))
    ends = [np.where(flip, q, r) for q, r in ((p.x1, p.x0), (p.y1, p.y0), (p.x0, p.x1), (p.y0, p.y1))]
    order = np.lexsort((*ends, p.row))
    same = np.ones(len(order), bool)
    same[1:] = np.any([v[order][1:] != v[order][:-1] for v in (*ends, p.row)], axis=0)
    first = np.flatnonzero(same)
    odd = np.diff(np.append(first, len(order))) % 2 == 1
    keep = order[first[odd]]
    row, x0, y0, x1, y1 = (v[keep] for v in (p.row, p.x0, p.y0, p.x1, p.y1))
    # Turned, so that hardly any piece is level; the ray then meets other pieces only
    c, s = np.cos(0.7), np.sin(0.7)
    u0, v0, u1, v1 = c * x0 - s * y0, s * x0 + c * y0, c * x1 - s * y1, s * x1 + c * y1
    mu, mv, hits = (u0 + u1) / 2, (v0 + v1) / 2, np.zeros(len(row), np.int64)
    for i, j in overlaps(row, mv, mv, row, np.minimum(v0, v1), np.maximum(v0, v1)):
        across = (i != j) & ((v0[j] <= mv[i]) != (v1[j] <= mv[i]))
        i, j = i[across], j[across]
        at = u0[j] + (mv[i] - v0[j]) * (u1[j] - u0[j]) / (v1[j] - v0[j])
        hits += np.bincount(i[at > mu[i]], minlength=len(row))
    turn = (hits % 2 == 1) == (v1 > v0)
    x0, x1, y0, y1 = np.where(turn, x1, x0), np.where(turn, x0, x1), np.where(turn, y1, y0), np.where(turn, y0, y1)
    rest = e.take(~bad[e.row])
    ring = np.arange(len(row)) + (e.ring.max(initial=0) + 1)  # each piece for itself
    made = [np.concatenate(v) for v in zip((rest.row, rest.ring, rest.x0, rest.y0, rest.x1, rest.y1), (row, ring, x0, y0, x1, y1))]
    order = np.argsort(made[0], kind="stable")
    return Edges(*(v[order] for v in made))


def _meet(a: Edges, b: Edges, n_rows: int, tol: float):
    """Where edges of A and B meet: split points for both sides, flags for
    vertices lying on the other boundary, and the pairs that touch at all."""
    cuts_a, cuts_b = [], []
    on_a = np.zeros(len(a.row), bool)
    on_b = np.zeros(len(b.row), bool)
    touched = np.zeros(n_rows, bool)

    def vertex_on_edge(p, q, ip, iq, dist, along, length):
        """Start vertex of edge ``p[ip]`` against edge ``q[iq]``."""
        hit = (np.abs(dist) <= tol) & (along >= -tol) & (along <= length + tol)
        x, y = p.x0[ip], p.y0[ip]
        inner = hit & (along > 0) & (along < length)
        inner &= ((x != q.x0[iq]) | (y != q.y0[iq])) & ((x != q.x1[iq]) | (y != q.y1[iq]))
        cut = (iq[inner], (along / length)[inner], p.x0[ip[inner]], p.y0[ip[inner]])
        return ip[hit], cut

    ax0, ax1 = np.minimum(a.x0, a.x1) - tol, np.maximum(a.x0, a.x1) + tol
    ay0, ay1 = np.minimum(a.y0, a.y1) - tol, np.maximum(a.y0, a.y1) + tol
    bx0, bx1 = np.minimum(b.x0, b.x1), np.maximum(b.x0, b.x1)
    by0, by1 = np.minimum(b.y0, b.y1), np.maximum(b.y0, b.y1)
    for i, j in overlaps(a.row, ax0, ax1, b.row, bx0, bx1):
        near = (ay0[i] <= by1[j]) & (by0[j] <= ay1[i])
        i, j = i[near], j[near]
        rx, ry = a.x1[i] - a.x0[i], a.y1[i] - a.y0[i]
        sx, sy = b.x1[j] - b.x0[j], b.y1[j] - b.y0[j]
        la, lb = np.hypot(rx, ry), np.hypot(sx, sy)
        wx, wy = b.x0[j] - a.x0[i], b.y0[j] - a.y0[i]
        # Signed distances of the end points from the other edge's line.
        b0 = (rx * wy - ry * wx) / la
        b1 = (rx * (wy + sy) - ry * (wx + sx)) / la
        a0 = (sy * wx - sx * wy) / lb
        a1 = (sx * (ry - wy) - sy * (rx - wx)) / lb

        hit, cut = vertex_on_edge(b, a, j, i, b0, (rx * wx + ry * wy) / la, la)
        on_b[hit] = True
        cuts_a.append(cut)
        touched[b.row[hit]] = True
        hit, cut = vertex_on_edge(a, b, i, j, a0, -(sx * wx + sy * wy) / lb, lb)
        on_a[hit] = True
        cuts_b.append(cut)
        touched[a.row[hit]] = True

        cross = (
            (np.minimum(np.abs(a0), np.abs(a1)) > tol)
            & (np.minimum(np.abs(b0), np.abs(b1)) > tol)
            & ((a0 > 0) != (a1 > 0))
            & ((b0 > 0) != (b1 > 0))
        )
        t = (a0 / np.where(cross, a0 - a1, 1.0))[cross]
        u = (b0 / np.where(cross, b0 - b1, 1.0))[cross]
        px = a.x0[i[cross]] + t * rx[cross]
        py = a.y0[i[cross]] + t * ry[cross]
        cuts_a.append((i[cross], t, px, py))
        cuts_b.append((j[cross], u, px, py))
        touched[a.row[i[cross]]] = True
    return cuts_a, cuts_b, on_a, on_b, touched


@dataclass
class Pieces:
    row: np.ndarray
    x0: np.ndarray
    y0: np.ndarray
    x1: np.ndarray
    y1: np.ndarray
    run: np.ndarray  # pieces of one run lie on the same side of the other shape
    met: np.ndarray  # the start point lies on the other boundary


def _split(e: Edges, cuts: list, touches: np.ndarray) -> Pieces:
    n = len(e.row)
    index = np.concatenate([np.arange(n), *[c[0] for c in cuts]]).astype(np.int64)
    t = np.concatenate([np.zeros(n), *[c[1] for c in cuts]])
    x = np.concatenate([e.x0, *[c[2] for c in cuts]])
    y = np.concatenate([e.y0, *[c[3] for c in cuts]])
    order = np.lexsort((t, index))
    index, x, y = index[order], x[order], y[order]
    first = np.ones(len(index), bool)
    first[1:] = index[1:] != index[:-1]
    last = np.ones(len(index), bool)
    last[:-1] = first[1:]
    x1, y1 = np.empty_like(x), np.empty_like(y)
    x1[:-1], y1[:-1] = x[1:], y[1:]
    x1[last], y1[last] = e.x1[index[last]], e.y1[index[last]]
    # A run goes on from one edge to the next of the same ring unless the vertex
    # between them lies on the other boundary or a piece was left out before it.
    follows = np.zeros(n, bool)
    follows[1:] = (
        (e.ring[1:] == e.ring[:-1])
        & (e.x0[1:] == e.x1[:-1])
        & (e.y0[1:] == e.y1[:-1])
        & ~touches[1:]
    )
    run = np.cumsum(~(first & follows[index]))
    met = ~first | touches[index]
    keep = (x1 != x) | (y1 != y)
    return Pieces(e.row[index][keep], x[keep], y[keep], x1[keep], y1[keep], run[keep], met[keep])


def _mix(row: np.ndarray, *coordinates: np.ndarray) -> np.ndarray:
    """64-bit mix of pair numbers and coordinates."""
    return _hashed(row, ((v + 0.0).view(np.uint64) for v in coordinates))  # + 0.0: no negative zero


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    table = np.sort(table)
    at = np.searchsorted(table, values)
    return table[np.minimum(at, len(table) - 1)] == values


def _shared(a: Pieces, b: Pieces):
    """Pieces lying on both boundaries: of A running the same way as one of B, of
    A running against one, and of B either way. Such a piece starts at a point
    on both boundaries, which leaves few to compare."""
    ma, mb = a.met, b.met
    fa = _mix(a.row[ma], a.x0[ma], a.y0[ma], a.x1[ma], a.y1[ma])
    fb = _mix(b.row[mb], b.x0[mb], b.y0[mb], b.x1[mb], b.y1[mb])
    rb = _mix(b.row[mb], b.x1[mb], b.y1[mb], b.x0[mb], b.y0[mb])
    same, against, of_b = np.zeros(len(a.row), bool), np.zeros(len(a.row), bool), np.zeros(len(b.row), bool)
    same[ma], against[ma] = _among(fa, fb), _among(fa, rb)
    of_b[mb] = _among(fb, fa) | _among(rb, fa)
    return same, against, of_b


def _inside(p: Pieces, other: Edges, n_rows: int) -> np.ndarray:
    """Even-odd test of one midpoint per run against the other shape."""
    if len(p.row) == 0:
        return np.zeros(0, bool)
    # The longest piece of a run gives the midpoint furthest from any boundary.
    length = np.hypot(p.x1 - p.x0, p.y1 - p.y0)
    order = np.lexsort((-length, p.run))
    head = np.ones(len(order), bool)
    head[1:] = p.run[order][1:] != p.run[order][:-1]
    rep = order[head]
    mx, my, row = (p.x0[rep] + p.x1[rep]) / 2, (p.y0[rep] + p.y1[rep]) / 2, p.row[rep]
    odd = np.zeros(len(rep), np.int64)
    for i, j in overlaps(row, my, my, other.row, np.minimum(other.y0, other.y1), np.maximum(other.y0, other.y1)):
        across = (other.y0[j] <= my[i]) != (other.y1[j] <= my[i])
        i, j = i[across], j[across]
        at = other.x0[j] + (my[i] - other.y0[j]) * (other.x1[j] - other.x0[j]) / (other.y1[j] - other.y0[j])
        odd += np.bincount(i[at > mx[i]], minlength=len(rep))
    runs = p.run[rep]
    return (odd % 2 == 1)[np.searchsorted(runs, p.run)]


def _kept(a: Edges, b: Edges, full_a: Edges, full_b: Edges, n_rows: int, tol: float):
    cuts_a, cuts_b, on_a, on_b, touched = _meet(a, b, n_rows, tol)
    pa_, pb = _split(a, cuts_a, on_a), _split(b, cuts_b, on_b)
    same_a, against_a, shared_b = _shared(pa_, pb)
    keep_a = same_a | (~against_a & _own_run(pa_, same_a | against_a, full_b, n_rows))
    keep_b = ~shared_b & _own_run(pb, shared_b, full_a, n_rows)
    out = [np.concatenate([getattr(pa_, f)[keep_a], getattr(pb, f)[keep_b]])
           for f in ("row", "x0", "y0", "x1", "y1")]
    return out, touched


def _own_run(p: Pieces, shared: np.ndarray, other: Edges, n_rows: int) -> np.ndarray:
    """Side of each piece that is not shared; shared pieces stay out of it."""
    free = ~shared
    side = np.zeros(len(p.row), bool)
    rest = Pieces(*(getattr(p, f)[free] for f in ("row", "x0", "y0", "x1", "y1", "run", "met")))
    side[free] = _inside(rest, other, n_rows)
    return side


def _assemble(x0, y0, x1, y1) -> list:
    """Directed pieces of one pair to closed rings, by matching end points.
    A walk that comes back to a point it has passed closes a ring there."""
    starts, ends = list(zip(x0.tolist(), y0.tolist())), list(zip(x1.tolist(), y1.tolist()))
    out_of: dict = {}
    for i, s in enumerate(starts):
        out_of.setdefault(s, []).append(i)
    rings = []
    for seed in range(len(starts)):
        if seed not in out_of.get(starts[seed], ()):
            continue
        walk, seen, at = [], {}, starts[seed]
        while out_of.get(at):
            seen[at] = len(walk)
            i = out_of[at].pop()
            walk.append(i)
            at = ends[i]
            if at in seen:
                loop, walk = walk[seen[at]:], walk[: seen[at]]
                for k in loop:
                    seen.pop(starts[k], None)
                pts = [(x0[k], y0[k]) for k in loop]
                if len(pts) > 2:
                    rings.append(np.array([*pts, pts[0]]))
    return rings


def _ring_area(xy: np.ndarray) -> float:
    x, y = xy[:, 0] - xy[0, 0], xy[:, 1] - xy[0, 1]
    return float(np.sum(x[:-1] * y[1:] - x[1:] * y[:-1]) / 2)


def _holds(outer: np.ndarray, x: float, y: float) -> bool:
    x0, y0, x1, y1 = outer[:-1, 0], outer[:-1, 1], outer[1:, 0], outer[1:, 1]
    across = (y0 <= y) != (y1 <= y)
    at = x0[across] + (y - y0[across]) * (x1[across] - x0[across]) / (y1[across] - y0[across])
    return bool(np.sum(at > x) % 2)


def _as_rings(loops: list) -> list:
    """Number exteriors as parts and give each hole to the smallest exterior
    around it."""
    sized = [(_ring_area(xy), xy) for xy in loops]
    outer = sorted((s for s in sized if s[0] > 0), key=lambda s: s[0])
    out = [[(i, False, xy)] for i, (_, xy) in enumerate(outer)]
    for area, xy in sized:
        if area < 0:
            mx, my = (xy[0] + xy[1]) / 2
            for i, (_, shell) in enumerate(outer):
                if _holds(shell, mx, my):
                    out[i].append((i, True, xy))
                    break
    return [ring for part in out for ring in part]


def _cycles(nxt: np.ndarray):
    """Smallest member of each piece's cycle, and steps to the cycle's last piece.
    Both by pointer doubling, so a ring of n pieces takes log n rounds."""
    label, jump = np.arange(len(nxt)), nxt
    while True:
        lower = np.minimum(label, label[jump])
        if np.array_equal(lower, label):
            break
        label, jump = lower, jump[jump]
    last = nxt == label
    jump = np.where(last, np.arange(len(nxt)), nxt)
    steps = np.where(last, 0, 1)
    while not last[jump].all():
        steps = steps + steps[jump]
        jump = jump[jump]
    return label, steps


def _link(row, x0, y0, x1, y1, n_rows: int):
    """Next piece of every piece, and the rows where that is not one to one
    because the boundary touches itself."""
    start, end = _mix(row, x0, y0), _mix(row, x1, y1)
    tangled = np.zeros(n_rows, bool)
    order = np.argsort(start, kind="stable")
    ranked = start[order]
    tangled[row[order[1:]][ranked[1:] == ranked[:-1]]] = True
    by_end = np.argsort(end, kind="stable")
    tangled[row[by_end[1:]][end[by_end][1:] == end[by_end][:-1]]] = True
    at = np.minimum(np.searchsorted(ranked, end), max(len(ranked) - 1, 0))
    tangled[row[ranked[at] != end]] = True
    return order[at], tangled


def _stitch(row, x0, y0, x1, y1, n_rows: int) -> Shapes:
    """Kept pieces of all pairs to closed rings."""
    order = np.argsort(row, kind="stable")
    row, x0, y0, x1, y1 = (v[order] for v in (row, x0, y0, x1, y1))
    nxt, tangled = _link(row, x0, y0, x1, y1, n_rows)
    plain = np.flatnonzero(~tangled[row])
    number = np.zeros(len(row), np.int64)
    number[plain] = np.arange(len(plain))
    label, steps = _cycles(number[nxt[plain]])
    walk = np.lexsort((-steps, label))
    piece, label = plain[walk], label[walk]
    head = np.ones(len(label), bool)
    head[1:] = label[1:] != label[:-1]
    count = np.diff(np.append(np.flatnonzero(head), len(label)))
    first = np.cumsum(count) - count
    long = count > 2
    count, first = count[long], first[long]
    take = piece[np.repeat(first, count + 1) + ranges(count + 1) % np.repeat(np.maximum(count, 1), count + 1)]
    ring_row = row[piece[first]]
    rings = Shapes(n_rows, ring_row, np.zeros(len(count), np.int32), np.zeros(len(count), bool),
                   offsets(count + 1), x0[take], y0[take])
    per_row = np.bincount(ring_row, minlength=n_rows)
    rings.ring_part = ranges(per_row[per_row > 0]).astype(np.int32)
    # Boundaries that touch themselves and shapes with holes need the slow walk.
    slow = tangled.copy()
    slow[ring_row[signed_areas(rings) < 0]] = True
    if not slow.any():
        return rings
    rings = _without(rings, slow)
    at = np.searchsorted(row, np.arange(n_rows + 1))
    shapes: list = [None] * n_rows
    for i in np.flatnonzero(slow):
        k = slice(at[i], at[i + 1])
        shapes[i] = _as_rings(_assemble(x0[k], y0[k], x1[k], y1[k]))
    return stack(rings, from_rows(shapes)[0])


def _without(s: Shapes, rows: np.ndarray) -> Shapes:
    keep = ~rows[s.ring_row]
    points = np.repeat(keep, s.sizes)
    return Shapes(s.rows, s.ring_row[keep], s.ring_part[keep], s.ring_hole[keep],
                  offsets(s.sizes[keep]), s.x[points], s.y[points])


def intersect(left: pa.Array, right: pa.Array, with_geometry: bool, tol: float = TOLERANCE) -> pa.StructArray:
    """struct(hit, area_ha, area_deg, residual[, rings]) for each pair of packed
    shapes.

    ``hit`` is the closed intersects test, ``residual`` the closure error of the
    kept boundary in degrees: clearly above ``tol`` only for invalid input.
    """
    sa, sb = unpack_shapes(left), unpack_shapes(right)
    n = sa.rows
    xa0, ya0, xa1, ya1 = _row_bounds(sa)
    xb0, yb0, xb1, yb1 = _row_bounds(sb)
    ox, oy = np.maximum(xa0, xb0), np.maximum(ya0, yb0)
    ox, oy = np.where(np.isfinite(ox), ox, 0.0), np.where(np.isfinite(oy), oy, 0.0)
    full_a, full_b = (_valid(_edges(s, ox, oy), n, tol) for s in (sa, sb))
    # Only the part of a boundary near the other shape's box can matter; the box is that
    # of the shape before its vertices moved.
    a = full_a.take(_near_boxes(full_a, xb0 - ox, yb0 - oy, xb1 - ox, yb1 - oy, 4 * tol))
    full_b = _joined(full_b, a, tol)
    b = full_b.take(_near_boxes(full_b, xa0 - ox, ya0 - oy, xa1 - ox, ya1 - oy, 4 * tol))
    (row, x0, y0, x1, y1), touched = _kept(a, b, full_a, full_b, n, tol)

    hit = touched.copy()
    hit[row] = True
    lat0 = cea_y(oy)[row]
    px0, px1 = np.radians(x0) * EARTH_RADIUS_M, np.radians(x1) * EARTH_RADIUS_M
    py0, py1 = cea_y(y0 + oy[row]) - lat0, cea_y(y1 + oy[row]) - lat0
    area = np.bincount(row, px0 * py1 - px1 * py0, n) / 2
    flat = np.bincount(row, x0 * y1 - x1 * y0, n) / 2
    gap = np.maximum(np.abs(np.bincount(row, x1 - x0, n)), np.abs(np.bincount(row, y1 - y0, n)))
    columns = {
        "hit": pa.array(hit),
        "area_ha": pa.array(area / SQM_PER_HA),
        "area_deg": pa.array(flat),
        "residual": pa.array(gap),
    }
    if with_geometry:
        rings = _stitch(row, x0, y0, x1, y1, n)
        at = np.repeat(rings.ring_row, rings.sizes)
        rings.x, rings.y = rings.x + ox[at], rings.y + oy[at]
        columns["rings"] = to_arrow(rings)
    return pa.StructArray.from_arrays(list(columns.values()), names=list(columns))
