"""Arrow functions for what Columns cannot express: binary geometry, line
simplification and the overlay of a pair."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraquilt.functions.edges import meet, plain_edges
from terraquilt.functions.kernel import TOLERANCE, intersect
from terraquilt.functions.packed import Shapes, from_rows, offsets, oriented, stack, to_arrow, unpack
from terraquilt.functions.thin import simplified
from terraquilt.model import RINGS

# Fixed values of the WKB format.
_WKB_POINT, _WKB_LINE, _WKB_POLYGON = 1, 2, 3
_WKB_MULTIPOINT, _WKB_MULTILINE, _WKB_MULTIPOLYGON, _WKB_COLLECTION = 4, 5, 6, 7


# The functions below are marked non-deterministic. They are not, but Spark would
# otherwise push a filter on their result beneath them and run them twice.


# --- WKB ---------------------------------------------------------------------

def _read_wkb(blob: bytes) -> list:
    """Bytes to (part, hole, xy) rings of all polygons in them. Extra dimensions are
    dropped; points and lines give no rings; what isn't a geometry raises."""
    out: list = []
    parts = 0

    def shape(at: int) -> int:
        nonlocal parts
        if blob[at] > 1:
            raise ValueError("not a geometry: its byte order is neither 0 nor 1")
        order = "<" if blob[at] else ">"
        (code,) = struct.unpack_from(order + "I", blob, at + 1)
        at += 5
        extra = code & 0xE0000000  # flag bits of the extended form
        if extra & 0x20000000:
            at += 4  # embedded SRID
        code &= 0x1FFFFFFF
        dims = 2 + bool(extra & 0x80000000) + bool(extra & 0x40000000)
        dims += {0: 0, 1: 1, 2: 1, 3: 2}[code // 1000]
        kind = code % 1000
        if kind == _WKB_POINT:
            return at + 8 * dims
        if not _WKB_LINE <= kind <= _WKB_COLLECTION:
            raise ValueError(f"not a geometry: type {code}")
        (count,) = struct.unpack_from(order + "I", blob, at)
        at += 4
        if kind == _WKB_LINE:
            return at + 8 * count * dims
        for i in range(count):
            if kind != _WKB_POLYGON:
                at = shape(at)
                continue
            (n,) = struct.unpack_from(order + "I", blob, at)
            xy = np.frombuffer(blob, order + "f8", n * dims, at + 4).reshape(n, dims)
            at += 4 + 8 * n * dims
            if n:
                out.append((parts, i > 0, xy[:, :2].astype(float)))
        parts += kind == _WKB_POLYGON and count > 0
        return at

    if shape(0) > len(blob):
        raise ValueError("not a geometry: its bytes end too soon")
    return out


def _or_empty(blob: bytes) -> list:
    try:
        return _read_wkb(blob)
    except (ValueError, IndexError, struct.error):
        return []


def _write_wkb(rings: list) -> bytes:
    """(part, hole, xy) rings to little-endian WKB; one part is a polygon."""
    parts: dict = {}
    for part, hole, xy in rings:
        parts.setdefault(part, []).append(xy)

    def polygon(shells: list) -> bytes:
        head = struct.pack("<BII", 1, _WKB_POLYGON, len(shells))
        return head + b"".join(
            struct.pack("<I", len(xy)) + np.ascontiguousarray(xy, "<f8").tobytes() for xy in shells
        )

    if len(parts) <= 1:
        return polygon(next(iter(parts.values()), []))
    head = struct.pack("<BII", 1, _WKB_MULTIPOLYGON, len(parts))
    return head + b"".join(polygon(shells) for shells in parts.values())


def _rows(rings: pa.Array) -> list:
    """Each row as None or a list of (part, hole, xy)."""
    s = unpack(rings)
    out: list = [[] for _ in range(s.rows)]
    for i, row in enumerate(s.ring_row):
        lo, hi = s.ring_at[i], s.ring_at[i + 1]
        out[row].append((int(s.ring_part[i]), bool(s.ring_hole[i]), np.column_stack([s.x[lo:hi], s.y[lo:hi]])))
    for row in np.flatnonzero(rings.is_null().to_numpy(zero_copy_only=False)):
        out[row] = None
    return out


# Most blobs are a polygon of one ring in little-endian order: a header of 13 bytes, then the points.
_HEAD, _POINT_BYTES = 13, 16
_ONE_RING = np.frombuffer(struct.pack("<BII", 1, _WKB_POLYGON, 1), np.uint8)


def _marked(size: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of so many bytes lie in runs that don't overlap."""
    step = np.zeros(size + 1, np.int8)
    np.add.at(step, begin, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1], dtype=np.int8).astype(bool)


def _one_ring_shapes(blobs: pa.Array) -> tuple[Shapes, np.ndarray]:
    """The blobs that are polygons of one ring, read together from Arrow's buffers, and which rows they are."""
    wide = blobs.cast(pa.large_binary())
    at = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(wide.buffers()[2] or b"", np.uint8)
    size = np.diff(at)
    rows = np.flatnonzero((size > _HEAD) & ((size - _HEAD) % _POINT_BYTES == 0) & wide.is_valid().to_numpy(zero_copy_only=False))
    head = data[at[rows][:, None] + np.arange(_HEAD)] if len(rows) else np.zeros((0, _HEAD), np.uint8)
    points = np.ascontiguousarray(head[:, len(_ONE_RING) :]).view("<u4").reshape(-1)
    rows = rows[(head[:, : len(_ONE_RING)] == _ONE_RING).all(1) & (points == (size[rows] - _HEAD) // _POINT_BYTES)]
    xy = data[_marked(len(data), at[rows] + _HEAD, at[rows] + size[rows])].view("<f8").reshape(-1, 2)
    none = np.zeros(len(rows), np.int32)
    return Shapes(len(wide), rows, none, none.astype(bool), offsets((size[rows] - _HEAD) // _POINT_BYTES), xy[:, 0], xy[:, 1]), rows


def _decoded(blobs: pa.Array, read) -> pa.Array:
    simple, rows = _one_ring_shapes(blobs)
    other = np.ones(len(blobs), bool)
    other[rows] = False
    null = blobs.is_null().to_numpy(zero_copy_only=False)
    rest: list = [None] * len(blobs)
    for i in np.flatnonzero(other & ~null):
        rest[i] = read(blobs[int(i)].as_py())
    return to_arrow(oriented(stack(simple, from_rows(rest)[0])), null)


def _one_ring_blobs(s: Shapes) -> tuple[pa.Array, np.ndarray]:
    """Blobs of the rows with one ring, the others null, and which rows have other numbers of rings."""
    count = np.bincount(s.ring_row, minlength=s.rows)
    ring = count[s.ring_row] == 1
    row, points = s.ring_row[ring], s.sizes[ring]
    size = np.zeros(s.rows, np.int64)
    size[row] = _HEAD + _POINT_BYTES * points
    at = offsets(size)
    data = np.empty(at[-1], np.uint8)
    data[at[row][:, None] + np.arange(len(_ONE_RING))] = _ONE_RING
    data[at[row][:, None] + np.arange(len(_ONE_RING), _HEAD)] = points.astype("<u4").view(np.uint8).reshape(-1, 4)
    own = np.repeat(ring, s.sizes)
    xy = np.column_stack([s.x[own], s.y[own]]).astype("<f8")
    data[_marked(len(data), at[row] + _HEAD, at[row] + size[row])] = np.ascontiguousarray(xy).view(np.uint8).reshape(-1)
    valid = pa.py_buffer(np.packbits(count == 1, bitorder="little").tobytes())
    blobs = pa.Array.from_buffers(pa.large_binary(), s.rows, [valid, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())])
    return blobs, np.flatnonzero(count != 1)


@F.arrow_udf(RINGS)
def _wkb_to_rings(blobs: pa.Array) -> pa.Array:
    return _decoded(blobs, _read_wkb)


@F.arrow_udf(RINGS)
def _wkb_to_rings_or_empty(blobs: pa.Array) -> pa.Array:
    return _decoded(blobs, _or_empty)


@F.arrow_udf(T.BinaryType())
def _rings_to_wkb(rings: pa.Array) -> pa.Array:
    blobs, other = _one_ring_blobs(unpack(rings))
    rest: list = [None] * len(rings)
    for i, shape in zip(other, _rows(rings.take(pa.array(other)))):
        rest[i] = None if shape is None else _write_wkb(shape)
    return pc.coalesce(blobs, pa.array(rest, pa.large_binary())).cast(pa.binary())


def rings_from_wkb(wkb: Column, lenient: bool = False) -> Column:
    """WKB to normalised rings of the polygons in it. What isn't a geometry raises, or with
    ``lenient`` gives no rings."""
    return (_wkb_to_rings_or_empty if lenient else _wkb_to_rings).asNondeterministic()(wkb)


def to_wkb(rings: Column) -> Column:
    return _rings_to_wkb.asNondeterministic()(rings)


# --- simplification ----------------------------------------------------------

def simplify(rings: Column, tolerance: float = 0.001) -> Column:
    """Fewer points, none further than ``tolerance`` degrees from the old line.
    A ring that would collapse or cross itself is left as it was."""
    @F.arrow_udf(RINGS)
    def run(shapes: pa.Array) -> pa.Array:
        null = shapes.is_null().to_numpy(zero_copy_only=False)
        return to_arrow(simplified(unpack(shapes), tolerance), null)

    return run.asNondeterministic()(rings)


# --- edges -------------------------------------------------------------------

def edges_of(shape: Column, most: int) -> Column:
    """The directed edges of a packed shape of at most `most` edges that doesn't cross or touch itself; null for others."""
    @F.arrow_udf("array<struct<x0: double, y0: double, x1: double, y1: double>>")
    def run(shapes: pa.Array) -> pa.Array:
        return plain_edges(shapes, most)

    return run.asNondeterministic()(shape)


def edges_meet(left: Column, right: Column) -> Column:
    """Whether two plain shapes, given by their edges, share a point."""
    @F.arrow_udf("boolean")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return meet(a, b)

    return run.asNondeterministic()(left, right)


# --- overlay of a pair -------------------------------------------------------

def clip(left: Column, right: Column, with_geometry: bool = False, tolerance: float = TOLERANCE) -> Column:
    """struct(hit, area_ha, area_deg, residual[, rings]) of the intersection of
    two packed shapes (``geom.pack_shape``)."""
    result = T.StructType().add("hit", T.BooleanType())
    for name in ("area_ha", "area_deg", "residual"):
        result = result.add(name, T.DoubleType())
    if with_geometry:
        result = result.add("rings", RINGS)

    @F.arrow_udf(result)
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return intersect(a, b, with_geometry, tolerance)

    return run.asNondeterministic()(left, right)
