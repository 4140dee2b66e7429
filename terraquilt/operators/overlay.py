"""Joins on geometry: overlay with clipping, intersects, within a place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraquilt.functions.codec import clip
from terraquilt.functions.geom import bbox_of, pack_shape
from terraquilt.functions.kernel import TOLERANCE
from terraquilt.model import GDA94, WGS84
from terraquilt.operators.areas import pair_sums, plain_edges
from terraquilt.operators.cells import cell_pairs
from terraquilt.operators.cover import meeting_pairs, points_within, shapes_within
from terraquilt.operators.windows import (
    BROADCAST_BYTES,
    levels_for,
    measure,
    window_pairs,
)

DEFAULT_CELL = 0.5
GEOMETRY = ("rings", "bbox")


def _attributes(df: DataFrame) -> list:
    return [c for c in df.columns if c not in GEOMETRY]


def check_systems(left: DataFrame, right: DataFrame) -> None:
    """Both layers have to be in one system, as far as they name it; the degrees of WGS84
    and GDA94 are taken as equal."""
    named = [layer.schema["rings"].metadata.get("srid") for layer in (left, right)]
    same = [WGS84 if s == GDA94 else s for s in named if s is not None]
    if len(set(same)) > 1:
        raise ValueError(f"the layers' coordinate systems differ: {named[0]} and {named[1]}")


def _sides(left: DataFrame, right: DataFrame, edges: bool = False, upright: bool = True) -> tuple[DataFrame, DataFrame]:
    """Geometry packed and named l_*/r_*; attribute names that differ at most in
    case get the suffixes _1 and _2, since Spark cannot tell them apart."""
    shared = {c.lower() for c in _attributes(left)} & {c.lower() for c in _attributes(right)}
    out = []
    for df, side, suffix in ((left, "l", "_1"), (right, "r", "_2")):
        out.append(
            df.select(
                *[
                    F.col(f"`{c}`").alias(c + suffix if c.lower() in shared else c)
                    for c in _attributes(df)
                ],
                pack_shape(F.col("rings")).alias(f"{side}_shape"),
                F.col("bbox").alias(f"{side}_bbox"),
                *([plain_edges(F.col("rings"), upright).alias(f"{side}_edges")] if edges else []),
            )
        )
    return out[0], out[1]


def _pairs(left: DataFrame, right: DataFrame, cell: float, broadcast_left: bool | None, edges: bool = False,
           upright: bool = True) -> DataFrame:
    """Candidate pairs. The left layer is the one that may be small: it is
    measured, and broadcast only if its windows fit. Otherwise, or when the caller
    knows that both sides are large, both are shuffled by cell."""
    check_systems(left, right)
    l, r = _sides(left, right, edges, upright)
    if broadcast_left is not False:
        levels = levels_for(r, cell)
        district = measure(l, cell, levels)
        if broadcast_left or district.bytes <= BROADCAST_BYTES:
            return window_pairs(l, r, cell, levels, district.cut)
    return cell_pairs(l, r, cell)


def overlay_intersection(
    left: DataFrame,
    right: DataFrame,
    keep_geom_type: bool = True,
    with_geometry: bool = False,
    cell: float = DEFAULT_CELL,
    broadcast_left: bool | None = None,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """One row per intersecting pair with the attributes of both and ``area_ha``,
    ``area_deg`` and ``residual`` of the clipped shape.

    ``keep_geom_type=False`` also keeps pairs that only touch, with area 0;
    ``with_geometry`` adds the clipped ``rings`` and ``bbox``, which makes the
    result a layer again. Shapes are intersected in degrees and the vertices
    projected afterwards.
    """
    pairs = _pairs(left, right, cell, broadcast_left)
    clipped = pairs.withColumn(
        "clip", clip(F.col("l_shape"), F.col("r_shape"), with_geometry, tolerance)
    )
    keep = F.col("clip.hit")
    if keep_geom_type:
        keep = keep & (F.col("clip.area_deg") > 0)
    out = clipped.where(keep).drop("l_shape", "r_shape", "l_bbox", "r_bbox")
    out = out.select(*[F.col(f"`{c}`") for c in out.columns if c != "clip"], "clip.*").drop("hit")
    return out.withColumn("bbox", bbox_of(F.col("rings"))) if with_geometry else out


def overlay_sums(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    sums: tuple[str, ...] = (),
    touching: bool | None = True,
    cell: float = DEFAULT_CELL,
    broadcast_left: bool | None = None,
) -> DataFrame:
    """What `overlay_intersection` gives, summed by keys: ``pairs``, ``area_ha``, ``area_deg`` and sums of further columns. Areas are
    sums over edge rows (`areas`). touching: whether pairs that only touch count as pairs; None where neither their number
    matters nor groups of them, which may then be there or not, with next to no area."""
    # Shapes for which edge rows don't do are rare; one look at each layer spares the others the way through Python.
    plain = [df.where((F.size("rings") > 0) & plain_edges(F.col("rings")).isNull()).isEmpty() for df in (left, right)]
    # Upright edges only matter to whether shapes touch.
    return pair_sums(_pairs(left, right, cell, broadcast_left, True, bool(touching)), keys, list(sums), touching, all_plain=all(plain))


def spatial_join(left: DataFrame, right: DataFrame, l_id: str, r_id: str, predicate: str = "intersects",
                 cell: float = DEFAULT_CELL) -> DataFrame:
    """Ids of every pair of shapes that share at least a point."""
    if predicate != "intersects":
        raise ValueError("only 'intersects' is supported")
    check_systems(left, right)
    return meeting_pairs(left, right, l_id, r_id, cell)


def within_place(df: DataFrame, place: DataFrame, row_id: str, lon: str = "x", lat: str = "y",
                 cell: float = DEFAULT_CELL) -> DataFrame:
    """Keep the features of a point table, or of a layer of any shapes (``rings`` or ``paths``), that share a
    point with a place."""
    if "rings" in df.columns or "paths" in df.columns:
        return shapes_within(df, place, row_id, cell)
    return points_within(df, place, lon, lat, cell)


def intersection_by(left: DataFrame, right: DataFrame, keys: list[str], cell: float = DEFAULT_CELL) -> DataFrame:
    """Shared area and number of pairs per group."""
    sums = overlay_sums(left, right, keys, cell=cell)
    return sums.select(*keys, F.col("pairs").alias("PAIRS"), F.col("area_ha").alias("AREAHA"))
