"""Joining a large layer to a district layer that fits in memory.

Every shape of the large layer falls in exactly one window: the cell of its lower
left corner, on the grid level whose cells are at least as wide as the shape. A
window spans two cells each way, so the whole shape lies inside it. District
polygons are listed under the windows they meet, and large ones are cut to them,
so a pair carries the few vertices near the shape and not a coastline. Cutting
does not change the answer: the cut lines lie outside every shape that uses the
window.

The large layer is neither copied nor shuffled, and each pair appears once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraquilt.functions.codec import clip
from terraquilt.functions.geom import bbox_of, pack_shape
from terraquilt.operators.areas import plain_edges

BROADCAST_BYTES = 128 * 1024 * 1024
CUT_NUMBERS = 400  # packed length (about 200 points) from which cutting pays
LADDER = 8  # large polygons are cut to windows this much wider first
MARGIN = 1e-6  # degrees a window reaches beyond its cells
ROW_BYTES = 300


@dataclass
class District:
    """Measured facts about a district layer, from one aggregate over it."""

    windows: int
    numbers: int
    largest: int

    @property
    def cut(self) -> bool:
        return self.largest > CUT_NUMBERS

    @property
    def bytes(self) -> int:
        return ROW_BYTES * self.windows + 8 * self.numbers


def extent(bbox: Column) -> Column:
    return F.greatest(bbox["xmax"] - bbox["xmin"], bbox["ymax"] - bbox["ymin"])


def levels_for(right: DataFrame, cell: float) -> int:
    """Number of grid levels the shapes of the large layer need."""
    widest = right.agg(F.max(extent(F.col("r_bbox")))).first()[0] or 0.0
    return 1 + max(0, math.ceil(math.log2(widest / cell))) if widest > 0 else 1


def _run(bbox: Column, lo: str, hi: str, size: Column, span: int) -> tuple[Column, Column]:
    return F.ceil(bbox[lo] / size) - span, F.floor(bbox[hi] / size)


def _size(level: Column, cell: float) -> Column:
    return F.pow(F.lit(2.0), level) * cell


def measure(left: DataFrame, cell: float, levels: int, span: int = 2) -> District:
    """Windows a layer needs, and a bound on the numbers its pieces hold: uncut
    shapes repeat in each window, cut ones hold each vertex at most span² times a
    level, twice that with the vertices the cuts add."""
    box, numbers = F.col("l_bbox"), F.size("l_shape").cast("bigint")
    if "l_edges" in left.columns:
        numbers = numbers + 6 * F.coalesce(F.size("l_edges"), F.lit(0))

    def count(level: Column) -> Column:
        size = _size(level, cell)
        (x0, x1), (y0, y1) = _run(box, "xmin", "xmax", size, span), _run(box, "ymin", "ymax", size, span)
        return (x1 - x0 + 1) * (y1 - y0 + 1)

    windows = F.aggregate(
        F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), count), F.lit(0).cast("bigint"), lambda a, n: a + n
    )
    held = F.when(numbers > CUT_NUMBERS, numbers * (2 * span * span * levels)).otherwise(windows * numbers)
    row = (
        left.select(windows.alias("w"), held.alias("h"), numbers.alias("n"))
        .agg(F.sum("w"), F.sum("h"), F.max("n"))
        .first()
    )
    return District(*[int(v or 0) for v in row])


def _window(cx: Column, cy: Column, size: Column, span: int) -> Column:
    """The packed rectangle of a window."""
    x0, y0 = cx * size - MARGIN, cy * size - MARGIN
    x1, y1 = (cx + span) * size + MARGIN, (cy + span) * size + MARGIN
    head = [F.lit(v) for v in (1.0, 5.0, 0.0)]
    return F.array(*head, x0, y0, x1, y0, x1, y1, x0, y1, x0, y0)


def _cut(rows: DataFrame, size: Column, span: int) -> DataFrame:
    """Replace large shapes by their part inside the row's window; windows such
    a shape does not reach drop out."""
    large = F.size("l_shape") > CUT_NUMBERS
    rows = rows.withColumn(
        "piece", clip(F.when(large, F.col("l_shape")), _window(F.col("cx"), F.col("cy"), size, span), True)
    )
    rows = rows.where(~large | (F.col("piece.area_deg") > 0)).withColumn("rings", F.col("piece.rings"))
    if "l_edges" in rows.columns:
        rows = rows.withColumn("l_edges", F.when(large, plain_edges(F.col("rings"))).otherwise(F.col("l_edges")))
    return rows.withColumns(
        {
            "l_bbox": F.when(large, bbox_of(F.col("rings"))).otherwise(F.col("l_bbox")),
            "l_shape": F.when(large, pack_shape(F.col("rings"))).otherwise(F.col("l_shape")),
        }
    ).drop("piece", "rings")


def window_rows(left: DataFrame, cell: float, levels: int, cut: bool, span: int = 2) -> DataFrame:
    """District shapes by window (``lv``, ``cx``, ``cy``)."""
    rows = left.withColumn("lv", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    size = _size(F.col("lv"), cell)
    box = F.col("l_bbox")

    def listed(df: DataFrame, width: Column, reach: int) -> DataFrame:
        xs = F.sequence(*_run(box, "xmin", "xmax", width, reach))
        ys = F.sequence(*_run(box, "ymin", "ymax", width, reach))
        return df.withColumn("cx", F.explode(xs)).withColumn("cy", F.explode(ys))

    if not cut:
        return listed(rows, size, span)
    # Wide windows first, so that a long boundary is not carried into each small
    # one. A small window lies inside the wide window its number falls in.
    wide = _cut(listed(rows, size * LADDER, span), size * LADDER, span)
    wide = wide.withColumnsRenamed({"cx": "wx", "cy": "wy"}).repartition("lv", "wx", "wy")

    def children(parent: str, lo: str, hi: str) -> Column:
        first, last = _run(box, lo, hi, size, span)
        low = F.greatest(first, F.col(parent) * LADDER)
        high = F.least(last, F.col(parent) * LADDER + LADDER - 1)
        return F.when(low <= high, F.sequence(low, high))

    small = wide.withColumn("cx", F.explode(children("wx", "xmin", "xmax")))
    small = small.withColumn("cy", F.explode(children("wy", "ymin", "ymax")))
    return _cut(small.drop("wx", "wy"), size, span)


def window_pairs(left: DataFrame, right: DataFrame, cell: float, levels: int, cut: bool) -> DataFrame:
    """Pairs of overlapping boxes. ``left`` must have been measured to fit."""
    rows = F.broadcast(window_rows(left, cell, levels, cut))
    lb, rb = F.col("l_bbox"), F.col("r_bbox")
    level = F.lit(0)
    if levels > 1:
        # Rounding in the logarithm must not name a level that was not listed.
        level = F.ceil(F.log2(extent(rb) / cell)).cast("int")
        level = F.least(F.greatest(level, F.lit(0)), F.lit(levels - 1))
        level = F.when(extent(rb) > 0, level).otherwise(0)
    size = _size(level, cell)
    on = (
        (F.col("lv") == level)
        & (F.col("cx") == F.floor(rb["xmin"] / size))
        & (F.col("cy") == F.floor(rb["ymin"] / size))
        & (lb["xmin"] <= rb["xmax"])
        & (rb["xmin"] <= lb["xmax"])
        & (lb["ymin"] <= rb["ymax"])
        & (rb["ymin"] <= lb["ymax"])
    )
    return rows.join(right, on).drop("lv", "cx", "cy")
