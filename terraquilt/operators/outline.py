"""Outlines of groups of polygons that don't overlap: what two neighbours share cancels.

Polygons keep their inside on the left, so an edge that two of them share is passed in both directions. Edges become rows;
those of a group that lie on one line meet, whatever their lengths are, and each adds 1 or -1 to what is passed between its
ends. A running sum along the line says where that is not 0: there the outline runs. Lines are the shuffle key, so no task
holds a group; a group's area and length are sums over its edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Decimals to which edges of one line agree in direction and place.
DECIMALS = 9


def _edges(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x0, y0, x1, y1 of every edge, from left to right (upwards if vertical), and way, 1 where it is passed so, else -1."""
    pts = F.col("r.pts")
    steps = F.transform(pts, lambda q, i: F.struct(F.get(pts, i - 1).alias("p"), q.alias("q")))
    rows = df.select(*keys, F.explode("rings").alias("r")).select(*keys, F.explode(steps).alias("s"))
    p, q = F.col("s.p"), F.col("s.q")
    rows = rows.where(p.isNotNull() & (p != q))
    turned = (p["x"] > q["x"]) | ((p["x"] == q["x"]) & (p["y"] > q["y"]))

    def pick(a: Column, b: Column) -> Column:
        return F.when(turned, b).otherwise(a)

    ends = {"x0": pick(p["x"], q["x"]), "y0": pick(p["y"], q["y"]), "x1": pick(q["x"], p["x"]), "y1": pick(q["y"], p["y"])}
    return rows.select(*keys, *[c.alias(n) for n, c in ends.items()], F.when(turned, -1).otherwise(1).alias("way"))


def group_outline(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys and x0, y0, x1, y1 of the outline of each group's polygons, the inside on the left. Where polygons of a group overlap,
    the outline of the overlap is part of it as often as it is covered once more; ``times`` says how often."""
    rows = _edges(df, keys)
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    size = F.sqrt(dx * dx + dy * dy)
    ux, uy = F.round(dx / size, DECIMALS), F.round(dy / size, DECIMALS)
    # -0.0 and 0.0 are one direction.
    place = F.round(F.col("x0") * uy - F.col("y0") * ux, DECIMALS) + 0.0
    rows = rows.select(*keys, (ux + 0.0).alias("ux"), (uy + 0.0).alias("uy"), place.alias("place"), "x0", "y0", "x1", "y1", "way")
    line = [*keys, "ux", "uy", "place"]
    ends = F.array(
        F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("way")),
        F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), (-F.col("way")).alias("way")),
    )
    marks = rows.select(*line, F.inline(ends)).groupBy(*line, "x", "y").agg(F.sum("way").alias("way"))
    marks = marks.where("way <> 0")  # an end where as much begins as ends doesn't cut the outline
    along = Window.partitionBy(*line).orderBy("x", "y")
    marks = marks.withColumns({"times": F.sum("way").over(along), "x1": F.lead("x").over(along), "y1": F.lead("y").over(along)})
    back = F.col("times") < 0

    def pick(a: str, b: str) -> Column:
        return F.when(back, F.col(b)).otherwise(F.col(a))

    return marks.where("times <> 0").select(
        *keys, pick("x", "x1").alias("x0"), pick("y", "y1").alias("y0"), pick("x1", "x").alias("x1"), pick("y1", "y").alias("y1"),
        F.abs("times").alias("times"),
    )


def outline_stats(outline: DataFrame, keys: list[str]) -> DataFrame:
    """Area in square degrees, length in degrees and number of edges of each group's outline."""
    x0, y0, x1, y1, n = (F.col(c) for c in ("x0", "y0", "x1", "y1", "times"))
    return outline.groupBy(*keys).agg(
        F.sum(n * (x0 * y1 - x1 * y0) / 2).alias("AREA"),
        F.sum(n * F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))).alias("LENGTH"),
        F.sum(n).alias("EDGES"),
    )
