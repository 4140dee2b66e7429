"""Areas of intersections as sums over edge rows.

A polygon with its inside on the left of its edges is a sum of columns under edges: those that go left count, those that go
right are taken off. So the area that two polygons share is a sum over pairs of their edges, each of which adds the area
under the lower one of the two where both run, with the product of their signs. Nothing is split, linked or
tested for being inside, and what isn't shared cancels. Edge pairs are rows: they are measured in generated code and summed
by the group that asks for them, partially before the only shuffle.

That holds for shapes that don't cross or touch themselves. Others, and pairs with more than EDGE_PAIRS edge pairs, are measured
by `clip`, pair by pair, in the same pass. Areas on the ground are of edges whose ends are projected; an edge that passes over an end
of the other shape's is projected in pieces there, which on edges of a degree differs by less than a millionth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraquilt.functions.codec import clip, edges_meet, edges_of
from terraquilt.functions.geom import cea_y, pack_shape
from terraquilt.functions.kernel import TOLERANCE
from terraquilt.model import EARTH_RADIUS_M, SQM_PER_HA

#: Edges of a shape that are looked at for crossings, and edge pairs of a pair that are rows.
SHAPE_EDGES, EDGE_PAIRS = 32, 1024


# --- edges of a shape -----------------------------------------------------------------------------


def plain_edges(rings: Column, upright: bool = True) -> Column:
    """The directed edges of a shape that doesn't cross or touch itself; null for others, for shapes of many
    edges and for none. Without ``upright`` edges go that no area lies under."""
    edges = edges_of(pack_shape(rings), SHAPE_EDGES)
    return edges if upright else F.filter(edges, lambda e: e["x0"] != e["x1"])


# --- pairs ----------------------------------------------------------------------------------------


def edge_pair_areas(pairs: DataFrame, keep: list[str]) -> DataFrame:
    """pairs with plain ``l_edges`` and ``r_edges`` (or null): columns `keep`, ``first_`` (once for each pair), and ``deg_`` and
    ``ha_``, which add up to the pair's shared area; both null where edges don't run over each other."""
    kept = [F.col(f"`{c}`") for c in [*keep, "base_", "ground_"]]
    pairs = pairs.withColumn("ground_", cea_y(F.col("base_")))  # once a pair, not for each of its rows
    rows = pairs.select(*kept, "r_edges", F.posexplode_outer("l_edges").alias("i_", "e_"))
    rows = rows.where("i_ IS NULL OR i_ = 0 OR e_.x0 <> e_.x1")  # nothing lies under an upright edge
    rows = rows.select(*kept, "i_", "e_", F.posexplode_outer("r_edges").alias("j_", "f_"))
    e, f = F.col("e_"), F.col("f_")
    left = lambda s: F.least(s["x0"], s["x1"])
    right = lambda s: F.greatest(s["x0"], s["x1"])
    first = (F.coalesce("i_", F.lit(0)) == 0) & (F.coalesce("j_", F.lit(0)) == 0)
    rows = rows.select(
        *kept, first.alias("first_"), "e_", "f_", F.greatest(left(e), left(f)).alias("from_"), F.least(right(e), right(f)).alias("to_")
    ).where("first_ OR from_ < to_")

    def at(s: Column, x: Column) -> Column:
        y = s["y0"] + (x - s["x0"]) * ((s["y1"] - s["y0"]) / F.nullif(s["x1"] - s["x0"], F.lit(0.0)))
        # An edge's ends are taken as they are, so that shared ends stay shared.
        return F.when(x == s["x0"], s["y0"]).when(x == s["x1"], s["y1"]).otherwise(y)

    a, b = F.col("from_"), F.col("to_")
    sign = F.when((e["x1"] < e["x0"]) == (f["x1"] < f["x0"]), 1.0).otherwise(-1.0)
    rows = rows.select(
        *kept, "first_", F.when(a < b, sign * (b - a)).alias("width_"),
        at(e, a).alias("e0_"), at(e, b).alias("e1_"), at(f, a).alias("f0_"), at(f, b).alias("f1_"),
    )
    before, after = F.col("e0_") - F.col("f0_"), F.col("e1_") - F.col("f1_")
    t = F.when(before * after < 0, before / (before - after))
    rows = rows.select(
        *kept, "first_", "width_", F.least("e0_", "f0_").alias("y0_"), F.least("e1_", "f1_").alias("y1_"),
        t.alias("t_"), (F.col("e0_") + t * (F.col("e1_") - F.col("e0_"))).alias("yt_"),
    )

    # Projected in a step of its own: code that is too long for one method isn't compiled by the JVM.
    heights = [(cea_y(F.col(f"{c}_")) - F.col("ground_")).alias(f"{c}_ground_") for c in ("y0", "yt", "y1")]
    rows = rows.select(*kept, "first_", "width_", "t_", *[(F.col(f"{c}_") - F.col("base_")).alias(f"{c}_flat_") for c in ("y0", "yt", "y1")], *heights)

    def under(kind: str) -> Column:
        y0, yt, y1, t = *(F.col(f"{c}_{kind}_") for c in ("y0", "yt", "y1")), F.col("t_")
        return F.when(t.isNull(), (y0 + y1) / 2).otherwise(((y0 + yt) * t + (yt + y1) * (1 - t)) / 2)

    flat, ground = under("flat"), under("ground")
    metres = F.radians(F.col("width_")) * EARTH_RADIUS_M
    return rows.select(*kept, "first_", (F.col("width_") * flat).alias("deg_"), (metres * ground / SQM_PER_HA).alias("ha_"))


def pair_sums(pairs: DataFrame, keys: list[str], sums: list[str], touching: bool | None, tolerance: float = TOLERANCE, all_plain: bool = False) -> DataFrame:
    """keys, ``pairs`` (their number), ``area_ha``, ``area_deg`` and the sums of columns `sums` over pairs of shapes. touching:
    whether pairs that only touch count; None if neither the number nor groups of such pairs matter. pairs have
    l_/r_ shape, edges and bbox. all_plain says that every pair's edges are there, so nothing goes through Python."""
    few = F.size("l_edges") * F.size("r_edges") <= EDGE_PAIRS
    own = pairs.withColumn("plain_", F.coalesce(few, F.lit(False)))
    other = ~F.col("plain_")
    if all_plain:
        none = F.lit(None)
        clipped = F.struct(none.cast("boolean").alias("hit"), none.cast("double").alias("area_ha"), none.cast("double").alias("area_deg"))
    else:
        clipped = clip(F.when(other, F.col("l_shape")), F.when(other, F.col("r_shape")), False, tolerance)
    own = own.withColumn("clip_", clipped).drop("l_shape", "r_shape")
    hit = F.col("clip_.hit") if touching else F.col("clip_.area_deg") > 0
    if touching:
        of = lambda c: F.when(F.col("plain_"), F.col(c))
        own = own.where(F.when(other, hit).otherwise(edges_meet(of("l_edges"), of("r_edges"))))
    else:
        own = own.where(F.col("plain_") | hit)
    box_l, box_r = F.col("l_bbox"), F.col("r_bbox")
    own = own.withColumns({
        "base_": F.greatest(box_l["ymin"], box_r["ymin"]),
        "l_edges": F.when(F.col("plain_"), F.col("l_edges")), "r_edges": F.when(F.col("plain_"), F.col("r_edges")),
        "clip_ha_": F.when(other, F.col("clip_.area_ha")), "clip_deg_": F.when(other, F.col("clip_.area_deg")),
    })
    kept = [*dict.fromkeys([*keys, *sums]), "clip_ha_", "clip_deg_"]
    if touching is False:
        # Which pairs share an area only their own sums can tell.
        kept.append("pair_")
        own = own.withColumn("pair_", F.monotonically_increasing_id())
    rows = edge_pair_areas(own, kept)
    once = lambda c: F.sum(F.when(F.col("first_"), F.col(f"`{c}`")))
    area = lambda c: F.coalesce(F.sum(f"{c}_"), F.lit(0.0)) + F.coalesce(once(f"clip_{c}_"), F.lit(0.0))
    totals = [area("ha").alias("area_ha"), area("deg").alias("area_deg")]
    if touching is False:
        each = rows.groupBy("pair_").agg(*[F.first(c).alias(c) for c in dict.fromkeys([*keys, *sums])], *totals).where(F.col("area_deg") > 1e-15)
        return each.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("pairs"), F.sum("area_ha").alias("area_ha"), F.sum("area_deg").alias("area_deg"), *[F.sum(c).alias(c) for c in sums]
        )
    return rows.groupBy(*keys).agg(F.count_if("first_").alias("pairs"), *totals, *[once(c).alias(c) for c in sums])
