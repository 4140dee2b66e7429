"""Shapes by labelled grid cells, and joins on the labels.

A shape of any kind is listed under the cells it meets, each a square of ``cell`` degrees that has its low
sides, not its high ones. A cell wholly inside a polygon carries nothing but its number. A border cell carries the
edges that run through it and ``low``, from which those edges alone tell what lies inside:

* Edges are cut at the grid lines between columns. For a point of a cell, the edges that a ray to the right
  meets are those of the cell, and those beyond its right side X. The latter are as many, modulo 2, as there are
  cuts on X below the point, since what lies right of X starts and ends there.
* ``low`` is the parity of the cuts on X below the cell's row, a running sum over the rows of a column; cuts within the row
  come with their edges. A row between two border rows has no edges, so ``low`` says whether it is inside.

All numbers of a cut come from one formula, so neighbouring cells agree and parity can't slip by rounding. The rows
of an edge, its cuts and the label are plain Columns; a shape's edges are rows, so no task holds a layer and a shape
of many edges is spread over its columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraquilt.functions.geom import as_paths, point_path
from terraquilt.operators.cells import spread_hot
from terraquilt.session import materialized

BROADCAST_BYTES = 64 * 1024 * 1024
#: Bytes of a cell and of an edge in memory, about: their fixed widths.
CELL_BYTES, EDGE_BYTES = 64, 80


# --- edges ----------------------------------------------------------------------------------------


def edges(paths: Column) -> Column:
    """array<struct<x0, y0, x1, y1, area>> of paths, each edge from left to right; a point is an edge of no
    length. ``area`` says whether the edge bounds a polygon."""
    def edge(p: Column, q: Column, area: Column) -> Column:
        swap = (p["x"] > q["x"]) | ((p["x"] == q["x"]) & (p["y"] > q["y"]))

        def pick(a: Column, b: Column) -> Column:
            return F.when(swap, b).otherwise(a)

        corners = {"x0": pick(p["x"], q["x"]), "y0": pick(p["y"], q["y"]), "x1": pick(q["x"], p["x"]), "y1": pick(q["y"], p["y"])}
        return F.struct(*[c.alias(n) for n, c in corners.items()], area.alias("area"))

    def of(path: Column) -> Column:
        pts, area = path["pts"], path["kind"] == "polygon"
        alone = (path["kind"] == "point") | (F.size(pts) == 1)
        # Points from the second on, each with the one before it.
        steps = F.filter(F.transform(pts, lambda q, i: F.struct(F.get(pts, i - 1).alias("p"), q.alias("q"))), lambda s: s["p"].isNotNull())
        return F.when(alone, F.transform(pts, lambda p: edge(p, p, F.lit(False)))).otherwise(
            F.transform(steps, lambda s: edge(s["p"], s["q"], area))
        )

    return F.flatten(F.transform(paths, of))


def _row(y: Column, cell: float) -> Column:
    return F.floor(y / cell)


def edge_cells(df: DataFrame, paths: Column, cell: float) -> DataFrame:
    """df's columns but geometry, with a row for each cell (``cx``, ``cy``) that an edge runs through: ``e``, a
    struct of the edge, its ends (``lo``, ``hi``) at the column's sides, and ``cut``, where it leaves through
    the right side in this row."""
    rows = df.withColumn("e", F.explode(edges(paths)))
    e = F.col("e")
    first, last = F.floor(e["x0"] / cell), F.floor(e["x1"] / cell)
    rows = rows.withColumn("cx", F.explode(F.sequence(first, last)))

    def at(x: Column) -> Column:
        y = e["y0"] + (x - e["x0"]) * ((e["y1"] - e["y0"]) / (e["x1"] - e["x0"]))
        return F.least(F.greatest(y, F.least(e["y0"], e["y1"])), F.greatest(e["y0"], e["y1"]))

    rows = rows.withColumns({
        "lo": F.when(F.col("cx") == first, e["y0"]).otherwise(at(F.col("cx") * cell)),
        "hi": F.when(F.col("cx") == last, e["y1"]).otherwise(at((F.col("cx") + 1) * cell)),
        "leaves": F.col("cx") < last,
    })
    low, high = F.least("lo", "hi"), F.greatest("lo", "hi")
    rows = rows.withColumn("cy", F.explode(F.sequence(_row(low, cell), _row(high, cell))))
    cut = F.when(F.col("leaves") & (_row(F.col("hi"), cell) == F.col("cy")), F.col("hi"))
    full = F.struct("e.*", "lo", "hi", cut.alias("cut"))
    return rows.withColumn("e", full).drop("lo", "hi", "leaves")


# --- labelled cells -------------------------------------------------------------------------------


def labelled_cells(df: DataFrame, keys: list[str], cell: float, paths: Column | None = None) -> DataFrame:
    """keys, ``cx``, ``cy``, ``edges`` (empty inside a polygon) and ``low`` of the shapes. Keys tell shapes
    apart. One shuffle, by shape and column."""
    paths = paths if paths is not None else shape_paths(df)
    rows = edge_cells(df.select(*keys, paths.alias("paths_")), F.col("paths_"), cell).drop("paths_")
    rows = rows.repartition(*keys, "cx")
    e = F.col("e")
    own = F.count_if(e["cut"].isNotNull() & e["area"])
    border = rows.groupBy(*keys, "cx", "cy").agg(F.collect_list("e").alias("edges"), own.alias("cuts"))
    column = Window.partitionBy(*keys, "cx").orderBy("cy")
    # Cuts up to and with this row; those before it decide its own label.
    border = border.withColumns({"upto": F.sum("cuts").over(column), "next": F.lead("cy").over(column)})
    low = (F.col("upto") - F.col("cuts")) % 2 == 1
    here = F.struct("cy", "edges", low.alias("low"))
    none = F.filter("edges", lambda x: F.lit(False))
    between = F.when(
        (F.col("upto") % 2 == 1) & (F.col("next") - F.col("cy") > 1), F.sequence(F.col("cy") + 1, F.col("next") - 1)
    ).otherwise(F.array().cast("array<bigint>"))
    inner = F.transform(between, lambda r: F.struct(r.alias("cy"), none.alias("edges"), F.lit(True).alias("low")))
    return border.select(*keys, "cx", F.inline(F.concat(F.array(here), inner)))


def shape_paths(df: DataFrame) -> Column:
    return F.col("paths") if "paths" in df.columns else as_paths(F.col("rings"))


def is_inside(edges: Column) -> Column:
    return F.size(edges) == 0


def polygon_cover(df: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """keys, ``cx``, ``cy`` and ``inside`` of every cell that a shape meets: true where the whole cell lies in
    a polygon and no edge runs through it."""
    return labelled_cells(df, keys, cell).select(*keys, "cx", "cy", is_inside(F.col("edges")).alias("inside"))


# --- predicates -----------------------------------------------------------------------------------


def holds(edges: Column, low: Column, x: Column, y: Column) -> Column:
    """Whether a point of the cell lies in a polygon with this label, or on an edge."""
    def step(acc: Column, e: Column) -> Column:
        side = (e["x1"] - e["x0"]) * (y - e["y0"]) - (x - e["x0"]) * (e["y1"] - e["y0"])
        on_edge = (
            (side == 0)
            & x.between(e["x0"], e["x1"])
            & y.between(F.least(e["y0"], e["y1"]), F.greatest(e["y0"], e["y1"]))
        )
        hits = ((e["lo"] <= y) != (e["hi"] <= y)) & ((side > 0) == (e["y1"] > e["y0"]))
        passed = F.coalesce(e["cut"] <= y, F.lit(False))
        odd = e["area"] & (hits != passed)
        return F.struct((acc["odd"] != odd).alias("odd"), (acc["edge"] | on_edge).alias("edge"))

    start = F.struct(low.alias("odd"), F.lit(False).alias("edge"))
    return F.aggregate(edges, start, step, lambda acc: acc["odd"] | acc["edge"])


def touches(a: Column, b: Column) -> Column:
    """Whether two closed segments, each from left to right, share a point."""
    def turn(s: Column, x: Column, y: Column) -> Column:
        return F.signum((s["x1"] - s["x0"]) * (y - s["y0"]) - (x - s["x0"]) * (s["y1"] - s["y0"]))

    def over(s: Column, t: Column) -> Column:
        return F.greatest(F.least(s["y0"], s["y1"]), F.least(t["y0"], t["y1"])) <= F.least(F.greatest(s["y0"], s["y1"]), F.greatest(t["y0"], t["y1"]))

    return (
        (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & over(a, b)
        & (turn(a, b["x0"], b["y0"]) * turn(a, b["x1"], b["y1"]) <= 0)
        & (turn(b, a["x0"], a["y0"]) * turn(b, a["x1"], a["y1"]) <= 0)
    )


def _ends_in(edges: Column, others: Column, low: Column, cx: Column, cy: Column, cell: float) -> Column:
    """Whether an end of an edge lies in the cell and in the other shape. Shapes whose boundaries don't touch meet
    only so: one holds an end of the other, and in that end's cell."""
    def end(x: Column, y: Column) -> Column:
        return (F.floor(x / cell) == cx) & (_row(y, cell) == cy) & holds(others, low, x, y)

    return F.exists(edges, lambda e: end(e["x0"], e["y0"]) | end(e["x1"], e["y1"]))


def cells_meet(l_edges: Column, l_low: Column, r_edges: Column, r_low: Column, cx: Column, cy: Column, cell: float) -> Column:
    """Whether two shapes share a point, as far as one cell that both are listed under can tell; they do if any
    such cell says so."""
    return (
        is_inside(l_edges) | is_inside(r_edges)
        | F.exists(l_edges, lambda e: F.exists(r_edges, lambda f: touches(e, f)))
        | _ends_in(l_edges, r_edges, r_low, cx, cy, cell)
        | _ends_in(r_edges, l_edges, l_low, cx, cy, cell)
    )


# --- joins ----------------------------------------------------------------------------------------


def fits(cells: DataFrame, edges: str) -> bool:
    """Whether written cells may be broadcast, by their measured size."""
    size = cells.agg(F.count(F.lit(1)), F.sum(F.size(edges))).first()
    return CELL_BYTES * size[0] + EDGE_BYTES * (size[1] or 0) <= BROADCAST_BYTES


def _place_cells(place: DataFrame, cell: float) -> DataFrame:
    """Cells of all shapes of a place, known by a hash of the shape."""
    shape = shape_paths(place)
    own = place.select(shape.alias("paths")).withColumn("place_", F.xxhash64("paths"))
    own = labelled_cells(own.dropDuplicates(["place_"]), ["place_"], cell)
    return materialized(own.select("cx", "cy", F.col("edges").alias("p_edges"), F.col("low").alias("p_low")), "place-cells")


def points_within(points: DataFrame, place: DataFrame, lon: str = "x", lat: str = "y", cell: float = 0.5,
                  broadcast_place: bool | None = None) -> DataFrame:
    """Semi-join: points in any shape of ``place`` or on its boundary. A point looks at its own cell: an
    inside one answers by itself, a border one by the edges in it."""
    cells = _place_cells(place, cell)
    x, y = F.col(f"`{lon}`"), F.col(f"`{lat}`")
    keys = ["cx", "cy"]
    spots = points.withColumns({"cx": F.floor(x / cell), "cy": F.floor(y / cell)})
    small = fits(cells, "p_edges") if broadcast_place is None else broadcast_place
    if small:
        cells = F.broadcast(cells)
    else:
        # Only the points of a hot cell are split; a point must stay in one share
        # for the semi-join to return it once.
        cells, spots, keys = spread_hot(cells, spots, keys, split_left=False)
    spots = spots.withColumnsRenamed({k: f"{k}_" for k in keys})
    on = reduce(Column.__and__, [F.col(k) == F.col(f"{k}_") for k in keys])
    on = on & (is_inside(F.col("p_edges")) | holds(F.col("p_edges"), F.col("p_low"), x, y))
    return spots.join(cells, on, "left_semi").drop(*[f"{k}_" for k in keys])


def shapes_within(shapes: DataFrame, place: DataFrame, row_id: str, cell: float = 0.5) -> DataFrame:
    """Semi-join: shapes that share a point with any shape of ``place``. Only ids and edges go through the join;
    the ids found are measured at run time and go to the layer, which isn't shuffled where they are few."""
    cells = _place_cells(place, cell)
    own = labelled_cells(shapes.select(row_id, shape_paths(shapes).alias("paths")), [row_id], cell)
    if fits(cells, "p_edges"):
        found = own.join(F.broadcast(cells), ["cx", "cy"])
    else:
        own, cells, keys = spread_hot(own, cells, ["cx", "cy"])
        found = own.join(cells, keys)
    meet = cells_meet(F.col("edges"), F.col("low"), F.col("p_edges"), F.col("p_low"), F.col("cx"), F.col("cy"), cell)
    return shapes.join(found.where(meet).select(row_id).distinct(), row_id, "left_semi")


def meeting_pairs(left: DataFrame, right: DataFrame, l_id: str, r_id: str, cell: float = 0.5) -> DataFrame:
    """Distinct pairs (l_id, r_id) of shapes that share a point. The left layer is the one that may be small: its cells
    are broadcast if they measure so; otherwise both sides meet by shuffle, and cells with many shapes are split."""
    if l_id == r_id:
        raise ValueError("the two ids need different names")

    def cells(df: DataFrame, name: str, side: str) -> DataFrame:
        own = labelled_cells(df.select(name, shape_paths(df).alias("paths")), [name], cell)
        return own.withColumnsRenamed({"edges": f"{side}_edges", "low": f"{side}_low"})

    l, keys = materialized(cells(left, l_id, "l"), "left-cells"), ["cx", "cy"]
    if fits(l, "l_edges"):
        pairs = cells(right, r_id, "r").join(F.broadcast(l), keys)
    else:
        l, r, keys = spread_hot(l, materialized(cells(right, r_id, "r"), "right-cells"), keys)
        pairs = l.join(r, keys)
    meet = cells_meet(F.col("l_edges"), F.col("l_low"), F.col("r_edges"), F.col("r_low"), F.col("cx"), F.col("cy"), cell)
    return pairs.where(meet).select(l_id, r_id).distinct()


def points_as_shapes(points: DataFrame, lon: str = "x", lat: str = "y") -> DataFrame:
    """A point table as a table of shapes."""
    return points.withColumn("paths", point_path(F.col(f"`{lon}`"), F.col(f"`{lat}`")))
