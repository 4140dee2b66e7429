"""Labelled cells of shapes of every kind against plain geometry."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shapes import ring, square, star
from terraquilt.functions import geom
from terraquilt.model import PATHS
from terraquilt.operators import cells, cover, overlay
from terraquilt.sources import scan

L_WITH_HOLE = [
    ring((0, 0), (1, 0), (1, 0.25), (0.375, 0.25), (0.375, 1), (0, 1)),
    ring((0.125, 0.5), (0.125, 0.75), (0.25, 0.75), (0.25, 0.5), hole=True),
]


def shape(kind, *rings):
    return [(kind, part, hole, [(float(x), float(y)) for x, y in xy]) for part, hole, xy in rings]


def line(*points):
    return [("line", 0, False, [(float(x), float(y)) for x, y in points])]


def point(x, y):
    return [("point", 0, False, [(float(x), float(y))])]


def table(spark, shapes, name="id"):
    schema = T.StructType([T.StructField(name, T.IntegerType()), T.StructField("paths", PATHS)])
    return spark.createDataFrame(list(enumerate(shapes)), schema).repartition(3)


# --- plain versions -------------------------------------------------------------------------------


def segments(paths):
    for kind, _, _, pts in paths:
        if kind == "point" or len(pts) == 1:
            yield from ((p, p, False) for p in pts)
        else:
            yield from ((p, q, kind == "polygon") for p, q in zip(pts, pts[1:]))


def turn(p, q, r):
    return np.sign((q[0] - p[0]) * (r[1] - p[1]) - (r[0] - p[0]) * (q[1] - p[1]))


def segments_touch(a, b):
    for i in (0, 1):
        if max(min(a[0][i], a[1][i]), min(b[0][i], b[1][i])) > min(max(a[0][i], a[1][i]), max(b[0][i], b[1][i])):
            return False
    return turn(*a, b[0]) * turn(*a, b[1]) <= 0 and turn(*b, a[0]) * turn(*b, a[1]) <= 0


def inside(paths, p):
    odd = False
    for a, b, area in segments(paths):
        if segments_touch((a, b), (p, p)):
            return True
        if area and (a[1] <= p[1]) != (b[1] <= p[1]):
            odd ^= a[0] + (p[1] - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) > p[0]
    return odd


def meet(l, r):
    ls, rs = list(segments(l)), list(segments(r))
    if any(segments_touch(a[:2], b[:2]) for a in ls for b in rs):
        return True
    return any(inside(r, a[0]) for a in ls) or any(inside(l, b[0]) for b in rs)


@pytest.fixture(scope="module")
def shapes():
    rng = random.Random(4)
    spot = lambda: (rng.uniform(-2, 2), rng.uniform(-2, 2))
    grid = lambda: (rng.randrange(-8, 9) / 4, rng.randrange(-8, 9) / 4)
    found = [shape("polygon", *star(*spot(), [rng.uniform(0.2, 1.5) for _ in range(rng.choice([3, 7, 40]))])) for _ in range(25)]
    found += [shape("polygon", *L_WITH_HOLE), shape("polygon", square(-2, -2, 2, 2), square(-1.5, -1.5, 1.5, 1.5, hole=True))]
    found += [shape("polygon", square(0, 0, 0.25, 0.25), square(1, 1, 1.25, 1.5, part=1)), []]
    found += [line(*[spot() for _ in range(rng.randrange(2, 6))]) for _ in range(25)] + [line(grid(), grid(), grid()) for _ in range(15)]
    found += [point(*spot()) for _ in range(25)] + [point(*grid()) for _ in range(25)]
    found += [point(0.125, 0.6), point(0.2, 0.6), line((0.15, 0.55), (0.2, 0.7)), line((-5, 0.1), (5, 0.1)), line((0.2, -3), (0.2, 3))]
    found += [[*line((9, 9), (8, 8)), *point(0.05, 0.05)], [*shape("polygon", square(5, 5, 6, 6)), *line((0.2, 0.6), (0.2, 0.61))]]
    return found


# --- cells ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("cell", [0.25, 0.31, 2.0])
def test_labels(spark, shapes, cell):
    """Inside cells lie inside by their corners and carry no edges, border cells hold their edges, no cell is missing, and
    any point is decided by its cell alone."""
    rows = cover.labelled_cells(table(spark, shapes), ["id"], cell)
    found = {}
    for r in rows.select("id", "cx", "cy", F.size("edges").alias("n"), "low").collect():
        assert (r["id"], r["cx"], r["cy"]) not in found
        found[r["id"], r["cx"], r["cy"]] = r
    probes = [(x, y) for x in np.arange(-2.6, 2.6, 0.173) for y in np.arange(-2.6, 2.6, 0.173)]
    probes += [(i / 8, j / 8) for i in range(-17, 18) for j in range(-17, 18)]
    for i, paths in enumerate(shapes):
        areas = [p for p in paths if p[0] == "polygon"]
        for x, y in probes:
            own = found.get((i, math.floor(x / cell), math.floor(y / cell)))
            if own is None:
                assert not inside(paths, (x, y))
            elif not own["n"]:
                assert own["low"] and inside(areas, (x, y))
    cells_ = cover.labelled_cells(table(spark, shapes), ["id"], cell)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in probes], "x double, y double")
    df = df.withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    got = df.join(cells_, ["cx", "cy"]).where(cover.holds(F.col("edges"), F.col("low"), F.col("x"), F.col("y")))
    got = {(r["id"], r["x"], r["y"]) for r in got.collect()}
    assert got == {(i, x, y) for i, paths in enumerate(shapes) for x, y in probes if inside(paths, (x, y))}


def test_cover_of_a_shape_with_a_hole(spark):
    found = cover.polygon_cover(table(spark, [shape("polygon", *L_WITH_HOLE)]), ["id"], 1 / 16).collect()
    kinds = {(r["cx"], r["cy"]): r["inside"] for r in found}
    assert kinds[1, 1] and kinds[9, 1] and kinds[5, 12]  # in both legs
    assert (3, 9) not in kinds and (9, 9) not in kinds  # in the hole, beside the L
    assert not kinds[0, 0] and not kinds[16, 0] and not kinds[2, 8] and not kinds[4, 8]
    assert sum(kinds.values()) == sum(
        inside(shape("polygon", *L_WITH_HOLE), ((x + 0.5) / 16, (y + 0.5) / 16)) and (x, y) in kinds and kinds[x, y] for x in range(17) for y in range(17)
    )


# --- joins ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("small, hot, cell", [(True, 4_000_000, 0.5), (False, 5, 0.5), (False, 4_000_000, 3.0)])
def test_pairs(spark, shapes, monkeypatch, small, hot, cell):
    monkeypatch.setattr(cells, "HOT_PAIRS", hot)
    monkeypatch.setattr(cover, "BROADCAST_BYTES", cover.BROADCAST_BYTES if small else 0)
    left, right = shapes[::2], shapes[1::2]
    got = cover.meeting_pairs(table(spark, left, "a"), table(spark, right, "b"), "a", "b", cell).collect()
    want = {(i, j) for i, l in enumerate(left) for j, r in enumerate(right) if meet(l, r)}
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want and len(want) > 50
    with pytest.raises(ValueError):
        cover.meeting_pairs(table(spark, left), table(spark, right), "id", "id")


@pytest.mark.parametrize("small", [True, False])
def test_shapes_in_places(spark, shapes, monkeypatch, small):
    monkeypatch.setattr(cover, "BROADCAST_BYTES", cover.BROADCAST_BYTES if small else 0)
    places = [shape("polygon", *L_WITH_HOLE), shape("polygon", square(-2, -2, -1.9, -1.9)), shape("polygon", *L_WITH_HOLE)]
    df = table(spark, shapes).withColumn("edges", F.lit("x"))
    got = cover.shapes_within(df, table(spark, places, "p"), "id", 0.2)
    assert got.columns[0] == "id" and set(got.columns) == set(df.columns)
    assert sorted(r["id"] for r in got.collect()) == [i for i, s in enumerate(shapes) if any(meet(s, p) for p in places)]
    assert cover.shapes_within(df, table(spark, places, "p").limit(0), "id").collect() == []


@pytest.mark.parametrize("small", [True, False])
def test_points_in_places(spark, shapes, monkeypatch, small):
    monkeypatch.setattr(cells, "HOT_PAIRS", 40)
    rng = np.random.default_rng(5)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-3, 3, (300, 2)))]
    pts += [(300, 1.0, 1.0), (301, 0.125, 0.6), (302, None, 0.0), (303, 0.0, 0.0), (303, 0.0, 0.0)]
    places = shapes[3:9] + [shape("polygon", *L_WITH_HOLE)]
    df = spark.createDataFrame(pts, "row_id int, x double, y double")
    got = cover.points_within(df, table(spark, places), cell=0.25, broadcast_place=small)
    want = [i for i, x, y in pts if x is not None and any(inside(p, (x, y)) for p in places)]
    assert sorted(r["row_id"] for r in got.collect()) == want and got.columns == df.columns


def test_inside_cells_carry_no_edges(spark):
    """The place side of a join holds edges along the border only, whatever the place's size."""
    place = table(spark, [shape("polygon", *star(0, 0, [1.0] * 4000))])
    rows = cover._place_cells(place, 1 / 32).select(F.size("p_edges").alias("n")).collect()
    assert sum(r["n"] == 0 for r in rows) > 2500  # of about 3,200 within the circle
    assert sum(r["n"] for r in rows) < 2 * 4000


def test_joins_have_no_nested_loop(spark, shapes):
    left, right = table(spark, shapes, "a"), table(spark, shapes, "b")
    for df in (cover.meeting_pairs(left, right, "a", "b"), cover.shapes_within(left, right, "a")):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in text and "Cartesian" not in text and "ArrowEval" not in text


# --- text -----------------------------------------------------------------------------------------


def test_shapes_from_text(spark):
    texts = {
        "POINT (1 2)": point(1, 2), "POINT Z(1 2 3)": point(1, 2), "LINESTRING (0 0, 1 1, 2 0)": line((0, 0), (1, 1), (2, 0)),
        "MULTIPOINT ((1 2), (3 4))": [("point", 0, False, [(1.0, 2.0), (3.0, 4.0)])], "MULTIPOINT (1 2, 3 4)": [("point", 0, False, [(1.0, 2.0), (3.0, 4.0)])],
        "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))": [("line", 0, False, [(0.0, 0.0), (1.0, 1.0)]), ("line", 0, True, [(2.0, 2.0), (3.0, 3.0)])],
        "GEOMETRYCOLLECTION (POINT (3 4), LINESTRING (0 0, 1 1), GEOMETRYCOLLECTION (POLYGON ((0 0, 1 0, 1 1, 0 0))))":
            [*point(3, 4), *line((0, 0), (1, 1)), ("polygon", 0, False, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)])],
        "LINESTRING EMPTY": [], "POINT EMPTY": [],
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("w", F.col("t"))
    got = {r["w"]: [(p["kind"], p["part"], p["hole"], [tuple(x) for x in p["pts"]]) for p in r["paths"]] for r in scan.shapes_from(df, "t", "wkt").collect()}
    assert got == texts
    json = {
        '{"type":"Point","coordinates":[1,2,9]}': point(1, 2), '{"type":"LineString","coordinates":[[0,0],[1,1]]}': line((0, 0), (1, 1)),
        '{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[3,4]},{"type":"LineString","coordinates":[]}]}': point(3, 4),
    }
    df = spark.createDataFrame([(t,) for t in json], "t string").withColumn("w", F.col("t"))
    got = {r["w"]: [(p["kind"], p["part"], p["hole"], [tuple(x) for x in p["pts"]]) for p in r["paths"]] for r in scan.shapes_from(df, "t", "geojson").collect()}
    assert got == json


def test_mixed_shapes_as_text(spark, shapes):
    some = [s for s in shapes if s]
    df = table(spark, some).select("id", geom.paths_to_wkt(F.col("paths")).alias("t"))
    back = scan.shapes_from(df, "t", "wkt").select("id", F.flatten(F.col("paths.pts")).alias("p")).collect()
    assert {r["id"]: sorted(map(tuple, r["p"])) for r in back} == {i: sorted(p for x in s for p in x[3]) for i, s in enumerate(some)}


@pytest.mark.parametrize("text", [
    "MULTIPOINT (" + ", ".join(f"({i} {i})" for i in range(100_000)) + ")",
    "POLYGON ((0 0, 9 0, 9 9, 0 0), " + ", ".join(["(1 1, 2 1, 2 2, 1 1)"] * 20_000) + ")",
    "LINESTRING (" + ", ".join(f"{i} {i % 7}" for i in range(100_000)) + ")",
])
def test_long_text_is_read(spark, text):
    """Patterns that recurse would end the executor."""
    for whole in (text, f"GEOMETRYCOLLECTION (POINT (1 1), {text})"):
        df = spark.createDataFrame([(whole,)], "t string")
        paths = scan.shapes_from(df, "t", "wkt").select(F.size(F.flatten(F.col("paths.pts")))).first()[0]
        assert paths >= 80_000
        assert df.select(F.size(geom.rings_from_wkt(F.col("t")))).first()[0] in (0, 20_001)


def test_within_place_takes_each_kind_of_table(spark, shapes):
    place = table(spark, [shape("polygon", *L_WITH_HOLE)])
    pts = spark.createDataFrame([(1, 0.1, 0.1), (2, 0.2, 0.6)], "row_id int, x double, y double")
    assert [r["row_id"] for r in overlay.within_place(pts, place, "row_id", cell=0.1).collect()] == [1]
    same = cover.points_as_shapes(pts)
    assert [r["row_id"] for r in overlay.within_place(same, place, "row_id", cell=0.1).collect()] == [1]
