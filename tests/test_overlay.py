"""Joins on geometry against brute force, on every path, and their plans."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from shapes import clip, packed, ring, row, square, star

from terraquilt.functions import edges, geom
from terraquilt.model import RINGS
from terraquilt.operators import areas, cells, overlay, windows
from terraquilt.operators.cells import cell_pairs, suggest_cell, with_cells
from terraquilt.session import materialized

R = RINGS.simpleString()


def layer(spark, shapes, name):
    df = spark.createDataFrame([(i, row(s)) for i, s in enumerate(shapes)], f"{name} int, rings {R}")
    df = df.withColumn("rings", geom.normalize(F.col("rings")))
    return df.withColumn("bbox", geom.bbox_of(F.col("rings")))


def brute(left, right):
    """{(i, j): area} of all pairs that meet, straight from the kernel."""
    keys = list(itertools.product(range(len(left)), range(len(right))))
    rows = clip([(left[i], right[j]) for i, j in keys])
    return {k: r["area_deg"] for k, r in zip(keys, rows) if r["hit"]}


def found(df):
    rows = df.select("a", "b", "area_deg").collect()
    assert len(rows) == len({(r["a"], r["b"]) for r in rows})  # each pair once
    return {(r["a"], r["b"]): r["area_deg"] for r in rows}


@pytest.fixture(scope="module")
def shapes():
    rng = np.random.default_rng(3)
    big = [star(*rng.uniform(-2, 2, 2), rng.uniform(0.5, 2, rng.integers(8, 40))) for _ in range(12)]
    big += [[square(-1, -1, 1, 1), square(-0.5, -0.5, 0.5, 0.5, hole=True)], None, []]
    # Boundaries with many points, so that cutting sets in.
    big += [star(0, 0, 2 + 0.3 * np.sin(np.arange(900) / 9)), star(1.5, 0.5, rng.uniform(0.9, 1, 1500))]
    small = [star(*rng.uniform(-3, 3, 2), rng.uniform(0.05, 0.4, rng.integers(3, 12))) for _ in range(60)]
    small += [[square(x / 4, y / 4, x / 4 + 0.25, y / 4 + 0.25)] for x in range(-5, 5) for y in (-4, -2, 1, 3)]
    small += [[square(-3, -3, 3, 3)], [square(0.01, 0.01, 0.02, 0.02)], None]
    small += [small[0]] * 5  # a group of copies
    return big, small


@pytest.fixture(scope="module")
def expected(shapes):
    return brute(*shapes)


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("cell", [0.25, 1.0])
def test_overlay_matches_brute_force(spark, shapes, expected, broadcast, cell):
    left, right = layer(spark, shapes[0], "a"), layer(spark, shapes[1], "b")
    got = found(overlay.overlay_intersection(left, right, False, cell=cell, broadcast_left=broadcast))
    assert got.keys() == expected.keys()
    assert got == pytest.approx(expected, abs=1e-9)


def test_cutting_changes_nothing(spark, shapes, expected, monkeypatch):
    monkeypatch.setattr(windows, "CUT_NUMBERS", 30)
    monkeypatch.setattr(windows, "LADDER", 4)
    left, right = layer(spark, shapes[0], "a"), layer(spark, shapes[1], "b")
    got = found(overlay.overlay_intersection(left, right, False, cell=0.25, broadcast_left=True))
    assert got.keys() == expected.keys()
    assert got == pytest.approx(expected, abs=1e-9)


def test_shapes_of_many_sizes_find_their_level(spark):
    """Widths at and around powers of two of the cell, over one district."""
    sizes = [0.1 * 2**k * f for k in range(7) for f in (0.999, 1.0, 1.001)]
    right = [[square(0.3, 0.3, 0.3 + s, 0.3 + s)] for s in sizes]
    left = [[square(0, 0, 0.35, 0.35)], [square(6, 6, 7, 7)]]
    out = overlay.overlay_intersection(layer(spark, left, "a"), layer(spark, right, "b"), False, cell=0.1, broadcast_left=True)
    assert found(out).keys() == brute(left, right).keys()


def test_measured_size_bounds_what_is_sent(spark, shapes):
    left = layer(spark, shapes[0], "a").select("a", geom.pack_shape(F.col("rings")).alias("l_shape"), F.col("bbox").alias("l_bbox"))
    for cell, levels in ((0.25, 1), (0.25, 4), (1.0, 1)):
        m = windows.measure(left, cell, levels)
        rows = windows.window_rows(left, cell, levels, m.cut).agg(F.count(F.lit(1)), F.sum(F.size("l_shape"))).first()
        assert m.cut
        assert rows[0] <= m.windows
        assert 8 * rows[1] + 100 * rows[0] <= m.bytes


def test_too_large_to_broadcast_is_shuffled(spark, shapes, expected, monkeypatch):
    monkeypatch.setattr(overlay, "BROADCAST_BYTES", 10)
    left, right = layer(spark, shapes[0], "a"), layer(spark, shapes[1], "b")
    out = overlay.overlay_intersection(left, right, False, cell=1.0)
    assert found(out).keys() == expected.keys()


@pytest.mark.parametrize("hot_pairs, finest", [(3, 32), (3, 1), (100, 4)])
def test_hot_cells_are_divided_and_nothing_is_lost(spark, shapes, expected, monkeypatch, hot_pairs, finest):
    monkeypatch.setattr(cells, "HOT_PAIRS", hot_pairs)
    monkeypatch.setattr(cells, "FINEST", finest)
    left, right = layer(spark, shapes[0], "a"), layer(spark, shapes[1], "b")
    got = found(overlay.overlay_intersection(left, right, False, cell=2.0, broadcast_left=False))
    assert got.keys() == expected.keys()
    assert got == pytest.approx(expected, abs=1e-9)


def boxes(spark, shapes, name, side):
    return layer(spark, shapes, name).withColumnsRenamed({"bbox": f"{side}_bbox"}).drop("rings")


def test_copies_in_one_cell_spread_over_shares(spark, monkeypatch):
    monkeypatch.setattr(cells, "HOT_PAIRS", 50)
    right = boxes(spark, [[square(0.1, 0.1, 0.2, 0.2)]] * 1000, "b", "r")
    left = boxes(spark, [[square(0, 0, 0.9, 0.9)]], "a", "l")
    lc, rc, keys = cells.spread_hot(with_cells(left, "l_bbox", 1.0), with_cells(right, "r_bbox", 1.0), ["cx", "cy"])
    sizes = [r["count"] for r in rc.groupBy(*keys).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 100 and sum(sizes) == 1000
    assert lc.count() == 20
    assert cell_pairs(left, right, 1.0).count() == 1000


def test_small_shapes_in_one_cell_get_a_finer_grid(spark, monkeypatch):
    monkeypatch.setattr(cells, "HOT_PAIRS", 50)
    right = boxes(spark, [[square(i / 40, j / 40, i / 40 + 0.02, j / 40 + 0.02)] for i in range(38) for j in range(38)], "b", "r")
    left = boxes(spark, [[square(i / 10, 0.3, i / 10 + 0.04, 0.35)] for i in range(9)], "a", "l")
    lc, rc = with_cells(left, "l_bbox", 1.0), with_cells(right, "r_bbox", 1.0)
    sizes = cells.histogram(cells._width(lc, "l"), cells._width(rc, "r"), ["cx", "cy"], F.avg("width"))
    _, rc, keys = cells.refine(lc, rc, sizes, 1.0)
    assert rc.agg(F.max("fine")).first()[0] == 16  # as wide as the wider side's shapes
    assert rc.groupBy(*keys).count().agg(F.max("count")).first()[0] <= 16


def test_polygon_only_drops_touching_pairs(spark):
    left, right = layer(spark, [[square(0, 0, 1, 1)]], "a"), layer(
        spark, [[square(1, 0, 2, 1)], [square(1, 1, 2, 2)], [square(0.5, 0.5, 2, 2)]], "b"
    )
    assert found(overlay.overlay_intersection(left, right)) == {(0, 2): 0.25}
    touching = found(overlay.overlay_intersection(left, right, False))
    assert touching == {(0, 0): 0.0, (0, 1): 0.0, (0, 2): 0.25}


def test_result_is_a_layer_again(spark):
    left = layer(spark, [[square(0, 0, 2, 2), square(0.5, 0.5, 1, 1, hole=True)]], "a")
    right = layer(spark, [[ring((-1, -1), (1.5, -1), (1.5, 3), (-1, 3))]], "b")
    once = overlay.overlay_intersection(left, right, with_geometry=True).select("a", "rings", "bbox")
    third = layer(spark, [[square(0, 0, 9, 1)]], "b")
    assert found(overlay.overlay_intersection(once, third))[(0, 0)] == pytest.approx(1.25)


def test_same_names_get_suffixes(spark):
    left = layer(spark, [[square(0, 0, 1, 1)]], "Name")
    right = layer(spark, [[square(0, 0, 1, 1)]], "NAME")
    assert {"Name_1", "NAME_2"} <= set(overlay.overlay_intersection(left, right).columns)


def test_polygons_in_place(spark, shapes):
    place = [star(0, 0, [1.0] * 30)]
    got = overlay.within_place(layer(spark, shapes[1], "b"), layer(spark, place, "a"), "b")
    assert {r["b"] for r in got.collect()} == {j for _, j in brute(place, shapes[1])}


def test_suggested_cell(spark, shapes):
    assert 0.5 < suggest_cell(layer(spark, shapes[0], "a"), layer(spark, shapes[1], "b")) < 5


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_nested_loops_and_no_shuffle_of_the_large_side(spark, shapes):
    left, right = layer(spark, shapes[0], "a"), layer(spark, shapes[1], "b")
    for broadcast in (True, False):
        text = plan(overlay.overlay_intersection(left, right, broadcast_left=broadcast))
        assert "NestedLoop" not in text and "Cartesian" not in text
    text = plan(overlay.overlay_intersection(left, right, broadcast_left=True, cell=8.0))
    assert "BroadcastHashJoin" in text
    assert text.count("Exchange hashpartitioning") <= 1  # at most the district windows


def test_shuffled_join_reads_each_side_twice(spark, shapes, tmp_path):
    """Once to count boxes by cell, once to join."""
    for name, some in (("a", shapes[0]), ("b", shapes[1])):
        layer(spark, some, name).write.parquet(str(tmp_path / name))
    left, right = (spark.read.parquet(str(tmp_path / n)) for n in "ab")
    out = overlay.overlay_intersection(left, right, cell=1.0, broadcast_left=False)
    text = plan(out)
    assert text.count("FileScan parquet") == 2
    assert "NestedLoop" not in text and "Cartesian" not in text


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("touching", [True, False, None])
def test_sums_match_pairs(spark, shapes, expected, broadcast, touching):
    """Edge rows add up to what pairs have, also for shapes with holes, of many edges, empty, null and repeated."""
    left, right = layer(spark, shapes[0], "a"), layer(spark, shapes[1], "b").withColumn("n", F.lit(2.5))
    got = overlay.overlay_sums(left, right, ["a"], ("n",), touching, 1.0, broadcast).collect()
    want = {}
    for (i, _), area in expected.items():
        if touching or area > 0:
            own = want.setdefault(i, [0, 0.0])
            own[0], own[1] = own[0] + 1, own[1] + area
    got = {r["a"]: (r["pairs"], r["n"], r["area_deg"]) for r in got if touching is not None or r["area_deg"] > 1e-12}
    assert got.keys() == want.keys()
    for i, (pairs, n, area) in got.items():
        assert area == pytest.approx(want[i][1], abs=1e-9)
        if touching is not None:
            assert (pairs, n) == (want[i][0], 2.5 * want[i][0])


def test_sums_on_the_ground(spark, shapes):
    left, right = layer(spark, shapes[0], "a"), layer(spark, shapes[1], "b")
    pairs = overlay.overlay_intersection(left, right, False, cell=1.0).groupBy("a").agg(F.sum("area_ha").alias("ha")).collect()
    sums = {r["a"]: r["area_ha"] for r in overlay.overlay_sums(left, right, ["a"], cell=1.0).collect()}
    assert sums == pytest.approx({r["a"]: r["ha"] for r in pairs}, rel=1e-5, abs=1e-3)


def test_plain_shapes(spark):
    """Shapes that cross or touch themselves, turn back or have too many edges don't go the way of edge rows."""
    good = [
        [square(0, 0, 1, 1)], [ring((0, 0), (2, 0), (2, 2), (1, 0.5), (0, 2))], [square(0, 0, 4, 4), square(1, 1, 2, 2, hole=True)],
        [square(0, 0, 1, 1), square(2, 2, 3, 3, part=1)], [ring((0, 0), (1, 0), (1, 0), (1, 1))],
    ]
    bad = [
        [ring((0, 0), (1, 1), (1, 0), (0, 1))], [ring((0, 0), (1, 0), (2, 0), (1, 0), (1, 1))], [square(0, 0, 4, 4), square(0, 1, 2, 2, hole=True)],
        [ring((0, 0), (2, 0), (1, 1), (2, 2), (0, 2), (1, 1))], [], None, star(0, 0, [1.0] * 40), [square(0, 0, 1, 1), square(1, 1, 2, 2, part=1)],
    ]
    rows = layer(spark, good + bad, "i").select("i", areas.plain_edges(F.col("rings")).isNotNull().alias("plain"))
    assert {r["i"]: r["plain"] for r in rows.collect()} == {i: i < len(good) for i in range(len(good + bad))}


def test_edge_tests_run_on_whole_batches(spark, shapes):
    """No test of a shape's edges against each other, or of a pair's, runs as nested functions of arrays, row by row."""
    left, right = (materialized(layer(spark, shapes[i], n), n) for i, n in enumerate("ab"))
    for touching in (True, False, None):
        text = plan(overlay.overlay_sums(left, right, ["a"], touching=touching, cell=1.0))
        assert "exists(" not in text and "aggregate(" not in text


def test_plain_shapes_that_meet():
    """Edges that touch, a shape inside another, one in a hole, apart, and none."""
    outer, hole = [square(0, 0, 4, 4)], [square(0, 0, 4, 4), square(1, 1, 3, 3, hole=True)]
    cases = [
        (outer, [square(4, 4, 5, 5)], True), (outer, [square(1, 1, 2, 2)], True), ([square(1, 1, 2, 2)], outer, True),
        (hole, [square(1.5, 1.5, 2, 2)], False), ([square(1.5, 1.5, 2, 2)], hole, False), (hole, [square(1.5, 1.5, 3, 2)], True),
        (outer, [square(9, 9, 10, 10)], False), (outer, [square(9, 9, 10, 10), square(1, 1, 2, 2, part=1)], True), (outer, None, False),
    ]
    sides = [pa.array([packed(c[i]) for c in cases], pa.list_(pa.float64())) for i in (0, 1)]
    signed = [edges.plain_edges(side, 32) for side in sides]
    assert edges.meet(*signed).to_pylist() == [c[2] for c in cases]
    assert edges.meet(*[side.slice(0, 0) for side in signed]).to_pylist() == []


def test_each_pair_is_clipped_once(spark, shapes):
    """A filter on the result must not make Spark run the function again."""
    left, right = layer(spark, shapes[0], "a"), layer(spark, shapes[1], "b")
    for broadcast in (True, False):
        out = overlay.overlay_intersection(left, right, True, False, 8.0, broadcast)
        pairs = plan(out).split("AdaptiveSparkPlan")[1]
        assert pairs.count("ArrowEvalPython") == (3 if broadcast else 1)  # two cuts of the districts
