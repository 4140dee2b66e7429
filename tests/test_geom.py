"""Column geometry, codecs and simplification."""

import math
import struct

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from shapes import ring, row, shoelace, square, star

from terraquilt.functions import geom
from terraquilt.functions.codec import rings_from_wkb, simplify, to_wkb
from terraquilt.model import ECC, ECC2, EARTH_RADIUS_M, RINGS
from terraquilt.operators.stats import layer_center

SHAPES = [
    [square(0, 0, 4, 4), square(1, 1, 3, 3, hole=True)],
    [square(150, -34, 151, -33), square(152.5, -34, 153, -33.25, part=1)],
    [square(0, 0, 4, 4), square(1, 1, 2, 2, hole=True), square(5, 5, 6, 6, part=1), square(5.25, 5.25, 5.5, 5.5, part=1, hole=True)],
    [ring((0, 0), (0, 1), (1, 1), (1, 0))],  # clockwise
    [],
    None,
]


@pytest.fixture(scope="module")
def shapes(spark):
    rows = [(i, row(s)) for i, s in enumerate(SHAPES)]
    return spark.createDataFrame(rows, "id int, rings " + RINGS.simpleString())


def by_id(df):
    return {r["id"]: r[1] for r in df.collect()}


@pytest.mark.parametrize(
    "encode, decode",
    [(geom.to_wkt, geom.rings_from_wkt), (geom.to_geojson, geom.rings_from_geojson), (to_wkb, rings_from_wkb)],
)
def test_round_trips(shapes, encode, decode):
    whole = shapes.withColumn("rings", geom.normalize(F.col("rings")))
    back = whole.select("id", encode(F.col("rings")).alias("g")).select("id", decode(F.col("g")))
    assert by_id(back) == by_id(whole)


def test_wkt_spellings(spark):
    texts = {
        "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))": 1.0,
        "polygon((0 0,1 0,1 1,0 1,0 0))": 1.0,
        "POLYGON Z ((0 0 5, 1 0 5, 1 1 5, 0 1 5, 0 0 5))": 1.0,
        "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((2 0, 3 0, 3 1, 2 0)))": 1.0,
        "POLYGON ((0 0, 1e1 0, 1e1 1.5E0, 0 1.5, 0 0))": 15.0,
        "POLYGON EMPTY": 0.0,
        "POINT (1 2)": 0.0,
    }
    df = spark.createDataFrame(list(texts), "string").select(
        "value", geom.area_degrees(geom.rings_from_wkt(F.col("value"))).alias("a")
    )
    assert {r["value"]: r["a"] for r in df.collect()} == pytest.approx(texts)


def test_wkb_variants(spark):
    pts = [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 0.0)]
    big = struct.pack(">BII", 0, 3, 1) + struct.pack(">I", 4) + b"".join(struct.pack(">dd", *p) for p in pts)
    srid = struct.pack("<BII", 1, 3 | 0x20000000, 4283) + struct.pack("<II", 1, 4) + b"".join(struct.pack("<dd", *p) for p in pts)
    with_z = struct.pack("<BII", 1, 1003, 1) + struct.pack("<I", 4) + b"".join(struct.pack("<ddd", *p, 9.0) for p in pts)
    point = struct.pack("<BIdd", 1, 1, 1.0, 2.0)
    df = spark.createDataFrame([(bytearray(b),) for b in (big, srid, with_z, point)], "g binary")
    areas = [r[0] for r in df.select(geom.area_degrees(rings_from_wkb(F.col("g")))).collect()]
    assert areas == pytest.approx([1.0, 1.0, 1.0, 0.0])


def test_orientation_is_normalised(shapes):
    turned = by_id(shapes.select("id", geom.normalize(F.col("rings"))))
    first = turned[3][0]["pts"]
    assert [(p["x"], p["y"]) for p in first][1] == (1.0, 0.0)


def test_planar_area_and_boxes(shapes):
    areas = by_id(shapes.select("id", geom.area_degrees(F.col("rings"))))
    assert areas == {i: None if s is None else pytest.approx(shoelace(s)) for i, s in enumerate(SHAPES)}
    boxes = by_id(shapes.select("id", geom.bbox_of(F.col("rings"))))
    assert tuple(boxes[1]) == (150.0, -34.0, 153.0, -33.0)
    assert boxes[4] is None and boxes[5] is None


def _q(lat):
    s = math.sin(math.radians(lat))
    return (1 - ECC2) * (s / (1 - ECC2 * s * s) - math.log((1 - ECC * s) / (1 + ECC * s)) / (2 * ECC))


def test_equal_area(spark, shapes):
    got = by_id(shapes.select("id", geom.area_ha(F.col("rings"))))[1]
    a2 = EARTH_RADIUS_M**2 / 2 / 1e4
    want = a2 * (math.radians(1) * (_q(-33) - _q(-34)) + math.radians(0.5) * (_q(-33.25) - _q(-34)))
    assert got == pytest.approx(want, rel=1e-12)
    elsewhere = by_id(shapes.select("id", geom.area_ha(F.col("rings"), 20.0)))[1]
    assert elsewhere == pytest.approx(got, rel=1e-12)
    globe = spark.range(1).select(geom.area_ha(geom.rectangle(*[F.lit(v) for v in (-180.0, -90.0, 180.0, 90.0)])))
    assert globe.first()[0] == pytest.approx(510065621.7 * 100, rel=1e-9)  # published area of the ellipsoid, ha


def test_web_mercator(spark):
    m = spark.range(1).select(geom.to_web_mercator(F.lit(180.0), F.lit(45.0)).alias("p")).first()["p"]
    assert m["x"] == pytest.approx(20037508.342789244)
    assert m["y"] == pytest.approx(5621521.486192066)


def test_layer_center(spark, shapes):
    got = layer_center(shapes.where("id = 1")).first()
    assert got["lon0"] == pytest.approx((150.5 * 1 + 152.75 * 0.375) / 1.375)
    assert got["lat0"] == pytest.approx((-33.5 * 1 + -33.625 * 0.375) / 1.375)


def test_simplify_keeps_tolerance_and_small_rings(spark):
    wavy = [(0.0, 0.0)] + [(i / 100, 0.0004 * (i % 2)) for i in range(1, 100)] + [(1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    tiny = [(0.0, 0.0), (0.0005, 0.0), (0.0005, 0.0005)]
    df = spark.createDataFrame([(row([ring(*wavy)]),), (row([ring(*tiny)]),), (None,)], "rings " + RINGS.simpleString())
    out = [r[0] for r in df.select(simplify(F.col("rings"), 0.001)).collect()]
    assert [(p["x"], p["y"]) for p in out[0][0]["pts"]] == [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    assert len(out[1][0]["pts"]) == 4
    assert out[2] is None


def test_simplify_does_not_cross_itself(spark):
    # A thin spike whose base would be cut off by simplification at this tolerance.
    spike = ring((0, 0), (1, 0), (1, 1), (0.52, 0.05), (0.5, -0.04), (0.48, 0.05), (0, 1))
    df = spark.createDataFrame([(row([spike]),)], "rings " + RINGS.simpleString())
    thin = df.select(simplify(F.col("rings"), 0.2).alias("rings")).select(geom.n_points(F.col("rings")), geom.area_degrees(F.col("rings"))).first()
    assert thin[0] >= 4 and thin[1] > 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0.2, 1.0), min_size=8, max_size=60))
def test_simplify_points_are_near(spark, radii):
    shape = star(0, 0, radii)
    df = spark.createDataFrame([(row(shape),)], "rings " + RINGS.simpleString())
    out = df.select(simplify(F.col("rings"), 0.05)).first()[0][0]["pts"]
    kept = [(p["x"], p["y"]) for p in out]
    assert kept[0] == kept[-1] == tuple(map(float, shape[0][2][0]))

    def off(p):
        best = math.inf
        for (x0, y0), (x1, y1) in zip(kept, kept[1:]):
            dx, dy = x1 - x0, y1 - y0
            t = 0 if dx == dy == 0 else max(0, min(1, ((p[0] - x0) * dx + (p[1] - y0) * dy) / (dx * dx + dy * dy)))
            best = min(best, math.hypot(p[0] - x0 - t * dx, p[1] - y0 - t * dy))
        return best

    assert all(off(p) <= 0.05 + 1e-12 for p in shape[0][2])


def test_unusual_text_is_read_and_bad_text_raises(spark):
    ring = "(0 0 9 9, 1 0 9 9, 1 1 9 9, 0 0 9 9)"
    texts = {
        f"POLYGON ZM ({ring})": 0.5, f"polygon z({ring})": 0.5, f"SRID=4283;POLYGON({ring})": 0.5, f"MULTIPOLYGON M (({ring}), ({ring.replace('1', '2')}))": 2.5,
        f"GEOMETRYCOLLECTION (POINT (3 4), POLYGON ({ring}), MULTIPOINT ((1 2), (3 4)), MULTIPOLYGON (({ring})))": 1.0,
        "POLYGON EMPTY": 0, "POINT (1 2)": 0, "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))": 0, "GEOMETRYCOLLECTION EMPTY": 0,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["a"] for r in df.select("t", geom.area_degrees(geom.rings_from_wkt(F.col("t"))).alias("a")).collect()}
    assert {t: a or 0 for t, a in got.items()} == pytest.approx(texts)
    bad = ["POLYGON ((0 0, 1 0, 1 1", "garbage", "POLYGON", "POLYGON ((0 0, x 1, 1 1, 0 0))", ""]
    for t in bad:
        one = spark.createDataFrame([(t,)], "t string")
        with pytest.raises(Exception, match="not a geometry"):
            one.select(geom.rings_from_wkt(F.col("t"))).collect()
        assert one.select(geom.rings_from_wkt(F.col("t"), lenient=True)).first()[0] == []
    for t in ("{", '{"type": "Polygon"}', '{"type": "Circle", "coordinates": []}'):
        one = spark.createDataFrame([(t,)], "t string")
        with pytest.raises(Exception, match="not a geometry"):
            one.select(geom.rings_from_geojson(F.col("t"))).collect()
        assert one.select(geom.rings_from_geojson(F.col("t"), lenient=True)).first()[0] == []


def test_unusual_binary_is_read_and_bad_binary_raises(spark):
    def polygon(order="<"):
        pts = [0.0, 0.0, 1.0, 0.0, 1.0, 1.0, 0.0, 0.0]
        return struct.pack(order + "BIII", order == "<", 3, 1, 4) + struct.pack(order + "8d", *pts)

    point = struct.pack("<BIdd", 1, 1, 5.0, 5.0)
    line = struct.pack("<BII4d", 1, 2, 2, 0, 0, 1, 1)
    blobs = [polygon(), polygon(">"), point, line, struct.pack("<BII", 1, 7, 4) + polygon() + point + line + polygon(">")]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(blobs)], "i int, b binary")
    got = {r["i"]: r["a"] or 0 for r in df.select("i", geom.area_degrees(rings_from_wkb(F.col("b"))).alias("a")).collect()}
    assert got == pytest.approx({0: 0.5, 1: 0.5, 2: 0, 3: 0, 4: 1.0})
    for b in (polygon()[:-3], b"\x09abc", b"", struct.pack("<BI", 1, 99)):
        one = spark.createDataFrame([(b,)], "b binary")
        with pytest.raises(Exception):
            one.select(rings_from_wkb(F.col("b"))).collect()
        assert one.select(rings_from_wkb(F.col("b"), lenient=True)).first()[0] == []


def test_binary_of_one_ring_and_others_together(spark):
    """Polygons of one ring are read and written together, others one by one, in any mixture and order."""
    rng = np.random.default_rng(3)
    one = [star(0, 0, rng.uniform(0.5, 1, n)) for n in (3, 4, 30, 200)]
    other = [None, [], [ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((1, 1), (1, 2), (2, 2), hole=True)], [*one[0], *[(1, False, xy + 9) for _, _, xy in one[1]]]]
    shapes = [s for k in range(30) for s in (one[k % 4], other[k % 4], one[(k + 1) % 4])]
    for some in (shapes, one, other, []):
        data = [(i, row(s)) for i, s in enumerate(some)]
        df = spark.createDataFrame(data, "i int, rings " + RINGS.simpleString()).withColumn("rings", geom.normalize(F.col("rings")))
        blobs = df.select("i", "rings", to_wkb(F.col("rings")).alias("b"))
        for r in blobs.withColumn("back", rings_from_wkb(F.col("b"))).collect():
            assert r["back"] == r["rings"]
            if r["rings"] and len(r["rings"]) == 1:
                pts = [v for p in r["rings"][0]["pts"] for v in (p["x"], p["y"])]
                assert bytes(r["b"]) == struct.pack(f"<BIII{len(pts)}d", 1, 3, 1, len(pts) // 2, *pts)
