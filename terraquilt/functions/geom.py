"""Geometry as Column expressions: text codecs, projections, areas, boxes.

Everything here is a composition of built-in functions, so it prunes, folds and
pushes down like any other projection.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from terraquilt.model import (
    PATHS,
    RINGS,
    DEFAULT_LON0,
    EARTH_RADIUS_M,
    ECC,
    ECC2,
    GDA94,
    SQM_PER_HA,
    WEB_MERCATOR,
    WGS84,
)

_POLY = "array<array<array<double>>>"
_MULTI = "array<array<array<array<double>>>>"


# --- points and boxes --------------------------------------------------------

def point_xy(lon: Column, lat: Column) -> Column:
    return F.struct(lon.cast("double").alias("x"), lat.cast("double").alias("y"))


def box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return F.struct(
        xmin.alias("xmin"), ymin.alias("ymin"), xmax.alias("xmax"), ymax.alias("ymax")
    )


def all_points(rings: Column) -> Column:
    return F.flatten(F.transform(rings, lambda r: r["pts"]))


def bbox_of(rings: Column) -> Column:
    """Bounding box; null for a null or empty geometry."""
    xs = F.transform(all_points(rings), lambda p: p["x"])
    ys = F.transform(all_points(rings), lambda p: p["y"])
    return F.when(
        F.size(rings) > 0,
        box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)),
    )


def n_points(rings: Column) -> Column:
    return F.aggregate(rings, F.lit(0), lambda n, r: n + F.size(r["pts"]))


def pack_shape(rings: Column) -> Column:
    """Rings as one ``array<double>``: number of rings, then size and hole flag of
    each, then x and y of every point. Joins copy and send this form, which is
    contiguous, rather than nested structs."""
    head = F.flatten(
        F.transform(
            rings, lambda r: F.array(F.size(r["pts"]).cast("double"), r["hole"].cast("double"))
        )
    )
    xy = F.flatten(F.transform(all_points(rings), lambda p: F.array(p["x"], p["y"])))
    return F.concat(F.array(F.size(rings).cast("double")), head, xy)


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """One counter-clockwise rectangular ring."""
    return polygon([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])


def polygon(corners: list[tuple[Column, Column]]) -> Column:
    """A single ring through ``corners`` (counter-clockwise, closed here)."""
    pts = F.array(*[point_xy(x, y) for x, y in [*corners, corners[0]]])
    return F.array(
        F.struct(
            F.lit(0).alias("part"), F.lit(False).alias("hole"), pts.alias("pts")
        )
    )


# --- projections -------------------------------------------------------------

def cea_x(lon: Column, lon0: float | Column = DEFAULT_LON0) -> Column:
    return F.radians(lon - lon0) * EARTH_RADIUS_M


def cea_y(lat: Column) -> Column:
    s = F.sin(F.radians(lat))
    q = (1 - ECC2) * (
        s / (1 - ECC2 * s * s) - F.log((1 - ECC * s) / (1 + ECC * s)) / (2 * ECC)
    )
    return q * (EARTH_RADIUS_M / 2)


def to_cea(lon: Column, lat: Column, lon0: float | Column = DEFAULT_LON0) -> Column:
    """Degrees to cylindrical equal-area metres (GRS80, true at the equator)."""
    return F.struct(cea_x(lon, lon0).alias("x"), cea_y(lat).alias("y"))


def to_web_mercator(lon: Column, lat: Column) -> Column:
    """EPSG:4326 degrees to EPSG:3857 metres."""
    return F.struct(
        (F.radians(lon) * EARTH_RADIUS_M).alias("x"),
        (F.log(F.tan(F.radians(lat) / 2 + F.lit(0.7853981633974483))) * EARTH_RADIUS_M).alias("y"),
    )


def reproject_points(lon: Column, lat: Column, crs: int | str, lon0: float = DEFAULT_LON0) -> Column:
    """Degrees to the named system. WGS84 and GDA94 differ by less than two
    metres and are treated as the same degrees."""
    if crs in (WGS84, GDA94):
        return point_xy(lon, lat)
    if crs == WEB_MERCATOR:
        return to_web_mercator(lon, lat)
    if crs == "cea":
        return to_cea(lon, lat, lon0)
    raise ValueError(f"unsupported coordinate system: {crs}")


def reproject_rings(rings: Column, crs: int | str, lon0: float = DEFAULT_LON0) -> Column:
    """Rings in degrees with every vertex in the named system."""
    return F.transform(
        rings,
        lambda r: F.struct(
            r["part"].alias("part"), r["hole"].alias("hole"),
            F.transform(r["pts"], lambda p: reproject_points(p["x"], p["y"], crs, lon0)).alias("pts"),
        ),
    )


# --- areas and centres -------------------------------------------------------

# Python functions cannot be fed from an inner lambda that uses a variable of an
# outer one (Spark then fails to run them), so no lambda below reaches outwards:
# what an edge walk needs to remember travels in its accumulator.

def _fold_edges(pts: Column, project: Callable, term: Callable) -> Column:
    """Sum ``term(p, q)`` over the edges of a closed ring. Points are taken
    relative to the first one, which keeps the products small."""
    ox, oy = project(pts[0])

    def state(s, x, y, ox, oy) -> Column:
        named = zip(("s", "x", "y", "ox", "oy"), (s, x, y, ox, oy))
        return F.struct(*[c.alias(n) for n, c in named])

    def step(acc: Column, p: Column) -> Column:
        x, y = project(p)
        x, y = x - acc["ox"], y - acc["oy"]
        return state(acc["s"] + term((acc["x"], acc["y"]), (x, y)), x, y, acc["ox"], acc["oy"])

    zero = F.lit(0.0)
    return F.aggregate(pts, state(zero, zero, zero, ox, oy), step, lambda acc: acc["s"])


def _cross(p, q):
    return (p[0] * q[1] - q[0] * p[1]) / 2


def _degrees(p: Column):
    return p["x"], p["y"]


def _cea(lon0: float | Column):
    return lambda p: (cea_x(p["x"], lon0), cea_y(p["y"]))


def _signed_sum(rings: Column, per_ring: Callable[[Column], Column]) -> Column:
    return F.aggregate(rings, F.lit(0.0), lambda total, r: total + per_ring(r))


def area_ha(rings: Column, lon0: float | Column = DEFAULT_LON0) -> Column:
    """Equal-area hectares; holes subtract. ``lon0`` shifts x only, so the
    result does not depend on it beyond rounding."""
    def one(r: Column) -> Column:
        a = F.abs(_fold_edges(r["pts"], _cea(lon0), _cross))
        return F.when(r["hole"], -a).otherwise(a)

    return _signed_sum(rings, one) / SQM_PER_HA


def area_degrees(rings: Column) -> Column:
    """Planar area in square degrees (a consistency measure, not an area)."""
    def one(r: Column) -> Column:
        a = F.abs(_fold_edges(r["pts"], _degrees, _cross))
        return F.when(r["hole"], -a).otherwise(a)

    return _signed_sum(rings, one)


def polygon_area(wkt: Column, lon0: float | Column = DEFAULT_LON0) -> Column:
    return area_ha(rings_from_wkt(wkt), lon0)


def centroid_sums(rings: Column) -> Column:
    """struct(area, mx, my): planar area and first moments, which add up over
    rings, polygons and whole layers."""
    def moments(r: Column) -> Column:
        first = r["pts"][0]
        area = _fold_edges(r["pts"], _degrees, _cross)
        mx = _fold_edges(r["pts"], _degrees, lambda p, q: (p[0] + q[0]) * (p[0] * q[1] - q[0] * p[1]) / 6)
        my = _fold_edges(r["pts"], _degrees, lambda p, q: (p[1] + q[1]) * (p[0] * q[1] - q[0] * p[1]) / 6)
        sign = F.when((area > 0) == r["hole"], -1.0).otherwise(1.0)
        return F.struct(
            (sign * area).alias("area"),
            (sign * (mx + first["x"] * area)).alias("mx"),
            (sign * (my + first["y"] * area)).alias("my"),
        )

    zero = F.struct(F.lit(0.0).alias("area"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
    return F.aggregate(
        F.transform(rings, moments),
        zero,
        lambda a, m: F.struct(
            (a["area"] + m["area"]).alias("area"),
            (a["mx"] + m["mx"]).alias("mx"),
            (a["my"] + m["my"]).alias("my"),
        ),
    )


def normalize(rings: Column) -> Column:
    """Exteriors counter-clockwise, holes clockwise."""
    def turn(r: Column) -> Column:
        ccw = _fold_edges(r["pts"], _degrees, _cross) > 0
        return F.struct(
            r["part"].alias("part"),
            r["hole"].alias("hole"),
            F.when(ccw == r["hole"], F.reverse(r["pts"])).otherwise(r["pts"]).alias("pts"),
        )

    return F.transform(rings, turn)


def snap(rings: Column, decimals: int = 9) -> Column:
    """Round coordinates to a fixed grid, so that vertices two layers share in
    intent are equal in value."""
    return F.transform(
        rings,
        lambda r: F.struct(
            r["part"].alias("part"),
            r["hole"].alias("hole"),
            F.transform(
                r["pts"],
                lambda p: F.struct(
                    F.round(p["x"], decimals).alias("x"), F.round(p["y"], decimals).alias("y")
                ),
            ).alias("pts"),
        ),
    )


# --- nested coordinates <-> rings --------------------------------------------

def _numbered_rings(parts: Column) -> Column:
    def numbered(poly: Column, i: Column) -> Column:
        no = F.transform(poly, lambda ring, j: j)
        return F.arrays_zip(poly, F.array_repeat(i, F.size(poly)), no).cast(
            "array<struct<ring:array<array<double>>,part:int,no:int>>"
        )

    return F.transform(
        F.flatten(F.transform(parts, numbered)),
        lambda z: F.struct(
            z["part"].alias("part"),
            (z["no"] > 0).alias("hole"),
            F.transform(z["ring"], lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("pts"),
        ),
    )


def rings_from_parts(parts: Column) -> Column:
    """array<polygon<ring<[x, y]>>> to normalised rings."""
    return normalize(_numbered_rings(parts))


def _or_raise(rings: Column, good: Column, source: Column, lenient: bool, kind=RINGS) -> Column:
    """rings where the text was good; elsewhere an error that names it, or no rings."""
    if lenient:
        return F.when(source.isNull(), F.lit(None)).when(good, rings).otherwise(F.array())
    said = F.concat(F.lit("not a geometry: "), F.substring(source.cast("string"), 1, 80))
    failed = F.raise_error(said).cast(kind)
    return F.when(source.isNull(), F.lit(None)).when(good, rings).otherwise(failed)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: One shape of a collection. Possessive repeats: they neither backtrack nor recurse, so a shape may have any
#: number of brackets.
_WKT_SHAPE = (
    r"(?:MULTI)?(?:POINT|LINESTRING|LINEARRING|POLYGON)\s*(?:ZM|Z|M)?\s*"
    r"(?:EMPTY|\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\))"
)
_WKT_HEAD = r"^[A-Z]+\s*(?:ZM|Z|M)?\s*(?=\(|EMPTY$)"


def _wkt_shape(text: Column) -> Column:
    """struct(kind, parts) of one shape's text: kind is point, line or polygon, and parts nested
    coordinates of three levels, null where the text isn't right."""
    def read(t: Column) -> Column:
        name = F.regexp_replace(F.regexp_extract(t, "^[A-Z]+", 0), "(ZM|Z|M)$", "")
        shape = F.regexp_replace(t, _WKT_HEAD, "")
        nested = (
            F.when(name == "POLYGON", F.concat(F.lit("("), shape, F.lit(")")))
            .when(name == "MULTIPOLYGON", shape)
            .when(name == "MULTILINESTRING", F.concat(F.lit("("), shape, F.lit(")")))
            .when(name == "MULTIPOINT", F.concat(F.lit("((("), F.translate(shape, "()", ""), F.lit(")))")))
            .when(name.isin("POINT", "LINESTRING", "LINEARRING"), F.concat(F.lit("(("), shape, F.lit("))")))
        )
        # "x y" pairs first, then the brackets that are left; a third and fourth
        # coordinate are dropped.
        number = r"([-+0-9.E]+)"
        nested = F.regexp_replace(nested, number + r"\s+" + number + r"(?:\s+[-+0-9.E]+)*+", "[$1,$2]")
        parts = F.from_json(F.translate(nested, "()", "[]"), _MULTI)
        empty = t.rlike(r"(EMPTY|[A-Z ]\(\s*\))$") & name.rlike("^(MULTI)?(POINT|LINESTRING|LINEARRING|POLYGON)$")
        kind = F.when(name.endswith("POINT"), "point").when(name.endswith("POLYGON"), "polygon").otherwise("line")
        return F.struct(kind.alias("kind"), F.when(empty, F.array().cast(_MULTI)).otherwise(parts).alias("parts"))

    return let(text, read)


def _wkt_shapes(wkt: Column) -> Column:
    """The shapes of a text, with or without Z, M and a leading SRID; those of a GEOMETRYCOLLECTION; null
    where the text is none."""
    def read(body: Column) -> Column:
        even = F.length(F.replace(body, F.lit("("))) == F.length(F.replace(body, F.lit(")")))
        members = F.transform(F.regexp_extract_all(body, F.lit(_WKT_SHAPE), F.lit(0)), _wkt_shape)
        shapes = F.when(body.startswith("GEOMETRYCOLLECTION"), members).otherwise(F.array(_wkt_shape(body)))
        return F.when(even & body.rlike(_WKT_HEAD), shapes)

    return let(F.upper(F.trim(F.regexp_replace(wkt, r"(?i)^\s*SRID\s*=\s*\d+\s*;", ""))), read)


def _whole(shapes: Column) -> Column:
    """Whether every shape was understood, to its last point."""
    def bad_point(p: Column) -> Column:
        return p.isNull() | (F.size(p) < 2) | p[0].isNull() | p[1].isNull()

    def bad(s: Column) -> Column:
        return s["parts"].isNull() | F.exists(s["parts"], lambda poly: poly.isNull() | F.exists(poly, lambda ring: ring.isNull() | F.exists(ring, bad_point)))

    return F.coalesce(~F.exists(shapes, bad), F.lit(False))


def _rings(shapes: Column) -> Column:
    polygons = F.filter(shapes, lambda s: s["kind"] == "polygon")
    return rings_from_parts(F.filter(F.flatten(F.transform(polygons, lambda s: s["parts"])), lambda p: F.size(p) > 0))


def _paths(shapes: Column) -> Column:
    """All shapes as paths: struct(kind, part, hole, pts), polygons normalised like rings."""
    def one(s: Column) -> Column:
        parts = F.filter(s["parts"], lambda p: F.size(p) > 0)
        rings = F.when(s["kind"] == "polygon", rings_from_parts(parts)).otherwise(_numbered_rings(parts))
        return F.transform(
            rings, lambda r: F.struct(s["kind"].alias("kind"), r["part"].alias("part"), r["hole"].alias("hole"), r["pts"].alias("pts"))
        )

    return F.flatten(F.transform(shapes, one))


def rings_from_wkt(wkt: Column, lenient: bool = False) -> Column:
    """POLYGON, MULTIPOLYGON and what a GEOMETRYCOLLECTION has of them to rings, with or
    without Z, M and a leading SRID. Points and lines have no rings; empty shapes give an
    empty array, null gives null; other text raises, or gives an empty array if ``lenient``.
    The text is rewritten to JSON, then parsed once."""
    return let(_wkt_shapes(wkt), lambda s: _or_raise(F.coalesce(_rings(s), F.array()), _whole(s), wkt, lenient))


def paths_from_wkt(wkt: Column, lenient: bool = False) -> Column:
    """Points, lines and polygons of any WKT as paths: array<struct<kind, part, hole, pts>>."""
    return let(_wkt_shapes(wkt), lambda s: _or_raise(F.coalesce(_paths(s), F.array()), _whole(s), wkt, lenient, PATHS))


def _geojson_shapes(geometry: Column) -> Column:
    shape = "type:string,coordinates:string"

    def one(m: Column) -> Column:
        text, kind = m["coordinates"], m["type"]
        line = F.array(F.array(F.from_json(text, "array<array<double>>")))
        parts = (
            F.when(kind == "Polygon", F.array(F.from_json(text, _POLY)))
            .when(kind == "MultiPolygon", F.from_json(text, _MULTI))
            .when(kind.isin("LineString", "MultiPoint"), line)
            .when(kind == "MultiLineString", F.array(F.from_json(text, _POLY)))
            .when(kind == "Point", F.array(F.array(F.array(F.from_json(text, "array<double>")))))
        )
        # An empty shape has no points that could be wrong.
        known = kind.rlike("^(Multi)?(Point|LineString|Polygon)$")
        parts = F.when(known & text.rlike(r"^\s*\[\s*\]\s*$"), F.array().cast(_MULTI)).otherwise(parts)
        name = F.when(kind.endswith("Point"), "point").when(kind.endswith("Polygon"), "polygon").otherwise("line")
        return F.struct(name.alias("kind"), parts.alias("parts"))

    def read(parsed: Column) -> Column:
        alone = F.array(F.struct(parsed["type"].alias("type"), parsed["coordinates"].alias("coordinates")))
        members = F.when(parsed["type"] == "GeometryCollection", F.coalesce(parsed["geometries"], F.array())).otherwise(alone)
        return F.when(parsed["type"].isNotNull(), F.transform(members, one))

    return let(F.from_json(geometry, f"struct<{shape},geometries:array<struct<{shape}>>>"), read)


def rings_from_geojson(geometry: Column, lenient: bool = False) -> Column:
    """GeoJSON geometry text (Polygon, MultiPolygon, or a GeometryCollection's) to rings. Points
    and lines have no rings; other text raises, or gives an empty array if ``lenient``."""
    return let(_geojson_shapes(geometry), lambda s: _or_raise(F.coalesce(_rings(s), F.array()), _whole(s), geometry, lenient))


def paths_from_geojson(geometry: Column, lenient: bool = False) -> Column:
    """Points, lines and polygons of any GeoJSON geometry as paths."""
    return let(_geojson_shapes(geometry), lambda s: _or_raise(F.coalesce(_paths(s), F.array()), _whole(s), geometry, lenient, PATHS))


def _nested_text(rings: Column, pair: Callable, opening: str, closing: str, sep: str) -> Column:
    """Text of all polygons. The rings of a part stand together with the exterior
    first, so each exterior closes the polygon before it; one pass, no regrouping."""
    def ring(r: Column, i: Column) -> Column:
        lead = (
            F.when(r["hole"], sep)
            .when(i == 0, opening)
            .otherwise(closing + sep + opening)
        )
        return F.concat(
            lead, F.lit(opening), F.array_join(F.transform(r["pts"], pair), sep), F.lit(closing)
        )

    return F.concat(F.array_join(F.transform(rings, ring), ""), F.lit(closing))


def _is_single(rings: Column) -> Column:
    return rings[0]["part"] == F.element_at(rings, -1)["part"]


def to_wkt(rings: Column) -> Column:
    body = _nested_text(
        rings,
        lambda p: F.concat(p["x"].cast("string"), F.lit(" "), p["y"].cast("string")),
        "(", ")", ", ",
    )
    return (
        F.when(F.size(rings) == 0, F.lit("POLYGON EMPTY"))
        .when(_is_single(rings), F.concat(F.lit("POLYGON "), body))
        .when(rings.isNotNull(), F.concat(F.lit("MULTIPOLYGON ("), body, F.lit(")")))
    )


def to_geojson(rings: Column) -> Column:
    """Geometry text: Polygon for one part, MultiPolygon for more."""
    body = _nested_text(
        rings,
        lambda p: F.concat(F.lit("["), p["x"].cast("string"), F.lit(","), p["y"].cast("string"), F.lit("]")),
        "[", "]", ",",
    )
    def geometry(kind: str, coordinates: Column) -> Column:
        return F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), coordinates, F.lit("}"))

    return (
        F.when(F.size(rings) == 0, geometry("Polygon", F.lit("[]")))
        .when(_is_single(rings), geometry("Polygon", body))
        .when(rings.isNotNull(), geometry("MultiPolygon", F.concat(F.lit("["), body, F.lit("]"))))
    )


# --- paths: shapes of any kind ------------------------------------------------

def as_paths(rings: Column) -> Column:
    """Rings as paths of kind polygon."""
    return F.transform(
        rings, lambda r: F.struct(F.lit("polygon").alias("kind"), r["part"].alias("part"), r["hole"].alias("hole"), r["pts"].alias("pts"))
    )


def point_path(lon: Column, lat: Column) -> Column:
    """A single point as paths."""
    spot = F.array(point_xy(lon, lat))
    return F.array(F.struct(F.lit("point").alias("kind"), F.lit(0).alias("part"), F.lit(False).alias("hole"), spot.alias("pts")))


def line_path(corners: list[tuple[Column, Column]]) -> Column:
    """A single line through ``corners`` as paths."""
    pts = F.array(*[point_xy(x, y) for x, y in corners])
    return F.array(F.struct(F.lit("line").alias("kind"), F.lit(0).alias("part"), F.lit(False).alias("hole"), pts.alias("pts")))


def paths_to_wkt(paths: Column) -> Column:
    """POINT, LINESTRING, POLYGON or MULTIPOLYGON, or a GEOMETRYCOLLECTION of several of them."""
    def pair(p: Column) -> Column:
        return F.concat(p["x"].cast("string"), F.lit(" "), p["y"].cast("string"))

    def line(r: Column) -> Column:
        return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(r["pts"], pair), ", "), F.lit(")"))

    def of(kind: str) -> Column:
        return F.filter(paths, lambda r: r["kind"] == kind)

    spots = F.transform(F.flatten(F.transform(of("point"), lambda r: r["pts"])), lambda p: F.concat(F.lit("POINT ("), pair(p), F.lit(")")))
    polygons = F.when(F.size(of("polygon")) > 0, F.array(to_wkt(of("polygon")))).otherwise(F.array())
    each = F.concat(spots, F.transform(of("line"), line), polygons)
    return let(each, lambda a: F.when(F.size(a) == 1, a[0]).otherwise(F.concat(F.lit("GEOMETRYCOLLECTION ("), F.array_join(a, ", "), F.lit(")"))))
