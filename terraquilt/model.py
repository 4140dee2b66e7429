"""Types and constants shared by every module.

A *layer* is a DataFrame with attribute columns plus

``rings``  the geometry: closed rings, exteriors counter-clockwise, holes
           clockwise, ``part`` numbering the polygons of a multi-polygon;
``bbox``   its bounding box, computed once when the layer is built.
"""

from __future__ import annotations

from pyspark.sql import types as T

POINT = T.StructType(
    [T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]
)
RING = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("hole", T.BooleanType()),
        T.StructField("pts", T.ArrayType(POINT)),
    ]
)
RINGS = T.ArrayType(RING)
#: Shapes of any kind: ``kind`` is point, line or polygon; a line has no holes and isn't closed, and each
#: point of a point path is one by itself.
PATHS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), *RING.fields]))
BBOX = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in ("xmin", "ymin", "xmax", "ymax")]
)

# Coordinate systems by EPSG number, and the GRS80 ellipsoid.
WGS84 = 4326
GDA94 = 4283
WEB_MERCATOR = 3857
EARTH_RADIUS_M = 6378137.0
GRS80_FLATTENING = 1 / 298.257222101
ECC2 = GRS80_FLATTENING * (2 - GRS80_FLATTENING)
ECC = ECC2**0.5

# Centre of the equal-area projection used when the caller names none (Sydney).
DEFAULT_LON0 = 151.2093
SQM_PER_HA = 10000.0

# Attribute schemas of the known inputs. Geometry arrives as WKB, WKT or GeoJSON.
FIRES_SCHEMA = (
    "FireNo string, FireName string, Label string, StartDate string, EndDate string, "
    "AreaHa double, wkt string"
)
LGA_SCHEMA = "STE_CODE16 int, LGA_CODE_2019 int, LGA_NAME19 string, WKB binary"
LANDUSE_SCHEMA = "Secondary string, geom_0 binary"
TOWERS_SCHEMA = (
    "radio string, mcc int, net int, area int, cell long, unit int, lon double, "
    "lat double, range int, samples int, changeable int, created long, updated long, "
    "averageSignal int"
)
CODES_SCHEMA = (
    "MCC int, MNC int, Network string, `Operator or brand name` string, Status string"
)
OCCURRENCES_SCHEMA = (
    "row_id long, Latitude double, Longitude double, "
    "`Scientific Name - original` string, `Local Government Areas 2011` string, "
    "`Event Date - parsed` string"
)
INDICATORS_SCHEMA = (
    "`Country Name` string, `Indicator Name` string, Year int, Value double"
)
