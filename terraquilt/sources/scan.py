"""Reading tables and layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraquilt.functions.codec import rings_from_wkb
from terraquilt.functions.geom import (
    bbox_of,
    normalize,
    paths_from_geojson,
    paths_from_wkt,
    reproject_rings,
    rings_from_geojson,
    rings_from_wkt,
    snap,
)
from terraquilt.model import DEFAULT_LON0, GDA94, WGS84
from terraquilt.operators.overlay import within_place
from terraquilt.sources import collection


def scan_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.read.table(name)


def scan_csv(spark: SparkSession, path: str, schema: str | None = None, line_breaks: bool = False) -> DataFrame:
    """CSV with a header, text quoted where needed and quotes doubled. A file is read in as many splits as it is long. With
    ``line_breaks`` a text may hold some, and then each file is one task's. Without a schema the types are
    inferred, which reads the file one more time. Nothing between two separators is null; an empty text is quoted."""
    # nullValue is what the parser returns for nothing at all; an empty text must differ from it
    reader = spark.read.options(header=True, multiLine=line_breaks, quote='"', escape='"', emptyValue="", nullValue="\x00")
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def balanced(df: DataFrame) -> DataFrame:
    """A scan with fewer partitions than the cluster has cores (one small file,
    say) spread over all of them, while its rows are still narrow. A scan that
    is already wide enough is left alone. Meant for plain scans: looking at the
    partitions of a query with shuffles would run it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def scan_external(spark: SparkSession, fmt: str, options: dict, table: str | None = None) -> DataFrame:
    """Any installed connector; credentials come in with ``options``."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.option("dbtable", table) if table else reader).load()


def from_local(spark: SparkSession, rows: list, schema) -> DataFrame:
    """Driver rows to a DataFrame, for tests and small lookups only."""
    return spark.createDataFrame(rows, schema)


def union_code_tables(tables: list[DataFrame]) -> DataFrame:
    """Stack lookup tables by column name; a column one of them lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def as_layer(df: DataFrame, rings: Column, srid: int = GDA94, decimals: int | None = None,
             drop: tuple = ()) -> DataFrame:
    """Attach geometry: ``rings`` and its ``bbox``, the system in the column's
    metadata. Raw geometry columns are dropped here so no join carries them."""
    shape = normalize(rings) if decimals is None else normalize(snap(rings, decimals))
    out = df.withColumn("rings", shape).drop(*drop)
    out = out.withMetadata("rings", {"srid": srid})
    return out.withColumn("bbox", bbox_of(F.col("rings")))


def reproject_layer(layer: DataFrame, crs: int | str, lon0: float = DEFAULT_LON0) -> DataFrame:
    """A layer in degrees with rings, box and system of another: an EPSG number or "cea"."""
    if srid_of(layer) not in (None, WGS84, GDA94):
        raise ValueError(f"only layers in degrees can be projected, not {srid_of(layer)}")
    out = layer.withColumn("rings", reproject_rings(F.col("rings"), crs, lon0))
    out = out.withMetadata("rings", {"srid": crs if crs != "cea" else f"cea {lon0}"})
    return out.withColumn("bbox", bbox_of(F.col("rings")))


def srid_of(layer: DataFrame) -> int | None:
    return layer.schema["rings"].metadata.get("srid")


def layer_from(df: DataFrame, column: str, encoding: str, srid: int = GDA94,
               decimals: int | None = None, lenient: bool = False) -> DataFrame:
    """A table with a WKB, WKT or GeoJSON geometry column as a layer. What isn't a geometry
    raises, or with ``lenient`` becomes an empty shape."""
    decode = {"wkb": rings_from_wkb, "wkt": rings_from_wkt, "geojson": rings_from_geojson}[encoding]
    return as_layer(df, decode(F.col(f"`{column}`"), lenient), srid, decimals, (column,))


def shapes_from(df: DataFrame, column: str, encoding: str, lenient: bool = False) -> DataFrame:
    """A table with a WKT or GeoJSON column as a table of shapes of any kind: points, lines and polygons in
    ``paths``, the text dropped."""
    decode = {"wkt": paths_from_wkt, "geojson": paths_from_geojson}[encoding]
    return df.withColumn("paths", decode(F.col(f"`{column}`"), lenient)).drop(column)


def scan_layer(
    spark: SparkSession,
    path: str,
    fmt: str,
    srid: int = GDA94,
    schema: str | None = None,
    column: str = "geometry",
    decimals: int | None = None,
    lenient: bool = False,
    parts: bool = False,
) -> DataFrame:
    """A vector layer from files: ``geojson`` (one feature per line) or ``collection`` (one
    FeatureCollection per file, or with ``parts`` one that the files of a folder make; for both, ``schema`` declares the properties), ``wkb``
    (parquet) or ``wkt`` (CSV)."""
    if fmt in ("geojson", "collection"):
        if schema is None:
            raise ValueError("GeoJSON needs the schema of its properties")
        feature = T.StructType([
            T.StructField("properties", T.StructType.fromDDL(schema)), T.StructField("geometry", T.StringType())
        ])
        if fmt == "geojson":
            lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
            found = lines.select(F.from_json("value", feature).alias("f"))
        else:
            found = collection.features(spark, path, parts).select(F.from_json("value", feature).alias("f"))
        table = found.select("f.properties.*", F.col("f.geometry").alias(column))
        return layer_from(table, column, "geojson", srid, decimals, lenient)
    if fmt == "wkb":
        return layer_from(scan_parquet(spark, path), column, "wkb", srid, decimals, lenient)
    if fmt == "wkt":
        return layer_from(scan_csv(spark, path, schema), column, "wkt", srid, decimals, lenient)
    raise ValueError(f"unsupported layer format: {fmt}")


def tagged(df: DataFrame, key: str, value: str | list[str] | bool) -> DataFrame:
    """Features whose tag ``key`` is ``value``, one of a list, or (True) any."""
    tag = F.col("tags")[key]
    if value is True:
        return df.where(tag.isNotNull())
    return df.where(tag.isin(value) if isinstance(value, list) else tag == value)


def osm_features(
    features: DataFrame,
    place: DataFrame,
    key: str = "amenities",
    value: str | list[str] | bool = "hospitals",
    row_id: str = "row_id",
    lon: str = "x",
    lat: str = "y",
    cell: float = 0.5,
) -> DataFrame:
    """Tagged map features that share a point with a place polygon: a point table, or with ``rings`` or
    ``paths`` a table of polygons or of shapes of any kind."""
    return within_place(tagged(features, key, value), place, row_id, lon, lat, cell)
