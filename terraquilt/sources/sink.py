"""Writing tables and layers. Every sink is a distributed Spark write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraquilt.functions.geom import to_geojson, to_wkt
from terraquilt.sources import collection


def write_table(df: DataFrame, name: str, mode: str = "append", fmt: str = "parquet",
                path: str | None = None) -> None:
    """Catalog table; ``mode`` is append or overwrite."""
    writer = df.write.format(fmt).mode(mode)
    (writer.option("path", path) if path else writer).saveAsTable(name)


def write_partitions(df: DataFrame, name: str, by: list[str], path: str | None = None, fmt: str = "parquet") -> None:
    """Catalog table in partitions of some columns. Writing again replaces the partitions that df has rows of, and leaves the
    others as they are, so a season that is loaded once more takes its own place."""
    spark = df.sparkSession
    rest = [c for c in df.columns if c not in by]
    if spark.catalog.tableExists(name):
        # Columns go by place: the table's own order.
        columns = [F.col(f"`{c}`") for c in spark.read.table(name).columns]
        setting = "spark.sql.sources.partitionOverwriteMode"
        before = spark.conf.get(setting)
        spark.conf.set(setting, "dynamic")  # a table's own write takes no such option
        try:
            df.select(*columns).write.insertInto(name, overwrite=True)
        finally:
            spark.conf.set(setting, before)
        return
    writer = df.select(*[F.col(f"`{c}`") for c in [*rest, *by]]).write.format(fmt).partitionBy(*by)
    (writer.option("path", path) if path else writer).saveAsTable(name)


def write_external(df: DataFrame, fmt: str, options: dict, table: str | None = None,
                   mode: str = "append") -> None:
    writer = df.write.format(fmt).options(**options)
    (writer.option("dbtable", table) if table else writer).mode(mode).save()


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "snappy").parquet(path)


def flat(df: DataFrame) -> DataFrame:
    """A layer as plain columns: geometry as WKT text, box dropped."""
    if "rings" not in df.columns:
        return df
    return df.withColumn("geometry", to_wkt(F.col("rings"))).drop("rings", "bbox")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Text with separators, quotes or line breaks is quoted and quotes are doubled; an
    empty text is written as two quotes, so it doesn't come back as null."""
    options = {"header": True, "quote": '"', "escape": '"', "emptyValue": '""'}
    flat(df).write.mode(mode).options(**options).csv(path)


def features(df: DataFrame) -> DataFrame:
    """Layer rows as GeoJSON feature text, one per row, in column ``value``."""
    attrs = [F.col(f"`{c}`") for c in df.columns if c not in ("rings", "bbox")]
    props = F.to_json(F.struct(*attrs), {"ignoreNullFields": "false"}) if attrs else F.lit("{}")
    shape = F.coalesce(to_geojson(F.col("rings")), F.lit("null"))
    return df.select(
        F.concat(
            F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'), shape, F.lit("}")
        ).alias("value")
    )


def write_collection(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One FeatureCollection in UTF-8 text files, which put together in the order of their names are the document."""
    collection.write(features(df), path, mode)


def write_geojson(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """UTF-8 text files with one feature per line."""
    features(df).write.mode(mode).text(path)
