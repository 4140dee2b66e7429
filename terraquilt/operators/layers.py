"""The tables behind map layers; nothing is drawn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraquilt.functions.codec import simplify
from terraquilt.functions.columns import concat_text, label_popup
from terraquilt.functions.geom import to_geojson

DISPLAY_TOLERANCE = 0.001  # degrees


def layer_features(layer: DataFrame, row_id: str, value: str | Column, tolerance: float = DISPLAY_TOLERANCE) -> DataFrame:
    """Id, class value and simplified GeoJSON of every shape."""
    value = F.col(f"`{value}`") if isinstance(value, str) else value
    thin = layer.select(
        F.col(f"`{row_id}`").alias("id"),
        value.alias("value"),
        simplify(F.col("rings"), tolerance).alias("rings"),
    )
    return thin.select("id", "value", to_geojson(F.col("rings")).alias("geometry"))


def point_features(df: DataFrame, lat: str, lon: str, prefix: str, text: str, row_id: str = "row_id") -> DataFrame:
    """Points with hover text; rows without text keep a null."""
    return df.select(
        row_id,
        F.col(f"`{lon}`").alias("x"),
        F.col(f"`{lat}`").alias("y"),
        concat_text(prefix, F.col(f"`{text}`")).alias("hover"),
    )


def fire_season_map(fires: DataFrame, label: str, tolerance: float = DISPLAY_TOLERANCE, fire_id: str = "FireNo") -> DataFrame:
    """Simplified shapes of one season and type with popup text."""
    thin = fires.where(F.col("Label") == label).select(
        fire_id,
        label_popup(F.col("FireName"), F.col("AreaHa")).alias("popup"),
        simplify(F.col("rings"), tolerance).alias("rings"),
    )
    return thin.select(fire_id, "popup", to_geojson(F.col("rings")).alias("geometry"))


def join_features_to_values(layer: DataFrame, values: DataFrame, key: str, value: str) -> DataFrame:
    """Choropleth rows: each shape with the value of its feature id. The key is
    unique in ``values``, so Spark may broadcast or shuffle as sizes dictate."""
    return layer.join(values.select(key, value), key)
