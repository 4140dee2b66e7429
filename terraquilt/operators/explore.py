"""What the dashboards ask of their tables: selections, pages, series, pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from terraquilt.functions.columns import axis_scale, series_title
from terraquilt.session import materialized

#: Bytes of row ids and positions that are broadcast; ids may be text of any length.
SELECTION_BYTES = 16 * 1024 * 1024


def selected_rows(df: DataFrame, selection: DataFrame | None, row_id: str = "row_id") -> DataFrame:
    """Rows picked on a map, in the order and as often as they were picked.
    No selection keeps every row; an empty one keeps none."""
    if selection is None:
        return df
    picked = selection.select("pos", row_id)
    size = picked.agg(F.sum(F.octet_length(F.col(row_id).cast("string")) + 16).alias("bytes")).first()["bytes"]
    if (size or 0) <= SELECTION_BYTES:
        picked = F.broadcast(picked)
    return df.join(picked, row_id).orderBy("pos")


def selection_count(selection: DataFrame | None, like: DataFrame) -> DataFrame:
    """One row with the number of picked points; 0 without a selection."""
    if selection is None:
        return like.limit(0).agg(F.count(F.lit(1)).alias("n"))
    return selection.agg(F.count(F.lit(1)).alias("n"))


def pair_indicators(df: DataFrame, x: str, y: str, year: int) -> DataFrame:
    """Two indicators of one year side by side, matched by country."""
    few = df.where((F.col("Year") == year) & F.col("Indicator Name").isin(x, y) & F.col("Country Name").isNotNull())
    # Both sides come from one pass over the table: two indicators of one year are written and read twice.
    few = materialized(few.select("Country Name", "Indicator Name", "Value"), "indicators")

    def one(indicator: str, name: str) -> DataFrame:
        return few.where(F.col("Indicator Name") == indicator).select("Country Name", F.col("Value").alias(name))

    return one(x, "x").join(one(y, "y"), "Country Name")


def time_series(df: DataFrame, entity: str, indicator: str, kind: str = "Linear") -> DataFrame:
    """One country and indicator over the years, with axis position and title."""
    return (
        df.where((F.col("Country Name") == entity) & (F.col("Indicator Name") == indicator))
        .select(
            "Year",
            "Value",
            axis_scale(F.col("Value"), kind).alias("axis_value"),
            series_title(F.col("Country Name"), F.col("Indicator Name")).alias("title"),
        )
        .orderBy("Year")
    )


def head(df: DataFrame, n: int, row_id: str = "row_id") -> DataFrame:
    return df.orderBy(row_id).limit(n)


def page(df: DataFrame, sort: list, page_no: int = 0, size: int = 10, row_id: str = "row_id") -> DataFrame:
    """One page of a sorted table; ties are ordered by row id."""
    return df.orderBy(*sort, row_id).offset(page_no * size).limit(size)


def transpose_head(df: DataFrame, n: int, row_id: str = "row_id") -> DataFrame:
    """The first rows turned on their side: one row per column, one column per
    row id, all as text."""
    few = head(df, n, row_id)
    text = few.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in few.columns])
    return text.transpose(text[row_id]).withColumnRenamed("key", "column")


def to_records(df: DataFrame, n: int) -> list[Row]:
    """At most ``n`` rows for display; the only place rows reach the driver."""
    return df.limit(n).collect()


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def map_partitions(df: DataFrame, fn, schema: str) -> DataFrame:
    """Apply a pandas frame-to-frame function batch by batch, for work that
    Columns cannot express."""
    def run(batches):
        for frame in batches:
            yield fn(frame)

    return df.mapInPandas(run, schema)
