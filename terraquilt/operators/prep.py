"""Column preparation and row filters."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terraquilt.functions import columns as C
from terraquilt.operators.heavy import balanced_join
from terraquilt.session import materialized

DICTIONARY_ROWS = 100_000
DICTIONARY_BYTES = 32 * 1024 * 1024


def project(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in cols])


def drop(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*cols)


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def filter_eq(df: DataFrame, col: str, value) -> DataFrame:
    return df.where(F.col(f"`{col}`") == F.lit(value))


def filter_and(df: DataFrame, values: dict) -> DataFrame:
    return df.where(reduce(Column.__and__, [F.col(f"`{c}`") == F.lit(v) for c, v in values.items()]))


def filter_since(df: DataFrame, col: str, bound: str) -> DataFrame:
    """Rows on or after a date; rows without one drop."""
    return df.where(F.col(f"`{col}`") >= F.lit(bound).cast("timestamp_ntz"))


def split_label(df: DataFrame, label: str = "Label") -> DataFrame:
    season, kind = C.split_label(F.col(label))
    return df.withColumn("FireSeason", season).withColumn("FireType", kind)


def with_load_date(df: DataFrame, day: dt.date | None = None, name: str = "DateUpdated") -> DataFrame:
    """A constant load date; pass ``day`` to make reruns repeatable."""
    return df.withColumn(name, F.lit(day) if day else F.current_date())


def parse_dates(df: DataFrame, cols: list[str], fmt: str | None = None, lenient: bool = False) -> DataFrame:
    return df.withColumns({c: C.parse_date(F.col(f"`{c}`"), fmt, lenient) for c in cols})


def epoch_to_ts(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: C.epoch_to_ts(F.col(f"`{c}`")) for c in cols})


def _numbered(values: DataFrame) -> DataFrame:
    """value and code, its ordinal in sort order, for more values than one task should sort:
    ranges are numbered by themselves and shifted by the sizes of those before."""
    ranged = values.repartitionByRange("value").select("value", F.spark_partition_id().alias("range_"))
    ranged = materialized(ranged, "category-ranges")
    sizes = ranged.groupBy("range_").agg(F.count(F.lit(1)).alias("n"))  # one row per partition
    before = W.orderBy("range_").rowsBetween(W.unboundedPreceding, -1)
    shift = sizes.select("range_", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    own = F.row_number().over(W.partitionBy("range_").orderBy("value")) - 1
    numbered = ranged.withColumn("own", own).join(F.broadcast(shift), "range_")
    return numbered.select((F.col("own") + F.col("shift")).cast("int").alias("code"), "value")


def category_codes(df: DataFrame, cols: list[str]) -> dict[str, tuple[DataFrame, bool]]:
    """For each column its distinct values numbered in sort order, and whether the dictionary
    was measured small enough to broadcast. One pass over the table for all columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("value")) for c in cols])
    values = df.select(F.explode(pairs).alias("p")).select("p.*").where(F.col("value").isNotNull()).distinct()
    values = materialized(values, "categories")
    size = values.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value")).alias("bytes"))
    measured = {r["name"]: (r["n"], r["bytes"]) for r in size.collect()}
    out = {}
    for col in cols:
        n, size_bytes = measured.get(col, (0, 0))
        own = values.where(F.col("name") == col).select("value")
        if n <= DICTIONARY_ROWS and size_bytes <= DICTIONARY_BYTES:
            # Few enough to sort in one row; posexplode gives the ordinals.
            packed = own.agg(F.array_sort(F.collect_list("value")).alias("v"))
            out[col] = packed.select(F.posexplode("v").alias("code", "value")), True
        else:
            out[col] = _numbered(own), False
    return out


def categorize(df: DataFrame, cols: list[str] | None = None, suffix: str = "_code") -> DataFrame:
    """Dictionary-encode string columns (all of them by default) into
    ``<col>_code``: ordinal in sort order, -1 for null."""
    if cols is None:
        cols = [f.name for f in df.schema if f.dataType.typeName() == "string"]
    out = df
    for col, (codes, small) in (category_codes(df, cols) if cols else {}).items():
        codes = codes.withColumnsRenamed({"value": "category_value", "code": "category_code"})
        if small:
            out = out.join(F.broadcast(codes), F.col(f"`{col}`") == F.col("category_value"), "left")
        else:
            # A value with much of the table is dealt over shares; so are nulls, which match nothing.
            out = balanced_join(out, codes, [(col, "category_value")])
        out = out.withColumn(col + suffix, F.coalesce("category_code", F.lit(-1)))
        out = out.drop("category_value", "category_code")
    return out


def extract_property(df: DataFrame, collection: str, name: str) -> DataFrame:
    """Position and one property of every feature in FeatureCollection text.
    The other columns are kept, the text is not."""
    shape = "struct<features:array<struct<properties:map<string,string>>>>"
    keep = [F.col(f"`{c}`") for c in df.columns if c != collection]
    rows = df.select(*keep, F.posexplode(F.from_json(F.col(collection), shape)["features"]).alias("pos", "feature"))
    return rows.withColumn(name, F.col("feature.properties")[name]).drop("feature")
