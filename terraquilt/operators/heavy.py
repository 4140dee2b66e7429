"""Joins to a lookup on keys of which a few hold much of the table.

A mergeable sketch of frequent items finds such keys in one aggregation over the key columns. Rows of a heavy key are
dealt over as many shares as their number asks for, and the lookup's rows of that key are copied to each share. There
are at most as many heavy keys as shuffle partitions, so the list of them has a bound.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A share holds at most 1 / FINER of an even partition, so that shares that meet by chance don't weigh much.
FINER = 8
#: Items that the sketch tracks: an item with 1 in some 7,000 rows is never missed.
TRACKED = 10_000


def heavy_keys(df: DataFrame, key: Column) -> DataFrame:
    """``key_`` and ``shares_`` of the keys with more rows than an even partition has."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = min(parts, TRACKED // 2)
    found = df.select(key.alias("key_")).agg(
        F.expr(f"approx_top_k(key_, {most}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("total")
    )
    found = found.select(F.inline("top"), "total").where(F.col("item").isNotNull())
    shares = F.ceil(F.col("count") * parts * FINER / F.col("total")).cast("int")
    return found.where(F.col("count") * parts > F.col("total")).select(F.col("item").alias("key_"), shares.alias("shares_"))


def balanced_join(rows: DataFrame, lookup: DataFrame, on: list[tuple[str, str]], how: str = "left") -> DataFrame:
    """rows joined with the lookup where all pairs (rows' column, lookup's column) are equal, nulls included; how is inner
    or left. No key's rows gather in one task, as far as rows differ in any column that isn't nested."""
    mine, theirs = ([F.col(f"`{pair[i]}`") for pair in on] for i in (0, 1))
    heavy = F.broadcast(heavy_keys(rows, F.xxhash64(*mine)))
    telling = [F.col(f"`{f.name}`") for f in rows.schema if f.dataType.typeName() not in ("array", "map", "struct")]
    none = F.lit(0)
    dealt = rows.withColumn("key_", F.xxhash64(*mine)).join(heavy, "key_", "left")
    share = F.coalesce(F.pmod(F.xxhash64(F.lit(1), *telling), F.col("shares_")).cast("int"), none)
    dealt = dealt.withColumn("share_", share).drop("key_", "shares_")
    copies = F.sequence(none, F.coalesce(F.col("shares_"), F.lit(1)) - 1)
    copied = lookup.withColumn("key_", F.xxhash64(*theirs)).join(heavy, "key_", "left")
    copied = copied.withColumn("copy_", F.explode(copies)).drop("key_", "shares_")
    same = reduce(Column.__and__, [F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`")) for a, b in on])
    return dealt.join(copied, same & (F.col("share_") == F.col("copy_")), how).drop("share_", "copy_")
