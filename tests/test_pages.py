"""Positions, page index, heavy keys, outlines and tables that are loaded again."""

import math
import random
import statistics
import uuid

import pytest
from pyspark.sql import functions as F
from shapes import ring, row, square

from terraquilt.functions import geom
from terraquilt.model import RINGS
from terraquilt.operators import explore, heavy, outline, pages, prep
from terraquilt.plans import towers as tw
from terraquilt.sources import scan, sink

R = RINGS.simpleString()


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- positions and pages --------------------------------------------------------------------------


def test_positions_over_several_files(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(0, 1000, 1, 7).select("id", F.lit("x").alias("first_"))
    df.write.parquet(path)
    first = {r["id"]: r["row_id"] for r in pages.positions(spark, path).collect()}
    assert sorted(first.values()) == list(range(1000))
    files = {}
    for r in spark.read.parquet(path).select("id", "_metadata.file_path").collect():
        files.setdefault(r["file_path"], []).append(r["id"])
    want = [i for name in sorted(files) for i in sorted(files[name])]
    assert [i for i, _ in sorted(first.items(), key=lambda x: x[1])] == want
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # other splits, the same numbers
    try:
        assert {r["id"]: r["row_id"] for r in pages.positions(spark, path).collect()} == first
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    text = pages.positions(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and text.count("Exchange hashpartitioning") == 1  # only the files' names are shuffled
    with pytest.raises(ValueError):
        pages.positions(spark, path, "ID")
    spark.range(0).write.parquet(str(tmp_path / "none"))
    assert rows(pages.positions(spark, str(tmp_path / "none"))) == []


def test_positions_of_any_table_are_stored(spark, tmp_path):
    df = spark.range(300).select("id", F.rand().alias("r")).orderBy("r").drop("r")
    pages.write_positions(df, str(tmp_path / "p"))
    first = rows(pages.read_positions(spark, str(tmp_path / "p")))
    assert sorted(first) == sorted(rows(pages.read_positions(spark, str(tmp_path / "p"))))
    assert sorted(r[0] for r in first) == list(range(300)) and {r[1] for r in first} == set(range(300))


def test_page_index(spark, tmp_path):
    rng = random.Random(2)
    data = [(i, rng.choice("abc"), rng.choice([None, 1, 2])) for i in range(1003)] + [(5000, "b", 1)]
    df = spark.createDataFrame(data, "row_id long, a string, b int").repartition(5)
    sort, path = [F.col("a"), F.col("b").desc()], str(tmp_path / "i")
    pages.write_page_index(df, sort, path, range_rows=100)
    for page, size in ((0, 10), (3, 33), (50, 10), (100, 10), (0, 2000), (200, 10)):
        assert rows(pages.read_page(spark, path, sort, page, size)) == rows(explore.page(df, sort, page, size))
    histogram = rows(spark.read.parquet(f"{path}/histogram"))
    assert len(histogram) == 11 and max(r[1] for r in histogram) < 250
    # A page far into the table moves the rows of at most two ranges.
    assert all(1 <= len(pages.page_ranges(spark, path, n * 10, n * 10 + 10)) <= 2 for n in range(100))
    text = pages.read_page(spark, path, sort, 80)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [range_" in text or "PartitionFilters: [isnotnull(range_" in text
    pages.write_page_index(df.limit(0), sort, str(tmp_path / "e"))
    assert rows(pages.read_page(spark, str(tmp_path / "e"), sort, 0)) == []


# --- heavy keys -----------------------------------------------------------------------------------


def skewed(spark):
    """Half of all rows on one key, a fifth without one."""
    k = F.col("id")
    key = F.when(k % 2 == 0, 7).when(k % 5 != 1, k % 3000)
    return spark.range(40_000).select("id", key.cast("long").alias("a"), F.lit(1).alias("b"))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_heavy_keys_join_like_others(spark, how):
    df = skewed(spark)
    lookup = spark.createDataFrame([(i, 1, f"v{i}") for i in range(0, 2000, 3)] + [(7, 1, "seven"), (7, 1, "again"), (None, 1, "null"), (8, 2, "no")], "c long, d int, v string")
    want = df.join(lookup, df.a.eqNullSafe(lookup.c) & (df.b == lookup.d), how)
    got = heavy.balanced_join(df, lookup, [("a", "c"), ("b", "d")], how)
    assert got.columns == want.columns and sorted(rows(got), key=str) == sorted(rows(want), key=str)
    none = heavy.balanced_join(df.limit(0), lookup, [("a", "c"), ("b", "d")], how)
    assert rows(none) == []


def test_no_task_takes_a_heavy_key(spark):
    df = skewed(spark).where("a IS NOT NULL")
    lookup = spark.range(3000).select(F.col("id").alias("c"), F.lit("x").alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = heavy.balanced_join(df, lookup, [("a", "c")])
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        plain = df.join(lookup, df.a == lookup.c, "left").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == df.count() and max(sizes) <= 2 * statistics.median(sizes)
    assert max(r["count"] for r in plain) > 4 * statistics.median(r["count"] for r in plain)


def test_large_lookups_take_the_balanced_join(spark, monkeypatch):
    towers = skewed(spark).limit(2000).select("id", F.col("a").alias("mcc"), F.col("b").alias("net"))
    codes = spark.createDataFrame([(7, 1, "Seven"), (None, 1, "None"), (9, 1, "Nine")], "MCC long, MNC int, Description string")
    want = sorted(rows(tw.enrich_left(towers, codes)), key=str)
    monkeypatch.setattr(tw, "CODES_BYTES", 0)
    assert sorted(rows(tw.enrich_left(towers, codes)), key=str) == want
    words = skewed(spark).limit(3000).select("id", F.concat(F.lit("w"), F.col("a")).alias("w"))
    want = sorted(rows(prep.categorize(words)))
    monkeypatch.setattr(prep, "DICTIONARY_ROWS", 3)
    assert sorted(rows(prep.categorize(words))) == want


# --- outlines -------------------------------------------------------------------------------------


def shapes(spark, groups):
    data = [(g, row(s)) for g, each in groups.items() for s in each]
    return spark.createDataFrame(data, f"g string, rings {R}").withColumn("rings", geom.normalize(F.col("rings")))


def test_shared_sides_cancel(spark):
    slanted = [[ring((0, 0), (4, 1), (0, 3))], [ring((4, 1), (5, 6), (0, 3))], [ring((0, 0), (-2, 1), (0, 3))]]
    groups = {
        "grid": [[square(x / 3, y / 3, (x + 1) / 3, (y + 1) / 3)] for x in range(6) for y in range(3)],
        "steps": [[square(0, 0, 2, 1)], [square(0, 1, 1, 2)], [square(1, 1, 2, 3)], [square(0, 2, 1, 3)]],  # sides of unequal length
        "ring": [[square(x, y, x + 1, y + 1)] for x in range(3) for y in range(3) if (x, y) != (1, 1)],
        "corner": [[square(0, 0, 1, 1)], [square(1, 1, 2, 2)]],
        "apart": [[square(0, 0, 1, 1), square(4, 4, 5, 5, part=1)], [square(9, 9, 9.5, 9.5)]],
        "slanted": slanted, "filled": [[square(0, 0, 3, 3), square(1, 1, 2, 2, hole=True)], [square(1, 1, 2, 2)]],
        "empty": [[]], "twice": [[square(0, 0, 1, 1)]] * 2,
    }
    df = shapes(spark, groups)
    edges = outline.group_outline(df, ["g"])
    got = {r["g"]: (r["AREA"], r["LENGTH"], r["EDGES"]) for r in outline.outline_stats(edges, ["g"]).collect()}
    side = math.hypot
    want = {
        "grid": (2, 6, 4), "steps": (6, 10, 4), "ring": (8, 16, 8), "corner": (2, 8, 8), "apart": (2.25, 10, 12),
        "slanted": (3 * 4 / 2 + (4 * 5 - 2 * 1) / 2 - 0, 0, 0), "filled": (9, 12, 4), "twice": (2, 8, 8),
    }
    parts = {r["g"]: r["a"] for r in df.groupBy("g").agg(F.sum(geom.area_degrees(F.col("rings"))).alias("a")).collect()}
    for g, (area, length, n) in got.items():
        assert area == pytest.approx(parts[g])  # what cancels has no area
        if g != "slanted":
            assert (area, length, n) == pytest.approx(want[g])
    assert got["slanted"][1:] == pytest.approx((side(4, 1) + side(1, 5) + side(5, 3) + side(2, 1) * 1 + side(2, 2), 5))
    assert "empty" not in got


# --- seasons and text -----------------------------------------------------------------------------


def test_a_season_is_replaced(spark, tmp_path):
    name = f"seasons_{uuid.uuid4().hex}"
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, None, 3.0), (4, "b", 4.0)], "id int, season string, ha double")
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    sink.write_partitions(df, name, ["season"], str(tmp_path / "t"))
    assert sorted(rows(spark.read.table(name).select("id", "season")), key=str) == sorted([(1, "a"), (2, "b"), (3, None), (4, "b")], key=str)
    again = spark.createDataFrame([(9.0, "b", 9), (8.0, "c", 8)], "ha double, season string, id int")
    for _ in "12":  # the second time changes nothing
        sink.write_partitions(again, name, ["season"])
        got = rows(spark.read.table(name).select("id", "season", "ha"))
        assert sorted(got, key=str) == sorted([(1, "a", 1.0), (9, "b", 9.0), (3, None, 3.0), (8, "c", 8.0)], key=str)
    sink.write_partitions(again.limit(0), name, ["season"])
    assert spark.read.table(name).count() == 4
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before


def test_plain_csv_is_split(spark, tmp_path):
    path = str(tmp_path / "c")
    spark.range(20_000).select("id", F.lit('a, "b"').alias("t")).coalesce(1).write.option("header", True).option("escape", '"').csv(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        whole, split = scan.scan_csv(spark, path, "id long, t string", line_breaks=True), scan.scan_csv(spark, path, "id long, t string")
        assert whole.rdd.getNumPartitions() == 1 and split.rdd.getNumPartitions() > 4
        assert sorted(rows(split)) == sorted(rows(whole)) and split.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
