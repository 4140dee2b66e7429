"""Row positions fixed at load, and an index that gives any page of a sorted table.

`positions` numbers the rows of stored files: a file's rows by their place in it, after all rows of the files
before it. Only files are counted and summed, so nothing is shuffled or sorted, and the numbers stay the same for as
long as the files do. `write_positions` stores any table with such numbers beside its columns.

`write_page_index` stores a table cut into ranges of the sort order and a histogram of them, rows and those before.
A page is then read from the one or two ranges that hold it; all others are pruned by their folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: File names that are broadcast with their first positions; more of them are joined by shuffle.
BROADCAST_FILES = 100_000
#: Rows of a range, about.
RANGE_ROWS = 200_000


def _free(columns: list[str], name: str) -> str:
    """A name that no column has."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def positions(spark: SparkSession, path: str, name: str = "row_id") -> DataFrame:
    """A parquet table with the position of each row over all its files, from 0."""
    scan = spark.read.parquet(path)
    columns = [F.col(f"`{c}`") for c in scan.columns]
    if name.lower() in {c.lower() for c in scan.columns}:
        raise ValueError(f"the table has a column {name} already")
    file, place, first = (_free(scan.columns, n) for n in ("file_", "place_", "first_"))
    files = scan.groupBy(F.col("_metadata.file_path").alias(file)).agg(F.count(F.lit(1)).alias("n"))
    # A row per file: how many rows there are in those before it by name.
    before = Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select(file, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first))
    if len(scan.inputFiles()) <= BROADCAST_FILES:
        offsets = F.broadcast(offsets)
    rows = scan.select(F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place), *columns)
    return rows.join(offsets, file).select((F.col(first) + F.col(place)).alias(name), *columns)


def write_positions(df: DataFrame, path: str, name: str = "row_id", mode: str = "errorifexists") -> None:
    """Store a table with its positions, by input split and place in it. The rows are written first and numbered as they
    lie there, so that a split that is read again can't be numbered otherwise."""
    spark = df.sparkSession
    df.write.mode(mode).parquet(f"{path}/rows")
    positions(spark, f"{path}/rows", name).write.mode(mode).parquet(f"{path}/numbered")


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/numbered")


def write_page_index(df: DataFrame, sort: list[Column], path: str, row_id: str = "row_id", range_rows: int = RANGE_ROWS) -> None:
    """Store df in ranges of ``sort``, ties by ``row_id``, with their histogram."""
    spark = df.sparkSession
    df.limit(0).write.parquet(f"{path}/columns")
    ranges = max(1, -(-df.count() // range_rows))
    order = [*sort, F.col(row_id)]
    cut = df.repartitionByRange(ranges, *order).withColumn("range_", F.spark_partition_id())
    cut.sortWithinPartitions(*order).write.partitionBy("range_").parquet(f"{path}/rows")
    counts = _ranges(spark, path).groupBy("range_").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("range_", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    counts.coalesce(1).write.parquet(f"{path}/histogram")  # a row per range


def _ranges(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows by range; an empty table has none, and no file to tell its columns."""
    columns = spark.read.parquet(f"{path}/columns").schema
    return spark.read.schema(columns.add("range_", T.IntegerType())).parquet(f"{path}/rows")


def page_ranges(spark: SparkSession, path: str, first: int, last: int) -> list[tuple[int, int]]:
    """The ranges that hold rows from `first` up to `last`, and how many rows lie before each. A page's few."""
    held = spark.read.parquet(f"{path}/histogram").where((F.col("before") < last) & (F.col("before") + F.col("n") > first))
    return [(r["range_"], r["before"]) for r in held.orderBy("range_").collect()]


def read_page(spark: SparkSession, path: str, sort: list[Column], page_no: int, size: int = 10, row_id: str = "row_id") -> DataFrame:
    """A page of an indexed table, as `explore.page` gives it, from the ranges that hold it."""
    first = page_no * size
    held = page_ranges(spark, path, first, first + size)
    rows = _ranges(spark, path).where(F.col("range_").isin([r for r, _ in held])).drop("range_")
    return rows.orderBy(*sort, row_id).offset(first - held[0][1] if held else 0).limit(size)
