"""What several operators share: joins with hot keys, components, shipping the code."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraquilt.session import materialized, ship_package

__all__ = ["components", "kept", "materialized", "ready", "ready_for_text", "spread_join", "table", "text_key", "tidy", "unused"]


def ready(spark: SparkSession) -> SparkSession:
    """Ship this package to the Python workers once per session."""
    ship_package(spark)
    return spark


#: Bytes of the Arrow batches in which text goes to Python. An executor and its workers hold a batch several times
#: over, each task its own. Just under four of words.CHUNK_BYTES, so that no small rest of a batch is left over.
TEXT_BATCH = "4000k"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ready_for_text(spark: SparkSession) -> SparkSession:
    """`ready`, and Arrow batches of TEXT_BATCH bytes from now on, unless the session names a size itself."""
    spark.conf.set(_BATCH_BYTES, spark.conf.get(_BATCH_BYTES, TEXT_BATCH))
    return ready(spark)


_clear: list[Callable[[], None]] = []


def kept(make: Callable) -> Callable:
    """make, which is called once a task at most: what it returns is kept until `release`."""
    cached = functools.cache(make)
    _clear.append(cached.cache_clear)
    return cached


def release() -> None:
    """Drop what is kept, and give memory that this process has freed back to the system, as far as its allocators can."""
    for clear in _clear:
        clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, for Spark to call on the batches of a task. Python workers live on from task to task and would keep, beside
    those of the next stages and the executor itself, all memory that a task once took; here it goes back at the end."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_key(c: Column) -> Column:
    """128 bits that stand for a text where the text itself needn't travel."""
    return F.unhex(F.md5(c.cast("binary")))


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of one key that are left to one task; a key of more is spread over shares.
HOT_ROWS, SHARES = 5_000, 64
#: Hot keys, of up to 64 bytes, that are broadcast; more of them are joined by shuffle.
BROADCAST_KEYS = 100_000


def spread_join(
    rows: DataFrame, small: DataFrame, key: str, sizes: DataFrame, salt: Column, how: str = "inner"
) -> DataFrame:
    """rows joined with `small`, which has at most a few rows for each key, on `key`. Keys
    with over HOT_ROWS rows (sizes: key, n) meet their copy of `small` in SHARES shares,
    chosen by `salt` of the row; no key's rows gather in one task. At most 1 in HOT_ROWS
    rows is a hot key, so the copies are few. how: inner or left."""
    shares = F.sequence(F.lit(0), F.lit(SHARES - 1))
    hot = materialized(sizes.where(F.col("n") > HOT_ROWS).select(key).distinct(), "hot-keys")
    count = hot.count()
    if not count:
        return rows.join(small, key, how)
    hot = hot.withColumn("hot_", F.lit(True))
    marked = small.join(hot, key, "left")
    copied = marked.withColumn("share_", F.explode(F.when(F.col("hot_"), shares).otherwise(F.array(F.lit(-1)))))
    hot = hot.withColumn("share_", F.explode(shares))
    hot = F.broadcast(hot) if count <= BROADCAST_KEYS else hot
    dealt = rows.withColumn("share_", F.pmod(salt, F.lit(SHARES)).cast("int")).join(hot, [key, "share_"], "left")
    dealt = dealt.withColumn("share_", F.when(F.col("hot_"), F.col("share_")).otherwise(F.lit(-1))).drop("hot_")
    return dealt.join(copied.drop("hot_"), [key, "share_"], how).drop("share_")


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a long, b long): one row (id, root) for each end of
    a link, root being the least id it is connected with.

    Alternates large-star and small-star steps, each of which points ids at smaller
    ones, so a chain of n links takes about log n rounds. Every round is a written
    table: no lineage grows and a lost executor costs one round. A hot root only ever
    groups by minimum, with partial aggregation first.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = materialized(edges, "links")
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        large = materialized(large, "large")
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = materialized(small.select("e.u", "e.v").where("u <> v").distinct(), "small")
        same = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if same == after.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first():
            break
        edges = after
    found = after.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return found.union(found.select("root", "root").distinct())
