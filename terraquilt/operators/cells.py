"""Candidate pairs of two layers by an equi-join on grid cells.

A box-overlap condition alone would plan as a nested-loop join. Here each row is
listed under the cells its closed box covers and rows meet on equal cells; a pair
is kept only in the cell that holds the lower left corner of the boxes' overlap,
so it appears once and nothing has to be de-duplicated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraquilt.session import materialized

#: Box pairs that one task compares for a key; a key with more is divided.
HOT_PAIRS = 4_000_000
FINEST = 32  # most parts a hot cell is divided into, each way
#: Hot keys, of fixed width, that are broadcast; more of them are joined by shuffle.
BROADCAST_KEYS = 100_000


def cover_cells(bbox: Column, cell: float) -> tuple[Column, Column]:
    """The runs of column and row numbers of the cells a closed box covers."""
    def run(lo: str, hi: str) -> Column:
        return F.sequence(F.floor(bbox[lo] / cell), F.floor(bbox[hi] / cell))

    return run("xmin", "xmax"), run("ymin", "ymax")


def with_cells(df: DataFrame, bbox: str, cell: float) -> DataFrame:
    """One row per covered cell (``cx``, ``cy``); rows without a box drop."""
    xs, ys = cover_cells(F.col(bbox), cell)
    return df.withColumn("cx", F.explode(xs)).withColumn("cy", F.explode(ys))


def suggest_cell(left: DataFrame, right: DataFrame) -> float:
    """Cell width near the mean box width of the layer with the larger shapes,
    so that most rows fall in few cells. One aggregate per layer."""
    widths = [
        df.agg(
            F.avg(
                F.greatest(F.col("bbox.xmax") - F.col("bbox.xmin"), F.col("bbox.ymax") - F.col("bbox.ymin"))
            )
        ).first()[0]
        or 0.0
        for df in (left, right)
    ]
    return max(max(widths), 1e-6)


def histogram(left: DataFrame, right: DataFrame, keys: list[str], *measures: Column) -> DataFrame:
    """Rows of both sides (``n_l``, ``n_r``) under each key that both have, and further measures of all of them, written: one
    pass over each side, of keys and what the measures need."""
    own = [df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n), *[m.alias(f"{n}_m{i}") for i, m in enumerate(measures)])
           for df, n in ((left, "n_l"), (right, "n_r"))]
    both = own[0].join(own[1], keys)
    wider = [F.greatest(f"n_l_m{i}", f"n_r_m{i}").alias(f"m{i}") for i in range(len(measures))]
    return materialized(both.select(*keys, "n_l", "n_r", *wider), "histogram")


def _few(hot: DataFrame) -> DataFrame:
    return F.broadcast(hot) if hot.count() <= BROADCAST_KEYS else hot


def _shares(sizes: DataFrame, split_left: bool = True) -> DataFrame:
    """Keys with more than HOT_PAIRS pairs, and into how many shares each side is put so that no two of them have more."""
    n_l, n_r = F.col("n_l").cast("double"), F.col("n_r").cast("double")
    parts = F.ceil(n_l * n_r / HOT_PAIRS)
    l = F.greatest(F.round(F.sqrt(parts * n_l / n_r)), F.lit(1.0)) if split_left else F.lit(1.0)
    names = [c for c in sizes.columns if c not in ("n_l", "n_r")]
    hot = sizes.where(n_l * n_r > HOT_PAIRS)
    return hot.select(*names, l.cast("int").alias("l_share"), F.ceil(parts / l).cast("int").alias("r_share"))


def _spread(df: DataFrame, hot: DataFrame, keys: list, own: str, other: str) -> DataFrame:
    """Put each row of a hot cell in one share of its own side and copy it to
    every share of the other side. The share comes from a hash of the row, so a
    recomputed task makes the same choice."""
    mine = F.xxhash64(*_telling(df))
    spread = df.join(hot, keys, "left")
    n_own, n_other = F.coalesce(F.col(own), F.lit(1)), F.coalesce(F.col(other), F.lit(1))
    return (
        spread.withColumn(f"{own}_at", F.pmod(mine, n_own).cast("int"))
        .withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0), n_other - 1)))
        .drop(own, other)
    )


def spread_hot(left: DataFrame, right: DataFrame, keys: list, split_left: bool = True, sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list]:
    """Both sides of a join on keys with hot keys split, and the join's keys.
    Without ``split_left`` a right row stays single and left rows are copied."""
    sizes = histogram(left.select(*keys), right.select(*keys), keys) if sizes is None else sizes
    hot = _few(_shares(sizes, split_left))
    return (
        _spread(left, hot, keys, "l_share", "r_share"),
        _spread(right, hot, keys, "r_share", "l_share"),
        [*keys, "l_share_at", "r_share_at"],
    )


def refine(left: DataFrame, right: DataFrame, sizes: DataFrame, cell: float) -> tuple[DataFrame, DataFrame, list]:
    """A finer grid inside hot cells whose shapes are much smaller than the cell.

    Adds ``fine`` (parts each way, a power of two; 1 in all other cells) and the
    part (``sx``, ``sy``); a row is listed under each part its box covers. sizes: the cells'
    `histogram`, with the mean width of their shapes.
    """
    width = F.greatest("m0", F.lit(cell / FINEST))
    parts = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(cell / width)), F.lit(0)))
    hot = sizes.where(F.col("n_l").cast("double") * F.col("n_r") > HOT_PAIRS)
    hot = _few(hot.select("cx", "cy", parts.cast("bigint").alias("fine")))

    def divided(df: DataFrame, bbox: Column) -> DataFrame:
        df = df.join(hot, ["cx", "cy"], "left")
        fine = F.coalesce(F.col("fine"), F.lit(1).cast("bigint"))
        df = df.withColumn("fine", fine)

        def run(axis: str, at: str) -> Column:
            first = F.floor(bbox[f"{axis}min"] * F.col("fine") / cell) - F.col(at) * F.col("fine")
            last = F.floor(bbox[f"{axis}max"] * F.col("fine") / cell) - F.col(at) * F.col("fine")
            zero = F.lit(0).cast("bigint")
            return F.sequence(F.greatest(first, zero), F.least(last, F.col("fine") - 1))

        return df.withColumn("sx", F.explode(run("x", "cx"))).withColumn("sy", F.explode(run("y", "cy")))

    return divided(left, F.col("l_bbox")), divided(right, F.col("r_bbox")), ["cx", "cy", "sx", "sy"]


def _width(df: DataFrame, side: str) -> DataFrame:
    b = F.col(f"{side}_bbox")
    return df.select("cx", "cy", F.greatest(b["xmax"] - b["xmin"], b["ymax"] - b["ymin"]).alias("width"))


def cell_pairs(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """Pairs whose closed boxes overlap, both sides shuffled by cell. ``left``
    carries ``l_bbox`` and ``right`` carries ``r_bbox``; the other column names
    must not collide. Boxes are read once to count them by cell, and once more in cells that are hot."""
    lc, rc = with_cells(left, "l_bbox", cell), with_cells(right, "r_bbox", cell)
    sizes = histogram(_width(lc, "l"), _width(rc, "r"), ["cx", "cy"], F.avg("width"))
    if sizes.where(F.col("n_l").cast("double") * F.col("n_r") > HOT_PAIRS).isEmpty():
        keys, one = ["cx", "cy"], F.lit(1).cast("bigint")
        lc = lc.withColumns({"fine": one, "sx": F.lit(0).cast("bigint"), "sy": F.lit(0).cast("bigint")})
        shared = []
    else:
        lc, rc, keys = refine(lc, rc, sizes, cell)
        divided = [df.where("fine > 1").select(*keys) for df in (lc, rc)]
        whole = sizes.select("cx", "cy", *[F.lit(0).cast("bigint").alias(s) for s in ("sx", "sy")], "n_l", "n_r")
        # Cells that stay whole are counted already.
        hot = _shares(whole).union(_shares(histogram(*divided, keys)))
        hot = materialized(hot.groupBy(*keys).agg(F.max("l_share").alias("l_share"), F.max("r_share").alias("r_share")), "hot-cells")
        hot = _few(hot)
        lc, rc = _spread(lc, hot, keys, "l_share", "r_share"), _spread(rc, hot, keys, "r_share", "l_share").drop("fine")
        shared = ["l_share_at", "r_share_at"]
    keys = [*keys, *shared]
    rc = rc.withColumnsRenamed({k: f"r_{k}" for k in keys})
    lb, rb = F.col("l_bbox"), F.col("r_bbox")
    on = F.lit(True)
    for axis in ("x", "y"):
        corner = F.greatest(lb[f"{axis}min"], rb[f"{axis}min"])
        part = F.floor(corner * F.col("fine") / cell) - F.col(f"c{axis}") * F.col("fine")
        on = on & (corner <= F.least(lb[f"{axis}max"], rb[f"{axis}max"])) & (part == F.col(f"s{axis}"))
    for k in keys:
        on = (F.col(k) == F.col(f"r_{k}")) & on
    return lc.join(rc, on).drop("fine", "sx", "sy", *keys, *[f"r_{k}" for k in keys])


def _telling(df: DataFrame) -> list:
    """Columns that tell rows apart without hashing their geometry."""
    heavy = ("array", "map")
    return [F.col(f"`{f.name}`") for f in df.schema if f.dataType.typeName() not in heavy]
