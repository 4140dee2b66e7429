"""Layers and tables derived from the test tables by arithmetic on their keys.

Shapes are rectangles on multiples of 1/64 degree, exact in binary, so touching
is decided without rounding and every area has a closed form in SQL. The same
rules are written as SQL in ``oracle.py``; see FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraquilt.functions.geom import box, line_path, paths_to_wkt, point_path, point_xy, polygon, rectangle, to_wkt
from terraquilt.operators.cells import with_cells
from terraquilt.operators.prep import split_label
from terraquilt.sources.scan import balanced, scan_parquet


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan_parquet(spark, f"{sf_dir}/{name}.parquet")


def wide_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    """A table whose rows grow into shapes: spread out first if it is one file."""
    return balanced(table(spark, sf_dir, name).select(*columns))


def _num(text: str) -> Column:
    return F.expr(text).cast("double")


def _rect_layer(df: DataFrame, x0: Column, y0: Column, w: Column, h: Column) -> DataFrame:
    df = df.withColumn("_x0", x0).withColumn("_y0", y0)
    df = df.withColumn("_x1", F.col("_x0") + w).withColumn("_y1", F.col("_y0") + h)
    corners = [F.col(c) for c in ("_x0", "_y0", "_x1", "_y1")]
    return df.withColumns({"rings": rectangle(*corners), "bbox": box(*corners)}).drop(
        "_x0", "_y0", "_x1", "_y1"
    )


def lga(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("lga_id"),
        F.concat(F.lit("LGA "), F.col("n_nationkey")).alias("LGA_NAME19"),
        (10000 + 10 * F.col("n_nationkey")).alias("LGA_CODE_2019"),
        F.col("n_regionkey").alias("STE_CODE16"),
    )
    one = F.lit(1.0)
    return _rect_layer(df, _num("148 + lga_id % 5"), _num("-36 + lga_id div 5"), one, one)


def _season() -> Column:
    start = F.year("o_orderdate") - F.when(F.month("o_orderdate") < 7, 1).otherwise(0)
    return F.concat(start, F.lit("-"), F.lpad(((start + 1) % 100).cast("string"), 2, "0"))


def fires_raw(spark, sf_dir) -> DataFrame:
    """Fires before label splitting, dates still text."""
    k = F.col("fire_id")
    label = F.concat(_season(), F.lit(" "), F.col("o_orderpriority"))
    columns = ["o_orderkey", "o_orderdate", "o_orderpriority", "o_totalprice"]
    df = wide_table(spark, sf_dir, "orders", columns).withColumn("fire_id", F.col("o_orderkey"))
    df = df.select(
        "fire_id",
        F.when(k % 50 != 0, k).alias("FireNo"),
        F.when(k % 33 != 0, F.concat(F.lit("Fire "), k)).alias("FireName"),
        F.when(k % 97 == 0, F.lit(None)).when(k % 89 == 0, "Unknown").otherwise(label).alias("Label"),
        (F.col("o_totalprice") / 100).alias("AreaHa"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("StartDate"),
        F.when(k % 40 != 0, F.date_format(F.date_add("o_orderdate", (k % 20).cast("int")), "yyyy-MM-dd")).alias("EndDate"),
    )
    return _rect_layer(
        df,
        _num("147.5D + ((37 * fire_id) % 384) / 64D"),
        _num("-36.5D + ((53 * fire_id + 7 * (fire_id div 384)) % 384) / 64D"),
        _num("(1 + fire_id % 16) / 64D"),
        _num("(1 + fire_id % 11) / 64D"),
    )


def fires(spark, sf_dir) -> DataFrame:
    return split_label(fires_raw(spark, sf_dir))


def tiles(spark, sf_dir) -> DataFrame:
    """Square tiles that together hold every fire."""
    df = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("tile_id"))
    wide = F.lit(1.5)
    return _rect_layer(df, _num("147 + 1.5D * (tile_id % 5)"), _num("-37 + 1.5D * (tile_id div 5)"), wide, wide)


def triangles(spark, sf_dir) -> DataFrame:
    """Lower left half of every fire rectangle."""
    b = F.col("bbox")
    ring = polygon([(b["xmin"], b["ymin"]), (b["xmax"], b["ymin"]), (b["xmin"], b["ymax"])])
    return fires_raw(spark, sf_dir).select("fire_id", ring.alias("rings"), "bbox")


def bowties(spark, sf_dir) -> DataFrame:
    """Every fire rectangle with two corners swapped: two lobes of a quarter each, on its left and right."""
    b = F.col("bbox")
    ring = polygon([(b["xmin"], b["ymin"]), (b["xmax"], b["ymax"]), (b["xmax"], b["ymin"]), (b["xmin"], b["ymax"])])
    return fires_raw(spark, sf_dir).select("fire_id", ring.alias("rings"), "bbox")


def dense_lga(spark, sf_dir) -> DataFrame:
    """Districts with a vertex every 1/64 degree."""
    b, steps = F.col("bbox"), F.sequence(F.lit(0), F.lit(63))

    def side(x: str, y: str, dx: int, dy: int) -> Column:
        return F.transform(steps, lambda i: point_xy(b[x] + dx * i / 64, b[y] + dy * i / 64))

    sides = [side("xmin", "ymin", 1, 0), side("xmax", "ymin", 0, 1), side("xmax", "ymax", -1, 0), side("xmin", "ymax", 0, -1)]
    pts = F.concat(*sides, F.array(point_xy(b["xmin"], b["ymin"])))
    ring = F.struct(F.lit(0).alias("part"), F.lit(False).alias("hole"), pts.alias("pts"))
    return lga(spark, sf_dir).withColumn("rings", F.array(ring))


def crowded_fires(spark, sf_dir) -> DataFrame:
    """All fires in one place, on sixteen spots."""
    k = wide_table(spark, sf_dir, "orders", ["o_orderkey"]).select(F.col("o_orderkey").alias("fire_id"))
    size = _num("(8 + fire_id % 5) / 64D")
    return _rect_layer(k, _num("148.9375D + (fire_id % 4) / 64D"), _num("-35.0625D + (fire_id % 16 div 4) / 64D"), size, size)


def season_squares(spark, sf_dir, cell: float) -> DataFrame:
    """The squares of a grid that the fires of a season meet, each once."""
    cells = with_cells(fires(spark, sf_dir).where("FireSeason IS NOT NULL").select("FireSeason", "bbox"), "bbox", cell)
    cells = cells.select("FireSeason", "cx", "cy").distinct()
    return _rect_layer(cells, F.col("cx") * cell, F.col("cy") * cell, F.lit(cell), F.lit(cell))


def landuse(spark, sf_dir) -> DataFrame:
    df = wide_table(spark, sf_dir, "part", ["p_partkey", "p_type"]).select(
        F.col("p_partkey").alias("landuse_id"),
        F.when(F.col("p_partkey") % 71 != 0, F.col("p_type")).alias("Secondary"),
    )
    return _rect_layer(
        df,
        _num("147.75D + ((29 * landuse_id) % 320) / 64D"),
        _num("-36.25D + ((41 * landuse_id + 5 * (landuse_id div 320)) % 320) / 64D"),
        _num("(4 + landuse_id % 32) / 64D"),
        _num("(4 + landuse_id % 23) / 64D"),
    )


def mesh_areas(spark, sf_dir) -> DataFrame:
    """A second table of areas per district and class, to compare against."""
    return (
        table(spark, sf_dir, "part")
        .groupBy(
            (10000 + 10 * (F.col("p_partkey") % 30)).cast("int").alias("LGA_CODE_2019"),
            F.col("p_type").alias("LANDUSETYPE"),
        )
        .agg(F.sum(F.col("p_size").cast("bigint")).cast("double").alias("OTHERHA"))
    )


def towers(spark, sf_dir) -> DataFrame:
    k = F.col("cell")
    epoch = F.date_diff(F.col("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400
    df = table(spark, sf_dir, "orders").withColumn("cell", F.col("o_orderkey"))
    kinds = F.array(*[F.lit(v) for v in ("GSM", "UMTS", "LTE", "CDMA", "NR")])
    return df.select(
        F.get(kinds, (k % 5).cast("int")).alias("radio"),
        (500 + k % 5).alias("mcc"),
        (k % 30).alias("net"),
        "cell",
        _num("148 + ((37 * cell) % 320) / 64D").alias("lon"),
        _num("-36 + ((53 * cell) % 320) / 64D").alias("lat"),
        F.when(k % 101 != 0, epoch).alias("created"),
        (epoch + (k % 1000) * 86400).alias("updated"),
    )


def code_tables(spark, sf_dir) -> list[DataFrame]:
    nation = table(spark, sf_dir, "nation").select(
        (500 + F.col("n_regionkey")).cast("bigint").alias("MCC"),
        F.col("n_nationkey").cast("bigint").alias("MNC"),
        F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).alias("Network"),
        F.concat(F.lit("Op "), F.col("n_name")).alias("Operator or brand name"),
    )
    region = table(spark, sf_dir, "region").select(
        (500 + F.col("r_regionkey")).cast("bigint").alias("MCC"),
        F.col("r_regionkey").cast("bigint").alias("MNC"),
        F.concat(F.lit("Op "), F.col("r_name")).alias("Operator or brand name"),
    )
    s = F.col("s_suppkey")
    supplier = table(spark, sf_dir, "supplier").select(
        (600 + F.col("s_nationkey")).cast("bigint").alias("MCC"),
        s.alias("MNC"),
        F.when(s % 4 != 0, F.col("s_name")).alias("Network"),
        F.concat(F.lit("Op "), F.col("s_name")).alias("Operator or brand name"),
    )
    return [nation, region, supplier]


def occurrences(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumn("row_id", F.col("event_id"))
    return df.select(
        "row_id",
        _num("-36 + ((53 * row_id) % 320) / 64D + 1 / 128D").alias("Latitude"),
        _num("148 + ((37 * row_id) % 320) / 64D + 1 / 128D").alias("Longitude"),
        F.col("event_type").alias("Scientific Name - original"),
        F.concat(F.lit("LGA "), F.col("user_id") % 25).alias("Local Government Areas 2011"),
        F.when(F.col("row_id") % 40 != 0, F.date_format("ts", "yyyy-MM-dd")).alias("Event Date - parsed"),
    )


def selection(spark, sf_dir) -> DataFrame:
    """Row ids picked on a map, from anywhere in the table, every one of them twice."""
    rows = table(spark, sf_dir, "events").where("event_id % 7 = 3").select("event_id", "user_id")
    twice = rows.select("event_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("again"))
    return twice.select((2 * F.col("event_id") + F.col("again")).alias("pos"), F.col("event_id").alias("row_id"))


def indicators(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # Summed per customer's nation before the name is looked up.
    sums = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .groupBy("c_nationkey", "o_orderpriority", F.year("o_orderdate").alias("Year"))
        .agg(F.round(F.sum("o_totalprice"), 2).alias("Value"))
    )
    return sums.join(nation, sums.c_nationkey == nation.n_nationkey).select(
        F.col("n_name").alias("Country Name"),
        F.col("o_orderpriority").alias("Indicator Name"),
        "Year",
        "Value",
    )


def managed_land(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("land_id"),
        F.col("s_name").alias("NAME_SHORT"),
        F.concat(F.lit("TYPE "), F.col("s_nationkey") % 4).alias("TYPE"),
    )
    quarter = F.lit(0.25)
    return _rect_layer(
        df,
        _num("148 + ((29 * land_id) % 320) / 64D"),
        _num("-36 + ((41 * land_id) % 320) / 64D"),
        quarter,
        quarter,
    )


def features(spark, sf_dir) -> DataFrame:
    """Tagged map points."""
    df = table(spark, sf_dir, "events").withColumn("row_id", F.col("event_id"))
    return df.select(
        "row_id",
        _num("148 + ((37 * row_id) % 320) / 64D + 1 / 128D").alias("x"),
        _num("-36 + ((53 * row_id) % 320) / 64D + 1 / 128D").alias("y"),
        F.create_map(
            F.lit("amenity"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k")
        ).alias("tags"),
    )


def places(spark, sf_dir) -> DataFrame:
    """An L-shaped place with a hole in every district's tile."""
    df = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("place_id"), _num("148 + n_nationkey % 5").alias("x"), _num("-36 + n_nationkey div 5").alias("y")
    )

    def ring(corners: list, hole: bool) -> Column:
        pts = [point_xy(F.col("x") + dx, F.col("y") + dy) for dx, dy in [*corners, corners[0]]]
        return F.struct(F.lit(0).alias("part"), F.lit(hole).alias("hole"), F.array(*pts).alias("pts"))

    outer = ring([(0, 0), (1, 0), (1, 0.25), (0.375, 0.25), (0.375, 1), (0, 1)], False)
    hole = ring([(0.125, 0.5), (0.125, 0.75), (0.25, 0.75), (0.25, 0.5)], True)
    edge = [F.col("x"), F.col("y"), F.col("x") + 1, F.col("y") + 1]
    return df.select("place_id", F.array(outer, hole).alias("rings"), box(*edge).alias("bbox"))


def mixed_features(spark, sf_dir) -> DataFrame:
    """Tagged map features of all kinds as WKT: a point for every event, a bent line for every order, a
    rectangle for every part."""
    b = F.col("bbox")
    events = features(spark, sf_dir)
    spots = events.select(
        F.lit("node").alias("element"), F.col("row_id").alias("osmid"), "tags", paths_to_wkt(point_path(F.col("x"), F.col("y"))).alias("geometry")
    )
    bent = line_path([(b["xmin"], b["ymin"]), (b["xmax"], b["ymin"]), (b["xmax"], b["ymax"])])
    ways = fires_raw(spark, sf_dir).select(
        F.lit("way").alias("element"), F.col("fire_id").alias("osmid"),
        F.create_map(F.lit("amenity"), F.when(F.col("fire_id") % 3 == 0, "click").otherwise("road")).alias("tags"),
        paths_to_wkt(bent).alias("geometry"),
    )
    areas = landuse(spark, sf_dir).select(
        F.lit("relation").alias("element"), F.col("landuse_id").alias("osmid"),
        F.create_map(F.lit("amenity"), F.when(F.col("landuse_id") % 2 == 0, "click").otherwise("view")).alias("tags"),
        to_wkt(F.col("rings")).alias("geometry"),
    )
    return spots.unionByName(ways).unionByName(areas)


def collections(spark, sf_dir) -> DataFrame:
    """FeatureCollection text: three features for every supplier."""
    k = F.col("s_suppkey")

    def feature(i: int) -> Column:
        props = F.struct(
            F.concat(F.lit("Unit "), (k + i) % 7).alias("MapUnitNa"), F.lit(i).alias("no")
        )
        spot = F.struct(F.lit("Point").alias("type"), F.array(k + 0.5, F.lit(float(i))).alias("coordinates"))
        return F.struct(F.lit("Feature").alias("type"), props.alias("properties"), spot.alias("geometry"))

    doc = F.struct(
        F.lit("FeatureCollection").alias("type"), F.array(*[feature(i) for i in range(3)]).alias("features")
    )
    return table(spark, sf_dir, "supplier").select(k.alias("doc_id"), F.to_json(doc).alias("doc"))


def points_of(layer: DataFrame, row_id: str) -> DataFrame:
    """Every vertex of a layer as a row."""
    ring = layer.select(row_id, F.posexplode("rings").alias("ring", "r"))
    pts = ring.select(row_id, "ring", "r.part", "r.hole", F.posexplode("r.pts").alias("pos", "p"))
    return pts.select(row_id, "ring", "part", "hole", "pos", "p.x", "p.y")


