"""The registered queries. Each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalogue import fixtures as fx
from terraquilt.functions import geom
from terraquilt.functions.codec import rings_from_wkb, simplify, to_wkb
from terraquilt.functions.columns import label_popup
from terraquilt.model import WEB_MERCATOR, WGS84
from terraquilt.operators import cover, explore, heavy, layers, outline, overlay, pages, prep, stats
from terraquilt.operators.cells import with_cells
from terraquilt.plans import fire_history as fh
from terraquilt.plans import towers as tw
from terraquilt.session import scratch_path
from terraquilt.sources import scan, sink

CELL = 1.0  # degrees: the district width, and above every fire's
FINE_CELL = 0.25


def rounded(df: DataFrame, **decimals: int) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), d) for c, d in decimals.items()})


# --- fires, districts, land use ----------------------------------------------

def lga_fire_stats(spark, sf):
    return rounded(fh.fire_history(fx.fires(spark, sf), fx.lga(spark, sf), cell=CELL), AREAHA=2)


def lga_fire_stats_state(spark, sf):
    return rounded(fh.fire_history(fx.fires(spark, sf), fx.lga(spark, sf), state=1, cell=CELL), AREAHA=2)


def lga_fire_stats_polygon_only(spark, sf):
    return rounded(stats.lga_fire_stats(fx.lga(spark, sf), fx.fires(spark, sf), True, CELL), AREAHA=2)


def lga_fire_stats_shuffled(spark, sf):
    """The flagship by the path taken when no side may be broadcast."""
    out = stats.lga_fire_stats(fx.lga(spark, sf), fx.fires(spark, sf), False, CELL, broadcast_left=False)
    return rounded(out, AREAHA=2)


def lga_fire_grouped(spark, sf):
    return rounded(stats.overlay_grouped(fx.fires(spark, sf), fx.lga(spark, sf), CELL), AREAHA=2)


def intersection_by_lga(spark, sf):
    lga = fx.lga(spark, sf).select("LGA_NAME19", "rings", "bbox")
    fires = fx.fires(spark, sf).select("fire_id", "rings", "bbox")
    return rounded(overlay.intersection_by(lga, fires, ["LGA_NAME19"], CELL), AREAHA=2)


def lga_landuse_stats(spark, sf):
    return rounded(stats.lga_landuse_stats(fx.lga(spark, sf), fx.landuse(spark, sf), CELL), AREAHA=2)


def landuse_burnt(spark, sf):
    out = stats.landuse_burnt(fx.landuse(spark, sf), fx.lga(spark, sf), fx.fires(spark, sf), FINE_CELL)
    return rounded(out, BURNTHA=2, TOTALHA=2, BURNTPCT=4)


def landuse_compare(spark, sf):
    areas = stats.lga_landuse_stats(fx.lga(spark, sf), fx.landuse(spark, sf), CELL).drop("LGA_NAME19")
    out = stats.landuse_compare(areas, fx.mesh_areas(spark, sf), ["LGA_CODE_2019", "LANDUSETYPE"])
    return rounded(out, AREAHA=2, DIFFHA=2)


def season_type_area(spark, sf):
    return rounded(stats.season_type_area(fx.fires(spark, sf)), AreaHa=4)


def fire_count_per_lga(spark, sf):
    return stats.fire_count_per_lga(fx.lga(spark, sf), fx.fires(spark, sf), CELL, "fire_id")


def area_blowout(spark, sf):
    out = stats.layer_overlap_blowout(fx.lga(spark, sf), fx.fires(spark, sf), CELL, "fire_id")
    return rounded(out, STATEDHA=4, CLIPPEDHA=2)


def landuse_area(spark, sf):
    return fx.landuse(spark, sf).select("landuse_id", F.round(geom.area_ha(F.col("rings")), 2).alias("AREAHA"))


def polygon_area(spark, sf):
    shapes = fx.fires_raw(spark, sf).select("fire_id", geom.to_wkt(F.col("rings")).alias("wkt"))
    return shapes.select("fire_id", F.round(geom.polygon_area(F.col("wkt")), 2).alias("AREAHA"))


def clipped_fires(spark, sf):
    lga = fx.lga(spark, sf).select("LGA_CODE_2019", "rings", "bbox")
    fires = fx.fires_raw(spark, sf).select("fire_id", "rings", "bbox")
    shapes = overlay.overlay_intersection(lga, fires, True, True, CELL)
    return shapes.select(
        "LGA_CODE_2019",
        "fire_id",
        F.round(geom.area_ha(F.col("rings")), 2).alias("AREAHA"),
        geom.n_points(simplify(F.col("rings"), layers.DISPLAY_TOLERANCE)).alias("POINTS"),
    )


def planar_conservation(spark, sf):
    tiles = fx.tiles(spark, sf).select("tile_id", "rings", "bbox")
    pairs = overlay.overlay_intersection(tiles, fx.triangles(spark, sf), cell=CELL)
    return pairs.groupBy("fire_id").agg(F.round(F.sum("area_deg"), 13).alias("DEG2"))


def overlay_bowtie(spark, sf):
    """Shapes that cross themselves: both lobes count, whichever way they are drawn."""
    tiles = fx.tiles(spark, sf).select("tile_id", "rings", "bbox")
    pairs = overlay.overlay_intersection(tiles, fx.bowties(spark, sf), cell=CELL)
    return pairs.groupBy("fire_id").agg(F.round(F.sum("area_deg"), 13).alias("DEG2"))


def _clipped(left, right, key, **options):
    pairs = overlay.overlay_intersection(left.select(key, "rings", "bbox"), right.select("fire_id", "rings", "bbox"), **options)
    return rounded(pairs.groupBy(key).agg(F.count(F.lit(1)).alias("PAIRS"), F.sum("area_ha").alias("AREAHA")), AREAHA=2)


def overlay_holes(spark, sf):
    """Places that aren't convex and have holes."""
    return _clipped(fx.places(spark, sf), fx.fires_raw(spark, sf), "place_id", cell=CELL)


def overlay_cut(spark, sf):
    """Districts of many points, cut to windows first."""
    return _clipped(fx.dense_lga(spark, sf), fx.fires_raw(spark, sf), "lga_id", keep_geom_type=False, cell=CELL)


def overlay_hot(spark, sf):
    """All fires in one cell, both sides shuffled."""
    return _clipped(fx.lga(spark, sf), fx.crowded_fires(spark, sf), "lga_id", keep_geom_type=False, cell=CELL, broadcast_left=False)


def group_outline(spark, sf):
    """Area and length of what the fires of a season cover, in squares whose shared sides cancel."""
    edges = outline.group_outline(fx.season_squares(spark, sf, 1 / 16), ["FireSeason"])
    return rounded(outline.outline_stats(edges, ["FireSeason"]).select("FireSeason", "AREA", "LENGTH"), AREA=9, LENGTH=9)


def lga_projected(spark, sf):
    layer = scan.reproject_layer(fx.lga(spark, sf), "cea")
    return rounded(fx.points_of(layer, "lga_id").select("lga_id", "pos", "x", "y"), x=3, y=3)


def label_split(spark, sf):
    return fx.fires(spark, sf).select("fire_id", "Label", "FireSeason", "FireType")


def fires_filtered(spark, sf):
    df = prep.filter_and(fx.fires(spark, sf), {"FireSeason": "1997-98", "FireType": "1-URGENT"})
    df = prep.with_load_date(prep.parse_dates(df, ["StartDate", "EndDate"]), dt.date(2020, 2, 3))
    df = prep.project(df, ["fire_id", "FireSeason", "FireType", "StartDate", "EndDate", "DateUpdated"])
    return df.withColumn("DateUpdated", F.col("DateUpdated").cast("string"))


def fire_popups(spark, sf):
    return fx.fires(spark, sf).select("fire_id", label_popup(F.col("FireName"), F.col("AreaHa")).alias("popup"))


def fires_by_union(spark, sf):
    """The results of each fire type, whichever there are: one grouping in place of a query for each."""
    fires = fx.fires(spark, sf).where("FireType IS NOT NULL").select("FireType")
    return fires.groupBy("FireType").agg(F.count(F.lit(1)).alias("n"))


# --- towers -------------------------------------------------------------------

def _towers(spark, sf):
    return tw.prepare_towers(fx.towers(spark, sf), "1998-01-01")


def towers_prepared(spark, sf):
    return rounded(_towers(spark, sf), x_3857=3, y_3857=3)


def towers_projected(spark, sf):
    """The projection as a frame function over batches, for comparison with the
    Column form used above."""
    def project(frame):
        import numpy as np

        radius = 6378137.0
        return frame.assign(
            x_3857=np.radians(frame.lon) * radius,
            y_3857=np.log(np.tan(np.radians(frame.lat) / 2 + np.pi / 4)) * radius,
        )[["cell", "x_3857", "y_3857"]]

    points = fx.towers(spark, sf).select("cell", "lon", "lat")
    out = explore.map_partitions(points, project, "cell long, x_3857 double, y_3857 double")
    return rounded(out, x_3857=3, y_3857=3)


def network_codes(spark, sf):
    return tw.network_codes(fx.code_tables(spark, sf))


def towers_enriched(spark, sf):
    out = tw.enrich_left(_towers(spark, sf), tw.network_codes(fx.code_tables(spark, sf)))
    return rounded(out, x_3857=3, y_3857=3)


def towers_preview(spark, sf):
    """The first rows of the enriched table, written and read again, on their side."""
    path = scratch_path(spark, "enriched")
    sink.write_parquet(towers_enriched(spark, sf), path)
    kept = scan.scan_parquet(spark, path)
    metres = {c: F.col(c).cast("decimal(18,3)") for c in ("x_3857", "y_3857")}
    order = F.struct("cell", "Description").alias("place")
    few = kept.withColumns(metres).select("*", order).orderBy("place").limit(3)
    few = few.withColumn("row", F.row_number().over(Window.orderBy("place"))).drop("place")  # three rows
    wide = explore.transpose_head(few, 3, "row")
    return wide.toDF("column", *[f"row_{i}" for i in range(1, len(wide.columns))])


def towers_heavy(spark, sf):
    """A lookup on keys of which one has half of all towers."""
    half = F.col("cell") % 2 == 0
    towers = fx.towers(spark, sf).withColumns({"mcc": F.when(half, 500).otherwise(F.col("mcc")), "net": F.when(half, 0).otherwise(F.col("net"))})
    codes = tw.network_codes(fx.code_tables(spark, sf)).withColumnsRenamed({"MCC": "code_mcc", "MNC": "code_mnc"})
    out = heavy.balanced_join(towers.select("cell", "mcc", "net"), codes, [("mcc", "code_mcc"), ("net", "code_mnc")])
    return out.select("cell", "mcc", "net", "Description")


def towers_head(spark, sf):
    cols = ["radio", "mcc", "net", "cell", "lon", "lat"]
    return explore.head(prep.project(fx.towers(spark, sf), cols), 5, "cell")


# --- dashboards ---------------------------------------------------------------

OCC_COLS = ["row_id", "Latitude", "Longitude", "Scientific Name - original", "Local Government Areas 2011"]


def table_info(spark, sf):
    return stats.table_info(fx.occurrences(spark, sf))


def selected_rows(spark, sf):
    return explore.selected_rows(prep.project(fx.occurrences(spark, sf), OCC_COLS), fx.selection(spark, sf))


def selection_count(spark, sf):
    return explore.selection_count(fx.selection(spark, sf), fx.occurrences(spark, sf))


def table_page(spark, sf):
    sort = [F.col("`Scientific Name - original`"), F.col("`Local Government Areas 2011`").desc()]
    return explore.page(prep.project(fx.occurrences(spark, sf), OCC_COLS), sort, 2, 10)


def table_pages(spark, sf):
    """The first, a middle and the last page of a sorted table that was indexed."""
    path = scratch_path(spark, "pages")
    sort = [F.col("`Scientific Name - original`"), F.col("`Local Government Areas 2011`").desc()]
    rows = prep.project(fx.occurrences(spark, sf), OCC_COLS)
    pages.write_page_index(rows, sort, path, range_rows=2_000)
    last = (rows.count() - 1) // 10
    found = [pages.read_page(spark, path, sort, n).withColumn("page", F.lit(n).cast("bigint")) for n in (0, last // 2, last)]
    return explore.union_all(found)


def positions(spark, sf):
    """Rows of a table of many files by their place in it."""
    path = scratch_path(spark, "files")
    events = fx.table(spark, sf, "events").select("event_id", "user_id")
    events.repartitionByRange(7, "event_id").sortWithinPartitions("event_id").write.parquet(path)
    return pages.positions(spark, path)


def distinct_lga(spark, sf):
    return stats.distinct_values(fx.occurrences(spark, sf), "Local Government Areas 2011")


def year_range(spark, sf):
    return stats.min_max(fx.indicators(spark, sf), "Year")


def indicator_pairs(spark, sf):
    return explore.pair_indicators(fx.indicators(spark, sf), "1-URGENT", "5-LOW", 1997)


def indicator_series(spark, sf):
    out = explore.time_series(fx.indicators(spark, sf), "NATION_7", "2-HIGH", "Log")
    return rounded(out, axis_value=9)


def point_layer(spark, sf):
    return layers.point_features(
        fx.occurrences(spark, sf), "Latitude", "Longitude", "Collection Date:", "Event Date - parsed"
    )


def points_reprojected(spark, sf):
    lon, lat = F.col("Longitude"), F.col("Latitude")
    m, e, d = (geom.reproject_points(lon, lat, crs) for crs in (WEB_MERCATOR, "cea", WGS84))
    return fx.occurrences(spark, sf).select(
        "row_id",
        *[F.round(c, 3).alias(n) for c, n in ((m["x"], "mx"), (m["y"], "my"), (e["x"], "ex"), (e["y"], "ey"))],
        d["x"].alias("dx"),
        d["y"].alias("dy"),
    )


# --- layers -------------------------------------------------------------------

def cell_cover(spark, sf):
    return with_cells(fx.fires_raw(spark, sf), "bbox", FINE_CELL).select("fire_id", "cx", "cy")


def _with_box(df: DataFrame, rings) -> DataFrame:
    return df.withColumn("b", geom.bbox_of(rings)).select("*", "b.*").drop("b")


def choropleth_layer(spark, sf):
    shapes = layers.layer_features(fx.managed_land(spark, sf), "NAME_SHORT", "TYPE")
    return _with_box(shapes, geom.rings_from_geojson(F.col("geometry"))).drop("geometry")


def choropleth_values(spark, sf):
    spend = fx.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("spend"))
    land = fx.managed_land(spark, sf).select("land_id", "NAME_SHORT", "TYPE")
    named = spend.withColumnRenamed("l_suppkey", "land_id")
    return layers.join_features_to_values(land, named, "land_id", "spend").drop("land_id")


def polygon_cover(spark, sf):
    """Cells of places that are neither convex nor whole, and whether they lie wholly inside."""
    return cover.polygon_cover(fx.places(spark, sf), ["place_id"], 1 / 32)


def osm_in_place(spark, sf):
    found = scan.osm_features(fx.features(spark, sf), fx.places(spark, sf), "amenity", "click", cell=FINE_CELL)
    return found.select("row_id", "x", "y")


def osm_land_in_place(spark, sf):
    inside = overlay.within_place(fx.managed_land(spark, sf), fx.places(spark, sf), "land_id", cell=FINE_CELL)
    return inside.select("land_id", "NAME_SHORT")


def osm_mixed(spark, sf):
    """Points, lines and polygons in one table, those with a tag in any place."""
    shapes = scan.shapes_from(fx.mixed_features(spark, sf), "geometry", "wkt")
    shapes = shapes.withColumn("osm", F.concat_ws("/", "element", F.col("osmid").cast("string")))
    found = scan.osm_features(shapes, fx.places(spark, sf), "amenity", "click", row_id="osm", cell=FINE_CELL)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.col("paths.kind"))), ",")
    return found.select("element", "osmid", kinds.alias("kind"))


def feature_property(spark, sf):
    return prep.extract_property(fx.collections(spark, sf), "doc", "MapUnitNa")


def _roundtrip(spark, sf, encode, decode):
    shapes = fx.landuse(spark, sf).select("landuse_id", encode(F.col("rings")).alias("g"))
    return fx.points_of(shapes.select("landuse_id", decode(F.col("g")).alias("rings")), "landuse_id")


def wkt_roundtrip(spark, sf):
    return _roundtrip(spark, sf, geom.to_wkt, geom.rings_from_wkt)


def wkb_roundtrip(spark, sf):
    return _roundtrip(spark, sf, to_wkb, rings_from_wkb)


def geojson_roundtrip(spark, sf):
    return _roundtrip(spark, sf, geom.to_geojson, geom.rings_from_geojson)


def simplified_layer(spark, sf):
    """Fires with a vertex added in the middle of every side, then simplified."""
    b = F.col("bbox")
    mx, my = (b["xmin"] + b["xmax"]) / 2, (b["ymin"] + b["ymax"]) / 2
    dense = geom.polygon([
        (b["xmin"], b["ymin"]), (mx, b["ymin"]), (b["xmax"], b["ymin"]), (b["xmax"], my),
        (b["xmax"], b["ymax"]), (mx, b["ymax"]), (b["xmin"], b["ymax"]), (b["xmin"], my),
    ])
    shapes = fx.fires_raw(spark, sf).select("fire_id", dense.alias("dense"))
    shapes = shapes.withColumn("thin", simplify(F.col("dense"), layers.DISPLAY_TOLERANCE))
    return shapes.select(
        "fire_id",
        geom.n_points(F.col("dense")).alias("before"),
        geom.n_points(F.col("thin")).alias("after"),
        F.round(geom.area_ha(F.col("thin")), 2).alias("AREAHA"),
    )


def fire_season_map(spark, sf):
    shapes = layers.fire_season_map(fx.fires(spark, sf), "1997-98 1-URGENT", fire_id="fire_id")
    shapes = _with_box(shapes, geom.rings_from_geojson(F.col("geometry")))
    return shapes.select("fire_id", F.split_part("popup", F.lit(" <br>"), F.lit(1)).alias("name"), "xmin", "ymax")


def layer_center(spark, sf):
    return rounded(stats.layer_center(fx.fires_raw(spark, sf)), lon0=6, lat0=6)


# --- sinks, read back ---------------------------------------------------------

def _land(spark, sf):
    return fx.managed_land(spark, sf)


def _back(layer: DataFrame) -> DataFrame:
    """Attributes and box of a layer that was written and read again."""
    b = F.col("bbox")
    return layer.select(
        "land_id", "NAME_SHORT", "TYPE",
        b["xmin"].alias("x0"), b["ymin"].alias("y0"), b["xmax"].alias("x1"), b["ymax"].alias("y1"),
    )


def sink_table(spark, sf):
    name = f"managed_land_{uuid.uuid4().hex}"
    sink.write_table(_land(spark, sf), name, "overwrite", path=scratch_path(spark, "table"))
    return _back(scan.scan_table(spark, name))


def sink_seasons(spark, sf):
    """A table by season of which one season is loaded again, with other rows."""
    name = f"fire_seasons_{uuid.uuid4().hex}"
    fires = fx.fires(spark, sf).select("FireSeason", "fire_id", "FireType", "AreaHa")
    sink.write_partitions(fires, name, ["FireSeason"], path=scratch_path(spark, "seasons"))
    again = prep.filter_eq(fires, "FireSeason", "1997-98").where("fire_id % 2 = 0")
    sink.write_partitions(again.withColumn("AreaHa", 2 * F.col("AreaHa")), name, ["FireSeason"])
    out = scan.scan_table(spark, name).select("fire_id", "FireSeason", "FireType", "AreaHa")
    return rounded(out, AreaHa=4)


def sink_external(spark, sf):
    path = scratch_path(spark, "external")
    sink.write_external(_land(spark, sf), "parquet", {"path": path})
    return _back(scan.scan_external(spark, "parquet", {"path": path}))


def sink_parquet(spark, sf):
    path = scratch_path(spark, "towers")
    sink.write_parquet(towers_prepared(spark, sf), path)
    return scan.scan_parquet(spark, path)


def sink_csv(spark, sf):
    path = scratch_path(spark, "csv")
    sink.write_csv(_land(spark, sf), path)
    schema = "land_id long, NAME_SHORT string, TYPE string, geometry string"
    return _back(scan.scan_layer(spark, path, "wkt", schema=schema))


def sink_geojson(spark, sf):
    path = scratch_path(spark, "geojson")
    sink.write_geojson(_land(spark, sf), path)
    schema = "land_id long, NAME_SHORT string, TYPE string"
    return _back(scan.scan_layer(spark, path, "geojson", schema=schema))


def collection_layer(spark, sf):
    """A layer written as one FeatureCollection and read again, in splits."""
    path = scratch_path(spark, "collection")
    sink.write_collection(_land(spark, sf), path)
    schema = "land_id long, NAME_SHORT string, TYPE string"
    return _back(scan.scan_layer(spark, path, "collection", schema=schema, parts=True))


QUERIES = {
    f.__name__: f
    for f in (
        lga_fire_stats, lga_fire_stats_state, lga_fire_stats_polygon_only, lga_fire_stats_shuffled,
        lga_fire_grouped, intersection_by_lga, lga_landuse_stats, landuse_burnt, landuse_compare,
        season_type_area, fire_count_per_lga, area_blowout, landuse_area, polygon_area, clipped_fires,
        planar_conservation, overlay_bowtie, overlay_holes, overlay_cut, overlay_hot, group_outline, lga_projected, label_split, fires_filtered, fire_popups, fires_by_union,
        towers_prepared, towers_projected, network_codes, towers_enriched, towers_preview, towers_heavy, towers_head,
        table_info, selected_rows, selection_count, table_page, table_pages, positions, distinct_lga, year_range,
        indicator_pairs, indicator_series, point_layer, points_reprojected, cell_cover,
        choropleth_layer, choropleth_values, polygon_cover, osm_in_place, osm_land_in_place, osm_mixed, feature_property,
        wkt_roundtrip, wkb_roundtrip, geojson_roundtrip, simplified_layer, fire_season_map,
        layer_center, sink_table, sink_seasons, sink_external, sink_parquet, sink_csv, sink_geojson, collection_layer,
    )
}
