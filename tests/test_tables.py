"""Table operators: cleaning, statistics, selections, sources and sinks."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from shapes import ring, row, square

from terraquilt.functions import columns as C
from terraquilt.functions import geom
from terraquilt.functions.codec import to_wkb
from terraquilt import model
from terraquilt.model import GDA94, RINGS
from terraquilt.operators import explore, layers, overlay, prep, stats
from terraquilt.plans import fire_history as fh
from terraquilt.plans import towers as tw
from terraquilt.sources import scan, sink

R = RINGS.simpleString()
UNIT, HOLED = [square(0, 0, 1, 1)], [square(2, 0, 6, 4), square(3, 1, 4, 2, hole=True)]


def rows(df):
    return [tuple(r) for r in df.collect()]


def layer(spark, data, schema):
    df = spark.createDataFrame([(*r[:-1], row(r[-1])) for r in data], f"{schema}, rings {R}")
    df = df.withColumn("rings", geom.normalize(F.col("rings")))
    return df.withColumn("bbox", geom.bbox_of(F.col("rings")))


# --- preparation --------------------------------------------------------------

def test_split_label(spark):
    labels = ["2019-20 Wildfire", "2019-20 Hazard Reduction Burn", "Unknown", None, "2019-20 ", ""]
    got = rows(prep.split_label(spark.createDataFrame([(v,) for v in labels], "Label string")))
    assert [r[1:] for r in got] == [
        ("2019-20", "Wildfire"), ("2019-20", "Hazard Reduction Burn"), ("Unknown", None),
        (None, None), ("2019-20", ""), ("", None),
    ]


def test_dates(spark):
    df = spark.createDataFrame([("2019-12-31", "2020-01-02 03:04:05"), (None, None)], "a string, b string")
    assert rows(prep.parse_dates(df, ["a", "b"])) == [
        (dt.datetime(2019, 12, 31), dt.datetime(2020, 1, 2, 3, 4, 5)), (None, None)
    ]
    bad = spark.createDataFrame([("soon",)], "a string")
    assert rows(prep.parse_dates(bad, ["a"], lenient=True)) == [(None,)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|CANNOT_PARSE"):
        prep.parse_dates(bad, ["a"]).collect()


def test_epochs_do_not_depend_on_the_session_zone(spark):
    df = spark.createDataFrame([(0,), (1041379200,), (None,)], "created long")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Australia/Sydney")
        got = prep.epoch_to_ts(df, ["created"])
        assert rows(got) == [(dt.datetime(1970, 1, 1),), (dt.datetime(2003, 1, 1),), (None,)]
        assert rows(prep.filter_since(got, "created", "2003-01-01")) == [(dt.datetime(2003, 1, 1),)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_categories(spark, monkeypatch):
    df = spark.createDataFrame([("LTE",), ("GSM",), (None,), ("LTE",), ("UMTS",)], "radio string")
    want = [("GSM", 0), ("LTE", 1), ("LTE", 1), ("UMTS", 2), (None, -1)]
    order = ["radio_code", "radio"]
    assert sorted(rows(prep.categorize(df, ["radio"])), key=str) == sorted(want, key=str)
    monkeypatch.setattr(prep, "DICTIONARY_ROWS", 1)  # the path for dictionaries too large to send
    assert sorted(rows(prep.categorize(df).orderBy(*order)), key=str) == sorted(want, key=str)


def test_text_columns(spark):
    df = spark.createDataFrame([("Gospers", 5.5), (None, None)], "n string, a double")
    assert rows(df.select(C.label_popup(F.col("n"), F.col("a")), C.concat_text("On:", F.col("n")))) == [
        ("Fire name: Gospers <br>Burnt Area (ha): 5.5", "On:Gospers"),
        ("Fire name: None <br>Burnt Area (ha): None", None),
    ]
    log = rows(spark.createDataFrame([(100.0,), (0.0,), (-1.0,), (None,)], "v double").select(C.axis_scale(F.col("v"), "Log")))
    assert log == [(2.0,), (None,), (None,), (None,)]


def test_extract_property(spark):
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"MapUnitNa": "a", "n": 1}, "geometry": None},
        {"type": "Feature", "properties": {"n": 2}, "geometry": None},
    ]}
    df = spark.createDataFrame([(1, json.dumps(doc))], "id int, doc string")
    assert rows(prep.extract_property(df, "doc", "MapUnitNa")) == [(1, 0, "a"), (1, 1, None)]


# --- statistics ---------------------------------------------------------------

@pytest.fixture(scope="module")
def lga(spark):
    data = [(1, "West", 10, [square(150, -34, 151, -33)]), (1, "East", 20, [square(151, -34, 152, -33)]), (2, "Far", 30, [square(160, -34, 161, -33)])]
    return layer(spark, data, "STE_CODE16 int, LGA_NAME19 string, LGA_CODE_2019 int")


@pytest.fixture(scope="module")
def fires(spark):
    over = [square(150.5, -33.5, 151.5, -33.25)]  # over both districts
    data = [
        (1, "a", "2019-20 Wildfire", 100.0, over),
        (2, None, "2019-20 Wildfire", 7.0, over),  # overlaps the first: both count
        (3, "c", "Unknown", 1.0, over),
        (4, "d", None, 1.0, over),
        (5, "e", "2020-21 Prescribed Burn", None, [square(150.25, -33, 150.5, -32.5)]),  # touches West
    ]
    return prep.split_label(layer(spark, data, "fire_id int, FireNo string, Label string, AreaHa double"))


def test_fire_statistics(lga, fires):
    got = {(r["LGA_NAME19"], r["FIRETYPE"]): (r["FIRECOUNT"], r["AREAHA"]) for r in stats.lga_fire_stats(lga, fires).collect()}
    one = lga.sparkSession.range(1).select(
        geom.area_ha(geom.rectangle(*[F.lit(v) for v in (150.5, -33.5, 151.0, -33.25)]))
    ).first()[0]
    assert got == {
        ("West", "Wildfire"): (2, pytest.approx(2 * one)),
        ("East", "Wildfire"): (2, pytest.approx(2 * one)),
        ("West", "Prescribed Burn"): (1, 0.0),
    }
    assert stats.lga_fire_stats(lga, fires, keep_geom_type=True).count() == 2
    grouped = stats.overlay_grouped(fires, lga)
    assert [f.dataType.simpleString() for f in grouped.schema] == ["string", "string", "string", "string", "bigint", "double"]
    assert grouped.columns == ["LGA_NAME", "LGA_CODE", "FIRESEASON", "FIRETYPE", "FIRECOUNT", "AREAHA"]


def test_state_filter_and_counts(lga, fires):
    assert fh.fire_history(fires, lga, state=2).count() == 0
    assert sorted(rows(stats.fire_count_per_lga(lga, fires))) == [("East", 20, 4), ("Far", 30, 0), ("West", 10, 5)]


def test_stated_area_overcounts(lga, fires):
    got = {r["fire_id"]: r for r in stats.layer_overlap_blowout(lga, fires, fire_id="fire_id").collect()}
    assert got[1]["LGAS"] == 2 and got[1]["STATEDHA"] == 200.0
    assert got[5]["STATEDHA"] is None


def test_season_type_area(spark, fires):
    assert sorted(rows(stats.season_type_area(fires))) == [
        ("2019-20", "Wildfire", 107.0), ("2020-21", "Prescribed Burn", 0.0)
    ]


def test_landuse(spark, lga, fires):
    use = layer(spark, [(1, "Grazing", [square(150.5, -33.5, 151.5, -33)]), (2, None, [square(150, -34, 151, -33)])], "landuse_id int, Secondary string")
    areas = stats.lga_landuse_stats(lga, use)
    assert {r["LGA_NAME19"] for r in areas.collect()} == {"West", "East"}
    burnt = {r["FIRESEASON"]: r for r in stats.landuse_burnt(use, lga, fires).collect()}
    assert set(burnt) == {"2019-20", "Unknown"}
    assert 199 < 2 * burnt["2019-20"]["BURNTPCT"] < 201  # two fires over nearly half of it
    other = spark.createDataFrame([(10, "Grazing", 5.0), (99, "Forest", 7.0)], "LGA_CODE_2019 int, LANDUSETYPE string, OTHERHA double")
    both = {r["LGA_CODE_2019"]: r for r in stats.landuse_compare(areas.drop("LGA_NAME19"), other, ["LGA_CODE_2019", "LANDUSETYPE"]).collect()}
    assert both[99]["AREAHA"] is None and both[99]["DIFFHA"] == -7.0
    assert both[20]["OTHERHA"] is None and both[20]["DIFFHA"] == both[20]["AREAHA"]


def test_land_use_beside_a_fire_is_not_burnt(spark, lga, fires):
    """Areas of pairs come from edge rows, pair by pair nothing is clipped; a class whose shapes only touch a fire never burnt."""
    corners = [((0, 0), (0.3, 0.1), (0.2, 0.4)), ((0.3, 0.1), (0.6, 0.3), (0.2, 0.4))]
    left, right = ([ring(*[(150.1 + x, -33.7 + y) for x, y in c])] for c in corners)
    use = layer(spark, [(1, "Beside", left), (2, "Under", right)], "landuse_id int, Secondary string")
    one = fires.limit(1).drop("rings", "bbox").withColumn("FireSeason", F.lit("2019-20"))
    fire = layer(spark, [(1, right)], "i int").select("rings", "bbox")
    out = stats.landuse_burnt(use, lga, one.crossJoin(fire))
    got = {r["LANDUSETYPE"]: (r["FIRESEASON"], r["BURNTPCT"]) for r in out.collect()}
    assert got["Beside"] == (None, 0.0)
    assert got["Under"] == ("2019-20", pytest.approx(100, rel=1e-5))
    assert "posexplode" in out._jdf.queryExecution().optimizedPlan().toString()


def test_table_summaries(spark):
    df = spark.createDataFrame([(2, "b", None), (1, "a", 1.0), (3, None, None), (4, "a", 2.0)], "row_id long, `a b` string, v double")
    assert rows(stats.table_info(df)) == [("row_id", "bigint", 4), ("a b", "string", 3), ("v", "double", 2)]
    assert rows(stats.distinct_values(df, "a b")) == [("a", 1), ("b", 2), (None, 3)]
    assert rows(stats.min_max(df, "v")) == [(1.0, 2.0)]


# --- dashboards ---------------------------------------------------------------

def test_selection(spark):
    df = spark.createDataFrame([(i, f"r{i}") for i in range(5)], "row_id long, v string")
    picked = spark.createDataFrame([(0, 3), (1, 1), (2, 3)], "pos long, row_id long")
    assert [r["v"] for r in explore.selected_rows(df, picked).collect()] == ["r3", "r1", "r3"]
    assert explore.selected_rows(df, None).count() == 5
    assert explore.selected_rows(df, picked.limit(0)).count() == 0
    assert rows(explore.selection_count(picked, df)) == [(3,)]
    assert rows(explore.selection_count(None, df)) == [(0,)]


def test_pages_and_heads(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(25)], "row_id long, k long")
    assert [r["row_id"] for r in explore.page(df, ["k"], 1, 10).collect()] == [20, 22, 24, 1, 3, 5, 7, 9, 11, 13]
    assert explore.page(df, ["k"], 3, 10).count() == 0
    assert [r["row_id"] for r in explore.head(df, 2).collect()] == [0, 1]
    assert len(explore.to_records(df, 3)) == 3
    wide = explore.transpose_head(df, 3)
    assert wide.columns == ["column", "0", "1", "2"] and rows(wide) == [("k", "0", "1", "0")]


def test_indicators(spark):
    data = [("A", "x", 2000, 1.0), ("A", "y", 2000, 2.0), ("B", "x", 2000, 3.0), ("A", "x", 2001, 100.0)]
    df = spark.createDataFrame(data, "`Country Name` string, `Indicator Name` string, Year int, Value double")
    assert rows(explore.pair_indicators(df, "x", "y", 2000)) == [("A", 1.0, 2.0)]
    assert rows(explore.time_series(df, "A", "x", "Log")) == [
        (2000, 1.0, 0.0, "<b>A</b><br>x"), (2001, 100.0, 2.0, "<b>A</b><br>x")
    ]


# --- towers -------------------------------------------------------------------

def test_enrichment_matches_null_keys_and_fans_out(spark):
    towers = spark.createDataFrame([(505, 1), (505, None), (505, 9)], "mcc long, net long")
    a = spark.createDataFrame([(505, 1, "Net", "Op"), (505, None, None, "NoNet")], "MCC long, MNC long, Network string, `Operator or brand name` string")
    b = spark.createDataFrame([(505, 1, "Second")], "MCC long, MNC long, `Operator or brand name` string")
    out = tw.enrich_left(towers, tw.network_codes([a, b]))
    assert sorted(rows(out.select("mcc", "net", "Description")), key=str) == sorted(
        [(505, 1, "Net"), (505, 1, "Second"), (505, None, "NoNet"), (505, 9, None)], key=str
    )


# --- sources and sinks --------------------------------------------------------

@pytest.fixture(scope="module")
def land(spark):
    return layer(spark, [(1, "a", UNIT), (2, "b, \"q\"", HOLED), (3, None, None)], "id int, `N A` string")


def shapes_of(df):
    return {r["id"]: (r["N A"], r["rings"]) for r in df.select("id", "N A", "rings").collect()}


def test_layer_files(spark, land, tmp_path):
    sink.write_geojson(land, f"{tmp_path}/g")
    back = scan.scan_layer(spark, f"{tmp_path}/g", "geojson", schema="id int, `N A` string")
    assert shapes_of(back) == shapes_of(land)
    assert scan.srid_of(back) == GDA94
    for line in spark.read.text(f"{tmp_path}/g").collect():
        assert json.loads(line["value"])["type"] == "Feature"
    sink.write_parquet(land.select("id", "N A", to_wkb(F.col("rings")).alias("geometry")), f"{tmp_path}/w")
    assert shapes_of(scan.scan_layer(spark, f"{tmp_path}/w", "wkb", srid=4326)) == shapes_of(land)
    odd = [(1, "line\nbreak, \"quoted\"", UNIT), (2, "", HOLED), (3, None, None), (4, "back\\slash", [])]
    wide = layer(spark, odd, "id int, `N A` string")
    sink.write_csv(wide, f"{tmp_path}/c")
    back = scan.scan_csv(spark, f"{tmp_path}/c", "id int, `N A` string, geometry string", line_breaks=True)
    assert shapes_of(scan.layer_from(back, "geometry", "wkt")) == shapes_of(wide)
    sink.write_csv(wide.where("id > 1"), f"{tmp_path}/d")
    back = scan.scan_layer(spark, f"{tmp_path}/d", "wkt", schema="id int, `N A` string, geometry string")
    assert shapes_of(back) == shapes_of(wide.where("id > 1"))


def test_collections_are_layers(spark, tmp_path):
    square = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]}
    mixed = {"type": "GeometryCollection", "geometries": [square, {"type": "Point", "coordinates": [5, 5]}]}
    features = [{"type": "Feature", "properties": {"n": i}, "geometry": g} for i, g in enumerate([square, mixed, None])]
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    got = {r["n"]: r["rings"] for r in scan.scan_layer(spark, str(tmp_path), "collection", schema="n int").collect()}
    assert len(got[0][0]["pts"]) == 5 and got[1] == got[0] and got[2] is None


def test_layers_are_projected_and_systems_compared(spark, land):
    flat = scan.reproject_layer(land.withMetadata("rings", {"srid": GDA94}), 3857)
    assert scan.srid_of(flat) == 3857
    box = flat.where("id = 1").select("bbox.*").first()
    assert box["xmin"] == 0 and box["xmax"] == pytest.approx(111319.490793) and box["ymax"] == pytest.approx(111325.142866)
    with pytest.raises(ValueError):
        overlay.overlay_intersection(land.withMetadata("rings", {"srid": GDA94}), flat)
    with pytest.raises(ValueError):
        scan.reproject_layer(flat, "cea")


def test_statistics_run_on_the_declared_inputs(spark):
    """Without ids beyond those of the known inputs."""
    square = "POLYGON ((150 -34, 151 -34, 151 -33, 150 -33, 150 -34))"
    raw = [("F1", "Big", "2019-20 Wildfire", "2019-10-26", "2020-01-12", 12345678.5, square), (None, None, "2019-20 Wildfire", None, None, 0.00025, square)]
    fires = fh.prepare_fires(spark.createDataFrame(raw, model.FIRES_SCHEMA), loaded=dt.date(2024, 1, 1))
    lga_rows = spark.createDataFrame([(1, 10, "East", square)], "STE_CODE16 int, LGA_CODE_2019 int, LGA_NAME19 string, WKB string")
    lga = fh.prepare_lga(lga_rows, encoding="wkt")
    assert rows(stats.fire_count_per_lga(lga, fires)) == [("East", 10, 2)]
    assert {r["FireNo"]: r["LGAS"] for r in stats.layer_overlap_blowout(lga, fires).collect()} == {"F1": 1, None: 1}
    assert stats.lga_fire_stats(lga, fires, with_check=True).first()["BADPAIRS"] == 0
    popups = {r["popup"] for r in layers.fire_season_map(fires, "2019-20 Wildfire").collect()}
    assert popups == {"Fire name: Big <br>Burnt Area (ha): 12345678.5", "Fire name: None <br>Burnt Area (ha): 0.00025"}
    far = square.replace("15", "14")
    use = spark.createDataFrame([("crop", square), ("wood", "POLYGON ((150 -34, 150.5 -34, 150.5 -33, 150 -34))"), (None, far)], "Secondary string, geom_0 string")
    some = fires.where("FireNo = 'F1'").withColumn("rings", F.col("rings"))
    burnt = {(r["LANDUSETYPE"], r["FIRESEASON"]): r["BURNTPCT"] for r in stats.landuse_burnt(scan.layer_from(use, "geom_0", "wkt"), lga, some).collect()}
    assert burnt == {("crop", "2019-20"): pytest.approx(100), ("wood", "2019-20"): pytest.approx(100)}
    none = stats.landuse_burnt(scan.layer_from(use, "geom_0", "wkt"), lga, fires.where("false")).collect()
    assert {(r["LANDUSETYPE"], r["FIRESEASON"], r["BURNTHA"]) for r in none} == {("crop", None, 0.0), ("wood", None, 0.0)}


def test_tables_append_and_overwrite(spark, tmp_path):
    df = scan.from_local(spark, [(1,)], "k int")
    for mode, n in (("append", 1), ("append", 2), ("overwrite", 1)):
        sink.write_table(df, "kept", mode)
        assert scan.scan_table(spark, "kept").count() == n
    sink.write_external(df, "json", {"path": f"{tmp_path}/j"})
    assert rows(scan.scan_external(spark, "json", {"path": f"{tmp_path}/j"})) == [(1,)]
    df.write.option("header", True).csv(f"{tmp_path}/i")
    assert scan.scan_csv(spark, f"{tmp_path}/i").schema["k"].dataType.typeName() == "integer"


def test_filters_reach_the_scan(spark, land, tmp_path):
    raw = land.select(F.col("id").alias("STE_CODE16"), to_wkb(F.col("rings")).alias("WKB"), F.col("N A").alias("LGA_NAME19"))
    sink.write_parquet(raw, f"{tmp_path}/lga")
    df = fh.prepare_lga(scan.scan_parquet(spark, f"{tmp_path}/lga"), state=1)
    assert "EqualTo(STE_CODE16,1)" in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 1
    narrow = df.select("LGA_NAME19")._jdf.queryExecution().executedPlan().toString()
    assert "WKB" not in narrow.split("ReadSchema")[1]


def test_raw_fires_become_a_layer(spark):
    raw = spark.createDataFrame(
        [("F1", "2019-20 Wildfire", "2019-10-26", "2020-01-12", "MULTIPOLYGON (((150 -34, 151 -34, 151 -33, 150 -34)))")],
        "FireNo string, Label string, StartDate string, EndDate string, wkt string",
    )
    got = fh.prepare_fires(raw, loaded=dt.date(2024, 1, 1)).first()
    assert (got["FireSeason"], got["FireType"], got["DateUpdated"]) == ("2019-20", "Wildfire", dt.date(2024, 1, 1))
    assert got["bbox"]["xmax"] == 151.0 and "wkt" not in got.asDict()


def test_tagged_features(spark, land):
    df = spark.createDataFrame(
        [(1, 0.5, 0.5, {"amenity": "hospital"}), (2, 0.5, 0.5, {"amenity": "school"}), (3, 3.5, 1.5, {"amenity": "hospital"}), (4, 2.5, 0.5, {"shop": "x"})],
        "row_id int, x double, y double, tags map<string,string>",
    )
    found = lambda value: {r["row_id"] for r in scan.osm_features(df, land, "amenity", value).collect()}
    assert found("hospital") == {1}  # the third lies in a hole
    assert found(["hospital", "school"]) == {1, 2}
    assert found(True) == {1, 2}


def test_map_layers(land):
    got = {r["id"]: r for r in layers.layer_features(land, "id", "N A").collect()}
    assert json.loads(got[1]["geometry"])["type"] == "Polygon" and got[3]["geometry"] is None
    values = land.select("id", F.lit(1.0).alias("v")).where("id = 2")
    assert layers.join_features_to_values(land, values, "id", "v").count() == 1
