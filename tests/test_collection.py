"""FeatureCollections in splits against a JSON parser."""

import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from terraquilt.sources import collection, scan, sink


def document(rng, n):
    odd = ['quote " and } {', "back\\slash\\", '\\"', "[[[", "ünï🙂}", "line\nbreak", "}}}}", '{"type":"Feature"}', ""]
    features = []
    for i in range(n):
        props = {"id": i, "name": rng.choice(odd), "deep": {"a": [{"b": rng.choice(odd)}, [1, [2]]], "f": {"type": "Feature", "x": 1}}}
        feature = {"type": "Feature", "properties": props, "geometry": {"type": "Point", "coordinates": [i, rng.random()]}}
        features.append(dict(sorted(feature.items(), key=lambda _: rng.random())))
    rest = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "}{"}}, "bbox": [0, 0, 1, 1]}
    doc = {**rest, "features": features, "after": [{"type": "Other", "v": [1]}]}
    return json.dumps(doc, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5), features


def ordered(features):
    return sorted(json.dumps(f, sort_keys=True) for f in features)


@pytest.mark.parametrize("split", ["128m", "3000", "200"])
def test_features_of_split_files(spark, tmp_path, split):
    rng = random.Random(7)
    want = []
    for name, n in (("a", 40), ("b", 0), ("c", 25), ("d", 1)):
        text, features = document(rng, n)
        want += features
        (tmp_path / f"{name}.json").write_text(text + rng.choice(["", "\n", " \n\n"]), "utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = collection.features(spark, str(tmp_path))
        got = [json.loads(r["value"]) for r in found.collect()]
        parts = spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert ordered(got) == ordered(want)
    assert parts > {"128m": 0, "3000": 5, "200": 50}[split]


def test_one_document_in_parts(spark, tmp_path):
    texts = [json.dumps({"type": "Feature", "properties": {"i": i, "t": 'a"}{'}, "geometry": None}) for i in range(50)]
    df = spark.createDataFrame([(t,) for t in texts], "value string").repartition(6).where(F.length("value") > 0)
    collection.write(df, str(tmp_path / "c"))
    files = sorted(glob.glob(str(tmp_path / "c" / "part-*")))
    whole = "".join(open(f, encoding="utf-8").read() for f in files)
    assert len(files) >= 3 and ordered(json.loads(whole)["features"]) == ordered(map(json.loads, texts))
    back = [json.loads(r["value"]) for r in collection.features(spark, str(tmp_path / "c"), parts=True).collect()]
    assert ordered(back) == ordered(map(json.loads, texts))
    collection.write(df.limit(0), str(tmp_path / "e"))
    whole = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(str(tmp_path / "e" / "part-*"))))
    assert json.loads(whole) == {"type": "FeatureCollection", "features": []}
    assert collection.features(spark, str(tmp_path / "e"), parts=True).collect() == []


def test_layers_of_collections(spark, tmp_path):
    rows = [(1, "a", "POLYGON ((0 0, 1 0, 1 1, 0 0))"), (2, None, "POLYGON EMPTY")]
    layer = scan.layer_from(spark.createDataFrame(rows, "id int, n string, g string"), "g", "wkt")
    sink.write_collection(layer, str(tmp_path / "l"))
    back = scan.scan_layer(spark, str(tmp_path / "l"), "collection", schema="id int, n string", parts=True)
    assert sorted((r["id"], r["n"], len(r["rings"])) for r in back.collect()) == [(1, "a", 1), (2, None, 0)]
