"""FeatureCollections as text: read in splits, however long a file is, and written as one document in parts.

Spark's text reader cuts a file at closing braces, which lets it split anywhere. What a split means depends on how it begins:
inside a string or not, and how deep. The number of quotes in the splits before says the former, the brackets outside
strings the latter, so one pass sums a split up, a running sum over the splits gives each its beginning, and a
second pass finds the features in it. A feature that runs over splits is put together by its number; all others never
move.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terraquilt.session import materialized, ship_package

#: Brackets around a feature: the document's and those of its list.
FEATURE_DEPTH = 2
_ESCAPED = re.compile(rb"\\.", re.S)
HEAD, FOOT = '{"type":"FeatureCollection","features":[', "]}"


def structure(data: bytes, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of a text that begins inside a string or not: +1 and -1 for each byte that opens or closes a bracket, and whether
    a byte is inside a string."""
    b = np.frombuffer(_ESCAPED.sub(b"__", data), np.uint8)
    quoted = (np.cumsum(b == 34) + inside) % 2 == 1
    step = np.zeros(len(b), np.int64)
    step[(b == ord("{")) | (b == ord("["))] = 1
    step[(b == ord("}")) | (b == ord("]"))] = -1
    step[quoted] = 0
    return step, quoted


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], int, bytes, pa.RecordBatch]]:
    """Runs of rows of one split in a batch: the split's place, the first row, the text and the batch."""
    place = None
    for batch in batches:
        files, starts, values = (batch.column(i).to_pylist() for i in range(3))
        at = 0
        while at < len(files):
            to = at
            while to < len(files) and (files[to], starts[to]) == (files[at], starts[at]):
                to += 1
            if (files[at], starts[at]) != place:
                place = files[at], starts[at]
            yield place, at, b"".join(v.encode() + b"}" for v in values[at:to]), batch
            at = to


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split the parity of its quotes, and for both ways to begin the change of depth and the features begun
    if the depth at its beginning is 0 to FEATURE_DEPTH and beyond (by that depth)."""
    found: dict = {}
    for place, at, data, batch in _splits(batches):
        own = found.setdefault(place, [0, [0, 0], [{}, {}], 0, batch.column(3)[at].as_py()])
        own[3] += len(data)
        for inside in (0, 1):
            step, quoted = structure(data, bool((own[0] + inside) % 2))
            depth = own[1][inside] + np.cumsum(step)
            opened = depth[(step == 1) & (np.frombuffer(data, np.uint8) == ord("{"))]
            for d, n in zip(*np.unique(opened, return_counts=True)):
                own[2][inside][int(d)] = own[2][inside].get(int(d), 0) + int(n)
            own[1][inside] = int(depth[-1])
            last = bool(quoted[-1])
        own[0] = (int(last) - 1) % 2  # `last` is that of beginning inside
    rows = [(*place, q, s, d, list(n.items()), *size) for place, (q, ds, ns, *size) in found.items() for s, (d, n) in enumerate(zip(ds, ns))]
    names = ["file", "start", "quotes", "inside", "depth", "opened", "bytes", "size"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.map_(pa.int64(), pa.int64()), pa.int64(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of splits of known beginning: number, whole (or a part of one that runs over the split's edge), place and text."""
    state, open_, number, last = {}, b"", 0, None

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * 5
        kinds = [pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["number", "whole", "file", "start", "text"])

    for place, at, data, batch in _splits(batches):
        rows = []
        if place != last:
            if last is not None and open_:
                rows.append((number, False, *last, open_.decode()))
            inside, depth, before = (batch.column(i)[at].as_py() for i in (3, 4, 5))
            # A feature that is open here began before this split.
            state = {"inside": bool(inside), "depth": depth, "begun": depth > FEATURE_DEPTH}
            open_, number, last = b"", before, place
        step, quoted = structure(data, state["inside"])
        depth = state["depth"] + np.cumsum(step)
        text = np.frombuffer(data, np.uint8)
        begins = np.flatnonzero((step == 1) & (depth == FEATURE_DEPTH + 1) & (text == ord("{")))
        ends = np.flatnonzero((step == -1) & (depth == FEATURE_DEPTH) & (text == ord("}"))) + 1
        if state["depth"] > FEATURE_DEPTH:  # a feature is open
            stop = int(ends[0]) if len(ends) else len(data)
            open_ += data[:stop]
            if len(ends):
                rows.append((number, not state["begun"], *place, open_.decode()))
                open_, ends, state["begun"] = b"", ends[1:], False
        for i, b in enumerate(begins):
            number += 1
            if i < len(ends):
                rows.append((number, True, *place, data[b : ends[i]].decode()))
            else:
                open_ = data[b:]
        state["inside"], state["depth"] = bool(quoted[-1]), int(depth[-1])
        if rows:
            yield packed(rows)
    yield packed([(number, False, *last, open_.decode())] if open_ else [])


def features(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """``value``, the text of each feature of the FeatureCollections in path: one for each file, or with ``parts`` one that
    its files make in the order of their names, each of which holds whole features."""
    ship_package(spark)
    lines = spark.read.option("lineSep", "}").text(path)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    rows = lines.select(*place, "value")
    kind = "file string, start long, quotes int, inside int, depth long, opened map<long,long>, bytes long, size long"
    sized = lines.select(*place, "value", F.col("_metadata.file_size").alias("size"))
    sums = materialized(sized.mapInArrow(_summed, kind), "splits")  # two rows a split
    # How each split begins follows from those before it, in their order: a row per split, of the table's splits.
    order = Window.orderBy("file", "start") if parts else Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # Every row was given a brace; a file that doesn't end with one has one too few, which its last split takes back.
    own = sums.where("inside = 0").groupBy("file").agg(F.max("start").alias("last"), (F.sum("bytes") - F.max("size") == 1).alias("open"))
    sums = sums.join(own, "file").withColumn("depth", F.col("depth") + F.when(F.col("open") & (F.col("start") == F.col("last")), 1).otherwise(0))
    quotes = sums.where("inside = 0").select("file", "start", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).cast("int").alias("inside"))
    known = sums.join(quotes, ["file", "start", "inside"])
    known = known.withColumn("from", F.coalesce(F.sum("depth").over(before), F.lit(0)))
    begun = F.coalesce(F.try_element_at("opened", F.lit(FEATURE_DEPTH + 1) - F.col("from")), F.lit(0))
    known = known.withColumn("begun", begun)
    known = known.select("file", "start", "inside", F.col("from"), F.coalesce(F.sum("begun").over(before), F.lit(0)).alias("number"))
    known = materialized(known, "split-beginnings")
    found = rows.join(F.broadcast(known), ["file", "start"]).select("file", "start", "value", "inside", "from", "number")
    pieces = found.mapInArrow(_pieces, "number long, whole boolean, file string, start long, text string")
    pieces = materialized(pieces, "features")
    group = ["number"] if parts else ["file", "number"]
    cut = pieces.where("NOT whole").groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("file", "start", "text"))).alias("p"))
    joined = cut.select(F.array_join("p.text", "").alias("value"))  # as many pieces as a feature has splits
    every = pieces.where("whole").select(F.col("text").alias("value")).union(joined)
    return every.where(F.get_json_object("value", "$.type") == "Feature")


def write(features: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Feature texts (``value``) as one FeatureCollection in part files: in the order of their names they make the document."""
    spark = features.sparkSession
    rows = materialized(features.select(F.monotonically_increasing_id().alias("at"), "value"), "feature-texts")
    first = rows.agg(F.min("at")).first()[0]
    # The first feature follows the head, all others, in whatever order their files are read, a comma.
    own, others = rows.where(F.col("at") == F.lit(first)), rows.where(F.col("at") != F.lit(first))
    one = spark.range(1, numPartitions=1)
    head, foot = (one.select(F.lit(x).alias("value")) for x in (HEAD, FOOT))
    lines = own.select("value").coalesce(1).union(others.select(F.concat(F.lit(","), "value").alias("value")))
    head.union(lines).union(foot).write.mode(mode).text(path)  # a union's parts are in order
