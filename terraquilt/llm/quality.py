"""Quality classifier by compression (operator 6).

Two zstandard dictionaries are trained, one on good and one on bad labelled text. A text
is cut into chunks small enough for the dictionary to matter to the last one, every
chunk is compressed with each dictionary, and the sizes are summed over the whole text.
The difference, divided by their sum, and how far the text shrinks at all (text that
repeats itself shrinks under either) become a score by a logistic fit on labelled rows
that the dictionaries haven't seen.

Fitting learns from every labelled row that isn't held out, read whole, as scoring reads every text. Half of them, by a
hash of doc_id, train the dictionaries: each shard of about SHARD_BYTES of a class one of its own, and those of up to FAN
shards the one that follows them, until one is left. The others are measured where they are, and the logistic fit takes
sums over them. No text comes to the driver.

Nulls: a null text is an empty text, which has no evidence either way and gets the
score of a difference of 0. Labels that are null or other than 0 and 1 don't count. With fewer
than `LEAST` rows of a class there is nothing to learn, and each score is the share of good
labels (0.5 without labels); keep_good then keeps every document. A doc_id labelled twice counts as good only if all
its labels do; of several rows of a labelled doc_id the one whose text has the least hash is learnt from, and all are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraquilt.llm.common import materialized, ready_for_text, spread_join, tidy, unused

CHUNK, LEAST = 2048, 16
#: Bytes of text, about, that one task trains a dictionary on, and dictionaries that are trained on for the next.
SHARD_BYTES, FAN = 4_000_000, 64
#: Labels, of 12 bytes, that are broadcast; more of them are joined by shuffle.
BROADCAST_LABELS = 500_000
DICTIONARY_BYTES, LEVEL = 112_640, 3
THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    share: float

    def score(self, features: np.ndarray) -> np.ndarray:
        if not self.good:
            return np.full(len(features), self.share)
        x = (features - np.array(self.mean)) / np.array(self.scale)
        z = self.weights[0] + x @ np.array(self.weights[1:])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def pieces(data: bytes) -> list[bytes]:
    return [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]


def _compressor(dictionary: bytes) -> zstd.ZstdCompressor:
    # Trained dictionaries carry a header, raw content doesn't; zstandard tells them apart.
    data = zstd.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstd.ZstdCompressor(
        level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False, write_checksum=False
    )


class Sizer:
    """Turns texts into the two features."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = _compressor(good), _compressor(bad)

    def features(self, parts: list[bytes]) -> tuple[float, float]:
        n = g = b = 0
        for part in parts:
            n += len(part)
            g += len(self.good.compress(part))
            b += len(self.bad.compress(part))
        return ((b - g) / (b + g), float(np.log((g + b) / (2 * n)))) if n else (0.0, 0.0)


def _dictionary(samples: list[bytes]) -> bytes:
    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstd.ZstdError:  # too little text to train on: the text itself serves
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _trained(rows: DataFrame) -> DataFrame:
    """quality, shard and a dictionary (data) for each shard of rows (quality, shard, place, data), in the order of place."""

    def train(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        samples = [p for data in f.sort_values("place")["data"] for p in pieces(data)]
        return pd.DataFrame({"quality": [key[0]], "shard": [key[1]], "data": [_dictionary(samples)]})

    return rows.groupBy("quality", "shard").applyInPandas(train, "quality int, shard long, data binary")


def dictionaries(texts: DataFrame) -> dict[int, bytes]:
    """The dictionary of each class, trained on all its texts (doc_id, quality, text)."""
    sizes = {r["quality"]: r["n"] for r in texts.groupBy("quality").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    shards = {q: -(-n // SHARD_BYTES) for q, n in sizes.items()}
    shard = F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.when(F.col("quality") == 1, shards.get(1, 1)).otherwise(shards.get(0, 1)))
    rows = texts.select("quality", shard.cast("long").alias("shard"), F.col("doc_id").alias("place"), F.col("text").cast("binary").alias("data"))
    found, left = materialized(_trained(rows), "dictionaries"), max(shards.values(), default=0)
    while left > 1:
        # A class of a single dictionary keeps it.
        single = [q for q, n in shards.items() if n == 1]
        done = found.where(F.col("quality").isin(single))
        rows = found.where(~F.col("quality").isin(single))
        rows = rows.select("quality", F.floor(F.col("shard") / FAN).alias("shard"), F.col("shard").alias("place"), "data")
        found = materialized(_trained(rows).union(done), "dictionaries")
        shards = {q: -(-n // FAN) for q, n in shards.items()}
        left = max(shards.values())
    return {r["quality"]: bytes(r["data"]) for r in found.collect()}


#: Sums are added up as whole numbers of this part of 1, so that they are the same in whatever order rows come.
_PART, _LOW = 2.0**-44, 2.0**24


def _totals(features: DataFrame, terms) -> np.ndarray:
    """Sums over all rows of the arrays that terms(x, y) gives, x of the two features and y of the class."""

    @tidy
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        high = low = 0
        for f in frames:
            whole = np.rint(np.array(terms(f[["a", "b"]].to_numpy(float), f["quality"].to_numpy(float))) / _PART)
            top = np.floor(whole / _LOW)
            high, low = high + top.sum(1).astype(np.int64), low + (whole - top * _LOW).sum(1).astype(np.int64)
        if np.ndim(high):
            yield pd.DataFrame({"high": [high], "low": [low]})

    parts = features.mapInPandas(run, "high array<long>, low array<long>").collect()
    return np.array([sum(h) * int(_LOW) + sum(n) for h, n in zip(zip(*(r["high"] for r in parts)), zip(*(r["low"] for r in parts)))], float) * _PART


def _logistic(features: DataFrame, mean: np.ndarray, scale: np.ndarray, weights: tuple[float, float]) -> np.ndarray:
    """Newton's method; each step takes sums over all rows. weights: of a row of class 0 and of class 1."""
    n = len(mean) + 1
    w, ridge = np.zeros(n), np.full(n, 0.05)
    ridge[0] = 1e-6
    for _ in range(40):

        def terms(x: np.ndarray, y: np.ndarray, w=w) -> list[np.ndarray]:
            a = np.column_stack([np.ones(len(x)), (x - mean) / scale])
            weight = np.where(y == 1, weights[1], weights[0])
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            s = weight * p * (1 - p) + 1e-9
            return [*(a[:, i] * a[:, j] * s for i in range(n) for j in range(n)), *(a * (weight * (p - y))[:, None]).T]

        sums = _totals(features, terms)
        step = np.linalg.solve(sums[: n * n].reshape(n, n) + np.diag(ridge), sums[n * n :] + ridge * w)
        size = np.abs(step).max()
        w = w - step / max(1.0, size / 2)  # short steps, as separable classes would overshoot
        if size < 1e-6:
            break
    return w


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """doc_id, quality, part (0 to learn dictionaries from, 1 to calibrate on) and text of every labelled
    document that isn't held out, and the share of good labels. Where rows share a
    doc_id, the one whose text has the least hash counts."""
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    labels = labels.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    labels = materialized(labels.where(~held_out(F.col("doc_id"))), "labels")
    count = {r["quality"]: r["n"] for r in labels.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total = sum(count.values())
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(F.col("doc_id"), text.alias("text"))
    if total <= BROADCAST_LABELS:
        found = found.join(F.broadcast(labels), "doc_id")
    else:
        found = spread_join(found, labels, "doc_id", docs.groupBy("doc_id").agg(F.count("*").alias("n")), F.xxhash64("text"))
    found = found.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    found = found.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(2)).cast("int"))
    return found.where(F.col("text") != ""), count.get(1, 0) / total if total else 0.5


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from all labelled documents that aren't held out, each read whole. Of one half of them the two dictionaries
    come to the driver, of the other half sums."""
    spark = ready_for_text(docs.sparkSession)
    sample, share = labelled(docs, labels)
    sample = materialized(sample, "labelled-texts")
    halves = {(r["quality"], r["part"]): r["n"] for r in sample.groupBy("quality", "part").agg(F.count("*").alias("n")).collect()}
    if min(sum(n for (q, _), n in halves.items() if q == own) for own in (0, 1)) < LEAST or len(halves) < 4:
        return Model(b"", b"", (), (), (), share)
    found = dictionaries(sample.where("part = 0"))
    good, bad = found[1], found[0]
    shared = spark.sparkContext.broadcast((good, bad))

    @tidy
    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizer = Sizer(*shared.value)
        for f in frames:
            x = np.array([sizer.features(pieces(t.encode())) for t in f["text"]]).reshape(-1, 2)
            yield pd.DataFrame({"quality": f["quality"], "a": x[:, 0], "b": x[:, 1]})

    rest = sample.where("part = 1").select("quality", "text").mapInPandas(measure, "quality int, a double, b double")
    rest = materialized(rest, "features")
    n, good_rows = halves[0, 1] + halves[1, 1], halves[1, 1]
    mean = _totals(rest, lambda x, y: x.T) / n
    scale = np.sqrt(_totals(rest, lambda x, y: ((x - mean) ** 2).T) / n) + 1e-9
    # Weighted to the shares the classes have among all labels, so that scores are probabilities.
    w = _logistic(rest, mean, scale, ((1 - share) / (1 - good_rows / n), share / (good_rows / n)))
    return Model(good, bad, tuple(mean), tuple(scale), tuple(w), share)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a column of scores, 0 to 1, higher for good text. Narrow: no shuffle."""
    ready_for_text(docs.sparkSession)

    @tidy
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sizer = Sizer(model.good, model.bad) if model.good else None
        for texts in batches:
            if sizer:
                x = np.array([sizer.features(pieces((t or "").encode())) for t in texts]).reshape(-1, 2)
            else:
                x = np.zeros((len(texts), 2))
            yield pd.Series(model.score(x))

    scored = F.pandas_udf(run, "double", F.PandasUDFType.SCALAR_ITER)
    return docs.withColumn(name, scored("text"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    model = fit(docs, labels)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't rejected, with their own columns. Where there was nothing to learn
    from (fewer than LEAST rows of a class), none is."""
    model = fit(docs, labels)
    if not model.good:
        return docs
    name = unused(docs, "quality_score")
    return score(docs, model, name).where(F.col(name) >= THRESHOLD).drop(name)
