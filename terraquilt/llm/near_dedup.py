"""Near-duplicate documents by weighted min-hashing (operator 8).

1. Shingles of five words, weighted by how often they occur in the text times an inverse
   document frequency over all documents. The frequency is damped to the range 1 to
   1 + DAMPING and flat below a share of RARE of all documents: an undamped one would let
   a large group of near copies push its own shared shingles down and fall apart.
2. Improved consistent weighted sampling: for every hash function the shingle of a text
   with the least a = c / (y * e^r), y the weight rounded down on the grid that r and beta
   give. Random r, c and beta come from a table of 8,192 draws per function; ties
   fall to a second hash of the shingle. Two texts draw the same sample with the
   probability of their weighted Jaccard similarity.
3. BANDS bands of ROWS samples: 20 of 5 miss a pair of similarity 0.8 with a chance of
   0.0004. Exact copies (equal word sequences) count as one text from here on.
4. Members of a bucket are compared with the one that is in the most company over all its
   buckets (in a group of copies that is the original), then what the components so far
   leave apart in a bucket is compared too. Each pair is compared first by its 100 sampled
   bytes (estimates under SCREEN are passed over), what is left apart also by four bits of FINE further samples
   (one in sixteen is equal by chance). Samples follow TF-IDF, by which a pair of 0.8 by TF alone may have
   0.8 / (0.8 + 0.2 * (1 + DAMPING)) = 0.762: SCREEN is five deviations below that, and the
   bands of step 3 miss such a pair with a chance of 0.003. The further samples' screen is six deviations below the least that the
   sizes and weights of the two texts allow a linked pair (`least_alike`). What passes
   is compared exactly, by the weighted Jaccard similarity of the whole texts. A pair is linked if
   that reaches 0.8 with TF-IDF weights or with TF weights alone: in a small corpus any
   shared shingle is frequent, and that mustn't hide a near copy.
5. Components of the links are the classes.

The shingles that matter to step 1 are those in RARE or more of all documents. Batches name
what is in RARE / 2 or more of their own documents; those that don't name a shingle have it in
less, so one that matters has RARE / 2 of all documents in the batches that name it. Only such
names, at most 2 * average length / RARE, are counted over all documents. That is exact, and
what is broadcast has a bound.

Nulls: a null or wordless text is in a class of its own. Rows are known by doc_id and a hash of their text, so a
null or repeated doc_id is a document per text, and each gets the class of its own text; texts are fetched for
comparison only where a pair names them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terraquilt.llm.common import components, kept, materialized, ready_for_text, spread_join, tidy, unused
from terraquilt.llm.words import SHINGLE_WORDS, chunks, mix, shingle_hashes, text_column, word_hashes

THRESHOLD, BANDS, ROWS = 0.8, 20, 5
RARE, DAMPING = 0.02, 0.25
SCREEN = 0.55
#: Further samples of texts that buckets leave apart, four bits of each, from smaller tables.
FINE, SPREAD, FINE_TABLE = 4000, 6.0, 1 << 9
#: Members of a bucket that one task compares with each other.
BLOCK = 1000
_TABLE = 1 << 13
#: Shingles sampled at a time; a longer text is taken whole.
PIECE = 1 << 15
_U = np.uint64


def _weighted(hashes: np.ndarray, bounds: np.ndarray, idf: tuple[np.ndarray, np.ndarray]):
    """Distinct shingles of each text with their weights and numbers, sorted within the text."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(h))).astype(np.float64)
    weights = counts.copy()
    h, o = h[first], o[first]
    keys, values = idf
    if len(keys):
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        weights *= np.where(keys[at] == h, values[at], 1 + DAMPING)
    else:
        weights *= 1 + DAMPING
    return h, weights, counts, np.searchsorted(o, np.arange(len(bounds)))


class Sampler:
    """Draws the weighted samples of a batch of texts."""

    def __init__(self, count: int, seed: int = 11, table: int = _TABLE):
        random = np.random.default_rng(seed)
        shape, self.shift = (count, table), _U(64 - (table - 1).bit_length())
        self.r = random.standard_gamma(2, shape, np.float32)
        self.c = np.log(random.standard_gamma(2, shape, np.float32))
        self.beta = random.random(shape, np.float32)
        self.factors = random.integers(1, 2**63, count, dtype=np.uint64) * _U(2) + _U(1)
        self.usual = np.float32(np.log(1 + DAMPING))  # of a shingle that occurs once and isn't frequent
        self.ready = np.stack([self._least(k, slice(None), self.usual) for k in range(count)])

    def _least(self, k: int, at, log_weight) -> np.ndarray:
        """The bits of log a, in order, above a hash of the weight's step."""
        r, c, beta = self.r[k][at], self.c[k][at], self.beta[k][at]
        t = np.floor(log_weight / r + beta)
        bits = (c - r * (t - beta) - r).view(np.int32)
        bits = bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))  # floats below 0 order the other way round
        step = t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1)
        return ((bits.astype(np.int64) + (1 << 31)).astype(_U) << _U(32)) | step

    def draw(self, h: np.ndarray, weights: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """One row per text with shingles, one column per hash function: bits of the
        least value, then of the shingle it belongs to."""
        full = np.flatnonzero(np.diff(bounds) > 0)
        starts, ends = bounds[:-1][full], bounds[1:][full]
        logs = np.log(weights).astype(np.float32)
        low = mix(h + _U(1)) >> _U(32)
        out = np.empty((len(full), len(self.factors)), np.uint64)
        first = 0
        while first < len(full):  # some texts at a time, whose shingles stay in the processor's cache
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + PIECE, "right")))
            part = slice(starts[first], ends[last - 1])
            own, tail, begin = h[part], low[part], starts[first:last] - starts[first]
            other = np.flatnonzero(np.abs(logs[part] - self.usual) > 1e-6)
            rest, value = logs[part][other], np.empty(len(own), np.uint64)
            for k, factor in enumerate(self.factors):
                at = ((own * factor) >> self.shift).view(np.int64)
                np.take(self.ready[k], at, out=value, mode="clip")
                if len(other):
                    value[other] = self._least(k, at[other], rest)
                value ^= tail
                out[first:last, k] = np.minimum.reduceat(value, begin)
            first = last
        return out

    def bits(self, h: np.ndarray, weights: np.ndarray, bounds: np.ndarray, texts: int = 256) -> np.ndarray:
        """Four bits of each sample. Some texts at a time: samples are 16 times as wide."""
        parts = [np.empty((0, len(self.factors)), np.uint8)]
        for at in range(0, len(bounds) - 1, texts):
            own = bounds[at : at + texts + 1]
            drawn = self.draw(h[own[0] : own[-1]], weights[own[0] : own[-1]], own - own[0])
            parts.append((mix(drawn) >> _U(60)).astype(np.uint8))
        return np.concatenate(parts)


@kept
def sampler() -> Sampler:
    """One per task of a Python worker: its tables take a moment to draw, and other stages have no use for them."""
    return Sampler(BANDS * ROWS)


@kept
def fine_sampler() -> Sampler:
    return Sampler(FINE, 12, FINE_TABLE)


# --- step 1: the frequent shingles -----------------------------------------------------------


def _batches(batches: Iterator[pa.RecordBatch], k: int):
    for batch in batches:
        for at, to in chunks(texts := text_column(batch["text"])):
            yield batch.slice(at, to - at), *shingle_hashes(*word_hashes(texts.slice(at, to - at)), k)


def frequencies(docs: DataFrame, k: int = SHINGLE_WORDS, rare: float = RARE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles in a share `rare` of all documents, and their damped weights."""

    @tidy
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, h, bounds in _batches(batches, k):
            keys, counts = np.unique(h, return_counts=True)
            keys = keys[counts >= rare / 2 * part.num_rows]  # counts within a document too: never too few
            yield from named_documents(part, h, bounds, keys)

    def named_documents(part, h, bounds, keys):
        if not len(keys):
            return
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == h)
        owner = np.repeat(np.arange(part.num_rows), np.diff(bounds))[hit]
        found, counts = np.unique(np.unique(owner * len(keys) + at[hit]) % len(keys), return_counts=True)
        yield pa.RecordBatch.from_pydict({"h": keys[found].view(np.int64), "n": counts.astype(np.int64)})

    @tidy
    def of_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, h, bounds in _batches(batches, k):
            yield from named_documents(part, h, bounds, named.value)

    spark = ready_for_text(docs.sparkSession)
    text = docs.select("text")
    total = text.count()
    first = text.mapInArrow(own, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    # Batches that don't name a shingle have less than rare / 2 of their documents with it, so one
    # in `rare` of all is named with rare / 2 of all at least: 2 * average length / rare names.
    names = [r["h"] for r in first.where(F.col("n") >= rare / 2 * total).select("h").collect()]
    names = np.sort(np.array(names, np.int64).view(np.uint64))
    if not len(names):
        return names, np.zeros(0)
    named = spark.sparkContext.broadcast(names)
    counted = text.mapInArrow(of_names, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") >= rare * total).collect()
    keys = np.array([r["h"] for r in rows], np.int64).view(np.uint64)
    share = np.array([r["n"] for r in rows], float) / max(total, 1)
    weights = 1 + DAMPING * np.log(1 / share) / np.log(1 / rare)
    order = np.argsort(keys)
    return keys[order], weights[order]


# --- steps 2 and 3: samples, bands, copies ---------------------------------------------------

_SIGNED = "doc_id long, row_key long, k1 long, k2 long, bands array<long>, sketch binary"


def signatures(docs: DataFrame, idf, k: int = SHINGLE_WORDS) -> DataFrame:
    """A row per document with words: two keys of its word sequence, a key for each band, and
    a byte for each sample. Narrow."""
    bound = docs.sparkSession.sparkContext.broadcast(idf)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, rows = text_column(batch["text"]), batch["doc_id"], batch["row_key"]
            for at, to in chunks(texts):
                words, bounds = word_hashes(texts.slice(at, to - at))
                full = np.flatnonzero(np.diff(bounds) > 0)
                if not len(full):
                    continue
                place = np.arange(len(words)) - np.repeat(bounds[:-1], np.diff(bounds))
                step = mix(place.astype(np.uint64) + _U(1))
                keys = [np.add.reduceat(mix(words ^ (step * _U(f))), bounds[:-1][full]) for f in (3, 5)]
                h, weights, _, bounds = _weighted(*shingle_hashes(words, bounds, k), bound.value)
                drawn = sampler().draw(h, weights, bounds)
                bands = mix(drawn).reshape(len(full), BANDS, ROWS)
                turn = np.arange(1, ROWS + 1, dtype=np.uint64) * _U(2) + _U(1)
                bands = mix((bands * turn).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
                sketch = np.ascontiguousarray((mix(drawn) >> _U(56)).astype(np.uint8))
                yield pa.RecordBatch.from_arrays([
                    ids.slice(at, to - at).take(pa.array(full)),
                    rows.slice(at, to - at).take(pa.array(full)),
                    pa.array(keys[0].view(np.int64)),
                    pa.array(keys[1].view(np.int64)),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(0, BANDS * len(full) + 1, BANDS, dtype=np.int32)),
                        pa.array(bands.reshape(-1).view(np.int64)),
                    ),
                    pa.array([row.tobytes() for row in sketch], pa.binary()),
                ], names=["doc_id", "row_key", "k1", "k2", "bands", "sketch"])

    return docs.select("doc_id", "row_key", "text").mapInArrow(run, _SIGNED)


def fine_sketches(texts: DataFrame, idf, k: int = SHINGLE_WORDS) -> DataFrame:
    """id, four bits for each of FINE samples, size (shingles) and weight of texts (id, text) with words. Narrow."""
    bound = texts.sparkSession.sparkContext.broadcast(idf)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = text_column(batch["text"])
            for at, to in chunks(found):
                words, bounds = word_hashes(found.slice(at, to - at))
                full = np.flatnonzero(np.diff(bounds) > 0)
                if not len(full):
                    continue
                h, weights, counts, bounds = _weighted(*shingle_hashes(words, bounds, k), bound.value)
                sums = [np.add.reduceat(x, bounds[:-1][full]) for x in (counts, weights)]
                bits = fine_sampler().bits(h, weights, bounds)
                sketch = np.ascontiguousarray(bits[:, ::2] << 4 | bits[:, 1::2])
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].slice(at, to - at).take(pa.array(full)), pa.array([x.tobytes() for x in sketch], pa.binary()), *map(pa.array, sums)],
                    names=["id", "fine", "size", "weight"],
                )

    return texts.select("id", "text").mapInArrow(run, "id long, fine binary, size double, weight double")


def least_alike(size: np.ndarray, weight: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least share of equal samples that a linked pair (a, b) has, but for chance of SPREAD deviations. A pair is linked by
    TF-IDF or by TF. Shared shingles of weight 1 + DAMPING less some deficit can't have more of it than either text, so
    what TF alone asks for bounds the similarity by TF-IDF, which the samples follow."""
    deficit = (1 + DAMPING) * size - weight
    shared = (1 + DAMPING) * THRESHOLD / (1 + THRESHOLD) * (size[a] + size[b]) - np.minimum(deficit[a], deficit[b])
    by_tf = shared / (weight[a] + weight[b] - shared)
    p = np.clip(np.minimum(by_tf, THRESHOLD), 0, 1)
    equal = p + (1 - p) / 16  # four bits are equal by chance
    return equal - SPREAD * np.sqrt(equal * (1 - equal) / FINE)


def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal halves of bytes, row by row."""
    other = x ^ y
    return (((other & 15) == 0).sum(1) + ((other >> 4) == 0).sum(1)) / (2 * x.shape[1])


# --- step 4: comparing pairs ------------------------------------------------------------------


def similarity(a, b) -> float:
    """Weighted Jaccard similarity of two sorted (hashes, weights, counts): the larger of
    those by weight and by count."""
    _, at, to = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    best = 0.0
    for x, y in ((a[1], b[1]), (a[2], b[2])):
        least = np.minimum(x[at], y[to]).sum()
        best = max(best, float(least / (x.sum() + y.sum() - least)))
    return best


def verified(pairs: DataFrame, texts: DataFrame, idf, k: int = SHINGLE_WORDS) -> DataFrame:
    """Of pairs (a, b) those whose whole texts (id, text) reach the threshold, with their similarity."""
    bound = texts.sparkSession.sparkContext.broadcast(idf)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = text_column(batch["text_a"]), text_column(batch["text_b"])
            for at, to in chunks(left, right):
                n = to - at
                sides = [_weighted(*shingle_hashes(*word_hashes(t.slice(at, n)), k), bound.value) for t in (left, right)]
                cut = lambda s, i: [x[s[3][i] : s[3][i + 1]] for x in s[:3]]
                found = np.array([similarity(cut(sides[0], i), cut(sides[1], i)) for i in range(n)])
                keep = pa.array(np.flatnonzero(found >= THRESHOLD))
                part = batch.slice(at, n).take(keep)
                yield pa.RecordBatch.from_arrays(
                    [part["a"], part["b"], pa.array(found[found >= THRESHOLD])], names=["a", "b", "similarity"]
                )

    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    with_a = spread_join(
        with_b, texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a",
        pairs.groupBy("a").agg(F.count("*").alias("n")), F.xxhash64("b"),
    )
    out = with_a.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, similarity double")
    return out.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def screened(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sampled bytes don't rule the threshold out."""
    one = lambda c: sketches.select(F.col("id").alias(c), F.col("sketch").alias("s" + c))
    both = spread_join(
        pairs.join(one("b"), "b"), one("a"), "a", pairs.groupBy("a").agg(F.count("*").alias("n")), F.xxhash64("b")
    )

    @tidy
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x, y = (np.frombuffer(b"".join(f[c]), np.uint8).reshape(len(f), -1) for c in ("sa", "sb"))
                f = f[(x == y).mean(1) >= SCREEN]
            yield f[["a", "b"]]

    return both.select("a", "b", "sa", "sb").mapInPandas(run, "a long, b long").distinct()


def apart(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of equal key but different roots that pass both screens, each found under the first key that both
    have. members: key, id, root, bands, sketch, fine, size, weight, n (rows of the key). Large keys are compared block by block."""
    blocks = F.ceil(F.col("n") / BLOCK)
    own = F.pmod(F.xxhash64("id"), blocks)
    other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    sides = ["id", "root", "bands", "sketch", "fine", "size", "weight"]
    rows = members.select("key", *sides, own.alias("own"), other.alias("other"))
    rows = rows.select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.struct(*sides, (F.col("own") <= F.col("other")).alias("left"), (F.col("own") >= F.col("other")).alias("right")).alias("m"),
    )
    groups = rows.groupBy("key", "i", "j").agg(F.collect_list("m").alias("m"))  # 2 * BLOCK at most

    @tidy
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [np.zeros((0, 2), np.int64)]
            for key, m in zip(f["key"], f["m"]):
                ids, roots = (np.array([x[c] for x in m], np.int64) for c in ("id", "root"))
                size, weight = (np.array([x[c] for x in m], np.float64) for c in ("size", "weight"))
                bands = np.array([x["bands"] for x in m], np.int64)
                left, right = (np.flatnonzero([x[c] for x in m]) for c in ("left", "right"))
                s, fine = (np.frombuffer(b"".join(x[c] for x in m), np.uint8).reshape(len(m), -1) for c in ("sketch", "fine"))
                for at in range(0, len(left), 64):  # rows of the left side in turn, for memory
                    l = left[at : at + 64]  # noqa: E741
                    equal = (s[l][:, None, :] == s[right][None, :, :]).mean(2) >= SCREEN
                    x, y = np.nonzero(equal & (roots[l][:, None] != roots[right][None, :]))
                    x, y = l[x], right[y]
                    shared = bands[x] == bands[y]
                    here = bands[x, shared.argmax(1)] == key
                    x, y = x[here], y[here]
                    least = least_alike(size, weight, x, y)
                    near = [alike(fine[x[i : i + 4096]], fine[y[i : i + 4096]]) >= least[i : i + 4096] for i in range(0, len(x), 4096)]
                    near = np.concatenate([*near, np.zeros(0, bool)])
                    out.append(np.sort(np.stack([ids[x[near]], ids[y[near]]], 1), axis=1))
            a = np.unique(np.concatenate(out), axis=0)
            yield pd.DataFrame({"a": a[:, 0], "b": a[:, 1]})

    return groups.mapInPandas(run, "a long, b long").where("a <> b").distinct()


# --- all of it ---------------------------------------------------------------------------------

#: Stands for no doc_id, so that such a row follows all others.
LAST = 2**63 - 1
#: What a text with words holds, see words.py.
HAS_WORDS = r"[0-9A-Za-z]|[^\x00-\x7F]"
#: Names of texts, of 24 bytes, that are broadcast; more of them are joined by shuffle.
BROADCAST_IDS = 500_000


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, row_key (a hash that tells texts of one doc_id apart) and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row_key"), text.alias("text"))


def _copies(signed: DataFrame) -> DataFrame:
    """A row per distinct word sequence: k1, k2, n (rows), its first row (doc_id, row_key) and id, a number of its own:
    that doc_id, or where texts share it or it is null a hash below 0."""
    place = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("d"), "row_key")
    found = signed.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    hashed = F.xxhash64("k1", "k2").bitwiseOR(F.lit(-(2**63)))
    same = W.partitionBy(F.when(F.col("first.d") < LAST, F.col("first.d")).otherwise(hashed)).orderBy("first.row_key", "k1", "k2")
    own = (F.row_number().over(same) == 1) & (F.col("first.d") < LAST)
    return found.select("k1", "k2", "n", "first.d", "first.row_key", F.when(own, F.col("first.d")).otherwise(hashed).alias("id"))


def texts_of(docs: DataFrame, copies: DataFrame, ids: DataFrame) -> DataFrame:
    """id and text of the texts named in `ids`. All other texts stay where they are, if the names may be broadcast."""
    wanted = materialized(copies.join(ids.select("id").distinct(), "id").select("id", "d", "row_key"), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    keyed = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("d"), "row_key", "text")
    # Equal rows are one text.
    return materialized(keyed.join(wanted, ["d", "row_key"]).select("id", "text").dropDuplicates(["id"]), "wanted-texts")


def classes(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, row_key, root (a number that all rows of a class share) and class_id of every row with words."""
    ready_for_text(docs.sparkSession)
    docs = _rows(docs).where(F.col("text").rlike(HAS_WORDS))
    idf = frequencies(docs, k)
    signed = materialized(signatures(docs, idf, k), "signatures")
    copies = materialized(_copies(signed), "texts")
    place = ["d", "row_key", "k1", "k2"]
    known = signed.withColumn("d", F.coalesce("doc_id", F.lit(LAST))).join(copies.select("id", *place), place)
    texts = materialized(known.dropDuplicates(place).select("id", "bands", "sketch"), "distinct-texts")
    sketches = texts.select("id", "sketch")

    members = texts.select(F.explode("bands").alias("key"), "id")
    buckets = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = materialized(buckets, "buckets")
    members = spread_join(members, buckets, "key", buckets, F.xxhash64("id"))
    members = materialized(members.select("key", "id", "n"), "members")
    # The original of a group shares more buckets with each copy than copies do with each other
    company = members.groupBy("id").agg(F.sum("n").alias("company"))
    leaders = members.join(company, "id").groupBy("key").agg(F.max(F.struct("company", (-F.col("id")).alias("a"))).alias("a"))
    led = spread_join(members, leaders.select("key", (-F.col("a.a")).alias("a")), "key", buckets, F.xxhash64("id"))
    pairs = led.where("a <> id").select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
    pairs = materialized(screened(pairs, sketches), "pairs")
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    links = materialized(verified(pairs, texts_of(docs, copies, ends), idf, k), "star-links")
    roots = materialized(components(links.select("a", "b")), "star-roots")

    rooted = members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    rooted = materialized(rooted.select("key", "id", "root", "n"), "rooted")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most")
    rest = spread_join(rooted, mixed.select("key"), "key", rooted.select("key", "n").distinct(), F.xxhash64("id"))
    rest = materialized(rest, "left-apart")
    some = texts_of(docs, copies, rest)
    fine = materialized(fine_sketches(some, idf, k), "fine-sketches")
    rest = rest.join(texts, "id").join(fine, "id").select("key", "id", "root", "bands", "sketch", "fine", "size", "weight", "n")
    more = materialized(apart(rest).join(pairs, ["a", "b"], "left_anti"), "more-pairs")
    if not more.isEmpty():
        more = materialized(verified(more, some, idf, k), "more-links")
        joined = links.select("a", "b").union(more.select("a", "b"))
        roots = materialized(components(joined), "roots")

    # Classes of several texts are known by their least doc_id.
    least = roots.join(copies.select("id", "d"), "id").groupBy("root").agg(F.min("d").alias("least"))
    named = copies.join(roots.join(least, "root"), "id", "left")
    label, root = F.coalesce("least", "d"), F.coalesce("root", "id")
    named = named.select(F.struct("k1", "k2").alias("key"), "n", root.alias("root"), F.when(label < LAST, label).otherwise(root).alias("class_id"))
    named = materialized(named, "text-classes")
    rows = signed.select("doc_id", "row_key", F.struct("k1", "k2").alias("key"))
    rows = spread_join(rows, named.drop("n"), "key", named.select("key", "n"), F.xxhash64("doc_id", "row_key"))
    return rows.select("doc_id", "row_key", "root", "class_id")


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, row_key (the hash of the text) and class_id for every row: the least doc_id of the class, or where none of its
    rows has one a number below 0. A row without words is a class of its own, known by its doc_id or null.
    Rows of equal doc_id and different texts are documents of their own."""
    wordless = _rows(docs).where(~F.col("text").rlike(HAS_WORDS))
    found = classes(docs, k).select("doc_id", "row_key", "class_id")
    return found.union(wordless.select("doc_id", "row_key", F.col("doc_id").alias("class_id")))


def drop_near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """The documents without all but the first row of each class, that of the least doc_id (rows without one come last, and
    those of one doc_id go by the hashes of their texts). Of rows equal in both, one stays. Documents without words stay, each of them."""
    found = materialized(classes(docs, k).select(F.coalesce("doc_id", F.lit(LAST)).alias("d"), "row_key", "root"), "classes")
    place = F.struct("d", "row_key")
    firsts = found.groupBy("root").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = materialized(firsts, "class-firsts")
    gone = spread_join(found, firsts.select("root", "first"), "root", firsts.select("root", "n"), F.xxhash64("row_key"))
    gone = materialized(gone.where(place != F.col("first")).select("d", "row_key").distinct(), "gone")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d, key = unused(docs, "d"), unused(docs, "row_key")
    keyed = docs.withColumn(d, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn(key, F.xxhash64(text))
    gone = gone.toDF(d, key)
    kept = keyed.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, [d, key], "left_anti")
    twice = found.groupBy("d", "row_key").agg(F.count("*").alias("n")).where("n > 1").select("d", "row_key")
    twice = materialized(twice, "twice").toDF(d, key)
    if twice.isEmpty():
        return kept.select(*docs.columns)
    # Some row of those that are equal, the same one whenever it is chosen again.
    named = [F.col(f"`{c}`") for c in docs.columns]
    again = kept.join(twice, [d, key], "left_semi").groupBy(d, key)
    again = again.agg(F.min_by(F.struct(*named), F.xxhash64(*named)).alias("row_")).select("row_.*")
    return kept.join(twice, [d, key], "left_anti").select(*docs.columns).union(again)
