"""Benchmark decontamination (operator 5): passages of documents that repeat a benchmark item.

Every item is compared with windows of its own size, in shingles of five words (items of
fewer words: one shingle of all of them), slid over the whole of every document by single
words. Of a document shorter than the item the whole is the window.

1. A window whose similarity to any item reaches the threshold shares a known number of
   shingles with it; windows with fewer shingles of the benchmark are passed over. That
   is exact, and leaves few windows to fingerprint.
2. SimHash: each remaining window and each item gets 128 bits, the signs of the sums of its
   shingles' bits.
3. Multi-index Hamming search, for items of the window's size: 16 blocks of 8 bits, items
   listed under every value within RADIUS // 16 = 2 bits of theirs in each block. If two fingerprints
   differ in RADIUS = 44 bits or fewer, some block differs in 2 or fewer, so all items within the
   radius are found. At the threshold fingerprints differ in 19 bits, give or take 4.
4. Candidates are verified by the exact weighted Jaccard similarity, with the number of times that a
   shingle occurs as its weight.

The benchmark is read in slices of about SLICE_CHARS characters, one pass over the documents
each, so what is broadcast is bounded however large it grows. Documents aren't shuffled.

Nulls: a null or wordless text has no windows, a null or wordless item matches nothing.
Rows of equal doc_id are searched one by one and reported together. Equal items are all reported.
"""

from __future__ import annotations

import functools
import itertools
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraquilt.llm.common import ready_for_text, tidy
from terraquilt.llm.words import SHINGLE_WORDS, chunks, mix, shingle_hashes, text_column, word_hashes

THRESHOLD = 0.8
BLOCKS, RADIUS = 16, 44
SLICE_CHARS = 8_000_000
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_U = np.uint64


@functools.cache
def near_bytes(within: int) -> tuple[int, ...]:
    """Masks of at most `within` bits of a byte."""
    return tuple(i for i in range(256) if bin(i).count("1") <= within)


def running_bits(h: np.ndarray) -> np.ndarray:
    """Running sums of +1 and -1 for each of 128 bits of every shingle."""
    both = np.stack([mix(h), mix(h ^ _U(0x5851F42D4C957F2D))], 1)
    signs = np.unpackbits(both.view(np.uint8).reshape(len(h), BLOCKS), axis=1).astype(np.int8) * 2 - 1
    out = np.zeros((len(h) + 1, 8 * BLOCKS), np.int32)
    np.cumsum(signs, axis=0, out=out[1:], dtype=np.int32)
    return out


def fingerprints(sums: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    return np.packbits(sums[starts + size] - sums[starts] > 0, axis=1)


@dataclass
class Sized:
    """Items of `size` shingles of `k` words, with their index."""

    items: list[int]
    counts: list[tuple[np.ndarray, np.ndarray]]
    prints: np.ndarray
    lists: list[dict[int, np.ndarray]]


class Index:
    """One slice of the benchmark."""

    def __init__(self, rows: list[tuple[int, str]]):
        words, bounds = word_hashes(text_column(pa.array([t for _, t in rows], pa.string())))
        grouped: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = defaultdict(list)
        for (item, _), at, to in zip(rows, bounds[:-1], bounds[1:]):
            if to > at:
                k = min(SHINGLE_WORDS, int(to - at))
                h, _ = shingle_hashes(words[at:to], np.array([0, to - at]), k)
                grouped[k, len(h)].append((item, h))
        self.known, self.maybe, self.sized = {}, {}, {}
        for k in {k for k, _ in grouped}:
            known = np.unique(np.concatenate([h for (kk, _), v in grouped.items() if kk == k for _, h in v]))
            table = np.zeros(1 << 20, bool)
            table[known >> _U(44)] = True
            self.known[k], self.maybe[k] = known, table
        for key, members in grouped.items():
            prints = np.concatenate([fingerprints(running_bits(h), np.array([0]), len(h)) for _, h in members])
            lists: list[dict[int, list[int]]] = [defaultdict(list) for _ in range(BLOCKS)]
            for i, p in enumerate(prints.tolist()):
                for b, mask in itertools.product(range(BLOCKS), near_bytes(RADIUS // BLOCKS)):
                    lists[b][p[b] ^ mask].append(i)
            self.sized[key] = Sized(
                [i for i, _ in members],
                [np.unique(h, return_counts=True) for _, h in members],
                prints,
                [{v: np.array(x) for v, x in b.items()} for b in lists],
            )

    def hits(self, texts: pa.Array) -> Iterator[tuple[int, int, int, float]]:
        """(row, item, first word of the window, similarity) of every window that matches."""
        words, bounds = word_hashes(texts)
        for k, known in self.known.items():
            h, starts = shingle_hashes(words, bounds, k)
            if not len(h):
                continue
            held = self.maybe[k][h >> _U(44)]
            at = np.flatnonzero(held)
            place = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
            held[at] = known[place] == h[at]
            short = np.diff(bounds) < k  # their one shingle has fewer words
            total = np.concatenate([[0], np.cumsum(held)])
            rows = np.flatnonzero((total[starts[1:]] > total[starts[:-1]]) & ~short)
            for row in rows.tolist():
                part = slice(starts[row], starts[row + 1])
                yield from ((row, *x) for x in self._document(k, h[part], total[starts[row] : starts[row + 1] + 1]))

    def _document(self, k: int, h: np.ndarray, total: np.ndarray) -> Iterator[tuple[int, int, float]]:
        sums = None
        for (kk, size), sized in self.sized.items():
            width = min(size, len(h))
            need = THRESHOLD * (size + width) / (1 + THRESHOLD) - 1e-9
            if kk != k or need > width:
                continue
            windows = np.flatnonzero(total[width:] - total[:-width] >= need)
            if not len(windows):
                continue
            if sums is None:
                sums = running_bits(h)
            for start, p in zip(windows.tolist(), fingerprints(sums, windows, width)):
                listed = [x for b in range(BLOCKS) if (x := sized.lists[b].get(int(p[b]))) is not None]
                if not listed:
                    continue
                near = np.unique(np.concatenate(listed))
                near = near[_POP[sized.prints[near] ^ p].sum(1, dtype=int) <= RADIUS]
                if len(near):
                    own = np.unique(h[start : start + width], return_counts=True)
                for i in near.tolist():
                    found = similarity(own, sized.counts[i])
                    if found >= THRESHOLD:
                        yield sized.items[i], start, found


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, at, to = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = int(np.minimum(a[1][at], b[1][to]).sum())
    return least / (int(a[1].sum()) + int(b[1].sum()) - least)


def slices(benchmark: DataFrame) -> Iterator[Index]:
    """The benchmark's indexes, slice by slice."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where("text is not null")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    count = -(-chars // SLICE_CHARS)
    for i in range(count):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == i)
        yield Index([(r["item_id"], r["text"]) for r in own.collect()])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per document and item that it repeats: doc_id, item_id, the similarity of the best
    window, the word at which it starts (from 0), and how many windows match."""
    spark = ready_for_text(docs.sparkSession)
    schema = "doc_id long, item_id long, start long, similarity double"
    found = spark.createDataFrame([], schema)
    for index in slices(benchmark):
        bound = spark.sparkContext.broadcast(index)

        @tidy
        def run(batches: Iterator[pa.RecordBatch], bound=bound) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = text_column(batch["text"])
                for at, to in chunks(texts):
                    rows = list(bound.value.hits(texts.slice(at, to - at)))
                    row, item, start, value = zip(*rows) if rows else ((), (), (), ())
                    ids = batch["doc_id"].slice(at, to - at).take(pa.array(row, pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(item, pa.int64()), pa.array(start, pa.int64()), pa.array(value, pa.float64())],
                        names=["doc_id", "item_id", "start", "similarity"],
                    )

        text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        found = found.union(text.mapInArrow(run, schema))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("at")))
    grouped = found.groupBy("doc_id", "item_id").agg(best.alias("best"), F.count("*").alias("windows"))
    return grouped.select(
        "doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.at")).alias("start"), "windows"
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that repeat no item, with their own columns. Narrow."""
    spark = ready_for_text(docs.sparkSession)
    for index in slices(benchmark):
        bound = spark.sparkContext.broadcast(index)

        @tidy
        def run(batches: Iterator[pa.RecordBatch], bound=bound) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, keep = text_column(batch["text"]), np.ones(batch.num_rows, bool)
                for at, to in chunks(texts):
                    for row, *_ in bound.value.hits(texts.slice(at, to - at)):
                        keep[at + row] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
