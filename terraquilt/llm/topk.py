"""Exact top-k by inner product over sparse integer vectors (operator 4).

Both sides are packed into blocks of a bounded number of rows, and every block of queries
meets every block of candidates once. Inside a pair of blocks, scores are gathered term
at a time: a block of candidates is a set of posting lists (term -> rows, weights), each
query's non-zero terms scatter their weighted postings into a dense array with one
slot per candidate, and a partition selection takes the k best of it. The partial lists
are k rows per query and block; a second selection per query merges them.

A posting list that most rows of a block are on is kept as a plain array of weights, so
that adding it is one contiguous pass; its zeros add nothing.

Ties go to the smaller id. An id that occurs more than once gives each of its rows, as query and
as candidate, like the registered SQL. A vector with no components scores 0 with all. Terms that one
side lacks count as 0. Rows whose id is null take no part. Scores beyond 64 bits are
worked out in Python's whole numbers and cut off at the largest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terraquilt.llm.common import materialized, ready_for_text, tidy

QUERY_BLOCK, CANDIDATE_BLOCK = 512, 4096
_BLOCK = "block long, ids binary, bounds binary, terms binary, weights binary"


def quantized(vector: Column, scale: int = 64) -> Column:
    """Integer components, or null for a vector that is null or holds null, NaN or infinity."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return F.when(vector.isNotNull() & ~bad, whole)


def sparse(vectors: DataFrame, id_col: str, ints: Column) -> DataFrame:
    """id, terms, weights: the non-zero components."""
    pairs = F.filter(F.transform(ints, lambda x, i: F.struct(i.alias("t"), x.alias("w"))), lambda p: p["w"] != 0)
    out = vectors.select(F.col(id_col).cast("long").alias("id"), pairs.alias("p")).where("id is not null and p is not null")
    return out.select("id", F.col("p.t").alias("terms"), F.col("p.w").alias("weights"))


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most `size` rows, numbered from 0 in no particular order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), size):
                part = f.iloc[at : at + size]
                lengths = np.fromiter(map(len, part["terms"]), np.int64, len(part))
                flat = lambda c, kind: np.concatenate([*part[c], np.zeros(0)]).astype(kind).tobytes()
                yield pd.DataFrame({
                    "block": [0],
                    "ids": [part["id"].to_numpy(np.int64).tobytes()],
                    "bounds": [np.concatenate([[0], np.cumsum(lengths)]).tobytes()],
                    "terms": [flat("terms", np.int32)],
                    "weights": [flat("weights", np.int64)],
                })

    blocks = rows.mapInPandas(run, _BLOCK)
    return blocks.withColumn("block", F.monotonically_increasing_id())


def _unpacked(row, prefix: str):
    read = lambda c, kind: np.frombuffer(getattr(row, prefix + c), kind)
    return read("ids", np.int64), read("bounds", np.int64), read("terms", np.int32), read("weights", np.int64)


class Postings:
    """The posting lists of one block of candidates."""

    def __init__(self, ids, bounds, terms, weights):
        self.ids, n = ids, len(ids)
        rows = np.repeat(np.arange(n), np.diff(bounds))
        order = np.argsort(terms, kind="stable")
        terms, rows, weights = terms[order], rows[order], weights[order]
        names, firsts = np.unique(terms, return_index=True)
        self.largest = int(np.abs(weights).max(initial=0))
        self.lists = {}
        for t, r, w in zip(names.tolist(), np.split(rows, firsts[1:]), np.split(weights, firsts[1:])):
            if 2 * len(r) >= n:
                dense = np.zeros(n, np.int64)
                dense[r] = w
                self.lists[t] = (None, dense)
            else:
                self.lists[t] = (r, w)

    def scores(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        bound = self.largest * int(np.abs(weights).max(initial=0)) * max(1, len(terms))
        kind = np.int32 if bound < 2**31 else np.int64 if bound < 2**62 else object
        out = np.zeros(len(self.ids), kind)
        for t, w in zip(terms.tolist(), weights.tolist()):
            rows, values = self.lists.get(t, (None, None))
            if values is None:
                continue
            if kind is object:
                values, w = values.astype(object), int(w)
            elif kind is np.int32:
                values, w = self._narrow(t, values), np.int32(w)
            if rows is None:
                out += values * w
            else:
                out[rows] += values * w
        return out.clip(-(2**63), 2**63 - 1).astype(np.int64) if kind is object else out

    def _narrow(self, t: int, values: np.ndarray) -> np.ndarray:
        if values.dtype != np.int32:
            values = values.astype(np.int32)
            self.lists[t] = (self.lists[t][0], values)
        return values


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, in order."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores > least)
        tied = np.flatnonzero(scores == least)
        need = k - len(at)
        if len(tied) > need:
            tied = tied[np.argpartition(ids[tied], need - 1)[:need]]
        at = np.concatenate([at, tied])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))]


def top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """query_id, rank (from 1), id, score: the k best candidates of every query, but never
    a row of its own id. Both sides as made by `sparse`."""
    spark = ready_for_text(queries.sparkSession)  # a block, like a text, may have megabytes
    q = materialized(_packed(queries, QUERY_BLOCK), "query-blocks")
    c = materialized(_packed(candidates, CANDIDATE_BLOCK), "candidate-blocks")
    # Blocks of candidates are dealt over shares, and every block of queries visits every
    # share: an equi-join in which each pair of blocks is one row of work. That each query
    # meets each candidate is the exhaustive search asked for.
    shares = max(1, min(c.count(), 4 * spark.sparkContext.defaultParallelism))
    c = c.select("*", F.pmod(F.xxhash64("block"), F.lit(shares)).alias("share"))
    q = q.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))).alias("share"))
    renamed = lambda d, p: d.select("share", *(F.col(x).alias(p + x) for x in d.columns if x != "share"))
    # Spark takes the copies of the query blocks for one of them: it would broadcast them by that size, from the driver.
    # Merged, they are dealt out by share, and a block of candidates meets all blocks of queries in a row.
    pairs = renamed(c, "c_").hint("merge").join(renamed(q, "q_"), "share")

    @tidy
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = postings = None
        for f in frames:
            for row in f.itertuples():
                if row.c_block != block:
                    block, postings = row.c_block, Postings(*_unpacked(row, "c_"))
                ids, bounds, terms, weights = _unpacked(row, "q_")
                out = []
                for i, own in enumerate(ids):
                    part = slice(bounds[i], bounds[i + 1])
                    s = postings.scores(terms[part], weights[part])
                    # rows of the query's own id go before the selection: there may be any number of them
                    rest = np.flatnonzero(postings.ids != own)
                    at = rest[best(s[rest], postings.ids[rest], k)] if len(rest) < len(s) else best(s, postings.ids, k)
                    out.append((np.full(len(at), own), postings.ids[at], s[at]))
                a, b, s = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
                yield pd.DataFrame({"query_id": a, "id": b, "score": s.astype(np.int64)})

    found = pairs.mapInPandas(run, "query_id long, id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "id", "score"
    )
