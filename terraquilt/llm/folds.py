"""Walks over groups of rows that lie together, in order, in a partition.

`grouped` brings a group's rows together and sorts them on disk if need be; `fold` streams over
them in Arrow batches and holds the state of one group, never its rows. What has to be read in order
to be known at all, such as a digest of a conversation, is read that way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from terraquilt.llm.common import ready

#: Rows that leave together.
FLUSH_ROWS = 4096


def grouped(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """df with the rows of equal keys (nulls equal each other) together, in `order`."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def fold(df: DataFrame, keys: int, make: Callable, schema: str) -> DataFrame:
    """Rows that `make(*key)` gives for each run of equal values in the first `keys` columns.
    Its `add(*lists)` takes the other columns of some more rows of the group, its `end()` comes
    last; both return an iterable of rows. Narrow: df's partitions and their order stay."""
    ready(df.sparkSession)
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            names = list(zip(*columns[:keys]))
            for own, places in groupby(range(len(names)), names.__getitem__):
                first = next(places)
                last = first + sum(1 for _ in places) + 1
                if state is None or own != key:
                    if state is not None:
                        out.extend(state.end())
                    key, state = own, make(*own)
                out.extend(state.add(*(c[first:last] for c in columns[keys:])))
                if len(out) >= FLUSH_ROWS:
                    yield packed(out)
                    out = []
        if state is not None:
            out.extend(state.end())
        yield packed(out)

    return df.mapInArrow(run, kind)


class Digest:
    """SHA-256 of a group's pieces of text, joined."""

    def __init__(self, *key, joiner: str = ""):
        self.key, self.hash, self.joiner, self.between = key, hashlib.sha256(), joiner.encode(), b""

    def add(self, pieces: list[str]) -> Iterable[tuple]:
        for piece in pieces:
            self.hash.update(self.between)
            self.hash.update(piece.encode())
            self.between = self.joiner
        return ()

    def end(self) -> Iterable[tuple]:
        return [(*self.key, self.hash.hexdigest())]


#: What a digest is where there is nothing to read.
EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()
