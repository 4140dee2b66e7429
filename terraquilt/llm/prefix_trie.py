"""Conversation prefix trie from sorted matrices of turn ids (operator 12).

A conversation is a sequence of 128-bit turn ids. Sequences are range-sharded, so a shard holds neighbours in
their order. In a shard the ids become a matrix, a row a conversation, padded with 0; it is sorted by numpy's lexsort
and the changes from row to row, OR-accumulated along the columns, mark where the nodes of each depth
start. `reduceat` over those starts then aggregates every depth: members, least member, weights; children
hand their sums up to the node above. Matrices are built in blocks of WIDTH columns, of the rows that are still
alike, so one long conversation doesn't widen the rest.

A node whose members span shards lies on the path of the first or the last row of each of them. Such
boundary nodes leave a shard with the prefix's hash and are recombined by it. Members, weights and least
member just add up. What counts distinct nodes below (children, leaves, words) was counted once too
often for each node on the path that two neighbouring shards share, which is found by a join
of the last path of one with the first path of the next, and taken away.

Rows with a null conv_id are not part of a conversation and take no part; null roles and texts are empty. Turns
are read by turn, nulls first, equal turns by the hash of role and text; repeated rows are turns of their own. An empty
table has no nodes. A conversation is one row of a shard (20 bytes a turn), so a task holds at least its longest one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraquilt.llm.common import materialized, ready, spread_join
from terraquilt.llm.folds import fold, grouped

#: Bytes of a turn id, and turns that a shard holds on average.
ID_BYTES, SHARD_TURNS = 16, 25_000
#: Columns of a matrix at a time.
WIDTH = 8
WORD = r"[^\x20\x09-\x0D]+"

# --- sequences ------------------------------------------------------------------------------------


class _Sequence:
    def __init__(self, conv_id):
        self.conv_id, self.ids, self.weights = conv_id, bytearray(), bytearray()

    def add(self, ids: list[bytes], weights: list[int]) -> Iterable[tuple]:
        self.ids += b"".join(ids)
        self.weights += np.array(weights, "<i4").tobytes()
        return ()

    def end(self) -> Iterable[tuple]:
        return [(self.conv_id, bytes(self.ids), bytes(self.weights))]


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, ids and weights (words of the text) of the turns of each conversation, in order, as
    bytes: ID_BYTES for an id, 4 for a weight."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    # The length in front tells ("a", "bc") from ("ab", "c").
    key = F.unhex(F.md5(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)).cast("binary")))
    rows = turns.where(F.col("conv_id").isNotNull())
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("id"), F.regexp_count(text, F.lit(WORD)).alias("weight"))
    rows = grouped(rows, ["conv_id"], [F.asc_nulls_first("turn"), "id"])
    return fold(rows.select("conv_id", "id", "weight"), 1, _Sequence, "conv_id long, ids binary, weights binary")


def turns_of(name: str, size: int, first: Column, count: Column | None = None) -> Column:
    """Turns from the one numbered `first` (from 0) on, `count` of them or all."""
    parts = [F.col(name), (first * size + 1).cast("int")]
    return F.substr(*parts, (count * size).cast("int")) if count is not None else F.substr(*parts)


# --- a shard --------------------------------------------------------------------------------------


class Shard:
    """The trie of some sequences, sorted: `order` gives their places."""

    def __init__(self, conv: np.ndarray, ids: list[bytes], weights: list[bytes]):
        flat = np.frombuffer(b"".join(ids), ">u8").astype(np.uint64).reshape(-1, 2)
        by = np.lexsort((flat[:, 1], flat[:, 0]))
        new = np.ones(len(by), bool)
        new[1:] = (flat[by[1:]] != flat[by[:-1]]).any(1)
        self.turn = np.empty(len(by), np.int64)
        self.turn[by] = np.cumsum(new)  # numbers from 1, in the order of the ids
        self.conv, self.weight = conv, np.frombuffer(b"".join(weights), "<i4").astype(np.int64)
        self.length = np.array([len(x) // ID_BYTES for x in ids], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.order = self._sorted()

    def matrix(self, rows: np.ndarray, at: int) -> np.ndarray:
        """Columns `at` to `at + WIDTH` of rows, 0 beyond their ends."""
        columns = at + np.arange(WIDTH)
        inside = columns < self.length[rows][:, None]
        places = np.where(inside, self.begin[rows][:, None] + columns, 0)
        return np.where(inside, self.turn[places], 0) if len(self.turn) else np.zeros(places.shape, np.int64)

    def _sorted(self) -> np.ndarray:
        """Rows by sequence, shorter ones first, then by conv_id. Rows that a block tells apart are done."""
        order = np.lexsort((self.conv,))
        group = np.zeros(len(order), np.int64)
        tied, at = np.arange(len(order)), 0
        while len(tied):
            matrix = self.matrix(order[tied], at)
            by = np.lexsort([*matrix.T[::-1], group[tied]])
            matrix, own = matrix[by], group[tied][by]
            order[tied] = order[tied][by]
            starts = np.ones(len(by), bool)
            starts[1:] = (own[1:] != own[:-1]) | (matrix[1:] != matrix[:-1]).any(1)
            first = np.flatnonzero(starts)
            group[tied] = tied[first][np.cumsum(starts) - 1]
            size = np.diff(np.append(first, len(by)))
            tied = tied[np.repeat(size > 1, size) & (matrix[:, -1] > 0)]
            at += WIDTH
        return order

    def shared(self) -> np.ndarray:
        """How many first turns each row has in common with the row before it."""
        found = np.zeros(len(self.order), np.int64)
        rows, at = np.arange(1, len(self.order)), 0
        while len(rows):
            own = self.matrix(self.order[rows], at)
            change = (own != self.matrix(self.order[rows - 1], at)) | (own == 0)
            change = np.logical_or.accumulate(change, axis=1)
            found[rows] += (~change).sum(1)
            rows = rows[~change[:, -1]]
            at += WIDTH
        return found

    def path(self, row: int, ids: bytes) -> list[tuple[bytes, int]]:
        """Hash of the prefix and words in it, for each depth of a row."""
        own = self.order[row]
        hashed, words, out = hashlib.md5(), 0, [(hashlib.md5().digest(), 0)]
        for d in range(self.length[own]):
            hashed.update(ids[d * ID_BYTES : (d + 1) * ID_BYTES])
            words += int(self.weight[self.begin[own] + d])
            out.append((hashed.copy().digest(), words))
        return out

    def levels(self) -> list[dict]:
        """The nodes of each depth, in the order of the rows: their first row and what is known from above."""
        conv, length = self.conv[self.order], self.length[self.order]
        shared, alive, nodes = self.shared(), np.arange(len(conv)), []
        for d in range(int(length.max()) + 1):
            alive = alive[length[alive] >= d]
            starts = np.flatnonzero(shared[alive] < d) if d else np.zeros(1, np.int64)
            first = alive[starts]
            here = {
                "depth": d, "alive": alive, "starts": starts, "first": first,
                "conv_id": np.minimum.reduceat(conv[alive], starts),
                "n_convs": np.diff(np.append(starts, len(alive))),
                "ends": length[first] == d,
                "on_first": first == 0,
                "on_last": np.append(starts[1:], len(alive)) == np.searchsorted(alive, len(conv) - 1) + 1,
            }
            here["on_last"] &= alive[-1] == len(conv) - 1
            if d:
                here["parent"] = np.searchsorted(nodes[-1]["first"], first, "right") - 1
            nodes.append(here)
        return nodes

    def sums(self, nodes: list[dict]) -> None:
        """Give each node what it adds up to with all below it."""
        length, begin = self.length[self.order], self.begin[self.order]
        weight, child = np.zeros(len(length), np.int64), None
        for here in reversed(nodes):
            d, alive, first = here["depth"], here["alive"], here["first"]
            if d:
                weight[alive] += self.weight[begin[alive] + d - 1]
            here["own"] = self.weight[begin[first] + d - 1] if d else np.zeros(1, np.int64)
            here["weight"] = np.add.reduceat(weight[alive], here["starts"])  # of all members' texts
            here["words"] = here["own"].copy()  # of distinct nodes' texts
            here["n_children"], here["n_leaves"] = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
            if child is not None:
                np.add.at(here["n_children"], child["parent"], 1)
                np.add.at(here["n_leaves"], child["parent"], child["n_leaves"])
                np.add.at(here["words"], child["parent"], child["words"])
            here["n_leaves"] += here["n_children"] == 0
            child = here


#: key: the prefix's hash, of boundary nodes alone; parent_key: the same of a node below one. The columns from shard
#: on tell how the paths of neighbouring shards meet.
NODE = (
    "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, weight long, words long, "
    "end_key binary, key binary, parent_key binary, shard int, on_first boolean, on_last boolean, words_to long, own long, length int"
)


def _shard_nodes(conv: np.ndarray, ids: list[bytes], weights: list[bytes], number: int) -> Iterator[pa.RecordBatch]:
    shard = Shard(conv, ids, weights)
    paths = [shard.path(row, ids[shard.order[row]]) for row in (0, len(conv) - 1)]
    nodes = shard.levels()
    shard.sums(nodes)
    above = None
    for here in nodes:
        d, n = here["depth"], len(here["first"])
        key, words_to = np.full(n, None, object), np.full(n, None, object)
        for path, name in zip(paths, ("on_first", "on_last")):
            for i in np.flatnonzero(here[name]):  # one node at most
                key[i], words_to[i] = path[d]
        end_key = np.full(n, None, object)
        for i in np.flatnonzero(here["ends"]):
            end_key[i] = hashlib.md5(ids[shard.order[here["first"][i]]]).digest()
        here["key"] = key
        parent = here.get("parent")
        parents = pa.nulls(n, pa.int64()) if above is None else pa.array(above["conv_id"][parent])
        parent_key = [None] * n if above is None else above["key"][parent].tolist()
        numbers = [pa.array(here[c]) for c in ("n_convs", "n_children", "n_leaves", "weight", "words")]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(here["conv_id"]), pa.array(np.full(n, d, np.int32)), parents, *numbers,
                pa.array(end_key.tolist(), pa.binary()), pa.array(key.tolist(), pa.binary()), pa.array(parent_key, pa.binary()),
                pa.array(np.full(n, number, np.int32)), pa.array(here["on_first"]), pa.array(here["on_last"]),
                pa.array(words_to.tolist(), pa.int64()), pa.array(here["own"]),
                pa.array(np.full(n, len(paths[1]) - 1, np.int32)),
            ],
            names=[c.split()[0] for c in NODE.split(", ")],
        )
        above = here


# --- all shards -----------------------------------------------------------------------------------


def _overlaps(edge: DataFrame) -> DataFrame:
    """What the path that a shard's first row shares with the last row of the shard before it counts twice."""
    # As many rows as shards.
    shards = edge.where("depth = 0").select("shard").withColumn("before", F.lag("shard").over(Window.orderBy("shard")))
    lasts = edge.where("on_last").select(F.col("shard").alias("before"), "key", "length")
    firsts = edge.where("on_first").select("shard", "key", "depth", "words_to", "own")
    met = firsts.join(shards.where("before IS NOT NULL"), "shard").join(lasts, ["before", "key"])
    met = materialized(met, "trie-overlaps")
    deepest = met.groupBy("shard").agg(F.max("depth").alias("deep"), F.max("words_to").alias("deep_words"))
    zero = F.lit(0).cast("long")
    return met.join(deepest, "shard").select(
        "key", "depth", F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("binary").alias("parent_key"),
        F.lit(None).cast("binary").alias("end_key"), zero.alias("n_convs"),
        F.when(F.col("depth") < F.col("deep"), -1).otherwise(0).cast("long").alias("n_children"),
        # The row before ended on the shared path: its end was a leaf there, and is counted here again or has children here.
        F.when(F.col("length") == F.col("deep"), -1).otherwise(0).cast("long").alias("n_leaves"),
        zero.alias("weight"),
        (F.col("words_to") - F.col("own") - F.col("deep_words")).alias("words"),
    )


def trie(rows: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of sequences (conv_id, ids, weights): conv_id (the least member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, weight (of all members from here on), words (of the distinct nodes
    from here on) and end_key, the hash of the sequence where some end here, else null."""
    ready(rows.sparkSession)
    rows = materialized(rows.select("conv_id", "ids", "weights"), "sequences")
    turns = rows.agg(F.sum(F.length("ids"))).first()[0]
    shards = max(1, -(-(turns or 0) // (ID_BYTES * shard_turns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if own is not None:
            conv = own.column("conv_id").to_numpy()
            yield from _shard_nodes(conv, own.column("ids").to_pylist(), own.column("weights").to_pylist(), TaskContext.get().partitionId())

    # conv_id cuts copies of one sequence into shards, too.
    nodes = materialized(rows.repartitionByRange(shards, "ids", "conv_id").mapInArrow(run, NODE), "trie-nodes")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "weight", "words", "end_key"]
    inner, edge = nodes.where("key IS NULL"), nodes.where("key IS NOT NULL")
    sums = ["n_convs", "n_children", "n_leaves", "weight", "words"]
    columns = ["key", "depth", "conv_id", "parent_key", "end_key", *sums]
    edge = edge.select(*columns).union(_overlaps(edge).select(*columns))
    edge = edge.groupBy("key", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.max("parent_key").alias("parent_key"), F.max("end_key").alias("end_key"),
        *(F.sum(c).alias(c) for c in sums),
    )
    edge = materialized(edge, "trie-edge")
    above = edge.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    below = inner.where("parent_key IS NOT NULL").drop("parent_conv_id")
    sizes = edge.select(F.col("key").alias("parent_key"), F.col("n_children").alias("n"))
    below = spread_join(below, above, "parent_key", sizes, F.xxhash64("conv_id"))
    edge = edge.join(above, "parent_key", "left")
    return inner.where("parent_key IS NULL").select(*out).union(below.select(*out)).union(edge.select(*out))


def ends(rows: DataFrame) -> DataFrame:
    """end_key and conv_id: at which node each sequence ends."""
    return rows.select(F.unhex(F.md5("ids")).alias("end_key"), "conv_id")


def graft(rows: DataFrame, block: int = 20, choices: int = 4) -> DataFrame:
    """Sequences that share beginnings: each takes the first h turns of the sequence conv_id - conv_id % block
    (all if fewer, none if absent) in place of its own, h = crc32(conv_id) % choices."""
    heads = rows.where(F.col("conv_id") % block == 0).select(
        F.col("conv_id").alias("base"),
        *(turns_of(c, n, F.lit(0), F.lit(choices - 1)).alias(f"head_{c}") for c, n in (("ids", ID_BYTES), ("weights", 4))),
    )
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % choices
    own = rows.withColumn("base", F.col("conv_id") - F.col("conv_id") % block).withColumn("h", h)
    both = own.join(heads, "base", "left")
    return both.select("conv_id", *(
        F.concat(F.coalesce(turns_of(f"head_{c}", n, F.lit(0), F.col("h")), F.lit(b"")), turns_of(c, n, F.col("h"))).alias(c)
        for c, n in (("ids", ID_BYTES), ("weights", 4))
    ))
