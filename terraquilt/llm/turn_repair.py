"""Conversation structure repair by a suffix-shared word graph (operator 11).

A conversation's turns become a signature, one letter a turn that names its role and its first fault.
Signatures are sorted from their ends, so that those that share a suffix lie together, and the graph is
walked in that order: a node stands for a suffix, and all conversations that end with it share the node.
At a node, the cheapest edits of the suffix are found once for each state of the grammar
`(s?(ua)+)?`, from the values of the node one turn later. A shard of the range-sorted signatures keeps
one path of nodes, as long as its longest signature, so the graph is never held as a whole, and only
the path at a shard's edge is computed again in the next.

Faults, the first of which counts: blank (no character but white space), duplicate (role and text seen
earlier in the conversation), truncated (the last character that isn't white space is not one of .!?).
Edits: Keep (0), Rerole to user or assistant (2), Delete (3; blank and duplicate turns must go), Insert an
empty turn of user or assistant (2). A truncated turn that stays adds 1. Of equally cheap edits the
least by their initials is taken.

Turns are read by turn, nulls first; equal turns by role, then by the MD5 of their text. Null roles and texts are empty ones, a
null conv_id is a conversation like any other. Rows that repeat are duplicates. Signatures are made from
range shards, so one conversation may span many tasks; only its repaired text is written by one task, which streams it.
"""

from __future__ import annotations

import os.path
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraquilt.llm.common import materialized, ready, text_key
from terraquilt.llm.folds import fold, grouped

VISIBLE = r"[^\x20\x09-\x0D]"
FINISHED = r"[.!?][\x20\x09-\x0D]*\z"
#: Letters of a signature: roles s, u, a and others, as they are, truncated, blank and duplicate.
SOUND, CUT, BLANK, REPEAT = "suao", "SUAO", "0123", "4567"
ROLES = str.maketrans(CUT + BLANK + REPEAT, SOUND * 3)

# --- the graph ------------------------------------------------------------------------------------

#: Grammar states: nothing yet, after s, after u, after a. State -> (state after an inserted turn, its role).
INSERTED = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
#: (state, role letter) -> state.
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
INSERT, REROLE, DELETE, UNFINISHED = 2, 2, 3, 1
#: A node: for each state the cost to go, the edits up to and with this turn's, and the state after them.
END = ((0, "", 0), (4, "II", 3), (2, "I", 3), (0, "", 3))


def node(letter: str, later: tuple) -> tuple:
    """The node of a turn before the suffix `later`. Edits of a turn are some inserts and one other
    letter, so no such text begins another one and the least whole audit has the least text here."""
    own = []
    for state in range(4):
        found = [(DELETE + later[state][0], "D", state)]
        if letter not in BLANK + REPEAT:
            extra = UNFINISHED * (letter in CUT)
            kept = KEPT.get((state, letter.lower()))
            if kept is not None:
                found.append((extra + later[kept][0], "K", kept))
            to = INSERTED[state][0]
            found.append((REROLE + extra + later[to][0], "R", to))
        own.append(min(found))
    best = []
    for state in range(4):
        found, at = [], state
        for inserts in range(3):  # a third one comes back to a state already tried
            cost, edit, to = own[at]
            found.append((INSERT * inserts + cost, "I" * inserts + edit, to))
            at = INSERTED[at][0]
        best.append(min(found))
    return tuple(best)


class SuffixGraph:
    """The path of nodes of the last signature; the next one keeps what of it they share."""

    def __init__(self):
        self.word, self.nodes, self.found = "", [END], (0, "")

    def solve(self, word: str) -> tuple[int, str]:
        """Cost and audit of a signature, given backwards."""
        if word != self.word:
            shared = len(os.path.commonprefix([word, self.word]))
            del self.nodes[shared + 1 :]
            for letter in word[shared:]:
                self.nodes.append(node(letter, self.nodes[-1]))
            edits, state = [], 0
            for values in reversed(self.nodes):
                _, edit, state = values[state]
                edits.append(edit)
            self.word, self.found = word, (self.nodes[-1][0][0], "".join(edits))
        return self.found


# --- signatures -----------------------------------------------------------------------------------


def _plain(turns: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))


def letters(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, key (of the text), rank (among equal turns of a conversation) and letter."""
    text, key = F.col("text"), text_key(F.col("text"))
    fault = F.when(~text.rlike(VISIBLE), 2).when(~text.rlike(FINISHED), 1).otherwise(0)
    rows = _plain(turns).select("conv_id", "turn", "role", key.alias("key"), fault.alias("fault"))
    equal = Window.partitionBy("conv_id", "role", "key").orderBy(F.asc_nulls_first("turn"))
    rows = rows.withColumn("rank", F.row_number().over(equal))
    # A fault's place in SOUND + CUT + BLANK + REPEAT; blank comes before duplicate.
    fault = F.when((F.col("rank") > 1) & (F.col("fault") < 2), 3).otherwise(F.col("fault"))
    initial = F.substring("role", 1, 1)
    known = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    letter = F.substring(F.lit(SOUND + CUT + BLANK + REPEAT), fault * 4 + known + 1, F.lit(1))
    return rows.select("conv_id", "turn", "role", "key", "rank", letter.alias("letter"))


class _Piece:
    """A shard's part of a conversation: its letters, its distinct turns, the first and the last one."""

    def __init__(self, conv_id):
        self.conv_id, self.letters, self.turns, self.first, self.last = conv_id, [], 0, None, None

    def add(self, turns: list, letters: list[str]) -> Iterable[tuple]:
        self.letters.extend(letters)
        for turn in turns:
            if turn is not None and turn != self.last:
                self.turns += 1
                self.first = turn if self.first is None else self.first
                self.last = turn
        return ()

    def end(self) -> Iterable[tuple]:
        shard = TaskContext.get().partitionId()
        return [(self.conv_id, shard, "".join(self.letters), self.turns, self.first, self.last)]


def signatures(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """conv_id, signature and gaps (turn numbers left out between the least and the greatest) of
    each conversation; those of `ids` without turns have an empty signature and no gaps."""
    kind = dict(turns.dtypes)["conv_id"]
    rows = materialized(letters(turns), "turn-letters")
    order = [F.asc_nulls_first("turn"), "role", "key", "rank"]
    rows = rows.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order)
    pieces = fold(
        rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "letter"), 1, _Piece,
        f"conv_id {kind}, shard int, letters string, turns long, first long, last long",
    )
    if ids is not None:
        nothing = [F.lit(-1), F.lit(""), F.lit(0).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("long")]
        pieces = pieces.union(ids.select("conv_id").distinct().select("conv_id", *nothing))
    # As many pieces as a conversation has shards.
    listed = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("shard", "letters", "turns", "first", "last"))).alias("p"))
    # A turn at a shard's edge counts in both pieces.
    numbers = F.aggregate(
        "p",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("last")),
        lambda a, x: F.struct(
            (a["n"] + x["turns"] - F.when(a["last"] == x["first"], 1).otherwise(0)).alias("n"),
            F.coalesce(x["last"], a["last"]).alias("last"),
        ),
        lambda a: a["n"],
    )
    spread = F.array_max(F.col("p.last")) - F.array_min(F.col("p.first")) + 1
    return listed.select(
        "conv_id",
        F.array_join("p.letters", "").alias("signature"),
        F.coalesce(spread - numbers, F.lit(0)).cast("long").alias("gaps"),
    )


def _many(letters: str) -> Column:
    kept = F.translate("signature", letters, "")
    return (F.length("signature") - F.length(kept)).cast("long")


def audits(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal (neighbours whose initials aren't su, ua or
    au), cost and audit of each conversation."""
    kind = dict(turns.dtypes)["conv_id"]
    found = materialized(signatures(turns, ids).withColumn("backwards", F.reverse("signature")), "signatures")
    ready(turns.sparkSession)
    schema = pa.schema([("cost", pa.int64()), ("audit", pa.string())])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = SuffixGraph()
        for batch in batches:
            solved = [graph.solve(w) for w in batch.column("backwards").to_pylist()]
            columns = [pa.array(c, t) for c, t in zip(zip(*solved) if solved else ((), ()), schema.types)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *columns], names=["conv_id", "signature", "gaps", "cost", "audit"]
            )

    # Equal signatures are dealt by conv_id, too, so a frequent one is no one task's burden.
    shards = found.repartitionByRange("backwards", "conv_id").sortWithinPartitions("backwards")
    solved = shards.mapInArrow(solve, f"conv_id {kind}, signature string, gaps long, cost long, audit string")
    roles = F.translate("signature", CUT + BLANK + REPEAT, SOUND * 3)
    pairs = F.greatest(F.length("signature") - 1, F.lit(0))
    legal = F.regexp_count(roles, F.lit("(?=su|ua|au)"))
    return solved.select(
        "conv_id", "gaps", _many(BLANK).alias("blank"), _many(REPEAT).alias("duplicate"), _many(CUT).alias("truncated"),
        (pairs - legal).cast("long").alias("illegal"), "cost", "audit",
    )


# --- the repaired turns ---------------------------------------------------------------------------


class _Repair:
    """Carries out a conversation's audit, which comes before its rows, on them."""

    def __init__(self, conv_id):
        self.conv_id, self.edits, self.state, self.place = conv_id, iter(""), 0, 0

    def _row(self, edit: str, turn, role: str, text: str) -> tuple:
        self.place += 1
        return self.conv_id, self.place - 1, edit, turn, role, text

    def _inserts(self) -> Iterator[tuple]:
        """Rows inserted here; the edit that ends them stays in `self.edit`."""
        self.edit = next(self.edits, "")
        while self.edit == "I":
            self.state, role = INSERTED[self.state]
            yield self._row("I", None, role, "")
            self.edit = next(self.edits, "")

    def add(self, turns: list, roles: list, texts: list, audits: list) -> Iterable[tuple]:
        out = []
        for turn, role, text, audit in zip(turns, roles, texts, audits):
            if audit is not None:
                self.edits = iter(audit)
                continue
            out.extend(self._inserts())
            if self.edit == "K":
                self.state = KEPT[self.state, role[:1]]
            elif self.edit == "R":
                self.state, role = INSERTED[self.state]
            if self.edit != "D":
                out.append(self._row(self.edit, turn, role, text))
        return out

    def end(self) -> Iterable[tuple]:
        return list(self._inserts())


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place, edit, turn, role and text of the turns that `found` (audits of `turns`) leaves,
    together and in order by conversation. A task streams a conversation, after its audit."""
    kind = dict(turns.dtypes)["conv_id"]
    rows = _plain(turns)
    rows = rows.withColumn("turn", F.col("turn").cast("long")).withColumn("audit", F.lit(None).cast("string"))
    key = F.when(F.col("audit").isNull(), text_key(F.col("text")))
    none = F.lit(None).cast("string")
    heads = found.select("conv_id", F.lit(None).cast("long").alias("turn"), none.alias("role"), none.alias("text"), "audit")
    both = rows.union(heads).withColumn("key", key).withColumn("below", F.col("audit").isNull())
    both = grouped(both, ["conv_id"], ["below", F.asc_nulls_first("turn"), "role", "key"])
    return fold(
        both.select("conv_id", "turn", "role", "text", "audit"), 1, _Repair,
        f"conv_id {kind}, place long, edit string, turn long, role string, text string",
    )


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with planted faults: by crc32(conv_id:turn) % 20, 0 drops a row, 1 empties its text, 2 takes
    its .!? away, 3 repeats it, 4 says that its role is user. Nulls are read as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    rows = conversations.where(kind != 0).select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(space("role")).alias("role"),
        text.alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")
