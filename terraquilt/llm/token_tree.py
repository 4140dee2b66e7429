"""Token counts under edits (operator 9).

The tokenizer cuts a text into pre-tokens and encodes each by itself, so a text's count is a
sum over pre-tokens. `build` keeps a segment tree per document: leaves of LEAF pre-tokens with their
characters and tokens, and sums above. `recount` applies edits (start, end, replacement
in code points) and encodes only from the start of the leaf before an edit, with CONTEXT
characters between, up to the first later leaf boundary at which the pre-tokens fall into step again; from
there on the text, and so every pre-token, is as before. Sums on the paths of the leaves are updated.

Why CONTEXT characters are enough: where a pre-token ends depends on the text up to two
characters after its end (the longest look-ahead is that of 'll, 've and 're), and never on what is
before its start.

Nulls: a null text is an empty one of 0 tokens. Texts are known by their hash, so rows of
equal or null doc_id are rows of their own and copies share their edits' work.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraquilt.llm.common import materialized, ready, spread_join, text_key

LEAF, CONTEXT = 64, 3
CACHE = 100_000


class Counter(dict):
    """Tokens of each pre-token. A full cache is emptied."""

    def __init__(self, ranks_path: str, pattern: str):
        super().__init__()
        self.pattern = regex.compile(pattern)
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        found = self[piece] = len(self.encode(piece))
        return found

    def leaves(self, text: str) -> tuple[list[int], list[int]]:
        """Characters and tokens of each leaf."""
        pieces = self.pattern.findall(text)
        groups = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)]
        return [sum(map(len, g)) for g in groups], [sum(map(self.__getitem__, g)) for g in groups]


class Tree:
    """Sums of (characters, tokens) over leaves; node i is above 2i and 2i + 1."""

    def __init__(self, chars: Sequence[int], tokens: Sequence[int]):
        self.count = max(1, len(chars))
        self.base = 1 << (self.count - 1).bit_length()
        self.sums = np.zeros((2 * self.base, 2), np.int64)
        self.sums[self.base : self.base + len(chars), 0] = chars
        self.sums[self.base : self.base + len(tokens), 1] = tokens
        for i in range(self.base - 1, 0, -1):
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and the character it starts at."""
        node, at = 1, 0
        while node < self.base:
            node *= 2
            if place - at >= self.sums[node, 0]:
                at += int(self.sums[node, 0])
                node += 1
        return node - self.base, at

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.base
        change = np.array([chars, tokens]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2

    def leaves(self) -> tuple[list[int], list[int]]:
        own = self.sums[self.base : self.base + self.count]
        return own[:, 0].tolist(), own[:, 1].tolist()


def edited(text: str, tree: Tree, counter: Counter, edit: tuple[int, int, str]) -> tuple[str, int]:
    """Apply one edit: the new text, and how many characters were encoded anew."""
    start, end, new = edit
    start = min(max(start, 0), len(text))
    end = min(max(end, start), len(text))
    changed = text[:start] + new + text[end:]
    shift = len(changed) - len(text)
    first, begin = tree.find(max(0, min(start - CONTEXT, len(text) - 1)))
    first = min(first, tree.count - 1)
    # Boundaries of the leaves from `first` on, as they stand in the new text
    last, stop = first, begin + int(tree.sums[tree.base + first, 0])
    at, found, ended = begin, [], []
    while True:
        while last + 1 < tree.count and (stop < end or stop + shift < at):
            last += 1
            stop += int(tree.sums[tree.base + last, 0])
        if stop >= end and stop + shift == at:
            break  # in step again
        if at == len(changed):
            last = tree.count - 1
            break
        piece = counter.pattern.match(changed, at).group()
        at += len(piece)
        found.append(counter[piece])
        ended.append(at)
    slots = last - first + 1
    each = -(-len(found) // slots) if found else 0
    for i in range(slots):  # what was encoded is dealt out over the leaves it replaces
        part = slice(i * each, (i + 1) * each)
        here = ended[part]
        before = ended[i * each - 1] if i and i * each <= len(ended) and each else begin
        tree.put(first + i, here[-1] - before if here else 0, sum(found[part]))
    return changed, at - begin


def build(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, text_id (the text's hash), chars and tokens of the leaves, n_tokens. Narrow."""
    ready(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter(ranks_path, pattern)
        for f in frames:
            found = [counter.leaves(t) for t in f["text"]]
            yield pd.DataFrame({
                "doc_id": f["doc_id"].astype("Int64"),
                "text_id": f["text_id"],
                "chars": [c for c, _ in found],
                "tokens": [t for _, t in found],
                "n_tokens": [sum(t) for _, t in found],
            })

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), text_key(text).alias("text_id"))
    return rows.mapInPandas(run, "doc_id long, text_id binary, chars array<int>, tokens array<int>, n_tokens long")


def recount(trees: DataFrame, texts: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Trees after edits: text_id, chars, tokens, n_tokens, encoded (characters encoded anew), n_edits.
    texts: text_id, text, edits (array of (start, end, new), not overlapping), a row per text."""
    ready(trees.sparkSession)
    known = trees.select("text_id", "chars", "tokens")
    known = known.join(texts.select("text_id"), "text_id", "left_semi")
    known = known.groupBy("text_id").agg(F.min(F.struct("chars", "tokens")).alias("tree"))
    joined = texts.join(known, "text_id").select("text_id", "text", "edits", "tree.chars", "tree.tokens")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter(ranks_path, pattern)
        for f in frames:
            out = []
            for text_id, text, edits, chars, tokens in f.itertuples(index=False):
                tree, encoded = Tree(chars, tokens), 0
                # from the last to the first, so that places stay right
                for e in sorted(edits, key=lambda e: -e["start"]):
                    text, n = edited(text, tree, counter, (e["start"], e["end"], e["new"]))
                    encoded += n
                out.append((text_id, *tree.leaves(), tree.tokens, encoded, len(edits)))
            yield pd.DataFrame(out, columns=["text_id", "chars", "tokens", "n_tokens", "encoded", "n_edits"])

    return joined.mapInPandas(
        run, "text_id binary, chars array<int>, tokens array<int>, n_tokens long, encoded long, n_edits int"
    )


def counts_under_edits(docs: DataFrame, edits: Column, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_after, encoded for every document. edits: an
    array of (start, end, new) worked out from `text`."""
    trees = materialized(build(docs, ranks_path, pattern), "token-trees")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    asked = docs.select(text.alias("text")).select("text", text_key(F.col("text")).alias("text_id"), edits.alias("edits"))
    asked = materialized(asked.where(F.size("edits") > 0), "edits").dropDuplicates(["text_id"])
    after = recount(trees, asked, ranks_path, pattern)
    after = materialized(after.select("text_id", F.col("n_tokens").alias("n_tokens_after"), "encoded", "n_edits"), "edited-trees")
    sizes = trees.join(after.select("text_id"), "text_id", "left_semi").groupBy("text_id").agg(F.count("*").alias("n"))
    rows = trees.select("doc_id", "text_id", "n_tokens")
    out = spread_join(rows, after, "text_id", sizes, F.xxhash64("doc_id"), "left")
    return out.select(
        "doc_id", "n_tokens",
        F.coalesce("n_edits", F.lit(0)).alias("n_edits"),
        F.coalesce("n_tokens_after", "n_tokens").alias("n_tokens_after"),
        F.coalesce("encoded", F.lit(0)).cast("long").alias("encoded"),
    )
