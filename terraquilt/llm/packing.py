"""Best-fit packing of token sequences (operator 7).

Lengths are whole numbers up to the capacity, so the whole corpus reduces to how many
pieces there are of each length: at most `capacity` numbers, whatever its size. The
packing is worked out on those counts and then dealt out to the pieces.

1. Tokenise. Only documents longer than the capacity are cut; full pieces are
   sequences by themselves.
2. Dominance reduction (Martello and Toth): the longest open length together with a set
   of at most two others is fixed for good where no other packing of it can be better:
   nothing fits beside it; a partner fills it to the brim; only one more fits
   and the longest that fits is taken; or no three more fit and that partner is as long as any two.
   Each step fixes as many bins at once as the counts allow. Martello and Toth also fix the longest
   with the best pair beside it where no triple beats that; this case isn't built: where a
   pair or a triple may be better, the reduction ends and best fit takes the rest.
3. What is left goes, longest first, into the open bin with the least room that
   still takes it (best fit), again many equal bins at a time.
4. Pieces of a length are numbered and looked up in the plan.

Numbering salts by bucket: a length that a third of all pieces share is numbered in
many buckets at once, shifted by the counts of the buckets before.

The plan has a bound: with every length a bin takes, its room at least halves, and each
length opens or splits at most four kinds of bins, so there are at most
4 * capacity * log2(capacity) entries (about 90,000 at 2,048).

Nulls: a null text is an empty one, which is the end id alone. Rows with equal or null
doc_id are packed as rows of their own, and their pieces come next to each other only
by chance; pieces are told apart by a row number within equal (doc_id, piece).
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terraquilt.llm.common import materialized, ready_for_text, tidy

CAPACITY, END_ID = 2048, 0
#: Cached words of a worker; a full cache is emptied.
CACHE_WORDS = 100_000
#: Pieces of one length and bucket that are numbered in one task.
BUCKET_ROWS = 100_000


class Parts(dict):
    """Ids of each pre-token below U+0100, in lower case, as bytes."""

    def __init__(self, model):
        super().__init__()
        alphabet = _byte_letters()
        self.letters = {c: "".join(alphabet[b] for b in chr(c).encode()) for c in range(128, 256)}
        self.tokenize = model.tokenize

    def __missing__(self, part: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        spelled = part if part.isascii() else part.translate(self.letters)
        found = self[part] = array("I", [t.id for t in self.tokenize(spelled)]).tobytes()
        return found


class Words(dict):
    """Ids of each run of text between white space, as bytes. Encoding such runs one by
    one equals encoding the text: the tokenizer drops white space and no token spans it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        setting = json.loads(self.tokenizer.to_str())
        self.split = regex.compile(setting["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.parts = Parts(self.tokenizer.model)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        parts, low = self.parts, word.lower()
        if low.isascii() or (max(word) < "Ā" and max(low) < "Ā"):
            # Here composing changes nothing and lower case is letter by letter.
            if low.isalpha():
                found = parts[low]
            elif low[-1] in ".,;:!?" and low[:-1].isalpha():
                found = parts[low[:-1]] + parts[low[-1]]
            elif "<|" in low:
                found = self._whole(word)
            else:
                found = b"".join([parts[p] for p in self.split(low)])
        else:
            found = self._whole(word)
        self[word] = found
        return found

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if _SEPARATORS.search(text):  # str.split() alone takes these as white space
            return self._whole(text)
        return b"".join(map(self.__getitem__, text.split()))


_SEPARATORS = re.compile("[\x1c-\x1f]")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


def tokenize(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece. Narrow."""
    ready_for_text(docs.sparkSession)

    @tidy
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(tokenizer_path)
        end = array("I", [END_ID]).tobytes()
        for f in frames:
            rows = []
            for doc_id, text in zip(f["doc_id"], f["text"]):
                ids = words.encode(text or "") + end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, i, at // 4, len(part) // 4, zlib.crc32(part)))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


# --- the plan, on counts -------------------------------------------------------------------


@dataclass
class Plan:
    """slots: for each length its runs (first rank, sequences from, pieces per sequence,
    offset), by rank; sequences: how many there are."""

    slots: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)
    sequences: int = 0


@dataclass
class _Bins:
    """`count` equal bins: (length, how many) in order, and the room left."""

    room: int
    count: int
    inside: list[tuple[int, int]]


def plan(counts: dict[int, int], capacity: int = CAPACITY, reduce: bool = True) -> Plan:
    left = {int(n): int(c) for n, c in counts.items() if c > 0}
    fixed, left = _reduced(left, capacity) if reduce else ([], left)
    return _dealt(fixed + _best_fit(left, capacity))


def _reduced(left: dict[int, int], capacity: int) -> tuple[list[_Bins], dict[int, int]]:
    """Bins that are fixed for good, and the counts that remain. What fits beside a length
    is sought among all open lengths, also larger ones that stayed undecided."""
    fixed, left = [], dict(left)
    for j in sorted(left, reverse=True):
        while left[j]:
            room = capacity - j
            fits = sorted(k for k, c in left.items() if k <= room and c > (k == j))
            if not fits:
                inside, times = [(j, 1)], left[j]
            else:
                k = fits[-1]
                few = [n for n in fits[:3] for _ in range(min(3, left[n] - (n == j)))][:3]
                pairs, triples = len(few) > 1 and sum(few[:2]) <= room, len(few) > 2 and sum(few) <= room
                if not (k == room or not pairs or (not triples and k >= _best_pair(fits, left, j, room))):
                    break  # undecided: for best fit
                inside = [(j, 2)] if k == j else [(j, 1), (k, 1)]
                times = left[j] // 2 if k == j else min(left[j], left[k])
            for n, c in inside:
                left[n] -= c * times
            fixed.append(_Bins(capacity - sum(n * c for n, c in inside), times, inside))
    return fixed, {n: c for n, c in left.items() if c}


def _best_pair(fits: list[int], left: dict[int, int], j: int, room: int) -> int:
    """The largest sum of two open lengths up to the room."""
    low, high, best = 0, len(fits) - 1, 0
    while low <= high:
        a, b = fits[low], fits[high]
        twice = left[a] - (a == j) > 1
        if a + b > room:
            high -= 1
        elif low == high:
            return max(best, 2 * a) if twice else best
        else:
            best = max(best, a + b, 2 * a if twice and 2 * a <= room else 0)
            low += 1
    return best


def _best_fit(left: dict[int, int], capacity: int) -> list[_Bins]:
    by_room: dict[int, list[_Bins]] = {}
    full: list[_Bins] = []

    def put(b: _Bins) -> None:
        (by_room.setdefault(b.room, []) if b.room else full).append(b)

    for n in sorted(left, reverse=True):
        c = left[n]
        for room in sorted(r for r in by_room if r >= n):
            stack = by_room[room]
            while stack and c:
                b, each = stack.pop(), room // n
                whole = min(b.count, c // each)
                if b.count > whole:
                    rest, some = b.count - whole, c - whole * each if c - whole * each < each else 0
                    if some:
                        put(_Bins(room - some * n, 1, [*b.inside, (n, some)]))
                        c -= some
                        rest -= 1
                    if rest:
                        stack.append(_Bins(room, rest, b.inside))
                if whole:
                    put(_Bins(room - each * n, whole, [*b.inside, (n, each)]))
                    c -= whole * each
                if b.count > whole:
                    break
            if not stack:
                by_room.pop(room, None)
            if not c:
                break
        each = capacity // n
        if c // each:
            put(_Bins(capacity - each * n, c // each, [(n, each)]))
        if c % each:
            put(_Bins(capacity - c % each * n, 1, [(n, c % each)]))
    return full + [b for stack in by_room.values() for b in stack]


def _dealt(bins: list[_Bins]) -> Plan:
    out, used = Plan(), {}
    for b in bins:
        offset = 0
        for n, each in b.inside:
            rank = used.get(n, 0)
            out.slots.setdefault(n, []).append((rank, out.sequences, each, offset))
            used[n] = rank + each * b.count
            offset += n * each
        out.sequences += b.count
    return out


# --- on Spark ---------------------------------------------------------------------------------


def numbered(pieces: DataFrame) -> DataFrame:
    """pieces with `rank`, from 0 among those of equal length."""
    total = pieces.count()
    buckets = max(1, -(-total // BUCKET_ROWS))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    shift = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    own = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("own", F.row_number().over(own) - 1)
    # one row per (length, bucket): the join is on what the window has dealt by already
    return ranked.join(shift, ["length", "bucket"]).withColumn("rank", F.col("own") + F.col("shift")).drop(
        "own", "shift", "bucket"
    )


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialized(tokenize(docs, tokenizer_path, capacity), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    made = plan(counts, capacity)
    bound = pieces.sparkSession.sparkContext.broadcast(
        {n: tuple(np.array(x, np.int64) for x in zip(*runs)) for n, runs in made.slots.items()}
    )

    @tidy
    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots = bound.value
        for f in frames:
            length, rank = f["length"].to_numpy(), f["rank"].to_numpy()
            sequence, offset = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                first, begin, each, where = slots[int(n)]
                run = np.searchsorted(first, rank[at], "right") - 1
                k = rank[at] - first[run]
                sequence[at] = begin[run] + k // each[run]
                offset[at] = where[run] + k % each[run] * n
            yield f.assign(sequence_id=sequence, offset=offset).drop(columns="rank")

    columns = "doc_id long, piece int, start long, length long, ids_crc32 long"
    ranked = numbered(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInPandas(place, f"{columns}, sequence_id long, offset long")
