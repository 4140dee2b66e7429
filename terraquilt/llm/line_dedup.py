"""Line dedup by a segment-partition edit join (operator 2). DataFrame functions only.

Lines are what lies between line feeds. Two lines of MIN_CHARS characters or more are the
same if at most `edits` insertions, deletions and substitutions lead from one to the
other. On shorter lines 2 edits mean little: with `short`, as the registered query and the pipeline
ask, they are the same only if they are equal; without it they take no part. Lines of white space
alone that are shorter than MIN_CHARS never do.

1. Equal lines are one text, known by a 128-bit hash and by its first occurrence (least
   doc_id, then line number).
2. A text of length n is split into edits + 1 segments. Any text within `edits` of it holds
   one of them unchanged, at a place that the two lengths and the segment's number bound
   (multi-match-aware selection: 5, 4 and 3 substrings for 2 edits and lengths that differ
   by 0, 1 and 2). Segments are listed under (length, number, segment); every text probes the
   lists of its own length and of those up to `edits` shorter.
3. Candidates are verified, without their common beginning and end, by a banded bit-parallel edit
   distance: per number of edits one
   word of bits, a bit per diagonal of the band, updated for all diagonals at once by
   shifts and logical operations.

Segments that many texts share are dealt over shares: the list of a hot segment is split and its
probes visit each part, so that no task takes it whole.

Nulls: a null text is an empty one. Rows without doc_id count as following all others. Rows of
equal doc_id are told apart by a hash of their text, and equal rows have equal lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraquilt.llm.common import BROADCAST_KEYS, materialized, spread_join, unused

EDITS, MIN_CHARS = 2, 20
#: Listed texts of one segment that one task compares with its probes.
LIST_ROWS = 2_000
#: Hashes of 8 or 16 bytes that are broadcast; more of them are joined by shuffle.
BROADCAST_IDS = 500_000
#: Sixteen letters whose counts tell most texts apart; any would do.
LETTERS = "etan iorsldhcum."
#: Characters after which most candidates that share just a segment have failed.
START = 24


def lines(docs: DataFrame, short: bool = False) -> DataFrame:
    """doc_id, row_key, line_no (from 0), line, and h1, h2 (its hash) of every line long enough; with `short`
    also of every other line that isn't blank."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row_key"), text.alias("text"))
    out = keyed.select("doc_id", "row_key", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    enough = F.length("line") >= MIN_CHARS
    out = out.where(enough | F.col("line").rlike(r"\S") if short else enough)
    return out.select("*", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def first_occurrences(found: DataFrame) -> DataFrame:
    """h1, h2, at (doc_id, row_key, line_no of the first occurrence), n, n_chars for each distinct line."""
    at = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), "row_key", "line_no")
    return found.groupBy("h1", "h2").agg(F.min(at).alias("at"), F.count("*").alias("n"), F.max(F.length("line")).alias("n_chars"))


def letters(line: Column) -> Column:
    """How often each of LETTERS occurs, modulo 16, four bits of a long each."""
    out, rest = F.lit(0).cast("long"), line
    for i, letter in enumerate(LETTERS):
        # Each is looked for in what the letters before it leave; they are of one byte, and bytes needn't be counted.
        before, rest = rest, F.replace(rest, F.lit(letter), F.lit(""))
        count = F.octet_length(before) - F.octet_length(rest)
        out = out.bitwiseOR(F.shiftleft((count % 16).cast("long"), 4 * i))
    return out


def letters_near(a: Column, b: Column, edits: int = EDITS) -> Column:
    """False only for texts more than `edits` apart: an edit moves two counts by 1 at most."""
    total, low = F.lit(0).cast("long"), F.lit(15)
    for i in range(len(LETTERS)):
        d = F.shiftright(a, 4 * i).bitwiseAND(low) - F.shiftright(b, 4 * i).bitwiseAND(low)
        total = total + F.least(d.bitwiseAND(low), (-d).bitwiseAND(low))
    return total <= 2 * edits


def _segment(texts: DataFrame, places: list[tuple[int, int, int]], edits: int) -> DataFrame:
    """key, h1, letters: one row per text and place (less, i, shift): the hash of (length - less, i, the text's
    substring where a text shorter by `less` has its segment i, moved by `shift`)."""
    parts = edits + 1
    rows = texts.select("h1", "line", F.length("line").alias("n"), "letters")
    named = [F.struct(F.lit(x).alias("less"), F.lit(i).alias("i"), F.lit(y).alias("shift")) for x, i, y in places]
    rows = rows.select("h1", "line", "n", "letters", F.explode(F.array(*named)).alias("p"))
    rows = rows.select("h1", "line", "n", "letters", "p.i", "p.shift", (F.col("n") - F.col("p.less")).alias("length"))
    rows = rows.withColumn("size", F.expr(f"int(length div {parts})"))  # even; the last ones take the remainder
    longer = F.col("i") - parts + F.col("length") % parts
    rows = rows.withColumn("at", F.col("i") * F.col("size") + F.greatest(longer, F.lit(0)) + F.col("shift"))
    rows = rows.withColumn("size", F.col("size") + F.when(longer >= 0, 1).otherwise(0))
    inside = (F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.col("n")) & (F.col("length") >= MIN_CHARS)
    key = F.xxhash64("length", "i", F.expr("substring(line, at + 1, size)"))
    return rows.where(inside).select(key.alias("key"), "h1", "letters")


def listed(texts: DataFrame, edits: int = EDITS) -> DataFrame:
    """Keys under which each text is listed."""
    return _segment(texts, [(0, i, 0) for i in range(edits + 1)], edits)


def probes(texts: DataFrame, edits: int = EDITS) -> DataFrame:
    """Keys that each text looks up: those of lists of its own length and up to `edits` less."""
    places = [
        (less, i, shift)
        for less in range(edits + 1)
        for i in range(edits + 1)
        for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1)
    ]
    return _segment(texts, places, edits)


def trimmed(a: Column, b: Column) -> tuple[Column, Column]:
    """The two texts without what they begin and end with in common. An edit distance is that
    of the rest."""
    steps = F.array(*(F.lit(1 << k) for k in range(20, -1, -1)))

    def common(x: Column, y: Column, most: Column) -> Column:
        def step(n: Column, by: Column) -> Column:
            same = F.call_function("substring", x, n + 1, by) == F.call_function("substring", y, n + 1, by)
            return F.when((n + by <= most) & same, n + by).otherwise(n)

        return F.aggregate(steps, F.lit(0), step)

    def once(value: Column, use) -> Column:
        """use(value), with the value worked out once rather than at each mention."""
        return F.element_at(F.transform(F.array(value), use), 1)

    least = F.least(F.length(a), F.length(b))

    def rest(x: Column) -> Column:
        def cut(ends: Column) -> Column:
            return F.call_function("substring", x, ends["head"] + 1, F.length(x) - ends["head"] - ends["tail"])

        def tail(head: Column) -> Column:
            back = common(F.reverse(a), F.reverse(b), least - head)
            return once(F.struct(head.alias("head"), back.alias("tail")), cut)

        return once(common(a, b, least), tail)

    return rest(a), rest(b)


def within(a: Column, b: Column, edits: int = EDITS, begin: int | None = None) -> Column:
    """Whether at most `edits` edits lead from a to b. Bit d of word e says that, at the
    current character of b, diagonal d - edits of the band can be reached with e edits.
    With `begin` only so many characters of b are looked at, and false means that no
    continuation can make it true."""
    width, mask = 2 * edits + 1, (1 << (2 * edits + 1)) - 1

    def matches(pair: Column) -> Column:
        """For each character of b, the diagonals on which a's character equals it."""
        def at(j: Column) -> Column:
            out = None
            for d in range(width):
                same = F.coalesce(F.get(pair["a"], j + (d - edits)) == F.get(pair["b"], j), F.lit(False))
                bit = F.when(same, F.lit(1 << d)).otherwise(F.lit(0))
                out = bit if out is None else out.bitwiseOR(bit)
            return out

        return F.transform(F.sequence(F.lit(0), F.size(pair["b"]) - 1), at)

    def turn(acc: Column, match: Column) -> Column:
        out: list[Column] = []
        for e in range(edits + 1):
            word = acc[f"e{e}"].bitwiseAND(match)
            if e:
                before = acc[f"e{e - 1}"]
                word = word.bitwiseOR(before).bitwiseOR(F.shiftright(before, 1))  # substitute, insert
                word = word.bitwiseOR(F.shiftleft(out[-1], 1).bitwiseAND(F.lit(mask)))  # delete
            out.append(word)
        return F.struct(*(w.alias(f"e{e}") for e, w in enumerate(out)))

    start = F.struct(*(F.lit(((1 << (e + 1)) - 1) << edits & mask).alias(f"e{e}") for e in range(edits + 1)))
    # The characters are split once: a lambda would split them again at each mention.
    near, none = F.abs(F.length(a) - F.length(b)) <= edits, F.length(b) == 0
    end = F.call_function("shiftleft", F.lit(1), F.length(a) - F.length(b) + edits)
    if begin is not None:
        end = F.when(F.length(b) <= begin, end).otherwise(F.lit(mask))
        a, b = F.substring(a, 1, begin + edits), F.substring(b, 1, begin)
    rows = F.transform(F.array(F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b"))), matches)
    reached = F.aggregate(F.element_at(rows, 1), start, turn, lambda acc: acc[f"e{edits}"].bitwiseAND(end) != 0)
    return F.when(~near, F.lit(False)).when(none, F.lit(True)).otherwise(reached)


def candidates(texts: DataFrame, edits: int = EDITS) -> DataFrame:
    """Pairs (a, b) of hashes h1 whose texts share a segment where one may be. Not every pair
    of a list: only what the places allow, and each pair once. Texts of equal h1 go together."""
    hot = listed(texts, edits).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > LIST_ROWS)
    hot = materialized(hot.select("key", F.ceil(F.col("n") / LIST_ROWS).alias("parts")), "hot-segments")
    lists = listed(texts, edits)
    probing = probes(texts, edits).withColumnsRenamed({"h1": "other", "letters": "others"})
    if hot.isEmpty():
        pairs = lists.join(probing, "key")
    else:
        one = F.lit(1).cast("long")
        dealt = lists.join(hot, "key", "left").withColumn("part", F.pmod(F.xxhash64("h1"), F.coalesce("parts", one)))
        every = F.sequence(F.lit(0).cast("long"), F.coalesce("parts", one) - 1)
        visiting = probing.join(hot, "key", "left").withColumn("part", F.explode(every))
        pairs = dealt.drop("parts").join(visiting.drop("parts"), ["key", "part"])
    pairs = pairs.where((F.col("h1") != F.col("other")) & letters_near(F.col("letters"), F.col("others"), edits))
    return pairs.select(F.least("h1", "other").alias("a"), F.greatest("h1", "other").alias("b")).distinct()


def links(texts: DataFrame, edits: int = EDITS) -> DataFrame:
    """Verified pairs (a, b) of text ids, struct(h1, h2). texts: h1, h2, line, a row per text. Written once, with
    their letters: lists, their sizes, probes and the lines of pairs are read from there."""
    texts = materialized(texts.select("h1", "h2", "line", letters(F.col("line")).alias("letters")), "line-texts")
    pairs = materialized(candidates(texts, edits), "line-pairs")
    wanted = materialized(pairs.select(F.col("a").alias("h1")).union(pairs.select("b")).distinct(), "paired-lines")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    paired = materialized(texts.join(wanted, "h1", "left_semi"), "paired-texts")
    one = lambda c: paired.select(F.col("h1").alias(c), F.struct("h1", "h2").alias("id" + c), F.col("line").alias("l" + c))
    sizes = lambda c: pairs.groupBy(c).agg(F.count("*").alias("n"))
    both = spread_join(pairs, one("b"), "b", sizes("b"), F.xxhash64("a"))
    both = spread_join(both, one("a"), "a", sizes("a"), F.xxhash64("b"))
    rest = trimmed(F.col("la"), F.col("lb"))
    both = both.where(F.abs(F.length("la") - F.length("lb")) <= edits).select("ida", "idb", rest[0].alias("ra"), rest[1].alias("rb"))
    both = both.where(within(F.col("ra"), F.col("rb"), edits, START))
    return both.where(within(F.col("ra"), F.col("rb"), edits)).select(F.col("ida").alias("a"), F.col("idb").alias("b")).distinct()


def distinct_texts(found: DataFrame, firsts: DataFrame) -> DataFrame:
    """h1, h2, line: a row per distinct line. Most lines occur once and are taken as they
    are, without a shuffle of text if the hashes of the others may be broadcast."""
    often = firsts.where("n > 1").select("h1", "h2")
    often = F.broadcast(often) if often.count() <= BROADCAST_IDS else often
    single = found.join(often, ["h1", "h2"], "left_anti")
    several = found.join(often, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.min("line").alias("line"))
    return single.select("h1", "h2", "line").union(materialized(several, "frequent-lines"))


def line_classes(docs: DataFrame, edits: int = EDITS, short: bool = False) -> DataFrame:
    """A row per line of MIN_CHARS or more, with `short` per line that isn't blank: doc_id, row_key, line_no; class_doc and class_line,
    the first occurrence of an equal line; links, how many other texts are within `edits`
    of it; and kept: whether it is the first of all equal and linked lines. A line goes if an
    earlier line equals it or is linked with it (even if that one goes, too)."""
    found = lines(docs, short)
    firsts = materialized(first_occurrences(found), "first-lines")
    texts = distinct_texts(found.where(F.length("line") >= MIN_CHARS), firsts.where(F.col("n_chars") >= MIN_CHARS))
    pairs = materialized(links(texts, edits), "line-links")
    near = pairs.union(pairs.select("b", "a")).toDF("id", "other")
    linked = near.select("id").distinct()
    names = firsts.select(F.struct("h1", "h2").alias("id"), "at", "n")
    # Lines that occur once and are linked with none are their own class: no need to look them up
    special = names.join(linked.withColumn("linked", F.lit(True)), "id", "left").where("n > 1 or linked")
    special = materialized(special, "special-lines")
    sizes = near.groupBy("id").agg(F.count("*").alias("n"))
    earlier = spread_join(
        near.select(F.col("id").alias("to"), F.col("other").alias("id")), special.select("id", "at"), "id", sizes, F.xxhash64("to")
    )
    earlier = earlier.groupBy(F.col("to").alias("id")).agg(F.min("at").alias("near"), F.count("*").alias("links"))
    known = special.join(earlier, "id", "left").select(
        "id", "at", "n",
        F.coalesce("links", F.lit(0)).cast("long").alias("links"),
        F.coalesce(F.col("near") < F.col("at"), F.lit(False)).alias("late"),
    )
    known = materialized(known, "known-lines")
    last = F.lit(2**63 - 1)
    rows = found.select("doc_id", F.coalesce("doc_id", last).alias("d"), "row_key", "line_no", F.struct("h1", "h2").alias("id"))
    if known.count() <= BROADCAST_KEYS:
        rows = rows.join(F.broadcast(known.drop("n")), "id", "left")
    else:
        rows = spread_join(rows, known.drop("n"), "id", known.select("id", "n"), F.xxhash64("d", "line_no"), "left")
    here = (F.col("at.doc_id") == F.col("d")) & (F.col("at.row_key") == F.col("row_key")) & (F.col("at.line_no") == F.col("line_no"))
    alone = F.col("at").isNull()
    return rows.select(
        "doc_id", "row_key", "line_no",
        F.when(alone, F.col("doc_id")).when(F.col("at.doc_id") < last, F.col("at.doc_id")).alias("class_doc"),
        F.when(alone, F.col("line_no")).otherwise(F.col("at.line_no")).alias("class_line"),
        F.coalesce("links", F.lit(0).cast("long")).alias("links"),
        F.when(alone, F.lit(True)).otherwise(here & ~F.col("late")).alias("kept"),
    )


def drop_lines(docs: DataFrame, edits: int = EDITS, short: bool = False) -> DataFrame:
    """The documents without the lines that aren't kept, with their own columns. Documents of
    which no line but blank ones is left go too; those that had no text stay. n_chars, where there is such
    a column, is counted anew."""
    gone = line_classes(docs.select("doc_id", "text"), edits, short).where(~F.col("kept"))
    d, key, drop = unused(docs, "d"), unused(docs, "row_key"), unused(docs, "drop_lines")
    gone = gone.groupBy(F.coalesce("doc_id", F.lit(2**63 - 1)).alias(d), F.col("row_key").alias(key)).agg(
        F.collect_set("line_no").alias(drop)  # at most the lines of one document
    )
    gone = materialized(gone, "gone-lines")
    text = F.col("text").cast("string")
    keyed = docs.withColumn(d, F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)))
    keyed = keyed.withColumn(key, F.xxhash64(F.coalesce(text, F.lit(""))))
    joined = keyed.join(gone, [d, key], "left")
    kept = F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(drop, i))
    short = F.when(F.col(drop).isNull(), text).otherwise(F.array_join(kept, "\n"))
    out = joined.withColumn("text", short)
    out = out.where(F.col(drop).isNull() | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(drop).isNull(), F.col("n_chars")).otherwise(F.length("text")))
    return out.select(*docs.columns)
