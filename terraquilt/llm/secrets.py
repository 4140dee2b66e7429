"""Secret scans by a trigram index (operator 3). DataFrame functions only.

1. Every rule is a regular expression with the literals it can't match without, as a choice
   of alternatives: any one of them has to be in the text. From each literal follow its
   trigrams, so a rule becomes a Boolean query: OR over alternatives of AND over trigrams.
2. The inverted index lists, for every trigram that any query asks for, the documents that
   hold it (lower-cased), as postings (trigram, document).
3. Postings meet by document: the trigrams of a document answer all queries at once,
   and what they admit is a candidate (document, rules). A rule without a mandatory
   trigram has no query; its candidates are all documents.
4. Candidates are verified by the regular expression over the whole text.

Places are found without positions from the regular expression: splitting a text at the
matches gives what lies between, and lengths of both, in turn, add up. They are counted in
code points, and the end is exclusive.

Nulls: a null text is an empty one, without spans. Rows are told apart by a row key made
here, so equal and null doc_id are kept as they are, a row each.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraquilt.llm.common import BROADCAST_KEYS, materialized, spread_join, text_key, unused


@dataclass(frozen=True)
class Rule:
    """literals: alternatives of parts that all have to occur (letters in either case);
    empty if nothing is mandatory. group and least: matches whose group is shorter go."""

    kind: str
    pattern: str
    literals: tuple[tuple[str, ...], ...] = ()
    group: int = 0
    least: int = 1


#: The rules of the contract. `[0-9a-f]{24,}` finds the runs of 24 and more, as `+` and dropping do.
BASE = (
    Rule(
        "assign",
        r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"""
        r"""|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        (("password",), ("passwd",), ("secret",), ("token",), ("api", "key")),
        2, 6,
    ),
    Rule("access", "AKIA[A-Z0-9]+", (("akia",),), 0, 20),
    Rule("hex", "[0-9a-f]{24,}", (), 0, 24),
)

#: Further well-known forms of public services' keys.
MORE = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}", (("ghp_",), ("gho_",), ("ghu_",), ("ghs_",), ("ghr_",))),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", (("xoxa-",), ("xoxb-",), ("xoxp-",), ("xoxr-",), ("xoxs-",))),
    Rule("google", "AIza[A-Za-z0-9_-]{35}", (("aiza",),)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", (("eyj",),)),
    Rule(
        "pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]{0,40}PRIVATE KEY-----)?",
        (("-----begin ", "private key-----"),),
    ),
    Rule("urlauth", r"[a-z][a-z0-9+]{1,20}://[^\s/@:]{1,100}:[^\s/@]{1,200}@", (("://", "@"),)),
)


def trigrams(literal: str) -> set[str]:
    return {literal[i : i + 3] for i in range(len(literal) - 2)}


def trigram_query(rule: Rule) -> list[set[str]]:
    """Alternatives, each a set of trigrams that all have to occur; empty: no query."""
    query = [set().union(*map(trigrams, parts)) for parts in rule.literals]
    return query if all(query) else []


def _query(rule: Rule, held: Column) -> Column:
    query = trigram_query(rule)
    if not query:
        return F.lit(True)
    alternatives = [reduce(Column.__and__, (F.array_contains(held, g) for g in sorted(q))) for q in query]
    return reduce(Column.__or__, alternatives)


def index(docs: DataFrame, rules: tuple[Rule, ...], key: str = "doc_key", text: str = "text") -> DataFrame:
    """Postings (trigram, key) of the trigrams that the rules ask for."""
    wanted = sorted(set().union(*(q for r in rules for q in trigram_query(r))))
    held = F.filter(F.array(*(F.when(F.contains(F.col("low"), F.lit(g)), F.lit(g)) for g in wanted)), lambda g: g.isNotNull())
    lowered = docs.select(key, F.lower(F.col(text)).alias("low"))
    return lowered.select(F.explode(held).alias("trigram"), key)


def candidates(docs: DataFrame, rules: tuple[Rule, ...], key: str = "doc_key", text: str = "text") -> DataFrame:
    """key and kinds: the rules with a query that a document's postings answer."""
    held = index(docs, rules, key, text).groupBy(key).agg(F.collect_set("trigram").alias("held"))
    asked = [r for r in rules if trigram_query(r)]
    kinds = F.array(*(F.when(_query(r, F.col("held")), F.lit(r.kind)) for r in asked))
    found = held.select(key, F.filter(kinds, lambda k: k.isNotNull()).alias("kinds"))
    return found.where(F.size("kinds") > 0)


def spans(text: Column, rule: Rule) -> Column:
    """array of (start, end) of a rule's matches, in order."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    group = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    between = F.split(text, rule.pattern, -1)
    steps = F.zip_with(
        F.zip_with(F.slice(between, 1, F.size(whole)), whole, lambda b, w: F.struct(F.length(b).alias("b"), F.length(w).alias("w"))),
        group,
        lambda s, g: F.struct(s["b"].alias("b"), s["w"].alias("w"), F.length(g).alias("g")),
    )
    def run(some: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

        def step(acc: Column, s: Column) -> Column:
            begin = acc["at"] + s["b"]
            span = F.array(F.struct(begin.alias("start"), (begin + s["w"]).alias("end")))
            out = F.when(s["g"] >= rule.least, F.concat(acc["out"], span)).otherwise(acc["out"])
            return F.struct((begin + s["w"]).alias("at"), out.alias("out"))

        return F.aggregate(some, start, step, lambda acc: acc["out"])

    # An array is copied for each item it gets, so n matches are taken in blocks of the root of n, and the
    # blocks' beginnings are added up first.
    def blocks(all_: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(all_))).cast("int")
        many = F.ceil(F.size(all_) / size).cast("int")
        return F.transform(F.sequence(F.lit(0), many - 1), lambda k: F.slice(all_, k * size + 1, size))

    def begins(some: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        length = lambda block: F.aggregate(block, F.lit(0), lambda n, s: n + s["b"] + s["w"])
        step = lambda acc, block: F.struct((acc["at"] + length(block)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(some, start, step, lambda acc: acc["out"])

    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    found = once(steps, lambda all_: F.when(
        F.size(all_) > 0, once(blocks(all_), lambda some: F.flatten(F.zip_with(some, begins(some), run)))
    ))
    return F.coalesce(found, F.array().cast("array<struct<start:int,end:int>>"))


def _joined(found: Column) -> Column:
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def _named(own: Column, rank: int, kind: str) -> Column:
    return F.transform(own, lambda s: F.struct(
        s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")
    ))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """docs with `secrets`: array of (start, rank, end, kind), by start and then rule.

    What a rule needs of a text beyond a look at it (splitting, extracting) is done for its
    candidates alone. The key of a row is its text's hash: equal texts have equal spans,
    so rows needn't be numbered and copies are one key of the index.
    """
    text, key = unused(docs, "whole_text"), unused(docs, "doc_key")
    keyed = docs.withColumn(text, F.coalesce(F.col("text").cast("string"), F.lit("")))
    keyed = keyed.withColumn(key, text_key(F.col(text)))
    kinds, found = unused(docs, "kinds"), unused(docs, "secrets")
    answers = candidates(keyed, rules, key, text).select(F.col(key), F.col("kinds").alias(kinds))
    answers = materialized(answers, "secret-candidates")
    if answers.count() <= BROADCAST_KEYS:
        joined = keyed.join(F.broadcast(answers), key, "left")
    else:
        sizes = keyed.join(answers.select(key), key, "left_semi").groupBy(key).agg(F.count("*").alias("n"))
        joined = spread_join(keyed, answers, key, sizes, F.xxhash64("doc_id"), "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    parts = []
    for rank, rule in enumerate(rules):
        admitted = F.array_contains(kinds, rule.kind) if trigram_query(rule) else F.col(text).rlike(rule.pattern)
        own = F.when(F.coalesce(admitted, F.lit(False)), spans(F.col(text), rule)).otherwise(none)
        parts.append(_named(own, rank, rule.kind))
    ordered = F.array_sort(F.concat(*parts))
    return joined.withColumn(found, ordered).drop(text, key, kinds)


def secret_counts(docs: DataFrame) -> DataFrame:
    """The digest of the contract: counts and a hash of the base rules' spans, and all spans."""
    found = scan(docs.select("doc_id", "text")).select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s["rank"] < len(BASE))
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *(count(r.kind) for r in BASE),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("secrets")).alias("spans"),
    )
