"""URL filters by a tree of path templates (operator 1).

Rules decide first (longest wins); what they decide is also the label that the tree learns
from, unless other labels are given. The tree judges the rest:

1. Urls become (host, segments of the path). Segments that are plainly variable become
   wildcards by their form: {num}, {hex}, with a file ending kept. Urls of equal form are
   counted together before anything else, so a host with a third of all urls is a few rows.
2. Level by level, below each (host, template so far): a segment that is one of CHILDREN or
   more and holds under RARE of the urls there is variable and becomes *.
3. Of the other branches, those with enough labels whose share of bad urls isn't
   significantly different from that of all their siblings together (two-proportion z-test)
   are merged into *.
4. A template is rejected if its smoothed purity reaches PURITY. Purity is smoothed down the tree: that of a node is
   (bad + STRENGTH * purity of the node above) / (labelled + STRENGTH) over the urls below it, and above a host's
   root stands the share of bad among all labels. So a template without labels is judged by the nearest
   nodes above it that have some (`evidence`, their depth, 0 for the host's root), and has to reach INHERITED, as what
   is around it must be bad nearly all through; on a host without any, none is rejected.

Segments beyond LEVELS are one variable tail. Nulls: a null url, or one without ://, has an empty host
and path and is judged by the template of those. A url that is labelled both ways counts
both ways. Rows stay as they are, equal ones too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraquilt.llm.common import materialized, spread_join, unused

LEVELS, CHILDREN, RARE = 12, 20, 0.05
LABELS, Z = 10, 1.96
STRENGTH, PURITY, INHERITED = 10.0, 0.5, 0.8

#: (verdict, host and path)
RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
    ("block", "net/es/"), ("block", "net/fr/"),
)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none fits. The rules
    are a list in the plan; they don't grow with the data."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def form(path: Column) -> Column:
    """Segments of a path, plainly variable ones as wildcards, without a trailing slash."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")

    def one(s: Column) -> Column:
        name, end = F.regexp_replace(s, r"\.[A-Za-z]{1,5}$", ""), F.regexp_extract(s, r"(\.[A-Za-z]{1,5})$", 1)
        wild = F.when(name.rlike("^[0-9]+$"), "{num}").when(
            name.rlike("^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), "{hex}"
        )
        return F.when(wild.isNotNull(), F.concat(wild, end)).otherwise(s)

    kept = F.transform(parts, one)
    return F.when(F.size(kept) <= LEVELS, kept).otherwise(F.concat(F.slice(kept, 1, LEVELS), F.array(F.lit("**"))))


def templates(urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From urls (host, form, bad: 1, 0 or null): which template each (host, form) is of, and for each
    (host, template) its counts, purity, evidence and verdict."""
    count = (F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    forms = urls.groupBy("host", "form").agg(*count)
    tree = materialized(forms.withColumn("template", F.lit("")), "forms")
    depth = tree.agg(F.coalesce(F.max(F.size("form")), F.lit(0))).first()[0]
    for level in range(depth):
        placed = tree.withColumn("segment", F.get("form", F.lit(level)))
        key = F.struct("host", "template", "segment").alias("key")
        rows = placed.select("*", key)
        branches = rows.where("segment is not null").groupBy("key").agg(
            F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.count("*").alias("rows")
        )
        branches = materialized(branches, "branches")
        above = branches.groupBy("key.host", "key.template").agg(
            F.count("*").alias("children"), F.sum("n").alias("all"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad")
        )
        beside = branches.select("*", "key.host", "key.template").join(above, ["host", "template"])
        others, bad = F.col("all_labelled") - F.col("labelled"), F.col("all_bad") - F.col("bad")
        pooled = F.col("all_bad") / F.col("all_labelled")
        spread = F.sqrt(pooled * (1 - pooled) * (1 / F.col("labelled") + 1 / others))
        apart = F.abs(F.col("bad") / F.col("labelled") - bad / others)
        similar = (F.col("labelled") >= LABELS) & (others >= LABELS) & (apart <= Z * spread)
        variable = (F.col("children") >= CHILDREN) & (F.col("n") < RARE * F.col("all"))
        # nested in when(): nothing is divided by 0 where labels are missing
        merged = variable | F.when((F.col("labelled") > 0) & (others > 0), similar).otherwise(F.lit(False))
        name = F.when(merged, F.lit("*")).otherwise(F.col("key.segment"))
        named = beside.select("key", name.alias("name"))
        ended = rows.where("segment is null").select("host", "form", "n", "labelled", "bad", "template")
        going = spread_join(
            rows.where("segment is not null"), named, "key",
            branches.select("key", F.col("rows").alias("n")), F.xxhash64("form"),
        )
        going = going.select("host", "form", "n", "labelled", "bad", F.concat("template", F.lit("/"), "name").alias("template"))
        tree = materialized(going.union(ended), "tree")
    total = tree.agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).first()
    prior = total["bad"] / total["labelled"] if total["labelled"] else 0.0
    judged = tree.groupBy("host", "template").agg(
        F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")
    )
    return tree.select("host", "form", "template", "n"), _judged(judged, prior)


def _judged(found: DataFrame, prior: float) -> DataFrame:
    """found (host, template, n, labelled, bad) with purity, evidence and verdict."""
    parts = F.split("template", "/")
    names = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda d: F.array_join(F.slice(parts, 1, d), "/"))
    found = materialized(found, "templates-found")
    steps = found.select("host", "template", "labelled", "bad", F.posexplode(names).alias("depth", "node"))
    key = F.struct("host", "node").alias("key")
    nodes = steps.groupBy(key).agg(F.sum("labelled").alias("node_labelled"), F.sum("bad").alias("node_bad"), F.count("*").alias("n"))
    nodes = materialized(nodes, "tree-nodes")
    # A host's root is the node of all its templates.
    chains = spread_join(steps.select("host", "template", "depth", key), nodes.drop("n"), "key", nodes.select("key", "n"), F.xxhash64("template"))
    own = F.struct("depth", "node_labelled", "node_bad")
    chains = chains.groupBy("host", "template").agg(F.sort_array(F.collect_list(own)).alias("chain"))  # LEVELS + 2 at most
    strength = F.lit(STRENGTH)
    purity = F.aggregate(
        "chain", F.lit(float(prior)), lambda p, x: (x["node_bad"] + strength * p) / (x["node_labelled"] + strength)
    )
    evidence = F.array_max(F.transform(F.filter("chain", lambda x: x["node_labelled"] > 0), lambda x: x["depth"]))
    judged = found.join(chains.select("host", "template", purity.alias("purity"), evidence.alias("evidence")), ["host", "template"])
    least = F.when(F.col("labelled") > 0, PURITY).otherwise(INHERITED)
    rejected = F.col("evidence").isNotNull() & (F.col("purity") >= least)
    return judged.withColumn("verdict", F.when(rejected, "block").otherwise("allow"))


def judge(pages: DataFrame, rules=RULES, bad: str | None = None) -> DataFrame:
    """pages with host, path, rule, verdict, template, purity and evidence. bad: a column of labels (1
    bad, 0 good, null none) to learn from instead of the rules' verdicts. Columns of pages with
    the names that are added are replaced."""
    added = ["host", "path", "rule", "verdict", "template", "purity", "evidence"]
    pages = pages.drop(*(c for c in added if c not in ("url", bad)))
    host, path = F.col("host"), F.col("path")
    parsed = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, said = rule_of(host, path, rules)
    key, own = unused(pages, "url_form"), unused(pages, "url_rule_verdict")
    parsed = parsed.withColumns({"rule": rule, own: said, key: F.struct(host.alias("host"), form(path).alias("form"))})
    label = F.col(bad).cast("long") if bad else F.when(F.col(own) == "block", 1).when(F.col(own) == "allow", 0).cast("long")
    tree, judged = templates(parsed.select(f"{key}.host", f"{key}.form", label.alias("bad")))
    known = tree.join(judged.drop("n", "labelled", "bad"), ["host", "template"])
    known = known.select(F.struct("host", "form").alias(key), "template", "purity", "evidence", "verdict", "n")
    known = materialized(known, "templates")
    out = spread_join(parsed, known.drop("n"), key, known.select(key, "n"), F.xxhash64("path"))
    out = out.withColumn("verdict", F.coalesce(F.col(own), F.col("verdict")))
    return out.select(*pages.columns, *added)
