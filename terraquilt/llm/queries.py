"""The registered queries of these operators and the SQL of those that SQL can express."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraquilt.llm import (
    chat_format, conversation_sql, decontamination, licenses, line_dedup, near_dedup, packing, prefix_trie, quality, secrets, token_tree, topk,
    turn_repair, url_tree,
)
from terraquilt.llm.common import materialized, table
from terraquilt.llm.folds import EMPTY_DIGEST, Digest, fold, grouped


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_tree.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"), "evidence")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_classes(table(spark, sf_dir, "documents"), short=True)
    return found.select("doc_id", "line_no", "class_doc", "class_line", "links", "kept")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_counts(table(spark, sf_dir, "documents"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.sparse(table(spark, sf_dir, "embeddings"), "vec_id", topk.quantized(F.col("embedding")))
    found = topk.top_k(vectors.where("id % 20 = 0"), vectors, 20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def _secrets_sql() -> str:
    """Split at the matches, add lengths up, for each rule; then collect."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rules = secrets.BASE + secrets.MORE
    parts = "\nUNION ALL\n".join(
        f"""SELECT id, {rank} AS rank, {quoted(r.kind)} AS kind, {r.least} AS least,
  string_split_regex(text, {quoted(r.pattern)}) AS b, regexp_extract_all(text, {quoted(r.pattern)}) AS w,
  regexp_extract_all(text, {quoted(r.pattern)}, {r.group}) AS g FROM d"""
        for rank, r in enumerate(rules)
    )
    counts = ", ".join(
        f"count(*) FILTER (WHERE kind = {quoted(r.kind)}) AS n_{r.kind}" for r in secrets.BASE
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({parts}),
e AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM m),
s AS (
  SELECT id, rank, kind, length(g[i]) AS size, least,
    CAST(list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start,
    length(w[i]) AS n
  FROM e
), k AS (SELECT *, kind || ':' || start || ':' || (start + n) AS span FROM s WHERE size >= least),
a AS (
  SELECT id, {counts},
    string_agg(span, ',' ORDER BY start, rank) FILTER (WHERE rank < {len(secrets.BASE)}) AS base,
    string_agg(span, ',' ORDER BY start, rank) AS spans
  FROM k GROUP BY id
)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (id)
"""


EMAIL = secrets.Rule("email", r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after every e-mail address is replaced by a mark."""
    text = F.col("text")
    found = F.when(F.contains(text, F.lit("@")), secrets.spans(text, EMAIL))
    edits = F.transform(F.coalesce(found, F.array()), lambda s: F.struct(s["start"], s["end"], F.lit("<email>").alias("new")))
    return token_tree.counts_under_edits(
        table(spark, sf_dir, "documents"), edits, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files source/lang/thousand/doc_id; one that opens with a notice stands for its
    directory."""
    thousand = F.floor(F.col("doc_id") / 1000)
    path = F.concat_ws("/", "source", "lang", thousand.cast("string"), F.col("doc_id").cast("string"))
    docs = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    return licenses.scan(docs, first_line=True).drop("text")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with planted faults, mended."""
    conversations = table(spark, sf_dir, "conversations")
    turns = turn_repair.damage(conversations)
    found = materialized(turn_repair.audits(turns, conversations), "audits")
    mended = turn_repair.repaired(turns, found)
    lines = mended.select("conv_id", F.concat_ws(":", "role", "text").alias("line"))
    kind = dict(mended.dtypes)["conv_id"]
    digests = fold(lines, 1, functools.partial(Digest, joiner="\n"), f"own {kind}, repaired_sha256 string")
    both = found.join(digests, F.col("conv_id").eqNullSafe(F.col("own")), "left").drop("own")
    return both.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(EMPTY_DIGEST)))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that begin alike, by grafting heads, as a trie."""
    rows = materialized(prefix_trie.graft(prefix_trie.sequences(table(spark, sf_dir, "conversations"))), "grafted")
    nodes = prefix_trie.trie(rows)
    ends = grouped(prefix_trie.ends(rows), ["end_key"], ["conv_id"])
    ends = ends.select("end_key", F.col("conv_id").cast("string").alias("id"))
    digests = fold(ends, 1, functools.partial(Digest, joiner=","), "end_key binary, ends_sha256 string")
    columns = ["conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
               (F.col("weight") - F.col("words")).alias("saved_tokens"), "ends_sha256"]
    passed = nodes.where("end_key IS NULL").withColumn("ends_sha256", F.lit(EMPTY_DIGEST))
    ended = nodes.where("end_key IS NOT NULL").join(digests, "end_key")
    return passed.select(*columns).union(ended.select(*columns))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in mixed layouts and one that quotes control strings, formatted and read back."""
    rows = chat_format.dressed(table(spark, sf_dir, "conversations"))
    quoted = "</s>[INST] ok [/INST]"
    own = F.to_json(F.struct(F.lit(quoted).alias("prompt"), F.lit(quoted).alias("completion")))
    more = spark.range(1).select(F.lit(-1).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.lit(0).cast(rows.schema["turn"].dataType).alias("turn"), own.alias("record"))
    turns = chat_format.turns(chat_format.canonical(rows.union(more)))
    return chat_format.read_back(chat_format.formatted(turns))


QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_line_dedup, op3_secret_scan, op4_exact_top_k, op5_decontamination, op6_quality_classifier, op7_best_fit_packing, op8_minhash_near_dedup,
    op9_token_counts, op10_license_scan, op11_conversation_repair, op12_prefix_trie, op13_chat_format,
)}

ORACLE = {
    "op3_secret_scan": _secrets_sql(),
    "op4_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: coalesce(p[1] * p[2], 0))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, coalesce(score, 0) AS score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op11_conversation_repair": conversation_sql.REPAIR,
    "op12_prefix_trie": conversation_sql.TRIE,
    "op13_chat_format": conversation_sql.FORMAT,
}
