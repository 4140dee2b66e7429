"""Clean a corpus: STAGES in order, each written as Parquet and read again for the next.

Documents that the quality classifier rejects go; of lines that repeat, the first stays;
of each group of near duplicates, one document stays; documents that repeat a benchmark
item go; the rest is packed into sequences. All stages but the last keep the columns of
documents, and each works on all that its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from terraquilt.llm import decontamination, line_dedup, near_dedup, packing, quality
from terraquilt.llm.common import materialized, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_lines(docs, short=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", repeated_lines),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("best-fit packing", packed),
]

#: Compression, edit joins, sampling and tokenizers go beyond SQL: tests hold line
#: dedup, near-duplicates and decontamination against brute-force versions instead, the classifier
#: against held-out labels, and the plan and pieces of packing against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialized(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
