"""Corpus pipeline: quality rules, line dedup, near duplicates, benchmark decontamination, mixing to target weights.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as the next one's documents.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import decontamination, line_dedup, mixing, ngram_join, quality_rules
from caseloom.llm.shared import WORD, table
from caseloom.session import use_checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line matches; one that loses its last word leaves."""
    out = line_dedup.dedup_lines(docs)
    emptied = (F.col("n_removed_lines") > 0) & ~F.col("text").rlike(WORD)
    out = out.filter(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        cut = F.when(F.col("n_removed_lines") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
        out = out.withColumn("n_chars", F.coalesce(cut, "n_chars"))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: five-word shingles, Jaccard of 0.8 or more."""
    return ngram_join.one_of_each(docs, k=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their rate and whole copies under the target weights of the domains."""
    return mixing.apply_mix(docs, table(spark, sf_dir, "labels"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("mixing to target weights", weights),
]

#: The stages cannot be expressed in SQL as a whole; they are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    home = f"{use_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{home}/{k}")
        docs = spark.read.parquet(f"{home}/{k}")
    return docs
