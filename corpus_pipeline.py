"""The corpus pipeline: each stage takes (spark, docs, sf_dir); its result is written and read again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopia.llm.decontamination import decontaminate
from canopia.llm.line_dedup import dedup_lines
from canopia.llm.packing import pack
from canopia.llm.quality import keep_good
from canopia.llm.simhash import drop_near_duplicates
from canopia.plans.shared import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that an earlier one holds; ``n_chars`` follows the text."""
    kept = dedup_lines(docs, spans="__spans_cut", removed="__words_cut")
    return kept.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): that with the smallest id."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in training sequences."""
    return pack(docs)


STAGES = [
    ("quality_classifier", quality), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination), ("best_fit_packing", packing),
]
#: The classifier's neighbours and the sequence lengths cannot be put in SQL; tests compare the run with a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
