"""A training corpus from documents: five stages, each an operator of pastframe.llm on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pastframe.llm import bpe, decontamination, line_templates, near_copies, weak_quality
from pastframe.llm.common import forget, settled
from pastframe.llm.queries import vocabulary_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return weak_quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go, and documents that consisted of them; n_chars is counted anew."""
    kept = line_templates.drop_recurring_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in kept.columns else kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more) stays: the one of the smallest doc_id."""
    return near_copies.drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the ids of each text, how many they are, and the text that they decode to."""
    coded = bpe.encode_decode(docs, vocabulary_path(), joined=False)
    return coded.withColumn("n_tokens", F.size("ids").cast("bigint")).withColumnRenamed("decoded", "decoded_text")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("tokenise", tokenise),
]

#: The classifier is trained, and tokens are not SQL's: no stage list can be told in SQL as a whole. tests/llm has the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = settled(spark, lambda: stage(spark, docs, sf_dir), name)  # noqa: B023  runs at once
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
