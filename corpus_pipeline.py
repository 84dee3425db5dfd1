"""Training-data pipeline: five stages over the documents table, each on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from memspark.functions.staging import remove
from memspark.llm import decontaminate, line_dedup, packing, simhash, toxicity
from memspark.llm.common import shared_folder, table


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose calibrated toxicity score is 0.3 or more."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def boilerplate_lines_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that stand on many sites, but for their first place."""
    return line_dedup.dedup_lines(docs)


def near_duplicates_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with a five-word Jaccard similarity of 0.8 or more one stays."""
    return simhash.drop_near_duplicates(docs)


def benchmark_passages_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every passage of 10 words that a benchmark item holds."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_to_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents to bins of 2,048 words without two of one source or duplicate cluster."""
    return packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic_documents_go),
    ("line_dedup", boilerplate_lines_go),
    ("near_dedup", near_duplicates_go),
    ("decontamination", benchmark_passages_go),
    ("packing", pack_to_bins),
]

#: SQL can't express the first stage (a trained model); tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents table; each stage is written to the shared folder and read again, and the one before it deleted then."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
