"""Training-data pipeline over `documents`: each stage takes what its predecessor kept, written as Parquet and read again.

quality classifier -> line dedup -> near-duplicates -> benchmark decontamination -> packing. All but the last return the
columns of documents; n_chars follows the text. The last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxion.llm.decontaminate import clean
from fluxion.llm.line_dedup import dedup_lines
from fluxion.llm.near_dup import keep_one
from fluxion.llm.packing import pack
from fluxion.llm.quality import keep_sampled
from fluxion.llm.queries import tokenizer_path
from fluxion.llm.support import materialise, table
from fluxion.shipping import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't sample go."""
    return keep_sampled(docs, table(ship(spark), sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later places of repeated three-line windows go; documents stay, with what remains of their texts."""
    out = dedup_lines(docs).drop("n_lines", "n_removed")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest doc_id."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that copy a test item go."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left and their places in sequences."""
    return pack(docs, tokenizer_path())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", packing),
]

#: Models, similarity search and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
