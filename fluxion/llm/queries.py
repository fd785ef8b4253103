"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_dedup, near_dup, url_filter
from .collocations import ORACLE_SQL as _PHRASES_SQL
from .collocations import collocations
from .decontaminate import contaminated
from .jaccard_join import ORACLE_SQL as _JOIN_SQL
from .jaccard_join import jaccard_join
from .language_id import language_id
from .licences import scan_licences
from .line_dedup import dedup_lines
from .mpeg_audio import encode_texts, probe_media
from .near_dup import near_duplicates
from .packing import pack
from .personal_data import find_personal_data
from .quality import resample
from .spelling import ORACLE_SQL as _SPELLING_SQL
from .spelling import spelling_variants
from .support import table
from .url_filter import filter_urls, listed_of


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = probe_media(encode_texts(table(spark, sf_dir, "documents")), "doc_id", "n_bytes")
    return out.withColumn("seek_offsets", F.array_join("seek_offsets", ",")).drop("tags")


def op2_hyperdimensional_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op3_bloom_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, listed_of(pages))


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_suffix_automaton_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licences(table(spark, sf_dir, "documents"))
    return out.withColumn("spans", F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["label"], x["start"], x["end"])), ","))


def op6_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents")).drop("found")


def op7_superminhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_line_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.encode("text", "utf-8")).alias("text_md5"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_partition_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op13_prefix_grown_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_bloom_url_filter": url_filter.ORACLE_SQL,
        "op7_superminhash_near_dup": near_dup.ORACLE_SQL,
        "op10_line_window_dedup": line_dedup.ORACLE_SQL,
        "op11_spelling_variants": _SPELLING_SQL,
        "op12_partition_jaccard_join": _JOIN_SQL,
        "op13_prefix_grown_collocations": _PHRASES_SQL,
    }
