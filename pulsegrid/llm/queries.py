"""One query for each operator over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from .oracle import ORACLE_SQL  # noqa: F401


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit, identify, split_of

    docs = tables.read(spark, sf_dir, "documents")
    return identify(docs, fit(docs, split_of(F.col("doc_id"), 3) != 1))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import digest, scan

    return digest(scan(tables.read(spark, sf_dir, "documents")))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import dedup

    return dedup(tables.read(spark, sf_dir, "documents")).drop("spans")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import join

    return join(tables.read(spark, sf_dir, "documents")).drop("th")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import split_of
    from .toxicity import fit, score

    docs = tables.read(spark, sf_dir, "documents")
    return score(docs, fit(docs, tables.read(spark, sf_dir, "labels"), split_of(F.col("_id"), 5) != 0))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import round_trip

    return round_trip(tables.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lz_dedup import dedup

    return dedup(tables.read(spark, sf_dir, "documents")).drop("spans")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated, digest

    return digest(contaminated(tables.read(spark, sf_dir, "documents"), tables.read(spark, sf_dir, "benchmark")))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(tables.read(spark, sf_dir, "documents"), shards=40)


def op10_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lattice_dedup import near_dedup

    return near_dedup(tables.read(spark, sf_dir, "embeddings"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import digest

    return digest(tables.read(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_repair import damage, digest

    rows = tables.read(spark, sf_dir, "conversations")
    return digest(rows, damage(rows))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(tables.read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_secret_scans": op2_secret_scans,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_toxicity": op5_toxicity,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_sharding": op9_sharding,
    "op10_lattice_dedup": op10_lattice_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_html_extraction": op13_html_extraction,
}
