"""The queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Names of public tokenizer files; ``token_file`` finds their path.
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def token_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op3_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .gru_lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op4_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .perplexity_rules import apply_quality_rules

    return apply_quality_rules(table(spark, sf_dir, "documents"))


def op5_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .srs_ann import nearest_of_every_20th

    return nearest_of_every_20th(table(spark, sf_dir, "embeddings"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .subword_classifier import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), token_file(BYTE_BPE))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), token_file(PIECE_BPE))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify_languages

    return identify_languages(table(spark, sf_dir, "documents"))


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licences

    return scan_licences(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_dedup, op2_html_text, op3_recurrent_lm, op4_perplexity_rules, op5_nearest_vectors, op6_quality_classifier, op7_packing, op8_sentencepiece, op9_language_id, op10_licence_scan)}


def oracle_sql() -> dict[str, str]:
    from .licenses import scan_sql

    return {"op10_licence_scan": scan_sql()}
