"""A training corpus from documents: quality rules, language identification, near-duplicates, packing.

Each stage gets all that its predecessor kept, written as Parquet and read again; all but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.langid import identify_languages
from rasterloom.llm.minhash_dedup import without_near_duplicates
from rasterloom.llm.packing import pack_documents
from rasterloom.llm.perplexity_rules import apply_quality_rules
from rasterloom.llm.queries import BYTE_BPE, token_file
from rasterloom.llm.shared import ROW, carried, store_path

#: Below this posterior a document has no clear language.
LEAST_LANGUAGE_SCORE = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what passes the base rule and lies within its language's perplexity band.

    Null and empty texts go (they have no words); a null language is one of its own, ``und``; a language
    without reference texts has no band; long texts are judged whole; a text at a band's edge stays;
    repeated rows stay or go alike, each row whole with whatever columns it has; no rows: none."""
    return apply_quality_rules(carried(docs), [ROW]).where("kept").select(f"{ROW}.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a recognisable language.

    Null texts and texts without a letter go; of languages alike in score the first by name counts;
    labels may be null, and without any label nothing stays; long texts are read whole; repeated rows
    stay or go alike, each row whole with whatever columns it has; no rows: none."""
    seen = identify_languages(carried(docs), [ROW])
    return seen.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(f"{ROW}.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near-duplicates, that of the least doc_id.

    A null text is near to none but rows of the same id; of repeated rows one stays; a null id comes
    after all others; long texts are compared whole; rows stay whole with whatever columns they have;
    no rows: none."""
    return without_near_duplicates(docs).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, placed in token sequences.

    A null or empty text is one end id; long texts make many pieces; repeated rows are packed as often
    as they come; ties go by id, start and checksum; other columns are left behind; no rows: none."""
    return pack_documents(docs, token_file(BYTE_BPE))


STAGES = [("quality rules", quality_rules), ("language id", language_id), ("near dedup", near_dedup), ("packing", packing)]

#: SQL can't express the model-based stages; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = store_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
