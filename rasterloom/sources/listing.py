"""Directory listings: slide files without those that a file set refers to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import FORMATS, file_format
from ..operators.planner import without_referenced

#: Suffixes of all formats, as a pattern of names; file systems tell capitals apart, formats don't.
PATTERN = r"(?i).*(" + "|".join(s.replace(".", r"\.") for group in FORMATS.values() for s in group) + r")$"


def listed(spark: SparkSession, folder: str, *, recursive: bool = True) -> DataFrame:
    """path, file_size, modified of all slide files; contents stay unread, since their column is never asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select("path", F.col("length").alias("file_size"), F.col("modificationTime").alias("modified")).where(F.col("path").rlike(PATTERN))


def referenced(spark: SparkSession, folder: str) -> DataFrame:
    """Paths that readable file sets refer to. Sets are small XML texts; one that can't be read refers to nothing."""
    texts = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.lower("path").endswith(".afi"))
    # a set that isn't XML gives no references
    text = F.regexp_extract_all(F.col("content").cast("string"), F.lit(r"<(?:\w+:)?Path>\s*([^<]*?)\s*</"), F.lit(1))
    rows = texts.where(F.col("content").cast("string").rlike(r"<(\w+:)?(?i:AFI)[\s>]")).select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), F.explode(text).alias("child"))
    return rows.where("child != ''").select(F.when(F.col("child").startswith("/"), F.concat(F.lit("file:"), "child")).otherwise(F.concat_ws("/", "folder", "child")).alias("path")).distinct()


def inspectable_files(spark: SparkSession, folder: str, *, recursive: bool = True) -> DataFrame:
    """Slide files with their format, numbered from 1 in order of path components."""
    files = without_referenced(listed(spark, folder, recursive=recursive), referenced(spark, folder), "path")
    # a listing is numbered as a whole: its rows are files, not tiles
    return files.withColumn("format", file_format("path")).withColumn("idx", F.row_number().over(Window.orderBy(F.split("path", "/"))).cast("bigint"))
