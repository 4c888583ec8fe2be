"""Pyramid levels: building, planning and choosing them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arithmetic import ceil_div, div


def level_extents(tiles: DataFrame) -> DataFrame:
    """Levels from tiles (slide_id, scale, x, y, w, h): one for each scale, the largest scale first."""
    levels = tiles.groupBy("slide_id", "scale").agg(F.max(F.col("x") + F.col("w")).alias("width"), F.max(F.col("y") + F.col("h")).alias("height"), F.count(F.lit(1)).alias("n_tiles"))
    order = Window.partitionBy("slide_id").orderBy(F.desc("scale"))
    return levels.withColumn("level_no", (F.dense_rank().over(order) - 1).cast("bigint"))


def halving_levels(slides: DataFrame, width: str, height: str, *, least: int = 512, most: int = 32) -> DataFrame:
    """Levels of repeated halving, rounded up: the first whose short side is below ``least`` is the last.

    After k halvings a side is ceil(side / 2**k), so the levels are a sequence, without recursion."""
    k = F.col("level_no")
    size = lambda side, n: ceil_div(side, F.pow(F.lit(2.0), n).cast("bigint"))
    steps = slides.withColumn("level_no", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(most).cast("bigint"))))
    before = F.least(size(width, k - 1), size(height, k - 1))
    return steps.where(before >= least).select("slide_id", "level_no", size(width, k).alias("width"), size(height, k).alias("height"))


def fixed_levels(slides: DataFrame, width: str, height: str, *, factors: tuple[int, ...] = (4, 16, 32), least: int = 512, only: int = 128) -> DataFrame:
    """Levels at fixed factors, rounded down, while the short side is at least ``least``; if there are
    none, one at the first factor whose short side is at least ``only``."""
    short = lambda f: F.least(div(width, f), div(height, f))
    good = F.array_compact(F.array(*(F.when(short(f) >= least, F.lit(f)) for f in factors)))
    one = F.when(short(factors[0]) >= only, F.array(F.lit(factors[0]))).otherwise(F.array().cast("array<int>"))
    rows = slides.withColumn("factor", F.explode(F.when(F.size(good) > 0, good).otherwise(one)))
    return rows.select("slide_id", "factor", div(width, "factor").alias("width"), div(height, "factor").alias("height"))


def preview_choice(levels: DataFrame, *, max_long_side: int = 2048) -> DataFrame:
    """The first level after the main one whose long side fits, else the last; and the largest level by area."""
    k = F.col("level_no")
    fits = (k > 0) & (F.greatest("width", "height") <= max_long_side)
    return levels.groupBy("slide_id").agg(
        F.coalesce(F.min(F.when(fits, k)), F.max(k)).alias("preview_level"),
        (F.max(F.struct(F.col("width") * F.col("height"), (-k).alias("k"))).getField("k") * -1).alias("largest_level"),
    )


def completeness(rows: DataFrame, key: str, index: str) -> DataFrame:
    """Whether the distinct indexes of each key are exactly 0 .. n-1: n of them, from 0 to n-1."""
    i = F.col(index)
    return rows.groupBy(key).agg(F.count_distinct(i).alias("n"), F.min(i).alias("__lo"), F.max(i).alias("__hi")).select(key, "n", ((F.col("__lo") == 0) & (F.col("__hi") == F.col("n") - 1)).alias("complete"))
