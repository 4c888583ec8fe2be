"""Order of pages and planes in written files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arithmetic import ceil_div, div
from .levels import fixed_levels

#: Kinds of pages of an Aperio-like file in order. Fixed values.
PAGE_ORDER = ("main", "thumbnail", "level", "label", "macro")


def thumbnail_size(width, height, most: int) -> tuple[Column, Column]:
    """Size that fits into a square of ``most`` with the same proportions; small images stay as they are."""
    w, h = F.col(width), F.col(height)
    long = F.greatest(w, h)
    fit = lambda side: F.when(long <= most, side).otherwise(F.greatest(F.lit(1), div(side * most, long)))
    return fit(w).cast("bigint"), fit(h).cast("bigint")


def aperio_pages(slides: DataFrame, *, thumbnail: int = 1024) -> DataFrame:
    """slide_id, page_no, kind, width, height: main page, thumbnail, reduced levels, then label and macro
    where the slide (slide_id, w, h, has_label, has_macro) has them."""
    tw, th = thumbnail_size("w", "h", thumbnail)
    one = lambda kind, w, h, rank: F.struct(F.lit(PAGE_ORDER.index(kind)).alias("rank"), F.lit(rank).cast("bigint").alias("sub"), F.lit(kind).alias("kind"), w.cast("bigint").alias("width"), h.cast("bigint").alias("height"))
    fixed = F.array_compact(F.array(one("main", F.col("w"), F.col("h"), 0), one("thumbnail", tw, th, 0), F.when(F.col("has_label"), one("label", F.lit(300), F.lit(294), 0)), F.when(F.col("has_macro"), one("macro", F.lit(1152), F.lit(625), 0))))
    pages = slides.select("slide_id", F.explode(fixed).alias("p")).select("slide_id", "p.*")
    levels = fixed_levels(slides.select("slide_id", "w", "h"), "w", "h").select("slide_id", F.lit(PAGE_ORDER.index("level")).alias("rank"), F.col("factor").cast("bigint").alias("sub"), F.lit("level").alias("kind"), "width", "height")
    number = F.row_number().over(Window.partitionBy("slide_id").orderBy("rank", "sub")) - 1
    return pages.unionByName(levels).select("slide_id", number.cast("bigint").alias("page_no"), "kind", "width", "height")


def plane_pages(planes: DataFrame) -> DataFrame:
    """Pages of independent planes (slide_id, field, t, z, c): one image for each field, time outermost, channels innermost."""
    number = F.row_number().over(Window.partitionBy("slide_id", "field").orderBy("t", "z", "c")) - 1
    return planes.withColumn("page_no", number.cast("bigint"))


def tile_counts(pages: DataFrame, tile: int) -> DataFrame:
    """Tiles of each page, and how many came before it in its file: where a stream of tiles stands."""
    n = ceil_div("width", tile) * ceil_div("height", tile)
    before = Window.partitionBy("slide_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("n_tiles", n).withColumn("first_tile", F.coalesce(F.sum("n_tiles").over(before), F.lit(0)))
