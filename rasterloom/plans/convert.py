"""Conversion of a folder's slides: tables of pages and segments in, slide files out."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.windows import greedy_names
from ..sources.datasource import register
from ..sources.listing import inspectable_files
from ..sources.ome import ome_xml
from ..sources.slide_pages import write_native_ome, write_svs
from .session import store_path

#: Suffix of each output of ``convert_slides``. Fixed values.
SUFFIX = {"ome_tiff": ".ome.tif", "svs": ".svs"}

def tiff_tables(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """header, levels and JPEG tiles of tiled TIFF files; slide_id is the path."""
    read = lambda table: register(spark).read.format("slide_tiff").option("table", table).option("paths", json.dumps(paths)).load()
    header, pages = read("header"), read("pages")
    leveled = pages.where("kind in ('main', 'level') and tiled")
    number = F.row_number().over(Window.partitionBy("path").orderBy("page")) - 1
    levels = leveled.select(F.col("path").alias("slide_id"), "page", number.cast("long").alias("level"), "width", "height", "tile_w", "samples")
    tiles = read("segments").withColumnRenamed("path", "slide_id").join(levels.select("slide_id", "page", "level", "tile_w"), ["slide_id", "page"])
    # a stored tile has its whole size, at the edges, too
    return header, levels, tiles.select("slide_id", "level", "x", "y", F.col("tile_w").alias("w"), F.col("tile_w").alias("h"), "payload")


def container_tables(spark: SparkSession, kind: str, paths: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same of KFB or .image containers: their first field, channel and plane."""
    read = lambda table: register(spark).read.format(kind).option("table", table).option("paths", json.dumps(paths)).load()
    if kind == "kfb":
        header = read("header").select("path", "width", "height", F.col("codec"), F.lit(8).alias("bit_depth"), "mpp", F.col("objective").alias("magnification"), F.col("tile_size").alias("tile_w"))
        tiles = read("tiles").where("field = 0 and channel = 0 and z = 0 and t = 0 and codec = 'JPEG'").select("path", "level", "x", "y", "w", "h", "payload")
    else:
        header = read("header").select("path", "width", "height", F.lit("JPEG").alias("codec"), F.lit(8).alias("bit_depth"), ((F.col("mpp_x") + F.col("mpp_y")) / 2).alias("mpp"), F.col("max_zoom").alias("magnification"), F.lit(256).cast("long").alias("tile_w"))
        tiles = read("tiles").where("not blank").select("path", "level", "x", "y", F.lit(256).cast("long").alias("w"), F.lit(256).cast("long").alias("h"), "payload")
    extents = read("levels").select(F.col("path").alias("slide_id"), F.col("level").cast("long").alias("page"), F.col("level").cast("long").alias("level"), "width", "height")
    levels = extents.join(header.select(F.col("path").alias("slide_id"), "tile_w", F.lit(3).cast("long").alias("samples")), "slide_id")
    return header.drop("tile_w"), levels, tiles.withColumnRenamed("path", "slide_id")


#: Formats that one reader serves. Fixed values.
READERS = {"slide_tiff": ("svs", "generic_tiff"), "kfb": ("kfb",), "image_container": ("image",)}


def convert_slides(spark: SparkSession, folder: str, out_folder: str, output_format: str = "ome_tiff", *, check: Callable[[], None] = lambda: None, log: Callable[[str], None] = lambda text: None) -> DataFrame:
    """Every slide of a folder that holds baseline JPEG tiles on a grid (TIFF, SVS, KFB, .image) as OME-TIFF
    or SVS; idx, input_path, status, output_path.

    Files of one reader, tile size and number of samples are written together. Files that no codec here
    reads are ``skipped_incompatible``. ``check`` is asked between groups and may raise to end the job."""
    known = [f for formats in READERS.values() for f in formats]
    files = inspectable_files(spark, folder).where(F.col("format").isin(*known)).withColumn("path", F.regexp_replace("path", "^file:(//)?", ""))
    paths: dict[str, list[str]] = {}
    for r in files.select("path", "format").collect():  # one folder's file names
        paths.setdefault(next(k for k, formats in READERS.items() if r["format"] in formats), []).append(r["path"])
    named = files.withColumns({"folder": F.lit("out"), "stem": F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"(?<=.)\.[^.]*$", ""), "suffix": F.lit(SUFFIX[output_format])})
    named = greedy_names(named.select("idx", "path", "folder", "stem", "suffix"), folder="folder", stem="stem", suffix="suffix", order="idx")
    written: list[tuple[str, str]] = []
    os.makedirs(out_folder, exist_ok=True)
    for kind, own_paths in paths.items():
        header, levels, tiles = tiff_tables(spark, own_paths) if kind == "slide_tiff" else container_tables(spark, kind, own_paths)
        good = header.where("codec = 'JPEG' and bit_depth = 8").join(named, "path")
        facts = good.select(F.col("path").alias("slide_id"), "mpp", F.col("magnification").alias("mag"), "stem", "name", F.col("width").alias("main_width"), F.col("height").alias("main_height")).join(levels, "slide_id")
        shapes = facts.where("level = 0").select("tile_w", "samples").distinct().orderBy("tile_w", "samples").collect()
        for shape in shapes:
            check()
            for path, target in convert_group(spark, facts, tiles, shape["tile_w"], shape["samples"], out_folder, output_format):
                written.append((path, target))
                log(f"{path} -> {target}")
    done = spark.createDataFrame(written, "path string, output_path string")
    status = F.when(F.col("output_path").isNotNull(), "converted").otherwise("skipped_incompatible")
    return files.join(done, "path", "left").select("idx", F.col("path").alias("input_path"), status.alias("status"), "output_path").orderBy("idx")


def convert_group(spark: SparkSession, facts: DataFrame, tiles: DataFrame, tile: int, samples: int, out_folder: str, output_format: str) -> list[tuple[str, str]]:
    """Writes the slides of one tile size and number of samples to a staging folder and moves them to their names."""
    own = facts.where("level = 0").where((F.col("tile_w") == tile) & (F.col("samples") == samples)).select("slide_id")
    mine = facts.join(own, "slide_id", "left_semi")
    staging = store_path(spark, "convert").removeprefix("file://").removeprefix("file:")
    slides = {r["slide_id"]: r for r in mine.where("level = 0").select("slide_id", "name", "stem", "main_width", "main_height", "mpp").collect()}
    key = F.md5(F.col("slide_id").cast("binary"))
    own_tiles = tiles.join(own, "slide_id", "left_semi").withColumn("slide_id", key)
    told = spark.createDataFrame([(i, ome_xml(r["stem"], width=r["main_width"], height=r["main_height"], channels=[], mpp=(r["mpp"], r["mpp"]), rgb=samples == 3)) for i, r in slides.items()], "slide_id string, description string")
    table = mine.join(told, "slide_id").withColumns({"slide_id": key, "icc": F.lit("none")})
    write = write_native_ome if output_format == "ome_tiff" else write_svs
    write(table, own_tiles, staging, tile=tile, bands=samples)
    out = []
    for path, r in slides.items():
        target = os.path.join(out_folder, r["name"])
        shutil.move(os.path.join(staging, hashlib.md5(path.encode()).hexdigest() + SUFFIX[output_format]), target)
        out.append((path, target))
    return out
