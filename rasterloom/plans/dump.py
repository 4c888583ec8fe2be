"""A look into one container: header, levels, tile list, associated images and previews as files."""

from __future__ import annotations

import json
import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jpeg_codec import encode
from ..operators.raster import decoded, read_regions
from ..sources.datasource import register
from .session import store_path


def scale_summary(tiles: DataFrame) -> DataFrame:
    """Levels from tiles (scale, x, y, w, h): size, tiles, columns and rows of each, the largest scale first."""
    by = tiles.groupBy(F.round("scale", 6).alias("scale")).agg(F.count(F.lit(1)).alias("n_tiles"), F.max(F.col("x") + F.col("w")).alias("width"), F.max(F.col("y") + F.col("h")).alias("height"), F.count_distinct("x").alias("n_columns"), F.count_distinct("y").alias("n_rows"))
    return by.orderBy(F.desc("scale"))


def export_region(tiles: DataFrame, path: str, box: tuple[int, int, int, int], *, bands: int = 3, background: int = 255, quality: int = 90) -> str:
    """A region of one slide's level as an image file, for people to look at: the region comes to the driver."""
    x0, y0, x1, y1 = box
    region = tiles.select("slide_id").limit(1).select("slide_id", *(F.lit(v).cast("long").alias(n) for n, v in zip(("region_id", "rx0", "ry0", "rx1", "ry1"), (0, x0, y0, x1, y1))))
    row = read_regions(tiles, region, background=background, bands=bands).first()
    px = decoded(bytes(row["pixels"]), row["h"], row["w"], bands) if row else np.full((y1 - y0, x1 - x0, bands), background, np.uint8)
    with open(path, "wb") as f:
        f.write(encode(px, quality))
    return path


def dump_container(spark: SparkSession, path: str, out: str, *, preview_levels: tuple[int, ...] = ()) -> str:
    """Writes metadata.json, tile_index (CSV), associated images and previews of a container; returns the JSON."""
    os.makedirs(out, exist_ok=True)
    read = lambda table: register(spark).read.format("kfb").option("table", table).load(path)
    tiles = read("tiles")
    index = store_path(spark, "tile-index").removeprefix("file://").removeprefix("file:")
    tiles.drop("payload").coalesce(1).orderBy("tile_no").write.option("header", True).csv(index)
    part = next(x for x in sorted(os.listdir(index)) if x.endswith(".csv"))
    with open(os.path.join(index, part), "rb") as a, open(os.path.join(out, "tile_index.csv"), "wb") as b:
        b.write(a.read())
    found = []
    for r in read("associated").toLocalIterator():  # a few images
        row = r.asDict()
        payload = row.pop("payload", None)
        if payload:
            name = os.path.join(out, f"{row['name']}.jpg")
            with open(name, "wb") as f:
                f.write(bytes(payload))
            row["file"] = name
        found.append(row)
    previews = []
    for level in preview_levels:
        own = tiles.where(F.col("level") == level).withColumn("slide_id", F.lit(0))
        size = own.agg(F.max(F.col("x") + F.col("w")).alias("w"), F.max(F.col("y") + F.col("h")).alias("h")).first()
        if size["w"]:
            previews.append(export_region(own, os.path.join(out, f"level_{level}.jpg"), (0, 0, size["w"], size["h"])))
    summary = {"header": read("header").first().asDict(), "levels": [r.asDict() for r in scale_summary(tiles).collect()], "associated_images": found, "previews": previews, "tile_index_csv": os.path.join(out, "tile_index.csv")}
    text = json.dumps(summary, ensure_ascii=False, indent=2, default=str)
    with open(os.path.join(out, "metadata.json"), "w", encoding="utf-8") as f:
        f.write(text)
    return text
