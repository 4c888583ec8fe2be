"""Pixel results of region reads and reduced levels: embeddings are 8x8 tiles, 20 to a grid row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arithmetic import div
from ..functions.pixels import quantised
from ..operators.raster import buffer_factor, encode_tiles, pixels_of, read_regions, reduce_level, source_window
from .pixel_queries import Q8
from .registry import Registry, table

registry = Registry()
query = registry.query

PIXELS = f"{Q8}, p AS (SELECT vec_id, (vec_id % 20) * 8 + i % 8 AS gx, (vec_id // 20) * 8 + i // 8 AS gy, px[i + 1] AS v FROM (SELECT *, unnest(range(0, 64)) AS i FROM q))"


def tiles_of(spark, sf_dir) -> DataFrame:
    k = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").select(F.lit(0).cast("bigint").alias("slide_id"), F.lit(0).cast("bigint").alias("level"), ((k % 20) * 8).alias("x"), (div(k, 20) * 8).alias("y"), F.lit(8).cast("bigint").alias("w"), F.lit(8).cast("bigint").alias("h"), quantised("embedding", 255).alias("px"))
    return encode_tiles(rows, "px")


@query(
    f"""WITH {PIXELS}, r AS (SELECT vec_id AS region_id, (vec_id % 20) * 8 + 3 AS rx, (vec_id // 20) * 8 + 2 AS ry FROM embeddings), c AS (SELECT *, unnest(range(0, 60)) AS i FROM r)
 SELECT c.region_id, c.i, coalesce(p.v, 255) AS v FROM c LEFT JOIN p ON p.gx = c.rx + c.i % 10 AND p.gy = c.ry + c.i // 10"""
)
def stitch_region(spark, sf_dir):
    k = F.col("vec_id")
    x, y = (k % 20) * 8 + 3, div(k, 20) * 8 + 2
    regions = table(spark, sf_dir, "embeddings").select(F.lit(0).cast("bigint").alias("slide_id"), k.alias("region_id"), x.alias("rx0"), y.alias("ry0"), (x + 10).alias("rx1"), (y + 6).alias("ry1"))
    return pixels_of(read_regions(tiles_of(spark, sf_dir), regions, bin_size=16)).select("region_id", "i", "v")


@query(f"WITH {PIXELS} SELECT gx // 2 AS px, gy // 2 AS py, CAST(round_even(avg(v), 0) AS BIGINT) AS v FROM p GROUP BY 1, 2")
def pyramid_pixels(spark, sf_dir):
    # the last group of tiles may lack neighbours; only pixels that tiles cover are compared
    small = pixels_of(reduce_level(tiles_of(spark, sf_dir), tile=8), "payload")
    covered = table(spark, sf_dir, "embeddings").select(((F.col("vec_id") % 20) * 4).alias("cx"), (div("vec_id", 20) * 4).alias("cy"))
    out = small.select((F.col("x") + F.col("i") % F.col("w")).alias("px"), (F.col("y") + div("i", F.col("w"))).alias("py"), "v")
    out = out.withColumns({"cx": div("px", 4) * 4, "cy": div("py", 4) * 4})
    return out.join(covered, ["cx", "cy"], "left_semi").select("px", "py", "v")


@query(
    """WITH s AS (SELECT p_partkey AS slide_id, 10000 + p_size * 1800 AS w, 9000 + (p_partkey % 70) * 1300 AS h FROM part), n AS (SELECT *, CAST(w AS DOUBLE) * h * 3 / (0.55 * 1024 * 1024 * 1024) AS need FROM s)
 SELECT slide_id, CAST(power(2.0, greatest(0.0, ceil(log2(greatest(need, 1.0)) / 2))) AS BIGINT) AS factor, CAST(floor(500 * (w / 1000.0)) AS BIGINT) AS win_begin, greatest(CAST(floor(500 * (w / 1000.0)) AS BIGINT) + 1, least(CAST(w AS BIGINT), CAST(ceil(600 * (w / 1000.0)) AS BIGINT))) AS win_end FROM n"""
)
def buffer_plan(spark, sf_dir):
    w, h = F.col("p_size").cast("bigint") * 1800 + 10000, (F.col("p_partkey") % 70) * 1300 + 9000
    begin, end = source_window(F.lit(500), F.lit(100), "w", F.lit(1000))
    slides = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slide_id"), w.alias("w"), h.alias("h"))
    return slides.select("slide_id", buffer_factor("w", "h", 1024).alias("factor"), begin.alias("win_begin"), end.alias("win_end"))
