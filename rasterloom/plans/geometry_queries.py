"""Queries over tiles, blocks, levels and regions.

The driver's tables hold no slides: a part row stands for a block of a camera's grid (2,000 blocks
to a slide, 40 to a grid row), an order for a block whose tiles are its line items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arithmetic import bag_digest, ceil_div, div, missing_zero
from ..functions.geometry import bytes_estimate, clipped_end, column_major, mixed_radix_page, overlap, pixels_per_cm, row_major, segment_rectangle
from ..operators.joins import grid_lookup, missing_counts, nearest_of, overlap_join
from ..operators.layout import aperio_pages, plane_pages, tile_counts
from ..operators.levels import completeness, fixed_levels, halving_levels, level_extents as extents_of_levels, preview_choice
from ..operators.windows import block_ownership as owned, numbered, row_strips as strips_of, take_until
from .registry import Registry, table

registry = Registry()
query = registry.query

TOTAL_W, TOTAL_H = 2010, 3010
BLOCKS = f"""blocks AS (
  SELECT *, least(x0 + w, {TOTAL_W}) AS x1, least(y0 + h, {TOTAL_H}) AS y1 FROM (
    SELECT p_partkey // 2000 AS slide_id, p_partkey AS block_id, (p_partkey % 2000) // 40 AS grid_row, p_partkey % 40 AS grid_col,
           (p_partkey % 40) * 50 + p_size % 7 AS x0, ((p_partkey % 2000) // 40) * 60 + p_size % 5 AS y0, 40 + p_size AS w, 50 + p_size % 20 AS h
    FROM part))"""
REGIONS = """regions AS (
  SELECT p_partkey // 2000 AS slide_id, p_partkey AS region_id, (p_partkey * 37) % 1900 AS rx0, (p_partkey * 53) % 2900 AS ry0,
         (p_partkey * 37) % 1900 + 30 + p_size AS rx1, (p_partkey * 53) % 2900 + 30 + p_size % 11 AS ry1
  FROM part)"""
OWNED = (
    BLOCKS
    + """, edges AS (
  SELECT *, CAST(floor(0.5 * (lag(x1) OVER r + x0)) AS BIGINT) AS bx, CAST(floor(0.5 * (x1 + lead(x0) OVER r)) AS BIGINT) AS ax,
            CAST(floor(0.5 * (lag(y1) OVER c + y0)) AS BIGINT) AS by_, CAST(floor(0.5 * (y1 + lead(y0) OVER c)) AS BIGINT) AS ay
  FROM blocks WINDOW r AS (PARTITION BY slide_id, grid_row ORDER BY x0, grid_col, block_id), c AS (PARTITION BY slide_id, grid_col ORDER BY y0, grid_row, block_id)),
 begins AS (SELECT *, greatest(x0, least(x1, coalesce(bx, x0))) AS own_x0, greatest(y0, least(y1, coalesce(by_, y0))) AS own_y0 FROM edges),
 owned AS (SELECT *, greatest(own_x0, least(x1, coalesce(ax, x1))) AS own_x1, greatest(own_y0, least(y1, coalesce(ay, y1))) AS own_y1 FROM begins)"""
)


def blocks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size").cast("bigint")
    rows = table(spark, sf_dir, "part").select(
        div(k, 2000).alias("slide_id"),
        k.alias("block_id"),
        div(k % 2000, 40).alias("grid_row"),
        (k % 40).alias("grid_col"),
        ((k % 40) * 50 + s % 7).alias("x0"),
        (div(k % 2000, 40) * 60 + s % 5).alias("y0"),
        (s + 40).alias("w"),
        (s % 20 + 50).alias("h"),
    )
    return rows.withColumns({"x1": clipped_end("x0", "w", TOTAL_W), "y1": clipped_end("y0", "h", TOTAL_H)})


def regions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size").cast("bigint")
    x, y = (k * 37) % 1900, (k * 53) % 2900
    return table(spark, sf_dir, "part").select(div(k, 2000).alias("slide_id"), k.alias("region_id"), x.alias("rx0"), y.alias("ry0"), (x + 30 + s).alias("rx1"), (y + 30 + s % 11).alias("ry1"))


@query(f"WITH {BLOCKS} SELECT slide_id, block_id, x0, y0, x1, y1, x1 - x0 AS clip_w, y1 - y0 AS clip_h FROM blocks")
def block_bounds(spark, sf_dir):
    return blocks_of(spark, sf_dir).select("slide_id", "block_id", "x0", "y0", "x1", "y1", (F.col("x1") - F.col("x0")).alias("clip_w"), (F.col("y1") - F.col("y0")).alias("clip_h"))


@query(
    f"WITH {BLOCKS} SELECT slide_id, grid_row, min(y0) AS strip_y0, max(y1) AS strip_y1, count(*) AS n_blocks, (min({{'x': x0, 'b': block_id}})).b AS first_block, (max({{'x': x0, 'b': block_id}})).b AS last_block FROM blocks GROUP BY slide_id, grid_row"
)
def row_strips(spark, sf_dir):
    return strips_of(blocks_of(spark, sf_dir))


@query(f"WITH {OWNED} SELECT slide_id, block_id, own_x0, own_x1, own_y0, own_y1 FROM owned")
def block_ownership(spark, sf_dir):
    return owned(blocks_of(spark, sf_dir)).select("slide_id", "block_id", "own_x0", "own_x1", "own_y0", "own_y1")


def region_blocks(spark, sf_dir) -> DataFrame:
    """Blocks of each region with their owned parts."""
    return overlap_join(owned(blocks_of(spark, sf_dir)), regions_of(spark, sf_dir), on=["slide_id"], left_box=("x0", "y0", "x1", "y1"), right_box=("rx0", "ry0", "rx1", "ry1"), bin_size=100)


@query(f"WITH {BLOCKS}, {REGIONS} SELECT r.region_id, b.block_id FROM regions r JOIN blocks b ON r.slide_id = b.slide_id AND b.x0 < r.rx1 AND r.rx0 < b.x1 AND b.y0 < r.ry1 AND r.ry0 < b.y1 AND b.y0 < b.y1 AND b.x0 < b.x1")
def region_overlap(spark, sf_dir):
    return overlap_join(blocks_of(spark, sf_dir), regions_of(spark, sf_dir), on=["slide_id"], left_box=("x0", "y0", "x1", "y1"), right_box=("rx0", "ry0", "rx1", "ry1"), bin_size=100).select("region_id", "block_id")


@query(
    f"""WITH {OWNED}, {REGIONS} SELECT r.region_id, count(*) AS n_blocks,
  CAST(sum(greatest(0, least(b.own_x1, r.rx1) - greatest(b.own_x0, r.rx0)) * greatest(0, least(b.own_y1, r.ry1) - greatest(b.own_y0, r.ry0))) AS BIGINT) AS owned_area
  FROM regions r JOIN owned b ON r.slide_id = b.slide_id AND b.x0 < r.rx1 AND r.rx0 < b.x1 AND b.y0 < r.ry1 AND r.ry0 < b.y1 AND b.y0 < b.y1 AND b.x0 < b.x1 GROUP BY r.region_id"""
)
def region_owned_area(spark, sf_dir):
    area = overlap("own_x0", "own_x1", "rx0", "rx1") * overlap("own_y0", "own_y1", "ry0", "ry1")
    return region_blocks(spark, sf_dir).groupBy("region_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(area).alias("owned_area"))


@query(
    f"""WITH {REGIONS}, tiles AS (SELECT p_partkey // 2000 AS slide_id, (p_partkey % 40) * 64 + CASE WHEN p_size = 7 THEN 3 ELSE 0 END AS x, ((p_partkey % 2000) // 40) * 64 AS y, min(p_size) AS payload FROM part WHERE p_size <= 40 GROUP BY 1, 2, 3),
 cells AS (SELECT *, unnest(range(rx0 // 64, (rx1 - 1) // 64 + 1)) * 64 AS cx FROM regions), cells2 AS (SELECT *, unnest(range(ry0 // 64, (ry1 - 1) // 64 + 1)) * 64 AS cy FROM cells)
 SELECT c.region_id, c.cx, c.cy, CAST(coalesce(t.payload, -1) AS BIGINT) AS payload FROM cells2 c LEFT JOIN tiles t ON t.slide_id = c.slide_id AND t.x = c.cx AND t.y = c.cy"""
)
def grid_lookup_tiles(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    tiles = table(spark, sf_dir, "part").where("p_size <= 40").select(div(k, 2000).alias("slide_id"), ((k % 40) * 64 + F.when(s == 7, 3).otherwise(0)).alias("x"), (div(k % 2000, 40) * 64).alias("y"), s.cast("bigint").alias("payload"))
    tiles = tiles.groupBy("slide_id", "x", "y").agg(F.min("payload").alias("payload"))
    return grid_lookup(regions_of(spark, sf_dir), tiles, on=["slide_id"], box=("rx0", "ry0", "rx1", "ry1"), tile=64, value="payload", background=-1).select("region_id", "cx", "cy", "payload")


@query(
    f"""WITH {REGIONS}, seg AS (SELECT *, unnest(range(ry0 // 128, (ry1 - 1) // 128 + 1)) AS ty FROM (SELECT *, unnest(range(rx0 // 128, (rx1 - 1) // 128 + 1)) AS tx FROM regions)), ids AS (SELECT region_id, ty * 16 + tx AS segment FROM seg WHERE tx < 16)
 SELECT region_id, segment, (segment % 16) * 128 AS sx, (segment // 16) * 128 AS sy, least(128, {TOTAL_W} - (segment % 16) * 128) AS sw, least(128, {TOTAL_H} - (segment // 16) * 128) AS sh FROM ids"""
)
def segment_lookup(spark, sf_dir):
    span = lambda a, b: F.sequence(div(a, 128), div(F.col(b) - 1, 128))
    across = ceil_div(F.lit(TOTAL_W), 128)
    ids = regions_of(spark, sf_dir).withColumn("tx", F.explode(span("rx0", "rx1"))).withColumn("ty", F.explode(span("ry0", "ry1"))).where(F.col("tx") < across)
    ids = ids.select("region_id", row_major("ty", "tx", across).alias("segment"))
    x, y, w, h = segment_rectangle("segment", F.lit(TOTAL_W), F.lit(TOTAL_H), 128)
    return ids.select("region_id", "segment", x.alias("sx"), y.alias("sy"), w.cast("bigint").alias("sw"), h.cast("bigint").alias("sh"))


@query(
    """SELECT o_orderkey AS block_id, coalesce(n, 0) AS n_found, ((o_custkey % 4 + 1) * 256 - 10 + 255) // 256 AS n_expected
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_orderkey) ON l_orderkey = o_orderkey
  WHERE coalesce(n, 0) <> ((o_custkey % 4 + 1) * 256 - 10 + 255) // 256"""
)
def tile_integrity(spark, sf_dir):
    blocks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("block_id"), ceil_div((F.col("o_custkey") % 4 + 1) * 256 - 10, 256).alias("n_expected"))
    tiles = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("block_id"))
    return missing_counts(blocks, tiles, "block_id", "n_expected").select("block_id", "n_found", "n_expected")


@query(
    """SELECT p_partkey AS slide_id, ty * ((100 + p_size * 20 + 63) // 64) + tx + 1 AS tile_no, tx * 64 AS x, ty * 64 AS y, least(64, 100 + p_size * 20 - tx * 64) AS w, least(64, 90 + (p_partkey % 5) * 30 - ty * 64) AS h
  FROM (SELECT *, unnest(range(0, CAST((100 + p_size * 20 + 63) // 64 AS BIGINT))) AS tx FROM (SELECT *, unnest(range(0, CAST((90 + (p_partkey % 5) * 30 + 63) // 64 AS BIGINT))) AS ty FROM part))"""
)
def tile_enumeration(spark, sf_dir):
    w, h = F.col("p_size").cast("bigint") * 20 + 100, (F.col("p_partkey") % 5) * 30 + 90
    rows = table(spark, sf_dir, "part").select("p_partkey", w.alias("w"), h.alias("h"), ceil_div(w, 64).alias("cols"), ceil_div(h, 64).alias("rows"))
    tiles = rows.withColumn("ty", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1))).withColumn("tx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cols") - 1)))
    x, y = F.col("tx") * 64, F.col("ty") * 64
    return tiles.select(F.col("p_partkey").alias("slide_id"), (row_major("ty", "tx", "cols") + 1).alias("tile_no"), x.alias("x"), y.alias("y"), F.least(F.lit(64), F.col("w") - x).alias("w"), F.least(F.lit(64), F.col("h") - y).alias("h"))


@query("SELECT p_partkey AS tile_id, s // 8 AS tile_row, s % 8 AS tile_col, (s // 8) * 8 + s % 8 AS row_major, (s % 8) * 7 + s // 8 AS column_major FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS s FROM part)")
def column_to_row_major(spark, sf_dir):
    r, c = div("p_size", 8), F.col("p_size").cast("bigint") % 8
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tile_id"), r.alias("tile_row"), c.alias("tile_col"), row_major(r, c, 8).alias("row_major"), column_major(r, c, 7).alias("column_major"))


@query(
    """SELECT p_partkey AS request_id, CAST((min({'d': abs(p_size * 300 - w) + abs(p_size * 200 + p_partkey % 97 - h), 'k': k})).k AS BIGINT) AS level
  FROM part, (VALUES (0, 15750, 10000), (1, 7875, 5000), (2, 3937, 2500), (3, 1968, 1250), (4, 984, 625)) AS levels(k, w, h) GROUP BY p_partkey"""
)
def nearest_level(spark, sf_dir):
    levels = [(15750, 10000), (7875, 5000), (3937, 2500), (1968, 1250), (984, 625)]
    s = F.col("p_size").cast("bigint")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("request_id"), nearest_of(s * 300, s * 200 + F.col("p_partkey") % 97, levels).alias("level"))


@query(
    """WITH t AS (SELECT p_partkey // 500 AS slide_id, round(40.0 / (1 << (p_size % 4)), 6) AS scale, (p_partkey % 40) * 16 AS x, (p_partkey % 25) * 16 AS y, 16 - p_size % 3 AS w, 16 - p_size % 5 AS h FROM part)
 SELECT slide_id, dense_rank() OVER (PARTITION BY slide_id ORDER BY scale DESC) - 1 AS level_no, scale, max(x + w) AS width, max(y + h) AS height, count(*) AS n_tiles FROM t GROUP BY slide_id, scale"""
)
def level_extents(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size").cast("bigint")
    scale = F.round(F.lit(40.0) / F.pow(F.lit(2.0), s % 4), 6)
    tiles = table(spark, sf_dir, "part").select(div(k, 500).alias("slide_id"), scale.alias("scale"), ((k % 40) * 16).alias("x"), ((k % 25) * 16).alias("y"), (F.lit(16) - s % 3).alias("w"), (F.lit(16) - s % 5).alias("h"))
    return extents_of_levels(tiles)


@query(
    """WITH RECURSIVE r AS (SELECT p_partkey AS slide_id, CAST(0 AS BIGINT) AS level_no, CAST(500 + p_size * 300 AS BIGINT) AS width, 600 + (p_partkey % 50) * 250 AS height FROM part
  UNION ALL SELECT slide_id, level_no + 1, (width + 1) // 2, (height + 1) // 2 FROM r WHERE least(width, height) >= 512)
 SELECT slide_id, level_no, width, height FROM r WHERE level_no > 0"""
)
def pyramid_halving(spark, sf_dir):
    slides = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slide_id"), (F.col("p_size").cast("bigint") * 300 + 500).alias("width"), ((F.col("p_partkey") % 50) * 250 + 600).alias("height"))
    return halving_levels(slides, "width", "height")


@query(
    """WITH s AS (SELECT p_partkey AS slide_id, CAST(100 + p_size * 800 AS BIGINT) AS w, 120 + (p_partkey % 50) * 500 AS h FROM part), c AS (SELECT *, unnest([4, 16, 32]) AS f FROM s),
 kept AS (SELECT slide_id, f, w // f AS width, h // f AS height FROM c WHERE least(w // f, h // f) >= 512)
 SELECT slide_id, f AS factor, width, height FROM kept UNION ALL
 SELECT slide_id, 4, w // 4, h // 4 FROM s WHERE slide_id NOT IN (SELECT slide_id FROM kept) AND least(w // 4, h // 4) >= 128"""
)
def pyramid_fixed(spark, sf_dir):
    slides = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slide_id"), (F.col("p_size").cast("bigint") * 800 + 100).alias("w"), ((F.col("p_partkey") % 50) * 500 + 120).alias("h"))
    return fixed_levels(slides, "w", "h")


VIEWER = """l AS (SELECT p_partkey AS slide_id, k AS level_no, greatest(1, (3000 + p_size * 250) // (1 << k)) AS width, greatest(1, (2000 + (p_partkey % 60) * 200) // (1 << k)) AS height FROM part, range(0, 9) AS r(k))"""


def viewer_pyramid(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumn("level_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(8).cast("bigint"))))
    step = F.pow(F.lit(2.0), F.col("level_no")).cast("bigint")
    return rows.select(
        F.col("p_partkey").alias("slide_id"),
        "level_no",
        F.greatest(F.lit(1), div(F.col("p_size") * 250 + 3000, step)).alias("width"),
        F.greatest(F.lit(1), div((F.col("p_partkey") % 60) * 200 + 2000, step)).alias("height"),
    )


@query(
    f"""WITH {VIEWER}, m AS (SELECT *, coalesce(sum(CASE WHEN level_no > 0 AND (width + 255) // 256 <= 2 AND (height + 255) // 256 <= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY slide_id ORDER BY level_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l)
 SELECT slide_id, level_no, width, height FROM m WHERE before = 0"""
)
def viewer_levels(spark, sf_dir):
    hit = (F.col("level_no") > 0) & (ceil_div("width", 256) <= 2) & (ceil_div("height", 256) <= 2)
    return take_until(viewer_pyramid(spark, sf_dir), by=["slide_id"], order=["level_no"], hit=hit).select("slide_id", "level_no", "width", "height")


@query(f"WITH {VIEWER} SELECT slide_id, coalesce(min(level_no) FILTER (WHERE level_no > 0 AND greatest(width, height) <= 1024), max(level_no)) AS preview_level, (max({{'a': width * height, 'k': -level_no}})).k * -1 AS largest_level FROM l GROUP BY slide_id")
def preview_level(spark, sf_dir):
    return preview_choice(viewer_pyramid(spark, sf_dir), max_long_side=1024)


@query(
    """WITH s AS (SELECT p_partkey AS slide_id, 20000 + p_size * 1500 AS w, 15000 + (p_partkey % 40) * 1000 AS h, 1 + p_partkey % 2 AS bpp FROM part), l AS (SELECT *, unnest([1, 4, 16, 32]) AS f FROM s),
 e AS (SELECT slide_id, CAST(sum(((w // f + 239) // 240) * 240 * ((h // f + 239) // 240) * 240 * bpp) AS BIGINT) + 67108864 AS estimate FROM l GROUP BY slide_id)
 SELECT slide_id, estimate, estimate > 3200000000 AS bigtiff FROM e"""
)
def bigtiff_estimate(spark, sf_dir):
    slides = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slide_id"), (F.col("p_size").cast("bigint") * 1500 + 20000).alias("w"), ((F.col("p_partkey") % 40) * 1000 + 15000).alias("h"), (F.col("p_partkey") % 2 + 1).alias("bpp"))
    sizes = [bytes_estimate(div("w", f), div("h", f), 240, "bpp") for f in (1, 4, 16, 32)]
    estimate = sum(sizes[1:], sizes[0]) + 67108864
    return slides.select("slide_id", estimate.alias("estimate"), (estimate > 3200000000).alias("bigtiff"))


@query(
    "SELECT l_orderkey AS slide_id, CAST(l_linenumber AS BIGINT) AS c, l_suppkey % 3 AS z, l_partkey % 2 AS t, ((l_partkey % 2) * 3 + l_suppkey % 3) * 8 + l_linenumber AS page, count(*) AS n_tiles FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber BETWEEN 1 AND 3 AND l_suppkey % 3 < 2 GROUP BY ALL"
)
def plane_filter(spark, sf_dir):
    planes = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_linenumber between 1 and 3").select(F.col("l_orderkey").alias("slide_id"), F.col("l_linenumber").cast("bigint").alias("c"), (F.col("l_suppkey") % 3).alias("z"), (F.col("l_partkey") % 2).alias("t"))
    return planes.where("z < 2").groupBy("slide_id", "c", "z", "t").agg(F.count(F.lit(1)).alias("n_tiles")).withColumn("page", mixed_radix_page("c", "z", "t", 8, 3))


@query(
    "SELECT l_orderkey AS slide_id, count(DISTINCT l_linenumber) AS n_channels, list_sort(list(DISTINCT l_linenumber)) = range(1, CAST(count(DISTINCT l_linenumber) AS BIGINT) + 1) AS complete FROM lineitem GROUP BY l_orderkey"
)
def plane_completeness(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("slide_id"), (F.col("l_linenumber") - 1).alias("c"))
    return completeness(rows, "slide_id", "c").withColumnRenamed("n", "n_channels")


@query(
    """WITH g AS (SELECT l_orderkey AS slide_id, l_linenumber AS c, list_sort(list(l_suppkey % 2)) AS shape FROM lineitem GROUP BY 1, 2)
 SELECT slide_id, count(*) AS n_channels, count(DISTINCT shape) = 1 AS agrees FROM g GROUP BY slide_id"""
)
def geometry_equality(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("slide_id"), "l_linenumber", (F.col("l_suppkey") % 2).alias("v"))
    shapes = rows.groupBy("slide_id", "l_linenumber").agg(bag_digest("v").alias("shape"))
    # least and greatest tell whether there are several, without a distinct count
    return shapes.groupBy("slide_id").agg(F.count(F.lit(1)).alias("n_channels"), (F.min("shape") == F.max("shape")).alias("agrees"))


@query(
    f"""WITH {BLOCKS} SELECT b.block_id, b.x0 // 4 + (l.l_linenumber % 2) * 8 AS px, b.y0 // 4 + (l.l_linenumber // 2) * 8 AS py, count(*) AS n
  FROM blocks b JOIN lineitem l ON l.l_partkey = b.block_id AND l.l_linestatus = 'F' GROUP BY ALL"""
)
def preview_join(spark, sf_dir):
    tiles = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.col("l_partkey").alias("block_id"), F.col("l_linenumber").cast("bigint").alias("n_"))
    px, py = div("x0", 4) + (F.col("n_") % 2) * 8, div("y0", 4) + div("n_", 2) * 8
    return blocks_of(spark, sf_dir).join(tiles, "block_id").groupBy("block_id", px.alias("px"), py.alias("py")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey AS slide_id, min(l_linenumber) FILTER (WHERE l_linenumber > 1) AS first_reduced, max(l_linenumber) AS last_layer FROM lineitem GROUP BY l_orderkey")
def layer_bounds(spark, sf_dir):
    layer = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("slide_id")).agg(F.min(F.when(layer > 1, layer)).alias("first_reduced"), F.max(layer).alias("last_layer"))


@query("SELECT min(l_linenumber) FILTER (WHERE l_linenumber > 0) AS min_layer FROM lineitem")
def min_layer(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_linenumber > 0").agg(F.min("l_linenumber").alias("min_layer"))


@query("SELECT max(l_linenumber) AS max_layer FROM lineitem")
def max_layer(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.max("l_linenumber").alias("max_layer"))


@query("SELECT p_partkey AS slide_id, CAST(CASE WHEN p_size % 5 = 0 THEN 255 ELSE p_size % 5 END AS BIGINT) AS bk_color, round(CASE WHEN p_size % 4 > 0 THEN 10000.0 / ((p_size % 4) * 0.25 * 4) ELSE 0.0 END, 6) AS px_per_cm FROM part")
def header_defaults(spark, sf_dir):
    s = F.col("p_size").cast("bigint")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slide_id"), missing_zero(s % 5, 255).cast("bigint").alias("bk_color"), F.round(pixels_per_cm((s % 4) * 0.25, 4), 6).alias("px_per_cm"))


@query(
    f"WITH {BLOCKS} SELECT slide_id, grid_row, block_id, row_number() OVER (PARTITION BY slide_id, grid_row ORDER BY x0, grid_col, block_id) AS place FROM blocks"
)
def block_order(spark, sf_dir):
    return numbered(blocks_of(spark, sf_dir), "place", by=["slide_id", "grid_row"], order=["x0", "grid_col", "block_id"]).select("slide_id", "grid_row", "block_id", "place")


@query(f"WITH {BLOCKS} SELECT slide_id, (min({{'a': (x1 - x0) * (y1 - y0), 'b': block_id}})).b AS smallest_block, max(grid_row) AS max_row, max(grid_col) AS max_col, min(x0) FILTER (WHERE x0 > 0) AS first_offset FROM blocks GROUP BY slide_id")
def grid_bounds(spark, sf_dir):
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return blocks_of(spark, sf_dir).groupBy("slide_id").agg(F.min(F.struct(area, "block_id")).getField("block_id").alias("smallest_block"), F.max("grid_row").alias("max_row"), F.max("grid_col").alias("max_col"), F.min(F.when(F.col("x0") > 0, F.col("x0"))).alias("first_offset"))


PAGES = """s AS (SELECT p_partkey AS slide_id, CAST(300 + p_size * 900 AS BIGINT) AS w, 400 + (p_partkey % 60) * 450 AS h, p_size % 2 = 0 AS has_label, p_size % 3 = 0 AS has_macro FROM part),
 c AS (SELECT *, unnest([4, 16, 32]) AS f FROM s), kept AS (SELECT slide_id, f, w // f AS lw, h // f AS lh FROM c WHERE least(w // f, h // f) >= 512),
 lv AS (SELECT * FROM kept UNION ALL SELECT slide_id, 4, w // 4, h // 4 FROM s WHERE slide_id NOT IN (SELECT slide_id FROM kept) AND least(w // 4, h // 4) >= 128),
 p AS (SELECT slide_id, 0 AS rank, 0 AS sub, 'main' AS kind, w AS width, h AS height FROM s
  UNION ALL SELECT slide_id, 1, 0, 'thumbnail', CASE WHEN greatest(w, h) <= 1024 THEN w ELSE greatest(1, w * 1024 // greatest(w, h)) END, CASE WHEN greatest(w, h) <= 1024 THEN h ELSE greatest(1, h * 1024 // greatest(w, h)) END FROM s
  UNION ALL SELECT slide_id, 2, f, 'level', lw, lh FROM lv
  UNION ALL SELECT slide_id, 3, 0, 'label', 300, 294 FROM s WHERE has_label UNION ALL SELECT slide_id, 4, 0, 'macro', 1152, 625 FROM s WHERE has_macro),
 pages AS (SELECT slide_id, row_number() OVER (PARTITION BY slide_id ORDER BY rank, sub) - 1 AS page_no, kind, width, height FROM p)"""


def page_slides(spark, sf_dir) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size").cast("bigint")
    return table(spark, sf_dir, "part").select(k.alias("slide_id"), (s * 900 + 300).alias("w"), ((k % 60) * 450 + 400).alias("h"), (s % 2 == 0).alias("has_label"), (s % 3 == 0).alias("has_macro"))


@query(f"WITH {PAGES} SELECT * FROM pages")
def page_layout(spark, sf_dir):
    return aperio_pages(page_slides(spark, sf_dir))


@query(
    f"""WITH {PAGES}, n AS (SELECT *, ((width + 239) // 240) * ((height + 239) // 240) AS n_tiles FROM pages)
 SELECT slide_id, page_no, n_tiles, CAST(coalesce(sum(n_tiles) OVER (PARTITION BY slide_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_tile FROM n"""
)
def page_tile_counts(spark, sf_dir):
    return tile_counts(aperio_pages(page_slides(spark, sf_dir)), 240).select("slide_id", "page_no", "n_tiles", "first_tile")


@query(
    """WITH p AS (SELECT DISTINCT l_orderkey AS slide_id, l_suppkey % 2 AS field, l_partkey % 2 AS t, l_suppkey % 3 AS z, CAST(l_linenumber AS BIGINT) AS c FROM lineitem)
 SELECT *, row_number() OVER (PARTITION BY slide_id, field ORDER BY t, z, c) - 1 AS page_no FROM p"""
)
def plane_order(spark, sf_dir):
    planes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("slide_id"), (F.col("l_suppkey") % 2).alias("field"), (F.col("l_partkey") % 2).alias("t"), (F.col("l_suppkey") % 3).alias("z"), F.col("l_linenumber").cast("bigint").alias("c"))
    return plane_pages(planes.distinct())
