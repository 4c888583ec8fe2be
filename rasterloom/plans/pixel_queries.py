"""Queries over pixels: an embedding of 64 values stands for an 8x8 tile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import display_lut, hex_colour, over_white, pack_rgba, padded, parse_hex_colour, quantised, to_display_floored, to_display_rounded, transposed, unpack_rgba
from ..operators.quality import composed, geometry_overlap, roi_quality as quality_of
from .registry import Registry, table

registry = Registry()
query = registry.query

#: Pixels of 8 bits, and of 12 bits, in DuckDB.
Q8 = "q AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(round_even((CAST(v AS DOUBLE) + 1) * 127.5, 0) AS BIGINT)) AS px FROM embeddings)"
Q12 = "q AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(round_even((CAST(v AS DOUBLE) + 1) * 2047.5, 0) AS BIGINT)) AS px FROM embeddings)"
EACH = "e AS (SELECT vec_id, label, i, px[i + 1] AS v FROM (SELECT *, unnest(range(0, 64)) AS i FROM q))"


def tiles(spark, sf_dir, top: int = 255) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", quantised("embedding", top).alias("px"))


def each(df: DataFrame, pixels: str = "px", name: str = "v") -> DataFrame:
    return df.select(*[c for c in df.columns if c != pixels], F.posexplode(pixels).alias("i", name)).withColumn("i", F.col("i").cast("bigint"))


@query(
    f"""WITH {Q12}, {EACH}, n AS (SELECT vec_id, i, greatest(0.0, least(1.0, (v - 100.0) / 3900.0)) AS x FROM e), c AS (SELECT vec_id, i, greatest(0.0, least(1.0, (x - 0.5) * 1.2 + 0.5 + 0.05)) AS x FROM n)
 SELECT vec_id, i, CAST(round_even(power(x, 1.0 / 2.2) * 255, 0) AS BIGINT) AS out FROM c"""
)
def lut(spark, sf_dir):
    shown = tiles(spark, sf_dir, 4095).select("vec_id", display_lut("px", black=100.0, white=4000.0, contrast=1.2, brightness=0.05, gamma=2.2).alias("px"))
    return each(shown, name="out")


COLOURS = "CASE vec_id % 3 WHEN 0 THEN {} WHEN 1 THEN {} ELSE {} END"
R, G, B = COLOURS.format(255, 0, 64), COLOURS.format(0, 255, 64), COLOURS.format(32, 16, 255)


def colour(values: tuple[int, int, int]):
    k = F.col("vec_id") % 3
    return F.when(k == 0, values[0]).when(k == 1, values[1]).otherwise(values[2])


def composition(spark, sf_dir, mode: str) -> DataFrame:
    planes = each(tiles(spark, sf_dir)).withColumns({"r": colour((255, 0, 64)), "g": colour((0, 255, 64)), "b": colour((32, 16, 255)), "image": F.call_function("div", F.col("vec_id"), F.lit(3).cast("bigint"))})
    return composed(planes, ["image", "i"], mode)


def composition_sql(how: str) -> str:
    parts = ", ".join(f"CAST(greatest(0, least(255, round_even({how}(v * ({c})) / 255.0, 0))) AS BIGINT) AS {n}" for n, c in (("r", R), ("g", G), ("b", B)))
    return f"WITH {Q8}, {EACH} SELECT vec_id // 3 AS image, i, {parts} FROM e GROUP BY 1, 2"


@query(composition_sql("sum"))
def compose_sum(spark, sf_dir):
    return composition(spark, sf_dir, "sum")


@query(composition_sql("max"))
def compose_max(spark, sf_dir):
    return composition(spark, sf_dir, "max")


@query(f"WITH {Q12}, {EACH} SELECT vec_id, i, CAST(round_even(greatest(0.0, least(1.0, CAST(v AS DOUBLE) / 4095)) * 255, 0) AS BIGINT) AS rounded, v * 255 // 4095 AS floored FROM e")
def bitdepth_scale(spark, sf_dir):
    return each(tiles(spark, sf_dir, 4095)).select("vec_id", "i", to_display_rounded("v", 4095).alias("rounded"), to_display_floored("v", 4095).alias("floored"))


@query(f"WITH {Q8}, {EACH} SELECT vec_id, i, CAST(trunc(v * ((label % 5) / 4.0) + 255.0 * (1.0 - (label % 5) / 4.0)) AS BIGINT) AS out FROM e")
def alpha_over_white(spark, sf_dir):
    return each(tiles(spark, sf_dir)).select("vec_id", "i", over_white("v", (F.col("label") % 5) / F.lit(4.0)).alias("out"))


@query(f"WITH {Q8} SELECT vec_id, i, px[(i % 8) * 8 + i // 8 + 1] AS v FROM (SELECT *, unnest(range(0, 64)) AS i FROM q)")
def tile_transpose(spark, sf_dir):
    return each(tiles(spark, sf_dir).select("vec_id", transposed("px", 8, 8).alias("px")))


@query(
    f"WITH {Q8} SELECT vec_id, i, CASE WHEN i % 16 < 8 - label % 3 AND i // 16 < 8 - label % 2 THEN px[(i // 16) * (8 - label % 3) + i % 16 + 1] ELSE 255 END AS v FROM (SELECT *, unnest(range(0, 256)) AS i FROM q)"
)
def tile_pad(spark, sf_dir):
    rows = tiles(spark, sf_dir)
    return each(rows.select("vec_id", padded("px", F.lit(8) - F.col("label") % 3, F.lit(8) - F.col("label") % 2, 16, 255).alias("px")))


CANDIDATE = "least(255, v + i % (label + 1))"


@query(
    f"""WITH {Q8}, {EACH}, p AS (SELECT vec_id, CAST(v AS DOUBLE) AS a, CAST({CANDIDATE} AS DOUBLE) AS b FROM e),
 s AS (SELECT vec_id, avg((a - b) * (a - b)) AS mse, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS cab FROM p GROUP BY vec_id)
 SELECT vec_id, round(mse, 6) AS mse, CASE WHEN mse > 0 THEN round(10 * log10(65025.0 / mse), 6) WHEN mse = 0 THEN CAST('Infinity' AS DOUBLE) END AS psnr,
        round((2 * ma * mb + 6.5025) * (2 * cab + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225)), 6) AS ssim FROM s"""
)
def roi_quality(spark, sf_dir):
    pairs = each(tiles(spark, sf_dir)).withColumn("b", F.least(F.lit(255), F.col("v") + F.col("i") % (F.col("label") + 1)))
    return quality_of(pairs, "vec_id", "v", "b")


@query(
    f"""WITH {Q8}, {EACH}, m AS (SELECT vec_id, abs(v - 128) > 12 AS a, abs({CANDIDATE} - 128) > 12 AS b FROM e),
 s AS (SELECT vec_id, count_if(a AND b) AS shared, count_if(a OR b) AS any_, count_if(a <> b) AS one FROM m GROUP BY vec_id)
 SELECT vec_id, round(CASE WHEN any_ = 0 THEN 1.0 ELSE shared / any_ END, 9) AS iou, round(CASE WHEN any_ = 0 THEN 0.0 ELSE one / any_ END, 9) AS xor_ratio,
        CASE WHEN any_ = 0 THEN 1.0 ELSE shared / any_ END >= 0.75 AND CASE WHEN any_ = 0 THEN 0.0 ELSE one / any_ END <= 0.25 AS passed FROM s"""
)
def occupancy_iou(spark, sf_dir):
    pairs = each(tiles(spark, sf_dir)).withColumn("b", F.least(F.lit(255), F.col("v") + F.col("i") % (F.col("label") + 1)))
    return geometry_overlap(pairs, "vec_id", "v", "b", background=128, tolerance=12)


@query(
    """WITH c AS (SELECT p_partkey AS id, (p_size * 5) % 256 AS r, p_partkey % 256 AS g, (p_partkey * 7) % 256 AS b FROM part), p AS (SELECT *, (CAST(r AS BIGINT) << 24) | (CAST(g AS BIGINT) << 16) | (CAST(b AS BIGINT) << 8) | 255 AS u FROM c)
 SELECT id, CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END AS packed, CAST(r AS BIGINT) AS r, CAST(g AS BIGINT) AS g, CAST(b AS BIGINT) AS b, printf('#%02X%02X%02X', r, g, b) AS hex FROM p"""
)
def colour_pack(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_size") * 5) % 256).alias("r"), (F.col("p_partkey") % 256).alias("g"), ((F.col("p_partkey") * 7) % 256).alias("b"))
    rows = rows.select("id", pack_rgba("r", "g", "b").alias("packed"), hex_colour("r", "g", "b").alias("hex"))
    r, g, b = parse_hex_colour("hex")
    _, g2, b2, _ = unpack_rgba("packed")
    # the way back from either form gives the same colour
    return rows.select("id", "packed", "hex", r.alias("r"), F.when(g == g2, g).alias("g"), F.when(b == b2, b).alias("b"))
