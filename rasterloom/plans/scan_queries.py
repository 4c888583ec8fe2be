"""Scans of slide containers. The driver has none, so each query writes samples to the shared folder first.

The SQL states what the samples were made of: 24 x 18 pixels in tiles of 16 with one reduced level, in
files whose headers have known sizes. A JPEG header of three components has 31 bytes, one of one has 25."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import samples
from ..sources.datasource import register
from .registry import Registry
from .session import store_path

registry = Registry()
query = registry.query


#: Tiles of the sample slides, as the sample writers are told them.
TILES = "t AS (SELECT * FROM (VALUES (0, 0, 0, 16, 16, 40.0), (1, 16, 0, 8, 16, 40.0), (2, 0, 16, 16, 2, 40.0), (3, 16, 16, 8, 2, 40.0), (4, 0, 0, 12, 9, 20.0)) v(n, x, y, w, h, scale))"
WHOLE = "CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h, CAST(scale AS DOUBLE) AS scale, 'JPEG' AS codec"


def bigints(*names: str) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)


def sample_folder(spark: SparkSession) -> str:
    folder = store_path(register(spark), "slides").removeprefix("file://").removeprefix("file:")
    samples.write_all(folder)
    return folder


def load(spark: SparkSession, kind: str, table: str, folder: str | None = None) -> DataFrame:
    df = spark.read.format(kind).option("table", table).load(folder or sample_folder(spark))
    return df.withColumn("path", F.regexp_extract("path", "([^/]*)$", 1))


@query(
    f"""SELECT 'a.ibl' AS path, CAST((c << 20) + (r << 12) AS BIGINT) AS block_id, CAST(0 AS BIGINT) AS layer, CAST(i // 2 AS BIGINT) AS tile_row, CAST(i % 2 AS BIGINT) AS tile_col, CAST(31 AS BIGINT) AS length
  FROM range(3) AS a(c), range(2) AS b(r), range(4) AS d(i)"""
)
def scan_ibl(spark, sf_dir):
    return load(spark, "ibl", "tiles").where("layer = 0").drop("payload")


@query(
    f"""WITH {TILES} SELECT path, CAST(n AS BIGINT) AS tile_no, CAST(n // 4 AS BIGINT) AS level, {bigints('field', 'channel', 'z', 't')}, {WHOLE}, CAST(545 + n * step AS BIGINT) AS offset, CAST(31 AS BIGINT) AS length
  FROM (SELECT t.*, 0 AS field, 0 AS channel, 0 AS z, 0 AS t, path, step FROM t, (VALUES ('b.kfb', 31), ('c.kfbf', 47)) f(path, step))"""
)
def scan_kfb(spark, sf_dir):
    return load(spark, "kfb", "tiles").where("path in ('b.kfb', 'c.kfbf')").drop("payload")


@query(
    f"""WITH {TILES} SELECT 'd.kfba' AS path, CAST(CASE WHEN n < 4 THEN 2 * (4 * field + n) ELSE 16 + 2 * field END + channel AS BIGINT) AS tile_no, CAST(n // 4 AS BIGINT) AS level, {bigints('field', 'channel', 'z', 't')}, {WHOLE}, CAST(4560 + 82 * block + 25 * channel AS BIGINT) AS offset, CAST(25 AS BIGINT) AS length
  FROM (SELECT t.*, a.field, b.channel, 0 AS z, 0 AS t, 5 * a.field + n AS block FROM t, range(2) AS a(field), range(2) AS b(channel))"""
)
def scan_kfba(spark, sf_dir):
    return load(spark, "kfb", "tiles").where("path = 'd.kfba'").drop("payload")


@query(
    "SELECT 'e.kfbx' AS path, CAST(l AS BIGINT) AS level, CAST(40.0 / (1 << l) AS DOUBLE) AS scale, CAST(24 >> l AS BIGINT) AS width, CAST(18 >> l AS BIGINT) AS height, CAST(4 - 3 * l AS BIGINT) AS n_tiles FROM range(2) AS a(l)"
)
def scan_kfbx(spark, sf_dir):
    return load(spark, "kfb", "levels").where("path = 'e.kfbx'")


@query(
    f"""SELECT 'f.image' AS path, {bigints('level', 'tile_row', 'tile_col')}, CAST(256 * tile_col AS BIGINT) AS x, CAST(256 * tile_row AS BIGINT) AS y, CAST(tile_row * (2 - level) + tile_col AS BIGINT) AS row_major, CAST(tile_col * (2 - level) + tile_row AS BIGINT) AS column_major,
  CAST(172 + 31 * stored AS BIGINT) AS offset, CAST(CASE WHEN blank THEN 0 ELSE 31 END AS BIGINT) AS length, blank FROM (VALUES (0, 0, 0, 0, false), (0, 1, 0, 1, false), (0, 0, 1, 2, false), (0, 1, 1, 0, true), (1, 0, 0, 3, false)) v(level, tile_row, tile_col, stored, blank)"""
)
def scan_image(spark, sf_dir):
    return load(spark, "image_container", "tiles").drop("payload")


@query(
    f"""SELECT path, CAST(l AS BIGINT) AS page, CASE WHEN l = 0 THEN 'main' ELSE 'level' END AS kind, CAST(40 >> l AS BIGINT) AS width, CAST(24 >> l AS BIGINT) AS height, CAST(16 AS BIGINT) AS tile_w, CAST(16 AS BIGINT) AS tile_h, true AS tiled, {bigints('samples')},
  CAST(8 AS BIGINT) AS bits, CAST(1 AS BIGINT) AS compression, CAST(l AS BIGINT) AS subfile, CAST(6 - 4 * l AS BIGINT) AS n_segments, CASE WHEN l = 0 THEN 'Aperio Library' || chr(13) || chr(10) || '40x24' || said ELSE 'level 1' END AS description
  FROM range(2) AS a(l), (VALUES ('g.tif', 3, '|AppMag = 20|MPP = 0.5'), ('channel0.svs', 1, ' JPEG/Monochrome|Dye = Dye0|DisplayColor = 255|MPP = 0.5|AppMag = 20'), ('channel1.svs', 1, ' JPEG/Monochrome|Dye = Dye1|DisplayColor = 65280|MPP = 0.5|AppMag = 20')) f(path, samples, said)"""
)
def scan_tiff(spark, sf_dir):
    return load(spark, "slide_tiff", "pages")


@query(
    f"SELECT 'set.afi' AS path, {bigints('channel')}, 'channel' || channel || '.svs' AS child, 'Dye' || channel AS name, CAST(0 AS BIGINT) AS r, CAST(255 * channel AS BIGINT) AS g, CAST(255 * (1 - channel) AS BIGINT) AS b FROM range(2) AS a(channel)"
)
def scan_afi(spark, sf_dir):
    return load(spark, "afi", "channels").withColumn("child", F.regexp_extract("child", "([^/]*)$", 1))


@query(
    "SELECT name, format, CAST(idx AS BIGINT) AS idx FROM (VALUES ('a.ibl', 'ibl', 1), ('b.kfb', 'kfb', 2), ('c.kfbf', 'kfb', 3), ('d.kfba', 'kfb', 4), ('e.kfbx', 'kfb', 5), ('f.image', 'image', 6), ('g.tif', 'generic_tiff', 7), ('set.afi', 'afi', 8)) v(name, format, idx)"
)
def list_slides(spark, sf_dir):
    from ..sources.listing import inspectable_files

    return inspectable_files(spark, sample_folder(spark)).select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "format", "idx")


@query(
    """SELECT DISTINCT ((vec_id // 20) * 8) // 80 || '.tif' AS path, CAST(0 AS BIGINT) AS page, 'main' AS kind, CAST(160 AS BIGINT) AS width, CAST(80 AS BIGINT) AS height, CAST(8 AS BIGINT) AS tile_w, CAST(8 AS BIGINT) AS tile_h, true AS tiled,
  CAST(1 AS BIGINT) AS samples, CAST(8 AS BIGINT) AS bits, CAST(8 AS BIGINT) AS compression, CAST(0 AS BIGINT) AS subfile, CAST(200 AS BIGINT) AS n_segments FROM embeddings"""
)
def write_and_scan_tiff(spark, sf_dir):
    """Tiles written as TIFF files and read again."""
    from ..sources.sinks import write_tiff
    from .raster_queries import tiles_of

    tiles = tiles_of(spark, sf_dir).withColumns({"slide_id": F.call_function("div", F.col("y"), F.lit(80).cast("bigint")), "y": F.col("y") % 80, "width": F.lit(160), "height": F.lit(80), "tile": F.lit(8)})
    folder = store_path(register(spark), "tiff").removeprefix("file://").removeprefix("file:")
    write_tiff(tiles, folder)
    return load(spark, "slide_tiff", "pages", folder).drop("description")


def jpeg_slides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Levels and JPEG tiles of slides of 160 x 80 grey pixels in tiles of 8, with a level of half the size."""
    from ..operators.raster import reduce_level
    from ..sources.slide_pages import encoded_tiles
    from .raster_queries import tiles_of

    raw = tiles_of(spark, sf_dir).withColumns({"slide_id": F.call_function("div", F.col("y"), F.lit(80).cast("bigint")), "y": F.col("y") % 80})
    tiles = encoded_tiles(raw, quality=95).unionByName(encoded_tiles(reduce_level(raw, tile=8), quality=95))
    slide = raw.select("slide_id").distinct().select("slide_id", F.lit(0.5).alias("mpp"), F.lit(20).alias("mag"), F.concat(F.lit("slide"), F.col("slide_id").cast("string")).alias("stem"), F.lit("none").alias("icc"), F.lit("<OME/>").alias("description"))
    both = F.explode(F.array(*(F.struct(F.lit(i).cast("bigint").alias("level"), F.lit(160 >> i).cast("bigint").alias("width"), F.lit(80 >> i).cast("bigint").alias("height")) for i in (0, 1)))).alias("l")
    return slide.select("*", both).select("*", "l.*").drop("l"), tiles


def scanned(spark, folder: str) -> DataFrame:
    return load(spark, "slide_tiff", "pages", folder).select("path", "page", "kind", "width", "height", "tile_w", "tiled", "samples", "compression", "subfile", "n_segments")


def target(spark: SparkSession, name: str) -> str:
    return store_path(register(spark), name).removeprefix("file://").removeprefix("file:")


@query(
    f"""WITH s AS (SELECT DISTINCT ((vec_id // 20) * 8) // 80 AS slide FROM embeddings)
 SELECT slide || '.ome.tif' AS path, {bigints('page')}, kind, {bigints('width', 'height', 'tile_w')}, true AS tiled, CAST(1 AS BIGINT) AS samples, CAST(7 AS BIGINT) AS compression, CAST(page AS BIGINT) AS subfile, {bigints('n_segments')}
  FROM s, (VALUES (0, 'main', 160, 80, 8, 200), (1, 'level', 80, 40, 8, 50)) v(page, kind, width, height, tile_w, n_segments)"""
)
def native_ome_pages(spark, sf_dir):
    """Every native level in one file, complete tiles byte for byte; read again."""
    from ..sources.slide_pages import write_native_ome

    folder = target(spark, "ome")
    levels, tiles = jpeg_slides(spark, sf_dir)
    write_native_ome(levels, tiles, folder, tile=8, bands=1)
    return scanned(spark, folder)


@query(
    f"""WITH s AS (SELECT DISTINCT ((vec_id // 20) * 8) // 80 AS slide FROM embeddings)
 SELECT slide || '.svs' AS path, {bigints('page')}, kind, {bigints('width', 'height', 'tile_w')}, tiled, CAST(1 AS BIGINT) AS samples, CAST(7 AS BIGINT) AS compression, CAST(0 AS BIGINT) AS subfile, {bigints('n_segments')}
  FROM s, (VALUES (0, 'main', 160, 80, 8, true, 200), (1, 'thumbnail', 64, 32, 64, false, 1), (2, 'level', 40, 20, 8, true, 15), (3, 'level', 10, 5, 8, true, 2), (4, 'level', 5, 2, 8, true, 1)) v(page, kind, width, height, tile_w, tiled, n_segments)"""
)
def svs_pages(spark, sf_dir):
    """Main page, thumbnail and reduced levels from the nearest native level, in their order; read again."""
    from ..sources.slide_pages import write_svs

    folder = target(spark, "svs")
    levels, tiles = jpeg_slides(spark, sf_dir)
    write_svs(levels, tiles, folder, tile=8, bands=1, thumbnail=64, least=2)
    return scanned(spark, folder)


@query(
    f"""WITH s AS (SELECT DISTINCT ((vec_id // 20) * 8) // 80 AS slide FROM embeddings)
 SELECT slide || '.svs' AS path, {bigints('page')}, kind, {bigints('width', 'height')}, CAST(16 AS BIGINT) AS tile_w, true AS tiled, CAST(1 AS BIGINT) AS samples, CAST(7 AS BIGINT) AS compression, CAST(page AS BIGINT) AS subfile, {bigints('n_segments')}
  FROM s, (VALUES (0, 'main', 160, 80, 50), (1, 'level', 80, 40, 15)) v(page, kind, width, height, n_segments)"""
)
def fluorescence_svs_pages(spark, sf_dir):
    """Single-channel files with tiles of another size than the source's; read again."""
    from ..sources.slide_pages import write_fluorescence_svs

    folder = target(spark, "fluorescence")
    levels, tiles = jpeg_slides(spark, sf_dir)
    slides = levels.where("level = 0").select("slide_id", F.lit("fluorescence").alias("modality"), F.lit(8).alias("bit_depth"), *(F.lit(1).alias(c) for c in ("n_field", "n_z", "n_t")), F.lit("DAPI").alias("dye"), F.lit(255).alias("color"), F.lit(1.5).alias("exposure"))
    write_fluorescence_svs(slides, levels, tiles, folder, tile=16)
    return scanned(spark, folder)
