"""Slide files written from pages and segments, read again: bytes, pixels, order, refusals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import jpeg_codec
from rasterloom.operators.raster import decoded, read_regions
from rasterloom.sources import slide_pages, tiff
from rasterloom.sources.datasource import register
from rasterloom.sources.storage import FormatError
from tests.test_jpeg import picture


def slide(spark, width=330, height=200, tile=64, bands=3):
    """A picture in two levels, as complete tiles and short ones at the edges."""
    big = picture(height, width, bands)
    rows, levels = [], []
    for level in (0, 1):
        px = big if level == 0 else slide_pages.resized(big, height // 4, width // 4)
        levels.append((1, level, px.shape[1], px.shape[0], 0.25 * 4**level, 40, "slide one", "sRGB", "<OME/>"))
        for y in range(0, px.shape[0], tile):
            for x in range(0, px.shape[1], tile):
                part = px[y : y + tile, x : x + tile]
                rows.append((1, level, x, y, part.shape[1], part.shape[0], bytearray(jpeg_codec.encode(part, 95))))
    names = "slide_id long, level long, width long, height long, mpp double, mag int, stem string, icc string, description string"
    return big, spark.createDataFrame(levels, names), spark.createDataFrame(rows, "slide_id long, level long, x long, y long, w long, h long, payload binary")


def segments_of(path):
    return {(r[1], r[2]): r[9] for r in tiff.rows_of(str(path), "segments")}


def test_native_levels_pass_byte_for_byte(spark, tmp_path):
    big, levels, tiles = slide(spark)
    slide_pages.write_native_ome(levels, tiles.where("not (level = 0 and x = 64 and y = 64)"), str(tmp_path), tile=64)
    path = tmp_path / "1.ome.tif"
    pages = list(tiff.rows_of(str(path), "pages"))
    assert [(p[2], p[3], p[4]) for p in pages] == [("main", 330, 200), ("level", 82, 50)] and pages[0][13] == "<OME/>"
    got = segments_of(path)
    for r in tiles.collect():
        across = 6 if r["level"] == 0 else 2
        payload = got[r["level"], r["y"] // 64 * across + r["x"] // 64]
        if (r["level"], r["x"], r["y"]) == (0, 64, 64):
            assert (jpeg_codec.decode(payload) == 255).all()  # a tile that isn't there is blank
        elif (r["w"], r["h"]) == (64, 64):
            assert payload == bytes(r["payload"])
        else:
            px = jpeg_codec.decode(payload)
            assert px.shape == (64, 64, 3) and np.abs(px[: r["h"], : r["w"]].astype(int) - jpeg_codec.decode(bytes(r["payload"]))).max() <= 4
            assert (px[r["h"] + 8 :] >= 250).all()


def test_svs_order_pixels_and_associated_pages(spark, tmp_path):
    big, levels, tiles = slide(spark)
    label = picture(20, 30, 3)
    rows = [(1, "macro", 30, 20, bytearray(jpeg_codec.encode(label))), (1, "label", 30, 20, bytearray(jpeg_codec.encode(label)))]
    extra = spark.createDataFrame(rows, "slide_id long, kind string, w long, h long, payload binary")
    slide_pages.write_svs(levels, tiles, str(tmp_path), tile=64, associated=extra, thumbnail=100, least=10)
    path = tmp_path / "1.svs"
    pages = list(tiff.rows_of(str(path), "pages"))
    assert [(p[2], p[3], p[4]) for p in pages] == [("main", 330, 200), ("thumbnail", 100, 61), ("level", 82, 50), ("level", 20, 12), ("label", 30, 20), ("macro", 30, 20)]
    assert pages[0][13].startswith("Aperio Image Library \r\n330x200 [0,0 330x200] (64x64) JPEG/RGB Q=90|AppMag = 40|Filename = slide one|MPP = 0.250000")
    assert pages[2][13].endswith("(64x64) -> 82x50 JPEG/RGB Q=90") and open(path, "rb").read(4) == b"II\x2a\x00"
    header = next(tiff.rows_of(str(path), "header"))
    assert header[14] == "aperio" and header[7] == 0.25 and header[8] == 40
    got = segments_of(path)
    for r in tiles.where("level = 1 and w = 64 and h = 64").collect():
        assert got[2, r["y"] // 64 * 2 + r["x"] // 64] == bytes(r["payload"])  # the native level of that size is copied
    small = jpeg_codec.decode(got[3, 0])[:12, :20]
    assert np.abs(small.astype(int) - slide_pages.resized(big, 12, 20)).mean() < 8
    thumb = jpeg_codec.decode(got[1, 0])
    assert thumb.shape == (61, 100, 3) and np.abs(thumb.astype(int) - slide_pages.resized(big, 61, 100)).mean() < 6
    assert (jpeg_codec.decode(got[4, 0]) == jpeg_codec.decode(jpeg_codec.encode(label))).all()
    scan = register(spark).read.format("slide_tiff").option("table", "pages").load(str(tmp_path))
    assert slide_pages.compatibility_report(scan).select("vendor", "level_count", "problems").first() == ("aperio", 3, "")


def test_fluorescence_files_and_refusals(spark, tmp_path):
    big, levels, tiles = slide(spark, bands=1)
    facts = {"modality": "fluorescence", "bit_depth": 8, "n_field": 1, "n_z": 1, "n_t": 1, "dye": "DAPI", "color": 255, "exposure": 1.5}
    one = lambda **more: spark.range(1, 2).select(F.col("id").alias("slide_id"), *(F.lit(v).alias(k) for k, v in (facts | more).items()))
    slide_pages.write_fluorescence_svs(one(), levels, tiles, str(tmp_path))
    path = tmp_path / "1.svs"
    header = next(tiff.rows_of(str(path), "header"))
    assert header[1:7] == (330, 200, 8, 1, "JPEG", "fluorescence")
    got = segments_of(path)
    px = np.concatenate([jpeg_codec.decode(got[0, 0]), jpeg_codec.decode(got[0, 1])], 1)
    assert np.abs(px[:200, :330, :].astype(int) - big).mean() < 3 and (px[210:] <= 5).all()
    assert next(tiff.rows_of(str(path), "channels"))[2:7] == ("DAPI", "DAPI", 0, 0, 255)
    for bad, code in (({"modality": "brightfield"}, "svs_not_fluorescence"), ({"bit_depth": 16}, "svs_bit_depth"), ({"n_z": 2}, "svs_axes")):
        with pytest.raises(FormatError) as e:
            slide_pages.write_fluorescence_svs(one(**bad), levels, tiles, str(tmp_path / "none"))
        assert e.value.code == code and not (tmp_path / "none").exists()


def test_failures_leave_nothing(spark, tmp_path):
    _, levels, tiles = slide(spark)
    with pytest.raises(Exception):
        slide_pages.write_native_ome(levels, tiles.union(tiles.where("x = 0")), str(tmp_path), tile=64)
    assert not list(tmp_path.iterdir())


def test_regions_of_jpeg_tiles(spark):
    big, _, tiles = slide(spark)
    regions = spark.createDataFrame([(1, 7, 50, 40, 150, 100)], "slide_id long, region_id long, rx0 long, ry0 long, rx1 long, ry1 long")
    r = read_regions(tiles.where("level = 0"), regions, bands=3).first()
    px = decoded(bytes(r["pixels"]), 60, 100, 3)
    assert np.abs(px.astype(int) - big[40:100, 50:150]).mean() < 3


def test_resizing_and_estimates(spark):
    px = np.arange(16, dtype=np.uint8).reshape(4, 4, 1)
    assert slide_pages.resized(px, 2, 2).ravel().tolist() == [2, 4, 10, 12] and (slide_pages.resized(px, 4, 4) == px).all()
    assert slide_pages.resized(np.full((7, 5, 3), 9, np.uint8), 3, 2).tolist() == [[[9] * 3] * 2] * 3
    levels = spark.createDataFrame([(1, 100, 100), (1, 25, 25)], "slide_id long, width long, height long")
    assert slide_pages.estimated_bytes(levels, 64, 1.0).first()["bytes"] == 128 * 128 + 64 * 64 + (64 << 20)
    w, h = slide_pages.fit_inside(F.lit(4000), F.lit(1000), 1024)
    assert tuple(spark.range(1).select(w, h, *slide_pages.fit_inside(F.lit(10), F.lit(5), 1024)).first()) == (1024, 256, 10, 5)
