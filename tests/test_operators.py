"""Exact vectors and properties of the operators."""

import random

import pytest
from pyspark.sql import functions as F

from rasterloom.functions.pixels import display_lut, over_white, pack_rgba, padded, transposed, unpack_rgba
from rasterloom.functions.text import LENGTH_UNITS, TIME_UNITS, aperio_description, channel_suffix, converted, file_format, little_endian, number_or_null, objective_power, output_path, payload_codec, pixel_size, safe_component
from rasterloom.functions.geometry import bytes_estimate
from rasterloom.operators.joins import nearest_of, overlap_join
from rasterloom.operators.levels import fixed_levels, halving_levels, level_extents, preview_choice
from rasterloom.operators.planner import modality, stale
from rasterloom.operators.quality import composed, composed_floor, geometry_overlap, roi_quality
from rasterloom.operators.raster import decoded, encode_tiles, read_regions, reduce_level, tile_grid
from rasterloom.operators.windows import block_ownership, greedy_names, suffixed_names, take_until


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_fixed_levels_vector(spark):
    df = fixed_levels(spark.createDataFrame([(1, 158159, 61614), (2, 700, 600), (3, 400, 400)], "slide_id long, w long, h long"), "w", "h")
    assert rows(df, "slide_id", "factor") == [(1, 4, 39539, 15403), (1, 16, 9884, 3850), (1, 32, 4942, 1925), (2, 4, 175, 150)]


def test_halving_keeps_the_first_small_level(spark):
    df = halving_levels(spark.createDataFrame([(1, 2001, 1500), (2, 400, 400)], "slide_id long, w long, h long"), "w", "h")
    assert rows(df, "level_no") == [(1, 1, 1001, 750), (1, 2, 501, 375)]


def test_bigtiff_vectors(spark):
    def estimate(per_pixel_main, per_pixel_rest):
        sizes = [(50000, per_pixel_main), (12500, per_pixel_rest), (3125, per_pixel_rest), (1562, per_pixel_rest)]
        return one(spark, sum((bytes_estimate(F.lit(s), F.lit(s), 240, 1) * b for s, b in sizes), F.lit(0)) + 67108864)[0]

    assert estimate(0.5, 0.4) < 3.2e9 < estimate(1.6, 1.6)


def test_viewer_prefix_vector(spark):
    levels = [(k, -(-15750 // 2**k), -(-26639 // 2**k)) for k in range(11)]
    df = spark.createDataFrame([(1, *x) for x in levels], "slide_id long, level_no long, width long, height long")
    hit = (F.col("level_no") > 0) & (F.ceil(F.col("width") / 256) <= 2) & (F.ceil(F.col("height") / 256) <= 2)
    assert take_until(df, by=["slide_id"], order=["level_no"], hit=hit).count() == 7


def test_preview_level_vector(spark):
    df = spark.createDataFrame([(1, k, s * 256, s * 256) for k, s in enumerate((16, 8, 4, 2))], "slide_id long, level_no long, width long, height long")
    assert preview_choice(df).first()["preview_level"] == 1


def test_ownership_vector(spark):
    df = spark.createDataFrame([(0, i, 0, i, 6 * i, 0, 6 * i + 8, 8) for i in range(3)], "slide_id long, block_id long, grid_row long, grid_col long, x0 long, y0 long, x1 long, y1 long")
    own = {r["block_id"]: (r["own_x0"], r["own_x1"]) for r in block_ownership(df).collect()}
    assert own == {0: (0, 7), 1: (7, 13), 2: (13, 20)}


def test_lookup_vector(spark):
    blocks = spark.createDataFrame([(i, i * 4, 0, i * 4 + 8, 8) for i in range(12)], "b long, x0 long, y0 long, x1 long, y1 long")
    region = spark.createDataFrame([(39, 0, 41, 8)], "rx0 long, ry0 long, rx1 long, ry1 long")
    df = overlap_join(blocks, region, on=[], left_box=("x0", "y0", "x1", "y1"), right_box=("rx0", "ry0", "rx1", "ry1"), bin_size=5)
    assert sorted(r["b"] for r in df.collect()) == [8, 9, 10]


def test_overlap_join_equals_nested_loop(spark):
    rng = random.Random(4)

    def boxes(n):
        out = []
        for i in range(n):
            x, y = rng.randrange(200), rng.randrange(200)
            out.append((i, x, y, x + rng.randrange(0, 60), y + rng.randrange(0, 60)))
        return out

    a, b = boxes(80), boxes(80)
    left = spark.createDataFrame(a, "i long, x0 long, y0 long, x1 long, y1 long")
    right = spark.createDataFrame(b, "j long, u0 long, v0 long, u1 long, v1 long")
    found = overlap_join(left, right, on=[], left_box=("x0", "y0", "x1", "y1"), right_box=("u0", "v0", "u1", "v1"), bin_size=17).select("i", "j").collect()
    want = {(p[0], q[0]) for p in a for q in b if max(p[1], q[1]) < min(p[3], q[3]) and max(p[2], q[2]) < min(p[4], q[4])}
    assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_greedy_names(spark):
    files = spark.createDataFrame([(1, "out", "sample", ".ome.tif"), (2, "out", "sample", ".ome.tif"), (3, "out", "sample_1", ".ome.tif"), (4, "out", "sample", ".ome.tif")], "idx int, folder string, stem string, suffix string")
    got = {r["idx"]: r["name"] for r in greedy_names(files, folder="folder", stem="stem", suffix="suffix", order="idx").collect()}
    assert got == {1: "sample.ome.tif", 2: "sample_1.ome.tif", 3: "sample_1_1.ome.tif", 4: "sample_2.ome.tif"}
    simple = {r["idx"]: r["name"] for r in suffixed_names(files.where("idx < 3"), folder="folder", stem="stem", suffix="suffix", order=["idx"]).collect()}
    assert simple == {1: "sample.ome.tif", 2: "sample_1.ome.tif"}


def test_lut_and_composition_vectors(spark):
    px = lambda *v: F.array(*map(F.lit, v))
    assert one(spark, display_lut(px(0, 128, 255)))[0] == [0, 128, 255]
    assert one(spark, display_lut(px(0, 2048, 4095), white=4095.0))[0] == [0, 128, 255]
    planes = spark.createDataFrame([(0, 100, 255, 0, 0), (0, 200, 0, 255, 0)], "p int, v int, r int, g int, b int")
    assert tuple(composed(planes, ["p"], "sum").first())[1:] == (100, 200, 0)
    white = spark.createDataFrame([(0, 100, 255, 255, 255), (0, 200, 255, 255, 255)], "p int, v int, r int, g int, b int")
    assert tuple(composed(white, ["p"], "max").first())[1:] == (200, 200, 200)
    assert tuple(composed_floor(spark.createDataFrame([(0, 100, 128, 0, 1)], "p int, v int, r int, g int, b int"), ["p"]).first())[1:] == (50, 0, 0)


def test_units(spark):
    got = one(spark, converted(F.lit(250.0), F.lit("nm"), LENGTH_UNITS), converted(F.lit(0.00025), F.lit("mm"), LENGTH_UNITS), converted(F.lit(4.05e-7), F.lit("m"), LENGTH_UNITS) * 1000, converted(F.lit(461000.0), F.lit("pm"), LENGTH_UNITS) * 1000, converted(F.lit(12.0), F.lit("ms"), TIME_UNITS), converted(F.lit(2.0), F.lit("µm"), LENGTH_UNITS))
    assert [round(x, 9) for x in got] == [0.25, 0.25, 405.0, 461.0, 0.012, 2.0]


def test_names_and_descriptions(spark):
    safe = ["a<>b", " DAPI / Hoechst ", "..", "x\t\ty"]
    got = one(spark, *(safe_component(F.lit(x)) for x in safe), channel_suffix(F.lit(0), F.lit("DAPI")), channel_suffix(F.lit(1), F.lit("FITC"), F.lit("unknown")))
    assert tuple(got) == ("a_b", "DAPI___Hoechst", "", "x_y", "C01_DAPI", "C02")
    texts = ["openslide.objective-power = 20", "Objective = 40", "AppMag: 40", "x|magnification=2.5", "AppMag = 39.6|MPP = 0.25 um", "  MPP=0.5", "XMPP = 0.5", ""]
    got = [one(spark, objective_power(F.lit(x)), pixel_size(F.lit(x))) for x in texts]
    assert [tuple(r) for r in got] == [(20, 0.0), (0, 0.0), (0, 0.0), (2, 0.0), (40, 0.25), (0, 0.5), (0, 0.0), (0, 0.0)]
    sizes = [(0.2, 0.4), (0.2, 0.0), (0.0, 0.4), (0.0, 0.0)]
    assert [round(one(spark, pixel_size(F.lit("MPP = 1"), F.lit(x), F.lit(y)))[0], 9) for x, y in sizes] == [0.3, 0.2, 0.4, 1.0]
    assert tuple(one(spark, *(number_or_null(F.lit(x)) for x in ("", "0", "0.0", "1.5", None)))) == (None, None, None, 1.5, None)
    named = (F.lit(40), F.lit("a b"), F.lit(0.25), F.lit("sRGB"))
    main = one(spark, aperio_description("Lib", F.lit(10), F.lit(20), F.lit(240), F.lit("JPEG/RGB Q=90"), *named))[0]
    assert main == "Lib \r\n10x20 [0,0 10x20] (240x240) JPEG/RGB Q=90|AppMag = 40|Filename = a b|MPP = 0.250000|DisplayColor = 0|OriginalWidth = 10|OriginalHeight = 20|ICC Profile = sRGB"


def test_display_curve_refuses_nonsense(spark):
    for bad in ({"black": 5, "white": 5}, {"gamma": 0}):
        with pytest.raises(ValueError):
            display_lut(F.array(F.lit(1)), **bad)
    got = one(spark, display_lut(F.array(F.lit(0), F.lit(255)), contrast=-2.0), display_lut(F.array(F.lit(0.0), F.lit(0.25)), white=0.5))
    assert got[0] == [128, 128] and got[1] == [0, 128]


def test_deep_samples(spark):
    tiles = encode_tiles(spark.createDataFrame([(1, 0, 0, 0, 2, 2, [0, 1000, 4095, 65535])], "slide_id long, level long, x long, y long, w long, h long, px array<long>"), "px", bits=16)
    region = spark.createDataFrame([(1, 5, 1, 0, 3, 2)], "slide_id long, region_id long, rx0 long, ry0 long, rx1 long, ry1 long")
    r = read_regions(tiles, region, background=7, bits=16).first()
    assert decoded(bytes(r["pixels"]), 2, 2).ravel().tolist() == [1000, 7, 65535, 7]
    small = reduce_level(tiles, tile=2, bits=16).first()
    assert decoded(bytes(small["payload"]), 1, 1).ravel().tolist() == [17658]


def test_levels_of_a_slide_stay_apart(spark):
    tiles = encode_tiles(spark.createDataFrame([(1, level, 0, 0, 2, 2, [10 * level] * 4) for level in (1, 2)], "slide_id long, level long, x long, y long, w long, h long, px array<long>"), "px")
    got = rows(reduce_level(tiles, tile=2).select("level", "payload"), "level")
    assert [(level, decoded(p, 1, 1).ravel().tolist()) for level, p in got] == [(2, [10]), (3, [20])]


def test_text_functions(spark):
    got = one(spark, safe_component(F.lit(" ._a<b>  c?._")), channel_suffix(F.lit(3), F.lit("..")), channel_suffix(F.lit(3), F.lit("DA PI")), output_path(F.lit("o"), F.lit("d/s.ome.tif"), F.lit(".svs")), output_path(F.lit("o"), F.lit("d/.tif"), F.lit(".svs")), file_format(F.lit("A.KFBX")), objective_power(F.lit("x|AppMag = 20.5|")), objective_power(F.lit("none")))
    assert tuple(got) == ("a_b__c", "C04", "C04_DA_PI", "o/d/s.ome.svs", "o/d/.tif.svs", "kfb", 20, 0)
    raw = F.lit(bytearray(b"\xff\xd8\x01\x02\x03\x04"))
    assert tuple(one(spark, little_endian(raw, 2, 4), payload_codec(raw), payload_codec(F.lit(bytearray(b"\xff\x0a"))), payload_codec(F.lit(bytearray(b"ab"))))) == (0x04030201, "JPEG", "JXL", None)


def test_pixel_functions(spark):
    px = F.array(*map(F.lit, range(6)))
    assert one(spark, transposed(px, 3, 2))[0] == [0, 3, 1, 4, 2, 5]
    assert one(spark, padded(F.transform(px, lambda v: v.cast("bigint")), F.lit(3), F.lit(2), 4, 9))[0] == [0, 1, 2, 9, 3, 4, 5, 9, 9, 9, 9, 9, 9, 9, 9, 9]
    assert one(spark, over_white(F.lit(100), F.lit(0.5)))[0] == 177
    assert one(spark, pack_rgba(F.lit(255), F.lit(1), F.lit(2)))[0] == 0xFF0102FF - (1 << 32)
    assert tuple(one(spark, *unpack_rgba(pack_rgba(F.lit(255), F.lit(1), F.lit(2))))) == (255, 1, 2, 255)


def test_quality_of_equal_images(spark):
    df = spark.createDataFrame([(0, i, i) for i in range(64)], "k int, a int, b int")
    assert tuple(roi_quality(df, "k", "a", "b").first()) == (0, 0.0, float("inf"), 1.0)
    empty = spark.createDataFrame([(0, 128, 128)], "k int, a int, b int")
    assert tuple(geometry_overlap(empty, "k", "a", "b", background=128).first()) == (0, 1.0, 0.0, True)


def test_nearest_level_prefers_the_first(spark):
    assert one(spark, nearest_of(F.lit(15), F.lit(10), [(20, 10), (10, 10), (40, 10)]))[0] == 0


def test_levels_by_scale(spark):
    tiles = spark.createDataFrame([(1, 40.0, 0, 0, 16, 16), (1, 40.0, 16, 16, 8, 2), (1, 20.0, 0, 0, 12, 9)], "slide_id long, scale double, x long, y long, w long, h long")
    assert [(r["level_no"], r["width"], r["height"]) for r in level_extents(tiles).orderBy("level_no").collect()] == [(0, 24, 18), (1, 12, 9)]


def test_stale_and_modality(spark):
    files = spark.createDataFrame([("a", 1, 2), ("b", 1, 3), ("c", 1, 1)], "path string, file_size long, mtime_ns long")
    known = spark.createDataFrame([("a", 1, 2), ("b", 1, 2)], "path string, file_size long, mtime_ns long")
    assert {r["path"]: r["changed"] for r in stale(files, known).collect()} == {"a": False, "b": True, "c": True}
    tiles = spark.createDataFrame([(1, 2, 0, 1), (1, 2, 1, 1), (2, 0, 0, 3), (3, 0, 0, 1)], "slide_id long, n_channels long, channel long, samples long")
    assert dict(map(tuple, modality(tiles).collect())) == {1: "fluorescence", 2: "brightfield", 3: "unknown"}


def test_regions_equal_paste(spark):
    tiles = [(0, 0, c * 4, r * 4, 4, 4, [(r * 40 + c * 20 + i) % 256 for i in range(16)]) for r in range(2) for c in range(2)]
    df = encode_tiles(spark.createDataFrame(tiles, "slide_id long, level long, x long, y long, w long, h long, px array<int>"), "px")
    regions = spark.createDataFrame([(0, 1, 2, 2, 7, 5), (0, 2, 100, 100, 102, 101)], "slide_id long, region_id long, rx0 long, ry0 long, rx1 long, ry1 long")
    got = {r["region_id"]: decoded(r["pixels"], r["h"], r["w"])[:, :, 0].tolist() for r in read_regions(df, regions, bin_size=3).collect()}
    canvas = [[0] * 8 for _ in range(8)]
    for _, _, x, y, _, _, px in tiles:
        for i, v in enumerate(px):
            canvas[y + i // 4][x + i % 4] = v
    assert got[1] == [row[2:7] for row in canvas[2:5]]
    assert got[2] == [[255, 255]]
    small = reduce_level(df, tile=4).collect()
    assert len(small) == 1
    px = decoded(small[0]["payload"], 4, 4)[:, :, 0]
    assert px[0, 0] == round((canvas[0][0] + canvas[0][1] + canvas[1][0] + canvas[1][1]) / 4)


def test_tile_order(spark):
    grid = tile_grid(spark.createDataFrame([(1, 32, 16)], "id int, width int, height int"), 8)
    assert [(r["x"], r["y"]) for r in grid.orderBy("tile_no").collect()] == [(x, y) for y in (0, 8) for x in (0, 8, 16, 24)]
