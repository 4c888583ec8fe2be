"""Containers: what scans return, filters that reach the reader, and a code for each kind of damage."""

import os

import pytest
from pyspark.sql import functions as F

from rasterloom.sources import afi, ibl, image_container, kfb, samples, tiff
from rasterloom.sources.datasource import register
from rasterloom.sources.jpeg import baseline_size, codec_of, frame_header
from rasterloom.sources.listing import inspectable_files
from rasterloom.sources.storage import FormatError


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("slides"))
    samples.write_all(path)
    return path


def code(call):
    with pytest.raises(FormatError) as e:
        list(call())
    return e.value.code


def test_ibl(spark, folder):
    register(spark)
    read = lambda t: spark.read.format("ibl").option("table", t).load(folder)
    head = read("header").first()
    assert (head["background_color"], head["total_img_width"], head["total_img_height"]) == (255, 20, 14)
    assert [(r["grid_row"], r["grid_col"], r["x1"]) for r in read("blocks").orderBy("grid_row", "grid_col").limit(3).collect()] == [(0, 0, 8), (0, 1, 14), (0, 2, 20)]
    tiles = read("tiles").where("layer = 0")
    assert tiles.count() == 24
    assert read("tiles").where(F.col("block_id").isin(0, 4096)).count() == 10
    assert {r["name"] for r in read("associated").collect()} == {"macro", "label"}
    meta = read("metadata").first()
    assert (meta["device_no"], meta["scan_time"], meta["packet_time"], meta["scan_duration"]) == ("D1", 77, "2024-01-01 00:00:00", "60")


def test_ibl_without_tables(tmp_path):
    import sqlite3

    path = str(tmp_path / "x.ibl")
    sqlite3.connect(path).execute("CREATE TABLE other (a)").connection.commit()
    assert code(lambda: ibl.rows_of(path, "header")) == "required_table_missing"


@pytest.mark.parametrize("magic, version, packed", [(b"KFB\x00", 1.0, False), (b"KFB\x00", 2.0, False), (b"KFBL", 2.2, False), (b"KFBF", 1.9, False), (b"KFBF", 2.1, False), (b"KFB\x00", 2.0, True), (b"KFBF", 2.3, True)])
def test_kfb_layouts(tmp_path, magic, version, packed):
    path = str(tmp_path / "x.kfb")
    samples.write_kfb(path, magic=magic, version=version, packed=packed)
    rows = list(kfb.rows_of(path, "tiles"))
    assert [(r[2], *r[7:11]) for r in rows] == [(0, 0, 0, 16, 16), (0, 16, 0, 8, 16), (0, 0, 16, 16, 2), (0, 16, 16, 8, 2), (1, 0, 0, 12, 9)]
    assert all(frame_header(r[-1]).width == r[9] for r in rows)
    assert list(kfb.rows_of(path, "levels")) == [(path, 0, 40.0, 24, 18, 4), (path, 1, 20.0, 12, 9, 1)]
    assert [r[1:4] for r in kfb.rows_of(path, "associated")] == [("macro", 64, 24)]
    assert [r[1:] for r in kfb.rows_of(path, "metadata")] == [(7, "Scanner One", "text"), (9, "5", "uint"), (11, "0102ff", "hex")]


def test_kfb_damage(tmp_path):
    path = str(tmp_path / "x.kfbf")
    samples.write_kfb(path, magic=b"KFBF", version=2.1, wrong_length=True)
    assert code(lambda: kfb.rows_of(path, "tiles")) == "tile_length_mismatch"
    samples.write_kfb(path, version=9.0)
    assert code(lambda: kfb.rows_of(path, "tiles")) == "unsupported_version"
    samples.write_kfb(path, cut=True)
    assert code(lambda: kfb.rows_of(path, "tiles")) in ("index_layout_invalid", "invalid_index_offset", "compressed_index_truncated", "read_out_of_bounds")
    with open(path, "wb") as f:
        f.write(b"?" * 200)
    assert code(lambda: kfb.rows_of(path, "tiles")) == "unknown_container"
    with open(path, "wb") as f:
        f.write(b"short")
    assert code(lambda: kfb.rows_of(path, "tiles")) == "header_truncated"


def test_kfba(tmp_path):
    path = str(tmp_path / "x.kfba")
    samples.write_kfba(path)
    rows = list(kfb.rows_of(path, "tiles"))
    assert len(rows) == 20 and {(r[2], r[3], r[4]) for r in rows} == {(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)}
    assert [(r[3], r[5:8], r[8], r[9]) for r in kfb.rows_of(path, "channels")] == [("Red", (255, 0, 0), 1.5, "source_metadata"), ("Channel 2", (0, 255, 0), 2.5, "unknown")]
    samples.write_kfba(path, drop_item=True)
    assert code(lambda: kfb.rows_of(path, "tiles")) == "kfba_required_item_missing"


def test_kfbx_levels_by_magnification(folder):
    assert [r[1:5] for r in kfb.rows_of(os.path.join(folder, "e.kfbx"), "levels")] == [(0, 40.0, 24, 18), (1, 20.0, 12, 9)]


def test_image_index_order(tmp_path, folder):
    path = os.path.join(folder, "f.image")
    rows = [r for r in image_container.rows_of(path, "tiles") if r[1] == 0]
    assert [(r[3], r[2], r[7]) for r in rows] == [(0, 0, 0), (1, 0, 2), (0, 1, 1), (1, 1, 3)]
    assert [r[10] for r in rows] == [False, False, False, True]
    head = next(image_container.rows_of(path, "header"))
    assert head[1:3] == (512, 512) and head[6:10] == ("2024-01-01 10:00:00", "DEV1", "医院", "C-17")
    bad = str(tmp_path / "x.image")
    samples.write_image(bad, bad_tail=True)
    assert code(lambda: image_container.rows_of(bad, "header")) == "tail_invalid"


def test_tiff(tmp_path):
    path = str(tmp_path / "x.tif")
    samples.write_tiff(path, description="Aperio Library\r\nx|AppMag = 20|MPP = 0.5")
    head = next(tiff.rows_of(path, "header"))
    assert head[1:10] == (40, 24, 8, 3, "raw", "brightfield", 0.5, 20, 2)
    segments = list(tiff.rows_of(path, "segments", page=0))
    assert [r[3:7] for r in segments] == [(0, 0, 16, 16), (16, 0, 16, 16), (32, 0, 8, 16), (0, 16, 16, 8), (16, 16, 16, 8), (32, 16, 8, 8)]
    plain = [r[9] for r in segments]
    samples.write_tiff(path, description="Aperio Library\r\nx|AppMag = 20|MPP = 0.5", insert=100)
    shifted = list(tiff.rows_of(path, "segments", page=0))
    assert [r[9] for r in shifted] == plain and next(tiff.rows_of(path, "header"))[13] == 100
    samples.write_tiff(path, samples=1, bits=16)
    assert code(lambda: tiff.rows_of(path, "header")) == "unsupported_page"


def test_ome_semantics(tmp_path):
    path = str(tmp_path / "x.ome.tif")
    xml = '<OME xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06"><Image Name="macro"><Pixels SizeC="3"/></Image><Image Name="s"><Pixels SizeC="2" SizeZ="3" SizeT="1"><Channel Name="DAPI" Fluor="DAPI" Color="-16776961" ExcitationWavelength="405" EmissionWavelength="0.461" EmissionWavelengthUnit="µm"/><Channel/><Plane TheC="0" ExposureTime="12" ExposureTimeUnit="ms"/><Plane TheC="0" ExposureTime="99"/></Pixels></Image></OME>'
    samples.write_tiff(path, samples=1, description=xml)
    head = next(tiff.rows_of(path, "header"))
    assert (head[6], head[10], head[11], head[14]) == ("fluorescence", 2, 3, "ome")
    first, second = tiff.rows_of(path, "channels")
    assert first[2:] == ("DAPI", "DAPI", 255, 0, 0, 405.0, 461.0, 0.012, "source_metadata") and second[2] == "Channel 2"


def test_afi(folder, tmp_path):
    path = os.path.join(folder, "set.afi")
    assert next(afi.rows_of(path, "header"))[1:] == (40, 24, 2, 8, "raw", 2)
    assert [r[3:] for r in afi.rows_of(path, "channels")] == [("Dye0", 0, 0, 255), ("Dye1", 0, 255, 0)]
    bad = tmp_path / "x.afi"
    bad.write_text("<AFI></AFI>")
    assert code(lambda: afi.rows_of(str(bad), "references")) == "afi_without_paths"
    bad.write_text("<AFI>")
    assert code(lambda: afi.rows_of(str(bad), "references")) == "afi_xml_invalid"


def test_listing_without_children(spark, folder):
    found = inspectable_files(spark, folder).orderBy("idx").collect()
    assert [os.path.basename(r["path"]) for r in found] == ["a.ibl", "b.kfb", "c.kfbf", "d.kfba", "e.kfbx", "f.image", "g.tif", "set.afi"]


def test_errors_as_rows(spark, tmp_path):
    register(spark)
    samples.write_kfb(str(tmp_path / "good.kfb"))
    (tmp_path / "bad.kfb").write_bytes(b"x" * 300)
    rows = spark.read.format("kfb").option("errors", "table").load(str(tmp_path)).collect()
    assert [(os.path.basename(r["path"]), r["code"], r["stage"]) for r in rows] == [("bad.kfb", "unknown_container", "detect")]


def test_jpeg_headers():
    assert baseline_size(samples.jpeg(7, 9)) == (7, 9)
    assert baseline_size(samples.jpeg(7, 9, marker=0xC2)) is None
    assert codec_of(samples.jpeg(4, 4, marker=0xC3)) == "SOF3" and codec_of(b"\xff\x0a") == "JXL"
    with pytest.raises(FormatError):
        codec_of(b"nothing")
