import json

import pandas as pd
from pyspark.sql import functions as F

from rasterloom.operators.raster import encode_tiles
from rasterloom.sources import tiff
from rasterloom.sources.datasource import register
from rasterloom.sources.sinks import REPORT, acceptance_markdown, read_catalog, structure_of, write_catalog, write_report, write_tiff
from rasterloom.streaming.jobs import START, fold_batch, folded, states_of, windowed_samples


def tiles(spark):
    rows = [(s, 0, 40, 24, 16, x, y, min(16, 40 - x), min(16, 24 - y), [(x + y + s) % 256] * (min(16, 40 - x) * min(16, 24 - y))) for s in (1, 2) for y in (0, 16) for x in (0, 16, 32)]
    return encode_tiles(spark.createDataFrame(rows, "slide_id long, level long, width long, height long, tile long, x long, y long, w long, h long, px array<int>"), "px")


def test_catalog_round_trip(spark, tmp_path):
    write_catalog(tiles(spark), str(tmp_path / "c"))
    back = read_catalog(spark, str(tmp_path / "c"))
    assert back.count() == 12 and back.where("slide_id = 1 and level = 0").count() == 6


def test_tiff_round_trip(spark, tmp_path):
    import zlib

    write_tiff(tiles(spark), str(tmp_path), description="Aperio x|MPP = 0.5")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["1.tif", "2.tif"]
    segments = list(tiff.rows_of(str(tmp_path / "2.tif"), "segments"))
    assert [zlib.decompress(r[9])[0] for r in segments] == [(r[3] + r[4] + 2) % 256 for r in segments]
    register(spark)
    pages = spark.read.format("slide_tiff").option("table", "pages").load(str(tmp_path))
    facts = structure_of(pages)
    assert facts.first()["levels"] == "40x24"
    assert "`40x24`" in acceptance_markdown(facts, {"iou": 1.0, "xor_ratio": 0.0, "passed": True})


def test_report(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", None, 0, 1.5), (1, "a", True, 7, None)], "idx int, input_path string, success boolean, width int, duration_sec double")
    write_report(df, str(tmp_path / "r.csv"))
    raw = (tmp_path / "r.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf")
    lines = raw.decode("utf-8-sig").splitlines()
    assert len(lines) == 3 and lines[0].split(",") == [n for n, _ in REPORT] and len(REPORT) == 52
    first = dict(zip((n for n, _ in REPORT), lines[1].split(",")))
    assert (first["input_path"], first["success"], first["width"], first["duration_sec"]) == ("a", "True", "7", "0.000")


def test_fold_rules():
    rows = pd.DataFrame([(3, "progress", 10.0), (1, "started", None), (2, "progress", 40.0), (4, "completed", None), (5, "progress", 1.0), (2, "failed", None)], columns=["seq", "type", "value"])
    assert folded(START, rows) == (100.0, 0, "completed", 5, 0.0)


def test_stream_equals_batch_and_survives_bad_lines(spark, tmp_path):
    events = [{"seq": i, "ts": f"2024-01-01T00:00:{i % 60:02d}", "job": f"j{i % 3}", "type": ["started", "progress", "performance", "file_done", "completed"][(i * 7) % 5 if i < 40 else 1], "value": float(i)} for i in range(60)]
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(e) for e in events[k::3]) + ("\nnot json\n" if k == 1 else ""))
    got = {r["job"]: tuple(r)[1:] for r in states_of(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()}
    batch = fold_batch(spark.createDataFrame([(e["seq"], e["job"], e["type"], e["value"]) for e in events], "seq long, job string, type string, value double"))
    want = {r["job"]: (r["percent"], r["files_done"], r["status"], r["last_seq"], r["peak"]) for r in batch.collect()}
    assert {k: v for k, v in got.items() if k} == want


def test_windowed_samples(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00.2", "a", "performance", 1.0), ("2024-01-01 00:00:00.8", "a", "performance", 3.0), ("2024-01-01 00:00:01.1", "a", "log", 9.0)], "t string, job string, type string, value double").withColumn("ts", F.to_timestamp("t"))
    assert [(r["n"], r["peak"], r["mean"]) for r in windowed_samples(df).collect()] == [(2, 3.0, 2.0)]


def test_ome_description_is_read_back(spark, tmp_path):
    from rasterloom.sources import samples
    from rasterloom.sources.ome import ome_xml

    text = ome_xml("s", width=40, height=24, z=2, channels=[{"name": "DAPI", "fluor": "DAPI", "color": (0, 0, 255), "excitation_nm": 405.0, "emission_nm": 461.0, "exposure_s": 0.5}, {"name": "FITC", "color": (0, 255, 0)}])
    path = str(tmp_path / "x.tif")
    samples.write_tiff(path, samples=1, description=text)
    head = next(tiff.rows_of(path, "header"))
    assert (head[6], head[10], head[11]) == ("fluorescence", 2, 2)
    rows = list(tiff.rows_of(path, "channels"))
    assert rows[0][2:9] == ("DAPI", "DAPI", 0, 0, 255, 405.0, 461.0) and rows[0][9] == 0.5 and rows[1][4:7] == (0, 255, 0)


def test_channel_set(spark, tmp_path):
    import pytest

    from rasterloom.sources import afi
    from rasterloom.sources.ome import write_channel_set
    from rasterloom.sources.storage import FormatError

    both = tiles(spark).withColumn("channel", F.col("slide_id") - 1)
    channels = [{"name": "DA PI", "color": (0, 0, 255), "exposure_s": 1.5}, {"name": "?", "color": (0, 255, 0)}]
    files = write_channel_set(both, str(tmp_path / "set.afi"), channels)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["set.afi", "set_C01_DA_PI.svs", "set_C02.svs"]
    assert next(afi.rows_of(files[0], "header"))[1:] == (40, 24, 2, 8, "deflate", 1)
    again = write_channel_set(both, str(tmp_path / "set.afi"), channels)
    assert again[0].endswith("set_1.afi")
    with pytest.raises(FormatError):
        write_channel_set(both.where("channel = 0 or x = 0"), str(tmp_path / "bad.afi"), channels)
    assert not [p for p in tmp_path.iterdir() if "bad" in p.name]
