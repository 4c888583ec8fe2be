"""The worker: its rules by themselves, in a replay, and with running jobs; conversion and dumps."""

import io
import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from rasterloom.functions import jpeg_codec
from rasterloom.plans.convert import convert_slides
from rasterloom.plans.dump import dump_container, export_region
from rasterloom.sources import samples, tiff
from rasterloom.sources.sinks import acceptance_json
from rasterloom.sources.slide_pages import write_svs
from rasterloom.streaming.protocol import CONVERT, INSPECT, Slot, Throttle, Units, Worker, replayed, spark_worker, step
from tests.test_jpeg import picture
from tests.test_slide_pages import slide


def test_one_job_at_a_time():
    busy = Slot("a", CONVERT)
    assert step(Slot(), {"type": "start", "job_id": "a"}).slot == busy
    assert step(busy, {"type": "start", "job_id": "b"}).events[0]["message"] == "conversion already running"
    assert step(busy, {"type": "inspect", "job_id": "b"}).events == [{"type": "inspection_error", "job_id": "b", "message": "worker is busy"}]
    out = step(Slot("a", INSPECT), {"type": "inspect", "job_id": "b"})
    assert out.stop and out.slot.pending["job_id"] == "b" and not out.events
    out = step(out.slot, {"type": "inspect", "job_id": "c"})
    assert out.slot.pending["job_id"] == "c"  # the latest counts
    after = step(out.slot, {"type": "finished"})
    assert after.slot == Slot("c", INSPECT) and after.events == [{"type": "inspection_started", "job_id": "c"}]
    assert step(after.slot, {"type": "finished"}).slot == Slot()
    assert step(busy, {"type": "cancel", "job_id": "x"}).events[0]["type"] == "error"
    assert step(busy, {"type": "cancel"}).stop and step(Slot(), {"type": "cancel"}).events[0]["type"] == "log"
    with pytest.raises(ValueError):
        step(Slot(), {"type": "dance"})


def test_replay():
    log = [{"type": "ping"}, {"type": "inspect", "job_id": "1"}, {"type": "start", "job_id": "2"}, {"type": "nonsense"}, {"type": "finished"}, {"type": "start", "job_id": "3"}]
    assert [e["type"] for e in replayed(log)] == ["ready", "inspection_started", "error", "error", "started"]


def test_throttle_and_units():
    now = iter([0.0, 0.1, 0.2, 0.3, 0.31])
    t = Throttle(clock=lambda: next(now))
    assert [t(i, 5) for i in (1, 2, 3, 4, 5)] == [True, False, False, True, True]
    u = Units((100, 20), associated=2, validate=True)
    assert (u.tail, u.total, u.done(1, 5)) == (2, 124, 105)


def serve(worker, out, lines):
    worker.serve(json.dumps(x) if isinstance(x, dict) else x for x in lines)
    return [json.loads(x) for x in out.getvalue().splitlines()]


def test_worker_replaces_cancels_and_reports(tmp_path):
    running, out = threading.Event(), io.StringIO()

    def inspect(job):
        running.set()
        while job.id == "1":
            job.check()
        return {"n": 1}

    def convert(job):
        job.log_to(str(tmp_path))
        job.log("begins")
        running.set()
        while True:
            job.check()

    def lines():
        yield {"type": "inspect", "job_id": "1"}
        running.wait(5)
        yield {"type": "inspect", "job_id": "2"}
        while worker.slot.job is not None:
            pass
        running.clear()
        yield "no json"
        yield {"type": "start", "job_id": "3"}
        running.wait(5)
        yield {"type": "cancel", "job_id": "3"}

    worker = Worker(inspect, convert, out=out, sample_every=0.01)
    events = serve(worker, out, lines())
    kinds = [(e["type"], e.get("job_id")) for e in events if e["type"] not in ("performance", "log")]
    assert kinds == [("ready", None), ("inspection_started", "1"), ("inspection_started", "2"), ("inspection_done", "2"), ("error", None), ("started", "3"), ("cancelled", "3")]
    assert any("begins" in open(tmp_path / f).read() for f in os.listdir(tmp_path) if f.endswith(".log"))
    assert all(e["memory_mb"] > 0 for e in events if e["type"] == "performance")


def test_spark_worker_inspects_and_fails(spark, tmp_path):
    samples.write_all(str(tmp_path / "in"))
    out = io.StringIO()
    worker = spark_worker(spark, out=out)

    def lines():
        yield {"type": "inspect", "job_id": "1", "payload": {"input_dir": str(tmp_path / "in")}}
        worker.thread.join()
        yield {"type": "start", "job_id": "2", "payload": {"input_dir": str(tmp_path / "none")}}

    events = serve(worker, out, lines())
    done = next(e for e in events if e["type"] == "inspection_done")
    assert len(done["files"]) == 8 and events[-1]["type"] == "error" and "invalid input_dir" in events[-1]["message"]


@pytest.mark.parametrize("output", ["ome_tiff", "svs"])
def test_conversion_of_a_folder(spark, tmp_path, output):
    big, levels, tiles = slide(spark)
    folder, out = tmp_path / "in", tmp_path / "out"
    write_svs(levels, tiles, str(folder), tile=64, thumbnail=100, least=10)
    samples.write_tiff(str(folder / "raw.tif"))
    said = []
    rows = convert_slides(spark, str(folder), str(out), output, log=said.append).collect()
    assert [r["status"] for r in rows] == ["converted", "skipped_incompatible"] and len(said) == 1
    assert [p.name for p in out.iterdir()] == ["1.ome.tif" if output == "ome_tiff" else "1.svs"]
    header = next(tiff.rows_of(rows[0]["output_path"], "header"))
    assert header[1:6] == (330, 200, 8, 3, "JPEG") and header[14] == ("ome" if output == "ome_tiff" else "aperio") and abs(header[7] - 0.25) < 1e-9
    before = {(r[1], r[2]): r[9] for r in tiff.rows_of(str(folder / "1.svs"), "segments")}
    after = {(r[1], r[2]): r[9] for r in tiff.rows_of(rows[0]["output_path"], "segments")}
    assert before[0, 0] == after[0, 0]  # complete tiles as they were


def test_conversion_of_containers(spark, tmp_path, monkeypatch):
    """KFB and .image files whose tiles have pixels."""
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    monkeypatch.setattr(samples, "jpeg", lambda w, h, comps=3, **more: jpeg_codec.encode(picture(h, w, comps), 95))
    samples.write_kfb(str(folder / "a.kfb"))
    samples.write_image(str(folder / "b.image"))
    rows = convert_slides(spark, str(folder), str(out)).collect()
    assert [(r["status"], os.path.basename(r["output_path"])) for r in rows] == [("converted", "a.ome.tif"), ("converted", "b.ome.tif")]
    for r, sizes in zip(rows, ([(24, 18), (12, 9)], [(512, 512), (256, 256)])):
        assert [(p[3], p[4]) for p in tiff.rows_of(r["output_path"], "pages")] == sizes
    got = {(r[1], r[2]): r[9] for r in tiff.rows_of(rows[0]["output_path"], "segments")}
    assert got[0, 0] == jpeg_codec.encode(picture(16, 16, 3), 95)
    assert abs(jpeg_codec.decode(got[0, 1])[:16, :8].astype(int) - picture(16, 8, 3)).mean() < 4


def test_dump_and_export(spark, tmp_path):
    samples.write_kfb(str(tmp_path / "b.kfb"))
    summary = json.loads(dump_container(spark, str(tmp_path / "b.kfb"), str(tmp_path / "out")))
    assert [(x["scale"], x["n_tiles"], x["width"], x["height"]) for x in summary["levels"]] == [(40.0, 4, 24, 18), (20.0, 1, 12, 9)]
    assert summary["header"]["width"] == 24 and os.path.exists(summary["associated_images"][0]["file"])
    lines = open(summary["tile_index_csv"]).read().splitlines()
    assert len(lines) == 6 and "scale" in lines[0]
    big, _, tiles = slide(spark)
    path = export_region(tiles.where("level = 0"), str(tmp_path / "r.jpg"), (10, 20, 110, 90))
    px = jpeg_codec.decode(open(path, "rb").read())
    assert px.shape == (70, 100, 3) and abs(px.astype(int) - big[20:90, 10:110]).mean() < 4
    files = spark.createDataFrame([("a", 1)], "path string, level_count long")
    assert json.loads(acceptance_json(files, {"iou": 1.0}))["files"] == [{"path": "a", "level_count": 1}]
