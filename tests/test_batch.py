import datetime
import os
import shutil

import pytest

from rasterloom.__main__ import main
from rasterloom.plans.batch import FACTS, IncompatibleError, convert_folder, counts_of, inspect_inputs, output_plan, output_subfolder, with_snapshot
from rasterloom.plans.options import Options
from rasterloom.sources import samples
from rasterloom.sources.listing import inspectable_files


@pytest.fixture
def folder(tmp_path):
    path = str(tmp_path / "in")
    samples.write_all(path)
    return path


def test_inspection_isolates_errors(spark, folder):
    with open(os.path.join(folder, "h.kfb"), "wb") as f:
        f.write(b"broken" * 100)
    rows = {os.path.basename(r["path"]): r for r in inspect_inputs(spark, folder).collect()}
    assert rows["h.kfb"]["error_code"] == "unknown_container" and rows["h.kfb"]["modality"] == "unknown"
    assert {n: r["modality"] for n, r in rows.items() if r["error"] is None} == {"a.ibl": "brightfield", "b.kfb": "brightfield", "c.kfbf": "brightfield", "d.kfba": "fluorescence", "e.kfbx": "brightfield", "f.image": "brightfield", "g.tif": "brightfield", "set.afi": "fluorescence"}
    assert rows["d.kfba"]["n_field"] == 2 and rows["set.afi"]["n_channels"] == 2


def test_plan_and_snapshot(spark, folder):
    # a snapshot is a table of its own: a cached plan would answer the later inspections, too
    facts = spark.createDataFrame(inspect_inputs(spark, folder).collect(), FACTS)
    plan = {os.path.basename(r["path"]): r for r in output_plan(spark, facts, folder, "/out", Options(output_format="svs")).collect()}
    assert plan["d.kfba"]["status"] == "not_allowed" and plan["d.kfba"]["output_path"] is None
    assert plan["a.ibl"]["output_path"] == "/out/a.svs"
    shutil.copy(os.path.join(folder, "b.kfb"), os.path.join(folder, "a.kfb"))
    shutil.copy(os.path.join(folder, "b.kfb"), os.path.join(folder, "a_1.kfb"))
    files = inspectable_files(spark, folder)
    again = with_snapshot(files, facts)
    names = {os.path.basename(r["path"]): r["output_path"] for r in output_plan(spark, again, folder, "/out", Options()).collect()}
    assert (names["a.ibl"], names["a.kfb"], names["a_1.kfb"]) == ("/out/a.ome.tif", "/out/a_1.ome.tif", "/out/a_1_1.ome.tif")
    with open(os.path.join(folder, "b.kfb"), "ab") as f:
        f.write(b"more")
    changed = output_plan(spark, inspect_inputs(spark, folder), folder, "/out", Options(), expected=facts).where("status = 'changed'")
    assert sorted(os.path.basename(r["path"]) for r in changed.collect()) == ["a.kfb", "a_1.kfb", "b.kfb"]


def make_writer():
    # made inside a function, so that it travels by value: tasks can't import tests
    def writer(row):
        if row["path"].endswith("b.kfb"):
            raise ValueError("no luck")
        with open(row["output_path"], "w") as f:
            f.write(row["path"])
        return {"width": row["width"], "height": row["height"]}

    return writer


def test_convert_goes_on_or_stops(spark, folder, tmp_path):
    out, writer = str(tmp_path / "out"), make_writer()
    with pytest.raises(IncompatibleError):
        convert_folder(spark, folder, out, Options(output_format="svs"), writer)
    rows = convert_folder(spark, folder, out, Options(output_format="svs", compatible_only=True), writer)
    assert counts_of(rows) == {"success_count": 5, "failed_count": 1, "skipped_count": 2, "cancelled_count": 0}
    assert sorted(os.listdir(out)) == ["a.svs", "c.svs", "e.svs", "f.svs", "g.svs"]
    assert [r["idx"] for r in rows.collect()] == list(range(1, 9))
    strict = convert_folder(spark, folder, out + "2", Options(output_format="svs", compatible_only=True, continue_on_error=False), writer)
    assert [r["status"] for r in strict.collect()][:4] == ["converted", "failed", "not_started", "skipped_incompatible"]


def test_options():
    o = Options.from_request({"output_format": "svs", "tile_size": "x", "parallel_wsi": 99, "memory_budget_mb": 1})
    assert (o.tile(), o.tile("J2K"), o.parallel(), o.memory_budget_mb, o.workers(), o.strip(), o.bigtiff()) == (240, 256, 8, 1024, 1, 512, False)
    assert Options(memory_budget_mb=6144, output_format="svs").strip() == 1024 and Options(encoder_workers=2).strip() == 2048
    with pytest.raises(ValueError):
        Options.from_request({"output_format": "png"})


def test_subfolder_and_command_line(tmp_path, capsys):
    now = datetime.datetime(2024, 1, 2, 3, 4)
    assert [os.path.basename(output_subfolder(str(tmp_path), now)) for _ in range(2)] == ["Slides_202401020304", "Slides_202401020304_1"]
    assert main(["--version"]) == 0 and main([]) == 2
