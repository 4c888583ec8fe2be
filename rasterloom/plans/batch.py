"""A batch from folder to report: list, inspect, check, plan, convert, count.

Inspection and conversion run as Spark tasks, one file to a row; whatever goes wrong with a file
becomes its row's error and leaves the others alone. The plan is a DataFrame, so a batch can be
looked at, filtered and stored before anything is written.
"""

from __future__ import annotations

import datetime
import os
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import OUTPUT_SUFFIX, parent_folder
from ..operators.planner import allowed_outputs, batch_counts, compatibility, stale
from ..operators.windows import greedy_names
from ..sources import afi, ibl, image_container, kfb, tiff
from ..sources.listing import inspectable_files
from .options import Options
from .session import ship, store_path

FACTS = "idx long, path string, format string, container string, version string, codec string, width long, height long, bit_depth long, modality string, native_planes boolean, n_field long, n_channels long, n_z long, n_t long, n_levels long, mpp double, file_size long, mtime_ns string, error_code string, error_stage string, error string"
RESULT = "idx long, input_path string, output_path string, status string, success boolean, width long, height long, pyramid_levels long, duration_sec double, failure_stage string, error_code string, error string"


def facts_of(path: str, kind: str) -> dict:
    """What the header of one file says, for eligibility and planning."""
    local = path.removeprefix("file://").removeprefix("file:")
    stat = os.stat(local)
    out = {"file_size": stat.st_size, "mtime_ns": str(stat.st_mtime_ns), "n_field": 1, "n_z": 1, "n_t": 1, "bit_depth": 8, "native_planes": False, "version": None, "mpp": 0.0}
    if kind == "ibl":
        h = dict(zip(("path", *(n for n, *_ in ibl.HEADER)), next(ibl.rows_of(local, "header"))))
        out |= {"container": "ibl", "version": h["version"], "codec": "JPEG", "width": h["total_img_width"], "height": h["total_img_height"], "modality": "brightfield", "n_channels": 1, "n_levels": 1, "mpp": h["pixel_size_mm"] * 1000}
    elif kind == "kfb":
        _, container, version, w, h, _, _, _, codec, mpp, _, channels = next(kfb.rows_of(local, "header"))
        tiles = list(kfb.rows_of(local, "tiles", with_payload=False))
        named = sum(1 for _ in kfb.rows_of(local, "channels"))
        fluorescence = named > 0 and {t[4] for t in tiles} == set(range(named))
        out |= {"container": container, "version": version, "codec": codec, "width": w, "height": h, "mpp": mpp, "n_channels": channels, "n_field": len({t[3] for t in tiles}), "n_levels": len({t[2] for t in tiles}), "modality": "fluorescence" if fluorescence else "brightfield", "native_planes": fluorescence}
    elif kind == "image":
        h = next(image_container.rows_of(local, "header"))
        out |= {"container": "image", "codec": "JPEG", "width": h[1], "height": h[2], "mpp": h[3], "modality": "brightfield", "n_channels": 1, "n_levels": sum(1 for _ in image_container.rows_of(local, "levels"))}
    elif kind == "afi":
        _, w, h, channels, bits, codec, levels = next(afi.rows_of(local, "header"))
        out |= {"container": "afi", "codec": codec, "width": w, "height": h, "bit_depth": bits, "modality": "fluorescence", "native_planes": True, "n_channels": channels, "n_levels": levels}
    else:
        h = next(tiff.rows_of(local, "header"))
        out |= {"container": h[14], "codec": h[5], "width": h[1], "height": h[2], "bit_depth": h[3], "modality": h[6], "mpp": h[7], "n_levels": h[9], "n_channels": h[10], "n_z": h[11], "n_t": h[12], "native_planes": h[6] == "fluorescence"}
    return out


def inspect_inputs(spark: SparkSession, folder: str, *, recursive: bool = True, parallel: int = 4) -> DataFrame:
    """One row of facts for each file, in order of paths; a file that can't be read has its error instead."""
    return inspect_files(inspectable_files(ship(spark), folder, recursive=recursive), parallel=parallel)


def inspect_files(files: DataFrame, *, parallel: int = 4) -> DataFrame:
    """Facts of files (idx, path, format)."""
    names = [x.split()[0] for x in FACTS.split(", ")]

    def look(parts):
        for pdf in parts:
            rows = []
            for r in pdf.itertuples():
                row = {"idx": r.idx, "path": r.path, "format": r.format, "modality": "unknown"}
                try:
                    row |= facts_of(r.path, r.format)
                except Exception as e:  # any failure is this file's own
                    row |= {"error_code": getattr(e, "code", type(e).__name__), "error_stage": getattr(e, "stage", "inspect"), "error": str(e)[:2000]}
                rows.append(row)
            yield pd.DataFrame(rows, columns=names).astype(object).where(lambda d: d.notna(), None)

    return files.select("idx", "path", "format").repartition(max(1, parallel), "path").mapInPandas(look, FACTS)


def with_snapshot(files: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Facts from an earlier inspection where there are any, from a new one for the rest."""
    known = files.select("idx", "path", "format").join(snapshot.drop("idx", "format"), "path")
    fresh = inspect_files(files.join(snapshot, "path", "left_anti"))
    return known.unionByName(fresh, allowMissingColumns=True)


def output_plan(spark: SparkSession, facts: DataFrame, root: str, out_root: str, options: Options, *, expected: DataFrame | None = None) -> DataFrame:
    """facts with status (changed, inspection_error, not_allowed, compatible), reason, and output_path for compatible files."""
    slides = facts.select(F.col("path").alias("slide_id"), "modality", "native_planes", "bit_depth", "n_field", "n_z", "n_t", "n_channels")
    offered = allowed_outputs(slides).where(F.col("format") == options.output_format).select(F.col("slide_id").alias("path"), "allowed", "reason")
    rows = facts.join(offered, "path")
    rows = stale(rows, expected) if expected is not None else rows.withColumn("changed", F.lit(False))
    rows = rows.withColumn("status", compatibility(changed=F.col("changed"), error=F.col("error_code").isNotNull(), allowed=F.col("allowed")))
    if options.selected is not None:
        rows = rows.join(spark.createDataFrame([(p,) for p in options.selected], "path string"), "path", "left_semi")
    base = root.removeprefix("file://").removeprefix("file:").rstrip("/")
    relative = F.regexp_replace(F.regexp_replace("path", "^file:(//)?", ""), f"^{base}/", "")
    stem = F.regexp_replace(F.regexp_extract(relative, "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    named = rows.where("status = 'compatible'").withColumns({"folder": parent_folder(relative), "stem": stem, "suffix": F.lit(OUTPUT_SUFFIX[options.output_format])})
    named = greedy_names(named.select("idx", "folder", "stem", "suffix"), folder="folder", stem="stem", suffix="suffix", order="idx")
    target = F.concat_ws("/", F.lit(out_root.rstrip("/")), F.nullif(F.col("folder"), F.lit("")), F.col("name"))
    return rows.join(named.select("idx", target.alias("output_path")), "idx", "left").drop("allowed", "changed")


class IncompatibleError(RuntimeError):
    """A batch holds files that can't be converted, and wasn't told to leave them out."""


Converter = Callable[[dict], dict]


def convert_folder(spark: SparkSession, folder: str, out_folder: str, options: Options, convert: Converter, *, expected: DataFrame | None = None) -> DataFrame:
    """Run ``convert`` on each compatible file of a folder; results, in order of the plan.

    convert gets the plan's row and writes to its output_path, a file of this attempt that is renamed when it
    returns; what it returns (width, height, pyramid_levels) goes to the result. With
    ``continue_on_error`` off, files after the first failure of their task count as not started, so use
    one task (parallel_wsi = 1) for a strict order.
    """
    facts = inspect_inputs(spark, folder, recursive=options.recursive)
    plan = output_plan(spark, facts, folder, out_folder, options, expected=expected).cache()
    bad = plan.where("status != 'compatible'")
    if not options.compatible_only:
        first = bad.orderBy("idx").limit(5).collect()
        if first:
            raise IncompatibleError("; ".join(f"{r['path']}: {r['error'] or r['reason'] or r['status']}" for r in first))
    names = [x.split()[0] for x in RESULT.split(", ")]
    go_on = options.continue_on_error

    def run(parts):
        import time

        from pyspark import TaskContext

        failed, attempt = False, TaskContext.get().taskAttemptId()
        for pdf in parts:
            for row in pdf.sort_values("idx").to_dict("records"):
                out = {"idx": row["idx"], "input_path": row["path"], "output_path": row["output_path"], "status": "not_started", "success": False, "duration_sec": 0.0}
                part = f"{row['output_path']}.{attempt}.part"
                begin = time.monotonic()
                try:
                    if not failed or go_on:
                        os.makedirs(os.path.dirname(part), exist_ok=True)
                        out |= convert({**row, "output_path": part})
                        os.replace(part, row["output_path"])
                        out |= {"output_path": row["output_path"], "status": "converted", "success": True}
                except Exception as e:
                    failed = True
                    out |= {"status": "failed", "failure_stage": getattr(e, "stage", "convert"), "error_code": getattr(e, "code", type(e).__name__), "error": str(e)[:2000]}
                finally:
                    if os.path.exists(part):
                        os.unlink(part)
                out["duration_sec"] = time.monotonic() - begin
                yield pd.DataFrame([out], columns=names).astype(object).where(lambda d: d.notna(), None)

    good = plan.where("status = 'compatible'").select("idx", "path", "format", "output_path", "width", "height", "modality", "mpp").repartition(options.parallel(), "path")
    done = good.sortWithinPartitions("idx").mapInPandas(run, RESULT)
    skipped = bad.select("idx", F.col("path").alias("input_path"), F.lit("skipped_incompatible").alias("status"), F.lit(False).alias("success"), F.coalesce("error_code", "status").alias("error_code"), F.coalesce("error", "reason", "status").alias("error"))
    # converted once: the results are written before anyone counts or reports them, so no lost executor converts again
    path = store_path(spark, "results")
    done.unionByName(skipped, allowMissingColumns=True).write.parquet(path)
    return spark.read.parquet(path).orderBy("idx")


def counts_of(results: DataFrame) -> dict:
    return batch_counts(results).first().asDict()


def output_subfolder(root: str, now: datetime.datetime | None = None) -> str:
    """A new folder of the minute below root: the first free name."""
    base = os.path.join(root, f"Slides_{(now or datetime.datetime.now()):%Y%m%d%H%M}")
    path, n = base, 0
    while True:
        try:
            os.makedirs(path)
            return path
        except FileExistsError:
            n += 1
            path = f"{base}_{n}"
