"""Sinks: the tile catalog as Parquet, one TIFF for each slide, and batch reports.

The catalog is the engine's own form: Parquet by slide and level, so that metadata queries don't
touch payloads. The TIFF sink is a two-phase Python data source: tasks write ``<slide>.part`` files
beside the target, commit renames all, abort removes them.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.text import blank_zero
from ..operators.raster import decoded
from ..plans.session import ship
from .storage import FormatError, split_uri

#: Columns of the batch report in order, and how each is written. Fixed values.
PLAIN, SECONDS, SIZE, SIZES, TEXTS = "plain", "seconds", "size", "sizes", "texts"
REPORT = (
    ("input_path", PLAIN), ("input_format", PLAIN), ("output_path", PLAIN), ("output_files", TEXTS), ("success", PLAIN), ("status", PLAIN), ("output_format", PLAIN),
    ("backend", PLAIN), ("width", "number"), ("height", "number"), ("level_dimensions", SIZES), ("pyramid_levels", "number"), ("mpp", "number"), ("duration_sec", SECONDS),
    ("read_decode_sec", SECONDS), ("main_write_sec", SECONDS), ("pyramid_sec", SECONDS), ("thumbnail_sec", SECONDS), ("encode_sec", SECONDS), ("writer_wait_sec", SECONDS),
    ("peak_memory_mb", SECONDS), ("avg_cpu_percent", SECONDS), ("svs_is_bigtiff", PLAIN), ("svs_label_dimensions", SIZE), ("svs_macro_dimensions", SIZE), ("openslide_vendor", PLAIN),
    ("svs_photometric_pages", TEXTS), ("svs_finalize_backend", PLAIN), ("max_level_reached", "number"), ("native_path", PLAIN), ("native_level_dimensions", SIZES),
    ("native_resource_dimensions", PLAIN), ("native_tile_mode", PLAIN), ("native_fallback_reason", PLAIN), ("source_container", PLAIN), ("source_version", PLAIN), ("source_codec", PLAIN),
    ("source_bit_depth", PLAIN), ("source_channel_count", PLAIN), ("source_axes", PLAIN), ("compatibility_level", PLAIN), ("diagnostic_code", PLAIN), ("diagnostic_stage", PLAIN),
    ("svs_omitted_native_data", PLAIN), ("source_modality", PLAIN), ("channel_definitions", PLAIN), ("channel_identity_source", TEXTS), ("channel_override_applied", PLAIN),
    ("skipped_reason", PLAIN), ("failure_stage", PLAIN), ("error_code", PLAIN), ("error", PLAIN),
)
BOM = "﻿"


def report_cells(results: DataFrame) -> DataFrame:
    """The report's columns as text; a column that results lack is blank throughout."""
    have = {f.name: f.dataType.typeName() for f in results.schema}
    size = lambda s: F.concat(s.getField("w").cast("string"), F.lit("x"), s.getField("h").cast("string"))

    def cell(name: str, how: str) -> Column:
        if name not in have:
            return F.lit("0.000" if how == SECONDS else "").alias(name)
        c = F.col(name)
        if how == "number":
            text = blank_zero(c)
        elif how == SECONDS:
            text = F.format_string("%.3f", F.coalesce(c.cast("double"), F.lit(0.0)))
        elif how == SIZE:
            text = size(c)
        elif how == SIZES:
            text = F.array_join(F.transform(c, size), "|")
        elif how == TEXTS:
            text = F.array_join(c, "|")
        elif have[name] in ("array", "map", "struct"):
            text = F.to_json(c)
        else:
            text = F.initcap(c.cast("string")) if have[name] == "boolean" else c.cast("string")
        return F.coalesce(text, F.lit("")).alias(name)

    return results.select(*(cell(*x) for x in REPORT))


def write_report(results: DataFrame, path: str, *, order: str = "idx") -> None:
    """The report as one CSV text with a byte-order mark, in order of the plan, put in place at once.

    A report has a row for each slide of a batch; rows are streamed to the driver's file one partition at a time."""
    import csv

    ordered = report_cells(results.orderBy(order)) if order in results.columns else report_cells(results)
    part = path + ".part"
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    try:
        with open(part, "w", newline="", encoding="utf-8") as f:
            f.write(BOM)
            out = csv.writer(f)
            out.writerow(name for name, _ in REPORT)
            for row in ordered.toLocalIterator():
                out.writerow(row)
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.unlink(part)


def write_catalog(tiles: DataFrame, path: str) -> None:
    """Tiles as Parquet by slide and level, in row-major order within each file."""
    tiles.repartition("slide_id", "level").sortWithinPartitions("slide_id", "level", "y", "x").write.partitionBy("slide_id", "level").mode("overwrite").parquet(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# ---------------------------------------------------------------- TIFF


@dataclass
class Done(WriterCommitMessage):
    files: list[str]


class TiffWriter(DataSourceArrowWriter):
    """Writes slide_id, level, width, height, tile, x, y, w, h, payload (sorted by slide, level, y, x) as tiled TIFF."""

    def __init__(self, options: dict):
        system, self.folder = split_uri(options["path"])
        if system is not None:
            raise FormatError("remote_sink", "write", "TIFF files are written to mounted folders")
        self.bands = int(options.get("bands", "1"))
        self.description = options.get("description", "")

    def write(self, iterator) -> Done:
        from pyspark import TaskContext

        os.makedirs(self.folder, exist_ok=True)
        # a retried or speculative task has files of its own; only those of the attempt that counts are renamed
        attempt = TaskContext.get().taskAttemptId()
        files, current, out = [], object(), None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if row["slide_id"] != current:
                        if out:
                            out.close()
                        current = row["slide_id"]
                        name = os.path.join(self.folder, f"{file_stem(current)}.tif.{attempt}.part")
                        files.append(name)
                        out = TiffFile(name, self.bands, self.description)
                    out.add(row)
            if out:
                out.close()
        except BaseException:
            for f in files:
                if os.path.exists(f):
                    os.unlink(f)
            raise
        return Done(files)

    def commit(self, messages: list[Done | None]) -> None:
        for m in messages:
            for f in m.files if m else []:
                os.replace(f, f.rsplit(".", 2)[0])

    def abort(self, messages: list[Done | None]) -> None:
        for m in messages:
            for f in m.files if m else []:
                if os.path.exists(f):
                    os.unlink(f)


def file_stem(slide_id) -> str:
    """A file name for a slide; one that had to be changed gets a checksum, so that two ids don't share a file."""
    if slide_id is None:
        raise FormatError("slide_without_id", "write")
    name = str(slide_id)
    safe = re.sub(r"[^\w.-]", "_", name)
    return safe if safe == name else f"{safe}-{zlib.crc32(name.encode()):08x}"


class TiffFile:
    """Tiles go to the file as they come; directories follow at the end. BigTIFF throughout, so no size has to be guessed."""

    def __init__(self, path: str, bands: int, description: str):
        self.out, self.bands, self.description = open(path, "wb"), bands, description  # noqa: SIM115
        self.out.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0))
        self.levels: dict[int, dict] = {}

    def add(self, row: dict) -> None:
        import numpy as np

        size = row["tile"]
        level = self.levels.setdefault(row["level"], {"w": row["width"], "h": row["height"], "tile": size, "at": {}})
        px = np.full((size, size, self.bands), 255, np.uint8)
        px[: row["h"], : row["w"]] = decoded(row["payload"], row["h"], row["w"], self.bands)
        blob = zlib.compress(px.tobytes(), 6)
        across = -(-row["width"] // size)
        level["at"][row["y"] // size * across + row["x"] // size] = (self.out.tell(), len(blob))
        self.out.write(blob)

    def close(self) -> None:
        link = 8
        for number in sorted(self.levels):
            v = self.levels[number]
            n = -(-v["w"] // v["tile"]) * -(-v["h"] // v["tile"])
            if len(v["at"]) < n:
                blob = zlib.compress(b"\xff" * (v["tile"] ** 2 * self.bands), 6)
                blank = (self.out.tell(), len(blob))
                self.out.write(blob)
            places = [v["at"].get(i) or blank for i in range(n)]

            def stored(raw: bytes) -> int:
                at = self.out.tell()
                self.out.write(raw)
                return at

            text = (self.description if number == min(self.levels) else f"level {number}").encode() + b"\x00"
            many = lambda values: values[0] if n == 1 else stored(struct.pack(f"<{n}Q", *values))
            bits = int.from_bytes(struct.pack("<4H", *([8] * self.bands + [0] * (4 - self.bands))), "little")
            entries = [(254, 4, 1, 0 if number == min(self.levels) else 1), (256, 4, 1, v["w"]), (257, 4, 1, v["h"]), (258, 3, self.bands, bits), (259, 3, 1, 8), (262, 3, 1, 2 if self.bands > 1 else 1), (270, 2, len(text), int.from_bytes(text.ljust(8, b"\x00"), "little") if len(text) <= 8 else stored(text)), (277, 3, 1, self.bands), (284, 3, 1, 1), (322, 4, 1, v["tile"]), (323, 4, 1, v["tile"]), (324, 16, n, many([p[0] for p in places])), (325, 16, n, many([p[1] for p in places]))]
            at = stored(struct.pack("<Q", len(entries)) + b"".join(struct.pack("<HHQQ", *e) for e in entries) + bytes(8))
            self.out.seek(link)
            self.out.write(struct.pack("<Q", at))
            self.out.seek(0, 2)
            link = self.out.tell() - 8
        self.out.close()


class TiffSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "slide_tiff_sink"

    def writer(self, schema, overwrite: bool) -> TiffWriter:
        return TiffWriter(self.options)


def write_tiff(tiles: DataFrame, path: str, *, bands: int = 1, description: str = "") -> None:
    """One TIFF for each slide: its tiles meet in one task, in order, and stream to the file."""
    spark = ship(tiles.sparkSession)
    spark.dataSource.register(TiffSink)
    columns = ["slide_id", "level", "width", "height", "tile", "x", "y", "w", "h", "payload"]
    rows = tiles.select(*columns).repartition("slide_id").sortWithinPartitions("slide_id", "level", "y", "x")
    rows.write.format("slide_tiff_sink").option("bands", bands).option("description", description).mode("append").save(path)


# ---------------------------------------------------------------- acceptance


def structure_of(pages: DataFrame) -> DataFrame:
    """What a written file consists of: pages, levels and their sizes, associated images."""
    size = F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"))
    level = F.col("kind").isin("main", "level")
    ordered = F.sort_array(F.collect_list(F.when(level, F.struct("page", size.alias("size")))))
    return pages.groupBy("path").agg(F.count(F.lit(1)).alias("page_count"), F.count_if(level).alias("level_count"), F.array_join(F.transform(ordered, lambda s: s.getField("size")), "|").alias("levels"), F.max(F.when(F.col("kind") == "label", size)).alias("label"), F.max(F.when(F.col("kind") == "macro", size)).alias("macro"))


def acceptance_markdown(structure: DataFrame, geometry: dict) -> str:
    """A report on a few written files, for people; one section for each."""
    lines = ["# Acceptance", "", f"- IoU: `{geometry['iou']:.4f}`", f"- XOR ratio: `{geometry['xor_ratio']:.4f}`", f"- Passed: `{'yes' if geometry['passed'] else 'no'}`"]
    for r in structure.orderBy("path").toLocalIterator():
        lines += ["", f"## {r['path']}", "", f"- Pages: `{r['page_count']}`", f"- Levels: `{r['levels']}`", f"- Label: `{r['label'] or ''}`", f"- Macro: `{r['macro'] or ''}`"]
    return "\n".join(lines) + "\n"


def acceptance_json(structure: DataFrame, geometry: dict) -> str:
    """The same facts as one JSON text."""
    import json

    return json.dumps({"geometry": geometry, "files": [r.asDict() for r in structure.orderBy("path").toLocalIterator()]}, ensure_ascii=False, indent=2)
