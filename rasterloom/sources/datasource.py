"""Slide containers as Spark data sources: ``spark.read.format("kfb").option("table", "tiles").load(folder)``.

One partition for each file. Equality filters on level, layer or page, and block lists, reach the
reader, so other payloads are never read; the payload column is read only with
``option("payload", "true")``. With ``option("errors", "table")`` a broken file becomes a row
(path, code, stage, message) of the result and a sound one none; otherwise it fails the query.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from ..plans.session import ship
from . import afi, ibl, image_container, kfb, tiff
from .storage import FormatError, files_below

ERRORS = "path string, code string, stage string, message string"


class FilePartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class SlideReader(DataSourceReader):
    """Reads one logical table of each file of a folder."""

    def __init__(self, module, schema: StructType, options: dict, default: str, pushed: dict[str, str]):
        self.module, self.schema = module, schema
        # a folder or file, or a JSON list of them
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.table = options.get("table", default)
        self.payload = options.get("payload", "true").lower() == "true"
        self.errors = options.get("errors", "fail")
        self.pushed, self.arguments = pushed, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") else None
            if isinstance(f, EqualTo) and name in self.pushed and self.table in ("tiles", "segments"):
                argument = self.pushed[name]
                self.arguments[argument] = [f.value] if argument == "block_ids" else f.value
            elif isinstance(f, In) and self.pushed.get(name) == "block_ids" and self.table == "tiles":
                self.arguments["block_ids"] = list(f.value)
            yield f  # Spark checks every row again

    def partitions(self) -> list[FilePartition]:
        return [FilePartition(p) for path in self.paths for p in files_below(path, self.module.SUFFIXES)]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        arguments = dict(self.arguments)
        if self.module not in (ibl, afi):
            arguments["with_payload"] = self.payload
        try:
            for row in self.module.rows_of(partition.path, self.table, **arguments):
                if self.errors != "table":
                    yield row
        except (FormatError, OSError) as e:
            if self.errors != "table":
                raise
            yield (partition.path, getattr(e, "code", "io_error"), getattr(e, "stage", "open"), str(e))


def source(name_: str, module_, default: str, pushed: dict[str, str] | None = None) -> type[DataSource]:
    class SlideSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name_

        def schema(self) -> str:
            if self.options.get("errors") == "table":
                return ERRORS
            table = self.options.get("table", default)
            if table not in module_.SCHEMAS:
                raise ValueError(f"{name_} has tables {', '.join(module_.SCHEMAS)}")
            return module_.SCHEMAS[table]

        def reader(self, schema: StructType) -> DataSourceReader:
            return SlideReader(module_, schema, self.options, default, pushed or {})

    SlideSource.__name__ = SlideSource.__qualname__ = f"{name_.title().replace('_', '')}Source"
    return SlideSource


IblSource = source("ibl", ibl, "header", {"layer": "layer", "block_id": "block_ids"})
KfbSource = source("kfb", kfb, "header", {"level": "level"})
ImageSource = source("image_container", image_container, "header", {"level": "level"})
TiffSource = source("slide_tiff", tiff, "header", {"page": "page"})
AfiSource = source("afi", afi, "header")
SOURCES = (IblSource, KfbSource, ImageSource, TiffSource, AfiSource)


def register(spark: SparkSession) -> SparkSession:
    """Make all formats known to a session."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for s in SOURCES:
        spark.dataSource.register(s)
    return spark
