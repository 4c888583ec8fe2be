"""Slide files from tables of pages and segments: OME-TIFF and SVS without another coding of complete tiles.

A file is a row for each page (``PAGE``: size, coding, description, parent for sub-pages) and a row for
each encoded segment (slide_id, page, segment, payload). Whatever needs pixels (padding of short tiles,
resampling, thumbnails) happens before the sink, in parallel; complete tiles pass as they are. The
sink sorts the rows of a slide and appends them to one file, segments first, directories at the end.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter

from ..functions.arithmetic import ceil_div, col, div
from ..functions.jpeg_codec import encode, tables
from ..functions.text import aperio_associated_description, aperio_description, aperio_level_description, aperio_thumbnail_description
from ..operators.raster import decoded, read_regions, tile_grid
from ..plans.session import ship
from .sinks import Done, file_stem
from .storage import FormatError, split_uri

#: Facts of a page. tile 0: one strip; parent -1: a page of its own, else the page it is a part of; blank: what stands for a segment that isn't there.
PAGE = "slide_id string, page int, width long, height long, tile long, samples int, bits int, compression int, photometric int, subfile int, description string, tables binary, parent int, mpp double, big boolean, blank binary"
FACTS = [x.split()[0] for x in PAGE.split(", ")][2:]
#: Values of TIFF tags. Fixed values.
JPEG, DEFLATE, GREY, RGB, YCBCR = 7, 8, 1, 2, 6
#: Beyond this estimate a file needs 64-bit offsets; what files hold beside pixels. Fixed values.
CLASSIC_LIMIT, BESIDE_PIXELS = 3_200_000_000, 64 << 20


#: Estimated bytes of a pixel of an encoded tile: a base, and what each step of quality adds. Fixed values.
DENSITY = {"jpeg": (0.15, 0.010), "j2k": (0.50, 0.035)}


class PageFile:
    """Appends the segments of one file and writes its directories at the end."""

    def __init__(self, path: str, big: bool):
        self.out, self.big = open(path, "wb"), big  # noqa: SIM115
        self.number = "<Q" if big else "<I"
        self.out.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0) if big else struct.pack("<2sHI", b"II", 42, 0))
        self.pages: dict[int, dict] = {}

    def append(self, raw: bytes) -> int:
        at = self.out.tell()
        self.out.write(raw + b"\x00" * (len(raw) % 2))
        return at

    def add(self, row: dict) -> None:
        if row["segment"] < 0:
            self.pages[row["page"]] = {**row, "at": {}}
        elif row["payload"] is not None:
            page = self.pages.get(row["page"])
            if page is None:
                raise FormatError("segment_without_page", "write")
            if row["segment"] in page["at"]:
                raise FormatError("segment_twice", "write")
            page["at"][row["segment"]] = (self.append(row["payload"]), len(row["payload"]))

    def places(self, p: dict) -> list[tuple[int, int]]:
        n = -(-p["width"] // p["tile"]) * -(-p["height"] // p["tile"]) if p["tile"] else 1
        if any(i >= n for i in p["at"]):
            raise FormatError("segment_out_of_grid", "write")
        blank = None
        if len(p["at"]) < n:
            if p["blank"] is None:
                raise FormatError("segment_missing", "write")
            blank = (self.append(p["blank"]), len(p["blank"]))
        return [p["at"].get(i) or blank for i in range(n)]

    def directory(self, p: dict, subs: list[int]) -> int:
        """Writes a page's directory; its place."""
        found, samples = self.places(p), p["samples"]
        text = (p["description"] or "").encode() + b"\x00"
        rational = struct.pack("<II", *((round(1e7 / p["mpp"]), 1000) if p["mpp"] else (1, 1)))
        wide, code = (16, "Q") if self.big else (4, "I")
        tags = [(254, 4, [p["subfile"]]), (256, 4, [p["width"]]), (257, 4, [p["height"]]), (258, 3, [p["bits"]] * samples), (259, 3, [p["compression"]]), (262, 3, [p["photometric"]]), (270, 2, text), (277, 3, [samples]), (282, 5, rational), (283, 5, rational), (284, 3, [1]), (296, 3, [3 if p["mpp"] else 1])]
        offsets, sizes = (324, 325) if p["tile"] else (273, 279)
        tags += [(offsets, wide, [x for x, _ in found]), (sizes, wide, [n for _, n in found])]
        tags += [(322, 4, [p["tile"]]), (323, 4, [p["tile"]])] if p["tile"] else [(278, 4, [p["height"]])]
        tags += [(330, 18 if self.big else 13, subs)] if subs else []
        tags += [(347, 7, p["tables"])] if p["tables"] else []
        tags += [(530, 3, [1, 1])] if p["photometric"] == YCBCR else []
        formats, size = {3: "H", 4: "I", 13: "I", 16: "Q", 18: "Q"}, struct.calcsize(self.number)
        entries = []
        for tag, kind, values in sorted(tags):
            raw = values if isinstance(values, bytes) else struct.pack(f"<{len(values)}{formats[kind]}", *values)
            count = len(values) if not isinstance(values, bytes) else 1 if kind == 5 else len(values)
            inline = raw.ljust(size, b"\x00") if len(raw) <= size else struct.pack(self.number, self.append(raw))
            entries.append(struct.pack("<HH", tag, kind) + struct.pack(self.number, count) + inline)
        head = struct.pack("<Q" if self.big else "<H", len(entries))
        at = self.append(b"")
        self.out.write(head + b"".join(entries) + bytes(size))
        return at

    def close(self) -> None:
        """Sub-pages first, then the chain of pages in order."""
        parts: dict[int, list[int]] = {}
        for number in sorted(self.pages):
            p = self.pages[number]
            if p["parent"] >= 0:
                parts.setdefault(p["parent"], []).append(self.directory(p, []))
        size = struct.calcsize(self.number)
        link = 8 if self.big else 4
        for number in sorted(self.pages):
            p = self.pages[number]
            if p["parent"] < 0:
                at = self.directory(p, parts.get(number, []))
                end = self.out.tell()
                self.out.seek(link)
                self.out.write(struct.pack(self.number, at))
                self.out.seek(end)
                link = end - size
        if not self.big and self.out.tell() >= 1 << 32:
            raise FormatError("classic_file_too_large", "write")
        self.out.close()


class PagesWriter(DataSourceArrowWriter):
    """Two phases: files of this attempt, then renaming on commit."""

    def __init__(self, options: dict):
        system, self.folder = split_uri(options["path"])
        if system is not None:
            raise FormatError("remote_sink", "write", "slide files are written to mounted folders")
        self.suffix = options["suffix"]

    def write(self, iterator) -> Done:
        from pyspark import TaskContext

        os.makedirs(self.folder, exist_ok=True)
        attempt = TaskContext.get().taskAttemptId()
        files, current, out = [], object(), None
        try:
            for batch in iterator:
                for i in range(batch.num_rows):
                    row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                    if row["slide_id"] != current:
                        if out:
                            out.close()
                        current = row["slide_id"]
                        files.append(os.path.join(self.folder, f"{file_stem(current)}{self.suffix}.{attempt}.part"))
                        out = PageFile(files[-1], bool(row["big"]))
                    out.add(row)
            if out:
                out.close()
        except BaseException:
            self.remove(files)
            raise
        return Done(files)

    @staticmethod
    def remove(files: list[str]) -> None:
        for f in files:
            if os.path.exists(f):
                os.unlink(f)

    def commit(self, messages: list[Done | None]) -> None:
        for m in messages:
            for f in m.files if m else []:
                os.replace(f, f.rsplit(".", 2)[0])

    def abort(self, messages: list[Done | None]) -> None:
        for m in messages:
            self.remove(m.files if m else [])


class PagesSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "slide_pages_sink"

    def writer(self, schema, overwrite: bool) -> PagesWriter:
        return PagesWriter(self.options)


def write_pages(pages: DataFrame, segments: DataFrame, path: str, *, suffix: str) -> None:
    """One file for each slide of pages; its rows meet in one task, in order, and stream to the file."""
    spark = ship(pages.sparkSession)
    spark.dataSource.register(PagesSink)
    kinds = dict(x.split() for x in PAGE.split(", "))
    head = pages.select(*(F.col(c).cast(t).alias(c) for c, t in kinds.items()), F.lit(-1).cast("long").alias("segment"), F.lit(None).cast("binary").alias("payload"))
    body = segments.select(F.col("slide_id").cast("string").alias("slide_id"), F.col("page").cast("int").alias("page"), F.col("segment").cast("long").alias("segment"), "payload")
    # a page's facts come before its segments, all of them before any segment
    rows = head.withColumn("turn", F.lit(0)).unionByName(body.withColumn("turn", F.lit(1)), allowMissingColumns=True)
    rows = rows.repartition("slide_id").sortWithinPartitions("slide_id", "turn", "page", "segment").drop("turn")
    rows.write.format("slide_pages_sink").option("suffix", suffix).mode("append").save(path)


# ---------------------------------------------------------------- encoded tiles


def encoded_tiles(tiles: DataFrame, pixels: str = "payload", *, bands: int = 1, quality: int = 90, tile: int | None = None, stripped: bool = False, background: int = 255) -> DataFrame:
    """Tiles (w, h, pixels) as JPEG; with ``tile``, short ones are filled up to tile x tile."""
    ship(tiles.sparkSession)
    keep = [c for c in tiles.columns if c != pixels]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tiles.select(*keep).schema) + ", payload binary"
    wi, hi = keep.index("w"), keep.index("h")

    def one(p: bytes, w: int, h: int) -> bytes:
        px = decoded(p, h, w, bands)
        if tile and (h, w) != (tile, tile):
            full = np.full((tile, tile, bands), background, np.uint8)
            full[:h, :w] = px
            px = full
        return encode(px, quality, stripped=stripped)

    def work(parts) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            w, h = batch.column(wi).to_pylist(), batch.column(hi).to_pylist()
            out = [one(p.as_py(), *size) for p, *size in zip(batch.column(len(keep)), w, h)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(out, pa.binary())], names=[*keep, "payload"])

    return tiles.select(*keep, pixels).mapInArrow(work, kinds)


def passed_through(tiles: DataFrame, *, tile: int, bands: int, background: int = 255) -> DataFrame:
    """Complete tiles byte for byte; only short ones go through the codec (quality 100) to be filled up."""
    full = (F.col("w") == tile) & (F.col("h") == tile)
    short = encoded_tiles(tiles.where(~full), bands=bands, quality=100, tile=tile, background=background)
    return tiles.where(full).select(*short.columns).unionByName(short)


def segment_of(width, tile: int) -> Column:
    return div("y", tile) * ceil_div(width, tile) + div("x", tile)


def blank_tile(tile: int, bands: int, background: int) -> Column:
    return F.lit(bytearray(encode(np.full((tile, tile, bands), background, np.uint8), 100)))


def bytes_per_pixel(codec: str, quality) -> Column:
    base, step = DENSITY[codec]
    return F.lit(base) + F.lit(step) * (quality if isinstance(quality, Column) else F.lit(quality))


def estimated_bytes(levels: DataFrame, tile: int, per_pixel) -> DataFrame:
    """slide_id, bytes: pixels of whole tiles of all levels at so many bytes a pixel, and what files hold beside."""
    padded = (ceil_div("width", tile) * tile).cast("double") * (ceil_div("height", tile) * tile)
    return levels.groupBy("slide_id").agg((F.sum(padded * per_pixel) + BESIDE_PIXELS).alias("bytes"))


def page_facts(df: DataFrame, **facts: Column) -> DataFrame:
    """Rows with all columns of PAGE; those not given are empty."""
    rest = {"samples": F.lit(3), "bits": F.lit(8), "compression": F.lit(JPEG), "photometric": F.lit(YCBCR), "subfile": F.lit(0), "description": F.lit(""), "tables": F.lit(None), "parent": F.lit(-1), "mpp": F.lit(0.0), "big": F.lit(True), "blank": F.lit(None), "tile": F.lit(0)}
    own = {**rest, **facts}
    kinds = dict(x.split() for x in PAGE.split(", "))
    return df.select(*((own[c] if c in own else F.col(c)).cast(t).alias(c) for c, t in kinds.items()))


# ---------------------------------------------------------------- OME-TIFF from native levels


def write_native_ome(levels: DataFrame, tiles: DataFrame, path: str, *, tile: int, bands: int = 3, background: int = 255) -> None:
    """Every level as it is: the first as the page, the others as its sub-pages.

    levels: slide_id, level (0 is the largest), width, height, mpp, description (of the whole);
    tiles: slide_id, level, x, y, w, h, payload (JPEG)."""
    grey = bands == 1
    pages = page_facts(
        levels,
        page=F.col("level"), tile=F.lit(tile), samples=F.lit(bands), photometric=F.lit(GREY if grey else YCBCR), subfile=F.when(F.col("level") > 0, 1).otherwise(0),
        description=F.when(F.col("level") == 0, F.col("description")).otherwise(""), parent=F.when(F.col("level") > 0, 0).otherwise(-1), mpp=F.col("mpp"), blank=blank_tile(tile, bands, background),
    )
    sized = tiles.join(levels.select("slide_id", "level", "width"), ["slide_id", "level"])
    done = passed_through(sized, tile=tile, bands=bands, background=background)
    write_pages(pages, done.select("slide_id", F.col("level").alias("page"), segment_of("width", tile).alias("segment"), "payload"), path, suffix=".ome.tif")


# ---------------------------------------------------------------- resampling


def resized(pixels: np.ndarray, h: int, w: int) -> np.ndarray:
    """Rows x columns x bands in another size: means over the source area of each pixel, in one step for each axis."""

    def along(a: np.ndarray, n: int) -> np.ndarray:
        edges = np.arange(n + 1) * (len(a) / n)
        total = np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, 0, dtype=np.float64)])
        low = np.minimum(np.floor(edges).astype(int), len(a) - 1)
        at = total[low] + (edges - low).reshape(-1, *[1] * (a.ndim - 1)) * a[low]
        return (at[1:] - at[:-1]) / (len(a) / n)

    return np.clip(np.rint(along(along(pixels, h).swapaxes(0, 1), w).swapaxes(0, 1)), 0, 255).astype(np.uint8)


def resampled_tiles(tiles: DataFrame, targets: DataFrame, *, tile: int, bands: int, quality: int = 90, background: int = 255) -> DataFrame:
    """JPEG tiles of target levels from the tiles of native levels.

    targets: slide_id, page, level (the native one), source_width, source_height, width, height. Each
    target tile reads the window of the native level that it covers, rounded outward."""
    grid = tile_grid(targets, tile)
    across, down = F.col("source_width") / F.col("width"), F.col("source_height") / F.col("height")
    window = {
        "rx0": F.floor(F.col("x") * across), "ry0": F.floor(F.col("y") * down),
        "rx1": F.least(F.col("source_width"), F.ceil((F.col("x") + F.col("w")) * across)), "ry1": F.least(F.col("source_height"), F.ceil((F.col("y") + F.col("h")) * down)),
    }
    named = grid.withColumns({k: v.cast("long") for k, v in window.items()}).withColumn("region_id", F.xxhash64("slide_id", "page", "x", "y"))
    # a slide's native level is what tells its tiles apart
    key = F.concat_ws("/", F.col("slide_id").cast("string"), F.col("level").cast("string"))
    regions = named.select(key.alias("slide_id"), "region_id", "rx0", "ry0", "rx1", "ry1")
    found = read_regions(tiles.withColumn("slide_id", key), regions, background=background, bands=bands, bin_size=4 * tile)
    rows = named.select("region_id", "slide_id", "page", "x", "y", F.col("w").alias("tw"), F.col("h").alias("th"), "width").join(found, "region_id")

    def shrink(parts) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            out = []
            for p, w, h, tw, th in zip(batch.column(4), *(batch.column(i).to_pylist() for i in (5, 6, 7, 8))):
                px = resized(decoded(p.as_py(), h, w, bands), th, tw)
                full = np.full((tile, tile, bands), background, np.uint8)
                full[:th, :tw] = px
                out.append(encode(full, quality))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(out, pa.binary())], names=["slide_id", "page", "segment", "width", "payload"])

    kinds = rows.select("slide_id", "page").schema.simpleString()[7:-1]
    chosen = rows.select("slide_id", "page", segment_of("width", tile).alias("segment"), "width", "pixels", "w", "h", "tw", "th")
    kind = ", ".join(x.replace(":", " ") for x in kinds.split(",")) + ", segment long, width long, payload binary"
    return chosen.mapInArrow(shrink, kind).drop("width")


def fit_inside(width, height, most: int) -> tuple[Column, Column]:
    """Size of an image that fits a square without being enlarged."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(col(width), col(height)))
    side = lambda v: F.greatest(F.lit(1), F.bround(col(v) * scale, 0)).cast("long")
    return side(width), side(height)


# ---------------------------------------------------------------- SVS


def svs_levels(levels: DataFrame, *, factors: tuple[int, ...] = (4, 16, 32), least: int = 512) -> DataFrame:
    """Reduced levels of an SVS file, each with the native level of the nearest size: slide_id, page,
    level, source_width, source_height, width, height."""
    from ..operators.levels import fixed_levels

    main = levels.where("level = 0").select("slide_id", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"))
    wanted = fixed_levels(main, "width", "height", factors=factors, least=least)
    source = levels.select("slide_id", "level", F.col("width").cast("long").alias("source_width"), F.col("height").cast("long").alias("source_height"))
    apart = F.abs(F.col("source_width") - F.col("width")) + F.abs(F.col("source_height") - F.col("height"))
    best = F.min(F.struct(apart.alias("d"), "level", "source_width", "source_height")).alias("s")
    chosen = wanted.join(source, "slide_id").groupBy("slide_id", "factor", "width", "height").agg(best)
    number = F.array_position(F.array(*map(F.lit, factors)), F.col("factor")) + 1
    return chosen.select("slide_id", number.cast("int").alias("page"), "s.level", "s.source_width", "s.source_height", "width", "height")


def write_svs(levels: DataFrame, tiles: DataFrame, path: str, *, tile: int, bands: int = 3, associated: DataFrame | None = None, library: str = "Aperio Image Library", thumbnail: int = 1024, least: int = 512, quality: int = 90, background: int = 255) -> None:
    """SVS files: main page, thumbnail, reduced levels, label, macro, in this order.

    levels: slide_id, level, width, height, mpp, mag, stem, icc; tiles: slide_id, level, x, y, w, h,
    payload; associated: slide_id, kind (label, macro), w, h, payload. A level whose size is that of a
    native one takes its tiles; others are resampled from the nearest native level."""
    main = levels.where("level = 0")
    wanted = svs_levels(levels, least=least)
    copied = wanted.where("width = source_width and height = source_height")
    made = wanted.where("width != source_width or height != source_height")
    mode = F.lit(f"JPEG/RGB Q={quality}" if bands == 3 else "JPEG/Monochrome")
    small = fit_inside("width", "height", thumbnail)
    named = (F.col("mag"), F.col("stem"), F.col("mpp"), F.col("icc"))
    colour = {"samples": F.lit(bands), "photometric": F.lit(GREY if bands == 1 else YCBCR)}
    size = estimated_bytes(main.select("slide_id", "width", "height").unionByName(wanted.select("slide_id", "width", "height")), tile, bytes_per_pixel("jpeg", quality))
    whole = main.join(size, "slide_id").withColumn("large", F.col("bytes") > CLASSIC_LIMIT)
    blank = blank_tile(tile, bands, background)
    facts = [
        page_facts(whole, page=F.lit(0), tile=F.lit(tile), mpp=F.col("mpp"), big=F.col("large"), blank=blank, description=aperio_description(library, "width", "height", F.lit(tile), mode, *named), **colour),
        page_facts(whole.withColumns({"tw": small[0], "th": small[1]}).withColumns({"said": aperio_thumbnail_description(library, "width", "height", "tw", "th", *named)}).withColumns({"width": F.col("tw"), "height": F.col("th")}), page=F.lit(1), big=F.col("large"), description=F.col("said"), **colour),
    ]
    low = wanted.join(whole.select("slide_id", F.col("width").alias("main_width"), F.col("height").alias("main_height"), "large"), "slide_id")
    said = aperio_level_description(library, "main_width", "main_height", F.lit(tile), mode, "width", "height")
    facts.append(page_facts(low, page=F.col("page") + 1, tile=F.lit(tile), big=F.col("large"), blank=blank, description=said, **colour))
    on_main = tiles.where("level = 0").join(main.select("slide_id", "width"), "slide_id").withColumn("page", F.lit(0))
    on_low = tiles.join(copied.select("slide_id", "level", "page", "width"), ["slide_id", "level"]).withColumn("page", F.col("page") + 1)
    kept = passed_through(on_main.unionByName(on_low.select(*on_main.columns)), tile=tile, bands=bands, background=background)
    segments = [kept.select("slide_id", "page", segment_of("width", tile).alias("segment"), "payload")]
    segments.append(resampled_tiles(tiles, made, tile=tile, bands=bands, quality=quality, background=background).withColumn("page", F.col("page") + 1))
    segments.append(thumbnails(levels, tiles, most=thumbnail, bands=bands, background=background).select("slide_id", F.lit(1).alias("page"), F.lit(0).alias("segment"), "payload"))
    if associated is not None:
        order = F.when(F.col("kind") == "label", 8).when(F.col("kind") == "macro", 9)
        extra = associated.where(order.isNotNull()).join(whole.select("slide_id", "large"), "slide_id").withColumns({"width": F.col("w"), "height": F.col("h")})
        text = F.when(F.col("kind") == "label", aperio_associated_description(library, "label", "w", "h")).otherwise(aperio_associated_description(library, "macro", "w", "h"))
        facts.append(page_facts(extra, page=order, subfile=F.when(F.col("kind") == "label", 1).otherwise(9), big=F.col("large"), description=text))
        segments.append(extra.select("slide_id", order.alias("page"), F.lit(0).alias("segment"), "payload"))
    write_pages(reduce(DataFrame.unionByName, facts), reduce(DataFrame.unionByName, [s.select(F.col("slide_id").cast("string").alias("slide_id"), "page", F.col("segment").cast("long").alias("segment"), "payload") for s in segments]), path, suffix=".svs")


def thumbnails(levels: DataFrame, tiles: DataFrame, *, most: int = 1024, bands: int = 3, background: int = 255, quality: int = 90) -> DataFrame:
    """slide_id, w, h, payload: the whole slide as one JPEG that fits a square, from its smallest level
    that isn't smaller than the square (else its largest)."""
    long = F.greatest("width", "height")
    best = levels.groupBy("slide_id").agg(F.coalesce(F.min(F.when(long >= most, F.struct(long.alias("s"), "level", "width", "height"))), F.max(F.struct(long.alias("s"), "level", "width", "height"))).alias("l"))
    main = levels.where("level = 0").select("slide_id", *(x.alias(n) for x, n in zip(fit_inside("width", "height", most), ("tw", "th"))))
    chosen = best.select("slide_id", "l.level", F.col("l.width").alias("source_width"), F.col("l.height").alias("source_height")).join(main, "slide_id")
    # strips of the thumbnail, so that no task holds a whole level
    rows = 64
    strips = chosen.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), div(F.col("th") - 1, rows)))).withColumns({"y0": F.col("part") * rows, "y1": F.least(F.col("th"), (F.col("part") + 1) * rows)})
    down = F.col("source_height") / F.col("th")
    key = F.concat_ws("/", F.col("slide_id").cast("string"), F.col("level").cast("string"))
    named = strips.withColumns({"region_id": F.xxhash64("slide_id", "part"), "ry0": F.floor(F.col("y0") * down).cast("long"), "ry1": F.least(F.col("source_height").cast("long"), F.ceil(F.col("y1") * down).cast("long"))})
    regions = named.select(key.alias("slide_id"), "region_id", F.lit(0).cast("long").alias("rx0"), "ry0", F.col("source_width").cast("long").alias("rx1"), "ry1")
    found = read_regions(tiles.withColumn("slide_id", key), regions, background=background, bands=bands, bin_size=1024)
    pieces = named.select("region_id", F.col("slide_id").cast("string").alias("slide_id"), "part", "tw", (F.col("y1") - F.col("y0")).alias("rows"), "th").join(found, "region_id")

    def shrink(parts) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            out = [resized(decoded(p.as_py(), h, w, bands), n, tw).tobytes() for p, w, h, tw, n in zip(batch.column(4), *(batch.column(i).to_pylist() for i in (5, 6, 2, 7)))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(out, pa.binary())], names=["slide_id", "part", "tw", "th", "data"])

    small = pieces.select("slide_id", "part", "tw", "th", "pixels", "w", "h", "rows").mapInArrow(shrink, "slide_id string, part long, tw long, th long, data binary")

    def together(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        w, h = t["tw"][0].as_py(), t["th"][0].as_py()
        px = np.frombuffer(b"".join(t["data"].to_pylist()), np.uint8).reshape(h, w, bands)
        return pa.table({"slide_id": t["slide_id"].slice(0, 1), "w": pa.array([w], pa.int64()), "h": pa.array([h], pa.int64()), "payload": pa.array([encode(px, quality)], pa.binary())})

    # a thumbnail has at most most x most pixels
    return small.groupBy("slide_id").applyInArrow(together, "slide_id string, w long, h long, payload binary")


# ---------------------------------------------------------------- fluorescence


def fluorescence_refusal(modality="modality", bits="bit_depth", fields="n_field", z="n_z", t="n_t") -> Column:
    """Code of why a slide can't become a single-channel SVS; null if it can."""
    return (
        F.when(col(modality) != "fluorescence", "svs_not_fluorescence")
        .when(col(bits) != 8, "svs_bit_depth")
        .when((col(fields) != 1) | (col(z) != 1) | (col(t) != 1), "svs_axes")
    )


def write_fluorescence_svs(slides: DataFrame, levels: DataFrame, tiles: DataFrame, path: str, *, tile: int = 256, library: str = "Aperio Image Library", quality: int = 90) -> None:
    """One grey file for each slide: every native level as grey JPEG tiles, darkness where there is none.

    slides: slide_id, modality, bit_depth, n_field, n_z, n_t, dye, color (0xRRGGBB), exposure; a slide
    that can't become such a file is an error before anything is written. levels and tiles as in ``write_svs``."""
    bad = slides.select("slide_id", fluorescence_refusal().alias("code")).where("code is not null").orderBy("slide_id").first()
    if bad:
        raise FormatError(bad["code"], "eligibility", str(bad["slide_id"]))
    facts = levels.join(slides.select("slide_id", "dye", "color", "exposure"), "slide_id")
    size = F.format_string("%dx%d", F.col("width").cast("int"), F.col("height").cast("int"))
    said = F.concat(F.lit(library + "\r\n"), size, F.lit(" JPEG/Monochrome|Dye = "), "dye", F.lit("|DisplayColor = "), F.col("color").cast("string"), F.lit("|Exposure Time = "), F.col("exposure").cast("string"), F.format_string("|MPP = %.6f", "mpp"))
    pages = page_facts(facts, page=F.col("level"), tile=F.lit(tile), samples=F.lit(1), photometric=F.lit(GREY), subfile=F.when(F.col("level") > 0, 1).otherwise(0), description=F.when(F.col("level") == 0, said).otherwise(F.concat(F.lit("level "), F.col("level").cast("string"))), mpp=F.col("mpp"), blank=blank_tile(tile, 1, 0))
    regions = tile_grid(levels.select("slide_id", "level", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height")), tile)
    targets = regions.select("slide_id", "level", "width", "height").distinct().select("slide_id", F.col("level").alias("page"), "level", F.col("width").alias("source_width"), F.col("height").alias("source_height"), "width", "height")
    write_pages(pages, resampled_tiles(tiles, targets, tile=tile, bands=1, quality=quality, background=0), path, suffix=".svs")


def shared_tables(quality: int, bands: int) -> Column:
    """Tables that stripped tiles of a page share."""
    return F.lit(bytearray(tables(quality, bands)))


# ---------------------------------------------------------------- checks of written files


def compatibility_report(pages: DataFrame) -> DataFrame:
    """What readers need of a written SVS, from its scanned pages: the vendor by description, whether
    every level is tiled, whether the first page is the largest, photometric kinds, and what is wrong."""
    level = F.col("kind").isin("main", "level")
    by = pages.groupBy("path").agg(
        F.max(F.when(F.col("page") == 0, F.col("description").startswith("Aperio"))).alias("aperio"),
        F.min(F.when(level, F.col("tiled"))).alias("tiled"),
        F.max(F.when(F.col("page") == 0, F.col("width") * F.col("height"))).alias("first"),
        F.max(F.col("width") * F.col("height")).alias("largest"),
        F.count_if(level).alias("level_count"),
    )
    wrong = F.array_compact(F.array(F.when(~F.col("tiled"), "level_not_tiled"), F.when(F.col("first") < F.col("largest"), "main_not_first"), F.when(~F.col("aperio"), "not_aperio")))
    return by.select("path", F.when(F.col("aperio"), "aperio").otherwise("generic").alias("vendor"), "level_count", F.array_join(wrong, ",").alias("problems"))
