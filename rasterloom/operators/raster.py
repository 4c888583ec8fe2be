"""Pixels of tiles: encoding, region reads, reduced levels, tile streams.

A tile row is slide_id, level, x, y, w, h, payload: a baseline JPEG, or a byte that tells the coding and
row-major samples of one or two bytes and ``bands`` bands, raw or zlib-packed. Regions and reduced tiles are groups of a few neighbouring tiles, so a
group stays small however large a slide is.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jpeg_codec
from ..functions.arithmetic import ceil_div, col, div
from ..plans.session import ship
from .joins import overlap_join

#: First byte of a payload: raw or packed samples of 8 bits, packed ones of 16 bits.
RAW, PACKED, DEEP = b"\x00", b"\x01", b"\x02"
SAMPLE = {8: np.uint8, 16: np.uint16}


def encoded(samples: np.ndarray, *, packed: bool = True) -> bytes:
    if samples.dtype == np.uint16:
        return DEEP + zlib.compress(np.ascontiguousarray(samples, "<u2").tobytes(), 1)
    raw = np.ascontiguousarray(samples, np.uint8).tobytes()
    return PACKED + zlib.compress(raw, 1) if packed else RAW + raw


def encode_tiles(df: DataFrame, pixels: str, *, packed: bool = True, bits: int = 8) -> DataFrame:
    """The array column as payload bytes, of samples of 8 or 16 bits."""
    ship(df.sparkSession)
    keep = [c for c in df.columns if c != pixels]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema) + ", payload binary"

    def encode(parts):
        for batch in parts:
            payload = [encoded(np.asarray(x, SAMPLE[bits]), packed=packed) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(payload, pa.binary())], names=[*keep, "payload"])

    return df.select(*keep, pixels).mapInArrow(encode, kinds)


@lru_cache(maxsize=64)
def jpeg_samples(payload: bytes) -> np.ndarray:
    """Samples of a JPEG payload; a task keeps the last few, since neighbouring regions share tiles."""
    return jpeg_codec.decode(payload)


def decoded(payload: bytes, h: int, w: int, bands: int = 1) -> np.ndarray:
    """Samples of a payload as rows x columns x bands; a wrong size is an error."""
    if payload[:2] == b"\xff\xd8":
        out = jpeg_samples(payload)
        if out.shape[:2] != (h, w):
            raise ValueError(f"payload is {out.shape[1]} x {out.shape[0]}, {w} x {h} was expected")
        # grey and colour stand for each other: by repeating, and by the green band
        return out if out.shape[2] == bands else out.repeat(bands, 2) if out.shape[2] == 1 else out[:, :, 1:2]
    raw = payload[1:] if payload[:1] == RAW else zlib.decompress(payload[1:])
    samples = np.frombuffer(raw, "<u2" if payload[:1] == DEEP else np.uint8)
    if len(samples) != h * w * bands:
        raise ValueError(f"payload has {len(samples)} samples, {h * w * bands} were expected")
    return samples.reshape(h, w, bands)


def read_regions(tiles: DataFrame, regions: DataFrame, *, background: int = 255, bands: int = 1, bits: int = 8, bin_size: int = 256, owned: bool = False) -> DataFrame:
    """Pixels of each region (slide_id, region_id, rx0, ry0, rx1, ry1): the parts of tiles that lie in
    it, pasted on the background. With ``owned``, only the part own_x0 .. own_y1 of each tile counts,
    so where tiles overlap each pixel has one source.

    Regions that no tile meets are background throughout. Result: region_id, w, h, pixels.
    """
    ship(tiles.sparkSession)
    boxes = tiles.withColumns({"tx1": F.col("x") + F.col("w"), "ty1": F.col("y") + F.col("h")})
    pairs = overlap_join(boxes, regions, on=["slide_id"], left_box=("x", "y", "tx1", "ty1"), right_box=("rx0", "ry0", "rx1", "ry1"), bin_size=bin_size)
    own = [F.col(c if owned else d).alias(c) for c, d in (("own_x0", "x"), ("own_x1", "tx1"), ("own_y0", "y"), ("own_y1", "ty1"))]
    cells = pairs.select("region_id", "rx0", "ry0", "rx1", "ry1", "x", "y", "w", "h", *own, "payload")
    empty = regions.join(cells.select("region_id").distinct(), "region_id", "left_anti").select("region_id", "rx0", "ry0", "rx1", "ry1")

    def paste(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        r = rows[0]
        w, h = r["rx1"] - r["rx0"], r["ry1"] - r["ry0"]
        out = np.full((h, w, bands), background, SAMPLE[bits])
        for t in sorted((t for t in rows if t["payload"] is not None), key=lambda t: (t["y"], t["x"])):
            x0, x1 = max(r["rx0"], t["own_x0"]), min(r["rx1"], t["own_x1"])
            y0, y1 = max(r["ry0"], t["own_y0"]), min(r["ry1"], t["own_y1"])
            if x0 < x1 and y0 < y1:
                px = decoded(t["payload"], t["h"], t["w"], bands)
                out[y0 - r["ry0"] : y1 - r["ry0"], x0 - r["rx0"] : x1 - r["rx0"]] = px[y0 - t["y"] : y1 - t["y"], x0 - t["x"] : x1 - t["x"]]
        return pa.table({"region_id": pa.array([r["region_id"]], pa.int64()), "w": pa.array([w], pa.int64()), "h": pa.array([h], pa.int64()), "pixels": pa.array([encoded(out)], pa.binary())})

    kind = "region_id long, w long, h long, pixels binary"
    return cells.unionByName(empty, allowMissingColumns=True).groupBy("region_id").applyInArrow(paste, kind)


def reduce_level(tiles: DataFrame, *, tile: int, factor: int = 2, bands: int = 1, bits: int = 8, background: int = 255) -> DataFrame:
    """The next level: every factor x factor pixels become their mean, rounded half to even.

    A reduced tile comes from factor x factor tiles of the grid, so one group by the reduced tile's
    place suffices; parts of it that no tile covers have the background's colour. Edge pixels average
    what is there.
    """
    ship(tiles.sparkSession)
    up = tiles.withColumns({"px": div("x", tile * factor) * tile, "py": div("y", tile * factor) * tile})

    def shrink(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        r = rows[0]
        x0, y0 = r["px"] * factor, r["py"] * factor
        w, h = max(t["x"] + t["w"] for t in rows) - x0, max(t["y"] + t["h"] for t in rows) - y0
        size = (-(-h // factor), -(-w // factor))
        big = np.full((size[0] * factor, size[1] * factor, bands), background, np.int64)
        weight = np.zeros(big.shape[:2], np.int64)
        weight[:h, :w] = 1
        for t in rows:
            big[t["y"] - y0 : t["y"] - y0 + t["h"], t["x"] - x0 : t["x"] - x0 + t["w"]] = decoded(t["payload"], t["h"], t["w"], bands)
        folded = lambda a: a.reshape(size[0], factor, size[1], factor, -1).sum((1, 3))
        mean = np.rint(folded(big * weight[:, :, None]) / folded(weight)).astype(SAMPLE[bits])
        out = {"slide_id": r["slide_id"], "level": r["level"] + 1, "x": r["px"], "y": r["py"], "w": size[1], "h": size[0]}
        return pa.table({**{k: pa.array([v], pa.int64()) for k, v in out.items()}, "payload": pa.array([encoded(mean)], pa.binary())})

    cols = ["slide_id", "level", "x", "y", "w", "h", "px", "py", "payload"]
    return up.select(*cols).groupBy("slide_id", "level", "px", "py").applyInArrow(shrink, "slide_id long, level long, x long, y long, w long, h long, payload binary")


def pixels_of(df: DataFrame, payload: str = "pixels", *, width: str = "w", height: str = "h") -> DataFrame:
    """One row for each sample of single-band payloads: i in row-major order, and v."""
    ship(df.sparkSession)
    keep = [c for c in df.columns if c not in (payload,)]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema) + ", v array<bigint>"
    wi, hi = keep.index(width), keep.index(height)

    def spread(parts):
        for batch in parts:
            ws, hs = batch.column(wi).to_pylist(), batch.column(hi).to_pylist()
            v = [decoded(p.as_py(), h, w).ravel().astype(np.int64) for p, w, h in zip(batch.column(len(keep)), ws, hs)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(v, pa.list_(pa.int64()))], names=[*keep, "v"])

    rows = df.select(*keep, payload).mapInArrow(spread, kinds)
    return rows.select(*keep, F.posexplode("v").alias("i", "v")).withColumn("i", F.col("i").cast("bigint"))


def tile_grid(images: DataFrame, tile: int) -> DataFrame:
    """Row-major tiles of each image (width, height): tile_no from 1, place and size."""
    grid = images.withColumns({"cols": ceil_div("width", tile), "rows": ceil_div("height", tile)})
    zero = F.lit(0).cast("bigint")
    grid = grid.withColumn("ty", F.explode(F.sequence(zero, F.col("rows") - 1))).withColumn("tx", F.explode(F.sequence(zero, F.col("cols") - 1)))
    x, y = F.col("tx") * tile, F.col("ty") * tile
    return grid.withColumns({"tile_no": F.col("ty") * F.col("cols") + F.col("tx") + 1, "x": x, "y": y, "w": F.least(F.lit(tile), F.col("width") - x), "h": F.least(F.lit(tile), F.col("height") - y)}).drop("tx", "ty", "cols", "rows")


def passthrough(full: Column, payload: str, short: Column, blank: Column) -> Column:
    """Payload of an output tile: the source's own bytes where the tile is complete, what ``short``
    makes of it at the edges, and the blank tile where there is none."""
    p = col(payload)
    return F.when(p.isNull(), blank).when(full, p).otherwise(short)


def buffer_factor(width, height, budget_mb: float, *, share: float = 0.55, bands: int = 3) -> Column:
    """The least power of two by which an image must shrink for its samples to fit a share of a memory budget."""
    need = col(width).cast("double") * col(height) * bands / (share * budget_mb * 1024 * 1024)
    return F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2(F.greatest(need, F.lit(1.0))) / 2))).cast("bigint")


def source_window(start, size, source_size, target_size) -> tuple[Column, Column]:
    """Window of the source that a window of a resized view needs, rounded outward."""
    scale = col(source_size).cast("double") / col(target_size)
    begin = F.floor(col(start) * scale).cast("bigint")
    end = F.least(col(source_size), F.ceil((col(start) + col(size)) * scale).cast("bigint"))
    return begin, F.greatest(begin + 1, end)
