"""``.image`` containers: a header, JPEG tiles, a column-major pyramid index and a hexadecimal tail."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from .storage import Bytes, FormatError, open_bytes

SUFFIXES = (".image",)

# Fixed values of the format.
HEADER_SIZE, TAIL_SIZE, TILE, MOST_LEVELS = 0xAC, 33, 256, 32
TAIL = re.compile(rb"[0-9a-fA-F]{32}\x00")
HEADER_TYPE = np.dtype({"names": ["thumbnail", "label", "index", "um_w", "um_h", "width", "height", "zoom", "device_len"], "formats": ["<u8", "<u8", "<u8", "<f4", "<f4", "<u4", "<u4", "<u4", "<u4"], "offsets": [0x00, 0x08, 0x10, 0x18, 0x1C, 0x20, 0x24, 0x38, 0x53], "itemsize": HEADER_SIZE})
TEXTS = {"scan_time": (0x40, 0x13), "institution": (0x84, 0x0C), "case_no": (0x98, 0x14)}
DEVICE_AT, DEVICE_END = 0x57, 0x84
RECORD_TYPE = np.dtype([("length", "<u4"), ("offset", "<u8")])
THUMBNAIL_W, LABEL_W, MACRO = 300, 300, (1152, 625, 24)

SCHEMAS = {
    "header": "path string, width bigint, height bigint, mpp_x double, mpp_y double, max_zoom bigint, scan_time string, device_no string, institution string, case_no string, tail_id string",
    "tiles": "path string, level bigint, tile_row bigint, tile_col bigint, x bigint, y bigint, row_major bigint, column_major bigint, offset bigint, length bigint, blank boolean, payload binary",
    "levels": "path string, level bigint, n_cols bigint, n_rows bigint, width bigint, height bigint, n_blank bigint",
    "associated": "path string, name string, width bigint, height bigint, offset bigint, payload binary",
}


class Container:
    def __init__(self, data: Bytes):
        self.data = data
        if data.size < HEADER_SIZE + TAIL_SIZE:
            raise FormatError("header_truncated", "header")
        raw = data.at(0, HEADER_SIZE)
        tail = data.at(data.size - TAIL_SIZE, TAIL_SIZE)
        if not TAIL.fullmatch(tail):
            raise FormatError("tail_invalid", "header")
        self.tail_id = tail[:-1].decode().lower()
        self.head = np.frombuffer(raw, HEADER_TYPE)[0]
        self.width, self.height, self.index_at = (int(self.head[k]) for k in ("width", "height", "index"))
        self.end = data.size - TAIL_SIZE
        if not HEADER_SIZE <= self.index_at < self.end:
            raise FormatError("index_offset_invalid", "header")
        if self.width <= 0 or self.height <= 0 or self.head["um_w"] <= 0 or self.head["um_h"] <= 0:
            raise FormatError("size_invalid", "header")
        device = int(self.head["device_len"])
        if DEVICE_AT + device > DEVICE_END:
            raise FormatError("device_length_invalid", "header")
        text = lambda at, size: raw[at : at + size].split(b"\x00")[0].decode("gbk", "replace").strip()
        self.texts = {k: text(*v) for k, v in TEXTS.items()} | {"device_no": text(DEVICE_AT, device)}
        self.levels = self.read_levels()

    def read_levels(self) -> list[np.ndarray]:
        """For each level its records as a rows x columns array; the file has them column by column."""
        levels, at = [], self.index_at
        while at < self.end:
            if len(levels) == MOST_LEVELS:
                raise FormatError("too_many_levels", "index")
            if at + 8 > self.end:
                raise FormatError("level_truncated", "index")
            columns, rows = np.frombuffer(self.data.at(at, 8), "<u4").astype(int)
            size = columns * rows * RECORD_TYPE.itemsize
            if columns <= 0 or rows <= 0 or at + 8 + size > self.end:
                raise FormatError("level_truncated", "index")
            records = np.frombuffer(self.data.at(at + 8, size), RECORD_TYPE).reshape(columns, rows).T
            offset, length = records["offset"].astype(np.int64), records["length"].astype(np.int64)
            if (offset < HEADER_SIZE).any() or (offset + length > self.index_at).any():
                raise FormatError("tile_offset_invalid", "index")
            for o, n in zip(offset[length > 0], length[length > 0]):
                if n < 5 or self.data.at(int(o), 3) != b"\xff\xd8\xff" or self.data.at(int(o + n - 2), 2) != b"\xff\xd9":
                    raise FormatError("tile_not_jpeg", "index")
            levels.append(records)
            at += 8 + size
        if at != self.end:
            raise FormatError("index_end_mismatch", "index")
        if (levels[0].shape[1] * TILE, levels[0].shape[0] * TILE) != (self.width, self.height):
            raise FormatError("main_level_size_mismatch", "levels")
        return levels

    def associated(self) -> Iterator[tuple[str, int, int, int]]:
        """Raw RGB areas before the tiles. Their heights follow from where the next area begins; if
        that doesn't work out, there are none."""
        first, label = int(self.head["thumbnail"]), int(self.head["label"])
        used = [int(r["offset"][r["length"] > 0].min()) for r in self.levels if (r["length"] > 0).any()]
        if not used or not HEADER_SIZE <= first < label < self.index_at or min(used) <= label:
            return
        macro = MACRO[0] * MACRO[1] * 3
        thumbnail, rest = label - first - macro - MACRO[2], min(used) - label
        if thumbnail <= 0 or thumbnail % (THUMBNAIL_W * 3) or rest % (LABEL_W * 3):
            return
        yield "thumbnail", first, THUMBNAIL_W, thumbnail // (THUMBNAIL_W * 3)
        yield "macro", first + thumbnail, MACRO[0], MACRO[1]
        yield "label", label, LABEL_W, rest // (LABEL_W * 3)


def rows_of(path: str, table: str, *, with_payload: bool = True, level: int | None = None) -> Iterator[tuple]:
    with open_bytes(path) as data:
        c = Container(data)
        if table == "header":
            t = c.texts
            yield (path, c.width, c.height, float(c.head["um_w"]) / c.width, float(c.head["um_h"]) / c.height, int(c.head["zoom"]), t["scan_time"], t["device_no"], t["institution"], t["case_no"], c.tail_id)
        elif table == "levels":
            for i, r in enumerate(c.levels):
                yield (path, i, r.shape[1], r.shape[0], r.shape[1] * TILE, r.shape[0] * TILE, int((r["length"] == 0).sum()))
        elif table == "associated":
            for name, at, w, h in c.associated():
                yield (path, name, w, h, at, data.at(at, w * h * 3) if with_payload else None)
        elif table == "tiles":
            for i, records in enumerate(c.levels):
                if level is not None and i != level:
                    continue
                rows, columns = records.shape
                for r in range(rows):
                    for k in range(columns):
                        offset, n = int(records["offset"][r, k]), int(records["length"][r, k])
                        yield (path, i, r, k, k * TILE, r * TILE, r * columns + k, k * rows + r, offset, n, n == 0, data.at(offset, n) if n and with_payload else None)
