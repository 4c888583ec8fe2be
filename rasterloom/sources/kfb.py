"""KFB-family containers: classic (KFB, KFBL, KFBF), KFBA and KFBX.

Fixed records are numpy record types, so an index of millions of tiles is decoded and checked as
arrays. Payloads stay unread unless the payload column is asked for.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

from .jpeg import codec_of, frame_header
from .storage import Bytes, FormatError, open_bytes

SUFFIXES = (".kfb", ".kfbl", ".kfbf", ".kfba", ".kfbx")

# Fixed values of the formats.
HEADER_MARKERS = (b"\xf1\x01\xee\xee", b"\xf1\x02\xee\xee")
META_MARKER = b"\xff\x01\xee\xee"
DATA_MARKER = b"\xf1\x04\xee\xee"
DATA_END_MARKER = b"\xff\x04\xee\xee"
CLASSIC = {b"KFB\x00": "kfb", b"KFBL": "kfbl", b"KFBF": "kfbf"}
VERSIONS = tuple(round(1 + i / 10, 1) for i in range(14))
CODECS = ("JPEG", "JXL", "LJPEG", "SOF3")
KFBA_VERSION, KFBA_RECORD, KFBA_ITEMS = 1.4, 424, (0, 1, 2, 3, 4, 5, 6, 7, 10)
#: KFBX attributes: bytes of a value by type, and the numbers of those that are read.
VALUE_TYPES = {0: "<u1", 1: "<u1", 2: "<i4", 3: "<u8", 4: "<f4"}
TILE_W, TILE_H, LEVEL, WIDTH, HEIGHT, MAGNIFICATION, OFFSETS, COORDINATES, LENGTHS, COMPRESSION = 1, 2, 123, 3, 4, 5, 123, 134, 135, 2123
#: Channel directory: item and bytes for a channel.
CHANNEL_COUNT, CHANNEL_ITEMS = 75, {"vendor_id": (76, 20), "name": (77, 40), "equipment": (78, 4), "color": (79, 12), "exposure": (84, 8)}

HEADER_TYPE = np.dtype({"names": ["version", "tiles", "height", "width", "objective", "codec", "timestamp", "macro", "label", "mpp", "tile_size"], "formats": ["<f4", "<u4", "<u4", "<u4", "<u4", "S8", "<u4", "<u4", "<u4", "<f4", "<u4"], "offsets": [0x0C, 0x10, 0x14, 0x18, 0x1C, 0x20, 0x2C, 0x34, 0x38, 0x4C, 0x58], "itemsize": 0x5C})
RECORD_FIELDS = {"begin": ("S4", 0), "x": ("<i4", 4), "y": ("<i4", 8), "w": ("<i4", 12), "h": ("<i4", 16), "scale": ("<f4", 20), "length": ("<u4", 32), "at32": ("<i4", 36), "at64": ("<u8", 36), "size_at32": ("<u4", 44), "size_at64": ("<u8", 44)}
ASSOCIATED_TYPE = np.dtype({"names": ["b0", "kind", "m", "height", "width", "channels", "size", "at32", "at64", "len32", "len64", "end"], "formats": ["u1", "u1", "S2", "<u4", "<u4", "<u4", "<u4", "<u4", "<u8", "<u4", "<u8", "S4"], "offsets": [0, 1, 2, 8, 12, 16, 20, 24, 24, 32, 32, 48], "itemsize": 52})

SCHEMAS = {
    "header": "path string, container string, version string, width bigint, height bigint, tile_size bigint, n_tiles bigint, objective bigint, codec string, mpp double, timestamp bigint, n_channels bigint",
    "tiles": "path string, tile_no bigint, level bigint, field bigint, channel bigint, z bigint, t bigint, x bigint, y bigint, w bigint, h bigint, scale double, codec string, offset bigint, length bigint, payload binary",
    "levels": "path string, level bigint, scale double, width bigint, height bigint, n_tiles bigint",
    "associated": "path string, name string, width bigint, height bigint, channels bigint, offset bigint, length bigint, payload binary",
    "channels": "path string, channel bigint, vendor_id string, name string, equipment bigint, r bigint, g bigint, b bigint, exposure double, identity_source string",
    "metadata": "path string, tag bigint, value string, kind string",
}


class Container:
    """Header, channel directory and tile index of one file."""

    def __init__(self, data: Bytes):
        self.data = data
        self.channels: list[tuple] = []
        self.items: dict[int, bytes] = {}
        self.associated_at: list[tuple[str, int]] = []
        if data.size < 0x80:
            raise FormatError("header_truncated", "detect")
        prefix = data.at(0, 0x80)
        if prefix[:4] in HEADER_MARKERS and prefix[4:8] in CLASSIC:
            self.container = CLASSIC[prefix[4:8]]
            self.classic()
        elif prefix[:4] in HEADER_MARKERS and b"KFBA" in prefix:
            self.container = "kfba"
            self.kfba()
        elif prefix.startswith((b"KAC\x00", b"KFBX")):
            self.container = "kfbx"
            self.kfbx()
        else:
            raise FormatError("unknown_container", "detect")

    # ------------------------------------------------------------ common parts

    def read_header(self) -> np.void:
        h = np.frombuffer(self.data.at(0, 0x5C), HEADER_TYPE)[0]
        self.version_value = round(float(h["version"]), 1)
        self.version = f"{self.version_value:.1f}"
        self.width, self.height, self.tile_size, self.n_records = (int(h[k]) for k in ("width", "height", "tile_size", "tiles"))
        self.objective, self.timestamp, self.mpp = int(h["objective"]), int(h["timestamp"]), float(h["mpp"])
        self.codec = h["codec"].split(b"\x00")[0].decode("ascii", "replace").upper()
        if min(self.width, self.height, self.tile_size, self.n_records) <= 0:
            raise FormatError("invalid_header_dimensions", "header")
        if self.codec not in CODECS:
            raise FormatError("unsupported_codec", "header", self.codec)
        return h

    def read_items(self, end: int) -> None:
        """The tagged values behind the header; a later value of a tag replaces an earlier one."""
        blob = self.data.at(0x5C, end - 0x5C) if end > 0x64 else b""
        if blob[:4] != META_MARKER:
            return
        at = 8
        for _ in range(int.from_bytes(blob[4:8], "little")):
            if at + 8 > len(blob):
                raise FormatError("metadata_truncated", "metadata")
            tag, size = struct.unpack_from("<II", blob, at)
            if at + 8 + size > len(blob):
                raise FormatError("metadata_truncated", "metadata")
            self.items[tag] = blob[at + 8 : at + 8 + size]
            at += 8 + size

    def read_channels(self, code: str, stage: str, *, pointers: bool, needed: bool) -> None:
        """The channel directory: parallel arrays inline, or behind 64-bit pointers."""
        count = self.items.get(CHANNEL_COUNT)
        if count is None and not needed:
            return
        if count is None or len(count) != 4 or not int.from_bytes(count, "little"):
            raise FormatError(code, stage, "channel count")
        n = int.from_bytes(count, "little")
        column: dict[str, bytes] = {}
        for name, (tag, size) in CHANNEL_ITEMS.items():
            blob = self.items.get(tag)
            if blob is None or len(blob) != (8 if pointers else n * size):
                raise FormatError(code, stage, f"item {tag}")
            column[name] = self.data.at(int.from_bytes(blob, "little"), n * size) if pointers else blob
        text = lambda blob, i, size: blob[i * size : (i + 1) * size].split(b"\x00")[0].decode("utf-8", "replace").strip()
        colors = np.frombuffer(column["color"], "<i4").reshape(n, 3)
        if (colors < 0).any() or (colors > 255).any():
            raise FormatError("kfba_channel_metadata_invalid" if not pointers else code, stage, "colour")
        equipment, exposure = np.frombuffer(column["equipment"], "<i4"), np.frombuffer(column["exposure"], "<f8")
        for i in range(n):
            name = text(column["name"], i, 40)
            self.channels.append((i, text(column["vendor_id"], i, 20) or None, name or f"Channel {i + 1}", int(equipment[i]), *map(int, colors[i]), float(exposure[i]), "source_metadata" if name else "unknown"))

    def place(self, tiles: dict[str, np.ndarray], *, by_index: bool) -> None:
        """Levels from tiles, by falling scale or rising native index, and tiles in their order."""
        key = tiles["native"] if by_index else -tiles["scale"]
        ranks, level = np.unique(key, return_inverse=True)
        order = np.lexsort((tiles["t"], tiles["z"], tiles["channel"], tiles["x"], tiles["y"], tiles["field"], level))
        self.tiles = {k: v[order] for k, v in tiles.items()} | {"level": level[order]}
        self.levels = []
        for i in range(len(ranks)):
            own = level == i
            self.levels.append((i, float(tiles["scale"][own][0]), int((tiles["x"] + tiles["w"])[own].max()), int((tiles["y"] + tiles["h"])[own].max()), int(own.sum())))
        if self.levels[0][2:4] != (self.width, self.height):
            raise FormatError("main_level_size_mismatch", "levels", f"{self.levels[0][2:4]}")

    def check_payloads(self, offset: np.ndarray, length: np.ndarray) -> None:
        if (offset < 0).any() or (length <= 0).any() or (offset + length > self.data.size).any():
            raise FormatError("tile_payload_invalid", "index")

    # ------------------------------------------------------------ classic

    def classic(self) -> None:
        h = self.read_header()
        if self.version_value not in VERSIONS:
            raise FormatError("unsupported_version", "header", self.version)
        index_at = int.from_bytes(self.data.at(0x44, 4), "little")
        if not 0x60 <= index_at < self.data.size:
            raise FormatError("invalid_index_offset", "header")
        last = int.from_bytes(self.data.at(0x3C, 4), "little")
        self.associated_at = [("macro", int(h["macro"])), ("label", int(h["label"])), ("thumbnail", last)]
        self.read_items(min(x for x in (int(h["macro"]), index_at) if x > 0))
        self.read_channels("kfbf_channel_metadata_invalid", "kfbf_metadata", pointers=True, needed=False)
        self.place(self.classic_tiles(index_at), by_index=False)

    def classic_tiles(self, index_at: int) -> dict[str, np.ndarray]:
        size = 68 if self.version_value == 1.0 else 64
        kind = np.dtype({"names": [*RECORD_FIELDS, "end"], "formats": [*(f for f, _ in RECORD_FIELDS.values()), "S4"], "offsets": [*(o for _, o in RECORD_FIELDS.values()), size - 4], "itemsize": size})
        expected = self.n_records * size
        marked = lambda r: (r["begin"] == DATA_MARKER).all() and (r["end"] == DATA_END_MARKER).all()
        rows = np.frombuffer(self.data.at(index_at, expected), kind) if self.data.size - index_at >= expected else None
        if rows is None or not marked(rows):
            if self.data.size - index_at < 12:
                raise FormatError("compressed_index_truncated", "index")
            marker, packed, plain = struct.unpack("<4sII", self.data.at(index_at, 12))
            if marker != DATA_MARKER or plain != expected:
                raise FormatError("index_layout_invalid", "index")
            try:
                blob = zlib.decompress(self.data.at(index_at + 12, packed, code="compressed_index_truncated", stage="index"))
            except zlib.error as e:
                raise FormatError("compressed_index_invalid", "index") from e
            rows = np.frombuffer(blob, kind) if len(blob) == expected else None
            if rows is None or not marked(rows):
                raise FormatError("compressed_index_invalid", "index")
        length = rows["length"].astype(np.int64)
        wide = self.version_value >= 2.1
        if self.container == "kfbf":
            # pointers to pointers: both the place and the length are read where the record says
            follow = lambda places: np.array([int.from_bytes(self.data.at(int(p), 8, code="tile_payload_invalid", stage="index"), "little") for p in places], np.int64)
            offset, told = follow(rows["at64" if wide else "at32"]), follow(rows["size_at64" if wide else "size_at32"])
        else:
            offset, told = (rows["at64"].astype(np.int64) if wide else rows["at32"].astype(np.int64) + index_at), length
        scale = np.round(rows["scale"].astype(np.float64), 6)
        if (rows["w"] <= 0).any() or (rows["h"] <= 0).any() or (scale <= 0).any():
            raise FormatError("tile_geometry_invalid", "index")
        if (told != length).any():
            raise FormatError("tile_length_mismatch", "index")
        self.check_payloads(offset, length)
        zero = np.zeros(len(rows), np.int64)
        return {"x": rows["x"].astype(np.int64), "y": rows["y"].astype(np.int64), "w": rows["w"].astype(np.int64), "h": rows["h"].astype(np.int64), "scale": scale, "offset": offset, "length": length, "field": zero, "channel": zero, "z": zero, "t": zero, "native": zero}

    # ------------------------------------------------------------ KFBA

    def kfba(self) -> None:
        h = self.read_header()
        if self.version_value != KFBA_VERSION:
            raise FormatError("unsupported_version", "header", self.version)
        last, index_at = (int.from_bytes(self.data.at(o, 8), "little") for o in (0x3C, 0x44))
        if index_at < 0x80 or index_at + self.n_records * KFBA_RECORD > self.data.size:
            raise FormatError("invalid_index_offset", "header")
        self.associated_at = [("macro", int(h["macro"])), ("label", int(h["label"])), ("thumbnail", last)]
        self.read_items(min(x for x in (int(h["macro"]), int(h["label"]), last, index_at) if x > 0x5C))
        self.read_channels("kfba_required_metadata_missing", "kfba_metadata", pointers=False, needed=True)
        n = len(self.channels)
        rows = []
        for i in range(self.n_records):
            v = self.block_items(index_at + i * KFBA_RECORD)
            if not (0 < v[3] <= self.tile_size and 0 < v[2] <= self.tile_size):
                raise FormatError("tile_geometry_invalid", "kfba_index", f"block {i}")
            places, sizes = (np.frombuffer(self.data.at(v[k], n * 8, code="tile_payload_invalid", stage="kfba_index"), "<u8").astype(np.int64) for k in (4, 5))
            rows += [(v[0], v[1], v[3], v[2], self.objective / 2 ** v[7], int(places[c]), int(sizes[c]), v[6], c, 0, 0, v[7]) for c in range(n)]
        names = ("x", "y", "w", "h", "scale", "offset", "length", "field", "channel", "z", "t", "native")
        tiles = {k: np.array([r[i] for r in rows], np.float64 if k == "scale" else np.int64) for i, k in enumerate(names)}
        self.check_payloads(tiles["offset"], tiles["length"])
        for o, s in zip(tiles["offset"], tiles["length"]):
            payload = self.data.at(int(o), min(int(s), 4096))
            codec = codec_of(payload)
            if (codec == "JXL") != (self.codec == "JXL"):
                raise FormatError("mixed_codec_unsupported", "codec")
            if codec != "JXL" and n > 1 and frame_header(payload).components != 1:
                raise FormatError("kfba_channel_layout_unsupported", "codec")
        self.place(tiles, by_index=True)

    def block_items(self, at: int) -> dict[int, int]:
        """The (id, type, length, value) items of a data block."""
        count = int.from_bytes(self.data.at(at, 8), "little")
        if 8 + count * 20 > KFBA_RECORD:
            raise FormatError("kfba_item_truncated", "kfba_index")
        kind = np.dtype([("id", "<u4"), ("type", "<u4"), ("length", "<u4"), ("value", "<u8")])
        items = np.frombuffer(self.data.at(at + 8, count * 20), kind)
        out = {int(i): int(v) for i, v in zip(items["id"], items["value"])}
        if len(out) != count:
            raise FormatError("kfba_duplicate_item", "kfba_index")
        if set(KFBA_ITEMS) - set(out):
            raise FormatError("kfba_required_item_missing", "kfba_index")
        return out

    # ------------------------------------------------------------ KFBX

    def kfbx(self) -> None:
        first = int.from_bytes(self.data.at(68, 8), "little")
        if not 76 <= first < self.data.size:
            raise FormatError("kfbx_attribute_offset_invalid", "kfbx_index")
        top = attributes(self.data.at(first, self.data.size - first))
        single = {k: v for k, v in top if k != LEVEL}
        levels = [v for k, v in top if k == LEVEL]
        if not levels:
            raise FormatError("kfbx_required_metadata_missing", "kfbx_metadata", "no level")

        def one(values: dict, key: int) -> float:
            v = values.get(key)
            if v is None or len(v) != 1:
                raise FormatError("kfbx_required_metadata_missing", "kfbx_metadata", f"attribute {key}")
            return v[0]

        tile_w, tile_h, _ = one(single, TILE_W), one(single, TILE_H), one(single, COMPRESSION)
        if not 0 < tile_w == tile_h:
            raise FormatError("kfbx_tile_geometry_unsupported", "kfbx_metadata")
        self.tile_size = int(tile_w)
        parts = []
        for blob in levels:
            v = dict(attributes(blob.tobytes()))
            w, h, scale = int(one(v, WIDTH)), int(one(v, HEIGHT)), float(one(v, MAGNIFICATION))
            if any(k not in v for k in (OFFSETS, LENGTHS, COORDINATES)):
                raise FormatError("kfbx_required_metadata_missing", "kfbx_index")
            offset, length = v[OFFSETS].view("<u8").astype(np.int64) if v[OFFSETS].dtype == np.uint8 else v[OFFSETS].astype(np.int64), v[LENGTHS].astype(np.int64)
            where = v[COORDINATES].astype(np.int64)
            if len(offset) != len(length) or len(where) != 2 * len(offset):
                raise FormatError("kfbx_index_count_mismatch", "kfbx_index")
            x, y = where[::2], where[1::2]
            if w <= 0 or h <= 0 or scale <= 0 or (x < 0).any() or (y < 0).any() or (x >= w).any() or (y >= h).any():
                raise FormatError("tile_geometry_invalid", "kfbx_index")
            self.check_payloads(offset, length)
            parts.append((scale, w, h, x, y, offset, length))
        parts.sort(key=lambda p: -p[0])
        self.width, self.height = parts[0][1], parts[0][2]
        self.version, self.objective, self.timestamp, self.mpp = "unknown", max(1, round(parts[0][0])), 0, 0.0
        found = {codec_of(self.data.at(int(o), min(int(s), 4096))) for p in parts for o, s in zip(p[5], p[6])}
        if len(found) != 1:
            raise FormatError("mixed_codec_unsupported", "codec")
        self.codec = found.pop()
        cat = lambda i: np.concatenate([p[i] for p in parts])
        n = [len(p[3]) for p in parts]
        whole = lambda i: np.repeat([p[i] for p in parts], n)
        x, y = cat(3), cat(4)
        zero = np.zeros(len(x), np.int64)
        self.n_records = len(x)
        tiles = {"x": x, "y": y, "w": np.minimum(self.tile_size, whole(1) - x), "h": np.minimum(self.tile_size, whole(2) - y), "scale": whole(0).astype(float), "offset": cat(5), "length": cat(6), "field": zero, "channel": zero, "z": zero, "t": zero, "native": np.repeat(np.arange(len(parts)), n)}
        self.place(tiles, by_index=True)

    # ------------------------------------------------------------ tables

    def associated(self, with_payload: bool) -> Iterator[tuple]:
        seen: set[int] = set()
        for name, at in self.associated_at:
            if at <= 0 or at in seen:
                continue
            if at >= self.data.size:
                raise FormatError("associated_offset_invalid", "associated")
            seen.add(at)
            r = np.frombuffer(self.data.at(at, 52), ASSOCIATED_TYPE)[0]
            if r["b0"] != 0xF1 or r["m"] != b"\xee\xee" or r["end"] != bytes([0xFF, r["kind"], 0xEE, 0xEE]):
                raise FormatError("associated_marker_invalid", "associated", name)
            wide = self.container in ("kfbf", "kfba") and self.version_value >= 1.4
            place, size_at, size = int(r["at64" if wide else "at32"]), int(r["len64" if wide else "len32"]), int(r["size"])
            if place == 52:
                place = at + 52
            elif self.container == "kfba" or (self.container == "kfbf" and self.version_value >= 2.1):
                place, told = (int.from_bytes(self.data.at(p, 8, code="associated_payload_invalid", stage="associated"), "little") for p in (place, size_at))
                if told != size:
                    raise FormatError("associated_length_mismatch", "associated", name)
            else:
                raise FormatError("associated_position_invalid", "associated", name)
            if not r["width"] or not r["height"] or size <= 0 or place + size > self.data.size:
                raise FormatError("associated_payload_invalid", "associated", name)
            yield (self.data.name, name, int(r["width"]), int(r["height"]), int(r["channels"]), place, size, self.data.at(place, size) if with_payload else None)

    def metadata(self) -> Iterator[tuple]:
        for tag, value in sorted(self.items.items()):
            try:
                text = value.rstrip(b"\x00").decode()
            except UnicodeDecodeError:
                text = ""
            if text and text.isprintable():
                yield (self.data.name, tag, text, "text")
            elif len(value) == 4:
                yield (self.data.name, tag, str(int.from_bytes(value, "little")), "uint")
            else:
                yield (self.data.name, tag, value.hex(), "hex")


def attributes(blob: bytes) -> list[tuple[int, np.ndarray]]:
    """(id, values) of a typed attribute list."""
    out, at = [], 0
    while at < len(blob):
        if at + 8 > len(blob):
            raise FormatError("kfbx_attribute_truncated", "kfbx_index")
        key, kind, count = struct.unpack_from("<HHI", blob, at)
        if kind not in VALUE_TYPES:
            raise FormatError("kfbx_value_type_unsupported", "kfbx_index", str(kind))
        size = count * np.dtype(VALUE_TYPES[kind]).itemsize
        if at + 8 + size > len(blob):
            raise FormatError("kfbx_attribute_truncated", "kfbx_index")
        out.append((key, np.frombuffer(blob, VALUE_TYPES[kind], count, at + 8)))
        at += 8 + size
    return out


def rows_of(path: str, table: str, *, with_payload: bool = True, level: int | None = None) -> Iterator[tuple]:
    """Rows of one logical table of a file; level prunes tiles before any payload is read."""
    with open_bytes(path) as data:
        data.name = path
        c = Container(data)
        if table == "header":
            yield (path, c.container, c.version, c.width, c.height, c.tile_size, len(c.tiles["x"]), c.objective, c.codec, c.mpp, c.timestamp, max(1, len(c.channels)))
        elif table == "levels":
            for row in c.levels:
                yield (path, *row)
        elif table == "channels":
            for row in c.channels:
                yield (path, *row)
        elif table == "associated":
            yield from c.associated(with_payload)
        elif table == "metadata":
            yield from c.metadata()
        elif table == "tiles":
            t = c.tiles
            for i in np.flatnonzero(t["level"] == level) if level is not None else range(len(t["x"])):
                offset, length = int(t["offset"][i]), int(t["length"][i])
                yield (path, int(i), *(int(t[k][i]) for k in ("level", "field", "channel", "z", "t", "x", "y", "w", "h")), float(t["scale"][i]), c.codec, offset, length, data.at(offset, length) if with_payload else None)
