"""TIFF and SVS: pages, segments and what their descriptions say about the slide.

A small walker reads classic and BigTIFF directories of either byte order. If a file's directory
pointer is off by a constant (bytes were lost or added before it), the directory is looked for in
the file's end, and all later positions are shifted by the same amount.
"""

from __future__ import annotations

import re
import struct
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from ..functions.text import LENGTH_UNITS, MAGNIFICATION_KEYS, PIXEL_SIZE_KEYS, TIME_UNITS, numbered_property
from .storage import Bytes, FormatError, open_bytes

SUFFIXES = (".tif", ".tiff", ".svs")

#: Bytes of a value by field type, and struct codes. Fixed values.
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 7: "c", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
SUBFILE, WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, STRIP_AT, SAMPLES, ROWS, STRIP_N, XRES, YRES, PLANAR, RES_UNIT, TILE_W, TILE_H, TILE_AT, TILE_N, SUB_IFDS = 254, 256, 257, 258, 259, 262, 270, 273, 277, 278, 279, 282, 283, 284, 296, 322, 323, 324, 325, 330
PALETTE = 3
CODECS = {1: "raw", 5: "LZW", 7: "JPEG", 8: "deflate", 32946: "deflate", 33003: "J2K", 33005: "J2K", 50001: "WebP", 50002: "JXL"}
SCAN_BYTES = 64 << 20

SCHEMAS = {
    "header": "path string, width bigint, height bigint, bit_depth bigint, samples bigint, codec string, modality string, mpp double, magnification bigint, n_levels bigint, n_channels bigint, n_z bigint, n_t bigint, shifted_by bigint, vendor string",
    "pages": "path string, page bigint, kind string, width bigint, height bigint, tile_w bigint, tile_h bigint, tiled boolean, samples bigint, bits bigint, compression bigint, subfile bigint, n_segments bigint, description string",
    "segments": "path string, page bigint, segment bigint, x bigint, y bigint, w bigint, h bigint, offset bigint, length bigint, payload binary",
    "channels": "path string, channel bigint, name string, fluor string, r bigint, g bigint, b bigint, excitation_nm double, emission_nm double, exposure_s double, identity_source string",
}


class Page(dict):
    """Tags of one directory."""

    def one(self, tag: int, default=0):
        v = self.get(tag)
        return v[0] if v else default

    @property
    def size(self) -> tuple[int, int]:
        return self.one(WIDTH), self.one(HEIGHT)

    @property
    def tiled(self) -> bool:
        return TILE_W in self

    @property
    def segment_size(self) -> tuple[int, int]:
        return (self.one(TILE_W), self.one(TILE_H)) if self.tiled else (self.one(WIDTH), min(self.one(ROWS, self.one(HEIGHT)), self.one(HEIGHT)))

    @property
    def places(self) -> tuple[list[int], list[int]]:
        return (self.get(TILE_AT, []), self.get(TILE_N, [])) if self.tiled else (self.get(STRIP_AT, []), self.get(STRIP_N, []))

    @property
    def description(self) -> str:
        v = self.get(DESCRIPTION)
        return v[0] if v else ""


class Tiff:
    def __init__(self, data: Bytes):
        self.data, self.shift, self.threshold = data, 0, 0
        head = data.at(0, 16 if data.size >= 16 else 8, code="header_truncated", stage="header")
        if head[:2] not in (b"II", b"MM"):
            raise FormatError("not_tiff", "header")
        self.order = "<" if head[:2] == b"II" else ">"
        version = struct.unpack_from(self.order + "H", head, 2)[0]
        if version not in (42, 43):
            raise FormatError("not_tiff", "header")
        self.big = version == 43
        first = struct.unpack_from(self.order + ("Q" if self.big else "I"), head, 8 if self.big else 4)[0]
        try:
            self.pages = self.walk(first)
        except FormatError:
            found = None if self.big or self.order == ">" else self.find_directory(first)
            if found is None:
                raise
            self.threshold, self.shift = first, found - first
            self.pages = self.walk(first)
        if not self.pages:
            raise FormatError("no_pages", "directory")
        self.describe()

    def place(self, offset: int) -> int:
        """Where a stored position really is."""
        return offset + self.shift if self.shift and offset >= self.threshold else offset

    def walk(self, first: int) -> list[Page]:
        pages, at, seen = [], first, set()
        while at and at not in seen:
            seen.add(at)
            page, at = self.directory(at)
            pages.append(page)
            # parts of a page, as its reduced levels, follow it
            for sub in page.get(SUB_IFDS) or []:
                if sub not in seen:
                    seen.add(sub)
                    pages.append(self.directory(sub)[0])
        return pages

    def directory(self, stored: int) -> tuple[Page, int]:
        at = self.place(stored)
        count_code, size, inline, next_code = ("Q", 20, 8, "Q") if self.big else ("H", 12, 4, "I")
        head = struct.calcsize(count_code)
        n = struct.unpack(self.order + count_code, self.data.at(at, head, code="directory_truncated", stage="directory"))[0]
        if not 1 <= n <= 4096:
            raise FormatError("directory_invalid", "directory")
        blob = self.data.at(at + head, n * size + inline, code="directory_truncated", stage="directory")
        page, previous = Page(), -1
        for i in range(n):
            tag, kind = struct.unpack_from(self.order + "HH", blob, i * size)
            count = struct.unpack_from(self.order + ("Q" if self.big else "I"), blob, i * size + 4)[0]
            if tag < previous or kind not in TYPES:
                raise FormatError("directory_invalid", "directory", f"tag {tag}")
            previous = tag
            page[tag] = self.values(kind, count, blob[i * size + size - inline : i * size + size], tag)
        return page, struct.unpack_from(self.order + next_code, blob, n * size)[0]

    def values(self, kind: int, count: int, inline: bytes, tag: int) -> list:
        code = TYPES[kind]
        width = struct.calcsize("<" + code)
        if count * width > len(inline):
            at = struct.unpack(self.order + ("Q" if self.big else "I"), inline)[0]
            raw = self.data.at(self.place(at), count * width, code="tag_out_of_bounds", stage="directory")
        else:
            raw = inline[: count * width]
        if kind in (2, 7):
            return [raw.split(b"\x00")[0].decode("utf-8", "replace") if kind == 2 or tag == DESCRIPTION else raw]
        out = struct.unpack(self.order + code * count, raw)
        if len(code) == 2:
            return [a / b if b else 0.0 for a, b in zip(out[::2], out[1::2])]
        return list(out)

    def find_directory(self, stored: int) -> int | None:
        """A plausible directory in the file's last bytes: rising tags, sizes and description among
        them, and a table of segment positions that lie in the file when shifted alike."""
        size = self.data.size
        begin = max(8, size - SCAN_BYTES)
        blob = self.data.at(begin, size - begin)
        for at in range(max(0, stored + 1 - begin), len(blob) - 6):
            n = int.from_bytes(blob[at : at + 2], "little")
            if not 8 <= n <= 200 or at + 6 + n * 12 > len(blob):
                continue
            rows = list(struct.iter_unpack("<HHII", blob[at + 2 : at + 2 + n * 12]))
            tags = [r[0] for r in rows]
            if tags != sorted(tags) or any(not 0 < r[1] <= 18 for r in rows):
                continue
            by_tag = {r[0]: r for r in rows}
            table = by_tag.get(TILE_AT) or by_tag.get(STRIP_AT)
            if not {WIDTH, HEIGHT, DESCRIPTION} <= set(tags) or table is None or not table[2]:
                continue
            k, delta = min(table[2], 8), begin + at - stored
            where = table[3] + (delta if table[3] >= stored else 0)
            if table[2] == 1:
                found = (table[3],)
            elif 8 <= where and where + 4 * k <= size:
                found = struct.unpack(f"<{k}I", self.data.at(where, 4 * k))
            else:
                continue
            if all(8 <= o < size for o in found):
                return begin + at
        return None

    # ------------------------------------------------------------ meaning

    def describe(self) -> None:
        main = self.pages[0]
        self.samples, self.bits = main.one(SAMPLES, 1), main.one(BITS, 8)
        self.channels: list[tuple] = []
        self.n_c, self.n_z, self.n_t, self.modality, self.vendor = 1, 1, 1, "unknown", "generic"
        self.axis_mpp: list[float] = []
        text = main.description
        if text.lstrip().startswith("<") and "OME" in text[:4000]:
            self.vendor = "ome"
            self.describe_ome(text)
        elif text.startswith("Aperio") or "|AppMag" in text or "|Dye" in text:
            self.vendor = "aperio"
            self.describe_aperio(text)
        if self.modality == "unknown" and self.samples >= 3 and not self.channels:
            self.modality = "brightfield"
        if self.bits not in (8, 16) or (self.bits == 16 and self.modality != "fluorescence") or self.samples not in (1, 3, 4) or main.one(PLANAR, 1) != 1 or main.one(PHOTOMETRIC) == PALETTE:
            raise FormatError("unsupported_page", "page")

    def describe_ome(self, text: str) -> None:
        plain = lambda e: e.tag.rsplit("}", 1)[-1]
        try:
            root = ET.fromstring(text)
        except ET.ParseError as e:
            raise FormatError("ome_xml_invalid", "description") from e
        pixels = next((p for image in root.iter() if plain(image) == "Image" and (image.get("Name") or "").lower() not in ("macro", "label", "thumbnail") for p in image if plain(p) == "Pixels"), None)
        if pixels is None:
            return
        self.n_c, self.n_z, self.n_t = (int(pixels.get(f"Size{a}", 1)) for a in "CZT")
        self.axis_mpp = [unit_value(pixels.get(f"PhysicalSize{a}") or "0", pixels.get(f"PhysicalSize{a}Unit", "µm"), LENGTH_UNITS) for a in "XY"]
        named = [e for e in pixels if plain(e) == "Channel"]
        exposure: dict[int, float] = {}
        for e in pixels:
            if plain(e) == "Plane" and e.get("ExposureTime"):
                exposure.setdefault(int(e.get("TheC", 0)), unit_value(e.get("ExposureTime"), e.get("ExposureTimeUnit", "s"), TIME_UNITS))
        kind = (next((e.get("ContrastMethod") or e.get("AcquisitionMode") or "" for e in named), "")).lower()
        if self.samples >= 3 and self.n_c in (1, 3):
            self.modality, self.n_c = "brightfield", 1
            return
        if "fluorescence" in kind or any(e.get("Fluor") for e in named):
            self.modality = "fluorescence"
        nm = lambda e, k: 1000 * unit_value(e.get(k), e.get(k + "Unit", "nm"), LENGTH_UNITS) if e.get(k) else None
        for i, e in enumerate(named):
            color = int(e.get("Color", -1)) & 0xFFFFFFFF
            name = e.get("Name") or e.get("Fluor")
            self.channels.append((i, name or f"Channel {i + 1}", e.get("Fluor"), color >> 24, color >> 16 & 255, color >> 8 & 255, nm(e, "ExcitationWavelength"), nm(e, "EmissionWavelength"), exposure.get(i), "source_metadata" if name else "unknown"))

    def describe_aperio(self, text: str) -> None:
        dye = property_of(text, "Dye")
        if dye and "JPEG/Monochrome" in text:
            color = int(property_of(text, "DisplayColor") or 16777215)
            number = lambda k: float(property_of(text, k)) if property_of(text, k) else None
            self.modality = "fluorescence"
            known = "unknown" if re.fullmatch(r"C\d+", dye) else "source_metadata"
            self.channels = [(0, dye, dye, color >> 16 & 255, color >> 8 & 255, color & 255, number("Excitation Wavelength"), number("Emission Wavelength"), number("Exposure Time"), known)]

    @property
    def mpp(self) -> float:
        """Micrometres per pixel: of the axes that say so, else from the description, else from the resolution tags, else 0."""
        axes = [v for v in self.axis_mpp if v > 0]
        if axes:
            return sum(axes) / len(axes)
        if said := re.search(numbered_property(PIXEL_SIZE_KEYS), self.pages[0].description):
            return float(said[1])
        res, unit = self.pages[0].one(XRES, 0.0), self.pages[0].one(RES_UNIT, 2)
        return {2: 25400.0, 3: 10000.0}.get(unit, 0.0) / res if res else 0.0

    @property
    def magnification(self) -> int:
        said = re.search(numbered_property(MAGNIFICATION_KEYS), self.pages[0].description)
        return round(float(said[1])) if said else 0

    def kind(self, i: int) -> str:
        """What a page is: main, level (tiled, full resolution family), or an associated image by name."""
        page, text = self.pages[i], self.pages[i].description.lower()
        if i == 0:
            return "main"
        for name in ("label", "macro", "thumbnail"):
            if re.search(rf"^{name}\b|\n{name}\b|name=\"{name}\"", text):
                return name
        if page.tiled and page.one(SUBFILE) in (0, 1):
            return "level"
        return "thumbnail" if self.vendor == "aperio" and i == 1 else "other"


def unit_value(value: str, unit: str, factors: dict[str, float]) -> float:
    if unit not in factors:
        raise FormatError("unknown_unit", "description", unit)
    return float(value) * factors[unit]


def property_of(text: str, key: str) -> str:
    """Value of a named part; parts lie between bars and line ends, and the first equals sign ends a name."""
    for line in text.splitlines():
        for part in line.split("|"):
            name, found, value = part.partition("=")
            if found and name.strip().lower() == key.lower() and value.strip():
                return value.strip()
    return ""


def rows_of(path: str, table: str, *, with_payload: bool = True, page: int | None = None) -> Iterator[tuple]:
    with open_bytes(path) as data:
        t = Tiff(data)
        if table == "header":
            main = t.pages[0]
            levels = sum(t.kind(i) in ("main", "level") for i in range(len(t.pages)))
            yield (path, *main.size, t.bits, t.samples, CODECS.get(main.one(COMPRESSION, 1), "other"), t.modality, t.mpp, t.magnification, levels, max(t.n_c, len(t.channels)), t.n_z, t.n_t, t.shift, t.vendor)
        elif table == "channels":
            for row in t.channels:
                yield (path, *row)
        elif table == "pages":
            for i, p in enumerate(t.pages):
                yield (path, i, t.kind(i), *p.size, *p.segment_size, p.tiled, p.one(SAMPLES, 1), p.one(BITS, 8), p.one(COMPRESSION, 1), p.one(SUBFILE), len(p.places[0]), p.description)
        elif table == "segments":
            for i, p in enumerate(t.pages):
                if page is not None and i != page:
                    continue
                (w, h), (tw, th), (offsets, lengths) = p.size, p.segment_size, p.places
                across = -(-w // tw) if tw else 1
                for k, (o, n) in enumerate(zip(offsets, lengths)):
                    x, y = k % across * tw, k // across * th
                    yield (path, i, k, x, y, min(tw, w - x), min(th, h - y), t.place(o), n, data.at(t.place(o), n) if with_payload else None)
