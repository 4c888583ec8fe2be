"""Small containers made in code, for tests and for the scan queries. Payloads are JPEG headers without pixels."""

from __future__ import annotations

import os
import sqlite3
import struct
import zlib

META, DATA, DATA_END = b"\xff\x01\xee\xee", b"\xf1\x04\xee\xee", b"\xff\x04\xee\xee"
#: Tiles of the sample slides: x, y, w, h, scale. 24 x 18 pixels, tiles of 16, and one reduced level.
TILES = ((0, 0, 16, 16, 40.0), (16, 0, 8, 16, 40.0), (0, 16, 16, 2, 40.0), (16, 16, 8, 2, 40.0), (0, 0, 12, 9, 20.0))


def jpeg(width: int, height: int, components: int = 3, marker: int = 0xC0, precision: int = 8, fill: int = 0) -> bytes:
    frame = struct.pack(">BHHB", precision, height, width, components) + bytes(3 * components)
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 6) + bytes([fill] * 4) + bytes([0xFF, marker]) + struct.pack(">H", len(frame) + 2) + frame + b"\xff\xd9"


def write_ibl(path: str, *, columns: int = 3, rows: int = 2, step: int = 6, size: int = 8, tile: int = 4, drop_tile: bool = False, extras: bool = True) -> None:
    if os.path.exists(path):
        os.unlink(path)
    con = sqlite3.connect(path)
    names = ["magicNo", "version", "focus_num", "image_format", "layer_size", "img_color", "check_sum", "ratio_step", "max_Lay_size", "slide_type", "bk_color", "pixel_size", "total_img_num", "max_zoom_rate", "img_col", "img_row", "img_width", "img_height", "tile_width", "tile_height", "shrink_tile_num", "total_img_width", "total_img_height"]
    w, h = (columns - 1) * step + size, (rows - 1) * step + size
    values = ["IBL", "1.0", 1, 0, 1, 3, None, 4, 1, 0, 0, 0.00025, columns * rows, 40, columns, rows, size, size, tile, tile, 0, w, h]
    con.execute(f"CREATE TABLE tbl_base_info ({', '.join(names)})")
    con.execute(f"INSERT INTO tbl_base_info VALUES ({', '.join('?' * len(names))})", values)
    con.execute("CREATE TABLE tbl_img_info (id INTEGER, layer INTEGER, topX, topY, leftX, leftY, col INTEGER, row INTEGER, nX INTEGER, nY INTEGER)")
    con.execute("CREATE TABLE tbl_tile_info (id INTEGER, layer INTEGER, col INTEGER, row INTEGER, data BLOB)")
    for r in range(rows):
        for c in range(columns):
            block = (c << 20) + (r << 12)
            con.execute("INSERT INTO tbl_img_info VALUES (?, 0, 0, 0, 0, 0, ?, ?, ?, ?)", (block, c, r, c * step, r * step))
            for layer in (0, 1):
                for i in range((size // tile) ** 2 if layer == 0 else 1):
                    if drop_tile and (r, c, layer, i) == (0, 0, 0, 0):
                        continue
                    con.execute("INSERT INTO tbl_tile_info VALUES (?, ?, ?, ?, ?)", (block, layer, i % (size // tile), i // (size // tile), jpeg(tile, tile, fill=i)))
    if extras:
        con.execute("CREATE TABLE tbl_ext_info (id INTEGER, type INTEGER, data BLOB)")
        con.executemany("INSERT INTO tbl_ext_info VALUES (?, ?, ?)", [(1, 1, b"macro"), (2, 3, b"label"), (3, 6, b'{"packetTime": "2024-01-01 00:00:00", "scanDuration": "60"}')])
        con.execute("CREATE TABLE tbl_user_info (id INTEGER, deviceNo TEXT, slideSource TEXT, slideType INTEGER, scanMode INTEGER, scanLayer INTEGER, scanTime INTEGER)")
        con.execute("INSERT INTO tbl_user_info VALUES (1, 'D1', 'S', 0, 0, 0, 77)")
    con.commit()
    con.close()


def kfb_header(magic: bytes, version: float, tiles: int, index_at: int, *, macro: int = 0, wide: bool = False) -> bytearray:
    h = bytearray(0x5C)
    h[0:8] = b"\xf1\x01\xee\xee" + magic
    struct.pack_into("<fIIII", h, 0x0C, version, tiles, 18, 24, 40)
    h[0x20:0x24] = b"JPEG"
    struct.pack_into("<I", h, 0x2C, 1700000000)
    struct.pack_into("<II", h, 0x34, macro, 0)
    struct.pack_into("<Q" if wide else "<I", h, 0x44, index_at)
    struct.pack_into("<f", h, 0x4C, 0.25)
    struct.pack_into("<I", h, 0x58, 16)
    return h


def items(values: dict[int, bytes]) -> bytes:
    return META + struct.pack("<I", len(values)) + b"".join(struct.pack("<II", k, len(v)) + v for k, v in values.items())


def write_kfb(path: str, *, magic: bytes = b"KFB\x00", version: float = 2.0, packed: bool = False, wrong_length: bool = False, cut: bool = False) -> None:
    """A classic container; KFBF records point to pointers."""
    meta = items({7: b"Scanner One", 9: struct.pack("<I", 5), 11: b"\x01\x02\xff"})
    size = 68 if version == 1.0 else 64
    macro_at = 0x5C + len(meta)
    macro = jpeg(64, 24)
    record = bytearray(52)
    record[0:4] = b"\xf1\x02\xee\xee"
    struct.pack_into("<IIIIIII", record, 8, 24, 64, 3, len(macro), 52, 0, 0)
    record[48:52] = b"\xff\x02\xee\xee"
    index_at = macro_at + 52 + len(macro)
    payloads = [jpeg(w, h, fill=i) for i, (_, _, w, h, _) in enumerate(TILES)]
    body_at = 0 if packed else index_at + size * len(TILES)
    rows = bytearray()
    kfbf, wide = magic == b"KFBF", version >= 2.1

    def build(start: int) -> tuple[bytes, bytes]:
        rows, body, at = bytearray(), bytearray(), start
        for (x, y, w, h, scale), p in zip(TILES, payloads):
            r = bytearray(size)
            r[0:4], r[size - 4 : size] = DATA, DATA_END
            struct.pack_into("<iiiifII", r, 4, x, y, w, h, scale, 0, 0)
            struct.pack_into("<I", r, 32, len(p) + (1 if wrong_length else 0))
            if kfbf:
                pointers = at + len(p)
                struct.pack_into("<QQ" if wide else "<IiI", r, 36, *((pointers, pointers + 8) if wide else (pointers, 0, pointers + 8)))
                body += p + struct.pack("<QQ", at, len(p))
            else:
                struct.pack_into("<Q" if wide else "<i", r, 36, at if wide else at - index_at)
                body += p
            at = start + len(body)
            rows += r
        return bytes(rows), bytes(body)

    if packed:
        # payloads before the index, whose packed size isn't known beforehand
        body_at = index_at
        _, body = build(body_at)
        index_at += len(body)
        rows, body = build(body_at)
        blob = zlib.compress(rows)
        index = DATA + struct.pack("<II", len(blob), len(rows)) + blob
        out = bytes(kfb_header(magic, version, len(TILES), index_at, macro=macro_at)) + meta + bytes(record) + macro + body + index
    else:
        rows, body = build(body_at)
        out = bytes(kfb_header(magic, version, len(TILES), index_at, macro=macro_at)) + meta + bytes(record) + macro + rows + body
    with open(path, "wb") as f:
        f.write(out[: len(out) // 2] if cut else out)


def channel_items() -> dict[int, bytes]:
    pad = lambda s, n: s.ljust(n, b"\x00")
    return {75: struct.pack("<I", 2), 76: pad(b"id1", 20) + pad(b"id2", 20), 77: pad(b"Red", 40) + pad(b"", 40), 78: struct.pack("<ii", 3, 4), 79: struct.pack("<6i", 255, 0, 0, 0, 255, 0), 84: struct.pack("<dd", 1.5, 2.5)}


def write_kfba(path: str, *, drop_item: bool = False) -> None:
    """Two fields, two levels, two channels."""
    meta = items(channel_items())
    blocks = [(field, level, t) for field in (0, 1) for level, tiles in ((0, TILES[:4]), (1, TILES[4:])) for t in tiles]
    index_at = 0x5C + len(meta)
    at = index_at + 424 * len(blocks)
    index, body = bytearray(), bytearray()
    for number, (field, level, (x, y, w, h, _)) in enumerate(blocks):
        payloads = [jpeg(w, h, 1, fill=30 + 90 * c + 40 * field + 10 * level) for c in (0, 1)]
        start = at + len(body)
        places = [start, start + len(payloads[0])]
        tables = start + sum(map(len, payloads))
        body += b"".join(payloads) + struct.pack("<QQ", *places) + struct.pack("<QQ", *map(len, payloads))
        values = {0: x, 1: y, 2: h, 3: w, 4: tables, 5: tables + 16, 6: field, 7: level, 10: number}
        if drop_item:
            values.pop(7)
        block = struct.pack("<Q", len(values)) + b"".join(struct.pack("<IIIQ", k, 0, 8, v) for k, v in values.items())
        index += block.ljust(424, b"\x00")
    with open(path, "wb") as f:
        f.write(bytes(kfb_header(b"KFBA", 1.4, len(blocks), index_at, wide=True)) + meta + bytes(index) + bytes(body))


def write_kfbx(path: str) -> None:
    attribute = lambda k, kind, code, *v: struct.pack("<HHI", k, kind, len(v)) + struct.pack(f"<{len(v)}{code}", *v)
    body, at, levels = bytearray(), 76, []
    for scale, tiles, w, h in ((20.0, TILES[4:], 12, 9), (40.0, TILES[:4], 24, 18)):
        places, sizes, where = [], [], []
        for x, y, tw, th, _ in tiles:
            p = jpeg(tw, th)
            places.append(at + len(body))
            sizes.append(len(p))
            where += [x, y]
            body += p
        levels.append(attribute(3, 2, "i", w) + attribute(4, 2, "i", h) + attribute(5, 4, "f", scale) + attribute(123, 3, "Q", *places) + attribute(135, 2, "i", *sizes) + attribute(134, 2, "i", *where))
    top = attribute(1, 2, "i", 16) + attribute(2, 2, "i", 16) + attribute(2123, 2, "i", 1) + b"".join(struct.pack("<HHI", 123, 0, len(x)) + x for x in levels)
    with open(path, "wb") as f:
        f.write(b"KAC\x00".ljust(68, b"\x00") + struct.pack("<Q", at + len(body)) + bytes(body) + top)


def write_image(path: str, *, blank: bool = True, bad_tail: bool = False) -> None:
    """Two levels of 2 x 2 and 1 x 1 tiles of 256 pixels."""
    head = bytearray(0xAC)
    body, records = bytearray(), []
    for level, (columns, rows) in enumerate(((2, 2), (1, 1))):
        own = []
        for c in range(columns):
            for r in range(rows):
                if blank and (level, c, r) == (0, 1, 1):
                    own.append((0, 0xAC))
                    continue
                p = jpeg(256, 256, fill=level * 16 + c * 2 + r)
                own.append((len(p), 0xAC + len(body)))
                body += p
        records.append(struct.pack("<II", columns, rows) + b"".join(struct.pack("<IQ", *x) for x in own))
    struct.pack_into("<QQQffII", head, 0, 0, 0, 0xAC + len(body), 512 * 0.25, 512 * 0.25, 512, 512)
    struct.pack_into("<I", head, 0x38, 40)
    head[0x40:0x53] = b"2024-01-01 10:00:00"
    struct.pack_into("<I", head, 0x53, 4)
    head[0x57:0x5B] = b"DEV1"
    head[0x84:0x88] = "医院".encode("gbk")
    head[0x98:0x9C] = b"C-17"
    with open(path, "wb") as f:
        f.write(bytes(head) + bytes(body) + b"".join(records) + (b"x" * 33 if bad_tail else b"0123456789abcdef" * 2 + b"\x00"))


def write_tiff(path: str, *, width: int = 40, height: int = 24, tile: int = 16, description: str = "", levels: int = 2, samples: int = 3, bits: int = 8, insert: int = 0) -> None:
    """Tiled little-endian TIFF with raw pixels and reduced pages; ``insert`` bytes are put in before the first directory without telling."""
    out = bytearray(b"II\x2a\x00\x00\x00\x00\x00")
    link, first = 4, 0
    for level in range(levels):
        w, h = max(1, width >> level), max(1, height >> level)
        places, sizes = [], []
        for i in range(-(-w // tile) * -(-h // tile)):
            pixels = bytes((level * 50 + i * 3 + k) % 256 for k in range(tile * tile * samples * bits // 8))
            places.append(len(out))
            sizes.append(len(pixels))
            out += pixels
        text = ((description if level == 0 else f"level {level}") + "\x00").encode()

        def stored(blob: bytes) -> int:
            at = len(out)
            out.extend(blob + b"\x00" * (len(blob) % 2))
            return at

        n = len(places)
        entries = [(254, 4, 1, 1 if level else 0), (256, 4, 1, w), (257, 4, 1, h), (258, 3, samples, bits if samples == 1 else stored(struct.pack(f"<{samples}H", *[bits] * samples)) if samples > 2 else bits), (259, 3, 1, 1), (262, 3, 1, 2 if samples > 1 else 1), (270, 2, len(text), stored(text) if len(text) > 4 else int.from_bytes(text.ljust(4, b"\x00"), "little")), (277, 3, 1, samples), (282, 5, 1, stored(struct.pack("<II", 40000, 1))), (284, 3, 1, 1), (296, 3, 1, 3), (322, 4, 1, tile), (323, 4, 1, tile), (324, 4, n, stored(struct.pack(f"<{n}I", *places)) if n > 1 else places[0]), (325, 4, n, stored(struct.pack(f"<{n}I", *sizes)) if n > 1 else sizes[0])]
        at = len(out)
        struct.pack_into("<I", out, link, at)
        first = first or at
        out += struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries)
        link = len(out)
        out += b"\x00\x00\x00\x00"
    if insert:
        # between the header and the first directory, so that the stored pointer falls short
        out[first:first] = b"\xaa" * insert
    with open(path, "wb") as f:
        f.write(bytes(out))


def write_afi(folder: str, name: str = "set.afi", channels: int = 2) -> None:
    for i in range(channels):
        write_tiff(os.path.join(folder, f"channel{i}.svs"), samples=1, description=f"Aperio Library\r\n40x24 JPEG/Monochrome|Dye = Dye{i}|DisplayColor = {255 << (8 * i)}|MPP = 0.5|AppMag = 20")
    with open(os.path.join(folder, name), "w") as f:
        f.write("<AFI>" + "".join(f"<Image><x/></Image><Path>channel{i}.svs</Path>" for i in range(channels)) + "</AFI>")


def write_all(folder: str) -> None:
    """One of each format."""
    os.makedirs(folder, exist_ok=True)
    at = lambda name: os.path.join(folder, name)
    write_ibl(at("a.ibl"))
    write_kfb(at("b.kfb"))
    write_kfb(at("c.kfbf"), magic=b"KFBF", version=2.1)
    write_kfba(at("d.kfba"))
    write_kfbx(at("e.kfbx"))
    write_image(at("f.image"))
    write_tiff(at("g.tif"), description="Aperio Library\r\n40x24|AppMag = 20|MPP = 0.5")
    write_afi(folder)
