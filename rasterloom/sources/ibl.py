"""IBL containers: a SQLite database with a header row, camera blocks and their tiles."""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator
from urllib.parse import quote

from .storage import FormatError, split_uri

SUFFIXES = (".ibl",)
REQUIRED = ("tbl_base_info", "tbl_img_info", "tbl_tile_info")
#: Header fields: name here, column of the table, type, default. Zero and null both mean missing. Fixed values.
HEADER = (
    ("magic_no", "magicNo", str, ""), ("version", "version", str, ""), ("focus_num", "focus_num", int, 0), ("image_format", "image_format", int, 0),
    ("layer_size", "layer_size", int, 0), ("img_color", "img_color", int, 0), ("check_sum", "check_sum", int, 0), ("ratio_step", "ratio_step", int, 0),
    ("max_layer_size", "max_Lay_size", int, 0), ("slide_type", "slide_type", int, 0), ("background_color", "bk_color", int, 255), ("pixel_size_mm", "pixel_size", float, 0.0),
    ("total_img_num", "total_img_num", int, 0), ("max_zoom_rate", "max_zoom_rate", int, 0), ("img_col", "img_col", int, 0), ("img_row", "img_row", int, 0),
    ("img_width", "img_width", int, 0), ("img_height", "img_height", int, 0), ("tile_width", "tile_width", int, 0), ("tile_height", "tile_height", int, 0),
    ("shrink_tile_num", "shrink_tile_num", int, 0), ("total_img_width", "total_img_width", int, 0), ("total_img_height", "total_img_height", int, 0),
)
SPARK_TYPE = {str: "string", int: "bigint", float: "double"}
#: Types of extension blobs. Fixed values.
ASSOCIATED = {1: "macro", 2: "thumbnail", 3: "label"}
METADATA = 6

SCHEMAS = {
    "header": "path string, " + ", ".join(f"{n} {SPARK_TYPE[t]}" for n, _, t, _ in HEADER),
    "blocks": "path string, block_id bigint, grid_col bigint, grid_row bigint, x0 bigint, y0 bigint, width bigint, height bigint, x1 bigint, y1 bigint",
    "tiles": "path string, block_id bigint, layer bigint, tile_row bigint, tile_col bigint, length bigint, payload binary",
    "shrink": "path string, layer bigint, x bigint, y bigint, payload binary",
    "associated": "path string, name string, payload binary",
    "metadata": "path string, json string, device_no string, slide_source string, scan_time bigint, packet_time string, scan_duration string",
}


def connect(path: str) -> sqlite3.Connection:
    system, local = split_uri(path)
    if system is not None:
        raise FormatError("remote_database", "open", "SQLite reads local and mounted paths")
    if not os.path.isfile(local):
        raise FormatError("not_found", "open", local)
    con = sqlite3.connect(f"file:{quote(local)}?mode=ro", uri=True)
    con.row_factory = sqlite3.Row
    return con


def tables_of(con: sqlite3.Connection) -> set[str]:
    return {r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}


def header_of(con: sqlite3.Connection) -> dict:
    missing = sorted(set(REQUIRED) - tables_of(con))
    if missing:
        raise FormatError("required_table_missing", "header", ", ".join(missing))
    row = con.execute("SELECT * FROM tbl_base_info LIMIT 1").fetchone()
    if row is None:
        raise FormatError("header_empty", "header")
    return {name: kind(row[column] or default) for name, column, kind, default in HEADER}


def rows_of(path: str, table: str, *, layer: int | None = None, block_ids: list[int] | None = None) -> Iterator[tuple]:
    """Rows of one logical table; layer and block_ids reach SQLite as predicates."""
    con = connect(path)
    try:
        head = header_of(con)
        have = tables_of(con)
        if table == "header":
            yield (path, *head.values())
        elif table == "blocks":
            n = 0
            for r in con.execute("SELECT id, col, row, nX, nY FROM tbl_img_info ORDER BY row, col"):
                n += 1
                x, y = int(r["nX"]), int(r["nY"])
                x1, y1 = min(head["total_img_width"], x + head["img_width"]), min(head["total_img_height"], y + head["img_height"])
                yield (path, int(r["id"]), int(r["col"]), int(r["row"]), x, y, x1 - x, y1 - y, x1, y1)
            if not n:
                raise FormatError("blocks_empty", "blocks")
        elif table == "tiles":
            where, args = [], []
            if layer is not None:
                where.append("layer = ?")
                args.append(layer)
            if block_ids is not None:
                where.append(f"id IN ({', '.join('?' * len(block_ids))})")
                args += block_ids
            sql = "SELECT id, layer, row, col, data FROM tbl_tile_info" + (f" WHERE {' AND '.join(where)}" if where else "") + " ORDER BY id, row, col"
            for r in con.execute(sql, args):
                yield (path, int(r["id"]), int(r["layer"]), int(r["row"]), int(r["col"]), len(r["data"] or b""), r["data"])
        elif table == "shrink" and "tbl_shrink_info" in have:
            for r in con.execute("SELECT layerNo, x, y, data FROM tbl_shrink_info ORDER BY layerNo, y, x"):
                yield (path, int(r["layerNo"]), int(r["x"]), int(r["y"]), r["data"])
        elif table == "associated":
            found: dict[str, bytes] = {}
            if "tbl_ext_info" in have:
                for r in con.execute("SELECT type, data FROM tbl_ext_info ORDER BY id"):
                    name = ASSOCIATED.get(r["type"])
                    if name and r["data"]:
                        found.setdefault(name, r["data"])
            if "tbl_airimg_info" in have:
                r = con.execute("SELECT data FROM tbl_airimg_info ORDER BY id LIMIT 1").fetchone()
                if r and r["data"]:
                    found.setdefault("macro", r["data"])
            for name in sorted(found):
                yield (path, name, found[name])
        elif table == "metadata":
            yield metadata_row(path, con, have)
    finally:
        con.close()


def metadata_row(path: str, con: sqlite3.Connection, have: set[str]) -> tuple:
    """The user row below the JSON blob. The row's scanTime is a duration, the blob's packetTime or scanTime a moment."""
    import json

    user = con.execute("SELECT * FROM tbl_user_info ORDER BY id LIMIT 1").fetchone() if "tbl_user_info" in have else None
    own = dict(user) if user else {}
    blob = con.execute("SELECT data FROM tbl_ext_info WHERE type = ? ORDER BY id LIMIT 1", (METADATA,)).fetchone() if "tbl_ext_info" in have else None
    try:
        said = json.loads(blob["data"]) if blob and blob["data"] else {}
    except ValueError:
        said = {}
    merged = {k: v for k, v in {**own, **said}.items() if not isinstance(v, bytes)}
    text = lambda k: str(said[k]) if k in said else None
    return (path, json.dumps(merged, sort_keys=True, ensure_ascii=False), own.get("deviceNo"), own.get("slideSource"), own.get("scanTime"), text("packetTime"), text("scanDuration"))
