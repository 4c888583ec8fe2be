"""AFI file sets: an XML list of single-channel fluorescence slides that must agree."""

from __future__ import annotations

import posixpath
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from .storage import FormatError, open_bytes
from .tiff import CODECS, COMPRESSION, Tiff

SUFFIXES = (".afi",)
SCHEMAS = {
    "references": "path string, channel bigint, child string",
    "header": "path string, width bigint, height bigint, n_channels bigint, bit_depth bigint, codec string, n_levels bigint",
    "channels": "path string, channel bigint, child string, name string, r bigint, g bigint, b bigint",
}


def references(path: str) -> list[str]:
    """The slides of a set in order, resolved against its folder."""
    with open_bytes(path) as data:
        try:
            root = ET.fromstring(data.at(0, data.size))
        except ET.ParseError as e:
            raise FormatError("afi_xml_invalid", "references") from e
    plain = lambda e: e.tag.rsplit("}", 1)[-1]
    if plain(root).upper() != "AFI":
        raise FormatError("afi_root_missing", "references")
    found = [e.text.strip() for e in root if plain(e) == "Path" and (e.text or "").strip()]
    if not found:
        raise FormatError("afi_without_paths", "references")
    folder = posixpath.dirname(path)
    return [f if f.startswith("/") or "://" in f else posixpath.join(folder, f) for f in found]


def rows_of(path: str, table: str) -> Iterator[tuple]:
    children = references(path)
    if table == "references":
        for i, child in enumerate(children):
            yield (path, i, child)
        return
    facts, channels = set(), []
    for i, child in enumerate(children):
        with open_bytes(child) as data:
            t = Tiff(data)
            if t.modality != "fluorescence" or len(t.channels) != 1:
                raise FormatError("afi_child_not_fluorescence", "channels", child)
            levels = tuple(p.size for k, p in enumerate(t.pages) if t.kind(k) in ("main", "level"))
            facts.add((levels, t.bits, t.pages[0].segment_size))
            channels.append((path, i, child, t.channels[0][1], *t.channels[0][3:6], CODECS.get(t.pages[0].one(COMPRESSION, 1), "other")))
    if len(facts) != 1:
        raise FormatError("afi_channels_disagree", "channels")
    levels, bits, _ = facts.pop()
    if table == "channels":
        for row in channels:
            yield row[:-1]
    else:
        codecs = {c[-1] for c in channels}
        yield (path, *levels[0], len(channels), bits, codecs.pop() if len(codecs) == 1 else "mixed", len(levels))
