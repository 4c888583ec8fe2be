"""Names, descriptions, units and JSON as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arithmetic import col

#: Suffixes of slide files, and what they are. Fixed values.
FORMATS = {
    "ibl": (".ibl",),
    "kfb": (".kfb", ".kfbl", ".kfbf", ".kfba", ".kfbx"),
    "image": (".image",),
    "svs": (".svs",),
    "generic_tiff": (".tif", ".tiff"),
    "afi": (".afi",),
}
#: Suffix of each output format. Fixed values.
OUTPUT_SUFFIX = {"ome_tiff": ".ome.tif", "svs": ".svs", "fluorescence_svs": ".svs", "afi": ".afi"}
#: Characters that a file name can't hold, as a pattern of a run of them. Fixed value.
UNSAFE = r'[<>:"/\\|?*\x00-\x1f]+'
#: Keys of the magnification and of the pixel size in descriptions. Fixed values.
MAGNIFICATION_KEYS = ("AppMag", "ObjectivePower", "openslide.objective-power", "Magnification")
PIXEL_SIZE_KEYS = ("MPP",)
#: Factors to micrometres, and to seconds. Fixed values.
LENGTH_UNITS = {"m": 1e6, "cm": 1e4, "mm": 1e3, "um": 1.0, "µm": 1.0, "μm": 1.0, "nm": 1e-3, "pm": 1e-6}
TIME_UNITS = {"s": 1.0, "ms": 1e-3, "us": 1e-6, "µs": 1e-6, "μs": 1e-6, "ns": 1e-9, "min": 60.0}


def suffix(path) -> Column:
    """Last suffix with its point, in lower case; '' if there is none."""
    return F.lower(F.regexp_extract(col(path), r"(\.[^./]*)$", 1))


def file_format(path) -> Column:
    s = suffix(path)
    out = None
    for name, suffixes in FORMATS.items():
        out = F.when(s.isin(*suffixes), name) if out is None else out.when(s.isin(*suffixes), name)
    return out.otherwise("unsupported")


def output_path(root, path, output_suffix) -> Column:
    """A relative path under another root, with its last suffix exchanged."""
    return F.concat(col(root), F.lit("/"), F.regexp_replace(col(path), r"(?<=[^/])\.[^./]*$", ""), col(output_suffix))


def parent_folder(path) -> Column:
    return F.regexp_extract(col(path), r"^(.*)/[^/]*$", 1)


def safe_component(text) -> Column:
    """A name without characters that file systems refuse: a run of them, and a run of blanks, becomes '_'; '.', '_' fall off the ends."""
    clean = F.regexp_replace(F.regexp_replace(col(text), UNSAFE, "_"), r"\s+", "_")
    return F.regexp_replace(F.regexp_replace(clean, r"^[._]+", ""), r"[._]+$", "")


def channel_suffix(index, name, identity=None) -> Column:
    """Cnn_name, counted from 1; Cnn where nothing is left of the name, or its identity is unknown."""
    safe = F.coalesce(safe_component(name), F.lit(""))
    bare = safe == "" if identity is None else (safe == "") | col(identity).eqNullSafe(F.lit("unknown"))
    return F.concat(F.format_string("C%02d", (col(index) + 1).cast("int")), F.when(bare, "").otherwise(F.concat(F.lit("_"), safe)))


def converted(value, unit, factors: dict[str, float]) -> Column:
    """value in the base unit of factors; an unknown unit is an error."""
    table = F.create_map(*(F.lit(x) for pair in factors.items() for x in pair))
    factor = F.element_at(table, col(unit))
    return col(value) * F.coalesce(factor, F.raise_error(F.concat(F.lit("unknown unit "), col(unit))).cast("double"))


def description_property(text, key: str) -> Column:
    """Value of 'key = value' in a description whose parts are set off by '|'; '' if absent."""
    return F.trim(F.regexp_extract(col(text), rf"(?i)(?:^|[|\n])\s*{key}\s*=\s*([^|\r\n]+)", 1))


def numbered_property(keys: tuple[str, ...]) -> str:
    """Pattern of 'key = number' for any of keys, anywhere in a description; the number is its group."""
    return r"(?i)\b(?:" + "|".join(map(re.escape, keys)) + r")\s*=\s*(\d+(?:\.\d+)?)"


def objective_power(text) -> Column:
    """Magnification from a description, rounded half to even; 0 if there is none."""
    found = F.regexp_extract(col(text), numbered_property(MAGNIFICATION_KEYS), 1)
    return F.coalesce(F.bround(found.try_cast("double"), 0).cast("bigint"), F.lit(0).cast("bigint"))


def pixel_size(text, x=None, y=None) -> Column:
    """Micrometres per pixel: the mean of x and y where both are above zero, the one that is, else the description's; 0 if there is none."""
    given = [F.coalesce(col(v), F.lit(0.0)) if v is not None else F.lit(0.0) for v in (x, y)]
    both = (given[0] > 0) & (given[1] > 0)
    said = F.regexp_extract(col(text), numbered_property(PIXEL_SIZE_KEYS), 1).try_cast("double")
    return F.when(both, (given[0] + given[1]) / 2).otherwise(F.coalesce(F.nullif(F.greatest(*given), F.lit(0.0)), said, F.lit(0.0)))


def number_or_null(value) -> Column:
    """A number; null for null, blank text and zero."""
    return F.nullif(F.nullif(col(value).cast("string"), F.lit("")).cast("double"), F.lit(0.0))


def blank_zero(value, fmt: str | None = None) -> Column:
    """A report cell: zero and null are blank, numbers take a printf format if given."""
    v = col(value)
    text = F.format_string(fmt, v) if fmt else v.cast("string")
    return F.when(v.isNull() | (v == 0), F.lit("")).otherwise(text)


def little_endian(data, offset: int, size: int) -> Column:
    """Unsigned little-endian number of size bytes at an offset of a binary column."""
    parts = [F.hex(F.substring(col(data), offset + size - i, 1)) for i in range(size)]
    return F.conv(F.concat(*parts), 16, 10).cast("bigint")


def payload_codec(payload) -> Column:
    """Codec by signature; null where nothing is known."""
    h = F.hex(col(payload))
    lossless = h.rlike("^FFD8(FF(?!C3|DA)..(....)?)*FFC3")
    return F.when(h.startswith("FFD8"), F.when(lossless, "SOF3").otherwise("JPEG")).when(h.startswith("FF0A") | h.startswith("0000000C4A584C20"), "JXL")


def aperio_size(width, height) -> Column:
    return F.format_string("%dx%d", col(width).cast("int"), col(height).cast("int"))


def aperio_properties(width, height, mag, stem, mpp, icc) -> Column:
    """The named parts of a main page's or a thumbnail's description. Fixed names, in fixed order."""
    return F.format_string(
        "AppMag = %d|Filename = %s|MPP = %.6f|DisplayColor = 0|OriginalWidth = %d|OriginalHeight = %d|ICC Profile = %s",
        col(mag).cast("int"), col(stem), col(mpp).cast("double"), col(width).cast("int"), col(height).cast("int"), col(icc),
    )


def aperio_description(library: str, width, height, tile, codec, mag, stem, mpp, icc) -> Column:
    """Description of a main page."""
    size, cut = aperio_size(width, height), aperio_size(tile, tile)
    return F.concat(F.lit(library + " \r\n"), size, F.lit(" [0,0 "), size, F.lit("] ("), cut, F.lit(") "), col(codec), F.lit("|"), aperio_properties(width, height, mag, stem, mpp, icc))


def aperio_level_description(library: str, width, height, tile, codec, level_width, level_height) -> Column:
    size, cut = aperio_size(width, height), aperio_size(tile, tile)
    return F.concat(F.lit(library + " \r\n"), size, F.lit(" [0,0 "), size, F.lit("] ("), cut, F.lit(") -> "), aperio_size(level_width, level_height), F.lit(" "), col(codec))


def aperio_thumbnail_description(library: str, width, height, thumb_width, thumb_height, mag, stem, mpp, icc) -> Column:
    return F.concat(F.lit(library + " \n"), aperio_size(width, height), F.lit(" -> "), aperio_size(thumb_width, thumb_height), F.lit(" - |"), aperio_properties(width, height, mag, stem, mpp, icc))


def aperio_associated_description(library: str, kind: str, width, height) -> Column:
    """Description of a label or a macro."""
    return F.concat(F.lit(f"{library} \n{kind} "), aperio_size(width, height))
