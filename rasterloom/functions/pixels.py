"""Pixel arithmetic on arrays, inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arithmetic import bound, col, div


def quantised(values, top: int) -> Column:
    """Samples from floats in [-1, 1]: rint of their place in [0, top]."""
    return F.transform(col(values), lambda v: F.rint((v.cast("double") + 1) * (top / 2)).cast("bigint"))


def display_lut(samples, *, black=0.0, white=255.0, contrast=1.0, brightness=0.0, channel_offset=0.0, gamma=1.0) -> Column:
    """Vendor display curve: normalise, contrast around one half (none below zero), offsets, gamma, round half to even."""
    if not white > black or not gamma > 0:
        raise ValueError(f"display curve from {black} to {white} with gamma {gamma}")

    def one(v: Column) -> Column:
        x = (v.cast("double") - black) / (white - black)
        x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
        x = (x - 0.5) * max(contrast, 0.0) + 0.5 + brightness + channel_offset
        x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
        return F.rint(F.pow(x, F.lit(1.0 / gamma)) * 255).cast("bigint")

    return F.transform(col(samples), one)


def to_display_rounded(v, top) -> Column:
    """High-bit sample to 8 bits: rint."""
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(v).cast("double") / col(top)))
    return F.rint(x * 255).cast("bigint")


def to_display_floored(v, top) -> Column:
    """High-bit sample to 8 bits: integer division."""
    return div(col(v) * 255, top)


def over_white(v, alpha) -> Column:
    """Sample with opacity in [0, 1] over white; truncated, not rounded."""
    return (col(v) * col(alpha) + F.lit(255.0) * (F.lit(1.0) - col(alpha))).cast("bigint")


def transposed(pixels, width: int, height: int) -> Column:
    """Row-major pixels with axes exchanged."""
    places = F.sequence(F.lit(0), F.lit(width * height - 1))
    return bound(pixels, lambda p: F.transform(places, lambda i: F.get(p, ((i % height) * width + F.floor(i / height)).cast("int"))))


def padded(pixels, width, height, tile: int, background: int) -> Column:
    """Row-major pixels of an edge tile filled up to tile x tile."""
    inside = lambda i: ((i % tile) < col(width)) & (F.floor(i / tile) < col(height))
    places = F.sequence(F.lit(0), F.lit(tile * tile - 1))
    place = lambda p, i: F.get(p, (F.floor(i / tile) * col(width) + i % tile).cast("int"))
    return bound(pixels, lambda p: F.transform(places, lambda i: F.when(inside(i), place(p, i)).otherwise(F.lit(background).cast("bigint"))))


def pack_rgba(r, g, b, a=255) -> Column:
    """Colour as a signed 32-bit number."""
    packed = F.shiftleft(col(r).cast("bigint"), 24).bitwiseOR(F.shiftleft(col(g).cast("bigint"), 16)).bitwiseOR(F.shiftleft(col(b).cast("bigint"), 8)).bitwiseOR(col(a).cast("bigint"))
    return F.when(packed >= 2147483648, packed - 4294967296).otherwise(packed)


def unpack_rgba(packed) -> tuple[Column, Column, Column, Column]:
    v = F.when(col(packed) < 0, col(packed) + 4294967296).otherwise(col(packed)).cast("bigint")
    return tuple(F.shiftright(v, s).bitwiseAND(F.lit(255)) for s in (24, 16, 8, 0))


def hex_colour(r, g, b) -> Column:
    return F.concat(F.lit("#"), F.lpad(F.hex(F.shiftleft(col(r).cast("bigint"), 16) + F.shiftleft(col(g).cast("bigint"), 8) + col(b).cast("bigint")), 6, "0"))


def parse_hex_colour(text) -> tuple[Column, Column, Column]:
    v = F.conv(F.substring(col(text), 2, 6), 16, 10).cast("bigint")
    return tuple(F.shiftright(v, s).bitwiseAND(F.lit(255)) for s in (16, 8, 0))
