"""Rectangles, tiles, segments and pyramid sizes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arithmetic import ceil_div, col, div


def clipped_end(start, size, limit) -> Column:
    """End of [start, start + size) within [0, limit)."""
    return F.least(col(start) + col(size), col(limit))


def overlap(a0, a1, b0, b1) -> Column:
    """Length of the common part of two half-open intervals, 0 if there is none."""
    return F.greatest(F.lit(0), F.least(col(a1), col(b1)) - F.greatest(col(a0), col(b0)))


def segment_rectangle(index, width, height, tile) -> tuple[Column, Column, Column, Column]:
    """x, y, width and height of a tile by its row-major number; the last ones are cut off at the image's edge."""
    across = ceil_div(width, tile)
    x, y = (col(index) % across) * col(tile), div(index, across) * col(tile)
    return x, y, F.least(col(tile), col(width) - x), F.least(col(tile), col(height) - y)


def mixed_radix_page(c, z, t, channels, depths) -> Column:
    """Page of a plane where channels vary fastest, then depth, then time."""
    return (col(t) * col(depths) + col(z)) * col(channels) + col(c)


def row_major(row, column, columns) -> Column:
    return col(row) * col(columns) + col(column)


def column_major(row, column, rows) -> Column:
    return col(column) * col(rows) + col(row)


def bytes_estimate(width, height, tile, per_pixel) -> Column:
    """Bytes of a level whose tiles are padded to their full size."""
    return ceil_div(width, tile) * col(tile) * ceil_div(height, tile) * col(tile) * col(per_pixel)


def pixels_per_cm(mpp, downsample) -> Column:
    """Resolution of a reduced level from micrometres per pixel; 0 where unknown."""
    return F.when(col(mpp) > 0, F.lit(10000.0) / (col(mpp) * col(downsample))).otherwise(F.lit(0.0))
