"""Joins over space: intervals by bins, grids by keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arithmetic import col, div


def overlap_join(left: DataFrame, right: DataFrame, *, on: list[str], left_box: tuple[str, str, str, str], right_box: tuple[str, str, str, str], bin_size: int) -> DataFrame:
    """Pairs whose half-open boxes (x0, y0, x1, y1) overlap and which agree in ``on``.

    A plain inequality join would be a nested loop. Both sides are spread over the bins that their
    boxes touch, bins meet in an equi-join (Spark picks sort-merge, hash or a checked broadcast),
    and a pair counts only in the bin where its common part begins, so none comes twice. Boxes
    without area meet nothing.
    """

    def spread(df: DataFrame, box: tuple[str, str, str, str]) -> DataFrame:
        x0, y0, x1, y1 = map(F.col, box)
        bins = lambda a, b: F.sequence(div(a, bin_size), div(b - 1, bin_size))
        solid = df.where((x0 < x1) & (y0 < y1))
        return solid.withColumn("__bx", F.explode(bins(x0, x1))).withColumn("__by", F.explode(bins(y0, y1)))

    l0, m0, l1, m1 = map(F.col, left_box)
    r0, s0, r1, s1 = map(F.col, right_box)
    begin_x, begin_y = F.greatest(l0, r0), F.greatest(m0, s0)
    meets = (l0 < r1) & (r0 < l1) & (m0 < s1) & (s0 < m1)
    first = (div(begin_x, bin_size) == F.col("__bx")) & (div(begin_y, bin_size) == F.col("__by"))
    return spread(left, left_box).join(spread(right, right_box), [*on, "__bx", "__by"]).where(meets & first).drop("__bx", "__by")


def grid_cells(requests: DataFrame, *, box: tuple[str, str, str, str], tile: int) -> DataFrame:
    """Cells cx, cy (multiples of tile) that each requested box touches."""
    x0, y0, x1, y1 = map(F.col, box)
    starts = lambda a, b: F.transform(F.sequence(div(a, tile), div(b - 1, tile)), lambda i: i * tile)
    solid = requests.where((x0 < x1) & (y0 < y1))
    return solid.withColumn("cy", F.explode(starts(y0, y1))).withColumn("cx", F.explode(starts(x0, x1)))


def grid_lookup(requests: DataFrame, tiles: DataFrame, *, on: list[str], box: tuple[str, str, str, str], tile: int, value: str, background: Column | int) -> DataFrame:
    """For each cell of each request the tile that begins exactly there, or the background; tiles off the grid are never found."""
    cells = grid_cells(requests, box=box, tile=tile)
    known = tiles.withColumnsRenamed({"x": "cx", "y": "cy"})
    return cells.join(known, [*on, "cx", "cy"], "left").withColumn(value, F.coalesce(F.col(value), col(background)))


def missing_counts(expected: DataFrame, found: DataFrame, key: str, count: Column | str) -> DataFrame:
    """Rows of expected whose number of found rows with their key is not what count says (none found: 0)."""
    counts = found.groupBy(key).agg(F.count(F.lit(1)).alias("n_found"))
    return expected.join(counts, key, "left").withColumn("n_found", F.coalesce("n_found", F.lit(0))).where(F.col("n_found") != col(count))


def nearest_of(width, height, levels: list[tuple[int, int]]) -> Column:
    """Number of the level of least |dw| + |dh| among a slide's levels; the first wins ties."""
    options = [F.struct((F.abs(col(width) - w) + F.abs(col(height) - h)).cast("bigint").alias("d"), F.lit(i).cast("bigint").alias("k")) for i, (w, h) in enumerate(levels)]
    return F.array_min(F.array(*options)).getField("k")
