"""Neighbours, running positions, take-while and naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arithmetic import half_floor


def block_ownership(blocks: DataFrame, *, slide: str = "slide_id") -> DataFrame:
    """Owned part of each block: overlaps (and gaps) with neighbours in its grid row and column are
    split in the middle, rounded down, and cut to the block's own box.

    blocks: slide, block_id, grid_row, grid_col, x0, y0, x1, y1. Adds own_x0, own_x1, own_y0, own_y1.
    """
    row = Window.partitionBy(slide, "grid_row").orderBy("x0", "grid_col", "block_id")
    column = Window.partitionBy(slide, "grid_col").orderBy("y0", "grid_row", "block_id")

    def edges(low: str, high: str, w) -> tuple[Column, Column]:
        before, after = half_floor(F.lag(high).over(w) + F.col(low)), half_floor(F.col(high) + F.lead(low).over(w))
        begin = F.greatest(F.col(low), F.least(F.col(high), F.coalesce(before, F.col(low))))
        return begin, F.greatest(begin, F.least(F.col(high), F.coalesce(after, F.col(high))))

    x = edges("x0", "x1", row)
    y = edges("y0", "y1", column)
    return blocks.withColumns({"own_x0": x[0], "own_x1": x[1]}).withColumns({"own_y0": y[0], "own_y1": y[1]})


def row_strips(blocks: DataFrame, *, slide: str = "slide_id") -> DataFrame:
    """Extent of each grid row, with its number of blocks and its first and last block by x."""
    return blocks.groupBy(slide, "grid_row").agg(
        F.min("y0").alias("strip_y0"),
        F.max("y1").alias("strip_y1"),
        F.count(F.lit(1)).alias("n_blocks"),
        F.min(F.struct("x0", "block_id")).getField("block_id").alias("first_block"),
        F.max(F.struct("x0", "block_id")).getField("block_id").alias("last_block"),
    )


def take_until(df: DataFrame, *, by: list[str], order: list[str], hit: Column) -> DataFrame:
    """Rows in order up to and including the first that hits."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(hit, 1).otherwise(0)).over(w), F.lit(0))
    return df.withColumn("__before", before).where("__before = 0").drop("__before")


def numbered(df: DataFrame, name: str, *, by: list[str], order: list, start: int = 1) -> DataFrame:
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) + (start - 1)).cast("bigint"))


def suffixed_names(df: DataFrame, *, folder: str, stem: str, suffix: str, order: list[str]) -> DataFrame:
    """Collision-free names: the first of equal candidates keeps its name, later ones get _1, _2, ...

    Exact as long as no literal name ends in such a suffix; ``greedy_names`` has no such limit."""
    w = Window.partitionBy(folder, stem, suffix).orderBy(*order)
    n = F.row_number().over(w) - 1
    return df.withColumn("name", F.concat(F.col(stem), F.when(n > 0, F.concat(F.lit("_"), n.cast("string"))).otherwise(""), F.col(suffix)))


def greedy_names(df: DataFrame, *, folder: str, stem: str, suffix: str, order: str) -> DataFrame:
    """The first free name in order, for each folder: an ordered pass, since later names depend on earlier ones.

    A folder's candidates meet in one task; they are file names of one output folder, not data rows."""
    import pandas as pd

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", name string"

    def assign(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        taken: set[str] = set()
        following: dict[str, int] = {}
        names = []
        for a, b in zip(rows[stem], rows[suffix]):
            name = a + b
            k = following.get(name, 0)
            while name in taken:
                k += 1
                name = f"{a}_{k}{b}"
            following[a + b] = k
            taken.add(name)
            names.append(name)
        return rows.assign(name=names)

    return df.groupBy(folder).applyInPandas(assign, kinds)


def running_max(df: DataFrame, name: str, value: Column, *, by: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.max(value).over(w))


def latest(df: DataFrame, *, key: list[str], order: list) -> DataFrame:
    """The last row of each key (upsert by replacement)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
