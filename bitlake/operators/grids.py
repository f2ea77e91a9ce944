"""Grids of bits as tables (grid_id, row, word): one word per row, column c at bit c."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitlake.functions import bits as B
from bitlake.functions import words as W
from bitlake.functions.words import word

#: Rows of a grid that one task looks at together.
BAND = 4096


def block_starts(grid: DataFrame, w: int, h: int) -> DataFrame:
    """grid with ``starts``: columns where a block of w x h set cells starts; zero in rows with fewer than h rows from them on."""
    W._within(w, 1, 64, "width")
    if h < 1:
        raise ValueError("a block has one row at least")
    # Bands of rows, each with copies of the h - 1 rows below it, so that one grid spreads over tasks.
    rows = max(BAND, h)
    band = F.floor(F.col("row") / rows)
    more = F.array_compact(F.array(band, F.when(F.col("row") - band * rows < h - 1, band - 1)))
    cut = grid.withColumn("__band", F.explode(more))
    down = Window.partitionBy("grid_id", "__band").orderBy("row").rowsBetween(0, h - 1)
    tall = F.when((F.count("*").over(down) == h) & (F.max("row").over(down) == F.col("row") + h - 1), F.bit_and("word").over(down)).otherwise(word(0))
    own = cut.withColumn("tall", tall).where(F.floor(F.col("row") / rows) == F.col("__band")).drop("__band")
    return W.layered(own, starts=lambda let: B.run_starts(F.col("tall"), w, let=let)).drop("tall")


def find_block(grid: DataFrame, w: int, h: int) -> DataFrame:
    """(grid_id, row, col) of the first block, by row, then column."""
    found = block_starts(grid, w, h)
    place = F.when(F.col("starts") != 0, F.struct("row", W.trailing_zeros(F.col("starts")).alias("col")))
    return found.groupBy("grid_id").agg(F.min(place).alias("at")).where("at is not null").select("grid_id", "at.row", "at.col")


def _block(row: int, col: int, w: int, h: int) -> tuple[Column, Column]:
    if w < 1 or h < 1 or col < 0 or col + w > 64:
        raise ValueError("the block lies outside the words")
    return F.col("row").between(row, row + h - 1), word(W.ones(w) << col)


def fill_block(grid: DataFrame, row: int, col: int, w: int, h: int) -> DataFrame:
    inside, m = _block(row, col, w, h)
    return grid.withColumn("word", F.when(inside, F.col("word").bitwiseOR(m)).otherwise(F.col("word")))


def clear_block(grid: DataFrame, row: int, col: int, w: int, h: int) -> DataFrame:
    inside, m = _block(row, col, w, h)
    return grid.withColumn("word", F.when(inside, F.col("word").bitwiseAND(F.bitwise_not(m))).otherwise(F.col("word")))
