"""Grids as rows: overlapping tiles, stitched votes, predictors on tiles, upsampling."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCENE = ["body_id", "date"]


def window_origins(size: int, tile: int, overlap: int) -> list[int]:
    """Where tiles begin along an axis: every tile - overlap, the last one moved back to the edge."""
    last = max(0, size - tile)
    return sorted({*range(0, last + 1, max(1, tile - overlap)), last})


def to_tiles(pixels: DataFrame, rows: int, cols: int, tile: int, overlap: int) -> DataFrame:
    """Each pixel once for every tile it lies in, with tile_row and tile_col; a narrow step."""

    def inside(axis: str, size: int) -> Column:
        starts = F.array(*map(F.lit, window_origins(size, tile, overlap)))
        return F.filter(starts, lambda o: (F.col(axis) >= o) & (F.col(axis) < o + tile))

    return pixels.withColumn("tile_row", F.explode(inside("row", rows))).withColumn("tile_col", F.explode(inside("col", cols)))


def predict_tiles(tiles: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.Series]]) -> DataFrame:
    """Adds vote to tile rows by a user's predictor, which gets one tile at a time; `load` runs once per group in the worker, and may cache.

    A group is one tile of one scene, so its size is bounded by the tile's.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(vote=load()(rows).astype(bool))

    return tiles.groupBy(*SCENE, "tile_row", "tile_col").applyInPandas(one, T.StructType([*tiles.schema, T.StructField("vote", T.BooleanType())]))


def stitch(votes: DataFrame) -> DataFrame:
    """(scene, row, col, mask): the mean of a pixel's votes is 0.5 or more; the sums are taken on the map side."""
    return votes.groupBy(*SCENE, "row", "col").agg((F.avg(F.col("vote").cast("double")) >= 0.5).alias("mask"))


def upsample(fine: DataFrame, coarse: DataFrame, factor: int, *values: str) -> DataFrame:
    """Adds a coarser grid's values to the pixels of a finer one, by the cell that each lies in; no cell: null."""
    c = coarse.select(*SCENE, F.col("row").alias("up_row"), F.col("col").alias("up_col"), *values)
    keyed = fine.withColumns({"up_row": F.floor(F.col("row") / factor), "up_col": F.floor(F.col("col") / factor)})
    return keyed.join(c, [*SCENE, "up_row", "up_col"], "left").drop("up_row", "up_col")


def grids_match(factor: int, coarse: tuple[int, int], fine: tuple[int, int]) -> bool:
    """Whether a grid of shape `coarse`, upsampled, has the shape `fine`."""
    return (coarse[0] * factor, coarse[1] * factor) == tuple(fine)
