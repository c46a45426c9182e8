"""Values of raster cells at points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pixel_of(lat: Column, lon: Column, north: float, west: float, step: float) -> tuple[Column, Column]:
    """Row and column of the cell that holds a point, in a grid that starts in the north-west."""
    return F.floor((F.lit(north) - lat) / step).cast("int"), F.floor((lon - F.lit(west)) / step).cast("int")


def lookup(points: DataFrame, pixels: DataFrame, north: float, west: float, step: float) -> DataFrame:
    """points with the value of their cell, null where the grid (px_row, px_col, value) has none."""
    row, col = pixel_of(F.col("lat"), F.col("lon"), north, west, step)
    return points.withColumns({"px_row": row, "px_col": col}).join(pixels, ["px_row", "px_col"], "left")
