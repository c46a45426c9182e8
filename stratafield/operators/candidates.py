"""Candidate points: a region picked at random, then a point uniform in degrees in its box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafield.functions.geo import between, uniform


def pick_region(u: Column, regions: Column) -> Column:
    """Uniform index, not weighted by area."""
    return F.floor(u * regions).cast("int")


def attempts(strata: DataFrame, first: int, past: int, per_point: int = 150) -> DataFrame:
    """(stratum_ord, stratum, quota, attempt_no) for attempts first..past-1, at most quota * per_point."""
    last = F.least(F.lit(past), F.col("quota") * per_point) - 1
    return strata.where(last >= first).select("*", F.explode(F.sequence(F.lit(first).cast("bigint"), last.cast("bigint"))).alias("attempt_no"))


def candidates(strata: DataFrame, regions: DataFrame, first: int, past: int, seed: int = 0, per_point: int = 150) -> DataFrame:
    """(stratum_ord, stratum, attempt_no, region_idx, lat, lon), unrounded; the same seed gives the same points."""
    counts = regions.groupBy("stratum").agg(F.count("*").alias("n_regions"))
    key = F.concat_ws("|", F.lit(str(seed)), "stratum", F.col("attempt_no").cast("string"))
    drawn = attempts(strata, first, past, per_point).join(counts, "stratum")
    drawn = drawn.withColumn("region_idx", pick_region(uniform("region", key), F.col("n_regions")))
    placed = drawn.join(regions, ["stratum", "region_idx"])
    lat = between(F.col("lat_lo"), F.col("lat_hi"), uniform("lat", key))
    lon = between(F.col("lon_lo"), F.col("lon_hi"), uniform("lon", key))
    return placed.select("stratum_ord", "stratum", "attempt_no", "region_idx", lat.alias("lat"), lon.alias("lon"))


def first_of_each(df: DataFrame, group: str, order: str, quota: Column | int, most: int | None = None) -> DataFrame:
    """Rows up to a quota in each group, in order.

    most: a number that no quota exceeds. Up to 1000, Spark then keeps only so many rows of a group in each task before
    it brings a group together.
    """
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(group).orderBy(order))
    ranked = df.withColumn("__rank", rank)
    if most is not None:
        ranked = ranked.where(F.col("__rank") <= F.lit(most))
    return ranked.where(F.col("__rank") <= quota).drop("__rank")
