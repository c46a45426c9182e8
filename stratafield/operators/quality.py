"""Dataset checks: counts, nulls, duplicates, ranges, quotas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def missing(df: DataFrame, name: str) -> Column:
    """Null, or not a number."""
    c = F.col(f"`{name}`")
    return c.isNull() | F.isnan(c) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else c.isNull()


def null_count(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Missing values, summed over columns."""
    return F.coalesce(reduce(lambda a, b: a + b, [F.sum(missing(df, c).cast("bigint")) for c in columns or df.columns]), F.lit(0)).cast("bigint")


def value_counts(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Rows for each value but null, most frequent first, ties by value."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(name)).orderBy(F.desc(name), column)


def counts_map(df: DataFrame, column: str, name: str = "counts") -> DataFrame:
    """One row: map from value to rows. For columns of few values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(name))


def duplicate_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows after the first of each key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def coordinate_range(df: DataFrame, columns: list[str], digits: int = 2) -> DataFrame:
    """One row: least and greatest number of each column, rounded."""
    return df.agg(*_ranges(df, columns, digits))


def _ranges(df: DataFrame, columns: list[str], digits: int) -> list[Column]:
    each = []
    for c in columns:
        number = F.when(~missing(df, c), F.col(c))
        each += [F.bround(F.min(number), digits).alias(f"min_{c}"), F.bround(F.max(number), digits).alias(f"max_{c}")]
    return each


def quota_status(strata: DataFrame, points: DataFrame) -> DataFrame:
    """stratum, quota, n and status (filled or short) of every stratum of the catalogue."""
    counts = points.groupBy("stratum").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return strata.join(counts, "stratum", "left").select("stratum", "quota", n.alias("n"), F.when(n < F.col("quota"), "short").otherwise("filled").alias("status"))


def report(points: DataFrame) -> DataFrame:
    """One row of checks, from one scan and one grouping by place."""
    here = points.withColumn("__missing", reduce(lambda a, b: a + b, [missing(points, c).cast("bigint") for c in points.columns]))
    places = here.groupBy("lat", "lon").agg(F.count("*").alias("__n"), F.sum("__missing").alias("__missing"))
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return places.agg(whole("__n").alias("n_rows"), whole("__missing").alias("n_missing"), whole(F.col("__n") - 1).alias("duplicates"), *_ranges(points, ["lat", "lon"], 2))
