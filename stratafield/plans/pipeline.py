"""From parameters, regions and land to the table of points and its summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafield.operators.candidates import candidates
from stratafield.operators.land import on_land, prepare
from stratafield.operators.quality import quota_status, value_counts
from stratafield.operators.sampler import sample
from stratafield.sources.catalogue import SamplingParameters, get_logger, regions_frame, strata_frame


def generate_points(spark: SparkSession, parameters: SamplingParameters, regions: dict, land: DataFrame | None = None, buffer_deg: float = 0.5) -> DataFrame:
    """Points of all strata; land: edges, or None for no land rule."""
    strata = strata_frame(spark, parameters.quotas.items())
    boxes = regions_frame(spark, regions)

    def draw_of(stratum: str):
        mine = strata.where(F.col("stratum") == stratum)
        return lambda first, past: candidates(mine, boxes, first, past, parameters.seed, parameters.attempts_per_point).select("attempt_no", "lat", "lon")

    ground = prepare(land, buffer_deg) if land is not None else None
    rule = (lambda points: on_land(points, ground)) if ground else None
    empty = spark.createDataFrame([], "lat double, lon double")
    draws = [(name, quota, draw_of(name)) for name, quota in parameters.quotas.items()]
    return sample(draws, empty, parameters.min_spacing_km, rule, parameters.attempts_per_point, parameters.bbox_size_m, log=get_logger("stratafield", parameters.log_level, parameters.log_file))


def summary(points: DataFrame, strata: DataFrame, rows: int = 10) -> dict:
    """Rows, rows by stratum, quotas reached, and the first rows by id."""
    return {"total": points.count(), "per_stratum": {r.stratum: r.n for r in value_counts(points, "stratum").toLocalIterator()}, "quotas": quota_status(strata, points).orderBy("stratum").collect(), "sample": points.orderBy("id").limit(rows).collect()}
