"""Labels and captions. Bin limits and wording are this library's own; callers pass theirs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def label(value: Column, limits: Sequence[tuple[float, str]], top: str) -> Column:
    """The word of the first limit that value is under, else `top`; null for null."""
    out = None
    for limit, word in limits:
        out = F.when(value < limit, word) if out is None else out.when(value < limit, word)
    return F.when(value.isNull(), None).otherwise(out.otherwise(top) if out is not None else F.lit(top))


def template_caption(stratum: Column, lat: Column, lon: Column) -> Column:
    return F.format_string("A %s site at %.6f, %.6f.", F.regexp_replace(stratum, "_", " "), lat, lon)


def model_caption(prompt: Column, complete: Callable[[str], str]) -> Column:
    """Caption from a caller's client, one call for each distinct prompt of a batch."""
    def ask(prompts: pd.Series) -> pd.Series:
        known = {p: complete(p) for p in prompts.dropna().unique()}
        return prompts.map(known)

    return F.pandas_udf(ask, "string")(prompt)


def stratum_rules(ndvi: Column, night_light: Column, population: Column, farmland: Column, coast_km: Column, rain_mm: Column, elevation_m: Column, water: Column, dark: float = 0.3, crowded: float = 0.7, covered: float = 0.5, near_km: float = 10.0, dry_mm: float = 250.0, high_m: float = 1500.0) -> dict[str, Column]:
    """Rules that a stratum's points should satisfy. 0.6 is the one published threshold, the others are this library's own.

    farmland and water are shares of the ground; rain is that of a year.
    """
    return {
        "agricultural": (farmland > covered) & (ndvi > 0.6),
        "forest": (ndvi > 0.6) & (night_light < dark),
        "coastal": (coast_km < near_km) & (water < covered),
        "arid": rain_mm < dry_mm,
        "alpine": elevation_m > high_m,
        "informal_settlements": (population > crowded) & (night_light < dark),
        "water_wetland": water > covered,
    }
