"""Distances, boxes, rounding and portable draws as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kilometres and metres of one degree of latitude.
KM_PER_DEGREE, M_PER_DEGREE = 111.32, 111320.0


def round6(x: Column) -> Column:
    """Half-even rounding of a double to six digits; 6 digits of a degree are about 0.1 m.

    A zero keeps its sign, as in IEEE 754, Python and SQL; `bround` alone drops it, which shows once it is made text.
    """
    rounded = F.bround(x, 6)
    return F.when(rounded == 0, x * F.lit(0.0)).otherwise(rounded)


def uniform(tag: str, key: Column) -> Column:
    """Draw from [0, 1) that any engine can repeat: the first 32 bits of an MD5 over 2**32."""
    digest = F.substring(F.md5(F.concat(F.lit(f"{tag}|"), key.cast("string")).cast("binary")), 1, 8)
    return F.conv(digest, 16, 10).cast("bigint") / F.lit(4294967296.0)


def between(lo, hi, u: Column) -> Column:
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi))
    return lo + (hi - lo) * u


def distance_km(lat: Column, lon: Column, other_lat: Column, other_lon: Column) -> Column:
    """Equirectangular distance with the first point's cosine; it does not wrap at the antimeridian."""
    dlat = F.abs(lat - other_lat) * KM_PER_DEGREE
    dlon = F.abs(lon - other_lon) * KM_PER_DEGREE * F.cos(F.radians(lat))
    return F.sqrt(dlat * dlat + dlon * dlon)


def bounding_box(lat: Column, lon: Column, size_m: float = 256.0) -> dict[str, Column]:
    """Box of full width size_m around a point; its longitudes are null at the poles."""
    dlat = F.lit(size_m / 2 / M_PER_DEGREE)
    dlon = F.try_divide(F.lit(size_m / 2), F.lit(M_PER_DEGREE) * F.cos(F.radians(lat)))
    return {"bbox_min_lat": lat - dlat, "bbox_max_lat": lat + dlat, "bbox_min_lon": lon - dlon, "bbox_max_lon": lon + dlon}


def cell_row(lat: Column, spacing_km: float) -> Column:
    """Row of a grid: points closer than spacing_km are in the same or adjoining rows."""
    return F.floor(lat * KM_PER_DEGREE / spacing_km).cast("bigint")


def cell_column(row: Column, lon: Column, spacing_km: float) -> Column:
    """Column in a row, whose cells are as wide as the degrees of longitude by which close points in it can differ.

    A row at a pole, where longitudes do not matter, has cells wider than the globe.
    """
    highest = F.greatest(F.abs(row), F.abs(row + 1)) * F.lit(spacing_km / KM_PER_DEGREE)
    width = F.when(highest < 89.9999, F.lit(spacing_km / KM_PER_DEGREE * (1 + 1e-6)) / F.cos(F.radians(highest))).otherwise(F.lit(720.0))
    return F.floor(lon / F.least(width, F.lit(720.0))).cast("bigint")


def popup(stratum: Column, lat: Column, lon: Column) -> Column:
    """Text of a marker; null where a part of it is null, as in SQL."""
    text = F.format_string("%s | %.6f, %.6f", stratum, lat, lon)
    return F.when(stratum.isNotNull() & lat.isNotNull() & lon.isNotNull(), text)


def tile_key(lat: Column, lon: Column, step: int = 3, pattern: str = "ESA_WorldCover_10m_2021_v200_%s%s_Map.tif") -> Column:
    """File name of the tile that holds a point; tiles are named after their lower left corner."""
    y, x = (F.floor(c / step).cast("int") * step for c in (lat, lon))
    north = F.format_string("%s%02d", F.when(y < 0, "S").otherwise("N"), F.abs(y))
    east = F.format_string("%s%03d", F.when(x < 0, "W").otherwise("E"), F.abs(x))
    return F.format_string(pattern, north, east)
