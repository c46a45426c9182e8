"""Points on land: crossing number against polygon edges, by bands of latitude and, near edges, by grid cells.

The edges of a band (or cell) are one row with an array of them, so that a point meets one row, its test is an
expression, and no point is moved, grouped or counted: the table of bands is broadcast if its size, which is counted
first, is under a bound; else both sides are joined by the key of the band.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafield.session import materialize

#: Bytes of edges up to which their table goes to every task.
BROADCAST_BYTES = 64 << 20
_EDGE = ("x1", "y1", "x2", "y2")


@dataclass(frozen=True)
class Land:
    """Prepared edges. bands: (__band, polygons: array of arrays of edges); cells: (__row, __cell, edges), or none without a buffer."""

    bands: DataFrame
    cells: DataFrame | None
    band: float
    cell: float
    within: float


def prepare(edges: DataFrame, buffer_deg: float = 0.0, poly: str = "poly_id", band: float = 0.1) -> Land:
    """Edges (x1, y1, x2, y2 and a polygon key), by bands of `band` degrees, and by cells that see all edges within the buffer."""
    edge = F.struct(*_EDGE)
    size = max(buffer_deg, band)
    spread = edges.withColumn("__band", _covered(F.least("y1", "y2"), F.greatest("y1", "y2"), band))
    rings = spread.groupBy("__band", poly).agg(F.collect_list(edge).alias("edges"))
    bands = _bounded(rings.groupBy("__band").agg(F.collect_list("edges").alias("polygons")), F.size(F.flatten("polygons")), "land-bands")
    cells = None
    if buffer_deg > 0:
        rows = edges.withColumn("__row", _covered(F.least("y1", "y2") - buffer_deg, F.greatest("y1", "y2") + buffer_deg, size))
        # The part of an edge that is in reach of a row: only its cells, not those of the edge's whole box.
        ends = [F.try_divide(F.col("__row") * size - buffer_deg - F.col("y1"), F.col("y2") - F.col("y1")), F.try_divide((F.col("__row") + 1) * size + buffer_deg - F.col("y1"), F.col("y2") - F.col("y1"))]
        share = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) for x in (F.coalesce(F.least(*ends), F.lit(0.0)), F.coalesce(F.greatest(*ends), F.lit(1.0)))]
        xs = [F.col("x1") + s * (F.col("x2") - F.col("x1")) for s in share]
        rows = rows.withColumn("__cell", _covered(F.least(*xs) - buffer_deg - 1e-9, F.greatest(*xs) + buffer_deg + 1e-9, size))
        cells = _bounded(rows.groupBy("__row", "__cell").agg(F.collect_list(edge).alias("edges")), F.size("edges"), "land-cells")
    return Land(bands, cells, band, size, buffer_deg)


def _covered(low: Column, high: Column, size: float) -> Column:
    """Explodes to the numbers of all strips of that size from low to high."""
    return F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))


def _bounded(table: DataFrame, edges: Column, name: str) -> DataFrame:
    table = materialize(table, name)
    held = table.agg(F.sum(edges)).first()[0] or 0
    return F.broadcast(table) if held * 8 * len(_EDGE) <= BROADCAST_BYTES else table


def _crosses(e: Column, lat: Column, lon: Column) -> Column:
    """The edge lies to the east of the point, at its latitude."""
    meets = (e["y1"] > lat) != (e["y2"] > lat)
    return meets & (lon < e["x1"] + (lat - e["y1"]) * F.try_divide(e["x2"] - e["x1"], e["y2"] - e["y1"]))


def _near(e: Column, lat: Column, lon: Column, within: float) -> Column:
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    t = F.coalesce(F.try_divide((lon - e["x1"]) * dx + (lat - e["y1"]) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    ex, ey = lon - (e["x1"] + t * dx), lat - (e["y1"] + t * dy)
    return F.sqrt(ex * ex + ey * ey) < within


def on_land(points: DataFrame, land: Land) -> DataFrame:
    """Points inside a polygon or, with a buffer in degrees, less than that from one of its edges.

    Inside: an odd number of a polygon's edges lies to the east; holes are rings of their polygon. Null places are not on land.
    """
    lat, lon = F.col("lat"), F.col("lon")
    inside = F.exists("polygons", lambda edges: F.size(F.filter(edges, lambda e: _crosses(e, lat, lon))) % 2 == 1)
    met = points.withColumn("__band", F.floor(lat / land.band)).join(land.bands, "__band", "left")
    on = F.coalesce(inside, F.lit(False))
    if land.cells is not None:
        met = met.withColumns({"__row": F.floor(lat / land.cell), "__cell": F.floor(lon / land.cell)}).join(land.cells, ["__row", "__cell"], "left")
        on = on | F.coalesce(F.exists("edges", lambda e: _near(e, lat, lon, land.within)), F.lit(False))
    return met.where(on).select(*[F.col(f"`{c}`") for c in points.columns])
