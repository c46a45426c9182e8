"""The table of points: CSV, and maps."""

from __future__ import annotations

import html
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafield.functions.geo import popup

POINT_SCHEMA = "id bigint, lat double, lon double, stratum string, bbox_min_lat double, bbox_max_lat double, bbox_min_lon double, bbox_max_lon double"
#: Marker colours by stratum.
COLOURS = {
    "dense_urban": "red",
    "industrial": "darkred",
    "suburban": "orange",
    "agricultural": "green",
    "forest": "darkgreen",
    "coastal": "blue",
    "arid": "cadetblue",
    "alpine": "purple",
    "informal_settlements": "pink",
    "water_wetland": "darkblue",
}
DEFAULT_COLOUR = "gray"


#: Nulls are empty fields and empty strings are quoted ones; quotes in values are doubled, blanks around values stay.
_CSV = {"header": True, "nullValue": "", "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
#: What stands for a quoted empty field while a file is read.
_EMPTY = "\x00"
#: Fields that other readers of such files take for missing.
NULL_TOKENS = ("#N/A", "#NA", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def save_csv(df: DataFrame, path: str, files: int | None = None) -> None:
    """CSV with a header; one file if files is 1, else as the data is partitioned."""
    (df.coalesce(files) if files else df).write.mode("overwrite").options(**_CSV, emptyValue='""').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str = POINT_SCHEMA, null_tokens: Iterable[str] = (), lines_in_values: bool = False) -> DataFrame:
    """What save_csv wrote, value by value. null_tokens: strings that are null (NULL_TOKENS for files of other programs).

    Values with line breaks need lines_in_values; a file is then read by one task.
    """
    df = spark.read.schema(schema).options(**_CSV, emptyValue=_EMPTY, multiLine=lines_in_values).csv(path)
    tokens = list(null_tokens)
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(F.col(c) == _EMPTY, "").when(F.col(c).isin(tokens), None).otherwise(F.col(c)) for c in texts}) if texts else df


def save_partitioned(df: DataFrame, path: str, by: str = "stratum") -> None:
    """Parquet with one folder for each value of a column, so that a reader of one stratum opens only its own files."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def marker_rows(df: DataFrame, colours: dict[str, str] | None = None) -> DataFrame:
    """lat, lon, stratum, colour and popup of each point."""
    colours = COLOURS if colours is None else colours
    known = F.create_map(*[F.lit(x) for kv in colours.items() for x in kv]) if colours else F.lit(None).cast("map<string,string>")
    colour = F.coalesce(F.try_element_at(known, F.col("stratum")), F.lit(DEFAULT_COLOUR))
    return df.select("lat", "lon", "stratum", colour.alias("colour"), popup(F.col("stratum"), F.col("lat"), F.col("lon")).alias("popup"))


def save_map(df: DataFrame, path: str, colours: dict[str, str] | None = None) -> int:
    """HTML map with one circle for each point, streamed to a file of the driver; returns how many."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    n = 0
    with open(path, "w") as out:
        out.write('<!DOCTYPE html><meta charset="utf-8"><title>Points</title><svg viewBox="-180 -90 360 180" style="width:100%;background:#eef">\n')
        for r in marker_rows(df, colours).toLocalIterator():
            title = f"{r.lat:.6f}, {r.lon:.6f}" if r.popup is None else r.popup  # a point without a stratum has no popup
            out.write(f'<circle cx="{r.lon}" cy="{-r.lat}" r="0.4" fill="{r.colour}" fill-opacity="0.8"><title>{html.escape(title)}</title></circle>\n')
            n += 1
        out.write("</svg>\n")
    return n


def geojson_features(df: DataFrame) -> DataFrame:
    """One GeoJSON feature a row, as text."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    properties = F.struct("stratum", "colour", "popup")
    return marker_rows(df).select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))).alias("value"))
