"""Descriptions of remote and file sources: manifests, listings, rasters, tagged elements, image series."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Paths and sizes below a folder; file contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length")


def listing_lines(text: Column) -> Column:
    """Lines of the text of a listing, without what is blank around it; a blank text has none."""
    stripped = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.filter(F.split(stripped, "\n"), lambda line: line != "")


def check_manifest(manifest: DataFrame, found: DataFrame, key: str = "path") -> DataFrame:
    """manifest with status: found or missing."""
    there = found.select(key).distinct().withColumn("__there", F.lit(True))
    return manifest.join(there, key, "left").withColumn("status", F.when(F.col("__there"), "found").otherwise("missing")).drop("__there")


def overpass_query(tag: str, value: str, south: float, west: float, north: float, east: float, timeout: int = 25) -> str:
    """Text of a query for ways with a tag in a box; sending it is the caller's part."""
    return f'[out:json][timeout:{timeout}];way["{tag}"="{value}"]({south},{west},{north},{east});out body;'


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def elements(responses: DataFrame, column: str = "body") -> DataFrame:
    """One row for each element of JSON responses; a null or broken response has none."""
    parsed = F.from_json(F.col(column), "elements array<string>")
    return responses.select(F.explode(parsed["elements"]).alias("element"))


#: Fields of an element of a map server's reply.
ELEMENT = "struct<type: string, id: bigint, lat: double, lon: double, tags: map<string, string>>"


def read_replies(spark: SparkSession, path: str) -> DataFrame:
    """(path, body) of saved replies, a file each."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def map_elements(responses: DataFrame, column: str = "body") -> DataFrame:
    """type, id, lat, lon and tags of each element of replies; a null or broken reply has none."""
    return responses.select(F.explode(F.from_json(F.col(column), f"elements array<{ELEMENT}>")["elements"]).alias("e")).select("e.*")


def tagged(found: DataFrame, tag: str, value: str, south: float, west: float, north: float, east: float) -> DataFrame:
    """Elements with a tag in a box, as the query text asks a server for them."""
    return found.where((F.try_element_at("tags", F.lit(tag)) == value) & in_box(F.col("lat"), F.col("lon"), south, west, north, east))


def element_count(body: Column) -> Column:
    return F.coalesce(F.size(F.from_json(body, "elements array<string>")["elements"]), F.lit(0))


def tiff_metadata(content: bytes) -> dict:
    """width, height and EPSG code (if any) of a TIFF's first directory."""
    order = {b"II": "<", b"MM": ">"}[content[:2]]
    version = struct.unpack(order + "H", content[2:4])[0]
    if version == 42:
        at, count, entry, number, value = struct.unpack(order + "I", content[4:8])[0], "H", 12, "I", 8
    elif version == 43:
        at, count, entry, number, value = struct.unpack(order + "Q", content[8:16])[0], "Q", 20, "Q", 12
    else:
        raise ValueError("not a TIFF")
    n, start = struct.unpack_from(order + count, content, at)[0], at + struct.calcsize(count)
    out: dict = {"width": None, "height": None, "crs": None}
    for i in range(n):
        p = start + i * entry
        tag, kind = struct.unpack_from(order + "HH", content, p)
        size = struct.unpack_from(order + number, content, p + 4)[0]
        if tag in (256, 257):
            out["width" if tag == 256 else "height"] = struct.unpack_from(order + ("H" if kind == 3 else "I"), content, p + value)[0]
        elif tag == 34735:  # geographic keys: projected (3072) or geographic (2048) code
            where = struct.unpack_from(order + number, content, p + value)[0] if size * 2 > entry - value else p + value
            keys = struct.unpack_from(f"{order}{size}H", content, where)
            codes = {keys[k]: keys[k + 3] for k in range(4, size - 3, 4)}
            if code := codes.get(3072) or codes.get(2048):
                out["crs"] = f"EPSG:{code}"
    return out


def tiff_pixels(content: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows of values) of a TIFF of one band in strips, plain or deflated."""
    order = {b"II": "<", b"MM": ">"}[content[:2]]
    if struct.unpack(order + "H", content[2:4])[0] != 42:
        raise ValueError("not a plain TIFF")
    at = struct.unpack(order + "I", content[4:8])[0]
    tags: dict[int, tuple] = {258: (1,), 259: (1,), 277: (1,), 317: (1,), 339: (1,)}
    for i in range(struct.unpack_from(order + "H", content, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", content, at + 2 + 12 * i)
        if kind in (1, 3, 4):
            code = order + str(n) + {1: "B", 3: "H", 4: "I"}[kind]
            place = at + 10 + 12 * i
            tags[tag] = struct.unpack_from(code, content, place if struct.calcsize(code) <= 4 else struct.unpack_from(order + "I", content, place)[0])
    if 273 not in tags or tags[277][0] != 1 or tags[317][0] != 1 or tags[259][0] not in (1, 8, 32946):
        raise ValueError("only strips of one band, plain or deflated, are read")
    width, height, rows = tags[256][0], tags[257][0], tags.get(278, tags[257])[0]
    kind = np.dtype(order + {1: "u", 2: "i", 3: "f"}[tags[339][0]] + str(tags[258][0] // 8))
    for k, (start, size) in enumerate(zip(tags[273], tags[279], strict=True)):
        strip = content[start : start + size]
        if tags[259][0] != 1:
            strip = zlib.decompress(strip)
        n = min(rows, height - k * rows)
        yield k * rows, np.frombuffer(strip, kind, n * width).reshape(n, width)


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """(path, px_row, px_col, value) of TIFF files, a strip at a time; a file is read by one task."""
    import pandas as pd

    def parse(frames):
        for f in frames:
            for file, content in zip(f["path"], f["content"], strict=True):
                for first, rows in tiff_pixels(content):
                    n, width = rows.shape
                    yield pd.DataFrame({"path": file, "px_row": np.repeat(np.arange(first, first + n), width), "px_col": np.tile(np.arange(width), n), "value": rows.ravel().astype(float)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif*").load(path)
    return files.select("path", "content").mapInPandas(parse, "path string, px_row int, px_col int, value double")


def raster_metadata(spark: SparkSession, path: str) -> DataFrame:
    """path, crs, width, height of TIFF files."""
    import pandas as pd

    def parse(frames):
        for f in frames:
            yield pd.DataFrame([{"path": p, **tiff_metadata(c)} for p, c in zip(f["path"], f["content"], strict=True)], columns=["path", "crs", "width", "height"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif*").load(path)
    return files.select("path", "content").mapInPandas(parse, "path string, crs string, width int, height int")


def window_mean(series: DataFrame, lo: str, hi: str, keys: list[str], value: str, ts: str = "ts") -> DataFrame:
    """Mean of value by keys over lo <= ts < hi; the filter reaches the scan."""
    return series.where((F.col(ts) >= F.lit(lo).cast("timestamp_ntz")) & (F.col(ts) < F.lit(hi).cast("timestamp_ntz"))).groupBy(*keys).agg(F.avg(value).alias("mean_value"))
