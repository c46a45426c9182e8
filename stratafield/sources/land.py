"""Land polygons as edges: (poly_id, ring_id, seq, x1, y1, x2, y2)."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE_SCHEMA = "poly_id bigint, ring_id int, seq int, x1 double, y1 double, x2 double, y2 double"


def edges_frame(spark: SparkSession, polygons: Iterable[Iterable[Iterable[tuple[float, float]]]]) -> DataFrame:
    """polygons: rings of (x, y); rings need not repeat their first point."""
    rows = []
    for p, rings in enumerate(polygons):
        for r, ring in enumerate(rings):
            pts = [tuple(map(float, xy)) for xy in ring]
            if pts and pts[0] == pts[-1]:
                pts = pts[:-1]
            rows += [(p, r, i, *a, *b) for i, (a, b) in enumerate(zip(pts, pts[1:] + pts[:1], strict=True))]
    return spark.createDataFrame(rows, EDGE_SCHEMA)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Edges of Polygon and MultiPolygon features of GeoJSON collections; a polygon is told apart by file, feature and part."""
    schema = "features array<struct<geometry:struct<type:string,coordinates:string>>>"
    shapes = spark.read.schema(schema).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("file"), F.posexplode("features").alias("f", "feature"))
    kind, raw = F.col("feature.geometry.type"), F.col("feature.geometry.coordinates")
    one = F.array(F.from_json(raw, "array<array<array<double>>>"))
    polygons = F.when(kind == "Polygon", one).when(kind == "MultiPolygon", F.from_json(raw, "array<array<array<array<double>>>>"))
    rings = shapes.select("file", "f", F.posexplode(polygons).alias("p", "rings")).select("file", "f", "p", F.posexplode("rings").alias("ring_id", "ring"))
    points = rings.select("file", "f", "p", "ring_id", F.posexplode("ring").alias("seq", "a"), "ring").where(F.col("seq") < F.size("ring") - 1)
    b = F.get("ring", F.col("seq") + 1)
    return points.select(F.xxhash64("file", "f", "p").alias("poly_id"), "ring_id", "seq", F.col("a")[0].alias("x1"), F.col("a")[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"))


def shapefile_edges(content: bytes) -> Iterator[tuple]:
    """Edges of the polygon records (types 5, 15, 25) of a .shp file's bytes."""
    if struct.unpack(">i", content[:4])[0] != 9994:
        raise ValueError("not a shapefile")
    at, poly = 100, 0
    while at + 12 <= len(content):
        length = struct.unpack(">i", content[at + 4 : at + 8])[0] * 2
        body = content[at + 8 : at + 8 + length]
        if struct.unpack("<i", body[:4])[0] in (5, 15, 25):
            parts, points = struct.unpack("<2i", body[36:44])
            starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
            xy = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
            for r in range(parts):
                for i, k in enumerate(range(starts[r], starts[r + 1] - 1)):
                    yield poly, r, i, *xy[2 * k : 2 * k + 4]
        poly += 1
        at += 8 + length


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a .shp file, or of all in a folder; a polygon, with all its parts, is told apart by file and record."""
    import pandas as pd

    names = [c.split()[0] for c in EDGE_SCHEMA.split(", ")]

    def parse(frames):
        for f in frames:
            for file, content in zip(f["path"], f["content"], strict=True):
                edges = pd.DataFrame(list(shapefile_edges(content)), columns=names)
                edges.insert(0, "file", file)
                yield edges

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.shp").load(path)
    edges = files.select("path", "content").mapInPandas(parse, "file string, " + EDGE_SCHEMA)
    return edges.select(F.xxhash64("file", "poly_id").alias("poly_id"), *names[1:])
