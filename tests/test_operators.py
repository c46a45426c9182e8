import json
import logging
import math
import random
import struct
import time
import zlib

import pytest
from pyspark.sql import functions as F

from stratafield.functions.captions import label, model_caption
from stratafield.functions.geo import bounding_box, tile_key
from stratafield.operators import land, quality, spacing
from stratafield.sources import points, remote
from stratafield.plans.pipeline import generate_points
from stratafield.sources.catalogue import SamplingParameters, get_logger, load_config, load_regions, log_counts, parameters
from stratafield.sources.land import edges_frame, read_geojson, read_shapefile, shapefile_edges
from stratafield.streaming.checks import windowed_counts

POINT = "attempt_no long, lat double, lon double"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_spacing_is_strict_and_joined_by_cells(spark):
    accepted = spark.createDataFrame([(10.0, 20.0)], "lat double, lon double")
    just_over, just_under = 10.0 + 1.0000001 / 111.32, 10.0 + 0.9999 / 111.32
    df = spark.createDataFrame([(1, just_over, 20.0), (2, just_under, 20.0), (3, 10.0, 20.0), (4, 10.0, 20.02)], POINT)
    free = spacing.away_from(df, accepted, 1.0)
    assert sorted(r.attempt_no for r in free.collect()) == [1, 4] and free.columns == df.columns
    for plan in (plan_of(spacing.conflicts(df, "attempt_no", 1.0)), plan_of(free)):
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "LeftAnti" in plan_of(free) and "Aggregate" not in plan_of(free)
    assert spacing.away_from(df, accepted.limit(0), 1.0).count() == 4


@pytest.mark.parametrize("low,high,width", [(-0.05, 0.05, 0.1), (48.0, 48.1, 0.15), (-89.2, -89.0, 6.0), (89.85, 90.0, 360.0)])
def test_spacing_equals_all_pairs_at_any_latitude(spark, low, high, width):
    """At the poles the cells are wide, and no close pair is missed."""
    rng = random.Random(low)
    points = [(i, rng.uniform(low, high), rng.uniform(-width / 2, width / 2)) for i in range(150)] + [(150, high, -width / 2), (151, high, width / 2)]
    got = {(r.earlier, r.later) for r in spacing.conflicts(spark.createDataFrame(points, POINT), "attempt_no", 1.0).collect()}
    want = set()
    for i, a, o in points:
        for j, b, p in points[i + 1 :]:
            if math.hypot((b - round(a, 6)) * 111.32, (p - round(o, 6)) * 111.32 * math.cos(math.radians(b))) < 1.0:
                want.add((i, j))
    assert got == want and want


def test_land_holes_and_buffer(spark):
    edges = edges_frame(spark, [[[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (3, 1), (3, 3), (1, 3)]]])
    df = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 5.0, 5.0), (4, 4.2, 2.0), (5, 1.1, 2.0), (6, None, 1.0), (7, float("nan"), 1.0)], POINT)
    assert sorted(r.attempt_no for r in land.on_land(df, land.prepare(edges)).collect()) == [1]
    assert sorted(r.attempt_no for r in land.on_land(df, land.prepare(edges, 0.3)).collect()) == [1, 4, 5]
    assert land.on_land(df, land.prepare(edges.limit(0), 0.3)).count() == 0
    plan = plan_of(land.on_land(df, land.prepare(edges, 0.3)))
    assert plan.count("BroadcastHashJoin") == 2 and "Aggregate" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("broadcast", [land.BROADCAST_BYTES, 0])
def test_land_equals_a_loop(spark, broadcast, monkeypatch):
    """Polygons that overlap, lie in each other or are long and slanting, with and without broadcast tables."""
    monkeypatch.setattr(land, "BROADCAST_BYTES", broadcast)
    rng = random.Random(9)
    polygons = [[[(0, 0), (3, 0), (3, 2), (0, 2)]], [[(1, 1), (2, 1), (2, 1.5), (1, 1.5)]], [[(-2.5, -1.7), (4, 3.3), (4, 3.35)]], [[(rng.uniform(-3, 4), rng.uniform(-2, 4)) for _ in range(7)]]]
    points = [(i, rng.uniform(-2.5, 4.5), rng.uniform(-4, 5)) for i in range(800)]

    def distance(lat, lon, a, b):
        (x1, y1), (x2, y2) = a, b
        t = max(0, min(1, ((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
        return math.hypot(lon - x1 - t * (x2 - x1), lat - y1 - t * (y2 - y1))

    def inside(lat, lon, rings):
        edges = [e for r in rings for e in zip(r, r[1:] + r[:1], strict=True)]
        return sum((y1 > lat) != (y2 > lat) and lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1) for (x1, y1), (x2, y2) in edges) % 2 == 1

    df, edges = spark.createDataFrame(points, POINT), edges_frame(spark, polygons)
    for buffer in (0.0, 0.05, 0.4):
        want = [i for i, lat, lon in points if any(inside(lat, lon, p) or any(distance(lat, lon, a, b) < buffer for r in p for a, b in zip(r, r[1:] + r[:1], strict=True)) for p in polygons)]
        assert sorted(r.attempt_no for r in land.on_land(df, land.prepare(edges, buffer)).collect()) == want


def shapefile(records):
    """Bytes of a .shp file of polygon records, each a list of closed rings."""
    out = struct.pack(">i", 9994) + bytes(96)
    for n, rings in enumerate(records, 1):
        points = [v for r in rings for p in r for v in p]
        starts = [sum(len(r) for r in rings[:k]) for k in range(len(rings))]
        body = struct.pack("<i4d2i", 5, 0, 0, 4, 4, len(rings), len(points) // 2) + struct.pack(f"<{len(rings)}i", *starts) + struct.pack(f"<{len(points)}d", *points)
        out += struct.pack(">2i", n, len(body) // 2) + body
    return out


def square(x, y, size):
    return [(x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y)]


def test_land_sources(spark, tmp_path):
    ring = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 0.0]]
    shapes = [{"type": "Polygon", "coordinates": [ring]}, {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}, {"type": "Point", "coordinates": [1, 2]}]
    for name in "ab":
        (tmp_path / f"{name}.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": g} for g in shapes]}))
    got = read_geojson(spark, str(tmp_path / "a.json"))
    assert got.count() == 9 and got.select("poly_id").distinct().count() == 3
    assert read_geojson(spark, f"{tmp_path}/*.json").select("poly_id").distinct().count() == 6
    shp = shapefile([[ring]])
    assert list(shapefile_edges(shp)) == [(0, 0, 0, 0, 0, 4, 0), (0, 0, 1, 4, 0, 4, 4), (0, 0, 2, 4, 4, 0, 0)]
    (tmp_path / "b.shp").write_bytes(shp)
    edges = read_shapefile(spark, str(tmp_path))
    assert edges.count() == 3 and edges.dtypes == got.dtypes == edges_frame(spark, [[ring]]).dtypes


def test_land_of_several_files(spark, tmp_path):
    """A point in a polygon of each file is on land; the second part of a record is its hole."""
    (tmp_path / "a.shp").write_bytes(shapefile([[square(0, 0, 4)], [square(10, 0, 4), square(11, 1, 2)]]))
    (tmp_path / "b.shp").write_bytes(shapefile([[square(1, 1, 4)]]))
    edges = read_shapefile(spark, str(tmp_path))
    assert edges.select("poly_id").distinct().count() == 3
    df = spark.createDataFrame([(1, 2.0, 2.0), (2, 4.5, 4.5), (3, 2.0, 12.0), (4, 0.5, 10.5), (5, 7.0, 7.0)], POINT)
    assert sorted(r.attempt_no for r in land.on_land(df, land.prepare(edges)).collect()) == [1, 2, 4]
    p = SamplingParameters({"a": 5}, seed=1)
    assert generate_points(spark, p, {"a": [(1.0, 4.0, 1.0, 4.0)]}, edges, 0.0).count() == 5
    (tmp_path / "c.json").write_text(json.dumps({"features": [{"geometry": {"type": "Polygon", "coordinates": [square(0, 0, 4)]}}]}))
    drawn = generate_points(spark, p, {"a": [(0.0, 8.0, 0.0, 8.0)]}, read_geojson(spark, str(tmp_path / "c.json")), 0.0).collect()
    assert len(drawn) == 5 and all(0 <= r.lat <= 4 and 0 <= r.lon <= 4 for r in drawn)


def test_quality_with_null_and_nan(spark):
    df = spark.createDataFrame([(1.0, 2.0), (float("nan"), None), (1.0, 2.0), (None, 5.5)], "lat double, lon double")
    r = quality.report(df).first()
    assert (r.n_rows, r.n_missing, r.duplicates, r.min_lat, r.max_lat, r.max_lon) == (4, 3, 1, 1.0, 1.0, 5.5)
    empty = quality.report(df.limit(0)).first()
    assert (empty.n_rows, empty.n_missing, empty.duplicates, empty.max_lat) == (0, 0, 0, None)
    ties = spark.createDataFrame([("b",), ("a",), (None,)], "k string")
    assert [(r.k, r.n) for r in quality.value_counts(ties, "k").collect()] == [("a", 1), ("b", 1)]


def test_box_tile_label(spark):
    df = spark.createDataFrame([(90.0, 0.0), (-0.5, -0.0005)], "lat double, lon double")
    rows = df.select(tile_key(F.col("lat"), F.col("lon")).alias("t"), *[c.alias(n) for n, c in bounding_box(F.col("lat"), F.col("lon")).items()], label(F.col("lat"), [(0.0, "low")], "high").alias("l")).collect()
    assert rows[1].t == "ESA_WorldCover_10m_2021_v200_S03W003_Map.tif" and rows[1].l == "low" and rows[0].l == "high"
    assert abs(rows[1].bbox_max_lat - rows[1].bbox_min_lat - 256 / 111320) < 1e-12
    asked = df.select(model_caption(F.lit("p"), lambda p: p + "!").alias("c")).collect()
    assert [r.c for r in asked] == ["p!", "p!"]


def test_map_of_a_point_without_a_stratum(spark, tmp_path):
    df = spark.createDataFrame([(1.5, -2.25, None)], "lat double, lon double, stratum string")
    assert points.save_map(df, str(tmp_path / "map.html")) == 1
    assert "<title>1.500000, -2.250000</title>" in (tmp_path / "map.html").read_text()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.5, -2.25, "forest", 1.0, 2.0, 3.0, 4.0), (2, 0.0, 0.0005, "<x>", 1.0, 2.0, 3.0, 4.0)], points.POINT_SCHEMA)
    points.save_csv(df, str(tmp_path / "p"), files=1)
    assert sorted(points.read_csv(spark, str(tmp_path / "p")).collect()) == sorted(df.collect())
    assert points.save_map(df, str(tmp_path / "m" / "map.html")) == 2
    page = (tmp_path / "m" / "map.html").read_text()
    assert "darkgreen" in page and "gray" in page and "&lt;x&gt;" in page
    assert json.loads(points.geojson_features(df).orderBy("value").first().value)["geometry"]["type"] == "Point"
    points.save_csv(df.limit(0), str(tmp_path / "none"))
    assert points.read_csv(spark, str(tmp_path / "none")).count() == 0
    points.save_partitioned(df, str(tmp_path / "by"))
    one = spark.read.parquet(str(tmp_path / "by")).where("stratum = 'forest'")
    assert one.count() == 1 and "PartitionFilters: [isnotnull(stratum" in plan_of(one)


def test_csv_gives_back_every_value(spark, tmp_path):
    values = [None, "", " ", " a ", "a\tb", '"', 'q"u,o"t', ",", "NA", "null", "\\", "é漢", "'"]
    df = spark.createDataFrame([(i, v, v, float(i) if i % 2 else None) for i, v in enumerate(values)], "i int, a string, b string, x double")
    points.save_csv(df, str(tmp_path / "v"))
    assert sorted(points.read_csv(spark, str(tmp_path / "v"), "i int, a string, b string, x double").collect()) == sorted(df.collect())
    tokens = points.read_csv(spark, str(tmp_path / "v"), "i int, a string, b string, x double", points.NULL_TOKENS)
    assert tokens.where("a is null").count() == 3
    lines = spark.createDataFrame([(1, "two\nlines"), (2, "")], "i int, a string")
    points.save_csv(lines, str(tmp_path / "l"))
    assert sorted(points.read_csv(spark, str(tmp_path / "l"), "i int, a string", lines_in_values=True).collect()) == sorted(lines.collect())


def test_remote_sources(spark, tmp_path):
    (tmp_path / "x.tif").write_bytes(b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 3) + struct.pack("<HHIHH", 256, 3, 1, 640, 0) + struct.pack("<HHII", 257, 4, 1, 480) + struct.pack("<HHII", 34735, 3, 8, 50) + bytes(4) + struct.pack("<8H", 1, 1, 0, 1, 2048, 0, 1, 4326))
    r = remote.raster_metadata(spark, str(tmp_path)).first()
    assert (r.width, r.height, r.crs) == (640, 480, "EPSG:4326")
    found = remote.listing(spark, str(tmp_path), "*.tif")
    assert found.count() == 1
    manifest = spark.createDataFrame([(found.first().path,), ("nowhere",)], "path string")
    assert {r.status for r in remote.check_manifest(manifest, found).collect()} == {"found", "missing"}
    replies = spark.createDataFrame([('{"elements": [1, {"a": 2}]}',), ("broken",), (None,), ("{}",)], "body string")
    assert [r[0] for r in replies.select(remote.element_count(F.col("body"))).collect()] == [2, 0, 0, 0]
    assert remote.elements(replies).count() == 2
    assert '["power"="line"](1,2,3,4)' in remote.overpass_query("power", "line", 1, 2, 3, 4)


def test_replies_of_a_map_server(spark, tmp_path):
    bodies = ['{"elements": [{"type": "way", "id": 7, "lat": 1.5, "lon": 2.5, "tags": {"power": "line"}}, {"type": "node", "id": 8, "lat": 9, "lon": 2, "tags": {"power": "line"}}, {"id": 9, "lat": 1.5, "lon": 2.5}]}', "broken", "{}", ""]
    for i, b in enumerate(bodies):
        (tmp_path / f"{i}.json").write_text(b)
    found = remote.map_elements(remote.read_replies(spark, str(tmp_path)))
    assert sorted(r.id for r in found.collect()) == [7, 8, 9]
    assert [(r.id, r.type) for r in remote.tagged(found, "power", "line", 1, 2, 3, 4).collect()] == [(7, "way")]


def test_config_and_log(tmp_path):
    (tmp_path / "c.yaml").write_text("sampling: {min_spacing_km: 2, strata: {a: 3, b: 4}}\nlogging: {level: WARNING}\n")
    p = parameters(load_config(str(tmp_path / "c.yaml")))
    assert p.total == 7 and p.min_spacing_km == 2 and p.log_level == "WARNING" and list(p.quotas) == ["a", "b"]
    log = get_logger("t", "WARNING", str(tmp_path / "logs" / "x.log"))
    (tmp_path / "d.yaml").write_text(f"sampling: {{seed: 3}}\nlogging: {{log_file: {tmp_path}/logs/y.log}}\n")
    assert (q := parameters(load_config(str(tmp_path / "d.yaml")))).log_file == f"{tmp_path}/logs/y.log" and q.seed == 3
    (tmp_path / "r.yaml").write_text("strata:\n  a: {count: 3, regions: [[[1, 2], [3, 4]], [[5, 6.5], [7, 8]]]}\n  b: [[1, 2, 3, 4]]\n  c: {count: 0}\n")
    assert load_regions(str(tmp_path / "r.yaml")) == {"a": [(1, 2, 3, 4), (5, 6.5, 7, 8)], "b": [(1, 2, 3, 4)], "c": []}
    (tmp_path / "s.yaml").write_text("a: [[1, 2, 3]]\n")
    with pytest.raises(ValueError):
        load_regions(str(tmp_path / "s.yaml"))
    assert get_logger("t").handlers == log.handlers and len(log.handlers) == 2


def test_counts_are_logged_by_the_action_that_reads(spark, tmp_path):
    log = get_logger("counts", "INFO", str(tmp_path / "c.log"))
    assert log_counts(log, spark.range(7), "seven", rows=F.count(F.lit(1)), most=F.max("id")).count() == 7
    for _ in range(100):
        if "seven" in (said := (tmp_path / "c.log").read_text()):
            break
        time.sleep(0.05)
    assert "counts | INFO | seven: rows 7, most 6" in said


def test_run_logs_to_the_configured_file(spark, tmp_path):
    logging.getLogger("stratafield").handlers.clear()
    p = SamplingParameters({"a": 2}, log_file=str(tmp_path / "run" / "x.log"))
    generate_points(spark, p, {"a": [(0.0, 1.0, 0.0, 1.0)]})
    assert "a: 2/2 points" in (tmp_path / "run" / "x.log").read_text()
    logging.getLogger("stratafield").handlers.clear()


@pytest.mark.parametrize("packed,kind,code", [(False, 3, "f"), (True, 1, "H")])
def test_pixels(spark, tmp_path, packed, kind, code):
    """Three rows of four values in two strips."""
    rows = [[r * 10 + c for c in range(4)] for r in range(3)]
    size = struct.calcsize(code)
    strips = [struct.pack(f"<{4 * len(part)}{code}", *sum(part, [])) for part in (rows[:2], rows[2:])]
    strips = [zlib.compress(x) for x in strips] if packed else strips
    tags = [(256, 4), (257, 3), (258, 8 * size), (259, 8 if packed else 1), (273, None), (277, 1), (278, 2), (279, None), (339, kind)]
    data = 8 + 2 + 12 * len(tags) + 4
    places = struct.pack("<2I", data + 16, data + 16 + len(strips[0])) + struct.pack("<2I", *map(len, strips))
    body = b"".join(struct.pack("<HHII", t, 4, 2, data + (0 if t == 273 else 8)) if v is None else struct.pack("<HHII", t, 4, 1, v) for t, v in tags)
    (tmp_path / "x.tif").write_bytes(b"II*\0" + struct.pack("<IH", 8, len(tags)) + body + bytes(4) + places + b"".join(strips))
    got = {(r.px_row, r.px_col): r.value for r in remote.read_pixels(spark, str(tmp_path)).collect()}
    assert got == {(r, c): float(rows[r][c]) for r in range(3) for c in range(4)}


def test_listing_lines(spark):
    df = spark.createDataFrame([("  a b \n\nc\n",), ("",), (" \n ",), ("x",)], "t string")
    assert [r[0] for r in df.select(remote.listing_lines(F.col("t"))).collect()] == [["a b ", "c"], [], [], ["x"]]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 01:00:00", "a"), ("2024-01-01 05:00:00", "a"), ("2024-01-02 01:00:00", "b"), ("2024-01-09 01:00:00", "b")], "ts string, k string").select(F.col("ts").cast("timestamp").alias("ts"), "k")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = windowed_counts(stream, "k").writeStream.format("memory").queryName("seen").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    assert sorted(spark.table("seen").collect()) == sorted(windowed_counts(rows, "k").collect())
