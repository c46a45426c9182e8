"""Registered queries on the test tables, and the SQL that gives the same rows.

The tables have no coordinates: orders play candidates (stratum = o_orderpriority, attempt_no = o_orderkey), placed in
one small box by draws that both engines can make from MD5.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafield.functions.captions import label, stratum_rules, template_caption
from stratafield.functions.geo import between, bounding_box, round6, tile_key, uniform
from stratafield.operators import land, pixels, quality, spacing
from stratafield.operators.candidates import candidates as candidate_draws
from stratafield.operators.candidates import first_of_each, pick_region
from stratafield.operators.sampler import assign_ids, sample, shape
from stratafield.session import own_folder
from stratafield.sources import points as sink
from stratafield.sources import remote
from stratafield.sources.catalogue import regions_frame, strata_frame
from stratafield.sources.land import edges_frame

QUOTAS = (("1-URGENT", 300), ("2-HIGH", 300), ("3-MEDIUM", 200), ("4-NOT SPECIFIED", 100), ("5-LOW", 50))
LAT, LON, SPACING = (48.0, 50.0), (-2.0, 1.0), 1.0
#: Made-up polygons (x, y): a square with a hole, and a triangle.
LAND = ([[(-1.8, 48.2), (-0.2, 48.2), (-0.2, 49.8), (-1.8, 49.8)], [(-1.2, 48.8), (-0.8, 48.8), (-0.8, 49.2), (-1.2, 49.2)]], [[(0.1, 48.1), (0.9, 48.4), (0.4, 49.9)]])
BUFFER = 0.05
BOXES = ((48.0, 48.5, -2.0, -1.0), (48.5, 49.0, -1.0, 0.0), (49.0, 50.0, 0.0, 1.0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stratum, attempt_no, lat, lon) of all orders."""
    key = F.col("o_orderkey")
    lat, lon = between(*LAT, uniform("lat", key)), between(*LON, uniform("lon", key))
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("stratum"), key.alias("attempt_no"), lat.alias("lat"), lon.alias("lon"))


def _own(spark: SparkSession, name: str) -> str:
    return f"{own_folder(spark)}/{uuid.uuid4().hex}-{name}"


def strata(spark: SparkSession) -> DataFrame:
    return strata_frame(spark, QUOTAS)


def _u(tag: str, key: str = "o_orderkey") -> str:
    return f"(('0x' || substr(md5('{tag}|' || {key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _between(lo: float, hi: float, u: str) -> str:
    return f"({lo}::DOUBLE + ({hi}::DOUBLE - {lo}::DOUBLE) * {u})"


PLACED = f"placed AS (SELECT o_orderpriority AS stratum, o_orderkey AS attempt_no, {_between(*LAT, _u('lat'))} AS lat, {_between(*LON, _u('lon'))} AS lon FROM orders)"
STRATA = "strata(stratum_ord, stratum, quota) AS (VALUES " + ", ".join(f"({i}, '{s}', {q})" for i, (s, q) in enumerate(QUOTAS, 1)) + ")"
_EDGE_ROWS = [(p, r, i, *a, *b) for p, rings in enumerate(LAND) for r, ring in enumerate(rings) for i, (a, b) in enumerate(zip(ring, ring[1:] + ring[:1], strict=True))]
EDGES = "edges(poly_id, ring_id, seq, x1, y1, x2, y2) AS (VALUES " + ", ".join("(" + ", ".join(f"{v}::DOUBLE" if k > 2 else str(v) for k, v in enumerate(row)) + ")" for row in _EDGE_ROWS) + ")"
INSIDE = "SELECT attempt_no FROM (SELECT attempt_no, poly_id, count(*) AS n FROM placed JOIN edges ON (y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) * ((x2 - x1) / (y2 - y1)) GROUP BY ALL) WHERE n % 2 = 1"
NEAR = f"""SELECT attempt_no FROM (SELECT attempt_no, lat, lon, x1, y1, x2, y2, greatest(0.0, least(1.0, ((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t FROM placed, edges)
WHERE sqrt((lon - (x1 + t * (x2 - x1))) ** 2 + (lat - (y1 + t * (y2 - y1))) ** 2) < {BUFFER}"""
_DISTANCE = "sqrt((abs(b.lat - a.e_lat) * 111.32::DOUBLE) ** 2 + (abs(b.lon - a.e_lon) * 111.32::DOUBLE * cos(radians(b.lat))) ** 2)"
_ROUNDED = "rounded AS (SELECT stratum, attempt_no, round_even(lat, 6) AS e_lat, round_even(lon, 6) AS e_lon FROM placed)"
_LATLON = "round_even(lat, 6) AS lat, round_even(lon, 6) AS lon"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return register


@query(f"WITH {STRATA} SELECT stratum_ord::INTEGER AS stratum_ord, stratum, quota::INTEGER AS quota FROM strata")
def strata_catalogue(spark, sf_dir):
    return strata(spark)


@query(f"WITH {PLACED} SELECT stratum, attempt_no, {_LATLON} FROM placed")
def candidates(spark, sf_dir):
    return placed(spark, sf_dir).select("stratum", "attempt_no", round6(F.col("lat")).alias("lat"), round6(F.col("lon")).alias("lon"))


_BOXES = "boxes(region_idx, lat_lo, lat_hi, lon_lo, lon_hi) AS (VALUES " + ", ".join(f"({i}, " + ", ".join(f"{v}::DOUBLE" for v in b) + ")" for i, b in enumerate(BOXES)) + ")"


@query(f"WITH {_BOXES} SELECT o_orderkey AS attempt_no, region_idx::INTEGER AS region_idx, round_even(lat_lo + (lat_hi - lat_lo) * {_u('lat')}, 6) AS lat, round_even(lon_lo + (lon_hi - lon_lo) * {_u('lon')}, 6) AS lon FROM orders JOIN boxes ON region_idx = floor({_u('region')} * {len(BOXES)})")
def region_pick(spark, sf_dir):
    boxes = spark.createDataFrame([(i, *b) for i, b in enumerate(BOXES)], "region_idx int, lat_lo double, lat_hi double, lon_lo double, lon_hi double")
    key = F.col("o_orderkey")
    drawn = table(spark, sf_dir, "orders").select(key, pick_region(uniform("region", key), F.lit(len(BOXES))).alias("region_idx")).join(boxes, "region_idx")
    return drawn.select(key.alias("attempt_no"), "region_idx", round6(between(F.col("lat_lo"), F.col("lat_hi"), uniform("lat", key))).alias("lat"), round6(between(F.col("lon_lo"), F.col("lon_hi"), uniform("lon", key))).alias("lon"))


_BBOX = "round_even(lat - 128.0::DOUBLE / 111320.0::DOUBLE, 6) AS bbox_min_lat, round_even(lat + 128.0::DOUBLE / 111320.0::DOUBLE, 6) AS bbox_max_lat, round_even(lon - 128.0::DOUBLE / (111320.0::DOUBLE * cos(radians(lat))), 6) AS bbox_min_lon, round_even(lon + 128.0::DOUBLE / (111320.0::DOUBLE * cos(radians(lat))), 6) AS bbox_max_lon"


@query(f"WITH {PLACED} SELECT attempt_no, {_BBOX} FROM placed")
def bbox(spark, sf_dir):
    box = bounding_box(F.col("lat"), F.col("lon"))
    return placed(spark, sf_dir).select("attempt_no", *[round6(c).alias(n) for n, c in box.items()])


@query(f"WITH {PLACED}, {_ROUNDED} SELECT a.attempt_no AS earlier, b.attempt_no AS later FROM rounded a JOIN placed b ON a.attempt_no < b.attempt_no WHERE {_DISTANCE} < {SPACING}")
def spacing_conflicts(spark, sf_dir):
    return spacing.conflicts(placed(spark, sf_dir), "attempt_no", SPACING)


@query(f"WITH {PLACED}, {_ROUNDED} SELECT b.attempt_no, {_LATLON} FROM placed b WHERE b.stratum <> '1-URGENT' AND NOT EXISTS (SELECT 1 FROM rounded a WHERE a.stratum = '1-URGENT' AND {_DISTANCE} < {SPACING})")
def spacing_anti_join(spark, sf_dir):
    points = placed(spark, sf_dir)
    accepted = points.where("stratum = '1-URGENT'").select(round6(F.col("lat")).alias("lat"), round6(F.col("lon")).alias("lon"))
    free = spacing.away_from(points.where("stratum <> '1-URGENT'"), accepted, SPACING)
    return free.select("attempt_no", round6(F.col("lat")).alias("lat"), round6(F.col("lon")).alias("lon"))


@query(f"WITH {PLACED}, {EDGES} SELECT attempt_no, {_LATLON} FROM placed WHERE attempt_no IN ({INSIDE})")
def land_mask(spark, sf_dir):
    kept = land.on_land(placed(spark, sf_dir), land.prepare(edges_frame(spark, LAND)))
    return kept.select("attempt_no", round6(F.col("lat")).alias("lat"), round6(F.col("lon")).alias("lon"))


@query(f"WITH {PLACED}, {EDGES} SELECT attempt_no, {_LATLON} FROM placed WHERE attempt_no IN ({INSIDE}) OR attempt_no IN ({NEAR})")
def land_mask_buffered(spark, sf_dir):
    kept = land.on_land(placed(spark, sf_dir), land.prepare(edges_frame(spark, LAND), BUFFER))
    return kept.select("attempt_no", round6(F.col("lat")).alias("lat"), round6(F.col("lon")).alias("lon"))


_QUOTA_CUT = f"WITH {STRATA}, ranked AS (SELECT o_orderpriority AS stratum, o_orderkey AS attempt_no, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS k FROM orders), kept AS (SELECT stratum_ord, stratum, attempt_no FROM ranked JOIN strata USING (stratum) WHERE k <= quota)"


def _cut(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("stratum"), F.col("o_orderkey").alias("attempt_no"))
    return first_of_each(rows.join(strata(spark), "stratum"), "stratum", "attempt_no", F.col("quota"), max(q for _, q in QUOTAS))


@query(_QUOTA_CUT + " SELECT stratum, count(*) AS n FROM kept GROUP BY stratum")
def stratified_quota(spark, sf_dir):
    return _cut(spark, sf_dir).groupBy("stratum").agg(F.count("*").alias("n"))


#: The loop over draws, as a fold: an accepted point joins the list that later ones are held against.
_SAMPLER = f"""WITH {STRATA}, {PLACED}, {EDGES},
land AS (SELECT * FROM placed WHERE attempt_no IN ({INSIDE}) OR attempt_no IN ({NEAR})),
draws AS (
  SELECT coalesce(list([{{'k': stratum_ord, 'q': quota, 'a': attempt_no, 'lat': lat, 'lon': lon, 'rlat': round_even(lat, 6), 'rlon': round_even(lon, 6), 'c': cos(radians(lat))}}] ORDER BY stratum_ord, attempt_no), []) AS d
  FROM land JOIN strata USING (stratum)),
folded AS (
  SELECT unnest(list_reduce(d, lambda acc, x: CASE
    WHEN len(list_filter(acc, lambda p: p.k = x[1].k)) >= x[1].q THEN acc
    WHEN len(list_filter(acc, lambda p: sqrt((abs(x[1].lat - p.rlat) * 111.32::DOUBLE) ** 2 + (abs(x[1].lon - p.rlon) * 111.32::DOUBLE * x[1].c) ** 2) < {SPACING})) > 0 THEN acc
    ELSE list_concat(acc, x) END, [])) AS p
  FROM draws),
taken AS (SELECT p.k AS k, p.a AS a, p.lat AS lat, p.lon AS lon FROM folded)
SELECT row_number() OVER (ORDER BY k, a) AS id, {_LATLON}, stratum, {_BBOX} FROM taken JOIN strata ON k = stratum_ord"""


@query(_SAMPLER)
def sampler(spark, sf_dir):
    points = placed(spark, sf_dir)
    ground = land.prepare(edges_frame(spark, LAND), BUFFER)
    whole = {r.stratum: r.past for r in points.groupBy("stratum").agg((F.max("attempt_no") + 1).alias("past")).collect()}  # a row for each stratum

    def draw_of(stratum):
        mine = points.where(F.col("stratum") == stratum).select("attempt_no", "lat", "lon")
        return lambda first, past: mine.where((F.col("attempt_no") >= first) & (F.col("attempt_no") < past))

    draws = [(s, q, draw_of(s)) for s, q in QUOTAS if s in whole]
    return sample(draws, spark.createDataFrame([], "lat double, lon double"), SPACING, lambda p: land.on_land(p, ground), attempts=whole)


_SEED, _PER_POINT = 7, 150
_KEY = f"'{_SEED}|' || stratum || '|' || attempt_no"


@query(f"""WITH {STRATA}, {_BOXES}, drawn AS (
  SELECT *, floor({_u('region', '(' + _KEY + ')')} * {len(BOXES)})::INTEGER AS region_idx
  FROM (SELECT stratum_ord, stratum, unnest(range(quota * {_PER_POINT}))::BIGINT AS attempt_no FROM strata))
SELECT stratum_ord::INTEGER AS stratum_ord, stratum, attempt_no, region_idx, round_even(lat_lo + (lat_hi - lat_lo) * {_u('lat', '(' + _KEY + ')')}, 6) AS lat, round_even(lon_lo + (lon_hi - lon_lo) * {_u('lon', '(' + _KEY + ')')}, 6) AS lon
FROM drawn JOIN boxes USING (region_idx)""")
def candidate_stream(spark, sf_dir):
    """All attempts that the quotas allow, and none past them, however many are asked for."""
    regions = regions_frame(spark, {s: list(BOXES) for s, _ in QUOTAS})
    drawn = candidate_draws(strata(spark), regions, 0, 1 << 40, _SEED, _PER_POINT)
    return drawn.withColumns({"lat": round6(F.col("lat")), "lon": round6(F.col("lon"))})


@query(_QUOTA_CUT + " SELECT row_number() OVER (ORDER BY stratum_ord, attempt_no) AS id, stratum, attempt_no FROM kept", "assign_ids")
def assign_point_ids(spark, sf_dir):
    return assign_ids(_cut(spark, sf_dir), ["stratum_ord", "attempt_no"]).select("id", "stratum", "attempt_no")


@query(_QUOTA_CUT + f", {PLACED} SELECT row_number() OVER (ORDER BY stratum_ord, attempt_no) AS id, {_LATLON}, stratum, {_BBOX} FROM kept JOIN placed USING (stratum, attempt_no)")
def point_records(spark, sf_dir):
    points = _cut(spark, sf_dir).join(placed(spark, sf_dir), ["stratum", "attempt_no"])
    return shape(assign_ids(points, ["stratum_ord", "attempt_no"]))


@query("SELECT o_orderpriority AS stratum, o_orderkey AS attempt_no FROM orders UNION ALL SELECT 'customers', c_custkey FROM customer")
def union_strata(spark, sf_dir):
    points = placed(spark, sf_dir).select("stratum", "attempt_no")
    more = table(spark, sf_dir, "customer").select(F.lit("customers").alias("stratum"), F.col("c_custkey").alias("attempt_no"))
    return points.unionByName(more)


@query(f"WITH {STRATA}, c AS (SELECT o_orderpriority AS stratum, count(*) AS n FROM orders GROUP BY 1) SELECT stratum, quota::INTEGER AS quota, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) < quota THEN 'short' ELSE 'filled' END AS status FROM (SELECT stratum, quota FROM strata UNION ALL VALUES ('no such stratum', 5), ('also none', 0)) LEFT JOIN c USING (stratum)")
def quota_status(spark, sf_dir):
    points = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("stratum"))
    return quality.quota_status(strata_frame(spark, [*QUOTAS, ("no such stratum", 5), ("also none", 0)]), points)


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY event_type")
def value_counts(spark, sf_dir):
    return quality.value_counts(table(spark, sf_dir, "events"), "event_type")


@query("SELECT event_type AS k, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def counts_as_map(spark, sf_dir):
    return quality.counts_map(table(spark, sf_dir, "events"), "event_type").select(F.explode("counts").alias("k", "n"))


@query("SELECT count(*) AS n_rows FROM events")
def row_count(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count("*").alias("n_rows"))


_HOLES = "holes AS (SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id END AS user_id, CASE WHEN event_id % 11 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS value FROM events)"


def _holes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("user_id"), F.when(F.col("event_id") % 11 == 0, float("nan")).when(F.col("event_id") % 13 != 0, F.col("value")).alias("value"))


@query(f"WITH {_HOLES} SELECT sum((user_id IS NULL)::BIGINT + (value IS NULL OR isnan(value))::BIGINT)::BIGINT AS n_missing FROM holes")
def null_count(spark, sf_dir):
    df = _holes(spark, sf_dir)
    return df.agg(quality.null_count(df).alias("n_missing"))


@query("SELECT sum(n - 1)::BIGINT AS duplicates FROM (SELECT count(*) AS n FROM events GROUP BY user_id, event_type)")
def duplicate_count(spark, sf_dir):
    return quality.duplicate_count(table(spark, sf_dir, "events"), ["user_id", "event_type"])


@query(f"WITH {PLACED}, {_HOLES}, number AS (SELECT value FROM holes WHERE NOT isnan(value)) SELECT (SELECT round_even(min(value), 2) FROM number) AS min_value, (SELECT round_even(max(value), 2) FROM number) AS max_value")
def coord_range(spark, sf_dir):
    return quality.coordinate_range(_holes(spark, sf_dir), ["value"])


@query(f"WITH {PLACED}, p AS (SELECT stratum, {_LATLON} FROM placed) SELECT (SELECT count(*) FROM p) AS n_rows, 0::BIGINT AS n_missing, (SELECT sum(n - 1)::BIGINT FROM (SELECT count(*) AS n FROM p GROUP BY lat, lon)) AS duplicates, round_even(min(lat), 2) AS min_lat, round_even(max(lat), 2) AS max_lat, round_even(min(lon), 2) AS min_lon, round_even(max(lon), 2) AS max_lon FROM p")
def quality_report(spark, sf_dir):
    return quality.report(placed(spark, sf_dir).select("stratum", round6(F.col("lat")).alias("lat"), round6(F.col("lon")).alias("lon")))


_COLOURS = {"1-URGENT": "red", "2-HIGH": "orange", "3-MEDIUM": "green"}
_COLOUR_CASE = "CASE stratum " + " ".join(f"WHEN '{s}' THEN '{c}'" for s, c in _COLOURS.items()) + " ELSE 'gray' END"


@query(f"WITH {PLACED}, p AS (SELECT stratum, {_LATLON} FROM placed) SELECT lat, lon, stratum, {_COLOUR_CASE} AS colour, printf('%s | %.6f, %.6f', stratum, lat, lon) AS popup FROM p")
def map_markers(spark, sf_dir):
    points = placed(spark, sf_dir).select("stratum", round6(F.col("lat")).alias("lat"), round6(F.col("lon")).alias("lon"))
    return sink.marker_rows(points, _COLOURS)


@query("SELECT event_type, round(avg(value), 6) AS mean_value FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-20' GROUP BY event_type")
def window_mean(spark, sf_dir):
    mean = remote.window_mean(table(spark, sf_dir, "events"), "2024-01-05", "2024-01-20", ["event_type"], "value")
    return mean.select("event_type", F.round("mean_value", 6).alias("mean_value"))


_EVENT_LAT, _EVENT_LON = _between(*LAT, _u("lat", "event_id")), _between(*LON, _u("lon", "event_id"))


@query(f"SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7' AND {_EVENT_LAT} BETWEEN 48.5 AND 49.5 AND {_EVENT_LON} BETWEEN -1.0 AND 0.5")
def bbox_tag_filter(spark, sf_dir):
    key = F.col("event_id")
    lat, lon = between(*LAT, uniform("lat", key)), between(*LON, uniform("lon", key))
    return table(spark, sf_dir, "events").where((F.get_json_object("props", "$.k") == "7") & remote.in_box(lat, lon, 48.5, -1.0, 49.5, 0.5)).select("event_id")


@query(f"SELECT event_id AS id, round({_EVENT_LAT}, 6) AS lat, round({_EVENT_LON}, 6) AS lon FROM events WHERE json_extract_string(props, '$.k') = '3' AND {_EVENT_LAT} BETWEEN 48.2 AND 49.9 AND {_EVENT_LON} BETWEEN -1.5 AND 0.9")
def tagged_elements(spark, sf_dir):
    """Replies with the events of a user as their elements, parsed and filtered by tag and box."""
    key = F.col("event_id")
    lat, lon = between(*LAT, uniform("lat", key)), between(*LON, uniform("lon", key))
    element = F.struct(F.lit("node").alias("type"), key.alias("id"), lat.alias("lat"), lon.alias("lon"), F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("tags"))
    replies = table(spark, sf_dir, "events").groupBy("user_id").agg(F.to_json(F.struct(F.collect_list(element).alias("elements"))).alias("body"))
    found = remote.tagged(remote.map_elements(replies), "k", "3", 48.2, -1.5, 49.9, 0.9)
    return found.select("id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("SELECT user_id % 10 AS part, count(*) AS n_elements FROM events GROUP BY 1")
def json_elements_count(spark, sf_dir):
    folded = table(spark, sf_dir, "events").groupBy("user_id").agg(F.to_json(F.struct(F.collect_list(F.struct("event_id")).alias("elements"))).alias("body"))
    return folded.groupBy((F.col("user_id") % 10).alias("part")).agg(F.sum(remote.element_count(F.col("body"))).cast("bigint").alias("n_elements"))


_MANIFEST = ("ALGERIA", "ATLANTIS", "FRANCE", "JAPAN", "LEMURIA")


@query("WITH m(path) AS (VALUES " + ", ".join(f"('{p}')" for p in _MANIFEST) + ") SELECT path, CASE WHEN n_name IS NULL THEN 'missing' ELSE 'found' END AS status FROM m LEFT JOIN nation ON n_name = path")
def manifest_check(spark, sf_dir):
    manifest = spark.createDataFrame([(p,) for p in _MANIFEST], "path string")
    return remote.check_manifest(manifest, table(spark, sf_dir, "nation").select(F.col("n_name").alias("path")))


@query("SELECT count(DISTINCT n_regionkey) AS n, true AS any_bytes FROM nation")
def listing_count(spark, sf_dir):
    """Files of nations by region, one each, as a listing of their folders finds them."""
    path = _own(spark, "nation-by-region")
    sink.save_partitioned(table(spark, sf_dir, "nation").repartition("n_regionkey"), path, "n_regionkey")
    return remote.listing(spark, path, "*.parquet").agg(F.count("*").alias("n"), F.coalesce(F.min("length") > 0, F.lit(True)).alias("any_bytes"))


@query("SELECT page_id, len(list_filter(string_split(regexp_replace(html, '^\\s+|\\s+$', '', 'g'), chr(10)), lambda x: x <> ''))::INTEGER AS n_lines FROM pages")
def listing_split(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.size(remote.listing_lines(F.col("html"))).alias("n_lines"))


@query("SELECT trim(min(url)) AS first_line FROM pages")
def first_listing(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.trim("url").alias("first_line")).orderBy("first_line").limit(1)


@query(f"""WITH {PLACED}, w AS (SELECT ceil(sqrt(count(*) * 1.5::DOUBLE))::BIGINT AS n FROM part),
grid AS (SELECT ((p_partkey - 1) // n)::INTEGER AS px_row, ((p_partkey - 1) % n)::INTEGER AS px_col, p_retailprice AS value FROM part, w),
c AS (SELECT attempt_no, floor((50.0::DOUBLE - lat) / (3.0::DOUBLE / n))::INTEGER AS px_row, floor((lon - -2.0::DOUBLE) / (3.0::DOUBLE / n))::INTEGER AS px_col FROM placed, w)
SELECT attempt_no, px_row, px_col, value FROM c LEFT JOIN grid USING (px_row, px_col)""")
def pixel_lookup(spark, sf_dir):
    """All parts make one raster over the box of the points, half as wide again as high."""
    part, n = table(spark, sf_dir, "part"), F.col("p_partkey") - 1
    width = math.ceil(math.sqrt(part.count() * 1.5))
    grid = part.select(F.floor(n / width).cast("int").alias("px_row"), (n % width).cast("int").alias("px_col"), F.col("p_retailprice").alias("value"))
    return pixels.lookup(placed(spark, sf_dir).select("attempt_no", "lat", "lon"), grid, 50.0, -2.0, 3.0 / width).select("attempt_no", "px_row", "px_col", "value")


@query(f"WITH {PLACED}, t AS (SELECT attempt_no, (floor((lat - 49) / 3) * 3)::INTEGER AS y, (floor(lon / 3) * 3)::INTEGER AS x FROM placed) SELECT attempt_no, printf('ESA_WorldCover_10m_2021_v200_%s%02d%s%03d_Map.tif', CASE WHEN y < 0 THEN 'S' ELSE 'N' END, abs(y), CASE WHEN x < 0 THEN 'W' ELSE 'E' END, abs(x)) AS tile FROM t", "tile_key")
def tile_keys(spark, sf_dir):
    return placed(spark, sf_dir).select("attempt_no", tile_key(F.col("lat") - 49, F.col("lon")).alias("tile"))


@query(f"WITH {PLACED} SELECT attempt_no, stratum, {_LATLON} FROM placed ORDER BY attempt_no LIMIT 10")
def sample_rows(spark, sf_dir):
    return candidates(spark, sf_dir).select("attempt_no", "stratum", "lat", "lon").orderBy("attempt_no").limit(10)


_NOTE = ("NULL", "''", "' a '", "'q\"u,o'", "'N/A'", "n_name")


@query("SELECT n_nationkey, n_name, n_regionkey, CASE n_nationkey % 6 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(_NOTE)) + " END AS note FROM nation")
def csv_roundtrip(spark, sf_dir):
    """Nulls, empty strings, blanks, quotes and commas come back as they were."""
    path = _own(spark, "nation.csv")
    note = F.expr("CASE n_nationkey % 6 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(_NOTE)) + " END")
    sink.save_csv(table(spark, sf_dir, "nation").withColumn("note", note), path, files=1)
    return sink.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int, note string")


@query("SELECT o_orderpriority AS stratum, count(*) AS n FROM orders GROUP BY 1")
def partitioned_sink(spark, sf_dir):
    path = _own(spark, "by-stratum")
    sink.save_partitioned(placed(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("stratum").agg(F.count("*").alias("n"))


_RULES_SQL = {"agricultural": "user_id % 3 / 2 > 0.5 AND value / 100 > 0.6", "forest": "value / 100 > 0.6 AND (event_id % 10) / 10 < 0.3", "coastal": "user_id % 40 < 10 AND event_id % 5 / 4 < 0.5", "arid": "user_id % 1000 < 250", "alpine": "event_id % 3000 > 1500", "informal_settlements": "(user_id % 10) / 10 > 0.7 AND (event_id % 10) / 10 < 0.3", "water_wetland": "event_id % 5 / 4 > 0.5"}


@query("SELECT event_id, " + ", ".join(f"{v} AS {k}" for k, v in _RULES_SQL.items()) + " FROM events", "stratum_rules")
def stratum_rule_flags(spark, sf_dir):
    event, user = F.col("event_id"), F.col("user_id")
    rules = stratum_rules(F.col("value") / 100, (event % 10) / 10, (user % 10) / 10, user % 3 / 2, user % 40, user % 1000, event % 3000, event % 5 / 4)
    return table(spark, sf_dir, "events").select("event_id", *[c.alias(n) for n, c in rules.items()])


@query(f"WITH {PLACED} SELECT attempt_no, printf('A %s site at %.6f, %.6f.', replace(stratum, '_', ' '), round_even(lat, 6), round_even(lon, 6)) AS caption, CASE WHEN lat < 48.5 THEN 'south' WHEN lat < 49.5 THEN 'middle' ELSE 'north' END AS label FROM placed")
def captions(spark, sf_dir):
    lat, lon = F.col("lat"), F.col("lon")
    return placed(spark, sf_dir).select("attempt_no", template_caption(F.col("stratum"), round6(lat), round6(lon)).alias("caption"), label(lat, [(48.5, "south"), (49.5, "middle")], "north").alias("label"))
