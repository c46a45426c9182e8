"""Constrained stratified sampling, exactly as a loop over draws would do it, by parallel rounds.

A stratum takes its candidates in draw order: on land, and no taken point of any stratum under the spacing away. In
one batch of draws that is the first maximal independent set of the conflict graph in draw order: who has no earlier
neighbour left is taken, who has a taken earlier neighbour is out, until few are undecided (Blelloch, Fineman and Shun,
2012); those few, of a fixed number at most, are decided in order by one task. The quota's cut comes after it, for taking depends on earlier draws alone. Strata follow each other, since a cut
changes what blocks the next one. A batch takes as many draws as the last one's yield asks for, each round is written to
the shared folder, and what has been taken so far is read back as one table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafield.functions.geo import bounding_box, round6
from stratafield.operators.spacing import away_from, conflicts
from stratafield.session import materialize, read_written
from stratafield.sources.points import POINT_SCHEMA


#: Edges (earlier, later) that one task decides in order, 16 bytes each; beyond that, all tasks decide in rounds.
FEW_EDGES = 20_000
#: Places of a quota up to which the first rows are found by one task's merge; beyond that, rows are numbered by ranges.
FEW_PLACES = 100_000


def _refuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges in one task: who is refused, in order of the later point."""
    earlier: dict[int, list[int]] = defaultdict(list)
    for batch in batches:
        for e, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            earlier[k].append(e)
    out: set[int] = set()
    for k in sorted(earlier):
        if any(e not in out for e in earlier[k]):
            out.add(k)
    yield pa.RecordBatch.from_arrays([pa.array(sorted(out), pa.int64())], names=["later"])


def first_independent(points: DataFrame, edges: DataFrame, key: str, few: int = FEW_EDGES) -> DataFrame:
    """Points of the first maximal independent set; edges are (earlier, later), of long keys."""
    edges = materialize(edges.select("earlier", "later"), "conflicts")
    out: list[DataFrame] = []
    while (left := edges.count()) > few:
        taken = edges.select(F.col("earlier").alias("k")).join(edges.select(F.col("later").alias("k")), "k", "left_anti").distinct()
        refused = materialize(edges.join(taken.withColumnRenamed("k", "earlier"), "earlier", "left_semi").select("later").distinct(), "refused")
        out.append(refused)
        edges = edges.join(refused, "later", "left_anti").join(refused.withColumnRenamed("later", "earlier"), "earlier", "left_anti")
        edges = materialize(edges, "undecided")
    if left:
        out.append(edges.repartition(1).mapInArrow(_refuse, "later long"))
    for refused in out:
        points = points.join(refused.withColumnRenamed("later", key), key, "left_anti")
    return points


def first_rows(df: DataFrame, order: str, n: int, few: int | None = None) -> DataFrame:
    """The first n rows in order of a column."""
    if n <= (FEW_PLACES if few is None else few):
        return df.orderBy(order).limit(n)
    return assign_ids(df, [order], "__place").where(F.col("__place") <= n).drop("__place")


def fill_stratum(draw: Callable[[int, int], DataFrame], quota: int, accepted: DataFrame, spacing_km: float, on_land: Callable[[DataFrame], DataFrame] | None = None, attempts: int | None = None, per_place: float = 8.0) -> tuple[list[DataFrame], int, int]:
    """(tables of taken points, how many, of how many draws). draw(first, past): candidates (attempt_no, lat, lon) of those attempts; accepted: rounded lat and lon.

    per_place: draws of the first batch for each place of the quota.
    """
    attempts = quota * 150 if attempts is None else attempts
    have, first, step = 0, 0, max(1024, int(per_place * quota))
    taken: list[DataFrame] = []
    while have < quota and first < attempts:
        past = min(attempts, first + step)
        points = draw(first, past)
        if on_land:
            points = on_land(points)
        before = accepted
        if taken:
            before = accepted.unionByName(read_written(taken).select(round6(F.col("lat")).alias("lat"), round6(F.col("lon")).alias("lon")))
        points = materialize(away_from(points, before, spacing_km), "free")
        chosen = first_independent(points, conflicts(points, "attempt_no", spacing_km), "attempt_no")
        taken.append(materialize(first_rows(chosen, "attempt_no", quota - have), "taken"))
        have += taken[-1].count()
        first = past
        # Half as many again as the yield so far asks for, and four times the last batch at most.
        step = min(4 * step, max(256, int(1.5 * (quota - have) * past / have) if have else 4 * step))
    return taken, have, first


def sample(draws: list[tuple[str, int, Callable[[int, int], DataFrame]]], empty: DataFrame, spacing_km: float = 1.0, on_land=None, attempts_per_point: int = 150, bbox_size_m: float = 256.0, attempts: dict[str, int] | None = None, log=None) -> DataFrame:
    """The table of points, ids 1..n in stratum and draw order. draws: (stratum, quota, draw) in the order of filling.

    A stratum that cannot be filled is reported to `log` and the next one goes on. `empty` is any frame with lat and lon
    whose points block all strata (none, usually).
    """
    blocked, tables, parts = empty.select("lat", "lon"), [], []
    places = drawn = 0
    for order, (stratum, quota, draw) in enumerate(draws):
        limit = attempts[stratum] if attempts else quota * attempts_per_point
        accepted = blocked
        if tables:
            accepted = blocked.unionByName(read_written(tables).select(round6(F.col("lat")).alias("lat"), round6(F.col("lon")).alias("lon")))
        yielded = {"per_place": 1.5 * drawn / places} if places else {}  # what the strata so far took
        taken, have, tries = fill_stratum(draw, quota, accepted, spacing_km, on_land, limit, **yielded)
        places, drawn = places + have, drawn + tries
        if log:
            (log.warning if have < quota else log.info)(f"{stratum}: {have}/{quota} points")
        if taken:
            tables += taken
            parts.append(read_written(taken).select(F.lit(order).alias("stratum_ord"), F.lit(stratum).alias("stratum"), "attempt_no", "lat", "lon"))
    spark = empty.sparkSession
    if not parts:
        return spark.createDataFrame([], POINT_SCHEMA)
    points = parts[0]
    for p in parts[1:]:
        points = points.unionByName(p)
    return shape(assign_ids(points, ["stratum_ord", "attempt_no"]), bbox_size_m)


def shape(points: DataFrame, bbox_size_m: float = 256.0) -> DataFrame:
    """id, rounded lat and lon, stratum, and the rounded box around the unrounded point."""
    box = bounding_box(F.col("lat"), F.col("lon"), bbox_size_m)
    return points.select("id", round6(F.col("lat")).alias("lat"), round6(F.col("lon")).alias("lon"), "stratum", *[round6(c).alias(n) for n, c in box.items()])


def assign_ids(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """Numbers 1..n in the order of `order`: a place in each range of rows, plus the sizes of the ranges before.

    Rows are dealt out by ranges, so no group of them meets in one task; only the ranges' counts do.
    """
    from pyspark.sql import Window

    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    spread = materialize(spread, "ranges").withColumn("__range", F.shiftright("__m", 33))
    counts = spread.groupBy("__range").agg(F.count("*").alias("__n"))
    before = counts.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    return spread.join(before, "__range").withColumn(name, (place + F.col("__before") + 1).cast("bigint")).drop("__m", "__range", "__before")
