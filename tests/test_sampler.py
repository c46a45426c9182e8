import math
import random

import pytest
from pyspark.sql import functions as F

from stratafield.operators import sampler
from stratafield.operators.sampler import sample
from stratafield.plans.pipeline import generate_points, summary
from stratafield.sources.catalogue import SamplingParameters, strata_frame


def too_close(lat, lon, accepted, spacing):
    return any(math.hypot((lat - a) * 111.32, (lon - o) * 111.32 * math.cos(math.radians(lat))) < spacing for a, o in accepted)


def loop(draws, spacing, on_land):
    """One draw after the other."""
    accepted, out = [], []
    for name, quota, points in draws:
        n = 0
        for lat, lon in points:
            if n == quota:
                break
            if not too_close(lat, lon, accepted, spacing) and on_land(lat, lon):
                accepted.append((round(lat, 6), round(lon, 6)))
                out.append((len(out) + 1, round(lat, 6), round(lon, 6), name))
                n += 1
    return out


@pytest.mark.parametrize("seed,few", [(0, 0), (1, 0), (1, 200_000), (2, 5)])
def test_equals_the_loop(spark, seed, few, monkeypatch):
    monkeypatch.setattr(sampler.first_independent, "__defaults__", (few,))
    rng = random.Random(seed)
    draws = []
    for k in range(3):
        n = rng.choice([0, 60, 150])
        draws.append((f"s{k}", rng.choice([0, 10, 40]), [(rng.uniform(48, 48.15), rng.uniform(2, 2.2)) for _ in range(n)]))
    frames = []
    for name, quota, points in draws:
        df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "attempt_no long, lat double, lon double")
        frames.append((name, quota, lambda a, z, df=df: df.where((F.col("attempt_no") >= a) & (F.col("attempt_no") < z))))
    empty = spark.createDataFrame([], "lat double, lon double")
    got = sample(frames, empty, 1.0, lambda df: df.where("lat < 48.12"), attempts={n: len(p) for n, _, p in draws})
    rows = [(r.id, r.lat, r.lon, r.stratum) for r in got.orderBy("id").collect()]
    assert rows == loop(draws, 1.0, lambda lat, lon: lat < 48.12)


def test_whole_pipeline_is_repeatable_and_keeps_its_rules(spark):
    p = SamplingParameters({"a": 12, "b": 8}, seed=5)
    regions = {"a": [(10.0, 10.2, 20.0, 20.2)], "b": [(10.1, 10.3, 20.1, 20.3), (-5.0, -4.9, 0.0, 0.1)]}
    first = generate_points(spark, p, regions)
    rows = first.orderBy("id").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    assert rows == generate_points(spark, p, regions).orderBy("id").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [r.id for r in rows] == list(range(1, 21))
    for i, r in enumerate(rows):
        assert not too_close(r.lat, r.lon, [(x.lat, x.lon) for x in rows[:i]], 0.999)
        assert any(a - 1e-6 <= r.lat <= b + 1e-6 and c - 1e-6 <= r.lon <= d + 1e-6 for a, b, c, d in regions[r.stratum])
    s = summary(first, strata_frame(spark, p.quotas.items()))
    assert s["total"] == 20 and s["per_stratum"] == {"a": 12, "b": 8} and len(s["sample"]) == 10


def test_spacing_holds_at_the_pole(spark):
    """Points that all longitudes bring together near the pole."""
    rows = generate_points(spark, SamplingParameters({"cap": 40}, seed=2), {"cap": [(89.85, 90.0, -180.0, 180.0)]}).orderBy("id").collect()
    assert len(rows) > 5
    for i, r in enumerate(rows):
        assert not too_close(r.lat, r.lon, [(x.lat, x.lon) for x in rows[:i]], 0.999)


@pytest.mark.parametrize("n", [0, 3, 50, 200])
def test_first_rows_by_merge_and_by_ranges(spark, n):
    rng = random.Random(n)
    df = spark.createDataFrame([(k,) for k in rng.sample(range(1000), 100)], "attempt_no long").repartition(5)
    want = sorted(r.attempt_no for r in df.collect())[:n]
    for few in (0, 10**6):
        assert sorted(r.attempt_no for r in sampler.first_rows(df, "attempt_no", n, few).collect()) == want


def test_short_stratum_and_no_strata(spark):
    p = SamplingParameters({"tiny": 50}, attempts_per_point=2)
    assert 0 < generate_points(spark, p, {"tiny": [(0.0, 0.01, 0.0, 0.01)]}).count() < 50
    none = generate_points(spark, SamplingParameters({}), {})
    assert none.count() == 0 and none.columns[0] == "id"
