import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import latency

NAMES = ["total_samples", "successful_samples", "failed_samples", "mean_ms", "min_ms", "max_ms", "p50_ms", "p95_ms", "p99_ms"]


def by_hand(values, always=False):
    good = [v for v, ok in values if ok and v is not None and np.isfinite(v)]
    row = [len(values), len(good), len(values) - len(good)]
    if not good:
        return [*row, *[None] * 6]
    p = [float(np.percentile(good, q)) for q in (50, 95, 99)]
    return [*row, float(np.mean(good)), min(good), max(good), p[0], p[1], p[2] if always or len(good) >= 1000 else None]


def close(got, want):
    return all((a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-9, abs=2e-6)) for a, b in zip(got, want, strict=True))


def test_golden(spark):
    rows = spark.createDataFrame([(10.0, True), (20.0, False), (30.0, True)], "latency_ms double, success boolean")
    r = latency.latency_table(rows, []).first()
    assert [r[n] for n in NAMES] == [3, 2, 1, 20.0, 10.0, 30.0, 20.0, 29.0, None]
    four = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "v double")
    assert latency.exact_percentiles(four, [], "v", [0.5, 0.95]).first() == pytest.approx((2.5, 3.85))
    with pytest.raises(ValueError):
        latency.exact_percentiles(four, [], "v", [1.5])
    assert latency.exact_percentiles(four.limit(0), [], "v", [0.5]).count() == 0 and latency.latency_table(rows.limit(0), []).count() == 0


@pytest.mark.parametrize("broadcast_rows", [50_000, 0])
def test_groups_of_all_kinds_equal_numpy(spark, monkeypatch, broadcast_rows):
    """Few ranges and short lists, so that ranges are counted again and again; with and without a broadcast of the ranges."""
    for name, value in (("RANGES", 4), ("FEW", 3), ("BROADCAST_ROWS", broadcast_rows)):
        monkeypatch.setattr(latency, name, value)
    rng = random.Random(7)
    groups = {
        "even": [rng.uniform(0, 1000) for _ in range(300)], "steep": [10.0 ** rng.uniform(-12, 12) for _ in range(200)], "ties": [rng.choice([1.0, 2.0, 2.0, 5.0]) for _ in range(400)],
        "one": [3.5], "same": [7.0] * 50, "signs": [rng.gauss(0, 1) for _ in range(100)] + [0.0, -0.0], None: [1.0, 2.0], "bad": [None, float("nan"), float("inf")],
        "far": [-1.7e308, 1.7e308, 0.0, 5e-324, 1e-300], "long": [float(x) for x in range(1200)],
    }
    rows = [(g, i % 2, v, rng.random() < 0.9) for g, vs in groups.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "g string, h int, latency_ms double, success boolean").repartition(5)
    got = {r.g: [r[n] for n in NAMES] for r in latency.latency_table(df, ["g"]).where("NOT g <=> 'far'").collect()}
    want = {g: by_hand([(v, ok) for k, _, v, ok in rows if k == g]) for g in groups if g != "far"}
    assert set(got) == set(want) and all(close(got[g], want[g]) for g in want)
    far = latency.exact_percentiles(df.where("g = 'far'"), ["g"], "latency_ms", [0.0, 0.25, 0.5, 1.0]).first()
    assert far == ("far", -1.7e308, 0.0, 5e-324, 1.7e308)


def test_grouping_sets(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(3), rng.uniform(0, 9), rng.random() < 0.8) for _ in range(500)]
    df = spark.createDataFrame(rows, "model string, round int, latency_ms double, success boolean")
    got = latency.latency_table(df, ["model", "round"], always_p99=True, sets=[["model"], ["round"], []]).collect()
    want = [(m, None, [r for r in rows if r[0] == m]) for m in ("a", "b", None)] + [(None, n, [r for r in rows if r[1] == n]) for n in range(3)] + [(None, None, rows)]
    assert len(got) == len(want)
    for model, n, own in want:
        assert any((r.model, r.round) == (model, n) and close([r[x] for x in NAMES], by_hand([(v, ok) for *_, v, ok in own], True)) for r in got)


def test_one_group_of_many_distinct_samples(spark):
    """What meets in one task is RANGES counts or FEW values, never the group."""
    n = 3_000_000
    df = spark.range(n).select((F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / 1024.0).alias("v"))
    want = np.percentile(np.array(df.toPandas().v), [0, 50, 95, 99, 100])
    assert latency.exact_percentiles(df, [], "v", [0.0, 0.5, 0.95, 0.99, 1.0]).first() == pytest.approx(tuple(want), rel=1e-12)
