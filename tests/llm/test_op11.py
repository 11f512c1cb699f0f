import math
import random
from collections import Counter

import numpy as np
import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from tessera.llm import op11_negatives as m

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def by_hand(rows, k=5):
    """The contract over (id, label, vector) rows, pair by pair."""
    live = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if label is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    last = lambda i: (i is None, i or 0)
    for n, (i, label, v) in enumerate(live):
        if i is None or i % 100:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), j, own == label) for p, (j, own, w) in enumerate(live) if p != n and len(w) == len(v)]
        scored.sort(key=lambda s: (-s[0], last(s[1])))
        for score, j, _ in [s for s in scored if s[2]][:k]:
            fits = [s for s in scored if not s[2] and 80 * score <= 100 * s[0] <= 100 * score][:k]
            out += [(i, j, rank, s[1], score, s[0]) for rank, s in enumerate(fits, 1)]
    return Counter(out)


def found(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in (("ROW_BLOCK", 97), ("ANCHOR_BLOCK", 20), ("STRIP", 3)):
        monkeypatch.setattr(m, name, value)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_query_equals_sql(spark, folder):
    assert_same(m.op11_negatives(spark, f"/root/testdata/{folder}"), m.SQL, f"/root/testdata/{folder}")


def test_query_in_small_blocks_equals_sql(spark, sf_dir, small_blocks, monkeypatch):
    monkeypatch.setattr(m, "ANCHOR_BLOCK", 2)
    assert_same(m.op11_negatives(spark, sf_dir), m.SQL, sf_dir)


def test_nulls_ties_repeats_dimensions_and_other_columns(spark, small_blocks):
    rng = random.Random(3)
    rows = []
    for n in range(400):
        v = [rng.choice([0.1, 0.25, -0.5, 1.0]) for _ in range(rng.choice([1, 5, 5, 5, 40]))]
        rows.append((rng.choice([None, 0, 100, 200, n]), rng.choice([None, 0, 1, 1, 1, 2]), v))
    rows += [(300, 1, None), (300, 1, [None, 1.0]), (300, 1, [math.nan] * 5), (300, 1, [math.inf] * 5), (300, 1, []), (400, 9, [0.5] * 5)] + [(500, 3, [0.5] * 5)] * 30
    made = spark.createDataFrame([(*r, "x", 1) for r in rows], "id long, label int, vector array<float>, row string, rank int")
    single = [(i, label, v and [None if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows]
    assert found(m.hard_negatives(made, F.col("id") % 100 == 0)) == by_hand(single)
    assert m.hard_negatives(made.limit(0), F.col("id") % 100 == 0).count() == 0


def test_large_components_are_exact(spark):
    rng = random.Random(4)
    rows = [(n * 50, n % 3, [float(rng.randrange(-(1 << 21), 1 << 21)) for _ in range(6)]) for n in range(60)]
    made = spark.createDataFrame(rows, "id long, label int, vector array<double>")
    assert found(m.hard_negatives(made, F.col("id") % 100 == 0)) == by_hand(rows)


def test_segment_bounds_hold_and_open_pairs_become_fewer():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 40, (6, 64)) + np.repeat(rng.normal(0, 60, (6, 16)), 4, axis=1)
    v = np.floor(centres[rng.integers(0, 6, 500)] + rng.normal(0, 5, (500, 64))).astype(np.int64)
    levels = np.concatenate([x for n in m.lengths() for x in m.summaries(v.astype(float), n)], axis=1).astype(np.float32)
    block = m.Block(64, list(range(500)), list(range(500)), [0] * 500, v.tobytes(), levels.tobytes())
    exact, widths = v @ v.T, []
    for level in range(len(block.levels)):
        low, high = m._bounds(block, block, level)
        assert (low <= exact).all() and (exact <= high).all()
        widths.append((high - low).mean())
    assert widths == sorted(widths, reverse=True) and widths[-1] < widths[0]
    every = np.full((1, 500), 1 << 40)
    scored = {}
    for share in (0.0, 0.5):  # by matrix products alone, then pair by pair where the summaries leave few open
        m.SPARSE = share
        _, _, s = next(m._above(block, block, ~np.eye(500, dtype=bool), -every, every, 5))
        scored[share] = np.sort(s.reshape(500, 5), axis=1)
    m.SPARSE = 0.02
    assert (scored[0.0] == scored[0.5]).all()
    assert (scored[0.0] == np.sort(np.where(np.eye(500, dtype=bool), -(1 << 40), exact), axis=1)[:, -5:]).all()
