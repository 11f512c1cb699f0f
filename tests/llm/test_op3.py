import random
import re
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from oracle import assert_same

from tessera.llm import op3_jaccard as m
from tessera.llm._graph import components

SCHEMA = "doc_id long, text string, node string, label string"


def brute(rows, n, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in (t or "")))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if sets[i] and d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return sorted(str((d, len(s), ids.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def ours(spark, rows, n, percent):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return sorted(str(tuple(r)) for r in m.jaccard_components(df, n, percent).collect())


def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    assert_same(m.op3_jaccard(spark, sf_dir), m.SQL, sf_dir)


@pytest.mark.parametrize("percent,n,blocks", [(85, 4, 512), (80, 5, 3)])
def test_families_of_near_copies_equal_brute_force(spark, monkeypatch, percent, n, blocks):
    monkeypatch.setattr(m, "BLOCK_SETS", blocks)
    rng = random.Random(percent)
    rows = []
    for _ in range(6):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 6, 9, 20, 60, 150]))]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randrange(max(1, len(w) // 12) + 1)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(300)}"
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    assert ours(spark, rows, n, percent) == brute(rows, n, percent)


def test_edges(spark):
    rows = [(9, None), (8, ""), (7, "a"), (3, "A"), (None, "a"), (None, "only here and nowhere else"), (5, "b c"), (5, "b c"), (1, "z " * 100000), (2, "z z z z"), (6, " \t")]
    got = ours(spark, rows, 4, 85)
    assert got == sorted(map(str, [(9, 0, 9), (8, 0, 8), (7, 1, 3), (3, 1, 3), (None, 1, 3), (None, 2, None), (5, 1, 5), (5, 1, 5), (1, 1, 1), (2, 1, 1), (6, 0, 6)]))
    assert m.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_sets_over_the_threshold_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 64, rng.integers(1, 120), dtype=np.uint64))
        i = int(rng.integers(0, len(a) + 1))
        extra = rng.integers(0, 1 << 64, int(rng.integers(0, len(a) // 5 + 1)), dtype=np.uint64)
        b = np.unique(np.concatenate([a[len(a) - i :], extra]))
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < percent * (len(a) + len(b) - both):
            continue
        sigs, rows = m.signatures(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), np.array([len(a), len(b)]), percent)
        assert set(sigs[rows == 0]) & set(sigs[rows == 1])


def test_partial_counts_sum_up(monkeypatch):
    monkeypatch.setattr(m, "DENSE_CELLS", 640)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 500, 200)).astype(np.uint64) for _ in range(12)]
    got = m.overlaps(np.concatenate(sets), np.repeat(np.arange(12), [len(s) for s in sets]), 12)
    want = [[0 if i == j else len(np.intersect1d(a, b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    assert got.tolist() == want
    across = m.overlaps(np.concatenate(sets), np.repeat(np.arange(12), [len(s) for s in sets]), 12, 5)
    assert across.tolist() == [row[5:] for row in want[:5]]


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 100), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_linked_sets_meet_often_enough(percent):
    rng = np.random.default_rng(percent + 1)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 64, rng.integers(1, 150), dtype=np.uint64))
        i = int(rng.integers(len(a) * percent // 100, len(a) + 1))
        extra = rng.integers(0, 1 << 64, int(rng.integers(0, len(a) // 8 + 1)), dtype=np.uint64)
        b = np.unique(np.concatenate([a[len(a) - i :], extra]))
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < percent * (len(a) + len(b) - both):
            continue
        grams, owners, sizes = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), np.array([len(a), len(b)])
        sigs, rows = m.signatures(grams, owners, sizes, percent)
        own, below = m.empty_segments(grams, owners, sizes, percent)
        shared = np.array(sorted(set(sigs[rows == 0]) & set(sigs[rows == 1])))
        ok = [m.enough_meetings((sizes[:1], sizes[1:]), (own[:1], below[:1], own[1:], below[1:]), np.array([odd]), np.array([int((shared & 1 == odd).sum())]), percent)[0] for odd in (0, 1)]
        assert any(ok)
        for x in (0, 1):
            even, odd = ([int((shared & 1 == k).sum())] for k in (0, 1))
            assert m.can_link(sizes[x : x + 1], own[x : x + 1], below[x : x + 1], np.array(even), np.array(odd), percent)[0]


def test_meetings_cut_by_batches(spark, monkeypatch):
    monkeypatch.setattr(m, "SMALL_MEETING", 4)
    rows = [(i, f"one two three four five {'x' if i % 2 else 'y'} " + f"tail{i} " * (i % 3)) for i in range(40)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert ours(spark, rows, 2, 50) == brute(rows, 2, 50)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("ids", ["null", "repeated", "shared"])
def test_sets_that_several_tasks_put_out_count_once(spark, ids):
    # Two of some 20 shingles differ: too few are equal for a link, but enough for a candidate.
    texts = [" ".join([*(f"f{size}w{i}" for i in range(size)), f"v{v}", "end"]) for size in range(14, 32) for v in range(4)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows = {"null": rows + [(None, t) for t in texts * 3], "repeated": rows * 4, "shared": [(i // 3, t) for i, t in rows * 4]}[ids]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert sorted(str(tuple(r)) for r in m.jaccard_components(df, 4, 85).collect()) == brute(rows, 4, 85)


def test_no_shuffle_file_outlives_its_action(spark):
    folders = [f.getPath() for f in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()]
    files = lambda: {p.name for f in folders for p in Path(f).glob("*/shuffle_*")}
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, own = files(), spark.conf.get(setting, None)
    text = " ".join(f"w{i}" for i in range(40))
    out = m.jaccard_components(spark.createDataFrame([(i, f"{text} {i % 3}") for i in range(20)], "doc_id long, text string"))
    for _ in range(50):  # files go a little later
        if not (left := files() - before):
            break
        time.sleep(0.2)
    assert not left and spark.conf.get(setting, None) == own
    assert {r.component_id for r in out.collect()} == {0}


def test_chains_of_candidates_are_counted_pair_by_pair(spark, monkeypatch):
    """Sets that resemble their neighbours only: one candidate group, whose pairs aren't all counted."""
    held, blocks, pairs = [], m._crowd_links, m._pair_links
    monkeypatch.setattr(m, "_crowd_links", lambda segments, settled, percent: (held.append(settled.count()), blocks(segments, settled, percent))[1])
    monkeypatch.setattr(m, "_pair_links", lambda segments, asked, percent: (held.append(asked.count()), pairs(segments, asked, percent))[1])
    words = [f"w{i}" for i in range(40 * 12 + 100)]
    rows = [(i, " ".join(words[i * 12 : i * 12 + 100])) for i in range(40)]  # 85 of 109 shingles are shared with the next one
    rows += [(100 + i, f"{rows[i * 5][1]} end{i}") for i in range(8)]
    assert ours(spark, rows, 4, 85) == brute(rows, 4, 85)
    assert held[0] < 4 * len(rows) and held[1] == 0
    held.clear()
    crowd = [(i, " ".join([*words[:60], *(f"v{i}x{j}" for j in range(9 if i % 2 else 1))])) for i in range(60)]
    assert ours(spark, crowd, 4, 85) == brute(crowd, 4, 85)
    assert held[1] > 0


def test_copies_send_one_set_of_signatures(spark):
    text = lambda i: " ".join(f"t{i}w{j}" for j in range(40))
    rows = [(i, text(i % 5)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(20)
    sent, segments = [], m._segments
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(m, "_segments", lambda *a: (out := segments(*a), sent.append(out.groupBy("node").count().agg({"count": "max"}).first()[0]))[0])
        got = m.jaccard_components(docs, 4, 85)
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(i, i % 5) for i, _ in rows}
    one = m.signatures(*m.shingle_sets(pa.array([text(0)]), 4), np.array([37]), 85)[0]
    assert sent[0] == len(one)
