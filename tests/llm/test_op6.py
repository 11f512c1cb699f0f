import hashlib
import random

import pytest
from oracle import assert_same

from tessera.llm import op6_substrings as m

SCHEMA = "doc_id long, text string, th string, key string"


def brute(rows, window):
    first = {}
    split = [(t or "").encode().split() for _, t in rows]
    for (d, _), w in zip(rows, split, strict=True):
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if d is not None:
                first[k] = min(d, first.get(k, d))
    out = []
    for (d, _), w in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append(str((d, len(w), len(gone), hashlib.sha256(kept).hexdigest())))
    return sorted(out)


def ours(spark, rows, window):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return sorted(str(tuple(r)) for r in m.remove_substrings(df, window, texts=False).collect())


def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    assert_same(m.op6_substrings(spark, sf_dir), m.SQL, sf_dir)


@pytest.mark.parametrize("window,piece,shard,frequent", [(50, 8192, 100_000, 1000), (12, 16, 40, 1000), (12, 8192, 1000, 3)])
def test_equals_brute_force(spark, monkeypatch, window, piece, shard, frequent):
    monkeypatch.setattr(m, "FREQUENT", frequent)
    monkeypatch.setattr("tessera.llm._shared.HOT_ROWS", frequent)
    monkeypatch.setattr(m, "PIECE", piece)
    monkeypatch.setattr(m, "SHARD_WORDS", shard)
    monkeypatch.setattr(m, "STREAM_WORDS", 5 * shard)
    rng = random.Random(window)
    passages = [[f"p{rng.randrange(30)}" for _ in range(rng.randrange(window - 3, 3 * window))] for _ in range(8)]
    rows = []
    for d in range(60):
        w = []
        for _ in range(rng.randrange(1, 5)):
            w += [f"r{rng.randrange(1000)}" for _ in range(rng.randrange(0, window))]
            p = rng.choice(passages)
            lo = rng.randrange(len(p) // 3)
            w += p[lo : len(p) - rng.randrange(len(p) // 3)]
        rows.append((d * 3 - 20, " ".join(w)))
    rows += [(500, rows[3][1]), (500, rows[3][1]), (501, "a b " * 200), (2, "other text"), (None, rows[0][1])]
    rng.shuffle(rows)
    assert ours(spark, rows, window) == brute(rows, window)


def test_edges(spark):
    assert m.remove_substrings(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, None), (2, ""), (3, " é\x1c x\t\n y"), (None, None), (4, "w " * 60), (5, "w " * 49), (6, "w " * 100000), (None, "w " * 60)]
    assert ours(spark, rows, 50) == brute(rows, 50)


def test_automaton_knows_the_smallest_owner():
    rng = random.Random(5)
    seqs = {d: [b"%d" % rng.randrange(3) for _ in range(60)] for d in (9, 4, 7)}
    a = m.SuffixAutomaton(6)
    for d, w in seqs.items():
        a.add(w, d)
    a.finish()
    probe = [b"%d" % rng.randrange(3) for _ in range(400)]
    for owner in (4, 5, 8, 10):
        have = {tuple(w[i : i + 6]) for d, w in seqs.items() if d < owner for i in range(55)}
        want = {j for i in range(395) if tuple(probe[i : i + 6]) in have for j in range(i, i + 6)}
        assert {j for x, y in a.spans(probe, owner) for j in range(x, y)} == want
