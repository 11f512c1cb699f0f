"""Query sets beyond the bound of a broadcast give the same results, from one scan of the corpus."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import blocks, evaluation, retrieval


@pytest.fixture(params=["broadcast", "blocks"])
def bounds(request, monkeypatch):
    if request.param == "blocks":
        for name, value in (("QUERY_BLOCK_BYTES", 64), ("TERM_BLOCK_CHARS", 12), ("FACTOR_CELLS", 12)):
            monkeypatch.setattr(retrieval, name, value)
        monkeypatch.setattr(evaluation, "FACTOR_CELLS", 12)
        monkeypatch.setattr(blocks, "BLOCK_ROWS", 7)
    return request.param


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def texts(seed, n):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "epsilon", "zeta"], k=rng.randrange(9))) if i % 9 else None) for i in range(n)]


def test_vectors(spark, bounds):
    rng = random.Random(1)
    vector = lambda: [float(rng.randrange(-4, 5)) for _ in range(4)]
    corpus, asked = [(i, vector(), "ab"[i % 2]) for i in range(90)], [(i, vector(), rng.choice(["a", "b", None])) for i in range(40)]
    c, q = spark.createDataFrame(corpus, "id int, vector array<float>, p string"), spark.createDataFrame(asked, "query_id int, vector array<float>, p string")
    want = []
    for i, v, p in asked:
        scored = sorted((round(sum((a - b) ** 2 for a, b in zip(v, w)), 6), j) for j, w, own in corpus if own == p)
        want += [(i, j, s, n) for n, (s, j) in enumerate(scored[:3], 1)]
    assert rows_of(retrieval.vector_search(q, c, 3, "l2", profile="p").select("query_id", "id", "score", "rank")) == sorted(want, key=str)
    assert retrieval.vector_search(q.limit(0), c, 3).count() == 0 and retrieval.vector_search(q, c.limit(0), 3).count() == 0


def test_terms(spark, bounds):
    corpus, asked = spark.createDataFrame(texts(2, 60), "id int, text string"), spark.createDataFrame(texts(3, 30), "query_id int, text string")
    counts = {r.term: tuple(r)[1:] for r in retrieval.corpus_counts(retrieval.query_term_rows(asked, retrieval.segments), corpus).collect()}
    own = [t for _, t in texts(2, 60) if t is not None]
    assert counts[None] == (60, len(own), sum(map(len, own)))
    assert {t: c[0] for t, c in counts.items() if t} == {t: sum(t in x for x in own) for t in ("alpha", "beta", "gamma", "delta", "epsilon", "zeta")}
    lexical = retrieval.lexical_search(asked, corpus, 4)
    want = []
    for i, t in texts(3, 30):
        terms = {r.term for r in retrieval.query_term_rows(asked.where(f"query_id = {i}")).collect()} if i < 4 else None
        if terms is not None:
            scored = sorted((-float(sum((x or "").count(w) for w in terms)), j) for j, x in texts(2, 60))
            want += [(i, j, -s, n) for n, (s, j) in enumerate([p for p in scored if p[0] < 0][:4], 1)]
    assert rows_of(lexical.where("query_id < 4").select("query_id", "id", "score", "rank")) == sorted(want, key=str)


def test_bm25_and_rules_are_the_same_either_way(spark, monkeypatch):
    corpus, asked = spark.createDataFrame(texts(4, 80), "id int, text string"), spark.createDataFrame(texts(5, 25), "query_id int, text string")
    rules = asked.select("query_id", F.slice(F.split("text", " "), 1, 1).alias("must_contain"), F.slice(F.split("text", " "), 2, 2).alias("any_of"))
    run = lambda: (rows_of(retrieval.bm25_search(asked, corpus, 3)), rows_of(evaluation.total_relevant(rules, corpus)), rows_of(retrieval.analyze_queries(asked, corpus)))
    first = run()
    for module in (retrieval, evaluation):
        monkeypatch.setattr(module, "FACTOR_CELLS", 10)
    monkeypatch.setattr(retrieval, "TERM_BLOCK_CHARS", 10)
    assert run() == first and all(first)


def test_ten_blocks_scan_the_corpus_once(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 10)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK_BYTES", 64)
    spark.range(1000).select(F.col("id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("vector")).write.parquet(f"{tmp_path}/corpus")
    corpus = spark.read.parquet(f"{tmp_path}/corpus")
    queries = spark.range(100).select(F.col("id").alias("query_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("vector"))
    found = retrieval.vector_search(queries, corpus, 1, "l2")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 2  # a plan may be shown twice
    assert rows_of(found.select("query_id", "id")) == sorted(((i, i) for i in range(100)), key=str)


@pytest.mark.parametrize("metric", ["cosine", "clamped", "l2"])
def test_best_vectors_of_many_equal_a_full_sort(metric):
    rng = np.random.default_rng(5)
    v = rng.integers(-3, 4, (3000, 5)).astype(float)
    v[::50] = 0
    v[1::3] = v[0:-2:3] * (1 + 1e-9)  # ties after rounding
    q = np.concatenate([rng.integers(-3, 4, (700, 5)).astype(float), np.zeros((1, 5))])
    places, same = rng.permutation(len(v)), np.ones(len(v), bool)
    scores = np.round(retrieval._scores(q, v, metric), 6)
    got = [[] for _ in q]
    for at_query, at_key, found in retrieval._best(q, v, places, 7, metric, same):
        for i, j, s in zip(at_query.tolist(), at_key.tolist(), found.tolist(), strict=True):
            got[i].append((s if metric == "l2" else -s, int(places[j])))
    want = [sorted(zip((row if metric == "l2" else -row).tolist(), places.tolist(), strict=True))[:7] for row in scores]
    assert got == want


def test_a_query_that_is_asked_often_is_searched_for_once(spark, monkeypatch):
    asked, search = [], retrieval.vector_search
    monkeypatch.setattr(retrieval, "vector_search", lambda queries, *a: (asked.append(queries.count()), search(queries, *a))[1])
    corpus = spark.createDataFrame([(f"c{i}", [float(i % 7), 1.0, float(i)]) for i in range(50)], "id string, vector array<float>")
    vectors = [[1.0, 2.0, 3.0], [0.0, 1.0, 0.0], [5.0, 1.0, -1.0]]
    queries = spark.createDataFrame([(i, vectors[i % 3]) for i in range(60)], "query_id int, vector array<float>")
    got = retrieval.every_profile_search(queries, corpus, 4, 1)
    one = {i: [(r.id, r.score, r.rank) for r in search(queries.where(f"query_id = {i}"), corpus, 4).orderBy("rank").collect()] for i in range(3)}
    rows = {}
    for r in got.orderBy("rank").collect():
        rows.setdefault(r.query_id, []).append((r.id, r.score, r.rank))
    assert asked == [3] and rows == {i: one[i % 3] for i in range(60)}
