import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking, retrieval

PARAMETERS = [(6, 2), (5, 0), (5, 4), (7, 5), (1, 0), (100, 3), (4, 4), (3, 9)]


def windows(text, size, overlap):
    """The definition: windows a step apart, up to the first that reaches the end."""
    out, at = [], 0
    while text and size > 0:
        out.append(text[at : at + size])
        if at + size >= len(text):
            break
        at += max(size - overlap, 1)
    return [c for c in (x.strip(" \t\n\x0b\x0c\r\x85\xa0　") for x in out) if c]


@pytest.mark.parametrize("size, overlap", PARAMETERS)
def test_fixed_windows_equal_the_definition(spark, size, overlap):
    rng = random.Random(size)
    texts = ["", None, "🙂" * 9, " \n", "　ab　"] + ["".join(rng.choice("ab \n　é🙂\xa0") for _ in range(rng.randrange(60))) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.c for r in df.select("i", chunking.fixed_windows(F.col("text"), size, overlap).alias("c")).collect()}
    assert [got[i] for i in range(len(texts))] == [windows(t, size, overlap) for t in texts]


def test_windows_of_a_very_long_text_take_linear_time(spark):
    text = "Wört er, und🙂 noch. " * 160_000
    df = spark.createDataFrame([(1, text)], "doc_id int, text string").cache()
    df.count()
    chunking.chunk_fixed(df, 500, 80).count()
    start = time.time()
    assert chunking.chunk_fixed(df, 500, 80).count() == len(windows(text, 500, 80))
    assert time.time() - start < 10  # 75 s when each window counted from the start; 1 s alone on this machine


def test_corpus_counts(spark):
    corpus = spark.createDataFrame([(1, "aaaa bb"), (2, ""), (3, None), (4, "bé🙂")], "id int, text string").repartition(3)
    terms = spark.createDataFrame([("aa",), ("b",), ("",), ("zz",), ("b",)], "term string")
    got = {r.term: tuple(r)[1:] for r in retrieval.corpus_counts(terms, corpus).collect()}
    assert {t: c[0] for t, c in got.items() if t} == {"aa": 1, "b": 2} and got[None] == (4, 3, 10)
    assert {r.term: tuple(r)[1:] for r in retrieval.corpus_counts(terms.limit(0), corpus).collect()} == {None: (4, 3, 10)}
    assert retrieval.corpus_counts(terms, corpus.limit(0)).where("df > 0").count() == 0
