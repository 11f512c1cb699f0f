import math
import random
from functools import lru_cache

import pytest
import regex
from pyspark.sql import functions as F

from tessera.functions import segment
from tessera.operators import retrieval


def every_cut(text):
    if not text:
        yield []
    for i in range(1, len(text) + 1):
        for rest in every_cut(text[i:]):
            yield [text[:i], *rest]


def best_by_hand(words, text):
    """The cut of the greatest sum among all cuts whose longer parts are words; of equals the one with longer words first."""
    total = math.log(sum(words.values()))
    value = lambda w: math.log(words[w]) - total if w in words else -total - math.log(2) if len(w) == 1 else None
    cuts = [c for c in every_cut(text) if all(value(w) is not None for w in c)]
    return max(cuts, key=lambda c: (round(sum(map(value, c)), 9), [len(w) for w in c]))


def test_best_path_equals_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        words = {"".join(rng.choices("abc", k=rng.randrange(1, 5))): rng.choice([1, 2, 5, 40]) for _ in range(rng.randrange(1, 12))}
        known = segment.Dictionary({w: float(n) for w, n in words.items()})
        text = "".join(rng.choices("abcd", k=rng.randrange(1, 11)))
        assert [w for w, _ in known._best(text)] == best_by_hand(words, text), (words, text)


def test_han_words_users_words_and_unknown_stretches():
    words = {"毛利": 10.0, "毛利率": 30.0, "宁德": 5.0, "时代": 8.0, "利率": 12.0, "多少": 9.0, "battery": 3.0}
    assert segment.Dictionary(words).cut("宁德时代毛利率多少? batteryX9 鿿鿾") == ["宁德", "时代", "毛利率", "多少", "battery", "X9", "鿿", "鿾"]
    assert segment.Dictionary(words, ["宁德时代", "时代毛"]).cut("宁德时代毛利率") == ["宁德时代", "毛利率"]
    assert segment.Dictionary({}, []).cut("ab cd_ef") == ["ab", "cd", "ef"]
    assert segment.Dictionary(words).cut(None) == segment.Dictionary(words).cut(" ,") == []


def test_time_grows_with_the_text():
    known = segment.Dictionary({"ab": 2.0, "ba": 1.0})
    assert "".join(known.cut("ab" * 200_000)) == "ab" * 200_000


def test_as_a_segmenter_of_bm25(spark):
    docs = spark.createDataFrame([(1, "kata kita kata"), (2, "kita pohon"), (3, None)], "id int, text string")
    known = segment.dictionary(segment.frequent_words(docs, 10), ["pohon"])
    terms = segment.segmenter(known)
    rows = spark.createDataFrame([(1, "katakitaX"), (2, None), (3, "POHON der pohonkata")], "query_id int, text string")
    got = {r.query_id: r.t for r in rows.select("query_id", terms(F.col("text")).alias("t")).collect()}
    assert got == {1: ["kata", "kita"], 2: [], 3: ["POHON", "der", "pohon", "kata"]}
    hits = retrieval.bm25_search(rows.where("query_id = 1"), docs, 2, terms).collect()
    assert [h.id for h in sorted(hits, key=lambda h: h["rank"])] == [1, 2]


def test_size_is_checked(spark, monkeypatch):
    monkeypatch.setattr(segment, "MOST_WORDS", 2)
    with pytest.raises(ValueError):
        segment.dictionary(spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "word string, n long"))


def test_registered_query_equals_plain_python(spark, sf_dir):
    from tessera import registry

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()
    counts = {}

    for r in rows:
        for w in regex.findall(r"[\p{L}\p{N}]+", r.text.lower()):
            if len(w) > 1:
                counts[w] = counts.get(w, 0) + 1
    total = math.log(sum(counts.values()))

    @lru_cache(None)
    def best(text):
        """(sum, lengths, words): straight recursion over the first word."""
        if not text:
            return 0.0, (), ()
        found = []
        for i in range(1, min(len(text), 40) + 1):
            w = text[:i]
            if w in counts or i == 1:
                s, lengths, words = best(text[i:])
                value = math.log(counts[w]) - total if w in counts else -total - math.log(2)
                found.append((value + s, (i, *lengths), ((w, w in counts), *words)))
        top = max(f[0] for f in found)
        return max((f for f in found if f[0] >= top - segment.TIE), key=lambda f: f[1])

    got = {r.query_id: r.terms for r in registry.QUERIES["dictionary_segments"](spark, sf_dir).collect()}
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    assert len(got) == len(items)
    for r in items:
        best.cache_clear()
        words = []
        for w, known in best(regex.sub(r"[^\p{L}\p{N}]+", "", r.text.lower()))[2]:
            if not known and words and not words[-1][1]:
                words[-1] = (words[-1][0] + w, False)
            else:
                words.append((w, known))
        assert got[r.item_id] == [w for w, _ in words if len(w) > 1]
