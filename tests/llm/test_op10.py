import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from tessera.llm import op10_language as m


def test_held_out_accuracy(spark, sf_dir):
    got = m.op10_language(spark, sf_dir)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    out = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out)
    assert all(0 <= r.score <= 1 for r in rows)


def test_filters_agree_with_sets_of_ngrams():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcdefg "), 200)) for _ in range(20)]
    codes, rows = m._codes(pa.array(texts))
    masks = np.zeros(m.SLOTS, np.uint8)
    sets = [set(), set()]
    for grams, of in m._grams(codes, rows):
        for lang in (0, 1):
            own = grams[of % 4 == lang]
            sets[lang] |= set(own.tolist())
            for s in m._slots(own):
                masks[s] |= np.uint8(1 << lang)
    model = m.LanguageFilters(["x", "y"], masks)
    best, score = model.score(pa.array(texts))
    for i, text in enumerate(texts):
        c, r = m._codes(pa.array([text]))
        grams = [g for gs, _ in m._grams(c, r) for g in gs.tolist()]
        exact = [sum(g in s for g in grams) / len(grams) for s in sets]
        assert abs(score[i] - max(exact)) < 0.02


def test_edges(spark):
    schema = "doc_id long, text string, lang string, score string, lang_pred string"
    empty = spark.createDataFrame([], schema)
    assert m.predict(empty, m.fit(empty)).count() == 0
    rows = [(i, f"the quick brown fox {i} jumps over lazy dogs", "en", "", "") for i in range(20)]
    rows += [(i + 100, f"der schnelle braune fuchs {i} springt weit", "de", "", "") for i in range(20)]
    rows += [(None, None, None, None, None), (7, "", "en", "", ""), (8, "123 %% 4", None, "", ""), (9, "the fox " * 60000, None, "", "")]
    docs = spark.createDataFrame(rows, schema)
    got = {r.text: (r.lang_pred, r.score) for r in m.predict(docs, m.fit(docs)).collect()}
    assert got[None] == got[""] == got["123 %% 4"] == ("und", 0.0)
    assert got["the fox " * 60000][0] == "en" and got["der schnelle braune fuchs 3 springt weit"][0] == "de"
    assert {r.lang_pred for r in m.predict(docs, m.fit(empty)).collect()} == {"und"}


def test_remainder_matches_crc32(spark):
    import zlib

    got = spark.range(50).select("id", m.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)
    assert spark.range(1).select(F.lit(None).cast("long").alias("i")).select(m.held_out("i").alias("h")).first().h is False


def learned(spark, langs):
    words = {"de": "der schnelle braune fuchs springt weit über {} faule hunde"}
    rows = [(i, words.get(lang, "the quick brown fox {} jumps over lazy dogs").format(i), lang, "s", 1) for lang in langs for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, m.predict(docs, m.fit(docs)).collect()


def test_one_language_twins_and_no_labels_stay(spark):
    import corpus_pipeline

    for langs in (["en"], ["en", "en-GB"], ["de", "en", "en-AU", "en-GB", "en-US"]):
        docs, got = learned(spark, langs)
        assert all(r.lang_pred[:2] == r.lang[:2] and r.score > 0.9 for r in got)
        assert corpus_pipeline.language_id(spark, docs, "").count() == docs.count()
    for langs in ([None], []):
        docs, got = learned(spark, langs)
        assert {r.lang_pred for r in got} <= {"und"}
        assert corpus_pipeline.language_id(spark, docs, "").count() == docs.count()


def test_more_languages_than_bits_of_a_word(spark):
    import random

    names = [f"l{i:03}" for i in range(130)]
    rows = []
    for i, name in enumerate(names):
        rng = random.Random(i)
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)]
        rows += [(i * 10 + j, " ".join(rng.sample(words, 12)), name) for j in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = m.predict(docs, m.fit(docs)).collect()
    assert len(got) == len(rows) and all(r.lang == r.lang_pred and r.score > 0.9 for r in got)


def brute_mix(x):
    mask = (1 << 64) - 1
    x = (x + 0x9E3779B97F4A7C15) & mask
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
    return x ^ (x >> 31)


def brute_grams(text):
    """Hashes of the n-grams of 2 to 4 characters of each word between boundary marks."""
    for word in regex.findall(r"[\p{L}\p{M}]+", (text or "").lower()):
        marked = f" {word} "
        for n in m.SIZES:
            for i in range(len(marked) - n + 1):
                value = n
                for c in marked[i : i + n]:
                    value = (value * 0x1FFFFF + ord(c)) & ((1 << 64) - 1)
                yield brute_mix(value)


def test_fit_and_predict_equal_brute_force(spark, sf_dir):
    """Sets of slots in plain Python; every labelled document is in the sample."""
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    counts = {}
    for doc, text, lang in rows:
        if text is not None and lang is not None and doc is not None and zlib.crc32(str(doc).encode()) % 4 != 2:
            counts.setdefault(lang, Counter()).update(brute_grams(text))
    languages = sorted(counts)
    rate = {lang: {g: n / sum(counts[lang].values()) for g, n in counts[lang].items()} for lang in languages}
    places = lambda g: (g & (m.SLOTS - 1), g >> 32 & (m.SLOTS - 1))
    holds, typical = ({lang: set() for lang in languages} for _ in range(2))
    for lang in languages:
        for g, n in counts[lang].items():
            if n >= m.LEAST:
                holds[lang].update(places(g))
                if rate[lang][g] * len(languages) >= sum(rate[x].get(g, 0) for x in languages) * m.SHARE:
                    typical[lang].update(places(g))
    want = {}
    for doc, text, _ in rows:
        grams = list(brute_grams(text))
        if not regex.search(r"\p{L}", text or ""):
            want[doc] = ("und", 0.0)
            continue
        each = []
        for lang in languages:
            shares = []
            for slots in (holds[lang], typical[lang]):
                false = (len(slots) / m.SLOTS) ** 2
                share = sum(a in slots and b in slots for a, b in map(places, grams)) / max(len(grams), 1)
                shares.append(min(max((share - false) / (1 - false), 0), 1))
            each.append((sum(shares), shares[0], lang))
        best = max(each, key=lambda x: (round(x[0], 12), [-ord(c) for c in x[2]]))
        want[doc] = (best[2], best[1] if grams else 0.0)
    got = {r.doc_id: (r.lang_pred, r.score) for r in m.op10_language(spark, sf_dir).collect()}
    assert got.keys() == want.keys()
    for doc, (lang, score) in got.items():
        assert lang == want[doc][0] and abs(score - want[doc][1]) < 1e-9, doc


def test_marks_are_no_letters_and_ties_go_to_the_smallest_name(spark):
    labelled = spark.createDataFrame([(i, "the same words in both", lang) for i, lang in enumerate(["nn", "nb"] * 5)], "doc_id long, text string, lang string")
    model = m.fit(labelled)
    docs = spark.createDataFrame([(1, "\u0301"), (2, "the same words"), (3, "e\u0301"), (4, "12 %"), (5, None)], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in m.predict(docs, model).collect()}
    assert got == {1: "und", 2: "nb", 3: "nb", 4: "und", 5: "und"}
