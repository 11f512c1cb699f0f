"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter holds the n-grams of all languages: each slot is a mask with one bit per language, and
the AND of an n-gram's slots gives all languages that contain it in one look-up. A language's score is the share of
the text's n-grams that it contains, corrected for its filter's false positives. A second filter holds the n-grams
that are typical of a language, used SHARE times as often as by the languages on average; the language with the largest
sum of both shares is taken, so languages that share their n-grams are told apart where that's possible, and score alike.

Fitting is bounded: SAMPLE_DOCS labelled documents per language at most (drawn by a hash of the id), of which each
language keeps all n-grams that it uses LEAST times. All languages take part, WORD of them in each integer of a slot (the
filters, on the driver and on each executor, take 16 MB for each WORD languages). Prediction reads every n-gram of the whole text.

Defined results: text that is null or has no letter gives ``und`` with score 0; null ids are not learned from;
empty tables give no rows, and with nothing learned every text is ``und``; equal scores go to the smallest
language name; other columns are ignored by ``predict``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._words import mix64, slices

SAMPLE_DOCS = 1500
SIZES = (2, 3, 4)
SLOTS = 1 << 20
HASHES = 2
SHARE = 1.5
LEAST = 3
WORD = 64
SLICE_BYTES = 1 << 20
UNKNOWN = "und"


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased characters of all texts, runs of non-letters as single spaces, and the text of each character."""
    lowered = pc.utf8_lower(column.fill_null(""))
    # One boundary mark on each side keeps word starts and ends visible and texts apart.
    cleaned = pc.replace_substring_regex(lowered, r"[^\pL\pM]+", " ")
    cleaned = pc.binary_join_element_wise("", pc.utf8_trim(cleaned, " "), "", " ")
    joined = "".join(cleaned.to_pylist())
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lens = pc.utf8_length(cleaned).to_numpy(zero_copy_only=False)
    return codes, np.repeat(np.arange(len(lens)), lens)


def _grams(codes: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hash and text of every n-gram, size by size; n-grams don't cross words, but hold a boundary mark."""
    space = codes == 32
    for n in SIZES:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        ok = rows[:m] == rows[n - 1 :]
        for j in range(1, n - 1):  # a mark may stand first or last only
            ok &= ~space[j : m + j]
        if n == 2:
            ok &= ~(space[:m] & space[1:])
        at = np.flatnonzero(ok)
        value = np.full(len(at), n, np.uint64)
        for j in range(n):
            value = value * np.uint64(0x1FFFFF) + codes[at + j]
        yield mix64(value), rows[at]


def _slots(grams: np.ndarray) -> list[np.ndarray]:
    return [((grams >> np.uint64(k * 32)) & np.uint64(SLOTS - 1)).astype(np.int64) for k in range(HASHES)]


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


class LanguageFilters:
    """The fitted filters: ``masks`` (SLOTS integers for each WORD languages) of contained n-grams, ``typical`` ones alike."""

    def __init__(self, languages: list[str], masks: np.ndarray, typical: np.ndarray | None = None):
        self.languages, self.masks = languages, np.atleast_2d(masks)
        self.typical = np.zeros_like(self.masks) if typical is None else np.atleast_2d(typical)
        self.false, self.false_typical = (self._false(m) for m in (self.masks, self.typical))

    def _false(self, masks: np.ndarray) -> np.ndarray:
        """The false positive rate of each language."""
        return np.array([(np.count_nonzero(self._bit(masks, b)) / SLOTS) ** HASHES for b in range(len(self.languages))])

    @staticmethod
    def _bit(masks, b: int) -> np.ndarray:
        word = masks[b // WORD]
        return word & word.dtype.type(1 << b % WORD) != 0

    def knows(self) -> bool:
        """Whether any n-gram was learned."""
        return bool(self.masks.any())

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Best language (-1: none) and its score for each text."""
        codes, rows = _codes(column)
        n, k = len(column), len(self.languages)
        total, hits, marks = np.zeros(n), np.zeros((n, k)), np.zeros((n, k))
        for grams, of in _grams(codes, rows):
            slots = _slots(grams)
            total += np.bincount(of, minlength=n)
            for masks, counts in ((self.masks, hits), (self.typical, marks)):
                found = []
                for word in masks:
                    both = word[slots[0]]
                    for s in slots[1:]:
                        both &= word[s]
                    found.append(both)
                for b in range(k):  # the popcount of each language's slice, by text
                    counts[:, b] += np.bincount(of[self._bit(found, b)], minlength=n)
        corrected, typical = (
            np.clip((counts / np.maximum(total, 1)[:, None] - false) / np.maximum(1 - false, 1e-9), 0, 1)
            for counts, false in ((hits, self.false), (marks, self.false_typical))
        )
        best = (corrected + typical).argmax(1) if k else np.zeros(n, int)
        score = corrected[np.arange(n), best] if k else np.zeros(n)
        # Marks alone are no text; a single letter is, though it may hold no n-gram.
        letters = pc.match_substring_regex(column.fill_null(""), r"\pL").to_numpy(zero_copy_only=False)
        told = letters & (k > 0)
        return np.where(told, best, -1), np.where(told & (total > 0), score, 0.0)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=SLICE_BYTES):
        batch = batch.sort_by("lang")
        codes, rows = _codes(batch.column("text"))
        langs = batch.column("lang").to_pylist()
        names = sorted(set(langs))
        of_row = np.searchsorted(names, langs)
        for grams, of in _grams(codes, rows):
            ends = np.searchsorted(of_row[of], np.arange(len(names) + 1))
            for i, name in enumerate(names):
                values, counts = np.unique(grams[ends[i] : ends[i + 1]], return_counts=True)
                yield pa.RecordBatch.from_pydict(
                    {"lang": pa.array([name] * len(values), pa.string()), "gram": values.astype(np.int64), "n": counts.astype(np.int64)}
                )


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> LanguageFilters:
    """Learns from ``labelled`` (doc_id, text, lang): at most about ``sample_docs`` documents of each language."""
    known = labelled.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL")
    sizes = {r.lang: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageFilters([], np.zeros(SLOTS, np.uint8))
    keep = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, sample_docs / sizes[lang]))])
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) < F.element_at(keep, F.col("lang")) * (1 << 20)
    sample = known.where(drawn).select("lang", "text")
    counts = sample.mapInArrow(_gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    per_lang = F.create_map(*[F.lit(x) for lang in languages for x in (lang, float(max(totals.get(lang, 1), 1)))])
    rates = counts.withColumn("rate", F.col("n") / F.element_at(per_lang, F.col("lang")))
    by_gram = rates.groupBy("gram").agg(F.sum("rate").alias("all"), F.collect_list(F.struct("lang", "n", "rate")).alias("each"))  # one entry a language
    chosen = by_gram.select("gram", "all", F.explode("each").alias("e")).where(F.col("e.n") >= LEAST)
    number = F.element_at(F.create_map(*[F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)]), F.col("e.lang"))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(number, F.lit(WORD)))
    often = F.col("e.rate") * len(languages) >= F.col("all") * SHARE
    masked = chosen.select("gram", F.floor(number / WORD).alias("word"), mask.alias("mask"), F.when(often, mask).otherwise(0).alias("typical"))
    slots = F.array(*[F.call_function("shiftrightunsigned", F.col("gram"), F.lit(32 * k)).bitwiseAND(F.lit(SLOTS - 1)) for k in range(HASHES)])
    sliced = masked.select(F.explode(slots).alias("slot"), "word", "mask", "typical").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask"), F.bit_or("typical").alias("typical"))
    kind = next((t for t, most in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(languages) <= most), np.uint64)
    masks, typical = np.zeros((2, -(-len(languages) // WORD), SLOTS), kind)
    rows = sliced.toArrow()  # at most SLOTS rows for each WORD languages
    at = rows.column("word").to_numpy(), rows.column("slot").to_numpy()
    masks[at] = rows.column("mask").to_numpy().astype(np.uint64).astype(kind)
    typical[at] = rows.column("typical").to_numpy().astype(np.uint64).astype(kind)
    return LanguageFilters(languages, masks, typical)


def predict(docs: DataFrame, model: LanguageFilters) -> DataFrame:
    """``docs`` with lang_pred and score; all columns of ``docs`` stay."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, [zlib.compress(m.tobytes(), 1) for m in (model.masks, model.typical)], model.masks.dtype.str))
    plain = docs.drop("lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, masks, kind = shared.value
        filters = LanguageFilters(languages, *(np.frombuffer(zlib.decompress(m), kind).reshape(-1, SLOTS) for m in masks))
        for batch in slices(batches, limit=SLICE_BYTES):
            best, score = filters.score(batch.column("text"))
            pred = pa.array([filters.languages[i] if i >= 0 else UNKNOWN for i in best], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, pred, pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    schema = T.StructType([*plain.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return plain.mapInArrow(run, schema)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.select("doc_id", "text", "lang").where(~held_out()))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
